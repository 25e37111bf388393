"""Closed vocabularies of sources and sinks, and the catalogs made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The names of sources and sinks, spelled as users' rules spell them.
ATTACKER_SOURCES = """
CHROME_SENDMESSAGE_EXTERNAL_RESPONSE CHROME_SENDNATIVEMESSAGE_EXTERNAL_RESPONSE CHROME_CONNECT_ONMESSAGE_EXTERANL CHROME_ONMESSAGEEXTERNAL_MESSAGE
CHROME_ONCONNECTEXTERNAL_ONMESSAGE CHROME_CONNECTNATIVE_ONMESSAGE WINDOW_MESSAGE_EVENT WINDOW_CUSTOM_EVENT TARGET_CUSTOM_EVENT
""".split()
WEB_EVENT_SOURCES = """
WINDOW_MESSAGE_EVENT WINDOW_CUSTOM_EVENT TARGET_CUSTOM_EVENT
""".split()
SENSITIVE_SOURCES = """
CHROME_TABS_DETECT_LANUAGE CHROME_TABS_CAPUTURE_VISIBLE_TAB CHROME_BOOKMARK_INFO CHROME_COOKIES_INFO CHROME_COOKIES_STORE CHROME_HISTORY_INFO
CHROME_READINGLIST_INFO CHROME_MANAGEMENT_INFO CHROME_DOWNLOADS_SEARCH CHROME_DOWNLOADS_FILEICON CHROME_TOPSITES_INFO CHROME_PAGECAPTURE_MHTML
CHROME_IDENTITY_TOKEN CHROME_IDENTITY_PROFILE CHROME_MANAGED_STORAGE CHROME_BOOKMARKS_ONCREATED CHROME_COOKIES_ONCHANGED CHROME_DOWNLOADS_ONCHANGED
CHROME_DOWNLOADS_ONCREATED CHROME_HISTORY_ONVISITED CHROME_MANAGEMENT_ONENABLED CHROME_MANAGEMENT_ONDISABLED CHROME_MANAGEMENT_ONINSTALLED
""".split()
SYSTEM_SOURCES = """
NAVIGAROR_GEOLOCATION NAVIGATOR_CLIPBOARD NAVIGATOR_CONNECTION NAVIGATOR_DEVICE_MEMORY NAVIGATOR_HARDWARE_CONCURRENCY NAVIGATOR_LANGUAGE
NAVIGATOR_MAX_TOUCH_POINTS NAVIGATOR_PLATFORM NAVIGATOR_PLUGINS NAVIGATOR_USER_AGENT NAVIGATOR_GPU_ADAPTER SCREEN_INFO CHROME_FONTSETTINGS_FONTLIST
CHROME_SYSTEM_CPU CHROME_SYSTEM_DISPLAY_LAYOUT CHROME_SYSTEM_DISPLAY CHROME_SYSTEM_MEMORY CHROME_SYSTEM_STORAGE
""".split()
NETWORK_SOURCES = """
JQUERY_AJAX_RESPONSE FETCH_RESPONSE XML_HTTP_RESPONSE AXIOS_RESPONSE AXIOS_GET_RESPONSE AXIOS_POST_RESPONSE AXIOS_REQUEST_RESPONSE
""".split()
DOCUMENT_SOURCES = """
ELEMENT_TEXT_CONTENT ELEMENT_INNER_HTML ELEMENT_OUTER_HTML ELEMENT_VALUE JQUERY_ELEMENT_VAL JQUERY_ELEMENT_TEXT JQUERY_ELEMENT_HTML DOCUMENT_COOKIE
DOCUMENT_URL DOCUMENT_TITLE
""".split()
STORAGE_SOURCES = """
STORAGE_ALL_ITEMS
""".split()
CODE_SINKS = """
NEW_FUNCTION EVAL TIME_EVAL JQUERY_GLOBAL_EVAL VUE_COMPILE WASM_INSTANTIATE WORKER_URL CHROME_DEBUGGER_COMMAND
""".split()
NETWORK_SINKS = """
FETCH_RESOURCE FETCH_OPTIONS FETCH_BODY FETCH_HEADERS JQUERY_AJAX_URL JQUERY_AJAX_DATA JQUERY_AJAX_SETTINGS_URL JQUERY_AJAX_SETTINGS_DATA
JQUERY_GET_URL JQUERY_GET_DATA JQUERY_POST_URL JQUERY_POST_DATA JQUERY_SETTINGS_URL JQUERY_SETTINGS_DATA XML_HTTP_REQUEST_OPEN XML_HTTP_REQUEST_SEND
XML_HTTP_REQUEST_SETHEADER AXIOS_URL AXIOS_DATA AXIOS_HEADERS WEBSOCKET_URL WEBSOCKET_DATA
""".split()
MESSAGE_SINKS = """
CHROME_RUNTIME_SENDMESSAGE_EXTERNAL CHROME_RUNTIME_CONNECT_POSTMESSAGE_EXTERNAL CHROME_RUNTIME_ONMESSAGEEXTERNAL_SENDRESPONSE
CHROME_RUNTIME_ONCONNECTEXTERNAL_POSTMESSAGE CHROME_RUNTIME_SENDNATIVEMESSAGE_EXTERNAL CHROME_RUNTIME_ONCONNECTNATIVE_POSTMESSAGE WINDOW_POSTMESSAGE
""".split()
DOM_SINKS = """
JQUERY_ELEMENT_VAL_SET JQUERY_ELEMENT_TEXT_SET JQUERY_ELEMENT_HTML_SET DOCUMENT_WRITE DOCUMENT_EXECCOMMAND DOM_INNER_HTML REACT_DANGEROUS_HTML
VUE_V_HTML ANGULAR_BYPASS_SECURITY
""".split()
STORAGE_SINKS = """
CHROME_LOCAL_STORAGE CHROME_SYNC_STORAGE CHROME_SESSION_STORAGE
""".split()
WEB_STORAGE_SINKS = """
WEB_LOCAL_STORAGE_SET_KEY WEB_LOCAL_STORAGE_SET_VALUE WEB_SESSION_STORAGE_SET_KEY WEB_SESSION_STORAGE_SET_VALUE
""".split()
PRIVILEGED_SINKS = """
WEB_LOCAL_STORAGE_REMOVE WEB_SESSION_STORAGE_REMOVE CHROME_ACTION_DISABLE_TABID CHROME_ACTION_ENABLE_TABID CHROME_ACTION_BADGE_OPTIONS
CHROME_ACTION_ICON_OPTIONS CHROME_ACTION_POPUP_OPTIONS CHROME_ACTION_TITLE_OPTIONS CHROME_ALARMS_CREATE_OPTIONS CHROME_ALARMS_CLEAR_NAME
CHROME_BOOKMARK_CREATE_INFO CHROME_BOOKMARK_MOVE_ID CHROME_BOOKMARK_MOVE_DESTINATION CHROME_BOOKMARK_REMOVE_ID CHROME_BOOKMARK_REMOVE_TREE_ID
CHROME_BOOKMARK_UPDATE_ID CHROME_BOOKMARK_UPDATE_INFO CHROME_BROWSINGDATA_REMOVE CHROME_COOKIES_SET_OPTIONS CHROME_COOKIES_REMOVE_OPTIONS
CHROME_CONTENTSETTINGS_SET CHROME_CONTENTSETTINGS_CLEAR CHROME_DECLARATIVECONTENT_RULES CHROME_DECLARATIVECONTENT_RULE_IDS
CHROME_DECLARATIVENETREQUEST_RULES CHROME_DOWNLOADS_REMOVE_ID CHROME_DOWNLOADS_OPTIONS CHROME_FONTSETTINGS_SET_OPTIONS
CHROME_FONTSETTINGS_SIZE_OPTIONS CHROME_GCM_SEND CHROME_HISTORY_ADD_URL CHROME_HISTORY_DELETE_RANGE CHROME_HISTORY_DELETE_URL
CHROME_MANAGEMENT_SETENABLED_ID CHROME_MANAGEMENT_SETENABLED_FLAG CHROME_MANAGEMENT_UNINSTALL_ID CHROME_MANAGEMENT_LAUNCHAPP_ID
CHROME_NOTIFICATIONS_CREATE_OPTIONS CHROME_NOTIFICATIONS_UPDATE_ID CHROME_NOTIFICATIONS_UPDATE_OPTIONS CHROME_NOTIFICATIONS_CLEAR_ID
CHROME_PROXY_SETTINGS_SET CHROME_READINGLIST_ADD_OPTIONS CHROME_READINGLIST_REMOVE_URL CHROME_READINGLIST_UPDATE_OPTIONS CHROME_WINDOWS_UPDATE_OPTIONS
CHROME_WINDOWS_CREATE_OPTIONS CHROME_TABS_CREATE_OPTIONS CHROME_TABS_EXECUTE
""".split()

#: (names, capability) in order of classification; the first list that has a name decides.
SOURCE_LISTS = (
    (ATTACKER_SOURCES, "ATTACKER_INPUT"),
    (SENSITIVE_SOURCES, "SENSITIVE_DATA"),
    (SYSTEM_SOURCES, "SYSTEM_INFO"),
    (NETWORK_SOURCES, "NETWORK_RESPONSE"),
    (DOCUMENT_SOURCES, "WEB_CONTENT"),
    (STORAGE_SOURCES, "STORAGE_DATA"),
)
SINK_LISTS = (
    (CODE_SINKS, "CODE_EXECUTION"),
    (NETWORK_SINKS, "NETWORK_SEND"),
    (MESSAGE_SINKS, "MESSAGE_RESPONSE"),
    (DOM_SINKS, "DOM_WRITE"),
    (STORAGE_SINKS, "STORAGE_WRITE"),
    (PRIVILEGED_SINKS, "PRIVILEGED_OPERATION"),
)


def _catalog(spark: SparkSession, lists) -> DataFrame:
    rows: dict[str, tuple[str, str, int]] = {}
    for k, (names, capability) in enumerate(lists):
        for n in names:
            rows.setdefault(n, (n, capability, k))
    return spark.createDataFrame(list(rows.values()), "type string, capability string, priority int")


def source_catalog(spark: SparkSession) -> DataFrame:
    """type, capability, priority: a row for each source."""
    return _catalog(spark, SOURCE_LISTS)


def sink_catalog(spark: SparkSession) -> DataFrame:
    """type, capability, priority: a row for each sink."""
    return _catalog(spark, SINK_LISTS)
