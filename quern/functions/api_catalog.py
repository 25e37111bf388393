"""What browser, language and library functions do to values: a catalog built from rules.

A line is: names | what they do. Braces in a name stand for each of their parts. What they do, in order:

    sink TAG...        the k-th argument is a sink of the k-th tag; TAG@n names the argument; TAG@this the receiver
    source TAG         the result is a source (or, with a callback, the callback's first parameter)
    event TAG n        the n-th parameter of the listener is a source
    reply TAG n        calls of the listener's n-th parameter are sinks
    flow KIND          arguments and receiver flow into the result
    clean              the result is free of taint
    call n             the n-th argument is called
    frame, bridge, summary   facts for other joins; nothing flows by itself
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, SparkSession

# Names, tags and argument places of the functions that are known.
CHROME = """
chrome.action.disable | sink CHROME_ACTION_DISABLE_TABID; call 1
chrome.action.enable | sink CHROME_ACTION_ENABLE_TABID; call 1
chrome.action.openPopup | call 0
chrome.action.setBadgeText | sink CHROME_ACTION_BADGE_OPTIONS; call 1
chrome.action.setIcon | sink CHROME_ACTION_ICON_OPTIONS; call 1
chrome.action.setPopup | sink CHROME_ACTION_POPUP_OPTIONS; call 1
chrome.action.setTitle | sink CHROME_ACTION_TITLE_OPTIONS; call 1
chrome.alarms.create | sink CHROME_ALARMS_CREATE_OPTIONS@1; call 2
chrome.alarms.clear | sink CHROME_ALARMS_CLEAR_NAME; call 1
chrome.bookmarks.{get,getChildren,getRecent,getSubTree,search} | source CHROME_BOOKMARK_INFO; call 1
chrome.bookmarks.getTree | source CHROME_BOOKMARK_INFO; call 0
chrome.bookmarks.create | sink CHROME_BOOKMARK_CREATE_INFO; call 1
chrome.bookmarks.move | sink CHROME_BOOKMARK_MOVE_ID CHROME_BOOKMARK_MOVE_DESTINATION; call 2
chrome.bookmarks.remove | sink CHROME_BOOKMARK_REMOVE_ID; call 1
chrome.bookmarks.removeTree | sink CHROME_BOOKMARK_REMOVE_TREE_ID; call 1
chrome.bookmarks.update | sink CHROME_BOOKMARK_UPDATE_ID CHROME_BOOKMARK_UPDATE_INFO; call 2
chrome.bookmarks.onCreated.addListener | event CHROME_BOOKMARKS_ONCREATED 1; call 0
chrome.browsingData.{remove,removeAppcache,removeCache,removeCacheStorage,removeCookies,removeDownloads,removeFileSystems,removeFormData,removeHistory,removeIndexedDB,removeLocalStorage,removePasswords,removeServiceWorkers,removeWebSQL} | sink CHROME_BROWSINGDATA_REMOVE; call 1
chrome.contentSettings.{autoVerify,automaticDownloads,camera,clipboard,cookies,images,javascript,location,microphone,notifications,popups,sound}.set | sink CHROME_CONTENTSETTINGS_SET; call 1
chrome.contentSettings.{autoVerify,automaticDownloads,camera,clipboard,cookies,images,javascript,location,microphone,notifications,popups,sound}.clear | sink CHROME_CONTENTSETTINGS_CLEAR; call 1
chrome.cookies.{getAll,get} | source CHROME_COOKIES_INFO; call 1
chrome.cookies.getAllCookieStores | source CHROME_COOKIES_STORE; call 0
chrome.cookies.set | sink CHROME_COOKIES_SET_OPTIONS; call 1
chrome.cookies.remove | sink CHROME_COOKIES_REMOVE_OPTIONS; call 1
chrome.cookies.onChanged.addListener | event CHROME_COOKIES_ONCHANGED 0; call 0
chrome.debugger.sendCommand | sink CHROME_DEBUGGER_COMMAND@2; call 3
chrome.declarativeContent.onPageChanged.addRules | sink CHROME_DECLARATIVECONTENT_RULES; call 1
chrome.declarativeContent.onPageChanged.removeRules | sink CHROME_DECLARATIVECONTENT_RULE_IDS; call 1
chrome.declarativeNetRequest.{updateDynamicRules,updateSessionRules,updateEnabledRulesets} | sink CHROME_DECLARATIVENETREQUEST_RULES; call 1
chrome.devtools.panels.create | frame 2; call 3
chrome.downloads.search | source CHROME_DOWNLOADS_SEARCH; call 1
chrome.downloads.getFileIcon | source CHROME_DOWNLOADS_FILEICON; call 2
chrome.downloads.download | sink CHROME_DOWNLOADS_OPTIONS; call 1
chrome.downloads.removeFile | sink CHROME_DOWNLOADS_REMOVE_ID; call 1
chrome.downloads.onChanged.addListener | event CHROME_DOWNLOADS_ONCHANGED 0; call 0
chrome.downloads.onCreated.addListener | event CHROME_DOWNLOADS_ONCREATED 0; call 0
chrome.fontSettings.setFont | sink CHROME_FONTSETTINGS_SET_OPTIONS; call 1
chrome.fontSettings.getFontList | source CHROME_FONTSETTINGS_FONTLIST; call 0
chrome.fontSettings.setDefaultFontSize | sink CHROME_FONTSETTINGS_SIZE_OPTIONS; call 1
chrome.gcm.send | sink CHROME_GCM_SEND; call 1
chrome.history.{search,getVisits} | source CHROME_HISTORY_INFO; call 1
chrome.history.addUrl | sink CHROME_HISTORY_ADD_URL; call 1
chrome.history.deleteRange | sink CHROME_HISTORY_DELETE_RANGE; call 1
chrome.history.deleteUrl | sink CHROME_HISTORY_DELETE_URL; call 1
chrome.history.onVisited.addListener | event CHROME_HISTORY_ONVISITED 0; call 0
chrome.identity.getAuthToken | source CHROME_IDENTITY_TOKEN; call 1
chrome.identity.getProfileUserInfo | source CHROME_IDENTITY_PROFILE; call 1
chrome.management.get | source CHROME_MANAGEMENT_INFO; call 1
chrome.management.getAll | source CHROME_MANAGEMENT_INFO; call 0
chrome.management.setEnabled | sink CHROME_MANAGEMENT_SETENABLED_ID CHROME_MANAGEMENT_SETENABLED_FLAG; call 2
chrome.management.uninstall | sink CHROME_MANAGEMENT_UNINSTALL_ID; call 2
chrome.management.launchApp | sink CHROME_MANAGEMENT_LAUNCHAPP_ID; call 1
chrome.management.onEnabled.addListener | event CHROME_MANAGEMENT_ONENABLED 0; call 0
chrome.management.onDisabled.addListener | event CHROME_MANAGEMENT_ONDISABLED 0; call 0
chrome.management.onInstalled.addListener | event CHROME_MANAGEMENT_ONINSTALLED 0; call 0
chrome.notifications.create | sink CHROME_NOTIFICATIONS_CREATE_OPTIONS@1; call 2
chrome.notifications.update | sink CHROME_NOTIFICATIONS_UPDATE_ID CHROME_NOTIFICATIONS_UPDATE_OPTIONS; call 2
chrome.notifications.clear | sink CHROME_NOTIFICATIONS_CLEAR_ID; call 1
chrome.offscreen.createDocument | frame 0
chrome.offscreen.{closeDocument,hasDocument} | summary
chrome.pageCapture.saveAsMHTML | source CHROME_PAGECAPTURE_MHTML; call 1
chrome.proxy.settings.set | sink CHROME_PROXY_SETTINGS_SET; call 1
chrome.readingList.query | source CHROME_READINGLIST_INFO; call 1
chrome.readingList.addEntry | sink CHROME_READINGLIST_ADD_OPTIONS; call 1
chrome.readingList.removeEntry | sink CHROME_READINGLIST_REMOVE_URL; call 1
chrome.readingList.updateEntry | sink CHROME_READINGLIST_UPDATE_OPTIONS; call 1
chrome.scripting.executeScript | frame 0; call 1
chrome.sidePanel.{setOptions,setPanelBehavior,open} | summary
chrome.storage.local.set | sink CHROME_LOCAL_STORAGE; bridge; call 1
chrome.storage.sync.set | sink CHROME_SYNC_STORAGE; bridge; call 1
chrome.storage.session.set | sink CHROME_SESSION_STORAGE; bridge; call 1
chrome.storage.{local,sync,session}.get | source STORAGE_ALL_ITEMS; bridge; call 1
chrome.storage.onChanged.addListener | bridge; call 0
chrome.storage.managed.get | source CHROME_MANAGED_STORAGE; call 1
chrome.system.cpu.getInfo | source CHROME_SYSTEM_CPU; call 0
chrome.system.display.getDisplayLayout | source CHROME_SYSTEM_DISPLAY_LAYOUT; call 0
chrome.system.display.getInfo | source CHROME_SYSTEM_DISPLAY; call 1
chrome.system.memory.getInfo | source CHROME_SYSTEM_MEMORY; call 0
chrome.system.storage.getInfo | source CHROME_SYSTEM_STORAGE; call 0
chrome.tabs.captureVisibleTab | source CHROME_TABS_CAPUTURE_VISIBLE_TAB; call 2
chrome.tabs.detectLanguage | source CHROME_TABS_DETECT_LANUAGE; call 1
chrome.tabs.create | sink CHROME_TABS_CREATE_OPTIONS; call 1
chrome.tabs.executeScript | sink CHROME_TABS_EXECUTE@1; frame 1; call 2
chrome.topSites.get | source CHROME_TOPSITES_INFO; call 0
chrome.windows.create | sink CHROME_WINDOWS_CREATE_OPTIONS; call 1
chrome.windows.update | sink CHROME_WINDOWS_UPDATE_OPTIONS@1; call 2
"""
MESSAGES = """
chrome.runtime.onMessageExternal.addListener | event CHROME_ONMESSAGEEXTERNAL_MESSAGE 0; reply CHROME_RUNTIME_ONMESSAGEEXTERNAL_SENDRESPONSE 2; call 0
chrome.runtime.sendNativeMessage | source CHROME_SENDNATIVEMESSAGE_EXTERNAL_RESPONSE; sink CHROME_RUNTIME_SENDNATIVEMESSAGE_EXTERNAL@1; call 2
"""
BROWSER = """
{decodeURI,encodeURI,decodeURIComponent,encodeURIComponent,atob,btoa} | flow RETURN
{parseInt,parseFloat,isNaN,isFinite} | flow RETURN
eval | sink EVAL
Blob.prototype.{constructor,slice,arrayBuffer,stream,bytes} | summary
Blob.prototype.text | flow RETURN
Worker.prototype.constructor | sink WORKER_URL
WebAssembly.{instantiate,instantiateStreaming,compile,compileStreaming} | sink WASM_INSTANTIATE
crypto.subtle.{digest,sign} | clean
crypto.subtle.{encrypt,decrypt} | flow RETURN
location.toString | source DOCUMENT_URL
document.{getElementById,querySelector,querySelectorAll} | source ELEMENT_TEXT_CONTENT; source ELEMENT_INNER_HTML; source ELEMENT_OUTER_HTML; source ELEMENT_VALUE
document.write | sink DOCUMENT_WRITE
document.execCommand | sink DOCUMENT_EXECCOMMAND@2
addEventListener | event WINDOW_MESSAGE_EVENT 0; event WINDOW_CUSTOM_EVENT 0; event ELEMENT_VALUE 0; call 1
target.addEventListener | event WINDOW_MESSAGE_EVENT 0; event TARGET_CUSTOM_EVENT 0; event ELEMENT_VALUE 0; call 1
postMessage | sink WINDOW_POSTMESSAGE
FormData.prototype.{constructor,append,set} | summary
FormData.prototype.{get,getAll} | flow RETURN
Qi.{open,put,get,count,clear} | summary
Qi.cursor | call 0
indexedDB.open | summary
IDBDatabase.transaction | summary
IDBTransaction.objectStore | summary
IDBObjectStore.{put,get,openCursor,count,clear} | summary
IDBCursor.continue | summary
navigator.geolocation.{getCurrentPosition,watchPosition} | source NAVIGAROR_GEOLOCATION; call 0
navigator.clipboard.{readText,read} | source NAVIGATOR_CLIPBOARD
navigator.gpu.requestAdapter | source NAVIGATOR_GPU_ADAPTER
fetch | sink FETCH_RESOURCE FETCH_OPTIONS; sink FETCH_BODY@1.body; sink FETCH_HEADERS@1.headers; source FETCH_RESPONSE
WebSocket.prototype.constructor | sink WEBSOCKET_URL
WebSocket.prototype.send | sink WEBSOCKET_DATA
XMLHttpRequest.prototype.open | sink XML_HTTP_REQUEST_OPEN@1
XMLHttpRequest.prototype.setRequestHeader | sink XML_HTTP_REQUEST_SETHEADER XML_HTTP_REQUEST_SETHEADER
XMLHttpRequest.prototype.send | sink XML_HTTP_REQUEST_SEND; source XML_HTTP_RESPONSE
localStorage.setItem | sink WEB_LOCAL_STORAGE_SET_KEY WEB_LOCAL_STORAGE_SET_VALUE
localStorage.removeItem | sink WEB_LOCAL_STORAGE_REMOVE
sessionStorage.setItem | sink WEB_SESSION_STORAGE_SET_KEY WEB_SESSION_STORAGE_SET_VALUE
sessionStorage.removeItem | sink WEB_SESSION_STORAGE_REMOVE
{setTimeout,setInterval} | sink TIME_EVAL; call 0
URL.prototype.constructor | flow INITIAL
URLSearchParams.prototype.constructor | summary
URLSearchParams.prototype.append | flow MUTATE
URLSearchParams.prototype.toString | flow RETURN
"""
LANGUAGE = """
Array.prototype.{constructor,at,filter,map,push,reverse,unshift,sort,slice,splice} | summary
Array.{from,of} | summary
Array.prototype.concat | flow COPY
Array.prototype.fill | flow MUTATE
Array.prototype.{find,pop,reduce,shift} | flow ELEMENT
Array.prototype.forEach | call 0
Array.prototype.{toString,join} | flow RETURN
Date.prototype.{toLocaleString,toLocaleDateString,toLocaleTimeString,toISOString,toUTCString,toDateString,toTimeString} | flow RETURN
Function | sink NEW_FUNCTION
Function.prototype.constructor | sink NEW_FUNCTION
Function.prototype.{call,apply} | call 0
Function.prototype.bind | summary
JSON.{stringify,parse} | flow RETURN
Map.prototype.{constructor,set,get,clear} | summary
Object.assign | flow COPY
Object.{create,defineProperty,defineProperties,entries,values,keys,getPrototypeOf,setPrototypeOf} | summary
executor.resolve | summary
Promise.prototype.{then,constructor} | call 0
Promise.{resolve,all} | summary
Set.prototype.{constructor,add,clear,union} | summary
Set.prototype.forEach | call 0
String.fromCharCode | flow RETURN
String.prototype.concat | flow RETURN
String.prototype.{normalize,repeat,slice,substring,trim,trimEnd,trimStart} | summary
String.prototype.{replace,replaceAll} | flow MUTATE
String.prototype.split | flow ELEMENT
TextEncoder.prototype.encode | flow RETURN
Uint8Array.prototype.constructor | flow INITIAL
Uint8Array.prototype.{toBase64,toHex,setFromBase64,setFromHex} | flow RETURN
Uint8Array.{fromBase64,fromHex} | flow RETURN
"""
LIBRARIES = """
$sce.trustAs | sink ANGULAR_BYPASS_SECURITY@1
angular.bypassSecurity | sink ANGULAR_BYPASS_SECURITY
axios.get | sink AXIOS_URL; sink AXIOS_DATA@1.params; sink AXIOS_HEADERS@1.headers; source AXIOS_GET_RESPONSE
axios.post | sink AXIOS_URL AXIOS_DATA; sink AXIOS_HEADERS@2.headers; source AXIOS_POST_RESPONSE
axios.request | sink AXIOS_URL@0.url; sink AXIOS_DATA@0.data; sink AXIOS_HEADERS@0.headers; source AXIOS_REQUEST_RESPONSE
axios.fn | sink AXIOS_URL@0.url; sink AXIOS_DATA@0.data; sink AXIOS_HEADERS@0.headers; source AXIOS_RESPONSE
axios.create | summary
base64.{encode,decode} | flow RETURN
CryptoJS.MD5 | clean
CryptoJS.AES.{encrypt,decrypt} | flow RETURN
CryptoJS.enc.Hex.stringify | flow RETURN
JQuery.fn | summary
JQuery.fn.val | source JQUERY_ELEMENT_VAL; sink JQUERY_ELEMENT_VAL_SET
JQuery.fn.text | source JQUERY_ELEMENT_TEXT; sink JQUERY_ELEMENT_TEXT_SET
JQuery.fn.html | source JQUERY_ELEMENT_HTML; sink JQUERY_ELEMENT_HTML_SET
JQuery.fn.{on,one,bind,delegate} | event TARGET_CUSTOM_EVENT 0; event ELEMENT_VALUE 0; call 1
JQuery.ajax | sink JQUERY_SETTINGS_URL@0.url; sink JQUERY_SETTINGS_DATA@0.data; sink JQUERY_AJAX_URL JQUERY_AJAX_DATA; source JQUERY_AJAX_RESPONSE; call 1
JQuery.get | sink JQUERY_GET_URL JQUERY_GET_DATA
JQuery.post | sink JQUERY_POST_URL JQUERY_POST_DATA
JQuery.globalEval | sink JQUERY_GLOBAL_EVAL
lodash.{map,filter,clone,cloneDeep,assign,debounce,once} | summary
lodash.get | flow ELEMENT
lodash.set | flow MUTATE
React.createElement | sink REACT_DANGEROUS_HTML@1.dangerouslySetInnerHTML
ReactDOM.render | summary
Vue.{fn,createApp} | sink VUE_V_HTML@0.template
Vue.compile | sink VUE_COMPILE
"""
#: Values that are sources wherever they are read.
ATTRIBUTES = """
document.cookie DOCUMENT_COOKIE
document.URL DOCUMENT_URL
document.title DOCUMENT_TITLE
location.href DOCUMENT_URL
navigator.userAgent NAVIGATOR_USER_AGENT
navigator.platform NAVIGATOR_PLATFORM
navigator.language NAVIGATOR_LANGUAGE
navigator.plugins NAVIGATOR_PLUGINS
navigator.connection NAVIGATOR_CONNECTION
navigator.deviceMemory NAVIGATOR_DEVICE_MEMORY
navigator.hardwareConcurrency NAVIGATOR_HARDWARE_CONCURRENCY
navigator.maxTouchPoints NAVIGATOR_MAX_TOUCH_POINTS
screen.width SCREEN_INFO
screen.height SCREEN_INFO
"""
#: Names under which libraries are known in code.
ALIASES = """
$ JQuery
jQuery JQuery
_ lodash
window.postMessage postMessage
window.addEventListener addEventListener
"""
#: DOM events that carry what users enter; `message` carries what other pages send; all others are custom.
STANDARD_EVENTS = """
click dblclick mousedown mouseup mousemove mouseover mouseout mouseenter mouseleave contextmenu wheel keydown keyup keypress input change
submit reset focus blur focusin focusout select copy cut paste drag dragstart dragend dragenter dragleave dragover drop touchstart touchmove
touchend touchcancel pointerdown pointerup pointermove load unload beforeunload DOMContentLoaded resize scroll error hashchange popstate
""".split()

GROUPS = (("chrome", CHROME), ("message", MESSAGES), ("browser", BROWSER), ("js", LANGUAGE), ("library", LIBRARIES))
SCHEMA = "api string, family string, ord int, role string, arg int, property string, tag string"


def expand(name: str) -> list[str]:
    """The names that a name with braces stands for."""
    parts = re.split(r"\{([^}]*)\}", name)
    return ["".join(x) for x in itertools.product(*(p.split(",") if k % 2 else [p] for k, p in enumerate(parts)))]


def rows() -> list[tuple]:
    """Rows of SCHEMA, one for each thing that a function does. A name that is registered twice is an error."""
    out, seen = [], set()
    for family, lines in GROUPS:
        for line in lines.strip().split("\n"):
            names, _, effects = line.partition(" | ")
            for api in expand(names):
                if api in seen:
                    raise ValueError(f"{api} is registered twice")
                seen.add(api)
                ord_ = 0
                for effect in effects.split("; "):
                    role, *rest = effect.split()
                    if role == "sink":
                        made = []
                        for k, x in enumerate(rest):
                            tag, _, at = x.partition("@")
                            arg, _, prop = at.partition(".")
                            made.append((int(arg) if arg else k, prop or None, tag))
                    elif role in ("event", "reply"):
                        made = [(int(rest[1]), None, rest[0])]
                    elif role in ("call", "frame"):
                        made = [(int(rest[0]), None, None)]
                    else:
                        made = [(None, None, rest[0] if rest else None)]
                    for arg, prop, tag in made:
                        out.append((api, family, ord_, role, arg, prop, tag))
                        ord_ += 1
    return out


def catalog(spark: SparkSession) -> DataFrame:
    """The rows as a table; it has some hundreds of rows, so its broadcast is bounded."""
    return spark.createDataFrame(rows(), SCHEMA)


def attributes(spark: SparkSession) -> DataFrame:
    """api, tag of values that are sources wherever they are read."""
    return spark.createDataFrame([tuple(x.split()) for x in ATTRIBUTES.strip().split("\n")], "api string, tag string")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(x.split()) for x in ALIASES.strip().split("\n")], "alias string, base string")
