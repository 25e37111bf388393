"""More queries on the synthetic tables, with the same in DuckDB SQL: an operator of the library each, over whole tables.

Where SQL can't express an operator (parsing scripts), the query has none and the tests hold it against golden rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import api_catalog, library_rules
from ..functions import scalars as S
from ..functions import vocabulary as V
from ..operators import api, bridges, classify, filters, graph, program, report, rules, selectors, severity
from ..operators.privilege import gate, refined
from ..sources import packages, script_facts
from .demo import _FLOWS_SQL, _flows, _t, _values, query


def _pick(names: list[str], n):
    return F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))


def _sql_pick(names: list[str], n: str) -> str:
    return f"list_extract({names!r}, CAST(({n}) % {len(names)} + 1 AS INT))"


# --- scalars ---------------------------------------------------------------

_URLS = ["https://a.b/c", "HTTP://x", "data:text/plain,1", "lib/a.js", "/b.js", "blob:1", "chrome-extension://id/x.js", "ftp://y"]


@query(f"SELECT p_partkey, url, regexp_matches(url, '(?i)^(https?:|data:|blob:|chrome-extension:|moz-extension:)') AS outside FROM (SELECT p_partkey, {_sql_pick(_URLS, 'p_partkey')} AS url FROM part)")
def q_external_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select("p_partkey", _pick(_URLS, F.col("p_partkey")).alias("url"))
    return p.withColumn("outside", S.is_external_url(F.col("url")))


_PATTERNS = ["<all_urls>", "*://*/*", "https://*.a.com/*", "https://a.com/*", "https://a.com/x/*", "http://localhost:8080/*", "file:///*", "", "nonsense", "http://127.0.0.1/*"]
_PATTERN_SQL = rf"""pats AS (SELECT p_partkey, p_size, {_sql_pick(_PATTERNS, 'p_partkey')} AS p FROM part),
parsed AS (SELECT *, regexp_extract(p, '^([^:]+)://([^/]*)(/.*)?$', 1) AS scheme, regexp_extract(p, '^([^:]+)://([^/]*)(/.*)?$', 2) AS host, coalesce(nullif(regexp_extract(p, '^([^:]+)://([^/]*)(/.*)?$', 3), ''), '/') AS path, regexp_full_match(p, '([^:]+)://([^/]*)(/.*)?') AS fits FROM pats),
ranked AS (SELECT *, (p = '' OR scheme = 'file' OR (fits AND regexp_replace(host, ':[0-9*]+$', '') IN ('localhost', '127.0.0.1', '0.0.0.0', '[::1]'))) AS skip,
CASE WHEN p = '<all_urls>' THEN 4 WHEN NOT fits THEN 1 WHEN host = '*' THEN 4 WHEN starts_with(host, '*.') THEN 3 WHEN path IN ('/*', '/', '*') THEN 2 ELSE 1 END AS rank FROM parsed)"""


def _patterns(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", "p_size", _pick(_PATTERNS, F.col("p_partkey")).alias("p"))


@query(f"WITH {_PATTERN_SQL} SELECT p_partkey, p, skip FROM ranked")
def q_ignored_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patterns(spark, sf_dir).select("p_partkey", "p", S.is_ignored_pattern(F.col("p")).alias("skip"))


@query(f"WITH {_PATTERN_SQL} SELECT p_partkey, CASE WHEN fits THEN scheme END AS scheme, CASE WHEN fits THEN host END AS host, CASE WHEN fits THEN path END AS path FROM ranked")
def q_pattern_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    return _patterns(spark, sf_dir).select("p_partkey", S.pattern_scheme(p).alias("scheme"), S.pattern_host(p).alias("host"), S.pattern_path(p).alias("path"))


@query(f"WITH {_PATTERN_SQL} SELECT p_size, bool_and(skip OR (p <> '<all_urls>' AND fits AND host <> '*')) AS restricted FROM ranked GROUP BY p_size")
def q_host_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _patterns(spark, sf_dir).groupBy("p_size").agg(F.collect_set("p").alias("ps"))
    return by.select("p_size", filters.host_restricted(F.col("ps")).alias("restricted"))


@query(f"WITH {_PATTERN_SQL} SELECT p_size, coalesce(max(rank) FILTER (NOT skip), 0) AS rank FROM ranked GROUP BY p_size")
def q_matches_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _patterns(spark, sf_dir).groupBy("p_size").agg(F.collect_set("p").alias("ps"))
    return by.select("p_size", severity.matches_rank(F.col("ps")).alias("rank"))


_IDS = ["abcdefghijklmnopabcdefghijklmnop", "abcdefghijklmnopabcdefghijklmnoq", "", "self", "short"]


@query(f"""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'UNKNOWN_EXTENSION_ID' WHEN id = '' OR id = 'self' THEN NULL WHEN regexp_full_match(id, '[a-p]{{32}}') THEN id ELSE 'INVALID' END AS said,
regexp_full_match(id, '[a-p]{{32}}') AS fits FROM (SELECT *, {_sql_pick(_IDS, 'p_partkey')} AS id FROM part)""")
def q_extension_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").withColumn("id", _pick(_IDS, F.col("p_partkey")))
    return p.select("p_partkey", S.extension_id_check(F.col("p_size") % 3 != 0, F.col("id"), F.lit("self")).alias("said"), S.is_package_id(F.col("id")).alias("fits"))


@query("SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END, ''), nullif(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END, '')) AS found FROM orders")
def q_first_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderstatus"))
    b = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", S.first_literal(a, b).alias("found"))


_VERSIONS = ["1", "1.2", "1.2.3.4", "1.2.3.4.5", "1.", "a.1", "", "10.20.x"]


@query(rf"SELECT p_partkey, regexp_full_match({_sql_pick(_VERSIONS, 'p_partkey')}, '\d+(\.\d+)*') AS ok FROM part")
def q_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", S.is_version(_pick(_VERSIONS, F.col("p_partkey"))).alias("ok"))


_GECKO = ["{01234567-89ab-cdef-0123-456789ABCDEF}", "me@site.org", "@x", "{0123}", "plain", "a b@c"]


@query(rf"SELECT p_partkey, regexp_full_match(g, '\{{[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}\}}') OR regexp_full_match(g, '[A-Za-z0-9._-]*@[A-Za-z0-9._-]+') AS ok FROM (SELECT p_partkey, {_sql_pick(_GECKO, 'p_partkey')} AS g FROM part)")
def q_gecko_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", S.is_gecko_id(_pick(_GECKO, F.col("p_partkey"))).alias("ok"))


@query("SELECT p_partkey, translate(substr(sha256(p_name || CAST(p_partkey AS VARCHAR)), 1, 32), '0123456789abcdef', 'abcdefghijklmnop') AS id FROM part")
def q_package_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("p_name", F.col("p_partkey").cast("string")).cast("binary")
    return _t(spark, sf_dir, "part").select("p_partkey", S.package_id(key).alias("id"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN '[unknown_loc]' ELSE 'L' || l_linenumber || ':C' || l_partkey || ' -> L' || l_linenumber || ':C' || l_suppkey END AS loc FROM lineitem")
def q_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("l_linenumber") != 1, F.col("l_linenumber").cast("string"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.location(line, F.col("l_partkey").cast("string"), line, F.col("l_suppkey").cast("string")).alias("loc"))


@query("SELECT c_custkey, CASE WHEN length(c_mktsegment) < 10 THEN rpad(c_mktsegment, 10, ' ') ELSE c_mktsegment END AS padded, printf('%.1f%%', c_nationkey / 24.0 * 100) AS share FROM customer")
def q_pad_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", S.pad_right(F.col("c_mktsegment"), 10).alias("padded"), S.percent(F.col("c_nationkey") / 24.0).alias("share"))


_PATHS = ["./a/b.js", "/x\\y.ts", "src\\lib.min.js", "plain", ".//z.js", "a.js/b"]


@query(rf"SELECT p_partkey, regexp_replace(p, '\.(js|ts)$', '') AS key, regexp_replace(replace(p, chr(92), '/'), '^(\./|/)+', '') AS path FROM (SELECT p_partkey, {_sql_pick(_PATHS, 'p_partkey').replace(chr(92) * 2, chr(92))} AS p FROM part)")
def q_script_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pick(_PATHS, F.col("p_partkey"))
    return _t(spark, sf_dir, "part").select("p_partkey", S.script_key(p).alias("key"), S.normal_path(p).alias("path"))


@query(r"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split_regex(trim(n), '\s+'), lambda x: x <> ''), lambda x: lower(split_part(x, '.', 1))))), ' ') AS names FROM (SELECT p_partkey, ' ' || p_name || '.ns ' || upper(p_type) || '  ' || p_name AS n FROM part)")
def q_event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.concat(F.lit(" "), F.col("p_name"), F.lit(".ns "), F.upper("p_type"), F.lit("  "), F.col("p_name"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(S.event_names(n)), " ").alias("names"))


@query("SELECT doc_id, CASE WHEN n_chars * 64 < 131072 THEN 120 WHEN n_chars * 64 < 1048576 THEN 300 ELSE 600 END AS seconds FROM documents")
def q_file_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", S.file_timeout(F.col("n_chars") * 64).alias("seconds"))


@query("SELECT user_id, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS micros FROM events GROUP BY user_id")
def q_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return by.select("user_id", F.round(S.seconds_between(F.col("a"), F.col("b")) * 1e6).cast("long").alias("micros"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS found, 'https://h/p?id=' || CAST(event_id AS VARCHAR) || '&t=' || event_type AS url, '{\"k\":' || CAST(event_id AS VARCHAR) || '}' AS changed FROM events")
def q_json_and_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    return e.select("event_id", S.value_at(F.col("props"), "k").alias("found"), S.url_with_query("https://h/p", id=n, t=F.col("event_type")).alias("url"), S.with_value_at(F.col("props"), "k", n).alias("changed"))


_COMPARED = [("===", "string", "1", "string", "1.0"), ("===", "number", "1", "string", "1"), ("==", "number", "1", "string", "1"), ("<", "string", "10", "string", "9"), ("<", "number", "10", "number", "9"), ("==", "null", "null", "undefined", "undefined"), ("===", "null", "null", "undefined", "undefined"), (">=", "boolean", "true", "number", "1"), ("!=", "string", "a", "string", "b"), ("<", "string", "x", "number", "1"), ("in", "string", "a", "string", "a"), ("!==", "number", "1.0", "number", "1")]
#: Golden values of the comparisons above.
_COMPARED_TRUE = [False, False, True, True, False, True, False, True, True, False, None, False]


@query(f"SELECT p_partkey, list_extract([{', '.join('NULL' if x is None else str(x) for x in _COMPARED_TRUE)}], CAST(p_partkey % {len(_COMPARED)} + 1 AS INT)) AS truth FROM part")
def q_branch_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [_pick([x[k] for x in _COMPARED], F.col("p_partkey")) for k in range(5)]
    return _t(spark, sf_dir, "part").select("p_partkey", program.compare(*c).alias("truth"))


@query("""SELECT p_partkey, CASE WHEN a IS NULL THEN 'UNKNOWN' WHEN a THEN 'TRUE' ELSE 'FALSE' END AS label, a AND b AS both_, a OR b AS any_, NOT a AS none_
FROM (SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN p_size % 3 = 1 END AS a, CASE WHEN p_partkey % 3 < 2 THEN p_partkey % 3 = 1 END AS b FROM part)""")
def q_truth_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = lambda c: F.when(F.col(c) % 3 < 2, F.col(c) % 3 == 1)
    a, b = three("p_size"), three("p_partkey")
    return _t(spark, sf_dir, "part").select("p_partkey", S.truth_label(a).alias("label"), S.truth_and(a, b).alias("both_"), S.truth_or(a, b).alias("any_"), S.truth_not(a).alias("none_"))


# --- classification --------------------------------------------------------

_KINDS = ["content_script", "background", "service_worker", "offscreen", "devtools", "devtools_panel", "popup", "options"]


@query(f"""SELECT p_partkey, CASE WHEN k = 'content_script' THEN 'CS' WHEN k IN ('background', 'service_worker') THEN 'BG' WHEN k = 'offscreen' THEN 'OF' WHEN k IN ('devtools', 'devtools_panel') THEN 'DT' ELSE 'EX' END AS family,
CASE WHEN k = 'content_script' THEN 'content_script' ELSE 'extension' END AS context FROM (SELECT p_partkey, {_sql_pick(_KINDS, 'p_partkey')} AS k FROM part)""")
def q_frame_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _pick(_KINDS, F.col("p_partkey"))
    return _t(spark, sf_dir, "part").select("p_partkey", classify.frame_family(k).alias("family"), classify.permissions_context(k).alias("context"))


_FILES = ["lib/jquery-3.6.0.min.js", "vendor/underscore.js", "axios.js", "src/chart-utils.js", "chart.min.js", "d3.v5.js", "react-dom.production.min.js", "vue@3.2.0.global.js", "zone.js", "app.js", "core-js/shim.js", "moment.js"]


@query(f"""SELECT p_partkey, name, coalesce(name <> 'Lodash' AND name <> 'Axios', NULL) AS ignore FROM (SELECT p_partkey, {_sql_pick(['jQuery', 'Lodash', 'Axios', '', 'ChartJS', 'D3', 'React', 'Vue', 'Angular', '', 'CoreJS', 'Moment'], 'p_partkey')} AS n, nullif(n, '') AS name FROM part)""")
def q_library_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _t(spark, sf_dir, "part").select("p_partkey", _pick(_FILES, F.col("p_partkey")).alias("path"))
    return classify.library_by_name(f, F.col("path"), library_rules.name_table(spark), ["p_partkey"]).withColumnRenamed("library", "name")


_MARKS = ["/*! jQuery v3.6.0 | (c) */", "var a = jQuery.fn;", "e.__vue__=1", "x._reactRootContainer", "platformBrowserDynamic()", "ng.probe (y)"]


_MARK_SQL = " ".join(f"WHEN regexp_matches(head, '(?i){pattern}') THEN '{name}'" for name, pattern in library_rules.CONTENT_MARKS)


@query(f"SELECT doc_id, CASE {_MARK_SQL} END AS library FROM (SELECT doc_id, substr({_sql_pick(_MARKS, 'doc_id')} || coalesce(text, ''), 1, 65536) AS head FROM documents)")
def q_library_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(_pick(_MARKS, F.col("doc_id")), F.coalesce("text", F.lit(""))).alias("code"))
    return classify.first_signature(d, F.col("code"), library_rules.content_table(spark), ["doc_id"])


_CALLEES = ["fetch", "axios.get", "axios.get.x", "chrome.runtime", "chrome.runtime.sendMessage", "WebSocket", "Function", "eval", "navigator.sendBeacon", "foo"]
_RULES_SQL = _values([tuple(x.split()) for x in library_rules.SINK_CALLS])


@query(f"""WITH n AS (SELECT p_partkey AS node, {_sql_pick(['CallExpression', 'NewExpression', 'Identifier'], 'p_size')} AS type, {_sql_pick(_CALLEES, 'p_partkey')} AS called FROM part),
r AS (SELECT type, callee, split_part(callee, '.', 1) || CASE WHEN contains(callee, '.') THEN '.' || split_part(callee, '.', 2) ELSE '' END AS called FROM (VALUES {_RULES_SQL}) AS t(type, callee))
SELECT node, callee, callee AS sink_type FROM n JOIN r USING (type, called) WHERE type <> 'Identifier'""")
def q_sink_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), _pick(["CallExpression", "NewExpression", "Identifier"], F.col("p_size")).alias("type"), _pick(_CALLEES, F.col("p_partkey")).alias("callee"))
    return program.sink_sites(n, library_rules.sink_table(spark))


_FAMILIES = [["EX"], ["CS"], ["BG"], ["CS", "EX"]]


@query(f"""WITH {_FLOWS_SQL}, f AS (SELECT event_id, source_type, sink_type, CAST(user_id % 4 AS INT) AS k, CAST(event_id % 4 AS INT) AS j FROM flows),
g AS (SELECT *, k IN (1, 3) AS s_cs, k IN (0, 3) AS s_ex, k = 2 AS s_bg, j IN (1, 3) AS t_cs FROM f)
SELECT event_id FROM g WHERE NOT ((source_type IN {tuple(V.DOCUMENT_SOURCES)} AND s_ex AND NOT s_cs) OR (source_type IN {tuple(V.WEB_EVENT_SOURCES)} AND s_bg AND NOT s_cs)
OR (source_type IN {tuple(V.WEB_EVENT_SOURCES)} AND s_cs AND t_cs AND sink_type IN {tuple(V.WEB_STORAGE_SINKS)}))""")
def q_feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    fam = lambda n: F.element_at(F.array(*(F.array(*map(F.lit, f)) for f in _FAMILIES)), (n % 4 + 1).cast("int"))
    f = _flows(spark, sf_dir).withColumns({"source_families": fam(F.col("user_id")), "sink_families": fam(F.col("event_id"))})
    return filters.feasible(f).select("event_id")


# --- severity, privilege, rules --------------------------------------------


@query("SELECT p_size, CASE WHEN p_size % 5 = 0 THEN 4 WHEN bool_or(p_brand = 'Brand#2') THEN 4 WHEN count(*) FILTER (p_brand <> 'Brand#3') > 0 THEN 1 ELSE 0 END AS rank FROM part GROUP BY p_size")
def q_ids_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_brand") == "Brand#2", "*").when(F.col("p_brand") != "Brand#3", F.col("p_brand"))
    by = _t(spark, sf_dir, "part").groupBy("p_size").agg(F.collect_set(name).alias("ids"))
    return by.select("p_size", severity.ids_rank(F.when(F.col("p_size") % 5 != 0, F.col("ids"))).alias("rank"))


@query(f"""WITH {_FLOWS_SQL}, {_PATTERN_SQL}, f AS (SELECT event_id, source_type, sink_type, ['CS', 'BG', 'EX', 'DT'][CAST(user_id % 4 + 1 AS INT)] AS fam, CASE WHEN skip THEN 0 ELSE rank END AS r FROM flows JOIN ranked ON p_partkey = event_id % 10),
s AS (SELECT *, source_type IN {tuple(severity.EXTERNAL_SOURCES)} OR sink_type IN {tuple(severity.EXTERNAL_SINKS)} AS external, fam = 'CS' AND source_type IN {tuple(severity.CONTENT_SOURCES)} AS content FROM f)
SELECT event_id, CASE WHEN external THEN 'EXTERNALLY_CONNECTABLE_IDS' WHEN content THEN 'CONTENT_SCRIPT_MATCHES' WHEN fam IN ('EX', 'DT') AND source_type IN {tuple(V.DOCUMENT_SOURCES)} THEN 'EXTENSION_UI' ELSE 'UNKNOWN' END AS kind,
CASE WHEN external THEN 'CRITICAL' WHEN content THEN CASE WHEN r >= 4 THEN 'CRITICAL' WHEN r = 3 THEN 'HIGH' WHEN r = 2 THEN 'MEDIUM' ELSE 'LOW' END WHEN fam IN ('EX', 'DT') AND source_type IN {tuple(V.DOCUMENT_SOURCES)} THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM s""")
def q_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    f = _flows(spark, sf_dir).withColumns({"family": _pick(["CS", "BG", "EX", "DT"], F.col("user_id")), "matches": F.array(_pick(_PATTERNS, F.col("event_id") % 10))})
    c = severity.constraint(F.col("source_type"), F.col("sink_type"), F.col("family"), F.col("matches"), F.array().cast("array<string>"), none)
    return f.select("event_id", c["kind"].alias("kind"), c["severity"].alias("severity"))


@query(f"""WITH {_FLOWS_SQL} SELECT event_id, sink_type IN {tuple(V.DOM_SINKS)} AND sink_type NOT IN ('JQUERY_ELEMENT_VAL_SET', 'JQUERY_ELEMENT_TEXT_SET') AND user_id % 2 = 0 AND event_id % 3 = 0 AS hidden FROM flows""")
def q_self_localised(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flows(spark, sf_dir)
    family = F.when(F.col("user_id") % 2 == 0, "EX").otherwise("CS")
    f = f.withColumns({"package": F.lit("p"), "source_family": family, "sink_family": family, "storage_area": F.lit(None).cast("string"), "storage_key": F.lit(None).cast("string"), "sink_code": F.when(F.col("event_id") % 3 == 0, "e.innerHTML = '__MSG_title__'").otherwise("e.innerHTML = x")})
    return gate(f).select("event_id", F.coalesce(F.col("reason") == "extension i18n self-localization", F.lit(False)).alias("hidden"))


def _own_rules() -> list[dict]:
    return [rules.default_rules(), {"version": 1, "rules": [{"id": "own", "flowType": "OWN", "match": {"sourceType": "FETCH_*"}}], "suppress": []}]


@query("SELECT p_size AS layer, CASE WHEN p_brand = 'Brand#3' THEN 'suppress' ELSE 'rules' END AS kind, CAST(count(*) AS INT) AS n FROM part GROUP BY ALL")
def q_rule_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by set and kind (R6, R9): a part is a rule, its size the set that it comes from."""
    r = _t(spark, sf_dir, "part").select(F.col("p_size").alias("layer"), (F.col("p_brand") == "Brand#3").alias("suppress"))
    return rules.rule_counts(r, ["layer"])


@query(f"""WITH {_FLOWS_SQL} SELECT DISTINCT source_type, sink_type, 'OWN' AS flow_type FROM classified WHERE source_type LIKE 'FETCH\\_%' ESCAPE '\\'""")
def q_flow_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = classify.classify(_flows(spark, sf_dir).select("source_type", "sink_type").distinct())
    return rules.match_pairs(pairs, rules.rules_frame(spark, _own_rules()[1:])).select("source_type", "sink_type", "flow_type").distinct()


_SETS = ['{"version": 2, "rules": []}', '{"version": 1}', '{"version": 1, "rules": [{"id": "x", "flowType": "F", "match": {}}]}', '{"version": 1, "rules": [{"flowType": "F", "match": {"sinkType": "A"}}]}', '{"version": 1, "rules": [], "suppress": [{"id": "s"}]}', '{"version": 1, "rules": [{"id": "x", "flowType": "F", "match": {"sinkType": "A"}}]}', "[]", "no"]
_FAULTS = ["version must be 1", "rules must be a list", "rules[0] has no matcher", "rules[0] has no id", "suppress[0] has neither a matcher nor a flowType", "", "not a rule set", "not JSON"]


@query(f"SELECT * FROM (SELECT p_partkey, {_sql_pick(_FAULTS, 'p_partkey + p_size')} AS violation FROM part) WHERE violation <> ''")
def q_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule sets as rows of JSON, one for each part (R7)."""
    sets = _t(spark, sf_dir, "part").select("p_partkey", _pick(_SETS, F.col("p_partkey") + F.col("p_size")).alias("text"))
    return rules.invalid(sets, "p_partkey", "text")


# --- facts of programs -----------------------------------------------------


@query("""SELECT l_orderkey AS get_id, l_linenumber, key, shape = 'none' AS all_keys FROM (SELECT l_orderkey, l_linenumber, shape, unnest(CASE WHEN shape = 'literal' THEN [l_returnflag] WHEN shape IN ('union', 'array') THEN [l_returnflag, l_linestatus] WHEN shape = 'object' THEN ['d'] ELSE [NULL] END) AS key
FROM (SELECT *, ['literal', 'union', 'array', 'object', 'none', 'unknown'][CAST(l_linenumber % 6 + 1 AS INT)] AS shape FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2)))""")
def q_key_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("r"), F.min("l_linestatus").alias("s"))
    args = rows.select(F.struct("l_orderkey", "l_linenumber").alias("get_id"), _pick(["literal", "union", "array", "object", "none", "unknown"], F.col("l_linenumber")).alias("shape"), F.col("r").alias("literal"), F.array("r", "s").alias("options"), F.array(F.lit("d")).alias("defaults"))
    return program.key_shapes(args).select("get_id.l_orderkey", "get_id.l_linenumber", "key", "all_keys").withColumnRenamed("l_orderkey", "get_id")


@query("""SELECT o_orderkey AS script, 'x' AS "local", CAST(NULL AS VARCHAR) AS property, c_custkey AS def FROM orders JOIN customer ON o_custkey = c_custkey AND (o_orderkey % 3 + 1)::INT::VARCHAR = (c_custkey % 3 + 1)::INT::VARCHAR WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 'x', (c_custkey % 3 + 1)::INT::VARCHAR, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 = 0""")
def q_import_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda c: (F.col(c) % 3 + 1).cast("int").cast("string")
    imports = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("script"), F.lit("x").alias("local"), F.col("o_custkey").alias("module"), F.when(F.col("o_orderkey") % 5 == 0, "*").otherwise(word("o_orderkey")).alias("name"))
    exports = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("module"), word("c_custkey").alias("name"), F.col("c_custkey").alias("def"))
    return program.import_bindings(imports, exports)


@query("""WITH RECURSIVE t(module, def) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey > 0 UNION ALL SELECT t.module * 2 + k, def FROM t, (VALUES (0), (1)) AS c(k) WHERE t.module * 2 + k IN (SELECT p_partkey FROM part))
SELECT module, 'n' || def AS name, def FROM t""")
def q_export_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each module passes on all of the module of half its number."""
    p = _t(spark, sf_dir, "part").filter("p_partkey > 0")
    own = p.select(F.col("p_partkey").alias("module"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("def"))
    again = p.filter("p_partkey > 1").select(F.col("p_partkey").alias("module"), F.lit("*").alias("name"), F.expr("p_partkey div 2").alias("from_module"), F.lit("*").alias("from_name"))
    return program.export_bindings(own, again)


@query("SELECT DISTINCT o_custkey AS script, o_orderkey % 3000 AS target, c_custkey IS NOT NULL AS found FROM orders LEFT JOIN customer ON o_orderkey % 3000 = c_custkey")
def q_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("script"), (F.col("o_orderkey") % 3000).alias("target"))
    return program.dependencies(imports, _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("script"))).select("script", "target", "found")


@query("""WITH RECURSIVE up(c, anc, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey > 0 UNION ALL SELECT c, anc // 2, depth + 1 FROM up WHERE anc // 2 > 0)
SELECT c AS "class", p_type AS name, p_size % 2 = 0 AS is_static, arg_min(p_partkey, depth) AS def FROM up JOIN part ON anc = p_partkey GROUP BY 1, 2, 3""")
def q_inherited_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").filter("p_partkey > 0")
    classes = p.select(F.col("p_partkey").alias("class"), F.expr("nullif(p_partkey div 2, 0)").alias("parent"))
    return program.superclass_members(classes, p.select(F.col("p_partkey").alias("class"), F.col("p_type").alias("name"), (F.col("p_size") % 2 == 0).alias("is_static"), F.col("p_partkey").alias("def")))


@query("""WITH RECURSIVE t(script, frame) AS (SELECT p_partkey, p_brand FROM part WHERE p_size = 1 AND p_partkey > 0 UNION SELECT script // 2, frame FROM t WHERE script // 2 > 0) SELECT DISTINCT script, frame FROM t""")
def q_inherited_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").filter("p_partkey > 0")
    refs = p.select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst")).filter("dst > 0")
    return program.inherited_frames(p.filter("p_size = 1").select(F.col("p_partkey").alias("script"), F.col("p_brand").alias("frame")), refs)


@query("SELECT c_custkey AS scope FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def q_never_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are scopes; those with an urgent order were analysed."""
    reached = _t(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("scope"))
    return program.never_reached(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scope")), reached)


_READS = "reads AS (SELECT o_orderkey AS read, o_custkey AS object, ['A', 'N', 'R'][CAST(o_orderkey % 3 + 1 AS INT)] AS name, o_orderkey % 7 <> 0 AS known FROM orders), props AS (SELECT DISTINCT l_suppkey AS object, l_returnflag AS name, l_suppkey * 10 + ascii(l_returnflag) AS def FROM lineitem)"


def _reads(spark, sf_dir):
    reads = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read"), F.col("o_custkey").alias("object"), _pick(["A", "N", "R"], F.col("o_orderkey")).alias("name"), (F.col("o_orderkey") % 7 != 0).alias("known"))
    props = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("object"), F.col("l_returnflag").alias("name"), (F.col("l_suppkey") * 10 + F.ascii("l_returnflag")).alias("def")).distinct()
    return reads, props


@query(f"WITH {_READS} SELECT read, def, NOT known AS opaque FROM reads r JOIN props p ON r.object = p.object AND (NOT known OR r.name = p.name)")
def q_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, props = _reads(spark, sf_dir)
    return program.members(reads.withColumn("names", F.array("name")).drop("name"), props)


@query(f"WITH {_READS} SELECT object AS src, read AS dst, 'ELEMENT' AS kind FROM reads r WHERE NOT EXISTS (SELECT 1 FROM props p WHERE p.object = r.object AND p.name = r.name)")
def q_container_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, props = _reads(spark, sf_dir)
    return program.container_edges(reads, props)


@query(f"""WITH {_READS}, sinks AS (SELECT c_custkey AS sink, c_custkey AS def FROM customer), tainted AS (SELECT 't' AS taint, c_custkey AS def FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'u', def FROM props),
direct AS (SELECT sink, taint, CAST(NULL AS VARCHAR) AS name FROM sinks JOIN tainted USING (def))
SELECT * FROM direct UNION ALL SELECT s.sink, t.taint, p.name FROM sinks s JOIN props p ON s.def = p.object JOIN tainted t ON t.def = p.def WHERE s.sink NOT IN (SELECT sink FROM direct)""")
def q_structured_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, props = _reads(spark, sf_dir)
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sink"), F.col("c_custkey").alias("def"))
    tainted = c.filter("sink % 4 = 0").select(F.lit("t").alias("taint"), "def").unionByName(props.select(F.lit("u").alias("taint"), "def"))
    return program.structured_hits(c, tainted, props)


@query("""WITH up AS (SELECT n_nationkey AS scope, n_nationkey AS anc, 0 AS depth FROM nation UNION ALL SELECT n_nationkey, 100 + n_regionkey, 1 FROM nation UNION ALL SELECT n_nationkey, 999, 2 FROM nation),
defs AS (SELECT c_nationkey AS scope, c_mktsegment AS name, min(c_custkey) AS def FROM customer WHERE c_custkey % 10 = 0 GROUP BY 1, 2 UNION ALL SELECT 100 + r_regionkey, 'MACHINERY', -r_regionkey - 1 FROM region UNION ALL SELECT 999, 'BUILDING', -99)
SELECT c_custkey AS use, c_nationkey AS scope, c_mktsegment AS name, arg_min(def, depth) AS def FROM customer LEFT JOIN (SELECT up.scope AS s, name AS n, depth, def FROM up JOIN defs ON anc = defs.scope) ON s = c_nationkey AND n = c_mktsegment GROUP BY ALL""")
def q_scope_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c, r = (_t(spark, sf_dir, x) for x in ("nation", "customer", "region"))
    up = n.select(F.col("n_nationkey").alias("scope"), F.col("n_nationkey").alias("ancestor"), F.lit(0).alias("depth"))
    up = up.unionByName(n.select(F.col("n_nationkey").alias("scope"), (F.col("n_regionkey") + 100).alias("ancestor"), F.lit(1).alias("depth"))).unionByName(n.select(F.col("n_nationkey").alias("scope"), F.lit(999).alias("ancestor"), F.lit(2).alias("depth")))
    defs = c.filter("c_custkey % 10 = 0").groupBy(F.col("c_nationkey").alias("scope"), F.col("c_mktsegment").alias("name")).agg(F.min("c_custkey").alias("def"))
    defs = defs.unionByName(r.select((F.col("r_regionkey") + 100).alias("scope"), F.lit("MACHINERY").alias("name"), (-F.col("r_regionkey") - 1).cast("long").alias("def"))).unionByName(spark.createDataFrame([(999, "BUILDING", -99)], "scope int, name string, def long"))
    uses = c.select(F.col("c_custkey").alias("use"), F.col("c_nationkey").alias("scope"), F.col("c_mktsegment").alias("name"))
    return program.scope_lookup(uses, up, defs).select("use", "scope", "name", "def")


@query("""WITH e AS (SELECT p_partkey AS src, p_partkey + k AS dst, CASE k WHEN 1 THEN 'TRUE' ELSE 'FALSE' END AS kind FROM part, (VALUES (1), (2)) AS t(k))
SELECT src, dst, kind FROM e JOIN part ON src = p_partkey WHERE NOT (p_size % 3 = 0 AND p_size % 2 = 0 AND kind = 'FALSE') AND NOT (p_size % 3 = 1 AND kind = 'TRUE')""")
def q_live_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards: sizes of 0 modulo 3 are true (loops where odd), of 1 false, others unknown."""
    p = _t(spark, sf_dir, "part")
    e = p.select(F.col("p_partkey").alias("src"), F.explode(F.array(F.struct((F.col("p_partkey") + 1).alias("dst"), F.lit("TRUE").alias("kind")), F.struct((F.col("p_partkey") + 2).alias("dst"), F.lit("FALSE").alias("kind")))).alias("e")).select("src", "e.*")
    guards = p.select(F.col("p_partkey").alias("src"), F.when(F.col("p_size") % 3 < 2, F.col("p_size") % 3 == 0).alias("truth"), (F.col("p_size") % 2 == 1).alias("is_loop"))
    return program.live_edges(e, guards).select("src", "dst", "kind")


@query("""WITH c AS (SELECT l_orderkey AS src, l_linenumber AS dst, bool_and(coalesce(l_quantity < 10, false)) AS never, bool_or(l_quantity > 45) AS sure FROM lineitem GROUP BY 1, 2), o AS (SELECT src, bool_or(sure) AS sure FROM c GROUP BY 1)
SELECT src, dst, 'CASE' AS kind FROM c WHERE NOT never UNION ALL SELECT o_orderkey, 0, 'DEFAULT' FROM orders LEFT JOIN o ON src = o_orderkey WHERE NOT coalesce(sure, false)""")
def q_live_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("dst"), F.when(F.col("l_quantity") > 45, True).when(F.col("l_quantity") < 10, False).alias("truth"))
    e = cases.select("src", "dst", F.lit("CASE").alias("kind")).distinct().unionByName(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lit(0).alias("dst"), F.lit("DEFAULT").alias("kind")))
    return program.live_cases(e, cases)


# --- graphs with cycles, joins and depth -----------------------------------

# Parts in rings of 20, the k-th place of a ring being the key modulo 20.
_RING = """edges AS (SELECT p_partkey AS src, p_partkey // 20 * 20 + (p_partkey + 1) % 20 AS dst FROM part UNION SELECT p_partkey, p_partkey // 20 * 20 + (p_partkey * 7) % 20 FROM part WHERE p_size % 6 = 0)"""


def _ring(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), "p_size", F.expr("p_partkey div 20 * 20").alias("base"))
    return p.select("src", (F.col("base") + (F.col("src") + 1) % 20).alias("dst")).union(p.filter("p_size % 6 = 0").select("src", F.col("base") + (F.col("src") * 7) % 20)).distinct()


@query(f"""WITH RECURSIVE {_RING}, t(root, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION SELECT root, dst, depth + 1 FROM t JOIN edges ON node = src WHERE depth < 20) SELECT root, node, min(depth) AS depth FROM t GROUP BY root, node""")
def q_closure_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of 20 nodes with chords, from every node: cycles, joins and paths of many steps (longer ones are in the tests)."""
    return graph.closure(_ring(spark, sf_dir), _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("root")))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey + 1 AS dst, CASE WHEN p_size % 2 = 0 THEN 'ASSIGN' ELSE 'RETURN' END AS kind FROM part WHERE (p_partkey + 1) // 20 = p_partkey // 20),
t(taint, def, depth, kind) AS (SELECT p_partkey // 20, min(p_partkey), 0, CAST(NULL AS VARCHAR) FROM part GROUP BY 1 UNION ALL SELECT taint, dst, depth + 1, e.kind FROM t JOIN e ON def = src) SELECT * FROM t""")
def q_taint_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of 20 parts with edges of two kinds, from each one's first: the kind by which a value was reached first (T5)."""
    p = _t(spark, sf_dir, "part")
    e = p.filter("(p_partkey + 1) div 20 = p_partkey div 20").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"), F.when(F.col("p_size") % 2 == 0, "ASSIGN").otherwise("RETURN").alias("kind"))
    return graph.propagate(p.groupBy(F.expr("p_partkey div 20").alias("taint")).agg(F.min("p_partkey").alias("def")), e)


@query("""SELECT p_partkey AS node, CASE WHEN p_partkey % 60 >= 30 THEN 0 WHEN p_partkey % 60 BETWEEN 20 AND 29 THEN NULL ELSE CAST(p_partkey % 60 AS INT) END AS level FROM part""")
def q_topo_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of 60 parts: a chain of 19 steps, a cycle of ten nodes that hangs on it, and free nodes."""
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 60).alias("k"))
    e = p.filter("k between 1 and 29").select("node", (F.col("node") - 1).alias("dep")).unionByName(p.filter("k = 20").select("node", (F.col("node") + 9).alias("dep")))
    return graph.topo_levels(e, p.select("node"))


# --- messages and the catalog ----------------------------------------------

_CATALOG_SQL = _values(api_catalog.rows())
_APIS = sorted({r[0] for r in api_catalog.rows()})
_CALLS_SQL = f"calls AS (SELECT 'p' AS package, 's' AS script, event_id AS call, user_id AS def, list_extract(a, CAST(event_id % {len(_APIS)} + 1 AS INT)) AS api FROM events, (SELECT {_APIS!r} AS a)), catalog AS (SELECT * FROM (VALUES {_CATALOG_SQL}) AS t(api, family, ord, role, arg, property, tag)), done AS (SELECT * FROM calls JOIN catalog USING (api))"


def _calls(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(F.lit("p").alias("package"), F.lit("s").alias("script"), F.col("event_id").alias("call"), F.col("user_id").alias("callee"), _pick(_APIS, F.col("event_id")).alias("api"))


def _args(spark, sf_dir):
    """Each call has two arguments: a literal, and an object."""
    e = _t(spark, sf_dir, "events").select(F.lit("p").alias("package"), F.lit("s").alias("script"), F.col("event_id").alias("call"))
    none = F.lit(None).cast("long").alias("function")
    a = e.select("*", (F.col("call") * 10).alias("def"), F.lit(0).cast("long").alias("ord"), none, F.lit("Literal").alias("type"), F.lit("FULL").alias("hint"), F.lit("input").alias("literal"))
    return a.unionByName(e.select("*", (F.col("call") * 10 + 1).alias("def"), F.lit(1).cast("long").alias("ord"), none, F.lit("ObjectExpression").alias("type"), F.lit("no_string").alias("hint"), F.lit(None).cast("string").alias("literal")))


@query(f"WITH {_CALLS_SQL} SELECT family, role, count(*) AS n, count(DISTINCT api) AS apis, count(DISTINCT tag) AS tags, count(DISTINCT call) AS calls FROM done GROUP BY ALL")
def q_api_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the calls of the events do, by family and role of the catalog (C10)."""
    done = api.effects(_calls(spark, sf_dir))
    return done.groupBy("family", "role").agg(F.count("*").alias("n"), F.count_distinct("api").alias("apis"), F.count_distinct("tag").alias("tags"), F.count_distinct("call").alias("calls"))


@query(f"WITH {_CALLS_SQL} SELECT DISTINCT call, tag AS source_type, call AS def FROM done WHERE role = 'source' AND tag <> 'STORAGE_ALL_ITEMS'")
def q_api_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls without callbacks: the result is the source."""
    done = api.effects(_calls(spark, sf_dir))
    params = spark.createDataFrame([], "package string, script string, function long, ord long, def long")
    members = spark.createDataFrame([], "package string, script string, node long, api string")
    return api.sources(done, _args(spark, sf_dir), params, members).select("call", "source_type", "def")


@query(f"""WITH {_CALLS_SQL}, args AS (SELECT event_id AS call, event_id * 10 + k AS def, k AS arg FROM events, (VALUES (0), (1)) AS t(k))
SELECT DISTINCT call AS sink, tag AS sink_type, args.def FROM done JOIN args USING (call, arg) WHERE role = 'sink' AND NOT (arg = 1 AND property IS NOT NULL) AND NOT (tag IN ('EVAL', 'TIME_EVAL') AND arg = 1)
UNION ALL SELECT DISTINCT call, tag, call * 10 + 2 FROM done WHERE role = 'sink' AND arg = 1 AND property IS NOT NULL""")
def q_api_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object argument has all properties that the catalog asks for, as one value."""
    done, args = api.effects(_calls(spark, sf_dir)), _args(spark, sf_dir)
    names = [r["property"] for r in api_catalog.catalog(spark).filter("property is not null").select("property").distinct().collect()]  # a handful
    props = args.filter("ord = 1").select("package", "script", F.col("def").alias("object"), F.explode(F.array(*map(F.lit, sorted(names)))).alias("name"), (F.col("def") + 1).alias("def"))
    params = spark.createDataFrame([], "package string, script string, function long, ord long, def long")
    return api.sinks(done, _calls(spark, sf_dir), args, params, props).select("sink", "sink_type", "def")


@query(f"WITH {_CALLS_SQL} SELECT call * 10 + k AS src, call AS dst, tag AS kind FROM done, (VALUES (0), (1)) AS t(k) WHERE role = 'flow'")
def q_api_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.edges(api.effects(_calls(spark, sf_dir)), _args(spark, sf_dir)).select("src", "dst", "kind")


@query(f"WITH {_CALLS_SQL} SELECT call AS def FROM done WHERE role = 'clean'")
def q_api_sanitizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.sanitized(api.effects(_calls(spark, sf_dir))).select("def")


_EVENTS = ["message", "click", "my-event", "", "keydown"]
_TAGS = ["WINDOW_MESSAGE_EVENT", "ELEMENT_VALUE", "WINDOW_CUSTOM_EVENT", "CHROME_COOKIES_ONCHANGED"]


@query(f"""WITH e AS (SELECT p_partkey, {_sql_pick(_TAGS, 'p_size')} AS tag, nullif({_sql_pick(_EVENTS, 'p_partkey')}, '') AS name FROM part)
SELECT p_partkey, CASE tag WHEN 'WINDOW_MESSAGE_EVENT' THEN coalesce(name = 'message', false) WHEN 'ELEMENT_VALUE' THEN coalesce(name IN ('click', 'keydown'), false) WHEN 'WINDOW_CUSTOM_EVENT' THEN name IS NULL OR name = 'my-event' ELSE true END AS hears FROM e""")
def q_event_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", api.event_fits(_pick(_TAGS, F.col("p_size")), F.nullif(_pick(_EVENTS, F.col("p_partkey")), F.lit(""))).alias("hears"))


@query("""WITH m AS (SELECT conv_id, role, list(DISTINCT length(text) % 4 ORDER BY length(text) % 4) AS c, bool_or(length(text) % 5 = 0) AS u FROM conversations GROUP BY ALL)
SELECT a.conv_id AS send_id, b.conv_id AS recv_id FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant' WHERE a.u OR list_has_any(a.c, b.c)""")
def q_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as channels: a user's texts are what is sent (unknown where divisible by 5), an assistant's what is asked for."""
    c = _t(spark, sf_dir, "conversations").select(F.lit("p").alias("package"), F.lit("s").alias("script"), "conv_id", "role", F.lit("action").alias("key"), (F.length("text") % 4).cast("string").alias("literal"), (F.length("text") % 5 == 0).alias("unknown"))
    sent = bridges.merge_candidates(c.filter("role = 'user'").withColumnRenamed("conv_id", "send"), ["send", "key"], "literal", "unknown")
    tests = c.filter("role = 'assistant'").select("package", "script", F.col("conv_id").alias("function"), F.lit(1).alias("def"), "key", "literal")
    listeners = tests.select("package", "script", F.col("function").alias("receive"), "function", "def").distinct()
    pairs = c.filter("role in ('user', 'assistant')").groupBy("conv_id").agg(F.count_distinct("role").alias("n")).filter("n = 2").select(F.col("conv_id").alias("send_id"), F.col("conv_id").alias("recv_id"))
    return api.protocol_pairs(pairs, sent, api.receiver_protocol(tests, listeners)).select("send_id", "recv_id")


@query("""WITH RECURSIVE props AS (SELECT p_partkey // 2 AS object, CASE p_partkey % 2 WHEN 0 THEN 'l' ELSE 'r' END AS name, p_partkey AS def FROM part WHERE p_partkey > 1),
t(root, path, def) AS (SELECT CAST(1 AS BIGINT), '', CAST(1 AS BIGINT) UNION ALL SELECT root, path || props.name, props.def FROM t JOIN props ON t.def = object) SELECT root, path, def FROM t WHERE def NOT IN (SELECT object FROM props)""")
def q_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").filter("p_partkey > 1")
    props = p.select(F.expr("p_partkey div 2").alias("object"), F.when(F.col("p_partkey") % 2 == 0, "l").otherwise("r").alias("name"), F.col("p_partkey").alias("def"))
    return api.projected(props, spark.createDataFrame([(1,)], "def long")).select("root", F.array_join("path", "").alias("path"), "def")


@query("""SELECT s.conv_id AS src, c.conv_id AS dst, 'RETURN' AS kind FROM conversations s JOIN conversations c ON s.turn = c.turn AND s.role = 'assistant' AND c.role = 'assistant' AND s.conv_id % 10 = c.conv_id % 10""")
def q_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").filter("role = 'assistant'").select(F.lit("p").alias("package"), F.lit("s").alias("script"), (F.col("conv_id") % 10 * 1000 + F.col("turn")).alias("function"), "conv_id")
    return api.returns(c.withColumnRenamed("conv_id", "call"), c.withColumnRenamed("conv_id", "def")).select("src", "dst", "kind")


# --- reports ---------------------------------------------------------------


@query("SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents")
def q_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.totals(_t(spark, sf_dir, "documents").select(F.col("n_chars").alias("size")))


@query("SELECT event_type, printf('%.1f%%', share * 100) AS percent, row_number() OVER (ORDER BY share, event_type) AS place FROM (SELECT event_type, count(*) FILTER (user_id % 2 = 0) / count(*) AS share FROM events GROUP BY 1)")
def q_worst_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov = report.coverage(_t(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 2 == 0).alias("hit")), "event_type", "hit")
    worst = report.worst_first(cov, "event_type")
    ranked = worst.agg(F.transform(F.array_sort(F.collect_list(F.struct("share", "event_type", "percent"))), lambda x: x).alias("all"))  # five rows
    return ranked.select(F.posexplode("all").alias("k", "r")).select("r.event_type", "r.percent", (F.col("k") + 1).cast("long").alias("place"))


@query("SELECT c_custkey AS taint FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def q_with_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("taint"))
    return report.with_sinks_only(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("taint")), hits)


@query("SELECT user_id AS file, count(*) AS issues FROM events WHERE event_type = 'error' GROUP BY 1")
def q_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.issues(_t(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("file")), "file")


@query("""SELECT o_orderkey, o_custkey, CASE WHEN r = 1 THEN o_orderpriority END AS path, r > 1 AS repeated FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS r FROM orders)""")
def q_source_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = report.representatives(_t(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"], "o_orderpriority")
    return got.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("path"), "repeated")


@query("SELECT event_type AS name, count(*) FILTER (value > 5) AS hits, count(*) AS lookups, count(*) FILTER (value > 5) / count(*) AS rate FROM events GROUP BY 1")
def q_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.hit_rate(_t(spark, sf_dir, "events").select(F.col("event_type").alias("name"), (F.col("value") > 5).alias("hit")), "name")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 25""")
def q_dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_returnflag") == "R").alias("is_true"), (F.col("l_linestatus") != "F").alias("is_duplicate"), F.when(F.col("l_quantity") > 25, "paper").otherwise("other").alias("kind"))
    return report.dataset_rows(rows, ["paper"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT CASE WHEN d.doc_id IS NULL THEN 'right' ELSE 'left' END AS side, coalesce(d.doc_id, e.doc_id) AS path FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d
FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN coalesce(text, '') || 'x' ELSE coalesce(text, '') END AS t FROM documents) e ON d.doc_id = e.doc_id AND d.t = e.t WHERE d.doc_id IS NULL OR e.doc_id IS NULL""")
def q_same_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    e = d.withColumn("content", F.when(F.col("path") % 50 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    return report.same_files(d, e).select("side", "path")


@query(r"""SELECT c_mktsegment AS graph, 'digraph {' || chr(10) || string_agg(line, chr(10) ORDER BY k, line) || chr(10) || '}' || chr(10) AS dot FROM (
SELECT c_mktsegment, 0 AS k, '  n' || c_custkey || ' [label="' || replace(c_name, '#', '"') || '"]' AS line FROM customer) GROUP BY 1""".replace("""replace(c_name, '#', '"')""", r"""replace(c_name, '#', '\"')"""))
def q_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("graph"), F.col("c_custkey").alias("id"), F.replace("c_name", F.lit("#"), F.lit('"')).alias("label"))
    return report.dot_graph(nodes, spark.createDataFrame([], "graph string, src long, dst long, label string"))


@query("""SELECT o_orderkey, '<tr><td>' || o_orderkey || '</td><td>' || replace(o_orderpriority, '-', '&amp;') || '</td></tr>' AS "row" FROM orders""")
def q_html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.replace("o_orderpriority", F.lit("-"), F.lit("&")).alias("p"))
    return report.html_rows(o, ["o_orderkey", "p"], keep=["o_orderkey"])


@query("""SELECT o_orderpriority AS flow_type, no, line FROM (SELECT o_orderpriority, 0 AS no, o_orderpriority || ' (' || count(*) || ')' AS line FROM orders GROUP BY 1
UNION ALL SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey), '  ' || o_orderstatus || ' -> T  [LOW]  ' || o_orderkey || ' => x' FROM orders)""")
def q_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("flow_type"), F.col("o_orderstatus").alias("source_type"), F.lit("T").alias("sink_type"), F.col("o_orderkey").alias("source_file"), F.lit("x").alias("sink_file"), F.lit("LOW").alias("severity"))
    return report.text_report(o).select("flow_type", F.col("no").cast("long").alias("no"), "line")


@query("""SELECT kind, severity, '{"kind":"' || kind || '","severity":"' || severity || '","evidence":["' || kind || '"]}' AS json FROM (SELECT DISTINCT o_orderstatus AS kind, o_orderpriority AS severity FROM orders)""")
def q_constraint_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("severity")).distinct()
    return o.select("kind", "severity", report.constraint_json(F.struct("kind", "severity", F.array("kind").alias("evidence"))).alias("json"))


# --- HTML and scripts ------------------------------------------------------


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s+([^>]*)>', 1)) AS t FROM pages), h AS (SELECT page_id, regexp_extract(t, 'href\s*=\s*"([^"]*)"', 1) AS href FROM a)
SELECT page_id, count(*) AS n, count(DISTINCT href) AS different FROM h WHERE href <> '' GROUP BY 1""")
def q_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<a\s+([^>]*)>"), F.lit(1))).alias("t"))
    h = tags.select("page_id", F.element_at(packages.attributes(F.col("t")), "href").alias("href")).filter("href <> ''")
    return h.groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct("href").alias("different"))


@query(r"""WITH s AS (SELECT page_id, generate_subscripts(bs, 1) AS k, unnest(bs) AS body FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script\s*>', 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS bs FROM pages))
SELECT page_id, '.inline-scripts/page_' || page_id || '.inline-' || (k - 1) || '.js' AS path, '// [inline]' || chr(10) || '// source-html: page/' || page_id || '.html' || chr(10) || '// script-index: ' || (k - 1) || chr(10) || body AS code FROM s""")
def q_inline_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".html")).alias("page"), "html")
    files = packages.inline_files(packages.html_scripts(p, "page", "html"), "page")
    return files.select(F.regexp_extract("page", r"(\d+)", 1).cast("long").alias("page_id"), "path", "code")


def _page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packages.html_scripts(_t(spark, sf_dir, "pages"), "page_id", "html").filter("kind = 'inline'")
    return script_facts.extract(p.select(F.lit("pages").alias("package"), F.concat_ws("-", F.col("page_id").cast("string"), F.col("ord").cast("string")).alias("script"), F.col("body").alias("code")))


@query()
def q_script_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All inline scripts of all pages, parsed: rows of each fact and kind by script."""
    return _page_facts(spark, sf_dir).groupBy("script", "fact", "kind").agg(F.count("*").alias("n"))


@query()
def q_script_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages' inline scripts call, with what the catalog says of it."""
    calls = script_facts.tables(_page_facts(spark, sf_dir))["call"]
    return calls.withColumn("api", api.api_name(F.col("api"))).groupBy("api").agg(F.count("*").alias("n"))


@query(f"WITH {_FLOWS_SQL} SELECT event_id, sink_type IN {tuple(V.CODE_SINKS + V.DOM_SINKS)} AS reads_text FROM flows")
def q_string_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flows(spark, sf_dir).select("event_id", filters.string_interpreting(F.col("sink_type")).alias("reads_text"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN o_orderkey % 3 = 0 THEN 'T' || o_orderkey END, 'LOW') AS severity FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def q_severity_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("frame"), F.col("o_orderkey").alias("taint"))
    c = _t(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("frame"), F.col("c_mktsegment").alias("severity"))
    t = o.filter("taint % 3 = 0").select("taint", F.concat(F.lit("T"), F.col("taint").cast("string")).alias("severity"))
    return severity.with_fallback(o, c, t).select("o_orderkey", "severity")


@query("""WITH e AS (SELECT l_orderkey AS graph, l_linenumber AS src, l_linenumber + 1 AS dst FROM lineitem WHERE l_linenumber < 7), g AS (SELECT o_orderkey AS graph FROM orders WHERE o_orderkey % 10 <> 0)
SELECT graph, 'entry without a successor' AS fault FROM g WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph = g.graph AND src = 1) UNION ALL SELECT graph, 'exit with a successor' FROM g WHERE EXISTS (SELECT 1 FROM e WHERE e.graph = g.graph AND src = 4)
UNION ALL SELECT graph, 'exit without a predecessor' FROM g WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph = g.graph AND dst = 4) UNION ALL SELECT DISTINCT graph, 'graph without an entry' FROM e WHERE graph NOT IN (SELECT graph FROM g)""")
def q_broken_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "lineitem").filter("l_linenumber < 7").select(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").alias("src"), (F.col("l_linenumber") + 1).alias("dst"))
    g = _t(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("graph"), F.lit(1).alias("entry"), F.lit(4).alias("exit"))
    return program.broken_graphs(e, g)


_REFINING = [(0, "F", "FULL", "dynamic", True, "dynamic address"), (1, "F", None, "fixed", False, "fixed endpoint"), (2, "F", "PARTIAL", "", False, "part of the address is fixed")]


@query("""SELECT event_id, NOT (event_type <> 'view' AND (c LIKE '%fixed%' AND NOT (k = 'FULL' AND c LIKE '%dynamic%') OR (k = 'PARTIAL' AND c NOT LIKE '%fixed%'))) AS keep,
CASE WHEN event_type = 'view' THEN NULL WHEN k = 'FULL' AND c LIKE '%dynamic%' THEN 'dynamic address' WHEN c LIKE '%fixed%' THEN 'fixed endpoint' WHEN k = 'PARTIAL' THEN 'part of the address is fixed' END AS reason
FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'FULL' ELSE 'PARTIAL' END AS k, ['fixed', 'dynamic fixed', 'dynamic', 'other'][CAST(event_id % 4 + 1 AS INT)] AS c FROM events)""")
def q_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "G").otherwise("F").alias("flow_type"), F.when(F.col("event_id") % 3 == 0, "FULL").otherwise("PARTIAL").alias("control"), _pick(["fixed", "dynamic fixed", "dynamic", "other"], F.col("event_id")).alias("sink_code"))
    return refined(e, spark.createDataFrame(_REFINING, "ord int, flow_type string, control string, pattern string, keep boolean, reason string")).select("event_id", "keep", "reason")


@query("""WITH n AS (SELECT p_partkey AS node, p_partkey // 2 AS parent, p_partkey % 2 AS ord, p_type AS type, p_brand AS text FROM part WHERE p_partkey > 0)
SELECT c.node FROM n c JOIN n p ON c.parent = p.node WHERE p.type = 'ECONOMY' AND ((c.type = 'STANDARD' AND c.text <> 'Brand#2') OR (c.ord = 0 AND c.text IN ('Brand#1', 'Brand#3')))""")
def q_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").filter("p_partkey > 0")
    n = p.select(F.lit("p").alias("package"), F.lit("s").alias("script"), F.col("p_partkey").alias("node"), F.expr("p_partkey div 2").alias("parent"), F.lit("body").alias("field"), (F.col("p_partkey") % 2).alias("ord"), F.col("p_type").alias("type"), F.col("p_brand").alias("text"), F.lit(0).alias("start"), F.lit(0).alias("stop"))
    return selectors.select(n, 'ECONOMY > STANDARD[name!="Brand#2"], ECONOMY > *:nth-child(1)[name=/^Brand#[13]$/]').select("node")
