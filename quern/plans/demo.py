"""The operators on the synthetic tables: a query each, and the same in DuckDB SQL.

The tables stand in for facts: events for reads and writes of stored values, parts for names and a graph, pages for HTML, conversations for ordered scripts, orders and lines for flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from ..operators import bridges, classify, filters, graph, program, report, rules, severity
from ..operators.privilege import gate
from ..sources.packages import html_scripts
from ..streaming.counts import stream_table, window_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Flows out of events: an event's type and value choose a source and a sink from the vocabularies.
_SOURCES = [*V.ATTACKER_SOURCES, *V.SENSITIVE_SOURCES, *V.SYSTEM_SOURCES, *V.NETWORK_SOURCES, *V.DOCUMENT_SOURCES, "NO_SUCH_SOURCE"]
_SINKS = [*V.CODE_SINKS, *V.NETWORK_SINKS, *V.MESSAGE_SINKS, *V.DOM_SINKS, *V.STORAGE_SINKS, *V.PRIVILEGED_SINKS, "NO_SUCH_SINK"]


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    return _t(spark, sf_dir, "events").select("event_id", "user_id", pick(_SOURCES, F.col("event_id")).alias("source_type"), pick(_SINKS, F.col("event_id") * 7 + F.col("user_id")).alias("sink_type"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


_FLOWS_SQL = f"""flows AS (SELECT event_id, user_id, list_extract(s, CAST(event_id % {len(_SOURCES)} + 1 AS INT)) AS source_type, list_extract(k, CAST((event_id * 7 + user_id) % {len(_SINKS)} + 1 AS INT)) AS sink_type
FROM events, (SELECT {_SOURCES!r} AS s, {_SINKS!r} AS k)),
sources AS (SELECT * FROM (VALUES {_values([(n, c) for names, c in V.SOURCE_LISTS for n in names])}) AS t(source_type, source_cap)),
sinks AS (SELECT * FROM (VALUES {_values([(n, c) for names, c in V.SINK_LISTS for n in names])}) AS t(sink_type, sink_cap)),
classified AS (SELECT event_id, user_id, f.source_type, f.sink_type, coalesce(source_cap, 'UNKNOWN_SOURCE') AS source_cap, coalesce(sink_cap, 'UNKNOWN_SINK') AS sink_cap
FROM flows f LEFT JOIN sources USING (source_type) LEFT JOIN sinks USING (sink_type))"""

_PAIRS_SQL = _values([line.split() for line in rules.DEFAULT_PAIRS])
_NAMED_SQL = f"""{_FLOWS_SQL},
named AS (SELECT event_id, user_id, c.source_type, c.sink_type, c.source_cap, c.sink_cap, p.flow_type, lower(replace(p.source_cap || '-' || p.sink_cap, '_', '-')) AS rule_id
FROM classified c JOIN (VALUES {_PAIRS_SQL}) AS p(source_cap, sink_cap, flow_type) USING (source_cap, sink_cap)
WHERE NOT (flow_type = 'DATA_LEAK' AND (source_type LIKE 'NAVIGATOR\\_%' ESCAPE '\\' OR source_type = 'SCREEN_INFO'))
AND NOT (c.source_cap IN ('SENSITIVE_DATA', 'SYSTEM_INFO') AND sink_type IN ('FETCH_HEADERS', 'AXIOS_HEADERS', 'XML_HTTP_REQUEST_SETHEADER'))
AND NOT contains(source_type, 'NATIVE') AND NOT contains(sink_type, 'NATIVE')
AND NOT (source_type = 'WINDOW_MESSAGE_EVENT' AND sink_type = 'WINDOW_POSTMESSAGE'))"""


@query(f"WITH {_NAMED_SQL} SELECT flow_type, rule_id, count(*) AS n, count(DISTINCT user_id) AS users FROM named GROUP BY ALL")
def flow_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows named by the default rules, less the suppressed ones, counted by type and rule."""
    named = rules.match_flows(_flows(spark, sf_dir), rules.rules_frame(spark, [rules.default_rules()]))
    return named.groupBy("flow_type", "rule_id").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"WITH {_NAMED_SQL} SELECT event_id, min(flow_type) AS flow_type, count(*) AS n_rules FROM named GROUP BY event_id")
def q_first_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = rules.match_flows(_flows(spark, sf_dir), rules.rules_frame(spark, [rules.default_rules()]))
    first = rules.first_match(named, ["event_id"])
    return first.join(named.groupBy("event_id").agg(F.count("*").alias("n_rules")), "event_id")


@query(f"WITH {_FLOWS_SQL} SELECT event_id, source_type, sink_type, source_cap, sink_cap FROM classified")
def q_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(_flows(spark, sf_dir).drop("user_id"))


@query(f"""WITH {_NAMED_SQL}, gated AS (SELECT event_id, flow_type, CASE
WHEN sink_cap = 'PRIVILEGED_OPERATION' AND sink_type LIKE 'CHROME\\_%' ESCAPE '\\' THEN NULL
WHEN fam = 'MAIN' AND sink_cap = 'CODE_EXECUTION' THEN 'page-world code execution'
WHEN source_cap = 'WEB_CONTENT' AND sink_cap = 'NETWORK_SEND' AND fam = 'CS' THEN 'content-script network access is the page''s own'
WHEN sink_cap = 'STORAGE_WRITE' AND user_id % 2 = 1 THEN 'stored value is never read back'
WHEN sink_type IN ('JQUERY_ELEMENT_VAL_SET', 'JQUERY_ELEMENT_TEXT_SET') THEN 'text display only' END AS reason
FROM (SELECT *, ['CS', 'BG', 'MAIN', 'EX'][CAST(user_id % 4 + 1 AS INT)] AS fam FROM named))
SELECT event_id, flow_type, reason, reason IS NULL AS crossing FROM gated""")
def q_privilege(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = rules.match_flows(_flows(spark, sf_dir), rules.rules_frame(spark, [rules.default_rules()]))
    family = F.element_at(F.array(*map(F.lit, ("CS", "BG", "MAIN", "EX"))), (F.col("user_id") % 4 + 1).cast("int"))
    f = named.withColumns({"source_family": family, "sink_family": family, "package": F.lit("p"), "storage_area": F.lit("local"), "storage_key": (F.col("user_id") % 2).cast("string"), "sink_code": F.lit("")})
    readers = spark.createDataFrame([("p", "local", "0")], "package string, area string, key string")
    return gate(f, readers).select("event_id", "flow_type", "reason", "crossing")


@query("""WITH names AS (SELECT DISTINCT p_type AS name FROM part),
rules AS (SELECT * FROM (VALUES (0, 'PROMO*', 'A'), (1, '*BRASS', 'B'), (2, 'STANDARD*', 'C'), (3, '*STEEL*', 'D')) AS t(ord, pat, tag))
SELECT name, ord, tag FROM names JOIN rules ON name = pat OR (contains(pat, '*') AND regexp_full_match(name, replace(pat, '*', '.*')))
WHERE NOT (regexp_full_match(name, '.*PLATED.*') AND tag = 'B')""")
def q_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _t(spark, sf_dir, "part").select(F.col("p_type").alias("source_type")).distinct()
    pairs = names.select("source_type", F.lit("T").alias("sink_type"), F.lit("S").alias("source_cap"), F.lit("K").alias("sink_cap"))
    by_name = [{"id": tag, "flowType": tag, "match": {"sourceType": pattern}} for pattern, tag in (("PROMO*", "A"), ("*BRASS", "B"), ("STANDARD*", "C"), ("*STEEL*", "D"))]
    off = [{"id": "off", "flowType": "B", "match": {"sourceType": "*PLATED*"}}]
    found = rules.match_pairs(pairs, rules.rules_frame(spark, [{"version": 1, "rules": by_name, "suppress": off}]))
    return found.select(F.col("source_type").alias("name"), "ord", F.col("flow_type").alias("tag"))


_EVENT_KEY = "json_extract_string(props, '$.k')"


@query(f"""WITH e AS (SELECT event_id, user_id, ts, event_type, {_EVENT_KEY} AS k FROM events)
SELECT s.event_id AS set_id, g.event_id AS get_id FROM e s JOIN e g ON s.user_id = g.user_id AND s.k = g.k AND s.event_type = 'click' AND g.event_type = 'view'""")
def q_storage_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("package"), F.lit("local").alias("area"), F.get_json_object("props", "$.k").alias("key"), "event_type").filter("key is not null")
    sets = e.filter("event_type = 'click'").select("package", "area", "key", F.col("event_id").alias("set_id"))
    gets = e.filter("event_type = 'view'").select("package", "area", "key", F.col("event_id").alias("get_id"))
    return bridges.storage_bridge(sets, gets).select("set_id", "get_id")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_id FROM events""")
def q_reaching_def(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("event_type") == "click", F.col("event_id"))
    return _t(spark, sf_dir, "events").select("event_id", bridges.last_definition(d, ["user_id"], ["ts", "event_id"]).alias("def_id"))


@query("""WITH RECURSIVE t(root, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL
SELECT root, node // 2, depth + 1 FROM t WHERE node // 2 > 0) SELECT root, node, depth FROM t""")
def q_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    edges = p.select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst")).filter("dst > 0")
    return graph.closure(edges, p.select(F.col("p_partkey").alias("root")))


@query("SELECT p_partkey AS node, CASE WHEN p_partkey < 1 THEN 0 ELSE CAST(floor(log2(p_partkey)) AS INT) END AS level FROM part")
def q_topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    edges = p.select(F.col("p_partkey").alias("node"), F.expr("p_partkey div 2").alias("dep")).filter("dep > 0")
    return graph.topo_levels(edges, p.select(F.col("p_partkey").alias("node")))


@query("""WITH RECURSIVE t(taint, def) AS (SELECT p_partkey, p_partkey FROM part WHERE p_size = 1 UNION ALL SELECT taint, def // 2 FROM t WHERE def // 2 > 0 AND (def // 2) % 7 <> 0)
SELECT t.taint, s.p_partkey AS sink FROM t JOIN part s ON t.def = s.p_partkey WHERE s.p_size < 10 AND t.taint % 7 <> 0""")
def q_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    edges = p.select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst")).filter("dst > 0")
    sources = p.filter("p_size = 1").select(F.col("p_partkey").alias("taint"), F.col("p_partkey").alias("def"))
    clean = p.filter("p_partkey % 7 = 0").select(F.lit(None).cast("long").alias("taint"), F.col("p_partkey").alias("def"))
    sinks = p.filter("p_size < 10").select(F.col("p_partkey").alias("sink"), F.lit("SINK").alias("sink_type"), F.col("p_partkey").alias("def"))
    return graph.check_sinks(graph.propagate(sources, edges, clean), sinks).select("taint", "sink")


@query("""WITH RECURSIVE t("start", n, path) AS (SELECT p_partkey, p_partkey, CAST(p_partkey AS VARCHAR) FROM part WHERE p_size = 2 UNION ALL
SELECT "start", n // 2, path || '>' || CAST(n // 2 AS VARCHAR) FROM t WHERE n // 2 > 0) SELECT "start" AS first_node, n AS last_node, path FROM t WHERE n < 4""")
def q_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    edges = p.select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst")).filter("dst > 0")
    got = graph.paths(edges, p.filter("p_size = 2").select(F.col("p_partkey").alias("node")), p.filter("p_partkey < 4").select(F.col("p_partkey").alias("node")))
    return got.select(F.col("start").alias("first_node"), F.col("end").alias("last_node"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([^:]+)://([^/]*)(/.*)?$', 2) AS host, coalesce(nullif(regexp_extract(url, '^([^:]+)://([^/]*)(/.*)?$', 3), ''), '/') AS path FROM pages)
SELECT page_id, host, CASE WHEN host = '' THEN 1 WHEN host = '*' THEN 4 WHEN starts_with(host, '*.') THEN 3 WHEN path IN ('/*', '/', '*') THEN 2 ELSE 1 END AS score,
CASE WHEN host = '*' THEN 'CRITICAL' WHEN starts_with(host, '*.') THEN 'HIGH' WHEN path IN ('/*', '/', '*') THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM u""")
def q_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = S.pattern_rank(F.col("url"))
    return _t(spark, sf_dir, "pages").select("page_id", S.pattern_host(F.col("url")).alias("host"), rank.alias("score"), S.rank_severity(rank).alias("severity"))


@query("""SELECT user_id, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS covered, count(*) AS total, count(*) FILTER (event_type = 'view') / count(*) AS share FROM events GROUP BY ROLLUP (user_id)""")
def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.coverage(_t(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "view").alias("hit")), "user_id", "hit")


@query(r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script\b([^>]*)>(.*?)</script\s*>', 2)) AS body, unnest(regexp_extract_all(html, '(?is)<script\b([^>]*)>(.*?)</script\s*>', 1)) AS a FROM pages)
SELECT page_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(regexp_replace(body, '^\s+|\s+$', '', 'g'))) AS BIGINT) AS chars FROM s WHERE regexp_extract(a, 'src\s*=\s*"?([^"\s]*)', 1) = '' AND regexp_replace(body, '^\s+|\s+$', '', 'g') <> '' GROUP BY page_id""")
def q_html_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_scripts(_t(spark, sf_dir, "pages"), "page_id", "html").filter("kind = 'inline'")
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("body").cast("long")).alias("chars"))


@query("""SELECT o_orderpriority AS flow_type, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1 GROUP BY 1""")
def q_flow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = report.first_of(_t(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"])
    return report.flow_counts(first.withColumnRenamed("o_orderpriority", "flow_type"))


@query("""WITH c AS (SELECT conv_id, role, list(DISTINCT length(text) % 5 ORDER BY length(text) % 5) AS cand, bool_or(length(text) % 11 = 0) AS unknown FROM conversations GROUP BY conv_id, role)
SELECT a.conv_id, NOT (NOT a.unknown AND NOT b.unknown AND NOT list_has_any(a.cand, b.cand)) AS may FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant'""")
def q_may_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").select("conv_id", "role", (F.length("text") % 5).alias("v"), (F.length("text") % 11 == 0).alias("u"))
    m = bridges.merge_candidates(c, ["conv_id", "role"], "v", "u")
    a, b = (m.filter(F.col("role") == r).select("conv_id", F.col("candidates").alias(f"c_{r}"), F.col("known").alias(f"k_{r}")) for r in ("user", "assistant"))
    return a.join(b, "conv_id").select("conv_id", bridges.may_match(F.col("c_user"), F.col("k_user"), F.col("c_assistant"), F.col("k_assistant")).alias("may"))


@query(r"""SELECT page_id, coalesce(CASE WHEN regexp_full_match(p, '(?:.*/)?[^/]*0') THEN false WHEN regexp_full_match(p, '(?:.*/)?[^/]*1[^/]*') THEN true END, false) AS ignored
FROM (SELECT page_id, regexp_replace(url, '^[^:]+://', '') AS p FROM pages)""")
def q_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[^:]+://", "")
    return _t(spark, sf_dir, "pages").select("page_id", filters.ignored(path, ["*1*", "!*0"]).alias("ignored"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(substr(text, 1, 65536), '(?i)license') THEN 'license' WHEN regexp_matches(substr(text, 1, 65536), '(?i)token *=') THEN 'secret' WHEN regexp_matches(substr(text, 1, 65536), '(?i)the ') THEN 'english' END AS library FROM documents""")
def q_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.createDataFrame([(0, "license", "license"), (1, "secret", "token *="), (2, "english", "the ")], "ord int, name string, pattern string")
    return classify.first_signature(_t(spark, sf_dir, "documents"), F.col("text"), s, ["doc_id"])


@query("""WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(CASE WHEN len(t) <= 3 THEN t ELSE list_concat(t[1:2], t[-1:]) END, ',') AS kept, CAST(CASE WHEN len(t) <= 3 THEN 0 ELSE len(t) - 3 END AS INT) AS omitted FROM c""")
def q_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    r = report.truncated(F.col("t"), 3, 2, 1)
    return c.select("conv_id", F.array_join(r["kept"].cast("array<string>"), ",").alias("kept"), r["omitted"].alias("omitted"))


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS id, CAST(l_partkey % 50 AS BIGINT) AS low, CAST(l_partkey % 50 + l_quantity AS BIGINT) AS high FROM lineitem), p AS (SELECT o_orderkey AS k, o_custkey % 60 AS place FROM orders)
SELECT k, place, id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY high - low, id) AS n FROM (SELECT p.k, p.place, r.id, r.low, r.high FROM p LEFT JOIN r ON p.k = r.k AND place >= low AND place <= high)) WHERE n = 1""")
def q_scope_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), (F.col("l_partkey") % 50).alias("low"), (F.col("l_partkey") % 50 + F.col("l_quantity")).cast("long").alias("high"))
    p = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 60).alias("place"))
    return bridges.innermost(p, r, ["k"], "place", "low", "high", "id").select("k", "place", "id")


@query("""SELECT a.conv_id AS frame, a.turn AS script, b.turn AS earlier FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn""")
def q_frame_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridges.frame_predecessors(_t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("frame"), F.col("turn").alias("ord"), F.col("turn").alias("script")))


@query("""WITH e AS (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
SELECT event_id, coalesce(bool_or(event_type = 'click') OVER (PARTITION BY user_id, g ORDER BY ts, event_id), false) AS tainted FROM e""")
def q_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return bridges.straight_line_taint(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "error").select("event_id", "tainted")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def q_used_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return filters.used_only(_t(spark, sf_dir, "customer"), used, "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) AS r FROM lineitem) WHERE r = 1")
def q_max_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity.most_severe(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", "l_partkey", ["l_partkey"])


@query("""SELECT 'and' AS op, count(*) AS n FROM (SELECT p_partkey FROM part WHERE p_size < 25 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
UNION ALL SELECT 'minus', count(*) FROM (SELECT p_partkey FROM part WHERE p_size < 25 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
UNION ALL SELECT 'or', count(*) FROM (SELECT p_partkey FROM part WHERE p_size < 25 UNION SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def q_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _t(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").alias("k"))
    b = _t(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return program.set_algebra(a, b).groupBy("op").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id, text, length(text) // 2 AS s FROM documents)
SELECT doc_id, substr(text, CAST(greatest(0, s - 20) + 1 AS INT), CAST(s - greatest(0, s - 20) AS INT)) || '>>>' || substr(text, CAST(s + 1 AS INT), 5) || '<<<' || substr(text, CAST(s + 6 AS INT), 20) AS snippet FROM d""")
def q_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr("int(length(text) div 2)")
    return _t(spark, sf_dir, "documents").select("doc_id", S.snippet(F.col("text"), s, s + 5).alias("snippet"))


@query("""SELECT s_suppkey AS send_id, c_custkey AS recv_id, CAST(s_nationkey AS VARCHAR) AS channel, r_name AS root FROM supplier JOIN customer ON s_nationkey = c_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE s_suppkey % 3 = 0 OR c_custkey % 3 = 0 OR s_suppkey % 3 = c_custkey % 3""")
def q_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = lambda c: F.when(F.col(c) % 3 != 0, F.col(c) % 3)
    send = _t(spark, sf_dir, "supplier").select(F.lit("p").alias("package"), F.col("s_suppkey").alias("send_id"), F.col("s_nationkey").cast("string").alias("channel"), outer("s_suppkey").alias("outer_id"))
    recv = _t(spark, sf_dir, "customer").select(F.lit("p").alias("package"), F.col("c_custkey").alias("recv_id"), F.col("c_nationkey").cast("string").alias("channel"), outer("c_custkey").alias("outer_id"))
    roots = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("channel"), F.col("r_name").alias("root"))
    return bridges.channel_bridge(send.join(roots, "channel"), recv, ("root",)).select("send_id", "recv_id", "channel", "root")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS id, arg_max(l_returnflag, l_linenumber * 100000000000 + CAST(l_extendedprice * 100 AS BIGINT) * 100 + l_quantity) AS type, arg_max(l_linestatus, l_linenumber * 100000000000 + CAST(l_extendedprice * 100 AS BIGINT) * 100 + l_quantity) AS html_path, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), ',') AS scripts FROM lineitem GROUP BY l_orderkey""")
def q_registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), (F.col("l_linenumber") * 100_000_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long") * 100 + F.col("l_quantity")).alias("ord"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("html_path"), F.array(F.concat("l_returnflag", "l_linestatus")).alias("script_paths"))
    return report.merge_components(rows).select("id", "type", "html_path", F.array_join("script_paths", ",").alias("scripts"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_counts(_t(spark, sf_dir, "events"), "ts", "event_type").withColumnRenamed("start", "window_start")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts by a stream that is run to the end of its folder."""
    import uuid

    name = f"counts_{uuid.uuid4().hex}"
    counts = window_counts(stream_table(spark, f"{sf_dir}/events.parque[t]", _t(spark, sf_dir, "events").schema), "ts", "event_type")
    at = f"{graph.shared_dir(spark)}/{name}"
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(at)).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.schema(counts.schema).parquet(at) if q.lastProgress else spark.createDataFrame([], counts.schema)
    return found.withColumnRenamed("start", "window_start")


@query("SELECT l_returnflag AS tool, count(*) FILTER (l_linestatus = 'O') AS tp, count(*) FILTER (l_linestatus <> 'O') AS fp, count(*) FILTER (l_linestatus = 'O') / count(*) AS precision FROM lineitem GROUP BY 1")
def q_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.verdict_counts(_t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tool"), (F.col("l_linestatus") == "O").alias("is_true")))


from . import analysis, more  # noqa: E402, F401  (more queries, into the same tables)
