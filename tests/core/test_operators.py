import hashlib
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators import api, bridges, filters, graph, report, rules, severity
from quern.operators.classify import classify
from quern.sources import packages


def _flow_types(spark, source, sink, sets=None):
    pairs = classify(spark.createDataFrame([(source, sink)], "source_type string, sink_type string"))
    got = rules.match_pairs(pairs, rules.rules_frame(spark, sets or [rules.default_rules()]))
    return sorted(r["flow_type"] for r in got.collect())


@pytest.mark.parametrize(
    ("source", "sink", "want"),
    [
        ("WINDOW_MESSAGE_EVENT", "CHROME_BOOKMARK_CREATE_INFO", ["PRIVILEGE_ESCALATION"]),
        ("FETCH_RESPONSE", "EVAL", ["CODE_INJECTION"]),
        ("DOCUMENT_URL", "CHROME_LOCAL_STORAGE", ["STORAGE_POSOING"]),
        ("ELEMENT_VALUE", "FETCH_BODY", ["DATA_LEAK"]),
        ("NAVIGATOR_USER_AGENT", "FETCH_BODY", []),
        ("CHROME_COOKIES_INFO", "FETCH_BODY", ["DATA_LEAK"]),
        ("CHROME_SYSTEM_CPU", "FETCH_HEADERS", []),
        ("CHROME_CONNECTNATIVE_ONMESSAGE", "EVAL", []),
        ("WINDOW_MESSAGE_EVENT", "WINDOW_POSTMESSAGE", []),
        ("NO_SUCH", "EVAL", []),
    ],
)
def test_default_rules(spark, source, sink, want):
    assert _flow_types(spark, source, sink) == want


def test_rule_sets_are_checked_and_layered(spark):
    assert rules.violations({"version": 2, "rules": []})
    assert rules.violations({"version": 1, "rules": [{"id": "x", "flowType": "F", "match": {}}]})
    with pytest.raises(ValueError, match="matcher"):
        rules.rule_rows([{"version": 1, "rules": [{"id": "x", "flowType": "F"}]}])
    own = {"version": 1, "rules": [{"id": "mine", "flowType": "OWN", "match": {"sourceType": "FETCH_*", "sinkType": ["EVAL"]}}]}
    assert _flow_types(spark, "FETCH_RESPONSE", "EVAL", [rules.default_rules(), own]) == ["CODE_INJECTION", "OWN"]


@pytest.mark.parametrize(("value", "pattern", "want"), [("NAVIGAROR_GEOLOCATION", "NAVIGATOR_*", False), ("CHROME_SYNC_STORAGE", "*_STORAGE", True), ("STORAGE_ALL_ITEMS", "*_STORAGE", False), ("a.b", "a.b", True), ("axb", "a.b*", False)])
def test_globs(spark, value, pattern, want):
    assert spark.range(1).select(S.glob_match(F.lit(value), F.lit(pattern)).alias("x")).first()["x"] is want


@pytest.mark.parametrize(
    ("source", "family", "matches", "want"),
    [
        ("ELEMENT_TEXT_CONTENT", "CS", ["<all_urls>"], ("CONTENT_SCRIPT_MATCHES", "CRITICAL")),
        ("DOCUMENT_TITLE", "CS", ["https://*.example.com/*"], ("CONTENT_SCRIPT_MATCHES", "HIGH")),
        ("ELEMENT_VALUE", "CS", ["https://www.youtube.com/watch*"], ("CONTENT_SCRIPT_MATCHES", "LOW")),
        ("DOCUMENT_TITLE", "BG", ["<all_urls>"], ("UNKNOWN", "LOW")),
        ("ELEMENT_VALUE", "CS", ["http://localhost:8080/*", "file:///*"], ("CONTENT_SCRIPT_MATCHES", "LOW")),
    ],
)
def test_severity(spark, source, family, matches, want):
    none = F.lit(None).cast("array<string>")
    c = severity.constraint(F.lit(source), F.lit("EVAL"), F.lit(family), F.array(*map(F.lit, matches)), none, none)
    r = spark.range(1).select(c.alias("c")).first()["c"]
    assert (r["kind"], r["severity"]) == want


def test_storage_bridge_wildcards(spark):
    sets = spark.createDataFrame([("p", "local", "a", 1), ("p", "local", None, 2), ("p", "sync", "a", 3), ("q", "local", "a", 4)], "package string, area string, key string, set_id long")
    gets = spark.createDataFrame([("p", "local", "a", 10), ("p", "local", None, 11), ("p", "*", "a", 12), ("r", "local", "a", 13)], "package string, area string, key string, get_id long")
    got = sorted(tuple(r) for r in bridges.storage_bridge(sets, gets).collect())
    assert got == [(1, 10), (1, 11), (1, 12), (2, 10), (2, 11), (2, 12), (3, 12)]


def test_cycles_end(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    got = {r["node"]: r["depth"] for r in graph.closure(edges, spark.createDataFrame([(1,)], "root long")).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}
    levels = {r["node"]: r["level"] for r in graph.topo_levels(edges.toDF("node", "dep"), spark.createDataFrame([(1,), (4,)], "node long")).collect()}
    assert levels == {1: None, 4: 0}


def test_fixpoints_have_no_bound(spark):
    chain = spark.range(70).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).coalesce(1)
    sources = spark.createDataFrame([("t", 0)], "taint string, def long")
    assert graph.propagate(sources, chain).count() == 71
    got = graph.paths(chain.filter("src < 22"), spark.createDataFrame([(0,)], "node long"), spark.createDataFrame([(22,)], "node long"))
    assert [r["path"] for r in got.collect()] == [list(range(23))]


def test_a_bound_is_an_error(spark):
    chain = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    one = spark.createDataFrame([(0,)], "root long")
    assert graph.closure(chain, one, 3).count() == 4
    for run in (
        lambda: graph.closure(chain, one, 2),
        lambda: graph.propagate(spark.createDataFrame([("t", 0)], "taint string, def long"), chain, None, 2),
        lambda: graph.topo_levels(chain.toDF("node", "dep"), spark.createDataFrame([(0,), (1,), (2,), (3,)], "node long"), 2),
        lambda: graph.paths(chain, one.toDF("node"), spark.createDataFrame([(3,)], "node long"), 2),
    ):
        with pytest.raises(RuntimeError, match="fixpoint"):
            run()


def test_sanitizers_stop_taint(spark):
    edges = spark.createDataFrame([(1, 2, "ASSIGN"), (2, 3, "RETURN")], "src long, dst long, kind string")
    sources = spark.createDataFrame([("t", 1), ("u", 1)], "taint string, def long")
    got = graph.propagate(sources, edges, spark.createDataFrame([("t", 2)], "taint string, def long"))
    assert sorted((r["taint"], r["def"]) for r in got.collect()) == [("t", 1), ("u", 1), ("u", 2), ("u", 3)]


def test_ignore_patterns(spark):
    paths = ["a/vendor/x.js", "vendor/keep.js", "src/lib.min.js", "src/a.js"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", filters.ignored(F.col("p"), ["vendor/", "*.min.js", "!vendor/keep.js"]).alias("x")).collect()
    assert {r["p"]: r["x"] for r in got} == {"a/vendor/x.js": True, "vendor/keep.js": False, "src/lib.min.js": True, "src/a.js": False}


def test_frames_in_which_a_flow_cannot_happen(spark):
    rows = [("ELEMENT_VALUE", "EVAL", ["EX"], ["EX"]), ("ELEMENT_VALUE", "EVAL", ["CS"], ["CS"]), ("WINDOW_MESSAGE_EVENT", "EVAL", ["BG"], ["BG"])]
    f = spark.createDataFrame(rows, "source_type string, sink_type string, source_families array<string>, sink_families array<string>")
    assert [r["source_families"] for r in filters.feasible(f).collect()] == [["CS"]]


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in files.items():
            z.writestr(n, c)
    return out.getvalue()


def test_packages(spark, tmp_path):
    good = _zip({"manifest.json": '{"name": "n", "version": "1.0", "manifest_version": 3}', "a.js": "eval(x)"})
    key = b"\x01\x02" * 20
    own = hashlib.sha256(key).digest()[:16]
    head = _field(2, _field(1, key) + _field(2, b"sig")) + _field(10000, _field(1, own))
    (tmp_path / "three.crx").write_bytes(b"Cr24" + struct.pack("<II", 3, len(head)) + head + good)
    (tmp_path / "two.crx").write_bytes(b"Cr24" + struct.pack("<III", 2, len(key), 3) + key + b"sig" + good)
    (tmp_path / "bad.zip").write_bytes(_zip({"manifest.json": "{}", "../x.js": ""}))
    (tmp_path / "none.xpi").write_bytes(b"nothing")
    files = packages.read_archives(spark, str(tmp_path)).cache()
    assert sorted(r["error"] is None for r in files.select("package", "error").distinct().collect()) == [False, False, True, True]
    ids = {r["id"] for r in packages.manifests(files.filter("error is null")).collect()}
    want = "".join(chr(97 + int(c, 16)) for c in hashlib.sha256(key).hexdigest()[:32])
    assert ids == {want}
    assert {r["path"] for r in packages.scripts(files).collect()} == {"a.js"}


def _field(k, v):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return varint(k << 3 | 2) + varint(len(v)) + v


def test_html_scripts(spark):
    html = '<script>one()</script><SCRIPT SRC="../lib/a.js"></SCRIPT><script src=/b.js type=module></script><script src="https://x/y.js"></script><script>  </script><script src="">two()</script><script src=" c.js ">x</script><script>\n\n</script><script src="  "></script>'
    got = packages.html_scripts(spark.createDataFrame([(1, html)], "k long, html string"), "k", "html")
    rows = {(r["kind"], r["src"], r["script_type"]) for r in got.collect()}
    assert rows == {("inline", None, "text/javascript"), ("local", "../lib/a.js", "text/javascript"), ("local", "/b.js", "module"), ("external", "https://x/y.js", "text/javascript"), ("local", "c.js", "text/javascript")}
    inline = packages.inline_files(got.withColumn("page", F.lit("pages/p.html")), "page").orderBy("path").collect()
    assert [(r["path"], r["code"].split("\n")[-1]) for r in inline] == [(".inline-scripts/pages_p.inline-0.js", "one()"), (".inline-scripts/pages_p.inline-1.js", "two()")]
    paths = spark.range(1).select(*(packages.resolve(F.lit("pages/p.html"), F.lit(s)) for s in ("../lib/a.js?x", "/b.js", "./c.js"))).first()
    assert tuple(paths) == ("lib/a.js", "b.js", "pages/c.js")


def test_reports(spark):
    assert [r["share"] for r in report.coverage(spark.createDataFrame([], "k string, hit boolean"), "k", "hit").collect()] in ([], [1.0])
    nodes, edges = spark.createDataFrame([("g", 1, 'a"b'), ("g", 2, None)], "graph string, id int, label string"), spark.createDataFrame([("g", 1, 2, "x"), ("g", 1, 2, "x")], "graph string, src int, dst int, label string")
    dot = report.dot_graph(nodes, edges).first()["dot"]
    assert dot.count("->") == 1 and '\\"' in dot
    row = report.html_rows(spark.createDataFrame([("<b>&",)], "c string"), ["c"]).first()["row"]
    assert row == "<tr><td>&lt;b&gt;&amp;</td></tr>"
    s = report.summary(spark.createDataFrame([("F",), ("F",)], "flow_type string"), spark.createDataFrame([(3,)], "size long")).first()["summary"]
    assert s == '{"flows":{"F":2},"files":1,"bytes":3}'


def test_text_functions(spark):
    r = spark.range(1).select(S.event_names(F.lit(" Click.ns  keyup click")).alias("e"), S.percent(F.lit(0.125)).alias("p"), S.script_key(F.lit("a/b.js")).alias("k"), S.pad_right(F.lit("abc"), 2).alias("w"), S.is_gecko_id(F.lit("a@b.c")).alias("g"), S.is_version(F.lit("1.2.x")).alias("v")).first()
    assert (r["e"], r["p"], r["k"], r["w"], r["g"], r["v"]) == (["click", "keyup"], "12.5%", "a/b", "abc", True, False)


def test_rule_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"version": 1, "rules": [{"id": "x", "flowType": "F", "match": {"sinkType": "EV*"}}]}')
    (tmp_path / "b.json").write_text(" ")
    sets = rules.load(spark, str(tmp_path))
    assert _flow_types(spark, "NO_SUCH", "EVAL", sets) == ["F"] and sets[1]["rules"] == []


def test_report_texts(spark):
    flows = spark.createDataFrame([("F", "S", "T", "a.js", "b.js", "HIGH"), ("F", "S", "T", "a.js", "a.js", "LOW")], "flow_type string, source_type string, sink_type string, source_file string, sink_file string, severity string")
    lines = [r["line"] for r in report.text_report(flows).orderBy("flow_type", "no").collect()]
    assert lines == ["F (2)", "  S -> T  [LOW]  a.js => a.js", "  S -> T  [HIGH]  a.js => b.js"]
    a, b = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, content string"), spark.createDataFrame([("x", "1"), ("y", "3")], "path string, content string")
    assert sorted(r["side"] for r in report.same_files(a, b).collect()) == ["left", "right"] and report.same_files(a, a).count() == 0
    cov = report.coverage(spark.createDataFrame([("a", True), ("a", False), ("b", False)], "k string, hit boolean"), "k", "hit")
    assert [(r["k"], r["percent"]) for r in report.worst_first(cov, "k").collect()] == [("b", "0.0%"), ("a", "50.0%")]
    r = spark.range(1).select(S.url_with_query("https://h/p", id=F.lit("a b"), v=F.lit("1")).alias("u"), S.value_at(F.lit('{"a": {"b": [1, {"c": "z"}]}}'), "a.b.1.c").alias("v")).first()
    assert (r["u"], r["v"]) == ("https://h/p?id=a+b&v=1", "z")


def test_folders(spark, tmp_path):
    root = tmp_path / "ext"
    for path, text in {"myext/manifest.json": "{}", "myext/ext/a.js": "1", "other/manifest.json": "{}", "other/b.js": "2", "none/c.js": "3"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    got = {(r["package"], r["path"]) for r in packages.read_folders(spark, str(root)).collect()}
    assert got == {("myext", "manifest.json"), ("myext", "ext/a.js"), ("other", "manifest.json"), ("other", "b.js")}


def test_long_chains_and_levels(spark):
    chain = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).coalesce(1)
    levels = graph.topo_levels(chain.filter("src < 20").toDF("dep", "node"), spark.range(21).toDF("node"))
    assert {r["node"]: r["level"] for r in levels.collect()} == {k: k for k in range(21)}
    got = graph.paths(chain.filter("src < 30"), spark.createDataFrame([(0,)], "node long"), spark.createDataFrame([(30,)], "node long"))
    assert [r["path"] for r in got.collect()] == [list(range(31))]


def test_html_page_needs_no_other_file(spark):
    page = report.html_page(spark.createDataFrame([("<b>", "x")], "flow_type string, sink string"), ["flow_type", "sink"], "Flows & more")
    assert "&lt;b&gt;" in page and "Flows &amp; more" in page and "<script src" not in page and "<link" not in page
    lines = [r["line"] for r in report.source_markdown(spark.createDataFrame([("S", "r", "L1", "a>b"), ("S", None, None, None)], "source_type string, remark string, location string, path string")).orderBy("source_type", "no").collect()]
    assert lines == ["## S (2)", "-  at [unknown_loc]", "- r at L1: a>b"]
    assert report.flow_json(spark.createDataFrame([("F", None)], "a string, b string")).first()["json"] == '{"a":"F","b":null}'


def test_projected_of_many_properties_is_not_broadcast(spark):
    """A sent value with more properties than are broadcast: each is a value of its own, by joins of shuffled rows."""
    n = graph.BROADCAST_ROWS + 1
    props = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("object"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), F.col("id").alias("def"))
    got = api.projected(props, spark.createDataFrame([(0,)], "def long"))
    assert got.filter("path = array(concat('p', def))").count() == n
    deep = props.unionByName(props.select(F.col("def").alias("object"), F.lit("q").alias("name"), (F.col("def") + n).alias("def")))
    got = api.projected(deep, spark.createDataFrame([(0,)], "def long"))
    assert got._jdf.queryExecution().simpleString().count("Broadcast") == 0
    assert got.filter("size(path) = 2").count() == got.count() == n


def test_channel_pairs_are_dealt_out(spark):
    """All pairs of one channel, each once, made in more than one task."""
    side = lambda name: spark.createDataFrame([("p", k, "c", k % 3 or None) for k in range(60)], f"package string, {name} long, channel string, outer_id long")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = bridges.channel_bridge(side("send_id").withColumn("root", F.lit("r")), side("recv_id"), ("root",)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    want = sorted((a, b, "c", "r") for a in range(60) for b in range(60) if a % 3 == 0 or b % 3 == 0 or a % 3 == b % 3)
    assert sorted((r["send_id"], r["recv_id"], r["channel"], r["root"]) for r in got) == want
    assert len({r["task"] for r in got}) > 1
