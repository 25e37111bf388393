import random

from pyspark.sql import functions as F

from quern.operators import graph, programs, valueflow
from quern.operators import program as P
from quern.sources import script_facts


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_sinks_branches_and_edges(spark):
    nodes = spark.createDataFrame([(1, "CallExpression", "chrome.tabs"), (2, "NewExpression", "Function"), (3, "Identifier", "eval"), (4, "CallExpression", "chrome.tabs.create")], "node int, type string, callee string")
    sinks = spark.createDataFrame([("CallExpression", "chrome.tabs", "TABS"), ("NewExpression", "Function", "NEW_FUNCTION")], "type string, callee string, sink_type string")
    assert _rows(P.sink_sites(nodes, sinks)) == [(1, "chrome.tabs", "TABS"), (2, "Function", "NEW_FUNCTION")]
    cases = [
        (("<", "number", "9", "number", "10"), True), (("<", "string", "9", "string", "10"), False), (("===", "string", "1", "string", "1.0"), False), (("===", "number", "1", "string", "1"), False), (("==", "number", "1", "string", "1"), True),
        ((">=", "number", "2", None, None), None), (("in", "string", "1", "string", "2"), None), (("!=", "string", "a", "string", "b"), True), ((">", "string", "b", "string", "a"), True), (("==", "null", "null", "undefined", "undefined"), True), (("==", "null", "null", "number", "0"), False),
    ]
    c = spark.createDataFrame([x for x, _ in cases], "op string, k string, a string, m string, b string").coalesce(1)
    assert [r[0] for r in c.select(P.compare(*(F.col(x) for x in ("op", "k", "a", "m", "b")))).collect()] == [x for _, x in cases]
    edges = spark.createDataFrame([(1, 2, "TRUE"), (1, 3, "FALSE"), (4, 5, "TRUE"), (4, 6, "FALSE"), (7, 8, "TRUE"), (7, 9, "FALSE")], "src int, dst int, kind string")
    guards = spark.createDataFrame([(1, True, False), (4, True, True), (7, False, False)], "src int, truth boolean, is_loop boolean")
    assert {r["dst"] for r in P.live_edges(edges, guards).collect()} == {2, 5, 6, 9}


def test_modules(spark):
    own = spark.createDataFrame([("a", "x", 1), ("a", "default", 2), ("b", "y", 3)], "module string, name string, def int")
    again = spark.createDataFrame([("b", "*", "a", "*"), ("c", "z", "b", "x")], "module string, name string, from_module string, from_name string")
    exports = P.export_bindings(own, again)
    assert _rows(exports) == [("a", "default", 2), ("a", "x", 1), ("b", "x", 1), ("b", "y", 3), ("c", "z", 1)]
    imports = spark.createDataFrame([("s", "q", "c", "z"), ("s", "all", "b", "*")], "script string, local string, module string, name string")
    assert _rows(P.import_bindings(imports, exports)) == [("s", "all", "x", 1), ("s", "all", "y", 3), ("s", "q", None, 1)]
    deps = P.dependencies(spark.createDataFrame([("s", "a"), ("s", "gone")], "script string, target string"), spark.createDataFrame([("a",)], "script string"))
    assert {(r["target"], r["found"]) for r in deps.collect()} == {("a", True), ("gone", False)}


def test_exports_pass_many_modules(spark):
    own = spark.createDataFrame([("m0", "x", 1)], "module string, name string, def int")
    again = spark.createDataFrame([(f"m{k + 1}", "*", f"m{k}", "*") for k in range(23)], "module string, name string, from_module string, from_name string")
    assert P.export_bindings(own, again.coalesce(1)).count() == 24


def test_frames_scopes_and_members(spark):
    frames = P.inherited_frames(spark.createDataFrame([("a", "CS_1")], "script string, frame string"), spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"))
    assert _rows(frames) == [("a", "CS_1"), ("b", "CS_1"), ("c", "CS_1")]
    uses = spark.createDataFrame([(1, 20, "x"), (2, 20, "nope")], "use int, scope int, name string")
    up = spark.createDataFrame([(20, 20, 0), (20, 10, 1), (20, 0, 2)], "scope int, ancestor int, depth int")
    defs = spark.createDataFrame([(0, "x", 100), (10, "x", 110)], "scope int, name string, def int")
    assert {r["use"]: r["def"] for r in P.scope_lookup(uses, up, defs).collect()} == {1: 110, 2: None}
    props = spark.createDataFrame([(1, "a", 11), (1, "b", 12)], "object int, name string, def int")
    reads = spark.createDataFrame([(50, 1, ["a"], True), (51, 1, [], False)], "read int, object int, names array<string>, known boolean")
    assert _rows(P.members(reads, props)) == [(50, 11, False), (51, 11, True), (51, 12, True)]
    taken = spark.createDataFrame([(60, 1, "a"), (61, 1, "z")], "read int, object int, name string")
    assert _rows(P.container_edges(taken, props)) == [(1, 61, "ELEMENT")]
    sinks = spark.createDataFrame([(7, 1), (8, 11)], "sink int, def int")
    assert _rows(P.structured_hits(sinks, spark.createDataFrame([("t", 11)], "taint string, def int"), props)) == [(7, "t", "a"), (8, "t", None)]
    assert P.never_reached(spark.createDataFrame([(1,), (2,)], "scope int"), spark.createDataFrame([(1,)], "scope int")).first()["scope"] == 2


def test_classes_and_keys(spark):
    classes = spark.createDataFrame([("C", "B"), ("B", "A"), ("A", None)], "class string, parent string")
    own = spark.createDataFrame([("A", "f", False, 1), ("B", "f", False, 2), ("A", "g", True, 3)], "class string, name string, is_static boolean, def int")
    got = {(r["class"], r["name"]): r["def"] for r in P.superclass_members(classes, own).collect()}
    assert got == {("A", "f"): 1, ("A", "g"): 3, ("B", "f"): 2, ("B", "g"): 3, ("C", "f"): 2, ("C", "g"): 3}
    args = spark.createDataFrame([(1, "literal", "k", None, None), (2, "array", None, ["a", "b"], None), (3, "object", None, None, ["d"]), (4, "none", None, None, None), (5, "unknown", None, None, None)], "get_id int, shape string, literal string, options array<string>, defaults array<string>")
    assert _rows(P.key_shapes(args)) == [(1, "k", False), (2, "a", False), (2, "b", False), (3, "d", False), (4, None, True), (5, None, False)]
    ids = spark.range(2).select(P.taint_id(F.lit("p"), F.lit("s"), F.lit("T"), F.lit(None).cast("string"), F.col("id").cast("string"))).distinct()
    assert ids.count() == 2


def _reach(edges, start):
    seen, work = set(), [start]
    while work:
        x = work.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                work.append(b)
    return seen


def test_order_with_cycles(spark):
    """A random graph: nodes that reach one another are one component, and every component comes after what it needs."""
    rng = random.Random(3)
    edges = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(38)} | {(40, 41), (41, 42), (42, 40), (42, 43), (44, 44), (45, 44)})
    nodes = [*range(31), *range(40, 46)]
    got = {r["node"]: r for r in graph.ordered(spark.createDataFrame(edges, "node long, dep long"), spark.createDataFrame([(n,) for n in nodes], "node long")).collect()}
    reach = {n: _reach(edges, n) for n in nodes}
    assert sorted(got) == nodes
    for n in nodes:
        own = {m for m in reach[n] if n in reach[m]} | {n}
        assert got[n]["component"] == min(own)
        needed = {d for a, d in edges if a in own and d not in own}
        assert got[n]["level"] == (1 + max(got[d]["level"] for d in needed) if needed else 0)


def test_taint_graph_keeps_all_ways(spark):
    """A diamond keeps its four edges, a loop on the way too; what doesn't lead to the sink, or isn't tainted, goes."""
    edges = [("s", "a"), ("s", "b"), ("a", "t"), ("b", "t"), ("b", "dead"), ("b", "b2"), ("b2", "b"), ("clean", "a")]
    e = spark.createDataFrame(edges, "src string, dst string")
    tainted = graph.propagate(spark.createDataFrame([("T", "s")], "taint string, def string"), e)
    got = graph.taint_graph(tainted, e, spark.createDataFrame([("T", "sink", "t")], "taint string, sink string, def string")).collect()
    assert {(r["src"], r["dst"]): r["depth"] for r in got} == {("s", "a"): 2, ("s", "b"): 2, ("a", "t"): 1, ("b", "t"): 1, ("b", "b2"): 1, ("b2", "b"): 2}
    assert {(r["taint"], r["sink"]) for r in got} == {("T", "sink")}


def test_summaries_of_functions(spark):
    """What a function does with a path of its parameter comes out at the call, through calls inside it and recursion."""
    p = lambda *x: list(x)
    edges = [("f.p", "f.m", p("url"), p(), False, "same"), ("f.m", "f.r", p(), p("out"), False, "same"), ("g.p", "g.a", p(), p(), False, "same"), ("g.c", "g.r", p("out"), p(), False, "same"), ("h.p", "h.a", p(), p(), False, "same"), ("h.c", "h.r", p(), p(), False, "same"), ("h.p", "h.r", p(), p(), True, "same")]
    sites = [("g.c", "f", "g.a", "f.p", p(), p(), False), ("x.c", "g", "x.a", "g.p", p(), p("url"), False), ("y.c", "g", "y.a", "g.p", p(), p("other"), False), ("h.c", "h", "h.a", "h.p", p(), p(), False), ("z.c", "h", "z.a", "h.p", p("k"), p(), False)]
    got = valueflow.summaries(
        spark.createDataFrame(edges, valueflow.EDGE), spark.createDataFrame([(f, f"{f}.p", f"{f}.p") for f in "fgh"], "function string, root string, def string"),
        spark.createDataFrame([(f, f"{f}.r") for f in "fgh"], "function string, def string"), spark.createDataFrame(sites, "call string, function string, src string, dst string, take array<string>, give array<string>, flat boolean"),
    )
    rows = {(r["src"], r["dst"], tuple(r["take"]), tuple(r["give"]), r["flat"]) for r in got.collect()}
    assert {("g.a", "g.c", ("url",), ("out",), False), ("x.a", "x.c", (), (), False), ("h.a", "h.c", (), (), True), ("z.a", "z.c", ("k",), (), True)} <= rows
    assert not any(r[0] == "y.a" for r in rows)


def test_cycles_that_hang_together(spark):
    """A ring, a ring that it leads to, and one that a later turn only finds, as the least node that reaches it is another ring's."""
    edges = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (5, 6), (6, 5), (7, 7)]
    got = graph.cycles(spark.createDataFrame(edges, "src long, dst long"))
    assert _rows(got) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7)]


def _broadcasts(df):
    return df._jdf.queryExecution().simpleString().count("Broadcast")


def test_levels_of_many_nodes_are_not_broadcast(spark):
    """What grows with the graph isn't broadcast beyond BROADCAST_ROWS, however small Spark takes it to be; a short table is."""
    many = spark.range(graph.BROADCAST_ROWS + 1).toDF("node")
    got = graph.topo_levels(many.select("node", (F.col("node") % 2).alias("dep")).filter("node > 1"), many)
    assert _broadcasts(got) == 0
    assert _rows(got.groupBy("level").count()) == [(0, 2), (1, graph.BROADCAST_ROWS - 1)]
    rows, n = graph._cut_large(spark.range(5))
    assert n == 5 and _broadcasts(many.join(rows, many["node"] == rows["id"])) > 0


def test_function_shapes_of_many_nodes_are_not_broadcast(spark, monkeypatch):
    """With more nodes than are broadcast, shapes are found by shuffles only: renamed copies are equal, another constant isn't."""
    code = [("p", "a", "function f(x) { return x + 1; }"), ("p", "b", "function g(y) { return y + 1; }"), ("p", "c", "function h(z) { return z + 2; }")]
    t = script_facts.tables(graph.table(script_facts.extract(spark.createDataFrame(code, "package string, script string, code string")), "fact"))
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    got = programs.function_shapes(t, graph._cut_large(programs.owners(t["node"]))[0])
    assert _broadcasts(got) == 0
    shape = {r["script"]: r["shape"] for r in got.collect()}
    assert shape["a"] == shape["b"] != shape["c"] and len(shape) == 3


def test_a_level_is_written_once(spark, monkeypatch):
    """A round of topo_levels writes one table, not two, and what waits for a later dependency gets its level then."""
    written, cut = [], graph._cut_large
    monkeypatch.setattr(graph, "_cut_large", lambda df: written.append(1) or cut(df))
    chain = [(k, k - 1) for k in range(1, 13)] + [(12, 0), (12, 5), (20, 21), (21, 20), (22, 20)]
    got = graph.topo_levels(spark.createDataFrame(chain, "node long, dep long"), spark.createDataFrame([(k,) for k in [*range(13), 20, 21, 22]], "node long"))
    assert sorted(_rows(got), key=repr) == sorted([(k, k) for k in range(13)] + [(20, None), (21, None), (22, None)], key=repr)
    assert len(written) <= 12 + 1 + 7
