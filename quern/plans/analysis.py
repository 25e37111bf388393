"""Queries for the operators of whole analyses (paths, sweeps, orders, graphs of a taint), on the synthetic tables, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, programs, valueflow
from ..operators.valueflow import path
from ..sources import script_facts
from .demo import _t, query

# A part is a value; it flows into the parts 2k and 2k + 1. What an edge does to paths hangs on the part's size, what kind of step it is on its key.
_STEPS = "CASE k % 7 WHEN 0 THEN 'call' WHEN 1 THEN 'return' WHEN 2 THEN 'heap' ELSE 'same' END"
_VALUES_SQL = f"""nodes AS (SELECT p_partkey AS k, p_size AS z FROM part WHERE p_partkey > 0),
edges AS (SELECT a.k AS src, b.k AS dst, CASE WHEN a.z % 4 = 1 THEN ['a'] WHEN a.z % 4 = 3 THEN ['*'] ELSE CAST([] AS VARCHAR[]) END AS take, CASE WHEN a.z % 4 = 0 THEN ['a'] WHEN a.z % 4 = 2 THEN ['b'] ELSE CAST([] AS VARCHAR[]) END AS give, {_STEPS.replace("k %", "a.k %")} AS step, a.z % 11 = 0 AS flat
 FROM nodes a JOIN nodes b ON b.k // 2 = a.k)"""


def _values(spark, sf_dir):
    n = _t(spark, sf_dir, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    z, m = F.col("z") % 4, F.col("k") % 7
    take = F.when(z == 1, path("a")).when(z == 3, path("*")).otherwise(path())
    give = F.when(z == 0, path("a")).when(z == 2, path("b")).otherwise(path())
    step = F.when(m == 0, "call").when(m == 1, "return").when(m == 2, "heap").otherwise("same")
    to = n.select(F.col("k").alias("dst"), F.expr("k div 2").alias("k"))
    return n.join(to, "k").select(F.col("k").alias("src"), "dst", take.alias("take"), give.alias("give"), (F.col("z") % 11 == 0).alias("flat"), step.alias("step"))


@query(f"""WITH RECURSIVE {_VALUES_SQL}, t(taint, def, path, down) AS (SELECT k, k, CAST([] AS VARCHAR[]), 0 FROM nodes
UNION SELECT taint, dst, list_slice(CASE WHEN flat THEN give ELSE list_concat(give, list_slice(path, len(take) + 1, 99)) END, 1, 4), CASE step WHEN 'call' THEN 1 WHEN 'heap' THEN 0 ELSE down END
 FROM t JOIN edges ON def = src WHERE (len(take) = 0 OR len(path) = 0 OR take[1] = path[1] OR take[1] = '*') AND NOT (step = 'return' AND down = 1))
SELECT taint, def, array_to_string(path, '.') AS path, CAST(min(down) AS INT) AS down FROM t GROUP BY taint, def, path""")
def q_field_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part taints itself; taint over paths and matched calls to its fixpoint (J3, T8, I7)."""
    edges = _values(spark, sf_dir)
    start = _t(spark, sf_dir, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("taint"), F.col("p_partkey").alias("def"), path().alias("path"))
    got = valueflow.propagate(start, edges)
    return got.groupBy("taint", "def", F.array_join("path", ".").alias("path")).agg(F.min("down").alias("down"))


# Nested ranges: a part k of the j-th level of a binary tree has 1 / 2^j of the line.
_TREE_SQL = "tree AS (SELECT p_partkey AS range, p_size AS key, (p_partkey - (1 << CAST(floor(log2(p_partkey)) AS INT))) * (1 << (20 - CAST(floor(log2(p_partkey)) AS INT))) AS start, 1 << (20 - CAST(floor(log2(p_partkey)) AS INT)) AS width FROM part WHERE p_partkey > 0)"


@query(f"""WITH {_TREE_SQL}, points AS (SELECT p_partkey AS point, p_size AS key, (p_partkey * 7919) % 1048576 AS pos FROM part)
SELECT point, arg_min(range, width) AS range FROM points LEFT JOIN tree ON points.key = tree.key AND pos >= start AND pos + 1 <= start + width AND width > 1 GROUP BY point""")
def q_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost range of the same size that holds a point, by a sweep (J13)."""
    p = _t(spark, sf_dir, "part")
    level = F.floor(F.log2("p_partkey")).cast("int")
    width = F.expr("shiftleft(1L, 20 - CAST(floor(log2(p_partkey)) AS INT))")
    ranges = p.filter("p_partkey > 0").select(F.col("p_size").alias("key"), F.col("p_partkey").alias("range"), ((F.col("p_partkey") - F.pow(F.lit(2), level).cast("long")) * width).alias("start"), width.alias("width")).filter("width > 1")
    at = (F.col("p_partkey") * 7919) % 1048576
    points = p.select(F.col("p_size").alias("key"), F.col("p_partkey").alias("point"), at.alias("start"), (at + 1).alias("stop"))
    return valueflow.enclosing(points, ranges.select("key", "range", "start", (F.col("start") + F.col("width")).alias("stop")), ["key"]).select("point", "range")


# A part needs the part k / 2; parts of a size that ten divides are also needed by it, so that they make cycles.
@query("""WITH RECURSIVE nodes AS (SELECT p_partkey AS k, p_size % 10 = 0 AS tied FROM part WHERE p_partkey > 0),
t(node, here, component, level) AS (SELECT k, k, k, 0 FROM nodes UNION ALL
 SELECT node, here // 2, CASE WHEN tied AND component = here THEN here // 2 ELSE component END, CASE WHEN tied THEN level ELSE level + 1 END FROM t JOIN nodes ON here = k WHERE here > 1)
SELECT node, component, CAST(level AS INT) AS level FROM t WHERE here = 1""")
def q_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order of all parts, cycles as one (I3)."""
    p = _t(spark, sf_dir, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("z"))
    up = p.filter("node > 1").select("node", F.expr("node div 2").alias("dep"), "z")
    return graph.ordered(up.select("node", "dep").unionByName(up.filter("z % 10 = 0").select(F.col("dep").alias("node"), F.col("node").alias("dep"))), p.select("node"))


_DIAMOND_SQL = "edges AS (SELECT b.p_partkey // 2 AS src, b.p_partkey AS dst FROM part b WHERE b.p_partkey > 1 UNION SELECT b.p_partkey // 2 + 1, b.p_partkey FROM part b WHERE b.p_partkey > 1 AND (b.p_partkey // 2) % 2 = 0)"


@query(f"""WITH RECURSIVE {_DIAMOND_SQL}, fwd(taint, def) AS (SELECT p_partkey, p_partkey FROM part WHERE p_size = 1 AND p_partkey > 0 UNION SELECT taint, dst FROM fwd JOIN edges ON def = src),
back(taint, sink, def, depth) AS (SELECT taint, p_partkey, p_partkey, 0 FROM fwd JOIN part ON def = p_partkey AND p_type = 'ECONOMY' UNION SELECT b.taint, b.sink, e.src, b.depth + 1 FROM back b JOIN edges e ON b.def = e.dst JOIN fwd f ON f.taint = b.taint AND f.def = e.src),
near AS (SELECT taint, sink, def, min(depth) AS depth FROM back GROUP BY ALL)
SELECT s.taint, s.sink, e.src, e.dst, CAST(s.depth AS INT) AS depth FROM near s JOIN edges e ON e.src = s.def JOIN near d ON d.taint = s.taint AND d.sink = s.sink AND d.def = e.dst""")
def q_taint_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges on the ways of taints (parts of size 1) to sinks (parts of one type), where ways part and meet again (I24)."""
    p = _t(spark, sf_dir, "part").filter("p_partkey > 0")
    own = p.filter("p_partkey > 1").select(F.expr("p_partkey div 2").alias("src"), F.col("p_partkey").alias("dst"))
    edges = own.unionByName(own.filter("src % 2 = 0").select((F.col("src") + 1).alias("src"), "dst")).distinct()
    tainted = graph.propagate(p.filter("p_size = 1").select(F.col("p_partkey").alias("taint"), F.col("p_partkey").alias("def")), edges)
    hits = tainted.join(p.filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("def")), "def").select("taint", F.col("def").alias("sink"), "def")
    return graph.taint_graph(tainted, edges, hits)


@query("SELECT 8 AS size, count(*) AS functions FROM part GROUP BY p_size")
def q_function_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many functions have each shape (I19): a part is a script with a function, whose own name, parameter and place are the part's, and whose constant is its size."""
    name = F.concat(F.lit("n"), F.col("p_partkey").cast("string"))
    code = F.concat(F.lit("/* "), F.col("p_name"), F.lit(" */ function "), name, F.lit("("), F.lower(F.regexp_replace("p_type", "[^A-Za-z]", "")), F.lit(") { return "), F.lower(F.regexp_replace("p_type", "[^A-Za-z]", "")), F.lit(" + "), F.col("p_size").cast("string"), F.lit("; }"))
    # a row group of short rows is very many scripts: they are dealt out before they are parsed
    scripts = _t(spark, sf_dir, "part").select(F.lit("p").alias("package"), name.alias("script"), code.alias("code")).repartition(4 * spark.sparkContext.defaultParallelism, "script")
    t = script_facts.tables(graph.table(script_facts.extract(scripts), "fact"))
    return programs.function_shapes(t, graph._cut_large(programs.owners(t["node"]))[0]).groupBy("shape", "size").agg(F.count("*").alias("functions")).select("size", "functions")
