"""Fixpoints over edge tables. Each round is checkpointed to the shared folder, joins only the new rows (semi-naive) and brings nothing but a count to the driver."""

from __future__ import annotations

import atexit
import functools
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SHARED = "quern.shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where none is named, a local one on a local master, and an error on a cluster, whose machines share no local folder."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or spark.conf.get(_SHARED, None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        atexit.register(shutil.rmtree, found[7:], True)
        spark.conf.set(_SHARED, found)
    return found


def _cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder; a lost executor costs a reread."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: As many rows of a written frame are broadcast at most.
BROADCAST_ROWS = 100_000


def _how(n: int) -> str:
    return "broadcast" if n <= BROADCAST_ROWS else "merge"


def _cut_large(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows as a table in the shared folder, and their number, by which they are broadcast to a join or not. Spark takes the size of a checkpoint from an estimate made before it ran (compressed files, a share of their columns), which can be many times too small, so that millions of rows would be collected on the driver. For frames that grow with the tables: the rows are made once (a checkpoint makes them twice), and read by columns."""
    at = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(at)
    rows = df.sparkSession.read.schema(df.schema).parquet(at)
    n = rows.count()
    return rows.hint(_how(n)), n


def apart(df: DataFrame, n: int) -> DataFrame:
    """The rows for joins in which n rows meet: by shuffle and sort where these are many, else as Spark likes."""
    return df.hint("merge") if n > BROADCAST_ROWS else df


def all_(parts: list[DataFrame]) -> DataFrame:
    """The rows of all frames."""
    return functools.reduce(DataFrame.unionByName, parts)


def table(df: DataFrame, by: str) -> DataFrame:
    """The rows as a table in the shared folder with a part for each value of a column, so that what asks for some values or columns reads these only. Costs more than a checkpoint for small data, less for wide rows that are read often."""
    at = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at).select(*df.columns)


def rounds(most: int | None) -> Iterator[int]:
    """1, 2, ...: the rounds of a fixpoint, which ends by itself when a round finds no new row. With a bound, an error where rows are still found beyond it: never a part of the result."""
    for k in itertools.count(1):
        if most is not None and k > most + 1:
            raise RuntimeError(f"no fixpoint after {most} rounds")
        yield k


def closure(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """edges (src, dst), roots (root) -> (root, node, depth): the least number of steps; roots themselves at 0."""
    edges = _cut(edges.select("src", "dst").distinct())
    new = _cut(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    seen = new
    for depth in rounds(max_depth):
        step = new.join(edges, new.node == edges.src).select("root", F.col("dst").alias("node")).distinct()
        new = _cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not new.head(1):
            break
        seen = seen.unionByName(new)
        if depth % 8 == 0:
            seen = _cut(seen)
    return seen


def propagate(sources: DataFrame, edges: DataFrame, sanitized: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """sources (taint, def), edges (src, dst, kind) -> (taint, def, depth, kind): the least number of steps, and the kind of the edge that brought the taint first (the least in order at ties; null at a source). A taint stops at (taint, def) rows of sanitized; a def there with a null taint stops all."""
    stop_one = sanitized.filter("taint is not null") if sanitized is not None else None
    stop_all = sanitized.filter("taint is null").select("def").distinct() if sanitized is not None else None

    def held(df: DataFrame) -> DataFrame:
        if sanitized is None:
            return df
        return df.join(stop_one, ["taint", "def"], "left_anti").join(stop_all, "def", "left_anti")

    kind = F.col("kind") if "kind" in edges.columns else F.lit(None).cast("string").alias("kind")
    edges = _cut(edges.groupBy("src", "dst").agg(F.min(kind).alias("kind")))
    new = _cut(held(sources.select("taint", "def").distinct()).select("taint", "def", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("kind")))
    seen = new
    for depth in rounds(max_depth):
        step = new.drop("kind").join(edges, new["def"] == edges.src).groupBy("taint", F.col("dst").alias("def")).agg(F.min("kind").alias("kind"))
        new = _cut(held(step).join(seen.select("taint", "def"), ["taint", "def"], "left_anti").select("taint", "def", F.lit(depth).alias("depth"), "kind"))
        if not new.head(1):
            break
        seen = seen.unionByName(new)
        if depth % 8 == 0:
            seen = _cut(seen)
    return seen


def check_sinks(tainted: DataFrame, sinks: DataFrame) -> DataFrame:
    """tainted (taint, def), sinks (sink, sink_type, def): a record for each taint on a sink's value."""
    return tainted.select("taint", "def").join(sinks, "def").select("taint", "sink", "sink_type", "def").distinct()


def topo_levels(edges: DataFrame, nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """edges (node, dep), nodes (node) -> (node, level): 0 without dependencies, else 1 + the deps' largest. Nodes on cycles, and those that need them, have a null level (`ordered` gives them one).

    A node is done in the round in which its last dependency is: a round joins the edges of the newly done only, adds up how many dependencies of the nodes that they meet are done by now, and is written once: what is done, and what waits for more."""
    edges, _ = _cut_large(edges.select("node", "dep").distinct())
    nodes, _ = _cut_large(nodes.select("node").distinct())
    needs, _ = _cut_large(edges.groupBy("node").agg(F.count("*").alias("needs")))
    new, n = _cut_large(nodes.join(needs, "node", "left_anti").withColumn("level", F.lit(0)))
    # an edge carries the number of its node's edges, so that rounds join nothing else
    edges, _ = _cut_large(edges.join(needs, "node").join(nodes, "node", "left_semi"))
    done, waits, waiting = [new], [], 0
    for level in rounds(max_depth):
        met = edges.join(new.select(F.col("node").alias("dep")).hint(_how(n)), "dep").groupBy("node").agg(F.count("*").alias("n"), F.first("needs").alias("needs"))
        got = F.col("n")
        if waits:
            met = met.join(all_(waits).groupBy("node").agg(F.sum("n").alias("before")).hint(_how(waiting)), "node", "left")
            got = got + F.coalesce("before", F.lit(0))
        rows, all_n = _cut_large(met.select("node", "n", (got == F.col("needs")).alias("ready"), F.lit(level).alias("level")))
        new = rows.filter("ready").select("node", "level")
        n = new.count() if all_n else 0
        if not n:
            break
        done = [*done, new]
        if n < all_n:
            waits, waiting = [*waits, rows.filter("not ready").select("node", "n")], waiting + all_n - n
        if level % 8 == 0:
            done = [_cut_large(all_(done))[0]]
            if waits:
                rows, waiting = _cut_large(all_(waits).groupBy("node").agg(F.sum("n").alias("n")).join(all_(done).hint("merge"), "node", "left_anti"))
                waits = [rows]
    return nodes.join(all_(done).hint("merge"), "node", "left")


def cycles(edges: DataFrame) -> DataFrame:
    """edges (src, dst), each node of which has edges in and out -> (node, component): the least node of the set of nodes that reach one another.

    Each node takes the least node that reaches it as its colour; what reaches a colour's own node inside the colour is that node's set. Sets are taken out, edges between colours dropped, and the rest coloured anew; each turn takes out at least one set of every part that hangs together."""
    left, _ = _cut_large(edges.select("src", "dst").distinct())
    nodes, n = _cut_large(left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct())
    found = []
    while n:
        # colours: a round joins the nodes whose colour fell
        colour = new = nodes.withColumn("colour", F.col("node"))
        for _k in rounds(None):
            step = new.withColumnRenamed("node", "src").join(left, "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("lower"))
            rows, _ = _cut_large(colour.join(step, "node", "left").select("node", F.least("colour", "lower").alias("colour"), F.coalesce(F.col("lower") < F.col("colour"), F.lit(False)).alias("fell")))
            colour, new = rows.select("node", "colour"), rows.filter("fell").select("node", "colour")
            fell = new.count()
            if not fell:
                break
            new = new.hint(_how(fell))
        inside, _ = _cut_large(left.join(colour.toDF("src", "c1"), "src").join(colour.toDF("dst", "c2"), "dst").filter("c1 = c2").select("src", "dst", F.col("c1").alias("colour")))
        own = new = _cut_large(colour.filter("node = colour"))[0]
        for k in rounds(None):
            step = new.withColumnRenamed("node", "dst").join(inside, ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            new, more = _cut_large(step.join(own, ["node", "colour"], "left_anti"))
            if not more:
                break
            own = own.unionByName(new)
            if k % 8 == 0:
                own, _ = _cut_large(own)
        got, _ = _cut_large(own.select("node", F.col("colour").alias("component")))
        found = [*found, got]
        nodes, n = _cut_large(nodes.join(got, "node", "left_anti"))
        if n:
            left, _ = _cut_large(inside.select("src", "dst").join(nodes.toDF("src"), "src", "left_semi").join(nodes.toDF("dst"), "dst", "left_semi"))
    return all_(found) if found else nodes.withColumn("component", F.col("node"))


def ordered(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (node, dep), nodes (node) -> (node, component, level): an order for all nodes, cycles included. Nodes that need one another are one component, named by its least node; its level is 0 if it needs no other, else 1 + the largest of those it needs. Inside a component nodes are in their own order."""
    nodes, _ = _cut_large(nodes.select("node").distinct())
    edges, _ = _cut_large(edges.select("node", "dep").distinct().join(nodes, "node", "left_semi").join(nodes.toDF("dep"), "dep", "left_semi"))
    levels, _ = _cut_large(topo_levels(edges, nodes))
    stuck, n = _cut_large(levels.filter("level is null").select("node"))
    if not n:
        return levels.select("node", F.col("node").alias("component"), "level")
    # of what waits for a cycle, what no cycle waits for isn't on one
    tied = edges.join(stuck, "node", "left_semi").join(stuck.toDF("dep"), "dep", "left_semi")
    back = topo_levels(tied.select(F.col("dep").alias("node"), F.col("node").alias("dep")), stuck)
    core, _ = _cut_large(back.filter("level is null").select("node"))
    among = tied.join(core, "node", "left_semi").join(core.toDF("dep"), "dep", "left_semi").select(F.col("node").alias("src"), F.col("dep").alias("dst"))
    named, _ = _cut_large(nodes.join(cycles(among), "node", "left").withColumn("component", F.coalesce("component", "node")))
    between_ = edges.join(named, "node").join(named.toDF("dep", "needed"), "dep").filter("component <> needed").select(F.col("component").alias("node"), F.col("needed").alias("dep"))
    return named.join(topo_levels(between_, named.select(F.col("component").alias("node"))).withColumnRenamed("node", "component"), "component").select("node", "component", "level")


def taint_graph(tainted: DataFrame, edges: DataFrame, hits: DataFrame) -> DataFrame:
    """tainted (taint, def: all that propagate found), edges (src, dst), hits (taint, sink, def) -> (taint, sink, src, dst, depth): every edge on any way of a taint to a sink that it reaches, with the least number of steps from the edge's start to the sink. Backward reach from the sink inside what the taint reached."""
    edges, tainted = _cut(edges.select("src", "dst").distinct()), _cut(tainted.select("taint", "def").distinct())
    seen = new = _cut(hits.select("taint", "sink", "def", F.lit(0).alias("depth")).distinct())
    for depth in rounds(None):
        step = new.join(edges, new["def"] == edges["dst"]).select("taint", "sink", F.col("src").alias("def")).distinct().join(tainted, ["taint", "def"], "left_semi")
        new = _cut(step.join(seen, ["taint", "sink", "def"], "left_anti").select("taint", "sink", "def", F.lit(depth).alias("depth")))
        if not new.head(1):
            break
        seen = seen.unionByName(new)
        if depth % 8 == 0:
            seen = _cut(seen)
    seen = _cut(seen)
    ends = seen.select("taint", "sink", F.col("def").alias("dst"))
    starts = seen.select("taint", "sink", F.col("def").alias("src"), "depth")
    return ends.join(edges, "dst").join(starts, ["taint", "sink", "src"]).select("taint", "sink", "src", "dst", "depth")


def paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_depth: int | None = None) -> DataFrame:
    """edges (src, dst), starts (node), ends (node) -> (start, end, path): of each pair the shortest path, the least in order at ties. The frontier keeps one path for each pair of nodes."""
    edges = _cut(edges.select("src", "dst").distinct())
    new = _cut(starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path")).distinct())
    seen = new
    for depth in rounds(max_depth):
        step = new.join(edges, new["at"] == edges.src).groupBy("start", F.col("dst").alias("at")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        new = _cut(step.join(seen.select("start", "at"), ["start", "at"], "left_anti"))
        if not new.head(1):
            break
        seen = seen.unionByName(new)
        if depth % 8 == 0:
            seen = _cut(seen)
    return seen.join(ends.select(F.col("node").alias("at")).distinct(), "at", "left_semi").select("start", F.col("at").alias("end"), "path")
