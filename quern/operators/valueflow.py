"""Taint over access paths, along calls that return to where they were called from.

A fact says that a taint is at a path below a value: ["url"] below a message is its property `url`, the empty path the whole value. An edge rewrites paths: what lies at or below `take` of its source lies, less that prefix, below `give` of its target (`flat` drops what is left of the path). A taint of the whole is a taint of every part; `*` stands for a name that isn't known. Paths are cut to DEPTH names, a cut path standing for all below it, so there are finitely many facts and every fixpoint ends, recursion included.

Edges compose, so what a function does with a parameter is an edge too: from the parameter, over edges inside the function, to what it returns. Such summaries are found once for each function and put at each of its calls as one more edge, until there are no new ones. Taint then runs in two phases: up, where it may return from the function that it began in to any call of that function, and, after it went down into a callee by an argument, no more; what a callee does with its caller's values comes back by summaries alone. So a value given to a function at one call never comes out of another. Values that leave a function otherwise (captured variables, stored values, messages) may go on as at the start.

Steps of edges: same, call, return, heap. All joins are equi joins on values; each round joins the new facts only and is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

DEPTH = 4
EDGE = "src string, dst string, take array<string>, give array<string>, flat boolean, step string"


def path(*names: str | Column) -> Column:
    """A path of names."""
    return F.array(*(F.lit(n) if isinstance(n, str) else n for n in names)).cast("array<string>")


def fits(x: Column, y: Column) -> Column:
    """Whether the shorter of two paths is a prefix of the longer."""
    n = F.least(F.size(x), F.size(y))
    return F.forall(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda a, b: (a == b) | (a == "*") | (b == "*")), lambda ok: ok)


def after(take: Column, give: Column, flat: Column, take2: Column, give2: Column, flat2: Column) -> dict[str, Column]:
    """Two rewritings as one, where they fit: the first's target is the second's source."""
    cut = lambda c: F.slice(c, 1, DEPTH)
    below = F.slice(take2, F.size(give) + 1, DEPTH)  # what the second wants below what the first gives
    rest = F.slice(give, F.size(take2) + 1, DEPTH)
    return {"take": F.when(flat, take).otherwise(cut(F.concat(take, below))), "give": cut(F.when(flat2, give2).otherwise(F.concat(give2, rest))), "flat": flat | flat2}


def _rounds(new: DataFrame, seen: DataFrame | None, advance, keys: list[str], better=None) -> DataFrame:
    """All facts that `advance` finds from new ones on; `better`, if any, compares the rest of a fact with one that was seen."""
    seen = new if seen is None else seen
    for k in graph.rounds(None):
        old = seen.select(*(F.col(c).alias(f"{c}_old") for c in seen.columns))
        same = [F.col(c) == F.col(f"{c}_old") for c in keys]
        step = advance(new)
        new = graph._cut(step.join(old, [*same, better] if better is not None else same, "left_anti").select(*seen.columns))
        if not new.head(1):
            return seen
        seen = seen.unionByName(new)
        if k % 4 == 0:
            seen = graph._cut(seen)


def summaries(edges: DataFrame, parameters: DataFrame, returned: DataFrame, sites: DataFrame) -> DataFrame:
    """edges (EDGE), parameters (function, def), returned (function, def), sites (call, function, src, dst, take, give, flat: an argument's way into a parameter) -> edges from arguments to calls, by what the functions do with them."""
    inner = graph._cut(edges.filter("step = 'same'").select("src", "dst", "take", "give", "flat"))
    sites = graph._cut(sites.select("call", "function", "src", "dst", "take", "give", "flat"))
    keys = ["root", "def", "take", "give", "flat"]
    start = graph._cut(parameters.select(F.col("root"), "def", path().alias("take"), path().alias("give"), F.lit(False).alias("flat")).distinct())
    ends = graph._cut(returned.select("function", F.col("def").alias("end")))
    owner = parameters.select("root", "function").distinct()

    def along(facts: DataFrame, way: DataFrame) -> DataFrame:
        e = way.select("src", "dst", F.col("take").alias("t2"), F.col("give").alias("g2"), F.col("flat").alias("f2"))
        j = facts.join(e, facts["def"] == e["src"]).filter(fits(F.col("give"), F.col("t2")))
        new = after(F.col("take"), F.col("give"), F.col("flat"), F.col("t2"), F.col("g2"), F.col("f2"))
        return j.select("root", F.col("dst").alias("def"), *(c.alias(n) for n, c in new.items())).distinct()

    known, seen, new = None, None, start
    for _ in graph.rounds(None):
        way = inner if known is None else graph._cut(inner.unionByName(known))
        seen = graph._cut(_rounds(new, seen, lambda facts, way=way: along(facts, way), keys))
        done = seen.join(owner, "root").join(ends, "function").filter(F.col("def") == F.col("end")).select("root", "function", F.col("take").alias("t2"), F.col("give").alias("g2"), F.col("flat").alias("f2")).distinct()
        at = sites.join(done, (sites["dst"] == done["root"]) & (sites["function"] == done["function"])).filter(fits(F.col("give"), F.col("t2")))
        made = at.select("src", F.col("call").alias("dst"), *(c.alias(n) for n, c in after(F.col("take"), F.col("give"), F.col("flat"), F.col("t2"), F.col("g2"), F.col("f2")).items())).distinct()
        more = graph._cut(made if known is None else made.join(known, ["src", "dst", "take", "give", "flat"], "left_anti"))
        if not more.head(1):
            break
        known = more if known is None else graph._cut(known.unionByName(more))
        # what was seen meets the new edges; what that finds goes on
        new = graph._cut(along(seen, more).join(seen, keys, "left_anti"))
        seen = graph._cut(seen.unionByName(new))
    out = known if known is not None else inner.limit(0)
    return out.withColumn("step", F.lit("same"))


def propagate(start: DataFrame, edges: DataFrame) -> DataFrame:
    """start (taint, def, path), edges (EDGE, summaries included) -> (taint, def, path, down): down is 0 where the taint may still return to callers."""
    edges = graph._cut(edges.distinct())
    new = graph._cut(start.select("taint", "def", "path", F.lit(0).alias("down")).distinct())

    def advance(facts: DataFrame) -> DataFrame:
        j = facts.join(edges, facts["def"] == edges["src"]).filter(fits(F.col("path"), F.col("take")) & ~((F.col("step") == "return") & (F.col("down") == 1)))
        none, no = path(), F.lit(False)
        down = F.when(F.col("step") == "call", 1).when(F.col("step") == "heap", 0).otherwise(F.col("down"))
        return j.select("taint", F.col("dst").alias("def"), after(none, F.col("path"), no, F.col("take"), F.col("give"), F.col("flat"))["give"].alias("path"), down.alias("down")).groupBy("taint", "def", "path").agg(F.min("down").alias("down"))

    return _rounds(new, None, advance, ["taint", "def", "path"], F.col("down_old") <= F.col("down"))


def enclosing(points: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, point, start, stop), ranges (keys, range, start, stop) that are nested or apart -> points with the innermost range that holds them (itself not counted), null if none. One sweep over starts and stops: the range that was opened last at a point's depth; no join, so many ranges and points of one key make no product."""
    at = lambda pos, order, step, id_: [F.col(c) for c in keys] + [pos.alias("pos"), order.alias("order"), F.lit(step).alias("step"), id_]
    opens = ranges.select(*at(F.col("start"), -F.col("stop"), 1, F.col("range")), F.lit(None).cast("long").alias("point"))
    closes = ranges.select(*at(F.col("stop"), F.lit(-1 << 62), -1, F.lit(None).cast("long").alias("range")), F.lit(None).cast("long").alias("point"))
    asked = points.select(*at(F.col("start"), -F.col("stop"), 0, F.lit(None).cast("long").alias("range")), F.col("point"))
    # at one place ranges that stop come first, then the wider before the narrower; a point comes before a range that is just as wide, which may be itself
    order = [F.col("pos"), F.col("order"), F.col("step")]
    swept = opens.unionByName(closes).unionByName(asked).withColumn("depth", F.sum("step").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    last = Window.partitionBy(*keys, "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return swept.withColumn("inner", F.when(F.col("depth") > 0, F.last("range", ignorenulls=True).over(last))).filter("point is not null").select(*keys, "point", F.col("inner").alias("range"))
