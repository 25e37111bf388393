"""Joins over facts of programs: call sites, branches, modules, frames, scopes, members.

Facts are tables that a parser's rows fill; each operator names the columns that it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph


def taint_id(package: Column, script: Column, type_: Column, remark: Column, place: Column) -> Column:
    """A source's id, the same on every run."""
    return F.xxhash64(package, script, type_, F.coalesce(remark, F.lit("")), F.coalesce(place, F.lit("")))


def sink_sites(nodes: DataFrame, sinks: DataFrame) -> DataFrame:
    """nodes (node, type, callee), sinks (type, callee, sink_type): calls and constructions of what a rule names by one name, or by an object and a property; a rule's further segments aren't compared. The callee given is the rule's."""
    r = sinks.select("type", F.substring_index("callee", ".", 2).alias("called"), "callee", "sink_type")
    n = nodes.filter(F.col("type").isin("CallExpression", "NewExpression")).select(*(c for c in nodes.columns if c != "callee"), F.col("callee").alias("called"))
    return n.join(F.broadcast(r), ["type", "called"]).select("node", "callee", "sink_type")


def compare(op: Column, left_kind: Column, left: Column, right_kind: Column, right: Column) -> Column:
    """Truth of a comparison of two literals (string, number, boolean, null, undefined) by the language's rules; null where an operand's kind or the operator isn't known."""
    nothing = lambda k: k.isin("null", "undefined")
    read = lambda t: F.try_to_number(F.trim(t), F.lit("S999999999999.999999"))
    as_number = lambda k, t: F.when(k == "boolean", F.when(t == "true", 1).otherwise(0)).when(k == "null", 0).when((k == "string") & (F.trim(t) == ""), 0).when(k.isin("string", "number"), read(t))
    a, b, strings = as_number(left_kind, left), as_number(right_kind, right), (left_kind == "string") & (right_kind == "string")
    same_number = F.coalesce(a == b, F.lit(False))
    strict = (left_kind == right_kind) & F.when(left_kind == "number", same_number).otherwise(left == right)
    loose = F.when(nothing(left_kind) | nothing(right_kind), nothing(left_kind) & nothing(right_kind)).when(strings, left == right).otherwise(same_number)
    less, more = F.when(strings, left < right).otherwise(F.coalesce(a < b, F.lit(False))), F.when(strings, left > right).otherwise(F.coalesce(a > b, F.lit(False)))
    equal = F.when(strings, left == right).otherwise(same_number)
    known = left_kind.isNotNull() & right_kind.isNotNull()
    return F.when(known, F.when(op == "===", strict).when(op == "!==", ~strict).when(op == "==", loose).when(op == "!=", ~loose).when(op == "<", less).when(op == "<=", less | equal).when(op == ">", more).when(op == ">=", more | equal))


def live_edges(edges: DataFrame, guards: DataFrame) -> DataFrame:
    """edges (src, dst, kind), guards (src, truth, is_loop): without the false edge of a guard that is true (a loop's is kept) and the true edge of one that is false."""
    dead = guards.filter("(truth and not is_loop) or not truth").select("src", F.when(F.col("truth"), "FALSE").otherwise("TRUE").alias("kind"))
    return edges.join(dead, ["src", "kind"], "left_anti")


def live_cases(edges: DataFrame, cases: DataFrame) -> DataFrame:
    """edges (src, dst, kind), cases (src, dst, truth) of switches: without the cases whose literal can't be the subject's (an entry that another case shares stays), and without the default where a case surely is the one."""
    never = cases.groupBy("src", "dst").agg(F.bool_and(F.coalesce(~F.col("truth"), F.lit(False))).alias("never")).filter("never").select("src", "dst", F.lit("CASE").alias("kind"))
    sure = cases.filter("truth").select("src", F.lit("DEFAULT").alias("kind")).distinct()
    return edges.join(never, ["src", "dst", "kind"], "left_anti").join(sure, ["src", "kind"], "left_anti")


def broken_graphs(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """edges (graph, src, dst), entries (graph, entry, exit): what is wrong with graphs of control flow; empty if nothing is. An entry without a successor, an exit that has one or is never reached, and edges of graphs that aren't known."""
    leaves = edges.select("graph", F.col("src").alias("node")).distinct()
    arrives = edges.select("graph", F.col("dst").alias("node")).distinct()
    say = lambda df, what: df.select("graph", F.lit(what).alias("fault"))
    e, x = entries.select("graph", F.col("entry").alias("node")), entries.select("graph", F.col("exit").alias("node"))
    out = say(e.join(leaves, ["graph", "node"], "left_anti"), "entry without a successor").unionByName(say(x.join(leaves, ["graph", "node"], "left_semi"), "exit with a successor"))
    out = out.unionByName(say(x.join(arrives, ["graph", "node"], "left_anti"), "exit without a predecessor"))
    return out.unionByName(say(edges.select("graph").distinct().join(entries, "graph", "left_anti"), "graph without an entry"))


def key_shapes(args: DataFrame) -> DataFrame:
    """args (get_id, shape, literal, options, defaults): a row for each key that is asked for; a null key is one that isn't known. Shapes: literal, union, array, object, none (all keys), unknown."""
    none = F.array(F.lit(None).cast("string"))
    keys = F.when(F.col("shape") == "literal", F.array("literal")).when(F.col("shape").isin("union", "array"), F.col("options")).when(F.col("shape") == "object", F.col("defaults")).otherwise(none)
    keys = F.when(F.coalesce(F.size(keys), F.lit(0)) < 1, none).otherwise(keys)
    return args.select("get_id", F.explode(keys).alias("key"), (F.col("shape") == "none").alias("all_keys"))


def import_bindings(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """imports (script, local, module, name), exports (module, name, def): what a local name stands for. `*` is the whole module: its exports as properties."""
    one = imports.filter("name <> '*'").join(exports, ["module", "name"]).select("script", "local", F.lit(None).cast("string").alias("property"), "def")
    whole = imports.filter("name = '*'").drop("name").join(exports, "module").select("script", "local", F.col("name").alias("property"), "def")
    return one.unionByName(whole)


def export_bindings(own: DataFrame, again: DataFrame, max_depth: int | None = None) -> DataFrame:
    """own (module, name, def), again (module, name, from_module, from_name): exports with those that are passed on; a name `*` passes all but default. A module's own name wins."""
    found = new = graph._cut(own.select("module", "name", "def"))
    for k in graph.rounds(max_depth):
        n = new.select(F.col("module").alias("from_module"), F.col("name").alias("from_name"), "def")
        named = again.filter("name <> '*'").join(n, ["from_module", "from_name"]).select("module", "name", "def")
        star = again.filter("name = '*'").drop("name", "from_name").join(n.filter("from_name <> 'default'"), "from_module").select("module", F.col("from_name").alias("name"), "def")
        new = graph._cut(named.unionByName(star).distinct().join(found.select("module", "name"), ["module", "name"], "left_anti"))
        if not new.head(1):
            break
        found = found.unionByName(new)
        if k % 8 == 0:
            found = graph._cut(found)
    return found


def dependencies(imports: DataFrame, scripts: DataFrame) -> DataFrame:
    """imports (script, target), scripts (script): edges, with found = false for targets that no script has."""
    s = scripts.select(F.col("script").alias("target"), F.lit(True).alias("found")).distinct()
    return imports.select("script", "target").distinct().join(s, "target", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def inherited_frames(frames: DataFrame, references: DataFrame) -> DataFrame:
    """frames (script, frame), references (src, dst): a script has the frames of all that refer to it, at any distance."""
    got = graph.closure(references, frames.select(F.col("script").alias("root")).distinct())
    return got.join(frames.select(F.col("script").alias("root"), "frame"), "root").select(F.col("node").alias("script"), "frame").distinct()


def never_reached(scopes: DataFrame, analysed: DataFrame) -> DataFrame:
    """Scopes for a second pass, whose parameters carry nothing."""
    return scopes.join(analysed.select("scope").distinct(), "scope", "left_anti")


def scope_lookup(uses: DataFrame, ancestors: DataFrame, defs: DataFrame) -> DataFrame:
    """uses (use, scope, name), ancestors (scope, ancestor, depth; a scope itself at 0), defs (scope, name, def): the definition in the nearest scope, null if none."""
    d = defs.select(F.col("scope").alias("ancestor"), "name", "def")
    near = uses.join(ancestors, "scope").join(d, ["ancestor", "name"]).groupBy("use").agg(F.min_by("def", "depth").alias("def"))
    return uses.join(near, "use", "left")


def members(reads: DataFrame, props: DataFrame) -> DataFrame:
    """reads (read, object, names, known), props (object, name, def): the properties that a read can meet; all of them, and opaque, if the name isn't known."""
    named = reads.filter("known").select("read", "object", F.explode("names").alias("name")).join(props, ["object", "name"]).select("read", "def", F.lit(False).alias("opaque"))
    return named.unionByName(reads.filter("not known").select("read", "object").join(props.drop("name"), "object").select("read", "def", F.lit(True).alias("opaque")))


def container_edges(reads: DataFrame, props: DataFrame) -> DataFrame:
    """reads (read, object, name): edges object -> read where the object has no such property, so that what is in a container stays in what is taken out."""
    return reads.join(props.select("object", "name"), ["object", "name"], "left_anti").select(F.col("object").alias("src"), F.col("read").alias("dst"), F.lit("ELEMENT").alias("kind"))


def structured_hits(sinks: DataFrame, tainted: DataFrame, props: DataFrame) -> DataFrame:
    """sinks (sink, def), tainted (taint, def), props (object, name, def): a hit on the value itself, or else on each of its own properties."""
    direct = sinks.join(tainted, "def").select("sink", "taint", F.lit(None).cast("string").alias("name"))
    rest = sinks.join(direct.select("sink").distinct(), "sink", "left_anti").select("sink", F.col("def").alias("object"))
    return direct.unionByName(rest.join(props, "object").join(tainted, "def").select("sink", "taint", "name"))


def superclass_members(classes: DataFrame, own: DataFrame) -> DataFrame:
    """classes (class, parent), own (class, name, is_static, def): members with those of all superclasses, the nearest first."""
    up = graph.closure(classes.filter("parent is not null").select(F.col("class").alias("src"), F.col("parent").alias("dst")), classes.select(F.col("class").alias("root")).distinct())
    m = up.select(F.col("root").alias("c"), F.col("node").alias("class"), "depth").join(own, "class")
    return m.groupBy(F.col("c").alias("class"), "name", "is_static").agg(F.min_by("def", "depth").alias("def"))


def set_algebra(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sets of rows with the same columns: `and`, `minus` and `or` of them, with the operation in `op`."""
    out = a.intersect(b).withColumn("op", F.lit("and"))
    return out.unionByName(a.subtract(b).withColumn("op", F.lit("minus"))).unionByName(a.union(b).distinct().withColumn("op", F.lit("or")))
