"""From the tables of facts of scripts to the edges, calls and places that `valueflow` runs over.

Values are named by package, script and number (`value_id`) wherever scripts meet; inside a script, rows are joined by (package, script, number)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bridges, graph, program
from .valueflow import enclosing, path

KEY = ["package", "script"]
FUNCTIONS = ("FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression")
CHAIN = 3


def value_id(column: str | Column) -> Column:
    """A value's name over all packages and scripts."""
    return F.concat_ws(":", "package", "script", (F.col(column) if isinstance(column, str) else column).cast("string"))


def owners(nodes: DataFrame) -> DataFrame:
    """(package, script, node, owner): the function that a node is in, the program's number (0) outside of functions."""
    functions = nodes.filter(F.col("type").isin(*FUNCTIONS)).select(*KEY, F.col("node").alias("range"), "start", "stop")
    return enclosing(nodes.select(*KEY, F.col("node").alias("point"), "start", "stop"), functions, KEY).select(*KEY, F.col("point").alias("node"), F.coalesce("range", F.lit(0)).alias("owner"))


def dead(nodes: DataFrame, branches: DataFrame) -> DataFrame:
    """(package, script, node): nodes that never run, as a test before them has a known truth. Such a branch is a whole subtree, so its nodes are those that lie inside."""
    test = nodes.select(*KEY, "node", F.col("parent").alias("whole"), F.col("field").alias("at"))
    decided = branches.filter("truth <> 'UNKNOWN'").select(*KEY, "node", "truth").join(test, [*KEY, "node"]).filter("at = 'test'")
    sides = nodes.select(*KEY, F.col("parent").alias("whole"), "field", "start", "stop", F.col("node").alias("range"))
    never = F.when(F.col("truth") == "FALSE", F.col("field").isin("consequent", "body")).otherwise(F.col("field") == "alternate")
    # the body of a do-while runs before its test
    runs_first = nodes.filter("type = 'DoWhileStatement'").select(*KEY, F.col("node").alias("whole"))
    ranges = decided.select(*KEY, "whole", "truth").join(sides, [*KEY, "whole"]).filter(never).join(runs_first, [*KEY, "whole"], "left_anti").select(*KEY, "range", "start", "stop")
    some = nodes.join(ranges.select(*KEY).distinct(), KEY, "left_semi")
    return enclosing(some.select(*KEY, F.col("node").alias("point"), "start", "stop"), ranges, KEY).filter("range is not null").select(*KEY, F.col("point").alias("node"))


def member_names(nodes: DataFrame) -> DataFrame:
    """(package, script, node, object, name): member expressions, what they are members of, and the property's name, `*` where it is computed from what isn't a literal."""
    m = nodes.filter("type = 'MemberExpression'").select(*KEY, "node", F.col("stop").alias("m_stop"))
    child = nodes.select(*KEY, F.col("parent").alias("node"), "field", F.col("node").alias("child"), "type", "text", "stop")
    named = (F.col("p.type") == "Literal") | ((F.col("p.type") == "Identifier") & (F.col("p.stop") == F.col("m_stop")))  # a computed one ends before its bracket
    o, p = child.filter("field = 'object'").select(*KEY, "node", F.col("child").alias("object")), child.filter("field = 'property'").alias("p")
    return m.join(o, [*KEY, "node"]).join(p, [*KEY, "node"]).select(*KEY, "node", "object", F.when(named, F.coalesce("p.text", F.lit("*"))).otherwise("*").alias("name"))


def written_paths(members: DataFrame, uses: DataFrame) -> DataFrame:
    """(package, script, member, base, give): the values that hold what is written to a member, with the path below them: its object, that one's object and so on, and the names that they read."""
    up = members.select(*KEY, F.col("node").alias("member"), F.col("object").alias("base"), path(F.col("name")).alias("give"))
    out, next_ = up, members.select(*KEY, F.col("node").alias("base"), F.col("object").alias("further"), F.col("name").alias("next"))
    for _ in range(CHAIN - 1):
        up = up.join(next_, [*KEY, "base"]).select(*KEY, "member", F.col("further").alias("base"), F.concat(F.array("next"), F.col("give")).alias("give"))
        out = out.unionByName(up)
    names = uses.select(*KEY, F.col("use").alias("base"), "def")
    return out.unionByName(out.join(names, [*KEY, "base"]).select(*KEY, "member", F.col("def").alias("base"), "give"))


def with_patterns(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with parameters that are patterns: the pattern's node is the parameter's value."""
    roots = t["node"].filter("field = 'params' and type in ('ObjectPattern', 'ArrayPattern')")
    return t | {"param": t["param"].unionByName(roots.select(*KEY, F.col("parent").alias("function"), F.col("node").alias("def"), "ord", F.lit(None).cast("string").alias("name")))}


def pattern_edges(nodes: DataFrame) -> DataFrame:
    """(package, script, src, dst, take): what patterns take out of the value that they stand for, pattern by pattern."""
    part = nodes.select(*KEY, F.col("parent").alias("src"), F.col("node").alias("part"), "type", "field")
    patterns = nodes.filter("type in ('ObjectPattern', 'ArrayPattern')").select(*KEY, F.col("node").alias("src"))
    inner = part.join(patterns, [*KEY, "src"]).filter("field in ('properties', 'elements')")
    child = lambda field: nodes.filter(F.col("field") == field).select(*KEY, F.col("parent").alias("part"), F.col("node").alias(field), F.col("text").alias(f"{field}_text"))
    named = inner.filter("type = 'Property'").join(child("key"), [*KEY, "part"]).join(child("value"), [*KEY, "part"]).select(*KEY, "src", F.col("value").alias("dst"), path(F.coalesce("key_text", F.lit("*"))).alias("take"))
    rest = inner.filter("type = 'RestElement'").join(child("argument"), [*KEY, "part"]).select(*KEY, "src", F.col("argument").alias("dst"), path().alias("take"))
    at = inner.filter("field = 'elements' and type <> 'RestElement'").select(*KEY, "src", F.col("part").alias("dst"), path("*").alias("take"))
    default = nodes.filter("type = 'AssignmentPattern'").select(*KEY, F.col("node").alias("part")).join(child("left"), [*KEY, "part"]).select(*KEY, F.col("part").alias("src"), F.col("left").alias("dst"), path().alias("take"))
    return named.unionByName(rest).unionByName(at).unionByName(default)


def value_edges(t: dict[str, DataFrame], own: DataFrame) -> DataFrame:
    """(package, script, src, dst, take, give, flat, step) of the values inside scripts, by what a step does to paths; step is `call` for an argument's way into a parameter and `heap` where a value leaves its function by a variable."""
    nodes = t["node"]
    what = nodes.select(*KEY, "node", "type", "parent")
    e = t["edge"].select(*KEY, "src", "dst", "kind").distinct()
    e = e.join(what.select(*KEY, F.col("node").alias("src"), F.col("type").alias("src_type"), F.col("parent").alias("up")), [*KEY, "src"], "left")
    e = e.join(what.select(*KEY, F.col("node").alias("up"), F.col("type").alias("up_type")), [*KEY, "up"], "left")
    e = e.join(what.select(*KEY, F.col("node").alias("dst"), F.col("type").alias("dst_type")), [*KEY, "dst"], "left")
    e = e.join(t["binding"].select(*KEY, F.col("def").alias("dst"), F.col("kind").alias("bound")), [*KEY, "dst"], "left")
    members = graph._cut(member_names(nodes))
    e = e.join(members.select(*KEY, F.col("node").alias("dst"), F.col("object").alias("src"), F.col("name").alias("read")), [*KEY, "src", "dst"], "left")
    # one name for what a pattern takes; several are names at several depths
    taken = t["destructured"].groupBy(*KEY, F.col("source").alias("src"), F.col("def").alias("dst")).agg(F.min("name").alias("part"), (F.count("*") > 1).alias("deep"))
    e = e.join(taken, [*KEY, "src", "dst"], "left")
    e = e.join(t["property"].select(*KEY, F.col("object").alias("dst"), F.col("def").alias("src"), F.col("name").alias("named")).distinct(), [*KEY, "src", "dst"], "left")
    targets = nodes.filter("field = 'left' and type = 'MemberExpression'").select(*KEY, F.col("parent").alias("up"), F.col("node").alias("member"))
    put = targets.join(written_paths(members, t["use"]), [*KEY, "member"]).select(*KEY, "up", F.col("base").alias("dst"), F.col("give").alias("put"))
    e = e.join(put, [*KEY, "up", "dst"], "left")
    kind, some = F.col("kind"), path("*")
    into_pattern = (F.col("bound") == "param") & kind.isin("ARGUMENT", "ELEMENT", "COPY")
    take = F.when(F.col("read").isNotNull(), path(F.col("read"))).when(kind == "ELEMENT", F.when(F.col("deep"), some).otherwise(path(F.coalesce("part", F.lit("*"))))).when(kind == "ITERATE", some).otherwise(path())
    give = (
        F.when(kind == "INITIAL", F.when(F.col("named").isNotNull(), path(F.col("named"))).when((F.col("dst_type") == "ArrayExpression") & (F.col("src_type") != "SpreadElement"), some).otherwise(path()))
        .when(kind == "MUTATE", F.when(F.col("up_type").isin("CallExpression", "NewExpression"), some).otherwise(F.coalesce("put", path())))
        .when((kind == "MERGE") & F.col("dst_type").isin("CallExpression", "NewExpression"), some).otherwise(path())
    )
    flat = ((kind == "MERGE") & F.col("dst_type").isin("BinaryExpression", "TemplateLiteral")) | (kind == "RETURN") | F.coalesce(F.col("deep"), F.lit(False))
    e = e.select(*KEY, "src", "dst", take.alias("take"), give.alias("give"), F.coalesce(flat, F.lit(False)).alias("flat"), F.when(F.coalesce(into_pattern, F.lit(False)), "call").alias("step"), "up", "up_type", "kind").distinct()
    for side in ("src", "dst"):
        e = e.join(own.select(*KEY, F.col("node").alias(side), F.col("owner").alias(f"{side}_owner")), [*KEY, side], "left")
    leaves = F.coalesce(F.col("src_owner") != F.col("dst_owner"), F.lit(False)) & ~((F.col("kind") == "INITIAL") | (F.col("kind") == "RETURN"))
    e = e.withColumn("step", F.coalesce("step", F.when(leaves, "heap").otherwise("same"))).drop("src_owner", "dst_owner")
    taken = pattern_edges(nodes).select(*KEY, "src", "dst", "take", path().alias("give"), F.lit(False).alias("flat"), F.lit(None).cast("long").alias("up"), F.lit(None).cast("string").alias("up_type"), F.lit("PATTERN").alias("kind"), F.lit("same").alias("step"))
    return e.unionByName(taken)


def by_assignment(edges: DataFrame, t: dict[str, DataFrame], own: DataFrame) -> DataFrame:
    """value_edges -> edges between value ids, by assignment instead of by variable: a read has what the assignments that reach it have assigned, and what came into the variable otherwise (as a parameter, by iteration, by a write to a property). A variable that is also assigned in another function than the read's, or a read that no assignment is known to reach, has all that was ever assigned."""
    # a node of its own for each assignment of a variable
    assigned = t["node"].filter(F.col("type").isin("VariableDeclarator", "AssignmentExpression")).select(*KEY, F.col("node").alias("up"), F.col("text").alias("operator"))
    side = t["node"].filter(F.col("field").isin("init", "right")).select(*KEY, F.col("node").alias("src"), F.col("parent").alias("up"))
    defs = t["binding"].select(*KEY, F.col("def").alias("dst"))
    exact = edges.filter("step in ('same', 'heap') and kind in ('ASSIGN', 'ELEMENT', 'COPY')").drop("up").join(side, [*KEY, "src"]).join(assigned, [*KEY, "up"]).join(defs, [*KEY, "dst"])
    exact = graph._cut(exact.join(own.select(*KEY, F.col("node").alias("up"), F.col("owner").alias("at")), [*KEY, "up"]))
    functions = exact.groupBy(*KEY, F.col("dst").alias("def")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    reads = t["reaches"].select(*KEY, "use", "def", "assignment").join(t["use"].select(*KEY, "use", "function").distinct(), [*KEY, "use"])
    local = graph._cut(reads.join(functions, [*KEY, "def"]).filter("first = function and last = function").select(*KEY, "use", "def", "assignment"))
    version = lambda a, d: F.concat_ws("@", value_id(a), F.col(d).cast("string"))
    other = lambda d: F.concat(value_id(d), F.lit("@"))
    shape = ["take", "give", "flat", "step"]
    plain = edges.select(*KEY, "src", "dst", *shape).join(local.select(*KEY, F.col("def").alias("src"), F.col("use").alias("dst")).distinct(), [*KEY, "src", "dst"], "left_anti")
    out = plain.select(value_id("src").alias("src"), value_id("dst").alias("dst"), *shape)
    out = out.unionByName(exact.select(value_id("src").alias("src"), version("up", "dst").alias("dst"), *shape))
    old = exact.filter("operator is not null and operator <> '='").select(*KEY, "up", "dst").distinct().join(t["node"].filter("field = 'left'").select(*KEY, F.col("parent").alias("up"), F.col("node").alias("left")), [*KEY, "up"])
    none = [path().alias("take"), path().alias("give"), F.lit(False).alias("flat"), F.lit("same").alias("step")]
    out = out.unionByName(old.select(value_id("left").alias("src"), version("up", "dst").alias("dst"), *none))
    out = out.unionByName(local.select(version("assignment", "def").alias("src"), value_id("use").alias("dst"), *none))
    out = out.unionByName(local.select(*KEY, "use", "def").distinct().select(other("def").alias("src"), value_id("use").alias("dst"), *none))
    beside = edges.join(exact.select(*KEY, "src", "dst").distinct(), [*KEY, "src", "dst"], "left_anti").join(defs, [*KEY, "dst"])
    return out.unionByName(beside.select(value_id("src").alias("src"), other("dst").alias("dst"), *shape)).distinct()


def beside(edges: DataFrame) -> DataFrame:
    """Edges into values from outside, also into what variables have besides assignments."""
    return edges.unionByName(edges.withColumn("dst", F.concat("dst", F.lit("@"))))


def call_sites(t: dict[str, DataFrame], edges: DataFrame) -> DataFrame:
    """(call, function, src, dst, take, give, flat) of the calls inside scripts: the edges from an argument, or from what a method that calls back is called on, into a parameter."""
    at = t["node"].select(*KEY, "node", "parent", "field")
    given = t["arg"].select(*KEY, "call", F.col("def").alias("src"))
    on = at.filter("field = 'callee'").select(*KEY, F.col("parent").alias("call"), F.col("node").alias("up")).join(at.filter("field = 'object'").select(*KEY, F.col("parent").alias("up"), F.col("node").alias("src")), [*KEY, "up"]).select(*KEY, "call", "src")
    params = t["binding"].filter("kind = 'param'").select(*KEY, F.col("def").alias("dst"), F.col("scope").alias("function"))
    into = edges.filter("step = 'call'").select(*KEY, "src", "dst", "take", "give", "flat").join(params, [*KEY, "dst"])
    s = t["calls"].select(*KEY, "call", "function").distinct().join(given.unionByName(on), [*KEY, "call"]).join(into, [*KEY, "src", "function"])
    return s.select(value_id("call").alias("call"), value_id("function").alias("function"), value_id("src").alias("src"), value_id("dst").alias("dst"), "take", "give", "flat")


def functions_of(t: dict[str, DataFrame]) -> DataFrame:
    """(package, script, def, function): the functions that a name, or a function itself, stands for."""
    f = t["node"].filter(F.col("type").isin(*FUNCTIONS)).select(*KEY, F.col("node").alias("function"), "type")
    named = f.join(t["edge"].select(*KEY, F.col("src").alias("function"), F.col("dst").alias("def")).join(t["binding"].select(*KEY, "def"), [*KEY, "def"]), [*KEY, "function"]).select(*KEY, "def", "function")
    declared = f.filter("type = 'FunctionDeclaration'").join(t["node"].filter("field = 'name'").select(*KEY, F.col("parent").alias("function"), F.col("text").alias("name"), F.col("node").alias("def")), [*KEY, "function"])
    return named.unionByName(declared.select(*KEY, "def", "function")).unionByName(f.select(*KEY, F.col("function").alias("def"), "function")).distinct()


def module_path(script: Column, module: Column) -> Column:
    """The path that a module's name means in a script; names of packages mean none."""
    base = F.when(module.startswith("/"), F.lit("")).otherwise(F.regexp_replace(script, r"[^/]*$", ""))
    parts = F.split(F.concat(base, module), "/")
    climbed = F.aggregate(parts, path(), lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.when(module.rlike(r"^\.{0,2}/"), F.array_join(climbed, "/"))


def exports(t: dict[str, DataFrame]) -> DataFrame:
    """(package, module, name, def): what each module exports, passed-on exports included; def is a value id, module a path, with and without its ending."""
    name = F.concat_ws("\n", "package", "script")
    own = t["export"].filter("def is not null").select(name.alias("module"), "name", value_id("def").alias("def"))
    source = F.concat_ws("\n", "package", module_path(F.col("script"), F.col("module")))
    again = t["export"].filter("module is not null").select(name.alias("of"), "name", source.alias("from_module"), F.col("local").alias("from_name")).withColumnRenamed("of", "module")
    bare = F.regexp_replace("module", r"\.m?js$", "")
    endless = own.unionByName(own.withColumn("module", bare)).distinct()
    if again.head(1):
        endless = program.export_bindings(endless, again.unionByName(again.withColumn("module", bare)).distinct())
    return endless.select(F.substring_index("module", "\n", 1).alias("package"), F.substring_index("module", "\n", -1).alias("module"), "name", "def").distinct()


def imports(t: dict[str, DataFrame], known: DataFrame) -> DataFrame:
    """(package, script, def, property, value): what the imported names of scripts stand for, by program.import_bindings; a whole module has its exports as properties."""
    wanted = t["import"].filter("def is not null").select(*KEY, "def", "name", module_path(F.col("script"), F.col("module")).alias("module")).filter("module is not null")
    i = wanted.select(F.concat_ws("\n", "package", "module").alias("module"), F.concat_ws("\n", "package", "script").alias("script"), F.col("def").alias("local"), "name")
    x = known.select(F.concat_ws("\n", "package", "module").alias("module"), "name", F.col("def").alias("def"))
    b = program.import_bindings(i, x)
    return b.select(F.substring_index("script", "\n", 1).alias("package"), F.substring_index("script", "\n", -1).alias("script"), F.col("local").alias("def"), "property", F.col("def").alias("value"))


def crossing_calls(t: dict[str, DataFrame], bound: DataFrame) -> DataFrame:
    """(call, function): calls, by value ids, of functions of other scripts through names (bound: package, script, def, property, value)."""
    by_id = functions_of(t).select(value_id("def").alias("value"), value_id("function").alias("function"))
    at = t["node"].select(*KEY, "node", "parent", "field")
    called = at.filter("field = 'callee'").select(*KEY, F.col("parent").alias("call"), F.col("node").alias("use")).join(t["call"].select(*KEY, "call"), [*KEY, "call"])
    direct = called.join(t["use"].select(*KEY, "use", "def"), [*KEY, "use"]).join(bound.filter("property is null"), [*KEY, "def"]).select(value_id("call").alias("call"), "value")
    on = at.filter("field = 'callee'").select(*KEY, F.col("parent").alias("call"), F.col("node").alias("up")).join(at.filter("field = 'object'").select(*KEY, F.col("parent").alias("up"), F.col("node").alias("use")), [*KEY, "up"])
    whole = t["call"].filter("method is not null").select(*KEY, "call", F.col("method").alias("property")).join(on, [*KEY, "call"]).join(t["use"].select(*KEY, "use", "def"), [*KEY, "use"]).join(bound.filter("property is not null"), [*KEY, "def", "property"])
    return direct.unionByName(whole.select(value_id("call").alias("call"), "value")).join(by_id, "value").select("call", "function").distinct()


def shared_names(t: dict[str, DataFrame], frames: DataFrame) -> DataFrame:
    """frames (package, frame, ord, script) -> (package, script, def, property, value): names that a script doesn't declare and an earlier script of its frame does, outside of functions; the last such script's."""
    f = frames.select(F.concat_ws("\n", "package", "frame").alias("frame"), "ord", "script", "package")
    pairs = bridges.frame_predecessors(f.select("frame", "ord", "script")).join(f.select("frame", F.col("script").alias("earlier"), "ord"), ["frame", "earlier"]).withColumn("package", F.substring_index("frame", "\n", 1))
    free = t["binding"].filter("kind = 'global'").select(*KEY, "name", "def")
    told = t["binding"].filter("kind <> 'global' and scope = 0").select("package", F.col("script").alias("earlier"), "name", value_id("def").alias("value"))
    met = free.join(pairs, KEY).join(told, ["package", "earlier", "name"])
    return met.groupBy(*KEY, "def").agg(F.max_by("value", F.struct("ord", "value")).alias("value")).select(*KEY, "def", F.lit(None).cast("string").alias("property"), "value")


def channels(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Senders (package, script, call, def: the message, back: what takes the answer) and receivers (package, script, call, function) of the messages inside a package."""
    a = t["arg"].select(*KEY, "call", "ord", F.col("def").alias("value"), F.col("function").alias("f"), "type")
    call = t["call"].filter(F.col("api").isin("chrome.runtime.sendMessage", "chrome.tabs.sendMessage")).select(*KEY, "call", "api")
    first = a.filter("ord = 0").select(*KEY, "call", F.col("value").alias("v0"), F.col("type").alias("t0"))
    second = a.filter("ord = 1").select(*KEY, "call", F.col("value").alias("v1"), F.col("f").alias("f1"))
    # a literal before the message names a receiver
    at_second = F.col("v1").isNotNull() & F.col("f1").isNull() & ((F.col("api") == "chrome.tabs.sendMessage") | (F.col("t0") == "Literal"))
    sent = call.join(first, [*KEY, "call"]).join(second, [*KEY, "call"], "left").filter("api = 'chrome.runtime.sendMessage' or v1 is not null").select(*KEY, "call", F.when(at_second, F.col("v1")).otherwise(F.col("v0")).alias("def"))
    answer = a.filter("f is not null").select(*KEY, "call", F.col("f").alias("function")).join(t["param"].filter("ord = 0").select(*KEY, "function", F.col("def").alias("back")), [*KEY, "function"]).select(*KEY, "call", "back")
    sent = sent.join(answer, [*KEY, "call"], "left").withColumn("back", F.coalesce("back", "call"))
    heard = t["call"].filter("api = 'chrome.runtime.onMessage.addListener'").select(*KEY, "call").join(a.filter("ord = 0 and f is not null").select(*KEY, "call", F.col("f").alias("function")), [*KEY, "call"])
    return sent, heard


def message_tests(t: dict[str, DataFrame], own: DataFrame) -> DataFrame:
    """(package, script, function, def, key, literal): the literals that a function compares a property of one of its values with, by === or ==, or by the cases of a switch."""
    nodes = t["node"]
    members = member_names(nodes).join(t["use"].select(*KEY, F.col("use").alias("object"), "def"), [*KEY, "object"]).select(*KEY, F.col("node").alias("read"), "def", F.col("name").alias("key"))
    literals = nodes.filter("type = 'Literal'").select(*KEY, F.col("parent").alias("whole"), F.col("text").alias("literal"))
    same = nodes.filter("type = 'BinaryExpression' and text in ('===', '==')").select(*KEY, F.col("node").alias("whole"))
    sides = nodes.filter("field in ('left', 'right') and type = 'MemberExpression'").select(*KEY, F.col("parent").alias("whole"), F.col("node").alias("read"))
    compared = same.join(sides, [*KEY, "whole"]).join(literals, [*KEY, "whole"]).select(*KEY, "read", "literal")
    subject = nodes.filter("field = 'discriminant'").select(*KEY, F.col("parent").alias("switch"), F.col("node").alias("read"))
    case = nodes.filter("field = 'cases'").select(*KEY, F.col("parent").alias("switch"), F.col("node").alias("whole"))
    switched = subject.join(case, [*KEY, "switch"]).join(nodes.filter("field = 'test' and type = 'Literal'").select(*KEY, F.col("parent").alias("whole"), F.col("text").alias("literal")), [*KEY, "whole"]).select(*KEY, "read", "literal")
    found = compared.unionByName(switched).join(members, [*KEY, "read"]).join(own.select(*KEY, F.col("node").alias("read"), F.col("owner").alias("function")), [*KEY, "read"])
    return found.select(*KEY, "function", "def", "key", "literal").distinct()


def function_shapes(t: dict[str, DataFrame], own: DataFrame) -> DataFrame:
    """(package, script, function, size, shape): a digest of each function's tree in which local names don't count, only where they are bound, so that renamed copies are equal. A node's place, kind and text, relative to the function, are hashed one by one and added up, nested functions' for each that they are in, so nothing is collected."""
    rows = own.count()
    far = lambda df: graph.apart(df, rows)
    names = t["use"].select(*KEY, F.col("use").alias("node"), "def").unionByName(t["binding"].select(*KEY, F.col("def").alias("node"), "def")).distinct()
    local = far(far(names).join(t["binding"].filter("kind <> 'global'").select(*KEY, "def"), [*KEY, "def"]).select(*KEY, "node", "def").distinct())
    within = own.filter("owner <> 0")
    functions = t["node"].filter(F.col("type").isin(*FUNCTIONS)).select(*KEY, F.col("node").alias("owner"))
    level, _ = graph._cut_large(within.select(*KEY, "node", F.col("owner").alias("function")).unionByName(functions.select(*KEY, F.col("owner").alias("node"), F.col("owner").alias("function"))))
    pairs, up = level, own.select(*KEY, F.col("node").alias("function"), F.col("owner").alias("outer"))
    for _ in graph.rounds(None):
        level, found = graph._cut_large(level.join(far(up), [*KEY, "function"]).filter("outer <> 0").select(*KEY, "node", F.col("outer").alias("function")))
        if not found:
            break
        pairs = pairs.unionByName(level)
    pairs, n = far(pairs), far(t["node"].select(*KEY, "node", "parent", "type", "field", "ord", "text"))
    last = pairs.groupBy(*KEY, "function").agg(F.max("node").alias("last"))
    inner = pairs.join(last, [*KEY, "function"]).join(n, [*KEY, "node"]).join(local, [*KEY, "node"], "left")
    bound = F.col("def").between(F.col("function"), F.col("last"))
    text = F.when(bound, F.concat(F.lit("#"), (F.col("def") - F.col("function")).cast("string"))).otherwise(F.coalesce("text", F.lit("")))
    root = F.col("node") == F.col("function")
    # where the function itself stands, and the name that others call it by, aren't a part of it
    name = (F.col("field") == "name") & (F.col("parent") == F.col("function"))
    place = [F.col("node") - F.col("function"), F.when(root, 0).otherwise(F.col("parent") - F.col("function")), "type", F.when(root, "").otherwise(F.col("field")), F.when(root, 0).otherwise(F.col("ord")), F.when(name, "").otherwise(text)]
    sums = [F.sum(F.xxhash64(F.lit(k), *place).cast("decimal(20,0)")).cast("string") for k in (1, 2)]
    return inner.groupBy(*KEY, "function").agg(F.count("*").alias("size"), F.sha2(F.concat_ws(" ", *sums), 256).alias("shape"))


def helpers(shapes: DataFrame, known: DataFrame) -> DataFrame:
    """shapes, known (shape, effect; of bounded number, `flow` or `clean`) -> (package, script, function, effect): functions that are copies of known ones, whatever their names."""
    return shapes.join(F.broadcast(known.select("shape", "effect").distinct()), "shape").select(*KEY, "function", "effect")
