"""Facts of calls joined with the catalog of functions: sources, sinks, edges, sanitizers; protocols of messages; stored values; whole analyses (`analyse`).

All facts are keyed by (package, script) and a number; the catalog is broadcast, being of bounded size, and every other join is an equi join on those keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import api_catalog
from . import bridges, graph, program, programs, rules, valueflow
from .valueflow import path

KEY = ["package", "script"]


def api_name(name: Column) -> Column:
    """A called name as the catalog spells it: libraries by their own names, methods of what isn't known as `target`."""
    head, rest = F.substring_index(name, ".", 1), F.regexp_replace(name, r"^[^.]*", "")
    head = F.when(head.isin("$", "jQuery"), "JQuery").when(head == "_", "lodash").otherwise(head)
    full = F.concat(head, rest)
    return (
        F.when(full.endswith(".addEventListener") & ~full.startswith("chrome."), "target.addEventListener")
        .when(full.startswith("*."), F.concat(F.lit("target"), rest)).when(full == "axios", "axios.fn").otherwise(full)
    )


def effects(calls: DataFrame) -> DataFrame:
    """calls (package, script, call, api) -> a row for each thing that the catalog says of the call: api, family, ord, role, arg, property, tag."""
    return calls.withColumn("api", api_name(F.col("api"))).join(F.broadcast(api_catalog.catalog(calls.sparkSession)), "api")


def event_fits(tag: Column, name: Column) -> Column:
    """Whether a listener for an event of this name (null: not known) hears what the tag means."""
    standard = name.isin(api_catalog.STANDARD_EVENTS)
    return F.when(tag == "WINDOW_MESSAGE_EVENT", F.coalesce(name == "message", F.lit(False))).when(tag == "ELEMENT_VALUE", F.coalesce(standard, F.lit(False))).when(tag.isin("WINDOW_CUSTOM_EVENT", "TARGET_CUSTOM_EVENT"), ~F.coalesce(standard | (name == "message"), F.lit(False))).otherwise(True)


def _callbacks(done: DataFrame, args: DataFrame, params: DataFrame) -> DataFrame:
    """(package, script, call, ord, def): the parameters of the functions that a call is given to call."""
    given = done.filter("role = 'call'").select(*KEY, "call", F.col("arg").alias("ord"))
    functions = given.join(args.filter("function is not null").select(*KEY, "call", F.col("ord"), "function"), [*KEY, "call", "ord"]).select(*KEY, "call", "function")
    return functions.join(params.select(*KEY, "function", "ord", "def"), [*KEY, "function"]).select(*KEY, "call", "ord", "def")


def sources(done: DataFrame, args: DataFrame, params: DataFrame, members: DataFrame) -> DataFrame:
    """(package, script, source_type, def, call). All stored items are a source only where no key is asked for. A result goes to the callback's first parameter where there is a callback, else to the call; an event to the listener's parameter; attributes are sources where they are read."""
    spark = done.sparkSession
    back = _callbacks(done, args, params)
    result = done.filter("role = 'source'").select(*KEY, "call", F.col("tag").alias("source_type"))
    first = back.filter("ord = 0").select(*KEY, "call", "def")
    asked = args.filter("ord = 0").select(*KEY, "call", F.col("literal").alias("key"), F.col("function").isNotNull().alias("no_key"))
    result = result.join(asked, [*KEY, "call"], "left").filter((F.col("source_type") != "STORAGE_ALL_ITEMS") | F.col("no_key").isNull() | F.col("no_key") | (F.col("key") == "null"))
    result = result.join(first, [*KEY, "call"], "left").withColumn("def", F.coalesce("def", "call"))
    names = args.filter("ord = 0").select(*KEY, "call", F.col("literal").alias("event"))
    event = done.filter("role = 'event'").select(*KEY, "call", F.col("tag").alias("source_type"), F.col("arg").cast("long").alias("ord")).join(back, [*KEY, "call", "ord"]).join(names, [*KEY, "call"], "left").filter(event_fits(F.col("source_type"), F.col("event")))
    read = members.select(*KEY, F.col("node").alias("def"), "api").join(F.broadcast(api_catalog.attributes(spark)), "api").select(*KEY, F.col("tag").alias("source_type"), "def", F.col("def").alias("call"))
    columns = [*KEY, "source_type", "def", "call"]
    return result.select(*columns).unionByName(event.select(*columns)).unionByName(read.select(*columns)).distinct()


def sinks(done: DataFrame, calls: DataFrame, args: DataFrame, params: DataFrame, properties: DataFrame, markup: DataFrame | None = None) -> DataFrame:
    """(package, script, sink_type, def, sink, path). An argument's property is the sink where the argument is written as an object, else the argument at that path; what can't be text is no code; replies of listeners are sinks."""
    a = args.select(*KEY, "call", F.col("ord").alias("arg"), F.col("def").alias("value"), "hint", F.col("type").alias("form"))
    s = done.filter("role = 'sink'").select(*KEY, "call", F.col("arg").cast("long").alias("arg"), "property", F.col("tag").alias("sink_type")).join(a, [*KEY, "call", "arg"])
    s = s.filter(~((F.col("sink_type") == "EVAL") & F.col("hint").isin("no_string", "callable")) & ~((F.col("sink_type") == "TIME_EVAL") & (F.col("hint").isin("no_string", "callable"))))
    p = properties.select(*KEY, F.col("object").alias("value"), F.col("name").alias("property"), F.col("def").alias("own"))
    direct = s.filter("property is null or form <> 'ObjectExpression'").select(*KEY, "sink_type", F.col("value").alias("def"), F.col("call").alias("sink"), F.when(F.col("property").isNull(), path()).otherwise(path(F.col("property"))).alias("path"))
    parts = s.filter("property is not null and form = 'ObjectExpression'").join(p, [*KEY, "value", "property"]).select(*KEY, "sink_type", F.col("own").alias("def"), F.col("call").alias("sink"), path().alias("path"))
    reply = done.filter("role = 'reply'").select(*KEY, "call", F.col("arg").cast("long").alias("ord"), F.col("tag").alias("sink_type")).join(_callbacks(done, args, params), [*KEY, "call", "ord"]).select(*KEY, "sink_type", F.col("def").alias("callee"))
    answered = calls.select(*KEY, "call", "callee").join(reply, [*KEY, "callee"]).join(a.filter("arg = 0"), [*KEY, "call"]).select(*KEY, "sink_type", F.col("value").alias("def"), F.col("call").alias("sink"), path().alias("path"))
    out = direct.unionByName(parts).unionByName(answered)
    if markup is not None:
        out = out.unionByName(markup.select(*KEY, "sink_type", "def", "sink", path().alias("path")))
    return out.distinct()


def edges(done: DataFrame, args: DataFrame) -> DataFrame:
    """(package, script, src, dst, kind): what the catalog lets flow from arguments into results."""
    return done.filter("role = 'flow'").select(*KEY, "call", F.col("tag").alias("kind")).join(args.select(*KEY, "call", F.col("def").alias("src")), [*KEY, "call"]).select(*KEY, "src", F.col("call").alias("dst"), "kind")


def returns(calls_to: DataFrame, returned: DataFrame) -> DataFrame:
    """(package, script, src, dst, kind): what a function returns flows into each call of it; a call with several callees has the values of all."""
    return calls_to.join(returned, [*KEY, "function"]).select(*KEY, F.col("def").alias("src"), F.col("call").alias("dst"), F.lit("RETURN").alias("kind"))


def sanitized(done: DataFrame) -> DataFrame:
    """(package, script, def): results without taint."""
    return done.filter("role = 'clean'").select(*KEY, F.col("call").alias("def"))


def frame_references(done: DataFrame, args: DataFrame, properties: DataFrame, files: DataFrame) -> DataFrame:
    """(package, script, call, path, found): scripts and pages that calls name by a literal, as argument or as a property `file`, `files`, `url` or `js`; found where the package has the file."""
    at = done.filter("role = 'frame'").select(*KEY, "call", F.col("arg").cast("long").alias("ord")).join(args.select(*KEY, "call", "ord", "def", "literal"), [*KEY, "call", "ord"])
    own = properties.filter(F.col("name").isin("file", "files", "url", "js") & F.col("literal").isNotNull()).select(*KEY, F.col("object").alias("def"), F.col("literal").alias("path"))
    named = at.filter("literal is not null").select(*KEY, "call", F.col("literal").alias("path")).unionByName(at.join(own, [*KEY, "def"]).select(*KEY, "call", "path"))
    there = files.select("package", "path", F.lit(True).alias("found")).distinct()
    return named.withColumn("path", F.regexp_replace("path", r"^\./|^/", "")).join(there, ["package", "path"], "left").withColumn("found", F.coalesce("found", F.lit(False))).select(*KEY, "call", "path", "found")


def sender_protocol(properties: DataFrame, messages: DataFrame) -> DataFrame:
    """messages (package, script, send, def), properties (package, script, object, name, literal): for `action` and `type` the values that a message can have; not known where one isn't a literal."""
    own = properties.filter(F.col("name").isin("action", "type")).select(*KEY, F.col("object").alias("def"), F.col("name").alias("key"), "literal")
    rows = messages.join(own, [*KEY, "def"]).withColumn("unknown", F.col("literal").isNull())
    return bridges.merge_candidates(rows, [*KEY, "send", "key"], "literal", "unknown")


def receiver_protocol(tests: DataFrame, listeners: DataFrame) -> DataFrame:
    """tests (package, script, function, def, key, literal), listeners (package, script, receive, function, def): the literals that a listener itself (no function inside it) compares its message's `action` and `type` with."""
    mine = tests.filter(F.col("key").isin("action", "type")).join(listeners, [*KEY, "function", "def"])
    return mine.groupBy(*KEY, "receive", "key").agg(F.array_sort(F.collect_set("literal")).alias("candidates")).withColumn("known", F.lit(True))


def protocol_pairs(pairs: DataFrame, sent: DataFrame, wanted: DataFrame) -> DataFrame:
    """pairs (send_id, recv_id) less those whose protocols can't agree: a key that both know, without a common value."""
    s = sent.select(F.col("send").alias("send_id"), "key", F.col("candidates").alias("sc"), F.col("known").alias("sk"))
    w = wanted.select(F.col("receive").alias("recv_id"), "key", F.col("candidates").alias("wc"), F.col("known").alias("wk"))
    refused = pairs.join(s, "send_id").join(w, ["recv_id", "key"]).filter(~bridges.may_match(F.col("sc"), F.col("sk"), F.col("wc"), F.col("wk"))).select("send_id", "recv_id").distinct()
    return pairs.join(refused, ["send_id", "recv_id"], "left_anti")


def projected(properties: DataFrame, messages: DataFrame) -> DataFrame:
    """messages (def), properties (object, name, def): a received message has the known properties of the sent one, each with its own taint, at any depth; what has no known property is one value: (root, path, def)."""
    properties, _ = graph._cut_large(properties.select(F.col("object").alias("def"), "name", F.col("def").alias("own")))
    now, _ = graph._cut_large(messages.select(F.col("def").alias("root"), F.array().cast("array<string>").alias("path"), "def"))
    out, seen = [now], [now.select("root", "def")]
    for _ in graph.rounds(None):
        step = now.join(properties, "def").select("root", F.concat("path", F.array("name")).alias("path"), F.col("own").alias("def"))
        now, n = graph._cut_large(step.join(graph.all_(seen).hint("merge"), ["root", "def"], "left_anti"))
        if not n:
            break
        out, seen = [*out, now], [*seen, now.select("root", "def")]
    deeper, _ = graph._cut_large(properties.select("def").distinct())
    return graph.all_(out).join(deeper, "def", "left_anti").select("root", "path", "def")


def storage_ops(done: DataFrame, args: DataFrame, properties: DataFrame, params: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sets (package, area, key, set_id) and gets (package, area, key, get_id, changed) of stored values, as bridges.storage_bridge takes them; ids are value ids. The keys that are asked for follow program.key_shapes: a literal, an array or a choice of literals, an object of defaults, nothing (all keys), or what isn't known."""
    area = F.regexp_extract("api", r"^chrome\.storage\.(\w+)\.", 1)
    ops = done.filter("role = 'bridge'").withColumn("area", area).select(*KEY, "call", "api", "area")
    first = args.filter("ord = 0").select(*KEY, "call", "def", F.col("type").alias("form"), "literal", F.col("function").isNotNull().alias("callback"))
    p = properties.select(*KEY, F.col("object").alias("def"), F.col("name").alias("key"), F.col("def").alias("own"))
    put = ops.filter(F.col("api").endswith(".set")).join(first, [*KEY, "call"])
    no_key = F.lit(None).cast("string")
    sets = put.join(p, [*KEY, "def"]).select("package", "area", "key", programs.value_id("own").alias("set_id"))
    sets = sets.unionByName(put.filter("form <> 'ObjectExpression'").select("package", "area", no_key.alias("key"), programs.value_id("def").alias("set_id")))
    # a callback may stand in any place, as the keys may be left out
    back = ops.join(args.filter("function is not null").select(*KEY, "call", "function"), [*KEY, "call"]).join(params.filter("ord = 0").select(*KEY, "function", F.col("def").alias("got")), [*KEY, "function"]).select(*KEY, "call", "got")
    asked = ops.filter(F.col("api").endswith(".get")).join(first, [*KEY, "call"], "left").join(back, [*KEY, "call"], "left").withColumn("get_id", programs.value_id(F.coalesce("got", "call")))
    parts = nodes.filter("field in ('elements', 'consequent', 'alternate')").groupBy(*KEY, F.col("parent").alias("def")).agg(F.collect_set(F.when(F.col("type") == "Literal", F.col("text"))).alias("options"), F.bool_and(F.col("type") == "Literal").alias("plain"))
    names = p.groupBy(*KEY, "def").agg(F.collect_set("key").alias("defaults"))
    none = F.col("def").isNull() | F.col("callback") | (F.col("literal").isin("null", "undefined") & F.col("form").isin("Literal", "Identifier"))
    shape = F.when(none, "none").when(F.col("form") == "Literal", "literal").when(F.col("plain") & F.col("form").isin("ArrayExpression", "ConditionalExpression"), F.when(F.col("form") == "ArrayExpression", "array").otherwise("union")).when(F.col("form") == "ObjectExpression", "object").otherwise("unknown")
    where = asked.join(parts, [*KEY, "def"], "left").join(names, [*KEY, "def"], "left").withColumn("shape", shape)
    keys = program.key_shapes(where.select("get_id", "shape", "literal", "options", "defaults")).select("get_id", "key").distinct()
    gets = where.select("package", "area", "get_id").distinct().join(keys, "get_id").select("package", "area", "key", "get_id", F.lit(False).alias("changed"))
    changed = ops.filter(F.col("api").endswith("onChanged.addListener")).join(_callbacks(done, args, params).filter("ord = 0"), [*KEY, "call"])
    return sets, gets.unionByName(changed.select("package", F.lit("*").alias("area"), no_key.alias("key"), programs.value_id("def").alias("get_id"), F.lit(True).alias("changed")))


def stored_edges(sets: DataFrame, gets: DataFrame) -> DataFrame:
    """Edges from stored values to what reads them: under their key in an answer, under the key and `newValue` in a change."""
    met = bridges.storage_bridge(sets, gets.drop("changed")).distinct().join(sets.select("set_id", F.col("key").alias("put")).distinct(), "set_id").join(gets.select("get_id", F.col("key").alias("asked"), "changed").distinct(), "get_id")
    key = F.coalesce("put", "asked")
    met = met.filter("put is null or asked is null or put = asked")
    take = F.when(F.col("put").isNotNull(), path()).when(F.col("changed"), path("*")).when(F.col("asked").isNotNull(), path(F.col("asked"))).otherwise(path())
    give = F.when(F.col("changed"), F.array(F.coalesce(key, F.lit("*")), F.lit("newValue"))).when(key.isNotNull(), path(key)).otherwise(path())
    return met.select(F.col("set_id").alias("src"), F.col("get_id").alias("dst"), take.alias("take"), give.alias("give"), F.lit(False).alias("flat"), F.lit("heap").alias("step")).distinct()


def message_edges(t: dict[str, DataFrame], own: DataFrame) -> DataFrame:
    """Edges of messages inside a package: from what is sent to the listeners' parameter, and from what they answer to what takes the answer; none where the protocols (`action`, `type`) can't agree."""
    sent, heard = (graph._cut(d) for d in programs.channels(t))
    id_, channel, any_ = programs.value_id, F.lit("runtime").alias("channel"), F.lit(None).cast("string").alias("outer_id")
    pairs = bridges.channel_bridge(sent.select("package", id_("call").alias("send_id"), channel, any_).distinct(), heard.select("package", id_("call").alias("recv_id"), channel, any_).distinct())
    message = t["param"].filter("ord = 0").select(*KEY, "function", "def")
    asked = sender_protocol(t["property"], sent.select(*KEY, id_("call").alias("send"), "def"))
    wanted = receiver_protocol(programs.message_tests(t, own), heard.join(message, [*KEY, "function"]).select(*KEY, id_("call").alias("receive"), "function", "def"))
    pairs = graph._cut(protocol_pairs(pairs.select("send_id", "recv_id"), asked, wanted))
    to = heard.join(message, [*KEY, "function"]).select(id_("call").alias("recv_id"), id_("def").alias("dst"))
    out = pairs.join(sent.select(id_("call").alias("send_id"), id_("def").alias("src")), "send_id").join(to, "recv_id").select("src", "dst")
    reply = t["param"].filter("ord = 2").select(*KEY, "function", F.col("def").alias("callee")).join(heard, [*KEY, "function"]).select(*KEY, "callee", id_("call").alias("recv_id"))
    said = t["call"].select(*KEY, F.col("call").alias("answer"), "callee").join(reply, [*KEY, "callee"]).join(t["arg"].filter("ord = 0").select(*KEY, F.col("call").alias("answer"), "def"), [*KEY, "answer"]).select("recv_id", id_("def").alias("src"))
    back = pairs.join(said, "recv_id").join(sent.select(id_("call").alias("send_id"), id_("back").alias("dst")), "send_id").select("src", "dst")
    return _plain(out.unionByName(back).distinct(), "heap")


def _plain(pairs: DataFrame, step: str) -> DataFrame:
    return pairs.select("src", "dst", path().alias("take"), path().alias("give"), F.lit(False).alias("flat"), F.lit(step).alias("step"))


def flow_edges(t: dict[str, DataFrame], done: DataFrame, own: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """All edges between the values of all scripts, summaries of functions included: inside scripts by assignment, the catalog's, calls and returns, modules, the names of a frame, messages, stored values."""
    id_ = programs.value_id
    local = graph._cut(programs.value_edges(t, own))
    out = programs.by_assignment(local, t, own)
    by_catalog = edges(done, t["arg"]).select(id_("src").alias("src"), id_("dst").alias("dst"), path().alias("take"), path().alias("give"), F.lit(True).alias("flat"), F.lit("same").alias("step"))
    bound = programs.imports(t, programs.exports(t))
    if frames is not None:
        bound = bound.unionByName(programs.shared_names(t, frames))
    bound = graph._cut(bound)
    crossing = graph._cut(programs.crossing_calls(t, bound))
    named = bound.select(F.col("value").alias("src"), id_("def").alias("dst"), path().alias("take"), F.when(F.col("property").isNull(), path()).otherwise(path(F.col("property"))).alias("give"), F.lit(False).alias("flat"), F.lit("heap").alias("step"))
    given = t["arg"].select(id_("call").alias("call"), "ord", id_("def").alias("src"))
    taken = t["param"].select(id_("function").alias("function"), "ord", id_("def").alias("dst"))
    far = crossing.join(given, "call").join(taken, ["function", "ord"])
    returned = t["return"].select(id_("function").alias("function"), id_("def").alias("def"))
    calls = t["calls"].select(id_("call").alias("call"), id_("function").alias("function")).unionByName(crossing).distinct()
    back = calls.join(returned, "function").select(F.col("def").alias("src"), F.col("call").alias("dst"))
    stored = stored_edges(*(graph._cut(d) for d in storage_ops(done, t["arg"], t["property"], t["param"], t["node"])))
    outside = _plain(far.select("src", "dst"), "call").unionByName(named).unionByName(stored).unionByName(message_edges(t, own))
    out = graph._cut(out.unionByName(by_catalog).unionByName(_plain(back, "return")).unionByName(programs.beside(outside)).join(sanitized(done).select(id_("def").alias("dst")).distinct(), "dst", "left_anti"))
    sites = programs.call_sites(t, local).unionByName(far.select("call", "function", "src", "dst", path().alias("take"), path().alias("give"), F.lit(False).alias("flat")))
    params = t["binding"].filter("kind = 'param'").select(id_("scope").alias("function"), id_("def").alias("root")).unionByName(t["param"].select(id_("function").alias("function"), id_("def").alias("root"))).distinct().join(calls.select("function").distinct(), "function", "left_semi")
    params = params.withColumn("def", F.explode(F.array(F.col("root"), F.concat("root", F.lit("@")))))
    return out.unionByName(valueflow.summaries(out, params, returned, sites).select(*out.columns))


def _given_way(t: dict[str, DataFrame], own: DataFrame, known: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the bodies of known helpers, and the edges that stand for them: from arguments to the calls of those that pass them on."""
    found = graph._cut(programs.helpers(programs.function_shapes(t, own), known))
    inside = found.join(own.withColumnRenamed("owner", "function"), [*KEY, "function"]).select(*KEY, "node").distinct()
    out = lambda df, node: df.join(inside.withColumnRenamed("node", node), [*KEY, node], "left_anti")
    calls = t["calls"].join(found.filter("effect = 'flow'").select(*KEY, "function"), [*KEY, "function"]).select(*KEY, "call")
    passed = calls.join(t["arg"].select(*KEY, "call", "def"), [*KEY, "call"]).select(programs.value_id("def").alias("src"), programs.value_id("call").alias("dst"))
    gone = t | {"call": out(t["call"], "call"), "edge": out(t["edge"], "dst"), "markup": out(t["markup"], "sink"), "return": out(t["return"], "def")}
    return gone, _plain(passed.distinct(), "same").withColumn("flat", F.lit(True))


def analyse(t: dict[str, DataFrame], rule_sets: list[dict] | None = None, frames: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """From the fact tables of scripts (written before) to flows: sources and sinks by the catalog where code can run, taint by paths over all edges to its fixpoint, rules. frames (package, frame, ord, script), if known, says which scripts run together; known (shape, effect), if given, which functions are helpers whose bodies give way to what they do. Rows: package, source_script, source_type, source_call, sink_script, sink_type, sink_call, flow_type, rule_id."""
    id_ = programs.value_id
    own, never = graph._cut(programs.owners(t["node"])), graph._cut(programs.dead(t["node"], t["branch"]))
    runs = lambda df, node: df.join(never.withColumnRenamed("node", node), [*KEY, node], "left_anti")
    t = programs.with_patterns(t)
    t = t | {"call": runs(t["call"], "call"), "edge": runs(t["edge"], "dst"), "member": runs(t["member"], "node"), "markup": runs(t["markup"], "sink"), "return": runs(t["return"], "def")}
    extra = None
    if known is not None:
        t, extra = _given_way(t, own, known)
    done = graph._cut(effects(t["call"]))
    found = graph._cut(sources(done, t["arg"], t["param"], t["member"]))
    hits = graph._cut(sinks(done, t["call"], t["arg"], t["param"], t["property"], t["markup"]))
    start = found.select(F.concat_ws(" ", id_("call"), "source_type").alias("taint"), F.explode(F.array(id_("def"), F.concat(id_("def"), F.lit("@")))).alias("def"), path().alias("path"))
    start = start.join(sanitized(done).select(id_("def").alias("def")), "def", "left_anti")
    way = flow_edges(t, done, own, frames)
    tainted = valueflow.propagate(start, way if extra is None else way.unionByName(extra.select(*way.columns)))
    ends = hits.select(id_("sink").alias("sink"), "sink_type", id_("def").alias("def"), F.col("path").alias("at"), F.col("script").alias("sink_script"), F.col("sink").alias("sink_call"))
    met = tainted.join(ends, "def").filter(valueflow.fits(F.col("path"), F.col("at"))).select("taint", "sink_type", "sink_script", "sink_call").distinct()
    names = found.select(F.concat_ws(" ", id_("call"), "source_type").alias("taint"), "package", F.col("script").alias("source_script"), "source_type", F.col("call").alias("source_call")).distinct()
    named = rules.match_flows(met.join(names, "taint"), rules.rules_frame(met.sparkSession, rule_sets or [rules.default_rules()]))
    return named.select("package", "source_script", "source_type", "source_call", "sink_script", "sink_type", "sink_call", "flow_type", "rule_id").distinct()
