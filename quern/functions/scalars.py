"""Column functions: all built from Spark's own, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_match(value: Column, pattern: Column) -> Column:
    """Literal equality, or `*` as any run of characters, anchored at both ends."""
    escaped = F.regexp_replace(pattern, r"([.+?^${}()|\[\]\\])", r"\\$1")
    regex = F.concat(F.lit("(?s)^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("$"))
    return F.coalesce((value == pattern) | (pattern.contains("*") & F.regexp_like(value, regex)), F.lit(False))


def ignore_glob_regex(pattern: str) -> str:
    """The regular expression of an ignore-file pattern (without its `!`). `**` crosses folders, `*` doesn't; a pattern without a slash holds at any depth; a trailing slash means all below."""
    p = pattern.replace("\\", "/").removeprefix("./").lstrip("/")
    deep = "/" not in p.rstrip("/")
    if p.endswith("/"):
        p += "**"
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + p[i] if p[i] in r".+^${}()|[]\\" else p[i]), i + 1
    return "^" + ("(?:.*/)?" if deep else "") + out + "$"


def normal_path(path: Column) -> Column:
    """Forward slashes, without a leading `./` or `/`."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./|/)+", "")


def script_key(path: Column) -> Column:
    return F.regexp_replace(path, r"\.(js|ts)$", "")


def location(line1: Column, col1: Column, line2: Column, col2: Column) -> Column:
    return F.coalesce(F.concat(F.lit("L"), line1, F.lit(":C"), col1, F.lit(" -> L"), line2, F.lit(":C"), col2), F.lit("[unknown_loc]"))


def snippet(code: Column, start: Column, end: Column, around: int = 20) -> Column:
    """The part of code from start to end (code points, end excluded) with its surroundings, the part itself in marks."""
    a = F.greatest(F.lit(0), start - around)
    return F.concat(F.substring(code, a + 1, start - a), F.lit(">>>"), F.substring(code, start + 1, end - start), F.lit("<<<"), F.substring(code, end + 1, F.lit(around)))


def pad_right(text: Column, width: int) -> Column:
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def event_names(names: Column) -> Column:
    """Names split at spaces, without namespaces, in lower case, each once."""
    parts = F.filter(F.split(F.trim(names), r"\s+"), lambda x: x != "")
    return F.array_distinct(F.transform(parts, lambda x: F.lower(F.substring_index(x, ".", 1))))


def file_timeout(size: Column) -> Column:
    """Seconds by size class."""
    return F.when(size < 128 * 1024, 120).when(size < 1024 * 1024, 300).otherwise(600)


def package_id(public_key: Column) -> Column:
    """The id of a package: the first 32 hexadecimal digits of the key's SHA-256, written in a to p."""
    return F.translate(F.substring(F.sha2(public_key, 256), 1, 32), "0123456789abcdef", "abcdefghijklmnop")


def is_package_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^[a-p]{32}$"), F.lit(False))


def is_gecko_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^\{[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\}$") | value.rlike(r"^[A-Za-z0-9._-]*@[A-Za-z0-9._-]+$"), F.lit(False))


def is_version(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^\d+(\.\d+)*$"), F.lit(False))


def extension_id_check(is_literal: Column, value: Column, own: Column) -> Column:
    """What a literal id argument says: null for our own, the id, or why it isn't one."""
    return F.when(~is_literal, "UNKNOWN_EXTENSION_ID").when((F.coalesce(value, F.lit("")) == "") | (value == own), None).when(is_package_id(value), value).otherwise("INVALID")


def is_external_url(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)^(https?:|data:|blob:|chrome-extension:|moz-extension:)"), F.lit(False))


def first_literal(*columns: Column) -> Column:
    """The first that isn't null or empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


# Match patterns: scheme://host/path.

_PATTERN = r"^([^:]+)://([^/]*)(/.*)?$"


def pattern_scheme(p: Column) -> Column:
    return F.nullif(F.regexp_extract(p, _PATTERN, 1), F.lit(""))


def pattern_host(p: Column) -> Column:
    return F.when(pattern_scheme(p).isNotNull(), F.regexp_extract(p, _PATTERN, 2))


def pattern_path(p: Column) -> Column:
    return F.when(pattern_scheme(p).isNotNull(), F.coalesce(F.nullif(F.regexp_extract(p, _PATTERN, 3), F.lit("")), F.lit("/")))


def is_ignored_pattern(p: Column) -> Column:
    """Empty, a file's, or a loopback host's."""
    host = F.regexp_replace(pattern_host(p), r":[0-9*]+$", "")
    return F.coalesce((F.trim(p) == "") | (pattern_scheme(p) == "file") | host.isin("localhost", "127.0.0.1", "0.0.0.0", "[::1]"), F.lit(False))


def pattern_rank(p: Column) -> Column:
    """How many pages a match pattern covers: 4 all hosts, 3 subdomains, 2 one host, 1 a path."""
    host, path = pattern_host(p), pattern_path(p)
    return F.when(p == "<all_urls>", 4).when(host.isNull(), 1).when(host == "*", 4).when(host.startswith("*."), 3).when(path.isin("/*", "/", "*"), 2).otherwise(1)


def rank_severity(rank: Column) -> Column:
    return F.when(rank >= 4, "CRITICAL").when(rank == 3, "HIGH").when(rank == 2, "MEDIUM").otherwise("LOW")


# Three-valued truth: Spark's null is UNKNOWN.


def truth_not(a: Column) -> Column:
    return ~a


def truth_label(a: Column) -> Column:
    return F.when(a.isNull(), "UNKNOWN").when(a, "TRUE").otherwise("FALSE")


def truth_and(a: Column, b: Column) -> Column:
    return a & b


def truth_or(a: Column, b: Column) -> Column:
    return a | b


def truth_nullish(left_kind: Column, left: Column, right: Column) -> Column:
    """`??`: the right side's truth where the left is null or undefined, the left's where its kind is known, else unknown."""
    return F.when(left_kind.isin("null", "undefined"), right).when(left_kind.isNotNull(), left)


def literal_truth(kind: Column, text: Column) -> Column:
    """Truth of a literal by its kind; null for kinds that aren't known."""
    n = F.try_to_number(text, F.lit("S999999999999.999999"))
    return F.when(kind == "string", text != "").when(kind == "boolean", text == "true").when(kind.isin("null", "undefined"), False).when(kind == "number", n != 0).when(kind.isin("object", "function", "regex"), True)


def url_with_query(base: str, **parameters: Column) -> Column:
    """A base address with encoded parameters, in the order given."""
    parts = [F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in parameters.items()]
    return F.concat(F.lit(base), F.lit("?" if parts else ""), *(x for k, p in enumerate(parts) for x in ([F.lit("&")] if k else []) + [p]))


def value_at(json: Column, path: str) -> Column:
    """The value at a dotted path of JSON text; array places are numbers."""
    steps = "".join(f"[{x}]" if x.isdigit() else f".{x}" for x in path.split("."))
    return F.get_json_object(json, f"${steps}")


def with_value_at(json: Column, key: str, value: Column) -> Column:
    """JSON text of an object with one of its keys set to a value (JSON text as well); what isn't an object is taken as an empty one."""
    pairs = F.coalesce(F.from_json(json, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    kept = F.map_filter(pairs, lambda k, _: k != key)
    return F.to_json(F.map_concat(kept, F.create_map(F.lit(key), F.parse_json(value))))


def seconds_between(start: Column, end: Column) -> Column:
    return end.cast("timestamp").cast("double") - start.cast("timestamp").cast("double")
