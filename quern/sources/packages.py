"""Readers of extension packages: folders, zip files and signed archives, as rows of files.

Archives are read by Spark's binaryFile source and unpacked where they are read, a package a row; names that leave the package are refused. Everything after that is columns."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import first_literal, is_external_url, package_id

FILES = "package string, kind string, path string, size long, content binary, public_key binary, error string"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def _fields(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Length-delimited fields of a message; others are skipped."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 2:
            n, at = _varint(data, at)
            yield tag >> 3, data[at : at + n]
            at += n
        elif tag & 7 == 0:
            _, at = _varint(data, at)
        else:
            at += 8 if tag & 7 == 1 else 4


def archive_parts(data: bytes) -> tuple[str, bytes, bytes | None]:
    """Kind, the zip inside, and the public key of a package's bytes. Raises ValueError for what is no package."""
    if data[:2] == b"PK":
        return "XPI", data, None
    if data[:4] != b"Cr24":
        raise ValueError("not a package")
    version = struct.unpack_from("<I", data, 4)[0]
    if version == 2:
        n_key, n_sig = struct.unpack_from("<II", data, 8)
        return "CRX", data[16 + n_key + n_sig :], data[16 : 16 + n_key]
    if version != 3:
        raise ValueError(f"version {version} isn't known")
    n = struct.unpack_from("<I", data, 8)[0]
    head = list(_fields(data[12 : 12 + n]))
    keys = [dict(_fields(v)).get(1) for k, v in head if k in (2, 3)]
    signed = dict(_fields(next((v for k, v in head if k == 10000), b"")))
    import hashlib

    own = signed.get(1)
    key = next((k for k in keys if k and own and hashlib.sha256(k).digest()[:16] == own), next((k for k in keys if k), None))
    return "CRX", data[12 + n :], key


def unpack(data: bytes) -> tuple[str, bytes | None, list[tuple[str, bytes]]]:
    """Kind, public key, and (path, content) of each file. Names with `..`, drives or a leading slash are refused."""
    kind, inner, key = archive_parts(data)
    files = []
    with zipfile.ZipFile(io.BytesIO(inner)) as z:
        for i in z.infolist():
            name = i.filename.replace("\\", "/")
            if i.is_dir():
                continue
            if name.startswith("/") or ":" in name.split("/")[0] or ".." in name.split("/"):
                raise ValueError(f"unsafe name {name!r}")
            files.append((name, z.read(i)))
    if not any(n == "manifest.json" for n, _ in files):
        raise ValueError("no manifest.json")
    return kind, key, files


def _unpack_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in FILES.split(", ")]
    for f in frames:
        for path, data in zip(f["path"], f["content"], strict=True):
            try:
                kind, key, files = unpack(bytes(data))
                rows = [(path, kind, n, len(c), c, key, None) for n, c in files]
            except (ValueError, zipfile.BadZipFile, struct.error, IndexError, StopIteration) as e:
                rows = [(path, None, None, None, None, None, str(e))]
            yield pd.DataFrame(rows, columns=columns)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of FILES of all .crx, .xpi and .zip files below path; a package that can't be read is a row with an error."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.lower("path").rlike(r"\.(crx|xpi|zip)$"))
    return raw.select("path", "content").mapInPandas(_unpack_all, FILES)


def read_folders(spark: SparkSession, root: str) -> DataFrame:
    """Rows of FILES of unpacked packages, a folder below root each; folders without a manifest.json are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    own = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")
    # Paths are cut by the length of the root's own path; the scheme before it may be written in more than one way.
    rest = F.substring(F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", ""), len(own) + 2, 1 << 30)
    files = raw.select(F.regexp_extract(rest, "^([^/]+)/", 1).alias("package"), F.lit("DIR").alias("kind"), F.regexp_replace(rest, "^[^/]+/", "").alias("path"), F.col("length").alias("size"), "content", F.lit(None).cast("binary").alias("public_key"), F.lit(None).cast("string").alias("error"))
    return files.join(files.filter("path = 'manifest.json'").select("package"), "package", "left_semi").select(*(c.split()[0] for c in FILES.split(", ")))


def manifests(files: DataFrame) -> DataFrame:
    """package, id, name, version, mv and the manifest as a variant ({} where it can't be parsed)."""
    m = files.filter("path = 'manifest.json'").withColumn("v", F.coalesce(F.try_parse_json(F.decode("content", "utf-8")), F.parse_json(F.lit("{}"))))
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    gecko = first_literal(get("$.browser_specific_settings.gecko.id"), get("$.applications.gecko.id"))
    own = F.when(F.col("public_key").isNotNull(), package_id(F.col("public_key"))).when(F.col("kind") == "XPI", F.coalesce(gecko, F.lit("unknown@firefox"))).otherwise(F.col("package"))
    return m.select("package", own.alias("id"), get("$.name").alias("name"), get("$.version").alias("version"), get("$.manifest_version", "int").alias("mv"), F.col("v").alias("manifest"))


def scripts(files: DataFrame, ignore: Column | None = None) -> DataFrame:
    """The .js files that aren't ignored."""
    s = files.filter(F.col("path").endswith(".js"))
    return s if ignore is None else s.filter(~ignore)


_TAG = r"(?is)<script\b([^>]*)>(.*?)</script\s*>"
_ATTRIBUTE = r"""([^\s=>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""


def attributes(text: Column) -> Column:
    """Attributes of a tag as a map, names in lower case, the last of a name."""
    names = F.transform(F.regexp_extract_all(text, F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
    values = [F.regexp_extract_all(text, F.lit(_ATTRIBUTE), F.lit(k)) for k in (2, 3, 4)]
    pairs = F.zip_with(names, F.zip_with(values[0], F.zip_with(values[1], values[2], lambda b, c: F.concat(b, c)), lambda a, b: F.concat(a, b)), lambda n, v: F.struct(n.alias("n"), v.alias("v")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["n"]), F.create_map(p["n"], p["v"])))


def html_scripts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, ord, kind (inline, local or external), src, body, script_type, inline_no of each script tag. A tag with an empty src is inline; surrounding white space of a src doesn't count, and a src of nothing else is left out, as are inline scripts of white space; a local source is kept once. inline_no numbers the inline scripts of a page from 0."""
    tags = F.arrays_zip(F.regexp_extract_all(html, F.lit(_TAG), F.lit(1)).alias("a"), F.regexp_extract_all(html, F.lit(_TAG), F.lit(2)).alias("b"))
    t = pages.select(key, F.posexplode(tags).alias("ord", "t")).select(key, "ord", attributes(F.col("t.a")).alias("at"), F.col("t.b").alias("body"))
    blank = lambda c: F.regexp_replace(c, r"(?s)^[\s\ufeff\u00a0]+|[\s\ufeff\u00a0]+$", "")
    raw = F.nullif(F.element_at("at", "src"), F.lit(""))
    src = blank(raw)
    t = t.filter(src.isNull() | (src != ""))
    t = t.select(key, "ord", F.when(src.isNull(), "inline").when(is_external_url(src), "external").otherwise("local").alias("kind"), src.alias("src"), F.when(src.isNull(), blank(F.col("body"))).alias("body"), F.coalesce(F.element_at("at", "type"), F.lit("text/javascript")).alias("script_type"), (F.coalesce(F.element_at("at", "type"), F.lit("")) != "").alias("typed"))
    t = t.filter((F.col("kind") != "inline") | (F.length("body") > 0))
    first = t.groupBy(key, "kind", "src", F.when(F.col("kind") == "inline", F.col("ord")).alias("__o")).agg(F.min_by(F.struct("ord", "body", "script_type", "typed"), "ord").alias("r"))
    out = first.select(key, "r.ord", "kind", "src", "r.body", "r.script_type", "r.typed")
    numbers = out.filter("kind = 'inline'").groupBy(key).agg(F.array_sort(F.collect_list("ord")).alias("__all"))  # the scripts of a page
    return out.join(numbers, key, "left").withColumn("inline_no", F.when(F.col("kind") == "inline", F.array_position("__all", F.col("ord")).cast("int") - 1)).drop("__all")


#: Fixed value: the folder of inline scripts' own names.
INLINE_FOLDER = ".inline-scripts"


def inline_path(page: Column, number: Column) -> Column:
    """The name of a page's inline script."""
    safe = F.regexp_replace(F.regexp_replace(page, r"[/\\:]", "_"), r"(?i)\.html?$", "")
    return F.concat(F.lit(f"{INLINE_FOLDER}/"), safe, F.lit(".inline-"), number.cast("string"), F.lit(".js"))


def inline_files(scripts: DataFrame, page_path: str) -> DataFrame:
    """Inline rows of `html_scripts` as scripts of their own: path (below INLINE_FOLDER, named after the page and the number) and code (three or four lines of comment that say where it is from, and the body)."""
    page = F.col(page_path)
    head = F.concat(F.lit("// [inline]\n// source-html: "), page, F.lit("\n// script-index: "), F.col("inline_no").cast("string"), F.lit("\n"), F.when(F.col("typed"), F.concat(F.lit("// script-type: "), F.col("script_type"), F.lit("\n"))).otherwise(""))
    return scripts.filter("kind = 'inline'").select(page_path, inline_path(page, F.col("inline_no")).alias("path"), F.concat(head, F.col("body")).alias("code"))


def resolve(page_path: Column, src: Column) -> Column:
    """The package's path of a local source: rooted, or relative to the page."""
    folder = F.regexp_replace(page_path, "[^/]*$", "")
    joined = F.when(src.startswith("/"), F.regexp_replace(src, "^/+", "")).otherwise(F.concat(folder, src))
    joined = F.regexp_replace(joined, r"[?#].*$", "")
    parts = F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.array_join(parts, "/")
