"""Catalog lookups: what a source or sink can do, which library a script is, which family a frame belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import sink_catalog, source_catalog


def classify(pairs: DataFrame) -> DataFrame:
    """Adds source_cap and sink_cap. The catalogs have a row for each known name, so their broadcast is bounded."""
    spark = pairs.sparkSession
    sources = F.broadcast(source_catalog(spark).select(F.col("type").alias("source_type"), F.col("capability").alias("source_cap")))
    sinks = F.broadcast(sink_catalog(spark).select(F.col("type").alias("sink_type"), F.col("capability").alias("sink_cap")))
    out = pairs.join(sources, "source_type", "left").join(sinks, "sink_type", "left")
    return out.withColumns({"source_cap": F.coalesce("source_cap", F.lit("UNKNOWN_SOURCE")), "sink_cap": F.coalesce("sink_cap", F.lit("UNKNOWN_SINK"))})


def first_signature(rows: DataFrame, text: Column, signatures: DataFrame, keys: list[str], prefix: int = 65536) -> DataFrame:
    """The first signature (ord, name, pattern; case-insensitive) that the text's first `prefix` characters have, for each key; null if none. Signatures are a rules table of bounded size."""
    head = rows.select(*keys, F.substring(text, 1, prefix).alias("__head"))
    hit = F.regexp_like("__head", F.concat(F.lit("(?i)"), F.col("pattern")))
    return head.join(F.broadcast(signatures), hit, "left").groupBy(*keys).agg(F.min_by("name", "ord").alias("library"))


def library_by_name(files: DataFrame, path: str, rules: DataFrame, keys: list[str]) -> DataFrame:
    """The first rule (ord, name, pattern, ignore) whose pattern a file's name (without .js) has, for each key: library, ignore; null if none. Rules are of bounded size."""
    stem = F.regexp_replace(path, r"\.(js|ts)$", "")
    joined = files.select(*keys, stem.alias("__stem")).join(F.broadcast(rules), F.regexp_like("__stem", F.col("pattern")), "left")
    return joined.groupBy(*keys).agg(F.min_by(F.struct(F.col("name").alias("library"), "ignore"), "ord").alias("r")).select(*keys, "r.library", "r.ignore")


def frame_family(component: Column) -> Column:
    """Families of frames by the kind of component."""
    return (
        F.when(component == "content_script", "CS").when(component.isin("background", "service_worker", "background_page"), "BG").when(component == "offscreen", "OF")
        .when(component.isin("devtools", "devtools_panel"), "DT").otherwise("EX")
    )


def permissions_context(component: Column) -> Column:
    return F.when(component == "content_script", "content_script").otherwise("extension")
