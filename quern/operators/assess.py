"""What flows of scripts mean in their packages: where they run, whether they can happen there, which cross a privilege boundary, how exposed they are, and which lie in libraries.

Nothing is dropped; each flow gets columns that say so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import library_rules
from ..sources import packages
from . import classify, filters, privilege, severity

_STRINGS = "array<string>"
FRAME = ["package", "frame", "family", "ord", "script", "matches", "world"]


def frames(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """files (package, path, content), manifests (package, manifest) -> FRAME: the scripts that run together, in their order. A content script's entry is a frame, the background's scripts are one, and every page with its local and inline scripts is one."""
    get = lambda p, t="string": F.try_variant_get("manifest", p, t)
    none, no_world = F.lit(None).cast(_STRINGS), F.lit(None).cast("string")
    clean = lambda c: F.regexp_replace(c, r"^\./|^/", "")
    content = manifests.select("package", F.posexplode(get("$.content_scripts", "array<struct<matches:array<string>,js:array<string>,world:string>>")).alias("k", "c"))
    content = content.select("package", F.concat(F.lit("content_script "), F.col("k").cast("string")).alias("frame"), F.posexplode("c.js").alias("ord", "script"), F.col("c.matches").alias("matches"), F.col("c.world").alias("world"))
    content = content.select("package", "frame", F.when(F.upper("world") == "MAIN", "MAIN").otherwise("CS").alias("family"), "ord", clean("script").alias("script"), "matches", "world")
    worker = get("$.background.service_worker")
    listed = F.when(worker.isNotNull(), F.array(worker)).otherwise(get("$.background.scripts", _STRINGS))
    back = manifests.select("package", F.posexplode(listed).alias("ord", "script"), get("$.background.page").alias("page")).select("package", F.lit("background").alias("frame"), F.lit("BG").alias("family"), "ord", clean("script").alias("script"), none.alias("matches"), no_world.alias("world"))
    text = F.decode("content", "utf-8")
    pages = files.filter(F.col("path").rlike(r"(?i)\.html?$")).select(F.concat_ws("\n", "package", "path").alias("page"), text.alias("html"))
    tags = packages.html_scripts(pages, "page", "html").filter("kind <> 'external'").withColumn("package", F.substring_index("page", "\n", 1)).withColumn("page", F.substring_index("page", "\n", -1))
    named = F.when(F.col("kind") == "local", packages.resolve(F.col("page"), F.col("src"))).otherwise(packages.inline_path(F.col("page"), F.col("inline_no")))
    which = manifests.select("package", clean(get("$.background.page")).alias("background"), clean(get("$.devtools_page")).alias("devtools"))
    family = F.when(F.col("page") == F.col("background"), "BG").when(F.col("page") == F.col("devtools"), "DT").otherwise("EX")
    shown = tags.join(which, "package", "left").select("package", F.concat(F.lit("page "), F.col("page")).alias("frame"), family.alias("family"), "ord", named.alias("script"), none.alias("matches"), no_world.alias("world"))
    return content.unionByName(back).unionByName(shown).select(*FRAME)


def assess(flows: DataFrame, places: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """flows as api.analyse gives them, places as `frames` does -> the same with source_families, sink_families, feasible, crossing, reason, exposure, severity and library (of the sink's script; null if none). A script in no frame has no family: nothing speaks against its flows."""
    by_script = places.groupBy("package", "script").agg(F.sort_array(F.collect_set("family")).alias("families"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce("matches", F.array().cast(_STRINGS)))))).alias("matches"))
    side = lambda x: by_script.select("package", F.col("script").alias(f"{x}_script"), F.col("families").alias(f"{x}_families"), F.col("matches").alias(f"{x}_matches"))
    empty = F.array().cast(_STRINGS)
    f = flows.join(side("source"), ["package", "source_script"], "left").join(side("sink"), ["package", "sink_script"], "left")
    f = f.withColumns({c: F.coalesce(c, empty) for c in ("source_families", "sink_families", "source_matches", "sink_matches")})
    # the two worlds of content scripts are one place for what can happen there
    place = lambda c: F.transform(c, lambda x: F.when(x == "MAIN", "CS").otherwise(x))
    can = filters.feasible(f.withColumns({c: place(F.col(c)) for c in ("source_families", "sink_families")})).select(*flows.columns).distinct().withColumn("feasible", F.lit(True))
    f = f.join(can, flows.columns, "left").withColumn("feasible", F.coalesce("feasible", F.lit(False)))
    only = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1))
    f = f.withColumns({"source_family": only(F.col("source_families")), "sink_family": only(F.col("sink_families")), "storage_area": F.lit(None).cast("string"), "storage_key": F.lit(None).cast("string"), "sink_code": F.lit(None).cast("string")})
    f = privilege.gate(f)
    if manifests is not None:
        outside = manifests.select("package", F.try_variant_get("manifest", "$.externally_connectable.ids", _STRINGS).alias("ids"), F.coalesce(F.try_variant_get("manifest", "$.externally_connectable.matches", _STRINGS), empty).alias("outside")).dropDuplicates(["package"])
        f = f.join(outside, "package", "left")
    else:
        f = f.withColumns({"ids": F.lit(None).cast(_STRINGS), "outside": empty})
    family: Column = F.when(F.array_contains("source_families", "CS") | F.array_contains("source_families", "MAIN"), "CS").otherwise(F.get("source_families", F.lit(0)))
    c = severity.constraint(F.col("source_type"), F.col("sink_type"), F.coalesce(family, F.lit("")), F.concat("source_matches", "sink_matches"), F.coalesce("outside", empty), F.col("ids"))
    f = f.withColumns({"exposure": c["kind"], "severity": c["severity"]})
    libraries = classify.library_by_name(f.select("package", "sink_script").distinct(), "sink_script", library_rules.name_table(f.sparkSession), ["package", "sink_script"])
    f = f.join(libraries.filter("ignore").select("package", "sink_script", "library"), ["package", "sink_script"], "left")
    return f.select(*flows.columns, "source_families", "sink_families", "feasible", "crossing", "reason", "exposure", "severity", "library")
