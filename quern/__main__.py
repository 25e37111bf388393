"""python -m quern INPUT OUTPUT: analyses the packages of a folder and writes flows, sources of findings, a summary and a page.

INPUT is a folder of .crx, .xpi and .zip files (or of unpacked packages, with --folders), as any path that Spark reads; rules can be given as JSON files (--rules)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import api, assess, filters, graph, report, rules
from .sources import packages, script_facts


def scripts_of(files: DataFrame, ignore: list[str]) -> DataFrame:
    """package, script, code of the files that aren't ignored, and of the inline scripts of pages."""
    text = F.decode("content", "utf-8")
    own = packages.scripts(files, filters.ignored(F.col("path"), ignore)).select("package", F.col("path").alias("script"), text.alias("code"))
    pages = files.filter(F.col("path").rlike(r"(?i)\.html?$")).select("package", F.concat_ws("\n", "package", "path").alias("page"), text.alias("html"))
    inline = packages.html_scripts(pages.select("page", "html"), "page", "html").withColumn("package", F.substring_index("page", "\n", 1)).withColumn("page", F.substring_index("page", "\n", -1))
    made = inline.filter("kind = 'inline'").select("package", packages.inline_path(F.col("page"), F.col("inline_no")).alias("script"), F.col("body").alias("code"))
    return own.unionByName(made)


def analyse(spark: SparkSession, files: DataFrame, ignore: list[str] | None = None, rule_sets: list[dict] | None = None) -> DataFrame:
    """Flows of the files of packages, with what they mean there (assess.assess). Facts are written by kind, so that each step reads its own."""
    good = files.filter("error is null")
    facts = graph.table(script_facts.extract(scripts_of(good, ignore or [])), "fact")
    told = graph._cut(packages.manifests(good).select("package", F.to_json("manifest").alias("text"))).select("package", F.parse_json("text").alias("manifest"))
    places = graph._cut(assess.frames(good, told))
    flows = graph._cut(api.analyse(script_facts.tables(facts), rule_sets, places.select("package", "frame", "ord", "script")))
    return assess.assess(flows, places, told)


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quern", description=__doc__)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--folders", action="store_true", help="INPUT holds unpacked packages")
    p.add_argument("--ignore", action="append", default=[], help="ignore pattern; may be given more than once")
    p.add_argument("--rules", help="a path of JSON rule files, after the default rules")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("quern").getOrCreate()
    files = graph._cut(packages.read_folders(spark, a.input) if a.folders else packages.read_archives(spark, a.input))
    sets = [rules.default_rules(), *(rules.load(spark, a.rules) if a.rules else [])]
    flows = graph._cut(analyse(spark, files, a.ignore, sets))
    flows.write.mode("overwrite").json(f"{a.output}/flows")
    report.summary(flows, files).write.mode("overwrite").text(f"{a.output}/summary")
    page = report.html_page(flows.orderBy("package", "flow_type", "source_script"), ["package", "flow_type", "source_type", "source_script", "sink_type", "sink_script", "rule_id", "severity", "reason"], "Flows")
    spark.createDataFrame([(page,)], "page string").coalesce(1).write.mode("overwrite").text(f"{a.output}/page")


if __name__ == "__main__":
    main()
