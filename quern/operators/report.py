"""Aggregates and shapes of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flow_counts(flows: DataFrame) -> DataFrame:
    return flows.groupBy("flow_type").agg(F.count("*").alias("n"))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def coverage(facts: DataFrame, key: str, covered: str) -> DataFrame:
    """Covered and total rows by key, and of all together (a null key): the overall share is of the sums, and 1 where there is nothing to cover."""
    out = facts.rollup(key).agg(F.count_if(F.col(covered)).alias("covered"), F.count("*").alias("total"))
    return out.withColumn("share", F.coalesce(F.col("covered") / F.nullif(F.col("total"), F.lit(0)), F.lit(1.0)))


def truncated(steps: Column, most: int, head: int, tail: int) -> Column:
    """struct(kept, omitted): all steps up to `most`, else the first and the last ones."""
    n = F.size(steps)
    cut = F.concat(F.slice(steps, 1, head), F.slice(steps, -tail, tail))
    return F.when(n <= most, F.struct(steps.alias("kept"), F.lit(0).alias("omitted"))).otherwise(F.struct(cut.alias("kept"), (n - head - tail).alias("omitted")))


def with_sinks_only(sources: DataFrame, hits: DataFrame) -> DataFrame:
    return sources.join(hits.select("taint").distinct(), "taint", "left_semi")


def merge_components(rows: DataFrame) -> DataFrame:
    """rows (id, ord, type, html_path, script_paths): one row for each id, with all scripts and the last type and page that are known."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    return rows.groupBy("id").agg(last("type"), last("html_path"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("script_paths")))).alias("script_paths"))


def verdict_counts(reports: DataFrame) -> DataFrame:
    """reports (tool, is_true): true and false reports of each tool, and the precision."""
    out = reports.groupBy("tool").agg(F.count_if("is_true").alias("tp"), F.count_if(~F.col("is_true")).alias("fp"))
    return out.withColumn("precision", F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)))


def summary(flows: DataFrame, files: DataFrame) -> DataFrame:
    """One row: JSON of the counts by flow type and the files' number and size."""
    by = flow_counts(flows).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flow_type", "n")))).alias("flows"))
    size = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return by.crossJoin(size).select(F.to_json(F.struct("flows", "files", "bytes")).alias("summary"))  # one row each


def totals(files: DataFrame) -> DataFrame:
    """One row: how many files and bytes."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def issues(flows: DataFrame, file: str) -> DataFrame:
    """Flows by file."""
    return flows.groupBy(file).agg(F.count("*").alias("issues"))


def representatives(sources: DataFrame, keys: list[str], order: list[str], path: str) -> DataFrame:
    """The first source of each key has its path; the others are kept as stubs, without one (`repeated`). The first is found by an aggregate and joined back, so a hot key's rows are never one task's."""
    first = sources.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"))
    out = sources.join(first, keys).withColumn("repeated", F.struct(*order) != F.col("__first")).drop("__first")
    return out.withColumn(path, F.when(~F.col("repeated"), F.col(path)))


def hit_rate(lookups: DataFrame, key: str) -> DataFrame:
    """Hits and lookups of each cache, and their ratio; 0 without lookups."""
    out = lookups.groupBy(key).agg(F.count_if("hit").alias("hits"), F.count("*").alias("lookups"))
    return out.withColumn("rate", F.coalesce(F.col("hits") / F.nullif(F.col("lookups"), F.lit(0)), F.lit(0.0)))


def dataset_rows(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """rows (is_true, is_duplicate, kind): the true ones that repeat no other, of the kinds asked for."""
    return rows.filter(F.coalesce("is_true", F.lit(False)) & ~F.coalesce("is_duplicate", F.lit(False)) & F.col("kind").isin(kinds))


def constraint_json(constraint: Column) -> Column:
    """A constraint as JSON text; fields without a value are left out."""
    return F.to_json(constraint)


def flow_json(flows: DataFrame) -> DataFrame:
    """A JSON line for each flow; null fields are kept, as readers count on all fields."""
    return flows.select(F.to_json(F.struct(*flows.columns), {"ignoreNullFields": "false"}).alias("json"))


def source_markdown(sources: DataFrame) -> DataFrame:
    """sources (source_type, remark, location, path): a heading for each type with its number, and a line for each source with its path, in order: (source_type, no, line)."""
    line = F.concat(F.lit("- "), F.coalesce("remark", F.lit("")), F.lit(" at "), F.coalesce("location", F.lit("[unknown_loc]")), F.when(F.col("path").isNotNull(), F.concat(F.lit(": "), F.col("path"))).otherwise(""))
    w = Window.partitionBy("source_type").orderBy("location", "remark", "path")
    body = sources.select("source_type", F.row_number().over(w).alias("no"), line.alias("line"))
    heads = sources.groupBy("source_type").agg(F.count("*").alias("n")).select("source_type", F.lit(0).alias("no"), F.format_string("## %s (%d)", "source_type", "n").alias("line"))
    return heads.unionByName(body)


def html_page(flows: DataFrame, columns: list[str], title: str) -> str:
    """A whole page with a row for each flow, without any outside file. For a report of a size that a reader can take in; the rows come to the driver."""
    import html

    rows = "\n".join(r["row"] for r in html_rows(flows, columns).toLocalIterator())
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    t = html.escape(title)
    return f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{t}</title><style>table{{border-collapse:collapse}}td,th{{border:1px solid #999;padding:2px 6px}}</style></head>\n<body><h1>{t}</h1><table><thead><tr>{head}</tr></thead><tbody>\n{rows}\n</tbody></table></body></html>\n'


def dot_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (graph, id, label), edges (graph, src, dst, label): a row for each graph with its DOT text; a graph is a function's, so its lines fit one row."""
    quote = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    a = nodes.select("graph", F.struct(F.lit(0).alias("k"), F.format_string('  n%s [label="%s"]', F.col("id").cast("string"), quote(F.col("label"))).alias("line")).alias("x"))
    b = edges.distinct().select("graph", F.struct(F.lit(1).alias("k"), F.format_string('  n%s -> n%s [label="%s"]', F.col("src").cast("string"), F.col("dst").cast("string"), quote(F.col("label"))).alias("line")).alias("x"))
    lines = a.unionByName(b).groupBy("graph").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lines.select("graph", F.concat(F.lit("digraph {\n"), F.array_join(F.col("x.line"), "\n"), F.lit("\n}\n")).alias("dot"))


def html_rows(flows: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """A table row of escaped cells for each flow; a page of them needs no outside file."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    return flows.select(*(keep or []), F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), esc(c), F.lit("</td>")) for c in columns), F.lit("</tr>")).alias("row"))


def worst_first(covered: DataFrame, key: str) -> DataFrame:
    """Rows of `coverage` by key, the least share first, with the share as text."""
    from ..functions.scalars import percent

    return covered.filter(F.col(key).isNotNull()).withColumn("percent", percent(F.col("share"))).orderBy("share", key)


def text_report(flows: DataFrame) -> DataFrame:
    """flows (flow_type, source_type, sink_type, source_file, sink_file, severity): a line for each flow, and one for each type with its number, in order of type and line number."""
    w = Window.partitionBy("flow_type").orderBy("source_file", "sink_file", "source_type", "sink_type")
    line = F.format_string("  %s -> %s  [%s]  %s => %s", "source_type", "sink_type", "severity", "source_file", "sink_file")
    rows = flows.select("flow_type", F.row_number().over(w).alias("no"), line.alias("line"))
    heads = flow_counts(flows).select("flow_type", F.lit(0).alias("no"), F.format_string("%s (%d)", "flow_type", "n").alias("line"))
    return heads.unionByName(rows)


def same_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """left and right (path, content): the files that only one side has, by path and SHA-256; empty if both are the same."""
    a, b = (d.select("path", F.sha2("content", 256).alias("sha256")) for d in (left, right))
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
