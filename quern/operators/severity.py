"""How exposed a flow is: ranks of match patterns and ids, and the largest of several constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.scalars import is_ignored_pattern, pattern_rank, rank_severity

# The surfaces by which others reach a frame.
EXTERNAL_SOURCES = "CHROME_ONMESSAGEEXTERNAL_MESSAGE CHROME_ONCONNECTEXTERNAL_ONMESSAGE CHROME_CONNECT_ONMESSAGE_EXTERANL CHROME_SENDMESSAGE_EXTERNAL_RESPONSE".split()
EXTERNAL_SINKS = "CHROME_RUNTIME_SENDMESSAGE_EXTERNAL CHROME_RUNTIME_CONNECT_POSTMESSAGE_EXTERNAL CHROME_RUNTIME_ONMESSAGEEXTERNAL_SENDRESPONSE CHROME_RUNTIME_ONCONNECTEXTERNAL_POSTMESSAGE".split()
CONTENT_SOURCES = [*V.DOCUMENT_SOURCES, *V.WEB_EVENT_SOURCES]


def matches_rank(patterns: Column) -> Column:
    """The largest rank of the patterns that count, 0 for none."""
    live = F.filter(patterns, lambda p: ~is_ignored_pattern(p))
    return F.coalesce(F.array_max(F.transform(live, pattern_rank)), F.lit(0))


def ids_rank(ids: Column) -> Column:
    """Who may connect by id: undeclared and `*` mean all."""
    return F.when(ids.isNull(), 4).when(F.array_contains(ids, "*"), 4).when(F.size(ids) > 0, 1).otherwise(0)


def constraint(source_type: Column, sink_type: Column, family: Column, matches: Column, external_matches: Column, external_ids: Column) -> Column:
    """struct(kind, severity, evidence) of a flow; the surfaces are tried in order."""
    external = source_type.isin(EXTERNAL_SOURCES) | sink_type.isin(EXTERNAL_SINKS)
    content = (family == "CS") & source_type.isin(CONTENT_SOURCES)
    empty = F.array().cast("array<string>")
    by_ids, by_matches = ids_rank(external_ids), matches_rank(external_matches)
    out = lambda kind, severity, evidence: F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), evidence.alias("evidence"))
    return (
        F.when(external & (by_ids > by_matches), out("EXTERNALLY_CONNECTABLE_IDS", rank_severity(by_ids), F.coalesce(external_ids, empty)))
        .when(external, out("EXTERNALLY_CONNECTABLE_MATCHES", rank_severity(by_matches), F.coalesce(external_matches, empty)))
        .when(content, out("CONTENT_SCRIPT_MATCHES", rank_severity(matches_rank(matches)), F.coalesce(matches, empty)))
        .when(family.isin("EX", "DT") & source_type.isin(V.DOCUMENT_SOURCES), out("EXTENSION_UI", F.lit("MEDIUM"), empty))
        .otherwise(out("UNKNOWN", F.lit("LOW"), empty))
    )


def with_fallback(flows: DataFrame, constraints: DataFrame, trackers: DataFrame) -> DataFrame:
    """flows (frame, taint), constraints (frame, severity), trackers (taint, severity): a flow's severity is its frame's, else that of the tracker of its taint, else LOW. Each side has one row for a key."""
    out = flows.join(constraints.withColumnRenamed("severity", "__of_frame"), "frame", "left").join(trackers.withColumnRenamed("severity", "__of_taint"), "taint", "left")
    return out.withColumn("severity", F.coalesce("__of_frame", "__of_taint", F.lit("LOW"))).drop("__of_frame", "__of_taint")


def most_severe(rows: DataFrame, keys: list[str], rank: str, order: str, columns: list[str]) -> DataFrame:
    """For each key the row of the largest rank, the first in order at ties."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns, rank), F.struct(F.col(rank), -F.col(order))).alias("r")).select(*keys, "r.*")
