"""Whether a flow crosses a privilege boundary. Flows that don't are set apart with a reason, never dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V

_CHROME = [s for s in V.PRIVILEGED_SINKS if s.startswith("CHROME_")]
#: Setters that only show text.
DISPLAY_SINKS = "JQUERY_ELEMENT_VAL_SET JQUERY_ELEMENT_TEXT_SET".split()


def gate(flows: DataFrame, readers: DataFrame | None = None) -> DataFrame:
    """Adds crossing (boolean) and reason. Columns: source_type, sink_type, source_family, sink_family, package, storage_area, storage_key, sink_code. readers: (package, area, key) of stored values that are read back; a null key reads all of its area."""
    f = flows
    if readers is not None:
        exact = readers.filter("key is not null").select("package", F.col("area").alias("storage_area"), F.col("key").alias("storage_key"), F.lit(True).alias("__by_key")).distinct()
        wide = readers.filter("key is null").select("package", F.col("area").alias("storage_area"), F.lit(True).alias("__by_area")).distinct()
        f = f.join(exact, ["package", "storage_area", "storage_key"], "left").join(wide, ["package", "storage_area"], "left")
        f = f.withColumn("__read", F.coalesce("__by_key", F.lit(False)) | F.coalesce("__by_area", F.lit(False)) | F.col("storage_key").isNull()).drop("__by_key", "__by_area")
    else:
        f = f.withColumn("__read", F.lit(True))
    source, sink = F.col("source_type"), F.col("sink_type")
    reason = (
        F.when(sink.isin(_CHROME), None)
        .when((F.col("sink_family") == "MAIN") & sink.isin(V.CODE_SINKS), "page-world code execution")
        .when(source.isin(V.DOCUMENT_SOURCES) & sink.isin(V.NETWORK_SINKS) & (F.col("source_family") == "CS") & (F.col("sink_family") == "CS"), "content-script network access is the page's own")
        .when(sink.isin(V.STORAGE_SINKS) & ~F.col("__read"), "stored value is never read back")
        .when(sink.isin(DISPLAY_SINKS), "text display only")
        .when(sink.isin(V.DOM_SINKS) & (F.col("sink_family") != "CS") & F.col("sink_code").rlike("__MSG_"), "extension i18n self-localization")
    )
    return f.withColumn("reason", reason).withColumn("crossing", F.col("reason").isNull()).drop("__read")


def refined(flows: DataFrame, table: DataFrame) -> DataFrame:
    """flows (flow_type, control, sink_code, ...), table (ord, flow_type, control, pattern, keep, reason): the first row of the table that fits a flow (same type, same control or null, pattern in the code) says whether it stays; a flow that no row fits stays. Adds keep and reason. What counts as harmless is an application's own knowledge, so it is a table that the user gives, of bounded size."""
    rows = flows.withColumn("__row", F.xxhash64(*flows.columns))
    t = F.broadcast(table.select("ord", F.col("flow_type").alias("t_type"), F.col("control").alias("t_control"), "pattern", "keep", "reason"))
    fits = (F.col("flow_type") == F.col("t_type")) & (F.col("t_control").isNull() | F.col("t_control").eqNullSafe(F.col("control"))) & F.coalesce(F.regexp_like("sink_code", F.col("pattern")), F.lit(False))
    best = rows.join(t, fits).groupBy("__row").agg(F.min_by(F.struct("keep", "reason"), "ord").alias("r"))
    return rows.join(best, "__row", "left").withColumns({"keep": F.coalesce("r.keep", F.lit(True)), "reason": F.col("r.reason")}).drop("__row", "r")


def split(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The flows that cross, and those that are suppressed."""
    return gated.filter("crossing"), gated.filter("not crossing")
