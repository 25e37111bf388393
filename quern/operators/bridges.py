"""Joins across contexts: stored values, messages, frames, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def storage_bridge(sets: DataFrame, gets: DataFrame) -> DataFrame:
    """sets (package, area, key, set_id) and gets (package, area, key, get_id); a null key is one that isn't known and meets every key of its area, the area `*` every area. Values meet inside a package only. Equal keys are an equi join; only rows with an unknown key or area take the wider ones, which are equi joins on package and area, or on the package."""
    known_s, known_g = (d.filter(F.col("key").isNotNull() & (F.col("area") != "*")) for d in (sets, gets))
    wild_s, wild_g = (d.filter(F.col("key").isNull() & (F.col("area") != "*")) for d in (sets, gets))
    exact = known_s.join(known_g, ["package", "area", "key"]).select("set_id", "get_id")
    by_area = wild_s.drop("key").join(gets.filter("area <> '*'").drop("key"), ["package", "area"]).select("set_id", "get_id")
    to_wild = known_s.drop("key").join(wild_g.drop("key"), ["package", "area"]).select("set_id", "get_id")
    star_g = gets.filter("area = '*'").select("package", "get_id", F.col("key").alias("asked"))
    star = sets.join(star_g, "package").filter(F.col("key").isNull() | F.col("asked").isNull() | (F.col("key") == F.col("asked"))).select("set_id", "get_id")
    return exact.unionByName(by_area).unionByName(to_wild).unionByName(star)


#: As many parts a channel's receivers are dealt to.
DEALT = 32


def channel_bridge(senders: DataFrame, receivers: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """senders (package, send_id, channel, outer_id) and receivers (package, recv_id, channel, outer_id): equal channels of a package; unequal outer ids refuse, null meets any. Columns of senders may be carried along. A channel's receivers are dealt to DEALT parts that each meet all of its senders, so that few channels with very many pairs keep all tasks busy; senders are met in sorted runs, which spill, and never broadcast."""
    r = receivers.withColumnRenamed("outer_id", "r_outer").withColumn("__part", F.pmod(F.xxhash64("recv_id"), F.lit(DEALT)).cast("int")).hint("merge")
    s = senders.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    ok = F.col("outer_id").isNull() | F.col("r_outer").isNull() | (F.col("outer_id") == F.col("r_outer"))
    return r.join(s, ["package", "channel", "__part"]).filter(ok).select("send_id", "recv_id", "channel", *carry)


def may_match(sent: Column, sent_known: Column, wanted: Column, wanted_known: Column) -> Column:
    """False only if both sets of values are fully known and have nothing in common."""
    return ~(sent_known & wanted_known & ~F.coalesce(F.arrays_overlap(sent, wanted), F.lit(False)))


def merge_candidates(rows: DataFrame, keys: list[str], value: str, unknown: str) -> DataFrame:
    """Union of candidate values; known only if every alternative is."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("candidates"), (~F.bool_or(unknown)).alias("known"))


def frame_predecessors(scripts: DataFrame) -> DataFrame:
    """scripts (frame, ord, script): pairs (script, earlier) inside a frame."""
    a, b = scripts.alias("a"), scripts.alias("b")
    return a.join(b, (F.col("a.frame") == F.col("b.frame")) & (F.col("b.ord") < F.col("a.ord"))).select(F.col("a.frame").alias("frame"), F.col("a.script").alias("script"), F.col("b.script").alias("earlier"))


def innermost(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, low: str, high: str, id_: str) -> DataFrame:
    """For each point the narrowest range of the same keys that holds it (the lesser id at ties); null if none."""
    p = graph._cut(points.withColumn("__row", F.monotonically_increasing_id()))  # written, so that both uses see the same numbers
    joined = p.join(ranges, keys, "left").filter(F.col(id_).isNull() | ((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))))
    best = joined.groupBy("__row").agg(F.min_by(id_, F.struct(F.col(high) - F.col(low), F.col(id_))).alias(id_))
    return p.join(best, "__row", "left").drop("__row")


def last_definition(uses: Column, keys: list[str], order: list[str]) -> Column:
    """The latest value before a row that isn't null: the definition that reaches it."""
    return F.last(uses, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def straight_line_taint(steps: DataFrame, keys: list[str], order: list[str], source: Column, clean: Column) -> DataFrame:
    """Adds `tainted`: in code that runs straight on, whether a source was met since the last sanitizer (which ends the taint where it stands)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    since = steps.withColumn("__since", F.count_if(clean).over(w))
    return since.withColumn("tainted", F.bool_or(source & ~clean).over(Window.partitionBy(*keys, "__since").orderBy(*order))).drop("__since")
