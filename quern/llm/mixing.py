"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents fall into cells (source, language, topic). The cells' token weights are raked: in turn for each of the three dimensions, every weight is scaled so that its value's total meets the target share. After each `rounds` turns the residual (the largest distance of a value's share from its target) is looked at; turns go on until it is at most `tolerance` or doesn't fall any more (targets that the cells can't meet), and the table of cells says what it is. A cell's rate is its raked weight over its tokens; the largest rate is made probability 1, so no document is repeated and the expected mix is the target mix. A document is kept if a hash of its id is under its cell's probability, the same way on every run.

Targets are shares by value, in three tables (value, share) or, by default, the present shares raised to `temper` and normalised: below 1 this lifts small sources, languages and topics.

Documents are read twice, once to sum up cells (pre-aggregated before a small shuffle) and once to sample. The cells are mostly few: up to ONE_TASK of them are raked in one task, more by aggregates and joins; their table is broadcast if it has at most BROADCAST_CELLS rows, else joined by shuffle.

Edge cases: a null source or language is a value of its own, "(null)"; a null or empty text has 0 tokens and its cell's probability, that of a cell without tokens being 1; a null id is hashed as the text "(null)"; repeated rows are kept or dropped together. A value with target 0 is dropped; targets of values without tokens are spread over the others. Very long texts are only measured. The columns that `calibrate` adds must not be there already (an error); `sample` adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BROADCAST_CELLS = 100_000
#: Cells that one task rakes.
ONE_TASK = 100_000
ADDED = ("__quern_tokens", "__quern_p", "__quern_kept")
DIMS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A coarse kind of text: tabular, with digits, long or plain."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains("|"), "tabular").when(t.rlike("[0-9]"), "numeric").when(F.length(t) >= 8000, "long").otherwise("plain")


def tokens_of(text: Column) -> Column:
    """Pieces between spaces."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def chance(doc_id: Column, seed: str) -> Column:
    """A number from 0 to 1 that hangs on the id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("(null)")), F.lit(seed))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _keys(docs: DataFrame, topic: Column | None) -> dict[str, Column]:
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(null)"))
    return {"source": own("source"), "lang": own("lang"), "topic": topic_of(F.col("text")) if topic is None else topic}


def _with(w: DataFrame, by: str | None, one_task: bool, **sums: Column) -> DataFrame:
    """w with aggregates over its rows, or over those with an equal value of `by`, as columns: windows in one task, or a join with an aggregate."""
    if one_task:
        over = Window.partitionBy(*([by] if by else []))
        return w.withColumns({k: c.over(over) for k, c in sums.items()})
    if by:
        return w.drop(*sums).join(w.groupBy(by).agg(*(c.alias(k) for k, c in sums.items())), by)
    return w.drop(*sums).crossJoin(F.broadcast(w.agg(*(c.alias(k) for k, c in sums.items()))))  # one row


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = 0.9, rounds: int = 10, tolerance: float = 1e-5) -> DataFrame:
    """cells (source, lang, topic, tokens), a row for each cell -> the same with weight, probability and residual, written."""
    scratch, n = Scratch(cells.sparkSession, "raking"), cells.count()
    one = n <= ONE_TASK
    w = cells.coalesce(1) if one else cells
    step = 0

    def written(df: DataFrame) -> DataFrame:
        """Cuts lineage; in one task only between blocks of turns."""
        nonlocal step
        step += 1
        return scratch.save(df, f"step{step}")

    for d in DIMS:
        if targets and d in targets:
            t = targets[d].groupBy(F.col("value").alias(d)).agg(F.sum(F.col("share").cast("double")).alias(f"t_{d}"))
            w = w.join(F.broadcast(t) if t.count() <= BROADCAST_CELLS else t, d, "left").fillna(0.0, [f"t_{d}"])
            w = _with(w, d, one, **{f"live_{d}": F.sum("tokens"), f"n_{d}": F.count("*")}).withColumn(f"s_{d}", F.when(F.col(f"live_{d}") > 0, F.col(f"t_{d}")).otherwise(0.0))
        else:
            w = _with(w, d, one, **{f"live_{d}": F.sum("tokens"), f"n_{d}": F.count("*")}).withColumn(f"s_{d}", F.pow(F.col(f"live_{d}").cast("double"), F.lit(temper)))
        w = _with(w if one else written(w), None, one, **{f"all_{d}": F.sum(F.col(f"s_{d}") / F.col(f"n_{d}"))})
        w = w.withColumn(f"s_{d}", F.col(f"s_{d}") / F.col(f"all_{d}"))
    w = w.withColumn("weight", F.col("tokens").cast("double")).select(*DIMS, "tokens", "weight", *(f"s_{d}" for d in DIMS))
    if not one:
        w = written(w)
    before = None
    while True:
        for _ in range(rounds):
            for d in DIMS:
                w = _with(w, d, one, total=F.sum("weight"))
                w = w.withColumn("weight", F.coalesce(F.col("weight") * F.col(f"s_{d}") / F.nullif(F.col("total"), F.lit(0.0)), F.lit(0.0))).drop("total")
                if not one:
                    w = written(w)
        w = written(w)
        far = [w.groupBy(d).agg(F.abs(F.sum("weight") - F.max(f"s_{d}")).alias("far")).agg(F.max("far").alias("far")) for d in DIMS]
        residual = max((r["far"] or 0.0) for r in far[0].unionByName(far[1]).unionByName(far[2]).collect())  # three rows
        if residual <= tolerance or (before is not None and residual >= 0.999 * before):
            break
        before = residual
        if one:
            w = w.coalesce(1)
    top = w.agg(F.max(F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")))).first()[0] or 0.0
    p = F.when((F.col("tokens") > 0) & F.lit(top > 0), F.round(F.col("weight") / F.col("tokens") / F.lit(float(top) or 1.0), 9)).otherwise(1.0)
    return written(w.select(*DIMS, "tokens", "weight", p.alias("probability"), F.lit(float(residual)).alias("residual")))


def calibrate(docs: DataFrame, topic: Column | None = None, targets: dict[str, DataFrame] | None = None, temper: float = 0.9, rounds: int = 10, seed: str = "mix") -> DataFrame:
    """docs with __quern_tokens, __quern_p (the probability) and __quern_kept."""
    if clash := [c for c in (*ADDED, *(f"__quern_{d}" for d in DIMS)) if c in docs.columns]:
        raise ValueError(f"columns may not be named {clash}")
    keys = _keys(docs, topic)
    scratch = Scratch(docs.sparkSession, "mixing")
    cells = docs.select(*(c.alias(k) for k, c in keys.items()), tokens_of(F.col("text").cast("string")).alias("tokens")).groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"))
    raked = rake(scratch.save(cells, "cells"), targets, temper, rounds)
    side = raked.select(*(F.col(d).alias(f"__quern_{d}") for d in DIMS), F.col("probability").alias("__quern_p"))
    if raked.count() <= BROADCAST_CELLS:
        side = F.broadcast(side)
    on = [keys[d] == F.col(f"__quern_{d}") for d in DIMS]
    joined = docs.join(side, on[0] & on[1] & on[2])
    return joined.withColumn("__quern_tokens", tokens_of(F.col("text").cast("string"))).withColumn("__quern_kept", chance(F.col("doc_id"), seed) < F.col("__quern_p")).drop(*(f"__quern_{d}" for d in DIMS))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The kept documents, with their columns as they were, whatever their names."""
    clash = {c: f"__quern_own_{k}" for k, c in enumerate(docs.columns) if c in (*ADDED, *(f"__quern_{d}" for d in DIMS))}
    return calibrate(docs.withColumnsRenamed(clash), **options).filter("__quern_kept").select(*(F.col(clash.get(c, c)).alias(c) for c in docs.columns))
