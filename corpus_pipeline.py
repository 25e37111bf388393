"""A corpus pipeline of the text operators: reject low quality, keep one of each group of near duplicates, take out benchmark text, mix, and write token ids.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All but the last return the columns of documents. Clean documents pass every filter; the mixing stage samples, which is what it is for.

Edge cases: a text that decontamination cuts has its n_chars counted anew; null texts and repeated ids are handled as each operator says; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, mixing, near_dedup, quality, token_store, toxicity
from quern.llm.common import Scratch, fresh, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = toxicity.labelled_sample(docs, read_table(spark, sf_dir, "labels"), "quality", 6000, 5, 0, "quality")
    return quality.keep(docs, quality.fit(Scratch(spark, "quality").save(rows.repartition(12), "sample")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs, 80, 5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = fresh("__quern_before", docs.columns)
    clean = decontam.clean(docs.withColumn(before, F.length("text")), read_table(spark, sf_dir, "benchmark"), 10)
    n = F.when(F.col(before) == F.length("text"), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return clean.withColumn("n_chars", F.coalesce(n, F.col("n_chars"))).drop(before)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "tokens-out")
    token_store.store(docs, public_tokenizers.path("byte_bpe_50k.json"), scratch.root)
    return token_store.read(spark, scratch.root)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage), ("tokens", token_stage)]

#: Learned scores, hashing and a tokenizer aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the last one's rows."""
    scratch, docs = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.free(*(n for n, _ in STAGES[: max(0, k)]))
    return STAGES[-1][1](spark, docs, sf_dir)
