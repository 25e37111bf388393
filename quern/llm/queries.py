"""The registered queries: each operator over its whole tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, fingerprints, langid, lattice_lm, mixing, near_dedup, oracle, packing, quality, suffix_dedup, token_store, toxicity, whitening
from .common import Scratch, fold, read_table, stratified


def _labelled(spark: SparkSession, sf_dir: str, label: str, cap: int) -> DataFrame:
    """A bounded sample of labelled rows outside the held-out fold, written so that it is read from the documents once."""
    rows = toxicity.labelled_sample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), label, cap, 5, 0, label)
    return Scratch(spark, label).save(rows.repartition(12), "sample")


def _judged(scores: DataFrame, folds: int, held: int, at: float) -> DataFrame:
    return scores.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), F.col("score"), (F.col("score") >= at).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str, cap: int = 6000) -> DataFrame:
    model = toxicity.fit(_labelled(spark, sf_dir, "toxic", cap), cap)
    return _judged(toxicity.score(read_table(spark, sf_dir, "documents"), model), 5, 0, 0.5)


def op2_langid(spark: SparkSession, sf_dir: str, cap: int = 800) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 3) != 1))
    out = langid.identify(docs, langid.fit(stratified(known, "lang", "doc_id", cap, "lang")))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(read_table(spark, sf_dir, "documents"), 85, 5)


def op5_quality(spark: SparkSession, sf_dir: str, cap: int = 6000) -> DataFrame:
    model = quality.fit(_labelled(spark, sf_dir, "quality", cap), cap)
    return _judged(quality.score(read_table(spark, sf_dir, "documents"), model), 5, 0, 0.3)


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = lattice_lm.score(read_table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "store")
    token_store.store(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch.root)
    return token_store.read(spark, scratch.root)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_edited(read_table(spark, sf_dir, "documents"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.calibrate(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mixed.select("doc_id", F.col("__quern_tokens").alias("n_tokens"), F.col("__quern_p").alias("probability"), F.col("__quern_kept").alias("kept"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict:
    found = [op1_toxicity, op2_langid, op3_suffix_dedup, op4_near_dedup, op5_quality, op6_lattice_lm, op7_token_store, op8_fingerprints, op9_decontam, op10_mixing, op11_whitening, op12_alignment, op13_packing]
    return {f.__name__: functools.partial(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
