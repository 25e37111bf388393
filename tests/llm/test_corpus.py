"""Mixing, the pipeline, and the registered queries with SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import decontam, mixing, near_dedup, queries, quality

from .conftest import SF


def _cells(spark):
    return spark.createDataFrame([(s, lang, t, n) for s, lang, t, n in (("a", "x", "p", 900), ("a", "y", "p", 50), ("b", "x", "q", 100), ("b", "y", "p", 200), ("b", "y", "q", 30), ("c", "x", "p", 0))], "source string, lang string, topic string, tokens long")


def test_raked_weights_meet_all_targets(spark):
    t = lambda **v: spark.createDataFrame(list(v.items()), "value string, share double")
    targets = {"source": t(a=0.5, b=0.5), "lang": t(x=0.6, y=0.4), "topic": t(p=0.7, q=0.3)}
    got = mixing.rake(_cells(spark), targets, rounds=12).cache()
    for d, want in (("source", {"a": 0.5, "b": 0.5, "c": 0}), ("lang", {"x": 0.6, "y": 0.4}), ("topic", {"p": 0.7, "q": 0.3})):
        for r in got.groupBy(d).agg(F.sum("weight").alias("w")).collect():
            assert abs(r["w"] - want[r[d]]) < 2e-2
    assert {r["residual"] for r in got.collect()} == {got.first()["residual"]} and got.first()["residual"] <= 1e-5
    p = [r["probability"] for r in got.collect()]
    assert max(p) == 1.0 and min(p) >= 0


def test_raking_without_one_task_is_the_same(spark, monkeypatch):
    one = {tuple(r)[:3]: r for r in mixing.rake(_cells(spark), rounds=2).collect()}
    monkeypatch.setattr(mixing, "ONE_TASK", 2)
    many = {tuple(r)[:3]: r for r in mixing.rake(_cells(spark), rounds=2).collect()}
    assert one.keys() == many.keys() and all(abs(one[k]["probability"] - many[k]["probability"]) < 1e-8 for k in one)


def test_targets_that_cannot_be_met(spark):
    """Source a has no cell of language y: what the cells allow is reached, and the residual says how far it is."""
    cells = spark.createDataFrame([("a", "x", "p", 10), ("b", "y", "p", 10)], "source string, lang string, topic string, tokens long")
    t = lambda **v: spark.createDataFrame(list(v.items()), "value string, share double")
    got = mixing.rake(cells, {"source": t(a=0.9, b=0.1), "lang": t(x=0.2, y=0.8)}).first()
    assert got["residual"] > 0.5


def test_sampling_is_calibrated(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 10 < 7, "en").otherwise("de").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").otherwise("s").alias("source"))
    got = mixing.calibrate(docs, temper=0.5).groupBy("lang", "source").agg(F.avg("__quern_p").alias("p"), F.avg(F.col("__quern_kept").cast("int")).alias("kept")).collect()
    assert all(abs(r["p"] - r["kept"]) < 0.03 for r in got) and max(r["p"] for r in got) == 1.0
    assert mixing.sample(docs).columns == docs.columns


def test_mixing_odd_rows(odd, nothing):
    got = mixing.calibrate(odd)
    assert got.count() == odd.count() and got.filter("__quern_p is null or __quern_kept is null").count() == 0
    named = odd.withColumnsRenamed({"rep": "__quern_p", "part": "__quern_tokens", "id": "__quern_source"})
    assert mixing.sample(named).columns == named.columns
    with pytest.raises(ValueError, match="__quern_p"):
        mixing.calibrate(named)
    assert mixing.sample(nothing).count() == 0


def test_mixing_runs_no_python(spark):
    plan = mixing.sample(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), c.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(x) for x in columns]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = docs.join(labels.filter("quality = 1"), "doc_id")
    assert kept.columns == docs.columns and kept.join(good, "doc_id", "left_semi").count() > 0.95 * good.count()
    once = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    want = {r["doc_id"] for r in near_dedup.groups(docs, 80, 5).filter("kept").collect()}
    assert once.columns == docs.columns and {r["doc_id"] for r in once.collect()} == want
    clean = corpus_pipeline.decontamination_stage(spark, docs, SF)
    assert clean.columns == docs.columns and clean.filter("n_chars <> length(text)").count() == docs.filter("n_chars <> length(text)").count()
    hit = decontam.scan(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert clean.count() == hit.filter("n_hit <= 0.5 * n_words").count()
    mixed = corpus_pipeline.mixing_stage(spark, docs, SF)
    assert mixed.columns == docs.columns and 0 < mixed.count() < docs.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert out and [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in out)
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(out, out[1:], strict=False))


def test_quality_without_labels_keeps_all(odd, nothing):
    model = quality.fit(nothing.withColumn("label", F.lit(0)))
    assert quality.keep(odd, model).count() == odd.count()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_over_empty_tables(spark, tmp_path, name):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_run_over_empty_tables(spark, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_by_hand(spark, real):
    """The pipeline's rows by plain steps: each stage's decisions recomputed, near copies and benchmark hits by brute force, ids by the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from quern.llm import toxicity
    from quern.llm.common import Scratch

    from .test_texts import _hits, _linked, _least, _set

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.labelled_sample(docs, labels, "quality", 6000, 5, 0, "quality")
    model = quality.fit(Scratch(spark, "q").save(rows.repartition(12), "s"))
    good = [(d, t) for d, t in sorted(real.items()) if quality.raw_scores(model, __import__("numpy").array([quality.features((t or "").encode())]))[0] >= model["cut_at"]]
    once = []
    for part in _linked(good, 80)[1]:
        own = [good[k] for k in part]
        once += own if not _set(own[0][1]) else [x for x in own if x[0] == _least([d for d, _ in own])]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {}
    for (d, n, hit, _), t in [(x, None) for x in _hits(once, items)]:
        if len(hit) <= 0.5 * n:
            clean[d] = decontam.cut(dict(once)[d], hit)
    table = spark.createDataFrame(list(clean.items()), "doc_id long, text string").join(docs.select("doc_id", "lang", "source"), "doc_id")
    kept = sorted(r["doc_id"] for r in mixing.calibrate(table).filter("__quern_kept").collect())
    t, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    want = []
    for d in kept:
        n = len(t.encode(clean[d] or "", add_special_tokens=False).ids) + 1
        want.append((d, at, n))
        at += n
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in corpus_pipeline.run(spark, SF).orderBy("start").collect()]
    assert got == want
