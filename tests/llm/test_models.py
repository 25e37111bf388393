"""Toxicity, language, quality: held-out accuracy, what the method promises, and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from quern.llm import langid, quality, queries, toxicity

from .conftest import SF


def _bad_words(spark, group, n=60):
    """Toxic sentences that mention one group more than clean ones do."""
    rows = [(i, f"these {group} are vile scum number {i}", 1) for i in range(n)] + [(n + i, f"some people met in town {i} today", 0) for i in range(2 * n)] + [(3 * n + i, f"the {group} met in town {i}", 0) for i in range(n // 10)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_counterfactuals_free_groups_of_blame(spark):
    plain = toxicity.fit(_bad_words(spark, "muslims"), counterfactual=0.0)
    fair = toxicity.fit(_bad_words(spark, "muslims"), counterfactual=5.0)
    neutral, other = b"the muslims met", b"the christians met"
    gap = lambda m: abs(toxicity.score_text(m, neutral) - toxicity.score_text(m, other))
    assert gap(fair) < 0.3 * gap(plain)
    assert toxicity.score_text(fair, neutral) < 0.5 < toxicity.score_text(fair, b"vile scum")


def test_penalty_is_that_of_swapped_sentences():
    """The penalty and its gradient against sentences that are really swapped, scored one by one."""
    rng = np.random.default_rng(3)
    texts = [b"the muslims met women in town", b"christians and jews came", b"nobody came to town", b"", b"black women and women"]
    others = {t.encode(): tuple(x.encode() for x in kind if x != t) for kind in toxicity.KINDS for t in kind}
    words = sorted({w for t in texts for w in toxicity.features(t, others)} | set(others))
    vocab = {w: k for k, w in enumerate(words)}
    w = rng.normal(size=len(words) + 1)

    def score(text):
        return w[-1] + sum(w[vocab[x]] for x in toxicity.features(text, others) if x in vocab)

    def by_hand():
        total = 0.0
        for t in texts:
            parts = t.split()
            made = []
            for term in sorted({x for x in parts if x in others}):
                for new in (b"", *others[term]):
                    made.append(b" ".join(new if x == term else x for x in parts))
            if made:
                total += np.mean([(score(t) - score(m)) ** 2 for m in made])
        return total / len(texts)

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array([0] * len(texts), pa.int32())], names=["text", "label"])
    out = next(toxicity._indices(vocab, others)(iter([batch])))
    ints = lambda k: [np.frombuffer(x, np.int32) for x in out.column(k).to_pylist()]
    cols, owner = np.concatenate(ints(1)), np.repeat(np.arange(len(texts)), [len(x) for x in ints(1)])
    swaps = toxicity.Swaps(cols, owner, len(texts), ints(2), ints(3))
    value, grad = swaps.value_and_grad(w)
    assert abs(value - by_hand()) < 1e-9
    for k in rng.choice(len(w), 25, replace=False):
        kept = w[k]
        w[k] = kept + 1e-5
        up = by_hand()
        w[k] = kept - 1e-5
        down = by_hand()
        w[k] = kept
        assert abs((up - down) / 2e-5 - grad[k]) < 1e-6


def test_gap_and_accuracy_with_and_without_the_penalty(spark):
    """On held-out templates the gap falls, on held-out sentences accuracy stays."""
    plain, fair = (toxicity.fit(_bad_words(spark, "muslims"), counterfactual=c) for c in (0.0, 5.0))
    right = lambda m: np.mean([toxicity.score_text(m, b"those people are vile scum") > 0.5, toxicity.score_text(m, b"a crowd met in town yesterday") < 0.5])
    print(f"gap {toxicity.gap(plain):.3f} without, {toxicity.gap(fair):.3f} with; accuracy {right(plain):.2f}, {right(fair):.2f}")
    assert toxicity.gap(fair) < 0.3 * toxicity.gap(plain) and right(fair) == 1 >= right(plain)


def test_toxicity_query(spark):
    """The registered query: every document, held-out rows by their fold, accuracy on them."""
    import zlib

    sf = "/root/testdata/sf0.01"
    got = queries.op1_toxicity(spark, sf).cache()
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in got.collect())
    held = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    assert held.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.9


def test_stems(spark):
    m = toxicity.fit(_bad_words(spark, "people"))
    assert toxicity.score_text(m, b"scummy vileness") > 5 * toxicity.score_text(m, b"met in town")


def test_toxicity_odd_rows(spark, odd, nothing):
    model = toxicity.fit(_bad_words(spark, "people"))
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(nothing, model).count() == 0
    empty = toxicity.fit(nothing.withColumn("label", F.lit(1)))
    assert {r["score"] for r in toxicity.score(odd, empty).collect()} == {toxicity.score_text(empty, b"")}
    s = [r["score"] for r in toxicity.score(odd, model).filter("doc_id = 8").collect()]
    assert len(s) == 3 and len(set(s)) == 1


def test_labels_with_odd_rows(spark, odd):
    labels = spark.createDataFrame([(None, 1), (3, None), (4, 1), (6, 0), (6, 0)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(odd, labels, "toxic", 10, 5, 0, "t")
    assert {r["doc_id"] for r in got.collect()} <= {4, 6}


def test_languages(spark):
    got = queries.op2_langid(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right = got.join(docs, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_votes_by_hand(spark):
    """The family by the largest margin, then every pair's duel counted one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null").select("text", "lang")
    model = langid.fit(docs)
    for r in docs.limit(60).collect():
        p = langid.profile(r["text"] or "")
        margin = lambda w, p=p: sum(float(a) * float(b) for a, b in zip(p, w[:-1], strict=True) if a) + float(w[-1])
        family = model["names"][0]
        if model["family"] is not None:
            family = max(zip(model["names"], map(margin, model["family"]), strict=True), key=lambda x: x[1])[0]
        members, votes, total = sorted(model["families"][family]), {}, {}
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                m = margin(model["pairs"][a, b])
                votes[a if m >= 0 else b] = votes.get(a if m >= 0 else b, 0) + 1
                total[a], total[b] = total.get(a, 0) + m, total.get(b, 0) - m
        want = sorted(members, key=lambda g: (-votes.get(g, 0), -total.get(g, 0), g))[0]
        got = langid.predict(model, r["text"])
        assert got[0] == (want if r["text"] and any(c.isalpha() for c in r["text"]) else "und")


def test_language_odd_rows(spark, odd, nothing):
    model = langid.fit(spark.createDataFrame([("the house is here", "en"), ("das haus ist hier", "de"), ("la maison est ici", "fr"), ("quux zork blip", "zz"), ("x", None)] * 5, "text string, lang string"))
    assert set(model["families"]) == {"germanic", "romance", "own-zz"} and ("de", "en") in model["pairs"]
    rows = {r["doc_id"]: r for r in langid.identify(odd, model).collect() if r["doc_id"] is not None}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (0, 1, 2, 15)) and rows[5]["lang_pred"] in ("en", "de", "fr", "zz")
    assert langid.identify(nothing, model).count() == 0
    assert langid.predict(langid.fit(nothing), "text") == ("und", 0.0)


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9


def test_pairwise_loss_by_loops(spark):
    """The learned weights are a minimum of the plain sum of logistic losses over the pairs, and scores are its linear form."""
    rows = [(i, ("good plain words in a row, and so on. " if i % 3 else "a b c d e f g. ") * (1 + i % 5), 1) for i in range(30)] + [(100 + i, "### $$$ !!! " * (2 + i % 4) + "word " * (i % 7), 0) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(df, n_pairs=300, steps=3000)
    x = np.array([quality.features(t.encode()) for _, t, _ in rows])
    y = np.array([l for _, _, l in rows])
    order = np.lexsort([*x.T, y])
    f, y = quality.expand(model, x[order]), y[order]
    rng = np.random.default_rng(7)
    good, bad = rng.choice(np.flatnonzero(y == 1), 300), rng.choice(np.flatnonzero(y == 0), 300)

    def loss(w):
        total = 0.0
        for g, b in zip(good, bad, strict=True):
            total += np.log1p(np.exp(-float((f[g] - f[b]) @ w)))
        return total / 300 + 0.5e-4 * float(w @ w)

    least = loss(model["w"])
    for _ in range(30):
        assert least <= loss(model["w"] + rng.normal(scale=0.02, size=len(model["w"]))) + 1e-6
    assert all(f[g] @ model["w"] > f[b] @ model["w"] for g, b in zip(good, bad, strict=True))


def test_quality_is_a_quantile_rule(spark):
    rows = [(i, "good plain words in a row, and so on. " * (1 + i % 5), 1) for i in range(40)] + [(100 + i, "### $$$ !!! " * (5 + i), 0) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(df)
    assert abs(model["quantile"] - 0.2) < 1e-9
    scores = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    assert all((scores[i] >= 0.3) == (y == 1) for i, _, y in rows)
    assert quality.keep(df, model).count() == 40 and quality.keep(df, model).columns == df.columns


def test_quality_odd_rows(odd, nothing):
    model = quality.fit(nothing.withColumn("label", F.lit(1)))
    assert {r["score"] for r in quality.score(odd, model).collect()} == {0.5}
    assert quality.score(nothing, model).count() == 0 and quality.keep(odd, model).count() == odd.count()
    assert all(np.isfinite(quality.features(t)).all() for t in (b"", b" ", b"\x00", b"a" * 100_000))
