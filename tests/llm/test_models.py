"""Trained operators on held-out rows, and their defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterline.llm import language_id, quality, toxicity
from raterline.llm.common import fold_of
from raterline.llm.queries import QUERIES
from raterline.llm.sampling import by_class

LARGER = "/root/testdata/sf0.1"


def accuracy(df, label, predicted, where="held_out"):
    r = df.where(where).where(f"{label} is not null").agg(F.avg((F.col(label) == F.col(predicted)).cast("double"))).head()
    return r[0]


def test_language(spark):
    d = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op9_language_id"](spark, LARGER)
    assert out.count() == d.count()
    assert accuracy(out.join(d, "doc_id"), "lang", "lang_pred") > 0.98


def recall_and_taken(df, label, predicted):
    """Held out: the share of label 1 that is predicted, and the share of label 0 that is too."""
    rate = lambda v: F.avg(F.when(F.col(label) == v, F.col(predicted).cast("double")))
    return tuple(df.where("held_out").agg(rate(1), rate(0)).head())


def test_quality_and_toxicity(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    q, t = QUERIES["op4_quality"](spark, LARGER), QUERIES["op10_toxicity"](spark, LARGER)
    good, bad = recall_and_taken(q.join(labels, "doc_id"), "quality", "predicted")
    assert good > 0.97 and bad < 0.05
    caught, taken = recall_and_taken(t.join(labels, "doc_id"), "toxic", "predicted")
    assert caught > 0.9 and taken < 0.03
    assert q.agg(F.min("score") >= 0, F.max("score") <= 1).head()[:] == (True, True)


def test_prior_is_that_of_the_unlabelled():
    """Positives and unlabelled sets of a known mixture: the prior comes out, without any clean example."""
    rng = np.random.default_rng(1)
    def make(toxic):
        s = rng.integers(100, 3000, 30)
        return np.unique(np.append(s, rng.integers(0, 40, 6)) if toxic else s)
    y = np.array([1] * 300 + [0] * 1500)
    sets = [make(True) for _ in range(300)] + [make(rng.random() < 0.2) for _ in range(1500)]
    m = toxicity.fit_sets(sets, y)
    fresh = [make(k < 200) for k in range(400)]
    z = np.array([m.weights[s].sum() + m.bias for s in fresh])
    assert (z[:200] > 0).mean() > 0.95 and (z[200:] > 0).mean() < 0.05
    z = np.concatenate([rng.normal(3, 1, 500), np.where(rng.random(4000) < 0.15, rng.normal(3, 1, 4000), rng.normal(-3, 1, 4000))])
    assert toxicity.least_ratio(z, np.array([1] * 500 + [0] * 4000), np.ones(4500)) == pytest.approx(0.15, abs=0.03)


def test_every_class_is_learned(spark):
    """More languages than any list of classes would hold, and rows that share a doc_id with labelled ones."""
    rows = [(k, f"q{k}z x{k}w " * 3, f"l{k}") for k in range(1500)] + [(0, "other text", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen = by_class(d, "lang", 5, "s").collect()
    assert len({r.lang for r in chosen}) == 1500 and all(r.text != "other text" for r in chosen)
    many = spark.createDataFrame([(k, "a" * 100, k % 2) for k in range(2000)], "doc_id long, text string, y int")
    few = by_class(many, "y", 1000, "s", most_bytes=10_000).groupBy("y").count().collect()
    assert all(60 < r["count"] < 150 for r in few)


def test_no_class_is_lost_by_size(spark):
    """Languages and labels that only long texts bear are learned; long texts are drawn at a lower share; one row a class at least."""
    english, french = "the dog and the cat run to the house ", "le chien et le chat vont dans la maison "
    rows = [(k, english * 3, "en") for k in range(60)] + [(100 + k, french * 16_000, "fr") for k in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(d)
    assert model.languages == ["en", "fr"]
    odd = spark.createDataFrame([(1, "le chien et le chat"), (2, "the dog and the cat")], "doc_id long, text string")
    assert sorted((r.doc_id, r.lang_pred) for r in language_id.predict(odd, model).collect()) == [(1, "fr"), (2, "en")]
    labels = d.selectExpr("doc_id", "cast(lang = 'fr' as int) as label")
    net = quality.fit(d.select("doc_id", "text"), labels)
    assert isinstance(net, quality.Network)
    scores = {r.doc_id: r.score for r in quality.score(odd, net).collect()}
    assert scores[1] > scores[2]
    sized = spark.createDataFrame([(k, 3_000_000 if k < 40 else 100, 1) for k in range(400)] + [(1000, 0, 2), (1001, 50_000_000, 2), (1002, 40_000_000, 2), (1003, 0, 3)], "doc_id long, size long, y int")
    drawn = by_class(sized, "y", 300, "s", most_bytes=1 << 20).collect()
    assert 0 < sum(r.size for r in drawn if r.y == 1) < 8 << 20
    assert any(r.size == 100 for r in drawn) and {r.y for r in drawn} == {1, 2, 3}
    assert min(r.size for r in drawn if r.y == 2 and r.size) == 40_000_000
    many = spark.range(30_000).selectExpr("id as doc_id", "10 as size", "id div 2 as y")
    assert by_class(many, "y", 5, "s").select("y").distinct().count() == 15_000


def test_training_chunks_are_those_of_scoring():
    import pyarrow as pa

    net = quality.Network(np.zeros((quality.WIDTH, 256, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32), 0.0, np.ones(4))
    for n in (0, 1, 128, 129, 384, 385, 512, 513, 1000, 100_000):
        assert len(net.chunk_logits(pa.array(["a" * n]))[0]) == len(quality.chunk_starts(n))


def test_columns_that_clash(spark):
    d = spark.createDataFrame([(1, "the cat", "keep me", 5, "t", "k")], "doc_id long, text string, score string, predicted int, _text string, rejected string")
    kept = toxicity.without(d, None)
    assert kept.columns == d.columns and kept.head() == d.head()
    assert toxicity.score(d, None).columns == ["doc_id", "text", "_text", "rejected", "score", "predicted"]
    assert quality.score(d, 0.5).columns == ["doc_id", "_text", "rejected", "score", "predicted"]
    assert language_id.predict(d, None).head().asDict() == {"doc_id": 1, "predicted": 5, "_text": "t", "lang_pred": "und", "score": 0.0, "rejected": True}


def test_undetermined(spark, docs, empty):
    learn = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 6)], "doc_id long, text string, lang string")
    model = language_id.fit(learn, sample=20, per_language=2)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "THE DOG AND THE CAT"), (5, "le chien"), (5, "le chien")], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred, r.score > 0) for r in language_id.predict(odd, model).collect())
    assert got == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (5, "fr", True), (5, "fr", True)]
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.fit(learn.limit(0)) is None
    assert language_id.predict(empty, model).count() == 0


def test_models_without_labels(spark, docs, empty):
    none = docs.select("doc_id").limit(0)
    assert toxicity.fit(docs, none, 0.1) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert quality.fit(docs, docs.select("doc_id", F.lit(1).alias("label"))) == 1.0
    assert quality.fit(docs, docs.select("doc_id", F.lit(1).alias("label")).limit(0)) == 0.5
    assert {r.predicted for r in quality.score(docs, 0.5).collect()} == {1}
    assert toxicity.score(empty, None).count() == 0 and quality.score(empty, 0.5).count() == 0


def test_scores_do_not_depend_on_the_batch(docs):
    rng = np.random.default_rng(2)
    net = quality.Network(rng.normal(size=(quality.WIDTH, 256, 4)).astype(np.float32), np.zeros(4, np.float32), rng.normal(size=4).astype(np.float32), 0.1, np.array([0.5, 0.3, 0.2, 0.0]))
    one = {(r.doc_id): r.score for r in quality.score(docs.repartition(1), net).collect()}
    many = {(r.doc_id): r.score for r in quality.score(docs.repartition(7), net).collect()}
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], abs=1e-6) for k in one)
    words = toxicity.WordModel(rng.normal(size=1 << toxicity.BITS).astype(np.float32) / 50, -0.5)
    one = {(r.doc_id): r.score for r in toxicity.score(docs.repartition(1), words).collect()}
    many = {(r.doc_id): r.score for r in toxicity.score(docs.repartition(7), words).collect()}
    assert all(one[k] == pytest.approx(many[k], abs=1e-9) for k in one)


def test_convolution_covers_whole_texts():
    import pyarrow as pa

    taps = np.zeros((quality.WIDTH, 256, 1), np.float32)
    taps[0, ord("#"), 0] = 5
    net = quality.Network(taps, np.zeros(1, np.float32), np.ones(1, np.float32), 0.0, np.array([0, 0, 1.0, 0]))
    for n in (1, 127, 128, 129, 500, 512, 513, 5000):
        for at in {0, n // 2, n - 1}:
            text = "a" * at + "#" + "a" * (n - at - 1)
            assert net.chunk_logits(pa.array([text, "b"]))[0].max() == 5, (n, at)
    assert net.chunk_logits(pa.array(["b" * 50, "#", None, ""]))[0].tolist() == [0, 5, 0, 0]


def test_copies_weigh_once():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 20, 100)) for _ in range(5)]
    w = toxicity.copy_weights([base[0]] * 10 + base[1:] + [np.zeros(0, np.int64)])
    assert np.allclose(w[:10], 0.1) and np.allclose(w[10:], 1)


def test_folds_match_crc32(spark):
    import zlib

    d = spark.range(50).withColumnRenamed("id", "doc_id")
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in d.withColumn("f", fold_of(F.col("doc_id"), 5)).collect())


def test_fitted_toxicity_ignores_common_words():
    rng = np.random.default_rng(0)
    common = [np.unique(rng.integers(0, 300, 60)) for _ in range(400)]
    sets = [np.append(s, 5000 + i % 4) if i < 100 else (np.append(s, 5000 + i % 4) if i % 12 == 0 else s) for i, s in enumerate(common)]
    y = np.array([1] * 100 + [0] * 300)
    m = toxicity.fit_sets(sets, y, 0.1)
    assert all(m.weights[5000 + k] > 1 for k in range(4)) and np.abs(m.weights[:300]).max() < 0.5


def test_cut_has_least_risk_over_all_cuts():
    rng = np.random.default_rng(5)
    y = np.array([1] * 40 + [0] * 200)
    z = np.round(np.where((y == 1) | (rng.random(240) < 0.1), rng.normal(2, 1, 240), rng.normal(-2, 1, 240)), 2)
    each = rng.random(240) + 0.1
    u, p = each * (y == 0) / each[y == 0].sum(), each * (y == 1) / each[y == 1].sum()
    risk = lambda c: 3 * 0.1 * p[z < c].sum() + max(0.0, u[z >= c].sum() - 0.1 * p[z >= c].sum())
    levels = sorted(set(z))
    best = min(risk((a + b) / 2) for a, b in zip(levels, levels[1:]))
    assert abs(risk(toxicity.least_risk_cut(z, y, each, 0.1)) - best) < 1e-12
    assert toxicity.least_risk_cut(np.ones(4), np.array([0, 0, 1, 1]), np.ones(4), 0.1) == 0.0
