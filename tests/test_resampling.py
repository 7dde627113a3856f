"""Bootstraps by counts: totals, distribution, and that they do not depend on how rows lie."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterline.operators import resampling as rs


def frame(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, i % 7, float(a), float(b)) for i, (a, b) in enumerate(rng.gamma(2.0, size=(n, 2)))], "id long, rater long, a double, b double")


def test_tree_deals_out_all_draws():
    before = np.append(0, np.cumsum([5, 0, 3, 1, 7, 4]))
    draws = np.full(300, 20)
    each = [rs.draws_of(leaf, before, draws, 3) for leaf in range(6)]
    assert (sum(each) == 20).all() and (each[1] == 0).all()
    # Multinomial: means and covariances of counts.
    many = np.array([rs.draws_of(leaf, before, np.full(20_000, 20), 4) for leaf in range(6)])
    p = np.diff(before) / 20
    assert np.allclose(many.mean(axis=1), 20 * p, atol=0.1)
    assert np.allclose(np.cov(many), 20 * (np.diag(p) - np.outer(p, p)), atol=0.2)


@pytest.mark.parametrize("bucket_rows", [1 << 16, 16])
def test_sums_have_the_bootstrap_distribution(spark, bucket_rows):
    d = frame(spark)
    x = np.array([[r.a, r.b] for r in d.collect()])
    got = rs.resampled_sums(d, ["a", "b"], 3000, 5, id_columns=["id"], bucket_rows=bucket_rows)
    assert (got[:, 2] == 400).all()
    mean = got[:, :2] / 400
    assert np.allclose(mean.mean(axis=0), x.mean(axis=0), atol=4 * x.std(axis=0).max() / np.sqrt(400 * 3000))
    assert np.allclose(np.cov(mean.T), np.cov(x.T, bias=True) / 400, rtol=0.12, atol=2e-4)
    again = rs.resampled_sums(d.repartition(7), ["a", "b"], 3000, 5, id_columns=["id"], bucket_rows=bucket_rows)
    assert np.allclose(got, again)


@pytest.mark.parametrize("size", [4096, 8])
def test_within_raters(spark, size):
    """Short raters and such as lie in many runs: the spread is that of a plain bootstrap of each rater."""
    d = frame(spark, 210, 2)
    f = lambda m: 1 - np.sqrt(m[..., 1] / m[..., 0])
    got, n = rs.within(d, ["a", "b"], 2000, 9, f, size=size)
    assert n == 7 and len(got) == 2000
    rng = np.random.default_rng(3)
    x = {r: np.array([[q.a, q.b] for q in d.where(F.col("rater") == r).collect()]) for r in range(7)}
    plain = np.array([np.mean([f(v[rng.integers(0, len(v), len(v))].mean(axis=0)) for v in x.values()]) for _ in range(2000)])
    assert got.mean() == pytest.approx(plain.mean(), abs=5 * plain.std() / 2000**0.5) and got.std() == pytest.approx(plain.std(), rel=0.12)


def test_shuffled_rows_do_not_grow_with_replicates(spark):
    d = frame(spark, 2000)

    def shuffled(replicates):
        store = spark.sparkContext._jsc.sc().statusStore()
        gateway = spark.sparkContext._gateway
        stages = lambda: (lambda s: [s.apply(i) for i in range(s.size())])(store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None))
        before = {s.stageId() for s in stages()}
        rs.resampled_sums(d, ["a"], replicates, 1, id_columns=["id"])
        # All but the sums themselves: one row a replicate and task, and one to order them.
        return sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before) - 5 * replicates

    assert shuffled(2000) <= shuffled(50) + 100


def test_binomial_pairs_and_empty(spark):
    d = rs.binomial_difference(0.6, 500, 0.7, 400, 20_000, 1)
    assert d.mean() == pytest.approx(0.1, abs=0.002) and d.std() == pytest.approx((0.24 / 500 + 0.21 / 400) ** 0.5, rel=0.05)
    assert rs.interval(d)[2] == 20_000 and rs.interval(np.array([np.nan]))[2] == 0
    none = frame(spark).limit(0)
    assert (rs.resampled_sums(none, ["a"], 10, 1, id_columns=["id"]) == 0).all()
    assert rs.within(none, ["a", "b"], 10, 1, lambda m: m[..., 0])[1] == 0


def test_folds_are_made_once(spark, sf_dir, monkeypatch):
    """Lines and row errors read stored folds; and a replicate's sums are those of the rows it draws."""
    from raterline.plans import QUERIES, models

    made = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda v: made.add(1) or v, "double").asNondeterministic()
    real = models.event_folds
    monkeypatch.setattr(models, "event_folds", lambda *a: real(*a).withColumn("y", counted("y")))
    monkeypatch.setattr(models, "REPLICATES", 20)
    assert QUERIES["b3_other_resampling"](spark, sf_dir).count() == 4
    assert made.value == real(spark, sf_dir).count()
    x, draws = np.random.default_rng(1).gamma(2.0, size=(9, 2)), np.array([0, 3, 9, 0, 14] * 40)
    at = np.split(rs._random(1, 2).integers(0, 9, draws.sum()), np.cumsum(draws)[:-1])
    assert np.allclose(rs.drawn_sums(x, draws, rs._random(1, 2)), [x[i].sum(axis=0) for i in at])
