"""The response model: rising bound, known raters, a rater over many tasks, local optima."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterline.operators import response
from raterline.plans.calibration import normal
from raterline.sources.observations import complete, events


def test_bound_rises_and_parameters_come_back(spark, sf_dir):
    """Steepness and midpoints planted on the raters and rows of the given events."""
    e = complete(events(spark, sf_dir)).select("rater", "obs_id", (1.2 * normal("x", F.col("obs_id"))).alias("x"))
    log_a, b = 0.3 + 0.3 * normal("a", F.col("rater")), -0.2 + 0.5 * normal("b", F.col("rater"))
    d = e.withColumns({"log_a0": log_a, "b0": b}).withColumn("y", response.predicted(F.col("x"), F.col("log_a0"), F.col("b0"), 100.0) + 4 * normal("e", F.col("obs_id")))
    m, curves = response.fit(d, size=16)
    assert len(m.bounds) > 3 and all(y >= x - 1e-7 * abs(x) for x, y in zip(m.bounds, m.bounds[1:]))
    assert m.noise == pytest.approx(16, rel=0.1)
    truth = d.groupBy("rater").agg(F.max("log_a0").alias("log_a0"), F.max("b0").alias("b0"))
    t = truth.agg(F.avg("log_a0"), F.avg("b0")).head()
    assert m.mean == pytest.approx([t[0], t[1]], abs=0.06)
    both = curves.join(truth, "rater").agg(F.corr("log_a", "log_a0"), F.corr("b", "b0"), F.sqrt(F.avg(F.pow(F.col("b") - F.col("b0"), 2)))).head()
    assert both[0] > 0.8 and both[1] > 0.97 and both[2] < 0.15


def simulated(sizes, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for r, n in enumerate(sizes):
        log_a, b = rng.normal(0.2, 0.3), rng.normal(0.1, 0.5)
        x = rng.normal(size=n)
        y = response.response(x, log_a, b, 100.0) + rng.normal(size=n) * 5
        rows += [(r, float(u), float(v)) for u, v in zip(x, y)]
    return rows


def test_long_rater_in_many_runs_gives_the_same(spark):
    rows = simulated([12, 1, 25, 8] * 4 + [700])
    d = spark.createDataFrame(rows, "rater int, x double, y double").repartition(5)
    one, many = response.fit(d, tolerance=1e-9), response.fit(d, size=20, tolerance=1e-9)
    assert one[0].bounds == pytest.approx(many[0].bounds, rel=1e-9) and one[0].noise == pytest.approx(many[0].noise, rel=1e-6)
    runs, _ = response.response_runs(d, size=20)
    assert runs.where("rater = 16").select("part").distinct().count() > 1
    # Each rater's q is where its bound is greatest, by trying around it.
    m, curves = many
    for r in curves.orderBy("rater").limit(6).collect():
        x, y = np.array([v[1:] for v in rows if v[0] == r.rater]).T
        q = np.array([[r.log_a, r.b, r.v_log_a, r.covariance, r.v_b]])

        def bound(q):
            s = response.run_sums(x, y, np.zeros(len(x), int), q, m.scale).sum(axis=0)
            return response._bound(np.concatenate([q, s[None], [[1.0]]], axis=1), m)[0]

        best = bound(q)
        for i in range(5):
            for way in (-1, 1):
                other = q.copy()
                other[0, i] += way * (0.02 if i < 2 else 0.05 * abs(q[0, i]) + 1e-5)
                assert bound(other) <= best + 2e-3


def test_defined_cases(spark):
    with pytest.raises(ValueError):
        response.fit(spark.createDataFrame([], "rater int, x double, y double"))
    m, curves = response.fit(spark.createDataFrame([(1, 0.0, 50.0), (2, 0.0, 50.0)], "rater int, x double, y double"))
    assert curves.count() == 2 and np.isfinite(m.bounds).all()


def test_rounds_broadcast_nothing(spark):
    """With raters of one run and of several: no table of raters goes through the driver."""
    d = spark.createDataFrame(simulated([12, 1, 25, 8] * 4 + [200]), "rater int, x double, y double")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    response.fit(d, size=20, rounds=2)
    plans = store.executionsList(int(before), 10_000)
    plans = [plans.apply(i).physicalPlanDescription() for i in range(plans.size())]
    assert len(plans) > 10 and not [p for p in plans if "BroadcastExchange" in p]
