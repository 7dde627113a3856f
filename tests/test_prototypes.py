"""Two-channel calibrators against a refit in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterline.operators import multivariate, prototypes
from raterline.plans import QUERIES


def test_channels_equal_a_refit(spark):
    rng = np.random.default_rng(5)
    rows = []
    for r in range(24):
        a, b = 3 * (r % 3) + rng.normal() * 0.3, 1 + (r % 3) + rng.normal() * 0.1
        for i in range([2, 6, 12][r % 3] + r % 4):
            x = rng.normal()
            rows.append((r, r * 100 + i, i % 3, float(x), float(a + b * x + rng.normal() * 0.5)))
    d = spark.createDataFrame(rows, "rater int, obs_id int, fold int, x double, y double")
    clusters = spark.createDataFrame([(r, r % 3) for r in range(23)], "rater int, cluster int")
    got = {r.rater: r for r in prototypes.two_channels(d, clusters, m=4, prior=2.0).collect()}
    weights = {r.obs_id: [r[f"w{b}"] for b in range(4)] for r in d.select("obs_id", *(prototypes.poisson_weight(b, "obs_id").alias(f"w{b}") for b in range(4))).collect()}
    data = np.array([r[3:] for r in rows])
    rater, obs, fold = (np.array([r[k] for r in rows]) for k in range(3))
    w = np.array([weights[o] for o in obs])

    def fit(keep, weight=None):
        x, y = data[keep].T
        weight = np.ones(len(x)) if weight is None else weight[keep]
        n = weight.sum()
        mx = (weight * x).sum() / n if n else 0
        spread = (weight * (x - mx) ** 2).sum() if n else 0
        if n < 3 or spread < 1e-10:
            return None
        slope = (weight * (x - mx) * y).sum() / spread
        return (weight * y).sum() / n - slope * mx, slope

    pop = fit(np.ones(len(rows), bool))
    assert got.keys() == set(range(24))
    for r in range(24):
        proto = pop
        if r < 23:
            peers = sum(q % 3 == r % 3 for q in range(23)) - 1
            other = fit((rater % 3 == r % 3) & (rater != r) & (rater < 23)) or pop
            share = peers / (peers + 2.0)
            proto = tuple(share * a + (1 - share) * b for a, b in zip(other, pop))
        sse = {"population": 0.0, "individual": 0.0, "prototype": 0.0, "mixed": 0.0}
        for k in range(3):
            held = (rater == r) & (fold == k)
            if not held.any():
                continue
            own = np.mean([fit((rater == r) & (fold != k), w[:, b]) or pop for b in range(4)], axis=0)
            arms = {"population": pop, "individual": own, "prototype": proto, "mixed": (np.array(own) + proto) / 2}
            for name, (a, b) in arms.items():
                sse[name] += ((data[held, 1] - a - b * data[held, 0]) ** 2).sum()
        for name, v in sse.items():
            assert got[r][f"rmse_{name}"] == pytest.approx((v / (rater == r).sum()) ** 0.5, abs=1e-8), (r, name)


def test_weights_are_poisson(spark):
    w = np.array([r[0] for r in spark.range(20_000).select(prototypes.poisson_weight(3, "id")).collect()])
    assert w.mean() == pytest.approx(1, abs=0.03) and w.var() == pytest.approx(1, abs=0.05) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)


def test_query_and_missing_features(spark, sf_dir):
    r = QUERIES["m4_two_channel_calibrators"](spark, sf_dir).head()
    assert r.raters > 0 and -1 <= r.silhouette <= 1 and min(r.rmse_individual, r.rmse_prototype, r.rmse_mixed) > 0
    d = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "a", 3.0)], "rater int, kind string, v double")
    f = multivariate.encoded(d, ["kind"], ["v"])
    assert f.count() == 3 and {r.rater: r.v for r in f.select("rater", "v").collect()}[2] == 2.0


def test_rows_are_made_once(spark):
    """Folds and features are dear: lines, sums, scaler, k-means and silhouette share what was made of them."""
    made = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda v: made.add(1) or v, "double")
    d = spark.createDataFrame([(r, r * 9 + i, i % 3, float(i * r % 7), float(i + r)) for r in range(20) for i in range(9)], "rater int, obs_id int, fold int, x double, y double")
    clusters = spark.createDataFrame([(r, r % 2) for r in range(20)], "rater int, cluster int")
    assert prototypes.two_channels(d.withColumn("x", counted("x")), clusters, m=3).count() == 20
    assert made.value == 180
    made.value = 0
    features = d.groupBy("rater").agg(F.avg("x").alias("a"), F.avg("y").alias("b"))
    clustered, _ = multivariate.prototypes(features.withColumn("a", counted("a")), ["a", "b"], 2)
    assert clustered.count() == 20 and made.value <= 40  # for its rows, and for a checkpoint of them
