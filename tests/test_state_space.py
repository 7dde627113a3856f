"""Drifting lines against the plain recursion, one row at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterline.operators import state_space as ss
from raterline.operators.ordered import packed_runs


def plain(x, y, m, v, d, pull=None):
    """(errors, last state, log likelihood) of the textbook filter."""
    c, mean, p, f, q = np.array(m), np.array(m, float), np.diag(v).astype(float), np.diag(d.rho), np.diag(d.q)
    errors, total = [], 0.0
    for a, b in zip(x, y):
        mean, p = c + f @ (mean - c), f @ p @ f.T + q
        h = np.array([1.0, a])
        s, e = h @ p @ h + d.noise, b - h @ mean
        errors.append(e)
        total -= 0.5 * (np.log(2 * np.pi * s) + e * e / s)
        k = p @ h / s
        mean, p = mean + k * e, (np.eye(2) - np.outer(k, h)) @ p
        if pull is not None:
            w = np.array(pull) / (np.array(pull) + np.diag(p))
            mean = w * mean + (1 - w) * c
    return np.array(errors), mean, total


def raters(sizes, d, seed=1):
    rng = np.random.default_rng(seed)
    out = {}
    for r, n in enumerate(sizes):
        m = np.array([0.3, 0.7])
        s, xs, ys = m + rng.normal(size=2) * 0.5, [], []
        for _ in range(n):
            s = m + np.array(d.rho) * (s - m) + rng.normal(size=2) * np.sqrt(d.q)
            xs.append(rng.normal())
            ys.append(s[0] + s[1] * xs[-1] + rng.normal() * d.noise**0.5)
        out[r] = (np.array(xs), np.array(ys))
    return out


DRIFT = ss.Drift((0.9, 0.97), (0.05, 0.02), 0.4)


@pytest.fixture(scope="module")
def data():
    """Many short raters, and one with most of all rows."""
    return raters([*([7, 1, 30, 12] * 5), 900], DRIFT)


def frame(spark, data):
    rows = [(r, t, r * 10_000 + t, float(x), float(y)) for r, (xs, ys) in data.items() for t, (x, y) in enumerate(zip(xs, ys))]
    return spark.createDataFrame(rows, "rater long, ts long, obs_id long, x double, y double").repartition(5)


def prior_frame(spark, data):
    return spark.createDataFrame([(r, 0.3, 0.7, 0.25, 0.16) for r in data], "rater long, m_intercept double, m_slope double, v_intercept double, v_slope double")


@pytest.fixture(scope="module")
def runs(spark, data):
    return ss.drift_runs(frame(spark, data), prior_frame(spark, data), size=16)


def test_a_long_rater_is_in_many_runs_and_tasks(runs, data):
    rows = runs.where("rater = 20").select("part", "first", F.size("x").alias("n"), "alone").collect()
    assert len({r.part for r in rows}) > 1 and max(r.n for r in rows) <= 16 and sum(r.n for r in rows) == 900 and not any(r.alone for r in rows)
    ordered = runs.where("rater = 20").orderBy("part", "first").select("x").collect()
    assert np.allclose(np.concatenate([r.x for r in ordered]), data[20][0])


def theta(d):
    rho = np.array(d.rho)
    return ss._theta(np.log(d.q), np.log(d.noise), np.log(rho / (1 - rho)))


def test_likelihood_and_gradient(runs, data):
    got = ss.likelihood(runs, theta(DRIFT))
    assert got[0] == pytest.approx(sum(plain(x, y, (0.3, 0.7), (0.25, 0.16), DRIFT)[2] for x, y in data.values()), abs=1e-9 * abs(got[0]) + 1e-8)
    at = np.array([*np.log(DRIFT.q), np.log(DRIFT.noise), *(np.log(r / (1 - r)) for r in DRIFT.rho)])

    def value(p):
        d = ss.Drift(tuple(1 / (1 + np.exp(-p[3:]))), tuple(np.exp(p[:2])), float(np.exp(p[2])))
        return sum(plain(x, y, (0.3, 0.7), (0.25, 0.16), d)[2] for x, y in data.values())

    numeric = [(value(at + e) - value(at - e)) / 2e-5 for e in np.eye(5) * 1e-5]
    assert np.allclose(got[1:], numeric, rtol=1e-5, atol=1e-4)


@pytest.mark.parametrize("pull", [None, (0.5, 0.2)])
def test_filter_equals_the_recursion(runs, data, pull):
    got = {r.rater: r for r in ss.kalman(runs, DRIFT, pull=pull).collect()}
    assert len(got) == len(data)
    for r, (x, y) in data.items():
        errors, last, _ = plain(x, y, (0.3, 0.7), (0.25, 0.16), DRIFT, pull)
        assert got[r].n == len(x)
        assert (got[r].intercept, got[r].slope, got[r].rmse) == pytest.approx((*last, np.sqrt(np.mean(errors**2))), abs=1e-9)


def test_combining_is_associative():
    rng = np.random.default_rng(3)
    x, y, size = rng.normal(size=30), rng.normal(size=30), np.array([10, 10, 10])
    e = ss.runs_elements(x, y, size, np.full((2, 3), 0.2), theta(DRIFT))
    a, b, c = (e[:, :, [i]] for i in range(3))
    one = ss.runs_elements(x, y, np.array([30]), np.full((2, 1), 0.2), theta(DRIFT))
    left, right = ss.combined(ss.combined(a, b), c), ss.combined(a, ss.combined(b, c))
    assert np.allclose(left, right, atol=1e-9) and np.allclose(left, one, atol=1e-9)
    joined, first = ss.combined_runs(e, np.array([4, 4, 4]))
    assert first.tolist() == [0] and np.allclose(joined, one, atol=1e-9)


def test_parameters_are_recovered(spark):
    walk = ss.Drift((1.0, 1.0), (0.04, 0.01), 0.5)
    known = raters([60] * 120 + [3000], walk, seed=5)
    runs = ss.drift_runs(frame(spark, known), prior_frame(spark, known), size=256)
    got = ss.fit_drift(runs, ss.Drift((1.0, 1.0), (0.005, 0.005), 1.0))
    assert got.converged and got.evaluations < 40 and got.rho == (1.0, 1.0)
    assert got.q == pytest.approx(walk.q, rel=0.25) and got.noise == pytest.approx(0.5, rel=0.05)
    known = raters([60] * 120 + [3000], ss.Drift((0.8, 0.9), (0.2, 0.05), 0.5), seed=6)
    runs = ss.drift_runs(frame(spark, known), prior_frame(spark, known), size=256)
    got = ss.fit_drift(runs, ss.Drift((0.9, 0.9), (0.05, 0.05), 1.0), reverting=True)
    assert got.converged and got.rho == pytest.approx((0.8, 0.9), abs=0.06) and got.q == pytest.approx((0.2, 0.05), rel=0.35) and got.noise == pytest.approx(0.5, rel=0.08)


def test_arms_on_drifting_raters(spark):
    known = raters([50] * 60, ss.Drift((1.0, 1.0), (0.1, 0.02), 0.3), seed=7)
    timed = frame(spark, known).withColumn("held_out", F.col("ts") >= 40)
    got = {r.arm: r.rmse for r in ss.time_varying_arms(timed).collect()}
    assert set(got) == {"population", "shrunk", "walk", "reverting", "anchored", "pulled"}
    assert got["walk"] < 0.9 * got["shrunk"] and got["walk"] < 0.9 * got["population"]


def test_empty_and_string_keys(spark, data):
    none = frame(spark, {0: data[0]}).limit(0)
    runs = ss.drift_runs(none, prior_frame(spark, {0: data[0]}))
    assert ss.likelihood(runs, theta(DRIFT)).tolist() == [0.0] * 6 and ss.kalman(runs, DRIFT).count() == 0
    named = frame(spark, {k: data[k] for k in (0, 1)}).withColumn("rater", F.concat(F.lit("r"), F.col("rater")))
    got = packed_runs(named, "rater", ["ts"], ["x"], size=3).collect()
    assert sorted((r.rater, len(r.x)) for r in got if r.rater == "r1") == [("r1", 1)] and sum(len(r.x) for r in got) == 8


def test_observations_are_made_once(spark, sf_dir, monkeypatch):
    """Priors, start and runs read stored rows: the source's text is parsed once however often they are read."""
    from raterline.plans import QUERIES, models

    made = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda v: made.add(1) or v, "double").asNondeterministic()
    real = models.events
    monkeypatch.setattr(models, "events", lambda *a: real(*a).withColumn("y", counted("y")))
    monkeypatch.setattr(models.state_space, "fit_drift", lambda runs, start: start)
    assert QUERIES["t1_kalman_filter"](spark, sf_dir).count() > 0
    assert made.value == real(spark, sf_dir).count()
