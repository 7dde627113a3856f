"""Preference models against refits in numpy, one rater and fold at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterline.operators import preference as pr
from raterline.operators import shrinkage, splits
from raterline.plans import QUERIES, models


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    z = models._conversations(spark, sf_dir).select("rater", "conversation", "fold", "grp", "x", "y").collect()
    out = {}
    for r in z:
        out.setdefault(r.rater, []).append(r)
    return out


@pytest.fixture(scope="module")
def pairs(events):
    """rater -> (differences of powers, fold)."""
    out = {}
    for rater, rows in events.items():
        d, f = [], []
        for c in rows:
            for r in rows:
                if c.grp == "purchase" and r.grp == "view" and c.conversation == r.conversation:
                    d.append(pr.powers(np.array([c.x]))[0] - pr.powers(np.array([r.x]))[0])
                    f.append(c.fold)
        if d:
            out[rater] = np.array(d), np.array(f)
    return out


@pytest.fixture(scope="module")
def runs(spark, events):
    """The same pairs in short runs over many tasks."""
    rows = [(c.rater, c.fold, c.x, r.x) for own in events.values() for c in own for r in own if c.grp == "purchase" and r.grp == "view" and c.conversation == r.conversation]
    return pr.pair_runs(spark.createDataFrame(rows, "rater long, fold int, chosen_x double, rejected_x double").repartition(6), folds=5, size=3)


def refit(d, ridge=0.1):
    w = np.zeros(pr.DEGREE)
    if not len(d):
        return w
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + ridge * w @ w / 2
    for _ in range(200):
        s = 1 / (1 + np.exp(d @ w))
        g = -(d * s[:, None]).mean(axis=0) + ridge * w
        step = -np.linalg.solve((d * (s * (1 - s))[:, None]).T @ d / len(d) + ridge * np.eye(pr.DEGREE), g)
        while loss(w + step) > loss(w) + 1e-14:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-11:
            break
    return w


def test_weights_of_every_fold(runs, pairs):
    got = {r.rater: np.array(r.w).reshape(5, pr.DEGREE) for r in pr.fold_weights(runs).collect()}
    assert got.keys() == pairs.keys()
    for rater, (d, f) in pairs.items():
        for k in range(5):
            assert np.allclose(got[rater][k], refit(d[f != k]), atol=1e-6), (rater, k)


def held_out(pairs, weights):
    return {r: (len(d), float(np.mean([np.logaddexp(0, -x @ weights[r][k]) for x, k in zip(d, f)]))) for r, (d, f) in pairs.items()}


def test_held_out_pairs_and_ratings(spark, sf_dir, pairs, events):
    got = {r.rater: r for r in QUERIES["k7_polynomial_preferences"](spark, sf_dir).collect()}
    weights = {r: [refit(d[f != k]) for k in range(5)] for r, (d, f) in pairs.items()}
    want = held_out(pairs, weights)
    assert got.keys() == want.keys()
    for rater, (n, loss) in want.items():
        assert got[rater].n == n and got[rater].log_loss == pytest.approx(loss, abs=2e-6)
        sse, steady, folds = 0.0, 0, 0
        x, y, fold = (np.array([getattr(r, c) for r in events[rater]]) for c in ("x", "y", "fold"))
        for k in sorted(set(fold)):
            score = pr.powers(x) @ weights[rater][k]
            s, t = score[fold != k], y[fold != k]
            a, b, ok = (t.mean() if len(t) else 0.0), 0.0, False
            if len(s) >= 3 and s.std() >= 1e-8:
                slope = ((s - s.mean()) * (t - t.mean())).mean() / s.var()
                if abs(slope) * s.std() <= 5 * (t.std() + 1e-8):
                    a, b, ok = t.mean() - slope * s.mean(), slope, True
            sse += ((y[fold == k] - a - b * score[fold == k]) ** 2).sum()
            steady, folds = steady + ok, folds + 1
        assert got[rater].rmse == pytest.approx((sse / len(y)) ** 0.5, abs=1e-5) and got[rater].steady == pytest.approx(steady / folds, abs=1e-5)


def refit_basis(pairs, k, basis=2, rounds=4, rate=0.3):
    a = np.eye(pr.DEGREE, basis) + 0.1
    w = {r: np.full(basis, 1 / basis) for r in pairs}
    for _ in range(rounds):
        total, n = np.zeros_like(a), 0
        for r, (d, f) in pairs.items():
            d = d[f != k]
            if len(d):
                g, s = d @ a, 1 / (1 + np.exp(d @ a @ w[r]))
                bend = (g * (s * (1 - s))[:, None]).T @ g / len(d)
                bend = bend + (1e-2 * np.trace(bend) + 1e-9) * np.eye(basis)
                first = -(g * s[:, None]).mean(axis=0)
                # Two weights that sum to one: a parabola between 0 and 1.
                e = np.array([1.0, -1.0])
                t = np.clip(-(first @ e) / (e @ bend @ e), -w[r][0], w[r][1])
                w[r] = w[r] + t * e
        for r, (d, f) in pairs.items():
            d = d[f != k]
            s = 1 / (1 + np.exp(d @ a @ w[r])) if len(d) else np.zeros(0)
            total, n = total + np.outer((d * s[:, None]).sum(axis=0), w[r]), n + len(d)
        a = np.clip(a + rate * total / max(n, 1), -5, 5)
    return {r: a @ w[r] for r in pairs}


def test_shared_basis_of_every_fold(runs, pairs):
    a, weights = pr.shared_basis(runs)
    assert a.shape == (5, pr.DEGREE, 2)
    fits = [refit_basis(pairs, k) for k in range(5)]
    want = held_out(pairs, {r: [fits[k][r] for k in range(5)] for r in pairs})
    got = {r.rater: r for r in pr.held_out_pairs(runs, weights).collect()}
    assert all(got[r].n == n and got[r].log_loss == pytest.approx(loss, abs=1e-4) for r, (n, loss) in want.items())


def test_mixtures_are_least_within_the_simplex(spark, sf_dir, events):
    z = models._conversations(spark, sf_dir)
    heads, shared = pr.polynomial_heads(z)
    assert shared.min() >= 0 and shared.sum() == pytest.approx(1)
    got = {}
    for r in pr.head_mixtures(pr.fold_sums(z, 5), heads).collect():
        got[r.rater, r.fold] = r
    grid = [np.array([i, j, 40 - i - j]) / 40 for i in range(41) for j in range(41 - i)]
    for rater, rows in list(events.items())[:6]:
        x, y, fold = (np.array([getattr(r, c) for r in rows]) for c in ("x", "y", "fold"))
        p = np.stack([np.polynomial.polynomial.polyval(np.clip(x, -3, 3), h) for h in heads], axis=1)
        for k in set(fold.tolist()):
            w = np.array(got[rater, k].weights)
            train = lambda w: ((y[fold != k] - p[fold != k] @ w) ** 2).sum()
            assert w.min() >= 0 and w.sum() == pytest.approx(1) and train(w) <= min(map(train, grid)) + 1e-6
            assert got[rater, k].sse == pytest.approx(((y[fold == k] - p[fold == k] @ w) ** 2).sum(), abs=1e-6)


def test_mixture_composed_with_shrinkage(spark):
    """Ratings that bend with the signal: the mixture helps, shrinkage helps, both help most; the parts equal their own evaluations."""
    rng = np.random.default_rng(2)
    rows = []
    for r in range(60):
        a, b = rng.normal(size=2) * 0.6
        for i, x in enumerate(rng.normal(size=20)):
            z = np.clip(x, -3, 3)
            rows.append((r, r * 100 + i, float(x), float(a + (1 + b) * (0.2 * z + 0.8 * z**2) + rng.normal() * 0.3)))
    obs = spark.createDataFrame(rows, "rater long, obs_id long, x double, y double")
    got = pr.composed_arms(obs).head()
    assert got.raters == 60 and got.rmse_mixture < got.rmse_population and got.rmse_shrunk < got.rmse_population
    assert got.rmse_composed < min(got.rmse_mixture, got.rmse_shrunk)
    plain = shrinkage.evaluation(splits.k_folds(obs, 5, 20260420)).head()
    assert got.rmse_population == pytest.approx(plain.rmse_population) and got.rmse_shrunk == pytest.approx(plain.rmse_shrunk)
    heads, weights = pr.polynomial_heads(obs)
    x = np.array([r[2] for r in rows])
    want = np.polynomial.polynomial.polyval(np.clip(x, -3, 3), weights @ heads)
    assert np.allclose([r.h for r in pr.with_mixture(obs, heads, weights, "h").orderBy("obs_id").collect()], want)


def test_projection_and_empty(spark):
    v = np.array([[0.2, 0.3, 0.9], [-1.0, 5.0, 0.0], [0.3, 0.3, 0.4]])
    assert np.allclose(pr.simplex(v).sum(axis=1), 1) and np.allclose(pr.simplex(v)[2], v[2]) and np.allclose(pr.simplex(v[1]), [0, 1, 0])
    none = pr.pair_runs(spark.createDataFrame([], "rater long, fold int, chosen_x double, rejected_x double"))
    assert pr.held_out_pairs(none, pr.fold_weights(none)).count() == 0
    assert pr.held_out_pairs(none, pr.shared_basis(none)[1]).count() == 0
