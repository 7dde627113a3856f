"""Distributions against closed forms, tests of normality against plain numpy, small operators on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterline.functions import distributions as dist
from raterline.operators import diagnostics, inference, normality
from raterline.plans import QUERIES


def test_student_and_f_tails(spark):
    rows = [(t, float(df)) for t in (0.0, 0.1, 1.0, 2.5, 7.0, 40.0) for df in (1, 2, 3, 4, 9, 30, 401, 5000)]
    for r in spark.createDataFrame(rows, "t double, df double").withColumn("p", dist.student_p(F.col("t"), F.col("df"))).collect():
        assert r.p == pytest.approx(inference.student_tail(r.t, int(r.df)), abs=1e-11)
    assert inference.student_tail(1.0, 1) == pytest.approx(0.5) and inference.student_tail(3.0, 2) == pytest.approx(1 - 3 / math.sqrt(11))
    # Tabulated: two-sided 5 % points.
    assert [round(inference.student_tail(t, d), 4) for t, d in ((12.7062, 1), (2.5706, 5), (2.0423, 30))] == [0.05] * 3
    rows = [(f, v) for f in (0.2, 1.0, 3.0, 9.0) for v in (3.0, 10.0, 500.0)]
    for r in spark.createDataFrame(rows, "f double, v double").withColumn("p", dist.f_p(F.col("f"), F.lit(2.0), F.col("v"))).collect():
        assert r.p == pytest.approx((1 + 2 * r.f / r.v) ** (-r.v / 2), abs=1e-11)
    empty = spark.range(1).select(dist.student_p(F.lit(1.0), F.lit(0.0)).alias("a"), dist.f_p(F.lit(1.0), F.lit(0.0), F.lit(3.0)).alias("b")).head()
    assert empty.a is None and empty.b is None


def test_normal_and_chi_square(spark):
    z = spark.createDataFrame([(x,) for x in (-6.0, -1.96, -0.3, 0.0, 0.5, 1.0, 2.0, 5.0, 9.0)], "z double")
    for r in z.select("z", dist.normal_tail(F.col("z")).alias("p"), dist.normal_quantile(dist.normal_tail(-F.col("z"))).alias("q")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), rel=1e-10)
        assert r.z > 5 or r.q == pytest.approx(r.z, abs=1e-7)
    for r in spark.createDataFrame([(x,) for x in (0.0, 0.1, 3.0, 9.0, 60.0)], "x double").select("x", dist.chi_square_p(F.col("x"), 2).alias("two"), dist.chi_square_p(F.col("x"), 6).alias("six")).collect():
        h = r.x / 2
        assert r.two == pytest.approx(math.exp(-h), rel=1e-11) and r.six == pytest.approx(math.exp(-h) * (1 + h + h * h / 2), rel=1e-10)
    gamma = spark.createDataFrame([(x,) for x in (0.5, 1.0, 4.5, 30.0, 1000.0)], "x double").select("x", dist.log_gamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12) for r in gamma)


def test_t_interval():
    mean, low, high = inference.t_interval([1.0, 2.0, 3.0, 4.0, 5.0])
    assert mean == 3 and high - mean == pytest.approx(2.776445 * math.sqrt(2.5 / 5), rel=1e-6) and mean - low == pytest.approx(high - mean)
    assert math.isnan(inference.t_interval([1.0])[1]) and math.isnan(inference.t_interval([])[0])


def samples():
    rng = np.random.default_rng(7)
    return {"normal": rng.normal(3, 2, 300), "skewed": rng.exponential(size=200), "small": rng.normal(size=14), "ties": np.round(rng.normal(size=250), 1)}


def quantile(p):
    low, high = -10.0, 10.0
    for _ in range(80):
        m = (low + high) / 2
        low, high = (m, high) if 0.5 * math.erfc(-m / math.sqrt(2)) < p else (low, m)
    return low


def shapiro(x):
    """Royston's approximation, from sorted values."""
    x, n = np.sort(x), len(x)
    m = np.array([quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u = 1 / math.sqrt(n)
    a = m.copy()
    a[-1] = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(m @ m)], u)
    a[-2] = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(m @ m)], u)
    phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
    a[2:-2] /= math.sqrt(phi)
    a[0], a[1] = -a[-1], -a[-2]
    w = (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()
    l = math.log(n)
    z = (math.log(1 - w) - np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], l)) / math.exp(np.polyval([0.0030302, -0.082676, -0.4803], l))
    return w, 0.5 * math.erfc(z / math.sqrt(2))


def anderson(x):
    z, n = np.sort((x - x.mean()) / x.std(ddof=1)), len(x)
    f = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    i = np.arange(1, n + 1)
    return -n - ((2 * i - 1) * (np.log(f) + np.log(1 - f[::-1]))).sum() / n


@pytest.mark.parametrize("name", ["normal", "skewed", "small", "ties"])
def test_order_tests(spark, name):
    x = samples()[name]
    got = normality.order_tests(spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double").repartition(3), "v").head()
    w, p = shapiro(x)
    assert got.n == len(x) and got.anderson == pytest.approx(anderson(x), abs=1e-6)
    assert got.shapiro == pytest.approx(w, abs=1e-6) and got.p_shapiro == pytest.approx(p, abs=2e-5)
    assert (got.p_anderson < 1e-4) == (name == "skewed") == (got.p_shapiro < 1e-4)


def test_moment_tests(spark):
    for name, x in list(samples().items())[:2]:
        got = normality.moment_tests(spark.createDataFrame([(float(v),) for v in x], "v double"), "v").head()
        d = x - x.mean()
        g1, g2, n = (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3, len(x)
        assert got.jarque_bera == pytest.approx(n / 6 * (g1**2 + g2**2 / 4)) and got.p_jarque_bera == pytest.approx(math.exp(-got.jarque_bera / 2), abs=1e-12)
        assert got.p_k2 == pytest.approx(math.exp(-got.k2 / 2), abs=1e-12) and (got.p_k2 < 1e-4) == (name == "skewed")


@pytest.mark.parametrize("k", [1, 3])
def test_mardia_equals_all_pairs(spark, k):
    x = np.random.default_rng(k).gamma(3.0, size=(90, k)) @ np.triu(np.ones((k, k)))
    names = [f"v{i}" for i in range(k)]
    got = normality.mardia(spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None,) * k], ", ".join(f"{c} double" for c in names)), names).head()
    d = x - x.mean(axis=0)
    g = d @ np.linalg.inv(np.atleast_2d(np.cov(x.T))) @ d.T
    b1, b2 = (g**3).mean(), (np.diag(g) ** 2).mean()
    assert got.n == 90 and got.b1 == pytest.approx(b1) and got.b2 == pytest.approx(b2)
    assert got.skewness == pytest.approx(90 * b1 / 6) and got.kurtosis == pytest.approx((b2 - k * (k + 2)) / math.sqrt(8 * k * (k + 2) / 90))
    assert got.p_kurtosis == pytest.approx(math.erfc(abs(got.kurtosis) / math.sqrt(2)), abs=1e-10)


def test_degenerate_values(spark):
    flat = spark.createDataFrame([(1.0, 2.0)] * 20, "a double, b double")
    assert normality.mardia(flat, ["a", "b"]).head().b1 is None
    assert normality.order_tests(flat, "a").head().shapiro is None and normality.order_tests(flat.limit(0), "a").head().n == 0


def test_quantiles_by_plain_interpolation(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 4), int(rng.integers(0, 3)), float(rng.integers(0, 12))) for i in range(200)] + [(900, 9, 0, 1.0)]
    got = {r.obs_id: r for r in diagnostics.quantile_matched(spark.createDataFrame(rows, "obs_id int, rater int, fold int, x double"), 3).collect()}
    population = np.sort([r[3] for r in rows])
    for i, rater, fold, x in rows:
        train = np.sort([r[3] for r in rows if r[1] == rater and r[2] != fold])
        if not len(train):
            assert got[i].u is None and got[i].matched is None
            continue
        u = np.interp(x, train, (np.arange(len(train)) + 0.5) / len(train))
        assert got[i].u == pytest.approx(u) and got[i].matched == population[min(max(int(u * len(population)), 0), len(population) - 1)]


def test_levels(spark):
    runs = spark.createDataFrame([("a", n, v) for n, v in ((1, 5.0), (2, 4.0), (3, 3.0))] + [("b", n, v) for n, v in ((1, 5.0), (2, 4.0), (3, 6.0), (4, 5.0), (5, 4.0), (6, 3.0))] + [("c", 1, 1.0)], "arm string, size int, v double")
    got = {r.arm: (r.levels, r.always_falls, r.always_rises, r.longest_fall) for r in diagnostics.along_levels(runs, "arm", "size", "v").collect()}
    assert got == {"a": (3, True, False, 2), "b": (6, False, False, 3), "c": (1, False, False, 0)}


def test_small_tests_over_seeds(spark, sf_dir):
    r = QUERIES["b7_small_tests"](spark, sf_dir).head()
    assert r.n == 5 and r.low <= r.mean <= r.high and 0 <= r.p_t <= 1 and r.p_sign in (0.0625, 0.375, 1.0) and 1 / 32 <= r.p_permutation <= 1
