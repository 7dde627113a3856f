"""Tests of normality, from moments and from ranks that no task takes of all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterline.functions import distributions as dist
from raterline.operators.inference import cumulative
from raterline.sources.files import written

#: Royston's polynomials for the two greatest weights, and for mean and spread of log(1 - W).
_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157)
_SECOND = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)
_MEAN = (0.0038915, -0.083751, -0.31082, -1.5861)
_SPREAD = (0.0030302, -0.082676, -0.4803)


def mardia(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Multivariate skewness and kurtosis of complete rows: n, b1, b2, statistics and p.

    Skewness is the squared length of the third-moment tensor of whitened values, a handful of
    averages, so no pair of rows meets.  The covariance is the unbiased one.  A singular
    covariance, or fewer rows than columns + 1, gives null.
    """
    k = len(columns)
    kept = rows.select(*columns).na.drop()
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    first = kept.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_samp(columns[i], columns[j]).alias(f"s{i}_{j}") for i, j in pairs)).head()
    spread = np.zeros((k, k))
    for i, j in pairs:
        spread[i, j] = spread[j, i] = first[f"s{i}_{j}"] if first[f"s{i}_{j}"] is not None else np.nan
    scale = np.sqrt(np.diag(spread))
    if not np.isfinite(spread).all() or not scale.all() or np.linalg.eigvalsh(spread / np.outer(scale, scale))[0] < 1e-12:
        return rows.sparkSession.createDataFrame([(first["n"], *[None] * 6)], "n long, b1 double, b2 double, skewness double, p_skewness double, kurtosis double, p_kurtosis double")
    white = np.linalg.inv(np.linalg.cholesky(spread))
    z = [sum((float(white[i, j]) * (F.col(columns[j]) - first[f"m{j}"]) for j in range(i + 1)), F.lit(0.0)) for i in range(k)]
    cubes = [(i, j, m, 1 if i == j == m else 3 if i == j or j == m else 6) for i in range(k) for j in range(i + 1) for m in range(j + 1)]
    length = sum((v * v for v in z), F.lit(0.0))
    t = kept.agg(F.count("*").alias("n"), *(F.avg(z[i] * z[j] * z[m]).alias(f"c{x}") for x, (i, j, m, _) in enumerate(cubes)), F.avg(length * length).alias("b2"))
    n, b1 = F.col("n"), sum((times * F.col(f"c{x}") * F.col(f"c{x}") for x, (*_, times) in enumerate(cubes)), F.lit(0.0))
    skewness, kurtosis = n * b1 / 6, (F.col("b2") - k * (k + 2)) / F.sqrt(8 * k * (k + 2) / n)
    return t.select("n", b1.alias("b1"), "b2", skewness.alias("skewness"), dist.chi_square_p(skewness, k * (k + 1) * (k + 2) / 6).alias("p_skewness"), kurtosis.alias("kurtosis"), dist.normal_p(kurtosis).alias("p_kurtosis"))


def moment_tests(rows: DataFrame, value: str) -> DataFrame:
    """Jarque-Bera, and D'Agostino's K2 of skewness and kurtosis, each with p; K2 needs eight rows or more.

    Both are chi square with two degrees of freedom, whose tail is exp(-x / 2).
    """
    out = "n long, skewness double, kurtosis double, jarque_bera double, p_jarque_bera double, k2 double, p_k2 double"
    spark = rows.sparkSession
    n, g1, g2 = rows.agg(F.count(value), F.skewness(value), F.kurtosis(value)).head()
    if g1 is None or math.isnan(g1):
        return spark.createDataFrame([(n, *[None] * 6)], out)
    jb = n / 6 * (g1 * g1 + g2 * g2 / 4)
    if n < 8:
        return spark.createDataFrame([(n, g1, g2, jb, math.exp(-jb / 2), None, None)], out)
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta - 1))
    z1 = math.asinh(g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2))) / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    third = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    b = 6 + 8 / third * (2 / third + math.sqrt(1 + 4 / third**2))
    inner = (1 - 2 / b) / (1 + (g2 + 3 - mean) / math.sqrt(var) * math.sqrt(2 / (b - 4)))
    z2 = (1 - 2 / (9 * b) - math.copysign(abs(inner) ** (1 / 3), inner)) / math.sqrt(2 / (9 * b))
    k2 = z1 * z1 + z2 * z2
    return spark.createDataFrame([(n, g1, g2, jb, math.exp(-jb / 2), k2, math.exp(-k2 / 2))], out)


def _ranked(rows: DataFrame, value: str) -> DataFrame:
    """Distinct numbers with how often they stand (t) and how many are smaller (less), stored."""
    per = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("t"))
    return written(cumulative(written(per, "distinct-values"), "v", "t", "less"), "ranked-values")


def _tail(z: np.ndarray) -> np.ndarray:
    """The share of a standard normal above z."""
    return 0.5 * np.array([math.erfc(v / math.sqrt(2)) for v in np.ravel(z).tolist()]).reshape(np.shape(z))


def _scores(i: np.ndarray, n: float) -> np.ndarray:
    """Expected values of a normal sample's ordered values, about."""
    p = (np.asarray(i, float) - 0.375) / (n + 0.25)
    low = np.minimum(p, 1 - p)
    r = np.sqrt(-2 * np.log(low))
    tail = np.polyval(dist.QUANTILE_C, r) / np.polyval(dist.QUANTILE_D, r)
    q = low - 0.5
    z = np.where(low >= 0.02425, q * np.polyval(dist.QUANTILE_A, q * q) / np.polyval(dist.QUANTILE_B, q * q), tail)
    # One Newton step from a quantile that is good to nine digits.
    z = z - (_tail(-z) - low) * math.sqrt(2 * math.pi) * np.exp(z * z / 2)
    return np.where(p < 0.5, z, -z)


#: Places of equal values that are told one by one; longer ties are cut into so many steps.
_STEPS = 64


def order_tests(rows: DataFrame, value: str) -> DataFrame:
    """Anderson-Darling's A2 (with the small-sample factor and its p) and Shapiro-Wilk's W with Royston's p.

    Values are ranked by ranges (inference.cumulative).  A2 and W are sums over ranks, so ties of
    any length are one row.  p of W is meant for up to 5,000 rows; W itself takes them all.  Under
    12 rows, or where all values are equal, there are no statistics; nulls and NaN are left out.
    """
    ranked = _ranked(rows, value)
    spark = rows.sparkSession
    out = "n long, anderson double, p_anderson double, shapiro double, p_shapiro double"
    s = ranked.agg(F.sum("t").alias("n"), (F.sum(F.col("t") * F.col("v")) / F.sum("t")).alias("m"), F.min("v").alias("low"), F.max("v").alias("high")).head()
    n, m = s["n"] or 0, s["m"]
    ss = ranked.agg(F.sum(F.col("t") * F.pow(F.col("v") - F.lit(m), 2))).head()[0] if n else 0.0
    if n < 12 or not ss:
        return spark.createDataFrame([(n, None, None, None, None)], out)
    sd = math.sqrt(ss / (n - 1))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3)
        for batch in batches:
            v, t, less = (batch.column(i).to_numpy().astype(float) for i in range(3))
            z = (v - m) / sd
            below, above = (np.log(np.maximum(_tail(x), 1e-300)) for x in (-z, z))
            # The ranks less + 1 ... less + t of equal values add up to t * (less + (t + 1) / 2).
            ranks = t * (less + (t + 1) / 2)
            steps = np.minimum(t, _STEPS).astype(int)
            width = np.repeat(t / steps, steps)
            within = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
            score = _scores(np.repeat(less, steps) + (within + 0.5) * width + 0.5, n)
            total += [((2 * ranks - t) * below + (2 * (n * t - ranks) + t) * above).sum(), (score * width * np.repeat(v, steps)).sum(), (score * score * width).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=["d", "qv", "qq"])

    d, qv, qq = ranked.select("v", "t", "less").mapInArrow(sums, "d double, qv double, qq double").agg(F.sum("d"), F.sum("qv"), F.sum("qq")).head()
    second = ranked.agg(F.min(F.when(F.col("less") + F.col("t") >= 2, F.col("v"))), F.max(F.when(F.col("less") <= n - 2, F.col("v")))).head()
    a2 = -n - d / n
    a = a2 * (1 + 0.75 / n + 2.25 / n**2)
    p_a2 = 1 - math.exp(-13.436 + 101.14 * a - 223.73 * a * a) if a < 0.2 else 1 - math.exp(-8.318 + 42.796 * a - 59.938 * a * a) if a < 0.34 else math.exp(0.9177 - 4.279 * a - 1.38 * a * a) if a < 0.6 else math.exp(1.2937 - 5.709 * a + 0.0186 * a * a) if a < 13 else 0.0
    top, after = (float(x) for x in _scores(np.array([n, n - 1]), n))
    u = 1 / math.sqrt(n)
    last, second_last = np.polyval([*_LAST, top / math.sqrt(qq)], u), np.polyval([*_SECOND, after / math.sqrt(qq)], u)
    rest = (qq - 2 * top**2 - 2 * after**2) / (1 - 2 * last**2 - 2 * second_last**2)
    outer, inner = s["high"] - s["low"], second[1] - second[0]
    w = min(1.0, float(last * outer + second_last * inner + (qv - top * outer - after * inner) / math.sqrt(rest)) ** 2 / ss)
    l = math.log(n)
    z = (math.log(max(1 - w, 1e-300)) - np.polyval(_MEAN, l)) / math.exp(np.polyval(_SPREAD, l))
    return spark.createDataFrame([(n, float(a2), float(p_a2), w, float(_tail(np.array([z]))[0]))], out)
