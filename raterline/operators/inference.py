"""Bootstraps, rank tests and effect sizes on per-rater rows."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from raterline.sources.observations import md5_int


def numbered(rows: DataFrame, key: str = "rater") -> DataFrame:
    """idx from 0 in the order of a key, and m, the number of rows.

    Positions come from counts per hash range and ranks within it, so no task sees all rows.
    """
    bins = rows.withColumn("_bin", F.pmod(F.xxhash64(key), F.lit(256)))
    sizes = bins.groupBy("_bin").agg(F.count("*").alias("_size"))
    w = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = sizes.withColumns({"_before": F.sum("_size").over(w) - F.col("_size"), "m": F.sum("_size").over(Window.partitionBy(F.lit(0)))}).drop("_size")
    place = F.row_number().over(Window.partitionBy("_bin").orderBy(key)) - 1
    return bins.withColumn("_r", place).join(F.broadcast(before), "_bin").withColumn("idx", F.col("_before") + F.col("_r")).drop("_bin", "_r", "_before")


def cumulative(values: DataFrame, value: str, count: str, name: str, *, bins: int = 64) -> DataFrame:
    """name: the sum of `count` over all rows whose number `value` is smaller.

    Rows are dealt into value ranges by quantiles; sums run inside a range, and the ranges'
    own totals, at most `bins` of them, are added on.  So no task orders all rows.
    """
    edges = sorted(set(values.approxQuantile(value, [i / bins for i in range(1, bins)], 0.001)))
    bin_ = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(value))) if edges else F.lit(0)
    dealt = values.withColumn("_bin", bin_)
    upto = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = dealt.groupBy("_bin").agg(F.sum(count).alias("_size")).select("_bin", (F.sum("_size").over(upto) - F.col("_size")).alias("_before"))
    inside = Window.partitionBy("_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sum(count).over(inside) - F.col(count)
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_bin").withColumn(name, F.col("_before") + F.col("_own")).drop("_bin", "_before", "_own")


def ordered(rows: DataFrame, key: str = "rater") -> DataFrame:
    """As numbered(), but idx follows the order of a numeric key, which no two rows share."""
    placed = cumulative(rows.withColumn("_one", F.lit(1)), key, "_one", "idx").drop("_one")
    return placed.crossJoin(F.broadcast(rows.agg(F.count("*").alias("m"))))


def bootstrap(rows: DataFrame, replicates: int, seed: int, *aggregates: Column) -> DataFrame:
    """B1: per replicate, aggregates over m rows drawn with replacement (rows: idx, m, values).

    A slot's draw is a hash of (seed, replicate, slot), so replicates are the same on every
    run.  The grid has replicates x m rows; rows are one per rater, sums of whatever is needed,
    and best come from a stored table: Spark then knows their size and broadcasts them if they
    are few, so that only partial aggregates are shuffled.  Spark takes the grid to be as small
    as its slots; every draw has its row, so a left join gives the same and never broadcasts it.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = rows.select(F.col("idx").alias("slot"), "m").repartition(partitions, "slot").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draw = md5_int(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("slot").cast("string"))) % F.col("m")
    return slots.select("b", draw.alias("idx")).join(rows, "idx", "left").groupBy("b").agg(*aggregates)


def percentile_interval(replicates: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return replicates.agg(F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"), F.count(value).alias("valid"))


def bca_interval(estimate: float, replicates: list[float], jackknife: list[float], level: float = 0.95) -> tuple[float, float]:
    """B2: bias-corrected and accelerated interval from replicate and leave-one-rater-out values."""
    mean = sum(jackknife) / max(len(jackknife), 1)
    return bca_from_moments(estimate, replicates, sum((mean - v) ** 2 for v in jackknife), sum((mean - v) ** 3 for v in jackknife), level)


def bca_from_moments(estimate: float, replicates: list[float], square: float, cube: float, level: float = 0.95) -> tuple[float, float]:
    """The same where Spark has summed the squares and cubes of (mean - value) over the leave-one-rater-out values.

    Falls back to percentiles where bias or acceleration cannot be had; under 100 valid
    replicates there is no interval (NaN).
    """
    values = sorted(v for v in replicates if v is not None and math.isfinite(v))
    if len(values) < 100:
        return math.nan, math.nan
    normal, tail = NormalDist(), (1 - level) / 2
    below = sum(v < estimate for v in values) / len(values)

    def at(p: float) -> float:
        where = p * (len(values) - 1)
        low = int(where)
        return values[low] + (where - low) * (values[min(low + 1, len(values) - 1)] - values[low])

    if not 0 < below < 1 or square <= 0:
        return at(tail), at(1 - tail)
    z0, a = normal.inv_cdf(below), cube / (6 * square**1.5)

    def moved(p: float) -> float:
        z = z0 + normal.inv_cdf(p)
        return normal.cdf(z0 + z / (1 - a * z)) if abs(1 - a * z) > 1e-12 else p

    return at(moved(tail)), at(moved(1 - tail))


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks of a column, equal values sharing their average; joins counts of distinct values."""
    per = cumulative(rows.groupBy(value).agg(F.count("*").alias("_ties")), value, "_ties", "_less")
    ranks = per.select(F.col(value).alias("_v"), (F.col("_less") + 1 + (F.col("_ties") - 1) / 2).alias(name), "_ties")
    return rows.join(ranks, F.col(value) == F.col("_v")).drop("_v")


def spearman(rows: DataFrame, x: str, y: str, tests: int = 1) -> DataFrame:
    """Rank correlation and, from its t approximation's normal limit, a Bonferroni-corrected p."""
    ranked = average_ranks(average_ranks(rows, x, "_rx").drop("_ties"), y, "_ry")
    r = ranked.agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))
    z = F.abs("rho") * F.sqrt(F.col("n") - 1)
    # Two-sided normal tail by a rational approximation good to 1.5e-7.
    t = 1 / (1 + 0.3275911 * z / math.sqrt(2))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z / 2)
    return r.withColumn("p", F.least(F.lit(1.0), tail * tests))


def wilcoxon(rows: DataFrame, a: str, b: str, zeros: str = "wilcox") -> DataFrame:
    """One row: n, W+ and W-, z (normal approximation with tie correction), win fraction of b < a.

    zeros: wilcox drops equal pairs; zsplit ranks them too and gives half to either side.
    """
    d = rows.withColumn("_d", F.col(a) - F.col(b)).where(F.col("_d").isNotNull())
    wins = d.agg(F.avg((F.col("_d") > 0).cast("double")).alias("win_fraction"))
    kept = d.where("_d != 0") if zeros == "wilcox" else d
    ranked = average_ranks(kept.withColumn("_abs", F.abs("_d")), "_abs", "_rank")
    half = F.when(F.col("_d") == 0, F.col("_rank") / 2)
    s = ranked.agg(
        F.count("*").alias("n"), F.sum(F.coalesce(half, F.when(F.col("_d") > 0, F.col("_rank")).otherwise(0.0))).alias("w_plus"),
        F.sum(F.coalesce(half, F.when(F.col("_d") < 0, F.col("_rank")).otherwise(0.0))).alias("w_minus"),
        # Each of t tied rows adds (t * t - 1): t rows make t**3 - t.
        F.sum(F.col("_ties") * F.col("_ties") - 1).alias("_tie"),
    )
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("_tie") / 48
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(F.when(variance > 0, variance))
    return s.withColumn("z", z).drop("_tie").crossJoin(F.broadcast(wins))


def cohens_d(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Paired d (mean over sd of differences), pooled d, and a label for the paired one."""
    d = F.col(a) - F.col(b)
    s = rows.agg((F.avg(d) / F.stddev_samp(d)).alias("d_paired"), ((F.avg(a) - F.avg(b)) / F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)).alias("d_pooled"), F.count("*").alias("n"))
    size = F.abs("d_paired")
    return s.withColumn("label", F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a proportion."""
    p, m = successes / n, F.lit(z * z) / n
    middle, reach = (p + m / 2) / (1 + m), z * F.sqrt(p * (1 - p) / n + m / (4 * n)) / (1 + m)
    return middle - reach, middle + reach


def anova(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One-way F and eta squared from group sums."""
    g = rows.groupBy(group).agg(F.count("*").cast("double").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    s = g.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    f = (between / (F.col("groups") - 1)) / (F.col("within") / (F.col("n") - F.col("groups")))
    return s.select("groups", "n", f.alias("f"), (between / (between + F.col("within"))).alias("eta_squared"))


def jarque_bera(rows: DataFrame, value: str) -> DataFrame:
    s, k, n = F.skewness(value), F.kurtosis(value), F.count(value)
    return rows.agg(n.alias("n"), (n / 6 * (s * s + k * k / 4)).alias("jb"))


def paired_t(differences: list[float]) -> tuple[float, int]:
    """T and degrees of freedom for a handful of runs or seeds."""
    n = len(differences)
    mean = sum(differences) / n
    sd = math.sqrt(sum((d - mean) ** 2 for d in differences) / (n - 1)) if n > 1 else math.nan
    return (mean / (sd / math.sqrt(n)) if sd and sd > 0 else math.nan), n - 1


def student_tail(t: float, df: int) -> float:
    """Two-sided p of Student's t with a whole number of degrees of freedom, by its finite series in the angle atan(t / sqrt(df))."""
    angle = math.atan(abs(t) / math.sqrt(df))
    sine, cosine = math.sin(angle), math.cos(angle)
    term, total = (cosine, 0.0) if df % 2 else (1.0, 0.0)
    for k in range(df % 2, df - 1, 2):
        total += term
        term *= cosine * cosine * (k + 1) / (k + 2)
    return max(0.0, 1 - (2 / math.pi * (angle + sine * total) if df % 2 else sine * total))


def t_interval(values: list[float], level: float = 0.95) -> tuple[float, float, float]:
    """Mean and t interval over a handful of runs or seeds; no interval (NaN) from one."""
    n = len(values)
    mean = sum(values) / n if n else math.nan
    if n < 2:
        return mean, math.nan, math.nan
    low, high = 0.0, 1e7
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if student_tail(middle, n - 1) > 1 - level else (low, middle)
    reach = low * math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1) / n)
    return mean, mean - reach, mean + reach


def sign_test(wins: int, n: int) -> float:
    """Two-sided exact binomial p against a half."""
    k = max(wins, n - wins)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n) if n else 1.0


def permutation_test(differences: list[float]) -> float:
    """Exact two-sided sign-flip p for up to 20 differences."""
    n = len(differences)
    if n > 20:
        raise ValueError("the full test doubles with every difference; at most 20")
    seen = abs(sum(differences))
    return sum(abs(sum(d if bits >> i & 1 else -d for i, d in enumerate(differences))) >= seen - 1e-12 for bits in range(1 << n)) / (1 << n)


def least_detectable_effect(n: int, level: float = 0.05, power: float = 0.8) -> float:
    """The standardised paired effect that n pairs detect."""
    normal = NormalDist()
    return (normal.inv_cdf(1 - level / 2) + normal.inv_cdf(power)) / math.sqrt(n)
