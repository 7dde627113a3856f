"""Empirical-Bayes shrinkage of rater lines toward the population line, and its evaluation.

Everything after the fold sums works on one row per (rater, fold).  Held-out errors come from
the same sums, so rows are read and shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterline.operators.regression import added, centred, line, moments, population_line, squared_error, sums, sums_of_moments, totals_less
from raterline.sources.files import written

ARMS = ("mean", "population", "rater", "shrunk")


def between_variance(lines: DataFrame, *, floor: float = 1e-6) -> DataFrame:
    """One row, t2_intercept and t2_slope: variance of the coefficients less their mean sampling variance.

    Raters without a variance count among the coefficients, not in the mean.  floor: 1e-6 or 0.
    """
    t2 = lambda c: F.greatest(F.var_samp(c) - F.avg(f"v_{c}"), F.lit(floor)).alias(f"t2_{c}")
    return lines.agg(t2("intercept"), t2("slope"))


def mean_centre(lines: DataFrame) -> DataFrame:
    """E1e: the mean of rater coefficients in place of the pooled line."""
    return lines.agg(F.avg("intercept").alias("pop_intercept"), F.avg("slope").alias("pop_slope"))


def weight(t2: Column, v: Column, *, v_floor: float | None = None, add: float = 0.0) -> Column:
    """t2 / (t2 + v), 0 without a variance.  E2b: 0 too for v under v_floor.  E2c: `add` in the denominator."""
    w = t2 / (t2 + v + add)
    if v_floor is not None:
        w = F.when(v >= v_floor, w)
    return F.coalesce(w, F.lit(0.0))


def shrunk(df: DataFrame, **options) -> DataFrame:
    """w_intercept, w_slope, eb_intercept, eb_slope from a line, its variances, t2_* and pop_*."""
    out = df
    for c in ("intercept", "slope"):
        out = out.withColumn(f"w_{c}", weight(F.col(f"t2_{c}"), F.col(f"v_{c}"), **options))
        out = out.withColumn(f"eb_{c}", F.col(f"w_{c}") * F.col(c) + (1 - F.col(f"w_{c}")) * F.col(f"pop_{c}"))
    return out


def rater_lines(obs: DataFrame, guard: str = "a") -> DataFrame:
    """R2: the line of every rater; obs as centred() gives them."""
    return line(sums(obs, "rater"), guard)


def held_out_lines(folds: DataFrame, *, guard: str = "a", floor: float = 1e-6, nested: bool = False, **options) -> DataFrame:
    """Per (rater, fold): the held-out rows' sums, and the lines of the other rows: own, population's and shrunken.

    folds: observations with `fold`.  nested (V9): population and variances from the other
    folds of all raters only, in place of all rows.
    """
    # One small row per rater and fold, read by the fits, the totals and the population alike; stored, so that the
    # rows behind them are read once and Spark knows how small it is.
    parts = sums_of_moments(written(moments(folds, "rater", "fold"), "fold-moments"))
    fitted = line(totals_less(parts, "rater"), guard, prefix="t_")
    if nested:
        other = line(totals_less(added(parts, "fold").withColumn("all", F.lit(0)), "all"), prefix="t_")
        population = other.select("fold", F.col("intercept").alias("pop_intercept"), F.col("slope").alias("pop_slope"))
        spread = lambda c: F.greatest(F.var_samp(c) - F.avg(f"v_{c}"), F.lit(floor)).alias(f"t2_{c}")
        t2 = fitted.groupBy("fold").agg(spread("intercept"), spread("slope"))
        fitted = fitted.join(F.broadcast(population.join(t2, "fold")), "fold")
    else:
        population = line(added(parts)).select(F.col("intercept").alias("pop_intercept"), F.col("slope").alias("pop_slope"))
        fitted = fitted.crossJoin(F.broadcast(population)).crossJoin(F.broadcast(between_variance(line(added(parts, "rater"), guard), floor=floor)))
    return shrunk(fitted, **options)


def held_out_errors(folds: DataFrame, **options) -> DataFrame:
    """Per (rater, fold), n and the sum of squared errors of every arm on the held-out rows; as held_out_lines() takes it."""
    e = held_out_lines(folds, **options)
    zero = F.lit(0.0)
    arms = {
        "mean": (F.coalesce(F.col("my") + F.col("t_sy") / F.when(F.col("t_n") > 0, F.col("t_n")), zero), zero),
        "population": (F.col("pop_intercept"), F.col("pop_slope")),
        "rater": (F.col("intercept"), F.col("slope")),
        "shrunk": (F.col("eb_intercept"), F.col("eb_slope")),
        "intercept_only": (F.col("eb_intercept"), F.col("pop_slope")),
        "slope_only": (F.col("pop_intercept"), F.col("eb_slope")),
    }
    return e.select("rater", "fold", "n", *(squared_error(a, b).alias(f"sse_{k}") for k, (a, b) in arms.items()), "w_intercept", "w_slope")


def row_errors(folds: DataFrame, **options) -> DataFrame:
    """rater, obs_id and the squared errors of the population's, the rater's own and the shrunken line on each held-out row."""
    lines = held_out_lines(folds, **options).select("rater", "fold", "pop_intercept", "pop_slope", "intercept", "slope", "eb_intercept", "eb_slope")
    off = lambda k: F.pow(F.col("y") - F.col(f"{k}intercept") - F.col(f"{k}slope") * F.col("x"), 2)
    return folds.join(lines, ["rater", "fold"]).select("rater", "obs_id", off("pop_").alias("population"), off("").alias("own"), off("eb_").alias("shrunk"))


def rater_rmse(errors: DataFrame) -> DataFrame:
    """A4: per rater, rows and the root mean squared error of every arm over all folds."""
    arms = [c for c in errors.columns if c.startswith("sse_")]
    return errors.groupBy("rater").agg(F.sum("n").alias("n"), *(F.sqrt(F.sum(c) / F.sum("n")).alias(f"rmse_{c[4:]}") for c in arms))


def gains(per_rater: DataFrame, *, base: str = "population", arm: str = "shrunk") -> DataFrame:
    """Three gains, which differ: of mean errors, of rater ratios, of pooled rows.

    A rater is won if its error falls by more than rounding (one part in 10**9).
    """
    b, a, n = F.col(f"rmse_{base}"), F.col(f"rmse_{arm}"), F.col("n")
    return per_rater.agg(
        (1 - F.avg(a) / F.avg(b)).alias("gain_of_means"), F.avg(1 - a / F.when(b > 0, b)).alias("gain_of_ratios"), (1 - F.sqrt(F.sum(n * a * a) / F.sum(n * b * b))).alias("gain_pooled"),
        F.count("*").alias("raters"), F.avg((a < b * (1 - 1e-9)).cast("double")).alias("win_rate"),
    )


def evaluation(folds: DataFrame, **options) -> DataFrame:
    """The core query: one row with the mean error of every arm, the gains and the win rate."""
    per_rater = rater_rmse(held_out_errors(folds, **options))
    b, a, n = F.col("rmse_population"), F.col("rmse_shrunk"), F.col("n")
    return per_rater.agg(
        F.count("*").alias("raters"), *(F.avg(f"rmse_{k}").alias(f"rmse_{k}") for k in ARMS), (1 - F.avg(a) / F.avg(b)).alias("gain_of_means"), F.avg(1 - a / F.when(b > 0, b)).alias("gain_of_ratios"),
        (1 - F.sqrt(F.sum(n * a * a) / F.sum(n * b * b))).alias("gain_pooled"), F.avg((a < b * (1 - 1e-9)).cast("double")).alias("win_rate"),
    )


def calibrated(obs: DataFrame, calibrators: DataFrame, population: DataFrame, mode: str = "shrunk") -> DataFrame:
    """`calibrated` = a line applied to x; mode none, population or shrunk; unknown raters take the population line.

    calibrators: rater, intercept, slope (one row each); population: one row.
    """
    if mode == "none":
        return obs.withColumn("calibrated", F.col("x"))
    both = obs.crossJoin(F.broadcast(population))
    if mode == "population":
        return both.withColumn("calibrated", F.col("pop_intercept") + F.col("pop_slope") * F.col("x"))
    own = both.join(calibrators.select("rater", "intercept", "slope"), "rater", "left")
    return own.withColumn("calibrated", F.coalesce("intercept", "pop_intercept") + F.coalesce("slope", "pop_slope") * F.col("x"))


def residual_means(obs: DataFrame, *, floor: float = 0.0) -> DataFrame:
    """Per rater, the mean residual from the population line, shrunk toward 0."""
    c = centred(obs).crossJoin(F.broadcast(population_line(centred(obs))))
    r = c.withColumn("r", F.col("y") - F.col("pop_intercept") - F.col("pop_slope") * F.col("x"))
    each = r.groupBy("rater").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r"), (F.var_samp("r") / F.count("*")).alias("v"))
    t2 = each.agg(F.greatest(F.var_samp("mean_r") - F.avg("v"), F.lit(floor)).alias("t2"))
    return each.crossJoin(F.broadcast(t2)).withColumn("w", weight(F.col("t2"), F.col("v"))).withColumn("shift", F.col("w") * F.col("mean_r"))
