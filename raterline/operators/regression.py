"""Lines fitted from sufficient statistics.

Six sums per group (n, x, y, xx, xy, yy) are all that a line, its sampling variances and its
error on other rows need.  They add up, so training folds are totals less the held-out fold,
and one aggregation with map-side combine serves every fold and every model.

Sums are taken about a centre (mx, my), the grand means as a rule: raw sums cancel badly when
means are large.  Lines and their variances are always those of x and y themselves, so the
choice of centre does not show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SUMS = ("n", "sx", "sy", "sxx", "sxy", "syy")


def centres(obs: DataFrame) -> DataFrame:
    """One row: mx, my."""
    return obs.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))


def centred(obs: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """Observations with cx and cy, x and y less their grand means (a one-row broadcast)."""
    return obs.crossJoin(F.broadcast(centres(obs) if about is None else about)).withColumns({"cx": F.col("x") - F.col("mx"), "cy": F.col("y") - F.col("my")})


def sums(obs: DataFrame, *keys: str, x: str = "cx", y: str = "cy") -> DataFrame:
    """The six sums per key, and the centre they are about (0 for other columns than cx and cy)."""
    a, b = F.col(x), F.col(y)
    centre = [F.max("mx").alias("mx"), F.max("my").alias("my")] if (x, y) == ("cx", "cy") else [F.lit(0.0).alias("mx"), F.lit(0.0).alias("my")]
    return obs.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"), F.sum(b * b).alias("syy"), *centre
    )


def moments(obs: DataFrame, *keys: str) -> DataFrame:
    """Per key: n, the means ax and ay, the variances vx and vy and the covariance vxy of x and y.

    Spark keeps these about running means, so they are as exact as centred sums and need no
    pass over the rows to find a centre first.
    """
    return obs.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"), F.avg("x").alias("ax"), F.avg("y").alias("ay"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy")
    )


def sums_of_moments(parts: DataFrame) -> DataFrame:
    """The six sums about the grand means, from rows of moments()."""
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    both = parts.crossJoin(F.broadcast(parts.agg(mean("ax").alias("mx"), mean("ay").alias("my"))))
    n, x, y = F.col("n"), F.col("ax") - F.col("mx"), F.col("ay") - F.col("my")
    return both.withColumns({"sx": n * x, "sy": n * y, "sxx": n * (F.col("vx") + x * x), "sxy": n * (F.col("vxy") + x * y), "syy": n * (F.col("vy") + y * y)}).drop("ax", "ay", "vx", "vy", "vxy")


def added(parts: DataFrame, *keys: str) -> DataFrame:
    """Sums of sums."""
    return parts.groupBy(*keys).agg(*(F.sum(s).alias(s) for s in SUMS), F.max("mx").alias("mx"), F.max("my").alias("my"))


def totals_less(parts: DataFrame, key: str) -> DataFrame:
    """Beside each part's sums: t_n, ..., the sums of all other parts of the same key."""
    w = Window.partitionBy(key)
    return parts.withColumns({f"t_{s}": (F.sum(s).over(w)) - F.col(s) for s in SUMS})


def line(df: DataFrame, guard: str = "a", *, prefix: str = "") -> DataFrame:
    """intercept, slope, v_intercept, v_slope of y on x, from columns of sums and their centre; null variance: infinite.

    guard: what counts as too little to fit a line.
      a  under 2 rows, or a spread of x under 1e-12 -> the mean (0 without rows), flat, no variance
      b  under 3 rows -> nothing; sum of squares of x under 1e-10 -> the mean, flat, no variance
      c  under 3 rows or that sum under 1e-10 -> nothing
      d  as a, but two rows take the spread of y for residual variance (1 if it is 0)
    """
    n, sx, sy, sxx, sxy, syy = (F.col(prefix + s) for s in SUMS)
    some = F.when(n > 0, n)
    mean_x, mean_y = F.col("mx") + sx / some, F.col("my") + sy / some
    spread, cross, total = sxx - sx * sx / some, sxy - sx * sy / some, syy - sy * sy / some
    few = {"a": n < 2, "b": n < 3, "c": n < 3, "d": n < 2}[guard]
    flat = {"a": spread / some < 1e-12, "b": spread < 1e-10, "c": spread < 1e-10, "d": spread / some < 1e-12}[guard]
    fits = ~F.coalesce(few | flat, F.lit(True))
    slope = F.when(fits, cross / spread)
    residual = F.greatest(total - cross * cross / F.when(fits, spread), F.lit(0.0))
    s2 = residual / (F.greatest(n - 2, F.lit(1.0)) if guard in "ad" else F.when(n > 2, n - 2))
    if guard == "d":
        s2 = F.when(n == 2, F.when(total > 0, total / some).otherwise(1.0)).otherwise(s2)
    mean_only = {"a": F.coalesce(mean_y, F.lit(0.0)), "b": F.when(~few, mean_y), "c": F.lit(None).cast("double"), "d": F.coalesce(mean_y, F.lit(0.0))}[guard]
    flat_slope = {"a": F.lit(0.0), "b": F.when(~few, F.lit(0.0)), "c": F.lit(None).cast("double"), "d": F.lit(0.0)}[guard]
    return df.withColumns({
        "slope": F.coalesce(slope, flat_slope), "intercept": F.when(fits, mean_y - slope * mean_x).otherwise(mean_only),
        "v_slope": F.when(fits, s2 / F.greatest(spread, F.lit(1e-12))), "v_intercept": F.when(fits, s2 * (1 / some + mean_x * mean_x / F.greatest(spread, F.lit(1e-12)))),
    })


def squared_error(intercept: Column, slope: Column, *, prefix: str = "") -> Column:
    """Sum of squared errors of a line on the rows behind a set of sums."""
    n, sx, sy, sxx, sxy, syy = (F.col(prefix + s) for s in SUMS)
    intercept = intercept - F.col("my") + slope * F.col("mx")
    return F.greatest(syy - 2 * intercept * sy - 2 * slope * sxy + n * intercept * intercept + 2 * intercept * slope * sx + slope * slope * sxx, F.lit(0.0))


def population_line(obs: DataFrame) -> DataFrame:
    """One row, the line through all observations; obs as centred() gives them."""
    return line(sums(obs)).select(F.col("intercept").alias("pop_intercept"), F.col("slope").alias("pop_slope"))


def quadratic(obs: DataFrame, *keys: str) -> DataFrame:
    """Y on 1, x, x**2 per group from power sums, about each group's own mean of x.

    Returns a (constant), b, c, the variance of c and the sums of powers p2 to p4; groups with under 4 rows or without
    three different x have none.
    """
    w = Window.partitionBy(*keys)
    d = obs.withColumn("_d", F.col("x") - F.avg("x").over(w))
    powers = d.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"), *(F.sum(F.pow("_d", F.lit(float(k)))).alias(f"p{k}") for k in (2, 3, 4)), F.sum("y").alias("q0"), F.sum(F.col("_d") * F.col("y")).alias("q1"),
        F.sum(F.col("_d") * F.col("_d") * F.col("y")).alias("q2"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.avg("x").alias("mean_x"),
    )
    # Normal equations with sum(d) = 0; determinants by cofactors.
    n, p2, p3, p4, q0, q1, q2 = (F.col(c) for c in ("n", "p2", "p3", "p4", "q0", "q1", "q2"))
    det = n * (p2 * p4 - p3 * p3) - p2 * p2 * p2
    ok = (n >= 4) & (F.abs(det) > 1e-6)
    det = F.when(ok, det)
    a = (q0 * (p2 * p4 - p3 * p3) + q1 * p2 * p3 - q2 * p2 * p2) / det
    b = (q0 * p2 * p3 + q1 * (n * p4 - p2 * p2) - q2 * n * p3) / det
    c = (-q0 * p2 * p2 - q1 * n * p3 + q2 * n * p2) / det
    fitted = powers.withColumns({"a": a, "b": b, "c": c})
    residual = F.greatest(F.col("yy") - F.col("a") * q0 - F.col("b") * q1 - F.col("c") * q2, F.lit(0.0))
    return fitted.select(*keys, "n", "mean_x", "p2", "p3", "p4", "a", "b", "c", (residual / F.greatest(n - 3, F.lit(1.0)) * n * p2 / det).alias("v_c"))


def robust_errors(obs: DataFrame, fitted: DataFrame, *keys: str) -> DataFrame:
    """Standard errors of b and c of quadratic() that allow for unequal variances (HC1), and z = estimate / error.

    A second pass over the rows: an error is the norm of the residuals weighted by their part in
    the estimate, by degrees of freedom.  Groups with under 4 rows have no fit and are not there;
    z is null where the fit is exact.
    """
    n, p2, p3, p4 = (F.col(c) for c in ("n", "p2", "p3", "p4"))
    det = n * (p2 * p4 - p3 * p3) - p2 * p2 * p2
    d = F.col("x") - F.col("mean_x")
    e = F.col("y") - F.col("a") - F.col("b") * d - F.col("c") * d * d
    part = {"b": (p2 * p3 + (n * p4 - p2 * p2) * d - n * p3 * d * d) / det, "c": (n * p2 * d * d - n * p3 * d - p2 * p2) / det}
    rows = obs.select(*keys, "x", "y").join(fitted.where("n >= 4 and a is not null"), list(keys))
    errors = rows.groupBy(*keys, "n", "b", "c").agg(*(F.sum(e * e * w * w).alias(f"v_{k}") for k, w in part.items()))
    se = {k: F.sqrt(F.col(f"v_{k}") * F.col("n") / F.greatest(n - 3, F.lit(1.0))) for k in part}
    return errors.select(*keys, *(se[k].alias(f"se_{k}") for k in part), *((F.col(k) / F.when(se[k] > 0, se[k])).alias(f"z_{k}") for k in part))
