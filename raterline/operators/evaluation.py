"""Held-out evaluations beside the core one: by setting, after few ratings, row by row, and simple baselines.

All of them work on the sums of operators.regression: rows are read once, and a line's error on
held-out rows comes from their sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from raterline.operators import splits
from raterline.operators.regression import SUMS, added, centred, line, moments, squared_error, sums, sums_of_moments, totals_less
from raterline.operators.shrinkage import between_variance, shrunk
from raterline.sources.files import written

_LINES = {"population": ("pop_intercept", "pop_slope"), "rater": ("intercept", "slope"), "shrunk": ("eb_intercept", "eb_slope")}


def _population(lines: DataFrame, *keys: str) -> DataFrame:
    return lines.select(*keys, F.col("intercept").alias("pop_intercept"), F.col("slope").alias("pop_slope"))


def _errors(**arms: tuple[Column, Column]) -> list[Column]:
    return [squared_error(a, b).alias(f"sse_{k}") for k, (a, b) in arms.items()]


def _lines() -> dict[str, tuple[Column, Column]]:
    return {k: (F.col(a), F.col(b)) for k, (a, b) in _LINES.items()}


def errors_by_setting(folds: DataFrame, setting: str = "setting") -> DataFrame:
    """Per (setting, rater), held-out RMSE of the population, rater and shrunk lines.

    folds: observations with `fold` and a setting, each setting a data set of its own with its own
    population and variances.  All settings are one plan: rows are aggregated once to (setting,
    rater, fold).  Settings are few; their population rows are broadcast.  Raters without a
    complete row are not there; an empty input gives an empty result.
    """
    parts = sums_of_moments(written(moments(folds, setting, "rater", "fold"), "setting-moments"))
    population = _population(line(added(parts, setting)), setting)
    t2 = line(added(parts, setting, "rater")).groupBy(setting).agg(
        *(F.greatest(F.var_samp(c) - F.avg(f"v_{c}"), F.lit(1e-6)).alias(f"t2_{c}") for c in ("intercept", "slope"))
    )
    fitted = line(totals_less(parts, [setting, "rater"]), prefix="t_").join(F.broadcast(population.join(t2, setting)), setting)
    e = shrunk(fitted).select(setting, "rater", "n", *_errors(**_lines()))
    return e.groupBy(setting, "rater").agg(*(F.sqrt(F.sum(f"sse_{k}") / F.sum("n")).alias(f"rmse_{k}") for k in _LINES))


def cold_start(obs: DataFrame, budgets: list[int], share: float, seed: int) -> DataFrame:
    """New raters after their first k ratings: mean error of four arms on the rest, and where each breaks even.

    A share of the raters is held out; population line and variances are those of the others.  A
    rater counts at budget k with k + 2 rows or more.  break_even is the least budget at which the
    arm's mean RMSE is no higher than the population line's on the same raters and rows (null: none).
    Rows are not multiplied by budgets: each rater gets its sums up to every budget in one aggregation.
    """
    c = centred(obs).join(splits.disjoint_raters(obs, share, seed), "rater")
    lines = line(sums(c.where(~F.col("held_out")), "rater"))
    population = _population(line(sums(c.where(~F.col("held_out"))))).crossJoin(F.broadcast(between_variance(lines)))
    pos = F.row_number().over(Window.partitionBy("rater").orderBy("ts", "obs_id"))
    x, y = F.col("cx"), F.col("cy")
    terms = dict(zip(SUMS, (F.lit(1.0), x, y, x * x, x * y, y * y)))
    upto = lambda k, v: F.sum(F.when(F.col("pos") <= k, v))
    new = c.where("held_out").withColumn("pos", pos).groupBy("rater").agg(
        F.max("mx").alias("mx"), F.max("my").alias("my"), *(F.sum(v).alias(f"all_{s}") for s, v in terms.items()),
        F.array(*(F.struct(F.lit(k).alias("budget"), *(upto(k, v).alias(f"t_{s}") for s, v in terms.items())) for k in budgets)).alias("fits"),
    )
    each = new.select("rater", "mx", "my", *(f"all_{s}" for s in SUMS), F.inline("fits")).where(F.col("all_n") >= F.col("budget") + 2)
    tested = each.withColumns({s: F.col(f"all_{s}") - F.col(f"t_{s}") for s in SUMS})
    fitted = shrunk(line(tested, prefix="t_").crossJoin(F.broadcast(population)))
    arms = {"mean": (F.col("my") + F.col("t_sy") / F.col("t_n"), F.lit(0.0)), **_lines()}
    e = fitted.select("rater", "budget", "n", *_errors(**arms))
    long = e.select("budget", F.sqrt(F.col("sse_population") / F.col("n")).alias("base"), F.inline(F.array(*(F.struct(F.lit(k).alias("arm"), F.sqrt(F.col(f"sse_{k}") / F.col("n")).alias("error")) for k in arms))))
    curve = long.groupBy("arm", "budget").agg(
        F.count("*").alias("raters"), F.avg("error").alias("rmse"), F.avg("base").alias("base"), F.avg((F.col("error") < F.col("base") * (1 - 1e-9)).cast("double")).alias("win_rate")
    )
    even = F.min(F.when(F.col("rmse") <= F.col("base"), F.col("budget"))).over(Window.partitionBy("arm"))
    return curve.select("arm", "budget", "raters", "rmse", "win_rate", even.alias("break_even"))


def leave_one_row_out(obs: DataFrame) -> DataFrame:
    """V8: every row predicted from its rater's other rows (three at least), by taking it off the rater's sums.

    One row: rows, and the RMSE of the population, rater and shrunk lines.  Population line and
    variances are those of all rows.  Rows meet their rater's sums in a join, which AQE may split
    where a rater is hot; no window holds a rater's rows.
    """
    c = centred(obs)
    own = sums(c, "rater")
    population = _population(line(sums(c))).crossJoin(F.broadcast(between_variance(line(own))))
    x, y = F.col("cx"), F.col("cy")
    row = dict(zip(SUMS, (F.lit(1.0), x, y, x * x, x * y, y * y)))
    rest = c.join(own.select("rater", *(F.col(s).alias(f"t_{s}") for s in SUMS)), "rater").withColumns(row)
    rest = rest.withColumns({f"t_{s}": F.col(f"t_{s}") - F.col(s) for s in SUMS}).where("t_n >= 3")
    e = shrunk(line(rest, prefix="t_").crossJoin(F.broadcast(population))).select(*_errors(**_lines()))
    return e.agg(F.count("*").alias("rows"), *(F.sqrt(F.avg(f"sse_{k}")).alias(f"rmse_{k}") for k in _LINES))


def simple_lines(folds: DataFrame, strata: DataFrame, *, least: int = 50) -> DataFrame:
    """The population line moved by the rater's mean residual, and the line of the rater's stratum.

    folds: observations with `fold`; strata: rater, stratum (one row each; raters without one are
    'Unknown').  A stratum under `least` rows, or with a flat signal, takes the population line.
    Per rater: held-out rmse_population, rmse_residual and rmse_stratum.
    """
    parts = written(sums_of_moments(moments(folds, "rater", "fold")).join(strata, "rater", "left").fillna("Unknown", ["stratum"]), "stratum-sums")
    population = _population(line(added(parts)))
    fitted = line(added(parts, "stratum"))
    fits = (F.col("n") >= least) & (F.col("sxx") / F.col("n") - (F.col("sx") / F.col("n")) ** 2 > 1e-9)
    stratum = fitted.select("stratum", F.when(fits, F.col("intercept")).alias("s_intercept"), F.when(fits, F.col("slope")).alias("s_slope"))
    train = totals_less(parts, "rater").join(stratum, "stratum").crossJoin(F.broadcast(population))
    a, b = F.col("pop_intercept"), F.col("pop_slope")
    some = F.when(F.col("t_n") > 0, F.col("t_n"))
    moved = F.coalesce(F.col("my") + F.col("t_sy") / some - b * (F.col("mx") + F.col("t_sx") / some), a)
    arms = {"population": (a, b), "residual": (moved, b), "stratum": (F.coalesce("s_intercept", a), F.coalesce("s_slope", b))}
    e = train.select("rater", "n", *_errors(**arms))
    return e.groupBy("rater").agg(*(F.sqrt(F.sum(f"sse_{k}") / F.sum("n")).alias(f"rmse_{k}") for k in arms))
