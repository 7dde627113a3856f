"""What simple baselines, forecasts and splits say: quantile matching, cells, two-parameter gains, roll-ups.

Everything but quantile matching works on sums per rater or cell; rows are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from raterline.operators.inference import cumulative
from raterline.operators.regression import centred, line, population_line, squared_error, sums, totals_less
from raterline.sources.files import written

#: Places of the population that one task orders.
PLACES = 1 << 16


def quantile_matched(folds: DataFrame, k: int) -> DataFrame:
    """Every row's signal by its place among the rater's other folds, read off the population's signals.

    folds: obs_id, rater, fold (0 to k - 1), x.  Returns obs_id, u and matched.  The place u is the
    empirical distribution's, straight between values and level beyond the ends; equal values share
    the greatest place.  A rater without other folds has null.  A rater's distinct values are
    ordered in one task, as its folds are.
    """
    rows = folds.where("x is not null").select("obs_id", "rater", "fold", "x")
    count = lambda g: F.count_if(F.col("fold") == g)
    values = rows.groupBy("rater", "x").agg(F.count("*").alias("n"), *(count(g).alias(f"n{g}") for g in range(k)))
    own = Window.partitionBy("rater").orderBy("x")
    upto, after, whole = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(1, Window.unboundedFollowing), Window.partitionBy("rater")
    seen = lambda g: F.when(F.col(f"n{g}") > 0, F.col("x"))
    placed = values.select(
        "rater", "x", *(F.col(f"n{g}").alias(f"n{g}") for g in range(k)), F.sum("n").over(upto).alias("c"), F.sum("n").over(whole).alias("all"),
        *(F.struct(F.sum(f"n{g}").over(upto).alias("c"), F.sum(f"n{g}").over(whole).alias("all"), F.max(seen(g)).over(upto).alias("low"), F.min(seen(g)).over(after).alias("high")).alias(f"g{g}") for g in range(k)),
    )

    def place(g: int) -> Column:
        c, n = F.col("c") - F.col(f"g{g}.c"), F.col("all") - F.col(f"g{g}.all")
        low, high = (f(*([F.col(f"g{h}.{e}") for h in range(k) if h != g] + [F.lit(None).cast("double")])) for f, e in ((F.greatest, "low"), (F.least, "high")))
        u = F.when(n == 0, None).when(c == 0, 0.5 / n).when(high.isNull(), (n - 0.5) / n).otherwise((c - 0.5 + (F.col("x") - low) / (high - low)) / n)
        return F.when(F.col(f"n{g}") > 0, F.struct(F.lit(g).alias("fold"), u.alias("u")))

    each = placed.select("rater", "x", F.inline(F.filter(F.array(*map(place, range(k))), lambda s: s.isNotNull())))
    population = written(cumulative(written(rows.groupBy("x").agg(F.count("*").alias("t")), "signals"), "x", "t", "less"), "signals")
    size = population.agg(F.sum("t").alias("size"))
    asked = each.crossJoin(F.broadcast(size)).withColumn("place", F.when(F.col("u").isNotNull(), F.least(F.greatest(F.floor(F.col("u") * F.col("size")), F.lit(0)), F.col("size") - 1)))
    asked = written(asked.select("rater", "x", "fold", "u", "place"), "places")
    # Which signal stands at each place: signals and places of a stretch of the population in one order.
    bin_ = lambda c: F.floor(c / PLACES)
    signals = population.select(F.col("less").alias("place"), F.lit(0).alias("asks"), F.col("x").alias("matched"), F.explode(F.sequence(bin_(F.col("less")), bin_(F.col("less") + F.col("t") - 1))).alias("bin"))
    places = asked.select("place").distinct().where("place is not null").select("place", F.lit(1).alias("asks"), F.lit(None).cast("double").alias("matched"), bin_(F.col("place")).alias("bin"))
    order = Window.partitionBy("bin").orderBy("place", "asks").rowsBetween(Window.unboundedPreceding, 0)
    table = signals.unionByName(places).withColumn("matched", F.last("matched", ignorenulls=True).over(order)).where("asks = 1").select("place", "matched")
    found = asked.join(table, "place", "left").select("rater", "x", "fold", "u", "matched")
    return rows.join(found, ["rater", "x", "fold"]).select("obs_id", "u", "matched")


def leave_one_cell_out(obs: DataFrame, *cell: str) -> DataFrame:
    """V8: residuals of every cell of a rater from the line of its other rows.

    Cells of two rows or more, with three others at least.  One row: cells, rows, the RMSE, the
    variance within cells (pooled) and between their mean residuals.
    """
    parts = sums(centred(obs), "rater", *cell)
    fitted = line(totals_less(parts, "rater").where("t_n >= 3 and n >= 2"), prefix="t_")
    sse = squared_error(F.col("intercept"), F.col("slope"))
    mean = F.col("my") + F.col("sy") / F.col("n") - F.col("intercept") - F.col("slope") * (F.col("mx") + F.col("sx") / F.col("n"))
    each = fitted.select("n", sse.alias("sse"), mean.alias("mean"))
    n = F.col("n")
    return each.agg(
        F.count("*").alias("cells"), F.sum("n").cast("long").alias("rows"), F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"),
        (F.sum(F.greatest(F.col("sse") - n * F.col("mean") * F.col("mean"), F.lit(0.0))) / F.sum(n - 1)).alias("within"), F.var_samp("mean").alias("between"),
    )


def two_parameter_forecast(obs: DataFrame, *, least: int = 5) -> DataFrame:
    """The gain that shrinking intercepts and slopes promises, from variances alone.

    Spreads of the raters' means and slopes (less their sampling variances) and the pooled noise give
    each rater the share g = r / (1 + r) that it keeps, with r the spread over the sampling variance.
    Forms: `ratio` (what is left of the spreads, plus noise, over the population line's error),
    `subtractive` (that error less what is gained, at the raters' own signals) and `at_large` (the
    same at the population's signals), and the one-parameter forms with intercepts at x = 0 only.
    A form is null where it would leave no error.
    """
    population = population_line(centred(obs))
    m = obs.groupBy("rater").agg(F.count("*").cast("double").alias("n"), F.avg("x").alias("ax"), F.avg("y").alias("ay"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"))
    n, ax, vx = F.col("n"), F.col("ax"), F.col("vx")
    slope = F.col("vxy") / vx
    each = m.where((n >= max(least, 3)) & (n * vx >= 1e-12)).crossJoin(F.broadcast(population))
    sse = n * F.greatest(F.col("vy") - slope * F.col("vxy"), F.lit(0.0))
    off = F.col("ay") - F.col("pop_intercept") - F.col("pop_slope") * ax
    base = n * (F.col("vy") - 2 * F.col("pop_slope") * F.col("vxy") + F.col("pop_slope") * F.col("pop_slope") * vx + off * off)
    mse = sse / (n - 2)
    each = each.select("n", "ax", "vx", "ay", slope.alias("slope"), (F.col("ay") - slope * ax).alias("at_zero"), sse.alias("sse"), base.alias("base"), (mse / n).alias("v_mean"), (mse / (n * vx)).alias("v_slope"))
    spread = lambda c, v: F.greatest(F.var_samp(c) - F.avg(v), F.lit(0.0))
    s = each.agg(
        spread("ay", "v_mean").alias("t_mean"), spread("slope", "v_slope").alias("t_slope"), spread("at_zero", F.col("v_mean") + ax * ax * F.col("v_slope")).alias("t_zero"),
        (F.sum("sse") / F.sum(n - 2)).alias("noise"), (F.sum("base") / F.sum("n")).alias("error"), (F.sum(n * (vx + ax * ax)) / F.sum("n")).alias("square"), F.count("*").alias("raters"),
    )
    keep = lambda t, v: n * F.col(t) * v / F.greatest(F.col("noise"), F.lit(1e-18))
    rated = each.crossJoin(F.broadcast(s)).withColumns({"r_mean": keep("t_mean", F.lit(1.0)), "r_slope": keep("t_slope", vx), "r_zero": keep("t_zero", F.lit(1.0))})
    g = lambda r: F.col(r) / (1 + F.col(r))
    mean = lambda c: F.sum(n * c) / F.sum(n)
    t = rated.agg(
        *(F.max(c).alias(c) for c in ("raters", "t_mean", "t_slope", "noise", "error")), mean(F.col("t_mean") / (1 + F.col("r_mean")) + vx * F.col("t_slope") / (1 + F.col("r_slope")) + F.col("noise")).alias("left"),
        mean(F.col("t_mean") * g("r_mean") + F.col("t_slope") * vx * g("r_slope")).alias("own"), mean(F.col("t_mean") * g("r_mean") + F.col("t_slope") * F.col("square") * g("r_slope")).alias("large"),
        mean(F.col("t_zero") / (1 + F.col("r_zero")) + F.col("noise")).alias("left_one"), mean(F.col("t_zero") * g("r_zero")).alias("one"),
    )
    error = F.col("error")
    saves = lambda left: F.when((left > 0) & (error > 0), 1 - F.sqrt(left / error))
    return t.select(
        "raters", F.col("t_mean").alias("spread_mean"), F.col("t_slope").alias("spread_slope"), "noise", saves(F.col("left")).alias("ratio"), saves(error - F.col("own")).alias("subtractive"),
        saves(error - F.col("large")).alias("at_large"), saves(F.col("left_one")).alias("one_ratio"), saves(error - F.col("one")).alias("one_subtractive"),
    )


def run_rollup(runs: DataFrame, keys: list[str], value: str, sets: list[list[str]]) -> DataFrame:
    """Mean, least and greatest value over grouping sets of a table of runs, and which set a row is of."""
    rolled = runs.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in keys))
    return rolled.agg(F.grouping_id(*keys).alias("level"), F.count("*").alias("runs"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def along_levels(runs: DataFrame, key: str, level: str, value: str) -> DataFrame:
    """Per key, whether values fall with every level, whether they rise, and the most neighbouring levels that fall in a row.

    Levels are few.
    """
    w = Window.partitionBy(key).orderBy(level)
    steps = runs.withColumn("step", F.col(value) - F.lag(value).over(w)).withColumn("falls", F.coalesce(F.col("step") < 0, F.lit(False)))
    islands = steps.withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy(key, "falls").orderBy(level)))
    longest = islands.groupBy(key, "falls", "island").agg(F.count("*").alias("n")).groupBy(key).agg(F.coalesce(F.max(F.when(F.col("falls"), F.col("n"))), F.lit(0)).alias("longest_fall"))
    flags = steps.groupBy(key).agg(F.count("*").alias("levels"), F.coalesce(F.every(F.col("step") < 0), F.lit(False)).alias("always_falls"), F.coalesce(F.every(F.col("step") > 0), F.lit(False)).alias("always_rises"))
    return flags.join(longest, key)
