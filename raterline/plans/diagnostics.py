"""Queries on sweeps, forecasts, matching, tests of normality, p-values and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from raterline.functions import distributions
from raterline.operators import diagnostics, evaluation, inference, normality, regression, shrinkage, splits
from raterline.plans.calibration import _SUMS, EVENT_FOLDS, ORDERS, SEED, K, centred_sql, errors_sql, event_folds, line_sql, rounded, sse_sql
from raterline.plans.registry import SQL, query
from raterline.plans.relational import EVENTS
from raterline.plans.robustness import _PARTS_LESS, _settings_sql, _summary
from raterline.sources.observations import complete, events, md5_int, orders

SIZES, COHORTS, SEEDS = [20, 30, 40, 50], [10, 25, 50, 100], [1, 2, 3, 4, 5]


# ------------------------------------------------------------------ sweeps

_WHOLE = f"(SELECT * FROM {EVENTS} WHERE x IS NOT NULL AND y IS NOT NULL AND rater IS NOT NULL)"
_FIRST = f"(SELECT rater, obs_id, grp, ts, x, y FROM (SELECT *, row_number() OVER (PARTITION BY rater ORDER BY md5('{SEED}:' || obs_id), obs_id) AS place, count(*) OVER (PARTITION BY rater) AS size FROM {_WHOLE}) WHERE place <= {{s}} AND size >= {{s}})"


@query(_settings_sql("size", SIZES, _FIRST))
def v11_subsample_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains with 20 to 50 rows of each rater that has as many; one order of rows and one plan for all sizes."""
    p = splits.placed(complete(events(spark, sf_dir)), SEED)
    each = p.withColumn("size", F.explode(F.filter(F.array(*map(F.lit, SIZES)), lambda s: (s > F.col("pos")) & (s <= F.col("cnt")))))
    fold = F.least(F.floor(F.col("pos") / F.floor(F.col("size") / K)), F.lit(K - 1)).cast("int")
    return _summary(evaluation.errors_by_setting(each.withColumn("fold", fold), "size"), "size")


_COHORT = f"(SELECT * FROM {EVENTS} WHERE CAST('0x' || substr(md5('cohort:' || rater), 1, 8) AS BIGINT) % 100 < {{s}})"


@query(_settings_sql("share", COHORTS, _COHORT))
def v11_cohort_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains in growing shares of the raters, by hash: a larger cohort holds the smaller ones."""
    place = md5_int(F.concat_ws(":", F.lit("cohort"), F.col("rater").cast("string"))) % 100
    each = event_folds(spark, sf_dir).withColumn("share", F.explode(F.filter(F.array(*map(F.lit, COHORTS)), lambda s: s > place)))
    return _summary(evaluation.errors_by_setting(each, "share"), "share")


def _seeds_sql() -> str:
    one = lambda s: f"SELECT CAST({s} AS DOUBLE) AS seed, * FROM (WITH {errors_sql(EVENT_FOLDS.replace(f'{SEED}:', f'{s}:'))} SELECT count(*) AS raters, round(avg(rmse_population), 5) AS rmse_population, round(avg(rmse_rater), 5) AS rmse_rater, round(avg(rmse_shrunk), 5) AS rmse_shrunk, coalesce(nullif(round(1 - avg(rmse_shrunk) / avg(rmse_population), 6), 0), 0) AS gain FROM r)"
    return " UNION ALL ".join(map(one, SEEDS))


@query(_seeds_sql())
def v11_seed_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core evaluation over five seeds of its folds, in one plan."""
    e = complete(events(spark, sf_dir)).withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    own = Window.partitionBy("rater", "seed")
    key = F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("obs_id").cast("string")).cast("binary"))
    p = e.withColumns({"pos": F.row_number().over(own.orderBy(key, "obs_id")) - 1, "cnt": F.count("*").over(own)}).where(F.col("cnt") >= K)
    fold = F.least(F.floor(F.col("pos") / F.floor(F.col("cnt") / K)), F.lit(K - 1)).cast("int")
    return _summary(evaluation.errors_by_setting(p.withColumn("fold", fold), "seed"), "seed")


@query()
def b7_small_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the seeds: what the population line saves of the raters' own lines; t interval, paired t, signs, all sign flips, least effect."""
    runs = v11_seed_sweep(spark, sf_dir).orderBy("seed").collect()
    saved = [r["rmse_rater"] - r["rmse_population"] for r in runs]
    mean, low, high = inference.t_interval(saved)
    t, df = inference.paired_t(saved)
    return rounded(spark.createDataFrame([(len(saved), mean, low, high, t, inference.student_tail(t, df), inference.sign_test(sum(d > 0 for d in saved), len(saved)), inference.permutation_test(saved), inference.least_detectable_effect(len(saved)))], "n int, mean double, low double, high double, t double, p_t double, p_sign double, p_permutation double, least_effect double"))


# ------------------------------------------------------------------ matching, cells, forecasts


@query(f"""WITH {EVENT_FOLDS}, t AS (SELECT a.obs_id, a.x, count(*) AS n, count(*) FILTER (b.x <= a.x) AS c, max(b.x) FILTER (b.x <= a.x) AS lo, min(b.x) FILTER (b.x > a.x) AS hi FROM f a JOIN f b ON a.rater = b.rater AND a.fold <> b.fold GROUP BY a.obs_id, a.x),
u AS (SELECT obs_id, CASE WHEN c = 0 THEN 0.5 / CAST(n AS DOUBLE) WHEN hi IS NULL THEN (n - CAST(0.5 AS DOUBLE)) / n ELSE (c - CAST(0.5 AS DOUBLE) + (x - lo) / (hi - lo)) / n END AS u FROM t),
pop AS (SELECT x AS matched, row_number() OVER (ORDER BY x) - 1 AS place, count(*) OVER () AS size FROM f)
SELECT u.obs_id, round(u, 6) AS u, round(matched, 6) AS matched FROM u JOIN pop ON pop.place = least(greatest(CAST(floor(u * size) AS BIGINT), 0), size - 1)""")
def r6_quantile_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.quantile_matched(event_folds(spark, sf_dir), K))


@query(f"""WITH {centred_sql(EVENTS)}, parts AS (SELECT rater, grp, CAST(ts AS DATE) AS day, {_SUMS} FROM c GROUP BY ALL), st AS (SELECT *, {_PARTS_LESS} FROM parts), k AS (SELECT * FROM st WHERE t_n >= 3 AND n >= 2), {line_sql("fit", "k", "a", "t_")},
e AS (SELECT n, {sse_sql("intercept", "slope")} AS sse, my + sy / n - intercept - slope * (mx + sx / n) AS m FROM fit)
SELECT count(*) AS cells, CAST(sum(n) AS BIGINT) AS rows, round(sqrt(sum(sse) / sum(n)), 5) AS rmse, round(sum(greatest(sse - n * m * m, 0)) / sum(n - 1), 4) AS within, round(var_samp(m), 4) AS between FROM e""")
def v8_leave_one_cell_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells: a rater's rows of one kind on one day."""
    e = complete(events(spark, sf_dir)).withColumn("day", F.to_date("ts"))
    return diagnostics.leave_one_cell_out(e, "grp", "day").select("cells", "rows", F.round("rmse", 5).alias("rmse"), F.round("within", 4).alias("within"), F.round("between", 4).alias("between"))


def _forecast_sql(source: str) -> str:
    saves = lambda left, name: f"round(CASE WHEN {left} > 0 AND error > 0 THEN 1 - sqrt(({left}) / error) END, 6) AS {name}"
    mean = lambda v, name: f"sum(n * ({v})) / sum(n) AS {name}"
    return f"""WITH {centred_sql(source)}, pa AS (SELECT {_SUMS} FROM c), {line_sql("pl", "pa")},
m AS (SELECT rater, CAST(count(*) AS DOUBLE) AS n, avg(x) AS ax, avg(y) AS ay, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS vxy FROM obs GROUP BY rater),
d AS (SELECT n, ax, vx, ay, vxy / vx AS slope, ay - vxy / vx * ax AS z, n * greatest(vy - vxy * vxy / vx, 0) AS sse, n * (vy - 2 * pl.slope * vxy + pl.slope * pl.slope * vx + (ay - pl.intercept - pl.slope * ax) ** 2) AS base FROM m, (SELECT intercept, slope FROM pl) pl WHERE n >= 5 AND n * vx >= 1e-12),
e AS (SELECT *, sse / (n - 2) / n AS vm, sse / (n - 2) / (n * vx) AS vs FROM d),
s AS (SELECT greatest(var_samp(ay) - avg(vm), 0) AS tm, greatest(var_samp(slope) - avg(vs), 0) AS tb, greatest(var_samp(z) - avg(vm + ax * ax * vs), 0) AS tz, sum(sse) / sum(n - 2) AS noise, sum(base) / sum(n) AS error, sum(n * (vx + ax * ax)) / sum(n) AS sq, count(*) AS raters FROM e),
r AS (SELECT e.*, s.*, n * tm / greatest(noise, 1e-18) AS rm, n * tb * vx / greatest(noise, 1e-18) AS rb, n * tz / greatest(noise, 1e-18) AS rz FROM e, s),
t AS (SELECT any_value(raters) AS raters, any_value(tm) AS tm, any_value(tb) AS tb, any_value(noise) AS noise, any_value(error) AS error, {mean("tm / (1 + rm) + vx * tb / (1 + rb) + noise", "kept")}, {mean("tm * rm / (1 + rm) + tb * vx * rb / (1 + rb)", "own")},
 {mean("tm * rm / (1 + rm) + tb * sq * rb / (1 + rb)", "large")}, {mean("tz / (1 + rz) + noise", "kept_one")}, {mean("tz * rz / (1 + rz)", "one")} FROM r)
SELECT raters, round(tm, 6) AS spread_mean, round(tb, 6) AS spread_slope, round(noise, 3) AS noise, {saves("kept", "ratio")}, {saves("error - own", "subtractive")}, {saves("error - large", "at_large")}, {saves("kept_one", "one_ratio")}, {saves("error - one", "one_subtractive")} FROM t"""


@query(_forecast_sql(EVENTS))
def e8_two_parameter_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = diagnostics.two_parameter_forecast(complete(events(spark, sf_dir)))
    return f.select(*(F.round(c, 3 if c == "noise" else 6).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes))


# ------------------------------------------------------------------ p-values and normality


def _student_sql(t: str, df: str) -> str:
    """Two-sided p for a whole number of degrees of freedom, by the finite series in the angle."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({angle}) * list_sum([exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - 2 * k * ln(2) + 2 * k * ln(cos({angle}))) FOR k IN range(0, {df} // 2)])"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum([exp(2 * (k * ln(2) + lgamma(k + 1)) - lgamma(2 * k + 2) + (2 * k + 1) * ln(cos({angle}))) FOR k IN range(0, ({df} - 1) // 2)]), 0))"
    return f"round(1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END, 6)"


@query(SQL["r3_robust_errors"][: SQL["r3_robust_errors"].rindex("SELECT rater")].rstrip() + f""", z AS (SELECT rater, CAST(n AS BIGINT) - 3 AS df, b / nullif(sqrt(vb * n / greatest(n - 3, 1)), 0) AS tb, c / nullif(sqrt(vc * n / greatest(n - 3, 1)), 0) AS tc FROM v)
SELECT rater, df, round(tb, 4) AS t_b, {_student_sql("tb", "df")} AS p_b, round(tc, 4) AS t_c, {_student_sql("tc", "df")} AS p_c FROM z""")
def r3_t_and_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Student's t of slope and curvature with HC1 errors, and its two-sided p."""
    e = complete(events(spark, sf_dir))
    fitted = regression.quadratic(e, "rater")
    r = regression.robust_errors(e, fitted, "rater").join(fitted.select("rater", (F.col("n").cast("long") - 3).alias("df")), "rater")
    p = lambda c: F.round(distributions.student_p(F.col(f"z_{c}"), F.col("df")), 6).alias(f"p_{c}")
    return r.select("rater", "df", F.round("z_b", 4).alias("t_b"), p("b"), F.round("z_c", 4).alias("t_c"), p("c"))


@query(f"""WITH o AS (SELECT x, y FROM {EVENTS} WHERE x IS NOT NULL AND y IS NOT NULL), s AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS sxx, covar_samp(x, y) AS sxy, var_samp(y) AS syy FROM o),
z AS (SELECT (x - mx) / sqrt(sxx) AS a, ((y - my) - sxy / sxx * (x - mx)) / sqrt(syy - sxy * sxy / sxx) AS b FROM o, s),
m AS (SELECT count(*) AS n, avg(a * a * a) ** 2 + 3 * avg(a * a * b) ** 2 + 3 * avg(a * b * b) ** 2 + avg(b * b * b) ** 2 AS b1, avg((a * a + b * b) ** 2) AS b2 FROM z)
SELECT n, round(b1, 6) AS b1, round(b2, 6) AS b2, round(n * b1 / 6, 3) AS skewness, round(exp(-n * b1 / 12) * (1 + n * b1 / 12), 6) AS p_skewness, round((b2 - 8) / sqrt(64.0 / n), 4) AS kurtosis FROM m""")
def b9_mardia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint normality of signal and rating."""
    m = normality.mardia(complete(events(spark, sf_dir)), ["x", "y"])
    return m.select("n", F.round("b1", 6).alias("b1"), F.round("b2", 6).alias("b2"), F.round("skewness", 3).alias("skewness"), F.round("p_skewness", 6).alias("p_skewness"), F.round("kurtosis", 4).alias("kurtosis"))


@query()
def b9_normality_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tests of raters' intercepts and slopes."""
    lines = shrinkage.rater_lines(regression.centred(complete(events(spark, sf_dir))))
    out = None
    for c in ("intercept", "slope"):
        one = normality.moment_tests(lines, c).crossJoin(normality.order_tests(lines, c).drop("n")).withColumn("variable", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


# ------------------------------------------------------------------ roll-ups

_KEYS, _SETS = ["corpus", "arm", "seed"], [["corpus", "arm", "seed"], ["corpus", "arm"], ["arm"], []]


@query(f"""WITH o AS (SELECT 'events' AS corpus, rater, obs_id, y FROM {EVENTS} WHERE y IS NOT NULL UNION ALL SELECT 'orders', rater, obs_id, y / 1000 FROM {ORDERS} WHERE y IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(seed || ':' || obs_id), 1, 8) AS BIGINT) % 2 = 1 AS held FROM (SELECT *, unnest([1, 2, 3]) AS seed FROM o)),
t AS (SELECT corpus, seed, rater, avg(y) AS m FROM h WHERE NOT held GROUP BY ALL), g AS (SELECT corpus, seed, avg(y) AS gm FROM h WHERE NOT held GROUP BY ALL),
e AS (SELECT h.corpus, h.seed, (y - gm) ** 2 AS population, (y - coalesce(m, gm)) ** 2 AS rater FROM h JOIN g USING (corpus, seed) LEFT JOIN t ON t.corpus = h.corpus AND t.seed = h.seed AND t.rater = h.rater WHERE held),
runs AS (SELECT corpus, seed, arm, sqrt(avg(v)) AS rmse FROM (SELECT corpus, seed, unnest(['population', 'rater']) AS arm, unnest([population, rater]) AS v FROM e) GROUP BY ALL)
SELECT corpus, arm, seed, CAST(GROUPING_ID(corpus, arm, seed) AS BIGINT) AS level, count(*) AS runs, round(avg(rmse), 5) AS mean, round(min(rmse), 5) AS least, round(max(rmse), 5) AS greatest FROM runs GROUP BY GROUPING SETS ((corpus, arm, seed), (corpus, arm), (arm), ())""")
def d2_run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two corpora, three seeds of a split in halves, two arms (mean of all, mean of the rater): every run and its roll-ups."""
    pick = lambda df, name, y: df.where("y is not null").select(F.lit(name).alias("corpus"), "rater", F.col("obs_id").cast("string").alias("obs_id"), y.alias("y"))
    o = pick(events(spark, sf_dir), "events", F.col("y")).unionByName(pick(orders(spark, sf_dir), "orders", F.col("y") / 1000))
    h = o.withColumn("seed", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("held", md5_int(F.concat_ws(":", F.col("seed").cast("string"), "obs_id")) % 2 == 1)
    # Sums of both halves per rater are all that means and errors need.
    half = lambda c, f, name: f(F.when(c, F.col("y"))).alias(name)
    held, train = F.col("held"), ~F.col("held")
    s = h.groupBy("corpus", "seed", "rater").agg(half(train, F.sum, "ts"), half(train, F.count, "tn"), half(held, F.count, "n"), half(held, F.avg, "m"), half(held, F.var_pop, "v"))
    grand = s.groupBy("corpus", "seed").agg((F.sum("ts") / F.sum("tn")).alias("gm"))
    own = F.coalesce(F.col("ts") / F.when(F.col("tn") > 0, F.col("tn")), F.col("gm"))
    sse = lambda at: F.col("n") * (F.col("v") + F.pow(F.col("m") - at, 2))
    runs = s.where("n > 0").join(F.broadcast(grand), ["corpus", "seed"]).groupBy("corpus", "seed").agg(F.sum("n").alias("n"), F.sum(sse(F.col("gm"))).alias("population"), F.sum(sse(own)).alias("rater"))
    runs = runs.select("corpus", "seed", F.inline(F.array(*(F.struct(F.lit(a).alias("arm"), F.sqrt(F.col(a) / F.col("n")).alias("rmse")) for a in ("population", "rater")))))
    return rounded(diagnostics.run_rollup(runs, _KEYS, "rmse", _SETS), 5)


@query(f"""WITH runs AS ({SQL["v11_subsample_sweep"]}), a AS (SELECT size, unnest(['population', 'rater', 'shrunk']) AS arm, unnest([rmse_population, rmse_rater, rmse_shrunk]) AS rmse FROM runs),
s AS (SELECT *, rmse - lag(rmse) OVER (PARTITION BY arm ORDER BY size) AS step FROM a), f AS (SELECT *, coalesce(step < 0, false) AS falls FROM s),
i AS (SELECT arm, falls, row_number() OVER (PARTITION BY arm ORDER BY size) - row_number() OVER (PARTITION BY arm, falls ORDER BY size) AS island FROM f), n AS (SELECT arm, falls, count(*) AS n FROM i GROUP BY arm, falls, island)
SELECT arm, count(*) AS levels, coalesce(bool_and(step < 0), false) AS always_falls, coalesce(bool_and(step > 0), false) AS always_rises, (SELECT coalesce(max(n) FILTER (n.falls), 0) FROM n WHERE n.arm = f.arm) AS longest_fall FROM f GROUP BY arm""")
def d2_errors_along_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does each arm's error fall with every size of the subsample, and over how many sizes in a row?"""
    runs = v11_subsample_sweep(spark, sf_dir)
    long = runs.select("size", F.inline(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(f"rmse_{a}").alias("rmse")) for a in ("population", "rater", "shrunk")))))
    return diagnostics.along_levels(long, "arm", "size", "rmse")
