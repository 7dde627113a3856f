"""Calibration queries: lines, splits, shrinkage, inference, pairs and simulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from raterline.functions import scalars
from raterline.operators import inference, regression, shrinkage, splits
from raterline.plans.registry import query
from raterline.plans.relational import EVENTS
from raterline.sources.files import written
from raterline.sources.observations import ORDERS_SQL, complete, events, md5_int, orders, table

SEED, K = 20260420, 5
ORDERS = f"({ORDERS_SQL})"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# ------------------------------------------------------------------ SQL building blocks

_SUMS = "CAST(count(*) AS DOUBLE) AS n, sum(cx) AS sx, sum(cy) AS sy, sum(cx * cx) AS sxx, sum(cx * cy) AS sxy, sum(cy * cy) AS syy, any_value(mx) AS mx, any_value(my) AS my"


def centred_sql(source: str) -> str:
    return f"obs AS (SELECT * FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL AND rater IS NOT NULL), mid AS (SELECT avg(x) AS mx, avg(y) AS my FROM obs), c AS (SELECT obs.*, mx, my, x - mx AS cx, y - my AS cy FROM obs, mid)"


def line_sql(name: str, source: str, guard: str = "a", p: str = "") -> str:
    """name AS (source's columns with spread, slope, intercept, v_slope, v_intercept)."""
    few = {"a": f"{p}n < 2", "b": f"{p}n < 3", "c": f"{p}n < 3", "d": f"{p}n < 2"}[guard]
    flat = {"a": f"spread / {p}n < 1e-12", "b": "spread < 1e-10", "c": "spread < 1e-10", "d": f"spread / {p}n < 1e-12"}[guard]
    s2 = f"greatest(total - cr * cr / spread, 0) / " + (f"greatest({p}n - 2, 1)" if guard in "ad" else f"({p}n - 2)")
    if guard == "d":
        s2 = f"CASE WHEN {p}n = 2 THEN CASE WHEN total > 0 THEN total / {p}n ELSE 1 END ELSE {s2} END"
    mean = {"a": f"coalesce(my + {p}sy / nullif({p}n, 0), 0)", "b": f"CASE WHEN {few} THEN NULL ELSE my + {p}sy / {p}n END", "c": "NULL", "d": f"coalesce(my + {p}sy / nullif({p}n, 0), 0)"}[guard]
    zero = {"a": "0", "b": f"CASE WHEN {few} THEN NULL ELSE 0 END", "c": "NULL", "d": "0"}[guard]
    return f"""{name}_s AS (SELECT *, {p}sxx - {p}sx * {p}sx / nullif({p}n, 0) AS spread, {p}sxy - {p}sx * {p}sy / nullif({p}n, 0) AS cr, {p}syy - {p}sy * {p}sy / nullif({p}n, 0) AS total FROM {source}),
{name}_f AS (SELECT *, coalesce(NOT ({few} OR {flat}), false) AS fits FROM {name}_s),
{name} AS (SELECT *, CAST(CASE WHEN fits THEN cr / spread ELSE {zero} END AS DOUBLE) AS slope, CAST(CASE WHEN fits THEN my + {p}sy / {p}n - cr / spread * (mx + {p}sx / {p}n) ELSE {mean} END AS DOUBLE) AS intercept,
 CASE WHEN fits THEN ({s2}) / greatest(spread, 1e-12) END AS v_slope, CASE WHEN fits THEN ({s2}) * (1 / {p}n + (mx + {p}sx / {p}n) * (mx + {p}sx / {p}n) / greatest(spread, 1e-12)) END AS v_intercept FROM {name}_f)"""


def sse_sql(a: str, b: str) -> str:
    a = f"({a} - my + {b} * mx)"
    return f"greatest(syy - 2 * {a} * sy - 2 * {b} * sxy + n * {a} * {a} + 2 * {a} * {b} * sx + {b} * {b} * sxx, 0)"


def folds_sql(source: str, fold: str, where: str = "true") -> str:
    """f: rows with pos, cnt and fold; c: the same centred."""
    return f"""obs AS (SELECT * FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL AND rater IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY rater ORDER BY md5('{SEED}:' || obs_id), obs_id) - 1 AS pos, count(*) OVER (PARTITION BY rater) AS cnt FROM obs),
f AS (SELECT *, CAST({fold} AS INTEGER) AS fold FROM p WHERE {where}),
mid AS (SELECT avg(x) AS mx, avg(y) AS my FROM f), c AS (SELECT f.*, mx, my, x - mx AS cx, y - my AS cy FROM f, mid)"""


K_FOLD = f"least(floor(pos / floor(cnt / {K})), {K - 1})"


def _weight(v: str, t2: str, v_floor: float | None, add: float) -> str:
    w = f"{t2} / ({t2} + {v} + {add})"
    return f"coalesce(CASE WHEN {v} >= {v_floor} THEN {w} END, 0)" if v_floor is not None else f"coalesce({w}, 0)"


def errors_sql(folds: str, *, guard: str = "a", floor: float = 1e-6, nested: bool = False, v_floor: float | None = None, add: float = 0.0) -> str:
    """CTEs up to e: per (rater, fold) the squared error of every arm; r: per rater the RMSEs."""
    sums = ("n", "sx", "sy", "sxx", "sxy", "syy")
    less = ", ".join(f"(sum({s}) OVER (PARTITION BY rater)) - {s} AS t_{s}" for s in sums)
    t2 = ", ".join(f"greatest(var_samp({c}) - avg(v_{c}), {floor}) AS t2_{c}" for c in ("intercept", "slope"))
    total = ", ".join(f"sum({s}) AS {s}" for s in sums) + ", any_value(mx) AS mx, any_value(my) AS my"
    if nested:
        fold_less = ", ".join(f"(sum({s}) OVER ()) - {s} AS t_{s}" for s in sums)
        middle = f"""pf AS (SELECT *, {fold_less} FROM (SELECT fold, {total} FROM parts GROUP BY fold)), {line_sql("pl", "pf", "a", "t_")},
t2 AS (SELECT fold, {t2} FROM fit GROUP BY fold), pop AS (SELECT pl.fold, intercept AS pop_intercept, slope AS pop_slope, t2_intercept, t2_slope FROM pl JOIN t2 USING (fold)),
j AS (SELECT fit.*, pop_intercept, pop_slope, t2_intercept, t2_slope FROM fit JOIN pop USING (fold))"""
    else:
        middle = f"""ra AS (SELECT rater, {total} FROM parts GROUP BY rater), {line_sql("rl", "ra", guard)}, t2 AS (SELECT {t2} FROM rl),
pa AS (SELECT {total} FROM parts), {line_sql("pl", "pa")}, pop AS (SELECT intercept AS pop_intercept, slope AS pop_slope FROM pl),
j AS (SELECT fit.*, pop_intercept, pop_slope, t2_intercept, t2_slope FROM fit, pop, t2)"""
    arms = {"mean": ("coalesce(my + t_sy / nullif(t_n, 0), 0)", "0"), "population": ("pop_intercept", "pop_slope"), "rater": ("intercept", "slope"), "shrunk": ("eb_intercept", "eb_slope"), "intercept_only": ("eb_intercept", "pop_slope"), "slope_only": ("pop_intercept", "eb_slope")}
    return f"""{folds}, parts0 AS (SELECT rater, fold, {_SUMS} FROM c GROUP BY ALL), parts AS (SELECT *, {less} FROM parts0), {line_sql("fit", "parts", guard, "t_")}, {middle},
w AS (SELECT *, {_weight("v_intercept", "t2_intercept", v_floor, add)} AS w_intercept, {_weight("v_slope", "t2_slope", v_floor, add)} AS w_slope FROM j),
eb AS (SELECT *, w_intercept * intercept + (1 - w_intercept) * pop_intercept AS eb_intercept, w_slope * slope + (1 - w_slope) * pop_slope AS eb_slope FROM w),
e AS (SELECT rater, fold, n, {", ".join(f"{sse_sql(a, b)} AS sse_{k}" for k, (a, b) in arms.items())} FROM eb),
r AS (SELECT rater, sum(n) AS n, {", ".join(f"sqrt(sum(sse_{k}) / sum(n)) AS rmse_{k}" for k in arms)} FROM e GROUP BY rater)"""


def evaluation_sql(folds: str, **options) -> str:
    return f"""WITH {errors_sql(folds, **options)} SELECT count(*) AS raters, {", ".join(f"round(avg(rmse_{k}), 6) AS rmse_{k}" for k in shrinkage.ARMS)},
round(1 - avg(rmse_shrunk) / avg(rmse_population), 6) AS gain_of_means, round(avg(1 - rmse_shrunk / nullif(rmse_population, 0)), 6) AS gain_of_ratios,
round(1 - sqrt(sum(n * rmse_shrunk * rmse_shrunk) / sum(n * rmse_population * rmse_population)), 6) AS gain_pooled, round(avg(CASE WHEN rmse_shrunk < rmse_population * (1 - 1e-9) THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM r"""


EVENT_FOLDS = folds_sql(EVENTS, K_FOLD, f"cnt >= {K}")
ORDER_FOLDS = folds_sql(ORDERS, K_FOLD, f"cnt >= {K}")


def event_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.k_folds(complete(events(spark, sf_dir)), K, SEED)


def rater_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of every arm per rater, stored: what bootstraps and ranks read again and again."""
    return written(shrinkage.rater_rmse(shrinkage.held_out_errors(event_folds(spark, sf_dir))), "rater-errors")


def drawn_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, numbered in the order of raters."""
    return written(inference.ordered(rater_errors(spark, sf_dir)), "rater-errors")


def order_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.k_folds(complete(orders(spark, sf_dir)), K, SEED)


# ------------------------------------------------------------------ the core query


@query(evaluation_sql(EVENT_FOLDS))
def core_shrinkage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shrinkage.evaluation(event_folds(spark, sf_dir)))


@query(evaluation_sql(ORDER_FOLDS))
def core_shrinkage_small_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shrinkage.evaluation(order_folds(spark, sf_dir)))


# ------------------------------------------------------------------ regression


@query(f"WITH {centred_sql(EVENTS)}, s AS (SELECT {_SUMS} FROM c), {line_sql('l', 's')} SELECT round(intercept, 6) AS intercept, round(slope, 9) AS slope FROM l")
def r1_population_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = regression.population_line(regression.centred(complete(events(spark, sf_dir))))
    return line.select(F.round("pop_intercept", 6).alias("intercept"), F.round("pop_slope", 9).alias("slope"))


def _rater_lines(guard: str) -> None:
    sql = f"WITH {centred_sql(ORDERS)}, s AS (SELECT rater, {_SUMS} FROM c GROUP BY rater), {line_sql('l', 's', guard)} SELECT rater, round(intercept, 3) AS intercept, round(slope, 4) AS slope, round(v_intercept / 1000000, 3) AS v_intercept, round(v_slope, 3) AS v_slope FROM l"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = shrinkage.rater_lines(regression.centred(complete(orders(spark, sf_dir))), guard)
        return lines.select("rater", F.round("intercept", 3).alias("intercept"), F.round("slope", 4).alias("slope"), F.round(F.col("v_intercept") / 1000000, 3).alias("v_intercept"), F.round("v_slope", 3).alias("v_slope"))

    run.__name__ = f"r2{guard}_rater_lines"
    query(sql)(run)


for _guard in "abcd":
    _rater_lines(_guard)


@query(f"""WITH o AS (SELECT rater, x, y, x - avg(x) OVER (PARTITION BY rater) AS d FROM {EVENTS} WHERE x IS NOT NULL AND y IS NOT NULL),
s AS (SELECT rater, CAST(count(*) AS DOUBLE) AS n, sum(d ** 2) AS p2, sum(d ** 3) AS p3, sum(d ** 4) AS p4, sum(y) AS q0, sum(d * y) AS q1, sum(d * d * y) AS q2, sum(y * y) AS yy FROM o GROUP BY rater),
t AS (SELECT *, n * (p2 * p4 - p3 * p3) - p2 * p2 * p2 AS det FROM s),
u AS (SELECT rater, n, yy, q0, q1, q2, p2, det, (q0 * (p2 * p4 - p3 * p3) + q1 * p2 * p3 - q2 * p2 * p2) / det AS a, (q0 * p2 * p3 + q1 * (n * p4 - p2 * p2) - q2 * n * p3) / det AS b, (-q0 * p2 * p2 - q1 * n * p3 + q2 * n * p2) / det AS c FROM t WHERE n >= 4 AND abs(det) > 1e-6)
SELECT rater, round(a, 6) AS a, round(b, 6) AS b, round(c, 8) AS c, round(greatest(yy - a * q0 - b * q1 - c * q2, 0) / greatest(n - 3, 1) * n * p2 / det * 1e6, 6) AS v_c FROM u""")
def r3_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = regression.quadratic(complete(events(spark, sf_dir)), "rater").where("a is not null")
    return q.select("rater", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("c", 8).alias("c"), F.round(F.col("v_c") * 1e6, 6).alias("v_c"))


@query(f"WITH {centred_sql(EVENTS)}, s AS (SELECT rater, {_SUMS} FROM c GROUP BY rater), {line_sql('l', 's')} SELECT obs_id, round(CASE WHEN abs(slope) <= 0.05 THEN y - intercept ELSE (y - intercept) / slope END, 5) AS corrected FROM c JOIN l USING (rater)")
def r5_inverse_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = regression.centred(complete(events(spark, sf_dir)))
    rest = F.col("y") - F.col("intercept")
    inverse = F.when(F.abs("slope") <= 0.05, rest).otherwise(rest / F.when(F.abs("slope") > 0.05, F.col("slope")))
    return c.select("rater", "obs_id", "y").join(shrinkage.rater_lines(c).select("rater", "intercept", "slope"), "rater").select("obs_id", F.round(inverse, 5).alias("corrected"))


@query(f"""WITH {EVENT_FOLDS}, s AS (SELECT rater, fold, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, min(x) AS lx, max(x) AS hx FROM f GROUP BY ALL),
t AS (SELECT a.rater, a.fold, sum(b.n) AS n, sum(b.sx) / sum(b.n) AS mx, sum(b.sxx) AS sxx, sum(b.sy) / sum(b.n) AS my, min(b.lx) AS lx, max(b.hx) AS hx FROM s a JOIN s b ON a.rater = b.rater AND a.fold <> b.fold GROUP BY ALL),
g AS (SELECT avg(y) AS gm, stddev_samp(y) AS gs FROM f),
z AS (SELECT f.obs_id, t.my AS by_mean, CASE WHEN sqrt(greatest(t.sxx / t.n - mx * mx, 0)) < 1e-9 THEN x - mx + gm ELSE (x - mx) / sqrt(greatest(t.sxx / t.n - mx * mx, 0)) * gs + gm END AS by_z, CASE WHEN hx - lx < 1e-9 THEN 50 ELSE 100 * (x - lx) / (hx - lx) END AS by_range FROM f JOIN t USING (rater, fold), g)
SELECT obs_id, round(by_mean, 9) AS by_mean, round(by_z, 5) AS by_z, round(by_range, 5) AS by_range FROM z""")
def r6_practical_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train mean, z-score and min-max of each rater's other folds."""
    f = event_folds(spark, sf_dir).select("rater", "obs_id", "fold", "x", "y")
    s = f.groupBy("rater", "fold").agg(F.count("*").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum("y").alias("sy"), F.min("x").alias("lx"), F.max("x").alias("hx"))
    own = Window.partitionBy("rater")
    others = F.filter(F.collect_list(F.struct("fold", "lx", "hx")).over(own), lambda v: v["fold"] != F.col("fold"))
    rest = lambda c: (F.sum(c).over(own)) - F.col(c)
    t = s.select(
        "rater", "fold", rest("n").alias("n"), (rest("sx") / rest("n")).alias("mx"), rest("sxx").alias("sxx"), (rest("sy") / rest("n")).alias("my"),
        F.array_min(F.transform(others, lambda v: v["lx"])).alias("lx"), F.array_max(F.transform(others, lambda v: v["hx"])).alias("hx"),
    )
    g = f.agg(F.avg("y").alias("gm"), F.stddev_samp("y").alias("gs"))
    sd = F.sqrt(F.greatest(F.col("sxx") / F.col("n") - F.col("mx") * F.col("mx"), F.lit(0.0)))
    z = F.when(sd < 1e-9, F.col("x") - F.col("mx") + F.col("gm")).otherwise((F.col("x") - F.col("mx")) / F.when(sd >= 1e-9, sd) * F.col("gs") + F.col("gm"))
    span = F.col("hx") - F.col("lx")
    scaled = F.when(span < 1e-9, 50.0).otherwise(100 * (F.col("x") - F.col("lx")) / F.when(span >= 1e-9, span))
    return f.join(t, ["rater", "fold"]).crossJoin(F.broadcast(g)).select("obs_id", F.round("my", 9).alias("by_mean"), F.round(z, 5).alias("by_z"), F.round(scaled, 5).alias("by_range"))


@query(f"WITH a AS (SELECT 'events' AS corpus, rater, y FROM {EVENTS} UNION ALL SELECT 'orders', rater, y FROM {ORDERS}), m AS (SELECT corpus, avg(y) AS m, stddev_pop(y) AS s FROM a GROUP BY 1 HAVING stddev_pop(y) > 0) SELECT corpus || '::' || rater AS cluster, count(*) AS n, round(avg((y - m) / s), 6) AS mean_z FROM a JOIN m USING (corpus) GROUP BY 1")
def r7_pooled_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda df, name: df.select(F.lit(name).alias("corpus"), "rater", "y")
    a = part(events(spark, sf_dir), "events").unionByName(part(orders(spark, sf_dir), "orders"))
    m = a.groupBy("corpus").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).where("s > 0")
    z = a.join(F.broadcast(m), "corpus").withColumn("z", (F.col("y") - F.col("m")) / F.col("s"))
    return z.groupBy(F.concat_ws("::", "corpus", F.col("rater").cast("string")).alias("cluster")).agg(F.count("*").alias("n"), F.round(F.avg("z"), 6).alias("mean_z"))


@query(f"SELECT rater, round(sum(x * y) / nullif(sum(x * x), 0), 6) AS slope, round(1 - (sum(y * y) - sum(x * y) * sum(x * y) / nullif(sum(x * x), 0)) / nullif(sum(y * y), 0), 6) AS r2 FROM {EVENTS} GROUP BY rater")
def r8_through_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    xy, xx, yy = (F.sum(F.col(a) * F.col(b)) for a, b in ("xy", "xx", "yy"))
    some = lambda c: F.when(c != 0, c)
    return events(spark, sf_dir).groupBy("rater").agg(F.round(xy / some(xx), 6).alias("slope"), F.round(1 - (yy - xy * xy / some(xx)) / some(yy), 6).alias("r2"))


# ------------------------------------------------------------------ splits

_SMALL = "floor(cnt / 7)"


@query(f"WITH {EVENT_FOLDS} SELECT obs_id, fold FROM f")
def v1_k_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_folds(spark, sf_dir).select("obs_id", "fold")


@query(f"WITH {folds_sql(EVENTS, 'pos % 5')} SELECT obs_id, fold FROM f")
def v2_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.round_robin(complete(events(spark, sf_dir)), 5, SEED).select("obs_id", "fold")


@query(f"WITH {folds_sql(EVENTS, f'CASE WHEN pos < (cnt % 7) * ({_SMALL} + 1) THEN floor(pos / ({_SMALL} + 1)) ELSE cnt % 7 + floor((pos - (cnt % 7) * ({_SMALL} + 1)) / nullif({_SMALL}, 0)) END')} SELECT obs_id, fold FROM f")
def v3_balanced_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.balanced(complete(events(spark, sf_dir)), 7, SEED).select("obs_id", "fold")


@query(f"WITH g AS (SELECT *, unnest(range(0, 3)) AS repeat FROM {EVENTS} WHERE x IS NOT NULL AND y IS NOT NULL), p AS (SELECT *, row_number() OVER (PARTITION BY rater, repeat ORDER BY md5('{SEED}:' || repeat || ':' || obs_id), obs_id) - 1 AS pos, count(*) OVER (PARTITION BY rater, repeat) AS cnt FROM g) SELECT obs_id, CAST(repeat AS INTEGER) AS repeat, pos < greatest(1, floor(cnt / 5)) AS held_out FROM p")
def v4_repeated_holdouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.repeated_holdouts(complete(events(spark, sf_dir)), 3, 5, SEED).select("obs_id", "repeat", "held_out")


@query(f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY rater ORDER BY ts, obs_id) - 1 AS pos, count(*) OVER (PARTITION BY rater) AS cnt FROM {EVENTS} WHERE x IS NOT NULL AND y IS NOT NULL), h AS (SELECT *, greatest(1, CAST(round_even(cnt * 0.2, 0) AS INTEGER)) AS held FROM p) SELECT obs_id, pos >= cnt - held AS held_out FROM h WHERE cnt - held >= 2")
def v5_temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.temporal(complete(events(spark, sf_dir))).select("obs_id", "held_out")


@query(f"WITH r AS (SELECT DISTINCT rater FROM {EVENTS}) SELECT rater, row_number() OVER (ORDER BY md5('{SEED}:' || rater), rater) <= floor(count(*) OVER () * 0.3) AS held_out FROM r")
def v6_disjoint_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.disjoint_raters(events(spark, sf_dir), 0.3, SEED)


@query(f"WITH g AS (SELECT DISTINCT rater, grp FROM {EVENTS}), h AS (SELECT rater, grp, row_number() OVER (PARTITION BY rater ORDER BY md5('{SEED}:' || rater || ':' || grp), grp) <= floor(count(*) OVER (PARTITION BY rater) / 2) AS held_out FROM g) SELECT obs_id, held_out FROM {EVENTS} JOIN h USING (rater, grp)")
def v7_half_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.half_of_groups(events(spark, sf_dir), SEED).select("obs_id", "held_out")


_GROUP_FOLDS = f"f AS (SELECT *, grp AS fold FROM {EVENTS} WHERE x IS NOT NULL AND y IS NOT NULL), mid AS (SELECT avg(x) AS mx, avg(y) AS my FROM f), c AS (SELECT f.*, mx, my, x - mx AS cx, y - my AS cy FROM f, mid)"


@query(evaluation_sql(_GROUP_FOLDS))
def v8_leave_one_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shrinkage.evaluation(complete(events(spark, sf_dir)).withColumn("fold", F.col("grp"))))


@query(evaluation_sql(EVENT_FOLDS, nested=True))
def v9_nested_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shrinkage.evaluation(event_folds(spark, sf_dir), nested=True))


_BUDGETS = f"obs AS (SELECT *, row_number() OVER (PARTITION BY rater ORDER BY ts, obs_id) AS pos, count(*) OVER (PARTITION BY rater) AS cnt FROM {EVENTS} WHERE x IS NOT NULL AND y IS NOT NULL), g AS (SELECT *, unnest([2, 5, 10, 20]) AS budget FROM obs), k AS (SELECT *, pos <= budget AS train FROM g WHERE cnt >= budget + 2)"


@query(f"WITH {_BUDGETS}, m AS (SELECT rater, budget, avg(y) FILTER (train) AS m FROM k GROUP BY ALL), e AS (SELECT rater, budget, sqrt(avg((y - m) ** 2)) AS rmse FROM k JOIN m USING (rater, budget) WHERE NOT train GROUP BY ALL) SELECT budget, count(*) AS raters, round(avg(rmse), 6) AS rmse FROM e GROUP BY budget")
def v10_cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out error of the mean of the first k ratings, from sums alone."""
    k = splits.first_k(complete(events(spark, sf_dir)), [2, 5, 10, 20])
    t, y = F.col("train"), F.col("y")
    s = k.groupBy("rater", "budget").agg(F.avg(F.when(t, y)).alias("m"), F.count_if(~t).alias("n"), F.sum(F.when(~t, y)).alias("sy"), F.sum(F.when(~t, y * y)).alias("syy"))
    rmse = F.sqrt(F.greatest((F.col("syy") - 2 * F.col("m") * F.col("sy")) / F.col("n") + F.col("m") * F.col("m"), F.lit(0.0)))
    return s.groupBy("budget").agg(F.count("*").alias("raters"), F.round(F.avg(rmse), 6).alias("rmse"))


@query(f"WITH r AS (SELECT rater, count(*) AS n, avg(y) AS m, var_samp(y) AS v FROM {EVENTS} GROUP BY rater), g AS (SELECT *, unnest([50, 60, 65, 70, 75]) AS least FROM r) SELECT least, count(*) AS raters, round(avg(m), 6) AS mean_m, round(var_samp(m), 6) AS between, round(avg(v / n), 6) AS within FROM g WHERE n >= least GROUP BY least")
def v11_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan for all thresholds: raters are multiplied by the settings, rows are not."""
    r = events(spark, sf_dir).groupBy("rater").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_samp("y").alias("v"))
    g = r.withColumn("least", F.explode(F.array(*map(F.lit, (50, 60, 65, 70, 75))))).where("n >= least")
    return g.groupBy("least").agg(F.count("*").alias("raters"), F.round(F.avg("m"), 6).alias("mean_m"), F.round(F.var_samp("m"), 6).alias("between"), F.round(F.avg(F.col("v") / F.col("n")), 6).alias("within"))


@query(f"WITH f AS (SELECT rater, grp, avg(y) AS m FROM {EVENTS} GROUP BY ALL) SELECT a.grp AS source, b.grp AS target, count(*) AS raters, round(sqrt(avg((a.m - b.m) ** 2)), 6) AS rmse FROM f a JOIN f b USING (rater) GROUP BY ALL")
def v12_transfer_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean-only transfer between the groups of each rater; groups are few."""
    f = events(spark, sf_dir).groupBy("rater", "grp").agg(F.avg("y").alias("m"))
    a, b = (f.select("rater", F.col("grp").alias(n), F.col("m").alias(f"m_{n}")) for n in ("source", "target"))
    d = F.col("m_source") - F.col("m_target")
    return a.join(b, "rater").groupBy("source", "target").agg(F.count("*").alias("raters"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"))


# ------------------------------------------------------------------ empirical Bayes


def _tau(floor: float) -> str:
    return f"WITH {centred_sql(ORDERS)}, s AS (SELECT rater, {_SUMS} FROM c GROUP BY rater), {line_sql('l', 's')} SELECT round(greatest(var_samp(intercept) - avg(v_intercept), {floor}) / 1e6, 4) AS t2_intercept, round(greatest(var_samp(slope) - avg(v_slope), {floor}), 2) AS t2_slope FROM l"


def _tau_df(spark: SparkSession, sf_dir: str, floor: float) -> DataFrame:
    t = shrinkage.between_variance(shrinkage.rater_lines(regression.centred(complete(orders(spark, sf_dir)))), floor=floor)
    return t.select(F.round(F.col("t2_intercept") / 1e6, 4).alias("t2_intercept"), F.round("t2_slope", 2).alias("t2_slope"))


@query(_tau(1e-6))
def e1a_between_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tau_df(spark, sf_dir, 1e-6)


@query(_tau(0))
def e1b_between_variance_from_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tau_df(spark, sf_dir, 0.0)


@query(f"WITH {centred_sql(EVENTS)}, s AS (SELECT rater, {_SUMS} FROM c GROUP BY rater), {line_sql('l', 's')}, k AS (SELECT count(*) FILTER (v_slope < 0.03) >= 100 AS enough FROM l), u AS (SELECT l.* FROM l, k WHERE NOT enough OR v_slope < 0.03) SELECT count(*) AS used, round(greatest(var_samp(intercept) - avg(v_intercept), 0), 5) AS t2_intercept, round(greatest(var_samp(slope) - avg(v_slope), 0), 7) AS t2_slope FROM u")
def e1c_reliable_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only raters with a precise slope count, unless fewer than 100 have one."""
    lines = shrinkage.rater_lines(regression.centred(complete(events(spark, sf_dir))))
    enough = lines.agg((F.count_if(F.col("v_slope") < 0.03) >= 100).alias("enough"))
    used = lines.crossJoin(F.broadcast(enough)).where(~F.col("enough") | (F.col("v_slope") < 0.03))
    t2 = lambda c, d: F.round(F.greatest(F.var_samp(c) - F.avg(f"v_{c}"), F.lit(0.0)), d).alias(f"t2_{c}")
    return used.agg(F.count("*").alias("used"), t2("intercept", 5), t2("slope", 7))


@query(f"WITH {centred_sql(EVENTS)}, s AS (SELECT rater, {_SUMS} FROM c GROUP BY rater), {line_sql('l', 's')}, t AS (SELECT greatest(var_samp(slope) - avg(v_slope), 0) AS t2, avg(v_slope) AS v FROM l) SELECT round(least(greatest(t2 / (t2 + v), 0), 1), 6) AS common_weight FROM t")
def e1d_common_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = shrinkage.rater_lines(regression.centred(complete(events(spark, sf_dir))))
    t = lines.agg(F.greatest(F.var_samp("slope") - F.avg("v_slope"), F.lit(0.0)).alias("t2"), F.avg("v_slope").alias("v"))
    return t.select(F.round(scalars.clipped(F.col("t2") / (F.col("t2") + F.col("v")), 0.0, 1.0), 6).alias("common_weight"))


@query(f"WITH {centred_sql(EVENTS)}, s AS (SELECT rater, {_SUMS} FROM c GROUP BY rater), {line_sql('l', 's')}, s1 AS (SELECT {_SUMS} FROM c), {line_sql('p', 's1')} SELECT round(p.intercept, 6) AS pooled_intercept, round(p.slope, 8) AS pooled_slope, round((SELECT avg(intercept) FROM l), 6) AS mean_intercept, round((SELECT avg(slope) FROM l), 8) AS mean_slope FROM p")
def e1e_population_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = regression.centred(complete(events(spark, sf_dir)))
    pooled = regression.population_line(c).select(F.round("pop_intercept", 6).alias("pooled_intercept"), F.round("pop_slope", 8).alias("pooled_slope"))
    mean = shrinkage.mean_centre(shrinkage.rater_lines(c)).select(F.round("pop_intercept", 6).alias("mean_intercept"), F.round("pop_slope", 8).alias("mean_slope"))
    return pooled.crossJoin(F.broadcast(mean))


@query(f"WITH {centred_sql(ORDERS)}, s AS (SELECT rater, {_SUMS} FROM c GROUP BY rater), {line_sql('l', 's')}, t AS (SELECT greatest(var_samp(intercept) - avg(v_intercept), 1e-6) AS ti, greatest(var_samp(slope) - avg(v_slope), 1e-6) AS ts FROM l) SELECT rater, round(coalesce(ti / (ti + v_intercept), 0), 6) AS w_intercept, round(coalesce(ts / (ts + v_slope), 0), 6) AS w_slope FROM l, t")
def e2_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = shrinkage.rater_lines(regression.centred(complete(orders(spark, sf_dir))))
    s = shrinkage.shrunk(lines.crossJoin(F.broadcast(shrinkage.between_variance(lines))).crossJoin(F.broadcast(shrinkage.mean_centre(lines))))
    return s.select("rater", F.round("w_intercept", 6).alias("w_intercept"), F.round("w_slope", 6).alias("w_slope"))


@query(evaluation_sql(ORDER_FOLDS, v_floor=1e-6))
def e2b_variance_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shrinkage.evaluation(order_folds(spark, sf_dir), v_floor=1e-6))


@query(evaluation_sql(ORDER_FOLDS, add=1e-12, floor=0))
def e2c_guarded_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shrinkage.evaluation(order_folds(spark, sf_dir), add=1e-12, floor=0.0))


@query(f"WITH {centred_sql(EVENTS)}, s AS (SELECT rater, {_SUMS} FROM c WHERE rater % 3 <> 0 GROUP BY rater), {line_sql('l', 's')}, s1 AS (SELECT {_SUMS} FROM c), {line_sql('p', 's1')} SELECT obs_id, round(coalesce(l.intercept, p.intercept) + coalesce(l.slope, p.slope) * x, 5) AS calibrated FROM c LEFT JOIN l USING (rater), p")
def e3_apply_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raters divisible by three stand for unknown ones: they take the population line."""
    c = regression.centred(complete(events(spark, sf_dir)))
    known = shrinkage.rater_lines(c.where("rater % 3 <> 0"))
    out = shrinkage.calibrated(c.select("rater", "obs_id", "x"), known, regression.population_line(c))
    return out.select("obs_id", F.round("calibrated", 5).alias("calibrated"))


@query(f"WITH {errors_sql(EVENT_FOLDS)} SELECT rater, arm, round(rmse, 6) AS rmse FROM (SELECT rater, rmse_mean AS mean, rmse_population AS population, rmse_rater AS rater_line, rmse_shrunk AS shrunk FROM r) UNPIVOT (rmse FOR arm IN (mean, population, rater_line, shrunk))")
def e4_four_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = shrinkage.rater_rmse(shrinkage.held_out_errors(event_folds(spark, sf_dir)))
    wide = r.select("rater", F.col("rmse_mean").alias("mean"), F.col("rmse_population").alias("population"), F.col("rmse_rater").alias("rater_line"), F.col("rmse_shrunk").alias("shrunk"))
    return wide.unpivot("rater", ["mean", "population", "rater_line", "shrunk"], "arm", "rmse").withColumn("rmse", F.round("rmse", 6))


@query(f"WITH {errors_sql(EVENT_FOLDS)} SELECT {', '.join(f'round(1 - avg(rmse_{a}) / avg(rmse_population), 6) AS gain_{a}' for a in ('intercept_only', 'slope_only', 'shrunk'))} FROM r")
def e5_component_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = shrinkage.rater_rmse(shrinkage.held_out_errors(event_folds(spark, sf_dir)))
    return r.agg(*(F.round(1 - F.avg(f"rmse_{a}") / F.avg("rmse_population"), 6).alias(f"gain_{a}") for a in ("intercept_only", "slope_only", "shrunk")))


@query(f"WITH {errors_sql(ORDER_FOLDS)} SELECT round(1 - avg(rmse_rater) / avg(rmse_population), 6) AS gain_of_means, round(avg(1 - rmse_rater / nullif(rmse_population, 0)), 6) AS gain_of_ratios, round(1 - sqrt(sum(n * rmse_rater * rmse_rater) / sum(n * rmse_population * rmse_population)), 6) AS gain_pooled, count(*) AS raters, round(avg(CASE WHEN rmse_rater < rmse_population * (1 - 1e-9) THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM r")
def e6_three_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shrinkage.gains(shrinkage.rater_rmse(shrinkage.held_out_errors(order_folds(spark, sf_dir))), arm="rater"))


@query(f"WITH {centred_sql(EVENTS)}, s1 AS (SELECT {_SUMS} FROM c), {line_sql('p', 's1')}, q AS (SELECT rater, y - intercept - slope * x AS r FROM c, p), e AS (SELECT rater, count(*) AS n, avg(r) AS mean_r, var_samp(r) / count(*) AS v FROM q GROUP BY rater), t AS (SELECT greatest(var_samp(mean_r) - avg(v), 0) AS t2 FROM e) SELECT rater, round(coalesce(t2 / (t2 + v), 0), 6) AS w, round(coalesce(t2 / (t2 + v), 0) * mean_r, 6) AS shift FROM e, t")
def e7_residual_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shrinkage.residual_means(complete(events(spark, sf_dir))).select("rater", F.round("w", 6).alias("w"), F.round("shift", 6).alias("shift"))


@query(f"WITH r AS (SELECT rater, CAST(count(*) AS DOUBLE) AS n, avg(y) AS m, var_samp(y) AS v FROM {ORDERS} GROUP BY rater HAVING count(*) >= 2), t AS (SELECT greatest(var_samp(m) - avg(v / n), 0) AS t2, sum((n - 1) * v) / sum(n - 1) AS s2, count(*) / sum(1 / n) AS harmonic FROM r) SELECT round(harmonic, 6) AS harmonic_n, round(harmonic * t2 / s2, 6) AS ratio, round(1 - sqrt((s2 + s2 * t2 / (harmonic * t2 + s2)) / (s2 + t2)), 6) AS forecast_gain FROM t")
def e8_forecast_of_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected gain of shrunk rater means from variances alone, at the harmonic mean of rater sizes."""
    r = orders(spark, sf_dir).groupBy("rater").agg(F.count("*").cast("double").alias("n"), F.avg("y").alias("m"), F.var_samp("y").alias("v")).where("n >= 2")
    n, v = F.col("n"), F.col("v")
    t = r.agg(F.greatest(F.var_samp("m") - F.avg(v / n), F.lit(0.0)).alias("t2"), (F.sum((n - 1) * v) / F.sum(n - 1)).alias("s2"), (F.count("*") / F.sum(1 / n)).alias("h"))
    t2, s2, h = F.col("t2"), F.col("s2"), F.col("h")
    return t.select(F.round(h, 6).alias("harmonic_n"), F.round(h * t2 / s2, 6).alias("ratio"), F.round(1 - F.sqrt((s2 + s2 * t2 / (h * t2 + s2)) / (s2 + t2)), 6).alias("forecast_gain"))


@query(f"WITH p AS (SELECT rater, y, row_number() OVER (PARTITION BY rater ORDER BY ts, obs_id) * 2 <= count(*) OVER (PARTITION BY rater) AS early FROM {EVENTS}), h AS (SELECT rater, avg(y) FILTER (early) AS a, avg(y) FILTER (NOT early) AS b FROM p GROUP BY rater), r AS (SELECT count(*) AS n, avg(y) AS m, var_samp(y) AS v FROM {EVENTS} GROUP BY rater) SELECT round((SELECT corr(a, b) FROM h), 6) AS split_half, round(greatest(var_samp(m) - avg(v / n), 0) / (avg(v) / avg(n)), 6) AS signal_to_noise FROM r")
def e9_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    w = Window.partitionBy("rater")
    p = e.withColumn("early", F.row_number().over(w.orderBy("ts", "obs_id")) * 2 <= F.count("*").over(w))
    h = p.groupBy("rater").agg(F.avg(F.when(F.col("early"), F.col("y"))).alias("a"), F.avg(F.when(~F.col("early"), F.col("y"))).alias("b"))
    r = e.groupBy("rater").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_samp("y").alias("v"))
    snr = F.greatest(F.var_samp("m") - F.avg(F.col("v") / F.col("n")), F.lit(0.0)) / (F.avg("v") / F.avg("n"))
    return h.agg(F.round(F.corr("a", "b"), 6).alias("split_half")).crossJoin(F.broadcast(r.agg(F.round(snr, 6).alias("signal_to_noise"))))


# ------------------------------------------------------------------ inference

_DRAWS = "i AS (SELECT *, row_number() OVER (ORDER BY rater) - 1 AS idx, count(*) OVER () AS m FROM r), d AS (SELECT b, CAST('0x' || substr(md5('7:' || b || ':' || idx), 1, 8) AS BIGINT) % m AS idx FROM i, range(0, 200) g(b)), k AS (SELECT b, i.* FROM d JOIN i USING (idx))"


@query(f"WITH {errors_sql(EVENT_FOLDS)}, {_DRAWS}, g AS (SELECT b, 1 - avg(rmse_rater) / avg(rmse_population) AS gain FROM k GROUP BY b) SELECT round(quantile_cont(gain, 0.025), 6) AS low, round(quantile_cont(gain, 0.975), 6) AS high, count(gain) AS valid FROM g")
def b1_rater_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = drawn_from(spark, sf_dir)
    gain = (1 - F.avg("rmse_rater") / F.avg("rmse_population")).alias("gain")
    return rounded(inference.percentile_interval(inference.bootstrap(r, 200, 7, gain), "gain"))


@query(f"WITH {errors_sql(EVENT_FOLDS)}, {_DRAWS}, g AS (SELECT b, 1 - sqrt(sum(n * rmse_rater ** 2) / sum(n * rmse_population ** 2)) AS gain FROM k GROUP BY b), jk AS (SELECT 1 - sqrt(((sum(n * rmse_rater ** 2) OVER ()) - n * rmse_rater ** 2) / ((sum(n * rmse_population ** 2) OVER ()) - n * rmse_population ** 2)) AS gain FROM r) SELECT round(quantile_cont(gain, 0.025), 6) AS low, round(quantile_cont(gain, 0.975), 6) AS high, count(gain) AS valid, round((SELECT avg(gain) FROM jk), 6) AS jackknife_mean, round((SELECT stddev_pop(gain) FROM jk), 8) AS jackknife_sd FROM g")
def b2_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled-row errors resampled by rater: each rater's squared-error sums are enough."""
    r = drawn_from(spark, sf_dir)
    s = r.select("idx", "m", (F.col("n") * F.col("rmse_population") ** 2).alias("base"), (F.col("n") * F.col("rmse_rater") ** 2).alias("model"))
    gain = lambda model, base: 1 - F.sqrt(model / base)
    whole = s.agg(F.sum("base").alias("all_base"), F.sum("model").alias("all_model"))
    j = s.crossJoin(F.broadcast(whole)).select(gain(F.col("all_model") - F.col("model"), F.col("all_base") - F.col("base")).alias("g"))
    ci = inference.percentile_interval(inference.bootstrap(s, 200, 7, gain(F.sum("model"), F.sum("base")).alias("gain")), "gain")
    return rounded(ci).crossJoin(F.broadcast(j.agg(F.round(F.avg("g"), 6).alias("jackknife_mean"), F.round(F.stddev_pop("g"), 8).alias("jackknife_sd"))))


_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2"


@query(f"WITH {errors_sql(EVENT_FOLDS)}, d AS (SELECT n, rmse_population - rmse_rater AS gain FROM r), k AS (SELECT {_RANK.format('n')} AS a, {_RANK.format('gain')} AS b FROM d) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM k")
def b4_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rater_errors(spark, sf_dir)
    d = r.select(F.col("n").alias("size"), (F.col("rmse_population") - F.col("rmse_rater")).alias("gain"))
    return inference.spearman(d, "size", "gain").select(F.round("rho", 6).alias("rho"), "n")


@query(f"WITH {errors_sql(EVENT_FOLDS)}, d AS (SELECT rmse_population - rmse_rater AS d FROM r), k AS (SELECT d, {_RANK.format('abs(d)')} AS rk FROM d WHERE d <> 0), s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS w_minus FROM k), t AS (SELECT sum(c * c * c - c) AS tie FROM (SELECT count(*) AS c FROM k GROUP BY abs(d))) SELECT n, w_plus, w_minus, round((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48), 6) AS z, round((SELECT avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) FROM d), 6) AS win_fraction FROM s, t")
def b5_paired_wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rater_errors(spark, sf_dir)
    return rounded(inference.wilcoxon(r, "rmse_population", "rmse_rater"))


@query(f"WITH {errors_sql(EVENT_FOLDS)}, s AS (SELECT avg(rmse_population - rmse_rater) / stddev_samp(rmse_population - rmse_rater) AS d, (avg(rmse_population) - avg(rmse_rater)) / sqrt((var_samp(rmse_population) + var_samp(rmse_rater)) / 2) AS p, count(*) AS n FROM r) SELECT round(d, 6) AS d_paired, round(p, 6) AS d_pooled, n, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS label FROM s")
def b6_effect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.cohens_d(shrinkage.rater_rmse(shrinkage.held_out_errors(event_folds(spark, sf_dir))), "rmse_population", "rmse_rater"))


_Z = 1.959963984540054


@query(f"WITH s AS (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS k, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT *, k / n AS p, {_Z * _Z} / n AS m FROM s) SELECT l_returnflag, round(p, 6) AS accuracy, round((p + m / 2 - {_Z} * sqrt(p * (1 - p) / n + m / (4 * n))) / (1 + m), 6) AS low, round((p + m / 2 + {_Z} * sqrt(p * (1 - p) / n + m / (4 * n))) / (1 + m), 6) AS high, round((SELECT avg(p) FROM p), 6) AS macro, round((SELECT sum(k) / sum(n) FROM p), 6) AS micro FROM p")
def b8_wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("k"), F.count("*").alias("n"))
    low, high = inference.wilson(F.col("k"), F.col("n"))
    all_ = s.agg(F.round(F.avg(F.col("k") / F.col("n")), 6).alias("macro"), F.round(F.sum("k") / F.sum("n"), 6).alias("micro"))
    return s.select("l_returnflag", F.round(F.col("k") / F.col("n"), 6).alias("accuracy"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high")).crossJoin(F.broadcast(all_))


@query(f"WITH g AS (SELECT grp, CAST(count(*) AS DOUBLE) AS n, avg(y) AS m, var_pop(y) AS v FROM {EVENTS} GROUP BY grp), s AS (SELECT count(*) AS groups, sum(n) AS n, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b, sum(n * v) AS w FROM g), j AS (SELECT count(*) AS c, avg((y - m) ** 3) / pow(avg((y - m) ** 2), 1.5) AS sk, avg((y - m) ** 4) / avg((y - m) ** 2) ** 2 - 3 AS ku FROM (SELECT y, avg(y) OVER () AS m FROM {EVENTS})) SELECT groups, n, round(b / (groups - 1) / (w / (n - groups)), 6) AS f, round(b / (b + w), 8) AS eta_squared, round(c / 6 * (sk * sk + ku * ku / 4), 3) AS jb FROM s, j")
def b9_anova_and_normality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    a = inference.anova(e, "grp", "y").select("groups", "n", F.round("f", 6).alias("f"), F.round("eta_squared", 8).alias("eta_squared"))
    return a.crossJoin(F.broadcast(inference.jarque_bera(e, "y").select(F.round("jb", 3).alias("jb"))))


# ------------------------------------------------------------------ preference pairs

_GROUPED = f"e AS (SELECT rater, CAST(ts AS DATE) AS day, grp, obs_id, x, y FROM {EVENTS})"


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("day", F.to_date("ts"))


@query(f"WITH {_GROUPED}, g AS (SELECT rater, day FROM e GROUP BY ALL HAVING count(*) FILTER (grp = 'purchase') = 1 AND count(*) FILTER (grp <> 'purchase') >= 1) SELECT a.rater, a.obs_id AS chosen, b.obs_id AS rejected FROM g JOIN e a USING (rater, day) JOIN e b USING (rater, day) WHERE a.grp = 'purchase' AND b.grp <> 'purchase'")
def k1_chosen_and_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of rater and day with exactly one chosen row."""
    e = grouped(spark, sf_dir)
    chosen = e.groupBy("rater", "day").agg(F.count_if(F.col("grp") == "purchase").alias("n"), F.max(F.when(F.col("grp") == "purchase", F.col("obs_id"))).alias("chosen")).where("n = 1").drop("n")
    return chosen.join(e.where("grp != 'purchase'").select("rater", "day", F.col("obs_id").alias("rejected")), ["rater", "day"]).select("rater", "chosen", "rejected")


@query(f"WITH {_GROUPED}, c AS (SELECT rater, day, min(obs_id) AS chosen FROM e WHERE grp = 'purchase' GROUP BY ALL), j AS (SELECT e.rater, e.day, e.obs_id, row_number() OVER (PARTITION BY e.rater, e.day ORDER BY CASE WHEN grp = 'error' THEN NULL ELSE y END ASC NULLS LAST, e.obs_id) AS r FROM e WHERE grp <> 'purchase') SELECT c.rater, chosen, j.obs_id AS rejected FROM c JOIN j ON c.rater = j.rater AND c.day = j.day AND j.r = 1")
def k2_observed_choice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen row against the lowest-rated other, unrated ones last."""
    e = grouped(spark, sf_dir)
    chosen = e.where("grp = 'purchase'").groupBy("rater", "day").agg(F.min("obs_id").alias("chosen"))
    rating = F.when(F.col("grp") != "error", F.col("y"))
    low = e.where("grp != 'purchase'").groupBy("rater", "day").agg(F.min(F.struct(rating.isNull().alias("none"), rating.alias("rating"), "obs_id")).alias("b"))
    return chosen.join(low, ["rater", "day"]).select("rater", "chosen", F.col("b.obs_id").alias("rejected"))


@query(f"WITH {_GROUPED}, g AS (SELECT rater, day, max(x) AS hi, min(x) AS lo FROM e GROUP BY ALL HAVING max(x) > min(x)) SELECT g.rater, min(e.obs_id) FILTER (e.x = hi) AS chosen, min(e.obs_id) FILTER (e.x = lo) AS rejected FROM g JOIN e USING (rater, day) GROUP BY g.rater, g.day")
def k3_calibrated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest against lowest score of a group; groups whose scores are all equal are skipped."""
    s = grouped(spark, sf_dir).groupBy("rater", "day").agg(F.max(F.struct("x", (-F.col("obs_id")).alias("k"))).alias("hi"), F.min(F.struct("x", "obs_id")).alias("lo"))
    return s.where("hi.x > lo.x").select("rater", (-F.col("hi.k")).alias("chosen"), F.col("lo.obs_id").alias("rejected"))


_PAIRS = f"{_GROUPED}, p AS (SELECT a.rater, a.obs_id AS c, b.obs_id AS r, a.x - b.x AS margin, abs(a.y - b.y) AS gap FROM e a JOIN e b ON a.rater = b.rater AND a.day = b.day WHERE a.grp = 'purchase' AND b.grp = 'view')"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = grouped(spark, sf_dir)
    c = e.where("grp = 'purchase'").select("rater", "day", F.col("obs_id").alias("c"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    r = e.where("grp = 'view'").select("rater", "day", F.col("obs_id").alias("r"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return c.join(r, ["rater", "day"]).select("rater", "c", "r", (F.col("cx") - F.col("rx")).alias("margin"), F.abs(F.col("cy") - F.col("ry")).alias("gap"))


@query(f"WITH {_PAIRS}, a AS (SELECT rater, count(*) AS n, avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END) AS s, avg(CASE WHEN margin > 0 THEN 1.0 WHEN margin = 0 THEN 0.5 ELSE 0.0 END) AS h FROM p GROUP BY rater) SELECT round(sum(n * s) / sum(n), 6) AS strict, round(sum(n * h) / sum(n), 6) AS half_ties, round(avg(s), 6) AS per_rater, CAST(sum(n) AS BIGINT) AS pairs FROM a")
def k4_pair_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("margin")
    half = F.when(m > 0, 1.0).when(m == 0, 0.5).otherwise(0.0)
    a = pairs(spark, sf_dir).groupBy("rater").agg(F.count("*").alias("n"), F.avg((m > 0).cast("double")).alias("s"), F.avg(half).alias("h"))
    n = F.col("n")
    return a.agg(F.round(F.sum(n * F.col("s")) / F.sum(n), 6).alias("strict"), F.round(F.sum(n * F.col("h")) / F.sum(n), 6).alias("half_ties"), F.round(F.avg("s"), 6).alias("per_rater"), F.sum("n").alias("pairs"))


@query(f"WITH {_PAIRS}, {EVENT_FOLDS.replace('p AS', 'pp AS').replace('FROM p ', 'FROM pp ')}, h AS (SELECT p.*, a.fold FROM p JOIN f a ON a.obs_id = p.c JOIN f b ON b.obs_id = p.r AND a.fold = b.fold) SELECT CASE WHEN gap < 10 THEN 'hard' WHEN gap < 40 THEN 'medium' ELSE 'easy' END AS stratum, count(*) AS n, round(avg(greatest(-margin / 50, 0) + ln(1 + exp(-abs(margin / 50)))), 6) AS nll FROM h GROUP BY 1")
def k5_held_out_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bradley-Terry loss on pairs whose two rows share a test fold, by difficulty."""
    f = event_folds(spark, sf_dir).select("obs_id", "fold")
    h = pairs(spark, sf_dir).join(f.select(F.col("obs_id").alias("c"), "fold"), "c").join(f.select(F.col("obs_id").alias("r"), "fold"), ["r", "fold"])
    stratum = F.when(F.col("gap") < 10, "hard").when(F.col("gap") < 40, "medium").otherwise("easy")
    return h.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n"), F.round(F.avg(-scalars.log_sigmoid(F.col("margin") / 50)), 6).alias("nll"))


@query(f"WITH {_GROUPED}, q AS (SELECT *, row_number() OVER (PARTITION BY rater, day ORDER BY obs_id) AS k FROM e), g AS (SELECT *, unnest([2, 3, 4]) AS n FROM q), t AS (SELECT rater, day, n, arg_max(obs_id, struct_pack(a := x, b := -obs_id)) AS by_x, arg_max(obs_id, struct_pack(a := y, b := -obs_id)) AS by_y FROM g WHERE k <= n GROUP BY ALL HAVING count(*) = n) SELECT n, count(*) AS groups, round(avg(CASE WHEN by_x = by_y THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM t GROUP BY n")
def k6_best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("rater", "day").orderBy("obs_id")
    g = grouped(spark, sf_dir).withColumn("k", F.row_number().over(w)).withColumn("n", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4)))).where("k <= n")
    top = lambda c: F.max(F.struct(c, (-F.col("obs_id")).alias("o")))["o"]
    t = g.groupBy("rater", "day", "n").agg(F.count("*").alias("size"), top("x").alias("by_x"), top("y").alias("by_y")).where("size = n")
    return t.groupBy("n").agg(F.count("*").alias("groups"), F.round(F.avg((F.col("by_x") == F.col("by_y")).cast("double")), 6).alias("agreement"))


@query(f"WITH {_GROUPED}, a AS (SELECT rater, day, arg_max(obs_id, struct_pack(a := x, b := -obs_id)) AS c FROM e GROUP BY ALL), b AS (SELECT rater, day, arg_max(obs_id, struct_pack(a := y, b := -obs_id)) AS c FROM e WHERE grp <> 'error' GROUP BY ALL) SELECT count(*) AS groups, count(*) FILTER (a.c = b.c) AS same, count(*) FILTER (a.c IS NULL OR b.c IS NULL) AS one_side, avg(CASE WHEN a.c = b.c THEN 0.0 ELSE 1.0 END) >= 0.05 AS differs FROM a FULL JOIN b USING (rater, day)")
def k10_arm_difference_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = grouped(spark, sf_dir)
    top = lambda c: F.max(F.struct(c, (-F.col("obs_id")).alias("o")))["o"]
    a, b = e.groupBy("rater", "day").agg(top("x").alias("ca")), e.where("grp != 'error'").groupBy("rater", "day").agg(top("y").alias("cb"))
    same = F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))
    return a.join(b, ["rater", "day"], "full").agg(F.count("*").alias("groups"), F.count_if(same).alias("same"), F.count_if(F.col("ca").isNull() | F.col("cb").isNull()).alias("one_side"), (F.avg((~same).cast("double")) >= 0.05).alias("differs"))


@query(f"WITH {_PAIRS}, a AS (SELECT rater, count(*) AS n, count(*) FILTER (margin > 0) AS win, count(*) FILTER (margin < 0) AS loss FROM p GROUP BY rater), q AS (SELECT quantile_cont(n, [0.25, 0.5, 0.75]) AS e FROM a) SELECT CASE WHEN n <= e[1] THEN 1 WHEN n <= e[2] THEN 2 WHEN n <= e[3] THEN 3 ELSE 4 END AS quartile, count(*) AS raters, CAST(sum(win) AS BIGINT) AS wins, CAST(sum(loss) AS BIGINT) AS losses FROM a, q GROUP BY 1")
def k11_wins_by_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = pairs(spark, sf_dir).groupBy("rater").agg(F.count("*").alias("n"), F.count_if(F.col("margin") > 0).alias("win"), F.count_if(F.col("margin") < 0).alias("loss"))
    q = a.agg(F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e"))
    quartile = F.size(F.filter("e", lambda x: x < F.col("n"))) + 1
    return a.crossJoin(F.broadcast(q)).groupBy(quartile.alias("quartile")).agg(F.count("*").alias("raters"), F.sum("win").alias("wins"), F.sum("loss").alias("losses"))


# ------------------------------------------------------------------ simulation and decisions


def uniform(*parts: Column) -> Column:
    """A hashed number in (0, 1)."""
    return (md5_int(F.concat_ws(":", *(p.cast("string") for p in parts))) + 0.5) / 4294967296.0


def _u(*parts: str) -> str:
    return f"((CAST('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


def _normal_sql(tag: str, *parts: str) -> str:
    return f"(sqrt(-2 * ln({_u(f"'{tag}a'", *parts)})) * cos(2 * pi() * {_u(f"'{tag}b'", *parts)}))"


def normal(tag: str, *parts: Column) -> Column:
    """Box-Muller on hashed uniforms."""
    return F.sqrt(-2 * F.log(uniform(F.lit(tag + "a"), *parts))) * F.cos(2 * F.pi() * uniform(F.lit(tag + "b"), *parts))


def simulated(spark: SparkSession, raters: int, ratings: int) -> DataFrame:
    """Raters with intercepts 50 + 8 z and slopes 1 + 0.3 z, signals 10 z, noise 5 z."""
    r = spark.range(raters).select(F.col("id").alias("rater"), (50 + 8 * normal("i", F.col("id"))).alias("true_intercept"), (1 + 0.3 * normal("s", F.col("id"))).alias("true_slope"))
    o = r.withColumn("obs_id", F.explode(F.sequence(F.lit(0), F.lit(ratings - 1))))
    x, noise = 10 * normal("x", F.col("rater"), F.col("obs_id")), 5 * normal("e", F.col("rater"), F.col("obs_id"))
    return o.withColumn("x", x).withColumn("y", F.col("true_intercept") + F.col("true_slope") * F.col("x") + noise)


def planted(obs: DataFrame) -> DataFrame:
    """The same lines and noise on the raters and rows of given observations."""
    line_ = lambda tag, at, by: at + by * normal(tag, F.col("rater"))
    o = obs.select("rater", "obs_id", (10 * normal("x", F.col("obs_id"))).alias("x"))
    return o.withColumn("y", line_("i", 50, 8) + line_("s", 1, 0.3) * F.col("x") + 5 * normal("e", F.col("obs_id")))


_SIM = f"sim AS (SELECT rater, obs_id, x, 50 + 8 * {_normal_sql('i', 'rater')} + (1 + 0.3 * {_normal_sql('s', 'rater')}) * x + 5 * {_normal_sql('e', 'obs_id')} AS y FROM (SELECT rater, obs_id, 10 * {_normal_sql('x', 'obs_id')} AS x FROM {EVENTS} WHERE rater IS NOT NULL))"


@query(f"WITH {_SIM}, {centred_sql('sim')}, s AS (SELECT rater, {_SUMS} FROM c GROUP BY rater), {line_sql('l', 's', 'b')} SELECT round(greatest(var_samp(intercept) - avg(v_intercept), 0), 3) AS t2_intercept, round(greatest(var_samp(slope) - avg(v_slope), 0), 5) AS t2_slope, count(*) AS raters FROM l")
def z1_recovery_of_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known spread (intercepts 64, slopes 0.09 about 0) planted on the raters and rows of the table: the estimates come near."""
    lines = shrinkage.rater_lines(regression.centred(planted(events(spark, sf_dir).where("rater is not null"))), "b")
    t = shrinkage.between_variance(lines, floor=0.0)
    return t.select(F.round("t2_intercept", 3).alias("t2_intercept"), F.round("t2_slope", 5).alias("t2_slope")).crossJoin(F.broadcast(lines.agg(F.count("*").alias("raters"))))


_NOISE = f"(SELECT rater, obs_id, grp, ts, CAST({_normal_sql('n', 'obs_id')} AS DOUBLE) AS x, y FROM {EVENTS})"


@query(evaluation_sql(folds_sql(_NOISE, K_FOLD, f"cnt >= {K}")))
def z2_signal_replaced_by_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = complete(events(spark, sf_dir).withColumn("x", normal("n", F.col("obs_id"))))
    return rounded(shrinkage.evaluation(splits.k_folds(noise, K, SEED)))


@query(f"WITH {centred_sql(EVENTS)}, s AS (SELECT rater, {_SUMS} FROM c GROUP BY rater), {line_sql('l', 's')} SELECT round(sqrt(sum({sse_sql('intercept', 'slope')}) / sum(n)), 6) AS fitted, round(sqrt(sum({sse_sql('intercept', '(-slope)')}) / sum(n)), 6) AS flipped, round(sqrt(sum({sse_sql('intercept', '(1 - slope)')}) / sum(n)), 6) AS complement FROM l")
def z3_flipped_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = shrinkage.rater_lines(regression.centred(complete(events(spark, sf_dir))))
    rmse = lambda b, name: F.round(F.sqrt(F.sum(regression.squared_error(F.col("intercept"), b)) / F.sum("n")), 6).alias(name)
    return lines.agg(rmse(F.col("slope"), "fitted"), rmse(-F.col("slope"), "flipped"), rmse(1 - F.col("slope"), "complement"))


@query(f"WITH {errors_sql(EVENT_FOLDS)}, {_DRAWS}, g AS (SELECT b, 1 - avg(rmse_rater) / avg(rmse_population) AS gain FROM k GROUP BY b), ci AS (SELECT quantile_cont(gain, 0.025) AS low, quantile_cont(gain, 0.975) AS high, (SELECT 1 - avg(rmse_rater) / avg(rmse_population) FROM r) AS gain FROM g) SELECT CASE WHEN gain >= 0.05 AND low > 0 THEN 'strong' WHEN low > 0 THEN 'positive' WHEN high < 0 THEN 'negative' ELSE 'null' END AS outcome, round(gain, 6) AS gain FROM ci")
def d1_outcome_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in order; the first that holds names the outcome."""
    r = drawn_from(spark, sf_dir)
    gain = 1 - F.avg("rmse_rater") / F.avg("rmse_population")
    ci = inference.percentile_interval(inference.bootstrap(r, 200, 7, gain.alias("gain")), "gain")
    c = ci.crossJoin(F.broadcast(r.agg(gain.alias("gain"))))
    outcome = F.when((F.col("gain") >= 0.05) & (F.col("low") > 0), "strong").when(F.col("low") > 0, "positive").when(F.col("high") < 0, "negative").otherwise("null")
    return c.select(outcome.alias("outcome"), F.round("gain", 6).alias("gain"))


@query(f"WITH e AS (SELECT rater, ts, obs_id, y > 30 AS above, row_number() OVER (PARTITION BY rater ORDER BY ts, obs_id) - row_number() OVER (PARTITION BY rater, y > 30 ORDER BY ts, obs_id) AS island FROM {EVENTS} WHERE y IS NOT NULL), i AS (SELECT rater, above, count(*) AS n FROM e GROUP BY rater, above, island) SELECT rater, max(n) FILTER (above) AS longest_above, max(n) FILTER (NOT above) AS longest_below FROM i GROUP BY rater")
def d2_longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("rater").orderBy("ts", "obs_id")
    both = Window.partitionBy("rater", "above").orderBy("ts", "obs_id")
    e = events(spark, sf_dir).where("y is not null").withColumn("above", F.col("y") > 30).withColumn("island", F.row_number().over(w) - F.row_number().over(both))
    i = e.groupBy("rater", "above", "island").agg(F.count("*").alias("n"))
    return i.groupBy("rater").agg(F.max(F.when(F.col("above"), F.col("n"))).alias("longest_above"), F.max(F.when(~F.col("above"), F.col("n"))).alias("longest_below"))
