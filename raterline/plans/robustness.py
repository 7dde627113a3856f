"""Queries on other evaluations: cold start, single rows, simple baselines, noise, corrupted raters; and files written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterline.operators import evaluation, inference, regression, shrinkage, splits
from raterline.plans.calibration import _SUMS, EVENT_FOLDS, K_FOLD, SEED, K, _normal_sql, centred_sql, errors_sql, evaluation_sql, event_folds, folds_sql, line_sql, normal, rounded, sse_sql
from raterline.plans.registry import query
from raterline.plans.relational import EVENTS
from raterline.sources import files
from raterline.sources.observations import complete, events, md5_int, table

BUDGETS = [2, 5, 10, 20]
NOISE = [0.0, 0.5, 1.0, 2.0, 5.0]
CORRUPTED = [0, 10, 25, 50]

_T2 = "t2 AS (SELECT greatest(var_samp(intercept) - avg(v_intercept), 1e-6) AS t2_intercept, greatest(var_samp(slope) - avg(v_slope), 1e-6) AS t2_slope FROM rl)"
_EB = "w AS (SELECT *, coalesce(t2_intercept / (t2_intercept + v_intercept), 0) AS wi, coalesce(t2_slope / (t2_slope + v_slope), 0) AS ws FROM j), eb AS (SELECT *, wi * intercept + (1 - wi) * pop_intercept AS eb_intercept, ws * slope + (1 - ws) * pop_slope AS eb_slope FROM w)"
_TERMS = {"n": "1.0", "sx": "cx", "sy": "cy", "sxx": "cx * cx", "sxy": "cx * cy", "syy": "cy * cy"}
_ARMS = {"population": ("pop_intercept", "pop_slope"), "rater": ("intercept", "slope"), "shrunk": ("eb_intercept", "eb_slope")}


def _cold_sql() -> str:
    both = ", ".join(f"CAST(sum({v}) FILTER (train) AS DOUBLE) AS t_{s}, CAST(sum({v}) FILTER (NOT train) AS DOUBLE) AS {s}" for s, v in _TERMS.items())
    arms = {"mean": ("(my + t_sy / t_n)", "0"), **_ARMS}
    errors = " UNION ALL ".join(f"SELECT '{k}' AS arm, budget, sqrt({sse_sql(a, b)} / n) AS error, sqrt({sse_sql('pop_intercept', 'pop_slope')} / n) AS base FROM eb" for k, (a, b) in arms.items())
    return f"""WITH o AS (SELECT * FROM {EVENTS} WHERE x IS NOT NULL AND y IS NOT NULL AND rater IS NOT NULL),
hr AS (SELECT rater, row_number() OVER (ORDER BY md5('{SEED}:' || rater), rater) <= floor(count(*) OVER () * 0.3) AS held_out FROM (SELECT DISTINCT rater FROM o)), {centred_sql("o")},
h AS (SELECT c.*, held_out FROM c JOIN hr USING (rater)),
tr AS (SELECT rater, {_SUMS} FROM h WHERE NOT held_out GROUP BY rater), {line_sql("rl", "tr")}, {_T2}, pa AS (SELECT {_SUMS} FROM h WHERE NOT held_out), {line_sql("pl", "pa")},
q AS (SELECT *, row_number() OVER (PARTITION BY rater ORDER BY ts, obs_id) AS pos, count(*) OVER (PARTITION BY rater) AS cnt, unnest({BUDGETS}) AS budget FROM h WHERE held_out),
k AS (SELECT *, pos <= budget AS train FROM q WHERE cnt >= budget + 2),
fp AS (SELECT rater, budget, any_value(mx) AS mx, any_value(my) AS my, {both} FROM k GROUP BY rater, budget), {line_sql("fit", "fp", "a", "t_")},
j AS (SELECT fit.*, pl.intercept AS pop_intercept, pl.slope AS pop_slope, t2_intercept, t2_slope FROM fit, pl, t2), {_EB}, e AS ({errors}),
g AS (SELECT arm, budget, count(*) AS raters, avg(error) AS rmse, avg(base) AS base, avg(CASE WHEN error < base * (1 - 1e-9) THEN 1.0 ELSE 0.0 END) AS win_rate FROM e GROUP BY arm, budget)
SELECT arm, CAST(budget AS INTEGER) AS budget, raters, round(rmse, 5) AS rmse, round(win_rate, 6) AS win_rate, CAST(min(budget) FILTER (rmse <= base) OVER (PARTITION BY arm) AS INTEGER) AS break_even FROM g"""


@query(_cold_sql())
def v10_cold_start_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, population, rater and shrunk arms after 2, 5, 10 and 20 ratings of raters unknown to the population."""
    c = evaluation.cold_start(complete(events(spark, sf_dir)), BUDGETS, 0.3, SEED)
    return c.select("arm", "budget", "raters", F.round("rmse", 5).alias("rmse"), F.round("win_rate", 6).alias("win_rate"), "break_even")


_LESS = ", ".join(f"(sum({v}) OVER (PARTITION BY rater)) - {v} AS t_{s}, {v} AS {s}" for s, v in _TERMS.items())


@query(f"""WITH {centred_sql(EVENTS)}, ra AS (SELECT rater, {_SUMS} FROM c GROUP BY rater), {line_sql("rl", "ra")}, {_T2}, pa AS (SELECT {_SUMS} FROM c), {line_sql("pl", "pa")},
d AS (SELECT obs_id, mx, my, {_LESS} FROM c), u AS (SELECT * FROM d WHERE t_n >= 3), {line_sql("fit", "u", "a", "t_")},
j AS (SELECT fit.*, pl.intercept AS pop_intercept, pl.slope AS pop_slope, t2_intercept, t2_slope FROM fit, pl, t2), {_EB}
SELECT count(*) AS rows, {", ".join(f"round(sqrt(avg({sse_sql(a, b)})), 6) AS rmse_{k}" for k, (a, b) in _ARMS.items())} FROM eb""")
def v8_leave_one_row_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.leave_one_row_out(complete(events(spark, sf_dir))))


@query(f"""WITH o AS (SELECT rater, x, y, x - avg(x) OVER (PARTITION BY rater) AS d FROM {EVENTS} WHERE x IS NOT NULL AND y IS NOT NULL AND rater IS NOT NULL),
s AS (SELECT rater, CAST(count(*) AS DOUBLE) AS n, sum(d ** 2) AS p2, sum(d ** 3) AS p3, sum(d ** 4) AS p4, sum(y) AS q0, sum(d * y) AS q1, sum(d * d * y) AS q2 FROM o GROUP BY rater),
t AS (SELECT *, n * (p2 * p4 - p3 * p3) - p2 * p2 * p2 AS det FROM s),
u AS (SELECT rater, n, p2, p3, p4, det, (q0 * (p2 * p4 - p3 * p3) + q1 * p2 * p3 - q2 * p2 * p2) / det AS a, (q0 * p2 * p3 + q1 * (n * p4 - p2 * p2) - q2 * n * p3) / det AS b, (-q0 * p2 * p2 - q1 * n * p3 + q2 * n * p2) / det AS c FROM t WHERE n >= 4 AND abs(det) > 1e-6),
v AS (SELECT rater, n, b, c, sum(((y - a - b * d - c * d * d) * (p2 * p3 + (n * p4 - p2 * p2) * d - n * p3 * d * d) / det) ** 2) AS vb, sum(((y - a - b * d - c * d * d) * (n * p2 * d * d - n * p3 * d - p2 * p2) / det) ** 2) AS vc FROM o JOIN u USING (rater) GROUP BY ALL)
SELECT rater, round(sqrt(vb * n / greatest(n - 3, 1)), 6) AS se_b, round(1000 * sqrt(vc * n / greatest(n - 3, 1)), 6) AS se_c, round(b / nullif(sqrt(vb * n / greatest(n - 3, 1)), 0), 5) AS z_b, round(c / nullif(sqrt(vc * n / greatest(n - 3, 1)), 0), 5) AS z_c FROM v""")
def r3_robust_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HC1 errors of slope and curvature; the error of the curvature in thousandths."""
    e = complete(events(spark, sf_dir))
    r = regression.robust_errors(e, regression.quadratic(e, "rater"), "rater")
    return r.select("rater", F.round("se_b", 6).alias("se_b"), F.round(1000 * F.col("se_c"), 6).alias("se_c"), F.round("z_b", 5).alias("z_b"), F.round("z_c", 5).alias("z_c"))


_STRATA = "SELECT p.*, coalesce(c_mktsegment, 'Unknown') AS stratum FROM parts p LEFT JOIN customer ON rater = c_custkey"
_PARTS_LESS = ", ".join(f"(sum({s}) OVER (PARTITION BY rater)) - {s} AS t_{s}" for s in _TERMS)
_SUM_SUMS = ", ".join(f"sum({s}) AS {s}" for s in _TERMS) + ", any_value(mx) AS mx, any_value(my) AS my"
_SIMPLE = {"population": ("a0", "b0"), "residual": ("coalesce(my + t_sy / nullif(t_n, 0) - b0 * (mx + t_sx / nullif(t_n, 0)), a0)", "b0"), "stratum": ("coalesce(sa, a0)", "coalesce(sb, b0)")}


@query(f"""WITH {EVENT_FOLDS}, parts AS (SELECT rater, fold, {_SUMS} FROM c GROUP BY rater, fold), st AS ({_STRATA}), ss AS (SELECT stratum, {_SUM_SUMS} FROM st GROUP BY stratum), {line_sql("sl", "ss")},
pa AS (SELECT {_SUM_SUMS} FROM parts), {line_sql("pl", "pa")}, g AS (SELECT stratum, CASE WHEN n >= 50 AND sxx / n - (sx / n) ** 2 > 1e-9 THEN intercept END AS sa, CASE WHEN n >= 50 AND sxx / n - (sx / n) ** 2 > 1e-9 THEN slope END AS sb FROM sl),
t AS (SELECT st.*, {_PARTS_LESS} FROM st), j AS (SELECT t.*, sa, sb, pl.intercept AS a0, pl.slope AS b0 FROM t JOIN g USING (stratum), pl)
SELECT rater, {", ".join(f"round(sqrt(sum({sse_sql(a, b)}) / sum(n)), 6) AS rmse_{k}" for k, (a, b) in _SIMPLE.items())} FROM j GROUP BY rater""")
def r6_residual_and_stratum_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments of customers stand for strata of raters."""
    strata = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select(F.col("c_custkey").alias("rater"), F.col("c_mktsegment").alias("stratum"))
    return rounded(evaluation.simple_lines(event_folds(spark, sf_dir), strata))


def _settings_sql(name: str, settings: list, source: str, where: str = "true") -> str:
    """One row per setting, each setting its own nest of the core query."""
    one = lambda s: f"SELECT CAST({s} AS DOUBLE) AS {name}, * FROM (WITH {errors_sql(folds_sql(source.format(s=s), K_FOLD, f'cnt >= {K}'))} SELECT count(*) AS raters, round(avg(rmse_population), 5) AS rmse_population, round(avg(rmse_rater), 5) AS rmse_rater, round(avg(rmse_shrunk), 5) AS rmse_shrunk, coalesce(nullif(round(1 - avg(rmse_shrunk) / avg(rmse_population), 6), 0), 0) AS gain FROM r WHERE {where.format(s=s)})"
    return " UNION ALL ".join(map(one, settings))


def _summary(per_rater: DataFrame, name: str) -> DataFrame:
    mean = lambda k: F.round(F.avg(f"rmse_{k}"), 5).alias(f"rmse_{k}")
    gain = F.round(1 - F.avg("rmse_shrunk") / F.avg("rmse_population"), 6).alias("gain")
    return per_rater.groupBy(F.col(name).cast("double").alias(name)).agg(F.count("*").alias("raters"), mean("population"), mean("rater"), mean("shrunk"), gain)


_NOISY = f"(SELECT e.rater, obs_id, grp, ts, CAST(x + {{s}} * sd * {_normal_sql('g', 'obs_id')} AS DOUBLE) AS x, y FROM {EVENTS} e, (SELECT stddev_samp(x) AS sd FROM {EVENTS} WHERE y IS NOT NULL AND rater IS NOT NULL))"


@query(_settings_sql("noise", NOISE, _NOISY))
def z2_noise_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise of 0 to 5 standard deviations on the signal: what is left of the gain.  One plan for all levels."""
    f = event_folds(spark, sf_dir)
    sd = complete(events(spark, sf_dir)).agg(F.stddev_samp("x").alias("sd"))
    noisy = f.crossJoin(F.broadcast(sd)).withColumn("z", normal("g", F.col("obs_id"))).withColumn("noise", F.explode(F.array(*map(F.lit, NOISE))))
    return _summary(evaluation.errors_by_setting(noisy.withColumn("x", F.col("x") + F.col("noise") * F.col("sd") * F.col("z")), "noise"), "noise")


_HASHED = f"CAST('0x' || substr(md5('{SEED}:' || rater), 1, 8) AS BIGINT) % 100"
_FLIPPED = f"(SELECT rater, obs_id, grp, ts, x, CASE WHEN {_HASHED} < {{s}} THEN 100 - y ELSE y END AS y FROM {EVENTS})"


@query(_settings_sql("share", CORRUPTED, _FLIPPED, f"{_HASHED} >= {{s}}"))
def z3_corrupted_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share of raters, by hash, rates 100 - y; the others are judged, with population and variances from all."""
    place = md5_int(F.concat_ws(":", F.lit(str(SEED)), F.col("rater").cast("string"))) % 100
    f = event_folds(spark, sf_dir).withColumn("share", F.explode(F.array(*map(F.lit, CORRUPTED))))
    flipped = f.withColumn("y", F.when(place < F.col("share"), 100 - F.col("y")).otherwise(F.col("y")))
    return _summary(evaluation.errors_by_setting(flipped, "share").where(place >= F.col("share")), "share")


# ------------------------------------------------------------------ files


def _path(spark: SparkSession, name: str) -> str:
    return f"{files.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def s2_csv_sink_and_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as headed CSV and read with a schema."""
    c, path = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment"), _path(spark, "csv")
    files.write_table(c, path, "csv")
    return files.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def s4_gzip_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "json")
    table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").write.option("compression", "gzip").json(path)
    return files.read_json_lines(spark, path, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def s8_parquet_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "parquet")
    files.write_table(table(spark, sf_dir, "orders", "o_orderpriority", "o_totalprice"), path)
    return spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT user_id, CAST(section AS BIGINT) AS section, count(*) AS lines, round(avg(value), 6) AS mean_v FROM (SELECT user_id, value, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS section FROM events) GROUP BY user_id, section")
def s10_log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as lines of text; fields come back by pattern, sections begin at purchases."""
    path = _path(spark, "log")
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    e.select(F.concat_ws(" ", F.format_string("[%d] user=%d event=%s", "event_id", "user_id", "event_type"), F.concat(F.lit("value="), F.col("value").cast("string"))).alias("value")).write.text(path)
    log = files.read_log(spark, path, {"place": (r"^\[(\d+)\]", "long"), "user_id": (r" user=(\d+)", "long"), "value": (r" value=([-+.0-9eE]+)", "double")})
    s = files.sections(log, " event=purchase( |$)", "user_id", order="place")
    return s.groupBy("user_id", "section").agg(F.count("*").alias("lines"), F.round(F.avg("value"), 6).alias("mean_v"))


@query("WITH o AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS c, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders) SELECT unnest(['rows', 'customers', 'keys.0', 'keys.1', 'about.table', 'about.note']) AS name, unnest([CAST(n AS VARCHAR), CAST(c AS VARCHAR), CAST(low AS VARCHAR), CAST(high AS VARCHAR), 'orders', NULL]) AS value FROM o")
def s3_json_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested summary written as JSON, read back as names and values."""
    path = _path(spark, "summary")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("customers"), F.array(F.min("o_orderkey"), F.max("o_orderkey")).alias("keys"))
    about = F.struct(F.lit("orders").alias("table"), F.lit(None).cast("string").alias("note"))
    o.select(F.to_json(F.struct("rows", "customers", "keys", about.alias("about")), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.text(path)
    return files.summary_rows(spark, path).select("name", "value")


@query("WITH o AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY p) + 1 AS place, '| ' || p || ' | ' || n || ' |' AS line FROM o) SELECT CAST(place AS INTEGER) AS place, line FROM (SELECT 0 AS place, '| o_orderpriority | n |' AS line UNION ALL SELECT 1, '| --- | --- |' UNION ALL SELECT * FROM r)")
def s9_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small result as a Markdown table, line by line."""
    o = table(spark, sf_dir, "orders", "o_orderpriority").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy("o_orderpriority")
    return spark.createDataFrame(list(enumerate(files.markdown(o).split("\n"))), "place int, line string")


_PERMUTED = f"(SELECT a.rater, a.obs_id, a.grp, a.ts, b.x, a.y FROM (SELECT *, row_number() OVER (ORDER BY obs_id) AS place FROM {EVENTS} WHERE x IS NOT NULL AND y IS NOT NULL AND rater IS NOT NULL) a JOIN (SELECT x, row_number() OVER (ORDER BY CAST('0x' || substr(md5('permuted:' || obs_id), 1, 13) AS BIGINT)) AS place FROM {EVENTS} WHERE x IS NOT NULL AND y IS NOT NULL AND rater IS NOT NULL) b USING (place))"


@query(evaluation_sql(folds_sql(_PERMUTED, K_FOLD, f"cnt >= {K}")))
def z2_signal_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals dealt anew over all rows; places come from ranges of ids and of hashes."""
    e = files.written(complete(events(spark, sf_dir)), "observations")
    key = F.conv(F.substring(F.md5(F.concat(F.lit("permuted:"), F.col("obs_id").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double")
    own = inference.ordered(e, "obs_id").select("rater", "obs_id", "grp", "ts", "y", "idx")
    other = inference.ordered(files.written(e.select("x", key.alias("key")), "keys"), "key").select("x", "idx")
    return rounded(shrinkage.evaluation(splits.k_folds(files.written(own.join(other, "idx").drop("idx"), "permuted"), K, SEED)))
