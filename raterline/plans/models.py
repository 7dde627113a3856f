"""Queries of fitted models: no SQL expresses them, so rows are checked in the tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterline.operators import inference, mixed, multivariate, preference, prototypes, regression, resampling, response, sequential, shrinkage, splits, state_space, text_components
from raterline.plans.calibration import drawn_from, event_folds, pairs, rounded
from raterline.plans.registry import query
from raterline.sources.files import walk, written
from raterline.sources.observations import EVENTS_SQL, complete, events, orders, table

#: Draws of a bootstrap, as in the reference scripts.
REPLICATES = 2000


def rater_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = complete(events(spark, sf_dir))
    return e.groupBy("rater").agg(F.avg("y").alias("mean_y"), F.avg("x").alias("mean_x"), F.stddev_samp("y").alias("sd_y"), F.max("grp").alias("kind"), F.avg((F.col("grp") == "purchase").cast("double")).alias("buys"))


@query()
def r4_mixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional lines, with the model that could be fitted (see mixed.shapes) and whether it converged."""
    c = regression.centred(complete(events(spark, sf_dir)))
    s = written(mixed.power_sums(c, "rater"), "power-sums")
    m = mixed.fit(s)
    return rounded(mixed.effects(s, m)).withColumns({"structure": F.lit(m.structure), "converged": F.lit(m.converged)})


@query()
def r4b_quadratic_mixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the grand means."""
    c = regression.centred(complete(events(spark, sf_dir)))
    s = written(mixed.power_sums(c, "rater", degree=2), "power-sums")
    m = mixed.fit(s, degree=2)
    return rounded(mixed.effects(s, m)).withColumns({"structure": F.lit(m.structure), "converged": F.lit(m.converged)})


@query()
def r4_variance_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population coefficients with errors, covariances and noise of both mixed models."""
    c = regression.centred(complete(events(spark, sf_dir)))
    s = written(mixed.power_sums(c, "rater", degree=2), "power-sums")
    rows = []
    for degree in (1, 2):
        m = mixed.fit(s, degree=degree)
        at = {"model": ("linear", "quadratic")[degree - 1], "structure": m.structure, "converged": m.converged}
        rows += [(*at.values(), f"beta_{k}", float(m.beta[k]), float(m.beta_covariance[k, k] ** 0.5)) for k in range(degree + 1)]
        rows += [(*at.values(), f"covariance_{i}{j}", float(m.covariance[i, j]), None) for i in range(degree + 1) for j in range(i + 1)]
        rows += [(*at.values(), "noise", m.noise, None), (*at.values(), "log_likelihood", m.log_likelihood, None)]
    return spark.createDataFrame(rows, "model string, structure string, converged boolean, name string, value double, error double")


@query()
def t1_kalman_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered lines under the random walk of highest likelihood over all raters."""
    z = regression_scaled(spark, sf_dir)
    runs = state_space.drift_runs(z, state_space.priors(z))
    return rounded(state_space.kalman(runs, state_space.fit_drift(runs, state_space.starting_drift(z))))


@query()
def t1_drift_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step variances, persistence and noise of the random walk and of AR(1), with their likelihood."""
    z = regression_scaled(spark, sf_dir)
    runs = state_space.drift_runs(z, state_space.priors(z))
    start = state_space.starting_drift(z)
    rows = [(name, *d.rho, *d.q, d.noise, d.log_likelihood, d.evaluations, d.converged) for name, d in (("walk", state_space.fit_drift(runs, start)), ("reverting", state_space.fit_drift(runs, start, reverting=True)))]
    return spark.createDataFrame(rows, "model string, rho_intercept double, rho_slope double, q_intercept double, q_slope double, noise double, log_likelihood double, evaluations int, converged boolean")


@query()
def t1_time_varying_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifth of each rater's rows, forecast by fixed and by drifting lines."""
    return rounded(state_space.time_varying_arms(splits.temporal(regression_scaled(spark, sf_dir))))


def regression_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with x and y standardised over all rows; rows and scales are stored, since what is fitted reads them many times."""
    e = written(complete(events(spark, sf_dir)), "observations")
    s = written(e.agg(F.avg("x").alias("ax"), F.stddev_samp("x").alias("dx"), F.avg("y").alias("ay"), F.stddev_samp("y").alias("dy")), "scales")
    z = lambda c: (F.col(c) - F.col(f"a{c}")) / F.when(F.col(f"d{c}") > 0, F.col(f"d{c}"))
    return e.crossJoin(F.broadcast(s)).select("rater", "obs_id", "ts", "grp", z("x").alias("x"), z("y").alias("y"))


@query()
def t2_spline_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequential.spline(regression_scaled(spark, sf_dir)))


def _gain(means: np.ndarray) -> np.ndarray:
    """What the own line's RMSE saves of the population line's; means: squared errors of both."""
    base = np.sqrt(np.maximum(means[..., 0], 0))
    return np.where(base > 1e-9, 1 - np.sqrt(np.maximum(means[..., 1], 0)) / np.maximum(base, 1e-9), 0.0)


@query()
def b3_other_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the gain of raters' own lines with raters, rows within raters and all rows resampled, and of the accuracy on easy less hard pairs."""
    folds = written(event_folds(spark, sf_dir).select("rater", "obs_id", "fold", "x", "y"), "folds")
    rows = written(shrinkage.row_errors(folds), "row-errors")
    raters = rows.groupBy("rater").agg(F.avg("population").alias("a"), F.avg("own").alias("b"))
    raters = written(raters.select("rater", F.when(F.col("a") > 1e-18, 1 - F.sqrt(F.col("b") / F.col("a"))).otherwise(0.0).alias("gain")), "rater-gains")
    estimate = raters.agg(F.avg("gain")).head()[0]
    pooled = rows.agg(F.avg("population"), F.avg("own")).head()
    by_rater = resampling.resampled_sums(raters, ["gain"], REPLICATES, 11, id_columns=["rater"])
    inside, _ = resampling.within(rows, ["population", "own"], REPLICATES, 13, _gain)
    by_row = resampling.resampled_sums(rows, ["population", "own"], REPLICATES, 17, id_columns=["obs_id"])
    p = pairs(spark, sf_dir).groupBy((F.col("gap") < 10).alias("hard")).agg(F.avg((F.col("margin") > 0).cast("double")).alias("share"), F.count("*").alias("n")).collect()
    hard, easy = ({r["hard"]: (float(r["share"]), r["n"]) for r in p}.get(k, (0.0, 0)) for k in (True, False))
    out = [
        ("raters", float(estimate), *resampling.interval(by_rater[:, 0] / by_rater[:, 1])), ("within_raters", float(estimate), *resampling.interval(inside)),
        ("rows", float(_gain(np.array(pooled, float))), *resampling.interval(_gain(by_row[:, :2] / by_row[:, 2:]))),
        ("pairs", easy[0] - hard[0], *resampling.interval(resampling.binomial_difference(*hard, *easy, REPLICATES, 19))),
    ]
    return rounded(spark.createDataFrame(out, "kind string, estimate double, low double, high double, valid int"))


@query(f"WITH e AS ({EVENTS_SQL}), c AS (SELECT * FROM e WHERE rater IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL), s AS (SELECT 'raters' AS kind, count(DISTINCT rater) AS drawn FROM c UNION ALL SELECT 'rows', count(*) FROM c) SELECT kind, CAST(b AS INTEGER) AS b, CAST(drawn AS BIGINT) AS drawn FROM s, range(0, {REPLICATES}) AS t(b)")
def b3_resampled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each replicate draws: as many as there are, whatever the buckets that share them."""
    e = complete(events(spark, sf_dir))
    out = []
    for kind, rows, key in (("raters", e.select("rater").distinct(), "rater"), ("rows", e.select("obs_id"), "obs_id")):
        sums = resampling.resampled_sums(rows.withColumn("one", F.lit(1.0)), ["one"], REPLICATES, 11, id_columns=[key])
        # The draws of ones add up to what the tree dealt out.
        out += [(kind, b, int(one) if one == n else -1) for b, (one, n) in enumerate(sums.tolist())]
    return spark.createDataFrame(out, "kind string, b int, drawn long")


@query()
def b1_rater_bootstrap_by_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the gain of means over 2,000 replicates of all raters."""
    r = drawn_from(spark, sf_dir)
    sums = resampling.resampled_sums(r, ["rmse_rater", "rmse_population"], REPLICATES, 7, id_columns=["rater"])
    low, high, valid = resampling.interval(1 - sums[:, 0] / sums[:, 1])
    return rounded(spark.createDataFrame([(low, high, valid)], "low double, high double, valid int"))


@query()
def b2_bca_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias-corrected interval of the gain: replicates are 2,000, the leave-one-out values one per rater."""
    r = drawn_from(spark, sf_dir)
    gain = (1 - F.avg("rmse_rater") / F.avg("rmse_population")).alias("gain")
    t = r.agg(gain, F.sum("rmse_rater").alias("s"), F.sum("rmse_population").alias("p")).head()
    sums = resampling.resampled_sums(r, ["rmse_rater", "rmse_population"], REPLICATES, 7, id_columns=["rater"])
    replicates = (1 - sums[:, 0] / sums[:, 1]).tolist()
    # Of the leave-one-out values only their moments matter: sums of squares and cubes, not the values.
    one = r.select((1 - (t["s"] - F.col("rmse_rater")) / (t["p"] - F.col("rmse_population"))).alias("g"))
    m = one.agg(F.avg("g").alias("m"), F.count("*").alias("n"), F.skewness("g").alias("skew"), F.stddev_pop("g").alias("sd")).head()
    square = m["n"] * m["sd"] ** 2
    low, high = inference.bca_from_moments(t["gain"], replicates, square, -m["n"] * m["sd"] ** 3 * (m["skew"] or 0.0))
    return spark.createDataFrame([(round(t["gain"], 6), round(low, 6), round(high, 6))], "gain double, low double, high double")


#: Folds of conversations.
FOLDS = 5


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised observations with their conversation (a rater's day) and its fold."""
    z = regression_scaled(spark, sf_dir).withColumn("conversation", F.to_date("ts"))
    return z.withColumn("fold", preference.conversation_fold(F.struct("rater", "conversation"), FOLDS))


def _pair_runs(spark: SparkSession, sf_dir: str) -> preference.PairRuns:
    """Chosen and rejected signals of one conversation, standardised."""
    z = _conversations(spark, sf_dir)
    side = lambda kind, name: z.where(F.col("grp") == kind).select("rater", "conversation", "fold", F.col("x").alias(name))
    return preference.pair_runs(side("purchase", "chosen_x").join(side("view", "rejected_x"), ["rater", "conversation", "fold"]), folds=FOLDS)


@query()
def k7_polynomial_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out pairs and ratings per rater: log loss, accuracy, and the error of recalibrated scores."""
    p = _pair_runs(spark, sf_dir)
    weights = preference.fold_weights(p)
    rows = preference.recalibrated(weights, preference.fold_sums(_conversations(spark, sf_dir), FOLDS))
    each = rows.groupBy("rater").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"), F.avg(F.col("steady").cast("double")).alias("steady"))
    return rounded(preference.held_out_pairs(p, weights).join(each, "rater"))


@query()
def k8_shared_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out log loss and accuracy per rater, with a basis shared by all raters for each fold left out."""
    p = _pair_runs(spark, sf_dir)
    _, weights = preference.shared_basis(p)
    return rounded(preference.held_out_pairs(p, weights))


@query()
def k9_head_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out error per rater of its own mixture of shared heads, and the first weight's mean over folds."""
    z = _conversations(spark, sf_dir)
    heads, _ = preference.polynomial_heads(z)
    out = preference.head_mixtures(preference.fold_sums(z, FOLDS), heads)
    return rounded(out.groupBy("rater").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"), F.avg(F.col("weights")[0]).alias("first_weight")))


@query()
def k9_composed_with_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preference.composed_arms(regression_scaled(spark, sf_dir)))


@query()
def m1_forest_and_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = multivariate.encoded(rater_features(spark, sf_dir), ["kind"], ["mean_x", "sd_y", "buys"]).cache()  # released below: vectors of the ML library, read by every fit
    rows = [(m, k, float(v)) for m in ("forest", "ridge") for k, v in enumerate(multivariate.cross_validated_r2(f, "mean_y", "rater", model=m))]
    f.unpersist()
    return spark.createDataFrame(rows, "model string, fold int, r2 double")


@query()
def v13_folds_over_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of whole raters: R2 of the forest, the ridge and the group's mean, with a t interval over folds."""
    f = multivariate.encoded(rater_features(spark, sf_dir), ["kind"], ["mean_x", "sd_y", "buys"]).cache()  # released below, as above
    rows = [(m, *map(float, inference.t_interval(multivariate.cross_validated_r2(f, "mean_y", "rater", folds=5, model=m)))) for m in ("forest", "ridge", "group_mean")]
    f.unpersist()
    return rounded(spark.createDataFrame(rows, "model string, r2 double, low double, high double"))


@query()
def m3_mixture_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = shrinkage.rater_lines(regression.centred(complete(events(spark, sf_dir))))
    rows = [(x["k"], x["log_likelihood"], x["aic"], x["bic"]) for x in multivariate.mixtures(lines, ["intercept", "slope"])]
    return spark.createDataFrame(rows, "k int, log_likelihood double, aic double, bic double")


@query()
def m3_density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multivariate.density_grid(shrinkage.rater_lines(regression.centred(complete(events(spark, sf_dir)))), "intercept", "slope")


@query()
def m4_prototype_calibrators(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered, _ = multivariate.prototypes(rater_features(spark, sf_dir).na.fill(0.0), ["mean_x", "sd_y", "buys"], 4)
    return clustered.groupBy("cluster").agg(F.count("*").alias("raters"), F.avg("mean_y").alias("mean_y"))


@query()
def m4_two_channel_calibrators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out error of raters' own resampled lines, of their prototypes' lines, and of both; with the silhouette of the clusters."""
    features = ["mean_x", "sd_y", "buys"]
    clustered, silhouette = multivariate.prototypes(rater_features(spark, sf_dir).select("rater", *features).na.fill(0.0), features, 4)
    each = prototypes.two_channels(event_folds(spark, sf_dir), written(clustered.select("rater", "cluster"), "clusters"))
    arms = ("population", "individual", "prototype", "mixed")
    return rounded(each.agg(F.count("*").alias("raters"), *(F.avg(f"rmse_{a}").alias(f"rmse_{a}") for a in arms)).withColumn("silhouette", F.lit(float(silhouette))))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with x standardised and y as it is."""
    e = complete(events(spark, sf_dir))
    s = e.agg(F.avg("x").alias("ax"), F.stddev_samp("x").alias("dx"))
    return e.crossJoin(F.broadcast(s)).select("rater", "obs_id", "ts", "grp", ((F.col("x") - F.col("ax")) / F.when(F.col("dx") > 0, F.col("dx"))).alias("x"), "y")


@query()
def m6_response_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and variances over raters of log steepness and midpoint, the noise, and how the bound rose."""
    m, _ = response.fit(_signals(spark, sf_dir))
    rises = all(b >= a - 1e-6 * abs(a) for a, b in zip(m.bounds, m.bounds[1:]))
    return rounded(spark.createDataFrame([(*map(float, m.mean), *map(float, m.spread), m.noise, m.bounds[-1], len(m.bounds), rises)], "mean_log_a double, mean_b double, var_log_a double, var_b double, noise double, bound double, rounds int, rises boolean"), 5)


@query()
def m6_response_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifth of each rater's rows, by the population line, shrunken lines and response curves fitted on the others."""
    timed = splits.temporal(_signals(spark, sf_dir))
    train = written(timed.where("not held_out"), "train")
    m, curves = response.fit(train)
    lines = state_space.priors(train, anchored=True).select("rater", F.col("m_intercept").alias("a"), F.col("m_slope").alias("s"))
    pop = regression.population_line(regression.centred(train))
    held = timed.where("held_out").join(lines, "rater").join(curves.select("rater", "log_a", "b"), "rater").crossJoin(F.broadcast(pop))
    arms = {"population": F.col("pop_intercept") + F.col("pop_slope") * F.col("x"), "shrunk": F.col("a") + F.col("s") * F.col("x"), "response": response.predicted(F.col("x"), F.col("log_a"), F.col("b"), m.scale)}
    each = held.groupBy("rater").agg(*(F.sqrt(F.avg(F.pow(F.col("y") - v, 2))).alias(k) for k, v in arms.items()))
    return rounded(each.agg(F.count("*").alias("raters"), *(F.avg(k).alias(f"rmse_{k}") for k in arms)), 5)


@query()
def m5_projected_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multivariate.projected(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "embedding", 4).select("vec_id", "components")


@query()
def f6_text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    v = multivariate.text_vectors(table(spark, sf_dir, "conversations", "conv_id", "turn", "text"), "text")
    return v.select("conv_id", "turn", F.round(F.aggregate(vector_to_array("tfidf"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query()
def f6_text_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five principal components of the turns' TF-IDF vectors."""
    c, rows = text_components.fit_components(table(spark, sf_dir, "conversations", "conv_id", "turn", "text"), "text")
    scored = text_components.scored(rows, c)
    return scored.select("conv_id", "turn", F.transform("components", lambda v: F.round(v, 5)).alias("components"))


@query()
def f6_component_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of each component, and the terms that weigh most in it."""
    c, _ = text_components.fit_components(table(spark, sf_dir, "conversations", "conv_id", "turn", "text"), "text")
    rows = [(k, float(v), [c.terms[i] for i in np.argsort(-np.abs(c.axes[:, k]), kind="stable")[:3]]) for k, v in enumerate(c.variances)]
    return rounded(spark.createDataFrame(rows, "component int, variance double, terms array<string>"))


@query("WITH RECURSIVE e AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_partkey - 1 - (p_partkey % 50) % 2 * ((p_partkey % 50) // 2) END AS parent FROM part), t(node, root, depth) AS (SELECT node, node, 0 FROM e WHERE parent IS NULL UNION ALL SELECT e.node, t.root, t.depth + 1 FROM e JOIN t ON e.parent = t.node) SELECT node, root, depth FROM t")
def s6_walk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and root of every node of an adjacency table: trees of fifty parts each."""
    k = F.col("p_partkey") % 50
    parent = F.when(k != 0, F.col("p_partkey") - 1 - k % 2 * F.floor(k / 2))
    return walk(spark, table(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("node"), parent.cast("long").alias("parent")))


@query("WITH c AS (SELECT * FROM (SELECT o_custkey AS rater, CAST(o_orderdate AS DATE) AS step, sum(o_totalprice) AS score, count(*) % 2 AS signature FROM orders GROUP BY ALL)), n AS (SELECT * FROM (SELECT *, coalesce(signature <> lag(signature) OVER (PARTITION BY rater ORDER BY step), true) AS new FROM c) WHERE new) SELECT rater, step, round(coalesce(lag(score, 2) OVER (PARTITION BY rater ORDER BY step), 0), 2) AS delayed FROM n")
def k_delayed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from raterline.streaming.running import delayed

    o = orders(spark, sf_dir).groupBy("rater", F.to_date("ts").alias("step")).agg(F.sum("y").alias("score"), (F.count("*") % 2).alias("signature"))
    return delayed(o, 2).select("rater", "step", F.round("delayed", 2).alias("delayed"))


@query()
def m2_one_hot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    f = multivariate.encoded(rater_features(spark, sf_dir), ["kind"], ["mean_x"])
    return f.select("rater", F.size(vector_to_array("features")).alias("width"), F.round(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT count(*) AS n_rows, count(DISTINCT user_id) AS raters, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (value < 0) AS negative, count(*) - count(DISTINCT event_id) AS repeated, md5('k=5;seed=20260420') AS config FROM events")
def d3_run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "value")
    return e.agg(
        F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("raters"), F.count_if(F.col("value").isNull()).alias("missing"), F.count_if(F.col("value") < 0).alias("negative"),
        (F.count("*") - F.count_distinct("event_id")).alias("repeated"),
    ).withColumn("config", F.md5(F.lit("k=5;seed=20260420").cast("binary")))
