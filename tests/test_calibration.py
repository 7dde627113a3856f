"""Properties of lines, splits and shrinkage, against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterline.operators import inference, mixed, regression, sequential, shrinkage, splits
from raterline.operators.preference import simplex
from raterline.plans.calibration import simulated
from raterline.sources import files
from raterline.streaming.running import delayed, running_lines, windowed_means


@pytest.fixture(scope="module")
def obs(spark):
    """Raters of 1 to 30 rows, some with constant x, some on a perfect line."""
    rng, rows, k = np.random.default_rng(1), [], 0
    for rater in range(40):
        n = 1 + rater % 30
        for _ in range(n):
            x = 5.0 if rater % 11 == 3 else float(rng.normal(10, 3))
            y = 2 * x + 1 if rater % 13 == 5 else 40 + rater * 0.5 + (1 + rater % 5 * 0.2) * x + float(rng.normal(0, 2))
            rows.append((rater, k, "ab"[k % 2], f"2024-01-{1 + k % 28:02d}", x, y))
            k += 1
    return spark.createDataFrame(rows, "rater long, obs_id long, grp string, ts string, x double, y double").cache()


def direct(x, y):
    if len(x) < 2 or np.var(x) < 1e-12:
        return (float(np.mean(y)) if len(y) else 0.0), 0.0, None, None
    b = float(np.cov(x, y, bias=True)[0, 1] / np.var(x))
    a = float(np.mean(y) - b * np.mean(x))
    sxx = float(((x - x.mean()) ** 2).sum())
    s2 = float(((y - a - b * x) ** 2).sum()) / max(len(x) - 2, 1)
    return a, b, s2 * (1 / len(x) + x.mean() ** 2 / sxx), s2 / sxx


def test_evaluation_matches_direct_refits(obs):
    """Every fold refitted from its rows, without sums."""
    folds = splits.k_folds(obs, 5, 3)
    p = folds.toPandas()
    x, y = p.x, p.y
    rater, fold = p.rater.to_numpy(), p.fold.to_numpy()
    x, y = x.to_numpy(), y.to_numpy()
    lines = [direct(x[rater == r], y[rater == r]) for r in sorted(set(rater))]
    t2 = [max(np.var([q[i] for q in lines], ddof=1) - np.mean([q[2 + i] for q in lines if q[2 + i] is not None]), 1e-6) for i in (0, 1)]
    pa, pb, _, _ = direct(x, y)
    want = {}
    for r in sorted(set(rater)):
        error = np.zeros(4)
        for f in sorted(set(fold[rater == r])):
            train, test = (rater == r) & (fold != f), (rater == r) & (fold == f)
            a, b, va, vb = direct(x[train], y[train])
            wa, wb = (t2[0] / (t2[0] + va) if va is not None else 0), (t2[1] / (t2[1] + vb) if vb is not None else 0)
            arms = [(y[train].mean(), 0), (pa, pb), (a, b), (wa * a + (1 - wa) * pa, wb * b + (1 - wb) * pb)]
            error += [((y[test] - i - s * x[test]) ** 2).sum() for i, s in arms]
        want[r] = np.sqrt(error / (rater == r).sum())
    got = {r.rater: [r.rmse_mean, r.rmse_population, r.rmse_rater, r.rmse_shrunk] for r in shrinkage.rater_rmse(shrinkage.held_out_errors(folds)).collect()}
    assert got.keys() == want.keys()
    for r in want:
        assert got[r] == pytest.approx(want[r], rel=1e-6, abs=1e-5)


@pytest.mark.parametrize("partitions", [1, 7])
def test_results_do_not_depend_on_partitions(spark, obs, partitions):
    a = shrinkage.evaluation(splits.k_folds(obs, 5, 3)).head()
    b = shrinkage.evaluation(splits.k_folds(obs.repartition(partitions), 5, 3)).head()
    assert all(x == pytest.approx(y, rel=1e-5) for x, y in zip(a, b))


def test_folds_partition_rows(obs):
    for f in (splits.k_folds(obs, 5, 1), splits.round_robin(obs, 5, 1), splits.balanced(obs, 4, 1), splits.hash_folds(obs, 5, 1)):
        p = f.toPandas()
        assert p.obs_id.is_unique and p.fold.between(0, 4).all()
    b = splits.balanced(obs, 4, 1).groupBy("rater", "fold").count().groupBy("rater").agg((F.max("count") - F.min("count")).alias("gap"), F.count("*").alias("k")).where("k = 4")
    assert b.agg(F.max("gap")).head()[0] <= 1
    k = splits.k_folds(obs, 5, 1).groupBy("rater", "fold").count().toPandas()
    for _, g in k.groupby("rater"):
        n = g["count"].sum()
        assert g.sort_values("fold")["count"].tolist() == [n // 5] * 4 + [n - 4 * (n // 5)]


def test_weights_lie_between(obs):
    lines = shrinkage.rater_lines(regression.centred(obs))
    s = shrinkage.shrunk(lines.crossJoin(shrinkage.between_variance(lines)).crossJoin(shrinkage.mean_centre(lines))).toPandas()
    assert s.w_intercept.between(0, 1).all() and s.w_slope.between(0, 1).all()
    low, high = np.minimum(s.slope, s.pop_slope), np.maximum(s.slope, s.pop_slope)
    assert ((s.eb_slope >= low - 1e-9) & (s.eb_slope <= high + 1e-9)).all()
    flat = s[s.v_slope.isna()]
    assert len(flat) and (flat.w_slope == 0).all()


@pytest.mark.parametrize(("guard", "few"), [("a", (5.0, 0.0)), ("b", (None, None)), ("c", (None, None)), ("d", (5.0, 0.0))])
def test_guards(spark, guard, few):
    d = spark.createDataFrame([("one", 1.0, 5.0), *(("flat", 2.0, v) for v in (1.0, 2.0, 3.0)), *(("line", v, 2 * v) for v in (1.0, 2.0, 4.0))], "rater string, x double, y double")
    got = {r.rater: r for r in regression.line(regression.sums(d, "rater", x="x", y="y"), guard).collect()}
    assert (got["one"].intercept, got["one"].slope) == few
    assert got["flat"].intercept == (None if guard == "c" else 2.0) and got["flat"].v_slope is None
    assert got["line"].slope == pytest.approx(2) and got["line"].v_slope == pytest.approx(0, abs=1e-9)


def test_variance_floor_pulls_exact_fits_to_the_population(spark):
    d = spark.createDataFrame([(1.0, 0.0), (1.0, 0.5), (1.0, None)], "t2 double, v double")
    w = lambda **o: [r[0] for r in d.select(shrinkage.weight(F.col("t2"), F.col("v"), **o)).collect()]
    assert w() == [1.0, pytest.approx(2 / 3), 0.0] and w(v_floor=1e-6) == [0.0, pytest.approx(2 / 3), 0.0]


def test_simulated_spread_is_recovered(spark):
    lines = shrinkage.rater_lines(regression.centred(simulated(spark, 400, 20)), "b")
    t = shrinkage.between_variance(lines, floor=0.0).head()
    assert t.t2_intercept == pytest.approx(64, rel=0.25) and t.t2_slope == pytest.approx(0.09, rel=0.35)
    g = shrinkage.evaluation(splits.k_folds(simulated(spark, 400, 20), 5, 1)).head()
    assert g.rmse_shrunk < g.rmse_rater < g.rmse_population and g.gain_of_means > 0.2


def test_mixed_model_recovers_and_shrinks(spark):
    c = regression.centred(simulated(spark, 300, 10))
    sums = mixed.power_sums(c, "rater").cache()
    m = mixed.fit(sums)
    assert m.covariance[0, 0] == pytest.approx(64, rel=0.25) and m.covariance[1, 1] == pytest.approx(0.09, rel=0.4) and m.noise == pytest.approx(25, rel=0.1)
    assert mixed.effects(sums, m).count() == 300


def dense_reml(groups, power, x_power, d, noise):
    """Restricted log-likelihood from whole covariance matrices; random effects of powers up to `power`."""
    left, right, total, n = np.zeros((x_power + 1, x_power + 1)), np.zeros(x_power + 1), 0.0, 0
    parts = []
    for cx, y in groups:
        x = np.stack([cx**k for k in range(x_power + 1)], axis=1)
        z = x[:, : power + 1]
        v = z @ d @ z.T + noise * np.eye(len(y))
        inv = np.linalg.inv(v)
        left += x.T @ inv @ x
        right += x.T @ inv @ y
        total -= 0.5 * np.linalg.slogdet(v)[1]
        n += len(y)
        parts.append((x, y, inv))
    beta = np.linalg.solve(left, right)
    value = total - 0.5 * (n - x_power - 1) * np.log(2 * np.pi) - 0.5 * np.linalg.slogdet(left)[1] - 0.5 * sum((y - x @ beta) @ inv @ (y - x @ beta) for x, y, inv in parts)
    return value, beta


def climbed(f, at, steps=200):
    """Maximise f by Newton steps with numerical derivatives, which knows nothing of mixed models."""
    value, k, h = f(at), len(at), 1e-4
    for _ in range(steps):
        e = h * np.eye(k)
        g = np.array([(f(at + e[i]) - f(at - e[i])) / (2 * h) for i in range(k)])
        m = np.array([[(f(at + e[i] + e[j]) - f(at + e[i] - e[j]) - f(at - e[i] + e[j]) + f(at - e[i] - e[j])) / (4 * h * h) for j in range(k)] for i in range(k)])
        w, v = np.linalg.eigh(m)
        step = v @ ((v.T @ g) / np.maximum(np.abs(w), 1e-6))
        step = step / max(1.0, np.abs(step).max())
        while f(at + step) < value and np.abs(step).max() > 1e-12:
            step = step / 2
        if f(at + step) - value < 1e-10:
            break
        at, value = at + step, f(at + step)
    return at, value


def rater_groups(spark, raters, size, degree, seed, effects):
    rng = np.random.default_rng(seed)
    rows, groups = [], []
    for r in range(raters):
        n = size + r % 3
        x = rng.normal(size=n)
        b = rng.normal(size=degree + 1) * effects
        y = sum((1.0 + b[k]) * x**k for k in range(degree + 1)) + rng.normal(size=n) * 0.7
        rows += [(r, float(a), float(c)) for a, c in zip(x, y)]
        groups.append((x, y))
    return spark.createDataFrame(rows, "rater int, cx double, cy double"), groups


@pytest.mark.parametrize("degree,effects", [(1, [1.0, 0.5]), (2, [1.0, 0.5, 0.4]), (1, [1.0, 0.0]), (2, [0.8, 0.0, 0.3])])
def test_mixed_model_equals_a_plain_optimiser(spark, degree, effects):
    """Inner maxima and such with a variance of zero."""
    d, groups = rater_groups(spark, 30, 5, degree, 4, np.array(effects))
    m = mixed.fit(mixed.power_sums(d, "rater", degree=degree), degree=degree, structures=mixed.shapes(degree + 1)[:1], tolerance=1e-9, passes=60)
    p = degree + 1
    cells = [(i, j) for i in range(p) for j in range(i + 1)]

    def f(phi):
        low = np.zeros((p, p))
        for (i, j), v in zip(cells, phi):
            low[i, j] = v
        return dense_reml(groups, degree, degree, low @ low.T, np.exp(phi[-1]))[0]

    start = np.array([*(0.5 if i == j else 0.0 for i, j in cells), 0.0])
    at, best = climbed(f, start)
    assert m.converged and m.structure == "full" and m.passes < 40
    assert m.log_likelihood == pytest.approx(best, abs=1e-4)
    assert m.log_likelihood == pytest.approx(dense_reml(groups, degree, degree, m.covariance, m.noise)[0], abs=1e-6)
    low = np.zeros((p, p))
    for (i, j), v in zip(cells, at):
        low[i, j] = v
    assert np.allclose(m.covariance, low @ low.T, atol=2e-3) and m.noise == pytest.approx(np.exp(at[-1]), rel=1e-3)
    assert np.allclose(m.beta, dense_reml(groups, degree, degree, low @ low.T, np.exp(at[-1]))[1], atol=1e-3)


def test_mixed_model_effects_are_the_best_linear_prediction(spark):
    d, groups = rater_groups(spark, 12, 6, 2, 9, np.array([1.0, 0.5, 0.3]))
    sums = mixed.power_sums(d, "rater", degree=2)
    m = mixed.fit(sums, degree=2)
    got = {r.rater: (r.intercept, r.slope, r.quadratic) for r in mixed.effects(sums, m).collect()}
    for r, (x, y) in enumerate(groups):
        z = np.stack([x**k for k in range(3)], axis=1)
        want = m.beta + m.covariance @ z.T @ np.linalg.solve(z @ m.covariance @ z.T + m.noise * np.eye(len(y)), y - z @ m.beta)
        assert np.allclose(got[r], want, atol=1e-8)


def test_mixed_model_falls_back(spark):
    """Two values of x tell two variances apart but no covariance; one row a rater tells none from the noise."""
    rng = np.random.default_rng(8)
    rows = [(r, float(r % 2), float(rng.normal() * (1 + 2 * (r % 2)) + e)) for r in range(200) for e in rng.normal(size=3)]
    rows = [(r, x, y) for (r, x, y), e in zip(rows, np.repeat(rng.normal(size=200), 3)) for y in [float(y + e)]]
    d = spark.createDataFrame(rows, "rater int, cx double, cy double")
    m = mixed.fit(mixed.power_sums(d, "rater"))
    assert m.converged and m.structure == "diagonal" and m.covariance[0, 1] == 0 and m.covariance[0, 0] > 0
    quadratic = mixed.fit(mixed.power_sums(spark.createDataFrame([(r, float(r % 3), y) for r, _, y in rows], "rater int, cx double, cy double"), "rater", degree=2), degree=2)
    assert quadratic.converged and quadratic.structure != "full"
    one = mixed.fit(mixed.power_sums(d.dropDuplicates(["rater"]), "rater"))
    assert not one.converged and one.structure == "intercept"
    with pytest.raises(ValueError):
        mixed.fit(mixed.power_sums(d.withColumn("cx", F.lit(1.0)), "rater"))
    with pytest.raises(ValueError):
        mixed.fit(mixed.power_sums(d.limit(0), "rater"))


def test_bootstrap_is_the_same_each_time(spark, obs):
    rows = inference.numbered(obs.groupBy("rater").agg(F.avg("y").alias("m_y")))
    assert sorted(r.idx for r in rows.collect()) == list(range(40)) and {r.m for r in rows.collect()} == {40}
    a, b = ([tuple(r) for r in inference.bootstrap(rows.repartition(p), 20, 5, F.avg("m_y").alias("v")).orderBy("b").collect()] for p in (1, 5))
    assert len(a) == 20 and all(x[1] == pytest.approx(y[1]) for x, y in zip(a, b))


def test_small_tests():
    assert inference.sign_test(5, 5) == pytest.approx(2 / 32) and inference.permutation_test([1.0, 1.0, 1.0]) == pytest.approx(0.25)
    t, df = inference.paired_t([1.0, 2.0, 3.0])
    assert (t, df) == (pytest.approx(2 / (1 / 3**0.5)), 2)
    low, high = inference.bca_interval(0.0, list(np.random.default_rng(0).normal(size=2000)), [0.1, -0.1, 0.05, -0.05] * 10)
    assert low == pytest.approx(-1.96, abs=0.2) and high == pytest.approx(1.96, abs=0.2)
    assert np.isnan(inference.bca_interval(0.0, [1.0], [])[0]) and inference.least_detectable_effect(100) == pytest.approx(0.28, abs=0.01)
    assert simplex(np.array([2.0, 0.0, 0.0])).tolist() == [1, 0, 0]


def test_wilcoxon_zeros(spark):
    d = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (1.0, 4.0)], "a double, b double")
    w, z = inference.wilcoxon(d, "a", "b").head(), inference.wilcoxon(d, "a", "b", "zsplit").head()
    assert (w.n, w.w_plus, w.w_minus) == (3, 3.0, 3.0) and (z.n, z.w_plus, z.w_minus) == (4, 5.5, 4.5)


def test_readers_and_sinks(spark, tmp_path):
    import gzip
    import json

    tree = {"message_tree_id": "t", "prompt": {"message_id": "a", "parent_id": None, "user_id": "u", "role": "p", "lang": "en", "created_date": "2024", "review_count": 1, "rank": None, "replies": [{"message_id": "b", "parent_id": "a", "replies": [{"message_id": "c", "parent_id": "b", "replies": []}]}, {"message_id": "d", "parent_id": "a", "replies": []}]}}
    with gzip.open(tmp_path / "t.jsonl.gz", "wt") as f:
        f.write(json.dumps(tree) + "\n")
    rows = files.flatten_trees(files.read_json_lines(spark, str(tmp_path / "t.jsonl.gz"), files.tree_schema(), partitions=2))
    assert sorted((r.message_id, r.depth) for r in rows.collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]
    (tmp_path / "x.csv").write_text("id,score\n1,2.5\n2,bad\n")
    assert [(r.id, r.score) for r in files.read_csv(spark, str(tmp_path / "x.csv"), "id int, score double").orderBy("id").collect()] == [(1, 2.5), (2, None)]
    d = spark.createDataFrame([(1, 0.5, "a_b")], "i int, v double, s string")
    files.write_table(d, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1
    assert files.markdown(d).splitlines()[2] == "| 1 | 0.5 | a_b |" and r"a\_b" in files.latex(d)
    e = spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, None)], "node int, parent int")
    assert sorted(tuple(r) for r in files.walk(spark, e).collect()) == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (9, 9, 0)]


@pytest.mark.parametrize("deep", [7, 3000])
def test_trees_of_any_depth(spark, tmp_path, deep):
    """Every reply of a deep tree has a row, whether its line is read with the tree schema or has a struct."""
    text = "".join(f'{{"message_id": "m{k}", "rank": {k}, "labels": {{"q": [1, {{"v": "}}]"}}]}}, "replies": [{{"message_id": "s{k}"}}, ' for k in range(deep)) + '{"message_id": "end"}' + "]}" * deep
    (tmp_path / "t.jsonl").write_text(f'{{"message_tree_id": "t", "prompt": {text}}}\n')
    want = sorted([*((k, f"m{k}", k) for k in range(deep)), *((k + 1, f"s{k}", None) for k in range(deep)), (deep, "end", None)], key=str)
    lines = files.read_json_lines(spark, str(tmp_path / "t.jsonl"), files.tree_schema())
    for trees in [lines, *([files.read_json_lines(spark, str(tmp_path / "t.jsonl"))] if deep < 100 else [])]:
        assert sorted(((r.depth, r.message_id, r.rank) for r in files.flatten_trees(trees).collect()), key=str) == want


def test_walk_has_no_depth_limit(spark):
    """A chain deeper than a recursive CTE would go, a node without a way to a root, a cycle, a node with two parents."""
    chain = [(k, k - 1 if k else None) for k in range(1500)]
    e = spark.createDataFrame([*chain, (2001, 2000), (3001, 3002), (3002, 3001), (4000, None), (4001, 4000), (4001, 0)], "node int, parent int")
    assert sorted(tuple(r) for r in files.walk(spark, e).collect()) == sorted([*((k, 0, k) for k in range(1500)), (4000, 4000, 0), (4001, 4000, 1), (4001, 0, 1)])
    with pytest.raises(ValueError):
        files.walk(spark, spark.createDataFrame([(1, None), (2, 1), (2, 3), (3, 2)], "node int, parent int"))


def test_streams(spark, obs, tmp_path):
    obs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in"))
    q = running_lines(stream).writeStream.format("memory").queryName("lines_now").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {r.rater: r.slope for r in regression.line(regression.sums(obs, "rater", x="x", y="y")).collect()}
    live = {r.rater: r.slope for r in spark.table("lines_now").collect()}
    assert live.keys() == batch.keys() and all(live[k] == pytest.approx(batch[k], rel=1e-6, abs=1e-6) for k in batch)
    w = windowed_means(stream).writeStream.format("memory").queryName("windows_now").outputMode("append").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert spark.table("windows_now").count() > 0
    d = spark.createDataFrame([("r", 1, "s1", 1.0), ("r", 2, "s1", 1.0), ("r", 3, "s2", 2.0), ("r", 4, "s3", 3.0)], "rater string, step int, signature string, score double")
    assert [r.delayed for r in delayed(d, 1).orderBy("step").collect()] == [0.0, 1.0, 2.0]


def test_projection_is_that_of_the_covariance(spark):
    import numpy as np

    from raterline.operators.multivariate import projected

    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5)) * [5, 3, 2, 1, 0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(60, None), (61, [1.0]), (62, [1.0, float("nan"), 0.0, 0.0, 0.0]), (63, [])]
    got = {r["i"]: r["components"] for r in projected(spark.createDataFrame(rows, "i int, e array<double>"), "e", 2).collect()}
    _, directions = np.linalg.eigh(np.cov(v.T))
    want = np.abs(v @ directions[:, ::-1][:, :2])
    assert np.allclose(np.abs([got[i] for i in range(60)]), want, atol=1e-8)
    assert [got[i] for i in range(60, 64)] == [None] * 4
    empty = projected(spark.createDataFrame([], "i int, e array<double>"), "e", 2)
    assert empty.count() == 0 and empty.columns == ["i", "e", "components"]


def test_spline_basis_interpolates_and_bends():
    """Straight lines are not rough, values at the knots come back, and the roughness is the integral of the squared bend."""
    knots = np.array([0.0, 0.2, 0.5, 0.7, 1.0])
    b, rough = sequential.spline_basis(knots, knots)
    assert np.allclose(b, np.eye(5)) and np.allclose(rough @ (2 + 3 * knots), 0, atol=1e-9)
    v, t = np.array([1.0, -1.0, 2.0, 0.5, 0.0]), np.linspace(0, 1, 20001)
    f = sequential.spline_basis(t, knots)[0] @ v
    bend = np.diff(f, 2) / (t[1] - t[0]) ** 2
    assert (bend**2).mean() == pytest.approx(v @ rough @ v, rel=1e-2) and abs(bend[0]) < 1 and abs(bend[-1]) < 1


def test_reports_are_never_cut(spark):
    d = spark.range(5)
    assert files.json_report(d, 5).count("id") == 5
    for report in (files.json_report, files.markdown, files.latex):
        with pytest.raises(ValueError):
            report(d, 4)


def under_broadcasts(df):
    """Lines of the final plan that lie under an exchange to the driver."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = [len(v) - len(v.lstrip(" :+-*()0123456789")) for v in lines]
    out = []
    for i, v in enumerate(lines):
        if "BroadcastExchange" in v:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out += lines[i + 1 : end]
    return out


def test_bootstrap_never_broadcasts_its_grid(spark):
    """Slots are narrower than rows of values, and the grid of all draws looks as small as they are."""
    rows = files.written(spark.range(3000).select(F.col("id").alias("idx"), F.lit(3000).cast("long").alias("m"), *(F.rand(i).alias(f"v{i}") for i in range(8))), "rows")
    df = inference.bootstrap(rows, 20, 5, *(F.sum(f"v{i}").alias(f"v{i}") for i in range(8)), F.count("v0").alias("n"))
    assert {r.n for r in df.collect()} == {3000}
    assert not [v for v in under_broadcasts(df) if "Generate" in v]
