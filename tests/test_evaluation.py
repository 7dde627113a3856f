"""Evaluations by setting, after few ratings and row by row, against refits from the rows; logs of text."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterline.operators import evaluation, regression, shrinkage, splits
from raterline.sources import files

OBS = "rater long, obs_id long, grp string, ts string, x double, y double"


@pytest.fixture(scope="module")
def rows():
    """Raters of 1 to 20 rows; every seventh has a constant x; ratings repeat."""
    rng, out = np.random.default_rng(3), []
    for rater in range(30):
        for k in range(1 + rater % 20):
            x = 4.0 if rater % 7 == 2 else float(rng.integers(0, 9))
            out.append((rater, len(out), "ab"[k % 2], f"2024-01-{1 + k:02d}", x, float(10 + rater + x + rng.normal())))
    return out


def line(x, y):
    if len(x) < 2 or np.var(x) < 1e-12:
        return float(np.mean(y)), 0.0
    b, a = np.polyfit(x, y, 1)
    return float(a), float(b)


def test_rows_left_out_match_refits(spark, rows):
    got = evaluation.leave_one_row_out(spark.createDataFrame(rows, OBS)).head()
    each: dict[int, list] = {}
    for r in rows:
        each.setdefault(r[0], []).append(r)
    errors = []
    for own in each.values():
        if len(own) < 4:
            continue
        for i, r in enumerate(own):
            rest = own[:i] + own[i + 1 :]
            a, b = line(np.array([q[4] for q in rest]), np.array([q[5] for q in rest]))
            errors.append((a + b * r[4] - r[5]) ** 2)
    assert got.rows == len(errors) and math.isclose(got.rmse_rater, math.sqrt(np.mean(errors)), rel_tol=1e-9)


def test_new_raters_match_refits(spark, rows):
    obs = spark.createDataFrame(rows, OBS)
    held = {r.rater for r in splits.disjoint_raters(obs, 0.5, 1).where("held_out").collect()}
    got = {(r.arm, r.budget): r for r in evaluation.cold_start(obs, [2, 5], 0.5, 1).collect()}
    assert {a for a, _ in got} == {"mean", "population", "rater", "shrunk"}
    for budget in (2, 5):
        errors = []
        for rater in held:
            own = sorted((r for r in rows if r[0] == rater), key=lambda r: (r[3], r[1]))
            if len(own) >= budget + 2:
                a, b = line(np.array([r[4] for r in own[:budget]]), np.array([r[5] for r in own[:budget]]))
                errors.append(math.sqrt(np.mean([(a + b * r[4] - r[5]) ** 2 for r in own[budget:]])))
        assert got["rater", budget].raters == len(errors) and math.isclose(got["rater", budget].rmse, np.mean(errors), rel_tol=1e-7)
        assert got["population", budget].win_rate == 0 and got["population", budget].break_even == 2


def test_one_setting_is_the_core_evaluation(spark, rows):
    folds = splits.k_folds(spark.createDataFrame(rows, OBS), 3, 1)
    by = {r.rater: r for r in evaluation.errors_by_setting(folds.withColumn("setting", F.explode(F.array(F.lit(1), F.lit(2))))).where("setting = 2").collect()}
    core = {r.rater: r for r in shrinkage.rater_rmse(shrinkage.held_out_errors(folds)).collect()}
    assert by.keys() == core.keys()
    assert all(math.isclose(by[k].rmse_shrunk, core[k].rmse_shrunk, rel_tol=1e-7, abs_tol=1e-7) for k in core)


def test_small_strata_and_raters_without_one_take_known_lines(spark, rows):
    folds = splits.k_folds(spark.createDataFrame(rows, OBS), 3, 1)
    strata = spark.createDataFrame([(r, "big" if r % 2 else "small") for r in range(20)], "rater long, stratum string")
    out = evaluation.simple_lines(folds, strata.where("stratum = 'big' or rater = 4")).collect()
    assert all(math.isclose(r.rmse_stratum, r.rmse_population, rel_tol=1e-9) for r in out if r.rater == 4)
    assert {r.rater for r in out} == {r.rater for r in folds.select("rater").distinct().collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], OBS)
    assert evaluation.cold_start(none, [2], 0.3, 1).count() == 0
    assert evaluation.leave_one_row_out(none).head().rows == 0
    assert evaluation.errors_by_setting(none.withColumn("fold", F.lit(0)).withColumn("setting", F.lit(0))).count() == 0
    assert regression.robust_errors(none, regression.quadratic(none, "rater"), "rater").count() == 0


def test_robust_errors_match_the_sandwich(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=40)
    y = 1 + 2 * x - x * x + rng.normal(size=40) * (1 + np.abs(x))
    obs = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "rater long, x double, y double")
    got = regression.robust_errors(obs, regression.quadratic(obs, "rater"), "rater").head()
    d = x - x.mean()
    m = np.stack([np.ones(40), d, d * d], axis=1)
    inverse, e = np.linalg.inv(m.T @ m), y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
    want = np.sqrt(np.diag(inverse @ (m.T * e**2) @ m @ inverse) * 40 / 37)
    assert math.isclose(got.se_b, want[1], rel_tol=1e-7) and math.isclose(got.se_c, want[2], rel_tol=1e-7)


def test_log_sections(spark, tmp_path):
    (tmp_path / "log.txt").write_text("[1] before loss=3\n[2] == start a\n[3] loss=0.5\nno fields here\n[4] == start b\n[5] loss=x\n")
    log = files.read_log(spark, str(tmp_path / "log.txt"), {"place": (r"^\[(\d+)\]", "long"), "loss": (r"loss=([0-9.]+)", "double")})
    got = {r.place: (r.section, r.loss) for r in files.sections(log.where("place is not null"), "== start", order="place").collect()}
    assert got == {1: (0, 3.0), 2: (1, None), 3: (1, 0.5), 4: (2, None), 5: (2, None)}
    assert log.where("place is null").count() == 1


def test_the_parser_takes_what_the_standard_reader_takes():
    import json

    good = ['{"a": [1, {"b": null}], "c": "x,]}"}', "[]", "{}", " 12 ", '[[], {}, ""]', "[1,2]"]
    bad = ["[1 2]", '{"a" "b"}', '{"a": 1,}', "[1,]", "[,1]", "{1: 2}", "[1", "", "1 2", '{"a"}', "]", '{"a": 1]', "{]"]
    deep = "[" * 50_000 + "]" * 50_000
    real = json.loads

    def fails(text):
        raise RecursionError

    json.loads = fails
    try:
        assert [files.parsed(t) for t in good] == [real(t) for t in good]
        for t in bad:
            with pytest.raises(ValueError):
                files.parsed(t)
        v, depth = files.parsed(deep), 0
        while v:
            v, depth = v[0], depth + 1
        assert depth == 49_999
    finally:
        json.loads = real


def test_group_mean_arm(spark):
    from raterline.operators import multivariate

    rows = [(r, "a" if r % 2 else "b", float(r % 2 * 10 + r % 3)) for r in range(60)]
    d = spark.createDataFrame(rows, "rater int, kind string, y double")
    assert min(multivariate.cross_validated_r2(d, "y", "rater", model="group_mean")) > 0.9
