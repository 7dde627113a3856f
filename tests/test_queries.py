"""Queries without SQL run and give whole results; the entry points hang together."""

import pytest

from raterline.plans import QUERIES, SQL

RATERS = {"r4_mixed_model", "r4b_quadratic_mixed_model", "t1_kalman_filter", "k9_head_mixtures", "m2_one_hot_features"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    n = df.count()
    raters = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
    assert n == raters if name in RATERS else n > 0
    assert len(set(df.columns)) == len(df.columns)


def test_models_are_registered_in_full(spark, sf_dir):
    """Five orders, 2,000 draws, and models that have converged."""
    assert [r.k for r in QUERIES["m3_mixture_orders"](spark, sf_dir).orderBy("k").collect()] == [1, 2, 3, 4, 5]
    assert QUERIES["b3_other_resampling"](spark, sf_dir).head().valid == 2000
    assert {r.converged for r in QUERIES["r4b_quadratic_mixed_model"](spark, sf_dir).select("converged").collect()} == {True}
    assert {r.converged for r in QUERIES["t1_drift_parameters"](spark, sf_dir).collect()} == {True}


def test_entry_points(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 1


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["s1_parquet_projection"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    plan = QUERIES["j2_two_key_join"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan


def test_core_query_shuffles_observations_once(spark, sf_dir):
    """Observations are scanned once and cross one exchange; all later exchanges move sums, a row for a rater and fold at most."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n, raters = e.count(), e.select("user_id").distinct().count()
    gateway = spark.sparkContext._gateway

    def stages():
        s = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return [s.apply(i) for i in range(s.size())]

    before = {s.stageId() for s in stages()}
    df = QUERIES["core_shrinkage_summary"](spark, sf_dir)
    assert df.count() == 1
    new = [s for s in stages() if s.stageId() not in before and str(s.status()) == "COMPLETE"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan
    large = [s.shuffleWriteRecords() for s in new if s.shuffleWriteRecords() >= 0.5 * n]
    assert len(large) == 1 and large[0] <= n
    assert sum(s.inputRecords() >= 0.5 * n for s in new) == 1
    assert all(s.shuffleWriteRecords() <= 4 * 5 * raters for s in new if s.shuffleWriteRecords() < 0.5 * n)


def test_permuted_signals_read_the_events_once(spark, sf_dir):
    """Places are taken over stored rows: no step parses the events' properties again."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert QUERIES["z2_signal_permuted"](spark, sf_dir).count() == 1
    plans = store.executionsList(int(before), 10_000)
    plans = [plans.apply(i).physicalPlanDescription() for i in range(plans.size())]
    assert sum("events.parquet" in p for p in plans) == 1
