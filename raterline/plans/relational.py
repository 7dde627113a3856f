"""Relational queries: reshaping, joins, aggregates, ranks and scalars over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from raterline.functions import scalars
from raterline.operators.inference import average_ranks
from raterline.operators.nearest import nearest
from raterline.plans.registry import query
from raterline.sources.observations import complete, events, md5_int, table

EVENTS = "(SELECT user_id AS rater, event_id AS obs_id, event_type AS grp, ts, CAST(json_extract(props, '$.k') AS DOUBLE) AS x, value AS y FROM events)"


def md5_int_sql(e: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({e} AS VARCHAR)), 1, 8) AS BIGINT)"


@query("SELECT o_orderkey, o_totalprice FROM orders")
def s1_parquet_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")


@query(f"SELECT obs_id, rater, x, y FROM {EVENTS} WHERE rater IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
def p1_drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete(events(spark, sf_dir)).select("obs_id", "rater", "x", "y")


@query("SELECT 'orders:' || o_custkey AS cluster, CAST(o_orderkey AS DOUBLE) AS x, o_totalprice AS y, 'orders' AS corpus FROM orders UNION ALL SELECT 'events:' || user_id, CAST(event_id AS DOUBLE), value, 'events' FROM events")
def p2_canonical_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    def canonical(df: DataFrame, cluster: str, x: str, y: str, corpus: str) -> DataFrame:
        return df.select(F.concat_ws(":", F.lit(corpus), cluster).alias("cluster"), F.col(x).cast("double").alias("x"), F.col(y).alias("y"), F.lit(corpus).alias("corpus"))

    o = canonical(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice", "orders")
    return o.unionByName(canonical(table(spark, sf_dir, "events"), "user_id", "event_id", "value", "events"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN 'loser' ELSE 'winner' END AS outcome, CASE WHEN abs(l_discount) <= 0.05 THEN l_extendedprice ELSE l_extendedprice / l_discount END AS inverse FROM lineitem")
def p3_conditional_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_discount")
    inverse = F.when(F.abs("l_discount") <= 0.05, F.col("l_extendedprice")).otherwise(F.col("l_extendedprice") / F.when(F.col("l_discount") != 0, F.col("l_discount")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.when(F.col("l_returnflag") == "R", "loser").otherwise("winner").alias("outcome"), inverse.alias("inverse"))


_FAMILY = "CASE WHEN contains(p_name, 'ring') THEN 'ring' WHEN starts_with(p_name, 'red') THEN 'red' WHEN contains(p_name, 'widget') THEN 'widget' ELSE 'other' END"
_BUCKET = "CASE WHEN p_size <= 10 THEN 'low' WHEN p_size <= 30 THEN 'mid' ELSE 'high' END"


@query(f"SELECT {_FAMILY} AS family, {_BUCKET} AS bucket, count(*) AS n FROM part GROUP BY ALL")
def p4_first_matching_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, size = F.col("p_name"), F.col("p_size")
    family = F.when(name.contains("ring"), "ring").when(name.startswith("red"), "red").when(name.contains("widget"), "widget").otherwise("other")
    bucket = F.when(size <= 10, "low").when(size <= 30, "mid").otherwise("high")
    return table(spark, sf_dir, "part", "p_name", "p_size").groupBy(family.alias("family"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, attribute, value FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR attribute IN (l_quantity, l_discount, l_tax))")
def p5_wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    wide = [c for c in li.columns if c in ("l_quantity", "l_discount", "l_tax")]
    return li.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], wide, "attribute", "value")


@query("SELECT o_custkey, 'order' AS source, o_orderkey AS id, o_totalprice AS value FROM orders UNION ALL SELECT o_custkey, 'line', l_linenumber, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def p6_explode_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    lines = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("id"), F.col("l_extendedprice").alias("value"))).alias("lines"))
    nested = o.withColumn("orders", F.array(F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")))).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    part = lambda c, tag: nested.select("o_custkey", F.lit(tag).alias("source"), F.inline(c))
    return part("orders", "order").unionByName(part("lines", "line"))


@query("WITH a AS (SELECT vec_id, embedding[1 : 1 + vec_id % 3] AS l, embedding[1 : 2] AS r FROM embeddings), p AS (SELECT vec_id, l, r, unnest(range(0, greatest(len(l), len(r)))) AS pos FROM a) SELECT vec_id, pos, CAST(l[pos + 1] AS DOUBLE) AS left_value, CAST(r[pos + 1] AS DOUBLE) AS right_value FROM p")
def p7_ragged_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.slice("embedding", F.lit(1), (1 + F.col("vec_id") % 3).cast("int")).alias("l"), F.slice("embedding", 1, 2).alias("r"))
    places = e.withColumn("pos", F.explode(F.sequence(F.lit(0), F.greatest(F.size("l"), F.size("r")) - 1)))
    return places.select("vec_id", F.col("pos").cast("long").alias("pos"), F.get("l", F.col("pos")).cast("double").alias("left_value"), F.get("r", F.col("pos")).cast("double").alias("right_value"))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'view' THEN 2.0 WHEN 'click' THEN 3.0 END::DOUBLE AS score FROM events")
def p8_lookup_in_parallel_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, scores = F.array(*map(F.lit, ("purchase", "view", "click"))), F.array(*map(F.lit, (1.0, 2.0, 3.0)))
    at = F.array_position(names, F.col("event_type"))
    return table(spark, sf_dir, "events", "event_id", "event_type").select("event_id", F.when(at > 0, F.get(scores, (at - 1).cast("int"))).alias("score"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def p9_field_with_cast_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "props", "event_type")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0)).alias("k"), F.col("event_type").try_cast("double").alias("bad"))


@query("SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND count(DISTINCT o_orderpriority) >= 4 AND max(o_orderdate) - min(o_orderdate) >= INTERVAL 1000 DAY) USING (o_custkey)")
def p10_cohort_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    span = F.unix_micros(F.max("o_orderdate").cast("timestamp")) - F.unix_micros(F.min("o_orderdate").cast("timestamp"))
    kept = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("kinds"), span.alias("span")).where((F.col("n") >= 12) & (F.col("kinds") >= 4) & (F.col("span") >= 1000 * 86_400_000_000))
    return o.join(kept, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT o_orderpriority AS slice, count(*) AS n, round(avg(o_totalprice), 4) AS mean_y FROM orders GROUP BY 1 HAVING count(*) >= 50 UNION ALL SELECT 'all', count(*), round(avg(o_totalprice), 4) FROM orders")
def p11_slices_with_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderpriority", "o_totalprice")
    sliced = o.withColumn("slice", F.explode(F.array(F.col("o_orderpriority"), F.lit("all"))))
    return sliced.groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_y")).where("n >= 50 or slice = 'all'")


@query("SELECT rater, obs_id FROM (SELECT user_id AS rater, event_id AS obs_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('11:' || event_id), event_id) AS r FROM events) WHERE r <= 10")
def p12_cap_per_rater(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("rater").orderBy(F.md5(F.concat_ws(":", F.lit("11"), F.col("obs_id").cast("string")).cast("binary")), "obs_id")
    return events(spark, sf_dir).select("rater", "obs_id").withColumn("r", F.row_number().over(w)).where("r <= 10").drop("r")


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j1_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("WITH a AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) SELECT l_orderkey, l_suppkey, quantity, n FROM a JOIN b USING (l_orderkey, l_suppkey)")
def j2_two_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    a = li.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"))
    b = li.where("l_returnflag = 'R'").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    return a.join(b, ["l_orderkey", "l_suppkey"])


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def j3_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "lang").join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j4_map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


@query("SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)")
def j5_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "source").join(table(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def j6_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "source").join(table(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_anti")


@query("WITH a AS (SELECT l_suppkey AS k, avg(l_quantity) AS q FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey AS k, avg(l_discount) AS d FROM lineitem GROUP BY 1), c AS (SELECT s_suppkey AS k, s_acctbal FROM supplier) SELECT k, round(q, 6) AS q, round(d, 6) AS d, s_acctbal FROM a JOIN b USING (k) JOIN c USING (k)")
def j7_three_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity", "l_discount").withColumnRenamed("l_suppkey", "k")
    a, b = li.groupBy("k").agg(F.round(F.avg("l_quantity"), 6).alias("q")), li.groupBy("k").agg(F.round(F.avg("l_discount"), 6).alias("d"))
    return a.join(b, "k").join(table(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal").withColumnRenamed("s_suppkey", "k"), "k")


_DAY = "SELECT user_id, CAST(ts AS DATE) AS day, event_type, event_id, value FROM events"


@query(f"WITH e AS ({_DAY}) SELECT a.user_id, a.event_id AS chosen, b.event_id AS rejected FROM e a JOIN e b ON a.user_id = b.user_id AND a.day = b.day WHERE a.event_type = 'purchase' AND b.event_type = 'view'")
def j8_chosen_by_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "ts", "event_type", "event_id").withColumn("day", F.to_date("ts"))
    chosen = e.where("event_type = 'purchase'").select("user_id", "day", F.col("event_id").alias("chosen"))
    return chosen.join(e.where("event_type = 'view'").select("user_id", "day", F.col("event_id").alias("rejected")), ["user_id", "day"]).drop("day")


@query(f"WITH e AS ({_DAY}), p AS (SELECT a.user_id, a.day, a.event_id AS a, b.event_id AS b, row_number() OVER (PARTITION BY a.user_id, a.day ORDER BY md5(a.event_id || ':' || b.event_id), a.event_id, b.event_id) AS r FROM e a JOIN e b ON a.user_id = b.user_id AND a.day = b.day AND a.event_id < b.event_id) SELECT user_id, a, b FROM p WHERE r <= 3")
def j9_pairs_in_group_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap is the feature: at most three hashed pairs a group."""
    e = table(spark, sf_dir, "events", "user_id", "ts", "event_id").withColumn("day", F.to_date("ts")).drop("ts")
    pairs = e.withColumnRenamed("event_id", "a").join(e.withColumnRenamed("event_id", "b"), ["user_id", "day"]).where("a < b")
    key = F.md5(F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")).cast("binary"))
    w = Window.partitionBy("user_id", "day").orderBy(key, "a", "b")
    return pairs.withColumn("r", F.row_number().over(w)).where("r <= 3").select("user_id", "a", "b")


@query("WITH a AS (SELECT l_orderkey AS k, max(l_quantity) AS q FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_orderkey AS k, max(l_quantity) AS q FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1) SELECT CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' WHEN a.q = b.q THEN 'same' ELSE 'differ' END AS kind, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def j10_compare_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").withColumnRenamed("l_orderkey", "k")
    a = li.where("l_linenumber <= 3").groupBy("k").agg(F.max("l_quantity").alias("left_q"))
    b = li.where("l_linenumber >= 2").groupBy("k").agg(F.max("l_quantity").alias("right_q"))
    kind = F.when(F.col("left_q").isNull(), "right").when(F.col("right_q").isNull(), "left").when(F.col("left_q") == F.col("right_q"), "same").otherwise("differ")
    return a.join(b, "k", "full").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) AS centred FROM orders")
def j11_scalar_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return o.crossJoin(F.broadcast(o.agg(F.avg("o_totalprice").alias("m")))).select("o_orderkey", F.round(F.col("o_totalprice") - F.col("m"), 4).alias("centred"))


@query("WITH e AS (SELECT vec_id, label, embedding FROM embeddings), d AS (SELECT a.vec_id, b.vec_id AS nearest, sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]) ** 2))) AS distance FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT vec_id, nearest, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest) AS r FROM d) WHERE r = 1")
def j12_nearest_in_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 20, against all vectors of their cluster."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    best = nearest(e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").alias("v")), "id % 20 = 0")
    return best.select(F.col("id").alias("vec_id"), "nearest", F.round("distance", 6).alias("distance"))


@query("SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 4) AS mean_y, round(stddev_samp(o_totalprice), 4) AS sd_y, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1")
def a1_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = "o_totalprice"
    return table(spark, sf_dir, "orders", "o_custkey", y).groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.avg(y), 4).alias("mean_y"), F.round(F.stddev_samp(y), 4).alias("sd_y"), F.min(y).alias("least"), F.max(y).alias("most"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def a2_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "user_id", "event_type", "ts").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), F.count_distinct(F.to_date("ts")).alias("days"))


@query("SELECT l_suppkey, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 9) AS returned FROM lineitem GROUP BY 1")
def a3_conditional_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag").groupBy("l_suppkey").agg(F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 9).alias("returned"))


@query("SELECT user_id, round(sqrt(avg((value - CAST(json_extract(props, '$.k') AS DOUBLE)) ** 2)), 6) AS rmse FROM events GROUP BY 1")
def a4_rmse_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("y") - F.col("x")
    return events(spark, sf_dir).groupBy(F.col("rater").alias("user_id")).agg(F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


@query("SELECT event_type, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY 1")
def a5_exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6).alias(f"q{int(p * 100):02d}")
    return table(spark, sf_dir, "events", "event_type", "value").groupBy("event_type").agg(q(0.05), q(0.5), q(0.95))


@query("WITH c AS (SELECT event_type, count(*) AS before, count(*) FILTER (value >= 20) AS after FROM events GROUP BY 1), s AS (SELECT event_type, before / sum(before) OVER () AS b, after / sum(after) OVER () AS a, after / before AS kept FROM c) SELECT event_type, round(b, 9) AS share_before, round(a, 9) AS share_after, round(kept, 9) AS retention, round((SELECT 0.5 * sum(abs(a - b)) FROM s), 9) AS total_variation FROM s")
def a6_balance_after_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events", "event_type", "value").groupBy("event_type").agg(F.count("*").alias("before"), F.count_if(F.col("value") >= 20).alias("after"))
    total = c.agg(F.sum("before").alias("all_before"), F.sum("after").alias("all_after"))
    s = c.crossJoin(F.broadcast(total)).select("event_type", (F.col("before") / F.col("all_before")).alias("b"), (F.col("after") / F.col("all_after")).alias("a"), (F.col("after") / F.col("before")).alias("kept"))
    tv = s.agg(F.round(0.5 * F.sum(F.abs(F.col("a") - F.col("b"))), 9).alias("total_variation"))
    return s.crossJoin(F.broadcast(tv)).select("event_type", F.round("b", 9).alias("share_before"), F.round("a", 9).alias("share_after"), F.round("kept", 9).alias("retention"), "total_variation")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id), 6) AS user_mean FROM events")
def a7_group_value_on_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "user_id", "value").select("event_id", F.round(F.avg("value").over(Window.partitionBy("user_id")), 6).alias("user_mean"))


@query("SELECT o_orderkey, CASE WHEN n >= 2 THEN round((s - o_totalprice) / (n - 1), 4) END AS others_mean FROM (SELECT o_orderkey, o_totalprice, sum(o_totalprice) OVER w AS s, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey))")
def a8_leave_one_out_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice").withColumns({"s": F.sum("o_totalprice").over(w), "n": F.count("*").over(w)})
    return o.select("o_orderkey", F.when(F.col("n") >= 2, F.round((F.col("s") - F.col("o_totalprice")) / (F.col("n") - 1), 4)).alias("others_mean"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 9) AS r_price, round(corr(l_quantity, l_discount), 9) AS r_discount FROM lineitem GROUP BY 1")
def a9_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(F.corr("l_quantity", c), 9)
    return table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount").groupBy("l_returnflag").agg(r("l_extendedprice").alias("r_price"), r("l_discount").alias("r_discount"))


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, o_custkey) AS k, count(*) OVER () AS m FROM c) SELECT round(sum(n) FILTER (k <= ceil(m * 0.01)) / sum(n), 9) AS top_share FROM r")
def a10_top_percent_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raters are counted by size first, so the ranks run over distinct sizes, which stay few."""
    c = table(spark, sf_dir, "orders", "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))
    sizes = c.groupBy("n").agg(F.count("*").alias("raters"))
    w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sizes.withColumn("upto", F.sum("raters").over(w)).crossJoin(F.broadcast(c.agg(F.count("*").alias("m"), F.sum("n").alias("all"))))
    taken = F.greatest(F.lit(0), F.least(F.col("raters"), F.ceil(F.col("m") * 0.01) - (F.col("upto") - F.col("raters"))))
    return ranked.agg(F.round(F.sum(taken * F.col("n")) / F.max("all"), 9).alias("top_share"))


@query("WITH t AS (SELECT min(ts) AS t0 FROM events) SELECT user_id, date_trunc('month', ts) AS month, CAST(floor((epoch_us(ts) - epoch_us(t0)) / 604800000000) AS BIGINT) AS week, count(*) AS n FROM events, t GROUP BY ALL")
def a11_time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "ts")
    t0 = e.agg(F.min("ts").alias("t0"))
    week = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / F.lit(604_800_000_000))
    return e.crossJoin(F.broadcast(t0)).groupBy("user_id", F.date_trunc("month", "ts").cast(e.schema["ts"].dataType).alias("month"), week.alias("week")).agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT l_suppkey, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS d FROM lineitem) SELECT l_suppkey, round(avg(d ** 3) / pow(avg(d * d), 1.5), 6) AS skew, round(avg(d ** 4) / (avg(d * d) * avg(d * d)) - 3, 6) AS excess FROM m GROUP BY 1")
def a12_skew_and_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_suppkey", "l_extendedprice").groupBy("l_suppkey").agg(F.round(F.skewness("l_extendedprice"), 6).alias("skew"), F.round(F.kurtosis("l_extendedprice"), 6).alias("excess"))


@query("WITH s AS (SELECT user_id, value, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS section FROM events) SELECT user_id, CAST(section AS BIGINT) AS section, round(avg(value), 6) AS mean_v, max(value) AS max_v, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 9) AS over FROM s GROUP BY ALL")
def s10_a13_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section begins at each purchase, as a log's does at a marker line."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = table(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type", "value").withColumn("section", F.sum((F.col("event_type") == "purchase").cast("long")).over(w))
    return e.groupBy("user_id", "section").agg(
        F.round(F.avg("value"), 6).alias("mean_v"), F.max("value").alias("max_v"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.round(F.avg((F.col("value") > 50).cast("double")), 9).alias("over")
    )


@query(f"SELECT rater, obs_id, row_number() OVER (PARTITION BY rater ORDER BY ts, x, obs_id) AS place FROM {EVENTS}")
def w1_total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("rater", "obs_id", F.row_number().over(Window.partitionBy("rater").orderBy("ts", F.asc_nulls_last("x"), "obs_id")).cast("long").alias("place"))


@query("SELECT o_custkey, o_orderkey AS best, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def w2_best_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equals wins; a struct maximum combines on the map side, unlike a rank."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return o.groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("b")).select("o_custkey", (-F.col("b.k")).alias("best"), "b.o_totalprice")


@query("SELECT user_id, event_id AS lowest FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN NULL ELSE value END ASC NULLS LAST, event_id) AS r FROM events) WHERE r = 1")
def w3_lowest_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("event_type") == "error", None).otherwise(F.col("value"))
    w = Window.partitionBy("user_id").orderBy(score.asc_nulls_last(), "event_id")
    return table(spark, sf_dir, "events", "user_id", "event_id", "event_type", "value").withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", F.col("event_id").alias("lowest"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 5")
def w4_first_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events", "user_id", "event_id", "ts").withColumn("r", F.row_number().over(w)).where("r <= 5").select("user_id", "event_id")


@query("(SELECT 'top' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) UNION ALL (SELECT 'bottom', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5)")
def w5_top_and_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    end = lambda side, key: o.orderBy(key, "o_orderkey").limit(5).select(F.lit(side).alias("side"), "o_orderkey", "o_totalprice")
    return end("top", F.desc("o_totalprice")).unionByName(end("bottom", F.asc("o_totalprice")))


@query("WITH q AS (SELECT quantile_cont(l_quantity, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM lineitem) SELECT CASE WHEN l_quantity <= e[2] THEN 1 WHEN l_quantity <= e[3] THEN 2 WHEN l_quantity <= e[4] THEN 3 ELSE 4 END AS bin, count(*) AS n, max(l_quantity) AS upto FROM lineitem, q GROUP BY 1")
def w6_quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right-closed bins between quantile edges; equal values share a bin, and equal edges merge."""
    li = table(spark, sf_dir, "lineitem", "l_quantity")
    edges = li.agg(F.array_distinct(F.percentile("l_quantity", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))).alias("e"))
    bin_ = F.greatest(F.lit(1), F.size(F.filter("e", lambda x: x < F.col("l_quantity"))))
    return li.crossJoin(F.broadcast(edges)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.max("l_quantity").alias("upto"))


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS average_rank FROM c")
def w7_average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of values come from counts of equal values, so no task orders all rows."""
    c = table(spark, sf_dir, "orders", "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return average_ranks(c, "n", "average_rank").select("o_custkey", "average_rank")


@query("SELECT event_id, r <= round_even(n * 0.8, 0) AS early, r * 2 <= n AS first_half FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)")
def w8_split_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts")
    r, n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.count("*").over(Window.partitionBy("user_id"))
    return e.withColumns({"r": r, "n": n}).select("event_id", (F.col("r") <= F.bround(F.col("n") * 0.8)).alias("early"), (F.col("r") * 2 <= F.col("n")).alias("first_half"))


@query("SELECT 'c' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 's', s_suppkey FROM supplier")
def u1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id")).unionByName(table(spark, sf_dir, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id")))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def u2_first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "source", "n_chars", "doc_id")
    return d.groupBy("source").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("k"))).alias("b")).select("source", (-F.col("b.k")).alias("doc_id"))


@query("SELECT 'both' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'none', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def u3_intersect_and_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    n = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(o.intersect(c), "both").unionByName(n(c.subtract(o), "none"))


@query("SELECT o_orderkey, CASE regexp_replace(o_orderpriority, '^[0-9]-', '') WHEN 'URGENT' THEN 4.0 WHEN 'HIGH' THEN 3.0 WHEN 'MEDIUM' THEN 2.0 WHEN 'LOW' THEN 1.0 END::DOUBLE AS score FROM orders")
def f1_ordinal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.regexp_replace("o_orderpriority", "^[0-9]-", "")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", scalars.ordinal(label, {"URGENT": 4.0, "HIGH": 3.0, "MEDIUM": 2.0, "LOW": 1.0}).alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(list_avg(list_filter([CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_discount END, l_tax, CASE WHEN l_linestatus = 'O' THEN NULL ELSE 0.5 END], lambda v: v IS NOT NULL)), 9) AS mean_v, round(abs(l_discount - 0.5), 9) AS margin, l_discount = l_tax AS tie FROM lineitem")
def f2_row_mean_and_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    values = F.array(F.when(F.col("l_returnflag") != "R", F.col("l_discount")), F.col("l_tax"), F.when(F.col("l_linestatus") != "O", F.lit(0.5)))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round(scalars.mean_of(values), 9).alias("mean_v"), F.round(F.abs(F.col("l_discount") - 0.5), 9).alias("margin"), (F.col("l_discount") == F.col("l_tax")).alias("tie"))


@query("WITH z AS (SELECT event_id, value - 30 AS z, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) SELECT event_id, round(ln(1 + abs(z)), 6) AS log1p, round(CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END, 9) AS sigmoid, round(-(greatest(-z, 0) + ln(1 + exp(-abs(z)))), 6) AS log_sigmoid, round(greatest(z, k) + ln(1 + exp(-abs(z - k))), 6) AS log_add_exp, least(greatest(z, -10), 10) AS clipped, CAST(sign(z) AS DOUBLE) AS sign, round(sqrt(abs(z)), 9) AS root FROM z")
def f3_numeric_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, k = F.col("y") - 30, F.col("x")
    return events(spark, sf_dir).select(
        F.col("obs_id").alias("event_id"), F.round(F.log1p(F.abs(z)), 6).alias("log1p"), F.round(scalars.sigmoid(z), 9).alias("sigmoid"), F.round(scalars.log_sigmoid(z), 6).alias("log_sigmoid"),
        F.round(scalars.log_add_exp(z, k), 6).alias("log_add_exp"), scalars.clipped(z, -10.0, 10.0).alias("clipped"), F.signum(z).alias("sign"), F.round(F.sqrt(F.abs(z)), 9).alias("root"),
    )


@query("SELECT o_orderkey, CAST((o_orderkey % 40 + o_orderkey % 40 + 9) / 2 AS DOUBLE) AS midpoint, 65.0::DOUBLE AS open_ended FROM orders")
def f4_age_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("o_orderkey") % 40
    text = F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string"))
    return table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", scalars.age_midpoint(text).alias("midpoint"), scalars.age_midpoint(F.lit("65+")).alias("open_ended"))


@query("WITH w AS (SELECT doc_id, length(text) AS n_chars, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents) SELECT doc_id, n_chars, CAST(len(w) AS INTEGER) AS n_words, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN ('the', 'of', 'and'))) / len(w) ELSE 0 END, 9) AS share FROM w")
def f5_words_and_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size(scalars.word_list(F.col("text"))).alias("n_words"), F.round(scalars.lexicon_share(F.col("text"), ["the", "of", "and"]), 9).alias("share"))


@query(f"SELECT o_orderkey, substr(md5(o_orderstatus || chr(31) || o_orderpriority), 1, 12) AS key, {md5_int_sql('o_orderkey')} AS number FROM orders")
def f7_md5_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return o.select("o_orderkey", scalars.md5_prefix(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("key"), md5_int(F.col("o_orderkey")).alias("number"))


@query("SELECT c_custkey, coalesce(TRY_CAST(nullif(regexp_extract(c_name, '^Customer#(\\d+)', 1), '') AS BIGINT), 0) AS n, 0 AS none FROM customer")
def f8_regex_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    return c.select("c_custkey", scalars.leading_ordinal(F.col("c_name"), "Customer#").alias("n"), scalars.leading_ordinal(F.col("c_name"), "ut").cast("int").alias("none"))


@query("SELECT o_custkey, CAST(floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000) AS BIGINT) AS days, CAST(count(TRY_CAST(o_orderpriority AS TIMESTAMP)) AS BIGINT) AS parsed FROM orders GROUP BY 1")
def f9_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderpriority")
    days = scalars.span_days(F.min("o_orderdate").cast("timestamp"), F.max("o_orderdate").cast("timestamp"))
    return o.groupBy("o_custkey").agg(days.alias("days"), F.count(F.try_to_timestamp("o_orderpriority")).alias("parsed"))


@query("SELECT p_partkey, contains(p_name, 'ring') AS has_ring, regexp_matches(p_name, 'red|blue') AS coloured FROM part")
def f10_substring_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", F.col("p_name").contains("ring").alias("has_ring"), F.col("p_name").rlike("red|blue").alias("coloured"))
