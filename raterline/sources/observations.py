"""Canonical observations: rater, obs_id, grp, ts, x (model signal), y (rating).

Sources come as tables of any layout; every view selects only the columns it needs, so that
column pruning reaches the scan.  NaN and infinite values become null here, once, since an
average over a NaN is NaN while nulls are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A Parquet scan of the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def finite(c: Column) -> Column:
    """The number, or null for NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def md5_int(c: Column) -> Column:
    """The first eight hex digits of an MD5 as a number: a portable hash."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    x = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("user_id").alias("rater"), F.col("event_id").alias("obs_id"), F.col("event_type").alias("grp"), "ts", finite(x).alias("x"), finite(F.col("value")).alias("y"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    x = (md5_int(F.col("o_orderkey")) % 97).cast("double")
    return o.select(F.col("o_custkey").alias("rater"), F.col("o_orderkey").alias("obs_id"), F.col("o_orderpriority").alias("grp"), F.col("o_orderdate").alias("ts"), x.alias("x"), finite(F.col("o_totalprice")).alias("y"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large raters.  No column names a row, so obs_id is a hash of all of them; equal rows are alike."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("rater"), F.xxhash64(*li.columns).alias("obs_id"), F.col("l_returnflag").alias("grp"), F.col("l_shipdate").alias("ts"), finite(F.col("l_quantity")).alias("x"), finite(F.col("l_extendedprice")).alias("y"))


def complete(obs: DataFrame) -> DataFrame:
    """Rows with a rater, a signal and a rating."""
    return obs.na.drop(subset=["rater", "x", "y"])


#: The same views as SQL, for checking in another engine.
EVENTS_SQL = "SELECT user_id AS rater, event_id AS obs_id, event_type AS grp, ts, CAST(json_extract(props, '$.k') AS DOUBLE) AS x, value AS y FROM events"
ORDERS_SQL = "SELECT o_custkey AS rater, o_orderkey AS obs_id, o_orderpriority AS grp, o_orderdate AS ts, CAST(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 97 AS DOUBLE) AS x, o_totalprice AS y FROM orders"
