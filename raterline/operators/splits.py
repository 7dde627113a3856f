"""Held-out splits within raters, as columns.

Places come from MD5 ranks, which any engine and any partitioning reproduces.  A rank needs a
rater's rows in one task; where a single rater may hold a large part of all rows use
`hash_folds`, whose folds are only about equal in size but need no rank and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from raterline.sources.observations import md5_int


def hash_key(seed: int | str, *parts: str | Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)).cast("binary"))


def placed(obs: DataFrame, seed: int, *, key: str = "rater") -> DataFrame:
    """pos (from 0) of each row in its rater's shuffled order, and cnt, the rater's rows."""
    shuffled = Window.partitionBy(key).orderBy(hash_key(seed, "obs_id"), "obs_id")
    return obs.withColumns({"pos": F.row_number().over(shuffled) - 1, "cnt": F.count("*").over(Window.partitionBy(key))})


def k_folds(obs: DataFrame, k: int, seed: int) -> DataFrame:
    """V1: equal folds, the last takes the remainder; raters with under k rows are left out."""
    return placed(obs, seed).where(F.col("cnt") >= k).withColumn("fold", F.least(F.floor(F.col("pos") / F.floor(F.col("cnt") / k)), F.lit(k - 1)).cast("int"))


def round_robin(obs: DataFrame, k: int, seed: int) -> DataFrame:
    """V2: place modulo k."""
    return placed(obs, seed).withColumn("fold", (F.col("pos") % k).cast("int"))


def balanced(obs: DataFrame, k: int, seed: int) -> DataFrame:
    """V3: the first cnt % k folds hold one row more."""
    small, extra = F.floor(F.col("cnt") / k), F.col("cnt") % k
    edge = extra * (small + 1)
    fold = F.when(F.col("pos") < edge, F.floor(F.col("pos") / (small + 1))).otherwise(extra + F.floor((F.col("pos") - edge) / F.when(small > 0, small)))
    return placed(obs, seed).withColumn("fold", fold.cast("int"))


def repeated_holdouts(obs: DataFrame, repeats: int, k: int, seed: int) -> DataFrame:
    """V4: `repeats` independent holdouts of max(1, cnt // k) rows; not a partition."""
    grid = obs.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    w = Window.partitionBy("rater", "repeat").orderBy(hash_key(seed, "repeat", "obs_id"), "obs_id")
    each = Window.partitionBy("rater", "repeat")
    return grid.withColumns({"pos": F.row_number().over(w) - 1, "cnt": F.count("*").over(each)}).withColumn("held_out", F.col("pos") < F.greatest(F.lit(1), F.floor(F.col("cnt") / k)))


def hash_folds(obs: DataFrame, k: int, seed: int) -> DataFrame:
    """Folds by hash alone: no rank, so a rater of any size is spread over tasks."""
    return obs.withColumn("fold", (md5_int(F.concat_ws(":", F.lit(str(seed)), F.col("obs_id").cast("string"))) % k).cast("int"))


def temporal(obs: DataFrame, share: float = 0.2) -> DataFrame:
    """V5: the last max(1, round(cnt * share)) rows by time are held out, if two remain to train on."""
    w = Window.partitionBy("rater").orderBy("ts", "obs_id")
    held = F.greatest(F.lit(1), F.bround(F.col("cnt") * share)).cast("int")
    timed = obs.withColumns({"pos": F.row_number().over(w) - 1, "cnt": F.count("*").over(Window.partitionBy("rater"))}).withColumn("held", held)
    return timed.where(F.col("cnt") - F.col("held") >= 2).withColumn("held_out", F.col("pos") >= F.col("cnt") - F.col("held"))


def disjoint_raters(obs: DataFrame, share: float, seed: int) -> DataFrame:
    """V6: raters, one row each, with held_out for the first `share` of them in hashed order.

    The order is a global rank of the distinct raters; it is taken in two steps, ranks within
    hash ranges and the ranges' offsets, so that no task sees all raters.
    """
    raters = obs.select("rater").distinct().withColumn("h", hash_key(seed, "rater")).withColumn("bin", F.substring("h", 1, 2))
    sizes = raters.groupBy("bin").agg(F.count("*").alias("size"))
    before = sizes.withColumns({"offset": F.sum("size").over(Window.orderBy("bin")) - F.col("size"), "total": F.sum("size").over(Window.partitionBy(F.lit(0)))})
    rank = F.row_number().over(Window.partitionBy("bin").orderBy("h", "rater"))
    return raters.withColumn("r", rank).join(F.broadcast(before), "bin").select("rater", (F.col("offset") + F.col("r") <= F.floor(F.col("total") * share)).alias("held_out"))


def half_of_groups(obs: DataFrame, seed: int) -> DataFrame:
    """V7: half of each rater's distinct groups (rounded down) is held out, rows with them."""
    groups = obs.select("rater", "grp").distinct()
    w = Window.partitionBy("rater").orderBy(hash_key(seed, "rater", "grp"), "grp")
    chosen = groups.withColumns({"r": F.row_number().over(w), "m": F.count("*").over(Window.partitionBy("rater"))}).select("rater", "grp", (F.col("r") <= F.floor(F.col("m") / 2)).alias("held_out"))
    return obs.join(chosen, ["rater", "grp"])


def first_k(obs: DataFrame, budgets: list[int]) -> DataFrame:
    """For each budget k, rows with `train` for the first k by time; raters with k + 2 rows or more."""
    w = Window.partitionBy("rater").orderBy("ts", "obs_id")
    timed = obs.withColumns({"pos": F.row_number().over(w), "cnt": F.count("*").over(Window.partitionBy("rater"))})
    return timed.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).where(F.col("cnt") >= F.col("budget") + 2).withColumn("train", F.col("pos") <= F.col("budget"))
