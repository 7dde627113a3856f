"""M4: calibrators of two channels: the rater's own bootstrapped lines, and the line of raters like it.

The individual channel is the mean of `m` lines through resampled rows.  Rows get Poisson weights
from a hash of row and replicate, so resampling adds up: weighted sums per rater and fold are one
aggregate, and no rater's rows meet in a task.  The prototype channel is the line of the rater's
cluster less the rater itself (its sums are taken off), shrunk to the population by the number of
raters in the cluster.  Both are judged on folds that taught neither of them about the rater.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from raterline.operators.regression import SUMS, added, centred, line, squared_error, sums
from raterline.sources.files import written
from raterline.sources.observations import md5_int

#: Upper ends of a Poisson variable's first values, of mean 1.
_STEPS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]


def poisson_weight(replicate: int, key: str) -> Column:
    """How often a replicate draws a row: Poisson with mean 1, from a hash of replicate and key."""
    return _weight(_hashed(F.lit(replicate), key))


def _hashed(replicate: Column, key: str) -> Column:
    return md5_int(F.concat_ws(":", F.concat(F.lit("poisson"), replicate.cast("string")), F.col(key).cast("string")))


def _weight(hashed: Column) -> Column:
    u = hashed / float(1 << 32)
    out = F.lit(float(len(_STEPS)))
    for k, end in reversed(list(enumerate(_STEPS))):
        out = F.when(u < end, float(k)).otherwise(out)
    return out


def resampled_lines(folds: DataFrame, m: int, population: DataFrame) -> DataFrame:
    """rater, fold, own_intercept, own_slope: the mean of m lines through resampled rows of the other folds.

    folds: observations with `fold`, as centred() gives them.  population: one row, pop_intercept
    and pop_slope, which a replicate with under three rows or a flat signal takes.
    """
    drawn = folds.select("rater", "fold", "obs_id", "mx", "my", "cx", "cy", F.explode(F.array(*map(F.lit, range(m)))).alias("b"))
    # The hash is a column of its own: within one expression each step of a weight would take it again.
    hashed = drawn.withColumn("u", _hashed(F.col("b"), "obs_id"))
    w, x, y = F.col("w"), F.col("cx"), F.col("cy")
    rows = hashed.select("rater", "fold", "b", "mx", "my", "cx", "cy", _weight(F.col("u")).alias("w"))
    parts = rows.groupBy("rater", "fold", "b").agg(F.max("mx").alias("mx"), F.max("my").alias("my"), F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.sum(w * y * y).alias("syy"))
    each = written(parts, "resampled-sums")
    w = Window.partitionBy("rater", "b")
    train = each.withColumns({f"t_{s}": (F.sum(s).over(w)) - F.col(s) for s in SUMS})
    fitted = line(train, "c", prefix="t_").crossJoin(F.broadcast(population))
    return fitted.groupBy("rater", "fold").agg(F.avg(F.coalesce("intercept", "pop_intercept")).alias("own_intercept"), F.avg(F.coalesce("slope", "pop_slope")).alias("own_slope"))


def two_channels(folds: DataFrame, clusters: DataFrame, *, m: int = 10, prior: float = 10.0) -> DataFrame:
    """Per rater: held-out RMSE of the population line, either channel, and their mean.

    folds: observations with `fold`; clusters: rater, cluster (raters without one have no
    prototype).  prior: raters that the population counts for when a cluster's line is shrunk.
    """
    # Folds cost a rank over all rows and are read three times, so they are stored.
    c = centred(written(folds.select("rater", "obs_id", "fold", "x", "y"), "folds"))
    parts = written(sums(c, "rater", "fold"), "fold-sums")
    population = line(added(parts)).select(F.col("intercept").alias("pop_intercept"), F.col("slope").alias("pop_slope"))
    own = added(parts, "rater").join(clusters.select("rater", "cluster"), "rater")
    whole = added(own, "cluster").join(own.groupBy("cluster").agg((F.count("*") - 1).alias("peers")), "cluster")
    rest = own.select("rater", "cluster", "mx", "my", *(F.col(s).alias(f"o_{s}") for s in SUMS)).join(F.broadcast(whole.drop("mx", "my")), "cluster")
    rest = rest.withColumns({s: F.col(s) - F.col(f"o_{s}") for s in SUMS})
    weight = F.col("peers") / (F.col("peers") + prior)
    mixed = lambda k: weight * F.coalesce(k, f"pop_{k}") + (1 - weight) * F.col(f"pop_{k}")
    prototype = line(rest, "c").crossJoin(F.broadcast(population)).select("rater", mixed("intercept").alias("proto_intercept"), mixed("slope").alias("proto_slope"))
    pop = F.broadcast(population.select(F.col("pop_intercept").alias("p_intercept"), F.col("pop_slope").alias("p_slope")))
    e = parts.join(resampled_lines(c, m, population), ["rater", "fold"]).join(prototype, "rater", "left").crossJoin(pop)
    at = lambda k, v: F.coalesce(F.col(f"{k}_{v}"), F.col(f"p_{v}"))
    arms = {"population": [F.col("p_intercept"), F.col("p_slope")], "individual": [at("own", "intercept"), at("own", "slope")], "prototype": [at("proto", "intercept"), at("proto", "slope")]}
    arms["mixed"] = [(a + b) / 2 for a, b in zip(arms["individual"], arms["prototype"])]
    errors = e.select("rater", "n", *(squared_error(a, b).alias(f"sse_{k}") for k, (a, b) in arms.items()))
    return errors.groupBy("rater").agg(*(F.sqrt(F.sum(f"sse_{k}") / F.sum("n")).alias(f"rmse_{k}") for k in arms))
