"""Bootstraps by counts, without a row for each draw of each replicate.

A replicate of N rows drawn from N is a multinomial vector of counts.  Rows are dealt into
buckets by hash, and how many of a replicate's draws fall into a bucket is told by conditional
binomials down a tree over the buckets: a task walks from the root to its own bucket, for all
replicates at once, with numbers that depend on seed and node alone.  Within the bucket, batches
of rows share its draws by binomials again, and a batch draws its rows.  A bucket sends one sum
a replicate and value; what is shuffled of the rows does not grow with the replicates.

Within raters (`within`), each rater is its own table.  A rater that ends within one run of rows
is drawn where it lies; the runs of a longer one share its draws by the same tree over its runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from raterline.operators.ordered import packed_runs
from raterline.sources.files import written


def _random(seed: int, *at: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *(int(a) & (1 << 62) - 1 for a in at)])))


def draws_of(leaf: int, before: np.ndarray, draws: np.ndarray, seed: int, *at: int) -> np.ndarray:
    """How many of each replicate's `draws` fall into a leaf; before: running sizes of the leaves, from 0."""
    low, high, n = 0, len(before) - 1, draws
    while high - low > 1:
        middle = (low + high) // 2
        size, left = before[high] - before[low], before[middle] - before[low]
        taken = _random(seed, *at, low, high).binomial(n, left / size if size else 0.0)
        low, high, n = (low, middle, taken) if leaf < middle else (middle, high, n - taken)
    return n


def drawn_sums(values: np.ndarray, draws: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Sums (replicates, columns) of rows drawn with replacement, `draws` of them for each replicate."""
    out = np.zeros((len(draws), values.shape[1]))
    columns = np.ascontiguousarray(values.T)
    # Replicates at a time: 64, or more of few draws each; the numbers drawn do not depend on it.
    step = max(64, (1 << 15) // max(int(draws.max(initial=0)), 1))
    for b in range(0, len(draws), step):
        n = draws[b : b + step]
        at = random.integers(0, len(values), int(n.sum()))
        some = np.flatnonzero(n)
        if len(some):
            first = (np.cumsum(n) - n)[some]
            # Column by column: picking and adding rows of a few values costs several times as much.
            for k, column in enumerate(columns):
                out[b + some, k] = np.add.reduceat(column.take(at), first)
    return out


def resampled_sums(rows: DataFrame, values: list[str], replicates: int, seed: int, *, id_columns: list[str], bucket_rows: int = 1 << 16) -> np.ndarray:
    """(replicates, values + 1): sums over as many rows as there are, drawn with replacement, and last their number.

    id_columns: what a row's bucket is told by; rows that agree there share one.
    """
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = rows.select(F.xxhash64(*id_columns).alias("_h"), *(F.col(v).cast("double").alias(v) for v in values))
    total = base.count()
    buckets = max(partitions, -(-total // bucket_rows))
    dealt = base.withColumn("bucket", F.pmod("_h", F.lit(buckets)).cast("int"))
    sizes = np.zeros(buckets, np.int64)
    for r in dealt.groupBy("bucket").count().collect():
        sizes[r["bucket"]] = r["count"]
    shared = spark.sparkContext.broadcast(np.append(0, np.cumsum(sizes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, total_sums = shared.value, np.zeros((replicates, len(values) + 1))
        now, left, rest, part = -1, np.zeros(0, np.int64), 0, 0
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
            for a, b in zip(cut, np.append(cut[1:], len(bucket))):
                if bucket[a] != now:
                    now, part, rest = int(bucket[a]), 0, int(before[bucket[a] + 1] - before[bucket[a]])
                    left = draws_of(now, before, np.full(replicates, before[-1]), seed)
                random = _random(seed, 1 << 40, now, part)
                here = random.binomial(left, (b - a) / rest) if b - a < rest else left
                total_sums[:, :-1] += drawn_sums(np.nan_to_num(x[a:b]), here, random)
                total_sums[:, -1] += here
                left, rest, part = left - here, rest - (b - a), part + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates), pa.int32()), pa.array(list(total_sums), pa.list_(pa.float64()))], names=["b", "v"])

    # Rows of a bucket come in one order, so that a task that is run again draws the same.
    each = dealt.select("bucket", *values, "_h").repartition(partitions, "bucket").sortWithinPartitions("bucket", "_h", *values).select("bucket", *values).mapInArrow(run, "b int, v array<double>")
    got = each.groupBy("b").agg(*(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(len(values) + 1))).orderBy("b").collect()
    return np.array([[r[f"v{i}"] for i in range(len(values) + 1)] for r in got])


def within(rows: DataFrame, values: list[str], replicates: int, seed: int, f: Callable[[np.ndarray], np.ndarray], *, size: int = 4096) -> tuple[np.ndarray, int]:
    """(mean over raters of f, raters) for each replicate, every rater's rows drawn from its own.

    rows: rater (a whole number) and values; f maps sums (..., values) divided by the rater's rows
    to one number each.
    """
    runs = written(packed_runs(rows.select("rater", *(F.col(v).cast("double").alias(v) for v in values)), "rater", values, values, size=size), "resampled-runs")
    counts = runs.groupBy("rater", "part").agg(F.count("*").alias("n")).groupBy("rater").agg(F.sum("n").alias("runs"))
    alone = counts.where("runs = 1").select("rater")
    # Raters in several runs; their runs get numbers, and where each ends, in small rows.
    place = Window.partitionBy("rater").orderBy("part", "first")
    cut = written(runs.join(counts.where("runs > 1").select("rater"), "rater", "left_semi").select("rater", "part", "first", F.size(values[0]).alias("n")).withColumn("number", F.row_number().over(place) - 1), "cut-runs")
    ends = cut.groupBy("rater").agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "n"))), lambda r: r["n"]).alias("sizes"))
    k = len(values)

    def stacked(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
        lists = [batch.column(at + i) for i in range(k)]
        return np.stack([np.nan_to_num(c.flatten().to_numpy()) for c in lists], axis=1), pc.list_value_length(lists[0]).to_numpy()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(replicates), 0
        for batch in batches:
            x, length = stacked(batch, 1)
            end = np.cumsum(length)
            for rater, a, b in zip(batch.column(0).to_pylist(), (end - length).tolist(), end.tolist()):
                sums = drawn_sums(x[a:b], np.full(replicates, b - a), _random(seed, rater))
                total += f(sums / (b - a))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates), pa.int32()), pa.array(total), pa.array(np.full(replicates, n))], names=["b", "v", "n"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, length = stacked(batch, 3)
            end = np.cumsum(length)
            for i, (rater, number, sizes) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                before = np.append(0, np.cumsum(sizes))
                here = draws_of(number, before, np.full(replicates, before[-1]), seed, rater)
                sums = drawn_sums(x[end[i] - length[i] : end[i]], here, _random(seed, rater, number)) / before[-1]
                yield pa.RecordBatch.from_arrays([pa.array([rater], pa.int64()), pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))], names=["rater", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A rater's runs follow each other; their sums are added as they come."""
        total, n, rater, held = np.zeros(replicates), 0, None, None
        for batch in batches:
            for r, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = v.values.to_numpy()
                if r == rater:
                    held = held + v
                    continue
                if rater is not None:
                    total, n = total + f(held.reshape(replicates, k)), n + 1
                rater, held = r, v
        if rater is not None:
            total, n = total + f(held.reshape(replicates, k)), n + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates), pa.int32()), pa.array(total), pa.array(np.full(replicates, n))], names=["b", "v", "n"])

    out = "b int, v double, n long"
    each = runs.join(alone, "rater", "left_semi").select("rater", *values).mapInArrow(whole, out)
    if cut.head(1):
        partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        asked = runs.join(cut.join(ends, "rater").select("rater", "part", "first", "number", "sizes"), ["rater", "part", "first"]).select("rater", "number", "sizes", *values)
        sums = asked.mapInArrow(parts, "rater long, v array<double>").repartition(partitions, "rater").sortWithinPartitions("rater")
        each = each.unionByName(sums.mapInArrow(added, out))
    got = each.groupBy("b").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("b").collect()
    n = int(got[0]["n"]) if got else 0
    return np.array([r["v"] for r in got]) / max(n, 1), n


def binomial_difference(share_a: float, n_a: int, share_b: float, n_b: int, replicates: int, seed: int) -> np.ndarray:
    """Replicates of b less a for two shares of so many tries."""
    random = _random(seed)
    a = random.binomial(n_a, share_a, replicates) / max(n_a, 1)
    return random.binomial(n_b, share_b, replicates) / max(n_b, 1) - a


def interval(values: np.ndarray, level: float = 0.95) -> tuple[float, float, int]:
    """Percentiles, and how many values are numbers."""
    good = values[np.isfinite(values)]
    if not len(good):
        return float("nan"), float("nan"), 0
    low, high = np.quantile(good, [(1 - level) / 2, (1 + level) / 2])
    return float(low), float(high), len(good)
