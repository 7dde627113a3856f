"""Exact nearest vectors within clusters, by blocks.

Each cluster's vectors and queries are packed in runs of bounded length (see ordered), and every
pair of a run of queries and a run of vectors is one row, whatever share of all vectors a cluster
holds.  A task finds a pair's near vectors from one matrix product, and measures those anew, sum by
sum, that the product's rounding leaves open; so distances and ties are those of the plain sums.

Vectors of another length, with missing or infinite numbers take the plain sums at once: terms that
are missing are passed over, and a distance without terms is missing and comes last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterline.operators.ordered import packed_runs
from raterline.sources.files import written

#: What a product's rounding may be, of the squared lengths; some hundred times its bound at 64 numbers.
ROUNDING = 1e-12


def block_nearest(own: np.ndarray, q: np.ndarray, other: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, nearest, distance) of queries among vectors of another id; equal distances by ascending id."""
    qq, vv = (q * q).sum(axis=1), (v * v).sum(axis=1)
    gap = qq[:, None] + vv - 2 * (q @ v.T)
    gap[own[:, None] == other] = np.inf
    limit = gap.min(axis=1) + ROUNDING * (1 + q.shape[1] / 64) * (qq + vv.max())
    a, b = np.nonzero((gap <= limit[:, None]) & np.isfinite(gap))
    total = np.zeros(len(a))
    for k in range(q.shape[1]):
        off = q[a, k] - v[b, k]
        total += off * off
    distance = np.sqrt(total)
    order = np.lexsort((other[b], distance, a))
    first = order[np.flatnonzero(np.diff(a[order], prepend=-1))]
    return own[a[first]], other[b[first]], distance[first]


def _plain(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    pairs = queries.select("id", "cluster", F.col("v").alias("q")).join(vectors.select(F.col("id").alias("nearest"), "cluster", "v"), "cluster").where("id != nearest")
    gap = F.filter(F.zip_with("q", "v", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), lambda t: t.isNotNull())
    total = F.when(F.size(gap) > 0, F.aggregate(gap, F.lit(0.0), lambda a, t: a + t))
    return pairs.select("id", "nearest", F.sqrt(total).alias("distance"))


def nearest(vectors: DataFrame, asks: str, *, size: int = 1024, asked: int = 256) -> DataFrame:
    """id, nearest, distance: the nearest vector of another id in its cluster, for each vector that `asks`.

    vectors: id (a whole number), cluster, v (an array of numbers); asks: a condition on them;
    size, asked: the longest runs of vectors and of queries.
    """
    known = vectors.where("id is not null and cluster is not null")
    width = known.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    width = width["n"] if width and width["n"] else 0
    plain = (F.size("v") == width) & F.forall("v", lambda x: F.abs(x.cast("double")) < 1e100)
    stored = written(known.withColumns({"asks": F.coalesce(F.expr(asks), F.lit(False)), "odd": ~F.coalesce(plain & F.lit(width > 0), F.lit(False))}), "vectors")
    packed = lambda rows, most, name: written(packed_runs(rows.select("cluster", "id", "v"), "cluster", ["id"], ["id", "v"], size=most), name)
    runs, ask = packed(stored.where("not odd"), size, "vector-runs"), packed(stored.where("asks and not odd"), asked, "query-runs")
    ask = ask.select("cluster", F.col("part").alias("q_part"), F.col("first").alias("q_first"), F.col("id").alias("q_id"), F.col("v").alias("q"))
    met = ask.select("cluster", "q_part", "q_first").join(runs.select("cluster", "part", "first"), "cluster")
    met = met.join(ask, ["cluster", "q_part", "q_first"]).join(runs, ["cluster", "part", "first"]).select("q_id", "q", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, other = (batch.column(c)[i].values.to_numpy() for c in (0, 2))
                q, v = (batch.column(c)[i].values.flatten().to_numpy().astype(float).reshape(-1, width) for c in (1, 3))
                yield pa.RecordBatch.from_arrays([*map(pa.array, block_nearest(own, q, other, v))], names=["id", "nearest", "distance"])

    odd, asking = stored.where("odd"), stored.where("asks")
    each = met.mapInArrow(run, f"id {stored.schema['id'].dataType.simpleString()}, nearest {stored.schema['id'].dataType.simpleString()}, distance double")
    each = each.unionByName(_plain(asking.where("odd"), stored)).unionByName(_plain(asking.where("not odd"), odd))
    best = each.groupBy("id").agg(F.min(F.struct(F.col("distance").isNull().alias("missing"), "distance", "nearest")).alias("b"))
    return best.select("id", "b.nearest", "b.distance")
