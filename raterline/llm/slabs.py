"""Asking the whole corpus about hashes, and getting bits back.

Texts are dealt into slabs by a hash of their key.  A slab asks: it sends sorted hashes, one
row for each bucket of hash values, and keeps nothing.  A bucket sees the hashes of all slabs
and replies to each with one byte or bit for every hash, in the order in which it was asked.
The replies meet the slab's texts again, which Spark has already dealt out.

So the shuffles carry hashes and bits, packed, in place of a row for every window.  Slabs and
buckets are bounded in size and grow in number with the input.  A value that many texts share
is asked once by each slab, whatever the number of copies in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterline.llm.common import schema

ASKED = schema(bucket="int", slab="int", body="binary")
ANSWERED = schema(slab="int", bucket="int", body="binary")
#: Bytes of text in a slab, about.
SLAB = 3 << 19
#: Bytes of text in a partition, at most about.
PARTITION = 64 << 20


@dataclass
class Dealt:
    """Rows (slab, key, doc_id, text) in partitions by slab, and how many slabs and buckets there are."""

    rows: DataFrame
    slabs: int
    buckets: int
    partitions: int


def deal(docs: DataFrame, *, asked_share: float, bucket_bytes: int = 8 << 20) -> Dealt:
    """docs: as keyed() gives them, null texts as empty.

    asked_share: bytes asked for each byte of text, to size the buckets.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    # As many partitions as the session sets, and more where texts would not fit them.
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION))
    slabs = max(partitions, -(-total // SLAB))
    buckets = max(partitions, -(-int(total * asked_share) // bucket_bytes))
    filled = docs.select(F.pmod("key", F.lit(slabs)).cast("int").alias("slab"), "key", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return Dealt(filled.repartition(partitions, "slab"), slabs, buckets, partitions)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(value, rows) of each run of equal values in the first column."""
    held: list[pa.RecordBatch] = []
    value = None
    for batch in batches:
        first = batch.column(0).to_numpy()
        if not len(first):
            continue
        cuts = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), len(first)]
        for a, b in zip(cuts, cuts[1:]):
            if held and first[a] != value:
                yield value, pa.Table.from_batches(held)
                held = []
            value = int(first[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield value, pa.Table.from_batches(held)


def column(table: pa.Table, name: str) -> pa.Array:
    got = table.column(name).combine_chunks()
    return got if isinstance(got, pa.Array) else pa.concat_arrays(got.chunks)


def ordered(table: pa.Table) -> pa.Table:
    """A slab's rows in an order that does not depend on how they arrived; repeated rows once, with their number."""
    table = table.combine_chunks().sort_by([("key", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    n = table.num_rows
    if not n:
        return table.append_column("copies", pa.array([], pa.int64()))
    # Rows are the same if both doc_id and text are; keys alone could agree by accident.
    same = np.ones(n - 1, bool)
    for name in ("key", "doc_id", "text"):
        c = column(table, name)
        a, b = c.slice(0, n - 1), c.slice(1)
        equal = pc.or_kleene(pc.equal(a, b), pc.and_(pc.is_null(a), pc.is_null(b)))
        same &= np.asarray(pc.fill_null(equal, False).to_numpy(zero_copy_only=False), bool)
    first = np.flatnonzero(np.append(True, ~same))
    return table.take(pa.array(first)).append_column("copies", pa.array(np.diff(np.append(first, n))))


def repeated(table: pa.Table, copies: pa.ChunkedArray) -> pa.Table:
    """Each row as often as it stands in the input."""
    n = copies.to_numpy()
    return table.take(pa.array(np.repeat(np.arange(len(n)), n)))


def ask(dealt: Dealt, question: Callable[[pa.Table], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """question(slab's rows) -> (bucket, body); rows of ASKED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, rows in runs(batches):
            yield asked(slab, question(ordered(rows)))

    return dealt.rows.sortWithinPartitions("slab").mapInArrow(run, ASKED)


def asked(slab: int, bodies: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    got = list(bodies)
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in got], pa.int32()), pa.array([slab] * len(got), pa.int32()), pa.array([x for _, x in got], pa.binary())], names=ASKED.names)


def answer(requests: DataFrame, dealt: Dealt, reply: Callable[[list[bytes], np.ndarray], list[bytes]]) -> DataFrame:
    """reply(bodies, slabs) -> bodies, over all that one bucket was asked; negative buckets come back as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in runs(batches):
            slabs, bodies = column(rows, "slab"), column(rows, "body").to_pylist()
            back = bodies if bucket < 0 else reply(bodies, slabs.to_numpy())
            yield pa.RecordBatch.from_arrays([slabs, pa.array([bucket] * len(bodies), pa.int32()), pa.array(back, pa.binary())], names=ANSWERED.names)

    return requests.repartition(dealt.partitions, "bucket").sortWithinPartitions("bucket", "slab").mapInArrow(run, ANSWERED)


def with_replies(dealt: Dealt, replies: DataFrame, f: Callable[[int, pa.Table, dict[int, bytes]], pa.Table], out: str) -> DataFrame:
    """f(slab, its rows, reply by bucket) for every slab."""

    def run(key: tuple, rows: pa.Table, got: pa.Table) -> pa.Table:
        by = dict(zip(got.column("bucket").to_pylist(), got.column("body").to_pylist()))
        return f(int(key[0].as_py()), ordered(rows), by)

    return dealt.rows.groupBy("slab").cogroup(replies.groupBy("slab")).applyInArrow(run, out)


def by_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indexes) of hashes by value range; h is sorted."""
    bucket = (h >> np.uint64(33)).astype(np.int64) * buckets >> 31
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(h))):
        yield int(bucket[a]), np.arange(a, b)
