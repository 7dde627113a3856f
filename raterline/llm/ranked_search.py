"""Ranked lexical search over a clustered index of reordered documents.

1. One pass splits every text and keeps, per document, its length and how often it holds each
   term of the queries.  Numbers of documents, lengths and document frequencies are taken over
   the whole table.
2. Documents are reordered by recursive graph bisection: a part is halved, and documents are
   swapped between the halves while that lowers the cost of the gaps between a term's documents,
   then each half is halved again.  The bisections are fitted on `sample` documents drawn by a
   hash of doc_id, over term buckets (both documented bounds); every document then goes down the
   tree to the side where it costs less.  The leaves, in order, are the clusters.
3. A cluster is stored as shards of about `SHARD` documents, so that no group of copies makes one
   shard large.  A shard has its postings and, for each term, the most that a document of it
   scores by that term; their sum over a query's terms bounds every score in the shard.
4. A query visits shards by falling bound, a few at first and then eight times as many a round.
   It stops for certain when no bound that is left reaches its k-th score: a shard whose bound
   equals that score is still visited, since a tie may have a smaller doc_id.  Shards visited by
   several queries in a round are read once.

All numbers are integers but for the logarithm in a term's weight, so no order depends on how a
sum is arranged.  Queries are taken in blocks of about `BLOCK` (query, term) pairs, which is what
tasks hold of them; the postings of a block are those of its terms.

Defined cases: null texts have no terms, as have texts of separators only; items that share an
item_id (null as well) are one query with the terms of all; queries without terms, or without
documents that score, have no rows; rows that repeat are documents of their own with ranks of
their own, a null doc_id comes last among ties; an empty table gives an empty result; other
columns are ignored.  Terms count as equal when their 64-bit hashes are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from raterline.llm.common import schema, written
from raterline.llm.slabs import column, runs
from raterline.llm.textvec import byte_values, class_table, prefix_hash, range_hash, slab, slices, words

#: Documents of a shard, about; (query, term) pairs of a block, about.
SHARD, BLOCK = 2048, 1 << 19
#: Buckets of terms that bisections see.
BUCKETS = 2048
#: Shards that a query visits in its first round, and how many times more in each later one.
FIRST, GROWTH = 2, 8

_SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_INSIDE = class_table(_SEPARATORS)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

FORWARD = schema(doc_id="long", n="long", terms="array<int>", tfs="array<int>")
INDEX = schema(shard="long", doc_ids="array<long>", m="binary", terms="binary", starts="binary", docs="binary", tfs="binary", bounds="binary")
VISIT = schema(q="int", shard="long", bound="long")
FOUND = schema(q="int", doc_id="long", score="long")


def text_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every term, number of its text)."""
    s = slab(texts)
    s.buf = _LOWER[s.buf]
    # Capital letters are inside as well: they have become small ones.
    first, last, of = words(s, _INSIDE)
    return range_hash(prefix_hash(byte_values(s.buf)), first, last), of


@dataclass
class Block:
    """Queries as arrays: the sorted hashes of their terms, and (query, term) pairs by query."""

    terms: np.ndarray
    query: np.ndarray
    term: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.flatnonzero(np.diff(self.query, prepend=-1))


def query_terms(queries: DataFrame, id_column: str) -> DataFrame:
    """Distinct (item, term) of all queries; item keeps its type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b)):
            h, of = text_terms(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(h.view(np.int64))], names=["item", "term"])

    kind = queries.schema[id_column].dataType.simpleString()
    return queries.select(F.col(f"`{id_column}`").alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"item {kind}, term long").distinct()


def forward(docs: DataFrame, block: Block) -> DataFrame:
    """Rows of FORWARD: each document's number of terms, and its terms that the block asks for (by number), with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(block.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in (p for b in batches for p in slices(b)):
            h, of = text_terms(part.column(1))
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            pair, tf = np.unique((of[hit].astype(np.int64) << 32) | at[hit], return_counts=True)
            cut = pa.array(np.searchsorted(pair >> 32, np.arange(part.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (pair & 0xFFFFFFFF, tf)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.bincount(of, minlength=part.num_rows).astype(np.int64)), *lists], names=FORWARD.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FORWARD)


def _buckets(terms: pa.ListArray) -> np.ndarray:
    """Rows of 0 and 1: which buckets of terms each document has."""
    out = np.zeros((len(terms), BUCKETS), np.float32)
    size = np.diff(terms.offsets.to_numpy())
    out[np.repeat(np.arange(len(terms)), size), terms.flatten().to_numpy() % BUCKETS] = 1
    return out


def _gap_cost(degree: np.ndarray, n: int) -> np.ndarray:
    """Bits for the gaps between `degree` of n documents, about."""
    return degree * np.log2(max(n, 1) / (degree + 1.0))


def bisect(x: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(which rows of x go left, by bucket: what a document with it saves by going left)."""
    n = len(x)
    left = np.arange(n) < n // 2
    sizes = n // 2, n - n // 2
    for _ in range(rounds):
        a, b = x[left].sum(axis=0), x[~left].sum(axis=0)
        now = _gap_cost(a, sizes[0]) + _gap_cost(b, sizes[1])
        # Where no document of a side has a bucket, none can take it away.
        to_right = now - _gap_cost(np.maximum(a - 1, 0), sizes[0]) - _gap_cost(b + 1, sizes[1])
        to_left = now - _gap_cost(a + 1, sizes[0]) - _gap_cost(np.maximum(b - 1, 0), sizes[1])
        mine, theirs = np.flatnonzero(left), np.flatnonzero(~left)
        gain = x[mine] @ to_right, x[theirs] @ to_left
        order = np.argsort(-gain[0], kind="stable"), np.argsort(-gain[1], kind="stable")
        pairs = min(len(mine), len(theirs))
        better = gain[0][order[0][:pairs]] + gain[1][order[1][:pairs]] > 1e-3
        if not better.any():
            break
        left[mine[order[0][:pairs][better]]] = False
        left[theirs[order[1][:pairs][better]]] = True
    a, b = x[left].sum(axis=0), x[~left].sum(axis=0)
    weights = _gap_cost(b + 1, sizes[1]) - _gap_cost(b, sizes[1]) - _gap_cost(a + 1, sizes[0]) + _gap_cost(a, sizes[0])
    return left, weights.astype(np.float32)


def bisections(x: np.ndarray, least: int = 64, deepest: int = 6) -> np.ndarray:
    """One row of weights for each part of a complete tree, breadth first: parts below `least` documents are not cut."""
    depth = max(0, min(deepest, int(math.log2(max(len(x), 1) / least)) if len(x) >= least else 0))
    parts, out = [np.arange(len(x))], []
    for _ in range(depth):
        after = []
        for rows in parts:
            left, weights = bisect(x[rows])
            out.append(weights)
            after += [rows[left], rows[~left]]
        parts = after
    return np.array(out, np.float32).reshape(-1, BUCKETS)


def clusters(x: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """The leaf that each row of x comes to, in the order of the bisections."""
    saves = x @ tree.T
    leaf = np.zeros(len(x), np.int64)
    for level in range(int(math.log2(len(tree) + 1))):
        leaf = 2 * leaf + (saves[np.arange(len(x)), (1 << level) - 1 + leaf] <= 0)
    return leaf


def clustered(rows: DataFrame, tree: np.ndarray) -> DataFrame:
    """rows of FORWARD with their leaf."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clusters(_buckets(batch.column(2)), shared.value))], names=[*FORWARD.names, "row", "leaf"])

    return rows.select(*FORWARD.names, "row").mapInArrow(run, f"{FORWARD}, row long, leaf long")


def fit_tree(rows: DataFrame, n: int, sample: int) -> np.ndarray:
    """Bisections of about `sample` documents, which come to the driver as bits of term buckets."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in np.packbits(_buckets(batch.column(1)).astype(bool), axis=1)], pa.binary())], names=["doc_id", "bits"])

    drawn = F.pmod(F.xxhash64("doc_id", F.lit("bisection")), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30))
    got = sorted((r["doc_id"], bytes(r["bits"])) for r in rows.where(drawn & F.col("doc_id").isNotNull() & (F.size("terms") > 0)).select("doc_id", "terms").mapInArrow(bits, "doc_id long, bits binary").collect())
    x = np.unpackbits(np.frombuffer(b"".join(b for _, b in got), np.uint8)).reshape(len(got), BUCKETS).astype(np.float32)
    return bisections(x)


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents of n terms; whole numbers throughout."""
    if int(n.max(initial=0)) * 50 * documents < 1 << 62:
        return 50 + 50 * n.astype(np.int64) * documents // max(total, 1)
    return np.array([50 + 50 * int(x) * documents // total for x in n], np.int64)


def parts_of_score(tf: np.ndarray, m: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return weight * (1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 20 * m))


def index(rows: DataFrame, sizes: DataFrame, weights: np.ndarray, documents: int, total: int, partitions: int) -> DataFrame:
    """Rows of INDEX, one a shard; rows: as clustered() gives them; sizes: leaf, shards; weights: by term number."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(weights)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, group in runs(batches):
            term_lists = column(group, "terms")
            size = np.diff(term_lists.offsets.to_numpy())
            term, tf = term_lists.flatten().to_numpy(), column(group, "tfs").flatten().to_numpy()
            doc = np.repeat(np.arange(len(size)), size)
            order = np.argsort(term, kind="stable")
            term, tf, doc = term[order], tf[order], doc[order]
            start = np.flatnonzero(np.diff(term, prepend=-1))
            m = lengths(group.column("n").to_numpy(), documents, total)
            bounds = np.maximum.reduceat(parts_of_score(tf, m[doc], shared.value[term]), start) if len(term) else np.zeros(0, np.int64)
            made = [m.astype("<i8"), term[start].astype("<i4"), np.append(start, len(term)).astype("<i4"), doc.astype("<u4"), tf.astype("<u4"), bounds.astype("<i8")]
            ids = pa.ListArray.from_arrays(pa.array([0, group.num_rows], pa.int32()), column(group, "doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), ids, *(pa.array([x.tobytes()], pa.binary()) for x in made)], names=INDEX.names)

    # Leaves are a bounded number, so their sizes are a small table.
    held = rows.where(F.size("terms") > 0).join(F.broadcast(sizes), "leaf")
    shard = F.shiftleft("leaf", 40) + F.pmod(F.xxhash64("row"), F.col("shards"))
    dealt = held.select(shard.alias("shard"), *FORWARD.names)
    return dealt.repartition(partitions, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last()).mapInArrow(pack, INDEX)


def bounds(shards: DataFrame, block: Block) -> DataFrame:
    """Rows of VISIT: every query with each shard that holds a term of it, and the bound of its scores there."""
    shared = shards.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        starts = b.starts
        for batch in batches:
            for shard, raw_terms, raw_bounds in zip(*(c.to_pylist() for c in batch.columns)):
                term, bound = np.frombuffer(raw_terms, "<i4"), np.frombuffer(raw_bounds, "<i8")
                at = np.minimum(np.searchsorted(term, b.term), len(term) - 1)
                total = np.add.reduceat(np.where(term[at] == b.term, bound[at], 0), starts)
                some = np.flatnonzero(total > 0)
                yield pa.RecordBatch.from_arrays([pa.array(b.query[starts[some]].astype(np.int32)), pa.array(np.full(len(some), shard)), pa.array(total[some])], names=VISIT.names)

    return shards.select("shard", "terms", "bounds").mapInArrow(run, VISIT)


def scores(visits: DataFrame, shards: DataFrame, block: Block, weights: np.ndarray, k: int) -> DataFrame:
    """Rows of FOUND: the best k documents of each visited shard that reach the query's k-th score so far.

    visits: shard, asked (array of q and theta).
    """
    shared = shards.sparkSession.sparkContext.broadcast((block, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, weight = shared.value
        starts = np.append(b.starts, len(b.query))
        number = {int(b.query[s]): i for i, s in enumerate(starts[:-1].tolist())}
        for batch in batches:
            for i in range(batch.num_rows):
                asked = batch.column(0)[i].as_py()
                ids = batch.column(1)[i].values
                m, term, cut, doc, tf = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in ((2, "<i8"), (3, "<i4"), (4, "<i4"), (5, "<u4"), (6, "<u4")))
                part = parts_of_score(tf, m[doc], np.repeat(weight[term], np.diff(cut)))
                q, place, score = [], [], []
                for a in asked:
                    j = number[a["q"]]
                    own = b.term[starts[j] : starts[j + 1]]
                    at = np.minimum(np.searchsorted(term, own), len(term) - 1)
                    total = np.zeros(len(m), np.int64)
                    for t in at[term[at] == own].tolist():
                        # A term's documents in a shard are distinct.
                        total[doc[cut[t] : cut[t + 1]]] += part[cut[t] : cut[t + 1]]
                    good = np.flatnonzero(total >= max(a["theta"] or 1, 1))
                    # Rows of a shard are in the order of doc_id, which a stable sort keeps among ties.
                    good = good[np.argsort(-total[good], kind="stable")[:k]]
                    q.append(np.full(len(good), a["q"], np.int32))
                    place.append(good)
                    score.append(total[good])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q)), ids.take(pa.array(np.concatenate(place))), pa.array(np.concatenate(score))], names=FOUND.names)

    return visits.join(shards, "shard").select("asked", "doc_ids", "m", "terms", "starts", "docs", "tfs").mapInArrow(run, FOUND)


def best(rows: DataFrame, k: int) -> DataFrame:
    """rows of FOUND with their rank, the k best of each query."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, block: Block, k: int, sample: int) -> DataFrame | None:
    """q, rank, doc_id, score of the block's queries; None if no document has a term."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows get their numbers as they are stored, so that these stay.
    rows = written(forward(docs, block).withColumn("row", F.monotonically_increasing_id()), "forward")
    documents, total = rows.where("n > 0").agg(F.count("*"), F.sum("n")).head()
    if not documents:
        return None
    df = np.zeros(len(block.terms), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    tree = fit_tree(rows, documents, sample)
    leaves = clustered(rows, tree)
    sizes = written(leaves.where(F.size("terms") > 0).groupBy("leaf").agg(F.ceil(F.count("*") / SHARD).alias("shards")), "leaves")
    shards = written(index(leaves, sizes, weights, documents, total, partitions), "shards")
    bounded = written(bounds(shards, block), "bounds")
    found, state, most = None, None, FIRST
    while True:
        rest = bounded.withColumn("theta", F.lit(None).cast("long"))
        if state is not None:
            after = F.col("last").isNull() | (F.col("bound") < F.col("last.bound")) | ((F.col("bound") == F.col("last.bound")) & (F.col("shard") > F.col("last.shard")))
            # One row a query, of which a block has a bounded number.
            rest = bounded.join(F.broadcast(state), "q", "left").where(after & (F.col("bound") >= F.coalesce("theta", F.lit(1))))
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "shard"))
        visits = written(rest.withColumn("place", place).where(F.col("place") <= most).select("q", "shard", "bound", "theta"), "visits")
        if not visits.head(1):
            break
        asked = visits.groupBy("shard").agg(F.collect_list(F.struct("q", "theta")).alias("asked"))
        more = scores(asked, shards, block, weights, k)
        found = written(best(more if found is None else found.select(*FOUND.names).unionByName(more), k), "found")
        theta = found.groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).alias("theta"))
        last = visits.groupBy("q").agg(F.max("bound").alias("_"), F.min_by(F.struct("bound", "shard"), F.struct("bound", -F.col("shard"))).alias("last")).drop("_")
        # Queries that had no visit in this round had none left.
        state = written(last.join(theta, "q", "left"), "thresholds")
        bounded = bounded.join(F.broadcast(state.select("q")), "q", "left_semi")
        most *= GROWTH
    return found


def ranked_search(docs: DataFrame, queries: DataFrame, *, k: int = 50, id_column: str = "item_id", sample: int = 8192) -> DataFrame:
    """The k best documents of each query: item_id (as in queries), rank, doc_id, score.

    docs: doc_id and text; queries: an id and text.  sample: documents that the order is fitted on.
    """
    spark: SparkSession = docs.sparkSession
    kind = queries.schema[id_column].dataType
    out = StructType([StructField(id_column, kind), StructField("rank", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())])
    pairs = written(query_terms(queries, id_column), "query-terms")
    blocks = -(-pairs.count() // BLOCK)
    results = []
    for i in range(blocks):
        got = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).collect()
        if not got:
            continue
        items = sorted({r["item"] for r in got}, key=lambda x: (x is None, str(x)))
        number = {item: q for q, item in enumerate(items)}
        terms, term = np.unique(np.array([r["term"] for r in got], np.int64).view(np.uint64), return_inverse=True)
        query = np.array([number[r["item"]] for r in got], np.int64)
        order = np.lexsort((term, query))
        found = search_block(docs, Block(terms, query[order], term[order].astype(np.int32)), k, sample)
        if found is not None:
            names = spark.createDataFrame([(q, item) for item, q in number.items()], StructType([StructField("q", IntegerType()), StructField(id_column, kind)]))
            results.append(found.join(F.broadcast(names), "q").select(id_column, F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], out)
