"""N-gram Jaccard join by chosen paths.

Texts are sets of hashed word n-grams, sketched by minhash.  Each run of the join splits the
sets recursively: at a node, which is the path of tokens chosen so far, a hash of the node
selects sketch positions, and a set goes on into one child for each selected position, named
by its value there.  Sets that are alike share values, so they share children; with selection
probability 1 / (split * positions) two sets of similarity `split` share one child on
average, and more alike ones more.  The depth grows with the logarithm of the number of sets,
so that unrelated sets rarely share a leaf; runs repeat until the target recall.

The leaves are searched by brute force on a second sketch.  In a leaf with many near copies
the search goes from leaders, each compared with all, and sets very near to a leader lead no
search themselves.  Of each group so found only links to its first set come out, so links are
linear in the rows, however large a group is.  A leaf with over `LEAF` sets is dealt out in
chunks; then the leaders of its chunks, which are few among near copies, meet in pairs of
blocks.

Links by sketch only gather candidates, at a lower similarity.  Candidate components of one
block are compared whole.  In larger ones each candidate link is checked against the n-gram
sets, which gives classes from work linear in the links; then the sets outside a component's
largest class, as a rule few, meet that class and each other in blocks, so no link between
classes is lost.  Numbers of links, where they are asked for, take all pairs of a class: its
sets are packed into blocks, one row each, and the blocks meet in pairs, so that rows grow with
the square of the blocks and not of the sets; classes themselves (`one_of_each`) need no such
step.

Sets that are equal are one set throughout, with a number of copies.

Defined cases: words are runs of anything but ASCII white space; a text with fewer than
`n` words, but not none, has one n-gram of them all; texts without words (null, empty) are
like nothing and in a class of their own; repeated rows are copies of each other; a null
doc_id counts as greater than others when a class is named by its least doc_id; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterline.llm.common import keyed, schema, unused, written
from raterline.llm.components import components
from raterline.llm.slabs import column, runs
from raterline.llm.textvec import BLANKS, byte_values, mix, prefix_hash, range_hash, slab, slices, words

POSITIONS, FILTER = 96, 32
_SALTS = mix(np.arange(1, POSITIONS + FILTER + 1, dtype=np.uint64)) | np.uint64(1)
SKETCH = schema(key="long", doc_id="long", set_a="long", set_b="long", n_grams="int", sketch="binary")


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct gram hashes of each text, sorted, end to end; number per text)."""
    s = slab(texts)
    first, last, of = words(s, BLANKS)
    h = range_hash(prefix_hash(byte_values(s.buf)), first, last)
    prefix = prefix_hash(h, np.uint64(0xA0761D6478BD642F))
    rows = len(texts)
    count = np.bincount(of, minlength=rows)
    begin = np.cumsum(count) - count
    pos = np.arange(len(h)) - begin[of]
    width = np.minimum(n, count)
    at = np.flatnonzero(pos + width[of] <= count[of])
    gram = range_hash(prefix, at, at + width[of[at]], np.uint64(0xA0761D6478BD642F))
    order = np.lexsort((gram, of[at]))
    g, o = gram[order], of[at][order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (o[1:] != o[:-1])]) if len(g) else np.zeros(0, bool)
    return g[new], np.bincount(o[new], minlength=rows)


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """Per row of keyed() documents: the set's identity, size and minhash values (16 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b)):
            gram, count = gram_sets(part.column(2), n)
            filled = np.flatnonzero(count)
            begin = (np.cumsum(count) - count)[filled]
            rows = part.num_rows
            ids = np.zeros((2, rows), np.uint64)
            sig = np.zeros((rows, len(_SALTS)), "<u2")
            if len(filled):
                ids[0, filled] = np.add.reduceat(mix(gram + _SALTS[0]), begin)
                ids[1, filled] = np.add.reduceat(mix(gram ^ _SALTS[1]), begin)
                for i, salt in enumerate(_SALTS):
                    # Multiplying by an odd number, then xor-shifting, reorders all 64-bit values.
                    x = gram * salt
                    x ^= x >> np.uint64(29)
                    x *= salt
                    sig[filled, i] = (mix(np.minimum.reduceat(x, begin)) >> np.uint64(48)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(ids[0].view(np.int64)), pa.array(ids[1].view(np.int64)), pa.array(count.astype(np.int32)), pa.array([r.tobytes() for r in sig], pa.binary())],
                names=SKETCH.names,
            )

    return docs.select("key", "doc_id", "text").mapInArrow(run, SKETCH)


def survival(similarity: float, split: float, depth: int) -> float:
    """Probability that two sets of a similarity share a leaf of one run."""
    dead = 0.0
    for _ in range(depth):
        dead = math.exp(-similarity / split * (1 - dead))
    return 1 - dead


def leaves(sets: DataFrame, *, runs_: int, depth: int, split: float) -> DataFrame:
    """(path, key, sketch for filtering) of every leaf that a set reaches."""
    limit = np.uint64(int((1 << 63) * 2 / (split * POSITIONS)))
    pick, name = mix(np.arange(POSITIONS, dtype=np.uint64) + np.uint64(1 << 20)), mix(np.arange(POSITIONS, dtype=np.uint64) + np.uint64(1 << 21))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(batch.num_rows, -1)
                tokens, filters = sig[:, :POSITIONS].astype(np.uint64), [r.tobytes() for r in sig[:, POSITIONS:].astype(np.uint8)]
                for r in range(runs_):
                    node = np.full(batch.num_rows, mix(np.array([r + 1], np.uint64))[0])
                    of = np.arange(batch.num_rows)
                    for _ in range(depth):
                        if not len(node):
                            break
                        parts = [np.nonzero(mix(node[i : i + 4096, None] ^ pick) < limit) for i in range(0, len(node), 4096)]
                        at = np.concatenate([p[0] + 4096 * k for k, p in enumerate(parts)])
                        position = np.concatenate([p[1] for p in parts])
                        node, of = mix(node[at] ^ mix(tokens[of[at], position] + name[position])), of[at]
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column(0).take(pa.array(of)), pa.array(filters, pa.binary()).take(pa.array(of))], names=["path", "key", "filter"])

    return sets.select("key", "sketch").mapInArrow(run, schema(path="long", key="long", filter="binary"))


#: Sets of one leaf that a task searches; fuller leaves are dealt out.
LEAF = 1 << 14
#: Equal filter values, of FILTER, from which two sets are linked as candidates, and from which one is covered by the other.
LINKED, COVERED = 14, 28


def _search(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within one leaf: (for each set, the first set that it is linked to through others; does it lead?).

    Leaders are compared with all sets; sets covered by a leader do not lead.
    """
    group = np.arange(len(sig))
    rest, leads = np.ones(len(sig), bool), np.zeros(len(sig), bool)
    for at in range(len(sig)):
        if rest[at]:
            leads[at] = True
            same = (sig == sig[at]).sum(axis=1)
            met = np.unique(group[same >= LINKED])
            if len(met) > 1:
                group[np.isin(group, met)] = met[0]
            rest[same >= COVERED] = False
    return group, leads


FOUND = schema(a="long", b="long", crowd="long", filter="binary")


def _searched(tasks: DataFrame, partitions: int) -> DataFrame:
    """tasks: task, key, crowd, filter.  Distinct links (a, b) within each task and, where crowd is given, its leaders (b null)."""

    def search(task: np.ndarray, key: np.ndarray, crowd: pa.Array, sig: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
        size = np.diff(np.append(first, len(task)))
        crowded = np.asarray(crowd.is_valid().to_numpy(zero_copy_only=False), bool)[first]
        two = first[(size == 2) & ~crowded]
        two = two[(sig[two] == sig[two + 1]).sum(axis=1) >= LINKED]
        a, b, leaders = [key[two]], [key[two + 1]], [np.zeros(0, np.int64)]
        more = (size > 2) | crowded
        for i, n, c in zip(first[more].tolist(), size[more].tolist(), crowded[more].tolist()):
            group, leads = _search(sig[i : i + n])
            a.append(key[i : i + n][group != np.arange(n)])
            b.append(key[i + group[group != np.arange(n)]])
            if c:
                leaders.append(i + np.flatnonzero(leads))
        pairs = np.sort(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=1)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        lead = np.concatenate(leaders)
        none = pa.nulls(len(lead), pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([pairs[:, 0], key[lead]])), pa.concat_arrays([pa.array(pairs[:, 1]), none]), pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), crowd.take(pa.array(lead))]),
                pa.array([None] * len(pairs) + [x.tobytes() for x in sig[lead]], pa.binary()),
            ], names=FOUND.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            task = column(now, "task").to_numpy()
            # The last task may go on in the next batch.
            whole = int(np.searchsorted(task, task[-1]))
            if whole:
                yield search(*_columns(now.slice(0, whole)))
            held = now.slice(whole)
        if held is not None and held.num_rows:
            yield search(*_columns(held))

    return tasks.select("task", "key", "crowd", "filter").repartition(partitions, "task").sortWithinPartitions("task", "key").mapInArrow(run, FOUND)


def _columns(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    return column(rows, "task").to_numpy(), column(rows, "key").to_numpy(), column(rows, "crowd"), np.frombuffer(b"".join(column(rows, "filter").to_pylist()), np.uint8).reshape(-1, FILTER)


def candidate_links(sketches: DataFrame, partitions: int, *, runs_: int, depth: int, split: float, most: int = LEAF, every: int = 16) -> DataFrame:
    """Distinct (a, b): sets that look alike in some leaf, each linked to the first of its group there.

    Which leaves hold over `most` sets is estimated from one set in `every`; that only steers
    how the sets are dealt to tasks, never which are compared.
    """
    options = {"runs_": runs_, "depth": depth, "split": split}
    some = leaves(sketches.where(F.pmod("key", F.lit(every)) == 0), **options).groupBy("path").agg((F.count("*") * every).alias("n"))
    crowds = written(some.where(F.col("n") > most).select(F.col("path").alias("crowd"), F.ceil(F.col("n") / most).alias("chunks")), "crowds")
    rows = leaves(sketches, **options)
    rows = rows.join(crowds, rows["path"] == crowds["crowd"], "left")
    task = F.when(F.col("crowd").isNotNull(), F.xxhash64("path", F.pmod(F.xxhash64("key"), F.col("chunks")))).otherwise(F.col("path"))
    found = written(_searched(rows.withColumn("task", task), partitions), "leaf-links")
    leaders = found.where("b is null").select(F.col("crowd").alias("path"), F.col("a").alias("key"), "filter")
    blocks = leaders.groupBy("path").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    i = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(i, j), F.greatest(i, j)))
    again = leaders.join(blocks, "path").select("path", "key", "filter", F.explode(pairs).alias("pair")).select(F.xxhash64("path", "pair").alias("task"), "key", F.lit(None).cast("long").alias("crowd"), "filter")
    both = found.where("b is not null").select("a", "b").unionByName(_searched(again, partitions).where("b is not null").select("a", "b"))
    return both.distinct()


def shared_counts(grams: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sizes of all pairwise intersections of sets laid end to end."""
    m = len(size)
    of = np.repeat(np.arange(m), size)
    _, token, count = np.unique(grams, return_inverse=True, return_counts=True)
    kept = count[token] > 1
    number = np.cumsum(count > 1) - 1
    token, of = number[token[kept]], of[kept]
    order = np.argsort(token, kind="stable")
    token, of = token[order], of[order]
    out = np.zeros((m, m), np.float32)
    width = max(256, min(8192, (1 << 23) // max(m, 1)))
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [low, low + width])
        x = np.zeros((m, width), np.float32)
        x[of[a:b], token[a:b] - low] = 1
        out += x @ x.T
    return out


def _alike(size: np.ndarray, grams: np.ndarray, side: np.ndarray, threshold: float) -> np.ndarray:
    """Which sets are alike; with sides given, only those of different ones."""
    shared = shared_counts(grams, size)
    n = size.astype(np.float64)
    alike = shared / np.maximum(n[:, None] + n[None, :] - shared, 1) >= threshold
    np.fill_diagonal(alike, False)
    if side.any():
        alike &= side[:, None] != side[None, :]
    return alike


def _compare(key: np.ndarray, copies: np.ndarray, size: np.ndarray, grams: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each set counted by copies, the least key it is linked to through others here)."""
    alike = _alike(size, grams, side, threshold)
    links = alike @ copies.astype(np.float64)
    label = key.copy()
    while True:
        low = np.where(alike, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        low = np.minimum(label, low)
        # The label of the set that bears a label: pointers halve long chains.
        where = np.argsort(key)
        low = np.minimum(low, low[where[np.searchsorted(key[where], low)]])
        if np.array_equal(low, label):
            return links.astype(np.int64), label
        label = low


BLOCK_BYTES, BLOCK_SETS = 4 << 20, 512


def blocks_of(bytes_: F.Column, sets: F.Column, block_bytes: int, block_sets: int) -> F.Column:
    return F.ceil(F.greatest(bytes_ / block_bytes, sets / block_sets)).cast("int")


def set_rows(members: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """members with their grams, one row each; texts: key, text, in which rows may repeat.

    set_a tells texts apart that share a key by accident.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b)):
            gram, count = gram_sets(part.column(1), n)
            cuts = np.cumsum(count)
            ids = [np.add.reduce(mix(p + _SALTS[0])) if len(p) else np.uint64(0) for p in np.split(gram, cuts[:-1])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array([p.tobytes() for p in np.split(gram, cuts[:-1])], pa.binary())], names=["key", "set_a", "grams"])

    needed = texts.join(members.select("key"), "key", "left_semi").mapInArrow(grams, schema(key="long", set_a="long", grams="binary"))
    # Documents that repeat both id and text share a key.  The join below deals rows out by the same columns.
    needed = needed.dropDuplicates(["key", "set_a"])
    return members.join(needed, ["key", "set_a"])


TASK = schema(key="long", links="long", label="long")


def _compared(tasks: DataFrame, partitions: int, threshold: float) -> DataFrame:
    """tasks: task, key, copies, side, grams.  Per task and set: its links there, and the least set it is linked to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches):
            rows = rows.sort_by("key")
            key = rows.column("key").to_numpy()
            once = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            rows, key = rows.take(pa.array(once)), key[once]
            raw = column(rows, "grams").to_pylist()
            size = np.array([len(g) // 8 for g in raw], np.int64)
            links, label = _compare(key, rows.column("copies").to_numpy(), size, np.frombuffer(b"".join(raw), np.uint64), rows.column("side").to_numpy(), threshold) if len(key) > 1 else (np.zeros(1, np.int64), key)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(links), pa.array(label)], names=TASK.names)

    return tasks.select("task", "key", "copies", "side", "grams").repartition(partitions, "task").sortWithinPartitions("task").mapInArrow(run, TASK)


def true_links(links: DataFrame, sets: DataFrame, partitions: int, threshold: float) -> DataFrame:
    """Those of the candidate links (a, b) that hold; sets: key, grams.

    A set with many links is one row for each of its tasks, in front of the sets it is compared
    with, which then pass one by one.  Only such sets, at most eight a partition, are broadcast,
    with their numbers of tasks.
    """
    degree = links.groupBy("a").agg(F.count("*").alias("n"))
    share = max(BLOCK_SETS, links.count() // (8 * partitions))
    chunks = F.ceil(F.col("n") / share).cast("int")
    hot = F.broadcast(degree.where(F.col("n") > share).select("a", chunks.alias("chunks")))
    heads = degree.select(F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk")).select(F.xxhash64("key", "chunk").alias("task"), F.lit(0).alias("place"), "key")
    tails = links.join(hot, "a", "left").select(F.xxhash64("a", F.coalesce(F.pmod(F.xxhash64("b"), F.col("chunks")), F.lit(0)).cast("int")).alias("task"), F.lit(1).alias("place"), F.col("b").alias("key"))
    rows = heads.unionByName(tails).join(sets.select("key", "grams"), "key").select("task", "place", "key", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, head, own = None, 0, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for t, place, key, raw in zip(*(c.to_pylist() for c in batch.columns)):
                grams = np.frombuffer(raw, np.uint64)
                if place == 0:
                    task, head, own = t, key, grams
                elif t == task:
                    shared = np.isin(grams, own, assume_unique=True).sum()
                    if shared / (len(grams) + len(own) - shared) >= threshold:
                        a.append(head)
                        b.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition(partitions, "task").sortWithinPartitions("task", "place").mapInArrow(run, schema(a="long", b="long"))


def _least_and_greatest(own: F.Column, n: F.Column) -> F.Column:
    """(i, j, side) of block `own` with each of n blocks: side 0 within a block, else 1 or 2."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(own == j, 0).when(own < j, 1).otherwise(2).alias("side")))


def stragglers_met(members: DataFrame, sets: DataFrame, partitions: int, threshold: float, block_bytes: int, block_sets: int) -> DataFrame:
    """Edges (a, b) that join classes of one component.

    members: component, class, key, copies, n_grams.  The sets outside a component's largest
    class meet it and each other in blocks; within that class nothing is left to find.
    """
    sized = members.groupBy("component", "class").agg(F.count("*").alias("n"), (F.sum(F.col("n_grams").cast("long")) * 8).alias("bytes"))
    top = F.max(F.struct("n", "bytes", (-F.col("class")).alias("c"))).alias("top")
    best = sized.groupBy("component").agg(top, F.sum("n").alias("all_n"), F.sum("bytes").alias("all_bytes"), F.count("*").alias("classes")).where("classes > 1")
    per = best.select(
        "component", (-F.col("top.c")).alias("largest"), blocks_of(F.col("top.bytes"), F.col("top.n"), block_bytes, block_sets).alias("g"),
        blocks_of(F.col("all_bytes") - F.col("top.bytes"), F.col("all_n") - F.col("top.n"), block_bytes, block_sets).alias("s"),
    )
    # A row a component, so small as a rule; Spark knows its size and broadcasts it only then.
    placed = members.join(written(per, "largest-classes"), "component").withColumn("own", F.col("class") == F.col("largest"))
    block = F.pmod(F.xxhash64("key"), F.when(F.col("own"), F.col("g")).otherwise(F.col("s"))).cast("int")
    across = lambda n, i, j, side: F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.struct((-1 - i(x)).alias("i"), j(x).alias("j"), F.lit(side).alias("side")))
    largest = across(F.col("s"), lambda x: x, lambda x: block, 2)
    others = F.concat(_least_and_greatest(block, F.col("s")), across(F.col("g"), lambda x: block, lambda x: x, 1))
    dealt = placed.join(sets.select("key", "grams"), "key").withColumn("pair", F.explode(F.when(F.col("own"), largest).otherwise(others)))
    found = _compared(dealt.select(F.xxhash64("component", "pair.i", "pair.j").alias("task"), "key", "copies", F.col("pair.side").alias("side"), "grams"), partitions, threshold)
    return found.where("key != label").select(F.col("key").alias("a"), F.col("label").alias("b"))


PACK = schema(label="long", block="int", blocks="int", keys="binary", copies="binary", sizes="binary", grams="binary")
COUNTED = schema(label="long", block="int", keys="binary", links="binary")


def links_within(members: DataFrame, sets: DataFrame, partitions: int, threshold: float, block_bytes: int, block_sets: int) -> DataFrame:
    """(key, links): how many rows of its class every set is alike; members: class, key, copies, n_grams."""
    sized = members.groupBy("class").agg(blocks_of(F.sum(F.col("n_grams").cast("long")) * 8, F.count("*"), block_bytes, block_sets).alias("blocks"))
    placed = members.join(written(sized, "class-blocks"), "class").join(sets.select("key", "grams"), "key")
    rows = placed.select(F.col("class").alias("label"), F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), "blocks", "key", "copies", "grams").withColumn("task", F.xxhash64("label", "block"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, r in runs(batches):
            raw = column(r, "grams").to_pylist()
            made = [column(r, "key").to_numpy().astype("<i8").tobytes(), column(r, "copies").to_numpy().astype("<i8").tobytes(), np.array([len(g) // 8 for g in raw], "<i8").tobytes(), b"".join(raw)]
            yield pa.RecordBatch.from_arrays([*(pa.array([r.column(c)[0].as_py()], k) for c, k in (("label", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()))), *(pa.array([x], pa.binary()) for x in made)], names=PACK.names)

    packed = rows.select("task", "label", "block", "blocks", "key", "copies", "grams").repartition(partitions, "task").sortWithinPartitions("task", "key").mapInArrow(pack, PACK)
    met = packed.withColumn("pair", F.explode(_least_and_greatest(F.col("block"), F.col("blocks")))).select(F.xxhash64("label", "pair.i", "pair.j").alias("task"), (F.col("pair.i") == F.col("pair.j")).alias("within"), *PACK.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, r in runs(batches):
            key, copies, size, gram = (np.concatenate([np.frombuffer(x, k) for x in column(r, c).to_pylist()]) for c, k in (("keys", "<i8"), ("copies", "<i8"), ("sizes", "<i8"), ("grams", "<u8")))
            held = [len(x) // 8 for x in column(r, "keys").to_pylist()]
            # Between two blocks, of which one may be empty, links within either do not count again.
            side = np.zeros(len(key), np.int64) if column(r, "within")[0].as_py() else np.repeat(np.arange(len(held)) + 1, held)
            links = _alike(size, gram, side, threshold) @ copies.astype(np.float64)
            parts = np.split(links.astype("<i8"), np.cumsum(held)[:-1])
            yield pa.RecordBatch.from_arrays([column(r, "label"), column(r, "block"), column(r, "keys"), pa.array([p.tobytes() for p in parts], pa.binary())], names=COUNTED.names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, r in runs(batches):
            links = np.sum([np.frombuffer(x, "<i8") for x in column(r, "links").to_pylist()], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r.column("keys")[0].as_py(), "<i8")), pa.array(links)], names=["key", "links"])

    counted = met.repartition(partitions, "task").sortWithinPartitions("task", "block").mapInArrow(count, COUNTED)
    return counted.select(F.xxhash64("label", "block").alias("task"), "keys", "links").repartition(partitions, "task").sortWithinPartitions("task").mapInArrow(total, schema(key="long", links="long"))


def verified(
    members: DataFrame, candidates: DataFrame, texts: DataFrame, *, n: int, threshold: float, partitions: int, count: bool = True, block_bytes: int = BLOCK_BYTES, block_sets: int = BLOCK_SETS
) -> tuple[DataFrame, DataFrame]:
    """Exact links within candidate components.

    members: component, key, set_a, copies, n_grams; candidates: the links (a, b) that made the
    components; texts: key, text.  Returns (key, links), complete only if `count`, and the final
    classes (key, class), named by their least key.  What fits one block of `block_bytes` of grams and
    `block_sets` sets is compared at once.
    """
    sized = members.groupBy("component").agg(blocks_of(F.sum(F.col("n_grams").cast("long")) * 8, F.count("*"), block_bytes, block_sets).alias("blocks"))
    placed = written(members.join(sized, "component"), "members")
    few, many = placed.where("blocks = 1"), placed.where("blocks > 1")
    found = written(_compared(set_rows(few, texts, n).select(F.col("component").alias("task"), "key", "copies", F.lit(0).alias("side"), "grams"), partitions, threshold), "links")
    degree, classes = found.select("key", "links"), found.select("key", F.col("label").alias("class"))
    if not many.head(1):
        return degree, classes
    sets = written(set_rows(many, texts, n).select("component", "key", "copies", "n_grams", "grams"), "sets")
    plain = sets.select("component", "key", "copies", "n_grams")
    # Both ends are in one component; a leads a leaf and may have many links, b has few.
    own = candidates.join(plain.select(F.col("key").alias("b")), "b", "left_semi")
    near = written(true_links(own, sets, partitions, threshold).unionByName(plain.select(F.col("key").alias("a"), F.col("key").alias("b"))), "near")
    classed = written(plain.join(components(near).select(F.col("node").alias("key"), F.col("component").alias("class")), "key"), "classed")
    met = written(stragglers_met(classed, sets, partitions, threshold, block_bytes, block_sets), "met")
    if met.head(1):
        # Classes that turn out to be linked are joined as wholes.
        side = lambda c: classed.select(F.col("key").alias(c), F.col("class").alias(f"class_{c}"))
        between = met.join(side("a"), "a").join(side("b"), "b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()
        joined = components(written(between, "between")).select(F.col("node").alias("class"), "component")
        renamed = classed.withColumnRenamed("component", "candidates").join(joined, "class", "left").withColumn("class", F.coalesce("component", "class"))
        classed = written(renamed.drop("component").withColumnRenamed("candidates", "component"), "classed")
    if count:
        degree = degree.unionByName(links_within(classed, sets, partitions, threshold, block_bytes, block_sets))
    return degree, classes.unionByName(classed.select("key", "class"))


def near_duplicates(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, split: float = 0.7, count: bool = True) -> DataFrame:
    """Per document: doc_id, key, class_id (the least doc_id of its class), class_key and n_links.

    n_links: how many other documents have a similarity of `threshold` or more to it; complete
    only if `count`, which compares all pairs of a class.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = keyed(docs)
    sketched = written(sketches(own, n), "sketches")
    identity = ["set_a", "set_b", "n_grams"]
    sets = sketched.where("n_grams > 0").groupBy(*identity).agg(F.min("key").alias("key"), F.count("*").alias("copies"), F.min("doc_id").alias("least_id"))
    sets = written(sets, "sets")
    total = sets.count()
    depth = max(2, math.ceil(math.log(max(total, 2)) / math.log(split / 0.01)))
    times = max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, split, depth))))
    sketch_of_sets = written(sketched.select("key", "sketch").join(sets.select("key"), "key", "left_semi").dropDuplicates(["key"]), "set-sketches")
    links = written(candidate_links(sketch_of_sets, partitions, runs_=times, depth=depth, split=split), "candidates")
    members = components(links).withColumnRenamed("node", "key").join(sets, "key").select("component", "key", "set_a", "copies", "n_grams")
    degree, classes = verified(members, links, own.select("key", "text"), n=n, threshold=threshold, partitions=partitions, count=count)
    known = sets.join(classes, "key", "left").join(degree, "key", "left").withColumn("class", F.coalesce("class", "key"))
    named = known.groupBy("class").agg(F.min("least_id").alias("class_id"))
    answered = known.join(named, "class").select(*identity, "class_id", F.col("class").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return sketched.drop("sketch").join(answered, identity, "left").select(
        "doc_id", "key", F.when(F.col("n_grams") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("class_key", "key").alias("class_key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_grams"
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents with all their columns, one of each class: that with the least doc_id."""
    found = written(near_duplicates(docs, count=False, **options), "classes")
    kept = found.where("n_grams > 0").groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")).select(F.col("best.key").alias("_kept"))
    kept = kept.unionByName(found.where("n_grams = 0").select(F.col("key").alias("_kept"))).distinct()
    again = found.where("n_grams > 0").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("_again"))
    mark = unused(docs, "key")
    own = docs.withColumn(mark, F.xxhash64("doc_id", "text"))
    own = own.join(kept, own[mark] == kept["_kept"], "left_semi")
    if again.limit(1).count():
        # Rows that repeat both doc_id and text are told apart by nothing: one of each stays.
        single = own.join(again, own[mark] == again["_again"], "left_anti")
        own = single.unionByName(own.join(again, own[mark] == again["_again"], "left_semi").dropDuplicates([mark]))
    return own.drop(mark)
