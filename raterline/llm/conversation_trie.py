"""The prefix trie of a table of conversations.

Every turn becomes a digest of its role and text, so no text is shuffled.  A conversation is
stored as packed chunks of turns with the digest of every prefix: a sum, modulo 2^64 and twice,
of turn digests times powers of a base, which chunks can add up apart from each other.

A node of the trie belongs to the least conversation that starts with it.  If a conversation
owns a node it owns all its longer prefixes, so what it owns is a chain, from some first depth
to its end.  The least conversation of every shared prefix digest is stored (`shared`); then all
conversations search their first owned depth at once, halving their ranges with one batched join
against those minima a round.  A chain hangs below the node before its first, which the
conversation of the last minimum met owns; conversations that own nothing end at such a node.

Counts rise from the chains' ends: totals of chains (members, leaves, shared bytes) are summed
over the chains below by doubling pointers, so that rounds grow with the logarithm of the
nesting of chains; within a chain each node takes the suffix sum of what hangs below it.

What is saved below a node is told from members alone: a member with first owned depth f shares
its turns up to f - 1 with others, so of the node's subtree it saves the bytes from the node to
there.

No step gathers a conversation or the members of a node in a task: turns are placed by range,
chunks have at most `CHUNK` turns, prefixes with many members are looked up by broadcast (there
are at most eight a partition), and the ids that end at a node are joined in pieces before they
are hashed in a stream.  Sequences count as equal when their 128-bit digests are.

Defined cases: rows without conv_id belong to no conversation; null role or text is empty;
turns that tie are ordered by the MD5 of their role and text, so repeated rows are repeated
turns; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from raterline.llm.common import schema, written

#: Turns of a packed row; more than any head that is taken from another conversation.
CHUNK = 4096
#: Every `GROUP`-th conversation lends its first turns, fewer than `HEAD`, to the next.
GROUP, HEAD = 5, 9
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_ARRAYS = {"g1": "array<long>", "g2": "array<long>", "bytes": "array<long>"}
TURNS = schema(part="int", conv_id="long", first="long", **_ARRAYS)
PREFIXES = schema(conv_id="long", k="long", before="long", h1="array<long>", h2="array<long>", cum="array<long>", bytes="array<long>")
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_digest() -> Column:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def ordered_turns(conversations: DataFrame, partitions: int) -> DataFrame:
    """Turns in order, packed: rows of TURNS, `first` counted within the partition."""
    size = CHUNK
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(turn_digest()).alias("digest"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("bytes")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, start = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            conv = rows.column("conv_id").to_numpy()
            run = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            place = np.arange(len(conv)) - np.repeat(run, np.diff(np.append(run, len(conv))))
            place[: run[1] if len(run) > 1 else len(conv)] += start
            cut = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (place[1:] // size != place[:-1] // size)]))
            if cut[-1]:
                yield packed(part, rows.slice(0, int(cut[-1])), cut[:-1], place)
            held, start = rows.slice(int(cut[-1])), int(place[cut[-1]])
        if held is not None:
            yield packed(part, held, np.zeros(1, np.int64), np.array([start]))

    def packed(part: int, rows: pa.Table, cut: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        digest = np.frombuffer(b"".join(rows.column("digest").to_pylist()), ">i8").astype(np.int64).reshape(-1, 2)
        at = pa.array(np.append(cut, rows.num_rows), pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (digest[:, 0], digest[:, 1], rows.column("bytes").to_numpy())]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(cut), pa.int32()), pa.array(rows.column("conv_id").to_numpy()[cut]), pa.array(place[cut]), *lists], names=TURNS.names)

    by = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    return turns.repartitionByRange(partitions, *by).sortWithinPartitions(*by).select("conv_id", "digest", "bytes").mapInArrow(pack, TURNS)


def chunks(conversations: DataFrame, partitions: int) -> DataFrame:
    """conv_id, k, first (place of the first turn, from 0), g1, g2, bytes: turns k * CHUNK and on of every conversation."""
    turns = written(ordered_turns(conversations, partitions), "turns")
    plain = turns.select("conv_id", F.floor(F.col("first") / CHUNK).alias("k"), "first", *_ARRAYS)
    # Conversations that the ranges cut: fewer than partitions.
    cut = written(turns.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("conv_id"), "cut")
    if not cut.head(1):
        return plain
    own = turns.join(F.broadcast(cut), "conv_id", "left_semi")
    each = own.groupBy("conv_id", "part").agg(F.sum(F.size("g1")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(each.select("conv_id", "part", before.alias("offset")), "offsets")
    rows = own.join(F.broadcast(offsets), ["conv_id", "part"]).select("conv_id", (F.col("offset") + F.col("first")).alias("start"), F.posexplode(F.arrays_zip(*_ARRAYS)).alias("i", "t"))
    rows = rows.select("conv_id", (F.col("start") + F.col("i")).alias("place"), "t.*").withColumn("k", F.floor(F.col("place") / CHUNK))
    again = rows.groupBy("conv_id", "k").agg(F.sort_array(F.collect_list(F.struct("place", *_ARRAYS))).alias("t"))
    again = again.select("conv_id", "k", F.col("t")[0]["place"].alias("first"), *(F.col(f"t.{a}").alias(a) for a in _ARRAYS))
    return plain.join(F.broadcast(cut), "conv_id", "left_anti").unionByName(again)


def rebuilt(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, len, shift, chunks; their chunks: conv_id, k, before, g1, g2, bytes).

    The first h turns of a conversation give way to those of the first of its group.  before: how
    many turns stand before the chunk's first; the turn at depth d is in chunk (d - 1 + shift) / CHUNK.
    """
    conv = F.col("conv_id")
    sizes = stored.groupBy("conv_id").agg(F.sum(F.size("g1")).alias("own"), F.count("*").alias("chunks"))
    sizes = sizes.select("conv_id", "own", "chunks", (conv - conv % GROUP).alias("lender"), (F.crc32(conv.cast("string").cast("binary")) % HEAD).cast("int").alias("h"))
    lent = stored.where((F.col("k") == 0) & (conv % GROUP == 0)).select(conv.alias("lender"), *(F.slice(a, 1, HEAD - 1).alias(f"head_{a}") for a in _ARRAYS))
    heads = [F.coalesce(F.slice(f"head_{a}", F.lit(1), F.col("h")), F.array().cast("array<bigint>")).alias(f"head_{a}") for a in _ARRAYS]
    taken = F.size("head_g1")
    info = sizes.join(lent, "lender", "left").select("conv_id", "own", "chunks", "h", *heads)
    info = info.select(*info.columns, (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"), (F.col("h") - taken).cast("long").alias("shift"))
    info = written(info, "conversations")
    # One row a chunk, so that a long conversation does not meet in one task.
    per = info.select("conv_id", "h", "shift", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("k"), *(f"head_{a}" for a in _ARRAYS))
    start = F.col("k") == 0
    parts = [F.when(start, F.concat(f"head_{a}", F.slice(a, F.col("h") + 1, F.lit(CHUNK)))).otherwise(F.col(a)).alias(a) for a in _ARRAYS]
    rows = stored.join(per, ["conv_id", "k"]).select("conv_id", "k", F.when(start, 0).otherwise(F.col("first") - F.col("shift")).cast("long").alias("before"), *parts)
    return info.select("conv_id", "len", "shift", "chunks"), rows


def _power(base: np.uint64, exponent: np.ndarray) -> np.ndarray:
    out, square, left = np.ones(len(exponent), np.uint64), base, exponent.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square, out)
        with np.errstate(over="ignore"):
            square = square * square
        left = left >> np.uint64(1)
    return out


def _sums(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Running sums within stretches of the given sizes, modulo 2^64."""
    total = np.cumsum(x, dtype=x.dtype)
    start = np.cumsum(size) - size
    return total - np.repeat(np.where(start > 0, total[np.maximum(start, 1) - 1], x.dtype.type(0)) if len(total) else np.zeros(len(size), x.dtype), size)


def prefixes(rows: DataFrame, info: DataFrame) -> DataFrame:
    """Rows of PREFIXES: for each turn of a chunk the digests of the prefix that it ends, the bytes of text up to it, and its own."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(i) for i in (3, 4, 5)]
            size = pc.list_value_length(lists[0]).to_numpy().astype(np.int64)
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            before = batch.column(2).to_numpy()
            flat = [x.flatten().to_numpy() for x in lists]
            out = []
            for g, base in zip(flat, _BASES):
                power = _power(base, np.arange(1, int(size.max(initial=0)) + 1))
                out.append(_sums(g.view(np.uint64) * power[within] * np.repeat(_power(base, before), size), size).view(np.int64))
            out += [_sums(flat[2], size), flat[2]]
            at = pa.array(np.append(0, np.cumsum(size)), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.ListArray.from_arrays(at, pa.array(x)) for x in out)], names=PREFIXES.names)

    own = written(rows.select("conv_id", "k", "before", *_ARRAYS).mapInArrow(digest, PREFIXES), "prefixes")
    long = info.where("chunks > 1").select("conv_id")
    if not long.head(1):
        return own

    def carried(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        sums = [np.cumsum(np.append(group.column(c).to_numpy().view(np.uint64), np.uint64(0)), dtype=np.uint64) for c in ("c1", "c2", "cb")]
        # What all chunks before have summed to.
        return pa.Table.from_arrays([group.column("conv_id"), group.column("k"), *(pa.array(np.append(np.uint64(0), s[: group.num_rows - 1]).view(np.int64)) for s in sums)], names=["conv_id", "k", "c1", "c2", "cb"])

    last = own.join(long, "conv_id", "left_semi").select("conv_id", "k", *(F.coalesce(F.element_at(F.when(F.size(a) > 0, F.col(a)), -1), F.lit(0)).alias(c) for a, c in (("h1", "c1"), ("h2", "c2"), ("cum", "cb"))))
    carry = written(last.groupBy("conv_id").applyInArrow(carried, "conv_id long, k long, c1 long, c2 long, cb long"), "carried").where("k > 0")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(i) for i in (3, 4, 5, 6)]
            size = pc.list_value_length(lists[0]).to_numpy()
            more = [np.repeat(pc.fill_null(batch.column(i), 0).to_numpy(), size) for i in (7, 8, 9)]
            out = [(x.flatten().to_numpy().view(np.uint64) + m.view(np.uint64)).view(np.int64) for x, m in zip(lists, more)]
            at = pa.array(np.append(0, np.cumsum(size)), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.ListArray.from_arrays(at, pa.array(x)) for x in out), lists[3]], names=PREFIXES.names)

    return written(own.join(carry, ["conv_id", "k"], "left").mapInArrow(add, PREFIXES), "prefixes")


def looked_up(rows: DataFrame, found: DataFrame, on: list[str], most: int) -> DataFrame:
    """rows left-joined with `found`, whose rows are unique by `on`; its column n says how many rows ask for them at most.

    Those with over `most`, which are few, are broadcast, so that their askers stay where they are.
    """
    other = [c for c in found.columns if c not in on and c != "n"]
    hot = F.broadcast(found.where(F.col("n") > most).select(*on, *other, F.lit(True).alias("hot")))
    split = rows.join(hot, on, "left")
    cold = split.where("hot is null").select(*rows.columns).join(found.where(F.col("n") <= most).select(*on, *other), on, "left")
    return split.where("hot").select(*rows.columns, *other).unionByName(cold.select(*rows.columns, *other))


def first_owned(info: DataFrame, own: DataFrame, least: int, partitions: int) -> DataFrame:
    """conv_id, f (first owned depth), len, owner and bytes `a` of the node before it; `least`: the least conversation, which owns the root."""
    turns = own.select("conv_id", F.col("before").alias("b"), F.posexplode(F.arrays_zip("h1", "h2")).alias("i", "t")).select("conv_id", (F.col("b") + F.col("i") + 1).alias("mid"), "t.h1", "t.h2")
    shared = written(turns.groupBy("mid", "h1", "h2").agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).where("n > 1"), "shared")
    most = max(16, (shared.agg(F.sum("n")).head()[0] or 0) // (8 * partitions))
    start = info.select("conv_id", "len", "shift", F.lit(1).cast("long").alias("lo"), (F.col("len") + 1).alias("hi"), F.lit(least).cast("long").alias("owner"), F.lit(0).cast("long").alias("a"))
    # The least conversation owns every prefix of its own, the root among them.
    state = start.where(F.col("conv_id") != least)
    ended = [start.where(F.col("conv_id") == least).withColumns({"lo": F.lit(0).cast("long"), "owner": F.lit(None).cast("long")}), state.where("lo = hi")]
    state = state.where("lo < hi")
    while state.head(1):
        asked = state.withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2)).withColumn("k", F.floor((F.col("mid") - 1 + F.col("shift")) / CHUNK))
        at = (F.col("mid") - 1 - F.col("before")).cast("int")
        asked = asked.join(own, ["conv_id", "k"]).select(*state.columns, "mid", F.get("h1", at).alias("h1"), F.get("h2", at).alias("h2"), F.get("cum", at).alias("cum"))
        met = looked_up(asked, shared, ["mid", "h1", "h2"], most)
        other = F.col("least") < F.col("conv_id")
        turn = lambda yes, no: F.when(other, yes).otherwise(no)
        now = met.select("conv_id", "len", "shift", turn(F.col("mid") + 1, F.col("lo")).alias("lo"), turn(F.col("hi"), F.col("mid")).alias("hi"), turn(F.col("least"), F.col("owner")).alias("owner"), turn(F.col("cum"), F.col("a")).alias("a"))
        now = written(now, "search")
        ended.append(now.where("lo = hi"))
        state = now.where("lo < hi")
    return written(reduce(DataFrame.unionByName, ended).select("conv_id", F.col("lo").alias("f"), "len", "shift", "owner", "a"), "first-owned")


def chain_totals(chains: DataFrame, ends: DataFrame, partitions: int) -> DataFrame:
    """conv_id, members, leaves and a (shared bytes) of each chain with all chains below it, and leaf (is the chain's last node one?)."""
    own = ends.groupBy(F.col("owner").alias("conv_id")).agg(F.count("*").alias("ends"), F.sum("a").alias("ends_a"))
    below = chains.where("owner is not null").groupBy(F.col("owner").alias("conv_id")).agg(F.max(F.col("f") - 1).alias("deepest"))
    leaf = F.coalesce(F.col("deepest") < F.col("len"), F.lit(True)).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0))
    now = chains.join(own, "conv_id", "left").join(below, "conv_id", "left").select("conv_id", F.col("owner").alias("up"), leaf.alias("leaf"), (1 + zero("ends")).alias("members"), leaf.alias("leaves"), (F.col("a") + zero("ends_a")).alias("a"))
    now = written(now, "chains")
    while now.where("up is not null").head(1):
        sums = now.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("members").alias("m"), F.sum("leaves").alias("l"), F.sum("a").alias("b"), F.count("*").alias("n"))
        joined = written(now.join(sums, "conv_id", "left"), "sums")
        most = max(16, (joined.agg(F.sum("n")).head()[0] or 0) // (8 * partitions))
        more = joined.select("conv_id", "leaf", "up", (F.col("members") + zero("m")).alias("members"), (F.col("leaves") + zero("l")).alias("leaves"), (F.col("a") + zero("b")).alias("a"))
        # A pointer moves on to where the conversation that it leads to points.
        onward = joined.where("n is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("next"), "n")
        moved = looked_up(more.where("up is not null"), onward, ["up"], most).drop("up").withColumnRenamed("next", "up")
        now = written(more.where("up is null").unionByName(moved), "chains")
    return now.drop("up")


def ended_by(ends: DataFrame, chains: DataFrame, partitions: int) -> DataFrame:
    """conv_id, depth, sha: nodes where conversations end that do not own them, with all that end there."""
    at = ends.select(F.col("owner").alias("conv_id"), (F.col("f") - 1).alias("depth"))
    owners = chains.join(at.distinct(), "conv_id").where("len = depth").select("conv_id", "depth", F.col("conv_id").alias("member"))
    rows = ends.select(F.col("owner").alias("conv_id"), (F.col("f") - 1).alias("depth"), F.col("conv_id").alias("member")).unionByName(owners)

    def runs_of(batch: pa.RecordBatch) -> np.ndarray:
        c, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        return np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])]))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            cut = runs_of(batch)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(cut, batch.num_rows), pa.int32()), batch.column(2).cast(pa.string())), ",")
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(cut)) for c in batch.columns), text], names=["conv_id", "depth", "first", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        row = lambda done: pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.string())], names=["conv_id", "depth", "sha"])
        for batch in batches:
            for conv, depth, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (conv, depth) != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (conv, depth), hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield row(out)
            out = []
        if key:
            yield row([(*key, sha.hexdigest())])

    pieces = rows.repartitionByRange(partitions, "conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member").mapInArrow(joined, "conv_id long, depth long, first long, text string")
    return pieces.repartition(partitions, "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(hashed, "conv_id long, depth long, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node, with the columns of NODE: of distinct sequences of first turns (role, text) of the rebuilt conversations."""
    partitions = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = chunks(conversations, partitions)
    info, rows = rebuilt(stored)
    least = info.agg(F.min("conv_id")).head()[0]
    own = prefixes(rows, info)
    found = first_owned(info, own, least if least is not None else 0, partitions)
    is_chain = (F.col("f") <= F.col("len")) | F.col("owner").isNull()
    chains, ends = found.where(is_chain), found.where(~is_chain)
    totals = written(chain_totals(chains, ends, partitions).join(chains.select("conv_id", "f", "len", "shift", "owner"), "conv_id"), "totals")
    zero, deepest = F.lit(0).cast("long"), F.lit(1 << 62)
    hung = totals.where("owner is not null").select(F.col("owner").alias("conv_id"), (F.col("f") - 1).alias("depth"), F.lit(1).cast("long").alias("n_chains"), "members", "leaves", "a")
    hung = hung.unionByName(ends.select(F.col("owner").alias("conv_id"), (F.col("f") - 1).alias("depth"), zero.alias("n_chains"), F.lit(1).cast("long").alias("members"), zero.alias("leaves"), "a"))
    sums = [F.sum(c).alias(c) for c in ("n_chains", "members", "leaves", "a")]
    part = F.floor(F.col("depth") / CHUNK).alias("part")
    hung = written(hung.groupBy("conv_id", "depth").agg(*sums).withColumn("part", part), "hung")
    # Long chains: what hangs below later parts is handed on to each earlier one.
    per = hung.groupBy("conv_id", "part").agg(*sums)
    reach = per.groupBy("conv_id").agg(F.max("part").alias("last")).where("last > 0")
    filled = reach.select("conv_id", F.explode(F.sequence(zero, F.col("last"))).alias("part")).join(per, ["conv_id", "part"], "left")
    later = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    handed = filled.select("conv_id", deepest.alias("depth"), "part", zero.alias("n_chains"), *(F.coalesce(F.sum(c).over(later), zero).alias(c) for c in ("members", "leaves", "a")))
    place = lambda d: F.floor((d - 1 + F.col("shift")) / CHUNK)
    spans = totals.where("len > 0").select("conv_id", "f", "len", "owner", "leaf", F.explode(F.sequence(place(F.greatest("f", F.lit(1))), place(F.col("len")))).alias("k"))
    nodes = spans.join(own, ["conv_id", "k"]).select("conv_id", "f", "len", "owner", "leaf", "before", F.posexplode(F.arrays_zip("cum", "bytes")).alias("i", "t"))
    nodes = nodes.select("conv_id", (F.col("before") + F.col("i") + 1).alias("depth"), "f", "len", "owner", "leaf", (F.col("t.cum") - F.col("t.bytes")).alias("above")).where("depth >= f")
    nodes = nodes.unionByName(totals.where("owner is null").select("conv_id", zero.alias("depth"), "f", "len", "owner", "leaf", zero.alias("above"))).withColumn("part", part)
    rows = nodes.unionByName(hung.unionByName(handed), allowMissingColumns=True).repartition(partitions, "conv_id", "part")
    rows = rows.groupBy("conv_id", "part", "depth").agg(*(F.max(c).alias(c) for c in ("f", "len", "owner", "leaf", "above")), *(F.coalesce(F.sum(c), zero).alias(c) for c in ("n_chains", "members", "leaves", "a")))
    upward = Window.partitionBy("conv_id", "part").orderBy(F.desc("depth"))
    rows = rows.withColumns({c: F.sum(c).over(upward) for c in ("members", "leaves", "a")}).where("len is not null")
    named = rows.join(ended_by(ends, chains, partitions), ["conv_id", "depth"], "left")
    alone = F.sha2(F.when(F.col("depth") == F.col("len"), F.col("conv_id").cast("string")).otherwise(F.lit("")), 256)
    return named.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("f"), F.col("owner")).otherwise(F.col("conv_id")).alias("parent_conv_id"), (1 + F.col("members")).alias("n_convs"),
        (F.col("n_chains") + (F.col("depth") < F.col("len")).cast("long")).alias("n_children"), (F.col("leaf") + F.col("leaves")).alias("n_leaves"), (F.col("a") - F.col("members") * F.col("above")).alias("saved_tokens"),
        F.coalesce("sha", alone).alias("ends_sha256"),
    )
