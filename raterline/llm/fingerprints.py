"""Document fingerprints as invertible Bloom lookup sketches.

A text is a set of paragraph digests: its lines, cut at sentence ends, hashed with their
number of earlier occurrences so that repeats stay apart.  The sketch is a small table of
cells (count, exclusive-or of digests, exclusive-or of checks); every digest goes to one cell
in each of three parts.  Peeling cells that hold a single digest recovers what a table holds.

A fingerprint is the smallest table, of sizes that double, from which all digests of its text
can be peeled: where peeling fails, a table twice as large is tried.  So two holders of
fingerprints need neither text.  Tables of one size subtract cell by cell, and peeling the
rest gives the digests in which the texts differ; where sizes differ, or the rest is too much
for the table, both are peeled whole, which cannot fail.

Neighbouring rows meet by a range partitioning of doc_id: each part also gets the first row
of the part after it, so one shuffle of the texts is all, whatever the number of rows.

Defined cases: null and empty texts have no digests and an empty table; two such texts are
alike (1.0); null ids sort first; rows that share an id are ordered by a hash of their text;
the last row's neighbour is the first; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterline.llm.common import schema
from raterline.llm.textvec import byte_values, class_table, mix, prefix_hash, range_hash, slab, words

PARTS = 3
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_ENDS = class_table("\n\r.!?")


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(digests of all texts in order, offsets of each text in them)."""
    s = slab(texts)
    first, last, of = words(s, _ENDS)
    h = range_hash(prefix_hash(byte_values(s.buf)), first, last)
    order = np.lexsort((h, of))
    same = np.zeros(len(h), np.int64)
    if len(h):
        ho, oo = h[order], of[order]
        new = np.concatenate([[True], (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])])
        start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        same[order] = np.arange(len(h)) - start
    return mix(h + same.astype(np.uint64) * _STEPS[0]), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]).astype(np.int64)


def cells_of(digest: np.ndarray, size: int) -> np.ndarray:
    """The cell of every digest in each part of a table with `size` cells a part."""
    return np.stack([(mix(digest ^ _STEPS[j]) % np.uint64(size)).astype(np.int64) + j * size for j in range(PARTS)])


def _checks(digest: np.ndarray) -> np.ndarray:
    return mix(digest + _STEPS[1]) >> np.uint64(32)


def tables(digest: np.ndarray, owner: np.ndarray, n: int, size: int, sign: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, keys, checks), each n x cells, of n sets at once; owner: each digest's set."""
    width = PARTS * size
    count, key, check = np.zeros(n * width, np.int64), np.zeros(n * width, np.uint64), np.zeros(n * width, np.uint64)
    _toggle(count, key, check, digest, owner, size, np.ones(len(digest), np.int64) if sign is None else sign)
    return count.reshape(n, width), key.reshape(n, width), check.reshape(n, width)


def _toggle(count: np.ndarray, key: np.ndarray, check: np.ndarray, digest: np.ndarray, owner: np.ndarray, size: int, sign: np.ndarray) -> None:
    own = _checks(digest)
    for cell in cells_of(digest, size):
        at = owner * PARTS * size + cell
        np.add.at(count, at, sign)
        np.bitwise_xor.at(key, at, digest)
        np.bitwise_xor.at(check, at, own)


def peel(count: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Recover what subtracted tables hold: (digest, owner, sign) and, per table, whether it was emptied."""
    n, width = count.shape
    size = width // PARTS
    count, key, check = count.ravel().copy(), key.ravel().copy(), check.ravel().copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        at = np.flatnonzero(np.abs(count) == 1)
        at = at[check[at] == _checks(key[at])]
        if not len(at):
            break
        owner = at // width
        _, once = np.unique(np.stack([owner.astype(np.uint64), key[at]]), axis=1, return_index=True) if len(at) > 1 else (None, np.array([0]))
        digest, owner, sign = key[at][once], owner[once], count[at][once]
        _toggle(count, key, check, digest, owner, size, -sign)
        found.append((digest, owner, sign))
    empty = ~((count != 0) | (key != 0)).reshape(n, width).any(axis=1)
    parts = list(zip(*found)) or [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    return *(np.concatenate(x) for x in parts), empty


@dataclass
class Tables:
    """Fingerprints of some texts: each one's digest count and table size, and the tables laid end to end."""

    held: np.ndarray
    size: np.ndarray
    count: np.ndarray
    key: np.ndarray
    check: np.ndarray

    @property
    def begin(self) -> np.ndarray:
        return PARTS * (np.cumsum(self.size) - self.size)

    def of_size(self, which: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, key, check), one row of cells for each of some tables, all of that size."""
        at = self.begin[which][:, None] + np.arange(PARTS * size)
        return self.count[at], self.key[at], self.check[at]

    def contents(self) -> tuple[np.ndarray, np.ndarray]:
        """(digest, text number) of all that the tables hold."""
        found = []
        for size in np.unique(self.size).tolist():
            which = np.flatnonzero(self.size == size)
            d, o, _, whole = peel(*self.of_size(which, size))
            if not whole.all():
                raise ValueError("not a fingerprint: its table does not hold what it counts")
            found.append((d, which[o]))
        return _joined(found, np.uint64, np.int64)

    def encoded(self) -> list[str]:
        """As text: digest count, table size and cells, in base 64."""
        cells = np.zeros(len(self.key), _CELL)
        cells["count"], cells["key"], cells["check"] = self.count, self.key, self.check
        raw, out = cells.tobytes(), []
        for n, size, at in zip(self.held.tolist(), self.size.tolist(), self.begin.tolist()):
            out.append(base64.b64encode(struct.pack("<II", n, size) + raw[at * _CELL.itemsize : (at + PARTS * size) * _CELL.itemsize]).decode())
        return out

    @staticmethod
    def decoded(texts: list[str]) -> Tables:
        raw = [base64.b64decode(t) for t in texts]
        head = np.array([struct.unpack_from("<II", r) for r in raw], np.int64).reshape(-1, 2)
        cells = np.frombuffer(b"".join(r[8:] for r in raw), _CELL)
        return Tables(head[:, 0], head[:, 1], cells["count"].astype(np.int64), cells["key"].copy(), cells["check"].astype(np.uint64))


_CELL = np.dtype([("count", "<u4"), ("key", "<u8"), ("check", "<u4")])


def _joined(parts: list, *kinds: type) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]) for i, k in enumerate(kinds))


def fingerprints_of(digest: np.ndarray, offsets: np.ndarray, *, least: int = 2) -> Tables:
    """The fingerprint of every text, from digests() of it."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    # Digests that are equal by accident would never be peeled apart; they count once.
    order = np.lexsort((digest, owner))
    d, o = digest[order], owner[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (o[1:] != o[:-1])])[: len(d)]
    d, o = d[new], o[new]
    held = np.bincount(o, minlength=n)
    # Three parts hold about 1.25 cells for every digest at best.
    size = least << np.ceil(np.log2(np.maximum(held * 1.25 / PARTS / least, 1))).astype(np.int64)
    made: list[tuple[np.ndarray, int, tuple]] = []
    todo = np.arange(n)
    while len(todo):
        left = []
        for s in np.unique(size[todo]).tolist():
            which = todo[size[todo] == s]
            number = np.full(n, -1)
            number[which] = np.arange(len(which))
            own = number[o] >= 0
            t = tables(d[own], number[o[own]], len(which), s)
            whole = peel(*t)[3]
            made.append((which[whole], s, tuple(x[whole] for x in t)))
            left.append(which[~whole])
        todo = np.concatenate(left)
        size[todo] *= 2
    out = Tables(held, size, *(np.zeros(PARTS * int(size.sum()), k) for k in (np.int64, np.uint64, np.uint64)))
    for which, s, t in made:
        at = out.begin[which][:, None] + np.arange(PARTS * s)
        out.count[at], out.key[at], out.check[at] = t
    return out


def differences(left: Tables, right: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests that only one side of each pair has: (digest, pair, 1 for left or -1 for right); from the fingerprints alone."""
    out, rest = [], [np.flatnonzero(left.size != right.size)]
    for size in np.unique(left.size).tolist():
        which = np.flatnonzero((left.size == size) & (right.size == size))
        a, b = left.of_size(which, size), right.of_size(which, size)
        d, o, s, whole = peel(a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2])
        out.append((d[whole[o]], which[o[whole[o]]], s[whole[o]]))
        rest.append(which[~whole])
    pairs = np.sort(np.concatenate(rest))
    if len(pairs):
        digest, pair, sign = [], [], []
        for side, s in ((left, 1), (right, -1)):
            at = np.concatenate([np.arange(b, b + PARTS * z) for b, z in zip(side.begin[pairs].tolist(), side.size[pairs].tolist())])
            d, o = Tables(side.held[pairs], side.size[pairs], side.count[at], side.key[at], side.check[at]).contents()
            digest.append(d)
            pair.append(pairs[o])
            sign.append(np.full(len(d), s))
        d, p, s = np.concatenate(digest), np.concatenate(pair), np.concatenate(sign)
        order = np.lexsort((d, p))
        d, p, s = d[order], p[order], s[order]
        twin = np.concatenate([(d[1:] == d[:-1]) & (p[1:] == p[:-1]), [False]])
        alone = ~(twin | np.concatenate([[False], twin[:-1]]))
        out.append((d[alone], p[alone], s[alone]))
    return _joined(out, np.uint64, np.int64, np.int64)


def likeness(left: Tables, right: Tables) -> np.ndarray:
    """Shared digests as a part of all, per pair; 1 for two empty texts."""
    _, pair, _ = differences(left, right)
    a, b, differ = left.held, right.held, np.bincount(pair, minlength=len(left.held))
    shared = (a + b - differ) / 2
    return np.where(a + b == 0, 1.0, shared / np.maximum(a + b - shared, 1))


NEIGHBOURS = schema(doc_id="long", n_chars="long", edited_sha256="string", fingerprint="string", edited_fingerprint="string", near_edited="double", near_next="double", pieces="long", pieces_edited="long")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    edited = [_edited(a, b) for a, b in zip(texts, following)]
    own, changed, after = (fingerprints_of(*digests(pa.array(x, pa.string()))) for x in (texts, edited, following))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(own.encoded()), pa.array(changed.encoded()), pa.array(likeness(own, changed)), pa.array(likeness(own, after)), pa.array(own.held), pa.array(changed.held),
        ], names=NEIGHBOURS.names,
    )


def parts_of(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, text) with `part` and `ahead`: rows in ranges of doc_id, the first of each also ahead in the range before."""
    low = -(2**63)
    ids = docs.select(F.coalesce("doc_id", F.lit(low)).alias("id"))
    bounds = sorted({int(x) for x in ids.approxQuantile("id", [i / parts for i in range(1, parts)], 0.0005)}) if parts > 1 else []
    edges = np.array([b for b in bounds if low < b < 2**63], np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), side="right"))

    # One row for each part; there are as many as partitions.
    first = ids.groupBy(part("id").alias("part")).agg(F.min("id").alias("first")).orderBy("part").collect()
    starts, before = np.full(len(edges) + 1, low), np.full(len(edges) + 1, -1)
    for i, r in enumerate(first):
        starts[r["part"]], before[r["part"]] = r["first"], first[i - 1]["part"]

    @F.pandas_udf("int")
    def ahead_in(ids: pd.Series) -> pd.Series:
        x = ids.to_numpy(np.int64)
        own = np.searchsorted(edges, x, side="right")
        return pd.Series(np.where(x == starts[own], before[own], -1))

    known = docs.withColumn("id", F.coalesce("doc_id", F.lit(low))).withColumns({"own": part("id"), "other": ahead_in("id")})
    place = lambda p, ahead: F.struct(p.alias("part"), F.lit(ahead).alias("ahead"))
    at = known.withColumn("place", F.explode(F.when(F.col("other") >= 0, F.array(place(F.col("own"), 0), place(F.col("other"), 1))).otherwise(F.array(place(F.col("own"), 0)))))
    return at.select("place.part", "place.ahead", "doc_id", "text", F.xxhash64("text").alias("tie"))


def fingerprint_neighbours(docs: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Each text's sketch, that of its edited version, and the likeness to both that and the next text.

    Edited: the last half of the characters (rounded down) gives way to as many from the start
    of the next text by doc_id, or all it has.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parts_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, following, held = [], [], [], 0
        last = None  # (part, doc_id, text) still without its next text
        for batch in batches:
            for part, ahead, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if last and last[0] == part:
                    ids.append(last[1])
                    texts.append(last[2])
                    following.append(text)
                    held += len(last[2])
                    if held > 1 << 20 or len(ids) >= 2000:
                        yield _compare(ids, texts, following)
                        ids, texts, following, held = [], [], [], 0
                last = None if ahead else (part, doc_id, text)
        if ids:
            yield _compare(ids, texts, following)

    placed = rows.repartition(n, "part").sortWithinPartitions("part", "ahead", F.asc_nulls_first("doc_id"), "tie")
    return placed.select("part", "ahead", "doc_id", "text").mapInArrow(run, NEIGHBOURS)


def _lists(batch: pa.RecordBatch, kept: int, left: Tables, right: Tables) -> pa.RecordBatch:
    d, pair, sign = differences(left, right)
    n, lists = batch.num_rows, []
    for s in (1, -1):
        own = sign == s
        order = np.lexsort((d[own], pair[own]))
        cuts = np.concatenate([[0], np.cumsum(np.bincount(pair[own], minlength=n))])
        lists.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(d[own][order].view(np.int64))))
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(kept)), *lists, pa.array(likeness(left, right))], names=[*batch.schema.names[:kept], *_MADE.names])


_MADE = schema(removed="array<bigint>", added="array<bigint>", likeness="double")


def _by_pairs(pairs: DataFrame, before: str, after: str, read) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 200) for i in range(0, whole.num_rows, 200)):
                k = batch.num_columns - 2
                yield _lists(batch, k, read(batch.column(k)), read(batch.column(k + 1)))

    kept = [c for c in pairs.columns if c not in (before, after, *_MADE.names)]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*kept).schema), _MADE])
    # The two come last and are told by place, so no name of the table's own can clash with theirs.
    return pairs.select(*kept, F.col(before).cast("string"), F.col(after).cast("string")).mapInArrow(run, out)


def version_differences(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """For rows holding two versions of a text: digests removed and added, and the likeness, in place of the texts."""
    return _by_pairs(pairs, before, after, lambda texts: fingerprints_of(*digests(texts)))


def fingerprint_differences(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """The same for rows holding two fingerprints and no text (null: that of an empty text)."""
    none = fingerprints_of(*digests(pa.array([""]))).encoded()[0]
    return _by_pairs(pairs, before, after, lambda made: Tables.decoded([x or none for x in made.to_pylist()]))
