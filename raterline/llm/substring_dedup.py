"""Substring deduplication through difference-cover anchors.

A window is `length` consecutive words; a word goes if a window that covers it also starts
earlier.  Of all positions in a document only those in a difference cover modulo `PERIOD` are
hashed, with the `length - PERIOD + 1` words that follow.  For any two places there is an
offset below the period that brings both onto the cover, so two equal windows share an anchor
there, and an anchor that occurs once in the corpus rules out all windows for which it would
have to be shared.  Around anchors that recur the match is extended to whole windows: their
hashes go to one place each, where the earliest start is found.

Both rounds run on packed hashes (see slabs): about 4/13 of all places in the first, only
windows near recurring anchors in the second.

Order is by doc_id (null ids first), then start.  Hashes have 64 bits; windows count as equal
when their hashes are.  Anchors with equal hashes by accident only add windows to compare.

Defined cases: null texts have no words; texts under `length` words lose nothing; rows that
repeat both doc_id and text count as one document and get the same answer; documents that
share only the id are ordered by a hash of their text; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from raterline.llm.common import keyed, schema
from raterline.llm.slabs import ASKED, Dealt, answer, ask, asked, by_bucket, column, deal, repeated, with_replies
from raterline.llm.textvec import BLANKS, byte_values, prefix_hash, range_hash, slab, words

#: A perfect difference cover: every number below 13 is a difference of two of these, modulo 13.
PERIOD, COVER = 13, np.array([0, 1, 3, 9])
_WORD_BASE = np.uint64(0xA0761D6478BD642F)

OUT = schema(doc_id="long", n_words="long", n_removed="long", kept_sha256="string")


class Words:
    """The words of a slab's rows: their hashes, documents and positions."""

    def __init__(self, rows: pa.Table):
        self.slab = slab(column(rows, "text"))
        self.first, self.last, self.of = words(self.slab, BLANKS)
        h = range_hash(prefix_hash(byte_values(self.slab.buf)), self.first, self.last)
        self.prefix = prefix_hash(h, _WORD_BASE)
        n = rows.num_rows
        self.count = np.bincount(self.of, minlength=n).astype(np.int64)
        self.begin = np.cumsum(self.count) - self.count
        self.pos = np.arange(len(h)) - self.begin[self.of]

    def starts(self, length: int) -> np.ndarray:
        """Word indexes at which `length` words of one document start."""
        return np.flatnonzero(self.pos + length <= self.count[self.of])

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        return range_hash(self.prefix, at, at + length, _WORD_BASE)


def _anchors(w: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, hash, order by hash) of all anchors, in documents long enough for a window."""
    at = w.starts(length - PERIOD + 1)
    at = at[np.isin(w.pos[at] % PERIOD, COVER) & (w.count[w.of[at]] >= length)]
    h = w.hashes(at, length - PERIOD + 1)
    return at, h, np.argsort(h, kind="stable")


def _unique_runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values: the first index of each distinct one, and how many there are."""
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(h)))


def _ask_anchors(dealt: Dealt, length: int) -> DataFrame:
    buckets = dealt.buckets

    def question(rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        _, h, order = _anchors(Words(rows), length)
        h = h[order]
        first, count = _unique_runs(h)
        for bucket, i in by_bucket(h[first], buckets):
            yield bucket, h[first][i].tobytes() + (count[i] > 1).astype(np.uint8).tobytes()

    return ask(dealt, question)


def _recurring(bodies: list[bytes], _: np.ndarray) -> list[bytes]:
    """For each distinct hash that a slab sent: does it occur twice or more in all?"""
    hashes = [np.frombuffer(b, np.uint64, len(b) // 9) for b in bodies]
    twice = [np.frombuffer(b, np.uint8, len(b) // 9, len(b) // 9 * 8) for b in bodies]
    h = np.concatenate(hashes)
    _, where, count = np.unique(h, return_inverse=True, return_counts=True)
    again = (count[where] > 1) | (np.concatenate(twice) > 0)
    return [np.packbits(x).tobytes() for x in np.split(again, np.cumsum([len(x) for x in hashes])[:-1])]


def _candidates(w: Words, by: dict[int, bytes], buckets: int, length: int) -> np.ndarray:
    """Word indexes of the windows that some recurring anchor lies in, aligned."""
    at, h, order = _anchors(w, length)
    h = h[order]
    first, count = _unique_runs(h)
    again = np.zeros(len(first), bool)
    for bucket, i in by_bucket(h[first], buckets):
        again[i] = np.unpackbits(np.frombuffer(by[bucket], np.uint8), count=len(i)).astype(bool)
    recurs = at[order][np.repeat(again, count)]
    # Windows that start up to PERIOD - 1 words before a recurring anchor, in its document.
    mark = np.zeros(len(w.of) + 1, np.int64)
    np.add.at(mark, np.maximum(recurs - (PERIOD - 1), w.begin[w.of[recurs]]), 1)
    np.add.at(mark, recurs + 1, -1)
    starts = w.starts(length)
    return starts[np.cumsum(mark)[starts] > 0]


def _local_first(w: Words, rows: pa.Table, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows sorted by hash, then place: (their order, hashes, first of each hash, places).

    A place is (doc_id, key) of the row; word order settles the rest.
    """
    ids = column(rows, "doc_id")
    rank = np.empty(rows.num_rows, np.int64)
    null = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), bool)
    plain = ids.fill_null(0).to_numpy()
    rank[np.lexsort((column(rows, "key").to_numpy(), plain, null))] = np.arange(rows.num_rows)
    h = w.hashes(at, length)
    order = np.lexsort((at, rank[w.of[at]], h))
    first, _ = _unique_runs(h[order])
    return order, h[order], first, null


def _places(rows: pa.Table) -> np.ndarray:
    """Per row, three numbers that order documents: null ids first, then doc_id, then key."""
    ids = column(rows, "doc_id")
    return np.stack([np.asarray(ids.is_valid().to_numpy(zero_copy_only=False)).astype(np.int64), ids.fill_null(0).to_numpy().astype(np.int64), column(rows, "key").to_numpy().astype(np.int64)], axis=1)


def _ask_windows(dealt: Dealt, replies: DataFrame, length: int) -> DataFrame:
    buckets = dealt.buckets

    def extend(number: int, rows: pa.Table, by: dict[int, bytes]) -> pa.Table:
        w = Words(rows)
        at = _candidates(w, by, buckets, length)
        order, h, first, _ = _local_first(w, rows, at, length)
        place, of = _places(rows), w.of[at[order]][first]
        bodies = []
        for bucket, i in by_bucket(h[first], buckets):
            docs, local = np.unique(of[i], return_inverse=True)
            head = np.array([len(i), len(docs)], np.int64).tobytes()
            bodies.append((bucket, head + h[first][i].tobytes() + place[docs].tobytes() + local.astype(np.uint32).tobytes()))
        mask = np.zeros(len(w.of), bool)
        mask[at] = True
        bodies.append((-1 - number % buckets, np.packbits(mask).tobytes()))
        return pa.Table.from_batches([asked(number, iter(bodies))])

    return with_replies(dealt, replies, extend, ASKED)


def _earliest(bodies: list[bytes], _: np.ndarray) -> list[bytes]:
    """For each distinct window hash that a slab sent: is its own place the earliest of all?"""
    hashes, places = [], []
    for b in bodies:
        n, m = np.frombuffer(b, np.int64, 2)
        hashes.append(np.frombuffer(b, np.uint64, n, 16))
        table = np.frombuffer(b, np.int64, 3 * m, 16 + 8 * n).reshape(m, 3)
        places.append(table[np.frombuffer(b, np.uint32, n, 16 + 8 * n + 24 * m)])
    h, p = np.concatenate(hashes), np.concatenate(places)
    order = np.lexsort((p[:, 2], p[:, 1], p[:, 0], h))
    first, _ = _unique_runs(h[order])
    least = np.zeros(len(h), bool)
    least[order[first]] = True
    return [np.packbits(x).tobytes() for x in np.split(least, np.cumsum([len(x) for x in hashes])[:-1])]


def _remove(dealt: Dealt, replies: DataFrame, length: int) -> DataFrame:
    buckets = dealt.buckets

    def finish(number: int, rows: pa.Table, by: dict[int, bytes]) -> pa.Table:
        w = Words(rows)
        n = len(w.of)
        at = np.flatnonzero(np.unpackbits(np.frombuffer(by.get(-1 - number % buckets, b""), np.uint8), count=n)) if n and by else np.zeros(0, np.int64)
        order, h, first, _ = _local_first(w, rows, at, length)
        kept = np.zeros(len(first), bool)
        for bucket, i in by_bucket(h[first], buckets):
            kept[i] = np.unpackbits(np.frombuffer(by[bucket], np.uint8), count=len(i)).astype(bool)
        late = np.ones(len(at), bool)
        late[first[kept]] = False
        mark = np.zeros(n + 1, np.int64)
        gone = at[order][late]
        np.add.at(mark, gone, 1)
        np.add.at(mark, gone + length, -1)
        removed = np.cumsum(mark)[:n] > 0
        raw = w.slab.buf.tobytes()
        sha = []
        for d in range(rows.num_rows):
            own = slice(w.begin[d], w.begin[d] + w.count[d])
            keep = ~removed[own]
            sha.append(hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(w.first[own][keep].tolist(), w.last[own][keep].tolist())])).hexdigest())
        n_removed = np.bincount(w.of[removed], minlength=rows.num_rows)
        answers = pa.Table.from_arrays([rows.column("doc_id"), pa.array(w.count), pa.array(n_removed.astype(np.int64)), pa.array(sha, pa.string())], names=OUT.names)
        return repeated(answers, rows.column("copies"))

    return with_replies(dealt, replies, finish, OUT)


def remove_repeats(docs: DataFrame, *, length: int = 20) -> DataFrame:
    """Per document: words, words removed, and the hash of what is kept.  length: at least PERIOD."""
    own = keyed(docs)
    dealt = deal(own, asked_share=0.5)
    recurring = answer(_ask_anchors(dealt, length), dealt, _recurring)
    earliest = answer(_ask_windows(dealt, recurring, length), dealt, _earliest)
    return _remove(dealt, earliest, length)

