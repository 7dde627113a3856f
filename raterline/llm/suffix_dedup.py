"""Suffix-array deduplication with run-length indexes.

Every byte goes that is covered by a `length`-byte string which also starts anywhere else in
the corpus.  Strings that are equal hold the same smallest hash of a `GRAM`-byte gram (the
leftmost of equals), their anchor; so each text falls into segments, the stretches of strings
that share an anchor, and only segments with one anchor need be compared.

First the corpus is asked which anchors and which whole segments recur (see slabs).  A segment
whose anchor occurs once is free; one that recurs as a whole is repeated throughout.  Of the
rest, distinct segments meet in buckets of anchors, and each bucket builds a run-length index
of them: the suffix array's Burrows-Wheeler transform, compressed into runs, with text
position and common prefix kept at the ends of runs only.  Between those samples the longest
match falls by one with each byte, so matching statistics stream along the text from them;
strings with a match of `length` bytes or more are reported back.

A bucket indexes at most `BLOCK` bytes at a time, whole anchors together.  Where the distinct
segments of an anchor have more, no bucket gets them: the slabs ask for the hash of each of
their strings instead, which spread over all buckets, whatever the number of texts.

Defined cases: null and empty texts lose nothing; matches never cross documents; rows that
repeat both doc_id and text each start every one of their strings elsewhere too, so they lose
all that is long enough; an empty table gives an empty result; further columns are ignored.  A
text of any length is worked on whole by one task, at about 60 bytes of memory for each of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from raterline.llm.common import keyed, schema
from raterline.llm.slabs import ASKED, Dealt, answer, ask, asked, by_bucket, column, deal, repeated, with_replies
from raterline.llm.textvec import byte_values, mix, prefix_hash, range_hash, slab, sliding_min, spans_from_mask

GRAM = 32
BLOCK = 1 << 20
#: The second round carries bytes in place of hashes, so its buckets are finer by this factor.
FINER = 8
#: Parts the segments of a bucket's text; never part of UTF-8.
SEPARATOR = 0xFF
#: The low bits hold a place in a slab: texts of up to 64 GB; the rest of a hash settles which is least.
_LOW = np.uint64((1 << 36) - 1)

OUT = schema(doc_id="long", n_bytes="long", n_removed="long", n_spans="long", kept_sha256="string")


@dataclass
class Segments:
    """Segments of a slab, sorted by (anchor, content): bytes start:stop, distinct ones numbered."""

    start: np.ndarray
    stop: np.ndarray
    anchor_at: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    first: np.ndarray
    count: np.ndarray


def segments(rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Segments]:
    """(bytes, start and end of each text, segments) of a slab."""
    s = slab(column(rows, "text"))
    if rows.column("copies").to_numpy().max(initial=1) > 1:
        # A repeated row counts as one more text, so that its strings recur.
        again = pa.chunked_array([column(rows, "text"), column(rows, "text").filter(pa.array(rows.column("copies").to_numpy() > 1))]).combine_chunks()
        s = slab(again if isinstance(again, pa.Array) else pa.concat_arrays(again.chunks))
    n = len(s.buf)
    empty = np.zeros(0, np.int64)
    if n < length:
        none = Segments(empty, empty, empty, *(np.zeros(0, np.uint64),) * 2, empty, empty)
        return s.buf, s.start, s.end, none
    prefix = prefix_hash(byte_values(s.buf))
    i = np.arange(n - GRAM + 1)
    h = range_hash(prefix, i, i + GRAM)
    at = (sliding_min((h & ~_LOW) | i.astype(np.uint64), length - GRAM + 1) & _LOW).astype(np.int64)
    of = np.repeat(np.arange(len(s.start)), s.end - s.start + 1)[: len(at)]
    inside = np.arange(len(at)) + length <= s.end[of]
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1]) | (inside[1:] != inside[:-1])]))
    stop = np.append(cut[1:], len(at))
    real = inside[cut]
    start, stop = cut[real], stop[real] + length - 1
    # The least of many hashes are small numbers; mixed again, they spread over all buckets.
    anchor, content = mix(h[at[start]]), range_hash(prefix, start, stop)
    order = np.lexsort((content, anchor))
    a, c = anchor[order], content[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])) if len(a) else empty
    return s.buf, s.start, s.end, Segments(start[order], stop[order], at[start][order], a, c, first, np.diff(np.append(first, len(a))))


# ---------------------------------------------------------------- first round: what recurs


def _anchors(seg: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Of the distinct segments: where each anchor begins, and how many there are of it."""
    anchor = seg.anchor[seg.first]
    begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(anchor)))


def _ask_segments(dealt: Dealt, length: int) -> DataFrame:
    """Anchors go to one half of the buckets, once a slab; contents, distinct ones, to the other."""
    buckets = dealt.buckets

    def question(rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        *_, seg = segments(rows, length)
        begin, many = _anchors(seg)
        anchor, content = seg.anchor[seg.first[begin]], seg.content[seg.first]
        size = np.minimum(np.add.reduceat((seg.stop - seg.start)[seg.first], begin), 2**32 - 1).astype(np.uint32) if len(begin) else begin
        several = (many > 1).astype(np.uint8)
        for bucket, i in by_bucket(anchor, buckets):
            yield bucket, np.array([len(i)], np.int64).tobytes() + anchor[i].tobytes() + content[begin[i]].tobytes() + size[i].tobytes() + several[i].tobytes()
        order, twice = np.argsort(content), (seg.count > 1).astype(np.uint8)
        for bucket, i in by_bucket(content[order], buckets):
            yield buckets + bucket, np.array([-len(i)], np.int64).tobytes() + content[order[i]].tobytes() + twice[order[i]].tobytes()

    return ask(dealt, question)


#: Codes: all strings of the segment recur; it is to be compared; and that by the hashes of its strings.
RECURS, WANTED, LARGE = 1, 2, 4


def _numbers(bodies: list[bytes], kind: type, at: int) -> np.ndarray:
    """An array of each body, end to end; at: bytes of the arrays before it, for each number in it."""
    size = [abs(int(np.frombuffer(b, np.int64, 1)[0])) for b in bodies]
    return np.concatenate([np.frombuffer(b, kind, n, 8 + at * n) for b, n in zip(bodies, size)])


def _several(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For the hashes that slabs asked, with a byte for those met twice: does it recur, is it the first?"""
    h, twice = _numbers(bodies, np.uint64, 0), _numbers(bodies, np.uint8, 8)
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    group = np.cumsum(new) - 1
    recurs, first = np.zeros(len(h), bool), np.zeros(len(h), bool)
    recurs[order] = (np.bincount(group) + np.bincount(group, twice[order]) > 1)[group]
    first[order] = new
    return recurs, first


def _judge(block: int):
    def reply(bodies: list[bytes], _: np.ndarray) -> list[bytes]:
        """A code for every anchor or content that a slab sent; of copies only one is wanted."""
        cuts = np.cumsum([abs(int(np.frombuffer(b, np.int64, 1)[0])) for b in bodies])[:-1]
        if np.frombuffer(bodies[0], np.int64, 1)[0] < 0:
            recurs, first = _several(bodies)
            code = np.where(recurs, RECURS, 0) | np.where(first, WANTED, 0)
        else:
            anchor, content, size, several = (_numbers(bodies, k, at) for k, at in ((np.uint64, 0), (np.uint64, 8), (np.uint32, 16), (np.uint8, 20)))
            order = np.lexsort((content, anchor))
            a, c = anchor[order], content[order]
            new = np.concatenate([[True], a[1:] != a[:-1]])
            group = np.cumsum(new) - 1
            last = np.append(new[1:], True)
            wanted = (c[new] != c[last]) | (np.bincount(group, several[order]) > 0)
            code = np.zeros(len(a), np.uint8)
            code[order] = np.where(wanted, WANTED | np.where(np.bincount(group, size[order]) > block, LARGE, 0), 0)[group]
        return [x.tobytes() for x in np.split(code.astype(np.uint8), cuts)]

    return reply


def _codes(seg: Segments, by: dict[int, bytes], buckets: int) -> np.ndarray:
    """Codes of distinct segments."""
    begin, many = _anchors(seg)
    of_anchor, of_content = np.zeros(len(begin), np.uint8), np.zeros(len(seg.first), np.uint8)
    for bucket, i in by_bucket(seg.anchor[seg.first[begin]], buckets):
        of_anchor[i] = np.frombuffer(by[bucket], np.uint8)
    content = seg.content[seg.first]
    order = np.argsort(content)
    for bucket, i in by_bucket(content[order], buckets):
        of_content[order[i]] = np.frombuffer(by[buckets + bucket], np.uint8)
    of_anchor = np.repeat(of_anchor, many)
    return (of_content & RECURS) | (of_content & of_anchor & WANTED) | (of_anchor & LARGE)


# ---------------------------------------------------------------- second round: comparison


def _strings(buf: np.ndarray, seg: Segments, code: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each string in the wanted segments of large anchors."""
    k = seg.first[code & (WANTED | LARGE) == WANTED | LARGE]
    if not len(k):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = seg.stop[k] - seg.start[k] - length + 1
    start = np.repeat(seg.start[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return start, mix(range_hash(prefix_hash(byte_values(buf)), start, start + length))


def _send_wanted(dealt: Dealt, replies: DataFrame, length: int) -> DataFrame:
    buckets, fine = dealt.buckets, dealt.buckets * FINER

    def send(number: int, rows: pa.Table, by: dict[int, bytes]) -> pa.Table:
        buf, _, _, seg = segments(rows, length)
        code = _codes(seg, by, buckets)
        wanted = np.flatnonzero(code & (WANTED | LARGE) == WANTED)
        one = seg.first[wanted]
        bodies = []
        for bucket, i in by_bucket(seg.anchor[one], fine):
            k = one[i]
            size = seg.stop[k] - seg.start[k]
            begin = np.cumsum(size) - size
            text = buf[np.repeat(seg.start[k] - begin, size) + np.arange(size.sum())]
            bodies.append((
                bucket, np.array([len(k)], np.int64).tobytes() + seg.anchor[k].tobytes() + size.astype(np.uint32).tobytes() + (seg.anchor_at[k] - seg.start[k]).astype(np.uint32).tobytes()
                + (code[wanted[i]] & RECURS).tobytes() + text.tobytes(),
            ))
        h, n = np.unique(_strings(buf, seg, code, length)[1], return_counts=True)
        for bucket, i in by_bucket(h, buckets):
            bodies.append((fine + bucket, np.array([-len(i)], np.int64).tobytes() + h[i].tobytes() + (n[i] > 1).tobytes()))
        bodies.append((-1 - number % fine, code.tobytes()))
        return pa.Table.from_batches([asked(number, iter(bodies))])

    return with_replies(dealt, replies, send, ASKED)


@dataclass
class RunLengthIndex:
    """Samples at the ends of the runs of a Burrows-Wheeler transform.

    head_at, head_match: text position of the first suffix of each run, and its common prefix
    with the suffix before it; tail_at, tail_match: the last one, and the suffix after it.
    """

    symbol: np.ndarray
    run: np.ndarray
    head_at: np.ndarray
    head_match: np.ndarray
    tail_at: np.ndarray
    tail_match: np.ndarray

    def matching_statistics(self, n: int) -> np.ndarray:
        """For every text position, the longest match that starts elsewhere."""
        return np.maximum(_stream(self.head_at, self.head_match, n), _stream(self.tail_at, self.tail_match, n))


def _stream(at: np.ndarray, match: np.ndarray, n: int) -> np.ndarray:
    """From each sample on, the match falls by one with every byte, until the next sample."""
    reach = np.full(n, -1, np.int64)
    reach[at] = at + match
    sample = np.full(n, -1, np.int64)
    sample[at] = at
    sample = np.maximum.accumulate(sample)
    return np.where(sample >= 0, np.maximum(reach[sample] - np.arange(n), 0), 0)


def _eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number, zeros past the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(len(text), np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + len(text)]
    return key


def suffix_array(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the compared length of those still tied."""
    n = len(text)
    order = np.argsort(key)
    k = key[order]
    # A rank is one more than the place of its group's first suffix; beyond the text it is 0.
    new = np.concatenate([[True], k[1:] != k[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = start + 1
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    h = 8
    while len(tied):
        suffix = order[tied]
        pair = (rank[suffix].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(suffix + h, n)].astype(np.uint64)
        by = np.argsort(pair)
        pair, suffix = pair[by], suffix[by]
        order[tied] = suffix
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        start = np.maximum.accumulate(np.where(new, tied, 0))
        rank[suffix] = start + 1
        tied = tied[~(new & np.append(new[1:], True))]
        h *= 2
    return order


def common_prefix(key: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes i and j, i != j; key as _eights() gives it."""
    n = len(key)
    out = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        a, b = i[live] + out[live], j[live] + out[live]
        inside = (a < n) & (b < n)
        x = key[np.minimum(a, n - 1)] ^ key[np.minimum(b, n - 1)]
        same = np.where(x == 0, 8, 0)
        differ = x != 0
        # The number of leading zero bytes, by the exponent of the float nearest to the highest set bit.
        top = np.zeros(len(x), np.int64)
        v = x[differ]
        high = (v >> np.uint64(32)) != 0
        bits = np.where(high, np.frexp((v >> np.uint64(32)).astype(float))[1] + 32, np.frexp((v & np.uint64(0xFFFFFFFF)).astype(float))[1])
        top[differ] = (64 - bits) // 8
        step = np.where(differ, top, same)
        step = np.minimum(step, np.maximum(np.minimum(n - a, n - b), 0))
        out[live] += np.where(inside, step, 0)
        live = live[inside & ~differ & (step == 8)]
    return out


def build_index(text: np.ndarray) -> RunLengthIndex:
    key = _eights(text)
    order = suffix_array(text, key)
    bwt = np.where(order > 0, text[order - 1].astype(np.int16), np.int16(-1))
    head = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
    tail = np.append(head[1:], len(bwt)) - 1
    before = np.zeros(len(head), np.int64)
    before[1:] = common_prefix(key, order[head[1:]], order[head[1:] - 1])
    after = np.append(before[1:], 0)
    return RunLengthIndex(bwt[head], tail - head + 1, order[head], before, order[tail], after)


def recurring_strings(texts: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """For segments laid end to end: does the string at each position start anywhere else too?"""
    begin = np.cumsum(size) - size
    at = np.arange(len(texts)) + np.repeat(np.arange(len(size)), size)
    joined = np.full(len(texts) + len(size), SEPARATOR, np.uint8)
    joined[at] = texts
    long_enough = np.arange(len(texts)) - np.repeat(begin, size) + length <= np.repeat(size, size)
    return (build_index(joined).matching_statistics(len(joined))[at] >= length) & long_enough


def _blocks(anchor: np.ndarray, size: np.ndarray, begin: np.ndarray, text: np.ndarray, anchor_at: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """Segments to index together, sorted by anchor; some in two blocks."""
    cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    block: list[np.ndarray] = []
    held = 0
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(anchor)).tolist()):
        group = np.arange(a, b)
        total = int(size[a:b].sum())
        if b - a < 2:
            continue
        if total > BLOCK:
            side = (length - GRAM) // 2
            prefix = prefix_hash(byte_values(text[begin[a] : begin[b - 1] + size[b - 1]]))
            for left in (True, False):
                lo = begin[group] - begin[a] + anchor_at[group] + (-side if left else GRAM)
                there = (anchor_at[group] >= side) if left else (anchor_at[group] + GRAM + side <= size[group])
                h = range_hash(prefix, lo[there], lo[there] + side)
                own = group[there][np.argsort(h, kind="stable")]
                h = np.sort(h)
                part = np.split(own, np.flatnonzero(h[1:] != h[:-1]) + 1)
                yield from _gathered([p for p in part if len(p) > 1], size)
            continue
        if held + total > BLOCK and block:
            yield np.concatenate(block)
            block, held = [], 0
        block.append(group)
        held += total
    if block:
        yield np.concatenate(block)


def _gathered(parts: list[np.ndarray], size: np.ndarray) -> Iterator[np.ndarray]:
    block: list[np.ndarray] = []
    held = 0
    for p in parts:
        total = int(size[p].sum())
        if held + total > BLOCK and block:
            yield np.concatenate(block)
            block, held = [], 0
        block.append(p)
        held += total
    if block:
        yield np.concatenate(block)


def _compare(length: int):
    def reply(bodies: list[bytes], _: np.ndarray) -> list[bytes]:
        """For each segment that a slab sent and that does not recur as a whole, a bit for each of its strings; or one for each hash of a string."""
        if np.frombuffer(bodies[0], np.int64, 1)[0] < 0:
            cuts = np.cumsum([-int(np.frombuffer(b, np.int64, 1)[0]) for b in bodies])[:-1]
            return [np.packbits(x).tobytes() for x in np.split(_several(bodies)[0], cuts)]
        parts = []
        for b in bodies:
            n = int(np.frombuffer(b, np.int64, 1)[0])
            parts.append((np.frombuffer(b, np.uint64, n, 8), np.frombuffer(b, np.uint32, n, 8 + 8 * n), np.frombuffer(b, np.uint32, n, 8 + 12 * n), np.frombuffer(b, np.uint8, n, 8 + 16 * n), np.frombuffer(b, np.uint8, -1, 8 + 17 * n)))
        anchor, size, anchor_at, done = (np.concatenate([p[k] for p in parts]) for k in range(4))
        size, anchor_at = size.astype(np.int64), anchor_at.astype(np.int64)
        text = np.concatenate([p[4] for p in parts])
        begin = np.cumsum(size) - size
        by = np.argsort(anchor, kind="stable")
        s = size[by]
        b = np.cumsum(s) - s
        dealt = text[np.repeat(begin[by] - b, s) + np.arange(len(text))]
        found = np.zeros(len(text), bool)
        for block in _blocks(anchor[by], s, b, dealt, anchor_at[by], length):
            own = s[block]
            at = np.repeat(b[block] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            found[at] |= recurring_strings(dealt[at], own, length)
        # Back in the order asked, only the strings of segments that need an answer.
        back = found[np.repeat(b[np.argsort(by)] - begin, size) + np.arange(len(text))]
        strings = (np.arange(len(text)) - np.repeat(begin, size) + length <= np.repeat(size, size)) & np.repeat(done == 0, size)
        cuts = np.cumsum([len(p[4]) for p in parts])[:-1]
        return [np.packbits(f[k]).tobytes() for f, k in zip(np.split(back, cuts), np.split(strings, cuts))]

    return reply


def _remove(dealt: Dealt, replies: DataFrame, length: int) -> DataFrame:
    buckets, fine = dealt.buckets, dealt.buckets * FINER

    def finish(number: int, rows: pa.Table, by: dict[int, bytes]) -> pa.Table:
        buf, begin, end, seg = segments(rows, length)
        code = np.frombuffer(by.get(-1 - number % fine, b""), np.uint8)
        mark = np.zeros(len(buf) + 1, np.int64)
        whole = np.repeat(code & RECURS, seg.count) > 0
        np.add.at(mark, seg.start[whole], 1)
        np.add.at(mark, seg.stop[whole], -1)
        wanted = np.flatnonzero(code & (WANTED | LARGE) == WANTED)
        one = seg.first[wanted]
        for bucket, i in by_bucket(seg.anchor[one], fine):
            k = one[i][code[wanted[i]] & RECURS == 0]
            strings = seg.stop[k] - seg.start[k] - length + 1
            total = int(strings.sum())
            bits = np.unpackbits(np.frombuffer(by[bucket], np.uint8), count=total).astype(bool) if total else np.zeros(0, bool)
            starts = (np.repeat(seg.start[k] - (np.cumsum(strings) - strings), strings) + np.arange(total))[bits]
            np.add.at(mark, starts, 1)
            np.add.at(mark, starts + length, -1)
        starts, h = _strings(buf, seg, code, length)
        asked_for, at = np.unique(h, return_inverse=True)
        recurs = np.zeros(len(asked_for), bool)
        for bucket, i in by_bucket(asked_for, buckets):
            recurs[i] = np.unpackbits(np.frombuffer(by[fine + bucket], np.uint8), count=len(i))
        np.add.at(mark, starts[recurs[at]], 1)
        np.add.at(mark, starts[recurs[at]] + length, -1)
        gone = np.cumsum(mark)[:-1] > 0
        n = rows.num_rows
        size = (end - begin)[:n]
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[end[:n]] - total[begin[:n]]
        first, _ = spans_from_mask(gone)
        spans = np.searchsorted(first, end[:n]) - np.searchsorted(first, begin[:n])
        sha = [hashlib.sha256(buf[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(begin[:n].tolist(), end[:n].tolist())]
        answers = pa.Table.from_arrays([rows.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array(sha, pa.string())], names=OUT.names)
        return repeated(answers, rows.column("copies"))

    return with_replies(dealt, replies, finish, OUT)


def remove_recurring(docs: DataFrame, *, length: int = 200, block: int = BLOCK) -> DataFrame:
    """Per document: bytes, bytes removed, removed runs, and the hash of what is kept.

    length: over GRAM.  block: bytes of segments that a bucket compares for one anchor, at most.
    """
    dealt = deal(keyed(docs), asked_share=0.25)
    judged = answer(_ask_segments(dealt, length), dealt, _judge(block))
    compared = answer(_send_wanted(dealt, judged, length), dealt, _compare(length))
    return _remove(dealt, compared, length)
