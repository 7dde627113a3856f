"""Token counts of byte-level BPE by rank-synchronous array merging.

A batch of texts is laid end to end as UTF-8 bytes.  Its pre-tokens are found with array
operations on the classes of its code points, and its distinct pre-tokens are held as one ragged
array of symbols, at first one a byte.  In every round each sequence's adjacent pair of lowest
rank is merged, wherever it stands in the sequence, in all sequences at once; a sequence with no
pair left to merge leaves the array, and its surviving symbols are its tokens.

That gives what merging one pair at a time gives, since a pair that holds a new symbol always
has a greater rank than the pair the symbol was made of; `Merges` checks this of a vocabulary.
A sequence of over `LONG` bytes would need very many rounds over itself: such sequences hold
the places of their pairs by rank instead and take ranks in ascending order, so that a round
touches only the places it changes.

Rows are independent: one pass over the input, no shuffle.  Memory is bounded by the batch (a
text of over `PIECE` code points is cut where a run of white space starts, which no pre-token
spans; a run without white space is held whole).

Defined cases: null texts are empty and have no tokens; added special tokens that stand inside
a text count one each and part it, as is the tokenizer's default; repeated rows are each
counted; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterline.llm.common import schema, scored
from raterline.llm.textvec import byte_values, prefix_hash, range_hash, slab

#: No pair to merge.
NONE = np.int32(2**31 - 1)
LONG, PIECE = 512, 1 << 20
COUNTS = schema(n_bytes="long", n_tokens="long")
BLANK, LETTER, NUMBER, OTHER = range(4)


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256)]


@dataclass
class Merges:
    """Ranks of pairs of symbols: bytes are 0 to 255, what the merge of rank r makes is 256 + r."""

    keys: np.ndarray
    of_key: np.ndarray
    of_bytes: np.ndarray

    @classmethod
    def read(cls, model: dict) -> Merges:
        symbol = {letter: b for b, letter in enumerate(byte_letters())}
        pairs = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if a not in symbol or b not in symbol or a + b in symbol:
                raise ValueError(f"merge {rank} has parts that no earlier merge makes, or makes a symbol anew")
            pairs.append((symbol[a], symbol[b]))
            symbol[a + b] = 256 + rank
        ab = np.array(pairs, np.int64).reshape(-1, 2)
        keys = (ab[:, 0] << 32) | ab[:, 1]
        order = np.argsort(keys)
        table = np.full((256, 256), NONE, np.int32)
        both = np.flatnonzero((ab < 256).all(axis=1))
        table[ab[both, 0], ab[both, 1]] = both
        return cls(keys[order], order.astype(np.int32), table)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), NONE, np.int32)
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.of_key[at], NONE).astype(np.int32)


def leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of sorted places, those to merge from left to right; after: the place that each would merge with.

    A place whose partner is the next place overlaps it, as in `aaa`: of such a run every other one stays.
    """
    joined = np.zeros(len(at), bool)
    joined[1:] = after[:-1] == at[1:]
    if not joined.any():
        return np.ones(len(at), bool)
    number = np.arange(len(at))
    return (number - np.maximum.accumulate(np.where(joined, 0, number))) % 2 == 0


def surviving(sym: np.ndarray, size: np.ndarray, merges: Merges) -> np.ndarray:
    """Symbols left of each sequence; sym: their bytes end to end (int32), size: bytes of each, none empty."""
    count, ids = size.copy(), np.arange(len(size))
    last = np.zeros(len(sym), bool)
    last[np.cumsum(size) - 1] = True
    rank = np.full(len(sym), NONE, np.int32)
    at = np.flatnonzero(~last)
    rank[at] = merges.of_bytes[sym[at], sym[at + 1]]
    while len(sym):
        low = np.minimum.reduceat(rank, np.cumsum(size) - size)
        live = low < NONE
        if not live.all():
            count[ids[~live]] = size[~live]
            kept = np.repeat(live, size)
            sym, rank, last, ids, size, low = sym[kept], rank[kept], last[kept], ids[live], size[live], low[live]
            if not len(sym):
                break
        at = np.flatnonzero(rank == np.repeat(low, size))
        at = at[leftmost(at, at + 1)]
        size = size - np.add.reduceat(np.bincount(at, minlength=len(sym)), np.cumsum(size) - size)
        sym[at], last[at] = 256 + rank[at], last[at + 1]
        kept = np.ones(len(sym), bool)
        kept[at + 1] = False
        sym, rank, last = sym[kept], rank[kept], last[kept]
        new = at - np.arange(len(at))
        rank[new] = NONE
        # Pairs to the right of a new symbol and to its left, where there are such within the sequence.
        touched = np.concatenate([new, new[new > 0] - 1])
        touched = touched[~last[touched]]
        rank[touched] = merges.ranks(sym[touched], sym[touched + 1])
    return count


def surviving_long(raw: np.ndarray, merges: Merges) -> int:
    """The same for one long sequence of bytes: ranks in ascending order, each with the places where it stands."""
    n = len(raw)
    sym, right, left = raw.astype(np.int32), np.arange(1, n + 1), np.arange(-1, n - 1)
    alive = np.ones(n + 1, bool)
    alive[n] = False
    places: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(at: np.ndarray, rank: np.ndarray) -> None:
        at, rank = at[rank < NONE], rank[rank < NONE]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank, prepend=-1))
        for r, part in zip(rank[cuts].tolist(), np.split(at, cuts[1:])):
            if r not in places:
                places[r] = []
                heapq.heappush(heap, r)
            places[r].append(part)

    add(np.arange(n - 1), merges.of_bytes[sym[:-1], sym[1:]])
    left_over = n
    while heap:
        r = heapq.heappop(heap)
        at = np.unique(np.concatenate(places.pop(r)))
        at = at[alive[at] & (right[at] < n)]
        at = at[merges.ranks(sym[at], sym[right[at]]) == r]
        at = at[leftmost(at, right[at])]
        partner = right[at]
        sym[at], alive[partner] = 256 + r, False
        right[at] = right[partner]
        left[right[at][right[at] < n]] = at[right[at] < n]
        left_over -= len(at)
        touched = np.unique(np.concatenate([at, left[at][left[at] >= 0]]))
        touched = touched[right[touched] < n]
        add(touched, merges.ranks(sym[touched], sym[right[touched]]))
    return left_over


class Splitter:
    """Pre-tokens of a byte-level tokenizer, found by array operations.

    The rule: a contraction ('s 't 're 've 'm 'll 'd), else letters, numbers or other marks with
    one space before them, else a run of white space less the last one before a word.  What
    class a code point beyond ASCII is in is asked of the tokenizer once for each.
    """

    def __init__(self, pre_tokenize):
        self.pre_tokenize = pre_tokenize
        self.kinds = np.full(0x110000, -1, np.int8)
        self.learn(np.arange(128))

    def learn(self, points: np.ndarray) -> None:
        for c in map(int, points):
            after = lambda lead: len(self.pre_tokenize(lead + chr(c))) == 1
            self.kinds[c] = LETTER if after("a") else NUMBER if after("1") else OTHER if after("!") else BLANK

    def starts(self, point: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Which code points start a pre-token; begin: which start a text."""
        n = len(point)
        kind = self.kinds[point]
        if (kind < 0).any():
            self.learn(np.unique(point[kind < 0]))
            kind = self.kinds[point]
        out = begin.copy()
        out[1:] |= kind[1:] != kind[:-1]
        blank = kind == BLANK
        # The last of a run of blanks that a word of the same text follows.
        end = np.flatnonzero(blank[:-1] & ~blank[1:] & ~begin[1:])
        out[end] = True
        out[end[point[end] == 32] + 1] = False
        letters = np.concatenate([point, np.zeros(3, point.dtype)])
        same = np.concatenate([(kind == LETTER) & ~begin, np.zeros(3, bool)])
        mark = np.flatnonzero((point == 39) & out)
        mark = mark[same[mark + 1]]
        one = mark[np.isin(letters[mark + 1], [ord(c) for c in "stmd"])]
        two = mark[same[mark + 2]]
        pair = letters[two + 1].astype(np.int64) * 256 + letters[two + 2]
        two = two[np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])]
        for at, width in ((one, 2), (two, 3)):
            out[at + 1] = False
            rest = at + width
            out[rest[same[rest]]] = True
        return out[:n]


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of valid UTF-8, byte place of each)."""
    if not len(buf) or buf.max() < 128:
        return buf.astype(np.int32), np.arange(len(buf))
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[at].astype(np.int32)
    width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    point = np.where(width == 1, lead, lead & (0x7F >> width))
    for k in (1, 2, 3):
        more = np.flatnonzero(width > k)
        point[more] = (point[more] << 6) | (buf[at[more] + k] & 0x3F)
    return point.astype(np.int32), at


class Counter:
    """Numbers of tokens of whole texts; one for each worker and vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        pre = file["pre_tokenizer"] or {}
        if file["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or file["normalizer"]:
            raise ValueError(f"not a plain byte-level BPE: {path}")
        added = file["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in what stands beside them are not supported")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.merges = Merges.read(file["model"])
        self.splitter = Splitter(tokenizer.pre_tokenizer.pre_tokenize_str)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        odd = size > PIECE
        if self.special:
            odd |= np.asarray(pc.fill_null(pc.match_substring_regex(texts, self.special.pattern), False).to_numpy(zero_copy_only=False), bool)
        if not odd.any():
            return self.plain(texts)
        count = self.plain(pc.if_else(pa.array(odd), pa.scalar(None, texts.type), texts))
        for i in np.flatnonzero(odd).tolist():
            parts = self.special.split(texts[i].as_py()) if self.special else [texts[i].as_py()]
            count[i] = len(parts) - 1
            for piece in (p for part in parts for p in pieces(part)):
                count[i] += int(self.plain(pa.array([piece]))[0])
        return count

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Tokens of texts in which no special string stands."""
        s = slab(texts)
        if not len(s.buf):
            return np.zeros(len(texts), np.int64)
        point, place = code_points(s.buf)
        begin = np.zeros(len(s.buf) + 1, bool)
        begin[s.start] = begin[s.end] = True  # the newline after a text is on its own, and is left out below
        at = place[self.splitter.starts(point, begin[:-1][place])]
        stop = np.append(at[1:], len(s.buf))
        of = np.searchsorted(s.start, at, side="right") - 1
        real = at < s.end[of]
        at, stop, of = at[real], stop[real], of[real]
        if not len(at):
            return np.zeros(len(texts), np.int64)
        h = range_hash(prefix_hash(byte_values(s.buf)), at, stop)
        _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        first, size = at[one], (stop - at)[one]
        count = np.empty(len(one), np.int64)
        long = size > LONG
        for i in np.flatnonzero(long).tolist():
            count[i] = surviving_long(s.buf[first[i] : first[i] + size[i]], self.merges)
        first, size = first[~long], size[~long]
        if len(size):
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
            count[~long] = surviving(s.buf[inside].astype(np.int32), size, self.merges)
        return np.bincount(of, count[inverse], len(texts)).astype(np.int64)


def pieces(text: str, most: int = PIECE):
    """Parts of a text that are tokenised alike apart and together: each begins with the first of a run of blanks."""
    at = 0
    while len(text) - at > most and (cut := _BEFORE_BLANK.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


_BEFORE_BLANK = re.compile(r"(?<=\S)[ \t\n\r]")


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, *, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether there are more than `limit` of them.

    tokenizer_path: a byte-level BPE vocabulary (JSON), at that place on every executor.
    """

    def each(texts: pa.Array) -> list[pa.Array]:
        return [pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(_counter(tokenizer_path)(texts))]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(rows, COUNTS, 1 << 20, each).withColumn("over_limit", F.col("n_tokens") > limit)
