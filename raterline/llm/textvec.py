"""Vectorised text helpers that run inside Arrow batches on the executors.

Everything here works on one bounded slice of an Arrow string column: the UTF-8 bytes of
its texts laid end to end, with one newline after each, so that no word and no rolling hash
reaches from one text into the next.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2 = np.uint64(0xD1342543DE82EF95)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    up, down = _powers(size, int(base))
    return up, down


def prefix_hash(values: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Prefix sums from which range_hash() reads the hash of any stretch of values."""
    up, _ = powers(len(values) + 1, base)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of values[start:end], the same wherever that sequence stands."""
    _, down = powers(len(prefix), base)
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * _M2)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_BYTE2 = mix(np.arange(1, 257, dtype=np.uint64) * _BASE2)


def byte_values(buf: np.ndarray, second: bool = False) -> np.ndarray:
    return (_BYTE2 if second else _BYTE)[buf]


@dataclass
class Slab:
    """Texts laid end to end: text i is buf[start[i]:end[i]], then comes one newline."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray


def slab(texts: pa.Array) -> Slab:
    """The UTF-8 bytes of a string array."""
    texts = pc.fill_null(texts, "")
    joined = pc.binary_join_element_wise(texts.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = joined.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    buf = raw[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    return Slab(buf, offsets[:-1], offsets[1:] - 1)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about `most` bytes of text, or a single row."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < n:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def class_table(separators: str) -> np.ndarray:
    """256 booleans: True for the bytes that belong to words, False for those given."""
    table = np.ones(256, bool)
    table[np.frombuffer(separators.encode("latin-1"), np.uint8)] = False
    return table


#: Words are runs of anything but ASCII white space.
BLANKS = class_table(" \t\n\x0b\x0c\r")


def words(s: Slab, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every word, in order."""
    inside = table[s.buf]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return first, last, np.searchsorted(s.start, first, side="right") - 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def spans_from_mask(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
