"""Packing by power-of-two decomposition.

Every document's tokens are cut into pieces whose lengths are powers of two, the longest
allowed first; pieces of one length form a bucket, and a training batch draws from a single
bucket.  So no sequence holds tokens of two documents and nothing is padded.

Rows are independent: the work is one pass over the input without any shuffle.

Defined cases: a null text counts as empty and yields the single end token; repeated rows are
packed once each, with sequence ids of their own; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterline.llm.common import schema
from raterline.llm.textvec import byte_values, prefix_hash, range_hash, slab, slices

PIECES = schema(doc_id="long", start="long", length="long", ids_crc32="long", doc_tokens="long", tokens="array<int>")


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: its lower-case form, and its class (0 blank, 1 letter, 2 digit, 3 mark, 4 any other)."""
    lower, kind = np.arange(256, dtype=np.uint8), np.full(256, 3, np.uint8)
    lower[65:91] += 32
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[97:123] = kind[65:91] = 1
    kind[48:58] = 2
    kind[128:] = kind[ord("'")] = 4
    return lower, kind


_LOWER, _KIND = _byte_classes()


class ChunkEncoder:
    """Token ids of whole texts, by way of their distinct chunks.

    Right for tokenizers that lower-case, drop white space and split letters, digits and
    marks: then a text's ids are its chunks' ids in order, and each distinct chunk is encoded
    once.  Chunks with bytes beyond ASCII or apostrophes are cut at blanks only.  Within a
    batch chunks are told apart by a 64-bit hash; across batches by their bytes.
    """

    def __init__(self, path: str, most: int = 200_000, end_mark: str = "</w>"):
        self.tokenizer, self.most = _tokenizer(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(end_mark)]] = True
        self.known: dict[bytes, np.ndarray] = {}
        self.older: dict[bytes, np.ndarray] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, chunks: list[str]) -> list[np.ndarray]:
        """Chunks that are one word each go together, parted again at the tokens that end words."""
        single = [c.isalpha() for c in chunks]
        one = [c for c, yes in zip(chunks, single) if yes]
        ids = self._encode([" ".join(one[i : i + 256]) for i in range(0, len(one), 256)])
        flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
        stops = np.flatnonzero(self.ends[flat]) + 1
        if len(stops) != len(one):
            return self._encode(chunks)
        parts = iter(np.split(flat, stops[:-1]))
        rest = iter(self._encode([c for c, yes in zip(chunks, single) if not yes]))
        return [next(parts if yes else rest) for yes in single]

    def _each(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of distinct chunks; two generations of what was met lately are kept."""
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = []
        for c in chunks:
            if c not in known:
                if (x := older.get(c)) is None:
                    new.append(c)
                else:
                    known[c] = x
        known.update(zip(new, self._encode_chunks([c.decode() for c in new])))
        return [known[c] for c in chunks]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of each text in them)."""
        s = slab(texts)
        n = len(texts)
        # Blanks beyond ASCII and the tokenizer's own special strings do not follow the rule.
        if _odd(s.buf):
            ids = self._encode([t or "" for t in texts.to_pylist()])
            return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, ids)])
        buf = _LOWER[s.buf]
        kind = _KIND[buf]
        cut = np.empty(len(kind), bool)
        cut[:1] = True
        a, b = kind[:-1], kind[1:]
        cut[1:] = (a != b) & (((a != 4) & (b != 4)) | (a == 0) | (b == 0))
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(kind))
        real = kind[first] != 0
        first, last = first[real], last[real]
        of = np.searchsorted(s.start, first, side="right") - 1
        h = range_hash(prefix_hash(byte_values(buf)), first, last)
        _, rep, inverse = np.unique(h, return_index=True, return_inverse=True)
        raw = buf.tobytes()
        each = self._each([raw[a:b] for a, b in zip(first[rep].tolist(), last[rep].tolist())])
        size = np.array([len(x) for x in each], np.int64)
        at = np.cumsum(size) - size
        flat = np.concatenate([*each, np.zeros(0, np.uint32)])
        take = size[inverse]
        begin = np.cumsum(take) - take
        ids = flat[np.repeat(at[inverse] - begin, take) + np.arange(take.sum())]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(of, take, n).astype(np.int64))])


def _odd(buf: np.ndarray) -> bool:
    """Could these bytes hold a blank beyond ASCII, a control character or a special string?

    U+0085, U+00A0, U+1680, U+2000-U+200F, U+2028-U+202F, U+205F and U+3000 start with C2,
    E1, E2 or E3; combining marks (CC, CD and up) are safe since chunks start on their own.
    """
    raw = buf.tobytes()
    if b"<|" in raw:
        return True
    low = buf < 32
    if low.any() and not np.isin(buf[low], (9, 10, 13)).all():
        return True
    return bool(np.isin(buf, (0xC2, 0xE1, 0xE2, 0xE3)).any() and any(x in raw for x in _BLANK_BYTES))


_BLANK_BYTES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), *range(0x2028, 0x2030), 0x205F, 0x3000)]


def binary_lengths(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut each length into powers of two, longest first: (owner, piece length), in order."""
    bits = most.bit_length() - 1
    whole = n >> bits
    count = np.concatenate([whole[:, None], (n[:, None] >> np.arange(bits - 1, -1, -1)) & 1], axis=1)
    owner = np.repeat(np.arange(len(n)), count.sum(axis=1))
    length = np.repeat(np.tile(1 << np.arange(bits, -1, -1), len(n)), count.ravel())
    return owner, length


def pieces(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, most: int = 2048, with_tokens: bool = True) -> DataFrame:
    """One row per piece: its place in the document, its length and its tokens.

    most: the longest sequence, a power of two.  Null texts are empty: one piece, the end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ChunkEncoder(tokenizer_path)
        for batch in (part for b in batches for part in slices(b, most=1 << 20)):
            ids, offsets = encode(batch.column(1))
            n = len(offsets) - 1
            full = np.insert(ids, offsets[1:], end_id).astype("<u4")
            size = np.diff(offsets) + 1
            begin = np.cumsum(size) - size
            owner, length = binary_lengths(size, most)
            start = np.cumsum(length) - length
            raw = full.tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), (start + length).tolist())]
            tokens = pa.ListArray.from_arrays(pa.array(np.append(start, start[-1] + length[-1]) if n else [0], pa.int32()), pa.array(full.astype(np.int32))) if with_tokens else pa.nulls(len(owner), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), pa.array(start - begin[owner]), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[owner]), tokens], names=PIECES.names
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, most: int = 2048, with_tokens: bool = True) -> DataFrame:
    """Pieces as sequences: each piece is a sequence of its own, in the bucket of its length.

    sequence_id is unique within a result; it numbers rows by input partition, which stays
    the same when a lost task is run again.
    """
    return pieces(docs, tokenizer_path, end_id=end_id, most=most, with_tokens=with_tokens).withColumns(
        {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2(F.col("length")).cast("int")}
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Store sequences by bucket, so that a reader batches equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)
