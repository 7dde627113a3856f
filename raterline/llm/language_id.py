"""Language identification by nearest centroids.

Texts become TF-IDF vectors of hashed byte n-grams, scaled to unit length.  The texts of one
language are grouped by spherical k-means into several centroids; a text gets the language
of the centroid with the highest cosine.  A text further from its centroid than nearly all
training texts were is flagged as rejected.

The centroids are fitted on a bounded sample of labelled rows (`sample` a language, 20,000 in
all, see by_class); every language has its centroids, however many there are.  All texts are
scored whole, in one pass without a shuffle.

Defined cases: null texts and texts without a letter are `und` with score 0; rows without
doc_id or language are not learned from, whatever other rows of their doc_id say; with nothing to learn from, all rows are `und`; ties
go to the first centroid; repeated rows get equal answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterline.llm.common import schema, scored
from raterline.llm.sampling import by_class
from raterline.llm.textvec import slab, slices

DIMENSIONS = 4096


def _letters() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_LETTERS = _letters()


def counts(texts: pa.Array) -> np.ndarray:
    """Hashed counts of byte bigrams and trigrams per text: lower case, all but letters as blanks."""
    s = slab(texts)
    n = len(texts)
    b = _LETTERS[s.buf]
    # In two-byte capitals of Latin-1 (C3 80 to C3 9E) the second byte is 20 lower than in small letters.
    capital = np.zeros(len(b), bool)
    capital[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)
    b = np.where(capital, b + 32, b).astype(np.uint32)
    of = np.repeat(np.arange(n), s.end - s.start + 1)
    out = np.zeros((n, DIMENSIONS), np.float32)
    for width, salt in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        if len(b) < width:
            continue
        code = b[: len(b) - width + 1].copy()
        for k in range(1, width):
            code = (code << np.uint32(8)) | b[k : len(b) - width + 1 + k]
        inside = (of[: len(code)] == of[width - 1 :]) & (b[: len(code)] + b[width - 1 :] != 64)
        cell = (code * np.uint32(salt)) >> np.uint32(20)
        out += np.bincount(of[: len(code)][inside] * DIMENSIONS + cell[inside], minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    return out


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=1 << 19):
            for at in range(0, part.num_rows, rows):
                yield part.slice(at, rows)


@dataclass
class Centroids:
    """A fitted model: bounded arrays, small enough to travel with the tasks."""

    languages: list[str]
    idf: np.ndarray
    vectors: np.ndarray
    of: np.ndarray
    least: np.ndarray

    def cosines(self, texts: pa.Array) -> np.ndarray:
        return unit(np.log1p(counts(texts)) * self.idf) @ self.vectors.T


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-9)


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """k unit centroids of the unit rows of x; starts from rows far from each other."""
    start = [int(np.argmax(x @ unit(x.mean(axis=0, keepdims=True))[0]))]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin((x @ x[start].T).max(axis=1))))
    c = x[start]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.stack([unit(x[near == j].sum(axis=0, keepdims=True))[0] if (near == j).any() else c[j] for j in range(len(c))])
    return c, np.argmax(x @ c.T, axis=1)


def fit(rows: DataFrame, *, sample: int = 700, per_language: int = 3, reject: float = 0.002) -> Centroids | None:
    """Centroids from about `sample` labelled rows (doc_id, text, lang) per language.

    The texts are turned into vectors where they lie; only the sample's vectors reach the driver.
    """
    chosen = by_class(rows, "lang", sample, "language")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            x = counts(part.column(1)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in np.minimum(x, 65535).astype("<u2")], pa.binary())], names=["lang", "counts"])

    got = chosen.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(vectors, schema(lang="string", counts="binary")).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], bytes(r["counts"])))
    lang = np.array([r["lang"] for r in got])
    tf = np.stack([np.frombuffer(r["counts"], "<u2") for r in got]).astype(np.float32)
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    x = unit(np.log1p(tf) * idf)
    languages, found, of, least = sorted(set(lang.tolist())), [], [], []
    for i, name in enumerate(languages):
        own = x[lang == name]
        c, near = spherical_means(own, per_language)
        best = (own * c[near]).sum(axis=1)
        found.append(c)
        of += [i] * len(c)
        least += [float(np.quantile(best[near == j], reject)) if (near == j).any() else 0.0 for j in range(len(c))]
    return Centroids(languages, idf, np.concatenate(found).astype(np.float32), np.array(of), np.array(least))


def predict(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """lang_pred, score and rejected for every row, beside the row's own columns but the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(texts: pa.Array) -> list[pa.Array]:
        m, n = shared.value, len(texts)
        if m is None:
            return [pa.array(["und"] * n), pa.array([0.0] * n), pa.array([True] * n)]
        # A vector for each row: few at a time.
        cos = np.concatenate([np.zeros((0, len(m.of)), np.float32), *(m.cosines(texts.slice(i, 128)) for i in range(0, n, 128))])
        best = cos.argmax(axis=1)
        top = cos[np.arange(n), best]
        lettered = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False), bool)
        pred = np.array(m.languages, object)[m.of[best]]
        return [pa.array(np.where(lettered, pred, "und").tolist(), pa.string()), pa.array(np.where(lettered, np.clip(top, 0, 1), 0).astype(float)), pa.array(~lettered | (top < m.least[best]))]

    return scored(docs, schema(lang_pred="string", score="double", rejected="boolean"), 1 << 19, each)
