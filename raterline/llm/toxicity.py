"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic examples and unlabelled texts are learned from.  The risk of calling a
text toxic is corrected by the class prior: with positives P, unlabelled texts U and prior
pi, the loss is  pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)),  the clipped part keeping a
flexible classifier from driving the estimate below zero.

Texts are sets of hashed words.  A linear classifier on the words that the positives
clearly favour (at least `least_z` standard deviations more often than unlabelled texts) is
fitted by gradient steps with soft thresholding, so that all but a few words have weight zero
and a long clean text gathers no score from its length.

Two things are read off texts left out of a fit: groups of near copies are dealt into folds,
and every text is scored by a fit on the other folds.  The prior is the least ratio of
unlabelled to positive texts above any score that enough positives reach, so confirmed clean
texts are not needed; and the bias is moved so that 0.5 stands where the corrected estimate,
with right or wrong in place of the logistic loss, is least; a missed toxic text counts
`miss_cost` times a clean one that is taken.

The fit uses bounded samples (`positives` confirmed and `unlabelled` other rows); every text is
scored whole, in one pass without a shuffle.

Defined cases: null and empty texts get the score of a text without words; rows without
doc_id are not learned from; without a confirmed positive every score is the prior's floor, 0;
repeated rows get equal scores; an empty table gives an empty result; columns named score or
predicted give way to the new ones in score(), all others stay; without() keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterline.llm.common import schema, scored, unused, written
from raterline.llm.sampling import by_class, sizes
from raterline.llm.textvec import byte_values, mix, prefix_hash, range_hash, slab, slices, words

BITS = 20


def _word_table() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[97:123] = inside[48:58] = inside[128:] = True
    return lower, inside


_LOWER, _INSIDE = _word_table()


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hash, text number) of every word: letters of any script and digits, ASCII in lower case."""
    s = slab(texts)
    s.buf = _LOWER[s.buf]
    first, last, of = words(s, _INSIDE)
    return range_hash(prefix_hash(byte_values(s.buf)), first, last) >> np.uint64(64 - BITS), of


@dataclass
class WordModel:
    """Weights of all hashed words, nearly all zero, and a bias; fixed in size."""

    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        word, of = hashed_words(texts)
        w = self.weights[word.astype(np.int64)]
        hit = np.flatnonzero(w)
        total = np.full(len(texts), self.bias, float)
        if len(hit):
            pairs = np.unique((of[hit].astype(np.uint64) << np.uint64(BITS)) | word[hit])
            np.add.at(total, (pairs >> np.uint64(BITS)).astype(np.int64), self.weights[(pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _sets(df: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """(word sets, labels) of a bounded sample of (label, text) rows, hashed where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b)):
            word, of = hashed_words(part.column(1))
            pairs = np.unique((of.astype(np.uint64) << np.uint64(BITS)) | word)
            cuts = np.searchsorted(pairs >> np.uint64(BITS), np.arange(1, part.num_rows))
            found = [p.astype("<u4").tobytes() for p in np.split((pairs & np.uint64((1 << BITS) - 1)), cuts)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["label", "words"])

    rows = sorted((r["label"], bytes(r["words"])) for r in df.mapInArrow(run, schema(label="int", words="binary")).collect())
    return [np.frombuffer(w, "<u4").astype(np.int64) for _, w in rows], np.array([y for y, _ in rows], int)


def fit(docs: DataFrame, positive: DataFrame, prior: float | None = None, *, exclude: Column | None = None, positives: int = 3000, unlabelled: int = 9000, most_bytes: int = 1 << 26) -> WordModel | None:
    """Fit on confirmed positives (a DataFrame of doc_id) and unlabelled texts.

    prior: the share of toxic texts; estimated if not given.  exclude: a condition on docs for
    rows never to learn from, labelled or not.  At most about `positives` and `unlabelled` rows
    are used, drawn by a hash of doc_id, and about `most_bytes` of the texts of either; long texts
    are drawn at a lower share, as sampling.by_class has it.
    """
    pool = docs.where(F.col("doc_id").isNotNull()) if exclude is None else docs.where(F.col("doc_id").isNotNull() & ~exclude)
    pool = pool.select("doc_id", F.col("text").cast("string").alias("text"))
    sized = sizes(pool)
    labelled = sized.join(positive.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("label", F.lit(1))
    draw = lambda rows, most, seed: by_class(rows, "label", most, seed, most_bytes=most_bytes).select("doc_id", "label").distinct()
    # Bounded by `positives` and `unlabelled`, so broadcast: no text is shuffled.
    chosen = written(draw(labelled, positives, "toxic").unionByName(draw(sized.withColumn("label", F.lit(0)), unlabelled, "unlabelled")), "chosen")
    sets, y = _sets(pool.join(F.broadcast(chosen), "doc_id").select("label", "text"))
    if not (y == 1).any() or not (y == 0).any():
        return None
    return fit_sets(sets, y, prior)


def copy_groups(sets: list[np.ndarray], bands: int = 30, rows: int = 8) -> np.ndarray:
    """A number for each set, the same for near copies: minhash bands find them, groups close under them."""
    n = len(sets)
    if not n:
        return np.zeros(0, np.int64)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.uint64)
    begin = np.cumsum(size) - size
    filled = np.flatnonzero(size)
    group = np.arange(n)
    for band in range(bands):
        key = np.zeros(len(filled), np.uint64)
        for r in range(rows):
            key = mix(key + np.minimum.reduceat(mix(flat + np.uint64((band * rows + r + 1) << BITS)), begin[filled]))
        _, same = np.unique(key, return_inverse=True)
        for _ in range(2):
            least = np.full(same.max() + 1, n)
            np.minimum.at(least, same, group[filled])
            group[filled] = np.minimum(group[filled], least[same])
            group = group[group]
    return group


def copy_weights(sets: list[np.ndarray]) -> np.ndarray:
    """1 / (number of near copies of each set)."""
    _, same, count = np.unique(copy_groups(sets), return_inverse=True, return_counts=True)
    return 1 / count[same] if len(sets) else np.zeros(0)


def least_ratio(z: np.ndarray, y: np.ndarray, each: np.ndarray, reached: float = 0.5) -> float:
    """The prior by which positives explain all unlabelled texts above some score: the least U(z >= c) / P(z >= c).

    Only scores count that a share `reached` of the positives attain; it lies within 0.001 and 0.5.
    """
    level = np.unique(z)
    above = [each[y == s].sum() and np.array([np.cumsum(np.bincount(np.searchsorted(level, z[y == s]), each[y == s], minlength=len(level))[::-1])[::-1] / each[y == s].sum()])[0] for s in (0, 1)]
    fine = above[1] >= reached
    return float(np.clip((above[0][fine] / above[1][fine]).min(), 0.001, 0.5)) if fine.any() else 0.1


def least_risk_cut(z: np.ndarray, y: np.ndarray, each: np.ndarray, prior: float, miss_cost: float = 3.0) -> float:
    """The cut through scores z of least corrected zero-one risk, midway between two scores.

    The risk is  miss_cost * pi * P(z < cut) + max(0, U(z >= cut) - pi * P(z >= cut)).  Of equal
    cuts the lowest is taken; scores that are all the same are cut at 0.
    """
    level, of = np.unique(z, return_inverse=True)
    if len(level) < 2:
        return 0.0
    below = [np.cumsum(np.bincount(of[y == side], each[y == side], minlength=len(level)))[:-1] / each[y == side].sum() for side in (0, 1)]
    risk = miss_cost * prior * below[1] + np.maximum(0, (1 - below[0]) - prior * (1 - below[1]))
    least = int(risk.argmin())
    return float(level[least] + level[least + 1]) / 2


def fit_sets(sets: list[np.ndarray], y: np.ndarray, prior: float | None = None, *, folds: int = 3, miss_cost: float = 3.0) -> WordModel:
    """The same from word sets in memory: y is 1 for a positive, 0 for an unlabelled set."""
    group = copy_groups(sets)
    # A text copied many times speaks once: else its rare words would look like signs of its label.
    _, same, count = np.unique(group * 2 + y, return_inverse=True, return_counts=True)
    each = 1 / count[same]
    fold = (mix(group.astype(np.uint64) + np.uint64(1)) % np.uint64(folds)).astype(int)

    def left_out(pi: float) -> np.ndarray:
        z = np.zeros(len(y))
        for k in range(folds):
            rest = fold != k
            if (y[rest] == 1).any() and (y[rest] == 0).any():
                w, b = linear([s for s, r in zip(sets, rest) if r], y[rest], each[rest], pi)
                z[~rest] = [w[s].sum() + b for s, r in zip(sets, rest) if not r]
        return z

    if prior is None:
        prior = least_ratio(left_out(0.1), y, each)
    w, b = linear(sets, y, each, prior)
    return WordModel(w, b - least_risk_cut(left_out(prior), y, each, prior, miss_cost))


def linear(sets: list[np.ndarray], y: np.ndarray, each: np.ndarray, prior: float, *, rounds: int = 400, rate: float = 0.05, shrink: float = 5e-4, least_z: float = 5.0) -> tuple[np.ndarray, float]:
    """(weights of all hashed words, bias) of least non-negative risk; each: the sets' weights."""
    size = np.array([len(s) for s in sets])
    flat, of = np.concatenate([*sets, np.zeros(0, np.int64)]), np.repeat(np.arange(len(sets)), size)
    p, u = float(each[y == 1].sum()), float(each[y == 0].sum())
    in_p = np.bincount(flat, np.where(y[of] == 1, each[of], 0), minlength=1 << BITS)
    in_u = np.bincount(flat, np.where(y[of] == 0, each[of], 0), minlength=1 << BITS)
    share = (in_p + 0.5) / (p + 1)
    lift = np.log(share / ((in_u + 0.5) / (u + 1)))
    expected = p * (in_u + 0.5) / (u + 1)
    clear = (in_p >= 3) & (lift >= np.log(2)) & ((in_p - expected) / np.sqrt(expected) >= least_z)
    kept = np.flatnonzero(clear)
    column = np.full(1 << BITS, -1)
    column[kept] = np.arange(len(kept))
    has = column[flat] >= 0
    x = np.zeros((len(sets), len(kept)), np.float32)
    x[of[has], column[flat[has]]] = 1
    w, b = np.zeros(len(kept)), float(np.log(prior / (1 - prior)))
    moment, second = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    positive = y == 1
    for step in range(1, rounds + 1):
        z = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30)))
        # Logistic loss: d/dz of loss(+) is s - 1, of loss(-) is s.
        loss_minus = -np.log1p(-np.minimum(z, 1 - 1e-7))
        negative_risk = (each * loss_minus)[~positive].sum() / u - prior * (each * loss_minus)[positive].sum() / p
        g = np.where(positive, prior * (z - 1) / p, 0.0)
        if negative_risk >= 0:
            g = g + np.where(positive, -prior * z / p, z / u)
        g = g * each
        grad = np.append(x.T @ g.astype(np.float32), g.sum())
        moment = 0.9 * moment + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * shrink, 0)
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = w
    return weights, b


def score(docs: DataFrame, model: WordModel | None, *, threshold: float = 0.5) -> DataFrame:
    """score and predicted for every row, beside the row's own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(texts: pa.Array) -> list[pa.Array]:
        s = np.zeros(len(texts)) if shared.value is None else shared.value.score(texts)
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return scored(docs, schema(score="double", predicted="int"), 1 << 19, each, keep_text=True)


def without(docs: DataFrame, model: WordModel | None, *, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns as they are, that score under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pa.RecordBatch.from_arrays(batch.columns, names=[f"{i}" for i in range(batch.num_columns)])
            for part in slices(named, f"{batch.num_columns - 1}"):
                s = np.zeros(part.num_rows) if shared.value is None else shared.value.score(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays(part.columns[:-1], names=names).filter(pa.array(s < threshold))

    return docs.select(*(F.col(f"`{n}`") for n in names), F.col("text").cast("string").alias(unused(docs, "_"))).mapInArrow(run, docs.schema)
