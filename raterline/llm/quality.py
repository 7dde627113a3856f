"""Text quality by a byte-level convolutional network.

A text's bytes are embedded, and learned filters slide over all of them; the responses are
max-pooled over overlapping chunks that together cover the whole text, each chunk gets a
logit, and the mean, least and largest logit are combined into one probability.

Embedding and filters multiply out to one table of responses per filter tap and byte value,
so scoring is table look-ups and sums.  Training is plain numpy on a bounded sample of labelled
rows (`sample` rows and `sample_bytes` of text of either label), on all chunks of each text,
laid as they are for scoring; a text's chunks share its weight.  Max-pooling leaves one active
position per filter and chunk, so gradients are sparse.  Every text is scored whole, in one pass
without a shuffle.

Defined cases: null and empty texts are scored as a chunk without bytes; rows without doc_id
or label are not learned from; with fewer than two classes to learn from every score is the
share of label 1 (0.5 without any); repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterline.llm.common import schema, scored, written
from raterline.llm.sampling import by_class, sizes

WIDTH, BLOCK, PER_CHUNK, STRIDE = 6, 128, 4, 3
PAD = 0


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with WIDTH zero bytes after each text, where each text starts and the end)."""
    parts = [(t.as_buffer().to_pybytes() if t.is_valid else b"") + bytes(WIDTH) for t in texts]
    at = np.cumsum([0, *map(len, parts)])
    return np.frombuffer(b"".join(parts), np.uint8), at


@dataclass
class Network:
    """Taps[k, byte, filter], filter biases, chunk weights and the weights that combine chunks."""

    taps: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    combine: np.ndarray

    def responses(self, buf: np.ndarray) -> np.ndarray:
        n = len(buf) - WIDTH + 1
        out = self.taps[0][buf[:n]]
        for k in range(1, WIDTH):
            out += self.taps[k][buf[k : n + k]]
        return out

    def chunk_logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(logit, text number) of every chunk: PER_CHUNK blocks each, every STRIDE blocks."""
        buf, at = padded(texts)
        size = np.diff(at) - WIDTH
        blocks = np.maximum(1, -(-size // BLOCK))
        of = np.repeat(np.arange(len(size)), blocks)
        number = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = at[of] + number * BLOCK
        # A text's last block must not take in the padding, whose windows reach the next text.
        top = np.maximum.reduceat(self.responses(np.append(buf, np.zeros(WIDTH, np.uint8))), _bounds(begin, at[of] + np.minimum((number + 1) * BLOCK, np.maximum(size[of], 1))), axis=0)[::2]
        chunk = np.flatnonzero((number % STRIDE == 0) & ((number == 0) | (number + 1 < blocks[of])))
        pooled = top[chunk]
        for k in range(1, PER_CHUNK):
            there = np.minimum(chunk + k, len(of) - 1)
            pooled = np.where((of[there] == of[chunk])[:, None], np.maximum(pooled, top[there]), pooled)
        return np.maximum(pooled + self.bias, 0) @ self.weight + self.offset, of[chunk]

    def score(self, texts: pa.Array) -> np.ndarray:
        logit, of = self.chunk_logits(texts)
        n = len(texts)
        return sigmoid(summary(logit, of, n) @ self.combine)


def _bounds(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """begin and end in turn, for reduceat: every other result is a block's."""
    out = np.empty(2 * len(begin), np.int64)
    out[::2], out[1::2] = begin, end
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def summary(logit: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Per text: mean, least and largest chunk logit, and 1."""
    low, high = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(low, of, logit)
    np.maximum.at(high, of, logit)
    mean = np.bincount(of, logit, n) / np.maximum(np.bincount(of, minlength=n), 1)
    return np.column_stack([mean, low, high, np.ones(n)])


def train(chunks: np.ndarray, of: np.ndarray, y: np.ndarray, *, filters: int = 16, dimensions: int = 8, rounds: int = 12, rate: float = 0.01, seed: int = 7) -> Network:
    """chunks: equally long rows of bytes; of: each one's text; y: each text's label."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.5, (256, dimensions)).astype(np.float32)
    embed[PAD] = 0
    kernel = rng.normal(0, (2 / (WIDTH * dimensions)) ** 0.5, (WIDTH, dimensions, filters)).astype(np.float32)
    state = {"embed": embed, "kernel": kernel, "bias": np.zeros(filters, np.float32), "weight": rng.normal(0, 0.3, filters).astype(np.float32), "offset": np.zeros(1, np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in state.items()} for _ in range(2))
    label = y[of].astype(np.float32)
    # Every text counts once, whatever its length, and both labels count alike.
    share = 1 / np.bincount(of, minlength=len(y))[of]
    both = np.array([max(share[label == k].sum(), 1e-9) for k in (0, 1)])
    class_weight = (0.5 * len(of) * share / both[label.astype(int)]).astype(np.float32)
    n, length = chunks.shape
    step = 0
    for _ in range(rounds):
        order = rng.permutation(n)
        for at in range(0, n, 128):
            pick = order[at : at + 128]
            x = chunks[pick]
            taps = np.einsum("bd,kdf->kbf", state["embed"], state["kernel"])
            out = taps[0][x[:, : length - WIDTH + 1]]
            for k in range(1, WIDTH):
                out += taps[k][x[:, k : length - WIDTH + 1 + k]]
            where = out.argmax(axis=1)
            pooled = np.take_along_axis(out, where[:, None, :], axis=1)[:, 0, :] + state["bias"]
            active = np.maximum(pooled, 0)
            z = active @ state["weight"] + state["offset"]
            error = (sigmoid(z) - label[pick]) * class_weight[pick] / len(pick)
            back = (error[:, None] * state["weight"]) * (pooled > 0)
            table = np.zeros_like(taps)
            f = np.arange(back.shape[1])[None, :]
            for k in range(WIDTH):
                np.add.at(table[k], (np.take_along_axis(x, where + k, axis=1), np.broadcast_to(f, where.shape)), back)
            grads = {
                "embed": np.einsum("kbf,kdf->bd", table, state["kernel"]), "kernel": np.einsum("kbf,bd->kdf", table, state["embed"]), "bias": back.sum(axis=0),
                "weight": active.T @ error + 1e-4 * state["weight"], "offset": error.sum(keepdims=True),
            }
            grads["embed"][PAD] = 0
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                state[k] = (state[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    taps = np.einsum("bd,kdf->kbf", state["embed"], state["kernel"]).astype(np.float32)
    net = Network(taps, state["bias"], state["weight"], float(state["offset"][0]), np.array([1.0, 0, 0, 0]))
    logits = np.concatenate([
        np.maximum(sum(taps[k][chunks[i : i + 256, k : length - WIDTH + 1 + k]] for k in range(WIDTH)).max(axis=1) + net.bias, 0) @ net.weight + net.offset for i in range(0, n, 256)
    ])
    net.combine = logistic(summary(logits, of, len(y)), y)
    return net


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ w)
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * len(y) * 0.01 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, x.T @ (p - y) + ridge * len(y) * 0.01 * w), -2, 2)
    return w


def chunk_starts(size: int) -> range | list[int]:
    """Where the chunks of a text of so many bytes begin, as chunk_logits() lays them."""
    blocks = max(1, -(-size // BLOCK))
    return [k * BLOCK for k in range(0, blocks, STRIDE) if k == 0 or k + 1 < blocks]


def fit(docs: DataFrame, labelled: DataFrame, *, sample: int = 1200, sample_bytes: int = 4 << 20) -> Network | float:
    """Fit on about `sample` rows and `sample_bytes` of text, at most, of either label.

    docs: doc_id and text; labelled: doc_id and label (0 or 1), each doc_id once.  Chunks are cut
    where the texts lie; those of the sample, whole texts, reach the driver.
    """
    length = BLOCK * PER_CHUNK
    # Bounded by `sample`, so broadcast: no text is shuffled.
    chosen = written(by_class(sizes(docs).join(labelled, "doc_id"), "label", sample, "quality", most_bytes=sample_bytes).select("doc_id", "label").distinct(), "chosen")
    chosen = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(1):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                found.append([raw[a : a + length].ljust(length + WIDTH, b"\0") for a in chunk_starts(len(raw))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["label", "chunks"])

    cuts = chosen.select(F.col("label").cast("int"), F.col("text").cast("string")).mapInArrow(cut, schema(label="int", chunks="array<binary>"))
    got = sorted((r["label"], [bytes(c) for c in r["chunks"]]) for r in cuts.collect())
    y = np.array([label for label, _ in got], int)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    of = np.repeat(np.arange(len(got)), [len(c) for _, c in got])
    return train(np.frombuffer(b"".join(c for _, cs in got for c in cs), np.uint8).reshape(len(of), length + WIDTH), of, y)


def score(docs: DataFrame, model: Network | float, *, threshold: float = 0.3) -> DataFrame:
    """score and predicted for every row, beside the row's own columns but the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(texts: pa.Array) -> list[pa.Array]:
        m = shared.value
        s = np.full(len(texts), m) if isinstance(m, float) else m.score(texts)
        return [pa.array(s.astype(float)), pa.array((s >= threshold).astype(np.int32))]

    return scored(docs, schema(score="double", predicted="int"), 1 << 18, each)
