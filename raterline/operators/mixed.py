"""The linear mixed model with random coefficients of a polynomial in x, by REML.

y = (1, x, ...)(beta + b_rater) + noise, b ~ N(0, D); degree 1 gives random intercepts and
slopes, degree 2 random quadratics.  Power sums per rater hold all the data.  A step is one
aggregate over those rows: restricted likelihood, score and average information are forms in
sums that are taken at once for ratings and powers together, so the population line need not be
known before the pass.  The per-rater algebra runs vectorised in the tasks; some hundred numbers
a partition reach the driver.

Steps are Newton steps in the Cholesky factor of D and the logarithm of the noise, where a
variance of zero is an inner point; a step that lowers the likelihood is halved.  A model whose
information is singular (its variances cannot be told apart in the data) or that does not settle
gives way to a smaller one: full covariance, then independent effects, then without the highest
power's effect, then random intercepts alone.

Defined cases: raters of one row count; without raters, or where powers of x are not independent
over all rows, fit() raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class MixedModel:
    """covariance: of all powers' effects, zero for those that a smaller model leaves out; passes: over the power sums."""

    beta: np.ndarray
    covariance: np.ndarray
    noise: float
    beta_covariance: np.ndarray
    log_likelihood: float
    structure: str
    passes: int
    converged: bool


def power_sums(obs: DataFrame, *keys: str, degree: int = 1) -> DataFrame:
    """s0 ... s(2 degree), c0 ... c(degree) and yy per key; obs with cx and cy."""
    x, y = F.col("cx"), F.col("cy")
    power = lambda k: F.lit(1.0) if k == 0 else F.pow(x, F.lit(float(k)))
    return obs.groupBy(*keys).agg(*(F.sum(power(k)).alias(f"s{k}") for k in range(2 * degree + 1)), *(F.sum(power(k) * y).alias(f"c{k}") for k in range(degree + 1)), F.sum(y * y).alias("yy"))


def _names(degree: int) -> list[str]:
    return [*(f"s{k}" for k in range(2 * degree + 1)), *(f"c{k}" for k in range(degree + 1)), "yy"]


def _moments(batch: pa.RecordBatch, degree: int, scale: np.ndarray) -> np.ndarray:
    """Per rater the cross-products of (1, x, ..., y), powers scaled."""
    s = {n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(float) for n in _names(degree)}
    p = degree + 1
    out = np.empty((batch.num_rows, p + 1, p + 1))
    for i in range(p):
        for j in range(p):
            out[:, i, j] = s[f"s{i + j}"] * scale[i] * scale[j]
        out[:, i, p] = out[:, p, i] = s[f"c{i}"] * scale[i]
    out[:, p, p] = s["yy"]
    return out


def _summed(rows: DataFrame, step, degree: int) -> np.ndarray:
    """Sum of step(batch) over all batches: a short vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v = step(batch)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    got = rows.select(*_names(degree)).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r["v"] for r in got])


@dataclass
class _Shape:
    """q random effects, with a full or a diagonal covariance; cells: the free entries of its Cholesky factor."""

    q: int
    diagonal: bool

    @property
    def cells(self) -> list[tuple[int, int]]:
        return [(i, j) for i in range(self.q) for j in range(i + 1) if i == j or not self.diagonal]

    @property
    def bases(self) -> list[np.ndarray]:
        """Symmetric matrices, one for each free entry of the covariance."""
        out = []
        for i, j in self.cells:
            e = np.zeros((self.q, self.q))
            e[i, j] = e[j, i] = 1.0
            out.append(e)
        return out

    def factor(self, phi: np.ndarray) -> np.ndarray:
        low = np.zeros((self.q, self.q))
        for (i, j), v in zip(self.cells, phi):
            low[i, j] = v
        return low

    def name(self, p: int) -> str:
        return "intercept" if self.q == 1 else ("diagonal" if self.diagonal else "full") + ("" if self.q == p else f" to power {self.q - 1}")


def shapes(p: int) -> list[_Shape]:
    """Models from the largest to the smallest."""
    out = [_Shape(p, False), *([_Shape(p, True)] if p > 1 else [])]
    return out + [_Shape(q, False) for q in range(p - 1, 0, -1)]


def _forms(w: np.ndarray, d: np.ndarray, noise: float, shape: _Shape) -> np.ndarray:
    """What one batch of cross-products w adds to the sums of a pass, end to end; see _Pass for their use.

    With Z the columns of the random effects, W those of all powers and the ratings, and
    T = (noise + D Z'Z)^-1, the inverse covariance takes Z to Z T, so every term is small.
    """
    q, bases = shape.q, shape.bases
    g, zw = w[:, :q, :q], w[:, :q, :]
    t = np.linalg.inv(noise * np.eye(q) + d @ g)
    u = t.transpose(0, 2, 1) @ zw
    h = t @ d @ zw
    first = (w - zw.transpose(0, 2, 1) @ h) / noise
    left = zw - g @ h
    second = (w - zw.transpose(0, 2, 1) @ h - h.transpose(0, 2, 1) @ left) / noise**2
    gt = g @ t
    third = (second - u.transpose(0, 2, 1) @ t @ d @ u) / noise
    logdet = -np.linalg.slogdet(t)[1].sum() + (w[:, 0, 0].sum() - q * len(w)) * np.log(noise)
    traces = [np.einsum("ij,nji->", e, gt) for e in bases] + [(w[:, 0, 0] - np.einsum("nij,nji->n", t @ d, g)).sum() / noise]
    eu = [e @ u for e in bases]
    ut = u.transpose(0, 2, 1)
    score = [(ut @ x).sum(axis=0) for x in eu] + [second.sum(axis=0)]
    pairs = [(a.transpose(0, 2, 1) @ gt @ b).sum(axis=0) for i, a in enumerate(eu) for b in eu[: i + 1]]
    mixed = [(ut @ t @ x).sum(axis=0) for x in eu] + [third.sum(axis=0)]
    return np.concatenate([[logdet, w[:, 0, 0].sum()], traces, first.sum(axis=0).ravel(), *(x.ravel() for x in (*score, *pairs, *mixed))])


class _Pass:
    """Restricted likelihood, score and average information at (D, noise), from the sums of one pass."""

    def __init__(self, v: np.ndarray, p: int, shape: _Shape):
        k = len(shape.cells) + 1
        at = 0

        def take(n: int, *shape_: int) -> np.ndarray:
            nonlocal at
            at += n
            return v[at - n : at].reshape(shape_)

        logdet, n = take(2, 2)
        traces = take(k, k)
        side = (p + 1, p + 1)
        cells = (p + 1) ** 2
        first, score = take(cells, *side), take(k * cells, k, *side)
        pairs = take(k * (k - 1) // 2 * cells, k * (k - 1) // 2, *side)
        mixed = take(k * cells, k, *side)
        self.phi = np.linalg.inv(first[:p, :p])
        self.beta = self.phi @ first[:p, p]
        r = np.append(-self.beta, 1.0)
        form = lambda m: r @ m @ r
        self.value = -0.5 * ((n - p) * np.log(2 * np.pi) + logdet + np.linalg.slogdet(first[:p, :p])[1] + form(first))
        self.score = np.array([-0.5 * (traces[i] - np.sum(self.phi * score[i][:p, :p]) - form(score[i])) for i in range(k)])
        met = [score[i][:p] @ r for i in range(k)]
        info = np.empty((k, k))
        at = 0
        for i in range(k - 1):
            for j in range(i + 1):
                info[i, j] = info[j, i] = 0.5 * (form((pairs[at] + pairs[at].T) / 2) - met[i] @ self.phi @ met[j])
                at += 1
        for i in range(k):
            info[i, -1] = info[-1, i] = 0.5 * (form((mixed[i] + mixed[i].T) / 2) - met[i] @ self.phi @ met[-1])
        self.information = info


def _newton(now: _Pass, phi: np.ndarray, shape: _Shape) -> tuple[np.ndarray, float]:
    """(step in the Cholesky entries and log noise, the gain it promises)."""
    low, noise, k = shape.factor(phi), np.exp(phi[-1]), len(phi)
    jacobian = np.zeros((k, k))
    jacobian[-1, -1] = noise
    for b, (i, j) in enumerate(shape.cells):
        e = np.zeros_like(low)
        e[i, j] = 1.0
        moved = e @ low.T + low @ e.T
        jacobian[:-1, b] = [moved[r, c] for r, c in shape.cells]
    gradient = jacobian.T @ now.score
    curve = -jacobian.T @ now.information @ jacobian
    for a, (i, j) in enumerate(shape.cells):
        for b, (r, c) in enumerate(shape.cells):
            if j == c:
                s = shape.cells.index((max(i, r), min(i, r))) if (max(i, r), min(i, r)) in shape.cells else None
                curve[a, b] += 0.0 if s is None else now.score[s] * (2.0 if i == r else 1.0)
    curve[-1, -1] += now.score[-1] * noise
    # Away from a maximum the curve may bend upwards: every direction is taken as bending down.
    values, vectors = np.linalg.eigh(curve)
    bend = np.maximum(np.abs(values), 1e-8 * np.abs(values).max() + 1e-12)
    step = vectors @ ((vectors.T @ gradient) / bend)
    return step, float(gradient @ step)


def _settle(look, start: np.ndarray, shape: _Shape, most: int, tolerance: float) -> tuple[np.ndarray, _Pass, int, bool]:
    phi, now, passes = start, look(start), 1
    while True:
        step, gain = _newton(now, phi, shape)
        if gain < tolerance:
            spread = np.sqrt(np.maximum(np.diag(now.information), 1e-300))
            apart = np.linalg.eigvalsh(now.information / np.outer(spread, spread))[0] > 1e-7
            return phi, now, passes, bool(apart)
        # A step of at most one in the logarithm of the noise, then halves.
        size = min(1.0, 1.0 / max(abs(step[-1]), 1e-12))
        while True:
            if passes >= most:
                return phi, now, passes, False
            there = look(phi + size * step)
            passes += 1
            if there.value > now.value or size * gain < tolerance:
                break
            size /= 2
        if there.value <= now.value:
            return phi, now, passes, False
        phi, now = phi + size * step, there


def fit(rater_sums: DataFrame, *, degree: int = 1, passes: int = 30, tolerance: float = 1e-6, structures: list[_Shape] | None = None) -> MixedModel:
    """rater_sums: one row per rater, as power_sums() gives them (about the grand means).

    tolerance: of the log-likelihood that another step would gain; passes: at most so many over
    the sums for each of `structures`, which are tried in order until one converges.
    """
    p = degree + 1
    total = rater_sums.agg(*(F.sum(s).alias(s) for s in _names(degree))).head()
    if not total["s0"]:
        raise ValueError("no raters to fit")
    n = float(total["s0"])
    scale = np.array([(n / max(float(total[f"s{2 * k}"]), 1e-300)) ** 0.5 for k in range(p)])
    gram = np.array([[float(total[f"s{i + j}"]) * scale[i] * scale[j] for j in range(p)] for i in range(p)]) / n
    if np.linalg.eigvalsh(gram)[0] < 1e-10:
        raise ValueError("powers of x are not independent")
    cross = np.array([float(total[f"c{k}"]) * scale[k] for k in range(p)]) / n
    noise = max(float(total["yy"]) / n - cross @ np.linalg.solve(gram, cross), 1e-12)
    used = 0
    for shape in structures or shapes(p):

        def look(phi: np.ndarray, shape: _Shape = shape) -> _Pass:
            low, sigma = shape.factor(phi), float(np.exp(phi[-1]))
            return _Pass(_summed(rater_sums, lambda batch: _forms(_moments(batch, degree, scale), low @ low.T, sigma, shape), degree), p, shape)

        start = np.array([*((noise * 0.2) ** 0.5 if i == j else 0.0 for i, j in shape.cells), np.log(noise * 0.8)])
        phi, at, took, converged = _settle(look, start, shape, passes, tolerance)
        used += took
        if converged:
            break
    low = shape.factor(phi)
    covariance = np.zeros((p, p))
    covariance[: shape.q, : shape.q] = low @ low.T
    back = np.outer(scale, scale)
    # In the units of the powers; the constant of the likelihood with them.
    return MixedModel(at.beta * scale, covariance * back, float(np.exp(phi[-1])), at.phi * back, float(at.value + np.log(scale).sum()), shape.name(p), used, converged)


def effects(rater_sums: DataFrame, model: MixedModel) -> DataFrame:
    """Conditional effects: rater and its coefficients (population plus best linear prediction)."""
    p = len(model.beta)
    names = ["intercept", "slope", "quadratic", *(f"power_{k}" for k in range(3, p))][:p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = _moments(batch, p - 1, np.ones(p))
                g, rest = w[:, :p, :p], w[:, :p, p] - w[:, :p, :p] @ model.beta
                u = np.linalg.solve((model.noise * np.eye(p) + model.covariance @ g).transpose(0, 2, 1), rest[:, :, None])[:, :, 0]
                both = model.beta + u @ model.covariance
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(both[:, k]) for k in range(p))], names=["rater", *names])

    kind = rater_sums.schema["rater"].dataType.simpleString()
    return rater_sums.select("rater", *_names(p - 1)).mapInArrow(run, f"rater {kind}, " + ", ".join(f"{n} double" for n in names))
