"""K7-K9: preference models with a few weights per rater, judged on held-out conversations.

Conversations are dealt into folds by hash; a conversation's pairs and rows are never learned
from by the fit that is judged on them.  A rater's pairs are packed in runs that any tasks may
hold (see ordered).  A round is one job: every run gives, for each fold left out, the sums that a
Newton step needs, which Spark adds up by rater; then every rater takes its steps on one small
row.  What raters share (a basis per fold) moves along the gradient summed over all of them.

Ratings are polynomials of the signal in all these models, so what they are off on held-out
rows follows from power sums per rater and fold (see mixed.power_sums): training sums are
totals less the fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from raterline.operators import shrinkage, splits
from raterline.operators.mixed import power_sums
from raterline.operators.ordered import packed_runs
from raterline.sources.files import written

DEGREE = 3
SUMS = tuple([*(f"s{k}" for k in range(2 * DEGREE + 1)), *(f"c{k}" for k in range(DEGREE + 1)), "yy"])


def powers(x: np.ndarray) -> np.ndarray:
    """z, z**2, z**3 with z clipped to [-3, 3]."""
    z = np.clip(x, -3, 3)
    return np.stack([z**k for k in range(1, DEGREE + 1)], axis=1)


def clipped(x: str | Column) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.greatest(F.lit(-3.0), F.least(F.lit(3.0), x))


def simplex(v: np.ndarray) -> np.ndarray:
    """The nearest points with non-negative entries that sum to one; v: one point, or one a row."""
    rows = np.atleast_2d(v)
    u = -np.sort(-rows, axis=1)
    over = (np.cumsum(u, axis=1) - 1) / np.arange(1, rows.shape[1] + 1)
    k = (u > over).sum(axis=1) - 1
    return np.maximum(rows - over[np.arange(len(rows)), k][:, None], 0).reshape(np.shape(v))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _losses(margin: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, -margin)


def conversation_fold(conversation: str | Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(F.col(conversation) if isinstance(conversation, str) else conversation), F.lit(folds)).cast("int")


@dataclass
class PairRuns:
    """runs: rater, part, first and arrays of pairs; shares: which parts a rater is in; both stored."""

    runs: DataFrame
    shares: DataFrame
    folds: int

    @property
    def kind(self) -> str:
        return self.runs.schema["rater"].dataType.simpleString()


def pair_runs(pairs: DataFrame, *, folds: int = 5, size: int = 4096) -> PairRuns:
    """pairs: rater, fold (from 0), chosen_x, rejected_x."""
    runs = written(packed_runs(pairs.select("rater", "fold", "chosen_x", "rejected_x"), "rater", ["fold", "chosen_x", "rejected_x"], ["fold", "chosen_x", "rejected_x"], size=size), "pair-runs")
    return PairRuns(runs, written(runs.select("rater", "part").distinct(), "pair-shares"), folds)


def _added(p: PairRuns, state: DataFrame, sums: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], width: int) -> DataFrame:
    """rater, w, v: the sums over all of a rater's pairs; state: rater and w (array).

    sums(d, fold, run, w by run) gives an array (pairs, width): differences of powers, the folds
    of the pairs, which run they are in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            fold, chosen, rejected = (batch.column(i) for i in (1, 2, 3))
            size = pc.list_value_length(fold).to_numpy().astype(np.int64)
            w = batch.column(4).flatten().to_numpy().reshape(batch.num_rows, -1)
            d = powers(chosen.flatten().to_numpy()) - powers(rejected.flatten().to_numpy())
            v = sums(d, fold.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), size), w)
            total = np.add.reduceat(v, np.cumsum(size) - size, axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(total), pa.list_(pa.float64()))], names=["rater", "v"])

    # By rater and part, so that a rater's runs stay in as many tasks as they were packed by.
    asked = p.runs.join(p.shares.join(state.select("rater", "w"), "rater"), ["rater", "part"]).select("rater", "fold", "chosen_x", "rejected_x", "w")
    each = asked.mapInArrow(run, f"rater {p.kind}, v array<double>").groupBy("rater").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(width))).alias("v"))
    return each.join(state, "rater")


def _state(rows: DataFrame, step: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], kind: str, name: str) -> DataFrame:
    """The next state, stored: step(v, w) -> (w, how far it moved), a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            w, moved = step(*(batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in (1, 2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(w), pa.list_(pa.float64())), pa.array(moved)], names=["rater", "w", "moved"])

    return written(rows.select("rater", "v", "w").mapInArrow(run, f"rater {kind}, w array<double>, moved double"), name)


def _first(p: PairRuns, start: np.ndarray) -> DataFrame:
    return p.shares.select("rater").distinct().select("rater", F.array(*(F.lit(float(x)) for x in start)).alias("w"))


def _terms(d: np.ndarray, fold: np.ndarray, w: np.ndarray, folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair and fold left out: (is the pair learned from, its miss, its loss); w: (pairs, folds, weights of d)."""
    margin = np.einsum("nj,nkj->nk", d, w)
    return (fold[:, None] != np.arange(folds)).astype(float), 1 - _sigmoid(margin), _losses(margin)


def fold_weights(p: PairRuns, *, ridge: float = 0.1, most: int = 40) -> DataFrame:
    """K7: rater and w: for each fold in turn, the DEGREE weights that its other pairs give.

    They minimise mean(log(1 + exp(-d w))) + ridge |w|^2 / 2, by Newton steps which are halved
    where the loss would rise.  A fold that leaves a rater no pairs has weights of zero.
    """
    k, q = p.folds, DEGREE
    upper = [(i, j) for i in range(q) for j in range(i + 1)]
    each = 2 + q + len(upper)

    def sums(d: np.ndarray, fold: np.ndarray, run: np.ndarray, w: np.ndarray) -> np.ndarray:
        at = w[:, : k * q].reshape(-1, k, q)[run]
        train, miss, loss = _terms(d, fold, at, k)
        bend = train * miss * (1 - miss)
        out = [train, train * loss, *(train * miss * d[:, [i]] for i in range(q)), *(bend * d[:, [i]] * d[:, [j]] for i, j in upper)]
        return np.stack(out, axis=2).reshape(len(d), k * each)

    def step(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """w holds, for all folds: where to look, the best point so far, the step from it, its loss, the part of the step."""
        v = v.reshape(-1, k, each)
        at, base, move = (w[:, i * k * q : (i + 1) * k * q].reshape(-1, k, q) for i in range(3))
        best, part = w[:, 3 * k * q :].reshape(-1, 2, k).transpose(1, 0, 2)
        n = np.maximum(v[:, :, 0], 1)
        loss = v[:, :, 1] / n + 0.5 * ridge * (at**2).sum(axis=2)
        gradient = -v[:, :, 2 : 2 + q] / n[:, :, None] + ridge * at
        bend = np.zeros((*loss.shape, q, q))
        for (i, j), x in zip(upper, np.moveaxis(v[:, :, 2 + q :], 2, 0)):
            bend[:, :, i, j] = bend[:, :, j, i] = x / n
        newton = -np.linalg.solve(bend + ridge * np.eye(q), gradient[..., None])[..., 0]
        good = loss <= best + 1e-13
        base, best = np.where(good[..., None], at, base), np.where(good, loss, best)
        move, part = np.where(good[..., None], newton, move), np.where(good, 1.0, part / 2)
        to = base + part[..., None] * move
        flat = [x.reshape(len(v), -1) for x in (to, base, move)]
        return np.concatenate([*flat, best, part], axis=1), np.abs(to - base).max(axis=(1, 2))

    state = _first(p, np.concatenate([np.zeros(3 * k * q), np.full(k, 1e300), np.ones(k)]))
    for _ in range(most):
        state = _state(_added(p, state, sums, k * each), step, p.kind, "fold-weights")
        if (state.agg(F.max("moved")).head()[0] or 0.0) < 1e-9:
            break
    return state.select("rater", F.slice("w", 1, k * q).alias("w"))


def held_out_pairs(p: PairRuns, weights: DataFrame) -> DataFrame:
    """Per rater: n pairs, their mean log loss and accuracy, each pair by the weights that its fold did not teach.

    weights: rater and w, DEGREE numbers for each fold.
    """
    k = p.folds

    def sums(d: np.ndarray, fold: np.ndarray, run: np.ndarray, w: np.ndarray) -> np.ndarray:
        own = w.reshape(-1, k, DEGREE)[run, fold]
        margin = (d * own).sum(axis=1)
        return np.stack([np.ones(len(d)), _losses(margin), (margin > 0) + 0.5 * (margin == 0)], axis=1)

    v = F.col("v")
    return _added(p, weights, sums, 3).select("rater", v[0].cast("long").alias("n"), (v[1] / v[0]).alias("log_loss"), (v[2] / v[0]).alias("accuracy"))


def shared_basis(p: PairRuns, *, basis: int = 2, rounds: int = 4, rate: float = 0.3) -> tuple[np.ndarray, DataFrame]:
    """K8: for each fold left out, a basis shared by all raters (folds x DEGREE x basis) and each rater's simplex weights on it.

    A round is a Newton step of all raters' weights within the simplex, then a step of each basis
    along the gradient summed over all raters.  Returns also rater and w, the products of basis
    and weights for each fold, as held_out_pairs() takes them.
    """
    k, q = p.folds, DEGREE
    a = np.repeat((np.eye(q, basis) + 0.1)[None], k, axis=0)
    upper = [(i, j) for i in range(basis) for j in range(i + 1)]
    each = 1 + basis + len(upper)

    def full(w: np.ndarray, a: np.ndarray) -> np.ndarray:
        return np.einsum("kqb,nkb->nkq", a, w.reshape(-1, k, basis))

    def weight_step(a: np.ndarray):
        def sums(d: np.ndarray, fold: np.ndarray, run: np.ndarray, w: np.ndarray) -> np.ndarray:
            train, miss, _ = _terms(d, fold, full(w, a)[run], k)
            f, bend = np.einsum("nq,kqb->nkb", d, a), train * miss * (1 - miss)
            out = [train, *(train * miss * f[:, :, i] for i in range(basis)), *(bend * f[:, :, i] * f[:, :, j] for i, j in upper)]
            return np.stack(out, axis=2).reshape(len(d), k * each)

        def step(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            v, w = v.reshape(-1, each), w.reshape(-1, basis)
            n = np.maximum(v[:, 0], 1)[:, None]
            bend = np.zeros((len(v), basis, basis))
            for (i, j), x in zip(upper, v[:, 1 + basis :].T):
                bend[:, i, j] = bend[:, j, i] = x / n[:, 0]
            g = -v[:, 1 : 1 + basis] / n
            # The least of the quadratic model within the simplex, damped a little.
            bend += (1e-2 * np.trace(bend, axis1=1, axis2=2) + 1e-9)[:, None, None] * np.eye(basis)
            to = least_in_simplex(bend, np.einsum("nij,nj->ni", bend, w) - g)
            return to.reshape(-1, k * basis), np.abs(to - w).reshape(-1, k * basis).max(axis=1)

        return sums, step

    state = _first(p, np.full(k * basis, 1 / basis))
    for _ in range(rounds):
        sums, step = weight_step(a)
        state = _state(_added(p, state, sums, k * each), step, p.kind, "basis-weights")

        def slopes(d: np.ndarray, fold: np.ndarray, run: np.ndarray, w: np.ndarray, a: np.ndarray = a) -> np.ndarray:
            train, miss, _ = _terms(d, fold, full(w, a)[run], k)
            g = np.einsum("nk,nq,nkb->nkqb", train * miss, d, w.reshape(-1, k, basis)[run])
            return np.concatenate([train, g.reshape(len(d), -1)], axis=1)

        width = k + k * q * basis
        total = _added(p, state, slopes, width).agg(*(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width))).head()
        v = np.array([x or 0.0 for x in total])
        a = np.clip(a + rate * v[k:].reshape(k, q, basis) / np.maximum(v[:k], 1)[:, None, None], -5, 5)
    last = a
    product = F.flatten(F.array(*(F.array(*(sum((F.col("w")[f * basis + b] * float(last[f, i, b]) for b in range(basis)), F.lit(0.0)) for i in range(q))) for f in range(k))))
    return a, state.select("rater", product.alias("w"))


def fold_sums(obs: DataFrame, folds: int) -> DataFrame:
    """rater, fold and power sums of held-out rows (h_*) and of the rater's other rows (t_*); obs: rater, fold, x, y."""
    sums = power_sums(obs.select("rater", "fold", clipped("x").alias("cx"), F.col("y").alias("cy")), "rater", "fold", degree=DEGREE)
    all_of = Window.partitionBy("rater")
    return sums.select("rater", "fold", *(F.col(s).alias(f"h_{s}") for s in SUMS), *((F.sum(s).over(all_of) - F.col(s)).alias(f"t_{s}") for s in SUMS))


def _arrays(batch: pa.RecordBatch, prefix: str) -> dict[str, np.ndarray]:
    return {s: batch.column(batch.schema.get_field_index(f"{prefix}_{s}")).to_numpy(zero_copy_only=False).astype(float) for s in SUMS}


def _gram(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    p = DEGREE + 1
    return np.stack([np.stack([s[f"s{i + j}"] for j in range(p)], -1) for i in range(p)], -2), np.stack([s[f"c{i}"] for i in range(p)], -1)


def _squared(s: dict[str, np.ndarray], poly: np.ndarray) -> np.ndarray:
    """Squared error of the polynomials (rows, DEGREE + 1) on rows with these sums."""
    gram, cross = _gram(s)
    return np.maximum(s["yy"] - 2 * (poly * cross).sum(axis=1) + np.einsum("ni,nij,nj->n", poly, gram, poly), 0)


def recalibrated(weights: DataFrame, sums: DataFrame, *, limit: float = 5.0) -> DataFrame:
    """K7: per rater and fold, held-out squared error of a + b times the preference score, fitted on the other rows.

    The mean takes its place (`steady` false) where the score is flat, under three rows, or where
    b carries the score to over `limit` times the spread of the ratings.
    """
    q = DEGREE
    kind = sums.schema["rater"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            t, h = _arrays(batch, "t"), _arrays(batch, "h")
            fold = batch.column(1).to_numpy()
            w = batch.column(batch.schema.get_field_index("w")).flatten().to_numpy().reshape(batch.num_rows, -1, q)[np.arange(batch.num_rows), fold]
            gram, cross = _gram(t)
            n = np.maximum(t["s0"], 1)
            mean, mean_y = np.einsum("ni,ni->n", w, gram[:, 0, 1:]) / n, cross[:, 0] / n
            spread = np.maximum(np.einsum("ni,nij,nj->n", w, gram[:, 1:, 1:], w) / n - mean**2, 0)
            both = np.einsum("ni,ni->n", w, cross[:, 1:]) / n - mean * mean_y
            spread_y = np.sqrt(np.maximum(t["yy"] / n - mean_y**2, 0)) + 1e-8
            b = both / np.maximum(spread, 1e-300)
            steady = (t["s0"] >= 3) & (np.sqrt(spread) >= 1e-8) & (np.abs(b) * np.sqrt(spread) <= limit * spread_y)
            b = np.where(steady, b, 0.0)
            poly = np.concatenate([(mean_y - b * mean)[:, None], b[:, None] * w], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h["s0"]), pa.array(_squared(h, poly)), pa.array(steady)], names=["rater", "fold", "n", "sse", "steady"])

    rows = sums.join(weights, "rater").select("rater", "fold", *(f"h_{s}" for s in SUMS), *(f"t_{s}" for s in SUMS), "w")
    return rows.mapInArrow(run, f"rater {kind}, fold int, n double, sse double, steady boolean")


def polynomial_heads(obs: DataFrame, *, ridges: tuple[float, ...] = (0.1, 10.0, 1000.0)) -> tuple[np.ndarray, np.ndarray]:
    """K9: one cubic ridge head per penalty (heads x (DEGREE + 1)) and their simplex weights on all rows, from one aggregate."""
    total = power_sums(obs.select(clipped("x").alias("cx"), F.col("y").alias("cy")), degree=DEGREE).head()
    s = {k: np.array([float(total[k] or 0.0)]) for k in SUMS}
    gram, cross = (x[0] for x in _gram(s))
    keep = np.diag([0.0] + [1.0] * DEGREE)
    heads = np.stack([np.linalg.solve(gram + r * keep + 1e-9 * np.eye(DEGREE + 1), cross) for r in ridges])
    return heads, mixture(gram[None], cross[None], heads)[0]


def mixture(gram: np.ndarray, cross: np.ndarray, heads: np.ndarray, steps: int = 300) -> np.ndarray:
    """Simplex weights of the heads with least squared error, for rows of sums."""
    return least_in_simplex(np.einsum("ai,nij,bj->nab", heads, gram, heads), cross @ heads.T, steps)


def least_in_simplex(g: np.ndarray, c: np.ndarray, steps: int = 300) -> np.ndarray:
    """Rows w in the simplex with least w g w / 2 - c w, by accelerated projected gradients."""
    length = 1 / np.maximum(np.trace(g, axis1=1, axis2=2), 1e-12)[:, None]
    w = ahead = np.full(c.shape, 1 / c.shape[1])
    t = 1.0
    for _ in range(steps):
        new = simplex(ahead - length * (np.einsum("nab,nb->na", g, ahead) - c))
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / later * (new - w), new, later
    return w


def head_mixtures(sums: DataFrame, heads: np.ndarray) -> DataFrame:
    """K9: per rater and fold of fold_sums(), the simplex weights of the heads on its other rows, and their held-out squared error."""
    kind = sums.schema["rater"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            w = mixture(*_gram(_arrays(batch, "t")), heads)
            h = _arrays(batch, "h")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h["s0"]), pa.array(_squared(h, w @ heads)), pa.array(list(w), pa.list_(pa.float64()))], names=["rater", "fold", "n", "sse", "weights"])

    return sums.mapInArrow(run, f"rater {kind}, fold int, n double, sse double, weights array<double>")


def with_mixture(obs: DataFrame, heads: np.ndarray, weights: np.ndarray, name: str = "x") -> DataFrame:
    """obs with the mixed heads' prediction as `name`."""
    poly, z = weights @ heads, clipped("x")
    value = F.lit(float(poly[-1]))
    for c in poly[-2::-1]:
        value = value * z + float(c)
    return obs.withColumn(name, value)


def composed_arms(obs: DataFrame, *, folds: int = 5, seed: int = 20260420) -> DataFrame:
    """K9 with E2: mean RMSE per rater of the population line, the mixture, the shrunken line, and the shrunken line on the mixture.

    One mixture for all raters takes the signal's place; all arms share their folds.
    """
    heads, weights = polynomial_heads(obs)
    dealt = splits.k_folds(obs, folds, seed)
    plain = shrinkage.rater_rmse(shrinkage.held_out_errors(dealt)).select("rater", F.col("rmse_population").alias("population"), F.col("rmse_shrunk").alias("shrunk"))
    mixed = shrinkage.rater_rmse(shrinkage.held_out_errors(with_mixture(dealt, heads, weights))).select("rater", F.col("rmse_population").alias("mixture"), F.col("rmse_shrunk").alias("composed"))
    arms = ("population", "mixture", "shrunk", "composed")
    return plain.join(mixed, "rater").agg(F.count("*").alias("raters"), *(F.avg(a).alias(f"rmse_{a}") for a in arms))
