"""M6: a hierarchical two-parameter response model, fitted by variational inference.

y = scale / (1 + exp(-a (x - b))) + noise, with log a and b normal over raters.  Each rater has a
Gaussian q over (log a, b).  One round is one pass over the rows: every run of a rater's rows gives
the expected squared residual under q (by a fixed Gauss-Hermite rule) and the sums of the natural
gradient and curvature, which add up by rater.  A rater takes its new q if its bound rises with
it, else tries a smaller step along the natural parameters; then means, spreads and noise take the
values that are best for all raters' q, which are averages.  So the bound rises in every round.

Raters' rows are packed in runs (see ordered): a rater of any size is spread over tasks.  A rater
that is one run keeps its q beside its rows, so a round moves none of them; the runs of longer
ones are asked by shuffled joins.  Nothing that grows with raters is broadcast or collected.
Defined cases: a rater keeps the prior where its rows say nothing; without rows fit() raises
ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from raterline.operators.ordered import packed_runs
from raterline.sources.files import written

#: Nodes of the quadrature in each direction, and the least variances.
NODES, LEAST = 5, 1e-6
#: A rater's state: q (mean 2, covariance 3), its sums (rows, residual, gradient 2, curvature 3), the size of the next step.
_Q, _SUMS, _STEP, _WIDTH = slice(0, 5), slice(5, 12), 12, 13


@dataclass
class Response:
    mean: np.ndarray
    spread: np.ndarray
    noise: float
    scale: float
    bounds: list[float] = field(default_factory=list)


def response(x: np.ndarray, log_a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
    return scale / (1 + np.exp(-np.clip(np.exp(log_a) * (x - b), -40, 40)))


def _factor(q: np.ndarray) -> np.ndarray:
    """Lower Cholesky entries (3, rows) of the covariances in q (rows, 5)."""
    first = np.sqrt(np.maximum(q[:, 2], LEAST**2))
    across = q[:, 3] / first
    return np.stack([first, across, np.sqrt(np.maximum(q[:, 4] - across**2, LEAST**2))])


def _nodes() -> tuple[np.ndarray, np.ndarray]:
    at, weight = np.polynomial.hermite_e.hermegauss(NODES)
    weight = weight / weight.sum()
    return np.stack(np.meshgrid(at, at), -1).reshape(-1, 2), np.outer(weight, weight).ravel()


def run_sums(x: np.ndarray, y: np.ndarray, run: np.ndarray, q: np.ndarray, scale: float) -> np.ndarray:
    """Per row: one, the expected squared residual, and the expected gradient and curvature of half of it (7 columns); q by run."""
    low = _factor(q)
    out = np.zeros((len(x), 7))
    out[:, 0] = 1.0
    for (u, v), weight in zip(*_nodes()):
        log_a, b = q[:, 0] + low[0] * u, q[:, 1] + low[1] * u + low[2] * v
        a = np.exp(log_a)[run]
        z = a * (x - b[run])
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        off, slope = y - scale * s, scale * s * (1 - s)
        d0, d1 = slope * z, -slope * a
        for i, term in enumerate((off * off, off * d0, off * d1, d0 * d0, d0 * d1, d1 * d1), 1):
            out[:, i] += weight * term
    return out


def _divergence(q: np.ndarray, m: Response) -> np.ndarray:
    """KL from each q to the prior."""
    det = np.maximum(q[:, 2] * q[:, 4] - q[:, 3] ** 2, 1e-300)
    off = (q[:, :2] - m.mean) ** 2 + q[:, [2, 4]]
    return 0.5 * ((off / m.spread).sum(axis=1) - 2 - np.log(det) + np.log(m.spread).sum())


def _bound(state: np.ndarray, m: Response) -> np.ndarray:
    n, residual = state[:, 5], state[:, 6]
    return -0.5 * n * np.log(2 * np.pi * m.noise) - residual / (2 * m.noise) - _divergence(state, m)


def _candidate(state: np.ndarray, m: Response) -> np.ndarray:
    """The q that each rater tries next (rows, 5)."""
    q, g, curve, part = state[:, _Q], state[:, 7:9], state[:, 9:12], state[:, _STEP]
    det = np.maximum(q[:, 2] * q[:, 4] - q[:, 3] ** 2, 1e-300)
    old = np.stack([q[:, 4], -q[:, 3], q[:, 2]], axis=1) / det[:, None]
    new = curve / m.noise + np.array([1 / m.spread[0], 0.0, 1 / m.spread[1]])
    precision = old + part[:, None] * (new - old)
    det = np.maximum(precision[:, 0] * precision[:, 2] - precision[:, 1] ** 2, 1e-300)
    s = np.stack([precision[:, 2], -precision[:, 1], precision[:, 0]], axis=1) / det[:, None]
    slope = g / m.noise - (q[:, :2] - m.mean) / m.spread
    step = part[:, None] * np.stack([s[:, 0] * slope[:, 0] + s[:, 1] * slope[:, 1], s[:, 1] * slope[:, 0] + s[:, 2] * slope[:, 1]], axis=1)
    return np.concatenate([q[:, :2] + np.clip(step, -2, 2), s], axis=1)


def response_runs(obs: DataFrame, *, size: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Stored runs of rows (rater, x, y), and which parts a rater is in, with `alone`: is it one run?"""
    runs = written(packed_runs(obs.select("rater", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "rater", ["x", "y"], ["x", "y"], size=size), "response-runs")
    alone = (F.count("*").over(Window.partitionBy("rater")) == 1) & (F.col("runs") == 1)
    return runs, written(runs.groupBy("rater", "part").agg(F.count("*").alias("runs")).select("rater", "part", alone.alias("alone")), "response-shares")


def _sums_of(batch: pa.RecordBatch, q: np.ndarray, scale: float) -> np.ndarray:
    """(runs, 7): the sums of runs, x and y being columns 1 and 2."""
    size = pc.list_value_length(batch.column(1)).to_numpy().astype(np.int64)
    v = run_sums(batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy(), np.repeat(np.arange(len(size)), size), q, scale)
    return np.add.reduceat(v, np.cumsum(size) - size, axis=0)


def _first(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.concatenate([q, v, np.ones((len(q), 1))], axis=1)


def _taken(v: np.ndarray, q: np.ndarray, s: np.ndarray, m: Response) -> np.ndarray:
    """The states that follow s where q was asked and gave v."""
    new = np.concatenate([q, v, np.minimum(1.0, 2 * s[:, _STEP])[:, None]], axis=1)
    better = np.isfinite(new).all(axis=1) & (_bound(new, m) >= _bound(s, m))
    kept = s.copy()
    kept[:, _STEP] /= 2
    return np.where(better[:, None], new, kept)


def _moved(own: DataFrame, start: np.ndarray, m: Response) -> DataFrame:
    """Raters of one run (rater, x, y, state) after a round, or, where they have no state yet, at q = start."""
    kind, known = own.schema["rater"].dataType.simpleString(), "state" in own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            s = batch.column(3).flatten().to_numpy().reshape(-1, _WIDTH) if known else None
            q = _candidate(s, m) if known else np.tile(start, (batch.num_rows, 1))
            v = _sums_of(batch, q, m.scale)
            state = _taken(v, q, s, m) if known else _first(v, q)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(state), pa.list_(pa.float64()))], names=["rater", "x", "y", "state"])

    return own.mapInArrow(run, f"rater {kind}, x array<double>, y array<double>, state array<double>")


def _summed(runs: DataFrame, shares: DataFrame, asked: DataFrame, scale: float) -> DataFrame:
    """rater, v: the seven sums of all its rows; asked: rater, q."""
    kind = runs.schema["rater"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            q = batch.column(3).flatten().to_numpy().reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(_sums_of(batch, q, scale)), pa.list_(pa.float64()))], names=["rater", "v"])

    rows = runs.join(shares.join(asked.hint("merge"), "rater").hint("merge"), ["rater", "part"]).select("rater", "x", "y", "q")
    return rows.mapInArrow(run, f"rater {kind}, v array<double>").groupBy("rater").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(7))).alias("v"))


def _mapped(rows: DataFrame, f, columns: list[str], out: str) -> DataFrame:
    """rater and f(columns as arrays), an array each."""
    kind = rows.schema["rater"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            v = f(*(batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in range(1, batch.num_columns)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(v), pa.list_(pa.float64()))], names=["rater", out])

    return rows.select("rater", *columns).mapInArrow(run, f"rater {kind}, {out} array<double>")


def _best_for_all(state: DataFrame, m: Response) -> Response:
    """Means, spreads and noise that are best for the q in state."""
    at = lambda i: F.col("state")[i]
    r = state.agg(*(F.avg(at(i)).alias(f"m{i}") for i in (0, 1)), *(F.var_pop(at(i)).alias(f"v{i}") for i in (0, 1)), F.avg(at(2)).alias("s0"), F.avg(at(4)).alias("s1"), F.sum(at(5)).alias("n"), F.sum(at(6)).alias("residual")).head()
    spread = np.maximum([r["v0"] + r["s0"], r["v1"] + r["s1"]], LEAST)
    return Response(np.array([r["m0"], r["m1"]]), spread, max(r["residual"] / r["n"], LEAST), m.scale, m.bounds)


def fit(obs: DataFrame, *, scale: float = 100.0, rounds: int = 40, tolerance: float = 1e-6, size: int = 4096) -> tuple[Response, DataFrame]:
    """(model, rater with log_a, b and their variances and covariance); obs: rater, x (about standardised), y.

    tolerance: of the bound, relative; at most so many rounds, one pass over the rows each.
    """
    runs, shares = response_runs(obs, size=size)
    spread = runs.select(F.explode("y").alias("y")).agg(F.count("*"), F.var_pop("y"), F.avg("y")).head()
    if not spread[0]:
        raise ValueError("no rows to fit")
    middle = np.log(min(max(spread[2] / scale, 0.01), 0.99) / (1 - min(max(spread[2] / scale, 0.01), 0.99)))
    m = Response(np.array([0.0, -middle]), np.array([0.5, 0.5]), max(spread[1], LEAST), scale)
    start = np.array([*m.mean, 0.25, 0.0, 0.25])
    part = lambda which: written(runs.join(shares.where(which).select("rater", "part").hint("merge"), ["rater", "part"]).select("rater", "part", "x", "y"), "response-runs")
    own, long = part("alone").select("rater", "x", "y"), shares.where("not alone").select("rater", "part")
    cut = part("not alone") if long.head(1) else None
    own, state = written(_moved(own, start, m), "response-own"), None
    if cut is not None:
        first = long.select("rater").distinct().select("rater", F.array(*(F.lit(float(v)) for v in start)).alias("q"))
        state = written(_mapped(_summed(cut, long, first, scale).join(first.hint("merge"), "rater"), _first, ["v", "q"], "state"), "response-state")
    every = lambda: own.select("rater", "state") if state is None else own.select("rater", "state").unionByName(state)
    for _ in range(rounds):
        m = _best_for_all(every(), m)
        bound = _mapped(every(), lambda s, m=m: _bound(s, m)[:, None], ["state"], "v").agg(F.sum(F.col("v")[0])).head()[0]
        m.bounds.append(float(bound))
        if len(m.bounds) > 1 and abs(m.bounds[-1] - m.bounds[-2]) < tolerance * (1 + abs(bound)):
            break
        own = written(_moved(own, start, m), "response-own")
        if state is not None:
            asked = written(_mapped(state, lambda s, m=m: _candidate(s, m), ["state"], "q"), "response-asked")
            met = _summed(cut, long, asked, scale).join(asked.hint("merge"), "rater").join(state.hint("merge"), "rater")
            state = written(_mapped(met, lambda v, q, s, m=m: _taken(v, q, s, m), ["v", "q", "state"], "state"), "response-state")
    at = lambda i, name: F.col("state")[i].alias(name)
    return m, every().select("rater", at(0, "log_a"), at(1, "b"), at(2, "v_log_a"), at(3, "covariance"), at(4, "v_b"), at(5, "n"))


def predicted(x, log_a, b, scale: float):
    """The response as a column."""
    return scale / (1 + F.exp(-F.exp(log_a) * (x - b)))
