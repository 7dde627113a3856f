"""Lines whose coefficients drift, fitted by the likelihood of a linear state-space model.

s_t = c + F (s_{t-1} - c) + w with F = diag(rho), w ~ N(0, diag(q)), and y_t = (1, x_t) s_t + v,
v ~ N(0, noise); s before the first row is N(m0, diag(v0)) with c = m0, the rater's own prior.
rho = 1 is a random walk, rho < 1 (AR(1)) reverts to the prior.

A stretch of rows is summed up in a Gaussian element: where the state ends given where it
began (A, b, C), and how likely the rows are as a function of where it began (eta, J, z).
Elements of neighbouring stretches combine, and combining is associative, so a rater's rows are
packed in runs (see ordered) that any tasks may hold; each task sends one element for each
rater it has met.  With the derivatives of every number carried along (forward sensitivities),
one job gives likelihood and gradient, for a quasi-Newton search on the driver.

The pull toward the prior after each row (`pull`) moves means only, so with variances known a
run is an affine map of the mean where it began, which runs hand on in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from raterline.operators.ordered import packed_runs
from raterline.operators.regression import centred, population_line
from raterline.operators.shrinkage import between_variance, rater_lines, shrunk
from raterline.sources.files import written


@dataclass(frozen=True)
class Drift:
    """Persistence and step variance of intercept and slope, and the noise; with how they were found."""

    rho: tuple[float, float]
    q: tuple[float, float]
    noise: float
    log_likelihood: float | None = None
    evaluations: int = 0
    converged: bool | None = None


# Numbers with derivatives: arrays (1 + parameters, rows), the value first.


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * b[:1]
    out[1:] += a[:1] * b[1:]
    return out


def div(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    v = a[:1] / b[:1]
    out = a - v * b
    out[1:] /= b[:1]
    out[0] = v[0]
    return out


def log(a: np.ndarray) -> np.ndarray:
    return np.concatenate([np.log(a[:1]), a[1:] / a[:1]])


def constant(v: np.ndarray, like: int) -> np.ndarray:
    out = np.zeros((like, len(v)))
    out[0] = v
    return out


#: Places in an element: A by rows, b, C, eta, J, z.
A00, A01, A10, A11, B0, B1, C00, C01, C11, E0, E1, J00, J01, J11, Z = range(15)


def neutral(rows: int, width: int) -> np.ndarray:
    e = np.zeros((15, width, rows))
    e[A00, 0] = e[A11, 0] = 1.0
    return e


def runs_elements(x: np.ndarray, y: np.ndarray, size: np.ndarray, target: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Elements of runs laid end to end; target: (2, runs); theta: (5, 1 + parameters) of rho, q, noise with derivatives.

    A Kalman filter over all runs at once, a row of each a step, which also keeps how the state
    and the likelihood depend on the state before the run.
    """
    order = np.argsort(-size, kind="stable")
    start = (np.cumsum(size) - size)[order]
    longest = int(size.max(initial=0))
    live = np.searchsorted(-size[order], -np.arange(longest), side="left")
    width = theta.shape[1]
    out = neutral(len(size), width)
    c = target[:, order]
    r0, r1, q0, q1, noise = (np.repeat(t[:, None], len(size), axis=1) for t in theta)
    for t in range(longest):
        n = int(live[t])
        e = out[:, :, :n]
        f0, f1 = r0[:, :n], r1[:, :n]
        a00, a01, a10, a11 = mul(f0, e[A00]), mul(f0, e[A01]), mul(f1, e[A10]), mul(f1, e[A11])
        c0, c1 = constant(c[0, :n], width), constant(c[1, :n], width)
        b0, b1 = c0 + mul(f0, e[B0] - c0), c1 + mul(f1, e[B1] - c1)
        p00, p01, p11 = mul(mul(f0, f0), e[C00]) + q0[:, :n], mul(mul(f0, f1), e[C01]), mul(mul(f1, f1), e[C11]) + q1[:, :n]
        h, seen = x[start[:n] + t], y[start[:n] + t]
        g0, g1 = p00 + h * p01, p01 + h * p11
        s = g0 + h * g1 + noise[:, :n]
        k0, k1 = div(g0, s), div(g1, s)
        w0, w1 = a00 + h * a10, a01 + h * a11
        off = constant(seen, width) - b0 - h * b1
        u0, u1, rest = div(w0, s), div(w1, s), div(off, s)
        ll = log(s) + mul(off, rest)
        ll[0] += np.log(2 * np.pi)
        e[Z] -= 0.5 * ll
        e[E0] += mul(w0, rest)
        e[E1] += mul(w1, rest)
        e[J00] += mul(w0, u0)
        e[J01] += mul(w0, u1)
        e[J11] += mul(w1, u1)
        e[A00], e[A01], e[A10], e[A11] = a00 - mul(k0, w0), a01 - mul(k0, w1), a10 - mul(k1, w0), a11 - mul(k1, w1)
        e[B0], e[B1] = b0 + mul(k0, off), b1 + mul(k1, off)
        e[C00], e[C01], e[C11] = p00 - mul(k0, g0), p01 - mul(k0, g1), p11 - mul(k1, g1)
    back = np.empty_like(out)
    back[:, :, order] = out
    return back


def whole_likelihood(x: np.ndarray, y: np.ndarray, size: np.ndarray, prior: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Log-likelihood of runs that begin at their prior, with derivatives: the filter of runs_elements() without what only its elements need.

    prior: (4, runs) of means and variances; theta as there.
    """
    order = np.argsort(-size, kind="stable")
    start = (np.cumsum(size) - size)[order]
    live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
    width = theta.shape[1]
    c0, c1, v0, v1 = (constant(v, width) for v in prior[:, order])
    m, p, z = np.stack([c0, c1]), np.stack([v0, np.zeros_like(v0), v1]), np.zeros((width, len(size)))
    r0, r1, q0, q1, noise = (t[:, None] for t in theta)
    # A random walk leaves the state as it is before each step's variance.
    walks = (theta[:2, 0] == 1.0).all() and not theta[:2, 1:].any()
    for t, n in enumerate(live.tolist()):
        b0, b1 = m[:, :, :n]
        p00, p01, p11 = p[:, :, :n]
        if not walks:
            b0, b1 = c0[:, :n] + mul(b0 - c0[:, :n], r0), c1[:, :n] + mul(b1 - c1[:, :n], r1)
            p00, p01, p11 = mul(p00, mul(r0, r0)), mul(p01, mul(r0, r1)), mul(p11, mul(r1, r1))
        p00, p11 = p00 + q0, p11 + q1
        h = x[start[:n] + t]
        g0, g1 = p00 + h * p01, p01 + h * p11
        s = g0 + h * g1 + noise
        k0, k1 = div(g0, s), div(g1, s)
        off = -(b0 + h * b1)
        off[0] += y[start[:n] + t]
        ll = log(s) + mul(off, div(off, s))
        ll[0] += np.log(2 * np.pi)
        z[:, :n] -= 0.5 * ll
        m[0, :, :n], m[1, :, :n] = b0 + mul(k0, off), b1 + mul(k1, off)
        p[0, :, :n], p[1, :, :n], p[2, :, :n] = p00 - mul(k0, g0), p01 - mul(k0, g1), p11 - mul(k1, g1)
    return z.sum(axis=1)


def _times(a: list, b: list) -> list:
    """Products of 2 x 2 matrices by rows."""
    return [mul(a[0], b[0]) + mul(a[1], b[2]), mul(a[0], b[1]) + mul(a[1], b[3]), mul(a[2], b[0]) + mul(a[3], b[2]), mul(a[2], b[1]) + mul(a[3], b[3])]


def _turned(a: list) -> list:
    return [a[0], a[2], a[1], a[3]]


def _on(a: list, v: list) -> list:
    return [mul(a[0], v[0]) + mul(a[1], v[1]), mul(a[2], v[0]) + mul(a[3], v[1])]


def _dot(a: list, b: list) -> np.ndarray:
    return mul(a[0], b[0]) + mul(a[1], b[1])


def combined(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The element of the rows of i and then those of j."""
    ai, aj = [*i[A00:B0]], [*j[A00:B0]]
    ci, cj, jj, ji = ([e[k], e[k + 1], e[k + 1], e[k + 2]] for e, k in ((i, C00), (j, C00), (j, J00), (i, J00)))
    bi, bj, ej = [i[B0], i[B1]], [j[B0], j[B1]], [j[E0], j[E1]]
    m = _times(ci, jj)
    m[0], m[3] = m[0].copy(), m[3].copy()
    m[0][0] += 1.0
    m[3][0] += 1.0
    det = mul(m[0], m[3]) - mul(m[1], m[2])
    e = [div(m[3], det), div(-m[1], det), div(-m[2], det), div(m[0], det)]
    ec, je, turned = _times(e, ci), _times(jj, e), _turned(e)
    ajE = _times(aj, e)
    a = _times(ajE, ai)
    shift = _on(ajE, [p + q for p, q in zip(bi, _on(ci, ej))])
    c = [p + q for p, q in zip(_times(_times(aj, ec), _turned(aj)), cj)]
    jb = _on(jj, bi)
    eta = _on(_times(_turned(ai), turned), [p - q for p, q in zip(ej, jb)])
    back = _times(_times(_turned(ai), je), ai)
    z = i[Z] + j[Z] - 0.5 * log(det) + 0.5 * _dot(ej, _on(ec, ej)) + _dot(ej, _on(e, bi)) - 0.5 * _dot(bi, _on(je, bi))
    return np.stack([*a, shift[0] + bj[0], shift[1] + bj[1], c[0], c[1], c[3], eta[0] + i[E0], eta[1] + i[E1], back[0] + ji[0], back[1] + ji[1], back[3] + ji[3], z])


def prior_element(mean: np.ndarray, variance: np.ndarray, width: int) -> np.ndarray:
    """A state that does not depend on anything before: mean and variance are (2, rows)."""
    e = np.zeros((15, width, mean.shape[1]))
    e[B0, 0], e[B1, 0], e[C00, 0], e[C11, 0] = *mean, *variance
    return e


def combined_runs(elements: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one element for each run of equal keys, place of its first); neighbours combine in pairs, all at once."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    while len(of) > len(first):
        place = np.arange(len(of)) - np.searchsorted(of, of)
        left = np.flatnonzero((place % 2 == 0) & np.append(of[1:] == of[:-1], False))
        elements = elements.copy()
        elements[:, :, left] = combined(elements[:, :, left], elements[:, :, left + 1])
        kept = np.ones(len(of), bool)
        kept[left + 1] = False
        elements, of = elements[:, :, kept], of[kept]
    return elements, first


def drift_runs(obs: DataFrame, priors: DataFrame, *, size: int = 4096) -> DataFrame:
    """Stored runs of raters' rows (rater, ts, obs_id, x, y) by time, with their priors and `alone`: is the run all of its rater?

    priors: rater, m_intercept, m_slope, v_intercept, v_slope; raters without a prior are left out.
    """
    runs = written(packed_runs(obs.select("rater", "ts", "obs_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "rater", ["ts", "obs_id"], ["x", "y"], size=size), "drift-runs")
    # One row for each task's share of a rater, so that a rater with many runs does not meet in one.
    shares = runs.groupBy("rater", "part").agg(F.count("*").alias("runs"))
    alone = (F.count("*").over(Window.partitionBy("rater")) == 1) & (F.col("runs") == 1)
    prior = priors.select("rater", F.array("m_intercept", "m_slope", "v_intercept", "v_slope").alias("prior"))
    known = shares.withColumn("alone", alone).join(prior, "rater").select("rater", "part", "prior", "alone")
    # Runs stay in order, so that neighbours combine where they lie.
    return written(runs.join(known, ["rater", "part"]).select("rater", "part", "first", "x", "y", "prior", "alone").sortWithinPartitions("rater", "part", "first"), "drift-runs")


def _theta(log_q: np.ndarray, log_noise: float, logit_rho: np.ndarray | None) -> np.ndarray:
    """Rows rho, rho, q, q, noise; columns value and derivatives by the parameters (log q, log q, log noise, logit rho, logit rho)."""
    k = 3 if logit_rho is None else 5
    out = np.zeros((5, 1 + k))
    out[:2, 0] = 1.0
    if logit_rho is not None:
        rho = 1 / (1 + np.exp(-logit_rho))
        out[:2, 0] = rho
        out[0, 4], out[1, 5] = rho * (1 - rho)
    out[2:4, 0] = np.exp(log_q)
    out[2, 1], out[3, 2] = out[2:4, 0]
    out[4, 0] = out[4, 3] = np.exp(log_noise)
    return out


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, size, prior as (4, runs)) of a batch of runs."""
    x, y, prior = (batch.column(batch.schema.get_field_index(c)) for c in ("x", "y", "prior"))
    size = pc.list_value_length(x).to_numpy().astype(np.int64)
    return x.flatten().to_numpy(), y.flatten().to_numpy(), size, prior.flatten().to_numpy().reshape(-1, 4).T


def likelihood(runs: DataFrame, theta: np.ndarray) -> np.ndarray:
    """Log-likelihood of all raters and its gradient, from one job over drift_runs()."""
    width = theta.shape[1]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            x, y, size, prior = _lists(batch)
            total += whole_likelihood(x, y, size, prior, theta)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    kind = runs.schema["rater"].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            x, y, size, prior = _lists(batch)
            rater = batch.column(0).dictionary_encode().indices.to_numpy()
            # Runs of a rater that follow each other in a part make one element.
            place = rater.astype(np.int64) * (1 << 32) + batch.column(1).to_numpy()
            e, at = combined_runs(runs_elements(x, y, size, prior[:2], theta), place)
            flat = e.transpose(2, 0, 1).reshape(len(at), -1)
            picked = [batch.column(i).take(pa.array(at)) for i in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays([*picked, batch.column(5).take(pa.array(at)), pa.array(list(flat), pa.list_(pa.float64()))], names=["rater", "part", "first", "prior", "element"])

    def put_together(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("first", "ascending")])
        e = np.array(group.column("element").to_pylist()).reshape(group.num_rows, 15, width).transpose(1, 2, 0)
        prior = np.array(group.column("prior")[0].as_py())[:, None]
        e, _ = combined_runs(e, np.zeros(group.num_rows, np.int64))
        return pa.table({"v": pa.array([combined(prior_element(prior[:2], prior[2:], width), e)[Z][:, 0].tolist()], pa.list_(pa.float64()))})

    columns = ["rater", "part", "first", "x", "y", "prior"]
    sums = runs.where("alone").select(*columns).mapInArrow(whole, "v array<double>")
    cut = runs.where("not alone").select(*columns)
    cut = cut.mapInArrow(parts, f"rater {kind}, part int, first long, prior array<double>, element array<double>").groupBy("rater").applyInArrow(put_together, "v array<double>")
    got = sums.unionByName(cut).agg(*(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width))).head()
    return np.array([v or 0.0 for v in got])


def fit_drift(runs: DataFrame, start: Drift, *, reverting: bool = False, most: int = 60, tolerance: float = 1e-6) -> Drift:
    """The drift of highest likelihood over drift_runs(), by BFGS steps in logarithms from `start`.

    tolerance: of the gain that a step promises, relative to the likelihood.  rho stays 1 unless
    `reverting`, which starts at start.rho or 0.99 where that is 1.
    """
    at = np.log([*start.q, start.noise])
    if reverting:
        rho = np.array([min(r, 0.99) for r in start.rho])
        at = np.concatenate([at, np.log(rho / (1 - rho))])
    spent = 0

    def look(p: np.ndarray) -> tuple[float, np.ndarray]:
        nonlocal spent
        spent += 1
        v = likelihood(runs, _theta(p[:2], p[2], p[3:] if reverting else None))
        return -v[0], -v[1:]

    value, gradient = look(at)
    inverse = np.eye(len(at)) / max(np.abs(gradient).max(), 1e-9)
    converged = False
    while spent < most:
        step = -inverse @ gradient
        slope = gradient @ step
        if slope > 0:
            inverse, step = np.eye(len(at)) / max(np.abs(gradient).max(), 1e-9), -gradient / max(np.abs(gradient).max(), 1e-9)
            slope = gradient @ step
        if -slope < tolerance * (1 + abs(value)) * 1e-2:
            converged = True
            break
        step = step / max(1.0, np.abs(step).max() / 3)
        slope, size = gradient @ step, 1.0
        while True:
            there, new = look(at + size * step)
            if np.isfinite(there) and there <= value + 1e-4 * size * slope or spent >= most:
                break
            size = max(size * 0.1, min(size * 0.5, -slope * size**2 / (2 * (there - value - slope * size)))) if np.isfinite(there) else size * 0.25
        if not np.isfinite(there) or there > value:
            break
        moved, change = size * step, new - gradient
        at, value, gradient = at + moved, there, new
        if (c := moved @ change) > 1e-12:
            v = np.eye(len(at)) - np.outer(moved, change) / c
            inverse = v @ inverse @ v.T + np.outer(moved, moved) / c
    rho = (1.0, 1.0) if not reverting else tuple((1 / (1 + np.exp(-at[3:]))).tolist())
    return Drift(rho, tuple(np.exp(at[:2]).tolist()), float(np.exp(at[2])), -float(value), spent, converged)


def _filtered(x: np.ndarray, y: np.ndarray, size: np.ndarray, begin: np.ndarray, target: np.ndarray, d: Drift, pull: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(errors of one-step forecasts, end states (5, runs), affine map (6, runs) of the mean) of runs that begin in states `begin`.

    States are intercept, slope and their three variances.  pull: (2,) variances t2; after each
    row a coefficient goes to t2 / (t2 + its variance) of itself and the rest of the target.
    """
    order = np.argsort(-size, kind="stable")
    start = (np.cumsum(size) - size)[order]
    live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
    s, c, error = begin[:, order].copy(), target[:, order], np.empty(len(x))
    a = np.zeros((6, len(size)))
    a[0] = a[3] = 1.0
    rho, q = np.array(d.rho)[:, None], np.array(d.q)
    for t, n in enumerate(live.tolist()):
        m = c[:, :n] + rho * (s[:2, :n] - c[:, :n])
        p00, p01, p11 = rho[0] ** 2 * s[2, :n] + q[0], rho[0] * rho[1] * s[3, :n], rho[1] ** 2 * s[4, :n] + q[1]
        h = x[start[:n] + t]
        g = np.stack([p00 + h * p01, p01 + h * p11])
        v = g[0] + h * g[1] + d.noise
        k = g / v
        off = y[start[:n] + t] - m[0] - h * m[1]
        error[start[:n] + t] = off
        # Joseph's form keeps variances positive.
        keep = np.stack([1 - k[0], -k[0] * h, -k[1], 1 - k[1] * h])
        left = np.stack([keep[0] * p00 + keep[1] * p01, keep[0] * p01 + keep[1] * p11, keep[2] * p00 + keep[3] * p01, keep[2] * p01 + keep[3] * p11])
        s[2, :n] = left[0] * keep[0] + left[1] * keep[1] + d.noise * k[0] ** 2
        s[3, :n] = left[0] * keep[2] + left[1] * keep[3] + d.noise * k[0] * k[1]
        s[4, :n] = left[2] * keep[2] + left[3] * keep[3] + d.noise * k[1] ** 2
        m = m + k * off
        b = c[:, :n] + rho * (a[4:, :n] - c[:, :n])
        b = b + k * (y[start[:n] + t] - b[0] - h * b[1])
        rows = np.stack([a[0, :n] * d.rho[0], a[1, :n] * d.rho[0], a[2, :n] * d.rho[1], a[3, :n] * d.rho[1]])
        moved = np.stack([keep[0] * rows[0] + keep[1] * rows[2], keep[0] * rows[1] + keep[1] * rows[3], keep[2] * rows[0] + keep[3] * rows[2], keep[2] * rows[1] + keep[3] * rows[3]])
        if pull is not None:
            w = pull[:, None] / (pull[:, None] + s[[2, 4], :n])
            m, b = w * m + (1 - w) * c[:, :n], w * b + (1 - w) * c[:, :n]
            moved = moved * np.repeat(w, 2, axis=0)
        s[:2, :n], a[:4, :n], a[4:, :n] = m, moved, b
    ends, maps = np.empty_like(s), np.empty_like(a)
    ends[:, order], maps[:, order] = s, a
    return error, ends, maps


SUMMED = "n long, sse double, intercept double, slope double, part int, first long"


def kalman(runs: DataFrame, drift: Drift, *, pull: tuple[float, float] | None = None) -> DataFrame:
    """Per rater of drift_runs(): n, the last intercept and slope, and the RMSE of one-step forecasts.

    pull: variances t2 of the coefficients, with which the state is drawn to the prior after each row.
    """
    kind = runs.schema["rater"].dataType.simpleString()
    theta = np.array([[*drift.rho, *drift.q, drift.noise]]).T
    strength = None if pull is None else np.array(pull, float)

    def forecasts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            x, y, size, prior = _lists(batch)
            begin = batch.column(6).flatten().to_numpy().reshape(-1, 5).T
            error, ends, _ = _filtered(x, y, size, begin, prior[:2], drift, strength)
            sse = np.add.reduceat(error**2, np.cumsum(size) - size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(sse), pa.array(ends[0]), pa.array(ends[1]), batch.column(1), batch.column(2)], names=["rater", "n", "sse", "intercept", "slope", "part", "first"])

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            x, y, size, prior = _lists(batch)
            e = runs_elements(x, y, size, prior[:2], theta)[:, 0].T
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(5), pa.array(list(e), pa.list_(pa.float64()))], names=["rater", "part", "first", "prior", "element"])

    def begun(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("first", "ascending")])
        prior = np.array(group.column("prior")[0].as_py())[:, None]
        now, states = prior_element(prior[:2], prior[2:], 1), []
        for element in group.column("element").to_pylist():
            states.append(now[[B0, B1, C00, C01, C11], 0, 0].tolist())
            now = combined(now, np.array(element).reshape(15, 1, 1))
        return pa.table({"rater": group.column("rater"), "part": group.column("part"), "first": group.column("first"), "begin": pa.array(states, pa.list_(pa.float64()))})

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            x, y, size, prior = _lists(batch)
            _, _, maps = _filtered(x, y, size, batch.column(6).flatten().to_numpy().reshape(-1, 5).T, prior[:2], drift, strength)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(6), pa.array(list(maps.T), pa.list_(pa.float64()))], names=["rater", "part", "first", "begin", "map"])

    def drawn(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("first", "ascending")])
        begin, maps = np.array(group.column("begin").to_pylist()), np.array(group.column("map").to_pylist())
        for i in range(1, len(begin)):
            a = maps[i - 1]
            begin[i, :2] = a[:4].reshape(2, 2) @ begin[i - 1, :2] + a[4:]
        return pa.table({"rater": group.column("rater"), "part": group.column("part"), "first": group.column("first"), "begin": pa.array(list(begin), pa.list_(pa.float64()))})

    at = f"rater {kind}, part int, first long"
    columns = ["rater", "part", "first", "x", "y", "prior"]
    whole = runs.where("alone").select(*columns, F.array(F.col("prior")[0], F.col("prior")[1], F.col("prior")[2], F.lit(0.0), F.col("prior")[3]).alias("begin"))
    cut = runs.where("not alone").select(*columns)
    begins = written(cut.mapInArrow(summaries, f"{at}, prior array<double>, element array<double>").groupBy("rater").applyInArrow(begun, f"{at}, begin array<double>"), "begins")
    cut_begun = cut.join(begins, ["rater", "part", "first"]).select(*columns, "begin")
    if strength is not None:
        begins = written(cut_begun.mapInArrow(mapped, f"{at}, begin array<double>, map array<double>").groupBy("rater").applyInArrow(drawn, f"{at}, begin array<double>"), "begins")
        cut_begun = cut.join(begins, ["rater", "part", "first"]).select(*columns, "begin")
    each = whole.unionByName(cut_begun).mapInArrow(forecasts, f"rater {kind}, {SUMMED}")
    last = F.max_by(F.struct("intercept", "slope"), F.struct("part", "first"))
    return each.groupBy("rater").agg(F.sum("n").alias("n"), last.alias("last"), F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse")).select("rater", "n", "last.intercept", "last.slope", "rmse")


def priors(train: DataFrame, *, anchored: bool = False, least: float = 1e-6) -> DataFrame:
    """rater, m_intercept, m_slope, v_intercept, v_slope: the population line and the spread of raters about it.

    anchored: each rater's own shrunken line and what is left of that spread.  Spreads are at least `least`.
    """
    c = centred(train)
    lines = rater_lines(c)
    e = shrunk(lines.crossJoin(F.broadcast(population_line(c))).crossJoin(F.broadcast(between_variance(lines, floor=least))))
    if anchored:
        return e.select("rater", *(F.col(f"eb_{k}").alias(f"m_{k}") for k in ("intercept", "slope")), *(F.greatest(F.col(f"t2_{k}") * (1 - F.col(f"w_{k}")), F.lit(least)).alias(f"v_{k}") for k in ("intercept", "slope")))
    return e.select("rater", *(F.col(f"pop_{k}").alias(f"m_{k}") for k in ("intercept", "slope")), *(F.col(f"t2_{k}").alias(f"v_{k}") for k in ("intercept", "slope")))


def starting_drift(train: DataFrame) -> Drift:
    """Noise as left by the population line, and steps of a hundredth of the raters' spread."""
    c = centred(train)
    p = population_line(c).head()
    noise = c.agg(F.avg(F.pow(F.col("y") - p["pop_intercept"] - p["pop_slope"] * F.col("x"), 2))).head()[0]
    t2 = between_variance(rater_lines(c), floor=1e-6).head()
    # Not so small that the likelihood is flat in its logarithm.
    step = lambda v: max(v * 0.01, (noise or 1.0) * 1e-3)
    return Drift((1.0, 1.0), (step(t2["t2_intercept"]), step(t2["t2_slope"])), max(noise or 1.0, 1e-8))


def time_varying_arms(timed: DataFrame) -> DataFrame:
    """Held-out errors of lines that drift beside fixed ones; timed: observations with held_out, the last of each rater.

    Arms: the population line, the shrunken line, a random walk and AR(1) from the population
    (fitted by likelihood), AR(1) about the rater's shrunken line, and that with a pull to it.
    One row per arm: raters, the mean of their RMSE and the RMSE of all rows.
    """
    train, held = written(timed.where("not held_out").select("rater", "ts", "obs_id", "x", "y"), "train"), timed.where("held_out")
    wide, own = priors(train), priors(train, anchored=True)
    t2 = wide.select("v_intercept", "v_slope").head()
    runs, anchored_runs = drift_runs(train, wide), drift_runs(train, own)
    start = starting_drift(train)
    walk, back = fit_drift(runs, start), fit_drift(runs, start, reverting=True)
    anchored = fit_drift(anchored_runs, start, reverting=True)
    arms = {
        "population": wide.select("rater", F.col("m_intercept").alias("intercept"), F.col("m_slope").alias("slope")), "shrunk": own.select("rater", F.col("m_intercept").alias("intercept"), F.col("m_slope").alias("slope")),
        "walk": kalman(runs, walk), "reverting": kalman(runs, back), "anchored": kalman(anchored_runs, anchored), "pulled": kalman(anchored_runs, anchored, pull=(t2[0], t2[1])) if t2 else kalman(anchored_runs, anchored),
    }
    lines = None
    for name, line in arms.items():
        one = line.select("rater", F.lit(name).alias("arm"), "intercept", "slope")
        lines = one if lines is None else lines.unionByName(one)
    each = held.join(lines, "rater").groupBy("arm", "rater").agg(F.count("*").alias("n"), F.sum(F.pow(F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"), 2)).alias("sse"))
    return each.groupBy("arm").agg(F.count("*").alias("raters"), F.avg(F.sqrt(F.col("sse") / F.col("n"))).alias("rmse"), F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse_pooled"))
