"""Lines whose coefficients follow a spline in time (T1, state-space models, is in state_space).

A rater's rows are one group of applyInArrow; they are bounded by what one person rates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def spline_basis(t: np.ndarray, knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(basis, roughness) of natural cubic splines by their values at the knots; t lies within the knots.

    basis @ v is the spline through the values v at the places t; v @ roughness @ v is the
    integral of its squared second derivative.
    """
    h, m = np.diff(knots), len(knots)
    inner = np.arange(m - 2)
    bend = np.zeros((m - 2, m))
    bend[inner, inner], bend[inner, inner + 2] = 1 / h[:-1], 1 / h[1:]
    bend[inner, inner + 1] = -1 / h[:-1] - 1 / h[1:]
    band = np.diag((h[:-1] + h[1:]) / 3) + np.diag(h[1:-1] / 6, 1) + np.diag(h[1:-1] / 6, -1)
    # Second derivatives at the knots, zero at both ends, as a linear map of the values.
    second = np.zeros((m, m))
    second[1:-1] = np.linalg.solve(band, bend)
    k = np.clip(np.searchsorted(knots, t, side="right") - 1, 0, m - 2)
    right = (t - knots[k]) / h[k]
    left, values = 1 - right, np.eye(m)
    cubic = (left**3 - left)[:, None] * second[k] + (right**3 - right)[:, None] * second[k + 1]
    return left[:, None] * values[k] + right[:, None] * values[k + 1] + cubic * (h[k] ** 2 / 6)[:, None], bend.T @ second[1:-1]


def spline(obs: DataFrame, *, knots: int = 4, ridges: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), held: int = 5) -> DataFrame:
    """Per rater: the line whose intercept and slope follow a spline in time, and the ridge that the last rows chose.

    Raters with under 3 * held rows are left out.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("ts", "ascending"), ("obs_id", "ascending")])
        x, y = rows.column("x").to_numpy(), rows.column("y").to_numpy()
        n = len(x)
        if n < 3 * held:
            return pa.table({"rater": rows.column("rater").slice(0, 0), "ridge": pa.array([], pa.float64()), "held_rmse": pa.array([], pa.float64()), "last_intercept": pa.array([], pa.float64()), "last_slope": pa.array([], pa.float64())})
        t = np.linspace(0, 1, n)
        b, rough = spline_basis(t, np.linspace(0, 1, knots))
        z = np.hstack([b, b * x[:, None]])
        penalty = np.kron(np.eye(2), rough)
        train = slice(0, n - held)
        solve = lambda r, s: np.linalg.solve(z[s].T @ z[s] + r * penalty + 1e-9 * np.eye(z.shape[1]), z[s].T @ y[s])
        errors = [(float(np.sqrt(np.mean((y[n - held :] - z[n - held :] @ solve(r, train)) ** 2))), r) for r in ridges]
        rmse, ridge = min(errors)
        w = solve(ridge, slice(0, n))
        return pa.table({"rater": rows.column("rater").slice(0, 1), "ridge": [ridge], "held_rmse": [rmse], "last_intercept": [float(b[-1] @ w[: b.shape[1]])], "last_slope": [float(b[-1] @ w[b.shape[1] :])]})

    kind = obs.schema["rater"].dataType.simpleString()
    return obs.select("rater", "ts", "obs_id", "x", "y").groupBy("rater").applyInArrow(run, f"rater {kind}, ridge double, held_rmse double, last_intercept double, last_slope double")
