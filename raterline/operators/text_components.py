"""principal components of TF-IDF vectors, by a randomised range finder over sparse rows.

A text is kept as the numbers of its terms (words and pairs of words of a vocabulary of at most
`most`).  The covariance is never formed: every pass multiplies it by a thin matrix, for which
tasks return one row of `terms x columns` sums each; the driver orthogonalises that matrix.  A few
passes turn it to the leading components, and one more gives their values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterline.sources.files import written


@dataclass
class Components:
    """terms, their idf weights and means; axes (terms x k, unit columns) and the variances along them."""

    terms: list[str]
    idf: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    rows: int


def term_array(text: Column) -> Column:
    """Lower-case words of letters, and pairs of neighbours."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def vocabulary(df: DataFrame, text: str, *, least: int, most: int) -> tuple[list[str], np.ndarray, int]:
    """(terms, the number of texts that hold each, number of texts): the `most` frequent of those in `least` texts or more."""
    n = df.count()
    found = df.select(F.explode(F.array_distinct(term_array(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = found.orderBy(F.desc("n"), "term").limit(most).collect()
    return [r["term"] for r in top], np.array([r["n"] for r in top], float), n


def _sparse(df: DataFrame, text: str, keys: list[str], terms: list[str]) -> DataFrame:
    """keys and `at`: the numbers of a text's terms, as often as they stand there."""
    known = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            own = batch.column(batch.num_columns - 1)
            size = pc.list_value_length(own).to_numpy().astype(np.int64)
            at = pc.index_in(own.flatten(), value_set=known)
            here = np.asarray(at.is_valid().to_numpy(zero_copy_only=False), bool)
            left = np.bincount(np.repeat(np.arange(len(size)), size)[here], minlength=len(size))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(left)), pa.int32()), at.drop_null())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*keys, "at"])

    kinds = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in keys)
    return df.select(*keys, term_array(F.col(text)).alias("_terms")).mapInArrow(run, f"{kinds}, at array<int>")


def _weights(at: pa.ListArray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf-idf) of the cells that are not zero."""
    size = pc.list_value_length(at).to_numpy().astype(np.int64)
    cell, tf = np.unique(np.repeat(np.arange(len(size)), size) * len(idf) + at.flatten().to_numpy().astype(np.int64), return_counts=True)
    row, term = cell // len(idf), cell % len(idf)
    return row, term, tf * idf[term]


def _gathered(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of `values` by their place (sorted), for n places."""
    out = np.zeros((n, values.shape[1]))
    if len(place):
        start = np.flatnonzero(np.diff(place, prepend=-1))
        out[place[start]] = np.add.reduceat(values, start, axis=0)
    return out


def _product(rows: DataFrame, idf: np.ndarray, thin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum over rows of x (x thin), sum of x): one pass."""
    terms, k = thin.shape
    shared = rows.sparkSession.sparkContext.broadcast((idf, thin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, q = shared.value
        total = np.zeros((terms, k + 1))
        for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            row, term, x = _weights(batch.column(0), weight)
            y = _gathered(row, x[:, None] * q[term], batch.num_rows)
            order = np.argsort(term, kind="stable")
            total += _gathered(term[order], np.concatenate([x[:, None] * y[row], x[:, None]], axis=1)[order], terms)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["i", "v"])

    got = rows.select("at").mapInArrow(run, "i int, v array<double>").groupBy("i").agg(F.array(*(F.sum(F.col("v")[j]) for j in range(k + 1))).alias("v")).collect()
    out = np.zeros((terms, k + 1))
    for r in got:
        out[r["i"]] = r["v"]
    return out[:, :k], out[:, k]


def fit_components(df: DataFrame, text: str, k: int = 5, *, least: int = 2, most: int = 2000, extra: int = 8, passes: int = 5, seed: int = 7) -> tuple[Components, DataFrame]:
    """(components, stored rows of term numbers with df's other columns).

    passes: multiplications by the covariance, one over the rows each; extra: columns beside the
    k that are asked for.  Fewer come out where there are fewer terms or rows.  Signs are such that
    each axis has its largest entry positive.
    """
    keys = [c for c in df.columns if c != text]
    terms, holding, n = vocabulary(df, text, least=least, most=most)
    idf = np.log((n + 1) / (holding + 1))
    rows = written(_sparse(df, text, keys, terms), "term-numbers")
    width = min(k + extra, len(terms), max(n - 1, 0))
    if not width:
        return Components(terms, idf, np.zeros(len(terms)), np.zeros((len(terms), 0)), np.zeros(0), n), rows
    thin, total, mean = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(terms), width)))[0], None, None
    for last in range(passes + 1):
        product, total = _product(rows, idf, thin)
        mean = total / n
        # Centring takes the mean's own part off.
        product = (product - n * np.outer(mean, mean @ thin)) / max(n - 1, 1)
        if last == passes:
            break
        thin = np.linalg.qr(product)[0]
    small = thin.T @ product
    value, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-value)[:k]
    axes = thin @ turn[:, order]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    return Components(terms, idf, mean, axes, np.maximum(value[order], 0), n), rows


def scored(rows: DataFrame, c: Components) -> DataFrame:
    """Stored rows of fit_components() with `components`, their places along the axes."""
    keys = [n for n in rows.columns if n != "at"]
    shared = rows.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            row, term, x = _weights(batch.column(batch.num_columns - 1), m.idf) if len(m.terms) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            y = _gathered(row, x[:, None] * m.axes[term], batch.num_rows) - m.mean @ m.axes
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(y), pa.list_(pa.float64()))], names=[*keys, "components"])

    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in keys)
    return rows.select(*keys, "at").mapInArrow(run, f"{kinds}, components array<double>")
