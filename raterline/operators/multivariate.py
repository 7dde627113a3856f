"""Spark ML models on rater features, embeddings and texts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, NGram, OneHotEncoder, RegexTokenizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from raterline.sources.files import shared_dir, written
from raterline.sources.observations import md5_int


def encoded(df: DataFrame, categories: list[str], numbers: list[str], out: str = "features") -> DataFrame:
    """M2: indexed and one-hot categories (unseen ones keep a slot) beside numbers, in one vector; a missing number is its mean (0 without any)."""
    df = _filled(df, numbers)
    stages = [StringIndexer(inputCols=categories, outputCols=[f"{c}_i" for c in categories], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_v" for c in categories], handleInvalid="keep")] if categories else []
    stages.append(VectorAssembler(inputCols=[f"{c}_v" for c in categories] + numbers, outputCol=out))
    return Pipeline(stages=stages).fit(df).transform(df).drop(*(f"{c}_{k}" for c in categories for k in "iv"))


def _filled(df: DataFrame, numbers: list[str]) -> DataFrame:
    """A missing number is its mean, 0 without any: no row is left out for it."""
    if not numbers:
        return df
    means = df.agg(*(F.avg(c).alias(c) for c in numbers)).head()
    return df.fillna({c: float(means[c]) if means[c] is not None else 0.0 for c in numbers})


def cross_validated_r2(df: DataFrame, label: str, key: str, *, folds: int = 3, model: str = "forest", group: str = "kind", seed: int = 7) -> list[float]:
    """Held-out R2 per fold, with folds of whole raters by hash.

    model: forest, ridge, or group_mean, the mean label of the rater's `group` among the other folds.
    """
    dealt = df.withColumn("_fold", md5_int(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))) % folds)
    r2 = RegressionEvaluator(labelCol=label, metricName="r2")
    if model == "group_mean":
        s = dealt.groupBy(group, "_fold").agg(F.sum(label).alias("_s"), F.count(label).alias("_n"))
        others = lambda c, *by: (F.sum(c).over(Window.partitionBy(*by)) if by else F.sum(c).over(Window.partitionBy(F.lit(0)))) - F.sum(c).over(Window.partitionBy(*by, "_fold"))
        # A group that no other fold has takes the mean of all other folds.
        means = s.select(F.col(group).alias("_group"), F.col("_fold").alias("_left_out"), F.coalesce(others("_s", group) / F.nullif(others("_n", group), F.lit(0)), others("_s") / F.nullif(others("_n"), F.lit(0))).alias("prediction"))
        judged = dealt.join(F.broadcast(means), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_fold") == F.col("_left_out"))).select("_fold", label, "prediction")
        return [r2.evaluate(judged.where(F.col("_fold") == f)) for f in range(folds)]
    estimator = RandomForestRegressor(labelCol=label, numTrees=20, maxDepth=5, seed=seed) if model == "forest" else LinearRegression(labelCol=label, regParam=1.0, elasticNetParam=0.0)
    return [r2.evaluate(estimator.fit(dealt.where(F.col("_fold") != f)).transform(dealt.where(F.col("_fold") == f))) for f in range(folds)]


def mixtures(df: DataFrame, columns: list[str], most: int = 5, *, steps: int = 60, tolerance: float = 1e-6) -> list[dict]:
    """M3: Gaussian mixtures of 1 to `most` parts with AIC and BIC.

    EM on sums: every step is one aggregate that serves all orders at once; tasks return each
    part's weight, sums and cross-products, and the driver decomposes matrices as wide as
    `columns`.  An order rests once its likelihood moves by under `tolerance` of itself; after
    `steps` steps all do.  Parts start evenly spaced along the principal axis.  Rows with a
    null, NaN or infinite value are left out; without two rows there is no fit.
    """
    d = len(columns)
    fine = reduce(lambda a, b: a & b, (F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) & ~F.isnan(F.col(c).cast("double")) for c in columns))
    rows = written(df.where(fine).select(*(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns))), "mixture")
    s = rows.agg(F.count("*").alias("n"), F.array(*(F.avg(f"v{i}") for i in range(d))).alias("m"), F.array(*(F.stddev_pop(f"v{i}") for i in range(d))).alias("s"), F.array(*(F.corr(f"v{i}", f"v{j}") for i in range(d) for j in range(d))).alias("c")).head()
    n = s["n"]
    if n < 2:
        return []
    centre, scale = np.array(s["m"]), np.array([x if x and x > 0 else 1.0 for x in s["s"]])
    spread = np.array([x if x is not None and np.isfinite(x) else 0.0 for x in s["c"]]).reshape(d, d)
    np.fill_diagonal(spread, 1.0)
    value, axis = np.linalg.eigh(spread)
    parts = {k: Mixture.along(value[-1] ** 0.5 * axis[:, -1] * (1 if axis[np.abs(axis[:, -1]).argmax(), -1] > 0 else -1), spread, k) for k in range(1, most + 1)}
    live, likelihood = list(parts), dict.fromkeys(parts, -np.inf)
    for _ in range(steps):
        sums = _mixture_sums(rows, d, [parts[k] for k in live], centre, scale)
        for k, (total, moments) in zip(list(live), sums):
            moved, likelihood[k] = abs(total - likelihood[k]), total
            if moved <= tolerance * abs(total):
                live.remove(k)
            else:
                parts[k] = Mixture.of(moments, n, d)
        if not live:
            break
    out = []
    for k in parts:
        free = k - 1 + k * d + k * d * (d + 1) / 2
        total = likelihood[k] - n * float(np.log(scale).sum())
        out.append({"k": k, "log_likelihood": total, "aic": 2 * free - 2 * total, "bic": free * math.log(n) - 2 * total})
    return out


@dataclass
class Mixture:
    """Shares, means and covariances of a mixture's parts, in standardised units."""

    share: np.ndarray
    mean: np.ndarray
    covariance: np.ndarray

    @staticmethod
    def along(direction: np.ndarray, spread: np.ndarray, k: int) -> Mixture:
        return Mixture(np.full(k, 1 / k), np.linspace(-1, 1, k)[:, None] * direction if k > 1 else np.zeros((1, len(direction))), np.stack([spread + 1e-6 * np.eye(len(spread))] * k))

    @staticmethod
    def of(moments: np.ndarray, n: int, d: int) -> Mixture:
        """From each part's weight, sums and cross-products."""
        weight = np.maximum(moments[:, 0], 1e-9)
        mean = moments[:, 1 : 1 + d] / weight[:, None]
        cross = moments[:, 1 + d :].reshape(-1, d, d) / weight[:, None, None]
        return Mixture(weight / n, mean, cross - np.einsum("ki,kj->kij", mean, mean) + 1e-6 * np.eye(d))

    def step(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """(log likelihood of the rows, the moments weighted by what each part owns of them)."""
        d = x.shape[1]
        away = x[:, None, :] - self.mean
        form = np.einsum("nki,kij,nkj->nk", away, np.linalg.inv(self.covariance), away)
        log = np.log(self.share) - 0.5 * (form + np.linalg.slogdet(self.covariance)[1] + d * math.log(2 * math.pi))
        top = log.max(axis=1, keepdims=True)
        total = np.exp(log - top)
        whole = total.sum(axis=1, keepdims=True)
        own = total / whole
        return float((top + np.log(whole)).sum()), np.concatenate([own.sum(axis=0)[:, None], own.T @ x, np.einsum("nk,ni,nj->kij", own, x, x).reshape(-1, d * d)], axis=1)


def _mixture_sums(rows: DataFrame, d: int, models: list[Mixture], centre: np.ndarray, scale: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """One step of every mixture over all rows: one job, a short vector from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = (np.column_stack([batch.column(i).to_numpy() for i in range(d)]) - centre) / scale
                v = np.concatenate([np.append(m.ravel(), t) for t, m in (model.step(x) for model in models)])
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    # A few hundred numbers from each task.
    got = np.sum([r["v"] for r in rows.mapInArrow(run, "v array<double>").collect()], axis=0)
    out, at, width = [], 0, 1 + d + d * d
    for m in models:
        k = len(m.share) * width
        out.append((float(got[at + k]), got[at : at + k].reshape(-1, width)))
        at += k + 1
    return out


def density_grid(df: DataFrame, x: str, y: str, *, cells: int = 10) -> DataFrame:
    """M3: a two-dimensional kernel density on a grid of `cells` x `cells` points (a bounded grid)."""
    df = df.select(F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x is not null and _y is not null")
    x, y = "_x", "_y"
    s = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.stddev_samp(x).alias("sx"), F.stddev_samp(y).alias("sy"), F.count("*").alias("n"))
    step = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / (cells - 1)
    grid = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).withColumn("gx", step("x0", "x1")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).withColumn("gy", step("y0", "y1"))
    hx, hy = F.col("sx") * F.pow("n", F.lit(-1 / 6)), F.col("sy") * F.pow("n", F.lit(-1 / 6))
    u, v = (F.col(x) - F.col("gx")) / hx, (F.col(y) - F.col("gy")) / hy
    weight = F.exp(-(u * u + v * v) / 2) / (2 * math.pi * hx * hy)
    return df.crossJoin(F.broadcast(grid)).groupBy("gx", "gy").agg((F.sum(weight) / F.first("n")).alias("density"))


def prototypes(df: DataFrame, columns: list[str], k: int, seed: int = 7) -> tuple[DataFrame, float]:
    """M4: standardised features, k-means clusters (prediction) and their silhouette; a missing feature is its mean.

    Scaler, k-means and silhouette each read the rows, so these are kept in the shared folder: as a
    checkpoint, since clusters depend on partitions and order, which a table would not keep.
    """
    shared_dir(df.sparkSession)  # names a folder for checkpoints where none is set
    df = _filled(df.checkpoint(), columns)
    stages = [VectorAssembler(inputCols=columns, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), KMeans(k=k, seed=seed, predictionCol="cluster")]
    out = Pipeline(stages=stages).fit(df).transform(df).drop("_raw")
    return out, ClusteringEvaluator(predictionCol="cluster").evaluate(out)


def projected(df: DataFrame, array: str, k: int) -> DataFrame:
    """M5: principal components of an array column, as an array.

    Spark sums the moments; their matrix, as wide as one array, is decomposed on the driver.
    Directions are signed so that their largest weight is positive, and are applied to rows that
    are not centred.  Null arrays, and ones with a null, NaN or infinite entry, have null
    components and are not fitted on; nor are arrays shorter than the longest.
    """
    number = F.transform(array, lambda x: x.cast("double"))
    fine = F.coalesce(F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(array) > 0), F.lit(False))
    longest = df.where(fine).agg(F.max(F.size(array))).head()[0]
    if longest is None:
        return df.withColumn("components", F.lit(None).cast("array<double>"))
    fits = fine & (F.size(array) == longest)
    v = df.where(fits).select(array_to_vector(number).alias("v"))
    spread = np.array(v.select(Summarizer.std(F.col("v"))).head()[0])
    like = np.nan_to_num(Correlation.corr(v, "v").head()[0].toArray()) if longest > 1 else np.ones((1, 1))
    _, directions = np.linalg.eigh(like * np.outer(spread, spread))
    top = directions[:, ::-1].T[:k]
    top = top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])[:, None]
    total = lambda w: F.aggregate(F.zip_with(number, F.lit(w.tolist()), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("components", F.when(fits, F.array(*(total(w) for w in top))))


def text_vectors(df: DataFrame, text: str, *, least: int = 2, most: int = 2000) -> DataFrame:
    """TF-IDF of one- and two-word terms."""
    clean = df.withColumn(text, F.coalesce(text, F.lit("")))
    stages = [RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[^\p{L}]+"), NGram(inputCol="_w", outputCol="_b", n=2)]
    both = Pipeline(stages=stages).fit(clean).transform(clean).withColumn("_t", F.concat("_w", "_b"))
    tf = CountVectorizer(inputCol="_t", outputCol="_tf", minDF=least, vocabSize=most).fit(both).transform(both)
    return IDF(inputCol="_tf", outputCol="tfidf").fit(tf).transform(tf).drop("_w", "_b", "_t", "_tf")
