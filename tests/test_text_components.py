"""Components of sparse text vectors against a dense decomposition."""

import re
from collections import Counter

import numpy as np
import pytest

from raterline.operators import text_components as tc


def dense(texts, least=2, most=2000):
    terms = []
    for t in texts:
        w = [x for x in re.split(r"[^a-zà-ÿ]+", (t or "").lower()) if x]
        terms.append(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df = Counter(x for own in terms for x in set(own))
    kept = sorted((x for x in df if df[x] >= least), key=lambda x: (-df[x], x))[:most]
    at = {x: i for i, x in enumerate(kept)}
    m = np.zeros((len(texts), len(kept)))
    for i, own in enumerate(terms):
        for x in own:
            if x in at:
                m[i, at[x]] += 1
    return kept, m * np.log((len(texts) + 1) / (np.array([df[x] for x in kept]) + 1))


def corpus(seed=1, n=160):
    rng = np.random.default_rng(seed)
    topics = [[f"{c}{d}" for d in "abcdefghij"] for c in ("ka", "lo", "mi")]
    return [" ".join(rng.choice(topics[i % 3] if rng.random() < 0.8 else topics[(i + 1) % 3]) for _ in range(rng.integers(3, 25))) for i in range(n)]


def test_components_equal_a_dense_decomposition(spark):
    texts = [*corpus(), None, "", "UPPER kaa, kaa! 12 kab"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, term string").repartition(5)
    c, rows = tc.fit_components(df, "text", 4)
    terms, x = dense(texts)
    assert c.terms == terms and c.rows == len(texts)
    centred = x - x.mean(axis=0)
    s = np.linalg.svd(centred, compute_uv=False)
    assert np.allclose(np.sqrt(c.variances * (len(texts) - 1)), s[:4], rtol=0.01)
    assert np.allclose(c.axes.T @ c.axes, np.eye(4), atol=1e-9)
    got = {r.id: r.components for r in tc.scored(rows, c).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], centred @ c.axes, atol=1e-9)
    assert tc.scored(rows, c).columns == ["id", "term", "components"]


def test_singular_values_on_the_shared_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    c, rows = tc.fit_components(df, "text")
    n = df.count()
    m = np.zeros((n, len(c.terms)))
    for i, r in enumerate(rows.collect()):
        np.add.at(m[i], r["at"], 1)
    s = np.linalg.svd(m * c.idf - (m * c.idf).mean(axis=0), compute_uv=False)
    assert np.allclose(np.sqrt(c.variances * (n - 1)), s[:5], rtol=0.01)


def test_few_terms_and_empty(spark):
    one = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id int, text string")
    c, rows = tc.fit_components(one, "text", 5)
    assert c.axes.shape[1] <= 2 and tc.scored(rows, c).count() == 3
    c, rows = tc.fit_components(one.limit(0), "text")
    assert c.terms == [] and tc.scored(rows, c).count() == 0
    c, rows = tc.fit_components(spark.createDataFrame([(1, None)], "id int, text string"), "text")
    assert tc.scored(rows, c).head().components == [] and c.variances.tolist() == pytest.approx([])
