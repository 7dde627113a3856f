"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from raterline.llm import ranked_search as rs
from raterline.llm.queries import QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, queries, k=50):
    own = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = {}
    for item, text in queries:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, ts in asked.items():
        scored = []
        for i, c in own:
            if c:
                m = 50 + 50 * sum(c.values()) * n // total
                scored.append((-sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c), i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    assert df.columns[1:] == ["rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_query(spark, sf_dir):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c).collect()]
    got = QUERIES["op13_ranked_search"](spark, sf_dir)
    assert found(got) == brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))


ITEMS = [(1, "w3 W17 w3 odd"), (2, "the"), (2, "café w9"), (3, None), (4, "..."), (None, "short"), (5, "no-such term"), (6, "日本語 x " + "x" * 3000)]


def test_odd_rows(spark, docs, texts, empty):
    items = spark.createDataFrame([(i, t, 3, 4) for i, t in ITEMS], "item_id long, text string, rank int, score long")
    rows = texts + texts[:6]
    twice = docs.unionAll(docs.where("doc_id <= 6"))
    assert found(rs.ranked_search(twice, items, k=3)) == brute(rows, ITEMS, 3)
    named = items.selectExpr("cast(item_id as string) as name", "text")
    assert found(rs.ranked_search(docs, named, id_column="name")) == brute(texts, [(None if i is None else str(i), t) for i, t in ITEMS])
    assert found(rs.ranked_search(empty, items)) == found(rs.ranked_search(docs, items.limit(0))) == []
    assert rs.ranked_search(empty, items).columns == ["item_id", "rank", "doc_id", "score"]


def corpus(n, seed=1):
    """Documents of several subjects, with many copies of one of them, and queries on a subject each."""
    rng = random.Random(seed)
    subject = [[f"s{j}w{i}" for i in range(60)] for j in range(8)]
    common = [f"c{i}" for i in range(30)]
    one = lambda j, size: " ".join(rng.choice(subject[j] if rng.random() < 0.6 else common) for _ in range(size))
    rows = [(i, one(i % 8, rng.randint(3, 60))) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(n // 3)]
    rng.shuffle(rows)
    return rows, [(j, one(j % 8, 12)) for j in range(16)] + [(99, "c1 c2")]


def test_many_shards_ties_and_blocks(spark, monkeypatch):
    """Small shards: shards are left out, ties at the k-th score go by doc_id, blocks of queries give what one gives."""
    rows, items = corpus(900)
    d, q = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items, 20)
    monkeypatch.setattr(rs, "SHARD", 16)
    seen = []
    real = rs.scores
    monkeypatch.setattr(rs, "scores", lambda visits, *rest: seen.append(visits.selectExpr("sum(size(asked))").head()[0]) or real(visits, *rest))
    assert found(rs.ranked_search(d, q, k=20)) == want
    assert 0 < sum(seen) < 0.7 * 17 * 1200 / 16  # far from every query in every shard
    monkeypatch.setattr(rs, "BLOCK", 40)
    assert found(rs.ranked_search(d, q, k=20)) == want


def test_bisection_gathers_subjects():
    rng = np.random.default_rng(2)
    subject = rng.integers(0, 2, 600)
    x = np.zeros((600, rs.BUCKETS), np.float32)
    for i, s in enumerate(subject):
        x[i, s * 100 + rng.integers(0, 100, 30)] = 1
        x[i, 200 + rng.integers(0, 100, 10)] = 1
    left, _ = rs.bisect(x)
    assert left.sum() == 300
    share = subject[left].mean()
    assert min(share, 1 - share) < 0.05
    tree = rs.bisections(x)
    leaf = rs.clusters(x, tree)
    assert len(tree) == 7 and set(leaf.tolist()) <= set(range(8))
    assert np.mean([max(c := np.bincount(subject[leaf == k], minlength=2)) / c.sum() for k in set(leaf.tolist())]) > 0.95


def test_lengths_beyond_64_bits():
    n = np.array([10**9, 3])
    assert rs.lengths(n, 10**11, 10**13).tolist() == [50 + 50 * 10**9 * 10**11 // 10**13, 50 + 50 * 3 * 10**11 // 10**13]


@pytest.mark.parametrize("size", [0, 1, 63, 64, 130])
def test_small_samples(size):
    x = np.ones((size, rs.BUCKETS), np.float32)
    assert len(rs.clusters(x, rs.bisections(x))) == size


def test_very_long_text(spark):
    rows = [(1, "needle " + "hay " * 1_200_000), (2, "needle"), (3, "hay " * 10)]
    items = [(1, "needle hay"), (2, "straw " * 300_000)]
    assert found(rs.ranked_search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))) == brute(rows, items)
