"""Chosen-path join against all pairs, and components."""

import re

import numpy as np

from raterline.llm import jaccard_join
from raterline.llm.components import components


def grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, grams(t)) for i, t in rows]
    alike = lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= 0.8
    links = [[k for k, (_, b) in enumerate(sets) if k != j and alike(a, b)] for j, (_, a) in enumerate(sets)]
    label = list(range(len(sets)))
    for _ in sets:
        label = [min([label[j], *(label[k] for k in links[j])]) for j in range(len(sets))]
    least = {}
    for j, c in enumerate(label):
        if sets[j][0] is not None:
            least[c] = min(least.get(c, sets[j][0]), sets[j][0])
    return sorted(((i is not None, i or 0, least.get(label[j]), len(links[j])) for j, (i, _) in enumerate(sets)), key=str)


def found(df):
    return sorted(((r.doc_id is not None, r.doc_id or 0, r.class_id, r.n_links) for r in df.collect()), key=str)


def test_small_cases(docs, texts):
    assert found(jaccard_join.near_duplicates(docs)) == brute(texts)


def test_shared_table(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(jaccard_join.near_duplicates(d)) == brute([tuple(r) for r in d.select("doc_id", "text").collect()])


def near_copies(n, seed=3):
    rng = np.random.default_rng(seed)
    base = [f"t{i}" for i in range(300)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.integers(0, 300, rng.integers(0, 5)):
            w[k] = f"u{rng.integers(1_000_000)}"
        out.append(" ".join(w))
    return out


def test_large_group_in_blocks(spark, monkeypatch):
    """Groups larger than a block, with sets nearby that are like few or none of the group: exact classes and numbers of links."""
    rows = list(enumerate([*near_copies(150), *[" ".join(t.split()[: 250 - k]) for k, t in enumerate(near_copies(12, 4))], *near_copies(9, 5)[3:], "short text"]))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert found(jaccard_join.near_duplicates(d)) == want
    monkeypatch.setattr(jaccard_join.verified, "__kwdefaults__", {**jaccard_join.verified.__kwdefaults__, "block_bytes": 40_000, "block_sets": 16})
    monkeypatch.setattr(jaccard_join.candidate_links, "__kwdefaults__", {"most": 20, "every": 1})
    assert found(jaccard_join.near_duplicates(d)) == want
    assert sorted(r.class_id for r in jaccard_join.near_duplicates(d, count=False).collect()) == sorted(r[2] for r in want)


def test_rows_of_a_large_class_stay_linear(spark):
    """Classes from 1,500 and 3,000 near copies: rows that Spark shuffles at most double, and no task takes a large part."""
    def shuffled(n):
        d = spark.createDataFrame(list(enumerate(near_copies(n))), "doc_id long, text string").repartition(8)
        store = spark.sparkContext._jsc.sc().statusStore()
        before = {s.stageId() for s in _stages(store)}
        assert jaccard_join.one_of_each(d).count() < n / 100
        return sum(s.shuffleWriteRecords() for s in _stages(store) if s.stageId() not in before)

    small, large = shuffled(1500), shuffled(3000)
    assert large < 2.5 * small


def _stages(store):
    seq = store.stageList(None, False, False, spark_quantiles(store), None)
    return [seq.apply(i) for i in range(seq.size())]


def spark_quantiles(store):
    from pyspark import SparkContext

    gateway = SparkContext._gateway
    return gateway.new_array(gateway.jvm.double, 0)


def test_repeated_rows_and_empty(twice, empty):
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(twice).collect()) == [(1, 1, 1), (1, 1, 1), (2, 2, 0), (3, 3, 0), (3, 3, 0)]
    assert jaccard_join.near_duplicates(empty).count() == 0
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(twice).collect()) == [1, 2, 3, 3]


def test_rows_that_repeat_in_large_classes(spark):
    """Near copies beyond one block, some rows standing twice or often, and two classes that only a straggler joins."""
    rows = list(enumerate(near_copies(620)))
    rows += rows[:9] + rows[:1] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.near_duplicates(d).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    assert found(jaccard_join.near_duplicates(d)) == brute(rows)
    assert sorted(r.class_id for r in jaccard_join.near_duplicates(d, count=False).collect()) == [0] * len(rows)
    assert jaccard_join.one_of_each(d).count() == 1


def test_repeated_rows_in_classes_joined_late(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join.verified, "__kwdefaults__", {**jaccard_join.verified.__kwdefaults__, "block_bytes": 40_000, "block_sets": 16})
    words = [f"t{i}" for i in range(300)]
    change = lambda k, n: " ".join([*(f"x{k}_{i}" for i in range(n)), *words[n:]])
    rows = list(enumerate([*(change(k, 20) for k in range(20)), *(" ".join([*words[:280], *(f"y{k}_{i}" for i in range(20))]) for k in range(20)), " ".join(words)]))
    rows += [*rows[::3], rows[-1], rows[-1]]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert found(jaccard_join.near_duplicates(d)) == want
    assert sorted(r.class_id for r in jaccard_join.near_duplicates(d, count=False).collect()) == sorted(r[2] for r in want)


def test_more_blocks_than_sets(spark, monkeypatch):
    """Long texts make more blocks than there are sets: links within a block count once, whatever blocks stay empty."""
    monkeypatch.setattr(jaccard_join.verified, "__kwdefaults__", {**jaccard_join.verified.__kwdefaults__, "block_bytes": 500})
    rows = list(enumerate([*near_copies(3), *near_copies(4, 9), "short text"])) + [(2, near_copies(3)[2])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard_join.near_duplicates(d)) == brute(rows)


def test_one_of_each_keeps_columns(docs):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and 4 in ids and 5 in ids and 7 in ids and 8 not in ids


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 105), (105, 103), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 103: 100, 105: 100, 200: 200}


def test_survival_falls_with_depth():
    p = [jaccard_join.survival(0.8, 0.7, d) for d in range(1, 6)]
    assert p == sorted(p, reverse=True) and p[0] > 0.6
