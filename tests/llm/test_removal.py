"""Suffix-array and substring dedup against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from raterline.llm import substring_dedup, suffix_dedup


def brute_bytes(rows, length=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def brute_words(rows, length=20):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first, out = {}, []
    for i, w in sorted(split, key=lambda r: (r[0] is not None, r[0])):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first.setdefault(tuple(w[k : k + length]), (i, k)) != (i, k):
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, *map(str, r[1:]))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_bytes_match_brute_force(docs, texts):
    assert got(suffix_dedup.remove_recurring(docs)) == sorted(brute_bytes(texts), key=key)


def test_words_match_brute_force(docs, texts):
    assert got(substring_dedup.remove_repeats(docs)) == sorted(brute_words(texts), key=key)


def test_shared_tables_match_brute_force(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in d.select("doc_id", "text").collect()]
    assert got(suffix_dedup.remove_recurring(d)) == sorted(brute_bytes(rows), key=key)
    assert got(substring_dedup.remove_repeats(d)) == sorted(brute_words(rows), key=key)


def test_repeated_rows(twice):
    """A repeated row is one more text to the first operator, and the same document to the second."""
    rows = [tuple(r) for r in twice.select("doc_id", "text").collect()]
    assert got(suffix_dedup.remove_recurring(twice)) == sorted(brute_bytes(rows), key=key)
    once = brute_words(sorted(set(rows)))
    assert got(substring_dedup.remove_repeats(twice)) == sorted([r for r in once for _ in range(2 if r[0] in (1, 3) else 1)], key=key)


def test_rows_are_told_apart_beyond_their_keys():
    """Two documents whose keys agree by accident stay two."""
    from raterline.llm import slabs

    t = pa.table({"key": [5, 5, 5, 5], "doc_id": pa.array([1, 2, 1, None], pa.int64()), "text": ["a", "b", "a", "c"]})
    assert slabs.ordered(t).select(["doc_id", "copies"]).to_pylist() == [{"doc_id": 1, "copies": 2}, {"doc_id": 2, "copies": 1}, {"doc_id": None, "copies": 1}]


def test_a_long_text(spark):
    """One text of some megabytes among short ones, a part of it copied."""
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in rng.integers(0, 10**7, 400_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[200_000:200_090])), (3, "short")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substring_dedup.remove_repeats(d)) == sorted(brute_words(rows), key=key)
    mine = {r.doc_id: r for r in suffix_dedup.remove_recurring(d).collect()}
    size = len(rows[1][1])
    assert (mine[2].n_removed, mine[2].n_spans) == (size, 1) and size <= mine[1].n_removed <= size + 4 and mine[1].n_spans == 1 and mine[3].n_removed == 0


def test_empty(empty):
    assert got(suffix_dedup.remove_recurring(empty)) == [] and got(substring_dedup.remove_repeats(empty)) == []


@pytest.mark.parametrize("text", [b"banana", b"abracadabra" * 30, bytes(range(1, 200)) * 3, b"a" * 500])
def test_run_length_index(text):
    t = np.frombuffer(text, np.uint8)
    order = suffix_dedup.suffix_array(t, suffix_dedup._eights(t))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    stats = suffix_dedup.build_index(t).matching_statistics(len(t))

    def shared(i, j):
        n = 0
        while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
            n += 1
        return n

    if len(text) <= 500:
        assert stats.tolist() == [max((shared(i, j) for j in range(len(text)) if j != i), default=0) for i in range(len(text))]


def test_large_anchor_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    rng = np.random.default_rng(1)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    middle, texts = word(90), []
    for _ in range(30):
        left, right = word(150), word(150)
        texts += [left + middle + word(100), word(100) + middle + right, left + middle + right]
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.array([t.index(middle) + 20 for t in texts])
    blocks = list(suffix_dedup._blocks(np.zeros(len(texts), np.uint64), size, begin, buf, at, 200))
    assert len(blocks) > 1
    found = np.zeros(len(buf), bool)
    for b in blocks:
        own = np.concatenate([np.arange(begin[k], begin[k] + size[k]) for k in b])
        found[own] |= suffix_dedup.recurring_strings(buf[own], size[b], 200)
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    # Of real segments every string holds the anchor; here only those that do are compared.
    holds = [k + 200 <= len(t) and middle[20:52] in t[k : k + 200] for t in texts for k in range(len(t))]
    want = [k + 200 <= len(t) and seen[t[k : k + 200]] > 1 for t in texts for k in range(len(t))]
    assert any(h and w for h, w in zip(holds, want))
    assert [f for f, h in zip(found.tolist(), holds) if h] == [w for w, h in zip(want, holds) if h]


def test_no_bucket_gets_a_common_passage_whole(spark):
    """A passage that many texts share in differing surroundings goes to all buckets, with the right result."""
    rng = np.random.default_rng(2)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    middle, texts = word(120), []
    for k in range(150):
        left, right = word(150), word(150)
        texts += [left + middle + word(100), word(100) + middle + right, left + middle + right][: 3 if k % 5 == 0 else 2]
    rows = [*enumerate([*texts, texts[0], middle + word(300), None])]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string")
    assert got(suffix_dedup.remove_recurring(docs, block=5000)) == sorted(brute_bytes([*rows, rows[3]]), key=key)
    few = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    d = suffix_dedup.deal(suffix_dedup.keyed(docs), asked_share=0.25)
    spark.conf.set("spark.sql.shuffle.partitions", few)
    judged = suffix_dedup.answer(suffix_dedup._ask_segments(d, 200), d, suffix_dedup._judge(5000))
    sent = suffix_dedup._send_wanted(d, judged, 200).where("bucket >= 0").selectExpr("bucket", "octet_length(body) AS n").groupBy("bucket").sum("n").collect()
    size = [r[1] for r in sent]
    assert max(size) < sum(size) / 4


@pytest.mark.parametrize("block", [0, 1000])
def test_large_anchors_match_brute_force(docs, texts, block):
    assert got(suffix_dedup.remove_recurring(docs, block=block)) == sorted(brute_bytes(texts), key=key)
