"""Token counts against the tokenizer's own library."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from raterline.llm import token_counts as tc
from raterline.llm.queries import QUERIES, tokenizer_path

PARTS = [*" \t\n\r\x0b\x1c\x00'!?.,-abcSTX019éüß日本語テ²Ⅷ", "\u3000", "\u0085", "\u0301", "\U0001f600", "\u200b", "'s", "'re", "'ll", "'v", " '", "\n's", "<|endoftext|>", "<|end", "  "]


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter(path):
    return tc.Counter(path)


def test_query_against_the_library(spark, sf_dir, library):
    got = QUERIES["op11_token_counts"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((r.doc_id, len((r.text or "").encode()), n := library(r.text), n > 512) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert sorted(map(tuple, got.collect())) == want


def test_odd_rows_and_extra_columns(spark, docs, empty, path, library):
    clash = docs.selectExpr("*", "5 as n_tokens", "'x' as over_limit")
    got = tc.token_counts(clash, path)
    by = lambda rows: sorted(rows, key=str)
    assert by(map(tuple, got.collect())) == by((r.doc_id, len((r.text or "").encode()), n := library(r.text), n > 512) for r in docs.collect())
    assert tc.token_counts(empty, path).count() == 0
    assert tc.token_counts(docs.unionAll(docs), path).count() == 2 * docs.count()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=5))
def test_any_text(counter, library, texts):
    assert counter(pa.array(texts)).tolist() == [library(t) for t in texts]


@pytest.mark.parametrize("long", [2, 8, tc.LONG])
def test_mixed_parts_and_both_ways_to_merge(counter, library, monkeypatch, long):
    monkeypatch.setattr(tc, "LONG", long)
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(2000)] + [None, "", "aaaaaaa", "x" * 3000, "ab" * 900, "日本" * 700]
    assert counter(pa.array(texts)).tolist() == [library(t) for t in texts]


def test_texts_of_megabytes(counter, library, monkeypatch):
    """Five megabytes of prose, cut at white space; and half a megabyte without any."""
    rng = random.Random(6)
    prose = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) + rng.choice(["", ".", "'s", "\n ", "  "]) for _ in range(800_000))
    run = "".join(rng.choices("etaoinshrdlu", k=500_000))
    assert len(prose) > 4_000_000
    assert counter(pa.array([prose, run, "end"])).tolist() == [library(prose), library(run), library("end")]
    monkeypatch.setattr(tc.pieces, "__defaults__", (7,))
    assert [*tc.pieces("")] == [""] and "".join(tc.pieces(prose[:5000])) == prose[:5000]
    assert sum(counter.plain(pa.array([p]))[0] for p in tc.pieces(prose[:5000])) == library(prose[:5000])


def test_vocabularies_out_of_order_are_refused():
    with pytest.raises(ValueError):
        tc.Merges.read({"merges": ["ab c", "a b"]})
    made = tc.Merges.read({"merges": []})
    assert tc.surviving(np.frombuffer(b"abc", np.uint8).astype(np.int32), np.array([1, 2]), made).tolist() == [1, 2]
