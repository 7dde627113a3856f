"""One text of five megabytes, beside short ones, through every operator; and ties of the classifiers."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from raterline.llm import common, decontamination, fingerprints, jaccard_join, language_id, packing, quality, secret_scan, substring_dedup, suffix_dedup, toxicity
from raterline.llm.queries import tokenizer_path

RNG = random.Random(11)
WORDS = ["".join(RNG.choices("abcdefghijklmnopqrstuvwxyz", k=RNG.randint(2, 9))) for _ in range(20_000)]
LONG = " ".join(RNG.choice(WORDS) for _ in range(900_000)) + " password = abcdef123456XYZ end"
SHORT = " ".join(WORDS[:300])


@pytest.fixture(scope="module")
def long_docs(spark):
    assert len(LONG) > 5_000_000
    rows = [(1, LONG, "en", "a", len(LONG)), (2, LONG[: len(LONG) - 40], "en", "b", 0), (3, SHORT, "en", "a", 0), (4, None, None, None, None), (5, LONG[2_000_000:2_003_000], "en", "c", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")


def test_joins_and_removal(long_docs):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(long_docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0)}
    cut = {r.doc_id: r for r in suffix_dedup.remove_recurring(long_docs).collect()}
    assert cut[1].n_bytes == len(LONG) and cut[1].n_removed >= len(LONG) - 60 and cut[5].n_removed == 3000 and cut[3].n_removed == 0
    words = {r.doc_id: r for r in substring_dedup.remove_repeats(long_docs).collect()}
    assert words[1].n_words == len(LONG.split()) and words[1].n_removed == 0 and words[2].n_removed >= words[2].n_words - 1


def test_scans(spark, long_docs):
    items = spark.createDataFrame([(7, " ".join(LONG.split()[400_000:400_030])), (8, SHORT)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.contamination(long_docs, items).collect()}
    assert got[1][:2] == (len(LONG.replace("=", " ").split()), 30) and got[1][2] == 1 and got[3] == (300, 300, 1)
    found = {r.doc_id: r for r in secret_scan.scan_secrets(long_docs, repository=F.col("doc_id"), owner=F.col("source")).collect()}
    assert found[1].n_assign == 1 and found[2].n_assign == 0 and found[4].n_assign == 0
    prints = {r.doc_id: r for r in fingerprints.fingerprint_neighbours(long_docs).collect()}
    assert prints[1].n_chars == len(LONG) and prints[1].fingerprint != prints[2].fingerprint and 0 <= prints[1].near_next <= 1
    pieces = packing.pack(long_docs.where("doc_id in (1, 4)"), tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"), F.max("length").alias("most")).collect()
    assert all(r.n == r.t and r.most <= 2048 for r in pieces) and {r.doc_id for r in pieces} == {1, 4}


def test_classifiers_read_whole_texts(spark, long_docs):
    """What tells the classes apart stands at the end of the long text."""
    end = LONG[:4_000_000] + " zzqx" * 400_000
    d = spark.createDataFrame([(1, end), (2, LONG)], "doc_id long, text string")
    net = quality.Network(np.zeros((quality.WIDTH, 256, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32), 0.0, np.array([0.0, 0.0, 0.0, 1.0]))
    net.taps[0, ord("q"), 0] = 1.0
    assert all(0 <= r.score <= 1 for r in quality.score(d, net).collect())
    weights = np.zeros(1 << toxicity.BITS, np.float32)
    import pyarrow as pa

    weights[int(toxicity.hashed_words(pa.array(["zzqx"]))[0][0])] = 9.0
    scores = {r.doc_id: r.score for r in toxicity.score(d, toxicity.WordModel(weights, -3.0)).collect()}
    assert scores[1] > 0.9 > 0.1 > scores[2]
    learn = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([(LONG[:3000], "en"), ("zzqx " * 600, "zz")] * 4)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(d, language_id.fit(learn)).collect()}
    assert got[2] == "en" and set(got.values()) <= {"en", "zz"}


def test_pipeline_stages_take_a_long_text(spark, long_docs, tmp_path):
    sf = str(tmp_path)
    long_docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(7, SHORT)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = corpus_pipeline.run(spark, sf)
    lengths = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    # The near copy and the benchmark's passage go; the long text, the empty one and the excerpt stay.
    assert set(lengths) == {1, 4, 5} and lengths[4] == 1 and lengths[1] > 900_000


def test_ties(spark):
    """Equal cosines go to the first language; rows that are alike score alike, whatever their ids' hashes."""
    learn = spark.createDataFrame([(i, "same words here", lang) for i, lang in enumerate(["b", "a"] * 5)], "doc_id long, text string, lang string")
    model = language_id.fit(learn)
    assert model.languages == ["a", "b"]
    same = spark.createDataFrame([(i, "same words here") for i in range(6)] + [(5, "same words here")], "doc_id long, text string")
    got = language_id.predict(same, model).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("a", got[0].score)} and len(got) == 7
    twice = spark.createDataFrame([(k % 10, "bad rude words" if k % 2 else f"clean text {k % 5}") for k in range(40)], "doc_id long, text string")
    m = toxicity.fit(twice, twice.where("doc_id % 2 = 1").select("doc_id"))
    assert len({r.score for r in toxicity.score(twice, m).where("text like 'bad%'").collect()}) == 1
    assert common.fold_of(F.lit(1), 5) is not None and zlib.crc32(b"1") % 5 == spark.range(1).select(common.fold_of(F.lit(1), 5)).head()[0]
