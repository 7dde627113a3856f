"""The pipeline's stages and queries."""

import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and len(after) > 0.7 * len(before), name
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == before


def test_stages_keep_clashing_columns(spark, sf_dir):
    """Columns named as anything that a stage makes itself come through, on odd rows and on none."""
    names = ("score", "predicted", "_text", "_key", "_cuts", "_kept", "_again", "key", "row_key", "row_cuts", "class_id", "hits", "found", "row", "_")
    rows = [(1, "plain words of a text " * 9, "en", "a", 5), (1, "plain words of a text " * 9, "en", "a", 5), (2, None, None, None, None), (None, "", "", "", 0), (3, "password = abcdefghijkl99x", "en", "b", 1)]
    d = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for docs in (d, d.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), d.schema)
            assert docs.columns == d.columns and all(r[n] == n for r in docs.collect() for n in names), name
        left = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()}
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.redact_secrets(spark, d, sf_dir).collect()) == [0, 1, 1, 2, 3]


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
