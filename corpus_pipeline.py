"""A training-text pipeline of five stages over the documents table.

Each stage works on everything its predecessor kept; every stage but the last returns the
columns of documents.  run() writes each stage's result to the shared folder before the next
one reads it, so that a lost executor costs one stage at most.

Defined cases, for all stages: other columns, whatever their names and nulls, stay as they are;
null and empty texts are clean, have no near copies and no words of a benchmark, and pack as the
end token alone; texts of any length are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterline.llm import decontamination, jaccard_join, packing, secret_scan, toxicity
from raterline.llm.common import table, written
from raterline.llm.queries import tokenizer_path, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts scored 0.5 or more for toxicity go; the model learns from this stage's input and labels.

    Rows that repeat are judged alike; without a toxic label nothing goes.
    """
    return toxicity.without(docs, toxicity_model(spark, sf_dir, docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts alike in 0.8 or more of their five-word n-grams, one stays: that of the least doc_id.

    So one of rows that repeat both id and text stays, too; texts without words all stay.
    """
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold ten consecutive words of a benchmark item, or a whole shorter item, go.

    Rows that repeat go or stay together; items without id count, items without words find nothing.
    """
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark, but for examples that at least three sources carry.

    No row goes; rows that repeat are redacted alike; null sources are one owner.
    """
    return secret_scan.redact(docs, repository=F.col("doc_id"), owner=F.col("source"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences whose lengths are powers of two, none across documents; rows that repeat are packed once each."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
