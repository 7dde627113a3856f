"""Small Spark helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raterline.llm.textvec import slices
from raterline.sources.files import shared_dir, written  # noqa: F401


def keyed(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id, text and `key`, a hash of both.

    Rows that repeat both doc_id and text share a key and get the same answer; rows that
    share only a doc_id stay apart.  Other columns, whatever their names, are left out.
    """
    return docs.select(
        F.xxhash64(F.col("doc_id"), F.col(text)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    )


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df bears (names of columns do not tell cases apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo the number of folds (null ids: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


class Fields(str):
    """A schema as DDL, with its column names at hand."""

    names: list[str]


def schema(**fields: str) -> Fields:
    out = Fields(", ".join(f"`{k}` {v}" for k, v in fields.items()))
    out.names = list(fields)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(docs: DataFrame, made: Fields, most: int, f, *, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with the columns of `made`, which f(texts) gives as arrays; one pass, batches of about `most` bytes.

    Columns of docs that bear a name of `made` give way to it; all others stay, whatever their
    names, `text` only if `keep_text`.
    """
    kept = [n for n in docs.columns if n not in made.names and (keep_text or n != text)]
    out = ", ".join([*(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in kept), made])

    # A text that stays is sent once, as it is scored where it stands; else it comes last.
    stays = text in kept and docs.schema[text].dataType.simpleString() == "string"
    place, width = (kept.index(text) if stays else len(kept)), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Columns are told by their places, as names may clash.
            named = pa.RecordBatch.from_arrays(batch.columns, names=[f"{i}" for i in range(batch.num_columns)])
            for part in slices(named, f"{place}", most=most):
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *f(part.column(place))], names=[*kept, *made.names])

    more = [] if stays else [F.col(f"`{text}`").cast("string").alias(unused(docs, "_"))]
    return docs.select(*(F.col(f"`{n}`") for n in kept), *more).mapInArrow(run, out)
