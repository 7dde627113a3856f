"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterline.llm.common import written


def hashed_share(seed: str) -> F.Column:
    """A number in [0, 1) drawn from doc_id alone, the same on every run and partitioning."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def by_class(rows: DataFrame, label: str, most: int, seed: str, *, most_bytes: int = 4 << 20, most_rows: int = 20_000) -> DataFrame:
    """About `most` whole rows of every class of labelled rows: doc_id, the label, and either text or its bytes as `size`.

    With `size` in place of the text, rows can be labelled by a join that moves no text; the
    sample is then small enough to broadcast.

    The sample is bounded by three parameters, each in expectation: `most` rows and `most_bytes`
    of text a class, and `most_rows` in all, which many classes share evenly.  Every class,
    however many there are, keeps the rows whose hash falls under its share; a text of over an
    eighth of `most_bytes` is drawn at a share that is lower by as much as it is longer.  One row
    of each class is always drawn, whatever the shares: its first by hash, among texts within
    that eighth if it has any that are not empty, else among its shortest.  So no class is left
    out for its size or by chance; what exceeds the bounds is at most one row a class.

    Shares are a small table that is joined, so no class is gathered anywhere.  Rows without
    doc_id or label are not drawn.
    """
    body = "size" if "text" not in rows.columns else "text"
    size = F.coalesce(F.col("size") if body == "size" else F.octet_length("text"), F.lit(0)).cast("long")
    cap = F.lit(most_bytes // 8).cast("long")
    rows = rows.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", body, label)
    place = F.struct((size == 0).alias("none"), F.greatest(size, cap).alias("over"), hashed_share(seed).alias("h"), F.col("doc_id").alias("doc_id"))
    counts = written(rows.groupBy(label).agg(F.count("*").alias("_n"), F.sum(F.least(size, cap)).alias("_bytes"), F.min(place).alias("_first")), "classes")
    each = min(most, max(1, most_rows // max(counts.count(), 1)))
    share = counts.select(label, F.least(each / F.col("_n"), most_bytes / F.greatest(F.col("_bytes"), F.lit(1))).alias("_share"), "_first")
    lower = F.least(F.lit(1.0), cap / F.greatest(size, F.lit(1)))
    drawn = (hashed_share(seed) < F.col("_share") * lower) | (F.col("doc_id") == F.col("_first.doc_id"))
    return rows.join(share, label).where(drawn).select("doc_id", body, label)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id and size of every row."""
    return docs.select("doc_id", F.octet_length(F.col("text").cast("string")).alias("size"))
