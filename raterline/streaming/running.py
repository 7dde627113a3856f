"""Rater sums and lines kept up to date by Structured Streaming.

The six sums add up, so they are ordinary streaming aggregates: state is one row per rater, or
per rater and window with a watermark that lets old windows go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterline.operators.regression import line, sums


def running_lines(stream: DataFrame, about_x: float = 0.0, about_y: float = 0.0) -> DataFrame:
    """Per rater: sums and the line so far.  about_*: fixed centres, such as past means."""
    centred = stream.where("rater is not null and x is not null and y is not null").withColumns(
        {"cx": F.col("x") - about_x, "cy": F.col("y") - about_y, "mx": F.lit(float(about_x)), "my": F.lit(float(about_y))}
    )
    return line(sums(centred, "rater"))


def windowed_means(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Per rater and time window: rows and mean rating; rows later than `late` are passed over."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("rater", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.avg("y").alias("mean_y")).select("rater", F.col("w.start").alias("start"), "n", "mean_y")


def delayed(rows: DataFrame, k: int, *, key: str = "rater") -> DataFrame:
    """Scores shown k batches late, zero before: consecutive equal batch signatures count as one batch."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy("step")
    once = rows.withColumn("_new", F.coalesce(F.col("signature") != F.lag("signature").over(w), F.lit(True))).where("_new").drop("_new")
    return once.withColumn("delayed", F.coalesce(F.lag("score", k).over(w), F.lit(0.0)))
