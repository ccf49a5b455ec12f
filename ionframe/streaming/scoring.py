"""Streaming use of the engine: additive relation counters and stateless scoring.

Fits need all rows in every step and so are batch; counters add up, so they can be kept for
windows of event time, and scores of arriving spectra need only a finished model table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_rates(pairs: DataFrame, time: str, by: list[str], on_pair: Column, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """On and off counts of each group and window of a stream (or a table) of related pairs."""
    stream = pairs.withWatermark(time, late) if pairs.isStreaming else pairs
    w = F.window(time, window, slide) if slide else F.window(time, window)
    counted = stream.groupBy(w, *by).agg(F.count_if(on_pair).alias("on_count"), F.count_if(~on_pair).alias("off_count"))
    return counted.select(F.col("window.start").alias("window_start"), *by, "on_count", "off_count")


def score_batches(stream: DataFrame, score, sink: str, checkpoint: str):
    """Start a query that writes score(batch) of every micro-batch as Parquet, once each: a batch
    has a folder of its own, which a repeated batch overwrites."""

    def write(batch: DataFrame, epoch: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
