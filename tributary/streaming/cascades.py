"""Cascade statistics from an unbounded stream of events.

The state is the first adoption of each (user, item); each micro-batch merges into it, so replays and
late events give what a batch over the same events gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cascades
from ..sources.tables import adoptions_of


def first_adoptions(events: DataFrame) -> DataFrame:
    """Streaming aggregate (complete or update mode): (user_id, item_id, ts, rating)."""
    return adoptions_of(events)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Adoption events per item and window; events later than ``late`` are dropped by the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("item_id", F.get_json_object("props", "$.k").cast("long"))
    return e.withWatermark("ts", late).groupBy(F.window("ts", width), "item_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "item_id", "n", "total")


def user_stats_sink(path: str):
    """A foreachBatch writer: each complete result replaces the statistics under ``path``."""

    def write(batch: DataFrame, epoch: int) -> None:
        users = batch.select("user_id").distinct()
        cascades.user_stats(cascades.cascades(batch), users).write.mode("overwrite").parquet(path)

    return write
