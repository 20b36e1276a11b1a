"""Adoption cascades and their temporal statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import days


def cascades(adoptions: DataFrame, least: int = 2) -> DataFrame:
    """(item_id, pos, user_id, t_days) of items with ``least`` or more adopters, in order of (ts, user)."""
    by_item = W.partitionBy("item_id")
    out = adoptions.select("item_id", "user_id", "ts", days("ts").alias("t_days"))
    out = out.withColumn("pos", F.row_number().over(by_item.orderBy("ts", "user_id"))).withColumn("n", F.count("*").over(by_item))
    return out.where(F.col("n") >= least).select("item_id", "pos", "user_id", "t_days")


def user_stats(cascades: DataFrame, users: DataFrame, least: int = 5) -> DataFrame:
    """(user_id, mean_cascade_position, min_cascade_position, cascade_breadth) of all ``users``; positions null below ``least``."""
    s = cascades.groupBy("user_id").agg(F.avg("pos").alias("m"), F.min("pos").alias("lo"), F.count("*").alias("n"))
    enough = F.col("n") >= least
    return users.select("user_id").distinct().join(s, "user_id", "left").select(
        "user_id",
        F.when(enough, F.col("m")).alias("mean_cascade_position"),
        F.when(enough, F.col("lo")).alias("min_cascade_position"),
        F.coalesce("n", F.lit(0)).cast("long").alias("cascade_breadth"),
    )


def gaps(cascades: DataFrame) -> DataFrame:
    """(item_id, gap) in days between consecutive adoptions, positive ones only."""
    nxt = F.lead("t_days").over(W.partitionBy("item_id").orderBy("pos"))
    return cascades.select("item_id", (nxt - F.col("t_days")).alias("gap")).where("gap > 0")


def median_gap(cascades: DataFrame) -> DataFrame:
    """One row: the exact median gap and the number of gaps."""
    return gaps(cascades).agg(F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.count("*").alias("n_gaps"))


def adoption_edges(cascades: DataFrame) -> DataFrame:
    """Distinct (src, dst): dst adopted an item right after src."""
    nxt = F.lead("user_id").over(W.partitionBy("item_id").orderBy("pos"))
    return cascades.select(F.col("user_id").alias("src"), nxt.alias("dst")).where("dst is not null and src <> dst").distinct()


def influence_pairs(cascades: DataFrame) -> DataFrame:
    """(item_id, src, dst, gap): src adopted the item strictly before dst.

    Quadratic in a cascade's length by definition; the inequality is checked within the item's join.
    """
    a, b = cascades.alias("a"), cascades.alias("b")
    return a.join(b, (F.col("a.item_id") == F.col("b.item_id")) & (F.col("a.t_days") < F.col("b.t_days"))).select("a.item_id", F.col("a.user_id").alias("src"), F.col("b.user_id").alias("dst"), (F.col("b.t_days") - F.col("a.t_days")).alias("gap"))
