"""Bias models: global mean, one-sided and alternating biases, most popular items."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written
from . import blocks

_TINY = math.sqrt(2.220446049250313e-16)


def global_mean(ratings: DataFrame, weight: str | None = None, nonneg: bool = False) -> float:
    """Mean over non-missing ratings (weighted); 0 if smaller than the root of the machine epsilon, or below 0 and ``nonneg``."""
    mean = F.avg("rating") if weight is None else F.sum(F.col("rating") * F.col(weight)) / F.sum(F.when(F.col("rating").isNotNull(), F.col(weight)))
    m = ratings.agg(mean.alias("m")).first()["m"] or 0.0
    return 0.0 if abs(m) < _TINY or (nonneg and m < 0) else m


def one_sided(ratings: DataFrame, by: str, mean: float, lam: float = 10.0) -> DataFrame:
    """(by, bias): sum of (rating - mean) over count + lam."""
    return ratings.where("rating is not null").groupBy(by).agg((F.sum(F.col("rating") - mean) / (F.count("*") + lam)).alias("bias"))


def two_sided(ratings: DataFrame, mean: float, lam_user: float = 10.0, lam_item: float = 10.0, passes: int = 5) -> tuple[DataFrame, DataFrame]:
    """((user_id, user_bias), (item_id, item_bias)): alternating passes, items first.

    A bias is a factor of no values but its own, so a pass is two half-steps over ratings that are dealt once.
    """
    by_user, by_item = blocks.deal(ratings, "user_id", "item_id"), blocks.deal(ratings, "item_id", "user_id")
    side = blocks.Side(0, own_bias=True, other_bias=True, mean=mean)
    step = lambda dealt, other, lam: written(blocks.half_step(dealt, other, side, np.full(1, lam), np.zeros((1, 1))))
    users = by_user.ratings.select("id").distinct().select("id", F.array(F.lit(0.0)).alias("f"))
    items = None
    for _ in range(passes):
        items = step(by_item, users, lam_item)
        users = step(by_user, items, lam_user)
    by_user.drop()
    by_item.drop()
    bias = lambda t, key, name: t.select(F.col("id").alias(key), F.element_at("f", 1).alias(name))
    return bias(users, "user_id", "user_bias"), bias(items, "item_id", "item_bias")


def predict(rows: DataFrame, mean: float, users: DataFrame, items: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Adds pred: mean plus the known biases (an unseen user or item adds nothing), clipped where bounds are given."""
    p = F.lit(mean) + F.coalesce("user_bias", F.lit(0.0)) + F.coalesce("item_bias", F.lit(0.0))
    if low is not None:
        p = F.greatest(p, F.lit(low))
    if high is not None:
        p = F.least(p, F.lit(high))
    return rows.join(users, "user_id", "left").join(items, "item_id", "left").withColumn("pred", p).drop("user_bias", "item_bias")


def most_popular(ratings: DataFrame, implicit: bool = False, lam: float = 10.0) -> DataFrame:
    """(item_id, score): item biases, or for implicit data the share-like sum of ratings over count + lam."""
    if implicit:
        return ratings.groupBy("item_id").agg((F.sum("rating") / (F.count("*") + lam)).alias("score"))
    return one_sided(ratings, "item_id", global_mean(ratings), lam).withColumnRenamed("bias", "score")


def center_columns(ratings: DataFrame, by: str = "item_id", weight: str | None = None) -> DataFrame:
    """Adds centered: the rating minus its column's (weighted) mean over non-missing values."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    m = ratings.where("rating is not null").groupBy(by).agg((F.sum(F.col("rating") * w) / F.sum(w)).alias("__m"))
    return ratings.join(m, by, "left").withColumn("centered", F.col("rating") - F.col("__m")).drop("__m")
