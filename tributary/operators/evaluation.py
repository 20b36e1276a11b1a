"""Rating and ranking metrics, candidates, recommendations, deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rating_metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(rmse, mae, r2, n) of ``predictions(rating, pred)``; r2 = 1 - SSE/SST, null where ratings don't vary."""
    e = F.col("rating") - F.col("pred")
    sse, sst = F.sum(e * e), F.var_pop("rating") * F.count("rating")
    agg = [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.when(F.var_pop("rating") > 0, 1.0 - sse / sst).alias("r2"), F.count("*").alias("n")]
    rows = predictions.where("pred is not null")
    return rows.groupBy(*by).agg(*agg) if by else rows.agg(*agg)


def ranked(scored: DataFrame) -> DataFrame:
    """Adds rank from 1 by (score descending, item)."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.col("score").desc_nulls_last(), "item_id")))


def ranking_by_user(scored: DataFrame, test: DataFrame, k: int = 10, threshold: float | None = None) -> DataFrame:
    """(user_id, precision_at_k, recall_at_k, ndcg_at_k, rr) for users with candidates and relevant items.

    ``scored(user_id, item_id, score)`` are the candidates; relevant are the test items (rated
    ``threshold`` or more).  Precision divides by k; recall by all relevant items, also those that
    aren't candidates; rr looks at the whole ranking.
    """
    relevant = (test if threshold is None else test.where(F.col("rating") >= threshold)).select("user_id", "item_id").distinct()
    hits = ranked(scored).join(relevant, ["user_id", "item_id"], "left_semi").groupBy("user_id").agg(
        F.count(F.when(F.col("rank") <= k, 1)).alias("hits"),
        F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.min("rank").alias("first"),
    )
    n = relevant.groupBy("user_id").agg(F.count("*").alias("n")).join(scored.select("user_id").distinct(), "user_id", "left_semi")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    j = n.join(hits, "user_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return j.select("user_id", (F.col("hits") / k).alias("precision_at_k"), (F.col("hits") / F.col("n")).alias("recall_at_k"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_at_k"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def ranking_means(by_user: DataFrame) -> DataFrame:
    """One row: means over users (0 without any)."""
    mean = lambda c, n: F.coalesce(F.avg(c), F.lit(0.0)).alias(n)
    return by_user.agg(mean("precision_at_k", "precision_at_k"), mean("recall_at_k", "recall_at_k"), mean("ndcg_at_k", "ndcg_at_k"), mean("rr", "mrr"), F.count("*").alias("n_users"))


def ranking_metrics(scored: DataFrame, test: DataFrame, k: int = 10, threshold: float | None = None) -> DataFrame:
    return ranking_means(ranking_by_user(scored, test, k, threshold))


def top_n(scored: DataFrame, n: int = 10, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """The n best (user_id, item_id, score, rank); items restricted to ``include`` or without ``exclude``, not both."""
    if include is not None and exclude is not None:
        raise ValueError("give include or exclude, not both")
    if include is not None:
        scored = scored.join(include.select("item_id").distinct(), "item_id", "left_semi")
    if exclude is not None:
        scored = scored.join(exclude.select("item_id").distinct(), "item_id", "left_anti")
    return ranked(scored).where(F.col("rank") <= n).select("user_id", "item_id", "score", "rank")


def deltas(frame: DataFrame, base: str, new: str, name: str) -> DataFrame:
    """Adds <name>_delta = new - base and <name>_improvement_pct = (base - new)/base*100 (null for base 0)."""
    b, n = F.col(base), F.col(new)
    return frame.withColumn(f"{name}_delta", n - b).withColumn(f"{name}_improvement_pct", F.when(b != 0, (b - n) / b * 100.0))


def reasonable(frame: DataFrame, span: float, col: str = "rmse") -> DataFrame:
    """Adds reasonable: all metrics finite and rmse at most max(10, 10*span)."""
    ok = F.lit(True)
    for c in ("rmse", "mae", "r2"):
        if c in frame.columns:
            x = F.col(c)
            ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return frame.withColumn("reasonable", F.coalesce(ok & (F.col(col) <= max(10.0, 10.0 * span)), F.lit(False)))


def span(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.min("rating").alias("lowest"), F.max("rating").alias("highest"), (F.max("rating") - F.min("rating")).alias("span"))
