"""Logical tables bound to the analytic tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def adoptions_of(events: DataFrame) -> DataFrame:
    """(user_id, item_id, ts, rating): the first adoption of each (user, item), with the mean rating."""
    item = F.get_json_object("props", "$.k").cast("long")
    return events.select("user_id", item.alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), "value").groupBy("user_id", "item_id").agg(F.min("ts").alias("ts"), F.avg("value").alias("rating"))


def adoptions(spark: SparkSession, folder: str) -> DataFrame:
    return adoptions_of(read(spark, folder, "events"))


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, item_id, rating, ts) of orders and their lines: a row per (user, item)."""
    lines = read(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"), "l_quantity")
    orders = read(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.groupBy("user_id", "item_id").agg(F.avg("l_quantity").alias("rating"), F.min("ts").alias("ts"))


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-in for search results: (trial, model, k, lam, w_user, rmse, mae, r2, edges, flags as text) derived from orders."""
    o = read(spark, folder, "orders")
    key = F.col("o_orderkey")
    model = F.element_at(F.array(F.lit("exponential"), F.lit("powerlaw"), F.lit("rayleigh")), (key % 3 + 1).cast("int"))
    return o.select(
        key.alias("trial"),
        model.alias("model"),
        (F.lit(5) + F.col("o_custkey") % 46).alias("k"),
        (F.lit(0.01) + (key % 100) / 10.0).alias("lam"),
        (F.col("o_totalprice") / 1e5).alias("rmse"),
        (F.col("o_totalprice") / 1.5e5).alias("mae"),
        (F.lit(1.0) - F.col("o_totalprice") / 4e5).alias("r2"),
        (F.col("o_custkey") % 97).alias("edges"),
        F.when(key % 7 == 0, "False").when(key % 11 == 0, "n/a").otherwise("true").alias("sane"),
        F.when(key % 5 == 0, "0").otherwise("1").alias("baseline_sane"),
        (F.col("o_totalprice") / 1e5 - F.lit(1.5)).alias("rmse_delta"),
    )
