"""User feature tables: assembly, one-hot communities, scalers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_communities(membership: DataFrame, n: int = 20) -> DataFrame:
    """(community, size, rank) of the n largest; ties by community."""
    sizes = membership.groupBy("community").agg(F.count_distinct("node").alias("size"))
    return sizes.orderBy(F.desc("size"), "community").limit(n).withColumn("rank", F.row_number().over(W.orderBy(F.desc("size"), "community")))


def one_hot(nodes: DataFrame, membership: DataFrame, communities: list[int]) -> DataFrame:
    """(node, community_<c>...): 1 for members, else 0."""
    sets = membership.where(F.col("community").isin(communities)).groupBy("node").agg(F.collect_set("community").alias("c"))
    j = nodes.select("node").distinct().join(sets, "node", "left")
    return j.select("node", *[F.coalesce(F.array_contains("c", F.lit(c).cast("long")), F.lit(False)).cast("int").alias(f"community_{c}") for c in communities])


def assemble(base: DataFrame, *others: DataFrame, key: str = "node", disabled: tuple[str, ...] = ()) -> DataFrame:
    """Left joins on ``key``; missing values 0; columns in ``disabled`` (``community_*``: the group) left out."""
    out = base
    for o in others:
        out = out.join(o, key, "left")
    off = lambda c: c in disabled or ("community_*" in disabled and c.startswith("community_"))
    return out.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in out.columns if c != key and not off(c)])


def _stats(frame: DataFrame, cols: list[str], fit: DataFrame | None, key: str, agg) -> DataFrame:
    rows = frame if fit is None else frame.join(fit.select(key).distinct(), key, "left_semi")
    return frame.join(F.broadcast(rows.agg(*[a for c in cols for a in agg(c)])))


def standard(frame: DataFrame, cols: list[str], fit: DataFrame | None = None, key: str = "node") -> DataFrame:
    """(x - mean)/population std, std 0 counting as 1; statistics over the keys of ``fit``."""
    j = _stats(frame, cols, fit, key, lambda c: [F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}")])
    return j.select(key, *[((F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)).alias(c) for c in cols])


def min_max(frame: DataFrame, cols: list[str], fit: DataFrame | None = None, key: str = "node") -> DataFrame:
    """(x - min)/(max - min); a range of 0 counts as 1."""
    j = _stats(frame, cols, fit, key, lambda c: [F.min(c).alias(f"__m_{c}"), F.max(c).alias(f"__s_{c}")])
    width = lambda c: F.when(F.col(f"__s_{c}") > F.col(f"__m_{c}"), F.col(f"__s_{c}") - F.col(f"__m_{c}")).otherwise(1.0)
    return j.select(key, *[((F.col(c) - F.col(f"__m_{c}")) / width(c)).alias(c) for c in cols])


def row_l2(frame: DataFrame, cols: list[str], fit: DataFrame | None = None, key: str = "node") -> DataFrame:
    """Rows scaled to length 1; a zero row stays."""
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)))
    return frame.select(key, *[F.when(norm > 0, F.col(c) / norm).otherwise(F.col(c)).alias(c) for c in cols])


SCALERS = {"standard": standard, "minmax": min_max, "normalizer": row_l2}


def align(frame: DataFrame, users: DataFrame, key: str = "node") -> DataFrame:
    """All users, missing features 0."""
    return users.select(key).distinct().join(frame, key, "left").na.fill(0.0)
