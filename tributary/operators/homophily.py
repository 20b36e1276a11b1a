"""Local pluralistic homophily, boundary users and social edge weights, given memberships.

``undirected(u, v)`` has each edge once; ``membership(node, community)`` a row per community.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import jaccard, sigmoid
from ..functions.lineage import cut
from .graph import neighbours


def member_sets(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """(node, communities): all nodes, an empty array for those in none."""
    sets = membership.groupBy("node").agg(F.array_sort(F.collect_set("community")).alias("communities"))
    return nodes.select("node").distinct().join(sets, "node", "left").withColumn("communities", F.coalesce("communities", F.array().cast("array<long>")))


def jaccard_lph(undirected: DataFrame, nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """(node, lph): mean Jaccard of a node's and its neighbours' communities; 0 if isolated."""
    sets = member_sets(nodes, membership)
    pairs = neighbours(undirected).join(sets, "node").join(sets.select(F.col("node").alias("nb"), F.col("communities").alias("other")), "nb")
    lph = pairs.groupBy("node").agg(F.avg(jaccard("communities", "other")).alias("lph"))
    return nodes.select("node").distinct().join(lph, "node", "left").select("node", F.coalesce("lph", F.lit(0.0)).alias("lph"))


def alignment(undirected: DataFrame, nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """(node, s): how many of a node's communities occur among its neighbours."""
    m = membership.select("node", "community").distinct()
    shared = neighbours(undirected).join(m, "node").join(m.select(F.col("node").alias("nb"), "community"), ["nb", "community"])
    s = shared.groupBy("node").agg(F.count_distinct("community").alias("s"))
    return nodes.select("node").distinct().join(s, "node", "left").select("node", F.coalesce("s", F.lit(0)).cast("long").alias("s"))


def network_homophily(undirected: DataFrame, s: DataFrame) -> DataFrame:
    """One row h: correlation of s along edges oriented from the smaller node; 0 without edges or variance."""
    e = undirected.join(s.select(F.col("node").alias("u"), F.col("s").alias("su")), "u").join(s.select(F.col("node").alias("v"), F.col("s").alias("sv")), "v")
    e = e.persist()
    mean = e.agg(F.avg((F.col("su") + F.col("sv")) / 2.0).alias("mu"))
    d = e.join(F.broadcast(mean))
    a, b = F.col("su") - F.col("mu"), F.col("sv") - F.col("mu")
    return d.agg(F.sum(a * b).alias("x"), F.sum(a * a).alias("y")).select(F.when(F.coalesce("y", F.lit(0.0)) == 0.0, 0.0).otherwise(F.col("x") / F.col("y")).alias("h"))


def paper_scores(undirected: DataFrame, nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """(node, s, delta, lph_score): delta is the mean |s - s'| over neighbours, lph_score = (h + sum of delta)/N - delta."""
    undirected = undirected.persist()
    s = cut(alignment(undirected, nodes, membership))  # read four times below
    h = network_homophily(undirected, s)
    pair = neighbours(undirected).join(s, "node").join(s.select(F.col("node").alias("nb"), F.col("s").alias("t")), "nb")
    delta = pair.groupBy("node").agg(F.avg(F.abs(F.col("s") - F.col("t"))).alias("delta"))
    d = s.join(delta, "node", "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
    d = cut(d)
    lam = d.agg(F.sum("delta").alias("total"), F.count("*").alias("n")).join(F.broadcast(h)).select(((F.col("h") + F.col("total")) / F.col("n")).alias("lam"))
    return d.join(F.broadcast(lam)).select("node", "s", "delta", (F.col("lam") - F.col("delta")).alias("lph_score"))


def boundary_flags(scores: DataFrame, percentile: float = 20.0, col: str = "lph_score") -> DataFrame:
    """Adds is_boundary: 1 where the score is at or below the percentile (linear interpolation)."""
    edge = scores.agg(F.percentile(col, F.lit(percentile / 100.0)).alias("__edge"))
    return scores.join(F.broadcast(edge)).withColumn("is_boundary", (F.col(col) <= F.col("__edge")).cast("int")).drop("__edge")


def boundary_intensity(frame: DataFrame) -> DataFrame:
    """(node, intensity) in 0..1 from lph_score, else is_boundary, else lph, else 0: the first that ``frame`` has.

    lph_score gives max(-score, 0) over its maximum; where that is 0, is_boundary if there is one.
    """
    cols = frame.columns
    clip = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    if "lph_score" in cols:
        raw = F.greatest(-F.col("lph_score"), F.lit(0.0))
        top = frame.agg(F.max(raw).alias("__top"))
        other: Column = F.col("is_boundary").cast("double") if "is_boundary" in cols else raw
        return frame.join(F.broadcast(top)).select("node", clip(F.when(F.col("__top") > 0, raw / F.col("__top")).otherwise(other)).alias("intensity"))
    if "is_boundary" in cols:
        return frame.select("node", clip(F.col("is_boundary").cast("double")).alias("intensity"))
    if "lph" in cols:
        ends = frame.agg(F.min("lph").alias("__lo"), F.max("lph").alias("__hi"))
        return frame.join(F.broadcast(ends)).select("node", clip(1.0 - (F.col("lph") - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-12)).alias("intensity"))
    return frame.select("node", F.lit(0.0).alias("intensity"))


def _network(pdf: pd.DataFrame) -> pd.DataFrame:
    """The scores of one network: rows of part 0 are nodes (a), of 1 edges (a, b), of 2 memberships (a in b)."""
    part = {k: g[["a", "b"]].to_numpy() for k, g in pdf.groupby("part")}
    node = np.unique(part[0][:, 0].astype(np.int64)).tolist() if 0 in part else []
    at = {n: k for k, n in enumerate(node)}
    has: list[set[int]] = [set() for _ in node]
    near: list[list[int]] = [[] for _ in node]
    for a, c in part.get(2, ()):
        if a in at:
            has[at[a]].add(c)
    ends = np.array([(at[a], at[b]) for a, b in part.get(1, ()) if a in at and b in at], np.int64).reshape(-1, 2)
    for a, b in ends:
        near[a].append(b)
        near[b].append(a)
    s = np.array([len(has[k] & set().union(*(has[x] for x in near[k]))) for k in range(len(node))], np.int64)
    mean = lambda x: sum(x) / len(x) if x else 0.0
    lph = [mean([len(has[k] & has[x]) / max(len(has[k] | has[x]), 1) for x in near[k]]) for k in range(len(node))]
    delta = np.array([mean([abs(int(s[k]) - int(s[x])) for x in near[k]]) for k in range(len(node))], float)
    u, v = s[ends[:, 0]], s[ends[:, 1]]
    mu = ((u + v) / 2.0).mean() if len(ends) else 0.0
    y = ((u - mu) ** 2).sum()
    h = ((u - mu) * (v - mu)).sum() / y if y else 0.0
    out = pd.DataFrame({"node": node, "s": s, "delta": delta, "lph_score": (h + delta.sum()) / max(len(node), 1) - delta, "lph": lph})
    out.insert(0, "net_idx", int(pdf["net_idx"].iloc[0]))
    out.insert(0, "model", pdf["model"].iloc[0])
    out["is_boundary"] = (out["lph_score"] <= out["lph_score"].quantile(0.2)).astype(int)
    return out


def network_scores(undirected: DataFrame, nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """(model, net_idx, node, s, delta, lph_score, lph, is_boundary): ``paper_scores``, ``jaccard_lph`` and ``boundary_flags`` of many networks, a task per network."""
    key = [F.col("model"), F.col("net_idx")]
    rows = nodes.select(*key, F.lit(0).alias("part"), F.col("node").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    rows = rows.unionByName(undirected.select(*key, F.lit(1).alias("part"), F.col("u").alias("a"), F.col("v").alias("b")))
    rows = rows.unionByName(membership.select(*key, F.lit(2).alias("part"), F.col("node").alias("a"), F.col("community").cast("long").alias("b")))
    return rows.groupBy("model", "net_idx").applyInPandas(_network, "model string, net_idx int, node long, s long, delta double, lph_score double, lph double, is_boundary int")


#: Weight of an edge by mode from the communities' Jaccard and the larger boundary intensity of its ends.
MODES = {
    "uniform": lambda j, b, beta, gamma: F.lit(1.0),
    "community_jaccard": lambda j, b, beta, gamma: j,
    "boundary_downweight": lambda j, b, beta, gamma: j * F.greatest(F.lit(0.0), 1.0 - beta * b),
    "bridge_preserve": lambda j, b, beta, gamma: sigmoid(gamma * j - beta * b),
}


def social_edges(edges: DataFrame, sets: DataFrame, intensity: DataFrame, mode: str = "uniform", beta: float = 0.5, gamma: float = 1.0, eligible: DataFrame | None = None) -> DataFrame:
    """(u, v, weight) with u < v: weights above 0, divided by their mean.  An unknown mode is a KeyError."""
    und = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    sets, intensity = cut(sets), cut(intensity)  # a row per node, each joined to both ends
    if eligible is not None:
        for end in ("u", "v"):
            und = und.join(eligible.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    for end, c, b in (("u", "cu", "bu"), ("v", "cv", "bv")):
        und = und.join(sets.select(F.col("node").alias(end), F.col("communities").alias(c)), end, "left")
        und = und.join(intensity.select(F.col("node").alias(end), F.col("intensity").alias(b)), end, "left")
    zero = F.lit(0.0)
    w = MODES[mode](jaccard("cu", "cv"), F.greatest(F.coalesce("bu", zero), F.coalesce("bv", zero)), beta, gamma)
    out = und.select("u", "v", w.alias("w")).where("w > 0 and not isnan(w)").persist()
    mean = out.agg(F.avg("w").alias("mean"))
    return out.join(F.broadcast(mean)).select("u", "v", (F.col("w") / F.col("mean")).alias("weight"))


def weight_summary(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("n_edges"), F.min("weight").alias("min_weight"), F.avg("weight").alias("mean_weight"), F.max("weight").alias("max_weight"))


def rank_by(df: DataFrame, by: list[str], order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(order)))
