"""Graph relations: ids, symmetrising, degrees, triangles, overlap of two graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dense_ids(ids: DataFrame, col: str = "id") -> DataFrame:
    """(id, code): the 0-based rank among the sorted distinct ids.

    Values fall into about 64 ranges by approximate quantiles (fixed numbers, so a task run again deals
    alike); a rank is the count of the ranges before plus the rank in the own range.
    """
    distinct = ids.select(col).where(F.col(col).isNotNull()).distinct()
    bounds = sorted(set(distinct.select(F.col(col).cast("double").alias(col)).approxQuantile(col, [i / 64 for i in range(1, 64)], 0.005)))
    bucket = F.size(F.filter(F.lit(bounds), lambda b: b < F.col(col))) if bounds else F.lit(0)
    dealt = distinct.withColumn("__b", bucket)
    counts = {r["__b"]: r["count"] for r in dealt.groupBy("__b").count().collect()}
    starts = [sum(n for k, n in counts.items() if k < i) for i in range(len(bounds) + 1)]
    rank = F.row_number().over(W.partitionBy("__b").orderBy(col)) - 1
    return dealt.select(col, (F.lit(starts)[F.col("__b")] + rank).cast("long").alias("code"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges between declared nodes, without self loops."""
    keep = edges.where("src <> dst").select("src", "dst").distinct()
    for end in ("src", "dst"):
        keep = keep.join(nodes.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return keep.select("src", "dst")


def union_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges (u < v) present in either direction."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def mutual_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges (u < v) present in both directions."""
    both = edges.where("src <> dst").select("src", "dst").distinct()
    oriented = both.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    return oriented.groupBy("u", "v").count().where("count = 2").select("u", "v")


SYMMETRISE = {"union": union_edges, "intersection": mutual_edges}


def neighbours(undirected: DataFrame) -> DataFrame:
    """(node, nb): both orientations of undirected edges (u, v)."""
    return undirected.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("nb")), F.struct(F.col("v").alias("node"), F.col("u").alias("nb")))).alias("e")).select("e.*")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, degree), each over max(N-1, 1)."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    n = nodes.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("n"))
    d = nodes.select("node").join(into, "node", "left").join(out, "node", "left").join(F.broadcast(n))
    i, o = F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0))
    return d.select("node", (i / F.col("n")).alias("in_degree"), (o / F.col("n")).alias("out_degree"), ((i + o) / F.col("n")).alias("degree"))


def raw_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, in_count, out_count)."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    return nodes.select("node").join(into, "node", "left").join(out, "node", "left").select("node", F.coalesce("i", F.lit(0)).alias("in_count"), F.coalesce("o", F.lit(0)).alias("out_count"))


def triangles(undirected: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c: edges are directed from the end of smaller degree, so hubs make few wedges."""
    deg = neighbours(undirected).groupBy("node").agg(F.count("*").alias("d"))
    e = undirected.join(deg.select(F.col("node").alias("u"), F.col("d").alias("du")), "u").join(deg.select(F.col("node").alias("v"), F.col("d").alias("dv")), "v")
    first = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    out = e.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("y"))
    wedge = out.alias("p").join(out.alias("q"), (F.col("p.x") == F.col("q.x")) & (F.col("p.y") < F.col("q.y"))).select(F.col("p.x").alias("x"), F.col("p.y").alias("u"), F.col("q.y").alias("v"))
    return wedge.join(undirected, ["u", "v"]).select(F.array_sort(F.array("x", "u", "v")).alias("t")).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def clustering(undirected: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, clustering): triangles over pairs of neighbours, 0 below two neighbours."""
    deg = neighbours(undirected).groupBy("node").agg(F.count("*").alias("d"))
    tri = triangles(undirected).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    d, t = F.coalesce("d", F.lit(0)), F.coalesce("t", F.lit(0))
    return nodes.select("node").join(deg, "node", "left").join(tri, "node", "left").select("node", F.when(d < 2, 0.0).otherwise(2.0 * t / (d * (d - 1))).alias("clustering"))


def overlap(trust: DataFrame, inferred: DataFrame) -> DataFrame:
    """(node, jaccard) of out-neighbour sets, for nodes of both graphs; null if both sets are empty."""
    ends = lambda e: e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    common = ends(trust).intersect(ends(inferred))
    t, i = trust.select("src", "dst").distinct(), inferred.select("src", "dst").distinct()
    count = lambda e, n: e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias(n))
    j = common.join(count(t, "nt"), "node", "left").join(count(i, "ni"), "node", "left").join(count(t.intersect(i), "nb"), "node", "left").na.fill(0)
    union = F.col("nt") + F.col("ni") - F.col("nb")
    return j.select("node", F.when(union > 0, F.col("nb") / union).alias("jaccard"))


def alignment_ratio(trust: DataFrame, inferred: DataFrame) -> DataFrame:
    """One row: inferred edges, those also in trust, and their ratio (null without inferred edges)."""
    i = inferred.select("src", "dst").distinct()
    flagged = i.join(trust.select("src", "dst").distinct().withColumn("hit", F.lit(1)), ["src", "dst"], "left")
    n, hit = F.count("*"), F.count("hit")
    return flagged.agg(n.alias("n_inferred"), hit.alias("n_shared"), F.when(n > 0, hit / n).alias("alignment_ratio"))


def trust_features(trust: DataFrame, jaccard: DataFrame) -> DataFrame:
    """Full outer join of trust degrees and overlap, missing values 0."""
    nodes = trust.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return raw_degrees(trust, nodes).join(jaccard, "node", "full").select("node", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_count", "out_count")], F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"))
