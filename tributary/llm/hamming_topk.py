"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments of 16 bits, each with an index from its values to codes.  With radius r
in every one of m segments, all codes within m*(r+1)-1 bits have been met (pigeonhole); the radius
grows until each query's k-th verified distance lies within this bound.  Codes are dealt to shards
and the query set to blocks, both of bounded size; a task searches one block in one shard's index,
and the shards' best are merged.  The first shard is searched before the others, whose radii then
need not grow beyond its k-th distance.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Scratch

SEGMENT = 16
SHARD, BLOCK = 1 << 14, 1 << 12
#: Partitions of a search at most; a partition may hold several pairs of a shard and a block, one after the other.
_PARTS = 1 << 14


@cache
def _masks() -> list[np.ndarray]:
    """16-bit values by their number of ones."""
    ones = np.bitwise_count(np.arange(1 << SEGMENT, dtype=np.uint16))
    return [np.flatnonzero(ones == r) for r in range(SEGMENT + 1)]


class Index:
    """One shard's tables: for each segment the codes sorted by its value, and where each value starts."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes  # rows of segments
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, s], np.arange((1 << SEGMENT) + 1)) for s, o in enumerate(self.order)]

    def search(self, queries: np.ndarray, ids: list[np.ndarray], k: int, most: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query the k best (distance, id) of those at most ``most`` away."""
        m = self.codes.shape[1]
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        seen = [np.zeros(len(self.codes), bool) for _ in queries]
        active = list(range(len(queries)))
        for radius in range(SEGMENT + 1):
            for q in active:
                fresh = []
                for s in range(m):
                    values = _masks()[radius] ^ int(queries[q, s])
                    lo, hi = self.starts[s][values], self.starts[s][values + 1]
                    full = hi > lo
                    if full.any():
                        lo, n = lo[full], hi[full] - lo[full]
                        ends = np.cumsum(n)
                        fresh.append(self.order[s][np.arange(ends[-1]) + np.repeat(lo - (ends - n), n)])
                if not fresh:
                    continue
                met = np.unique(np.concatenate(fresh))
                met = met[~seen[q][met]]
                seen[q][met] = True
                far = np.bitwise_count(self.codes[met] ^ queries[q]).sum(1)
                if len(met) > k:  # ids of codes beyond the k-th code can't be among the k best
                    edge = np.partition(far, k - 1)[k - 1]
                    met, far = met[far <= edge], far[far <= edge]
                found = [(int(d), int(i)) for c, d in zip(met.tolist(), far.tolist(), strict=True) for i in ids[c]]
                best[q] = sorted(best[q] + found)[:k]
            covered = m * (radius + 1) - 1
            active = [q for q in active if covered < most[q] and (len(best[q]) < k or best[q][-1][0] > covered)]
            if not active:
                break
        return [[x for x in found if x[0] <= most[q]] for q, found in enumerate(best)]


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", dims: int | None = None) -> DataFrame:
    """(id, code): a bit per dimension (1: not negative), in array<int> segments; null vectors are left out.

    Missing or null components count as negative.  Codes are as long as the longest vector, or ``dims``: then
    components from there on are left out.
    """
    if dims is None:
        longest = vectors.where(F.col(id_col).isNotNull()).agg(F.max(F.size(col))).first()[0]
        dims = max(longest or 0, 1)
    bit = lambda s, b: F.when(F.get(F.col(col), s * SEGMENT + b) >= 0, F.lit(1)).otherwise(F.lit(0))
    seg = lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(SEGMENT - 1)), F.lit(0), lambda acc, b: acc * 2 + bit(s, b))
    code = F.transform(F.sequence(F.lit(0), F.lit(-(-dims // SEGMENT) - 1)), seg)
    return vectors.where(F.col(col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), code.alias("code"))


def _search(codes: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    unpack = lambda t: np.array(t.column("code").to_pylist(), np.uint16)
    rows: list[tuple[list[int], int, int]] = []
    if len(codes) and len(queries):
        asked = unpack(queries)
        found = Index(unpack(codes)).search(asked, [np.array(x) for x in codes.column("ids").to_pylist()], k, queries.column("most").to_numpy())
        rows = [(q, i, d) for q, best in zip(asked.tolist(), found, strict=True) for d, i in best]
    return pa.table({"query": pa.array([r[0] for r in rows], pa.list_(pa.int32())), "id": pa.array([r[1] for r in rows], pa.int64()), "distance": pa.array([r[2] for r in rows], pa.int32())})


def topk(codes: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank from 1, id, distance): for each row of ``queries(id, code)`` the k nearest of ``codes(id, code)``.

    Order: distance, then id; a query finds itself if it is among the codes.  Fewer than k codes: all
    of them.  Equal codes are one entry that keeps its k smallest ids, so a hot code costs k rows.
    Repeated rows of one id count once.  All codes have the same number of segments; null codes are
    left out; empty inputs give no row.
    """
    scratch = Scratch(codes.sparkSession)
    codes, queries = codes.where("code is not null and id is not null"), queries.where("code is not null and id is not null")
    few = W.partitionBy("code").orderBy("id")
    # ranks are limited before they shuffle, so a code that a third of all rows share sends k rows per task
    kept = codes.distinct().withColumn("r", F.row_number().over(few)).where(F.col("r") <= k).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    kept = scratch.write(kept, "codes")
    asked = scratch.write(queries.select("code").distinct(), "asked")
    shards, blocks = max(1, -(-kept.count() // shard)), max(1, -(-asked.count() // block))
    kept = kept.select("code", "ids", F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int").alias("shard"))
    asked = asked.select("code", F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("block"))
    parts = min(shards * blocks, _PARTS)

    def among(low: int, high: int, asked: DataFrame) -> DataFrame:
        """What shards low to high (exclusive) have for ``asked(code, block, most)``."""
        left = kept.where(F.col("shard").between(low, high - 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(parts, "shard", "block")
        right = asked.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high - 1)))).repartition(parts, "shard", "block")
        return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(lambda a, b: _search(a, b, k), "query array<int>, id long, distance int")

    far = F.lit(1 << 30)
    found = scratch.write(among(0, 1, asked.withColumn("most", far)), "first")
    if shards > 1:
        edge = found.groupBy(F.col("query").alias("code")).agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(far).alias("edge"))
        bounded = asked.join(edge, "code", "left").select("code", "block", F.coalesce("edge", far).alias("most"))
        found = found.unionByName(among(1, shards, bounded))
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct().join(found, "query").select("query_id", "rank", "id", "distance")
