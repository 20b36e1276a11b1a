"""Ratings dealt once to blocks of entities, and half-steps of alternating least squares over them.

Ratings are written once for each side, bucketed by (block, salt) of their entity, and never shuffled
again.  Blocks are ranges of ids with about as many ratings each: entities that came up together often
have ids that lie together and partners in common.  A route table names the blocks in which an entity
of the other side occurs; in a half-step a factor is sent once to each of these, not once a rating.  An entity with more ratings than a block
should hold is dealt over salts by its partner; its partial normal equations are summed over the salts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, dropped, shared_folder

#: Ratings that a block holds, and the most entities that are dealt over salts.
BLOCK_ROWS, MOST_HOT = 250_000, 10_000
#: Values of rows' outer products that a task holds at once, and the size from which a product for each entity is cheaper.
_PRODUCTS, _WIDE = 4_000_000, 16


@dataclass
class Dealt:
    """ratings(block, salt, id, other, x, w) and routes(block, salt, other); ``hot(id, salts)`` if there are any."""

    spark: SparkSession
    ratings: DataFrame
    routes: DataFrame
    edges: list[float]
    hot: DataFrame | None
    tables: list[str]

    def drop(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            dropped(self.spark, f"{shared_folder(self.spark)}/{name}")

    def block_of(self, ids: DataFrame) -> DataFrame:
        """``ids`` with the block of their entity and salt 0; those dealt over salts are left out."""
        rest = ids if self.hot is None else ids.join(F.broadcast(self.hot.select("id")), "id", "left_anti")
        return placed(rest, self.edges).select("block", F.lit(0).cast("long").alias("salt"), *ids.columns)


def placed(df: DataFrame, edges: list[float]) -> DataFrame:
    """Adds block: the range between ``edges`` in which id lies."""
    if not edges:
        return df.withColumn("block", F.lit(0).cast("long"))
    ranges = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="__id", outputCol="__block", handleInvalid="keep")
    return ranges.transform(df.withColumn("__id", F.col("id").cast("double"))).withColumn("block", F.col("__block").cast("long")).drop("__id", "__block")


def _bucketed(df: DataFrame, n: int, *keys: str) -> tuple[DataFrame, str]:
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return spark.table(name), name


def deal(ratings: DataFrame, key: str, other: str, weight_col: str | None = None, rows: int | None = None) -> Dealt:
    """Deals the ratings that are not null by ``key``; entities with more than ``rows`` of them over salts.

    So many at least that no more than ``MOST_HOT`` entities can have them: their list is broadcast.
    """
    rows = rows or BLOCK_ROWS
    w = F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)) if weight_col else F.lit(1.0)
    r = ratings.where("rating is not null").select(F.col(key).cast("long").alias("id"), F.col(other).cast("long").alias("other"), F.col("rating").cast("double").alias("x"), w.alias("w")).where("id is not null and other is not null")
    total = r.count()
    limit = max(rows, total // MOST_HOT + 1)
    spark = ratings.sparkSession
    blocks = max(spark.sparkContext.defaultParallelism, -(-total // rows))
    # quantiles so close that an entity with more ratings than the limit, a block's at least, is one of them
    steps = r.agg(F.percentile_approx("id", [k / (4 * blocks) for k in range(1, 4 * blocks)], max(10_000, 40 * blocks))).first()[0] or []
    often = spark.createDataFrame([(k,) for k in sorted(set(steps))], "id long")
    hot = cut(r.join(F.broadcast(often), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("id", F.ceil(F.col("n") / limit).alias("salts")))
    hot = None if hot.isEmpty() else hot
    edges = sorted(set(map(float, steps[3::4])))
    if hot is None:
        dealt = placed(r.withColumn("salt", F.lit(0).cast("long")), edges).select("block", "salt", "id", "other", "x", "w")
    else:
        salt = F.when(F.col("salts").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("other", F.lit(1)), F.col("salts"))).cast("long")
        dealt = placed(r.join(F.broadcast(hot), "id", "left").withColumn("salt", salt), edges).select("block", "salt", "id", "other", "x", "w")
    ratings_table, first = _bucketed(dealt, blocks, "block", "salt")
    routes, second = _bucketed(ratings_table.select("block", "salt", "other").distinct(), blocks, "other")
    return Dealt(spark, ratings_table, routes, edges, hot, [first, second])


@dataclass(frozen=True)
class Side:
    """How a rating adds to its entity's system.

    The other side's factor gives ``width`` shared values from place ``skip`` on; the system has
    ``pad`` unknowns before them and, with ``own_bias``, one after.  The other side's bias is its last
    value.  ``kind``: 'rating', 'implicit' (confidence 1 + alpha x), 'zero' (cells without a rating
    are zeros of weight 1, of which ``base`` has all and the rows correct those that have one), or
    'seen' (only that there is a rating counts: ``base`` has all cells).  With ``seen_weight``, the
    other side's factor starts with ``width`` more values, by which a row that is there adds.
    """

    width: int
    skip: int = 0
    pad: int = 0
    own_bias: bool = False
    other_bias: bool = False
    kind: str = "rating"
    mean: float = 0.0
    weight: float = 1.0
    alpha: float = 1.0
    log_transform: bool = False
    seen_weight: float = 0.0

    @property
    def size(self) -> int:
        return self.pad + self.width + self.own_bias

    def design(self, g: np.ndarray) -> np.ndarray:
        """Rows of the system's matrix from factors of the other side."""
        out = np.zeros((len(g), self.size))
        out[:, self.pad : self.pad + self.width] = g[:, self.skip : self.skip + self.width]
        if self.own_bias:
            out[:, -1] = 1.0
        return out

    def terms(self, x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of f f' in the gram and of f in the right side; ``b`` is the other side's bias."""
        w = w * self.weight
        if self.kind == "seen":
            return np.zeros(len(x)), np.full(len(x), self.weight)
        if self.kind == "implicit":
            c = np.log1p(x * self.alpha) if self.log_transform else x * self.alpha
            return c * w, (1.0 + c) * w
        if self.kind == "zero":
            return w - self.weight, w * (x - b) + self.weight * b
        return w, w * (x - self.mean - b)


def _sums(f: np.ndarray, place: np.ndarray, wg: np.ndarray, wr: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each entity's weighted gram and right side; its rows start at ``starts`` and have the factors ``f[place]``."""
    size, m, stops = f.shape[1], len(starts), np.r_[starts[1:], len(place)]
    gram, rhs = np.empty((m, size, size)), np.empty((m, size))
    if size > _WIDE:
        for k, (lo, hi) in enumerate(zip(starts, stops, strict=True)):
            part = f[place[lo:hi]]
            gram[k], rhs[k] = (part * wg[lo:hi, None]).T @ part, wr[lo:hi] @ part
        return gram, rhs
    most, k = max(1, _PRODUCTS // (size * size)), 0
    while k < m:
        end = max(k + 1, int(np.searchsorted(stops, starts[k] + most, "right")))
        lo, hi = starts[k], stops[end - 1]
        part, at = f[place[lo:hi]], starts[k:end] - lo
        if end == k + 1:
            gram[k], rhs[k] = (part * wg[lo:hi, None]).T @ part, wr[lo:hi] @ part
        else:
            gram[k:end] = np.add.reduceat((part * wg[lo:hi, None])[:, :, None] * part[:, None, :], at)
            rhs[k:end] = np.add.reduceat(part * wr[lo:hi, None], at)
        k = end
    return gram, rhs


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), pa.float64()))


def _solved(side: Side, finish):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        def given(kind: int) -> tuple[np.ndarray, np.ndarray]:
            """The ids sent, sorted, and their values, a row each."""
            rows = right.filter(pc.equal(right.column("kind"), kind)) if len(right) else right
            if not len(rows):
                return np.zeros(0, np.int64), np.zeros((0, 0))
            ids, values = rows.column("id").to_numpy(), rows.column("f").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
            order = np.argsort(ids, kind="stable")
            return ids[order], values[order]

        ids, g = given(0)
        extra_ids, extra = given(1)
        order = np.argsort(left.column("id").to_numpy(), kind="stable") if len(left) else np.zeros(0, int)
        own, other, x, w = (left.column(c).to_numpy()[order] if len(left) else np.zeros(0) for c in ("id", "other", "x", "w"))
        place = np.searchsorted(ids, other) if len(ids) else np.zeros(0, int)
        known = ids[np.minimum(place, len(ids) - 1)] == other if len(ids) else np.zeros(len(own), bool)
        own, x, w, place = own[known], x[known], w[known], place[known]
        f = side.design(g) if len(ids) else np.zeros((0, side.size))
        b = g[:, -1][place] if side.other_bias and len(ids) else np.zeros(len(own))
        wg, wr = side.terms(x, w, b)
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
        n = np.diff(np.r_[starts, len(own)])
        gram, rhs = _sums(f, place, wg, wr, starts)
        if side.seen_weight and len(starts):
            rhs[:, side.pad : side.pad + side.width] += side.seen_weight * np.add.reduceat(g[place, : side.width], starts)
        found = own[starts].astype(np.int64)
        double = pa.list_(pa.float64())
        if key[1].as_py() != 0:
            return pa.Table.from_arrays([pa.array(found, pa.int64()), pa.nulls(len(found), double), _lists(np.c_[gram.reshape(len(n), -1), rhs, n])], ["id", "f", "eq"])
        rest = np.setdiff1d(extra_ids, found)  # no rating, but other terms
        every = np.r_[found, rest]
        more = np.zeros((len(every), side.size + 1))
        if len(extra_ids):
            at = np.minimum(np.searchsorted(extra_ids, every), len(extra_ids) - 1)
            more = np.where((extra_ids[at] == every)[:, None], extra[at], 0.0)
        none = len(rest)
        gram, rhs, n = np.r_[gram, np.zeros((none, side.size, side.size))], np.r_[rhs, np.zeros((none, side.size))], np.r_[n, np.zeros(none, int)]
        return pa.Table.from_arrays([pa.array(every, pa.int64()), _lists(finish(gram, rhs, n, more)), pa.nulls(len(every), double)], ["id", "f", "eq"])

    return run


def half_step(dealt: Dealt, other: DataFrame, side: Side, lam: np.ndarray, base: np.ndarray, base_rhs: np.ndarray | None = None, extras: DataFrame | None = None, scale_lam: bool = False, everyone: int | None = None, solve=None) -> DataFrame:
    """(id, f): each entity's minimiser, given the factors ``other(id, f)``.

    The system is ``base`` plus the entity's ratings plus diag(``lam``), times the number of its
    ratings with ``scale_lam`` (of ``everyone`` on the other side, if given).  ``extras(id, f)`` adds,
    for an entity, a right side and (last value) a weight on the diagonal; entities that have only
    these are solved too.  ``solve(gram, right side)`` takes the place of the plain solve, one entity at a time.
    """
    base_rhs = np.zeros(side.size) if base_rhs is None else base_rhs

    def finish(gram: np.ndarray, rhs: np.ndarray, n: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """The entities' minimisers, a row each; ``extra`` as in ``extras``."""
        times = (np.maximum(n if everyone is None else np.full(len(n), everyone), 1) if scale_lam else np.ones(len(n)))[:, None]
        gram, rhs = base + gram, base_rhs + rhs + extra[:, :-1]
        at = np.arange(side.size)
        gram[:, at, at] += lam * times + extra[:, -1:]
        if solve is None:
            return np.linalg.solve(gram, rhs[..., None])[..., 0]
        return np.array([solve(g, r) for g, r in zip(gram, rhs, strict=True)]).reshape(len(n), side.size)

    sent = dealt.routes.join(other.select(F.col("id").alias("other"), "f"), "other").select("block", "salt", F.lit(0).alias("kind"), F.col("other").alias("id"), "f")
    if extras is not None:
        sent = sent.unionByName(dealt.block_of(extras.select("id", "f")).select("block", "salt", F.lit(1).alias("kind"), "id", "f"))
    keys = ["block", "salt"]
    out = dealt.ratings.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_solved(side, finish), "id long, f array<double>, eq array<double>")
    if dealt.hot is None:
        return out.select("id", "f")
    out = cut(out)
    sums = out.where("eq is not null").select("id", F.posexplode("eq")).groupBy("id", "pos").agg(F.sum("col").alias("v")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("e")).select("id", F.transform("e", lambda x: x["v"]).alias("eq"))
    sums = sums.join(extras.select("id", F.col("f").alias("more")), "id", "left") if extras is not None else sums.withColumn("more", F.lit(None).cast("array<double>"))

    def last(batches):
        k = side.size
        for batch in batches:
            if not len(batch):
                continue
            eq = np.array(batch.column("eq").to_pylist())
            more = np.array([np.zeros(k + 1) if e is None else e for e in batch.column("more").to_pylist()])
            found = finish(eq[:, : k * k].reshape(-1, k, k), eq[:, k * k : -1], eq[:, -1], more)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(found)], ["id", "f"])

    return out.where("f is not null").select("id", "f").unionByName(sums.mapInArrow(last, "id long, f array<double>"))
