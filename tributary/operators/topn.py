"""Exact best items of every user, without pairing all users with all items.

Items lie in blocks by the length of their vector, longest first.  By Cauchy-Schwarz no item of a
block scores above the user's length times the block's longest, so a user is sent only to blocks
that can still hold one of the best; the first blocks, taken in doubling rounds, set the bar.
Block and users meet in cells of bounded size as one matrix product.

Where items have one order for all users, their places in it are found by one sort, and a user's
ranks are these places less the items the user has before them (``top_n_by_order``, ``ranking_by_order``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import Tables, cut

#: Items in a block, and users in a cell.
BLOCK_ITEMS, CELL_USERS = 4096, 4096
#: Places of the common order up to which items are broadcast to users.
FIRST_PLACES = 100_000
_STATE = "user_id long, f array<double>, skip array<long>, score double, item long, length double, top array<struct<score:double,item_id:long>>, above long"
_FOUND = "user_id long, top array<struct<score:double,item_id:long>>, above long"


def _blocks(items: DataFrame, tables: Tables, size: int) -> tuple[DataFrame, list[float]]:
    """(block, ids, f) packed, and each block's longest vector (below zero: its items have no score), longest first."""
    length = F.when(F.col("f").isNull(), F.lit(-1.0)).otherwise(F.sqrt(F.aggregate("f", F.lit(0.0), lambda s, x: s + x * x)))
    rows = tables.write(items.select(F.col("id").cast("long").alias("id"), "f", length.alias("length")).where("id is not null").dropDuplicates(["id"]))
    n = rows.count()
    bins = -(-n // size)
    edges = rows.agg(F.percentile_approx("length", [k / bins for k in range(1, bins)] or [0.5], 10_000)).first()[0] or []
    edges = sorted(set(edges)) if bins > 1 else []
    place = F.when(F.col("length") < 0, F.lit(-1)).otherwise(F.size(F.filter(F.array(*[F.lit(float(x)) for x in edges]).cast("array<double>"), lambda x: x <= F.col("length"))))
    rows = rows.withColumn("bin", place)
    # a bin that many equal lengths fill is cut again by a hash
    parts = rows.groupBy("bin").agg(F.ceil(F.count("*") / size).alias("parts"))
    packed = rows.join(F.broadcast(parts), "bin").groupBy("bin", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).agg(F.sort_array(F.collect_list(F.struct("id", "f"))).alias("x"), F.max("length").alias("longest"))
    packed = tables.write(packed.select("bin", "part", "longest", F.transform("x", lambda v: v["id"]).alias("ids"), F.transform("x", lambda v: v["f"]).alias("f")))
    known = sorted(((r["longest"], r["bin"], r["part"]) for r in packed.select("bin", "part", "longest").collect()), reverse=True)  # a row for every few thousand items
    names = items.sparkSession.createDataFrame([(b, p, k) for k, (_, b, p) in enumerate(known)], "bin int, part long, block int")
    return packed.join(F.broadcast(names), ["bin", "part"]).select("block", "ids", "f"), [x for x, _, _ in known]


def _cell(n: int):
    def run(users: pa.Table, packed: pa.Table) -> pa.Table:
        if not len(users) or not len(packed):
            return _none()
        ids = packed.column("ids").combine_chunks().flatten().to_numpy()
        vectors = packed.column("f").to_pylist()[0]
        scored = np.array([v is not None for v in vectors])
        width = next((len(v) for v in vectors if v is not None), 0)
        v = np.array([x if x is not None else [0.0] * width for x in vectors]).reshape(len(ids), width)
        own = users.column("f").to_pylist()
        u = np.array([x if x is not None else [0.0] * width for x in own]).reshape(len(own), width)
        table = u @ v.T
        table[:, ~scored] = -np.inf
        table[[x is None for x in own]] = -np.inf
        tops, above = [], []
        for row, skip, score, item in zip(table, *(users.column(c).to_pylist() for c in ("skip", "score", "item")), strict=True):
            free = ~np.isin(ids, skip) if skip else np.ones(len(ids), bool)
            at = np.flatnonzero(free)
            if item is None:
                above.append(0)
            else:
                bar = -np.inf if score is None else score
                above.append(int(np.sum(free & (ids != item) & ((row > bar) | (row == bar) & (ids < item)))))
            if len(at) > n:
                bar = np.partition(row[at], len(at) - n)[len(at) - n]
                at = at[row[at] >= bar]  # with all ties of the last
            at = at[np.lexsort((ids[at], -row[at]))][:n]
            tops.append([{"score": float(row[k]), "item_id": int(ids[k])} for k in at])
        kind = pa.list_(pa.struct([("score", pa.float64()), ("item_id", pa.int64())]))
        return pa.Table.from_arrays([users.column("user_id").combine_chunks(), pa.array(tops, kind), pa.array(above, pa.int64())], ["user_id", "top", "above"])

    return run


def best(users: DataFrame, items: DataFrame, n: int, block_items: int | None = None, stats: dict | None = None) -> DataFrame:
    """(user_id, top, above): each user's ``n`` best items, and how many items beat a given one.

    ``users(user_id, f, skip, score, item)``, each once: vector, items left out, and a target (or null)
    with its score.  ``items(id, f)``.  A score is the vectors' product; items or users without a vector
    have none (minus infinity), which comes last.  Order: score descending, then item.  ``stats`` gets
    the number of (user, block) meetings under 'meetings'.
    """
    spark, tables = users.sparkSession, Tables(users.sparkSession)
    packed, longest = _blocks(items, tables, block_items or BLOCK_ITEMS)
    length = F.sqrt(F.aggregate("f", F.lit(0.0), lambda s, x: s + x * x))
    empty = F.array().cast("array<struct<score:double,item_id:long>>")
    state = users.select(F.col("user_id").cast("long").alias("user_id"), "f", "skip", "score", "item", length.alias("length"), empty.alias("top"), F.lit(0).cast("long").alias("above"))
    state = tables.write(spark.createDataFrame([], _STATE).unionByName(state))
    bar = F.when(F.size("top") < n, F.lit(float("-inf"))).otherwise(F.element_at("top", -1)["score"])
    bar = F.when(F.col("item").isNotNull(), F.least(bar, F.coalesce("score", F.lit(float("-inf"))))).otherwise(bar)
    start, meetings = 0, 0
    while start < len(longest):
        stop = min(len(longest), max(1, 2 * start))
        reach = F.array(*[F.lit(float(x)) for x in longest[start:stop]])
        there = F.element_at(reach, F.col("k") + 1)
        most = F.when(there < 0, F.lit(float("-inf"))).otherwise(F.coalesce("length", F.lit(0.0)) * there * (1 + 1e-9) + 1e-12)
        met = tables.write(state.select("*", bar.alias("bar"), F.explode(F.sequence(F.lit(0), F.lit(stop - start - 1))).alias("k")).where((most >= F.col("bar")) | F.col("f").isNull()).select("user_id", "f", "skip", "score", "item", (F.col("k") + start).cast("int").alias("block")))
        count = met.count()
        meetings += count
        if count:
            salts = -(-state.count() // CELL_USERS)
            left = met.withColumn("salt", F.pmod(F.xxhash64("user_id"), F.lit(salts)))
            right = packed.where(F.col("block").between(start, stop - 1)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
            found = left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(_cell(n), _FOUND)
            by_score = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["item_id"] < b["item_id"], -1).otherwise(1)
            merged = found.groupBy("user_id").agg(F.flatten(F.collect_list("top")).alias("new"), F.sum("above").alias("more"))
            top = F.slice(F.array_sort(F.concat("top", F.coalesce("new", empty)), by_score), 1, n)
            state = tables.write(state.join(merged, "user_id", "left").select(*[c for c in state.columns if c not in ("top", "above")], top.alias("top"), (F.col("above") + F.coalesce("more", F.lit(0))).alias("above")))
        start = stop
    if stats is not None:
        stats["meetings"] = meetings
    out = cut(state.select("user_id", "top", "above"))
    tables.drop()
    return out


def _none() -> pa.Table:
    kind = pa.list_(pa.struct([("score", pa.float64()), ("item_id", pa.int64())]))
    return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], kind), pa.array([], pa.int64())], ["user_id", "top", "above"])


def _asked(users: DataFrame, known: DataFrame | None, targets: DataFrame | None = None) -> DataFrame:
    """``users(user_id, f)`` with the items each has already, and its target."""
    out = users.select("user_id", "f")
    if known is None:
        out = out.withColumn("skip", F.lit(None).cast("array<long>"))
    else:
        out = out.join(known.groupBy("user_id").agg(F.collect_set(F.col("item_id").cast("long")).alias("skip")), "user_id", "left")
    if targets is None:
        return out.select("*", F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("item"))
    return out.join(targets, "user_id", "left")


def top_n(users: DataFrame, items: DataFrame, n: int = 10, known: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, score, rank): the ``n`` best items of ``users(user_id, f)``, without those in ``known(user_id, item_id)``."""
    rows = best(_asked(users, known), items, n).select("user_id", F.posexplode("top").alias("rank", "x"))
    score = F.when(F.col("x.score") > float("-inf"), F.col("x.score"))
    return rows.select("user_id", F.col("x.item_id").alias("item_id"), score.alias("score"), (F.col("rank") + 1).alias("rank"))


def ranking_by_user(users: DataFrame, items: DataFrame, test: DataFrame, known: DataFrame, k: int = 10, threshold: float | None = None) -> DataFrame:
    """(user_id, precision_at_k, recall_at_k, ndcg_at_k, rr) as ``evaluation.ranking_by_user`` has them, from vectors.

    The first relevant item's rank over the whole catalogue is one more than the items that beat it.
    """
    relevant = (test if threshold is None else test.where(F.col("rating") >= threshold)).select("user_id", "item_id").distinct()
    mine = relevant.join(known.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    scored = mine.join(users.select("user_id", F.col("f").alias("u")), "user_id").join(items.select(F.col("id").alias("item_id"), F.col("f").alias("v")), "item_id")
    score = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    first = F.max(F.struct(F.coalesce(score, F.lit(float("-inf"))).alias("score"), (-F.col("item_id")).alias("item")))
    targets = scored.groupBy("user_id").agg(first.alias("t")).select("user_id", F.col("t.score").alias("score"), (-F.col("t.item")).alias("item"))
    found = best(_asked(users, known, targets), items, k)
    hits = found.select("user_id", F.posexplode("top").alias("rank", "x")).select("user_id", F.col("x.item_id").alias("item_id"), "rank").join(relevant, ["user_id", "item_id"]).groupBy("user_id").agg(F.count("*").alias("hits"), F.sum(1.0 / F.log2(F.col("rank") + 2.0)).alias("dcg"))
    n = relevant.groupBy("user_id").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    j = n.join(found.where(F.size("top") > 0).select("user_id", "above"), "user_id").join(hits, "user_id", "left").join(targets.select("user_id", F.lit(1).alias("ranked")), "user_id", "left")
    hit = F.coalesce("hits", F.lit(0))
    return j.select("user_id", (hit / k).alias("precision_at_k"), (hit / F.col("n")).alias("recall_at_k"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_at_k"), F.when(F.col("ranked") == 1, 1.0 / (F.col("above") + 1)).otherwise(0.0).alias("rr"))


def _places(scores: DataFrame, tables: Tables) -> DataFrame:
    """(item_id, score, place) of ``scores(item_id, score)``: places from 1 by (score descending, nulls last, item), from one range sort."""
    rows = tables.write(scores.dropDuplicates(["item_id"]).orderBy(F.desc_nulls_last("score"), "item_id").withColumn("at", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for every sorted partition
    starts = np.cumsum([0, *[r["n"] for r in sizes]]).tolist()
    before = scores.sparkSession.createDataFrame([(r["part"], k) for r, k in zip(sizes, starts, strict=False)], "part long, before long")
    place = F.col("at").bitwiseAND((1 << 33) - 1) + F.col("before") + 1
    return tables.write(rows.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(before), "part").select("item_id", "score", place.alias("place")))


def top_n_by_order(users: DataFrame, scores: DataFrame, n: int = 10, known: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, score, rank): as ``top_n``, where ``scores(item_id, score)`` holds for all users.

    A user's j-th item has place j plus the items the user has of which fewer than j others stand before.
    """
    tables = Tables(users.sparkSession)
    places = _places(scores, tables)
    asked = users.select("user_id").distinct()
    if known is None:
        wanted = asked.withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("rank", F.col("place"))
    else:
        have = known.select("user_id", "item_id").join(asked, "user_id", "left_semi").join(places.select("item_id", "place"), "item_id")
        own = W.partitionBy("user_id").orderBy("place")
        # dense_rank, so that an item known twice counts once
        have = have.select("user_id", "place", F.dense_rank().over(own).alias("k")).where(F.col("place") - F.col("k") < n).distinct()
        jumps = have.groupBy("user_id").agg(F.array(*[F.count(F.when(F.col("place") - F.col("k") < j, 1)) for j in range(1, n + 1)]).alias("jumps"))
        jumps = asked.join(jumps, "user_id", "left").select("user_id", F.coalesce("jumps", F.array_repeat(F.lit(0).cast("long"), n)).alias("jumps"))
        wanted = jumps.select("user_id", F.posexplode("jumps").alias("at", "jump")).select("user_id", (F.col("at") + 1 + F.col("jump")).alias("place"), (F.col("at") + 1).alias("rank"))
    wanted = tables.write(wanted)
    last = wanted.agg(F.max("place")).first()[0] or 0
    first = places.where(F.col("place") <= last)
    out = cut(wanted.join(F.broadcast(first) if last <= FIRST_PLACES else first, "place").select("user_id", "item_id", "score", "rank"))
    tables.drop()
    return out


def ranking_by_order(scores: DataFrame, test: DataFrame, known: DataFrame, k: int = 10, threshold: float | None = None) -> DataFrame:
    """As ``ranking_by_user``, of all users with relevant items, where ``scores(item_id, score)`` holds for all of them.

    A relevant item's rank is its place in the order less the items the user has before it.
    """
    tables = Tables(scores.sparkSession)
    places = _places(scores, tables)
    size = places.count()
    relevant = (test if threshold is None else test.where(F.col("rating") >= threshold)).select("user_id", "item_id")
    n = relevant.distinct().groupBy("user_id").agg(F.count("*").alias("n"))
    have = known.select("user_id", "item_id").join(relevant.select("user_id").distinct(), "user_id", "left_semi")
    rows = have.withColumn("asked", F.lit(0)).unionByName(relevant.withColumn("asked", F.lit(1))).join(places.select("item_id", "place"), "item_id")
    own = W.partitionBy("user_id").orderBy("place", "asked")
    # what stands twice counts once, and not as relevant where the user has it
    rows = rows.select("user_id", "place", "asked", F.coalesce(F.lag("place").over(own) != F.col("place"), F.lit(True)).alias("new"))
    mine = F.when(F.col("new") & (F.col("asked") == 0), 1).otherwise(0)
    rows = rows.select("*", mine.alias("mine"), F.sum(mine).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("before"))
    rank = F.when(F.col("new") & (F.col("asked") == 1), F.col("place") - F.col("before"))
    found = rows.select("user_id", "mine", rank.alias("rank")).groupBy("user_id").agg(
        F.count(F.when(F.col("rank") <= k, 1)).alias("hits"),
        F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.min("rank").alias("first"),
        F.sum("mine").alias("have"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    j = n.join(found, "user_id", "left").where(F.coalesce("have", F.lit(0)) < size)
    hit = F.coalesce("hits", F.lit(0))
    out = cut(j.select("user_id", (hit / k).alias("precision_at_k"), (hit / F.col("n")).alias("recall_at_k"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_at_k"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr")))
    tables.drop()
    return out


def candidate_counts(users: DataFrame, items: DataFrame, known: DataFrame) -> DataFrame:
    """(user_id, n): the items of the catalogue that a user does not have yet, counted without listing them; users with none are left out."""
    catalogue = items.select("item_id").distinct()
    size = catalogue.agg(F.count("*").alias("size"))
    have = known.select("user_id", "item_id").distinct().join(catalogue, "item_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("have"))
    j = users.select("user_id").distinct().join(have, "user_id", "left").join(F.broadcast(size))
    return j.select("user_id", (F.col("size") - F.coalesce("have", F.lit(0))).alias("n")).where("n > 0")
