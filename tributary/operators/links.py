"""Sums along weighted links, step after step, with the links packed once and never shuffled again.

Links are dealt to blocks of their targets (``blocks.deal``), and each block is packed into one row of
arrays, bucketed by block.  A step sends a node's score once to each block that has a link from it; the
block adds up its links and gives a row for each of its targets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import Tables, dropped, shared_folder
from . import blocks

_PACKED = ["sources", "place", "targets", "starts", "weights"]
_KINDS = [np.int64, np.int32, np.int64, np.int32, np.float64]


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    order = np.argsort(rows.column("id").to_numpy(), kind="stable")
    target, source, w = (rows.column(c).to_numpy()[order] for c in ("id", "other", "x"))
    starts = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
    sources, place = np.unique(source, return_inverse=True)
    parts = [sources, place, target[starts], starts, w]
    return pa.Table.from_arrays([pa.array([k.as_py()], pa.int64()) for k in key] + [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(parts, _KINDS, strict=True)], ["block", "salt", *_PACKED])


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """Each target's sum of weight * score; sources without a score add nothing."""
    if not len(left) or not len(right):
        return pa.table({"id": pa.array([], pa.int64()), "x": pa.array([], pa.float64())})
    sources, place, targets, starts, w = (np.frombuffer(left.column(c)[0].as_py(), t) for c, t in zip(_PACKED, _KINDS, strict=True))
    score = np.zeros(len(sources))
    score[np.searchsorted(sources, right.column("other").to_numpy())] = right.column("x").to_numpy()
    return pa.table({"id": pa.array(targets), "x": pa.array(np.add.reduceat(w * score[place], starts))})


class Links:
    """``links(a, b, w)`` between long ids: ``passed`` adds up w * x over each b's links."""

    def __init__(self, links: DataFrame):
        self.spark = links.sparkSession
        self.dealt = blocks.deal(links.withColumnRenamed("w", "rating"), "b", "a")
        self.tables = Tables(self.spark)
        fields = "block long, salt long, " + ", ".join(f"{c} binary" for c in _PACKED)
        packed = self.tables.write(self.dealt.ratings.groupBy("block", "salt").applyInArrow(_pack, fields))
        self.packed, self.name = blocks._bucketed(packed, max(1, packed.count()), "block", "salt")

    def passed(self, state: DataFrame, base: DataFrame | None = None) -> DataFrame:
        """(id, x) of all ids with a link from ``state(id, x)``'s blocks, and the rows of ``base`` added."""
        keys = ["block", "salt"]
        sent = self.dealt.routes.join(state.select(F.col("id").alias("other"), "x"), "other").select(*keys, "other", "x")
        moved = self.packed.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_summed, "id long, x double")
        moved = moved if base is None else moved.unionByName(base.select("id", "x"))
        return moved.groupBy("id").agg(F.sum("x").alias("x"))

    def drop(self) -> None:
        self.tables.drop()
        self.dealt.drop()
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        dropped(self.spark, f"{shared_folder(self.spark).rstrip('/')}/{self.name}")
