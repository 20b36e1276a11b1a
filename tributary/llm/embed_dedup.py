"""Near-duplicate vectors by int8-quantised tile products with rigorous error bounds.

Vectors of one label are dealt to tiles of bounded size, and every pair of tiles is one task.  A
unit vector x is held as s*q + e with q of int8; for two of them
|x.y - s_x s_y q_x.q_y| <= |e_x| + |s_x q_x| |e_y|.  Products of the q (exact integers) plus this
bound show which pairs could reach the threshold; only these are computed again in double
precision.  A task gives counts per vector and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, components

TILE = 4096
_SLACK = 1e-9


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, norm of the error, norm of scale*q) of unit rows; q are integers of at most 127."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127.0
    q = np.rint(x / scale[:, None])
    held = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(x - held, axis=1), np.linalg.norm(held, axis=1)


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool, step: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, rows, columns) of the links between two tiles, rows in steps."""
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    xa, xb = unit(a), unit(b)
    qa, sa, ea, ha = quantise(xa)
    qb, sb, eb, _ = quantise(xb)
    # products of int8 values in single precision are exact up to 2**24: 1024 dimensions at a time
    for lo in range(0, len(a), step):
        hi = min(lo + step, len(a))
        dot = np.zeros((hi - lo, len(b)))
        for d in range(0, a.shape[1], 1024):
            dot += qa[lo:hi, d : d + 1024].astype(np.float32) @ qb[:, d : d + 1024].astype(np.float32).T
        upper = dot * sa[lo:hi, None] * sb[None, :] + ea[lo:hi, None] + ha[lo:hi, None] * eb[None, :] + _SLACK
        maybe = upper >= threshold
        if same:
            maybe[np.arange(hi - lo), np.arange(lo, hi)] = False
        r, c = np.nonzero(maybe)
        # one formula for every pair, the same for (a, b) and (b, a), so that links are symmetric at the threshold
        hit = np.concatenate([np.zeros(0, bool), *((xa[lo + r[k : k + 65536]] * xb[c[k : k + 65536]]).sum(1) >= threshold for k in range(0, len(r), 65536))])
        yield lo, r[hit], c[hit]


def _tile_pair(table: pa.Table, threshold: float) -> pa.Table:
    """Counts and forest of one pair of tiles (or of one tile with itself): at most two tiles' rows."""
    ids, weight = table.column("vec_id").to_numpy(), table.column("copies").to_numpy()
    tile = table.column("tile").to_numpy()
    flat = table.column("embedding").combine_chunks()
    flat = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    ids, weight, tile, x = ids[order], weight[order], tile[order], x[order]
    first = tile == tile.min()
    left, right = np.flatnonzero(first), np.flatnonzero(~first)
    same = len(right) == 0
    if same:
        right = left
    links = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    for lo, r, c in tile_links(x[left], x[right], threshold, same):
        rows, cols = left[lo + r], right[c]
        np.add.at(links, rows, weight[cols])
        if not same:
            np.add.at(links, cols, weight[rows])
        cut = np.flatnonzero(np.diff(rows, prepend=-1)) if len(rows) else np.zeros(0, int)
        for k, begin in enumerate(cut.tolist()):
            stop = cut[k + 1] if k + 1 < len(cut) else len(rows)
            met = np.unique(np.append(root[cols[begin:stop]], root[rows[begin]]))
            if len(met) > 1:
                root[np.isin(root, met[1:])] = met[0]
    some = (links > 0) | (root != np.arange(len(ids)))
    return pa.table({"vec_id": ids[some], "links": links[some], "root": ids[root[some]]})


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors(vec_id, embedding, label)``.

    Vectors link when their labels are equal and not null and their cosine reaches ``threshold``.
    Vectors that are null, zero or hold null or non-finite components, and those of other lengths
    than the row compared with, link with nothing: n_links 0, component_id their own id, kept.
    Equal vectors of a label are one class with a count.  Rows with one vec_id (null: none) are one
    node; a row repeated with its id links with its copies.  An empty table gives no row.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.col("label"))
    sound = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value
    rows = rows.withColumn("sound", sound).withColumn("embedding", F.when(F.col("sound"), F.transform("embedding", lambda x: x + F.lit(0.0))))
    keyed = rows.withColumn("dims", F.size("embedding")).withColumn("h", F.xxhash64("embedding")).withColumn("g", F.hash("embedding"))
    classes = keyed.where("sound").groupBy("label", "dims", "h", "g").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.min_by("embedding", "vec_id").alias("embedding"))
    classes = scratch.write(classes, "classes")
    sizes = classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    dealt = classes.join(sizes, ["label", "dims"]).withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    pairs = dealt.withColumn("other", meets).withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")})
    found = pairs.select("label", "dims", "lo", "hi", "tile", "vec_id", "copies", "embedding").groupBy("label", "dims", "lo", "hi").applyInArrow(lambda table: _tile_pair(table, threshold), "vec_id long, links long, root long")
    found = scratch.write(found, "found")
    copies = keyed.where("sound").select("vec_id", "label", "dims", "h", "g").join(classes.select("label", "dims", "h", "g", F.col("vec_id").alias("rep"), "copies"), ["label", "dims", "h", "g"])
    copies = scratch.write(copies.select("vec_id", "rep", "copies"), "copies")
    edges = found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).unionByName(copies.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    labels = components(scratch, edges.where("a <> b"))
    counted = found.groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "rep")
    linked = copies.join(counted, "rep", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    out = rows.select("vec_id").join(linked, "vec_id", "left").join(labels.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
