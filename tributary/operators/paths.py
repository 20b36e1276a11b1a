"""Shortest paths from all nodes of all networks at once, over tiles of sources and nodes.

Nodes are numbered.  A tile holds a block of sources and a range of nodes: the places ``at`` (node *
sources + source, both counted within the tile) that a level of the search reaches, and a value for
each.  Edges are packed once by the ranges of their two ends.  In a step a range's tile gathers from the
tiles of all ranges that have edges into it; what is sent is a level's places, each once a range, and no
task holds more than a block of sources and the edges into a range.

Where a network has no more than ``MOST_LINKS`` edges, its packed edges are sent to each block of sources
instead (``searched``): a task searches from its sources one by one, and no (source, node) pair is sent or written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges of a network that a task holds (4 bytes each), and the sources of a task.
MOST_LINKS, LEAST_SOURCES, MOST_SOURCES = 50_000_000, 16, 4096


@dataclass(frozen=True)
class Grid:
    """Ids a network, and of a tile: sources, nodes, and edges whose values are gathered at once."""

    per: int
    sources: int = 256
    width: int = 4096
    edges: int = 8192


TILE = ["net", "s", "j"]
_TILES = "net long, s long, j long, at binary, x binary, part binary"


def packed(edges: DataFrame, g: Grid) -> DataFrame:
    """(net, i, j, a, b): the edges of ``edges(a, b)``, by the ranges of their ends; by b in each."""
    code = lambda c: F.pmod(F.col(c), F.lit(g.per))
    e = edges.select(F.expr(f"a div {g.per}").alias("net"), code("a").alias("a"), code("b").alias("b"))
    e = e.select("net", F.expr(f"a div {g.width}").alias("i"), F.expr(f"b div {g.width}").alias("j"), (F.col("a") % g.width).cast("int").alias("a"), (F.col("b") % g.width).cast("int").alias("b"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        a, b = (rows.column(c).to_numpy() for c in ("a", "b"))
        order = np.argsort(b, kind="stable")
        return pa.Table.from_arrays([*(pa.array([k.as_py()]) for k in key), pa.array([a[order].tobytes()]), pa.array([b[order].tobytes()])], ["net", "i", "j", "a", "b"])

    return e.groupBy("net", "i", "j").applyInArrow(run, "net long, i long, j long, a binary, b binary")


def _gathered(sent: pa.Table, links: pa.Table, g: Grid) -> np.ndarray:
    """The sums over the links of the values sent, a row for each node of the range."""
    out, given = np.zeros((g.width, g.sources)), {}
    for i, at, x in zip(*(sent.column(c).to_pylist() for c in ("i", "at", "x")), strict=True) if len(sent) else ():
        given[i] = np.frombuffer(at, np.int32), np.frombuffer(x)
    for i, a, b in zip(*(links.column(c) for c in ("of", "a", "b")), strict=True) if len(links) else ():
        at, x = given[i.as_py()]
        f = np.zeros(g.width * g.sources)
        f[at] = x
        f = f.reshape(g.width, g.sources)
        a, b = np.frombuffer(a.as_py(), np.int32), np.frombuffer(b.as_py(), np.int32)
        used = np.zeros(g.width, bool)
        used[at // g.sources] = True
        a, b = a[used[a]], b[used[a]]
        for lo in range(0, len(a), g.edges):
            to = b[lo : lo + g.edges]
            starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            out[to[starts]] += np.add.reduceat(f[a[lo : lo + g.edges]], starts)
    return out


def _tile(key: tuple, at: np.ndarray, x: np.ndarray, part: np.ndarray) -> pa.Table:
    one = lambda v: pa.array([v.tobytes()] if len(at) else [], pa.binary())
    return pa.Table.from_arrays([*(pa.array([k.as_py()] if len(at) else [], pa.int64()) for k in key), one(at.astype(np.int32)), one(x), one(part)], [*TILE, "at", "x", "part"])


def _step(sent: DataFrame, own: DataFrame, links: DataFrame, g: Grid, run: Callable) -> DataFrame:
    """``run(key, sums, tiles of own)`` for every tile that the links lead to from ``sent(net, s, i, at, x)``, or that is in ``own``."""
    to = links.select("net", "i", "j").join(sent, ["net", "i"]).select(*TILE, F.lit(0).alias("kind"), "i", "at", "x")
    mine = own.select(*TILE, F.lit(1).alias("kind"), F.lit(None).cast("long").alias("i"), "at", "x")
    edges = links.join(sent.select("net", "s", "i"), ["net", "i"]).select(*[F.col(c).alias(f"to_{c}") for c in TILE], F.col("i").alias("of"), "a", "b")

    def one(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        kind = left.column("kind").to_numpy()
        return run(key, _gathered(left.filter(pa.array(kind == 0)), right, g).reshape(-1), left.filter(pa.array(kind == 1)))

    return to.unionByName(mine).groupBy(*TILE).cogroup(edges.groupBy(*[f"to_{c}" for c in TILE])).applyInArrow(one, _TILES)


def _further(key: tuple, sums: np.ndarray, seen: pa.Table) -> pa.Table:
    for at in seen.column("at").to_pylist():
        sums[np.frombuffer(at, np.int32)] = 0.0
    at = np.flatnonzero(sums)
    return _tile(key, at, sums[at], np.zeros(len(at)))


def _back(key: tuple, sums: np.ndarray, own: pa.Table) -> pa.Table:
    if not len(own):
        return _tile(key, *[np.zeros(0)] * 3)
    at, x = np.frombuffer(own.column("at")[0].as_py(), np.int32), np.frombuffer(own.column("x")[0].as_py())
    return _tile(key, at, x, x * sums[at])


def first_level(ids: DataFrame, g: Grid) -> DataFrame:
    """Every node of ``ids(id)`` as a source at itself."""
    code = F.pmod(F.col("id"), F.lit(g.per))
    n = ids.select(F.expr(f"id div {g.per}").alias("net"), code.alias("c")).select("net", F.expr(f"c div {g.sources}").alias("s"), F.expr(f"c div {g.width}").alias("j"), "c")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        c = np.sort(rows.column("c").to_numpy())
        return _tile(key, c % g.width * g.sources + c % g.sources, np.ones(len(c)), np.zeros(len(c)))

    return n.groupBy(*TILE).applyInArrow(run, _TILES)


def further(front: DataFrame, seen: DataFrame, links: DataFrame, g: Grid) -> DataFrame:
    """The next level: places that no tile of ``seen`` has, and the number of shortest paths to each (x)."""
    return _step(front.withColumnRenamed("j", "i").select("net", "s", "i", "at", "x"), seen, links, g, _further)


def handed_back(level: DataFrame, before: DataFrame, links: DataFrame, g: Grid) -> DataFrame:
    """The level ``before`` with its dependencies (part), from the next level's, along links turned round."""

    def run(batches):
        for batch in batches:
            gain = [((1.0 + np.frombuffer(p)) / np.frombuffer(x)).tobytes() for x, p in zip(batch.column("x").to_pylist(), batch.column("part").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("net", "s", "j", "at")] + [pa.array(gain, pa.binary())], ["net", "s", "i", "at", "x"])

    return _step(level.mapInArrow(run, "net long, s long, i long, at binary, x binary"), before, links, g, _back)


def _by(level: DataFrame, value: Callable, g: Grid, name: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for net, s, j, at, part in zip(*(batch.column(c).to_pylist() for c in (*TILE, "at", "part")), strict=True):
                code, x = value(s, j, np.frombuffer(at, np.int32), np.frombuffer(part))
                yield pa.RecordBatch.from_arrays([pa.array(net * g.per + code, pa.int64()), pa.array(x, pa.float64())], ["id", name])

    return level.mapInArrow(run, f"id long, {name} double")


def reached(level: DataFrame, g: Grid) -> DataFrame:
    """(id, n): how many nodes the level reaches from each source, tile by tile."""

    def value(s: int, j: int, at: np.ndarray, part: np.ndarray):
        n = np.bincount(at % g.sources, minlength=g.sources)
        return s * g.sources + np.flatnonzero(n), n[n > 0].astype(float)

    return _by(level, value, g, "n")


def parts(level: DataFrame, g: Grid) -> DataFrame:
    """(id, part): each node's dependencies, summed over the sources of a tile."""

    def value(s: int, j: int, at: np.ndarray, part: np.ndarray):
        node, place = np.unique(at // g.sources, return_inverse=True)
        return j * g.width + node, np.bincount(place, part)

    return _by(level, value, g, "part")


def _neighbours(starts: np.ndarray, to: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends of the nodes' edges, in their order; how many each has)."""
    lo, n = starts[nodes], starts[nodes + 1] - starts[nodes]
    return to[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)], n


def _search(source: int, starts: np.ndarray, to: np.ndarray, entered: np.ndarray, most: int, part: np.ndarray) -> tuple[int, int, int]:
    """(nodes reached, sum of distances, farthest distance) from ``source``; adds each node's dependency to ``part``.

    Of ``most`` nodes that ``entered`` marks, once all are reached no level follows.
    """
    size = len(starts) - 1
    seen, sigma = np.zeros(size, bool), np.zeros(size)
    seen[source], sigma[source] = True, 1.0
    left = most - int(entered[source])
    level, levels = np.array([source]), []
    while left and len(level):
        end, n = _neighbours(starts, to, level)
        new = ~seen[end]
        end, of = end[new], np.repeat(np.arange(len(level)), n)[new]
        got = np.bincount(end, sigma[level][of], size) if len(end) else np.zeros(size)
        levels.append((level, end, of))
        level = np.flatnonzero(got)
        sigma[level] = got[level]
        seen[level] = True
        left -= len(level)
    if len(level):
        levels.append((level, level[:0], level[:0]))
    gain = np.zeros(size)
    for k in range(len(levels) - 1, 0, -1):
        nodes, end, of = levels[k]
        own = sigma[nodes] * np.bincount(of, gain[end], len(nodes)) if len(end) else np.zeros(len(nodes))
        part[nodes] += own
        gain[nodes] = (1.0 + own) / sigma[nodes]
    sizes = [len(nodes) for nodes, _, _ in levels] or [1]
    return sum(sizes), sum(k * x for k, x in enumerate(sizes)), len(sizes) - 1


def searched(ids: DataFrame, edges: DataFrame, g: Grid) -> DataFrame:
    """(id, b, total, n, far): each node of ``ids(id)`` as a source, and its dependencies from every block of sources, along ``edges(a, b)``."""
    spark = ids.sparkSession
    n = ids.count()
    each = min(MOST_SOURCES, max(LEAST_SOURCES, -(-n // (8 * spark.sparkContext.defaultParallelism))))
    code = lambda c: F.pmod(F.col(c), F.lit(g.per))
    e = edges.select(F.expr(f"a div {g.per}").alias("net"), code("a").alias("a"), code("b").cast("int").alias("b")).withColumn("i", F.expr(f"a div {g.width}"))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        a, b = rows.column("a").to_numpy() % g.width, rows.column("b").to_numpy()
        out = np.bincount(a, minlength=g.width).astype(np.int32), b[np.argsort(a, kind="stable")].astype(np.int32)
        return pa.Table.from_arrays([*(pa.array([k.as_py()]) for k in key), *(pa.array([x.tobytes()], pa.binary()) for x in out)], ["net", "i", "n", "b"])

    links = e.groupBy("net", "i").applyInArrow(pack, "net long, i long, n binary, b binary")
    own = ids.select(F.expr(f"id div {g.per}").alias("net"), code("id").alias("c")).withColumn("s", F.expr(f"c div {each}"))

    def listed(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([*(pa.array([k.as_py()]) for k in key), pa.array([rows.column("c").to_numpy().astype(np.int32).tobytes()], pa.binary())], ["net", "s", "b"])

    sources = own.groupBy("net", "s").applyInArrow(listed, "net long, s long, b binary").select("net", "s", F.lit(-1).cast("long").alias("i"), F.lit(None).cast("binary").alias("n"), "b")
    blocks = own.select("net", "s").distinct()
    sent = sources.unionByName(links.join(blocks, "net").select("net", "s", "i", "n", "b"))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, degree, ends = np.zeros(0, np.int32), np.zeros(0, np.int32), {}
        for batch in batches:
            for i, n, b in zip(*(batch.column(c).to_pylist() for c in ("i", "n", "b")), strict=True):
                if i < 0:
                    mine = np.frombuffer(b, np.int32)
                else:
                    ends[i] = np.frombuffer(n, np.int32), np.frombuffer(b, np.int32)
        size = max(g.per, g.width * (max(ends, default=0) + 1))
        degree = np.zeros(size, np.int64)
        for i, (n, _) in ends.items():
            degree[i * g.width : (i + 1) * g.width] = n
        to = np.concatenate([ends[i][1] for i in sorted(ends)]) if ends else np.zeros(0, np.int32)
        ends.clear()
        starts = np.r_[0, np.cumsum(degree)]
        entered, part = np.zeros(size, bool), np.zeros(size)
        entered[to] = True
        most = int(entered.sum())
        found = np.array([_search(int(c), starts, to, entered, most, part) for c in mine], np.int64).reshape(-1, 3)
        net, none = key[0].as_py() * g.per, lambda x: np.zeros(len(x))
        names = ["id", "b", "total", "n", "far"]
        yield pa.RecordBatch.from_arrays([pa.array(net + mine.astype(np.int64)), pa.array(none(mine)), pa.array(found[:, 1].astype(float)), pa.array(found[:, 0].astype(float)), pa.array(found[:, 2].astype(np.int32))], names)
        at = np.flatnonzero(part)
        yield pa.RecordBatch.from_arrays([pa.array(net + at), pa.array(part[at]), pa.array(none(at)), pa.array(none(at)), pa.array(np.zeros(len(at), np.int32))], names)

    many = min(4096, max(1, blocks.count()))
    return sent.repartition(many, "net", "s").groupBy("net", "s").applyInArrow(run, "id long, b double, total double, n double, far int")
