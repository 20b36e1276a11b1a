"""Centrality of all networks at once, by joins keyed by network: no task holds a network.

``nodes(model, net_idx, node)`` and ``edges(model, net_idx, src, dst)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import Tables, cut
from . import paths
from .graph import dense_ids
from .links import Links

KEY = ["model", "net_idx"]


def _both(edges: DataFrame) -> DataFrame:
    u = edges.select(*KEY, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    return u.select(*KEY, F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(u.select(*KEY, F.col("b").alias("src"), F.col("a").alias("dst")))


def _numbered(tables: Tables, nodes: DataFrame) -> tuple[DataFrame, int]:
    """((model, net_idx, node, id), ids a network), written: the nodes once each; near nodes of a network have near ids.

    Networks are few (models x rates) and are numbered on the driver.
    """
    n = tables.write(nodes.select(*KEY, "node").distinct())
    nets = [(*r, k) for k, r in enumerate(n.select(*KEY).distinct().orderBy(*KEY).collect())]
    nets = F.broadcast(n.sparkSession.createDataFrame(nets, n.select(*KEY).withColumn("__k", F.lit(0).cast("long")).schema))
    codes = tables.write(dense_ids(n, "node"))
    per = codes.count() + 1  # one for a node without a name
    return tables.write(n.join(codes, "node", "left").join(nets, KEY).select(*KEY, "node", (F.col("__k") * F.lit(per) + F.coalesce("code", F.lit(per - 1))).alias("id"))), per


def _coded(n: DataFrame, edges: DataFrame, **ends: str) -> DataFrame:
    """The edges with the ids of their ends (new name = column) between nodes of ``n``."""
    for name, c in ends.items():
        edges = edges.join(n.select(*KEY, F.col("node").alias(c), F.col("id").alias(name)), [*KEY, c])
    return edges


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, steps: int = 20) -> DataFrame:
    """(model, net_idx, node, pagerank): uniform teleport and redistribution of dangling mass, ``steps`` iterations."""
    tables = Tables(nodes.sparkSession)
    n, _ = _numbered(tables, nodes)
    e = tables.write(edges.select(*KEY, "src", "dst"))
    out = e.groupBy(*KEY, "src").agg(F.count("*").alias("d"))
    size = nodes.groupBy(*KEY).agg(F.count("*").alias("n"))
    base = tables.write(n.join(size, KEY).join(out.withColumnRenamed("src", "node"), [*KEY, "node"], "left"))
    links = Links(tables.write(_coded(n, e.join(out, [*KEY, "src"]), a="src", b="dst").select("a", "b", (1.0 / F.col("d")).alias("w"))))
    state = base.withColumn("x", 1.0 / F.col("n"))
    for _ in range(steps):
        got = links.passed(state.select("id", "x")).withColumnRenamed("x", "p")
        lost = state.groupBy(*KEY).agg(F.sum(F.when(F.col("d").isNull(), F.col("x")).otherwise(0.0)).alias("lost"))
        state = base.join(got, "id", "left").join(lost, KEY).withColumn("x", (1.0 - damping) / F.col("n") + damping * (F.coalesce("p", F.lit(0.0)) + F.col("lost") / F.col("n"))).select(*base.columns, "x")
        state = tables.write(state)  # the next step reads it more than once
    result = cut(state.select(*KEY, "node", F.col("x").alias("pagerank")))
    links.drop()
    tables.drop()
    return result


#: Steps of a power iteration between two writes; so few that scores not yet scaled stay far from overflow.
_CHAIN = 10


def _known(n: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b): the ids of src and dst of the edges between two different nodes of ``n``, each once."""
    return _coded(n, edges.where("src <> dst").select(*KEY, "src", "dst").distinct(), a="src", b="dst").select("a", "b")


def _unit(state: DataFrame, per: int) -> DataFrame:
    """A written state(id, x), ``per`` ids a network, scaled to length 1 in each network; one of zeros stays."""
    state = state.withColumn("net", F.expr(f"id div {per}"))
    norm = state.groupBy("net").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return state.join(F.broadcast(norm), "net").select("id", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(F.col("x")).alias("x"))


def _powers(tables: Tables, state: DataFrame, step, steps: int, chain: int, per: int) -> DataFrame:
    """``steps`` steps from a state, scaled and written after every ``chain`` of them."""
    for done in range(0, steps, chain):
        for _ in range(min(chain, steps - done)):
            state = step(state)
        state = _unit(tables.write(state), per)
    return state


def _flipped(links: DataFrame) -> DataFrame:
    return links.select(F.col("b").alias("a"), F.col("a").alias("b"))


def hits(nodes: DataFrame, edges: DataFrame, steps: int = 20) -> DataFrame:
    """(model, net_idx, node, hub_score, auth_score): power iteration of ``steps`` (1 or more) rounds, L2-normalised.

    Networks without edges have scores of 0.
    """
    tables = Tables(nodes.sparkSession)
    n, per = _numbered(tables, nodes)
    e = tables.write(_known(n, edges))
    there, back = Links(e.withColumn("w", F.lit(1.0))), Links(_flipped(e).withColumn("w", F.lit(1.0)))
    hub = _powers(tables, n.select("id", F.lit(1.0).alias("x")), lambda x: back.passed(there.passed(x)), steps - 1, _CHAIN // 2, per)
    auth = _unit(tables.write(there.passed(hub)), per)
    hub = _unit(tables.write(back.passed(auth)), per)
    out = n.join(hub.withColumnRenamed("x", "hub_score"), "id", "left").join(auth.withColumnRenamed("x", "auth_score"), "id", "left")
    out = cut(out.na.fill(0.0, ["hub_score", "auth_score"]).drop("id"))
    for x in (there, back, tables):
        x.drop()
    return out


def eigenvector(nodes: DataFrame, edges: DataFrame, steps: int = 100) -> DataFrame:
    """(model, net_idx, node, eigenvector): power iteration of A + I on the undirected view (the shift keeps bipartite networks from swinging)."""
    tables = Tables(nodes.sparkSession)
    n, per = _numbered(tables, nodes)
    e = _known(n, edges)
    both = e.unionByName(_flipped(e)).distinct().unionByName(n.select(F.col("id").alias("a"), F.col("id").alias("b")))
    links = Links(tables.write(both.withColumn("w", F.lit(1.0))))
    state = _powers(tables, _unit(n.select("id", F.lit(1.0).alias("x")), per), links.passed, steps, _CHAIN, per)
    out = cut(n.join(state, "id").select(*KEY, "node", F.col("x").alias("eigenvector")))
    links.drop()
    tables.drop()
    return out


def _declared(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges(src, dst)): each once, edges between two different ones of the nodes."""
    n = nodes.select(*KEY, "node").distinct()
    e = edges.where("src <> dst").select(*KEY, "src", "dst").distinct()
    for c in ("src", "dst"):
        e = e.join(n.withColumnRenamed("node", c), [*KEY, c], "left_semi")
    return n, e.select(*KEY, "src", "dst")


def _passed(state: DataFrame, links: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(node, x): each node's sum of w * x over its ``links(a, b, w)`` from nodes of ``state(node, x)``, and its rows of ``base``.

    The state is read once, so steps can follow each other in one plan; sums combine before they are
    shuffled, and a node with many links may be split by the adaptive join.
    """
    moved = links.join(state.select(*KEY, F.col("node").alias("a"), "x"), [*KEY, "a"]).select(*KEY, F.col("b").alias("node"), (F.col("w") * F.col("x")).alias("x"))
    moved = moved if base is None else moved.unionByName(base)
    return moved.groupBy(*KEY, "node").agg(F.sum("x").alias("x"))


def pagerank_beta(nodes: DataFrame, edges: DataFrame, beta: DataFrame, alpha: float = 0.85, tolerance: float = 1e-13, rounds: int = 2000) -> DataFrame:
    """(model, net_idx, node, pagerank_lph): the fixed point of x_i = (beta_i + alpha * sum of successors' x)/max(out, 1), scaled to sum 1.

    ``beta(model, net_idx, node, beta)``; nodes without one get (1-alpha)/N.  The map contracts by alpha, so it
    settles within some hundred of the ``rounds``: once ``_CHAIN`` of them change no finite score by more than
    ``tolerance`` (of the largest, where that is above 1).  A beta that is not finite gives scores that are not.
    """
    tables = Tables(nodes.sparkSession)
    n, e = _declared(nodes, edges)
    n, e = tables.write(n), tables.write(e)
    own = n.join(n.groupBy(*KEY).agg(F.count("*").alias("size")), KEY).join(beta.select(*KEY, "node", F.col("beta").cast("double").alias("beta")), [*KEY, "node"], "left")
    own = own.join(e.groupBy(*KEY, F.col("src").alias("node")).agg(F.count("*").alias("out")), [*KEY, "node"], "left")
    share = F.nanvl(F.coalesce("beta", F.lit(float("nan"))), (1.0 - alpha) / F.col("size"))
    base = tables.write(own.select(*KEY, "node", (share / F.coalesce("out", F.lit(1))).alias("x")))
    out = e.groupBy(*KEY, "src").agg(F.count("*").alias("out"))
    links = tables.write(e.join(out, [*KEY, "src"]).select(*KEY, F.col("dst").alias("a"), F.col("src").alias("b"), (alpha / F.col("out")).alias("w")))
    state, done = base, 0
    while done < rounds:
        new = state
        for _ in range(min(_CHAIN, rounds - done)):
            new = _passed(new, links, base)
        new = tables.write(new)
        done += _CHAIN
        both = new.join(state.withColumnRenamed("x", "y"), [*KEY, "node"]).select(F.abs(F.col("x") - F.col("y")).alias("change"), F.abs("x").alias("x"))
        both = both.where(F.col("change") < float("inf"))
        most = both.agg(F.max("change").alias("change"), F.max("x").alias("x")).first()
        state = new
        if most["change"] is None or most["change"] <= tolerance * max(1.0, most["x"]):
            break
    x = F.greatest("x", F.lit(0.0))
    total = state.groupBy(*KEY).agg(F.sum(x).alias("total"))
    result = cut(state.join(total, KEY).select(*KEY, "node", F.when(F.col("total") > 0, x / F.col("total")).otherwise(x).alias("pagerank_lph")))
    tables.drop()
    return result


def softmax_beta(scores: DataFrame, alpha: float = 0.85) -> DataFrame:
    """(model, net_idx, node, beta) = (1 - alpha) * softmax(lph_score) within each network."""
    top = scores.groupBy(*KEY).agg(F.max("lph_score").alias("m"))
    e = scores.join(top, KEY).select(*KEY, "node", F.exp(F.col("lph_score") - F.col("m")).alias("e"))
    return e.join(e.groupBy(*KEY).agg(F.sum("e").alias("t")), KEY).select(*KEY, "node", ((1.0 - alpha) * F.col("e") / F.col("t")).alias("beta"))


def _over_tiles(n: DataFrame, e: DataFrame, size: DataFrame, grid: paths.Grid, directed: bool, batch_rows: int, tables: Tables) -> list[DataFrame]:
    """(id, b, total, n, far) by batches of blocks of sources, so many that (source, node) pairs stay below about ``batch_rows``.

    Forward, a level's numbers of paths go along the edges and nodes of earlier levels drop out; backward,
    each level hands its dependencies to the one before.  A batch's levels are dropped after it.
    """
    there = tables.write(paths.packed(e, grid))
    back = tables.write(paths.packed(_flipped(e), grid)) if directed else there
    pairs = size.agg(F.sum(F.col("size").cast("double") * F.col("size"))).first()[0] or 0.0
    batches = max(1, int(-(-pairs // batch_rows)))
    every = []
    for k in range(batches):
        own = Tables(n.sparkSession)
        mine = n.select("id").where(F.pmod(F.xxhash64(F.expr(f"id div {grid.per}"), F.expr(f"(id % {grid.per}) div {grid.sources}")), F.lit(batches)) == k)
        levels = [own.write(paths.first_level(mine, grid))]
        while True:
            # along undirected edges, only the last two levels can come up again
            seen = reduce(DataFrame.unionByName, levels if directed else levels[-2:])
            new = own.write(paths.further(levels[-1], seen, there, grid))
            if new.isEmpty():
                break
            levels.append(new)
        rows = [paths.reached(level, grid).select("id", F.lit(0.0).alias("part"), "n", F.lit(d).alias("far")) for d, level in enumerate(levels)]
        for d in range(len(levels) - 1, 0, -1):
            rows.append(paths.parts(levels[d], grid).select("id", "part", F.lit(0.0).alias("n"), F.lit(0).alias("far")))
            if d > 1:
                levels[d - 1] = own.write(paths.handed_back(levels[d], levels[d - 1], back, grid))
        one = reduce(DataFrame.unionByName, rows).groupBy("id")
        every.append(tables.write(one.agg(F.sum("part").alias("b"), F.sum(F.col("n") * F.col("far")).alias("total"), F.sum("n").alias("n"), F.max("far").alias("far"))))
        own.drop()
    return every


def path_metrics(nodes: DataFrame, edges: DataFrame, directed: bool = False, batch_rows: int = 50_000_000, tile: tuple[int, ...] = ()) -> DataFrame:
    """(model, net_idx, node, betweenness, closeness, eccentricity) of all networks, by Brandes (``operators.paths``).

    Blocks of sources are searched in a task each, which is sent the edges of their network; networks with more
    edges than a task should hold (and with ``tile``) are searched over tiles instead.  Closeness is scaled by the
    reachable share (Wasserman-Faust), 0 if isolated; eccentricity is the farthest reachable node's distance.
    """
    tables = Tables(nodes.sparkSession)
    n, per = _numbered(tables, nodes)
    grid = paths.Grid(per, *tile)
    e = tables.write(_known(n, edges))
    e = e if directed else tables.write(e.unionByName(_flipped(e)).distinct())
    size = tables.write(n.groupBy(*KEY).agg(F.count("*").alias("size")))
    most = e.groupBy(F.expr(f"a div {per}")).count().agg(F.max("count")).first()[0] or 0
    every = _over_tiles(n, e, size, grid, directed, batch_rows, tables) if tile or most > paths.MOST_LINKS else [paths.searched(n.select("id"), e, grid)]
    sums = reduce(DataFrame.unionByName, every).groupBy("id").agg(F.sum("b").alias("b"), F.max("total").alias("total"), (F.max("n") - 1).alias("reach"), F.max("far").alias("far"))
    sums = n.join(sums, "id").join(size, KEY)
    near_share = F.when((F.col("total") > 0) & (F.col("size") > 1), F.col("reach") / F.col("total") * (F.col("reach") / (F.col("size") - 1))).otherwise(0.0)
    out = cut(sums.select(*KEY, "node", (F.col("b") if directed else F.col("b") / 2.0).alias("betweenness"), near_share.alias("closeness"), F.col("far").cast("long").alias("eccentricity")))
    tables.drop()
    return out


def bfs(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(source, node, dist) along undirected ``edges(u, v)`` from ``sources(node)``: a join per level, until none is new or ``most``."""
    e = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    seen = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("dist"))
    front, level = seen, 0
    while most is None or level < most:
        level += 1
        nxt = front.join(e, front["node"] == e["a"]).select("source", F.col("b").alias("node")).distinct().join(seen.select("source", "node"), ["source", "node"], "left_anti")
        front = cut(nxt.withColumn("dist", F.lit(level)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front)) if level % 10 == 0 else seen.unionByName(front)
    return seen


def bundle(nodes: DataFrame, edges: DataFrame, beta: DataFrame | None = None) -> DataFrame:
    """All metrics per node and network, missing ones 0; pagerank_lph only with community scores."""
    n = nodes.select(*KEY, "node").distinct()
    size = n.groupBy(*KEY).agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("n"))
    count = lambda c, name: edges.groupBy(*KEY, F.col(c).alias("node")).agg(F.count("*").alias(name))
    out = n.join(size, KEY).join(count("src", "o"), [*KEY, "node"], "left").join(count("dst", "i"), [*KEY, "node"], "left").na.fill(0)
    share: Column = F.col("n")
    out = out.select(*KEY, "node", (F.col("i") / share).alias("in_degree"), (F.col("o") / share).alias("out_degree"), ((F.col("i") + F.col("o")) / share).alias("degree"))
    for part in (pagerank(n, edges), hits(n, edges), eigenvector(n, edges), path_metrics(n, edges), local_clustering(n, edges)):
        out = out.join(part, [*KEY, "node"], "left")
    if beta is not None:
        out = out.join(pagerank_beta(n, edges, beta), [*KEY, "node"], "left")
    return out.na.fill(0)


def local_clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(model, net_idx, node, clustering) on the undirected view: triangles over pairs of neighbours, 0 below two.

    Edges point to the end of larger degree, so that a hub is the start of few wedges; a closed wedge
    is one triangle, counted at its three nodes.
    """
    u = cut(_both(edges))
    deg = u.groupBy(*KEY, F.col("src").alias("node")).agg(F.count("*").alias("d"))
    rank = lambda c, name: deg.select(*KEY, F.col("node").alias(c), F.struct("d", F.col("node").alias("v")).alias(name))
    up = cut(u.join(rank("src", "x"), [*KEY, "src"]).join(rank("dst", "y"), [*KEY, "dst"]).where("x < y").select(*KEY, "src", "dst", "y"))
    wedge = up.alias("p").join(up.alias("q"), [*KEY, "src"]).where("p.y < q.y").select(*KEY, F.col("src").alias("low"), F.col("p.dst").alias("a"), F.col("q.dst").alias("b"))
    closed = wedge.join(up.select(*KEY, F.col("src").alias("a"), F.col("dst").alias("b")), [*KEY, "a", "b"], "left_semi")
    each = closed.select(*KEY, F.explode(F.array("low", "a", "b")).alias("node")).groupBy(*KEY, "node").agg(F.count("*").alias("t"))
    j = nodes.select(*KEY, "node").distinct().join(deg, [*KEY, "node"], "left").join(each, [*KEY, "node"], "left").na.fill(0, ["d", "t"])
    return j.select(*KEY, "node", F.when(F.col("d") > 1, 2.0 * F.col("t") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("clustering"))
