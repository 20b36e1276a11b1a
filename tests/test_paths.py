"""Path metrics by joins against searches from every node."""

import random
from collections import deque

import pytest

from tributary.operators import centrality, paths


def brute(nodes, edges, directed):
    near = {v: set() for v in nodes}
    for a, b in edges:
        if a != b and a in near and b in near:
            near[a].add(b)
            if not directed:
                near[b].add(a)
    between, out = dict.fromkeys(nodes, 0.0), {}
    for s in nodes:
        dist, sigma, came, order, todo = {s: 0}, {s: 1.0}, {}, [], deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] = sigma.get(w, 0.0) + sigma[v]
                    came.setdefault(w, []).append(v)
        part = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in came.get(w, []):
                part[v] += sigma[v] / sigma[w] * (1 + part[w])
            if w != s:
                between[w] += part[w]
        total, reach = sum(dist.values()), len(order) - 1
        out[s] = [0.0, reach / total * reach / (len(nodes) - 1) if total else 0.0, max(dist.values())]
    for v in nodes:
        out[v][0] = between[v] if directed else between[v] / 2
    return out


@pytest.mark.parametrize("directed,batch_rows", [(False, 50_000_000), (True, 50_000_000), (False, 400)])
def test_path_metrics(spark, directed, batch_rows):
    rng = random.Random(7)
    nets = {("a", 0): (range(25), [(rng.randrange(25), rng.randrange(25)) for _ in range(40)]), ("a", 1): (range(10, 16), [(k, k + 1) for k in range(10, 15)] + [(10, 99), (12, 12), (11, 10)]), ("b", 0): ([5, 6], [])}
    nodes = spark.createDataFrame([(m, i, v) for (m, i), (vs, _) in nets.items() for v in vs] + [("b", 0, 5)], "model string, net_idx int, node long")
    edges = spark.createDataFrame([(m, i, a, b) for (m, i), (_, es) in nets.items() for a, b in es], "model string, net_idx int, src long, dst long")
    got = {(r[0], r[1], r[2]): r[3:] for r in centrality.path_metrics(nodes, edges, directed, batch_rows).collect()}
    want = {(m, i, v): x for (m, i), (vs, es) in nets.items() for v, x in brute(list(vs), es, directed).items()}
    assert set(got) == set(want)
    for k, x in want.items():
        assert got[k] == pytest.approx(x, abs=1e-9), k


def test_no_nodes(spark):
    nodes = spark.createDataFrame([], "model string, net_idx int, node long")
    edges = spark.createDataFrame([], "model string, net_idx int, src long, dst long")
    assert centrality.path_metrics(nodes, edges).count() == 0


@pytest.mark.parametrize("directed", [False, True])
def test_paths_over_several_tiles(spark, directed):
    rng = random.Random(3)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(70)] + [(30, 31), (31, 32)]
    rows = spark.createDataFrame([("m", 0, v) for v in range(34)], "model string, net_idx int, node long")
    links = spark.createDataFrame([("m", 0, a, b) for a, b in edges], "model string, net_idx int, src long, dst long")
    got = {r["node"]: tuple(r)[3:] for r in centrality.path_metrics(rows, links, directed, tile=(4, 8, 5)).collect()}
    want = brute(range(34), edges, directed)
    assert set(got) == set(want)
    for v, x in want.items():
        assert got[v] == pytest.approx(x, abs=1e-9), v


def test_a_step_gathers_without_a_row_for_a_source_and_edge(spark):
    grid = paths.Grid(100)
    ends = [(a, b) for a in range(60) for b in range(60) if a != b]
    links = paths.packed(spark.createDataFrame(ends, "a long, b long"), grid).persist()
    first = paths.first_level(spark.range(60), grid).persist()
    level = paths.further(first, first, links, grid)
    assert [links.count(), first.count(), level.count()] == [1, 1, 1]
    assert sorted(tuple(r) for r in paths.reached(level, grid).collect()) == [(k, 59.0) for k in range(60)]


@pytest.mark.parametrize("sources", [1, 16])
def test_whole_searches_write_no_level(spark, monkeypatch, sources):
    monkeypatch.setattr(paths, "first_level", None)
    monkeypatch.setattr(paths, "LEAST_SOURCES", sources)
    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]
    rows = spark.createDataFrame([(m, 0, v) for m in "ab" for v in range(40)], "model string, net_idx int, node long")
    links = spark.createDataFrame([("b", 0, a, b) for a, b in edges], "model string, net_idx int, src long, dst long")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in centrality.path_metrics(rows, links).collect()}
    want = {(m, 0, v): x for m, es in (("a", []), ("b", edges)) for v, x in brute(range(40), es, False).items()}
    assert set(got) == set(want)
    for k, x in want.items():
        assert got[k] == pytest.approx(x, abs=1e-9), k
