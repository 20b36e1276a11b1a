"""HITS, eigenvector, PageRank with own teleport and clustering against dense matrices, network by network."""

import numpy as np
import pytest

from tributary.operators import centrality

K = "model string, net_idx int, "


@pytest.fixture(scope="module")
def networks(spark):
    rng = np.random.default_rng(5)
    nodes, edges = [], []
    for net, (n, m) in enumerate([(30, 90), (12, 0), (25, 200)]):
        nodes += [("m", net, 10 * k) for k in range(n)] + [("m", net, 0)]  # the first one twice
        edges += [("m", net, int(a), int(b)) for a, b in 10 * rng.integers(0, n - 2, (m, 2))]  # loops and repeats; two isolated nodes
        edges += [("m", net, 0, 5), ("m", net, 7, 10)] + [("m", net, 0, 10 * k) for k in range(1, n - 2) if net == 2]  # unknown ends; a hub
    return nodes, edges, spark.createDataFrame(nodes, K + "node long"), spark.createDataFrame(edges, K + "src long, dst long")


def dense(nodes, edges, net):
    ids = sorted({v for _, k, v in nodes if k == net})
    a = np.zeros((len(ids), len(ids)))
    for _, k, s, d in edges:
        if k == net and s != d and s in ids and d in ids:
            a[ids.index(s), ids.index(d)] = 1
    return ids, a


def unit(x):
    return x / np.linalg.norm(x) if np.linalg.norm(x) > 0 else x


def held(rows, net, ids, want, column):
    got = {r["node"]: r[column] for r in rows if r["net_idx"] == net}
    assert len(got) == sum(r["net_idx"] == net for r in rows)
    assert sorted(got) == ids
    assert np.allclose([got[v] for v in ids], want, atol=1e-9)


def test_hits(networks):
    nodes, edges, n, e = networks
    rows = centrality.hits(n, e, steps=7).collect()
    for net in range(3):
        ids, a = dense(nodes, edges, net)
        hub = np.ones(len(ids))
        for _ in range(7):
            auth = unit(a.T @ hub)
            hub = unit(a @ auth)
        held(rows, net, ids, hub, "hub_score")
        held(rows, net, ids, auth, "auth_score")


def test_eigenvector(networks):
    nodes, edges, n, e = networks
    rows = centrality.eigenvector(n, e, steps=13).collect()
    for net in range(3):
        ids, a = dense(nodes, edges, net)
        both = np.maximum(a, a.T) + np.eye(len(ids))
        x = unit(np.ones(len(ids)))
        for _ in range(13):
            x = unit(both @ x)
        held(rows, net, ids, x, "eigenvector")


def test_pagerank_beta(spark, networks):
    nodes, edges, n, e = networks
    given = [("m", net, 10 * k, b) for net in range(3) for k, b in ((0, 0.3), (3, 0.02), (4, float("nan")), (5, -0.1))]
    rows = centrality.pagerank_beta(n, e, spark.createDataFrame(given, K + "node long, beta double")).collect()
    for net in range(3):
        ids, a = dense(nodes, edges, net)
        b = np.full(len(ids), 0.15 / len(ids))
        for _, k, v, x in given:
            if k == net and not np.isnan(x):
                b[ids.index(v)] = x
        out = np.maximum(a.sum(axis=1), 1)
        x = np.maximum(np.linalg.solve(np.diag(out) - 0.85 * a, b), 0)
        held(rows, net, ids, x / x.sum(), "pagerank_lph")


def test_no_nodes_and_endless_beta(spark, networks):
    _, _, n, e = networks
    none = n.where("node < 0")
    assert centrality.hits(none, e, 2).count() == centrality.eigenvector(none, e, 2).count() == 0
    beta = spark.createDataFrame([("m", 0, 10, float("inf"))], K + "node long, beta double")
    assert centrality.pagerank_beta(none, e, beta).count() == 0
    got = centrality.pagerank_beta(n, e, beta).where("net_idx = 0").toPandas()["pagerank_lph"]
    assert not np.isfinite(got).all()


def test_local_clustering(networks):
    nodes, edges, n, e = networks
    e = e.where("src % 10 = 0 and dst % 10 = 0")
    rows = centrality.local_clustering(n, e).collect()
    for net in range(3):
        ids, a = dense(nodes, edges, net)
        a = np.maximum(a, a.T)
        d = a.sum(axis=1)
        held(rows, net, ids, np.diag(a @ a @ a) / np.maximum(d * (d - 1), 1), "clustering")
