"""Hand-made graphs and cascades, and numeric properties of the models."""

import math
import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from tributary.operators import alpha, attribution, biases, cascades, centrality, communities, evaluation, factorization, features, graph, homophily, inference, search, split
from tributary.sources import files


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def path3(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    und = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    member = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, 1)], "node long, community long")
    return nodes, und, member


def test_symmetrise(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (3, 3)], "src long, dst long")
    assert rows(graph.union_edges(e), "u", "v") == [(1, 2), (1, 3)]
    assert rows(graph.mutual_edges(e), "u", "v") == [(1, 2)]


def test_cascades(spark):
    day = lambda d: pd.Timestamp("2024-01-01") + pd.Timedelta(days=d)
    a = spark.createDataFrame(pd.DataFrame([(1, 10, day(0)), (2, 10, day(1)), (3, 10, day(4)), (2, 11, day(0)), (1, 11, day(2)), (3, 12, day(5))], columns=["user_id", "item_id", "ts"]))
    c = cascades.cascades(a)
    assert rows(c, "item_id", "user_id", "pos") == [(10, 1, 1), (10, 2, 2), (10, 3, 3), (11, 1, 2), (11, 2, 1)]
    m = cascades.median_gap(c)
    assert m.first()["median_gap"] == 2.0
    centers = {r["model"]: r["center"] for r in alpha.centers(m).collect()}
    assert centers["exponential"] == pytest.approx(math.log(2) / 2) and centers["rayleigh"] == pytest.approx(2 * math.log(2) / 4) and centers["powerlaw"] is None
    g = alpha.grid(alpha.centers(m)).toPandas()
    assert g.groupby("model").size().tolist() == [100, 100, 100]
    stats = cascades.user_stats(c, a.select("user_id"), least=2)
    assert rows(stats, "user_id", "mean_cascade_position", "cascade_breadth")[0] == (1, 1.5, 2)


def test_homophily_on_a_path(path3):
    nodes, und, member = path3
    assert rows(homophily.jaccard_lph(und, nodes, member), "node", "lph") == [(1, 0.5), (2, 0.5), (3, 0.5)]
    s = homophily.paper_scores(und, nodes, member)
    assert [(n, a, d) for n, a, d, _ in rows(s, "node", "s", "delta", "lph_score")] == [(1, 1, 1.0), (2, 2, 1.0), (3, 1, 1.0)]
    assert all(x == pytest.approx(-1 / 3) for (x,) in rows(s, "lph_score"))


def test_boundary_and_weights(spark):
    s = spark.createDataFrame([(i, float(i)) for i in range(5)], "node long, lph_score double")
    assert rows(homophily.boundary_flags(s), "node", "is_boundary")[:2] == [(0, 1), (1, 0)]
    sets = spark.createDataFrame([(1, [0]), (2, [0, 1])], "node long, communities array<long>")
    b = spark.createDataFrame([(1, 0.2), (2, 0.6)], "node long, intensity double")
    e = spark.createDataFrame([(1, 2)], "src long, dst long")
    raw = {m: f for m, f in homophily.MODES.items()}
    assert set(raw) == {"uniform", "community_jaccard", "boundary_downweight", "bridge_preserve"}
    for mode in raw:
        assert rows(homophily.social_edges(e, sets, b, mode), "u", "v", "weight") == [(1, 2, pytest.approx(1.0))]


def test_ranking(spark):
    scored = spark.createDataFrame([(1, i, s) for i, s in ((1, 4.0), (2, 3.0), (3, 2.0), (4, 1.0))], "user_id long, item_id long, score double")
    test = spark.createDataFrame([(1, 2, 5.0), (1, 4, 5.0)], "user_id long, item_id long, rating double")
    r = evaluation.ranking_metrics(scored, test, k=3).first()
    assert r["precision_at_k"] == pytest.approx(1 / 3) and r["recall_at_k"] == 0.5 and r["mrr"] == 0.5
    assert r["ndcg_at_k"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    with pytest.raises(ValueError):
        evaluation.top_n(scored, 1, scored, scored)


def test_scalers(spark):
    f = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 5.0)], "node long, x double")
    fit = spark.createDataFrame([(1,), (2,)], "node long")
    assert [v for _, v in rows(features.standard(f, ["x"], fit), "node", "x")] == [-1, 1, 3]
    assert [v for _, v in rows(features.min_max(f, ["x"], fit), "node", "x")] == [0, 1, 2]


def test_split_is_a_partition(spark):
    r = spark.createDataFrame([(i, i % 7, float(i), datetime(2024, 1, 1 + i % 9)) for i in range(101)], "user_id long, item_id long, rating double, ts timestamp")
    t = split.temporal(r).toPandas()
    assert (t.fold == "train").sum() == 80 and t[t.fold == "train"].ts.max() <= t[t.fold == "test"].ts.min()
    assert split.random(r).where("fold = 'train'").count() == 80


def test_dense_ids(spark):
    ids = spark.createDataFrame([(x * x % 991,) for x in range(500)], "id long")
    got = graph.dense_ids(ids).toPandas().sort_values("id")
    assert got.code.tolist() == list(range(len(got)))


def test_inference_is_the_global_greedy(spark):
    rng = random.Random(3)
    c = [(i, p + 1, u, t) for i in range(6) for p, (u, t) in enumerate(sorted(((u, rng.random() * 5) for u in rng.sample(range(7), 5)), key=lambda x: x[1]))]
    cas = spark.createDataFrame(c, "item_id long, pos int, user_id long, t_days double")
    grid = spark.createDataFrame([("exponential", 0, 0.7)], "model string, net_idx int, alpha double")
    got = {(r["src"], r["dst"]) for r in inference.infer(cas, grid, 8).collect()}
    w = {}
    for i, _, u, t in c:
        for j, _, v, s in c:
            if i == j and t < s:
                w[i, u, v] = max(0.0, math.log(0.7) - 0.7 * (s - t) - math.log(1e-8))
    chosen, have = set(), {}
    for _ in range(8):
        gain = {}
        for (i, u, v), x in w.items():
            if (u, v) not in chosen:
                gain[u, v] = gain.get((u, v), 0) + max(0.0, x - have.get((i, v), 0.0))
        best = min(gain, key=lambda e: (-gain[e], e))
        chosen.add(best)
        for (i, u, v), x in w.items():
            if (u, v) == best:
                have[i, v] = max(have.get((i, v), 0.0), x)
    assert got == chosen


def test_centrality(spark):
    nodes = spark.createDataFrame([("m", 0, i) for i in (1, 2, 3, 4)], "model string, net_idx int, node long")
    edges = spark.createDataFrame([("m", 0, 1, 2), ("m", 0, 2, 3), ("m", 0, 3, 4)], "model string, net_idx int, src long, dst long")
    p = centrality.path_metrics(nodes, edges).toPandas().sort_values("node")
    assert p.betweenness.tolist() == [0, 2, 2, 0] and p.eccentricity.tolist() == [3, 2, 2, 3]
    assert centrality.pagerank(nodes, edges, steps=5).toPandas().pagerank.sum() == pytest.approx(1.0)
    two = nodes.where("node <= 2")
    beta = two.selectExpr("model", "net_idx", "node", "0.075D as beta")
    x = rows(centrality.pagerank_beta(two, edges.where("src = 1"), beta), "node", "pagerank_lph")
    assert x[0][1] == pytest.approx(0.649123, abs=1e-6) and x[1][1] == pytest.approx(0.350877, abs=1e-6)
    h = centrality.hits(nodes, edges).toPandas()
    assert (h.hub_score**2).sum() == pytest.approx(1.0)


def test_communities_share_a_node():
    near = {}
    for clique in ((1, 2, 3, 4), (4, 5, 6, 7)):
        for a in clique:
            near.setdefault(a, set()).update(set(clique) - {a})
    found = communities.ego_communities(near)
    assert {1, 2, 3, 4} in found and {4, 5, 6, 7} in found
    assert communities.speaker_listener(near)


def _ratings(spark, n=12, m=9, k=2, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(n, k)), rng.normal(size=(m, k))
    x = [(u, i, float(3 + a[u] @ b[i])) for u in range(n) for i in range(m) if rng.random() < 0.7]
    return spark.createDataFrame(x, "user_id long, item_id long, rating double").persist()


def test_half_step_is_the_optimum(spark):
    r = _ratings(spark)
    o = factorization.Options(k=2, lam=0.5, iterations=2)
    m = factorization.fit(r, o)
    base = factorization.objective(m, r)
    users = m.users.toPandas()
    for j in range(3):
        for eps in (-1e-3, 1e-3):
            moved = users.copy()
            moved["f"] = [np.array(f) + (np.arange(3) == j) * eps for f in moved["f"]]
            other = m.with_users(spark.createDataFrame([(int(i), [float(v) for v in f]) for i, f in moved[["id", "f"]].values], "id long, f array<double>"))
            assert factorization.objective(other, r) >= base - 1e-9


def test_factorisation_learns_and_variants_run(spark):
    r = _ratings(spark)
    o = factorization.Options(k=2, lam=0.1, iterations=4)
    m = factorization.fit(r, o)
    assert evaluation.rating_metrics(m.predict(r)).first()["rmse"] < 0.5
    uf = spark.createDataFrame([(u, float(u % 3), 1.0) for u in range(14)], "user_id long, a double, b double")
    side = factorization.fit(r, factorization.Options(k=2, lam=0.1, iterations=2), user_features=uf)
    assert side.users.count() == 14
    cold = side.factors_cold(uf.where("user_id >= 12"))
    assert cold.count() == 2
    implicit = factorization.fit(r.selectExpr("user_id", "item_id", "abs(rating) as rating"), factorization.Options(k=2, lam=0.1, iterations=2, implicit=True, user_bias=False, item_bias=False))
    assert implicit.top_n(r.limit(1), 3).count() == 3
    social = spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0)], "u long, v long, weight double")
    tied = factorization.fit(r, factorization.Options(k=2, lam=0.1, iterations=2, lam_social=50.0), social=social)
    f = {x["id"]: np.array(x["f"])[:2] for x in tied.users.collect()}
    g = {x["id"]: np.array(x["f"])[:2] for x in m.users.collect()}
    assert np.linalg.norm(f[0] - f[1]) < np.linalg.norm(g[0] - g[1]) + 1e-9
    model, c, d = factorization.fit_offsets(r, uf, None, factorization.Options(k=2, lam=0.1, iterations=1))
    assert c.shape == (2, 2) and d is None
    nn = factorization.fit(r, factorization.Options(k=2, lam=0.1, iterations=1, nonneg=True, user_bias=False, item_bias=False))
    assert min(min(x["f"]) for x in nn.users.collect()) >= 0


def test_biases(spark):
    r = spark.createDataFrame([(1, 7, 3.0), (2, 7, 5.0)], "user_id long, item_id long, rating double")
    assert rows(biases.one_sided(r, "item_id", 3.0, 2.0), "item_id", "bias") == [(7, 0.5)]


def test_search_and_shap():
    out = search.search(lambda p: (p["lam"] - 1.0) ** 2, {"lam": search.Space(0.01, 10, log=True)}, trials=30)
    assert abs(out["best_params"]["lam"] - 1.0) < 0.5 and len(out["all_results"]) == 30
    tree = {"feature": 0, "edge": 0.5, "cover": 4, "left": {"value": 0.0, "cover": 2}, "right": {"feature": 1, "edge": 0.5, "cover": 2, "left": {"value": 1.0, "cover": 1}, "right": {"value": 3.0, "cover": 1}}}
    x = np.array([1.0, 1.0])
    assert sum(attribution.tree_shap(tree, x).values()) == pytest.approx(3.0 - 1.0)


def test_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" 1.0e+00  2.0e+00\n1 2\n3 1\n")
    assert rows(files.load_trust(spark, str(tmp_path / "t.txt")), "src", "dst") == [(1, 2), (3, 1)]
    (tmp_path / "inferred-network-expo-007.txt").write_text("1,1\n2,2\n\n1,2\n1,2\n1,9\n")
    nodes, edges = files.read_networks(spark, str(tmp_path / "inferred-network-expo-007.txt"))
    assert rows(edges, "model", "net_idx", "src", "dst") == [("expo", 7, 1, 2)] and nodes.count() == 2
    c = spark.createDataFrame([(5, 1, 1, 0.5), (5, 2, 2, 1.5), (6, 1, 3, 1.0)], "item_id long, pos int, user_id long, t_days double")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    files.write_cascades(c, users, str(tmp_path / "c"))
    u, back = files.read_cascades(spark, str(tmp_path / "c"))
    assert u.count() == 3 and rows(back, "pos", "user_id", "t_days") == [(1, 1, 0.5), (2, 2, 1.5)]
    with pytest.raises(ValueError):
        files.load_dataset(spark, "nope")
