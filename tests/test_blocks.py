"""Block ALS against dense solves of the same systems."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import biases, blocks, factorization
from tributary.operators.factorization import Options


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    cells = [(u, i, float(rng.normal(3, 1)), float(rng.uniform(0.5, 2))) for u in range(12) for i in range(9) if rng.random() < 0.6 or u == 0]
    return cells, spark.createDataFrame(cells, "user_id long, item_id long, rating double, w double").persist()


def dense(cells, other, o, mean, n_other):
    """The users' factors by one dense system each, from the full matrix where empty cells count."""
    size = o.k + 1
    out = {}
    for u in sorted({c[0] for c in cells}):
        gram, rhs, n = np.zeros((size, size)), np.zeros(size), 0
        seen = {i: (x, w) for v, i, x, w in cells if v == u}
        for i in range(n_other):
            f, b = np.r_[other[i][: o.k], 1.0], other[i][-1]
            if o.missing_as_zero or i in seen:
                x, w = seen.get(i, (0.0, 1.0))
                gram += w * np.outer(f, f)
                rhs += w * (x - mean - b) * f
                n += 1
        out[u] = np.linalg.solve(gram + o.lam * (n if o.scale_lam else 1.0) * np.eye(size), rhs)
    return out


@pytest.mark.parametrize("rows", [None, 4])
@pytest.mark.parametrize("zero", [False, True])
@pytest.mark.parametrize("scale", [False, True])
def test_half_step_equals_the_dense_solve(spark, data, monkeypatch, rows, zero, scale):
    cells, ratings = data
    monkeypatch.setattr(blocks, "BLOCK_ROWS", rows or 250_000)
    o = Options(k=3, lam=0.7, weight_col="w", missing_as_zero=zero, scale_lam=scale)
    rng = np.random.default_rng(5)
    other = {i: rng.normal(size=4) for i in range(9)}
    items = spark.createDataFrame([(i, [float(x) for x in f]) for i, f in other.items()], "id long, f array<double>")
    mean = 0.0 if zero else 2.5
    dealt = blocks.deal(ratings, "user_id", "item_id", "w")
    assert (dealt.hot is None) == (rows is None)
    got = {r["id"]: r["f"] for r in factorization._update(o, dealt, items, mean, None, None).collect()}
    want = dense(cells, other, o, mean, 9)
    assert set(got) == set(want)
    assert max(np.abs(np.array(got[u]) - want[u]).max() for u in want) < 1e-9
    dealt.drop()


def test_ratings_are_not_shuffled_again(spark, data):
    dealt = blocks.deal(data[1], "user_id", "item_id")
    items = spark.createDataFrame([(i, [0.1, 0.2]) for i in range(9)], "id long, f array<double>")
    out = blocks.half_step(dealt, items, blocks.Side(2), np.ones(2), np.zeros((2, 2)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("FlatMapCoGroupsInArrow") :].split("Exchange")[0]
    assert "bucket" in left.lower() or "FileScan" in left, plan
    assert out.count() == 12
    dealt.drop()


def test_extras_reach_every_entity(spark, data, monkeypatch):
    cells, ratings = data
    o = Options(k=2, lam=0.5)
    items = spark.createDataFrame([(i, [0.1 * i, 0.3, 0.2]) for i in range(9)], "id long, f array<double>")
    rows = spark.createDataFrame([(u, 2.0, 0.25, [1.0, -1.0, 0.0]) for u in (0, 3, 77)] + [(0, 1.0, 0.0, [0.0, 1.0, 0.0])], factorization.ROW)
    extras = factorization.extras_of(rows)
    assert {r["id"]: r["f"] for r in extras.collect()} == {0: [2.0, -1.0, 0.0, 0.25], 3: [2.0, -2.0, 0.0, 0.25], 77: [2.0, -2.0, 0.0, 0.25]}
    found = []
    for size in (250_000, 4):
        monkeypatch.setattr(blocks, "BLOCK_ROWS", size)
        dealt = blocks.deal(ratings, "user_id", "item_id")
        side = factorization._side(o, 1.0)
        found.append({r["id"]: r["f"] for r in blocks.half_step(dealt, items, side, np.full(3, o.lam), np.zeros((3, 3)), None, extras).collect()})
        dealt.drop()
    assert set(found[0]) == set(range(12)) | {77}
    assert all(np.allclose(found[0][u], found[1][u], atol=1e-10) for u in found[0])
    assert np.allclose(found[0][77], np.array([2.0, -2.0, 0.0]) / 0.75)


def test_nothing_to_deal(spark):
    none = spark.createDataFrame([], "user_id long, item_id long, rating double")
    model = factorization.fit(none, Options(k=2, iterations=1, center=False))
    assert model.users.count() == 0 and model.items.count() == 0


def test_implicit_features_have_factors_of_their_own(spark, data):
    """Both pairs are minimisers of 1/2 sum w (x - m - b_u - b_i - a.b)^2 + w'/2 (|S - A Bi'|^2 + |S' - B Ai'|^2) + lam/2 (all squares)."""
    cells, ratings = data
    o = Options(k=3, lam=0.7, weight_col="w", implicit_features=True, w_implicit=0.6)
    rng = np.random.default_rng(8)
    table = lambda rows: spark.createDataFrame([(i, [float(x) for x in f]) for i, f in rows.items()], "id long, f array<double>")
    users, items = {u: rng.normal(size=4) for u in range(12)}, {i: rng.normal(size=4) for i in range(9)}
    by_user, by_item = blocks.deal(ratings, "user_id", "item_id", "w"), blocks.deal(ratings, "item_id", "user_id", "w")
    a = np.array([users[u][:3] for u in range(12)])
    s = np.zeros((12, 9))
    for u, i, _, _ in cells:
        s[u, i] = 1
    seen = factorization.seen_factors(o, by_item, table(users))
    bi = np.zeros((9, 3))
    for r in seen.collect():
        bi[r["id"]] = r["f"]
    want = np.linalg.solve(o.w_implicit * a.T @ a + o.lam * np.eye(3), o.w_implicit * a.T @ s).T
    assert np.abs(bi - want).max() < 1e-9
    got = {r["id"]: np.array(r["f"]) for r in factorization._update(o, by_user, table(items), 2.5, None, None, seen=seen).collect()}
    for u, f in got.items():
        gram, rhs = o.lam * np.eye(4), np.zeros(4)
        gram[:3, :3] += o.w_implicit * bi.T @ bi
        rhs[:3] += o.w_implicit * s[u] @ bi
        for v, i, x, w in cells:
            if v == u:
                g = np.r_[items[i][:3], 1.0]
                gram += w * np.outer(g, g)
                rhs += w * (x - 2.5 - items[i][3]) * g
        assert np.abs(np.linalg.solve(gram, rhs) - f).max() < 1e-9
    by_user.drop()
    by_item.drop()
    model = factorization.fit(ratings, Options(k=2, lam=0.5, iterations=2, implicit_features=True))
    warm = {r["id"]: r["f"] for r in model.factors_warm(ratings).collect()}
    assert all(np.allclose(r["f"], warm[r["id"]], atol=1e-9) for r in model.users.collect())


def test_near_ids_share_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 200)
    ratings = spark.range(10 * 20 * 10).selectExpr("id div 200 * 1000 + id % 20 as user_id", "id div 200 * 1000 + id div 20 % 10 as item_id", "double(id % 5) as rating")
    dealt = blocks.deal(ratings, "user_id", "item_id")
    assert dealt.routes.select("block").distinct().count() >= 8
    assert dealt.routes.count() <= 3 * 10 * 10  # by a hash of the user, an item would be in nearly all blocks
    dealt.drop()


def test_biases_equal_plain_passes(spark, data, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 4)
    cells = data[0]
    bu, bi = {}, {}
    for _ in range(3):
        for mine, other, at in ((bi, bu, 1), (bu, bi, 0)):
            for k in {c[at] for c in cells}:
                rows = [c for c in cells if c[at] == k]
                mine[k] = sum(c[2] - 2.5 - other.get(c[1 - at], 0.0) for c in rows) / (len(rows) + 10.0)
    users, items = biases.two_sided(data[1], 2.5, passes=3)
    assert {r[0]: r[1] for r in users.collect()} == pytest.approx(bu)
    assert {r[0]: r[1] for r in items.collect()} == pytest.approx(bi)


def test_features_are_computed_once(spark, data):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda u: seen.add(1) or float(u), "double").asNondeterministic()
    features = spark.range(12).select(F.col("id").alias("user_id"), count("id").alias("x"))
    factorization.fit(data[1], Options(k=2, iterations=2), user_features=features).users.count()
    assert seen.value == 12


def test_factors_that_were_replaced_are_dropped(spark):
    from pathlib import Path

    from tributary.functions.lineage import shared_folder
    from tributary.operators import factorization

    rows = spark.createDataFrame([(u, i, float(u * i % 5)) for u in range(12) for i in range(9) if (u + i) % 3], "user_id long, item_id long, rating double")
    root = Path(shared_folder(spark).removeprefix("file:"))
    before = set(root.iterdir())
    model = factorization.fit(rows, factorization.Options(k=2, iterations=3))
    assert [model.users.count(), model.items.count()] == [12, 9]
    new = [p.name.split("-")[0] for p in set(root.iterdir()) - before]
    assert new.count("tables") == 2 and sum(p.name.startswith("rdd") for p in set(root.iterdir()) - before) <= 2  # users and items; at most both lists of entities dealt over salts


def test_side_information_reads_the_folds_once(spark, monkeypatch):
    from tributary.plans import queries

    calls, real = [], queries._folds
    monkeypatch.setattr(queries, "_folds", lambda s, d: calls.append(d) or real(s, d))
    queries.QUERIES["cmf_side_info_metrics"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
