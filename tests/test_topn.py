"""Exact best items against a full score table."""

import numpy as np
import pytest

from tributary.operators import evaluation, factorization, topn
from tributary.plans import queries


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(11)
    items = {i: None if i % 37 == 0 else rng.normal(size=4) * np.exp(rng.normal()) for i in range(300)}
    items[5] = items[4].copy()
    users = {u: None if u == 9 else rng.normal(size=4) for u in range(40)}
    vec = lambda f: None if f is None else [float(x) for x in f]
    ud = spark.createDataFrame([(u, vec(f)) for u, f in users.items()], "user_id long, f array<double>")
    it = spark.createDataFrame([(i, vec(f)) for i, f in items.items()], "id long, f array<double>")
    known = [(u, i) for u in range(40) for i in range(300) if rng.random() < 0.1]
    return users, items, ud.persist(), it.persist(), known, spark.createDataFrame(known, "user_id long, item_id long").persist()


def order(users, items, known, u):
    have = {i for v, i in known if v == u}
    score = lambda i: -np.inf if users[u] is None or items[i] is None else float(users[u] @ items[i])
    return sorted(((score(i), i) for i in items if i not in have), key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("size", [7, 4096])
def test_top_n(spark, world, monkeypatch, size):
    users, items, ud, it, known, kd = world
    monkeypatch.setattr(topn, "BLOCK_ITEMS", size)
    monkeypatch.setattr(topn, "CELL_USERS", 16)
    got = {}
    for r in topn.top_n(ud, it, 5, kd).collect():
        got.setdefault(r["user_id"], []).append((r["rank"], r["item_id"], r["score"]))
    for u in users:
        want = order(users, items, known, u)[:5]
        mine = sorted(got[u])
        assert [x[1] for x in mine] == [i for _, i in want]
        assert all((a is None and b == -np.inf) or a == pytest.approx(b) for (_, _, a), (b, _) in zip(mine, want, strict=True))


def test_blocks_are_skipped(spark, world):
    users, items, ud, it, known, kd = world
    scored = it.where("f is not null")
    stats = {}
    topn.best(topn._asked(ud.where("f is not null"), None), scored, 3, 7, stats).count()
    assert stats["meetings"] < 0.5 * 39 * (290 / 7)


def test_ranking_equals_the_full_table(spark, world, monkeypatch):
    users, items, ud, it, known, kd = world
    monkeypatch.setattr(topn, "BLOCK_ITEMS", 20)
    rng = np.random.default_rng(2)
    test = [(u, int(i), float(rng.integers(1, 6))) for u in range(0, 40, 2) for i in rng.choice(320, 6, replace=False)]
    td = spark.createDataFrame(test, "user_id long, item_id long, rating double")
    full = [(u, i, None if s == -np.inf else s) for u in users for s, i in order(users, items, known, u)]
    scored = spark.createDataFrame(full, "user_id long, item_id long, score double")
    for threshold in (None, 4.0):
        want = {r["user_id"]: tuple(r)[1:] for r in evaluation.ranking_by_user(scored, td, 5, threshold).collect()}
        got = {r["user_id"]: tuple(r)[1:] for r in topn.ranking_by_user(ud, it, td, kd, 5, threshold).collect()}
        assert set(got) == set(want)
        for u in want:
            assert got[u] == pytest.approx(want[u]), u


def test_candidate_counts(spark, world):
    users, items, ud, it, known, kd = world
    got = {r["user_id"]: r["n"] for r in topn.candidate_counts(ud, it.selectExpr("id as item_id"), kd).collect()}
    assert got == {u: 300 - sum(v == u for v, _ in known) for u in users}


def test_model_top_n(spark):
    rng = np.random.default_rng(4)
    vec = lambda n, size: spark.createDataFrame([(i, [float(x) for x in rng.normal(size=size)]) for i in range(n)], "id long, f array<double>").persist()
    for o in (factorization.Options(k=3, k_user=1, k_item=2), factorization.Options(k=3, user_bias=False, item_bias=False)):
        bias = int(o.user_bias)
        model = factorization.Model(o, 2.5, vec(6, o.k_user + 3 + bias), vec(25, o.k_item + 3 + bias))
        asked = spark.createDataFrame([(0,), (3,), (3,), (99,)], "user_id long")
        left_out = spark.createDataFrame([(1,), (2,)], "item_id long")
        pairs = asked.distinct().join(model.items.selectExpr("id as item_id"), how="cross")
        for inc, exc in ((None, None), (left_out, None), (None, left_out)):
            want = evaluation.top_n(model.predict(pairs).withColumnRenamed("pred", "score"), 4, inc, exc).collect()
            got = model.top_n(asked, 4, inc, exc).collect()
            key = lambda rows: {(r["user_id"], r["rank"]): r["item_id"] for r in rows}
            assert key(got) == key(want)
            scores = {(r["user_id"], r["item_id"]): r["score"] for r in want}
            assert all((r["score"] is None) == (scores[r["user_id"], r["item_id"]] is None) and (r["score"] is None or r["score"] == pytest.approx(scores[r["user_id"], r["item_id"]])) for r in got)
    with pytest.raises(ValueError):
        model.top_n(asked, 1, left_out, left_out)


def test_nothing_to_rank(spark, world):
    _, _, ud, it, _, kd = world
    assert topn.top_n(ud.where("false"), it, 3).count() == 0
    assert topn.top_n(ud, it.where("false"), 3).count() == 0


def test_one_order_for_all_users_equals_the_full_table(spark, world, monkeypatch):
    _, _, _, _, known, kd = world
    score = {i: None if i % 37 == 0 else float(i * 7 % 50) for i in range(300)}
    scores = spark.createDataFrame(list(score.items()), "item_id long, score double").repartition(5)
    kd = kd.union(kd.where("user_id < 3")).union(spark.createDataFrame([(38, i) for i in range(300)] + [(0, 999)], kd.schema))
    asked = spark.createDataFrame([(u,) for u in range(41)], "user_id long")
    have = {tuple(r) for r in kd.collect()}
    full = [(u, i, s) for u in range(41) for i, s in score.items() if (u, i) not in have]
    scored = spark.createDataFrame(full, "user_id long, item_id long, score double")
    want = {tuple(r) for r in evaluation.top_n(scored, 5).collect()}
    for most in (topn.FIRST_PLACES, 3):
        monkeypatch.setattr(topn, "FIRST_PLACES", most)
        assert {tuple(r) for r in topn.top_n_by_order(asked, scores, 5, kd).collect()} == want
    assert topn.top_n_by_order(asked, scores, 5).where("rank = 5").count() == 41
    rng = np.random.default_rng(3)
    test = [(u, int(i), float(rng.integers(1, 6))) for u in range(0, 41, 2) for i in rng.choice(320, 6, replace=False)]
    td = spark.createDataFrame(test + test[:9], "user_id long, item_id long, rating double")
    for threshold in (None, 4.0):
        want = {r["user_id"]: tuple(r)[1:] for r in evaluation.ranking_by_user(scored, td, 5, threshold).collect()}
        got = {r["user_id"]: tuple(r)[1:] for r in topn.ranking_by_order(scores, td, kd, 5, threshold).collect()}
        assert set(got) == set(want)
        assert all(got[u] == pytest.approx(want[u]) for u in want)


def test_counting_candidates_fits_no_biases(spark, monkeypatch):
    monkeypatch.setattr(queries.biases, "two_sided", None)
    assert queries.QUERIES["candidate_counts"](spark, "/root/testdata/sf0.001").count() > 0
