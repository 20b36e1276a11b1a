"""Queries and steps cover their whole tables."""

import pytest

from tributary.operators import graph, homophily
from tributary.plans.pipeline import run
from tributary.plans.queries import ORACLES, QUERIES

from .test_oracles import SMALL as FOLDER, con  # noqa: F401


def test_networks_of_every_rate(spark):
    nets = QUERIES["inferred_edges"](spark, FOLDER).groupBy("model", "net_idx").count().collect()
    grid = {(r["model"], r["net_idx"]) for r in QUERIES["edge_counts_by_alpha"](spark, FOLDER).where("edges > 0").collect()}
    assert {(r["model"], r["net_idx"]) for r in nets} == grid and len(grid) > 3


def test_networks_of_every_rate_in_sql(con):  # noqa: F811
    assert con.execute(f"SELECT count(*), count(*) FILTER (edges > 0) FROM ({ORACLES['edge_counts_by_alpha']})").fetchone()[0] == 300


def test_no_member_is_lost(spark, tmp_path):
    rows = [(i, i, f'{{"k": {7 * (i % 2)}}}', float(i), "click") for i in range(40)]
    spark.createDataFrame(rows, "event_id long, user_id long, props string, value double, event_type string").selectExpr("*", "timestamp_seconds(event_id) as ts").write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES["community_membership"](spark, str(tmp_path)).count() == 40


def test_steps_take_every_rate_and_network_scores(spark, tmp_path):
    r = run(spark, FOLDER, str(tmp_path / "out"), ("cascade", "alpha", "inference", "communities"))
    assert r.get("edge_counts").where("edges > 0").count() == r.get("scores").select("model", "net_idx").distinct().count() > 9
    for model, net_idx in (("exponential", 50), ("rayleigh", 50)):
        one = lambda n: r.get(n).where(f"model = '{model}' and net_idx = {net_idx}")  # noqa: E731,B023
        e, n, m = graph.union_edges(one("edges")), one("nodes").select("node"), one("membership").select("node", "community")
        want = homophily.paper_scores(e, n, m).join(homophily.jaccard_lph(e, n, m), "node").toPandas().sort_values("node")
        got = one("scores").toPandas().sort_values("node")
        for c in ("node", "s", "delta", "lph_score", "lph"):
            assert got[c].tolist() == pytest.approx(want[c].tolist())


def test_search_reaches_the_end(spark, tmp_path):
    rows = [(i, i // 2 + i % 2, f'{{"k": {i // 2}}}', 1.0, "click") for i in range(26)]
    spark.createDataFrame(rows, "event_id long, user_id long, props string, value double, event_type string").selectExpr("*", "timestamp_seconds(event_id) as ts").write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["bfs_distances"](spark, str(tmp_path)).collect()
    assert sorted((r["node"], r["dist"]) for r in got) == [(i, i) for i in range(14)]
