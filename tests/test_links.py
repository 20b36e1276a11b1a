"""Sums along packed links are as the links say."""

import numpy as np

from tributary.operators.links import Links


def test_links_are_summed(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.random(300), strict=True)]
    links = Links(spark.createDataFrame(rows, "a long, b long, w double"))
    state = {k: float(k) for k in range(0, 40, 2)}
    out = links.passed(spark.createDataFrame(list(state.items()), "id long, x double"))
    want = {b: sum(w * state.get(a, 0.0) for a, c, w in rows if c == b) for b in {b for _, b, _ in rows}}
    got = {r["id"]: r["x"] for r in out.collect()}
    assert all(abs(got.get(b, 0.0) - x) < 1e-9 for b, x in want.items())
    links.drop()
