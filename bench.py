"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import time

from tributary.operators import factorization
from tributary.plans import queries
from tributary.sources import tables
from tributary.session import local_session

HEADLINE = ["cascade_user_stats", "median_gap_days", "alpha_grid", "split_temporal", "warm_test_rows", "adoption_edges", "clustering_coefficient", "jaccard_lph", "lph_scores", "social_weights_boundary_downweight", "two_sided_biases", "bias_rmse_mae_r2", "feature_matrix", "sweep_summary", "pagerank_3_steps"]


#: The published timing of the factorisation: 50 factors, 15 iterations.
FIT = factorization.Options(k=50, iterations=15)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    queries.QUERIES["adoption_counts"](spark, folder).collect()  # warm-up: session and file listing
    took = {}
    for name in HEADLINE:
        spark.catalog.clearCache()
        began = time.time()
        queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    total = round(sum(took.values()), 3)  # the headline queries; the fit is listed beside them
    began = time.time()
    factorization.fit(tables.ratings(spark, folder), FIT).users.write.format("noop").mode("overwrite").save()
    took["cmf_fit_k50_15"] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
