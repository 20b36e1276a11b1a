"""The eight analysis steps over one folder, each a function of what came before; results are keyed tables.

    python -m tributary.plans.pipeline FOLDER OUT --steps cascade alpha inference communities centrality recommend search shap
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alpha, attribution, cascades, centrality, communities, factorization, features, homophily, inference, search, split
from ..sources import files, tables

STEPS = ("cascade", "alpha", "inference", "communities", "centrality", "recommend", "search", "shap")


class Run:
    """Tables under ``out``: a step writes its own and reads its predecessors'."""

    def __init__(self, spark: SparkSession, folder: str, out: str, picks: tuple[int, ...] | None = None, degree: float = 2.0):
        self.spark, self.folder, self.out, self.picks, self.degree = spark, folder, out.rstrip("/"), picks, degree

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.out}/{name}")
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/{name}")

    def cascade(self) -> None:
        folds = self.put(split.temporal(tables.adoptions(self.spark, self.folder)), "folds")
        c = self.put(cascades.cascades(folds.where("fold = 'train'")), "cascades")
        users = folds.select("user_id").distinct()
        self.put(users.withColumnRenamed("user_id", "node"), "users")
        self.put(cascades.user_stats(c, users), "user_stats")

    def alpha(self) -> None:
        self.put(alpha.grid(alpha.centers(cascades.median_gap(self.get("cascades")))), "grid")

    def inference(self) -> None:
        """Networks of every rate, or of the rates in ``picks``, in one job."""
        grid = self.get("grid")
        if self.picks is not None:
            grid = grid.where(F.col("net_idx").isin(*self.picks))
        budget = alpha.edge_budget(self.get("users"), self.degree).first()["budget"]
        edges = self.put(inference.infer(self.get("cascades"), grid, budget), "edges")
        self.put(inference.edge_counts(grid, edges), "edge_counts")
        nets = edges.select("model", "net_idx").distinct()
        self.put(nets.join(self.get("users"), how="cross"), "nodes")  # users times networks: the node tables themselves

    def communities(self, algorithm: str = "demon", symmetrise: str = "union") -> None:
        nodes, edges = self.get("nodes"), self.get("edges")
        und = edges.select("model", "net_idx", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
        member = self.put(communities.detect(nodes, und, algorithm), "membership")
        if symmetrise == "intersection":
            both = edges.where("src <> dst").select("model", "net_idx", "src", "dst").distinct()
            und = both.select("model", "net_idx", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).groupBy("model", "net_idx", "u", "v").count().where("count = 2").drop("count")
        elif symmetrise != "union":
            raise KeyError(symmetrise)
        lists = communities.membership_lists(nodes, member)
        self.put(homophily.network_scores(und, nodes, member).join(lists, ["model", "net_idx", "node"], "left"), "scores")

    def centrality(self) -> None:
        self.put(centrality.bundle(self.get("nodes"), self.get("edges"), centrality.softmax_beta(self.get("scores"))), "centrality")

    def _features(self, model: str, net_idx: int) -> DataFrame:
        key = (F.col("model") == model) & (F.col("net_idx") == net_idx)
        c = self.get("centrality").where(key).drop("model", "net_idx")
        s = self.get("scores").where(key).select("node", "lph", "lph_score", "is_boundary", "num_communities")
        stats = self.get("user_stats").withColumnRenamed("user_id", "node")
        return features.assemble(c, s, stats).withColumnRenamed("node", "user_id")

    def recommend(self) -> None:
        rows = []
        ratings = self.get("folds").drop("fold")
        for r in self.get("edges").select("model", "net_idx").distinct().collect():
            got = search.sweep([{"model": r["model"], "net_idx": r["net_idx"]}], lambda x: search.paired(ratings, self._features(x["model"], x["net_idx"]), factorization.Options(k=8, iterations=3)))
            rows += got
        names = ("rmse", "mae", "r2", "baseline_rmse", "improvement_pct")
        table = self.spark.createDataFrame([(r["model"], r["net_idx"], *(r.get(n) for n in names), r["status"]) for r in rows], "model string, net_idx int, " + ", ".join(f"{n} double" for n in names) + ", status string")
        self.put(table, "results")

    def search(self, trials: int = 4) -> None:
        folds = self.get("folds").persist()
        train, test = folds.where("fold = 'train'"), folds.where("fold = 'test'")
        out = search.search(lambda p: search.evaluate(train, test, factorization.Options(k=p["k"], lam=p["lam"], iterations=3))[1]["rmse"], search.BASELINE, trials=trials, warm_up=2)
        done = [(t["trial"], t["params"]["k"], t["params"]["lam"], t["value"]) for t in out["all_results"]]
        files.write_json(self.spark.createDataFrame(done, "trial int, k int, lam double, rmse double"), f"{self.out}/search")

    def shap(self) -> None:
        folds = self.get("folds")
        first = self.get("edges").select("model", "net_idx").distinct().orderBy("model", "net_idx").first()
        f = self._features(first["model"], first["net_idx"])
        cols = [c for c in f.columns if c != "user_id"]
        model = factorization.fit(folds.where("fold = 'train'"), factorization.Options(k=8, iterations=3))
        mean = model.predict(folds.select("user_id", "item_id")).groupBy("user_id").agg(F.avg("pred").alias("target"))
        frame = f.join(mean, "user_id").withColumnRenamed("user_id", "node").persist()
        gbt, r2 = attribution.surrogate(frame, cols, "target", trees=10)
        values = attribution.shap_values(frame, cols, gbt).withColumn("model", F.lit(first["model"])).withColumn("net_idx", F.lit(first["net_idx"])).withColumn("surrogate_r2", F.lit(r2))
        self.put(values, "shap")


def run(spark: SparkSession, folder: str, out: str, steps: tuple[str, ...] = STEPS) -> Run:
    r = Run(spark, folder, out)
    for step in STEPS:
        if step in steps:
            getattr(r, step)()
    return r


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("folder")
    p.add_argument("out")
    p.add_argument("--steps", nargs="+", choices=STEPS, default=list(STEPS))
    a = p.parse_args()
    run(SparkSession.builder.appName("tributary").getOrCreate(), a.folder, a.out, tuple(a.steps))


if __name__ == "__main__":
    main()
