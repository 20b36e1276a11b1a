"""Feature attribution: a gradient-boosted surrogate and exact Shapley values of its trees."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tree(node) -> dict:
    """A fitted tree's node as plain values; cover is its number of training rows."""
    stats = node.impurityStats() if hasattr(node, "impurityStats") else None
    out = {"value": node.prediction(), "cover": float(stats.count()) if stats is not None else 1.0}
    if node.getClass().getSimpleName() == "InternalNode":
        out |= {"feature": node.split().featureIndex(), "edge": node.split().threshold(), "left": _tree(node.leftChild()), "right": _tree(node.rightChild())}
        out["cover"] = out["left"]["cover"] + out["right"]["cover"]
    return out


def _used(tree: dict) -> set[int]:
    return {tree["feature"]} | _used(tree["left"]) | _used(tree["right"]) if "feature" in tree else set()


def expectation(tree: dict, x: np.ndarray, known: frozenset[int]) -> float:
    """The tree's mean over the features not known, by the covers of its branches."""
    if "feature" not in tree:
        return tree["value"]
    if tree["feature"] in known:
        return expectation(tree["left" if x[tree["feature"]] <= tree["edge"] else "right"], x, known)
    a, b = tree["left"], tree["right"]
    return (a["cover"] * expectation(a, x, known) + b["cover"] * expectation(b, x, known)) / max(a["cover"] + b["cover"], 1e-12)


def tree_shap(tree: dict, x: np.ndarray) -> dict[int, float]:
    """Exact Shapley values of one tree (all subsets of the features it uses: at most 2^depth-1 of them matter)."""
    used = sorted(_used(tree))
    m = len(used)
    held = {frozenset(s): expectation(tree, x, frozenset(s)) for r in range(m + 1) for s in combinations(used, r)}
    out = {}
    for f in used:
        rest = [u for u in used if u != f]
        out[f] = sum(factorial(r) * factorial(m - r - 1) / factorial(m) * (held[frozenset(s) | {f}] - held[frozenset(s)]) for r in range(m) for s in map(frozenset, combinations(rest, r)))
    return out


def surrogate(frame: DataFrame, features: list[str], target: str, trees: int = 20, depth: int = 3, seed: int = 42):
    """(fitted GBT model, R2 on the last fifth of rows by key): frame has node, the features and the target."""
    v = VectorAssembler(inputCols=features, outputCol="features").transform(frame)
    ranked = v.withColumn("__h", F.percent_rank().over(_order()))
    train, test = ranked.where("__h < 0.8"), ranked.where("__h >= 0.8")
    model = GBTRegressor(labelCol=target, maxIter=trees, maxDepth=depth, seed=seed).fit(train)
    e = model.transform(test).agg((1.0 - F.sum(F.pow(F.col(target) - F.col("prediction"), 2)) / (F.var_pop(target) * F.count("*"))).alias("r2")).first()
    return model, e["r2"]


def _order():
    from pyspark.sql import Window as W

    return W.orderBy("node")


def shap_values(frame: DataFrame, features: list[str], model) -> DataFrame:
    """(node, feature, shap) long table: trees' Shapley values by their weights."""
    trees = [_tree(t._call_java("rootNode")) for t in model.trees]
    weights = list(model.treeWeights)

    def run(batches):
        for pdf in batches:
            rows = []
            for node, x in zip(pdf["node"], pdf[features].to_numpy(), strict=True):
                total = np.zeros(len(features))
                for w, t in zip(weights, trees, strict=True):
                    for f, v in tree_shap(t, x).items():
                        total[f] += w * v
                rows += [(node, f, float(v)) for f, v in zip(features, total, strict=True)]
            yield pd.DataFrame(rows, columns=["node", "feature", "shap"])

    return frame.select("node", *features).mapInPandas(run, "node long, feature string, shap double")
