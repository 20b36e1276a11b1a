"""Parameter search and evaluation of recommenders: seeded samplers on the driver, fits and metrics on the cluster."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from . import evaluation, features, split
from .factorization import Model, Options, fit


@dataclass(frozen=True)
class Space:
    """A parameter's range; ``log`` draws its logarithm, ``whole`` rounds."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def draw(self, u: float) -> float:
        x = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low))) if self.log else self.low + u * (self.high - self.low)
        return int(round(x)) if self.whole else x

    def place(self, x: float) -> float:
        return (math.log(x) - math.log(self.low)) / (math.log(self.high) - math.log(self.low)) if self.log else (x - self.low) / (self.high - self.low)


BASELINE = {"k": Space(5, 50, whole=True), "lam": Space(0.01, 10.0, log=True)}
ENHANCED = BASELINE | {"w_main": Space(0.1, 1.0), "w_user": Space(0.01, 1.0, log=True)}
SOCIAL = ENHANCED | {"lam_social": Space(1e-4, 1.0, log=True), "beta": Space(0.0, 1.0), "gamma": Space(0.1, 5.0)}


class Pruned(Exception):
    """A trial without a usable result."""


def search(score: Callable[[dict], float], space: dict[str, Space], trials: int = 50, seed: int = 42, warm_up: int = 10, share: float = 0.25, candidates: int = 24) -> dict:
    """Minimise ``score``: random trials first, then draws near the best quarter, chosen by the ratio of the two densities
    (a small tree-structured Parzen estimator).  Seeded; pruned and non-finite trials are recorded without a value."""
    rng = random.Random(seed)
    done: list[dict] = []
    for t in range(trials):
        good = sorted((d for d in done if d["value"] is not None), key=lambda d: d["value"])
        if len(good) < warm_up:
            params = {n: s.draw(rng.random()) for n, s in space.items()}
        else:
            cut = max(2, int(share * len(good)))
            params = {}
            for n, s in space.items():
                best, rest = ([s.place(d["params"][n]) for d in part] for part in (good[:cut], good[cut:]))
                density = lambda x, pts: sum(math.exp(-(((x - p) / 0.1) ** 2) / 2) for p in pts) / len(pts) + 1e-6
                draws = [min(max(rng.gauss(rng.choice(best), 0.1), 0.0), 1.0) for _ in range(candidates)]
                params[n] = s.draw(max(draws, key=lambda x: density(x, best) / density(x, rest or [0.5])))
        try:
            value = score(params)
            value = value if value is not None and math.isfinite(value) else None
        except Pruned:
            value = None
        done.append({"trial": t, "params": params, "value": value})
    ok = [d for d in done if d["value"] is not None]
    best = min(ok, key=lambda d: d["value"]) if ok else None
    return {"best_params": best["params"] if best else None, "best_value": best["value"] if best else None, "all_results": done}


def grid(score: Callable[[dict], float], values: dict[str, list]) -> dict:
    """Every combination of the values."""
    combos: list[dict] = [{}]
    for name, options in values.items():
        combos = [c | {name: o} for c in combos for o in options]
    done = [{"trial": t, "params": c, "value": score(c)} for t, c in enumerate(combos)]
    ok = [d for d in done if d["value"] is not None and math.isfinite(d["value"])]
    return {"best_params": min(ok, key=lambda d: d["value"])["params"] if ok else None, "all_results": done}


def evaluate(train: DataFrame, test: DataFrame, options: Options, **sides) -> tuple[Model, dict]:
    """(model, rmse/mae/r2 on test)."""
    model = fit(train, options, **sides)
    return model, evaluation.rating_metrics(model.predict(test.select("user_id", "item_id", "rating"))).first().asDict()


def cross_validate(ratings: DataFrame, options: Options, splits: int = 5, test: float = 0.2, **sides) -> dict:
    """Mean metrics over repeated random splits, the seed being the split's number."""
    rows = []
    for s in range(splits):
        folds = split.random(ratings, test, seed=s)
        rows.append(evaluate(folds.where("fold = 'train'"), folds.where("fold = 'test'"), replace(options, seed=s), **sides)[1])
    return {m: sum(r[m] for r in rows) / len(rows) for m in ("rmse", "mae", "r2")}


def paired(ratings: DataFrame, user_features: DataFrame, options: Options, splits: int = 1, test: float = 0.2, scaler: str = "standard") -> dict:
    """The model with user features against the one without, on the same folds and the same users (those with features).

    Features are scaled by statistics of the training users.  Without a common user the trial is pruned.
    """
    mine = ratings.join(user_features.select("user_id").distinct(), "user_id", "left_semi")
    if mine.isEmpty():
        raise Pruned("no user has features")
    cols = [c for c in user_features.columns if c != "user_id"]
    out = []
    for s in range(splits):
        folds = split.random(mine, test, seed=s)
        train, held = folds.where("fold = 'train'"), split.warm(folds.where("fold = 'train'"), folds.where("fold = 'test'"))
        scaled = features.SCALERS[scaler](user_features, cols, train, "user_id")
        _, with_features = evaluate(train, held, options, user_features=scaled)
        _, without = evaluate(train, held, options)
        out.append((with_features, without))
    mean = lambda i, m: sum(r[i][m] for r in out) / len(out)
    return {"rmse": mean(0, "rmse"), "mae": mean(0, "mae"), "r2": mean(0, "r2"), "baseline_rmse": mean(1, "rmse"), "improvement_pct": (mean(1, "rmse") - mean(0, "rmse")) / mean(1, "rmse") * 100.0}


def social_comparison(train: DataFrame, test: DataFrame, social: DataFrame, options: Options, **sides) -> dict:
    """Metrics with and without the social term, their differences, and whether both are sane for the rating scale."""
    width = evaluation.span(train).first()["span"] or 0.0
    _, off = evaluate(train, test, replace(options, lam_social=0.0), **sides)
    _, on = evaluate(train, test, options, social=social, **sides)
    sane = lambda m: all(m[x] is not None and math.isfinite(m[x]) for x in ("rmse", "mae")) and m["rmse"] <= max(10.0, 10.0 * width)
    return {"off": off, "on": on, "delta": {m: on[m] - off[m] for m in ("rmse", "mae", "r2")}, "off_sane": sane(off), "on_sane": sane(on)}


def retry(run: Callable[[int], dict], sane: Callable[[dict], bool], seed: int = 42, attempts: int = 5) -> dict:
    """``run(seed + attempt)`` until its result is sane; the last one, marked, if none is."""
    for attempt in range(attempts):
        result = run(seed + attempt)
        if sane(result):
            break
    return result | {"attempts": attempt + 1, "sane": sane(result)}


def sweep(runs: list[dict], run: Callable[[dict], dict]) -> list[dict]:
    """A row per run; an error becomes a row with status."""
    out = []
    for r in runs:
        try:
            out.append(r | run(r) | {"status": "ok"})
        except Exception as e:  # noqa: BLE001  recorded, and the sweep goes on
            out.append(r | {"status": f"error: {type(e).__name__}: {e}"})
    return out
