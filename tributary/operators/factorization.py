"""Collective matrix factorisation by alternating least squares over DataFrames.

Factors are tables (id, f array<double>).  Ratings are dealt once to blocks of entities
(``operators.blocks``); a half-step sends the other side's factors to the blocks that need them and
solves each entity's normal equations in double precision.  Side information, social ties and
implicit data only add terms to these systems.

Objective: 1/2 w_main sum W (x - mean - b_u - b_i - a.b)^2 + 1/2 w_user |U - A C|^2
+ 1/2 w_item |I - B D|^2 + 1/2 lam (all squares) + lam_social sum w_uv |a_u - a_v|^2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import Tables, cut
from . import biases, blocks, topn


@dataclass(frozen=True)
class Options:
    k: int = 40
    lam: float = 10.0
    iterations: int = 10
    w_main: float = 1.0
    w_user: float = 0.5
    w_item: float = 0.5
    k_user: int = 0
    k_item: int = 0
    k_main: int = 0
    user_bias: bool = True
    item_bias: bool = True
    center: bool = True
    scale_lam: bool = False
    nonneg: bool = False
    l1: float = 0.0
    missing_as_zero: bool = False
    implicit: bool = False
    alpha: float = 1.0
    log_transform: bool = False
    implicit_features: bool = False
    w_implicit: float = 0.5
    lam_social: float = 0.0
    social_sweeps: int = 2
    weight_col: str | None = None
    seed: int = 42


def solve(gram: np.ndarray, rhs: np.ndarray, nonneg: bool = False, l1: float = 0.0, sweeps: int = 200) -> np.ndarray:
    """Minimiser of 1/2 x'Gx - r'x (+ l1 |x|), over x >= 0 with ``nonneg``."""
    if not nonneg and not l1:
        return np.linalg.solve(gram, rhs)
    x = np.maximum(np.linalg.solve(gram, rhs), 0.0) if nonneg else np.linalg.solve(gram, rhs)
    for _ in range(sweeps):
        old = x.copy()
        for j in range(len(x)):
            g = rhs[j] - gram[j] @ x + gram[j, j] * x[j]
            v = np.sign(g) * max(abs(g) - l1, 0.0) / gram[j, j]
            x[j] = max(v, 0.0) if nonneg else v
        if np.abs(x - old).max() < 1e-10:
            break
    return x


#: What a row of side information or a tie adds to its entity's system: rhs += wr f, diagonal += dg.
ROW = "id long, wr double, dg double, f array<double>"


def extras_of(rows: DataFrame, size: int | None = None) -> DataFrame:
    """(id, f): each entity's rows summed, f holding the ``size`` values of the right side (as many as the first row has) and then the diagonal."""
    size = size if size is not None else (rows.select(F.size("f")).first() or [0])[0]
    sums = [F.sum(F.element_at("f", j) * F.col("wr")) for j in range(1, size + 1)]
    return rows.groupBy("id").agg(F.array(*sums, F.sum("dg")).alias("f"))


def outer_sum(left: DataFrame, right_cols: str | None = None) -> tuple[np.ndarray, np.ndarray | None, int]:
    """(sum f f', sum f g', rows) of (f[, g]) rows: one k x k partial result per task goes to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g1 = g2 = None
        n = 0
        for pdf in batches:
            if len(pdf):
                f = np.stack(pdf["f"].to_numpy())
                g1 = f.T @ f + (0 if g1 is None else g1)
                n += len(f)
                if right_cols:
                    g2 = f.T @ np.stack(pdf[right_cols].to_numpy()) + (0 if g2 is None else g2)
        if g1 is not None:
            yield pd.DataFrame({"a": [g1.ravel()], "b": [g2.ravel() if g2 is not None else np.zeros(0)], "n": [n]})

    cols = ["f", *([right_cols] if right_cols else [])]
    parts = left.select(*cols).mapInPandas(run, "a array<double>, b array<double>, n long").collect()
    if not parts:
        return np.zeros((0, 0)), None, 0
    a = sum(np.array(p["a"]) for p in parts)
    k = int(round(len(a) ** 0.5))
    b = sum(np.array(p["b"]) for p in parts).reshape(k, -1) if right_cols else None
    return a.reshape(k, k), b, sum(p["n"] for p in parts)


def start(ids: DataFrame, size: int, seed: int, scale: float = 0.1, positive: bool = False) -> DataFrame:
    """Seeded factors from hashes of the ids: the same for an id wherever it is computed."""
    u = lambda j: F.pmod(F.xxhash64("id", F.lit(seed), j), F.lit(1_000_003)) / 1_000_003.0
    value = (lambda j: u(j) * scale) if positive else (lambda j: (u(j) - 0.5) * 2 * scale)
    return ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), value).alias("f"))


def vectors(frame: DataFrame, key: str) -> DataFrame:
    """(id, u array<double>) of a wide feature table; missing values 0."""
    cols = [c for c in frame.columns if c != key]
    return frame.select(F.col(key).cast("long").alias("id"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]).alias("u"))


@dataclass
class Model:
    """mean; users(id, f) and items(id, f), whose last column is the bias if there is one; C and D map factors to features."""

    options: Options
    mean: float
    users: DataFrame
    items: DataFrame
    C: np.ndarray | None = None
    D: np.ndarray | None = None
    seen: DataFrame | None = None
    history: list[float] = field(default_factory=list)

    def _sides(self):
        o = self.options
        ub, ib = int(o.user_bias and not o.implicit), int(o.item_bias and not o.implicit)
        size = o.k + o.k_main
        return (o.k_user, size, ub), (o.k_item, size, ib)

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds pred for (user_id, item_id).  Unseen users or items: the mean plus the known bias; without biases, null."""
        (u0, n, ub), (i0, _, ib) = self._sides()
        cut = lambda c, at: F.slice(F.col(c), at + 1, n)
        j = rows.join(self.users.select(F.col("id").alias("user_id"), F.col("f").alias("__u")), "user_id", "left").join(self.items.select(F.col("id").alias("item_id"), F.col("f").alias("__i")), "item_id", "left")
        both = F.aggregate(F.zip_with(cut("__u", u0), cut("__i", i0), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        bias = (F.coalesce(F.element_at("__u", -1), F.lit(0.0)) if ub else F.lit(0.0)) + (F.coalesce(F.element_at("__i", -1), F.lit(0.0)) if ib else F.lit(0.0))
        pred = F.lit(self.mean) + bias + (F.coalesce(both, F.lit(0.0)) if ub or ib else both)
        return j.withColumn("pred", pred).drop("__u", "__i")

    def top_n(self, users: DataFrame, n: int = 10, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
        """(user_id, item_id, score, rank) of the n best items; items restricted to ``include(item_id)`` or without ``exclude``, not both."""
        if include is not None and exclude is not None:
            raise ValueError("give include or exclude, not both")
        (u0, n_f, ub), (i0, _, ib) = self._sides()
        items = self.items
        if include is not None:
            items = items.join(include.select(F.col("item_id").alias("id")).distinct(), "id", "left_semi")
        if exclude is not None:
            items = items.join(exclude.select(F.col("item_id").alias("id")).distinct(), "id", "left_anti")
        items = items.select("id", F.concat(F.slice("f", i0 + 1, n_f), F.array(F.element_at("f", -1) if ib else F.lit(0.0))).alias("f"))
        asked = users.select(F.col("user_id").cast("long").alias("user_id")).distinct().join(self.users.select(F.col("id").alias("user_id"), F.col("f").alias("g")), "user_id", "left")
        own = F.concat(F.slice("g", u0 + 1, n_f), F.array(F.lit(1.0)))
        unseen = F.concat(F.array_repeat(F.lit(0.0), n_f), F.array(F.lit(1.0))) if ub or ib else F.lit(None).cast("array<double>")
        bias = F.coalesce(F.element_at("g", -1), F.lit(0.0)) if ub else F.lit(0.0)
        asked = cut(asked.select("user_id", F.coalesce(own, unseen).alias("f"), (F.lit(self.mean) + bias).alias("level")))
        found = topn.top_n(asked.select("user_id", "f"), items, n)
        return found.join(asked.select("user_id", "level"), "user_id").select("user_id", "item_id", (F.col("score") + F.col("level")).alias("score"), "rank")

    def swapped(self) -> Model:
        """The model of the transposed ratings."""
        o = self.options
        o = replace(o, k_user=o.k_item, k_item=o.k_user, w_user=o.w_item, w_item=o.w_user, user_bias=o.item_bias, item_bias=o.user_bias)
        return Model(o, self.mean, self.items, self.users, self.D, self.C)

    def factors_cold(self, features: DataFrame, key: str = "user_id") -> DataFrame:
        """(id, f) of users known by their features alone: (w C'C + lam)^-1 w C'u, bias 0."""
        o = self.options
        c, ub = self.C, int(o.user_bias and not o.implicit)
        gram = o.w_user * c.T @ c + o.lam * np.eye(c.shape[1])
        m = np.linalg.solve(gram, o.w_user * c.T)

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    f = np.stack(pdf["u"].to_numpy()) @ m.T
                    yield pd.DataFrame({"id": pdf["id"], "f": list(np.pad(f, ((0, 0), (0, o.k_main + ub))))})

        return vectors(features, key).mapInPandas(run, "id long, f array<double>")

    def factors_warm(self, ratings: DataFrame, features: DataFrame | None = None) -> DataFrame:
        """(id, f) of users from their ratings (and features): one half-step on the new rows."""
        dealt = blocks.deal(ratings, "user_id", "item_id", self.options.weight_col)
        if self.options.implicit_features and self.seen is None:
            raise ValueError("the model has no factors of what was seen")
        out = cut(_update(self.options, dealt, self.items, self.mean, self.C, features, seen=self.seen))
        dealt.drop()
        return out

    def with_users(self, factors: DataFrame) -> Model:
        return replace(self, users=factors)

    def impute(self, users: DataFrame, items: DataFrame, known: DataFrame) -> DataFrame:
        """(user_id, item_id, rating, imputed): the grid with known ratings and predictions for the rest."""
        grid = users.select("user_id").distinct().join(items.select("item_id").distinct(), how="cross")
        rest = self.predict(grid.join(known, ["user_id", "item_id"], "left_anti"))
        return known.select("user_id", "item_id", "rating", F.lit(False).alias("imputed")).unionByName(rest.select("user_id", "item_id", F.col("pred").alias("rating"), F.lit(True).alias("imputed")))


def _side(o: Options, mean: float) -> blocks.Side:
    ub, ib = bool(o.user_bias and not o.implicit), bool(o.item_bias and not o.implicit)
    kind = "implicit" if o.implicit else "zero" if o.missing_as_zero else "rating"
    n = o.k + o.k_main
    return blocks.Side(n, o.k_item + (n if o.implicit_features else 0), o.k_user, ub, ib, kind, mean, o.w_main, o.alpha, o.log_transform, o.w_implicit if o.implicit_features else 0.0)


def _base(o: Options, other: DataFrame) -> tuple[np.ndarray, np.ndarray, int | None]:
    """(gram, right side, entities) that every system holds: those of all cells, for implicit data, missing-as-zero and implicit features."""
    side = _side(o, 0.0)
    base, rhs = np.zeros((side.size, side.size)), np.zeros(side.size)
    if o.implicit_features:
        at = slice(side.pad, side.pad + side.width)
        seen, _, n = outer_sum(other.select(F.slice("f", 1, side.width).alias("f")))
        base[at, at] += o.w_implicit * seen if n else 0.0
    if not (o.implicit or o.missing_as_zero):
        return base, rhs, None
    bias = F.element_at("f", -1) if side.other_bias else F.lit(0.0)
    cells = other.select(F.concat(F.slice("f", side.skip + 1, side.width), F.array(F.lit(1.0)) if side.own_bias else F.array().cast("array<double>")).alias("f"), F.array(bias).alias("b"))
    gram, cross, n = outer_sum(cells, "b")
    if not n:
        return base, rhs, 0
    base[side.pad :, side.pad :] += o.w_main * gram
    if o.implicit:
        return base, rhs, None
    rhs[side.pad :] -= o.w_main * cross[:, 0]  # an empty cell's target is zero less the other side's bias
    return base, rhs, n


def seen_factors(o: Options, dealt: blocks.Dealt, users: DataFrame) -> DataFrame:
    """(id, f) of the items' own factors of what was seen: minimisers of w_implicit |1[x seen] - a.b'|^2 over all pairs, plus lam.

    ``dealt`` by item; the users' from the items with options and tables swapped.
    """
    n = o.k + o.k_main
    shared = cut(users.select("id", F.slice("f", o.k_user + 1, n).alias("f")))
    gram, _, there = outer_sum(shared)
    base = o.w_implicit * gram if there else np.zeros((n, n))
    return blocks.half_step(dealt, shared, blocks.Side(n, kind="seen", weight=o.w_implicit), np.full(n, o.lam), base)


def _with_seen(items: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """The items' factors, each with what ``seen_factors`` gives it in front (zeros for items that nobody rated)."""
    none = F.array_repeat(F.lit(0.0), n)
    return items.join(seen.select("id", F.col("f").alias("s")), "id", "left").select("id", F.concat(F.coalesce("s", none), "f").alias("f"))


def _feature_rows(features: DataFrame, key: str, c: np.ndarray, weight: float, tail: int) -> DataFrame:
    """Side rows: rhs += weight * C'u."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                f = weight * np.stack(pdf["u"].to_numpy()) @ c
                yield pd.DataFrame({"id": pdf["id"], "wr": 1.0, "dg": 0.0, "f": list(np.pad(f, ((0, 0), (0, tail))))})

    return vectors(features, key).mapInPandas(run, ROW)


def _update(o: Options, dealt: blocks.Dealt, items: DataFrame, mean: float, c: np.ndarray | None, features: DataFrame | None, key: str = "user_id", social: DataFrame | None = None, users: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(id, f) of the users (of the items, if the options and tables are swapped): one half-step."""
    side = _side(o, mean)
    if o.implicit_features:
        items = cut(_with_seen(items, seen, side.width))
    base, rhs, everyone = _base(o, items)
    rows = None
    if features is not None and c is not None:
        n = c.shape[1]
        base[:n, :n] += o.w_user * c.T @ c
        rows = _feature_rows(features, key, c, o.w_user, side.size - n)
    if social is not None and users is not None:
        both = social.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("other"), "weight"), F.struct(F.col("v").alias("id"), F.col("u").alias("other"), "weight"))).alias("e")).select("e.*")
        tied = both.join(users.select(F.col("id").alias("other"), F.col("f").alias("g")), "other")
        # ties bind the shared and main factors, not the users' own part nor the bias
        f = F.concat(F.array_repeat(F.lit(0.0), side.pad), F.slice("g", side.pad + 1, side.width), F.array_repeat(F.lit(0.0), int(side.own_bias)))
        weight = 2.0 * o.lam_social * F.col("weight")
        ties = tied.select("id", weight.alias("wr"), weight.alias("dg"), f.alias("f"))
        rows = ties if rows is None else rows.unionByName(ties)
    minimise = (lambda g, r: solve(g, r, o.nonneg, o.l1)) if o.nonneg or o.l1 else None
    return blocks.half_step(dealt, items, side, np.full(side.size, o.lam), base, rhs, extras_of(rows, side.size) if rows is not None else None, o.scale_lam, everyone, minimise)


def _feature_map(factors: DataFrame, features: DataFrame, key: str, width: int, lam: float, weight: float) -> np.ndarray:
    """C of U ~ A C': (A'A + lam/w)^-1 A'U, transposed."""
    j = factors.select("id", F.slice("f", 1, width).alias("f")).join(vectors(features, key), "id")
    gram, cross, _ = outer_sum(j, "u")
    return np.linalg.solve(gram + lam / weight * np.eye(width), cross).T


def fit(ratings: DataFrame, options: Options = Options(), user_features: DataFrame | None = None, item_features: DataFrame | None = None, social: DataFrame | None = None) -> Model:
    """Fit (user_id, item_id, rating).  Entities with features but no rating get factors from these.

    Each iteration: C and D, then items, then users (with ``social`` ties: some sweeps).  ``social``
    has (u, v, weight), each tie once.  Features and ties are read in every half-step, so they are computed once.
    """
    o = options
    user_features, item_features, social = (t if t is None else cut(t) for t in (user_features, item_features, social))
    ub, ib = int(o.user_bias and not o.implicit), int(o.item_bias and not o.implicit)
    mean = biases.global_mean(ratings, o.weight_col, o.nonneg) if o.center and not o.implicit and not o.missing_as_zero else 0.0
    us = ratings.select(F.col("user_id").cast("long").alias("id"))
    its = ratings.select(F.col("item_id").cast("long").alias("id"))
    if user_features is not None:
        us = us.unionByName(user_features.select(F.col("user_id").cast("long").alias("id")))
    if item_features is not None:
        its = its.unionByName(item_features.select(F.col("item_id").cast("long").alias("id")))
    width_u, width_i = o.k_user + o.k, o.k_item + o.k
    users = start(us.distinct(), width_u + o.k_main + ub, o.seed, positive=o.nonneg)
    items = start(its.distinct(), width_i + o.k_main + ib, o.seed + 1, positive=o.nonneg)
    swapped = replace(o, k_user=o.k_item, k_item=o.k_user, w_user=o.w_item, w_item=o.w_user, user_bias=o.item_bias, item_bias=o.user_bias)
    c = d = seen_i = None
    by_user, by_item = blocks.deal(ratings, "user_id", "item_id", o.weight_col), blocks.deal(ratings, "item_id", "user_id", o.weight_col)
    kept: dict[str, Tables] = {}

    def renewed(name: str, factors: DataFrame) -> DataFrame:
        """The factors, written; those that they take the place of are dropped."""
        tables = Tables(ratings.sparkSession)
        out, old = tables.write(factors), kept.pop(name, None)
        kept[name] = tables
        if old is not None:
            old.drop()
        return out

    for _ in range(o.iterations):
        if user_features is not None:
            c = _feature_map(users, user_features, "user_id", width_u, o.lam, o.w_user)
        if item_features is not None:
            d = _feature_map(items, item_features, "item_id", width_i, o.lam, o.w_item)
        seen_u = renewed("seen_u", seen_factors(swapped, by_user, items)) if o.implicit_features else None
        items = renewed("items", _update(swapped, by_item, users, mean, d, item_features, "item_id", seen=seen_u))
        seen_i = renewed("seen_i", seen_factors(o, by_item, users)) if o.implicit_features else None
        for _ in range(o.social_sweeps if social is not None and o.lam_social else 1):
            users = renewed("users", _update(o, by_user, items, mean, c, user_features, "user_id", social if o.lam_social else None, users, seen_i))
    if "seen_u" in kept:
        kept["seen_u"].drop()
    by_user.drop()
    by_item.drop()
    if user_features is not None:
        c = _feature_map(users, user_features, "user_id", width_u, o.lam, o.w_user)
    if item_features is not None:
        d = _feature_map(items, item_features, "item_id", width_i, o.lam, o.w_item)
    return Model(o, mean, users, items, c, d, seen_i)


def fit_offsets(ratings: DataFrame, user_features: DataFrame, item_features: DataFrame | None = None, options: Options = Options()) -> tuple[Model, np.ndarray, np.ndarray | None]:
    """X ~ (A + U C)(B + I D)': fit X alone, then regress the factors on the features; (model, C, D) predicts new entities from features."""
    model = fit(ratings, options)
    n = options.k + options.k_main

    def regress(factors: DataFrame, features: DataFrame, key: str) -> np.ndarray:
        j = vectors(features, key).join(factors.select("id", F.col("f").alias("a")), "id").select(F.col("u").alias("f"), F.slice("a", 1, n).alias("u"))
        gram, cross, _ = outer_sum(j, "u")
        return np.linalg.solve(gram + 1e-6 * np.eye(len(gram)), cross)

    return model, regress(model.users, user_features, "user_id"), regress(model.items, item_features, "item_id") if item_features is not None else None


def offset_factors(features: DataFrame, key: str, coef: np.ndarray, tail: int = 0) -> DataFrame:
    """(id, f) of new entities: their features times the regression's coefficients."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "f": list(np.pad(np.stack(pdf["u"].to_numpy()) @ coef, ((0, 0), (0, tail))))})

    return vectors(features, key).mapInPandas(run, "id long, f array<double>")


def fit_content(ratings: DataFrame, user_features: DataFrame, item_features: DataFrame, k: int = 8, lam: float = 1.0, iterations: int = 6, seed: int = 42) -> tuple[float, np.ndarray, np.ndarray]:
    """X - mean ~ (U C)(I D)': alternating least squares on C and D, each one system of (features x k) unknowns."""
    mean = biases.global_mean(ratings)
    rng = np.random.default_rng(seed)
    j = ratings.where("rating is not null").select("user_id", "item_id", (F.col("rating") - mean).alias("x"))
    j = j.join(vectors(user_features, "user_id").select(F.col("id").alias("user_id"), F.col("u").alias("p")), "user_id").join(vectors(item_features, "item_id").select(F.col("id").alias("item_id"), F.col("u").alias("q")), "item_id").select("x", "p", "q")
    first = j.first()
    np_, nq = len(first["p"]), len(first["q"])
    c, d = rng.normal(0, 0.1, (np_, k)), rng.normal(0, 0.1, (nq, k))

    def update(own: str, other: str, coef: np.ndarray, size: int) -> np.ndarray:
        def rows(batches):
            for pdf in batches:
                if len(pdf):
                    a, b = np.stack(pdf[own].to_numpy()), np.stack(pdf[other].to_numpy()) @ coef
                    z = (a[:, :, None] * b[:, None, :]).reshape(len(a), -1)
                    yield pd.DataFrame({"f": list(z), "u": list(pdf["x"].to_numpy()[:, None])})

        gram, cross, _ = outer_sum(j.mapInPandas(rows, "f array<double>, u array<double>"), "u")
        return np.linalg.solve(gram + lam * np.eye(len(gram)), cross[:, 0]).reshape(size, k)

    for _ in range(iterations):
        c = update("p", "q", d, np_)
        d = update("q", "p", c, nq)
    return mean, c, d


def objective(model: Model, ratings: DataFrame, social: DataFrame | None = None) -> float:
    """The ratings', regularisation and social terms of the objective (features left out)."""
    o = model.options
    e = model.predict(ratings.where("rating is not null").select("user_id", "item_id", "rating")).agg(F.sum(F.pow(F.col("rating") - F.col("pred"), 2))).first()[0] or 0.0
    square = lambda t: t.agg(F.sum(F.aggregate("f", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    total = 0.5 * o.w_main * e + 0.5 * o.lam * (square(model.users) + square(model.items))
    if social is not None and o.lam_social:
        u = model.users.select(F.col("id").alias("u"), F.slice("f", o.k_user + 1, o.k + o.k_main).alias("fu"))
        v = u.select(F.col("u").alias("v"), F.col("fu").alias("fv"))
        gap = F.aggregate(F.zip_with("fu", "fv", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        total += o.lam_social * (social.join(u, "u").join(v, "v").agg(F.sum(F.col("weight") * gap)).first()[0] or 0.0)
    return total
