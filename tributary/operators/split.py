"""Train/test folds and the warm filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import written

_KEYS = ("ts", "user_id", "item_id")


def _nth(df: DataFrame, primary: Column, order: list[str], n: int, total: int):
    """The n-th row (from 1) in the order, whose first key grows with the number ``primary``.

    Approximate quantiles bracket the row; the rows before the bracket are counted, and only those
    inside it are sorted.
    """
    keyed = df.select(*order, primary.cast("double").alias("__x"))
    low, high = keyed.approxQuantile("__x", [max(0.0, n / total - 0.004), min(1.0, n / total + 0.004)], 0.002)
    before = keyed.where(F.col("__x") < low).count()
    inside = keyed.where(F.col("__x").between(low, high))
    if not before < n <= before + inside.count():
        before, inside = 0, keyed
    return inside.orderBy(*order).limit(n - before).orderBy(*[F.col(c).desc() for c in order]).first()


def temporal(ratings: DataFrame, test: float = 0.2) -> DataFrame:
    """Adds fold: ``train`` for the earliest floor(n*(1-test)) rows by (ts, user, item), ``test`` for the rest.

    One global cut.  The boundary row is found by its order, then rows are compared with it; the rows
    are read several times, so they are written once first.
    """
    ratings = written(ratings)
    n = ratings.count()
    cut = int(n * (1 - test))
    if cut <= 0:
        return ratings.withColumn("fold", F.lit("test"))
    last = _nth(ratings, F.unix_micros("ts"), list(_KEYS), cut, n)
    key = F.struct(*_KEYS)
    edge = F.struct(*[F.lit(last[c]).cast(ratings.schema[c].dataType) for c in _KEYS])
    return ratings.withColumn("fold", F.when(key <= edge, "train").otherwise("test"))


def random(ratings: DataFrame, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds fold by a seeded hash order of (user, item): exactly floor(n*(1-test)) rows are ``train``.

    Repeated (user, item) rows are told apart by nothing else and share a fold.
    """
    ratings = written(ratings)
    n = ratings.count()
    cut = int(n * (1 - test))
    key = F.md5(F.concat_ws("-", F.col("user_id").cast("string"), F.col("item_id").cast("string"), F.lit(str(seed))))
    keyed = ratings.withColumn("__k", key)
    if cut <= 0:
        return ratings.withColumn("fold", F.lit("test"))
    last = _nth(keyed, F.conv(F.substring("__k", 1, 12), 16, 10), ["__k"], cut, n)
    return keyed.withColumn("fold", F.when(F.col("__k") <= last["__k"], "train").otherwise("test")).drop("__k")


def warm(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test rows whose user and item both occur in train."""
    return test.join(train.select("user_id").distinct(), "user_id", "left_semi").join(train.select("item_id").distinct(), "item_id", "left_semi")


def sample(ratings: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows by a seeded hash order."""
    return ratings.orderBy(F.md5(F.concat_ws("-", F.col("user_id").cast("string"), F.col("item_id").cast("string"), F.lit(str(seed))))).limit(n)


def rank_in(df: DataFrame, by: str, order: list[str], limit: int) -> DataFrame:
    """First ``limit`` rows of each group in an order."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rn") <= limit)
