"""Report aggregates: the data behind the plots and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import as_flag


def community_stats(scores: DataFrame) -> DataFrame:
    """Per network: mean, median and sample deviation of lph and lph_score, mean and median number of communities."""
    stat = lambda c: [F.avg(c).alias(f"{c}_mean"), F.median(c).alias(f"{c}_median"), F.stddev_samp(c).alias(f"{c}_std")]
    return scores.groupBy("model", "net_idx").agg(*stat("lph"), *stat("lph_score"), F.avg("num_communities").alias("communities_mean"), F.median("num_communities").alias("communities_median"))


def with_alpha(stats: DataFrame, grid: DataFrame) -> DataFrame:
    """Network statistics next to their rate, rates above 0."""
    return grid.where("alpha > 0").join(stats, ["model", "net_idx"])


def network_summary(runs: DataFrame) -> DataFrame:
    """Per network: mean and population deviation of rmse, the baseline's mean, improvement in per cent."""
    s = runs.groupBy("model", "net_idx").agg(F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"), F.avg("baseline_rmse").alias("baseline_rmse_mean"))
    b = F.col("baseline_rmse_mean")
    return s.withColumn("improvement_pct", F.when(b != 0, (b - F.col("rmse_mean")) / b * 100.0))


def sweep_summary(results: DataFrame) -> DataFrame:
    """Per model: runs, sane runs, runs whose baseline is sane too; mean, deviation, least and most of metrics over sane
    runs and of rmse_delta over the latter, rounded to 9 places."""
    sane, both = as_flag("sane") == 1, (as_flag("sane") == 1) & (as_flag("baseline_sane") == 1)
    aggs = [F.count("*").alias("sampled_runs"), F.count(F.when(sane, 1)).alias("metric_runs"), F.count(F.when(both, 1)).alias("delta_runs")]
    for c, ok in (("rmse", sane), ("mae", sane), ("r2", sane), ("edges", sane), ("rmse_delta", both)):
        x = F.when(ok, F.col(c).cast("double"))
        aggs += [F.round(f(x), 9).alias(f"{c}_{n}") for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return results.groupBy("model").agg(*aggs)


def running_best(trials: DataFrame, by: str = "model", order: str = "trial", col: str = "rmse") -> DataFrame:
    """Adds best_so_far: the least value up to each trial."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return trials.withColumn("best_so_far", F.min(col).over(w))


def best_trial(trials: DataFrame, by: str = "model", col: str = "rmse", key: str = "trial") -> DataFrame:
    """The trial with the least value per group; ties to the smallest key."""
    pick = F.min(F.struct(F.col(col), F.col(key)))
    return trials.where(F.col(col).isNotNull()).groupBy(by).agg(pick.alias("b")).select(by, F.col(f"b.{key}").alias(key), F.col(f"b.{col}").alias(col))


def heatmap(trials: DataFrame, x: str, y: str, col: str, x_range: tuple[float, float], y_range: tuple[float, float], bins: int = 9) -> DataFrame:
    """(x_bin, y_bin, n, mean) on a grid of equal bins; the first holds its lower edge, values outside are left out."""

    def at(c, low, high):
        width = (high - low) / bins
        return F.when(F.col(c).between(low, high), F.greatest(F.ceil((F.col(c) - low) / width), F.lit(1)).cast("int"))

    rows = trials.select(at(x, *x_range).alias("x_bin"), at(y, *y_range).alias("y_bin"), F.col(col).alias("v"))
    return rows.where("x_bin is not null and y_bin is not null").groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def heatmap_wide(cells: DataFrame, bins: int = 9) -> DataFrame:
    return cells.groupBy("y_bin").pivot("x_bin", list(range(1, bins + 1))).agg(F.first("mean"))


def correlations(frame: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of each pair of columns, in one pass; null where a column doesn't vary."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    both = lambda a, b: F.stddev_pop(a) * F.stddev_pop(b)
    one = frame.agg(*[F.when(both(a, b) > 0, F.covar_pop(a, b) / both(a, b)).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def clipped(frame: DataFrame, col: str, share: float = 0.99) -> DataFrame:
    """The column cut at its percentile."""
    edge = frame.agg(F.percentile(col, F.lit(share)).alias("__edge"))
    return frame.join(F.broadcast(edge)).withColumn(col, F.least(F.col(col), F.col("__edge"))).drop("__edge")


def histogram(frame: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """(bin, n) of the positive values over bins equal in width between their ends."""
    pos = frame.where(F.col(col) > 0)
    ends = pos.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(col) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return pos.join(F.broadcast(ends)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def timeline(cascades: DataFrame, n: int = 5) -> DataFrame:
    """Events of the first n cascades by item."""
    first = cascades.select("item_id").distinct().orderBy("item_id").limit(n)
    return cascades.join(F.broadcast(first), "item_id", "left_semi")


def points(frame: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group by a seeded hash order, for plots."""
    w = W.partitionBy(by).orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), key)
    return frame.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def importance(shap: DataFrame) -> DataFrame:
    """Per model and feature: mean over networks of the networks' mean |value| and mean value, with rank."""
    net = shap.groupBy("model", "net_idx", "feature").agg(F.avg(F.abs("shap")).alias("m"), F.avg("shap").alias("s"))
    out = net.groupBy("model", "feature").agg(F.avg("m").alias("mean_abs_shap"), F.avg("s").alias("mean_shap"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("model").orderBy(F.desc("mean_abs_shap"), "feature")))


def flatten(results: DataFrame, col: str, fields: dict[str, str]) -> DataFrame:
    """One flat row of a JSON column: name to path; missing keys are null."""
    return results.select("*", *[F.get_json_object(col, f"$.{path}").alias(name) for name, path in fields.items()]).drop(col)
