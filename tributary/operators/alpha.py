"""Rate grids of the diffusion models, and the edge budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODELS = ("exponential", "powerlaw", "rayleigh")


def centers(median: DataFrame) -> DataFrame:
    """(model, center) from ``median(median_gap)``: ln2/gap, 2 ln2/gap^2, none for the power law (nor for a gap of 0)."""
    gap = F.when(F.col("median_gap") > 0, F.col("median_gap"))
    two = F.log(F.lit(2.0))
    rows = [F.struct(F.lit(m).alias("model"), c.cast("double").alias("center")) for m, c in (("exponential", two / gap), ("powerlaw", F.lit(None)), ("rayleigh", 2 * two / (gap * gap)))]
    return median.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def grid(centers: DataFrame, n: int = 100, ratio: float = 100.0, linear: tuple[float, float] = (1.1, 5.0)) -> DataFrame:
    """(model, net_idx, alpha): n rates from center/ratio to center*ratio on a log scale; models without center: linear.

    n = 1 gives the lower end.
    """
    steps = max(n - 1, 1)
    i = F.col("net_idx")
    log = F.col("center") * F.pow(F.lit(ratio), 2.0 * i / steps - 1.0)
    lin = F.lit(linear[0]) + i * (linear[1] - linear[0]) / steps
    return centers.select("model", "center", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("net_idx")).select("model", "net_idx", F.when(F.col("center").isNotNull(), log).otherwise(lin).alias("alpha"))


def edge_budget(nodes: DataFrame, degree: float = 2.0) -> DataFrame:
    """One row (n_nodes, budget): max(1, degree * nodes), halves rounded to even."""
    return nodes.agg(F.count_distinct(nodes.columns[0]).alias("n_nodes")).select("n_nodes", F.greatest(F.lit(1), F.bround(F.col("n_nodes") * degree)).cast("long").alias("budget"))
