"""Text formats: rating files, trust edges, cascade files and network files, both ways."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RatingFormat:
    """Where a rating file has its fields; ``sep`` is a comma or ``ws`` (runs of white space)."""

    path: str
    sep: str
    header: bool
    user: int
    item: int
    rating: int
    ts: int | None


_registry: dict[str, RatingFormat] = {}


def register(name: str, fmt: RatingFormat) -> None:
    _registry[name] = fmt


def datasets() -> list[str]:
    """Names of the registered datasets."""
    return sorted(_registry)


def load_dataset(spark: SparkSession, name: str | None = None, path: str | None = None, encode: bool = True) -> DataFrame:
    """(user_id, item_id, rating, ts) of a registered dataset, or of a CSV file with these as columns 0, 1 and 2.

    With ``encode``, ids become the 0-based rank among the sorted distinct ids.  An unknown name is a ValueError.
    """
    if path is not None:
        fmt = RatingFormat(path, ",", True, 0, 1, 2, None)
    elif name in _registry:
        fmt = _registry[name]
    else:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(datasets())}")
    if fmt.sep == "ws":
        parts = spark.read.text(fmt.path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") > max(fmt.user, fmt.item, fmt.rating))
        at = lambda i: F.col("p")[i]
    else:
        wide = spark.read.csv(fmt.path, sep=fmt.sep, header=fmt.header)
        parts, names = wide, wide.columns
        at = lambda i: F.col(f"`{names[i]}`")
    ts = F.timestamp_seconds(at(fmt.ts).cast("double").cast("long")) if fmt.ts is not None else F.lit(None).cast("timestamp")
    rows = parts.select(at(fmt.user).cast("double").cast("long").alias("user_id"), at(fmt.item).cast("double").cast("long").alias("item_id"), at(fmt.rating).cast("double").alias("rating"), ts.alias("ts"))
    if not encode:
        return rows
    from ..operators.graph import dense_ids

    for col in ("user_id", "item_id"):
        codes = dense_ids(rows.select(F.col(col).alias("id"))).withColumnRenamed("id", col)
        rows = rows.join(codes, col).drop(col).withColumnRenamed("code", col)
    return rows.select("user_id", "item_id", "rating", "ts")


def load_trust(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (src, dst) of a white-space file of numbers in scientific notation, rounded to integers."""
    p = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 2)
    at = lambda i: F.round(F.col("p")[i].cast("double")).cast("long")
    return p.select(at(0).alias("src"), at(1).alias("dst")).where("src is not null and dst is not null").distinct()


def cascade_lines(cascades: DataFrame) -> DataFrame:
    """(item_id, line): ``user,day,user,day,...`` in order of adoption, for cascades of two or more."""
    grouped = cascades.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("t_days", "user_id"))).alias("c")).where(F.size("c") >= 2)
    pair = F.transform("c", lambda x: F.concat(x["user_id"].cast("string"), F.lit(","), x["t_days"].cast("string")))
    return grouped.select("item_id", F.array_join(pair, ",").alias("line"))


def write_cascades(cascades: DataFrame, users: DataFrame, path: str) -> None:
    """A text folder: a file of ``id,id`` lines for all users, a blank line, the cascades' lines."""
    ids = users.select(F.lit(0).alias("o"), F.col("user_id").alias("k"), F.concat_ws(",", F.col("user_id").cast("string"), F.col("user_id").cast("string")).alias("value"))
    blank = cascades.sparkSession.createDataFrame([(1, 0, "")], "o int, k long, value string")
    lines = cascade_lines(cascades).select(F.lit(2).alias("o"), F.col("item_id").alias("k"), F.col("line").alias("value"))
    ids.unionByName(blank).unionByName(lines).repartitionByRange(4, "o", "k").sortWithinPartitions("o", "k").select("value").write.mode("overwrite").text(path)


def read_cascades(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(users, cascades(line, pos, user_id, t_days)) of such a folder; a cascade is numbered by its text's hash."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.split("value", ",").alias("p"), F.xxhash64("value").alias("line"))
    users = rows.where((F.size("p") == 2) & (F.col("p")[0] == F.col("p")[1])).select(F.col("p")[0].cast("long").alias("user_id"))
    body = rows.where(F.size("p") >= 4)
    steps = F.sequence(F.lit(0), (F.size("p") / 2).cast("int") - 1)
    flat = body.select("line", F.posexplode(F.transform(steps, lambda i: F.struct(F.get("p", 2 * i).cast("long").alias("user_id"), F.get("p", 2 * i + 1).cast("double").alias("t_days")))).alias("pos", "x"))
    return users, flat.select("line", (F.col("pos") + 1).alias("pos"), "x.user_id", "x.t_days")


def network_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value) lines: ``i,i`` for nodes, then ``i,j`` for edges."""
    pair = lambda a, b: F.concat_ws(",", F.col(a).cast("string"), F.col(b).cast("string"))
    return nodes.select(pair("node", "node").alias("value")).unionByName(edges.select(pair("src", "dst").alias("value")))


def read_networks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(model, net_idx, node), edges(model, net_idx, src, dst)) of ``inferred-network-<model>-<NNN>`` files.

    A two-field line is a node if both fields agree, else an edge; other lines are ignored.  Edges stay
    if both ends are declared; parallel ones collapse.  Files with other names are an error.
    """
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^inferred-network-(.+)-(\d+)(?:\.\w+)*$", 1)
    idx = F.regexp_extract(F.col("_metadata.file_name"), r"^inferred-network-(.+)-(\d+)(?:\.\w+)*$", 2)
    rows = spark.read.text(path).select("value", name.alias("model"), idx.alias("i"))
    bad = F.raise_error(F.lit("a network file must be named inferred-network-<model>-<NNN>"))
    rows = rows.withColumn("model", F.when(F.col("model") == "", bad.cast("string")).otherwise(F.col("model"))).withColumn("net_idx", F.col("i").cast("int"))
    two = rows.withColumn("p", F.split(F.trim("value"), ",")).where(F.size("p") == 2).select("model", "net_idx", F.trim(F.col("p")[0]).cast("long").alias("src"), F.trim(F.col("p")[1]).cast("long").alias("dst"))
    nodes = two.where("src = dst").select("model", "net_idx", F.col("src").alias("node")).distinct()
    edges = two.where("src <> dst").distinct()
    for end in ("src", "dst"):
        edges = edges.join(nodes.withColumnRenamed("node", end), ["model", "net_idx", end], "left_semi")
    return nodes, edges.select("model", "net_idx", "src", "dst")


def latest(results: DataFrame, updates: DataFrame, keys: tuple[str, ...] = ("model", "net_idx")) -> DataFrame:
    """Results with the updates' columns set for their keys; columns either side lacks are null."""
    both = results.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in (*keys, "__new")]
    return both.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__new"))).alias(c) for c in cols])


def remaining(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of ``todo`` without a result yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def write_keyed(df: DataFrame, path: str) -> None:
    """A table keyed by network as Parquet, a folder per (model, net_idx)."""
    df.repartition("model", "net_idx").write.mode("overwrite").partitionBy("model", "net_idx").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A report table of the first rows (of small aggregates)."""
    rows = df.limit(limit).collect()
    head = f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)


def log_run(spark: SparkSession, path: str, run: str, params: dict, metrics: dict, step: int = 0) -> None:
    """Appends an experiment's parameters and metrics as (run, kind, key, value, step)."""
    rows = [(run, "param", k, str(v), step) for k, v in params.items()] + [(run, "metric", k, str(v), step) for k, v in metrics.items()]
    spark.createDataFrame(rows, "run string, kind string, key string, value string, step int").write.mode("append").parquet(path)
