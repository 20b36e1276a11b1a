"""Tables written to the shared folder, and connected components on top of them."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a new local one on one machine, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        path = _own.setdefault(app, "") or tempfile.mkdtemp(prefix="tributary-")
        _own[app] = path
    return path.rstrip("/")


class Scratch:
    """Named Parquet tables in the shared folder.

    They cut the lineage, and any executor can read them again after another is lost.  Tables are
    dropped as soon as no later step reads them; those a result still reads stay until the
    cluster's owner clears the folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished steps: it does so once the driver's garbage is collected."""
        gc.collect()
        self.spark._jvm.System.gc()


def give_back() -> None:
    """Returns freed memory of this process to the system, after large tables came to the driver."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for all nodes of ``edges(a, b)``: the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014); each is two shuffles whose
    aggregations combine before they shuffle, so a hub's rows do not meet in one task.  Rounds stop
    once every node has one edge to a smaller node that has none itself; a round's result is a
    written table.  An input without edges gives an empty table.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cur = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    for k in count(1):
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("top")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("top"))))
        if cur.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("top").alias("top")).where("up > 1 or up = 1 and top = 1").isEmpty():
            break
        # large star: every larger neighbour of u is tied to the smallest of u and its neighbours
        every = both(cur)
        low = every.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = every.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its smaller neighbours are tied to the smallest of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        cur = scratch.write(small, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
