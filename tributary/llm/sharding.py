"""Sharding by extendible hashing.

Keys are hashed to 60 bits.  A directory of hash prefixes starts with one bucket over everything;
only buckets above the byte limit split on their next bit, until every shard fits.  Rows whose whole
hash is one bucket above the limit (one key repeated) are cut into consecutive parts that fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Scratch

BITS = 60


def key_hash(col: str):
    """60 bits of the key's MD5 as a long (null: as the empty string)."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


STRIDE = 16


def directory(scratch: Scratch, sizes: DataFrame, limit: int) -> DataFrame:
    """(prefix, depth, bytes) of the leaves for ``sizes(h, bytes)``; a leaf above the limit has depth ``BITS``.

    Rows are summed to prefixes of the next ``STRIDE`` bits, at most 2**16 for each bucket that still
    has to split, and the levels in between split on these sums; only rows of buckets above the limit
    at a stride's end are read again.
    """
    active, leaves = sizes, None
    for low in range(0, BITS, STRIDE):
        high = min(low + STRIDE, BITS)
        sums = scratch.write(active.groupBy(F.shiftright("h", BITS - high).alias("fine")).agg(F.sum("bytes").alias("bytes")), f"sums{high}")
        rest = sums
        full = None
        for depth in range(low, high + 1):
            if low and depth == low:
                continue  # these buckets are known to split
            prefix = F.shiftright("fine", high - depth) if depth else F.lit(0).cast("long")
            level = scratch.write(rest.groupBy(prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes")), f"level{depth}")
            full = level.where(F.col("bytes") > limit)
            part = (level if depth == BITS else level.where(F.col("bytes") <= limit)).withColumn("depth", F.lit(depth))
            leaves = part if leaves is None else leaves.unionByName(part)
            if depth == BITS or full.isEmpty():
                return scratch.write(leaves, "directory")
            rest = scratch.write(rest.withColumn("prefix", prefix).join(full.select("prefix"), "prefix", "left_semi").drop("prefix"), f"rest{depth}")
        active = active.withColumn("prefix", F.shiftright("h", BITS - high)).join(full.select("prefix"), "prefix", "left_semi").drop("prefix")
    raise AssertionError("the last depth returns")


def shard(rows: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 64 << 20) -> DataFrame:
    """Adds shard (the prefix's bits, ``-`` and the part for cut buckets), depth and shard_bytes to ``rows``.

    A row weighs its text's UTF-8 bytes (null: 0).  Only a row above the limit by itself is in a shard
    above it, alone.  Rows of a null key share a hash.  Columns of ``rows`` named like an added one
    are replaced; an empty table gives no row.
    """
    scratch = Scratch(rows.sparkSession)
    keep = [c for c in rows.columns if c not in ("shard", "depth", "shard_bytes")]
    hashed = rows.select(*keep, key_hash(key).alias("__h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("__n"))
    sizes = scratch.write(hashed.groupBy(F.col("__h").alias("h")).agg(F.sum("__n").alias("bytes"), F.count("*").alias("rows")), "sizes")
    leaves = directory(scratch, sizes, limit)
    depths = [r["depth"] for r in leaves.select("depth").distinct().collect()]  # at most 61
    tagged = None
    at = F.explode(F.array([F.struct(F.lit(d).alias("depth"), (F.shiftright("h", BITS - d) if d else F.lit(0).cast("long")).alias("prefix")) for d in sorted(depths)] or [F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"))]))
    tagged = sizes.select("h", "rows", at.alias("at")).select("h", "rows", "at.*").join(leaves, ["depth", "prefix"])
    whole = (F.col("bytes") <= limit) | ((F.col("depth") == BITS) & (F.col("rows") == 1))
    tagged = tagged.select(F.col("h").alias("__h"), "depth", "prefix", F.col("bytes").alias("__whole"), whole.alias("__fits"))
    tagged = scratch.write(tagged, "tagged")
    out = hashed.join(tagged, "__h")
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.substring(F.lpad(F.bin("prefix"), BITS, "0"), BITS + 1 - F.col("depth"), F.col("depth")))
    fits = out.where("__fits").select(*keep, name.alias("shard"), "depth", F.col("__whole").alias("shard_bytes"))
    # one key above the limit: greedy cuts would need all its rows in one task, so first they are dealt
    # by chance into strips of half a limit, and a strip is cut where a running sum crosses the limit
    over = out.where("not __fits").withColumn("__strip", F.floor(F.rand(7) * F.ceil(F.col("__whole") * 2 / limit)).cast("long"))
    over = scratch.write(over, "over")
    running = F.sum("__n").over(W.partitionBy("__h", "__strip").orderBy(F.col("__n"), *[F.col(c) for c in keep if c == text]).rowsBetween(W.unboundedPreceding, -1))
    cut = over.withColumn("__part", F.when(F.col("__n") > limit // 2, -1 - F.monotonically_increasing_id()).otherwise(F.floor(F.coalesce(running, F.lit(0)) * 2 / limit)))
    cut = cut.withColumn("shard_bytes", F.sum("__n").over(W.partitionBy("__h", "__strip", "__part")))
    cut = cut.select(*keep, F.concat(name, F.lit("-"), F.col("__strip").cast("string"), F.lit("."), F.col("__part").cast("string")).alias("shard"), "depth", "shard_bytes")
    return fits.unionByName(cut)
