"""Prefix trie of conversations, built from ownership instead of pointers.

A node is a sequence of first turns; its members are the conversations that start with it, and its
owner is the smallest member.  The owners along a path fall towards the root, so every conversation
owns a suffix of its own path (maybe none of it).  Sums over a subtree are therefore sums over the
members of its top: what a member's path holds from there on, less what that member owns.  One
aggregation over prefixes gives them, without walking the tree.

Nothing gathers a conversation or a node's members in one place: paths are hashed in blocks of
``BLOCK`` turns and joined by the blocks' digests, prefixes are aggregated with partial sums, and
only first-owned nodes look their parent up.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch

BLOCK = 1024
#: Ids are strung together in runs of so many (by value), so that no row holds a whole node's members.
_RUN_BITS = 10
_SLOT_BITS = 10


def _root() -> Column:
    """The key of the empty path."""
    return F.unhex(F.lit(""))


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, own, rank, digest, bytes): the turns in order, from 0, and how many their conversation has.

    Turns are ordered by ``turn`` (null first), ties by role and then text; a null role or text is
    empty.  Rows without a conv_id belong to no conversation and are left out.  ``digest`` is the
    SHA-256 of role and text, ``bytes`` the text's length in UTF-8.  Ranks are counted in slots of
    1,024 turn numbers, so one long conversation is many groups.
    """
    turn = F.col("turn").cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), F.coalesce(F.shiftright(turn, _SLOT_BITS), F.lit(-(1 << 60))).alias("slot"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    counts = rows.groupBy("conv_id", "slot").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id")
    before = counts.select("conv_id", "slot", F.sum("n").over(whole).alias("own"), (F.sum("n").over(whole.orderBy("slot")) - F.col("n")).alias("before"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    place = F.row_number().over(Window.partitionBy("conv_id", "slot").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    placed = rows.select("conv_id", "slot", place.alias("place"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    return placed.join(before, ["conv_id", "slot"]).select("conv_id", "own", (F.col("before") + F.col("place") - 1).alias("rank"), "digest", "bytes")


def with_shared_heads(turns: DataFrame, scratch: Scratch, every: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on a common start: (members, paths).

    Conversation c takes the first h turns of conversation ``c - c % every`` (all if it has fewer,
    none if it is absent), then its own turns after its first h, where h is the unsigned CRC-32 of
    c in decimal, modulo ``most + 1``.  ``members(conv_id, n)`` has a row for every conversation,
    ``paths(conv_id, n, depth, digest, bytes)`` one for every turn; depth counts from 1.
    """
    turns = scratch.write(turns, "turns")
    c = F.col("conv_id")
    convs = turns.where("rank = 0").select("conv_id", "own", (F.crc32(c.cast("string").cast("binary")) % (most + 1)).alias("h"), (c - c % every).alias("base"))
    bases = turns.where(f"rank = 0 and conv_id % {every} = 0").select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    head = F.least("h", F.coalesce("there", F.lit(0)))
    members = convs.join(bases, "base", "left").select("conv_id", "base", "h", head.alias("head"), (head + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    members = scratch.write(members, "members")
    heads = turns.where(f"rank < {most} and conv_id % {every} = 0").select(F.col("conv_id").alias("base"), "rank", "digest", "bytes").join(members, "base").where("rank < head").select("conv_id", "n", (F.col("rank") + 1).alias("depth"), "digest", "bytes")
    # a conversation's own part needs what it took before: one row for every 1,024 turns of it
    taken = members.join(convs.select("conv_id", "own"), "conv_id").select("conv_id", "n", "h", "head", F.explode(F.sequence(F.lit(0), F.floor((F.col("own") - 1) / BLOCK))).alias("part"))
    own = turns.withColumn("part", F.floor(F.col("rank") / BLOCK)).join(taken, ["conv_id", "part"]).where("rank >= h").select("conv_id", "n", (F.col("head") + F.col("rank") - F.col("h") + 1).alias("depth"), "digest", "bytes")
    return members.select("conv_id", "n"), heads.unionByName(own)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, part, place): the digest of the rows so far in the part, that before, and the bytes before."""
    owner, chain, total = None, b"", 0
    for batch in batches:
        last, here, before = [], [], []
        for c, part, digest, size in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "part", "digest", "bytes")), strict=True):
            if (c, part) != owner:
                owner, chain, total = (c, part), b"", 0
            last.append(chain)
            chain = sha256(chain + digest).digest()
            here.append(chain)
            before.append(total)
            total += size
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column("bytes"), pa.array(here, pa.binary()), pa.array(last, pa.binary()), pa.array(before, pa.int64())], ["conv_id", "n", "depth", "part", "bytes", "chain", "last", "before"])


def _linked(df: DataFrame, *place: str) -> DataFrame:
    rows = df.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", *place).select("conv_id", "n", "depth", "part", "bytes", "digest")
    return rows.mapInArrow(_chained, "conv_id long, n long, depth long, part long, bytes long, chain binary, last binary, before long")


def prefixes(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, n, depth, part, key, parent_key, before, bytes): every prefix of every path but the root, by a 256-bit key.

    A key chains the digests of the prefix's turns within its block of ``BLOCK``, on top of the
    chain of all blocks before; ``before`` is the bytes of the turns above the last.
    """
    rows = paths.withColumn("part", F.floor((F.col("depth") - 1) / BLOCK))
    chained = scratch.write(_linked(rows, "depth"), "chained")
    full = chained.where(F.col("depth") % BLOCK == 0).select("conv_id", "n", "depth", F.lit(0).cast("long").alias("part"), (F.col("before") + F.col("bytes")).alias("bytes"), F.col("chain").alias("digest"), "last")
    ended = _linked(full, "depth")
    above = ended.select("conv_id", F.floor(F.col("depth") / BLOCK).alias("part"), F.col("chain").alias("state"), F.col("last").alias("state_before"), (F.col("before") + F.col("bytes")).alias("bytes_above"))
    ends = chained.where(F.col("depth") % BLOCK == 0).select("conv_id", F.floor(F.col("depth") / BLOCK).alias("part"), F.col("chain").alias("end"))
    above = above.join(ends, ["conv_id", "part"])
    hashed = lambda state, chain: F.when(F.length(state) > 0, F.unhex(F.sha2(F.concat(state, chain), 256))).otherwise(chain)
    state = F.coalesce("state", _root())
    first = F.length("last") == 0
    parent = F.when(first & F.col("state").isNotNull(), hashed(F.col("state_before"), F.col("end"))).when(first, _root()).otherwise(hashed(state, F.col("last")))
    return chained.join(above, ["conv_id", "part"], "left").select("conv_id", "n", "depth", "part", hashed(state, F.col("chain")).alias("key"), parent.alias("parent_key"), (F.coalesce("bytes_above", F.lit(0)) + F.col("before")).alias("before"), "bytes")


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, run): the SHA-256 of each key's runs, joined by commas."""
    key, state, keys, out = None, None, [], []
    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k == key and state is not None:
                state.update(b",")
            else:
                if state is not None:
                    keys.append(key)
                    out.append(state.hexdigest())
                key, state = k, sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "ends_sha256"])
        keys, out = [], []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def trie(members: DataFrame, paths: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row for every node of the trie of ``paths(conv_id, n, depth, digest, bytes)``.

    ``members(conv_id, n)`` names every conversation once, with the length of its path.  Columns:
    conv_id (the owner: the smallest member), depth, parent_conv_id (the parent's owner; null for the
    root), n_convs (members), n_children, n_leaves (childless nodes in its subtree), saved_tokens
    (over the subtree, each node's other members times the bytes of its last turn), ends_sha256
    (SHA-256 of the ids, ascending and joined by commas, of the members that end there).  Without
    members there is no node; with members that have no turn there is the root alone.
    """
    scratch = scratch or Scratch(members.sparkSession)
    at_root = members.select("conv_id", "n", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("part"), _root().alias("key"), F.lit(None).cast("binary").alias("parent_key"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("bytes"))
    seen = scratch.write(prefixes(paths, scratch).unionByName(at_root), "prefixes")
    scratch.drop("chained", "turns")
    nodes = scratch.write(seen.groupBy("key", "parent_key", "depth", "before").agg(F.min("conv_id").alias("owner"), F.max("n").alias("longest")), "nodes")

    # what each owner owns: its path from depth `first` on, and whether it ends in a leaf
    owned = nodes.groupBy("owner").agg(F.min(F.struct("depth", "before", "parent_key")).alias("top"), F.max((F.col("longest") == F.col("depth")).cast("int")).alias("leaf")).select(F.col("owner").alias("conv_id"), F.col("top.depth").alias("first"), F.col("top.before").alias("shared"), F.col("top.parent_key").alias("parent_key"), "leaf")
    root = nodes.where("depth = 0").select("owner").first()
    below = owned.where("first > 1").join(nodes.select(F.col("key").alias("parent_key"), F.col("owner").alias("above")), "parent_key")
    top = owned.where("first <= 1").withColumn("above", F.when(F.col("first") == 1, F.lit(root[0] if root else None).cast("long")))
    columns = ["conv_id", "first", "shared", "leaf", "above"]
    owned = below.select(columns).unionByName(top.select(columns))

    ends = seen.where("depth = n").select("conv_id", "n", "key", (F.col("before") + F.col("bytes")).alias("total"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("n") - 1) / BLOCK), F.lit(0))))
    info = ends.join(owned, "conv_id", "left").select("conv_id", parts.alias("part"), F.coalesce("first", F.col("n") + 1).alias("first"), F.coalesce("shared", "total").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"), "above")

    depth, first = F.col("depth"), F.col("first")
    sums = seen.join(info, ["conv_id", "part"]).groupBy("key", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        F.max(F.when(depth > first, F.col("conv_id")).when(depth == first, F.col("above"))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.sum(((depth + 1 >= first) & (depth < F.col("n"))).cast("long")).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(F.greatest(F.col("shared") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    runs = ends.groupBy("key", F.shiftright("conv_id", _RUN_BITS).alias("run")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    hashes = runs.repartition("key").sortWithinPartitions("key", "run").select("key", "ids").mapInArrow(_hash_lists, "key binary, ends_sha256 string")
    return sums.join(hashes, "key", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
