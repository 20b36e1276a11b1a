"""The registered queries: each applies one operator to its whole table and keeps what its contract asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_trie, embed_dedup, hamming_topk, langid, license_scan, ngram_join, packing, quality, secrets, sharding, token_alignment, toxicity
from ._shared import Scratch

#: Bytes a shard may hold, and the share of all bytes that is enough where the table is small.
SHARD_LIMIT, SHARDS = 64 << 20, 40


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _crc(col: str = "doc_id"):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang", (_crc() % 5 == 0).alias("held_out"))
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_documents(spark, sf_dir), keep=["doc_id"])
    base = F.filter("notices", lambda x: x["base"])
    places = F.transform(base, lambda x: x["first_word"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("notices")).alias("labels"),
        F.coalesce(F.array_max(F.transform("notices", lambda x: 1.0 - x["edits"] / F.length(x["phrase"]))), F.lit(0.0)).alias("score"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), keep=["doc_id"], with_ids=False)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_documents(spark, sf_dir))


def op7_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming_topk.sign_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hamming_topk.topk(codes, codes.where("id % 50 = 0")).withColumnRenamed("id", "vec_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", (_crc() % 3 == 1).alias("held_out"))
    model = quality.train(docs.where("not held_out"), spark.read.parquet(f"{sf_dir}/labels.parquet").where(_crc() % 3 != 1))
    return quality.score(docs, model, keep=["doc_id", "held_out"])


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return sharding.shard(rows, limit=max(1, min(SHARD_LIMIT, total // SHARDS))).select("doc_id", "shard", "depth", "shard_bytes")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_documents(spark, sf_dir), keep=["doc_id"])
    base = F.filter("secrets", lambda x: x["base"])
    kind = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return found.select("doc_id", kind("assign"), kind("access"), kind("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", (_crc() % 4 == 2).alias("held_out"))
    model = toxicity.train(docs.where("not held_out"), spark.read.parquet(f"{sf_dir}/labels.parquet").where(_crc() % 4 != 2), corpus=docs)
    return toxicity.score(docs, model, keep=["doc_id", "held_out"])


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    turns = conversation_trie.ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_trie.trie(*conversation_trie.with_shared_heads(turns, scratch), scratch)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), keep=["doc_id"])


QUERIES = {f.__name__: f for f in (op1_language_id, op2_license_scan, op3_byte_bpe, op4_packing, op5_embedding_dedup, op6_ngram_join, op7_hamming_topk, op8_quality, op9_sharding, op10_secret_scan, op11_toxicity, op12_conversation_trie, op13_token_alignment)}

#: The rest is tested against brute force: their methods, models or whole-table cost are beyond SQL.
ORACLES = {
    "op9_sharding": f"""
WITH rows AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n,
                     ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
     most AS (SELECT greatest(1, least({SHARD_LIMIT}, sum(n) // {SHARDS})) AS bytes FROM rows),
     sums AS (SELECT d, h >> (60 - d)::INT AS prefix, sum(n)::BIGINT AS bytes FROM rows, range(0, 61) t(d) GROUP BY ALL),
     fit AS (SELECT doc_id, h, coalesce(min(d) FILTER (sums.bytes <= most.bytes), 60) AS depth FROM rows, most, range(0, 61) t(d)
             JOIN sums USING (d) WHERE sums.prefix = rows.h >> (60 - d)::INT GROUP BY doc_id, h)
SELECT f.doc_id, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(f.h >> (60 - depth)::INT), 60, '0'), depth::INT) END AS shard,
       depth::INT AS depth, s.bytes AS shard_bytes
FROM fit f JOIN sums s ON s.d = f.depth AND s.prefix = f.h >> (60 - f.depth)::INT
""",
    # paths are compared turn by turn and subtrees summed from all their nodes; CRC-32 bit by bit
    "op12_conversation_trie": """
WITH turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r,
                      {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
     convs AS (SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                 lambda s, x: list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384::BIGINT * (a & 1)))), 4294967295::BIGINT) % 9 AS h
               FROM turns GROUP BY c),
     built AS (SELECT convs.c, r, t FROM convs JOIN turns ON turns.c = base AND r <= h
               UNION ALL SELECT convs.c, 100 + r, t FROM convs JOIN turns ON turns.c = convs.c AND r > h),
     paths AS (SELECT c, coalesce(list(t ORDER BY r) FILTER (t IS NOT NULL), []) AS p FROM convs LEFT JOIN built USING (c) GROUP BY c),
     members AS (SELECT c, d, p[1:d] AS p, d = len(p) AS ends FROM paths, unnest(range(0, len(p) + 1)) u(d)),
     nodes AS (SELECT d, p, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ended,
                      CASE WHEN d > 0 THEN octet_length(encode(p[d].text)) ELSE 0 END AS bytes FROM members GROUP BY d, p),
     children AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
     under AS (SELECT nodes.p[1:a] AS p, sum((nodes.n - 1) * bytes) AS saved, count(*) FILTER (children.n IS NULL) AS leaves
               FROM nodes LEFT JOIN children ON children.p = nodes.p, unnest(range(0, d + 1)) u(a) GROUP BY ALL)
SELECT x.c AS conv_id, x.d AS depth, up.c AS parent_conv_id, x.n AS n_convs, coalesce(children.n, 0) AS n_children, leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(x.ended) AS ends_sha256
FROM nodes x JOIN under ON under.p = x.p LEFT JOIN children ON children.p = x.p LEFT JOIN nodes up ON x.d > 0 AND up.d = x.d - 1 AND up.p = x.p[1:x.d - 1]
""",
}
