"""Models against plain versions, and searches and shards on hard cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tributary.llm import embed_dedup, hamming_topk, langid, quality, queries, sharding


def _grams(texts):
    """(three bytes before, byte) with their counts; a text stands after line feeds."""
    out = Counter()
    for t in texts:
        b = b"\n\n\n" + t.encode()
        for i in range(3, len(b)):
            out[b[i - 3 : i], b[i]] += 1
    return out


class _Plain:
    """A coder that walks the contexts byte by byte, from the longest held to the shortest."""

    def __init__(self, texts_of, least=2):
        grams = {lang: _grams(t) for lang, t in texts_of.items()}
        self.seen = {b for g in grams.values() for _, b in g}
        total = {lang: sum(g.values()) for lang, g in grams.items()}
        pooled = Counter()
        self.after = {lang: defaultdict(Counter) for lang in grams}
        for lang, g in grams.items():
            for (ctx, b), n in g.items():
                for k in range(4):
                    key = self.named(ctx[3 - k :])
                    self.after[lang][key][b] += n
                    pooled[key] += n * max(total.values()) / total[lang]
        self.held = {c for c, n in pooled.items() if len(c) < 2 or n >= least - 1e-9}

    def named(self, ctx):
        return tuple(b if b in self.seen else -1 for b in ctx)

    def cost(self, lang, text):
        b = b"\n\n\n" + text.encode()
        bits = 0.0
        for i in range(3, len(b)):
            ctx, gone = self.named(b[i - 3 : i]), set()
            while len(ctx) >= 2 and ctx not in self.held:
                ctx = ctx[1:]
            while True:
                here = {s: n for s, n in self.after[lang].get(ctx, {}).items() if s not in gone}
                whole, kinds = sum(here.values()), len(here)
                if b[i] in here:
                    bits -= math.log2(here[b[i]] / (whole + kinds))
                    break
                if kinds:
                    bits -= math.log2(kinds / (whole + kinds))
                gone |= here.keys()
                if not ctx:
                    bits += math.log2(256 - len(self.after[lang][()]))
                    break
                ctx = ctx[1:]
        return bits


def test_code_lengths_equal_a_plain_coder():
    rng = random.Random(21)
    words = {"a": ["the", "cat", "and", "mat", "é"], "b": ["le", "chat", "où", "et"], "c": ["das", "und", "Maß"]}
    texts = {x: [" ".join(rng.choice(w) for _ in range(rng.randint(1, 9))) for _ in range(3 + 4 * k)] for k, (x, w) in enumerate(words.items())}
    rows = [(lang, int.from_bytes(bytes([*ctx, b]), "big"), n) for lang, t in texts.items() for (ctx, b), n in _grams(t).items()]
    table = pa.table({"lang": [r[0] for r in rows], "gram": [r[1] for r in rows], "n": [r[2] for r in rows]})
    model, plain = langid.compile_model(table), _Plain(texts)
    for text in [*(t for x in texts.values() for t in x), "the chat und zebra", "ÿx\n\n", "q", "1"]:
        data = np.frombuffer(text.encode(), np.uint8)
        got = langid.code_lengths(model, data, np.array([0, len(data)]))[0]
        assert got.tolist() == pytest.approx([plain.cost(x, text) for x in model.langs], rel=1e-5)


def test_every_language_and_byte_is_learned(spark):
    rows = [(k, f"{chr(0x100 + 7 * k)} {chr(0x4E00 + 99 * k)}abc " * 5, f"l{k:03}") for k in range(90)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted(r[2] for r in rows)
    seen = {b for r in rows for b in r[1].encode()}
    assert len({int(model.codes[b]) for b in seen}) == len(seen)


def test_equal_code_lengths_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(k, "same words here", x) for k, x in enumerate("zyx")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(docs)).collect()} == {"x"}


def test_classifier_equals_a_plain_dual_solver():
    rng = np.random.default_rng(22)
    y = rng.integers(0, 2, 60)
    rows = [np.unique(np.concatenate([rng.integers(0, 30, 6), 40 + rng.integers(0, 6, 2) + 6 * label])).astype(np.int32) for label in y]
    model = quality.fit(rows, y, epochs=3000)
    x = np.zeros((60, 60))
    for k, r in enumerate(rows):
        x[k, r] = 1.0
    up, down = x[y == 1].sum(0) + 1.0, x[y == 0].sum(0) + 1.0
    ratio = np.log(up / ((y == 1).sum() + 2.0)) - np.log(down / ((y == 0).sum() + 2.0))
    z = x * ratio
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    sign = np.where(y == 1, 1.0, -1.0)
    cap = np.where(y == 1, 60 / (2 * (y == 1).sum()), 60 / (2 * (y == 0).sum()))
    q = (z @ z.T + 1.0) * sign[:, None] * sign[None, :]
    alpha = np.zeros(60)
    for _ in range(200_000):  # projected gradient
        alpha = np.clip(alpha - (q @ alpha - 1.0) / np.linalg.norm(q, 2), 0.0, cap)
    want = z @ ((alpha * sign) @ z) + (alpha * sign).sum()
    got = quality.margins(model, np.concatenate(rows), np.array([len(r) for r in rows]))
    assert got == pytest.approx(want, abs=0.01)


def test_search_over_many_shards_and_repeated_rows(spark):
    rng = np.random.default_rng(23)
    x = rng.integers(0, 1 << 16, (500, 3))
    x[200:260] = x[7]
    rows = [(i, x[i].tolist()) for i in range(500)]
    codes = spark.createDataFrame(rows + rows[:50], "id long, code array<int>")
    got = defaultdict(list)
    for r in hamming_topk.topk(codes, codes.where("id % 50 = 0 or id = 7"), k=7, shard=40, block=3).collect():
        got[r["query_id"]].append((r["rank"], r["id"], r["distance"]))
    for q in [*range(0, 500, 50), 7]:
        far = np.bitwise_count((x ^ x[q]).astype(np.uint16)).sum(1)
        assert sorted(got[q]) == [(k + 1, int(i), int(far[i])) for k, i in enumerate(np.lexsort((np.arange(500), far))[:7])]


def test_links_at_the_threshold_are_symmetric():
    rng = np.random.default_rng(24)
    a = rng.normal(size=(300, 16))
    a[150:] = a[:150] + rng.normal(size=(150, 16)) * 1e-3
    u = a / np.linalg.norm(a, axis=1, keepdims=True)
    edge = float((u[0] * u[150]).sum())  # exactly the cosine of a pair
    found = {(lo + int(r), int(c)) for lo, rs, cs in embed_dedup.tile_links(a, a, edge, True) for r, c in zip(rs, cs, strict=True)}
    assert (0, 150) in found and all((c, r) in found for r, c in found)
    back = {(int(c), lo + int(r)) for lo, rs, cs in embed_dedup.tile_links(a[150:], a[:150], edge, False) for r, c in zip(rs, cs, strict=True)}
    assert {(r, c - 150) for r, c in found if r < 150 <= c} == back


def test_sharding_splits_as_its_sql_says(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(queries.ORACLES["op9_sharding"]).fetchall()}
    got = {r["doc_id"]: (r["shard"], r["depth"], r["shard_bytes"]) for r in queries.op9_sharding(spark, folder).collect()}
    assert got == want and len({r[0] for r in got.values()}) > 20


def test_sharding_of_single_rows_and_keys_above_the_limit(spark):
    rows = [(1, "x" * 900), (2, "y" * 10), (3, "y" * 10)] + [(4, "z" * 30)] * 40 + [(None, "é" * 20)] * 3
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), limit=200).withColumn("n", F.octet_length("text")).toPandas()
    sizes = got.groupby("shard").n.sum()
    assert len(got) == len(rows) and (got.groupby("shard").shard_bytes.first() == sizes).all()
    assert (sizes > 200).sum() == 1 and got[got.doc_id == 1][["depth", "shard_bytes"]].values.tolist() == [[60, 900]]


def test_many_languages_with_all_bytes_keep_longer_contexts():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    langs, grams, counts = [], [], []
    for k in range(80):
        own = rng.integers(0, 240, (400, 4), dtype=np.int64)
        own[:240, 0] = np.arange(240)
        for g in (own << np.array([0, 8, 16, 24])).sum(1):
            langs.append(f"l{k:02d}")
            grams.append(int(g))
            counts.append(int(rng.integers(1, 50)))
    table = pa.table({"lang": langs, "gram": grams, "n": counts}).group_by(["lang", "gram"]).aggregate([("n", "sum")]).rename_columns(["lang", "gram", "n"])
    model = langid.compile_model(table)
    size = int(model.codes.max()) + 1
    assert size == 241 and len(model.langs) == 80
    contexts = len(model.bits) // size
    assert contexts > size + 1 and contexts * size * 80 <= 200_000 * 80
    p = np.exp2(-model.bits.reshape(contexts, size, 80).astype(float))
    assert np.allclose(p[:, :-1].sum(1) + 16 * p[:, -1], 1.0, atol=1e-3)
    tight = langid.compile_model(table, 1000, 10)
    assert len(tight.bits) // size == size + 1


def test_quality_reaches_the_driver_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"good words stand here {i} {'x' * (i % 7)}" if i % 2 else f"BAD {i} !! bad" if i else "") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) as quality")
    monkeypatch.setattr(type(docs), "toArrow", None)
    model = quality.train(docs, labels)
    monkeypatch.undo()
    rows = docs.collect()
    feats = [quality.features(np.frombuffer((t := r["text"].encode()), np.uint8), np.array([0, len(t)]))[0] for r in rows]
    for x in feats:
        assert quality.unpacked(quality.packed(x)).tolist() == x.tolist() and quality.unpacked(quality.packed(x)).dtype == x.dtype
    order = np.argsort([zlib.crc32(x.tobytes()) for x in feats], kind="stable")
    want = quality.fit([feats[i] for i in order], np.array([rows[i]["doc_id"] % 2 for i in order]))
    assert model.bias == want.bias and np.array_equal(model.weights, want.weights) and np.array_equal(model.squares, want.squares)
