"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tributary.llm import bpe, embed_dedup, hamming_topk, langid, license_scan, ngram_join, packing, quality, queries, secrets, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    long = "the quick brown fox " * 20_000
    data = [(1, None, "en", 0), (2, "", None, 1), (3, "Hello world, ça va?", "fr", 2), (3, "Hello world, ça va?", "fr", 2), (None, "abc def", "en", 3), (4, long, "en", 4), (5, "1234 !!!", "en", 5)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, score int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, score int")


# ---- language ------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, docs):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_code_lengths_are_probabilities(docs):
    model = langid.train(docs)
    size = int(model.codes.max()) + 1
    p = np.exp2(-model.bits.reshape(-1, size, len(model.langs)).astype(float))
    rest = 256 - len(np.unique(np.flatnonzero(model.codes < size - 1)))
    assert np.allclose(p[:, :-1].sum(1) + rest * p[:, -1], 1.0, atol=1e-4)
    data = np.frombuffer("où est la gare".encode(), np.uint8)
    whole = langid.code_lengths(model, data, np.array([0, len(data)]))
    two = langid.code_lengths(model, np.concatenate([data, data]), np.array([0, len(data), 2 * len(data)]))
    assert np.allclose(two, np.vstack([whole, whole]))


def test_language_cases(docs, odd, none):
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[5]["lang_pred"] == "und" and got[5]["score"] == 0.0
    assert langid.predict(none, model).count() == 0
    assert langid.predict(odd, langid.train(none)).where("lang_pred <> 'und'").count() == 0


# ---- licences ------------------------------------------------------------------------------------

_W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _base_places(text):
    words = _W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    out = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), out


def _check_licences(rows, texts):
    for r in rows:
        n, places = _base_places(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"]) == (n, len(places)), r
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert {x for _, x in places} <= set(r["labels"].split(",")) | {""}


def test_licences_match_brute_force(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    _check_licences(queries.op2_license_scan(spark, SF).collect(), texts)


def test_licences_planted(spark):
    rng = random.Random(5)
    bits = ["cc", "BY", "-", " ", "\n", "general", "Public", "license", "all", "rights", "reserved", "é", "x1", ".", "GENERAL PUBLIC LICENSE", "All  Rights--Reserved", "licence"]
    texts = {i: "".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 40))) for i in range(300)}
    scanner = license_scan.Scanner()
    blob = [t.encode() for t in texts.values()]
    at = np.concatenate([[0], np.cumsum([len(b) for b in blob])])
    n, spans, counts = license_scan.scan_block(scanner, np.frombuffer(b"".join(blob), np.uint8), at)
    k = 0
    for i, text in texts.items():
        mine, k = spans[k : k + counts[i]], k + counts[i]
        want_n, places = _base_places(text)
        assert n[i] == want_n and sorted((s["first_word"], s["label"]) for s in mine if s["base"]) == sorted(places), text


def test_licences_fuzzy(spark):
    d = spark.createDataFrame([(1, "All rihgts reserved."), (2, "GNU General Publik License"), (3, "nothing here")], "doc_id long, text string")
    got = {r["doc_id"]: [(x["label"], x["edits"], x["base"]) for x in r["notices"]] for r in license_scan.scan(d).collect()}
    assert ("reserved", 2, False) in got[1] and ("gpl", 1, False) in got[2] and got[3] == []


def test_licence_cases(odd, none):
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(none).count() == 0


# ---- tokens --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f)
    return bpe.Tokenizer(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(reference):
    own, lib = reference
    rng = random.Random(1)
    tokens = list(own.machine.ranks)
    alphabet = "ab ce\n th'ſ\x1c\x85 ²½é中\t　-----====="
    texts = [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 8))).decode(errors="replace") for _ in range(2000)]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24))) for _ in range(3000)] + ["thonly" * 400 + "-" * 900, ""]
    ids, counts = own.encode_batch(texts)
    at = np.concatenate([[0], np.cumsum(counts)])
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [lib.encode_ordinary(t) for t in texts]
    data, sizes = own.decode(ids, counts)
    assert data.tobytes() == "".join(texts).encode() and sizes.sum() == len(data)


def test_bpe_settles_early(reference):
    own, lib = reference
    machine = bpe.Transducer(own.machine.ranks, horizon=8)
    piece = b"thonlyaing" * 50
    assert machine.encode_piece(piece) == lib.encode_ordinary(piece.decode())


def test_utf8_machine():
    rng = random.Random(2)
    for _ in range(3000):
        b = bytes(rng.choice([rng.randint(0, 255), rng.randint(0x80, 0xBF), 0xE0, 0xED, 0xF0, 0xF4, 0xC2, 65]) for _ in range(8))
        m = bpe.Utf8Machine()
        assert m.feed(b[:3]) + m.feed(b[3:5]) + m.feed(b[5:]) + m.close() == b.decode(errors="replace")


def test_bpe_query(spark, docs, reference):
    _, lib = reference
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in queries.op3_byte_bpe(spark, SF).collect():
        ids = lib.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_cases(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = bpe.encode(odd, path, public_tokenizers.PATTERN).collect()
    assert all(len(r["ids"]) == 0 for r in got if not r["text"]) and all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in got)
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0


# ---- packing -------------------------------------------------------------------------------------


def test_word_tokenizer_equals_the_library():
    t = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    alphabet = [*"ab C Éé\n th'ſs\x1c\x85 ²½é中Σς\t　-!.İ́̀ﬁ1", "<|endoftext|>", "'ll", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    ids, counts = t.encode_batch(texts)
    at = np.concatenate([[0], np.cumsum(counts)])
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [t.library.encode(x, add_special_tokens=False).ids for x in texts]


def test_fast_engine_merges_as_the_vocabulary_does():
    t = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert t.fast is not None
    words = [w.removesuffix("</w>") for w in list(t.library.get_vocab())[::7] if w.endswith("</w>") and packing._PLAIN.fullmatch(w.removesuffix("</w>"))]
    ids, sizes = t._encode(words)
    at = np.concatenate([[0], np.cumsum(sizes)])
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(words))] == [t.library.encode(w, add_special_tokens=False).ids for w in words]


def test_cuts_are_optimal():
    rng = random.Random(4)
    plan = packing.Plan(size=128, window=1.0)
    for _ in range(200):
        m = rng.randint(1, 40)
        cuts = np.concatenate([[0], np.cumsum([rng.randint(1, 100) for _ in range(m)])])
        pen = np.array([rng.choice([0, 2.0, 24.0]) for _ in cuts])
        best = [0.0] + [1e9] * m
        for j in range(1, m + 1):
            for i in range(j):
                n = int(cuts[j] - cuts[i])
                if n <= 128:
                    best[j] = min(best[j], best[i] + (0 if n & (n - 1) == 0 else 128 - n) + pen[j] + 1.0)
        chosen, cost = packing.best_cuts(cuts, pen, plan)
        assert cost == pytest.approx(best[-1]) and chosen[0] == 0 and chosen[-1] == m


def _check_packing(rows, ids_of):
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for i, ids in ids_of.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["length"] > 0
            at += r["length"]
        assert at == len(ids)
    waste = total = 0
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += at
        waste += 0 if at & (at - 1) == 0 else 2048 - at
    return waste / max(total, 1)


def test_packing_query(spark, docs):
    t = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: [*t.library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    assert _check_packing(queries.op4_packing(spark, SF).collect(), ids) < 0.02


def test_packing_cases(spark, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(odd.dropDuplicates(["doc_id"]), path).collect()
    one = [r for r in got if r["doc_id"] in (1, 2)]
    assert [(r["length"], r["ids"]) for r in one] == [(1, [1]), (1, [1])]
    assert sum(r["length"] for r in got if r["doc_id"] == 4) == 80_001
    assert packing.pack(none, path).count() == 0


# ---- embeddings ----------------------------------------------------------------------------------


def _vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    x = [base[i % 12] + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.06]) for i in range(160)]
    data = [(i, [float(np.float32(v)) for v in x[i]], int(i % 3)) for i in range(160)]
    data += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, data[3][1], None), (904, data[4][1], data[4][2]), (905, [None] + [1.0] * 15, 0), (906, [1.0] * 4, 0)]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("tile", [7, 4096])
def test_embeddings_match_brute_force(spark, tile):
    data, df = _vectors(spark)
    sound = {i: (np.array(v, float), y) for i, v, y in data if v and y is not None and None not in v and np.isfinite(v).all() and any(v)}
    near = {i: {j for j, (w, z) in sound.items() if j != i and z == y and len(w) == len(v) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98} for i, (v, y) in sound.items()}
    root = {i: i for i, _, _ in data}
    moved = True
    while moved:
        moved = False
        for i, js in near.items():
            low = min([root[i], *(root[j] for j in js)])
            moved, root[i] = moved or low != root[i], low
    for r in embed_dedup.near_duplicates(df, tile=tile).collect():
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(near.get(i, ())), root[i], root[i] == i)
    assert sum(map(len, near.values())) > 100
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_quantisation_bound():
    x = np.random.default_rng(1).normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e, h = embed_dedup.quantise(x)
    dot = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None]
    assert (np.abs(x @ x.T - dot) <= e[:, None] + h[:, None] * e[None] + 1e-12).all()


# ---- n-gram join ---------------------------------------------------------------------------------


def _brute_join(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in held[g]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            held[g].append(i)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_join_matches_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = {}
    base = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(12)]
    for i in range(240):
        w = list(base[i % 12])
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.2:
            w += passage
        texts[i] = rng.choice([" ", "\n", " \t"]).join(w)
    texts |= {500: None, 501: "", 502: " \n ", 503: "One two", 504: "one TWO", 505: "one two three four five"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df).collect()}
    assert got == _brute_join(texts)


def test_join_cases(spark, odd, none):
    got = ngram_join.join(odd).collect()
    assert len(got) == odd.count() and [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert ngram_join.join(none).count() == 0


# ---- search --------------------------------------------------------------------------------------


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64))
    x[100:180] = x[5]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(300)] + [(999, None)], "vec_id long, embedding array<float>")
    codes = hamming_topk.sign_codes(df)
    got = defaultdict(list)
    for r in hamming_topk.topk(codes, codes.where("id % 50 = 0"), k=10, shard=64, block=2).collect():
        got[r["query_id"]].append((r["rank"], r["id"], r["distance"]))
    bits = x >= 0
    for q in range(0, 300, 50):
        far = (bits != bits[q]).sum(1)
        want = [(k + 1, int(i), int(far[i])) for k, i in enumerate(np.lexsort((np.arange(300), far))[:10])]
        assert sorted(got[q]) == want
    assert hamming_topk.topk(codes.limit(0), codes.limit(0)).count() == 0
    assert hamming_topk.topk(codes.where("id < 4"), codes.where("id = 0"), k=10).count() == 4


# ---- quality -------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    got = queries.op8_quality(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality"), "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_cases(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    assert quality.score(odd, quality.train(odd, labels)).count() == odd.count()
    blank = quality.train(none, labels)
    assert [r["score"] for r in quality.score(odd.limit(1), blank).collect()] == [0.5] and quality.score(none, blank).count() == 0


# ---- sharding ------------------------------------------------------------------------------------


def test_sharding(spark, docs):
    rows = docs.select("doc_id", "text")
    got = sharding.shard(rows, limit=60_000).selectExpr("doc_id", "shard", "depth", "shard_bytes", "octet_length(text) as n").toPandas()
    sizes = got.groupby("shard").n.sum()
    assert sizes.max() <= 60_000 and (got.groupby("shard").shard_bytes.first() == sizes).all()
    for shard in sizes.index:  # no split that wasn't needed
        kin = [s for s in sizes.index if s.startswith(shard[:-1])]
        assert not shard or sizes[kin].sum() > 60_000


def test_sharding_cases(spark, odd, none):
    assert sharding.shard(odd).count() == odd.count() and sharding.shard(none).count() == 0
    hot = spark.range(500).select((F.col("id") % 2).alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"), F.col("id").alias("depth"))
    got = sharding.shard(hot, limit=5000).toPandas()
    assert len(got) == 500 and (got.groupby("shard").size() * 100).max() <= 5000


# ---- secrets -------------------------------------------------------------------------------------

_PATTERNS = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))


def _base_secrets(text):
    out = []
    for k, (kind, p) in enumerate(_PATTERNS):
        for m in p.finditer(text or ""):
            if (len(m[2]) >= 12) if kind == "assign" else (len(m[0]) >= (18 if kind == "access" else 16)):
                out.append((m.start(), k, m.end()))
    return [f"{_PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(out)]


def test_secrets_match_brute_force(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op10_secret_scan(spark, SF).collect():
        want = _base_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) | {""}


def test_secrets_planted(spark):
    rng = random.Random(8)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "AKIA", "ABCDEFGHIJKLMN123", "deadbeef", "0123456789abcdef", "é", "x", "+/_.=-", "\n"]
    texts = {i: "".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for i in range(500)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in secrets.scan(df).collect():
        got = [f"{x['kind']}:{x['start']}:{x['stop']}" for x in r["secrets"] if x["base"]]
        assert got == _base_secrets(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_secrets_are_confirmed():
    import base64
    import json

    enc = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    jwt = f"{enc({'alg': 'HS256', 'typ': 'JWT'})}.{enc({'sub': '1'})}.c2lnbmF0dXJlc2lnbmF0dXJl"
    der = bytes([0x30, 0x26, 0x02, 0x01, 0x00, 0x04, 0x21]) + bytes(range(33))
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(range(32))))
    text = f"é {jwt} and {base64.b64encode(der).decode()} or {base64.b64encode(ssh).decode()} not {'QUJD' * 20} {der.hex()}"
    data = np.frombuffer(text.encode(), np.uint8)
    spans, _ = secrets.scan_block(data, np.array([0, len(data)]))
    assert [s["kind"] for s in spans if not s["base"]] == ["jwt", "der", "ssh", "der"]
    assert text[spans[0]["start"] : spans[0]["stop"]] == jwt


def test_secret_cases(odd, none):
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(none).count() == 0
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(odd).collect()}
    assert clean[1] is None and clean[3] == "Hello world, ça va?"


def test_redact(spark):
    d = spark.createDataFrame([(1, 'ça token = "0123456789abcdef0123" fin', 5)], "doc_id long, text string, n_chars long")
    r = secrets.redact(d).first()
    assert r["text"] == 'ça [secret]" fin' and r["n_chars"] == len(r["text"])
