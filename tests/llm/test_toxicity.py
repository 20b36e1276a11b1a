"""Toxicity: lattices against all readings, the classifier on held-out and disguised documents, odd rows."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tributary.llm import queries, toxicity

SF = "/root/testdata/sf0.01"
WORDS = ["loser", "idiot", "pathetic", "scum", "worthless", "moron", "clown", "trash", "disgusting", "stupid"]


@pytest.fixture(scope="module")
def grams(spark):
    return toxicity.language_model(spark.read.parquet(f"{SF}/documents.parquet"))


def test_counts_of_symbols(spark):
    texts = ["Ab é", "", "x", "Çab 日本"]
    signs = []
    for t in texts:
        signs += [0, 0, 0, *[ord(c.lower()) - 96 if c.isascii() and c.isalpha() else 27 if c > "\x7f" else 0 for c in t]]
    want = np.zeros([28] * 4)
    for k in range(len(signs) - 2):
        want[tuple([*signs, 0][k : k + 4])] += 1
    _, _, data, at = next(toxicity.blocks(pa.array(texts)))
    assert (toxicity.count_grams(data, at).reshape([28] * 4) == want).all()
    p = np.exp(toxicity.language_model(spark.createDataFrame([(t,) for t in [*texts, None]], "text string")).reshape([28] * 4))
    assert np.allclose(p.sum(-1), 1) and p[0, 0, 1, 2] > 10 * p[0, 0, 1, 3]


def test_viterbi_is_the_best_reading(grams):
    tool = toxicity.Restorer(grams)
    logp = grams.reshape([28] * 4)
    for region, apart in [("1d10t", False), ("m0rr0n", False), ("s.c.u.m", True), ("5tup1d", False), ("l00ser", False), ("i d 1 o t", True), ("tr4ssh", False)]:
        best, top = None, -np.inf
        for way in itertools.product(*tool._slots(region, apart)):
            context, total = (0, 0, 0), 0.0
            for symbol, _, cost in way:
                total -= cost
                if symbol >= 0:
                    total += logp[(*context, symbol)]
                    context = (*context[1:], symbol)
            total += logp[(*context, 0)]
            if total > top:
                best, top = "".join(ch for _, ch, _ in way), total
        assert tool._decode(region, apart) == best


def test_disguised_words_come_back(grams):
    tool = toxicity.Restorer(grams)
    swap = {"o": "0", "i": "1", "e": "3", "a": "@", "s": "$"}
    for w in WORDS:
        inner = w[0] + "".join(swap.get(c, c) for c in w[1:-1]) + w[-1]
        for way in (inner, " ".join(w), ".".join(w), "-".join(w.upper()), w[:2] + w[1] * 3 + w[2:], w[:3] + "​" + w[3:]):
            assert w in tool.text(f"The {way} of.").lower(), way


def test_plain_text_stays(grams, spark):
    tool = toxicity.Restorer(grams)
    for t in ["", "I", "a committee of 12 at 10:30, 3.5 %", "été çà où naïve Straße", "A B", "https://example.org/path?x=1", "--- *** !!!", "and $$$ 100 +++", "Да, это текст."]:
        assert tool.text(t) == t


def test_suspects_miss_nothing(grams):
    rng = random.Random(3)
    alphabet = "ab io1 0@$*.-_é​а­€  |LL3"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    array = pa.array(texts)
    for _, _, data, at in toxicity.blocks(array, 1 << 30):
        found = set(toxicity.suspects(data, at).tolist())
        break
    want = {k for k, t in enumerate(texts[: len(at) - 1]) if toxicity._DISGUISED.search(t)}
    assert want <= found
    tool = toxicity.Restorer(grams)
    assert toxicity.restored(array, tool).to_pylist() == [tool.text(t) for t in texts]


def test_fit_is_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.random((80, 6)) < 0.3
    y = (x[:, 0] | (rng.random(80) < 0.1)).astype(float)
    rows, places = np.nonzero(x)
    w, b = toxicity.fit(rows, places, y, 6)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + 0.1 * w).max() < 1e-3 and abs((p - y).sum() + 1e-3 * b) < 1e-3
    assert w[0] == max(w)


def test_held_out_and_disguised(spark):
    docs = spark.read.parquet("/root/testdata/check_s/documents.parquet").where("doc_id % 7 = 0").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/check_s/labels.parquet")
    model = toxicity.train(docs.where("doc_id % 4 <> 2"), labels, corpus=docs)
    got = toxicity.score(docs.where("doc_id % 4 = 2"), model).join(labels, "doc_id").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()
    assert got[got.toxic == 1].predicted.mean() > 0.97 and got[got.toxic == 0].predicted.mean() < 0.01
    clean = [r["text"] for r in docs.join(labels, "doc_id").where("toxic = 0 and length(text) between 200 and 2000").limit(40).collect()]
    made = [(k, t[:100] + " y0u st0p " + w[0] + w[1:-1].replace("o", "0").replace("i", "1").replace("e", "3").replace("u", "*").replace("a", "@") + w[-1] + " " + t[100:]) for k, (t, w) in enumerate(zip(clean, WORDS * 4, strict=False))]
    got = toxicity.score(spark.createDataFrame(made, "doc_id long, text string"), model, with_text=True).toPandas()
    assert got.predicted.mean() >= 0.9
    assert all(w in t for t, w in zip(got.sort_values("doc_id").restored, WORDS * 4, strict=False))


def test_odd_rows(spark):
    schema = "doc_id long, text string, score int, predicted string, lang string"
    rows = [(1, None, 1, "x", None), (2, "", 2, "y", "en"), (3, "you idiot " * 20_000, 3, "z", "en"), (3, "you idiot " * 20_000, 3, "z", "en"), (None, "a clean text", 4, "w", None), (5, "i" * 100_000 + "1d1" * 2000, 5, "v", "en")]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(3, 1), (3, 1), (2, 0), (1, None), (5, 0), (None, 1), (7, 0), (7, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels))
    assert out.columns == ["doc_id", "text", "lang", "score", "predicted"]
    got = [(r["doc_id"], r["score"]) for r in out.collect()]
    assert len(got) == 6 and all(0 <= s <= 1 for _, s in got) and min(s for i, s in got if i == 3) > 0.3 > max(s for i, s in got if i in (1, 2))
    empty = docs.where("false")
    for some, said, level in ((empty, labels, 0), (docs, labels.where("toxic = 1"), 1), (docs, labels.where("false"), 0)):
        model = toxicity.train(some, said)
        assert [round(r["score"]) for r in toxicity.score(docs, model, keep=["doc_id"]).collect()] == [level] * 6
    assert toxicity.score(empty, model).count() == 0


def test_query(spark):
    got = queries.op11_toxicity(spark, SF).toPandas()
    assert len(got) == 1000 and {"doc_id", "held_out", "score", "predicted"} <= set(got.columns)
