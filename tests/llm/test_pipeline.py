"""The pipeline's stages against plain versions, each on its own input."""

import re

import corpus_pipeline
from tests.llm.test_llm import _brute_join, _check_packing
from tributary.llm import packing

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "near_copies", "secrets", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        if name == "near_copies":
            groups = _brute_join({r["doc_id"]: r["text"] for r in before.collect()})
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
        if name == "secrets":
            assert docs.count() == before.count()
            assert not any(re.search("[0-9a-f]{16}", r["text"] or "") for r in docs.collect())
    import public_tokenizers

    t = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "secrets")).collect()}
    ids = {i: [*t.library.encode(x or "", add_special_tokens=False).ids, 1] for i, x in texts.items()}
    assert _check_packing(docs.collect(), ids) < 0.03
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    language = spark.read.parquet(str(tmp_path / "language"))
    quality = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "quality")).select("doc_id").collect()}
    good = [r["doc_id"] for r in language.select("doc_id").collect() if labels.get(r["doc_id"]) == 1]
    assert sum(i in quality for i in good) >= 0.97 * len(good)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).toPandas()
    docs = rows.groupby("doc_id")
    assert (docs.length.sum() == docs.doc_tokens.first()).all() and (rows.length > 0).all()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {i: (n, c) for i, (n, c) in _brute_join({i: texts[i] for i in docs.groups}).items()}
    assert set(docs.groups) <= set(texts) and all(i == c for i, (_, c) in kept.items())


def test_texts_that_share_an_id_stay_together(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long), (1, "another text of the first document"), (1, long), (2, long), (3, "a text by itself"), (3, "a text by itself"), (None, long), (None, long), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.without_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=key) == sorted([(1, long), (1, "another text of the first document"), (3, "a text by itself"), (None, long), (None, long), (4, None), (5, "")], key=key)
    assert corpus_pipeline.without_near_copies(spark, docs.where("false"), SF).count() == 0


def test_documents_beside_a_component_meet_several_of_its_members_whole(spark):
    from tributary.llm import ngram_join

    meta = lambda pos: (((140 << 28) + pos) << 4) + 12
    rows = [(token, node, meta(token + 1), 1 if node < 9 else node, 8 if node < 9 else 1) for token in range(30) for node in (*range(1, 9), 90)]
    mine = spark.createDataFrame(rows, "token long, node long, meta long, component long, size long")
    met = ngram_join.next_stars(mine, 1).where("node = 90").groupBy("star").count().collect()
    assert len(met) > 1 and {r["count"] for r in met} == {30}
    assert ngram_join.crossings(mine) == (30, 30 * 7)


def test_last_step_tries_few_pairs_of_two_components_before_the_others(spark):
    from tributary.llm import ngram_join

    # nodes 100..102 beside a component of 50 that all meet it, and two nodes by themselves
    rows = [(a, b, 0, b) for a in range(50) for b in (100, 101, 102)] + [(200, 201, 200, 201)]
    pairs = spark.createDataFrame(rows, "a long, b long, ca long, cb long")
    first = ngram_join.some_of(pairs)
    got = {tuple(r) for r in first.collect()}
    assert got <= {r[:2] for r in rows} and (200, 201) in got
    assert all(1 <= sum(b == k for _, b in got) <= ngram_join._STARS for k in (100, 101, 102))
    # 100 and 101 joined; 102 did not, so all its other pairs stay
    labels = spark.createDataFrame([(k, 0) for k in (*range(50), 100, 101)], "node long, component long")
    left = sorted(tuple(r) for r in ngram_join.still_apart(pairs, labels, first).collect())
    assert left == sorted((a, 102) for a in range(50) if (a, 102) not in got)
