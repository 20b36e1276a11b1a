"""Cross-tokenizer alignment against whole texts encoded by the vocabularies' own libraries."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from tributary.llm import queries, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def brute(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), from byte ranges of whole encodings."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B)
    alphabet = token_alignment.byte_alphabet()
    a_bytes = {i: bytes(alphabet[c] for c in p) for p, i in a.get_vocab().items() if i != 50256}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def ranges(ids, spell):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(spell(i))))
            at += len(spell(i))
        return out

    rows, counts = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        x = ranges(a.encode(" " + text, add_special_tokens=False).ids, a_bytes.__getitem__)
        y = ranges(b.encode(text), piece)
        raw = (" " + text).encode()
        if b"".join(a_bytes[i] for i, _, _ in x) != raw or b"".join(piece(i) for i, _, _ in y) != raw:
            rows.append(None)
            continue
        cuts = sorted({e for _, _, e in x} & {e for _, _, e in y})
        groups, low = [], 0
        for cut in cuts:
            side = lambda z: [t for t in z if low <= t[1] and t[2] <= cut]  # noqa: E731, B023
            groups.append((side(x), side(y)))
            low = cut
        links = [(p[0], q[0]) for g, h in groups for p in g for q in h if p[1] < q[2] and q[1] < p[2]]
        counts.update(links)
        rows.append((x, y, groups, links))
    best = Counter()
    for (_, q), n in counts.items():
        best[q] = max(best[q], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        x, y, groups, links = r
        text = ";".join(f"{','.join(str(t[0]) for t in g)}|{','.join(str(t[0]) for t in h)}" for g, h in groups)
        out.append((len(x), len(y), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    None, "", " ", "  ", "\n", "a", "a ", " a", "a  b   c\n\nd\t\te \n f", "x  y \n z　 w", "\x0b q \x0c\x1c r\x85s", "it's we'll I'M 12345 1,000.50!!! --- ...", "<|endoftext|> </s> <s> <unk> <0x41>", "already ▁ marked▁",
    "emoji 😀👩‍👩‍👧 日本語のテキスト、切れ目なし 한국어", "ﬁ ① Å é é", "\r\n\r\n x\r y", "tab\tbed\t \tx", "nul\x00 byte\x01", "the cat the cat the cat", "the cat", "word" * 3000, "日本" * 2000, " " * 500 + "x" + "\n" * 300,
]


@pytest.mark.parametrize("limit", [token_alignment.BLOCK_BYTES, 40])
def test_alignment_of_odd_texts(spark, limit):
    texts = [*TEXTS, *TEXTS[:20]]
    docs = spark.createDataFrame([(i, t, "en", i, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_a int, block string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in token_alignment.align(docs, A, B, limit=limit).collect()}
    want = dict(enumerate(brute(texts)))
    assert {i: (texts[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op13_token_alignment(spark, SF).collect()}
    assert got == {d["doc_id"]: w for d, w in zip(docs, brute([d["text"] for d in docs]), strict=True)}


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, places int")
    out = token_alignment.align(none, A, B)
    assert out.columns == ["doc_id", "text", *COLUMNS] and out.count() == 0


def test_memory_of_stretches_is_bounded(monkeypatch):
    monkeypatch.setattr(token_alignment, "_MEMO_BYTES", 20_000)
    tools = token_alignment.Aligner(A, B)
    for k in range(30):
        tools.groups([f" w{k * 100 + i}" for i in range(100)] + [" the", " " + "日" * 200])
        assert len(tools.young) <= 60 and len(tools.old) <= 60
        assert " " + "日" * 200 not in tools.young
