"""Scans of long texts, the decoder's state machine, and the join against brute force on hard cases."""

import base64
import json
import random
import re
import time
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest

from tributary.llm import bpe, license_scan, ngram_join, secrets
from tributary.llm._text import span_hashes, table, word_spans


def _secrets(text):
    data = np.frombuffer(text if isinstance(text, bytes) else text.encode(), np.uint8)
    return secrets.scan_block(data, np.array([0, len(data)]))[0]


def _licences(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return license_scan.scan_block(license_scan.Scanner(), data, np.array([0, len(data)]))[1]


@pytest.mark.parametrize("unit", [b"0123456789abcdef", b"A", b"AAAA-", b"aaaaaaaa.", b"A" * 64 + b"\n", b"-----BEGIN X-----AAAAAAAAAA\n", b"eyJhbGciOiJIUzI1NiJ9."])
def test_secrets_take_time_in_proportion(unit):
    began = time.process_time()
    _secrets(unit * (10_000_000 // len(unit)))
    assert time.process_time() - began < 20


@pytest.mark.parametrize("unit", ["all rihgts reserved ", "all rights reserved ", "permission is herby granted free of chage ", "licensed under "])
def test_licences_take_time_in_proportion(unit):
    began = time.process_time()
    got = _licences(unit * 20_000)
    assert time.process_time() - began < 20
    assert len(got) == (0 if unit == "licensed under " else 20_000)


def _der(rng, n):
    body = bytes([2, 1, 0, 4, n]) + rng.randbytes(n)
    return bytes([0x30, len(body)]) + body


def _planted(rng):
    enc = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    kind = rng.choice(("jwt", "der", "ssh", "hex"))
    if kind == "jwt":
        return "jwt", f"{enc({'alg': 'HS256'})}.{enc({'sub': rng.randint(0, 99)})}.{enc(rng.randbytes(20).hex())}"
    if kind == "ssh":
        return "ssh", base64.b64encode(b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", rng.randbytes(32)))).decode()
    value = _der(rng, rng.randint(33, 100))
    return ("der", base64.b64encode(value).decode()) if kind == "der" else ("hex", value.hex())


def test_planted_keys_are_found_where_they_stand():
    rng = random.Random(11)
    for _ in range(300):
        text, want = "", []
        for _ in range(rng.randint(0, 6)):
            text += rng.choice(["words é here ", "a.b.c ", "x = ", "«", "not a key: " + "QUJD" * 20 + " ", "1.2.3.4 ", "aaaaaaaaaa.bbb.cc "])
            kind, value = _planted(rng)
            want.append(("der" if kind == "hex" else kind, len(text), len(text) + len(value)))
            text += value + rng.choice([" ", "\n\n", ", ", "é"])
        assert [(x["kind"], x["start"], x["stop"]) for x in _secrets(text) if not x["base"]] == want


def test_token_behind_other_dotted_parts():
    head = base64.urlsafe_b64encode(b'{"alg":"none"}').rstrip(b"=").decode()
    token = f"{head}.{head}."
    for before in ("", "aaaaaaaa.bb.", "aaaaaaaa."):
        assert [(x["kind"], x["start"]) for x in _secrets(f"{before}{token}")] == [("jwt", len(before))]


def _labels(text):
    """By edit distance to every run of words."""
    words = text.split()
    out = set()
    for n in license_scan.NOTICES:
        m = len(n.phrase)
        for i in range(len(words)):
            row = list(range(m + 1))
            run = " ".join(words[i : i + 16])
            for j, c in enumerate(run, 1):
                new = [j]
                for k, p in enumerate(n.phrase, 1):
                    new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (c != p)))
                row = new
                if row[-1] <= n.edits and (j == len(run) or run[j] == " "):
                    out.add(n.label)
                    break
                if j > m + n.edits:
                    break
    return out


def test_licence_labels_equal_edit_distance():
    rng = random.Random(12)
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 3)):
            p = list(rng.choice(license_scan.NOTICES).phrase)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(p))
                p[k : k + rng.choice((0, 1))] = rng.choice(("", "x", "e", " "))
            parts += ["".join(p), rng.choice(["and", "some words", "rights reserved", "public license"])]
        text = " ".join(" ".join(parts).split())
        assert {x["label"] for x in _licences(text)} == _labels(text), text


# ---- decoding ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.Tokenizer(bpe.read_ranks(f), public_tokenizers.PATTERN)


def test_decoding_steps_the_machine_over_split_and_malformed_characters(tokenizer):
    rng = random.Random(13)
    odd = np.flatnonzero(~tokenizer.whole).tolist()
    rows = [[rng.choice(odd) if rng.random() < 0.6 else rng.randrange(len(tokenizer.tokens)) for _ in range(rng.randint(0, 9))] for _ in range(4000)]
    rows += [tokenizer.encode_batch([x])[0].tolist() for x in ("漢字 𓀀𓁀 ﷺ", "😀é", "")]
    data, sizes = tokenizer.decode(np.array(sum(rows, []), np.int32), np.array([len(x) for x in rows]))
    at = np.concatenate([[0], np.cumsum(sizes)])
    for k, ids in enumerate(rows):
        want = b"".join(tokenizer.tokens[i] for i in ids).decode(errors="replace")
        assert bytes(data[at[k] : at[k + 1]]).decode() == want == "".join(tokenizer.stream(ids))


def test_stream_gives_a_character_once_it_is_whole(tokenizer):
    one = [tokenizer.machine.ranks[bytes([b])] for b in "é漢".encode()]
    assert list(tokenizer.stream(one)) == ["é", "漢"]


# ---- join ----------------------------------------------------------------------------------------


def test_word_hash_has_no_structure():
    x = "a"
    while len(x) < 4096:
        x += x.translate(str.maketrans("ab", "ba"))
        y = x.translate(str.maketrans("ab", "ba"))
        data = np.frombuffer(f"{x} {y} {x}".encode(), np.uint8)
        s, e, _ = word_spans(data, np.array([0, len(data)]), ~table(b" "))
        h = span_hashes(data, s, e)
        assert h[0] != h[1] and h[0] == h[2]
    rng = np.random.default_rng(3)
    words = {rng.integers(97, 100, rng.integers(1, 90), dtype=np.uint8).tobytes() for _ in range(20_000)}
    data = np.frombuffer(b" ".join(words), np.uint8)
    s, e, _ = word_spans(data, np.array([0, len(data)]), ~table(b" "))
    assert len(np.unique(span_hashes(data, s, e))) == len(words)


def test_signatures_rule_out_no_link():
    rng = np.random.default_rng(4)
    kept = 0
    for _ in range(3000):
        n = int(rng.integers(1, 700))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = np.unique(np.concatenate([a[: rng.integers(0, n + 1)], rng.integers(0, 2**64, int(rng.integers(0, n // 3 + 2)), dtype=np.uint64)]))
        a = np.unique(a)
        common = len(np.intersect1d(a, b))
        if 100 * common >= 75 * (len(a) + len(b) - common):
            kept += 1
            assert ngram_join.could_link(len(a), len(b), ngram_join.signature(a), ngram_join.signature(b))
    assert kept > 100


def _brute(rows):
    sets = []
    for i, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        sets.append((i, {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))
    up = {i: i for i, _ in sets if i is not None}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, a), (j, b) in combinations(sets, 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((top(i), top(j)))
            up[y] = x
    return sorted((i, len(a), top(i)) if i is not None else (None, len(a), None) for i, a in sets)


def _joined(spark, rows):
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key)


def test_join_of_families_of_near_copies(spark, monkeypatch):
    rng = random.Random(14)
    rows = []
    for family in range(3):
        base = [f"w{family}x{k}" for k in range((60, 150, 400)[family])]
        for _ in range((60, 60, 30)[family]):
            words = list(base)
            for _ in range(rng.randint(0, len(base) // 20)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(500 + k, rows[k][1]) for k in range(20)] + [(600 + k, None if k % 2 else "  ") for k in range(4)]
    want = _brute(rows)
    assert 20 < len({c for _, _, c in want}) < 150
    assert _joined(spark, rows) == want
    # shingles of a few documents count as hot, so that they are dealt to several tasks; no turn but the first
    monkeypatch.setattr(ngram_join, "_HOT", 2)
    monkeypatch.setattr(ngram_join, "_TURNS", 1)
    assert _joined(spark, rows) == want


def test_join_of_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (2, b), (2, a + " more"), (3, b + " more"), (4, c), (5, c), (5, c), (None, c), (None, None)]
    got = _joined(spark, rows)
    assert [(i, k) for i, _, k in got] == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (None, None), (None, None)]
    x = "ab"
    while len(x) < 1024:
        x += x.translate(str.maketrans("ab", "ba"))
    assert [k for _, _, k in _joined(spark, [(7, x), (8, x.translate(str.maketrans("ab", "ba")))])] == [7, 8]


def test_links_are_decided_by_words():
    rng = np.random.default_rng(11)
    for _ in range(300):
        a = " ".join(rng.choice(["a", "B", "c", "ä"], rng.integers(0, 30)))
        b = a + " d" * int(rng.integers(0, 3)) if rng.random() < 0.7 else " ".join(rng.choice(["a", "b", "c"], rng.integers(0, 30)))
        sets = []
        for text in (a, b):
            w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
        x, y = sets
        want = bool(x & y) and 100 * len(x & y) >= 75 * len(x | y)
        assert ngram_join.words_link(a.encode(), b.encode()) == want
    many = [f"w{k}" for k in range(20_000)]  # so many words that runs are numbered anew
    assert ngram_join.words_link(" ".join(many).encode(), " ".join(many[:15_004]).encode())
    assert not ngram_join.words_link(" ".join(many).encode(), " ".join(many[:15_000]).encode())


def test_chosen_words_and_short_prints_link_nothing_else(spark):
    # two words that collide where the hash has no key
    texts = ["eszycidpyopumzgd", "povxgrgb%lx#tv'a", "eszycidpyopumzgd", " ".join(f"w{k}" for k in range(60))]
    texts.append(texts[3] + " more")
    rng = np.random.default_rng(12)
    texts += [" ".join(f"v{k}" for k in rng.integers(0, 9000, rng.integers(1, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = list(range(len(texts)))
    want[2], want[4] = 0, 3
    for i in range(5, len(texts)):  # one-word texts can be equal by chance
        want[i] = texts.index(texts[i])
    for bits in (64, 5):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(df, print_bits=bits).collect()}
        assert [got[i] for i in range(len(texts))] == want
