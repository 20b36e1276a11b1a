"""The conversation trie against plain dictionaries of tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tributary.llm import conversation_trie
from tributary.llm._shared import Scratch

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in turns.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 * (1 if c >= 0 else -1))
        paths[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
            leaves[p[:d]] += children[p] == 0
    sha = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p, m)) for p, m in members.items())


def ours(spark, rows, extra=""):
    df = spark.createDataFrame([(*r, *([1] if extra else [])) for r in rows], "conv_id long, turn long, role string, text string" + extra)
    scratch = Scratch(spark)
    out = conversation_trie.trie(*conversation_trie.with_shared_heads(conversation_trie.ordered(df), scratch), scratch)
    assert out.columns == COLUMNS
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("block", [4, 1024])
def test_trie_of_random_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_trie, "BLOCK", block)
    monkeypatch.setattr(conversation_trie, "_SLOT_BITS", 2 if block == 4 else 10)
    monkeypatch.setattr(conversation_trie, "_RUN_BITS", 1 if block == 4 else 10)
    rng = random.Random(block)
    rows = []
    for c in [*range(60), *range(-12, 0), 10**12, 10**12 + 1]:
        if c in (10, 20):
            continue
        for k in range(rng.choice([1, 2, 3, 9, 14, 30])):
            rows.append((c, k, rng.choice(["user", "assistant"]) if c % 3 else "user", rng.choice(["hi", "ça va?", "yes", ""]) if k > 4 else "start"))
    assert ours(spark, rows) == brute(rows)


def test_trie_of_copies_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 8)
    rows = [(c, k, "user", f"t{k % 3}") for c in range(0, 200, 5) for k in range(20)] + [(7, k, "user", "long") for k in range(300)]
    assert ours(spark, rows) == brute(rows)


def test_trie_cases(spark):
    assert ours(spark, []) == []
    odd = [(1, None, None, None), (1, None, "user", None), (1, 2, "a", "b"), (1, 2, "a", "b"), (1, 2, "a", "a"), (None, 1, "user", "lost"), (3, -5, "x", "y" * 100_000), (3, None, "x", ":"), (4, 1, "x:", ""), (6, 1, "x", ":")]
    assert ours(spark, odd, ", depth int") == brute(odd)
    # rebuilt conversations that have no turns: h is 8 or less, and conversation 0 is absent
    alone = [(c, 0, "user", "x") for c in (1, 2, 3, 4) if zlib.crc32(str(c).encode()) % 9 > 0]
    got = ours(spark, alone)
    assert got == brute(alone) and got[0][:3] == (min(c for c, *_ in alone), 0, None) and got[0][4] == 0 and got[0][5] == 1
