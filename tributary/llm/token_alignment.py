"""Alignment of two tokenizers over the same texts, through a dictionary of token groups.

The byte offsets where tokens of both tokenizers end cut a text into groups.  Groups repeat far more
often than they are new, so they are interned: links between tokens are expanded once per distinct
group and multiplied by its frequency, and what a group is worth comes back to the documents by the
group's key.

Texts are read in blocks of a bounded number of bytes.  A block keeps a dictionary of its own, and
its documents refer to groups by place in it; only these dictionaries, not the documents' groups, are
shuffled to be summed and looked up.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch
from ._text import lists, row_of, text_column

BLOCK_BYTES = 8 << 20
#: A worker remembers the groups of short stretches, up to so many bytes of them (estimated) twice.
_MEMO_BYTES, _SHORT = 32 << 20, 64
#: Longer stretches are tokenized by themselves.
_LONG = 1000
#: A stretch starts at white space that follows something else, so that neither tokenizer joins tokens across its start.
_STRETCH = re.compile(r"[ \n\t]\s*\S*(?:[^\S \n\t]\s*\S*)*")


def byte_alphabet() -> dict[str, int]:
    """The characters of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and the groups of stretches of text."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        spelled = byte_alphabet()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = {i: p.encode() if p in special else bytes(spelled[c] for c in p) for p, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.a_text, self.b_text = ([str(i) for i in range(len(x))] for x in (self.a_size, self.b_size))
        self.space = self.b.piece_to_id("▁")
        with open(a_path, encoding="utf-8") as f:
            split = json.load(f).get("pre_tokenizer") or {}
        # texts may be cut into stretches if A splits at white space first and no piece of B reaches over such a cut
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.cuts = bool(plain) and not any(re.search(r"[^▁\s][▁\n\t]|▁[\n\t]", p) for p in pieces)
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.held = 0

    def stretches(self, text: str) -> list[str]:
        """The parts of space+text that can be tokenized apart."""
        return _STRETCH.findall(" " + text) if self.cuts else [" " + text]

    def _groups(self, raw: bytes, a: list[int], b: list[int]) -> tuple:
        """(A tokens, B tokens, text of the groups, groups, whether both spell the bytes)."""
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return (0, 0, "", (), False)
        out, i, j, ai, bj = [], 0, 0, 0, 0
        at = bt = 0
        while i < len(a) or j < len(b):
            if at <= bt and i < len(a):
                at += len(self.a_bytes[a[i]])
                i += 1
            else:
                bt += len(self.b_bytes[b[j]])
                j += 1
            if at == bt:
                out.append(f"{','.join(map(str, a[ai:i]))}|{','.join(map(str, b[bj:j]))}")
                ai, bj = i, j
        return (len(a), len(b), ";".join(out), tuple(out), True)

    def _encode_one(self, part: str) -> tuple:
        # B adds a space in front: it takes the place of the stretch's own, or is dropped again
        b = [self.space] if part == " " else self.b.encode(part[1:]) if part[0] == " " else self.b.encode(part)[1:]
        return self._groups(part.encode(), self.a.encode(part, add_special_tokens=False).ids, b)

    def _encode(self, parts: list[str]) -> list[tuple]:
        """Stretches one after the other are tokenized as one text, since no token reaches over their starts."""
        text = "".join(parts)
        raw = text.encode()
        a = self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return [self._encode_one(p) for p in parts]
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.cumsum([len(p) for p in parts] if text.isascii() else [len(p.encode()) for p in parts])
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        last = np.searchsorted(common, ends)
        if common[-1] < ends[-1] or not (common[np.minimum(last, len(common) - 1)] == ends).all():
            return [self._encode_one(p) for p in parts]
        a_to, b_to = np.searchsorted(a_end, common, "right").tolist(), np.searchsorted(b_end, common, "right").tolist()
        a_text, b_text, names, i, j = [self.a_text[x] for x in a], [self.b_text[x] for x in b], [], 0, 0
        for x, y in zip(a_to, b_to, strict=True):
            names.append(f"{a_text[i] if x == i + 1 else ','.join(a_text[i:x])}|{b_text[j] if y == j + 1 else ','.join(b_text[j:y])}")
            i, j = x, y
        out, k, i, j = [], 0, 0, 0
        for to in (last + 1).tolist():
            x, y = a_to[to - 1], b_to[to - 1]
            out.append((x - i, y - j, ";".join(names[k:to]), tuple(names[k:to]), True))
            k, i, j = to, x, y
        return out

    def groups(self, parts: list[str]) -> list[tuple]:
        """What ``_groups`` says of each of the distinct stretches, remembered where they are short."""
        out: dict[str, tuple] = {}
        missing = []
        for p in parts:
            hit = self.young.get(p) or self.old.get(p)
            if hit is None:
                missing.append(p)
            else:
                self._remember(p, hit)
            out[p] = hit
        apart = [p for p in missing if len(p) > _LONG or p[-1].isspace()]
        joined = [p for p in missing if len(p) <= _LONG and not p[-1].isspace()]
        for p in apart:
            out[p] = self._encode_one(p)
        for k in range(0, len(joined), 1024):
            some = joined[k : k + 1024]
            out.update(zip(some, self._encode(some), strict=True))
        for p in missing:
            self._remember(p, out[p])
        return [out[p] for p in parts]

    def _remember(self, part: str, got: tuple) -> None:
        if len(part) > _SHORT or part in self.young:
            return
        self.young[part] = got
        self.held += 400 + 2 * len(part) + 3 * len(got[2]) + 60 * len(got[3])
        if self.held > _MEMO_BYTES:  # those not met again since the last turn go
            self.young, self.old, self.held = {}, self.young, 0


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


class _Block:
    """Documents of one block: their stretches, and at its end the block's dictionary of groups."""

    def __init__(self, tools: Aligner, keep: pa.Schema):
        self.tools, self.keep, self.bytes = tools, keep, 0
        self.local: dict[str, int] = {}
        self.known: list[tuple] = []
        self.names: list[str] = []
        self.bad = False
        self.waiting: list[list[str]] = []
        self.new: dict[str, None] = {}
        self.docs: list[np.ndarray] = []
        self.digests: list[str] = []
        self.rows: list[pa.RecordBatch] = []

    def add(self, text: str) -> None:
        parts = self.tools.stretches(text) if text else []
        self.waiting.append(parts)
        self.new.update(dict.fromkeys(p for p in parts if p not in self.local))
        if len(self.new) > 4096:
            self.settle()
        self.bytes += len(text)

    def settle(self) -> None:
        """Takes up the documents that wait for their stretches' groups."""
        new = list(self.new)
        for p, got in zip(new, self.tools.groups(new), strict=True):
            self.local[p] = len(self.known)
            self.bad |= not got[4]
            self.known.append(got)
            self.names.append(got[2])
        place, names = self.local.__getitem__, self.names
        for parts in self.waiting:
            ids = list(map(place, parts))
            if self.bad and not all(self.known[i][4] for i in ids):
                ids = []
            self.docs.append(np.array(ids, np.int64))
            self.digests.append(sha256(";".join([names[i] for i in ids]).encode()).hexdigest() if ids else "")
        self.waiting, self.new = [], {}

    def end(self) -> pa.RecordBatch:
        """A row per document, and a last one with the dictionary; commonest groups first."""
        self.settle()
        words: dict[str, int] = {}
        own = [np.array([words.setdefault(g, len(words)) for g in k[3]], np.int64) for k in self.known]
        size = np.array([len(x) for x in own], np.int64)
        start = np.cumsum(size) - size
        flat = np.concatenate(own) if own else np.zeros(0, np.int64)
        n_docs = len(self.docs)
        lengths = np.array([len(d) for d in self.docs], np.int64)
        every = np.concatenate(self.docs) if n_docs else np.zeros(0, np.int64)
        doc = row_of(lengths)
        total = lambda k: np.bincount(doc, np.array([x[k] for x in self.known], np.float64)[every], minlength=n_docs).astype(np.int64) if len(every) else np.zeros(n_docs, np.int64)
        n_a, n_b = total(0), total(1)
        # the groups of all stretches of all documents, counted by (document, group)
        count = size[every]
        place = np.repeat(start[every] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        group = flat[place]
        n_groups = np.bincount(np.repeat(doc, count), minlength=n_docs).astype(np.int64) if len(group) else np.zeros(n_docs, np.int64)
        freq = np.bincount(group, minlength=len(words))
        order = np.argsort(-freq, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        pair, times = np.unique(np.repeat(doc, count) * max(len(words), 1) + rank[group], return_counts=True) if len(group) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        held = np.bincount(pair // max(len(words), 1), minlength=n_docs) if len(pair) else np.zeros(n_docs, np.int64)
        named = np.array(list(words), object)[order]
        used = freq[order] > 0  # groups of texts that have no tokens in the end
        name = uuid.uuid4().hex
        doc_part = pa.RecordBatch.from_arrays(
            [pa.array([name] * n_docs, pa.string()), *[pa.concat_arrays([r.column(c) for r in self.rows]) for c in self.keep.names], pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(self.digests, pa.string()), lists(pair % max(len(words), 1), held, pa.int32()), lists(times, held, pa.int32()), pa.nulls(n_docs, pa.list_(pa.string())), pa.nulls(n_docs, pa.list_(pa.int64()))],
            ["block", *self.keep.names, "n_a", "n_b", "n_groups", "groups_sha256", "places", "times", "names", "freqs"],
        )
        nothing = [pa.nulls(1, f.type) for f in doc_part.schema]
        nothing[0] = pa.array([name])
        nothing[-2], nothing[-1] = pa.array([named[used].tolist()], pa.list_(pa.string())), pa.array([freq[order][used].tolist()], pa.list_(pa.int64()))
        return pa.Table.from_batches([doc_part, pa.RecordBatch.from_arrays(nothing, schema=doc_part.schema)]).combine_chunks().to_batches()[0]


def links_of(a: list[int], b: list[int], a_bytes: dict, b_bytes: list) -> dict[tuple[int, int], int]:
    """How often each id pair overlaps within one group."""
    out: dict[tuple[int, int], int] = {}
    i = j = 0
    at, bt = len(a_bytes[a[0]]), len(b_bytes[b[0]])
    while True:
        out[a[i], b[j]] = out.get((a[i], b[j]), 0) + 1
        if at <= bt:
            i += 1
        if bt <= at:
            j += 1
        if i == len(a) or j == len(b):
            return out
        if at == bt:  # not inside a group
            raise ValueError("a group holds an inner border")
        if at < bt:
            at += len(a_bytes[a[i]])
        else:
            bt += len(b_bytes[b[j]])


def blocks(docs: DataFrame, a_path: str, b_path: str, keep: list[str], limit: int = BLOCK_BYTES) -> DataFrame:
    """Documents by block with their groups' places and times in its dictionary, and a row with each block's dictionary."""
    added = ["block", "n_a", "n_b", "n_groups", "groups_sha256", "places", "times", "names", "freqs"]
    keep = [c for c in keep if c not in added]
    source = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    schema = "block string, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields) + "n_a long, n_b long, n_groups long, groups_sha256 string, places array<int>, times array<int>, names array<string>, freqs array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, now = aligner(a_path, b_path), None
        for batch in batches:
            own = batch.select(keep)
            texts, row = text_column(batch, "__text"), 0
            for k in range(len(batch)):
                now = now or _Block(tools, own.schema)
                now.add(texts[k].as_py())
                if now.bytes >= limit:
                    now.rows.append(own.slice(row, k + 1 - row))
                    yield now.end()
                    now, row = None, k + 1
            if now and row < len(batch):
                now.rows.append(own.slice(row))
        if now:
            yield now.end()

    return source.mapInArrow(run, schema)


def _expanded(a_path: str, b_path: str):
    """Adds to distinct groups (gid, name, freq) their links: id pairs with how often each occurs in the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = aligner(a_path, b_path)
        for batch in batches:
            for k in range(0, len(batch), 2048):
                part = batch.slice(k, 2048)
                a_ids, b_ids, times, counts = [], [], [], []
                for name in part.column("name").to_pylist():
                    a, b = ([int(x) for x in side.split(",")] for side in name.split("|"))
                    found = links_of(a, b, tools.a_bytes, tools.b_bytes)
                    a_ids += [x for x, _ in found]
                    b_ids += [x for _, x in found]
                    times += found.values()
                    counts.append(len(found))
                sizes = np.array(counts, np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, lists(np.array(a_ids), sizes, pa.int32()), lists(np.array(b_ids), sizes, pa.int32()), lists(np.array(times), sizes, pa.int64())], ["gid", "name", "freq", "a", "b", "n"])

    return run


def _worth(left: pa.Table, right: pa.Table, keep: list[str]) -> pa.Table:
    """A block's documents with the sums over their groups; ``right`` has what each place of the dictionary is worth."""
    place = right.column("place").to_numpy()
    size = int(place.max()) + 1 if len(place) else 0
    own = left.select([*keep, "n_a", "n_b", "n_groups"])
    sums = {}
    places, times = left.column("places").combine_chunks(), left.column("times").combine_chunks()
    counts = places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    at, n = places.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    for c in ("best", "total"):
        table = np.zeros(size, np.int64)
        table[place] = right.column(c).to_numpy()
        run = np.concatenate([[0], np.cumsum(table[at] * n)])  # differences hold even where the running sum has wrapped round
        sums[c] = run[ends[1:]] - run[ends[:-1]]
    n_a, n_b, n_groups = (left.column(c).to_numpy() for c in ("n_a", "n_b", "n_groups"))
    return pa.Table.from_arrays([*own.columns, pa.array(n_a + n_b - n_groups), pa.array(sums["best"]), pa.array(sums["total"]), left.column("groups_sha256")], [*own.column_names, "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_counts(groups: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, count, is_best): for each id pair its links in all texts, and whether no other A id has more with that B id."""
    some = groups.select("freq", F.explode(F.arrays_zip("a", "b", "n")).alias("x"))
    counts = scratch.write(some.groupBy("x.a", "x.b").agg(F.sum(F.col("x.n") * F.col("freq")).alias("count")), "pairs")
    return counts.join(counts.groupBy("b").agg(F.max("count").alias("most")), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("is_best"))


def align(docs: DataFrame, a_path: str, b_path: str, keep: list[str] | None = None, limit: int = BLOCK_BYTES) -> DataFrame:
    """Each document's alignment between the tokenizers in ``a_path`` (byte-level) and ``b_path`` (pieces).

    A encodes space+text, B the text (it adds the space); strings of special tokens are plain text.
    Columns added to ``keep``: n_a, n_b, n_groups, n_links (overlapping pairs of tokens), n_best (links
    whose id pair has as many links in all texts as any pair of its B id), count_sum (over links, those
    of their pair in all texts), groups_sha256.  A text that is null or empty, or that either tokenizer
    does not spell byte for byte, has zeros and an empty hash.  Repeated rows count as often as they
    stand; an empty table gives an empty one.  Columns of ``docs`` named like an added one are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    added = {"block", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "places", "times", "names", "freqs", "best", "total", "place"}
    keep = [c for c in (keep or docs.columns) if c not in added]
    read = scratch.write(blocks(docs, a_path, b_path, keep, limit), "blocks")
    entries = read.where("names is not null").select("block", F.posexplode(F.arrays_zip("names", "freqs")).alias("place", "x")).select("block", "place", F.col("x.names").alias("name"), F.col("x.freqs").alias("freq"))
    interned = entries.groupBy("name").agg(F.sum("freq").alias("freq")).select(F.monotonically_increasing_id().alias("gid"), "name", "freq")
    groups = scratch.write(interned.mapInArrow(_expanded(a_path, b_path), "gid long, name string, freq long, a array<int>, b array<int>, n array<long>"), "groups")
    pairs = scratch.write(pair_counts(groups, scratch), "worth")
    scratch.drop("pairs")
    scratch.release()
    links = groups.select("gid", F.explode(F.arrays_zip("a", "b", "n")).alias("x")).select("gid", "x.a", "x.b", "x.n")
    sums = links.join(pairs, ["a", "b"]).groupBy("gid").agg(F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("best"), F.sum(F.col("n") * F.col("count")).alias("total"))
    worth = scratch.write(groups.select("gid", "name").join(sums, "gid").select("name", "best", "total"), "sums")
    scratch.drop("worth", "groups")
    scratch.release()
    back = scratch.write(entries.select("block", "place", "name").join(worth, "name").select("block", "place", "best", "total"), "back")
    scratch.drop("sums")
    scratch.release()
    rows = read.where("names is null").drop("names", "freqs")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields) + "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        return _worth(left, right, keep)

    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(join, schema)
