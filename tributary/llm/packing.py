"""Order-preserving packing of documents into token windows by dynamic programming.

The documents of a partition form one stream of tokens.  Windows of at most ``size`` tokens cut it;
``f(j) = min over i in [j - size, j) of f(i) + padding(j - i) + penalty(j)`` over candidate cuts j:
document ends (no penalty), sentence ends, and, where neither comes for long, places inside a
sentence.  Padding to ``size`` is linear in i, so a monotone queue of f(i) + i yields the best i; a
window whose length is a power of two needs no padding and is tried besides.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import blocks, lists, text_column
from .bpe import _Memo, _ragged, ship

#: Tokens that end a sentence, as the vocabulary writes them.
SENTENCE_ENDS = (".</w>", "!</w>", "?</w>", "!!</w>", "...</w>")


#: The white space of the vocabulary's pattern, and Python's further separators.
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Letters with one simple lower case and no decomposed form, then marks without the apostrophe.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
_C0 = re.compile("[\x1c-\x1f]")


@dataclass(frozen=True)
class Plan:
    """size: tokens a window holds; penalties in tokens; gap: longest stretch without a candidate cut."""

    size: int = 2048
    sentence: float = 2.0
    inside: float = 24.0
    window: float = 4.0
    gap: int = 96
    block: int = 1 << 20


def best_cuts(cuts: np.ndarray, penalty: np.ndarray, plan: Plan = Plan()) -> tuple[list[int], float]:
    """(indices of the chosen cuts from first to last, their total cost).

    ``cuts`` are increasing places, the first and the last of which must be taken; neighbours are at
    most ``plan.size`` apart.
    """
    size, n = plan.size, len(cuts)
    # candidates at a power of two before a cut, in order of the cuts
    index = np.full(int(cuts[-1] - cuts[0]) + 1, -1, np.int32)
    index[cuts - cuts[0]] = np.arange(n)
    ends, begins = [], []
    power = 1 << (size.bit_length() - 1)
    while power:
        far = cuts - cuts[0] - power
        late = np.flatnonzero(far >= 0)
        at = index[far[late]]
        ends.append(late[at >= 0])
        begins.append(at[at >= 0])
        power >>= 1
    order = np.argsort(np.concatenate(ends), kind="stable")
    begin = np.concatenate(begins)[order].tolist()
    until = np.searchsorted(np.concatenate(ends)[order], np.arange(n), "right").tolist()
    place, cost = cuts.tolist(), penalty.tolist()
    best, came = [0.0] * n, [0] * n
    queue: deque[tuple[float, int, int]] = deque([(0.0 + place[0], place[0], 0)])
    for j in range(1, n):
        p = place[j]
        while queue[0][1] < p - size:
            queue.popleft()
        low, _, i = queue[0]
        value = low + size - p
        if until[j] > until[j - 1]:
            for k in begin[until[j - 1] : until[j]]:
                if best[k] < value:
                    value, i = best[k], k
        value += cost[j] + plan.window
        best[j], came[j] = value, i
        key = value + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    out, j = [n - 1], n - 1
    while j:
        j = came[j]
        out.append(j)
    return out[::-1], best[-1]


class Packer:
    """Takes documents in order and gives finished pieces; holds about ``plan.block`` tokens and the last document."""

    def __init__(self, plan: Plan, ends: np.ndarray):
        self.plan, self.ends = plan, ends
        self.ids = np.zeros(0, np.uint32)
        self.held: list[list[int]] = []  # [row, start in the document, length here, document's tokens]
        self.sequence = 0
        self.waiting: list[tuple[int, np.ndarray]] = []
        self.tokens = 0

    def add(self, row: int, ids: np.ndarray) -> list[tuple]:
        self.waiting.append((row, ids))
        self.tokens += len(ids)
        return self.pack(False) if self.tokens >= self.plan.block else []

    def pack(self, last: bool) -> list[tuple]:
        """Pieces (row, start, length, crc32, document's tokens, sequence, offset) of the windows that are settled."""
        plan = self.plan
        self.ids = np.concatenate([self.ids, *(x for _, x in self.waiting)])
        self.held += [[row, 0, len(x), len(x)] for row, x in self.waiting]
        self.waiting = []
        total = len(self.ids)
        if not total:
            return []
        doc_ends = np.cumsum([x[2] for x in self.held])
        penalty = np.full(total + 1, np.inf)
        penalty[np.flatnonzero(self.ends[np.minimum(self.ids, len(self.ends) - 1)]) + 1] = plan.sentence
        penalty[doc_ends] = 0.0
        penalty[0] = 0.0
        near = np.flatnonzero(np.isfinite(penalty))
        if near[-1] != total:
            near = np.append(near, total)
        for a, b in zip(near[:-1][np.diff(near) > plan.gap].tolist(), near[1:][np.diff(near) > plan.gap].tolist(), strict=True):
            spots = np.arange(a + plan.gap, b, plan.gap)
            penalty[spots] = plan.inside
        penalty[total] = min(penalty[total], plan.inside)
        cuts = np.flatnonzero(np.isfinite(penalty))
        chosen, _ = best_cuts(cuts, penalty[cuts], plan)
        marks = cuts[chosen]
        if not last:
            # what follows may change the last windows' cuts; they stay for the next call
            marks = marks[: max(1, len(marks) - 2)]
        out = []
        k, used = 0, 0
        for a, b in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True):
            at = a
            while at < b:
                row, start, length, whole = self.held[k]
                take = min(length - used, b - at)
                out.append((row, start + used, take, zlib.crc32(self.ids[at : at + take].astype("<u4").tobytes()), whole, self.sequence, at - a))
                at += take
                used += take
                if used == length:
                    k, used = k + 1, 0
            self.sequence += 1
        self.held = self.held[k:]
        if used:
            row, start, length, whole = self.held[0]
            self.held[0] = [row, start + used, length - used, whole]
        self.ids = self.ids[marks[-1] :].copy()
        self.tokens = len(self.ids)
        return out


def _closing_engine(library):
    """The vocabulary's merges for ``tiktoken``, with the byte 0 as word end, and which ids hold it.

    Valid if ids follow the order of the merges and each merge makes one token; else there is none.
    """
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    model = json.loads(library.to_str())["model"]
    close = model["end_of_word_suffix"]
    ranks = {}
    for token, i in model["vocab"].items():
        stem = token.removesuffix(close) if close and token != close else token
        ranks[bytes(byte[c] for c in stem) + b"\0" * (stem != token)] = i
    merged = [model["vocab"][a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    if merged != list(range(512, 512 + len(merged))) or len(ranks) != len(model["vocab"]):
        return None, None
    closes = np.zeros(max(ranks.values()) + 1, np.int64)
    closes[[i for t, i in ranks.items() if len(t) > 1 and t.endswith(b"\0")]] = 1
    return tiktoken.Encoding("closing", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}), closes


class WordTokenizer:
    """A vocabulary of the ``tokenizers`` library; keeps the ids of words between white space seen before (bounded)."""

    def __init__(self, path: str, memo: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.memo = _Memo(self._encode, memo)
        self.fast, self.closes = _closing_engine(self.library)

    def _library(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        """(ids, ids per word) by the library; many words are one call."""
        ids, sizes = [], []
        for lo in range(0, len(words), 2048):
            part = words[lo : lo + 2048]
            got = self.library.encode(part, is_pretokenized=True, add_special_tokens=False)
            sizes.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
            ids += got.ids
        return ids, np.concatenate([np.zeros(0, np.int64), *sizes])

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word).

        A word of Latin letters and then marks is two matches of the vocabulary's pattern; the faster
        engine takes these, each match with a closing byte in place of the vocabulary's word end.
        """
        plain, closed, matches, other = [], [], [], []
        match = _PLAIN.fullmatch if self.fast else lambda _: None
        for k, word in enumerate(words):
            m = match(word)
            if m is None:
                other.append(k)
                continue
            cut = m.end(1)
            plain.append(k)
            if cut == len(word):
                closed.append(word)
                matches.append(1)
            else:
                closed.append(f"{word[:cut]}\0{word[cut:]}")
                matches.append(2)
        # letters of these words are lower-cased one by one, and marks have no case
        ids = np.array(self.fast.encode_ordinary("\0".join(closed).lower() + "\0") if closed else [], np.int32)
        more, sizes = self._library([words[k] for k in other])
        if plain:
            done = np.cumsum(self.closes[ids])  # matches closed so far
            per = np.cumsum(matches)
            ends = np.searchsorted(done, per) + 1
            sizes = np.concatenate([np.diff(ends, prepend=0), sizes])
        ids = np.concatenate([ids, np.array(more, np.int32)])
        order = np.array(plain + other, np.int64)
        starts = np.cumsum(sizes) - sizes
        back = np.argsort(order, kind="stable")
        return ids[_ragged(starts[back], sizes[back])], sizes[back]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text).  The vocabulary drops white space and no token spans it, so words are encoded by themselves."""
        parts, counts = [], []
        for text in texts:
            # the C0 separators end Python's words but not the vocabulary's
            words = [x for x in _WHITE.split(text) if x] if _C0.search(text) else text.split()
            parts += words
            counts.append(len(words))
        return self.memo.gather(parts, counts)


@cache
def _tokenizer(name: str) -> WordTokenizer:
    return WordTokenizer(SparkFiles.get(name))


def pack(docs: DataFrame, vocabulary_path: str, end_id: int = 1, plan: Plan = Plan(), keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """A row per piece: the columns ``keep`` of its document, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document is its ids and then ``end_id`` (null or empty text: ``end_id`` alone).  Each partition
    is packed by itself and in its order; at most its last window is far from full.  ids are the
    piece's tokens, left out unless ``with_ids``.  An empty table gives no row.  Columns of ``docs`` named like an added one are replaced.
    """
    added = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    keep = [c for c in (keep or docs.columns) if c not in added]
    name = ship(docs, vocabulary_path)
    source = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    schema = docs.select(*keep).withColumns({c: F.lit(None).cast("array<int>") if c == "ids" else F.lit(0).cast("long") for c in added}).schema
    for f in schema.fields:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(name)
        ends = np.zeros(t.library.get_vocab_size() + 1, bool)
        ends[[i for i in map(t.library.token_to_id, SENTENCE_ENDS) if i is not None]] = True
        packer = Packer(plan, ends)
        base = TaskContext.get().partitionId() << 40
        rows: list[pa.RecordBatch] = []  # columns of the documents that pieces may still name
        first = 0
        texts: list[np.ndarray] = []
        low = 0

        def give(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal rows, first, low, texts
            if not pieces:
                return
            for lo in range(0, len(pieces), 4096):
                part = pieces[lo : lo + 4096]
                cols = [np.array(x, np.int64) for x in zip(*part, strict=True)]
                ids = []
                if with_ids:
                    flat = np.concatenate([texts[r - low][s : s + n] for r, s, n in zip(cols[0].tolist(), cols[1].tolist(), cols[2].tolist(), strict=True)])
                    ids = [lists(flat.astype(np.int32), cols[2], pa.int32())]
                table = pa.Table.from_batches(rows).take(pa.array(cols[0] - first)).combine_chunks()
                kept = [table.column(c).combine_chunks() for c in keep]
                kept = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in kept]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x) for x in (cols[1], cols[2], cols[3], cols[4], cols[5] + base, cols[6])), *ids], [*keep, *added])
            done = packer.held[0][0] if packer.held else low + len(texts)
            texts, low = texts[done - low :], done
            while rows and first + len(rows[0]) <= low:
                first += len(rows[0])
                rows = rows[1:]

        for batch in batches:
            text = text_column(batch, "__text")
            for row, end, _, _ in blocks(text, 1 << 20):
                part = batch.slice(row, end - row)
                rows.append(pa.RecordBatch.from_arrays([part.column(c) for c in keep], keep) if keep else part)
                ids, counts = t.encode_batch(text.slice(row, end - row).to_pylist())
                at = np.concatenate([[0], np.cumsum(counts)])
                for k in range(end - row):
                    mine = np.append(ids[at[k] : at[k + 1]].astype(np.uint32), np.uint32(end_id))
                    texts.append(mine)
                    yield from give(packer.add(low + len(texts) - 1, mine))
        yield from give(packer.pack(True))

    return source.mapInArrow(run, schema)
