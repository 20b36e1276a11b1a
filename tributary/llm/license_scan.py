"""Fuzzy search for short licence notices.

A text is read as words (runs of ASCII letters, digits and all non-ASCII characters, A-Z
lower-cased), written with one blank between them.  A notice with at most k edits contains one of
the k + 1 pieces it is split into unchanged (pigeonhole); exact search for the pieces gives
candidate windows, and bounded-error matching by the ``regex`` library verifies each and yields the
span and its number of edits.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import blocks, lists, table, text_column


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int


#: The notices, their labels and the edits (characters) each allows.
NOTICES = (
    Notice("cc by", "cc-by", 0),
    Notice("general public license", "gpl", 2),
    Notice("all rights reserved", "reserved", 2),
    Notice("licensed under the apache license", "apache", 3),
    Notice("released under the mit license", "mit", 2),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("mozilla public license", "mpl", 2),
    Notice("lesser general public license", "lgpl", 2),
    Notice("affero general public license", "agpl", 2),
    Notice("creative commons attribution", "creative-commons", 3),
    Notice("cc by nc", "cc-by-nc", 0),
    Notice("cc by sa", "cc-by-sa", 0),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 5),
    Notice("proprietary and confidential", "proprietary", 2),
)
#: Windows of so many bytes are remembered.
_SHORT = 1024
#: Phrases whose exact places form the base result.
BASE = ("cc by", "general public license", "all rights reserved")

_WORD = table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOWER[~_WORD] = 0x20
SPAN = "array<struct<label:string,phrase:string,first_word:long,n_words:int,edits:int,base:boolean>>"
_SPAN = pa.struct([("label", pa.string()), ("phrase", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int32()), ("edits", pa.int32()), ("base", pa.bool_())])


def pieces(phrase: bytes, edits: int) -> list[tuple[int, bytes]]:
    """``edits + 1`` consecutive pieces of about equal length, with their places."""
    cut = np.linspace(0, len(phrase), edits + 2).astype(int)
    return [(int(a), phrase[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Scanner:
    """Finds the notices in normalised text; remembers the windows it has verified (bounded)."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES, memo: int = 20_000):
        self.notices = [(n, n.phrase.encode()) for n in notices]
        self.seeds: dict[bytes, list[tuple[int, int]]] = {}
        for k, (n, phrase) in enumerate(self.notices):
            for at, piece in pieces(phrase, n.edits):
                self.seeds.setdefault(piece, []).append((k, at))
        # word borders are part of the match: notices start and end where words do
        fuzzy = [rb"(?<= )(?:%s){e<=%d}(?= )" % (regex.escape(p), n.edits) for n, p in self.notices]
        self.leftmost = [regex.compile(x) for x in fuzzy]
        self.best = [regex.compile(b"(?be)" + x) for x in fuzzy]
        self.memo: OrderedDict[tuple[int, bytes], list[tuple[int, int, int]]] = OrderedDict()
        self.limit = memo

    def _fuzzy(self, k: int, window: bytes, lo: int, hi: int) -> list[tuple[int, int, int]]:
        """Matches of notice k in window[lo:hi], from the left: a match is found, then the best one that stands where it does.

        Each step looks at the leftmost match and ``edits`` characters beyond it, so that a long
        window with many matches is read once.  Searches take the blanks on both sides along, since
        the library allows no insertion where a search starts.
        """
        edits = self.notices[k][0].edits
        found = []
        while hi > lo and (m := self.leftmost[k].search(window, lo - 1, hi + 1)):
            end = window.find(b" ", min(hi, m.end() + edits), hi)
            end = hi if end < 0 else end
            top = self.best[k].search(window, m.start() - 1, end + 1)
            if not top or top.end() <= top.start():
                break
            if top.start() - 1 > m.start():  # what the best one leaves on its left
                found += [(x.start(), x.end(), sum(x.fuzzy_counts)) for x in [self.best[k].search(window, m.start() - 1, top.start())] if x]
            found.append((*top.span(), sum(top.fuzzy_counts)))
            lo = top.end() + 1
        return found

    def _verify(self, k: int, window: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the matches of notice k in a window: every exact place, and fuzzy ones between these."""
        key = (k, window)
        if (known := self.memo.get(key)) is not None:
            return known
        phrase, found, lo = self.notices[k][1], [], 1
        padded = b" %s " % window
        at = padded.find(b" %s " % phrase) + 1
        while at:
            end = at + len(phrase)
            found += self._fuzzy(k, padded, lo, at - 1)
            found.append((at, end, 0))
            lo = end + 1
            at = padded.find(b" %s " % phrase, end) + 1
        found += self._fuzzy(k, padded, lo, len(padded) - 1)
        found = [(a - 1, b - 1, edits) for a, b, edits in found]
        if len(window) <= _SHORT:
            self.memo[key] = found
            if len(self.memo) > self.limit:
                self.memo.popitem(last=False)
        return found

    def scan(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in a text of words with single blanks around each."""
        wanted: dict[int, list[int]] = {}
        for seed, uses in self.seeds.items():
            at = text.find(seed)
            while at >= 0:
                for k, offset in uses:
                    wanted.setdefault(k, []).append(at - offset)
                at = text.find(seed, at + 1)
        out = []
        for k, starts in wanted.items():
            n, phrase = self.notices[k]
            slack = 2 * n.edits + 1
            todo: list[list[int]] = []
            for a in sorted(starts):  # windows that meet are searched as one
                lo, hi = max(0, a - slack), min(len(text), a + len(phrase) + slack)
                if todo and lo <= todo[-1][1]:
                    todo[-1][1] = max(todo[-1][1], hi)
                else:
                    todo.append([lo, hi])
            for lo, hi in todo:
                lo = text.rfind(b" ", 0, lo + 1) + 1 if lo else 0
                cut = text.find(b" ", hi)
                hi = len(text) if cut < 0 else cut
                out += [(k, lo + a, lo + b, edits) for a, b, edits in self._verify(k, text[lo:hi])]
        return out


def scan(docs: DataFrame, keep: list[str] | None = None, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """Adds n_words and notices (an array of spans, by first word, then catalogue order) to ``keep``.

    A span gives the label, the notice's phrase, its first word (from 0), its number of words, the
    edits, and whether it is an exact place of a base phrase.  A null or empty text has no words and
    no spans.  Columns of ``docs`` named like an added one are replaced.
    """
    added = ["n_words", "notices"]
    keep = [c for c in (keep or docs.columns) if c not in added]
    source = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    schema = docs.select(*keep).withColumns({"n_words": F.lit(0).cast("long"), "notices": F.lit(None).cast(SPAN)}).schema
    for f in schema.fields:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            for row, end, data, at in blocks(text_column(batch, "__text")):
                part = batch.slice(row, end - row)
                n_words, spans, counts = scan_block(scanner, data, at)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n_words), lists(pa.array(spans, _SPAN), counts)], [*keep, *added])

    return source.mapInArrow(run, schema)


def scan_block(scanner: Scanner, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[dict], np.ndarray]:
    """(words per row, spans in order of rows, spans per row) of a block of texts."""
    rows, n = len(at) - 1, len(data)
    # every text gets a border byte (0) before it; then runs of non-word bytes shrink to one blank
    where = at[:-1] + np.arange(rows)
    flat = np.zeros(n + rows, np.uint8)
    inner = np.ones(n + rows, bool)
    inner[where] = False
    flat[inner] = _LOWER[data]
    blank = flat == 0x20
    stays = ~blank
    stays[1:] |= blank[1:] & ~blank[:-1] & (flat[:-1] != 0)
    small = flat[stays]
    begin = np.flatnonzero(small == 0)
    sep = small <= 0x20
    starts = np.flatnonzero(~sep[1:] & sep[:-1]) + 1  # word starts
    first = np.searchsorted(starts, np.append(begin, len(small)))
    n_words = np.diff(first).astype(np.int64)
    joined = small.tobytes()
    bounds = begin.tolist()
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    for row in _hit_rows(scanner, joined, begin):
        lo, hi = bounds[row] + 1, bounds[row + 1] if row + 1 < rows else len(joined)
        if got := scanner.scan(joined[lo:hi]):
            found[row] = got
    counts, spans = np.zeros(rows, np.int64), []
    for row in sorted(found):
        lo = bounds[row] + 1
        seen = []
        for k, a, b, edits in found[row]:
            notice, _ = scanner.notices[k]
            w0 = int(np.searchsorted(starts, lo + a)) - int(first[row])
            w1 = int(np.searchsorted(starts, lo + b)) - int(first[row])
            exact = joined[lo + a : lo + b] == notice.phrase.encode()
            seen.append((w0, k, {"label": notice.label, "phrase": notice.phrase, "first_word": w0, "n_words": w1 - w0, "edits": edits, "base": exact and notice.phrase in BASE}))
        seen.sort(key=lambda x: x[:2])
        spans += [x[2] for x in seen]
        counts[row] = len(seen)
    return n_words, spans, counts


def _hit_rows(scanner: Scanner, joined: bytes, begin: np.ndarray) -> list[int]:
    """Rows that hold any seed."""
    hits = set()
    for seed in scanner.seeds:
        at = joined.find(seed)
        while at >= 0:
            row = int(np.searchsorted(begin, at, "right")) - 1
            hits.add(row)
            # the rest of this row needs no look
            nxt = int(begin[row + 1]) if row + 1 < len(begin) else len(joined)
            at = joined.find(seed, nxt)
    return sorted(hits)
