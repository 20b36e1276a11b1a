"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming decoder.

A sequence of tokens is the encoding of its bytes exactly if every adjacent pair of it is the
encoding of the pair's bytes.  So the encoding of the bytes read so far ends, at each place, in one
possible token, and a token is settled once all places from which a token could still reach beyond
the bytes read descend from it.  These places lie no further back than the longest read suffix that
begins a token: that suffix is the deterministic state of the reading side (built on first use),
its length the lookahead, and the transducer's register holds the end tokens of the places since
the last token emitted.  Tokens are emitted as they settle, checked once the register has grown by
``horizon`` places, and at a piece's end.  The suffix is shorter than the longest token; how many
places its ways take to meet depends on the vocabulary (the tests measure it for the one in use), and
until they meet the register grows by a token and a place for each byte.

Whether two tokens may stand side by side is read off their joins in reverse, as in published work on
byte pair encoding as a rewriting of tokenisations (Berglund and van der Merwe, 2023).
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import blocks, lists, text_column


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: a line has a token in base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Transducer:
    """Encodes one pre-split piece at a time.

    A state is [transitions, tokens that end here from the longest to the shortest as (id, length),
    length of the state's suffix].
    """

    def __init__(self, ranks: dict[bytes, int], horizon: int = 128, max_pairs: int = 400_000):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.heads = {t[:i] for t in ranks for i in range(1, len(t) + 1)}
        self.states: dict[bytes, list] = {}
        self.start = self._state(b"")
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.horizon, self.max_pairs = horizon, max_pairs

    def merge(self, piece: bytes, parts_left: int = 1) -> list[int]:
        """The encoding by its definition: join the adjacent pair of least rank, the leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > parts_left:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose join makes a longer token."""
        found = self.halves.get(token)
        if found is None:
            found = self.halves[token] = tuple(self.merge(self.tokens[token], 2))
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens may stand side by side.

        Joins happen in order of rank.  Going back from the finished pair, each undone join shows the
        two parts that met at the border until then; had they a join of lower rank, it came first.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            limit, known = 1 << 60, True
            while known:
                if self.ranks.get(self.tokens[left] + self.tokens[right], 1 << 60) < limit:
                    known = False
                elif len(self.tokens[max(left, right)]) == 1:
                    break
                elif left > right:
                    limit, left = left, self._halves(left)[1]
                else:  # of equal ranks the one further left is joined first
                    limit, right = right + 1, self._halves(right)[0]
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _state(self, suffix: bytes) -> list:
        state = self.states.get(suffix)
        if state is None:
            ends = [(self.ranks[suffix[i:]], len(suffix) - i) for i in range(len(suffix)) if suffix[i:] in self.ranks]
            state = self.states[suffix] = [{}, ends, len(suffix), suffix]
        return state

    def _step(self, state: list, byte: int) -> list:
        """The state after one more byte: the longest suffix of what was read that begins a token."""
        suffix = state[3] + bytes((byte,))
        while suffix and suffix not in self.heads:
            suffix = suffix[1:]
        found = state[0][byte] = self._state(suffix)
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        ends: list[int] = [-1]  # the register: end tokens of the places since the last emission
        back: list[int] = [0]  # and the places where these tokens start
        state, pairs = self.start, self.pairs
        at, check = 0, self.horizon
        for byte in piece:
            at += 1
            state = state[0].get(byte) or self._step(state, byte)
            for token, size in state[1]:
                place = at - size
                if place < 0:
                    continue
                last = ends[place]
                if last >= 0:
                    fits = pairs.get((last, token))
                    if not (self.fits(last, token) if fits is None else fits):
                        continue
                ends.append(token)
                back.append(place)
                break
            if at == check:
                check += self.horizon
                cut = self._settled(back, state[3], at)
                out += self._path(ends, back, cut)
                ends, back = ends[cut:], [x - cut for x in back[cut:]]
                at, check = at - cut, check - cut
        return out + self._path(ends, back, at)

    def _settled(self, back: list[int], suffix: bytes, at: int) -> int:
        """The furthest place on the way to every place where a token reaching past the read bytes may start."""
        low = at
        for i in range(len(suffix)):
            if suffix[i:] in self.heads:
                other = at - len(suffix) + i
                if other < 0:
                    return 0
                while other != low:
                    if other > low:
                        other = back[other]
                    else:
                        low = back[low]
        return low

    @staticmethod
    def _path(ends: list[int], back: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(ends[at])
            at = back[at]
        return out[::-1]


class Utf8Machine:
    """Incremental UTF-8: bytes in, characters out as soon as they are whole.

    A state is the number of continuation bytes due and the range the next one must lie in.
    Malformed sequences give U+FFFD once for each maximal part, as the standard recommends.
    """

    def __init__(self, state: tuple[int, int, int, int] = (0, 0x80, 0xBF, 0)) -> None:
        self.due, self.low, self.high, self.code = state

    @property
    def state(self) -> tuple[int, int, int, int]:
        return (self.due, self.low, self.high, self.code) if self.due else (0, 0x80, 0xBF, 0)

    def feed(self, data: bytes) -> str:
        if not self.due and data.isascii():
            return data.decode("ascii")
        out = []
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.code, self.due, self.low, self.high = self.code << 6 | b & 0x3F, self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.due = 0
            self.low, self.high = 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.due, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.due, self.code = 2, b & 0x0F
                self.low, self.high = 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.due, self.code = 3, b & 0x07
                self.low, self.high = 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        left, self.due = "�" if self.due else "", 0
        return left


class Tokenizer:
    """Texts to ids and back under one vocabulary; keeps the ids of stretches seen before (bounded)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 300_000):
        self.machine = Transducer(ranks)
        self.split = regex.compile(pattern)
        # where no white space follows white space, a blank begins a match of the pattern and any other
        # white space is a match by itself, so such texts can be cut at blanks and line feeds first
        self.odd = regex.compile(r"[\s\x1c-\x1f](?:[\s\x1c-\x1f]|\Z)|[\x1c-\x1f]")
        self.memo = _Memo(self._encode, memo)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.tokens = tokens
        self.whole = np.array([t.isascii() or self._is_whole(t) for t in tokens])
        self.steps: dict[tuple, tuple] = {}
        self.most_steps = 200_000

    @staticmethod
    def _is_whole(token: bytes) -> bool:
        machine = Utf8Machine()
        return machine.feed(token).encode() == token and not machine.due

    def _encode(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per stretch)."""
        out: list[int] = []
        ends = []
        for stretch in stretches:
            for piece in self.split.findall(stretch):
                out += self.machine.encode_piece(piece.encode())
            ends.append(len(out))
        return np.array(out, np.int32), np.diff(np.array(ends, np.int64), prepend=0)

    def stretches(self, text: str) -> list[str]:
        """Consecutive parts of the text, each a run of whole matches of the pattern."""
        if self.odd.search(text):
            return self.split.findall(text)
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            if first:
                out.append(first)
            out += [" " + x for x in rest]
            out.append("\n")
        out.pop()
        return out

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text)."""
        parts, counts = [], []
        for text in texts:
            got = self.stretches(text) if text else []
            parts += got
            counts.append(len(got))
        return self.memo.gather(parts, counts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 of the texts, bytes per text): the ids of each text run through the UTF-8 machine.

        From its first state the machine returns to it over a token of whole characters, and gives
        that token's bytes; such runs are gathered at once.  Tokens that begin or end inside a
        character step the machine, by transitions kept once met; what is open where a whole token
        or the text's end comes is malformed, and gives U+FFFD.
        """
        starts, sizes, source = self.starts[ids], self.sizes[ids], self.bytes
        odd = np.flatnonzero(~self.whole[ids])
        if len(odd):
            row = np.searchsorted(np.cumsum(counts), odd, "right").tolist()
            extra, begin, length = bytearray(), [], []
            state, places = Utf8Machine().state, odd.tolist()
            for k, place in enumerate(places):
                given, state = self._step(state, int(ids[place]))
                begin.append(len(source) + len(extra))
                extra += given
                if state[0] and (k + 1 == len(places) or places[k + 1] != place + 1 or row[k + 1] != row[k]):
                    extra += "\ufffd".encode()
                    state = Utf8Machine().state
                length.append(len(source) + len(extra) - begin[-1])
            starts[odd], sizes[odd] = begin, length
            source = np.concatenate([source, np.frombuffer(bytes(extra), np.uint8)])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return source[_ragged(starts, sizes)], ends[at[1:]] - ends[at[:-1]]

    def _step(self, state: tuple[int, int, int, int], token: int) -> tuple[bytes, tuple[int, int, int, int]]:
        """(UTF-8 given, next state) of the machine over one token."""
        key = (state, token)
        known = self.steps.get(key)
        if known is None:
            machine = Utf8Machine(state)
            known = machine.feed(self.tokens[token]).encode(), machine.state
            if len(self.steps) >= self.most_steps:
                self.steps.clear()
            self.steps[key] = known
        return known

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of a stream of ids, each part as soon as its characters are whole."""
        machine = Utf8Machine()
        for i in ids:
            if part := machine.feed(self.tokens[i]):
                yield part
        if part := machine.close():
            yield part


class _Memo(dict):
    """Strings to places in a store of their ids.

    Once it holds ``most`` strings, those met only once since the last time go, or all if few would.
    """

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most
        self.new: list[str] = []
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.ids, self.starts, self.sizes, self.met = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        again = np.flatnonzero(self.met > 1)
        if len(again) > self.most // 2:
            return self._empty()
        keys = list(self)
        ids, sizes = self.ids[_ragged(self.starts[again], self.sizes[again])], self.sizes[again]
        self.clear()
        self.update((keys[i], k) for k, i in enumerate(again.tolist()))
        self.ids, self.sizes, self.starts, self.met = ids, sizes, np.cumsum(sizes) - sizes, np.zeros(len(again), np.int64)

    def __missing__(self, key: str) -> int:
        at = self[key] = len(self)
        self.new.append(key)
        return at

    def gather(self, parts: list[str], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of texts cut into ``counts`` parts each."""
        if len(self) >= self.most:
            self._shrink()
        which = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        if self.new:
            flat, sizes = self.encode(self.new)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.ids, self.sizes, self.new = np.concatenate([self.ids, flat]), np.concatenate([self.sizes, sizes]), []
            self.met = np.concatenate([self.met, np.zeros(len(sizes), np.int64)])
        self.met += np.bincount(which, minlength=len(self.met))
        sizes = self.sizes[which]
        ids = self.ids[_ragged(self.starts[which], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return ids, ends[at[1:]] - ends[at[:-1]]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at ``starts``, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


@cache
def _tokenizer(name: str, pattern: str) -> Tokenizer:
    with open(SparkFiles.get(name), "rb") as f:
        return Tokenizer(read_ranks(f), pattern)


def ship(df: DataFrame, path: str) -> str:
    """Sends a vocabulary file to the executors; returns the name under which they find it."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """Adds ids (array of int) and decoded (binary: UTF-8 of the ids' text) to the columns ``keep`` of ``docs``.

    Whole texts, no special tokens.  A null or empty text has no ids and decodes to no bytes.
    Columns of ``docs`` named like an added one are replaced.
    """
    added = ["ids", "decoded"]
    keep = [c for c in (keep or docs.columns) if c not in added]
    name = ship(docs, ranks_path)
    source = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    schema = docs.select(*keep).withColumns({"ids": F.lit(None).cast("array<int>"), "decoded": F.lit(None).cast("binary")}).schema
    for f in schema.fields:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(name, pattern)
        for batch in batches:
            text = text_column(batch, "__text")
            for row, end, _, _ in blocks(text, 1 << 20):
                ids, counts = t.encode_batch(text.slice(row, end - row).to_pylist())
                data, sizes = t.decode(ids, counts)
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists(ids, counts, pa.int32()), decoded], [*keep, *added])

    return source.mapInArrow(run, schema)
