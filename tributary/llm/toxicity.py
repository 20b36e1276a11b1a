"""Toxicity: disguised words are restored through a noisy channel, then the restored text is scored.

Stretches that look disguised (digits or symbols for letters, letters apart, letters repeated, letters
of other scripts, invisible characters) become lattices: every sign offers the characters it may stand
for, or nothing.  Viterbi search picks the reading that is likeliest under a character language model
of the whole corpus.  A logistic model over the words of the restored text, their beginnings and their
ends gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, give_back
from ._text import blocks, lists, mix, row_of, span_hashes, table, text_column, word_spans

# What a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
}
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Costs in nats of reading a sign as a letter, as itself, as nothing, of letting a repeated letter go, and one that may well be double.
_AS_LETTER, _AS_ITSELF, _AS_NOTHING, _AGAIN, _DOUBLE = 1.0, 12.0, 9.0, 0.5, 12.0

#: Symbols of the language model: no letter, a to z, any other character beyond ASCII.
SYMBOLS = 28
_CODE = np.zeros(256, np.uint8)
_CODE[0x61:0x7B] = _CODE[0x41:0x5B] = np.arange(1, 27)
_CODE[0xC0:] = 27
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 0x20
_U = np.uint64

_OTHER = "\u0370-\u03ff\u0400-\u04ff"
_SEEN = rf"0-9@$!|+*€£{_INVISIBLE}{_OTHER}"
_DISGUISED = re.compile(
    rf"(?P<apart>(?<!\S)[A-Za-z0-9@$!|](?:[ ._*~-]{{1,2}}[A-Za-z0-9@$!|]){{2,}}(?![^\W_]))"
    rf"|[A-Za-z][0-9@$!|+*€£]+[A-Za-z]|(?<![A-Za-z{_SEEN}])[0-9@$!|]{{1,2}}[A-Za-z]{{2}}"
    rf"|([A-Za-z])(?i:\2)\2|(?:([A-Za-z])\3){{3}}|[A-Za-z][{_INVISIBLE}{_OTHER}]|[{_OTHER}][A-Za-z]"
)
_DOUBLES = re.compile(r"(?:([A-Za-z])\1){3}")
_DECORATION = re.compile(r"(?:[!|+*€£]+|[@$]{3,})+\Z")
_IN_REGION = re.compile(rf"[A-Za-z{_SEEN}]+")
_LETTER, _LEET = table([*range(0x41, 0x5B), *range(0x61, 0x7B)]), table(b"0123456789@$!|+*")
_BEYOND = table([0xC2, 0xCC, 0xCD, 0xCE, 0xCF, *range(0xD0, 0xD4), 0xE2, 0xEF])
_ONE, _APART, _BLANK = table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"@$!|"]), table(b" ._*~-"), table([*range(0x21), *range(0x80, 0x100)])
_WORD = table([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def count_grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each four symbols stand in a row in the texts; a text starts and ends with no letter."""
    keep = (data & 0xC0) != 0x80  # continuation bytes belong to the character before
    shift = np.concatenate([[0], np.cumsum(keep)])[at]
    code = _CODE[data[keep]].astype(np.int64)
    rows = len(at) - 1
    padded = np.zeros(len(code) + 3 * rows + 1, np.int64)  # three symbols of no letter before each text, one at the end
    padded[np.arange(len(code)) + 3 * (row_of(np.diff(shift)) + 1)] = code
    gram = ((padded[:-3] * SYMBOLS + padded[1:-2]) * SYMBOLS + padded[2:-1]) * SYMBOLS + padded[3:]
    return np.bincount(gram, minlength=SYMBOLS**4)


def language_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities of a symbol after three others, from the counts of all texts.

    Each order is smoothed by the one below (five pseudo-counts).  The table has 28^4 cells for any corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            for _, _, data, at in blocks(text_column(batch)):
                total += count_grams(data, at)
        cells = np.flatnonzero(total)
        for k in range(0, len(cells), 10_000):
            some = cells[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["cell", "n"])

    got = docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**4)
    if len(got):
        counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    low = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(1, 5):
        n = counts.reshape(-1, *[SYMBOLS] * order).sum(0)
        low = (n + 5.0 * low) / (n.sum(-1, keepdims=True) + 5.0)
    return np.log(low).ravel()


class Restorer:
    """Viterbi search through the lattices of disguised stretches."""

    def __init__(self, model: np.ndarray):
        self.logp = memoryview(np.ascontiguousarray(model))
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def text(self, text: str) -> str:
        """The text with its disguised stretches restored; all else stays."""
        out, done = [], 0
        for m in _DISGUISED.finditer(text):
            start, end = m.span()
            if start < done and end <= done:
                continue
            if not m.group("apart"):
                while start > done and _IN_REGION.match(text[start - 1]):
                    start -= 1
                end = _IN_REGION.match(text, max(start, done)).end() if _IN_REGION.match(text, max(start, done)) else end
            start = max(start, done)
            out += [text[done:start], self.region(text[start:end], bool(m.group("apart")))]
            done = end
        return "".join([*out, text[done:]]) if out else text

    def region(self, region: str, apart: bool = False) -> str:
        key = ("." if apart else "") + region
        got = self.young.get(key) or self.old.get(key)
        if got is None:
            got = self._decode(region, apart)
        if len(region) <= 48:
            self.young[key] = got
            if len(self.young) > 20_000:
                self.young, self.old = {}, self.young
        return got

    def _slots(self, region: str, apart: bool) -> list[list[tuple[int, str, float]]]:
        """For each sign the (symbol, character, cost) it may be read as; symbol -1 is nothing."""
        slots, before, run = [], "", 0
        again = region.lower()
        all_double = bool(_DOUBLES.search(region))
        for k, ch in enumerate(region):
            low = ch.lower()
            run = run + 1 if low == before else 1
            before = low
            if apart and ch in " ._*~-":
                options = [(-1, "", 0.0), (0, ch, 1.0)]
            elif "a" <= low <= "z":
                options = [(ord(low) - 96, low, 0.0)]
            elif ch in _INVISIBLE:
                options = [(-1, "", 0.0)]
            elif low in SIGNS:
                options = [(ord(x) - 96, x, _AS_LETTER) for x in SIGNS[low]] + [(27 if ch > "\x7f" else 0, ch, _AS_ITSELF)]
                if not ch.isalnum():
                    options.append((-1, "", _AS_NOTHING))
            else:
                options = [(27 if ch > "\x7f" else 0, ch, 0.0)]
            if run == 2:
                options.append((-1, "", _AGAIN if all_double or again[k + 1 : k + 2] == low else _DOUBLE))
            elif run > 2:
                options = [(-1, "", 0.0)]
            slots.append(options)
        return slots

    def _decode(self, region: str, apart: bool) -> str:
        if sum("a" <= c <= "z" for c in region.lower()) < 2 or not apart and not any(c.isalpha() for c in region):
            return region
        core = region if apart else _DECORATION.sub("", region)
        tail = region[len(core) :]
        front = len(core) - len(core.lstrip("!|+*€£"))
        head, core = (core[:front], core[front:]) if front > 1 else ("", core)
        logp, cut = self.logp, SYMBOLS**2
        ways: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for options in self._slots(core, apart):
            new: dict[int, tuple[float, tuple | None]] = {}
            for context, (score, path) in ways.items():
                for symbol, ch, cost in options:
                    if symbol < 0:
                        to, value, way = context, score - cost, path
                    else:
                        value, to, way = score - cost + logp[context * SYMBOLS + symbol], context % cut * SYMBOLS + symbol, (path, ch)
                    if to not in new or value > new[to][0]:
                        new[to] = (value, way)
            ways = new
        _, path = max(ways.items(), key=lambda x: (x[1][0] + logp[x[0] * SYMBOLS], x[0]))[1]
        out = []
        while path:
            path, ch = path
            out.append(ch)
        return head + "".join(reversed(out)) + tail


def suspects(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows that may hold a disguised stretch: none is missed, some hold none."""
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64)
    low = _LOW[data]
    letter, leet, beyond = _LETTER[data], _LEET[data], _BEYOND[data]
    sign = np.zeros(n, bool)
    sign[1:] |= leet[1:] & letter[:-1]
    sign[:-1] |= leet[:-1] & letter[1:]
    sign[1:-1] |= (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & letter[1:-1]
    sign[1:] |= beyond[1:] & letter[:-1] & _strange(data)[1:]
    sign[:-1] |= letter[1:] & (data[:-1] >= 0x80) & _strange_end(data)[:-1]
    one, apart, start = np.zeros(n + 6, bool), np.zeros(n + 6, bool), np.zeros(n, bool)
    one[:n], apart[:n] = _ONE[data], _APART[data]
    start[at[:-1][at[:-1] < n]] = True
    start[1:] |= _BLANK[data[:-1]]
    third = one[: n + 3] & apart[1 : n + 4] & (one[2 : n + 5] | apart[2 : n + 5] & one[3 : n + 6])
    sign |= start & one[:n] & apart[1 : n + 1] & (third[2 : n + 2] | apart[2 : n + 2] & third[3 : n + 3])
    if n > 5:
        two = letter[1:] & (low[1:] == low[:-1])
        sign[:-5] |= two[:-4] & two[2:-2] & two[4:]
    return np.unique(np.searchsorted(at, np.flatnonzero(sign), "right") - 1)


def _strange(data: np.ndarray) -> np.ndarray:
    """Where a Greek, Cyrillic, symbol or invisible character may begin (Latin letters with marks do not)."""
    out = _BEYOND[data]
    nxt = np.concatenate([data[1:], [0]])
    return out & ~((data == 0xC2) & (nxt != 0xAD) & (nxt != 0xA3))


def _strange_end(data: np.ndarray) -> np.ndarray:
    """Where the last byte of such a character may stand."""
    out = np.zeros(len(data), bool)
    lead = _strange(data)
    out[1:] |= lead[:-1]
    out[2:] |= lead[:-2] & (data[:-2] >= 0xE0)
    return out


def restored(texts: pa.Array, tool: Restorer) -> pa.Array:
    """The texts with disguised stretches restored."""
    out, done = [], 0
    for row, end, data, at in blocks(texts):
        for k in suspects(data, at).tolist():
            text = texts[row + k].as_py()
            new = tool.text(text)
            if new != text:
                out += [texts.slice(done, row + k - done), pa.array([new], texts.type)]
                done = row + k + 1
    return pa.concat_arrays([*out, texts.slice(done)]) if out else texts


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, row of each): 64-bit hashes of each text's words in lower case and of their first and last 4 to 6 bytes."""
    low = _LOW[data]
    s, e, counts = word_spans(low, at, _WORD)
    row = row_of(counts)
    out, rows = [span_hashes(low, s, e)], [row]
    for n in (4, 5, 6):
        some = np.flatnonzero(e - s > n)
        out += [mix(span_hashes(low, s[some], s[some] + n) + _U(n)), mix(span_hashes(low, e[some] - n, e[some]) + _U(100 + n))]
        rows += [row[some], row[some]]
    return np.concatenate(out).view(np.int64), np.concatenate(rows)


@dataclass
class Model:
    """The language model; chosen features in order and their weights; the bias."""

    grams: np.ndarray
    chosen: np.ndarray
    weights: np.ndarray
    bias: float


def _present(model_features: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place among the chosen) of each chosen feature of each row, once."""
    feats, rows = features(data, at)
    if not len(model_features) or not len(feats):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    filter_ = np.zeros(1 << 16, bool)
    filter_[(model_features.view(_U) >> _U(48)).astype(np.int64)] = True
    some = np.flatnonzero(filter_[(feats.view(_U) >> _U(48)).astype(np.int64)])
    place = np.minimum(np.searchsorted(model_features, feats[some]), len(model_features) - 1)
    hit = model_features[place] == feats[some]
    key = np.unique(rows[some][hit] * len(model_features) + place[hit])
    return key // len(model_features), key % len(model_features)


def fit(rows: np.ndarray, places: np.ndarray, y: np.ndarray, size: int, ridge: float = 0.1, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on 0/1 features, by Newton steps with halving."""
    x = np.zeros((len(y), size + 1), np.float32)
    x[rows, places] = 1
    x[:, size] = 1
    penalty = np.full(size + 1, ridge)
    penalty[size] = 1e-3
    w = np.zeros(size + 1)
    loss = lambda w: float(np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w)).sum() + 0.5 * (penalty * w * w).sum())
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p)).astype(np.float32)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        size_of = 1.0
        while size_of > 1e-4 and (new := loss(w - size_of * step)) > now:
            size_of /= 2
        if size_of <= 1e-4:
            break
        w, gained, now = w - size_of * step, now - new, new
        if gained < 1e-6 * max(now, 1e-9):
            break
    return w[:-1], float(w[-1])


def sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_rows: int, max_texts: int) -> DataFrame:
    """(label, text) of at most about ``max_rows`` labelled ids, half of them at most of label 1, chosen by a hash of the id.

    Ids with null or contradicting labels are left out.  An id gives at most ``max_texts`` texts that differ.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("label"), F.max(label_col).alias("__top")).where("label = __top").drop("__top")
    n = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.pmod(F.xxhash64(F.col(id_col), F.lit("toxic")), F.lit(1_000_003)) / 1_000_003
    ones = min(n.get(1, 0), max_rows // 2)
    limit = F.when(F.col("label") == 1, ones / max(n.get(1, 1), 1)).otherwise((max_rows - ones) / max(n.get(0, 1), 1))
    chosen = marked.where(share < limit)
    rows = docs.select(id_col, "text").join(F.broadcast(chosen), id_col).select(id_col, "label", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates([id_col, "text"])
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64("text"), "text"))
    return rows.withColumn("__k", first).where(F.col("__k") <= max_texts).select(id_col, "label", "text")


def train(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", label_col: str = "toxic", max_rows: int = 10_000, max_texts: int = 4, max_features: int = 1_000, ridge: float = 1.0, share_kept: float = 0.2) -> Model:
    """Fit on the documents that ``labels(id_col, label_col)`` marks 0 or 1; the language model counts all of ``corpus`` (default: ``docs``).

    The classifier is fitted on a bounded sample (``max_rows`` ids, ``max_texts`` texts of each); of all
    features of its restored texts it takes the ``max_features`` that tell most of label 1.
    Without both classes there are no features, and the score is the class that there is (0 without any).
    """
    scratch = Scratch(docs.sparkSession)
    grams = language_model(corpus if corpus is not None else docs)
    shared = docs.sparkSession.sparkContext.broadcast(grams)  # of fixed size
    chosen = scratch.write(sample(docs, labels, id_col, label_col, max_rows, max_texts), "sample")

    def ready(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Restorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), restored(text_column(batch), tool)], ["label", "text"])

    texts = scratch.write(chosen.repartition(F.xxhash64("text")).select(F.col("label").cast("int").alias("label"), "text").mapInArrow(ready, "label int, text string"), "texts")
    n = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model(grams, np.zeros(0, np.int64), np.zeros(0), 50.0 if n.get(1) else -50.0)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy()
            for row, _, data, at in blocks(text_column(batch)):
                feats, rows = features(data, at)
                pairs = np.unique(np.rec.fromarrays([feats, rows]))
                found, where, n_docs = np.unique(pairs.f0, return_inverse=True, return_counts=True)
                ones = np.bincount(where, label[row + pairs.f1], minlength=len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n_docs.astype(np.int64)), pa.array(ones)], ["feature", "n", "ones"])

    base = n[1] / (n[0] + n[1])
    rate = (F.col("ones") + F.lit(base)) / (F.col("n") + 1)
    worth = (F.col("ones") * F.log(rate / base)).alias("worth")
    best = texts.mapInArrow(tally, "feature long, n long, ones long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).where((F.col("ones") >= 1) & (rate >= min(2 * base, (1 + base) / 2) - 1e-9))
    picked = np.sort(np.array([r[0] for r in best.select("feature", worth).orderBy(F.desc("worth"), "feature").limit(max_features).collect()], np.int64))

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, at in blocks(text_column(batch)):
                rows, places = _present(picked, data, at)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(row, end - row), lists(places, np.bincount(rows, minlength=end - row), pa.int32())], ["label", "places"])

    got = texts.mapInArrow(matrix, "label int, places array<int>").orderBy("label", "places").toArrow()
    y = got.column("label").to_numpy().astype(np.float64)
    held = got.column("places").combine_chunks()
    counts = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows, places = row_of(counts), held.flatten().to_numpy()
    # each row also stands with most of its features left out, so that one of several telling words is enough by itself
    kept = np.random.default_rng(7).random(len(rows)) < share_kept
    told = np.zeros(len(y), bool)
    told[rows[kept]] = True
    order = np.cumsum(told) - 1 + len(y)
    weights, bias = fit(np.concatenate([rows, order[rows[kept]]]), np.concatenate([places, places[kept]]), np.concatenate([y, y[told]]), len(picked), ridge)
    scratch.drop("sample", "texts")
    del got, held
    give_back()
    return Model(grams, picked, weights, bias)


def score(docs: DataFrame, trained: Model, keep: list[str] | None = None, threshold: float = 0.3, with_text: bool = False) -> DataFrame:
    """Adds score (0 to 1; higher: label 1 likelier) and predicted (1 if score >= ``threshold``) to ``keep``; with ``with_text`` also the restored text.

    A null or empty text has no features; the bias alone decides.  Texts are restored and scored whole.
    Columns of ``docs`` named like an added one are replaced.
    """
    added = ["score", "predicted", *(["restored"] if with_text else [])]
    keep = [c for c in (keep or docs.columns) if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(trained)  # of fixed size
    source = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    extra = {"score": F.lit(0.0), "predicted": F.lit(0)} | ({"restored": F.lit("")} if with_text else {})
    schema = docs.select(*keep).withColumns(extra).schema
    for f in schema.fields:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tool = Restorer(model.grams)
        for batch in batches:
            texts = restored(text_column(batch, "__text"), tool)
            for row, end, data, at in blocks(texts):
                rows, places = _present(model.chosen, data, at)
                margin = model.bias + np.bincount(rows, model.weights[places], minlength=end - row)
                value = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(value), pa.array((value >= threshold).astype(np.int32)), *([texts.slice(row, end - row)] if with_text else [])], [*keep, *added])

    return source.mapInArrow(run, schema)
