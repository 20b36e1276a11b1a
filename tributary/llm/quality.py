"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams (of words, and of the words' shapes) are scaled by the log-count ratios of the
two classes; on these a linear hinge-loss model is fitted by dual coordinate descent.  Features are
hashed to a fixed width, so model and scoring memory do not depend on the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, give_back
from ._text import blocks, mix, row_of, span_hashes, table, text_column, word_spans

BITS = 18
_U = np.uint64
_WORD = ~table(b" \t\n\x0b\x0c\r")
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 0x20
_UPPER, _LETTER, _DIGIT = (table(x) for x in (range(0x41, 0x5B), [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)], range(0x30, 0x3A)))


@dataclass
class NbSvm:
    """Per hashed feature the weight (ratio times coefficient) and the squared ratio; bias; scale of the margin in the score."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    scale: float = 4.0


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, features per row): the distinct hashed n-grams of each text.

    Words between white space, A-Z lower-cased: 1 and 2 in a row.  Shapes (kind of first and last
    character, case, length class, whether the word repeats the one before): 1 to 3 in a row.
    """
    rows = len(at) - 1
    s, e, counts = word_spans(data, at, _WORD)
    if not len(s):
        return np.zeros(0, np.int32), np.zeros(rows, np.int64)
    row = row_of(counts)
    word = span_hashes(_LOW[data], s, e)
    first, last = data[s], data[e - 1]
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    letter = np.concatenate([[0], np.cumsum(_LETTER[data])])
    size = e - s
    same = np.zeros(len(s), bool)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    ups = upper[e] - upper[s]
    case = np.where(ups == 0, 0, np.where(ups == letter[e] - letter[s], 3, np.where((ups == 1) & _UPPER[first], 1, 2)))
    kind = lambda c: np.where(_LETTER[c], 1, np.where(_DIGIT[c], 2, c.astype(np.int64) + 3))
    shape = (((kind(first) * 300 + kind(last)) * 4 + case) * 6 + np.searchsorted([1, 3, 7, 15, 31], size)) * 2 + same
    shape = mix(shape.astype(np.uint64) + _U(77))
    grams, owner = [word], [row]
    for seq, most in ((word, 2), (shape, 3)):
        if seq is shape:
            grams.append(mix(shape + _U(1)))
            owner.append(row)
        for n in range(2, most + 1):
            if len(seq) < n:
                continue
            gram = seq[: len(seq) - n + 1].copy()
            for k in range(1, n):
                gram = gram * _U(0x9E3779B97F4A7C15) + seq[k : len(seq) - n + 1 + k]
            ok = row[: len(gram)] == row[n - 1 :]
            grams.append(mix(gram[ok] + _U(n)))
            owner.append(row[: len(gram)][ok])
    key = (np.concatenate(owner).astype(np.int64) << BITS) | (np.concatenate(grams) >> _U(64 - BITS)).astype(np.int64)
    key = np.unique(key)
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.bincount(key >> BITS, minlength=rows)


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, smooth: float = 1.0, epochs: int = 12, seed: int = 7) -> NbSvm:
    """Fit on the feature lists and the 0/1 labels of rows; with one class only, the score is that class for all."""
    size = 1 << BITS
    if len(y) == 0 or y.min() == y.max():
        return NbSvm(np.zeros(size, np.float32), np.ones(size, np.float32), 0.0 if not len(y) else (1.0 if y[0] else -1.0))
    counts = [np.full(size, smooth), np.full(size, smooth)]
    for x, label in zip(rows, y, strict=True):
        counts[int(label)][x] += 1
    # share of the class's rows that hold the feature
    ratio = np.log(counts[1] / (np.sum(y == 1) + 2 * smooth)) - np.log(counts[0] / (np.sum(y == 0) + 2 * smooth))
    norm = [max(np.sqrt((v := ratio[x]) @ v), 1e-9) for x in rows]
    sign = np.where(y == 1, 1.0, -1.0)
    caps = np.where(y == 1, cost * len(y) / (2 * np.sum(y == 1)), cost * len(y) / (2 * np.sum(y == 0)))
    alpha, w, bias = np.zeros(len(y)), np.zeros(size), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            x = rows[i]
            v = (ratio[x] / norm[i]).astype(np.float32)  # made again each time: kept for all rows they take as much as the rows
            slope = sign[i] * (v @ w[x] + bias) - 1.0
            new = min(max(alpha[i] - slope / 2.0, 0.0), caps[i])  # rows have length 1, and a constant feature 1
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                w[x] += step * v
                bias += step
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return NbSvm((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), float(bias))


def margins(model: NbSvm, feats: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Margins of texts, each scaled to length 1 as in the fit."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0.0], np.cumsum(model.weights[feats], dtype=np.float64)])
    norm = np.concatenate([[0.0], np.cumsum(model.squares[feats], dtype=np.float64)])
    length = np.sqrt(np.maximum(norm[ends[1:]] - norm[ends[:-1]], 1e-18))
    return (total[ends[1:]] - total[ends[:-1]]) / length + model.bias


def packed(feats: np.ndarray) -> bytes:
    """A row's features, sorted and distinct, as compressed gaps."""
    return zlib.compress(np.diff(feats, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(gaps).view("<u4").ravel(), dtype=np.int64).astype(np.int32)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, at in blocks(text_column(batch)):
            feats, counts = features(data, at)
            each = pa.array([packed(x) for x in np.split(feats, np.cumsum(counts)[:-1])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(row, end - row), each], ["label", "features"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = 6_000, **options) -> NbSvm:
    """Fit on the documents that ``labels(id_col, label_col)`` marks 0 or 1.

    Reads at most about ``max_rows`` labelled ids (chosen by a hash of the id).  Ids with null or
    contradicting labels are left out; repeated documents count as often as they stand.
    """
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).alias("label"), F.max(label_col).alias("__top")).where("label = __top").drop("__top")
    n = marked.count()
    share = F.pmod(F.xxhash64(F.col(id_col), F.lit("quality")), F.lit(1_000_003)) / 1_000_003
    chosen = marked.where(share < max_rows / n) if n > max_rows else marked  # so it holds about max_rows rows at most
    rows = docs.select(id_col, "text").join(F.broadcast(chosen), id_col).select("label", "text")
    scratch = Scratch(docs.sparkSession)
    table = scratch.write(rows.mapInArrow(_extract, "label int, features binary"), "features")
    got = [(r["label"], unpacked(r["features"])) for r in table.toLocalIterator()]  # a part at a time, so that the driver never holds all parts twice
    scratch.drop("features")
    y = np.array([label for label, _ in got], np.int64)
    found = [x for _, x in got]
    order = np.argsort([zlib.crc32(x.tobytes()) for x in found], kind="stable").astype(int)  # whatever order rows arrive in
    model = fit([found[i] for i in order], y[order], **options)
    del got, found
    give_back()
    return model


def score(docs: DataFrame, trained: NbSvm, keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1; higher: label 1 likelier) and predicted (1 if score >= 0.5) to ``keep``.

    A null or empty text has no features; the bias alone decides.  Without training rows every score
    is 0.5.  Columns of ``docs`` named like an added one are replaced.
    """
    added = ["score", "predicted"]
    keep = [c for c in (keep or docs.columns) if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(trained)  # of fixed size
    source = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    schema = docs.select(*keep).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    for f in schema.fields:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for row, end, data, at in blocks(text_column(batch, "__text")):
                feats, counts = features(data, at)
                value = 1.0 / (1.0 + np.exp(-np.clip(model.scale * margins(model, feats, counts), -50, 50)))
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], [*keep, *added])

    return source.mapInArrow(run, schema)
