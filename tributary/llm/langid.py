"""Language identification by prediction by partial matching (PPM).

Every language has a variable-order byte context tree, frozen after training.  Coding a byte costs
its code length in the longest context the tree holds, escaping (method C, with exclusion) to
shorter contexts down to a uniform code; the language with the shortest code wins.  Since the
statistics are frozen, the exact code length of a byte is a function of its context node and the
byte alone: ``compile_model`` tabulates it, and ``predict`` looks up and adds these lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import give_back
from ._text import blocks, raw, table, text_column

ORDER = 3
_ASCII_LETTERS = table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_STEP = 1 << 18


@dataclass
class PpmModel:
    """langs[l] costs ``bits[node * n_codes + code, l]`` for byte code ``code`` in context ``node``.

    ``codes`` maps bytes to codes (the last code stands for all bytes not seen in training) and
    ``nodes`` maps the three codes before a byte to the deepest context held.
    """

    langs: list[str]
    codes: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray


def _grams(data: np.ndarray, at: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Each byte of [lo, hi) with the three before it, as 32 bits; a text starts after line feeds."""
    padded = np.full(hi - lo + ORDER, 10, np.uint32)
    left = min(lo, ORDER)
    padded[ORDER - left :] = data[lo - left : hi]
    out = padded[ORDER:].copy()
    for k in range(1, ORDER + 1):
        before = padded[ORDER - k : -k].copy()
        for j in range(k):  # bytes before a text's start are not its context
            i = at + j - lo
            i = i[(i >= 0) & (i < hi - lo)]
            before[i] = 10
        out |= before << np.uint32(8 * k)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        order = sorted(range(len(langs)), key=langs.__getitem__)
        text = text_column(batch).take(pa.array(order, pa.int64()))
        langs = [langs[i] for i in order]
        k = 0
        while k < len(langs):
            end = k + 1
            while end < len(langs) and langs[end] == langs[k]:
                end += 1
            data, at = raw(text.slice(k, end - k))
            for lo in range(0, len(data), _STEP):
                gram, n = np.unique(_grams(data, at[:-1], lo, min(lo + _STEP, len(data))), return_counts=True)
                old = held.get(langs[k])
                if old is not None:
                    both = np.concatenate([old[0], gram])
                    gram, inverse = np.unique(both, return_inverse=True)
                    n = np.bincount(inverse, weights=np.concatenate([old[1], n])).astype(np.int64)
                held[langs[k]] = (gram, n)
            k = end
    for lang, (gram, n) in held.items():
        for lo in range(0, len(gram), 50_000):
            part = slice(lo, lo + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram[part])), pa.array(gram[part].astype(np.int64)), pa.array(n[part].astype(np.int64))], ["lang", "gram", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", max_docs: int = 2000, max_cells: int = 3_000_000) -> PpmModel:
    """Fit on ``docs(id_col, text, lang)``.

    The fit reads at most about ``max_docs`` documents of each language (whole texts, chosen by a
    hash of the id); every language that occurs is learned.  ``max_cells`` bounds the table of code
    lengths (see ``compile_model``): contexts seen less often go first, by their share of their language, so that a rare
    language keeps as much as a frequent one.  Rows without lang or text are left out; without any
    row the model has no language.
    """
    rows = docs.select(id_col, "text", "lang").where("lang is not null and text is not null and length(text) > 0")
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return PpmModel([], np.zeros(256, np.int64), np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    share = F.pmod(F.xxhash64(F.col(id_col), F.lit("langid")), F.lit(1_000_003)) / 1_000_003
    keep = F.lit(False)
    for r in sizes:
        keep = keep | ((F.col("lang") == r["lang"]) & (share < float(max_docs) / r["count"]))
    counts = rows.where(keep).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    model = compile_model(counts, max_cells)
    del counts
    give_back()
    return model


def compile_model(counts: pa.Table, max_cells: int = 3_000_000, lang_cells: int = 200_000) -> PpmModel:
    """The table of exact code lengths from counts of (lang, 4-byte gram).

    It has at most ``max_cells`` cells of 4 bytes, or ``lang_cells`` for each language where that is more;
    contexts of orders 0 and 1 are held whatever that takes (codes squared for each language).
    """
    coded = counts.column("lang").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    gram, n = counts.column("gram").to_numpy().astype(np.int64), counts.column("n").to_numpy().astype(np.float64)
    langs = sorted(names)
    per_byte = np.bincount(gram & 255, weights=n, minlength=256)
    seen = np.flatnonzero(per_byte)
    size = len(seen) + 1
    codes = np.full(256, size - 1, np.int64)
    codes[seen] = np.arange(len(seen))
    part = [codes[(gram >> (8 * k)) & 255] for k in range(ORDER + 1)]  # the byte itself, then those before it
    keys = [np.zeros_like(gram), part[1], part[2] * size + part[1], (part[3] * size + part[2]) * size + part[1]]
    total = np.bincount(of, weights=n)
    fair = n * (total.max(initial=1.0) / np.maximum(total, 1.0))[of]
    # contexts held, by order; all of orders 0 and 1
    least = 2
    while True:
        held = [np.zeros(1, np.int64), np.arange(size)]
        for k in (2, 3):
            key, inverse = np.unique(keys[k], return_inverse=True)
            held.append(key[np.bincount(inverse, weights=fair) >= least])
        if sum(map(len, held)) * size * len(langs) <= max(max_cells, lang_cells * len(langs)) or not any(map(len, held[2:])):
            break
        least *= 2
    first = np.cumsum([0, *map(len, held)])
    bits = np.empty((first[-1], size, len(langs)), np.float32)
    for which, lang in enumerate(langs):
        mine = of == names.index(lang)
        shorter = tail = None  # counts in the contexts one byte shorter, and what follows their escape
        for k in range(ORDER + 1):
            count = np.zeros((len(held[k]), size))
            at = np.minimum(np.searchsorted(held[k], keys[k][mine]), max(len(held[k]) - 1, 0))
            ok = held[k][at] == keys[k][mine] if len(held[k]) else np.zeros(len(at), bool)
            np.add.at(count, (at[ok], part[0][mine][ok]), n[mine][ok])
            count[:, size - 1] = 0  # never seen, by definition
            if k == 0:
                after = np.full((1, size), np.log2(256.0 - np.count_nonzero(count)))
            else:
                suffix = np.searchsorted(held[k - 1], held[k] % size ** (k - 1))
                rest = np.where(count > 0, 0, shorter[suffix])  # symbols seen here are excluded below
                own, escape = _lengths(rest)
                after = np.where(rest > 0, own, escape + tail[suffix])
            own, escape = _lengths(count)
            bits[first[k] : first[k + 1], :, which] = np.where(count > 0, own, escape + after)
            shorter, tail = count, after
    nodes = np.full((size, size, size), 0, np.int32)
    nodes[:] = (first[1] + np.arange(size))[None, None, :]
    if len(held[2]):
        nodes[:, held[2] // size, held[2] % size] = first[2] + np.arange(len(held[2]))
    nodes.reshape(-1)[held[3]] = first[3] + np.arange(len(held[3]))
    return PpmModel(langs, codes, nodes.reshape(-1), bits.reshape(-1, len(langs)))


def _lengths(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code lengths of the symbols, of the escape) in each context by method C; an empty context's escape is free."""
    total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        own = -np.log2(count / (total + kinds))
        escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
    return own, escape


def code_lengths(model: PpmModel, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits to code each row's bytes, a column per language; whole rows in steps of bounded size."""
    out = np.zeros((len(at) - 1, len(model.langs)))
    size = int(model.codes.max()) + 1
    sizes = np.int32(size)
    codes = model.codes.astype(np.int32)
    for lo in range(0, len(data), _STEP):
        hi = min(lo + _STEP, len(data))
        own = codes[data[max(0, lo - ORDER) : hi]]
        skip = min(lo, ORDER)
        feed = codes[10]
        before = []
        i0 = at[:-1] - lo
        for k in range(1, ORDER + 1):
            c = np.full(hi - lo, feed, np.int32)
            src = own[max(0, skip - k) : len(own) - k]
            c[len(c) - len(src) :] = src
            for j in range(k):
                i = i0 + j
                c[i[(i >= 0) & (i < hi - lo)]] = feed
            before.append(c)
        at_node = model.nodes[(before[2] * sizes + before[1]) * sizes + before[0]]
        cost = model.bits.take(at_node.astype(np.int64) * size + own[skip:], axis=0)
        row0, row1 = int(np.searchsorted(at, lo, "right")) - 1, int(np.searchsorted(at, hi, "left"))
        begins = np.maximum(at[row0:row1], lo) - lo
        full = np.flatnonzero(np.diff(np.append(begins, hi - lo)) > 0)
        out[row0 + full] += np.add.reduceat(cost, begins[full], axis=0, dtype=np.float64)
    return out


def predict(docs: DataFrame, model: PpmModel, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score and bits_per_byte to the columns ``keep`` (default: all) of ``docs``.

    score is the winner's posterior probability under equal priors.  A text that is null or has no
    letter, or any text under a model without language, gives ``und``, score 0 and, where the text is
    empty, bits_per_byte null.  Equal code lengths go to the first language by name.
    Columns of ``docs`` named like an added one are replaced.
    """
    added = ["lang_pred", "score", "bits_per_byte"]
    keep = [c for c in (keep or docs.columns) if c not in added]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by max_cells, or by the number of languages
    source = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    schema = docs.select(*keep).withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0), "bits_per_byte": F.lit(0.0)}).schema
    for f in schema.fields:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            text = text_column(batch, "__text")
            for row, end, data, at in blocks(text):
                sizes = np.diff(at)
                hit = np.zeros(len(data) + 1, np.int64)
                np.cumsum(_ASCII_LETTERS[data], out=hit[1:])
                known = hit[at[1:]] > hit[at[:-1]]
                for i in np.flatnonzero(~known & (sizes > 0)):
                    known[i] = any(map(str.isalpha, text[row + int(i)].as_py()))
                if m.langs:
                    cost = code_lengths(m, data, at)
                    best = cost.argmin(1)
                    low = cost[np.arange(len(best)), best]
                    score = 1.0 / np.exp2(np.maximum(low[:, None] - cost, -1000.0)).sum(1)
                else:
                    known[:] = False
                    best, low, score = np.zeros(len(sizes), int), np.zeros(len(sizes)), np.zeros(len(sizes))
                best = np.where(known, best, len(m.langs))
                per_byte = pa.array(low / np.maximum(sizes, 1), mask=(sizes == 0) | (not m.langs))
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names[best], pa.string()), pa.array(np.where(known, score, 0.0)), per_byte], [*keep, *added])

    return source.mapInArrow(run, schema)
