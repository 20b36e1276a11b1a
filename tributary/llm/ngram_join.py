"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is its set of distinct five-word shingles, held as 64-bit hashes in one global order:
rare first, by a sketch of shingle counts over all documents.  Its l-prefix holds the first
``n - t + l`` of them (t: the smallest overlap a linked partner needs); linked documents share at
least ``min(l, l')`` prefix shingles.  Each document lengthens its prefix while the sketch promises
that asking for more shared shingles saves more verification than the longer prefix costs.

Hashes are keyed by random numbers of the run, so that no text can be written to collide.  Classes and
components are the result, so groups of copies need no pairs: documents with one set are one node,
named by a 64-bit print of the set; a second print under another key tells sets apart whose first
prints agree, and then names them.  Pairs that link by hashes are compared word by word.  In turns, every node is tried against stars of its prefix
shingles, and what links becomes one component; then all pairs of nodes in different components that
share enough prefix shingles are verified, so no link between components is lost: a few pairs of each two
components first, and the others where these did not link them.

Before texts are compared, a parity signature (bit h is set where an odd number of the set's shingles
falls on h) bounds the symmetric difference of two sets from below: every bit in which two signatures
differ needs a shingle that only one set holds.  Pairs that the bound rules out make no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Scratch, components
from ._text import blocks, mix, span_hashes, table, text_column, word_spans

WORDS, PER_CENT = 5, 75
SKETCH_BITS = 18
_SEGMENTS = 64
#: Bits of the signature that rows carry into joins, and of the shortest whole signature.
_SHORT, _LEAST = 512, 2048
_S = [f"s{k}" for k in range(_SHORT // 64)]
#: So many of a node's first shared prefix shingles tell whether a pair has met before.
_FIRST = 8
_TURNS = 6
#: Meetings of components for each row that the last step takes on rather than have another turn.
_MEET = 32
#: Members of a component that documents beside it try, and pairs of two components that the last step tries first.
_STARS = 3
#: A shingle that the sketch counts this often above its noise is dealt to several tasks.
_HOT = 50_000
_LEVELS = np.array([1, 2, 3, 4, 6, 8, 12])
_U = np.uint64
_WORD = ~table(b" \t\n\x0b\x0c\r")
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 0x20


def _grams(word: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The shingle hashes of each text in its order, from its words' hashes; fewer words than ``WORDS`` are one shingle."""
    ends = np.cumsum(counts)
    gram = word.copy()
    if len(word) >= WORDS:
        gram = word[: len(word) - WORDS + 1].copy()
        for k in range(1, WORDS):
            gram = gram * _U(0x9E3779B97F4A7C15) + word[k : len(word) - WORDS + 1 + k]
        gram = mix(gram + _U(WORDS))
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= WORDS:
            out.append(gram[end - n : end - WORDS + 1])
        elif n:
            whole = word[end - n : end - n + 1].copy()
            for k in range(1, n):
                whole = whole * _U(0x9E3779B97F4A7C15) + word[end - n + k]
            out.append(mix(whole + _U(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingles(data: np.ndarray, at: np.ndarray, key: int = 0) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text under a key."""
    s, e, counts = word_spans(data, at, _WORD)
    return [np.unique(x) for x in _grams(span_hashes(_LOW[data], s, e, key), counts)]


@dataclass(frozen=True)
class Prints:
    """How a run names sets: the keys of the two prints, the bits of the first one, the first prints that several sets have."""

    keys: tuple[int, int]
    bits: int = 64
    shared: frozenset[int] = frozenset()

    def both(self, data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
        """(set, first print, second print) of each text; the second is made of hashes of the words under its own key."""
        s, e, counts = word_spans(data, at, _WORD)
        low, out = _LOW[data], []
        for x, y in zip(*(_grams(span_hashes(low, s, e, k), counts) for k in self.keys), strict=True):
            tokens, first = np.unique(x, return_index=True)
            out.append((tokens, node_of(tokens) >> (64 - self.bits), node_of(y[first])))
        return out

    def named(self, data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """(set, node) of each text: its first print, or the second where several sets have that."""
        if self.shared:
            return [(x, alt if node in self.shared else node) for x, node, alt in self.both(data, at)]
        return [(x, node_of(x) >> (64 - self.bits)) for x in shingles(data, at, self.keys[0])]


def words_link(left: bytes, right: bytes) -> bool:
    """Whether two texts link, decided by the words themselves."""
    a, b = left.lower().split(), right.lower().split()
    if min(len(a), len(b)) < WORDS:
        return bool(a) and a == b
    words = a + b
    number = {w: k for k, w in enumerate(set(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    # a run's number is made of its words' numbers; where it would be too large, the runs so far are numbered anew
    runs, size = ids, len(number)
    for k in range(1, WORDS):
        if size * len(number) >= 1 << 63:
            runs = np.unique(runs, return_inverse=True)[1]
            size = len(runs)
        runs = runs[:-1] * len(number) + ids[k:]
        size *= len(number)
    x, y = np.unique(runs[: len(a) - WORDS + 1]), np.unique(runs[len(a) :])
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= PER_CENT * (len(x) + len(y) - common)


def node_of(tokens: np.ndarray) -> int:
    """A 64-bit print that stands for a set: two sums of its mixed hashes and its size, mixed."""
    sums = np.array([np.sum(mix(tokens)), np.sum(mix(tokens ^ _U(0xD6E8FEB86659FD93)))], np.uint64)
    return int(mix(mix(sums[:1] + _U(len(tokens))) ^ sums[1:]).view(np.int64)[0])


def signature(tokens: np.ndarray) -> np.ndarray:
    """The parity bits of a set as 64-bit words: two bits a shingle or more, ``_LEAST`` at least, a power of two.

    Half as many bits are the two halves, one over the other (xor).
    """
    bits = max(_LEAST, 1 << max(0, 2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & _U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def could_link(na: int, nb: int, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether signatures allow a link: sets that link differ in a seventh of both sizes at most."""
    size = min(len(a), len(b))
    return 7 * int(np.bitwise_count((folded(a, size) ^ folded(b, size)).view(np.uint64)).sum()) <= na + nb


def overlap_needed(n: int) -> int:
    """The least overlap of a set of n with any set it links to."""
    return -(-PER_CENT * n // 100)


def prefix(tokens: np.ndarray, sketch: np.ndarray, noise: int) -> tuple[np.ndarray, int]:
    """(prefix shingles, matches to ask for) of a set.

    Estimated cost of level l: its entries, their meetings with other documents' entries, and the
    verification of the documents that can reach l meetings.
    """
    n, t = len(tokens), overlap_needed(len(tokens))
    seen = sketch[(tokens >> _U(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((tokens, seen))
    levels = _LEVELS[_LEVELS <= t]
    sizes = n - t + levels
    meet = np.cumsum(np.maximum(seen[order[: sizes[-1]]].astype(np.int64) - noise, 0))[sizes - 1]
    best = int(np.argmin(4 * sizes + meet + 40 * meet / levels))
    return tokens[order[: sizes[best]]], int(levels[best])


def _summaries(docs: DataFrame, prints: Prints) -> DataFrame:
    """A row per document (id, node, alt, n, signatures) and, for each partition, its counts of shingles in segments."""
    names = ["id", "n", "node", "alt", *_S, "sig", "segment", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        seen: set[int] = set()
        for batch in batches:
            for row, end, data, at in blocks(text_column(batch)):
                sets, nodes, alts = zip(*prints.both(data, at), strict=True)
                marks = [signature(x) for x in sets]
                for node, tokens in zip(nodes, sets, strict=True):
                    if node not in seen:
                        seen.add(node)
                        np.add.at(sketch, (tokens >> _U(64 - SKETCH_BITS)).astype(np.int64), 1)
                n = end - row
                short = np.stack([folded(x, len(_S)) for x in marks])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, n), pa.array([len(x) for x in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(alts, pa.int64()), *(pa.array(short[:, k]) for k in range(len(_S))), pa.array([x.tobytes() for x in marks], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        parts = [x.astype("<u4").tobytes() for x in np.minimum(sketch, 0xFFFFFFFF).reshape(_SEGMENTS, -1)]
        if sketch.any():
            none = pa.nulls(_SEGMENTS, pa.int64())
            yield pa.RecordBatch.from_arrays([*[none] * (4 + len(_S)), pa.nulls(_SEGMENTS, pa.binary()), pa.array(range(_SEGMENTS), pa.int32()), pa.array(parts, pa.binary())], names)

    fields = ", ".join(f"{s} long" for s in _S)
    return docs.mapInArrow(run, f"id long, n long, node long, alt long, {fields}, sig binary, segment int, counts binary")


def _add_counts(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the count vectors of a partition's rows by segment."""
    total: dict[int, np.ndarray] = {}
    for batch in part:
        for segment, counts in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            values = np.frombuffer(counts, "<u4").astype(np.int64)
            total[segment] = total[segment] + values if segment in total else values
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes() for x in total.values()], pa.binary())], ["segment", "counts"])


def read_sketch(summaries: DataFrame) -> np.ndarray:
    """The counts over all documents; of fixed size (2**18 counters), whatever the corpus."""
    part = summaries.where("segment is not null").select("segment", "counts").mapInArrow(_add_counts, "segment int, counts binary")
    rows = part.repartition(8, "segment").mapInArrow(_add_counts, "segment int, counts binary").collect()
    sketch = np.zeros((_SEGMENTS, (1 << SKETCH_BITS) // _SEGMENTS), np.int64)
    for r in rows:
        sketch[r["segment"]] = np.frombuffer(r["counts"], "<u4")
    return np.minimum(sketch.reshape(-1), 0xFFFFFFFF).astype(np.uint32)


def noise_of(counts: np.ndarray) -> int:
    """What a counter holds of ordinary shingles: the middle, and four deviations of the middle half of the counters."""
    middle = np.median(counts)
    return int(middle + 6 * np.median(np.abs(counts - middle))) + 1


def _postings(docs: DataFrame, sketch: np.ndarray, prints: Prints) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        noise = noise_of(counts)
        seen: set[int] = set()
        for batch in batches:
            for row, end, data, at in blocks(text_column(batch)):
                tokens, nodes, metas, lens, salts = [], [], [], [], []
                ids = batch.column("id").slice(row, end - row)
                for known, (found, node) in zip(ids.is_valid().to_pylist(), prints.named(data, at), strict=True):
                    # a copy's entries would say what its first copy's do
                    if not len(found) or not known or node in seen:
                        continue
                    seen.add(node)
                    part, need = prefix(found, counts, noise)
                    tokens.append(part)
                    nodes.append(node)
                    metas.append((((len(found) << 28) + np.arange(1, len(part) + 1)) << 4) + need)
                    lens.append(len(part))
                    heat = (counts[(part >> _U(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64) - noise) // _HOT
                    salts.append(np.where(heat > 0, 1 + (node & 0xFFFFFFFF) % (np.maximum(heat, 0) + 1), 0))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), lens)), pa.array(np.concatenate(metas)), pa.array(np.concatenate(salts).astype(np.int32))], ["token", "node", "meta", "salt"])

    return docs.mapInArrow(run, "token long, node long, meta long, salt int")


def _verify(pairs: DataFrame, key: int) -> DataFrame:
    """Pairs whose texts link: those that do by hashes are compared by words.

    The right texts come in runs, so the last one's set is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, bytes, np.ndarray] | None = None
        for batch in batches:
            b = batch.column("b").to_pylist()
            left, right = text_column(batch, "left"), text_column(batch, "right")
            keep = []
            lefts: list[np.ndarray] = []
            for _, _, data, at in blocks(left):
                lefts += shingles(data, at, key)
            for k, (y, x) in enumerate(zip(b, lefts, strict=True)):
                text = right[k].as_py().encode()
                if last is None or last[:2] != (y, text):
                    data = np.frombuffer(text, np.uint8)
                    last = y, text, shingles(data, np.array([0, len(data)]), key)[0]
                common = len(np.intersect1d(x, last[2], assume_unique=True))
                near = 100 * common >= PER_CENT * (len(x) + len(last[2]) - common) and common > 0
                keep.append(near and words_link(left[k].as_py().encode(), text))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return pairs.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


_MAP_WORDS = 1 << 17


def _among(docs: DataFrame, ids: DataFrame, repeats: bool) -> DataFrame:
    """The documents with these ids; of equal rows one, where ids repeat.

    A bitmap of the ids' hashes, of fixed size (2**23 bits), drops most other documents before their
    texts shuffle; where so many ids come that it is full, all texts shuffle.
    """
    word, bit = F.pmod(F.xxhash64("id"), F.lit(_MAP_WORDS)).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(64)).cast("int")
    bitmap = ids.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    near = docs.where("id is not null").withColumn("word", word).join(F.broadcast(bitmap), "word")
    near = near.where(F.call_function("shiftrightunsigned", F.col("bits"), bit).bitwiseAND(F.lit(1)) == 1).select("id", "text")
    found = near.join(ids.hint("merge"), "id", "left_semi")
    return found.groupBy("id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).drop("h") if repeats else found


_PAIR = ["a", "b", "ida", "idb"]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
        x, y = batch.column("siga"), batch.column("sigb")
        keep = pa.array([could_link(int(a[k]), int(b[k]), np.frombuffer(x[k].as_py(), np.int64), np.frombuffer(y[k].as_py(), np.int64)) for k in range(batch.num_rows)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in _PAIR], _PAIR)


def near(forms: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole signatures allow a link, with the ids of a document of each."""
    side = lambda c: forms.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}{c}") for x in ("id", "n", "sig")])
    both = pairs.select("a", "b").hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    return both.select(*_PAIR, "na", "nb", "siga", "sigb").mapInArrow(_near, "a long, b long, ida long, idb long")


def verified(docs: DataFrame, pairs: DataFrame, repeats: bool, key: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts link.

    Sort-merge joins at every size: what small inputs broadcast would not be small on large ones.
    """
    texts = _among(docs, pairs.select(F.explode(F.array("ida", "idb")).alias("id")).distinct(), repeats)
    left = pairs.hint("merge").join(texts.select(F.col("id").alias("ida"), F.col("text").alias("left")), "ida")
    both = left.hint("merge").join(texts.select(F.col("id").alias("idb"), F.col("text").alias("right")), "idb")
    out = _verify(both, key)
    return out.distinct() if repeats else out


def _parts(meta: str, tail: str = "") -> dict:
    """(n, pos, need) of a posting: the set's size, the shingle's place in its order, the matches to ask for."""
    m = F.col(meta)
    return {f"n{tail}": F.shiftright(m, 32), f"pos{tail}": F.shiftright(m, 4).bitwiseAND(F.lit((1 << 28) - 1)), f"need{tail}": m.bitwiseAND(F.lit(15))}


def _could(na: str, pa_: str, da: str, nb: str, pb: str, db: str) -> str:
    """Whether a shared shingle lies in both prefixes that count for this pair.

    A link takes an overlap of t = 3/7 of both sizes, so the first n - t + l shingles of either set
    share l, for the l both ask for; the sizes must allow a link at all.
    """
    return f"7 * ({pa_} - least({da}, {db})) <= 4 * {na} - 3 * {nb} and 7 * ({pb} - least({da}, {db})) <= 4 * {nb} - 3 * {na}"


def _meet(rows: DataFrame) -> DataFrame:
    """Per pair: shared shingles, last places, sizes, matches to ask for."""
    return rows.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("posa").alias("la"), F.max("posb").alias("lb"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.min(F.least("needa", "needb")).alias("need"))


def star_pairs(near: DataFrame, tries: int = 2) -> DataFrame:
    """(a, b): for each document its likeliest partners among its shingles' stars.

    ``near(node, meta, star, star_meta)`` has a row per shingle and document; ``tries`` partners share
    most shingles with the document.  Which pairs are tried here has no bearing on the result:
    ``cross_pairs`` covers the rest.
    """
    near = near.where("node <> star").withColumns(_parts("meta", "a") | _parts("star_meta", "b")).where(_could("na", "posa", "needa", "nb", "posb", "needb"))
    met = _meet(near.withColumn("a", F.col("node")).withColumn("b", F.col("star")))
    met = met.where("7 * (c + least(na - la, nb - lb)) >= 3 * (na + nb)")
    best = met.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("c"), "b"))).where(F.col("r") <= tries)
    return best.select("a", "b")


def next_stars(mine: DataFrame, turn: int, stars: int = _STARS) -> DataFrame:
    """Rows for ``star_pairs`` once components are known: a shingle's stars are documents of its largest component;
    documents of that component are left out.

    One is the shingle's own, by a hash that changes with the turn.  The others are the component's, ``stars`` at
    most and the same for all its shingles: a document beside it meets a star in every shingle that both hold, so
    what they share is counted whole.
    """
    hashed = lambda c, *more: F.xxhash64(c, F.lit(turn), *map(F.lit, more))
    key = F.least("size", F.lit(1 << 30)) * (1 << 32) + F.pmod(hashed("node"), F.lit(1 << 32))
    own = mine.groupBy("token").agg(F.max_by("node", key).alias("star"), F.max_by("meta", key).alias("star_meta"), F.max_by("component", key).alias("other"))
    if not stars:
        return mine.join(own, "token").where("component <> other")
    several = mine.where("size > 1")
    heads = several.groupBy("component").agg(F.array_distinct(F.array(*[F.max_by("node", hashed("node", k)) for k in range(stars)])).alias("heads"))
    heads = heads.select(F.col("component").alias("other"), F.explode("heads").alias("star"))
    shared = several.select("token", F.col("node").alias("star"), F.col("meta").alias("star_meta"), F.col("component").alias("other"))
    shared = shared.join(heads, ["other", "star"]).join(own.select("token", "other"), ["token", "other"]).select("token", "star", "star_meta", "other")
    return mine.join(own.unionByName(shared).distinct(), "token").where("component <> other")


def labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings of shingles that stand in several components, with component and its size in nodes."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    known = labels.join(sizes, "component").select("node", "component", "size")
    mine = entries.join(known, "node", "left").select("token", "node", "meta", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))
    mixed = mine.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    return mine.join(mixed, "token", "left_semi")


def crossings(mine: DataFrame) -> tuple[int, int]:
    """What meets in the part of the prefixes that counts for sets of one size, once for each shingle.

    (pairs of components, pairs of a component and a further member of the shingle's largest one: what
    the last step need not compare where a few of these pairs link).
    """
    near = mine.withColumns(_parts("meta")).where("7 * (pos - need) <= n")
    each = near.groupBy("token", "component").agg(F.count("*").alias("n")).groupBy("token").agg(F.count("*").alias("m"), F.max("n").alias("top"))
    left, wide = each.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2), F.sum((F.col("m") - 1) * (F.col("top") - 1))).first()
    return left or 0, wide or 0


def meetings(scratch: Scratch, mine: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row per node and list of nodes that it shares shingles with, a row per list and component).

    Shingles with one and the same list are one.  ``x`` names the list, ``pos`` is the first of its
    shingles' places, ``first`` the node's first ``_FIRST`` lists in the global order, ``many`` how
    many of the node's component stand in the list; the second table has bounds of their sizes,
    places and matches to ask for.
    """
    mark = F.xxhash64("node")
    lists = mine.groupBy("token").agg(F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"), F.sum(F.shiftrightunsigned(mark, 32)).alias("hi"), F.count("*").alias("k"))
    named = mine.join(lists.select("token", F.xxhash64("lo", "hi", "k").alias("x")), "token").withColumns(_parts("meta"))
    rows = scratch.write(named.groupBy("node", "x").agg(F.min("pos").alias("pos"), F.first("n").alias("n"), F.first("need").alias("need"), F.first("component").alias("component")), "lists")
    first = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "x"))), 1, _FIRST).alias("first")).select("node", F.col("first.x").alias("first"))
    kinds = scratch.write(rows.groupBy("x", "component").agg(F.count("*").alias("many"), F.min("n").alias("small"), F.max("n").alias("large"), F.min("pos").alias("early"), F.max("need").alias("most")), "kinds")
    met = rows.hint("merge").join(kinds.select("x", "component", "many"), ["x", "component"]).join(first, "node").join(forms.select("node", *_S), "node")
    return scratch.write(met, "met"), kinds


def _differ(x: str, y: str) -> str:
    return " + ".join(f"bit_count({x}.{s} ^ {y}.{s})" for s in _S)


def _new(x: str, y: str) -> str:
    """Whether two nodes that meet in a list could link by their signatures, and have not met in an earlier list.

    Lists have one order for all nodes, so where the places of one common list allow a link, those
    of the first one do.
    """
    return f"7 * ({_differ(x, y)}) <= {x}.n + {y}.n and coalesce(get(array_intersect({x}.first, {y}.first), 0) = {x}.x, true)"


def cross_pairs(met: DataFrame, kinds: DataFrame) -> DataFrame:
    """(a, b, ca, cb, need): nodes of different components ca and cb that meet in a list of ``meetings`` and could link: all of them.

    Nodes that stand alone for their component meet each other; components with several are
    paired first (with bounds of their members' places), so a large component's members meet only
    the few nodes outside it, never each other.
    """
    one = met.where("many = 1")
    room = _could("p.n", "p.pos", "p.need", "q.n", "q.pos", "q.need")
    end = lambda t, c: F.struct(F.col(f"{t}.node").alias("node"), F.col(f"{t}.{c}").alias("component"))
    pair = lambda own: [end("p", own).alias("p"), end("q", "component").alias("q"), F.least("p.need", "q.need").alias("need")]
    alone = one.alias("p").join(one.alias("q"), F.expr(f"p.x = q.x and p.node < q.node and {room} and {_new('p', 'q')}")).select(*pair("component"))
    wide = "7 * (u.early - least(u.most, v.most)) <= 4 * u.large - 3 * v.small and 7 * (v.early - least(u.most, v.most)) <= 4 * v.large - 3 * u.small"
    # the side with more members is u
    two = kinds.where("many > 1").alias("u").join(kinds.alias("v"), F.expr(f"u.x = v.x and struct(u.many, u.component) > struct(v.many, v.component) and {wide}"))
    two = two.select(F.col("u.x").alias("x"), F.col("u.component").alias("other"), F.col("v.component").alias("component"))
    fewer = met.join(two, ["x", "component"]).select("x", F.col("other").alias("component"), F.col("component").alias("own"), "node", "n", "pos", "need", "first", *_S)
    mixed = fewer.alias("p").join(met.where("many > 1").alias("q"), F.expr(f"p.x = q.x and p.component = q.component and {room} and {_new('p', 'q')}")).select(*pair("own"))
    both = alone.unionByName(mixed).select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "need")
    ends = [F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.col("p.component").alias("ca"), F.col("q.component").alias("cb")]
    return both.groupBy(*ends).agg(F.min("need").alias("need"))


def matched(mine: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, ca, cb) that share as many prefix shingles as both ask for."""
    more = pairs.where("need > 1")
    used = more.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = mine.join(used.hint("merge"), "node", "left_semi").groupBy("node").agg(F.collect_list("token").alias("tokens"))
    side = lambda c: own.select(F.col("node").alias(c), F.col("tokens").alias(f"t{c}"))
    both = more.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    known = ["a", "b", "ca", "cb"]
    return pairs.where("need = 1").select(*known).unionByName(both.where(F.size(F.array_intersect("ta", "tb")) >= F.col("need")).select(*known))


def some_of(pairs: DataFrame) -> DataFrame:
    """(a, b): of the pairs (a, b, ca, cb) between two components ``_STARS`` at most, by hashes.

    Where these link, the components are one, and their other pairs, as many as the product of their sizes, are not needed.
    """
    picked = F.array_distinct(F.array(*[F.min_by(F.struct("a", "b"), F.xxhash64("a", "b", F.lit(k))) for k in range(_STARS)]))
    return pairs.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(picked.alias("p")).select(F.explode("p").alias("p")).select("p.a", "p.b")


def still_apart(pairs: DataFrame, labels: DataFrame, tried: DataFrame) -> DataFrame:
    """The pairs (a, b) that were not ``tried`` and whose components ca and cb are still two by ``labels``.

    Components are looked up once for each two of them, not for each pair.
    """
    two = pairs.select("ca", "cb").distinct()
    for c in ("ca", "cb"):
        now = labels.select(F.col("node").alias(c), F.col("component").alias(f"now_{c}"))
        two = two.join(now.hint("merge"), c, "left")
    two = two.where(F.coalesce("now_ca", "ca") != F.coalesce("now_cb", "cb")).select("ca", "cb")
    return pairs.hint("merge").join(two, ["ca", "cb"], "left_semi").select("a", "b").join(tried.hint("merge"), ["a", "b"], "left_anti")


def join(docs: DataFrame, id_col: str = "doc_id", print_bits: int = 64) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of ``docs(id_col, text)``; ids are integers.

    Two documents link when their sets' Jaccard similarity is 0.75 or more; component_id is the
    smallest id reachable by links, the own id without any.  Null and empty texts, and texts of
    white space, have no shingles and link with nothing.  Rows with one id are one document, whose
    texts all link; a null id links with nothing and has a null component.  An empty table gives no row.
    With any ``print_bits`` (of the first print of a set) the rows are the same.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), "text")
    prints = Prints((uuid4().int >> 64 | 1, uuid4().int >> 64 | 1), print_bits)
    summaries = scratch.write(_summaries(docs, prints), "summaries")
    rows = summaries.where("segment is null").select("id", "n", "node", "alt", *_S, "sig")
    kinds = lambda t: t.where("n > 0 and id is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), *[F.first(s).alias(s) for s in _S], F.first("sig").alias("sig"), F.min("alt").alias("alt"), F.max("alt").alias("other"))
    forms = scratch.write(kinds(rows), "forms")
    # about N * N / 2 ** 65 first prints of N sets stand for several
    shared = frozenset(r["node"] for r in forms.where("alt <> other").select("node").collect())
    if shared:
        prints = replace(prints, shared=shared)
        rows = rows.withColumn("node", F.when(F.col("node").isin(list(shared)), F.col("alt")).otherwise(F.col("node")))
        forms = scratch.write(kinds(rows), "forms-apart")
    some = rows.where("n > 0 and id is not null").select("id", "n", "node")
    rows = rows.select("id", "n", "node")
    sketch = read_sketch(summaries)
    together = W.partitionBy("token", "salt")
    entries = _postings(docs, sketch, prints).withColumn("s", F.min(F.struct("node", "meta")).over(together)).withColumn("top", F.max("node").over(together))
    # a hot shingle's postings stay, since another salt's documents may hold it; copies in several partitions have equal ones
    entries = entries.where("s.node <> top or salt > 0").select("token", "salt", "node", "meta", F.col("s.node").alias("star"), F.col("s.meta").alias("star_meta")).distinct()
    entries = scratch.write(entries.drop("salt"), "entries")
    scratch.release()
    # an id with several texts ties their nodes
    tied = some.groupBy("id").agg(F.min("node").alias("b"), F.count("*").alias("k")).where("k > 1").select("id", "b")
    links = [scratch.write(some.join(tied, "id").select(F.col("node").alias("a"), "b").where("a <> b").distinct(), "tied")]
    repeats = not tied.isEmpty()
    joined = lambda: reduce(DataFrame.unionByName, links)  # noqa: E731  the components so far, and what is new
    most = rows.count()
    pairs = scratch.write(near(forms, star_pairs(entries)), "tried0")
    before = None
    for turn in range(1, _TURNS + 1):
        links.append(scratch.write(verified(docs, pairs, repeats, prints.keys[0]), f"links{turn}"))
        scratch.drop(f"tried{turn - 1}")
        scratch.release()
        labels = components(scratch, joined(), f"labels{turn}-")
        links = [labels.select(F.col("node").alias("a"), F.col("component").alias("b"))]
        mine = scratch.write(labelled(entries, labels), f"mine{turn}")
        left, wide = crossings(mine)
        # a further turn pays where many components still meet and the last one joined many
        if turn == _TURNS or left <= _MEET * most or (before is not None and left > 0.7 * before):
            break
        before = left
        pairs = scratch.write(near(forms, star_pairs(next_stars(mine, turn, 0))), f"tried{turn}")
        scratch.drop(f"mine{turn}")
        scratch.release()
    scratch.drop("entries")
    scratch.release()
    pairs = scratch.write(cross_pairs(*meetings(scratch, mine, forms)), "cross")
    scratch.drop("lists", "kinds", "met")
    pairs = scratch.write(matched(mine, pairs), "matched")
    scratch.drop(f"mine{turn}", "cross")
    scratch.release()
    if wide:  # some pairs of each two components first
        first = scratch.write(some_of(pairs), "first")
        links.append(scratch.write(verified(docs, scratch.write(near(forms, first), "close"), repeats, prints.keys[0]), "some"))
        labels = components(scratch, joined(), "joined")
        links = [labels.select(F.col("node").alias("a"), F.col("component").alias("b"))]
        pairs = scratch.write(still_apart(pairs, labels, first), "apart")
        scratch.drop("matched", "first", "close", "some")
        scratch.release()
    links.append(scratch.write(verified(docs, scratch.write(near(forms, pairs), "close"), repeats, prints.keys[0]), "rest"))
    scratch.drop("matched", "apart", "close")
    scratch.release()
    labels = scratch.write(components(scratch, joined(), "last"), "components")
    # joined as tables, so that a class with many copies can be split between tasks
    placed = scratch.write(rows.hint("merge").join(labels, "node", "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("component")), "placed")
    heads = scratch.write(placed.where("component is not null").groupBy("component").agg(F.min("id").alias("head")), "heads")
    return placed.hint("merge").join(heads, "component", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("head", "id")).alias("component_id"))
