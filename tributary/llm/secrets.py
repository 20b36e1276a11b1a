"""Secret scans with structural confirmation.

Base patterns name places by their look (assignments, access keys, hex runs).  Beside these, runs
that could be base64 or hex are decoded, and reported only if what they hold parses: DER keys
(nested lengths that fit exactly), OpenSSH key blobs (length-prefixed strings), and signed tokens
(JSON header that names an algorithm).  Code wrapped over lines is joined first.  Confirmed kinds: ``der``, ``ssh``, ``jwt``.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import blocks, lists, table, text_column, word_spans

#: The order in which kinds with one start are listed.
KINDS = ("assign", "access", "hex", "jwt", "ssh", "der")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_SEEDS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = table(b"0123456789abcdef")
_CODE = table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.")
_SEGMENT = re.compile(rb"[A-Za-z0-9_-]+")
#: A run of each alphabet is tried as a whole; a run that mixes them is not one value, but may hold one.
_B64 = (re.compile(rb"[A-Za-z0-9+/]{40,}={0,2}"), re.compile(rb"[A-Za-z0-9_-]{40,}={0,2}"))
#: Code at the end of a line, carried on at the starts of the next ones, through indents, quotes and the like.
_WRAP = re.compile(rb"""(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:(?:["'][ \t]{0,2}[+,\\]?|[,\\]|)[ \t]{0,2}\r?\n[ \t>#*|]*["']?[A-Za-z0-9+/_-]++)+={0,2}""")
_PART = re.compile(rb"""(?:^|(?<=\n))[ \t>#*|]*["']?([A-Za-z0-9+/_-]+)""")
_HEXRUN = re.compile(rb"(?:[0-9a-fA-F]{2}){32,}")
_PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]++)-----([A-Za-z0-9+/=\s]++)-----END \1-----")
#: The names with which SSH key blobs start.
_SSH = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
_OPENSSH = b"openssh-key-v1\0"
#: Strings that a key blob, or keys that a private key file, may hold at most.
_MEMBERS = 16
SPAN = "array<struct<kind:string,start:long,stop:long,base:boolean,confirmed:string>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("confirmed", pa.string())])


def decode64(run: bytes) -> bytes | None:
    """The bytes of a base64 run of either alphabet, padded or not; None if it isn't one."""
    body = run.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    try:
        return base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill data[at:end] exactly; None if they don't."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or at + wide > end:
                return None
            size, at = int.from_bytes(data[at : at + wide], "big"), at + wide
            if size < 0x80:
                return None
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE over all of the data, whose members nest exactly and include a long number or string."""
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    long_member, todo, depth = False, [(top[0][1], top[0][2], 0)], 0
    while todo:
        a, b, depth = todo.pop()
        items = der_items(data, a, b)
        if items is None or depth > 12:
            return False
        for tag, x, y in items:
            if tag & 0x20:
                todo.append((x, y, depth + 1))
            elif tag in (0x02, 0x03, 0x04):
                long_member |= y - x >= 16
            elif tag not in (0x01, 0x05, 0x06, 0x0C, 0x13):
                return False
    return long_member


def _strings(read: Callable[[int, int], bytes], at: int, count: int, limit: int) -> list[int] | None:
    """Ends of ``count`` length-prefixed strings from ``at`` on; None if one ends behind ``limit``."""
    out = []
    for _ in range(count):
        size = read(at, 4)
        if len(size) < 4 or at + 4 + int.from_bytes(size, "big") > limit:
            return None
        at += 4 + int.from_bytes(size, "big")
        out.append(at)
    return out


def _blob_ends(read: Callable[[int, int], bytes], at: int, limit: int) -> list[int]:
    """Where a key blob that starts at ``at`` may end: after two or more strings, the first of which names its kind."""
    size = int.from_bytes(read(at, 4), "big")
    if size > 64 or read(at + 4, size) not in _SSH:
        return []
    out, at = [], at + 4 + size
    for _ in range(_MEMBERS - 1):
        end = _strings(read, at, 1, limit)
        if end is None:
            break
        at = end[0]
        out.append(at)
    return out


def ssh_ends(read: Callable[[int, int], bytes], limit: int) -> list[int]:
    """Lengths, longest first, that an SSH key may have by its own account: a key blob, or an OpenSSH private key.

    The latter is parsed to its end: cipher, derivation and its options, the number of keys, that many
    public keys (each a blob that fills its string) and the private part, in whole blocks of eight.
    ``read(at, n)`` gives bytes, so that only lengths and names are read.
    """
    if read(0, len(_OPENSSH)) != _OPENSSH:
        return _blob_ends(read, 0, limit)[::-1]
    head = _strings(read, len(_OPENSSH), 3, limit)
    if head is None or not 0 < head[0] - len(_OPENSSH) - 4 <= 64:
        return []
    count = int.from_bytes(read(head[2], 4), "big")
    ends = _strings(read, head[2] + 4, count + 1, limit) if 1 <= count <= _MEMBERS else None
    if ends is None:
        return []
    starts = [head[2] + 4, *ends]
    if any(end not in _blob_ends(read, start + 4, end) for start, end in zip(starts, ends[:-1], strict=False)):
        return []
    private = ends[-1] - starts[-2] - 4
    return [ends[-1]] if private >= 16 and private % 8 == 0 else []


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key, or a key blob of length-prefixed strings, that fills the data exactly."""
    return len(data) in ssh_ends(lambda at, n: data[at : at + n], len(data))


def _json(part: bytes) -> object:
    try:
        return json.loads(decode64(part) or b"")
    except (ValueError, RecursionError):
        return None


def is_signed_token(run: bytes) -> bool:
    """Three dotted parts, the first a JSON object with an algorithm, the second a JSON object."""
    head, body, _ = run.split(b".", 2)
    head = _json(head)
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(_json(body), dict)


def signed_tokens(run: bytes) -> list[tuple[int, int]]:
    """(start, end) of the signed tokens in a run, from the left, without overlap; every part is decoded once as a header at most."""
    if run.count(b".") < 2:
        return []
    parts = [m.span() for m in _SEGMENT.finditer(run)]
    out, done = [], 0
    for k, (a, b) in enumerate(parts[:-1]):
        c, d = parts[k + 1]
        if a < done or b - a < 8 or d - c < 2 or c != b + 1 or run[b : b + 1] != b"." or run[d : d + 1] != b".":
            continue
        end = parts[k + 2][1] if k + 2 < len(parts) and parts[k + 2][0] == d + 1 else d + 1
        if is_signed_token(run[a:end]):
            out.append((a, end))
            done = end
    return out


def confirm(value: bytes) -> str | None:
    """What a decoded candidate is: ``ssh`` or ``der``."""
    return "ssh" if is_ssh_key(value) else "der" if is_der_key(value) else None


def _der_size(head: bytes) -> list[int]:
    """The length that a DER key says it has."""
    wide = head[1] & 0x7F if head[1] & 0x80 else 0
    return [2 + wide + int.from_bytes(head[2 : 2 + wide], "big")] if 1 <= wide <= 4 else [2 + head[1]] if not wide else []


def _at64(code: bytes, start: int) -> Callable[[int, int], bytes]:
    """Reads bytes of the base64 code that starts at ``start``."""

    def read(at: int, n: int) -> bytes:
        first = start + at // 3 * 4
        got = decode64(code[first : first + -(-(at % 3 + n) // 3) * 4]) or b""
        return got[at % 3 : at % 3 + n]

    return read


def _at16(code: bytes, start: int) -> Callable[[int, int], bytes]:
    return lambda at, n: _unhex(code[start + 2 * at : start + 2 * (at + n)]) or b""


def _any(places: list[int], start: int, stop: int) -> bool:
    k = bisect_left(places, start)
    return k < len(places) and places[k] < stop


def wrapped(text: bytes, start: int, stop: int) -> list[tuple[int, int, str]]:
    """(start, end, kind) of keys in the code lines text[start:stop], joined from one line's start to another's end."""
    parts = [(start + m.start(1), start + m.end(1)) for m in _PART.finditer(text[start:stop])]
    code = b"".join(text[a:b] for a, b in parts)
    at = [0]
    for a, b in parts:
        at.append(at[-1] + b - a)
    ends = {x: k for k, x in enumerate(at)}
    plus, dash = ([m.start() for m in re.finditer(x, code)] for x in (rb"[+/]", rb"[_-]"))  # the two alphabets, which one key doesn't mix
    out, k = [], 0
    while k < len(parts) - 1:
        step = 1
        for read, chars in ((decode64, lambda n: -(-n * 4 // 3)), (_unhex, lambda n: 2 * n)):
            head = read(code[at[k] : at[k] + 32]) or b""
            sizes = _der_size(head) if head[:1] == b"\x30" and len(head) >= 6 else []
            if not sizes and (head[:12] == _OPENSSH[:12] or head[4:8] in (b"ssh-", b"ecds")):
                left = len(code) - at[k]
                sizes = ssh_ends((_at64 if read is decode64 else _at16)(code, at[k]), left * 3 // 4 if read is decode64 else left // 2)
            for size in sizes:
                last = ends.get(at[k] + chars(size), 0)
                if last <= k + 1:
                    continue
                if read is decode64 and _any(plus, at[k], at[last]) and _any(dash, at[k], at[last]):
                    continue
                body = code[at[k] : at[last]]
                if (value := read(body)) and (kind := confirm(value)):
                    b = parts[last - 1][1]
                    out.append((parts[k][0], b + len(re.match(rb"={0,2}", text[b : b + 2])[0]), kind))
                    step = last - k
                    break
            if step > 1:
                break
        k += step
    return out


def _unhex(run: bytes) -> bytes | None:
    try:
        return binascii.unhexlify(run)
    except (binascii.Error, ValueError):
        return None


def find(text: bytes, base_hex: list[tuple[int, int]], rich: list[tuple[int, int]], lines: bool = False) -> list[tuple[int, int, int, bool, str | None]]:
    """(kind, start, end, base, confirmed) of a text, in bytes; ``rich`` are its long runs of code characters; ``lines``: code may go on over lines."""
    out = []
    low = text.lower()
    seeds = []
    for seed in _SEEDS:
        at = low.find(seed)
        while at >= 0:
            seeds.append(at)
            at = low.find(seed, at + 1)
    done = 0
    for at in sorted(seeds):  # from the left, without overlap, as one search over the text would
        if at >= done and (m := _ASSIGN.match(text, at)):
            done = m.end()
            if m.end(2) - m.start(2) >= 12:
                value = m[2]
                out.append((0, m.start(), m.end(), True, _inner(value)))
    if b"AKIA" in text:
        out += [(1, m.start(), m.end(), True, None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    for a, b in base_hex:
        value = binascii.unhexlify(text[a:b]) if (b - a) % 2 == 0 else b""
        out.append((2, a, b, True, confirm(value)))
    taken = []
    for m in _PEM.finditer(text) if b"-----BEGIN " in text else ():
        value = decode64(b"".join(m[2].split()))
        if value and (kind := confirm(value)):
            out.append((KINDS.index(kind), m.start(), m.end(), False, kind))
            taken.append((m.start(), m.end()))
    for a, b in rich:
        if _meets(taken, a, b):
            continue
        run = text[a:b]
        out += [(3, a + x, a + y, False, "jwt") for x, y in signed_tokens(run)]
        for m in (m for p in _B64 for m in p.finditer(run)):
            value = decode64(m[0])
            if value and (kind := confirm(value)):
                out.append((KINDS.index(kind), a + m.start(), a + m.end(), False, kind))
        for m in _HEXRUN.finditer(run):
            if kind := confirm(binascii.unhexlify(m[0])):
                out.append((KINDS.index(kind), a + m.start(), a + m.end(), False, kind))
    whole = [(a, b, kind) for m in (_WRAP.finditer(text) if lines else ()) for a, b, kind in wrapped(text, m.start(), m.end()) if not _meets(taken, a, b)]
    if whole:  # one of their lines may look like a key by itself
        starts = [a for a, _, _ in whole]
        inside = lambda x: (k := bisect_right(starts, x[1]) - 1) >= 0 and x[2] <= whole[k][1]
        out = [x for x in out if x[3] or not inside(x)] + [(KINDS.index(kind), a, b, False, kind) for a, b, kind in whole]
    return sorted(set(out), key=lambda x: (x[1], x[0], x[2]))


def _meets(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether any of the spans, which are in order and apart, has a place in a to b."""
    k = bisect_left(spans, (b,)) - 1
    return k >= 0 and spans[k][1] > a


def _inner(value: bytes) -> str | None:
    if value.count(b".") == 2 and is_signed_token(value):
        return "jwt"
    data = decode64(value)
    return confirm(data) if data else None


def scan_block(data: np.ndarray, at: np.ndarray) -> tuple[list[dict], np.ndarray]:
    """(spans in order of rows, spans per row), with places in code points."""
    rows = len(at) - 1
    counts, spans = np.zeros(rows, np.int64), []
    if not len(data):
        return spans, counts
    hot = set()
    hexes: dict[int, list[tuple[int, int]]] = {}
    s, e, _ = word_spans(data, at, _HEX)
    for k in np.flatnonzero(e - s >= 16):
        row = int(np.searchsorted(at, s[k], "right")) - 1
        hexes.setdefault(row, []).append((int(s[k] - at[row]), int(e[k] - at[row])))
    rich: dict[int, list[tuple[int, int]]] = {}
    s, e, _ = word_spans(data, at, _CODE)
    for k in np.flatnonzero(e - s >= 40):
        row = int(np.searchsorted(at, s[k], "right")) - 1
        rich.setdefault(row, []).append((int(s[k] - at[row]), int(e[k] - at[row])))
    near = e[e - s >= 16]  # words that end at most six bytes before the end of a line
    near = near[(data[np.minimum(near[:, None] + np.arange(7), len(data) - 1)] == 10).any(1)]
    lines = set((np.searchsorted(at, near - 1, "right") - 1).tolist())
    joined = data.tobytes()
    for low, seeds in ((joined.lower(), _SEEDS), (joined, (b"AKIA", b"-----BEGIN "))):
        for seed in seeds:
            place = low.find(seed)
            while place >= 0:
                row = int(np.searchsorted(at, place, "right")) - 1
                hot.add(row)
                place = low.find(seed, int(at[row + 1]))
    for row in sorted(hot | hexes.keys() | rich.keys() | lines):
        text = joined[at[row] : at[row + 1]]
        found = find(text, hexes.get(row, []), rich.get(row, []), row in lines)
        if not found:
            continue
        chars = np.zeros(len(text) + 1, np.int64)
        np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=chars[1:])
        spans += [{"kind": KINDS[k], "start": int(chars[a]), "stop": int(chars[b]), "base": base, "confirmed": kind} for k, a, b, base, kind in found]
        counts[row] = len(found)
    return spans, counts


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds secrets (spans by start, then kind; places in code points, end exclusive) to ``keep``.

    A null or empty text has none.  ``base`` tells places of the base patterns from those reported
    only because they decode to a key or token; ``confirmed`` names what a value decodes to.
    A column of ``docs`` named secrets is replaced.
    """
    keep = [c for c in (keep or docs.columns) if c != "secrets"]
    source = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    schema = docs.select(*keep).withColumn("secrets", F.lit(None).cast(SPAN)).schema
    for f in schema.fields:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, at in blocks(text_column(batch, "__text")):
                spans, counts = scan_block(data, at)
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists(pa.array(spans, _SPAN), counts)], [*keep, "secrets"])

    return source.mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every reported span (spans that meet: as one) replaced by ``mark``; n_chars follows.

    Documents without spans stay as they are.  Null texts stay null.
    """
    found = scan(docs)

    def piece(acc, x):
        # acc: text so far, and the place up to which the text is used
        fresh = x["start"] >= acc["at"]
        return F.struct(
            F.when(fresh, F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], x["stop"]).alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    clean = F.aggregate("secrets", start, piece, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    text = F.when(F.size("secrets") > 0, clean).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
