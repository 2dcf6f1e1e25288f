"""Secret scans with a recursive decoding worklist.

Each text is scanned for assignments, access keys and long hex runs. Then its encoded
layers are unwrapped: percent escapes, ``\\u``/``\\x`` escapes, base64 tokens (also over
several lines, and at each of the four alignments, since a token may stand right behind
other letters), and what is compressed (zlib, gzip, bz2, xz, bare deflate; all members) at
any place of the bytes of any of these. Every layer goes on a worklist, is scanned, and
unwrapped in turn until nothing new appears. A layer is recognised by its text and place;
one that was seen before is not queued again, which ends cycles. Each layer carries the
places of its characters in the original text, so spans are always code point ranges of
the original (end exclusive).

No layer is dropped for what it holds: bytes that are no UTF-8 are read as latin-1, and
bytes with zeros also as both halves of UTF-16. Only layers in which no pattern can match
and nothing can be encoded (``LIVE``) are not queued. Base64 tokens have 16 characters or
more: the shortest span, an assignment of 12 bytes, needs as many.

Bounded memory: one text at a time; streams are unfolded in pieces and scanned in windows
of ``WINDOW`` bytes that overlap by ``OVERLAP``. Streams of one text that unfold to more
than ``max_inflated`` bytes in all are scanned up to there (``n_left`` is 1 then, else 0).

Defined results: a null text is empty and has no spans; rows that repeat are scanned
each; an empty table gives an empty result.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The patterns of the contract, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the greedy runs of 24 or more are the same spans
KINDS = ("assign", "access", "hex")
#: An assignment's first letters before the pattern is tried.
ASSIGN_HINT = re.compile(r"pass|secret|token|api_?key", re.IGNORECASE | re.ASCII)

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\})+")
ONE_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8}))")
PART = re.compile(r"[A-Za-z0-9]{16,}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 in lines: all but the last of 16 or more.
WRAPPED = re.compile(r"(?:(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}\r?\n[ \t]*)+[A-Za-z0-9+/_-]+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: Heads of zlib and gzip streams as escapes, and the bytes that follow.
PERCENT_PACKED = re.compile(r"%1[Ff]%8[Bb]|(?:%78|x)(?:%01|%5[Ee]|\^|%9[Cc]|%[Dd][Aa])")
PERCENT_BYTE = re.compile(r"%([0-9A-Fa-f]{2})()|[!-~]")
ESCAPE_PACKED = re.compile(r"\\(?:x|u00)1[Ff]\\(?:x|u00)8[Bb]|(?:\\(?:x|u00)78|x)(?:\\(?:x|u00)(?:01|5[Ee]|9[Cc]|[Dd][Aa])|\^)")
ESCAPE_BYTE = re.compile(r"\\(?:x|u00)([0-9A-Fa-f]{2})|\\([abfnrtv0'\"\\])|[ -\[\]-~]")
NAMED = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "0": 0, "'": 39, '"': 34, "\\": 92}

Spans = list[tuple[int, int, int]]  # (start, kind, end)


def scan(text: str) -> Spans:
    """Spans of one layer, in its own code points."""
    found: Spans = []
    if ASSIGN_HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


#: What a layer must have if it holds a span or a further layer.
LIVE = re.compile(rb"(?i:pass|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\|[A-Za-z0-9+/_-]{16}")
#: Heads of compressed streams.
HEAD = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00", re.DOTALL)
WINDOW, OVERLAP, PIECE = 1 << 24, 1 << 20, 256

Place = Callable[[int, int], tuple[int, int]]


class Layer:
    """A text and, for ranges of its characters, where they stand in the original:
    by lists, by a function, or the original itself."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None, place: Place | None = None):
        self.text, self.starts, self.ends, self.place = text, starts, ends, place

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.place is not None:
            return self.place(start, end)
        if self.starts is None or self.ends is None:
            return start, end
        return self.starts[start], max(self.ends[start:end])

    def key(self) -> tuple[bytes, tuple[int, int]]:
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), self.span(0, len(self.text))


class Budget:
    """Bytes that the streams of one text may still unfold to."""

    def __init__(self, most: int):
        self.rest, self.left = most, 0


def _replaced(layer: Layer, pattern: re.Pattern[str], decode) -> Layer | None:
    """A layer with every match of ``pattern`` decoded: ``decode`` gives (character,
    start, end) triples in the match's own positions, or None to leave it."""
    text: list[str] = []
    starts: list[int] = []
    ends: list[int] = []

    def copy(a: int, b: int) -> None:
        text.append(layer.text[a:b])
        if layer.place is not None:
            for i in range(a, b):
                s, e = layer.place(i, i + 1)
                starts.append(s)
                ends.append(e)
        elif layer.starts is None or layer.ends is None:
            starts.extend(range(a, b))
            ends.extend(range(a + 1, b + 1))
        else:
            starts.extend(layer.starts[a:b])
            ends.extend(layer.ends[a:b])

    at, changed = 0, False
    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if got is None:
            continue
        changed = True
        copy(at, m.start())
        for c, a, b in got:
            text.append(c)
            s, e = layer.span(m.start() + a, m.start() + b)
            starts.append(s)
            ends.append(e)
        at = m.end()
    if not changed:
        return None
    copy(at, len(layer.text))
    return Layer("".join(text), starts, ends)


def _percent(run: str) -> list[tuple[str, int, int]] | None:
    data = binascii.unhexlify(run.replace("%", ""))
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    if len(text) == len(data):
        return [(c, 3 * i, 3 * i + 3) for i, c in enumerate(text)]
    out, at = [], 0
    for c in text:
        n = len(c.encode("utf-8"))
        out.append((c, 3 * at, 3 * (at + n)))
        at += n
    return out


def _escapes(run: str) -> list[tuple[str, int, int]] | None:
    out: list[tuple[str, int, int]] = []
    for m in ONE_ESCAPE.finditer(run):
        code = int(m[1] or m[2] or m[3] or m[4], 16)
        if code > 0x10FFFF:
            return None
        if out and 0xDC00 <= code < 0xE000 and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            high, a, _ = out.pop()
            out.append((chr(0x10000 + ((ord(high) - 0xD800) << 10) + code - 0xDC00), a, m.end()))
        else:
            out.append((chr(code), m.start(), m.end()))
    return out


def _packed(data: bytes) -> bool:
    """Whether bytes start like a stream."""
    return bool(HEAD.match(data)) or len(data) > 2 and data[0] & 0x0F == 8 and (data[0] * 256 + data[1]) % 31 == 0


def _faulty(head: bytes) -> bool:
    try:
        zlib.decompressobj(47).decompress(head, 1 << 16)
    except zlib.error:
        return True
    return not _packed(head)


class _Stream:
    """The pieces of what a stream (all its members) unfolds to, as far as it can be
    read; then ``used``, the bytes that it took."""

    def __init__(self, data: bytes, bare: bool = False):
        self.data, self.bare, self.used = data, bare, 0

    def _reader(self, head: bytes):
        if self.bare:
            return zlib.decompressobj(-15)
        if head.startswith(b"BZh"):
            return bz2.BZ2Decompressor()
        return lzma.LZMADecompressor() if head.startswith(b"\xfd7zXZ") else zlib.decompressobj(47)

    def __iter__(self) -> Iterator[bytes]:
        data, at = self.data, 0
        while at < len(data) and (self.bare and at == 0 or not self.bare and _packed(data[at : at + 16])):
            reader, start = self._reader(data[at : at + 16]), at
            while at < len(data) and not reader.eof:
                piece = data[at : at + PIECE]
                safe = reader.copy() if hasattr(reader, "copy") else None
                try:
                    yield reader.decompress(piece)
                except (zlib.error, OSError, lzma.LZMAError, EOFError):
                    for i in range(len(piece) if safe else 0):  # what comes before the fault counts
                        try:
                            yield safe.decompress(piece[i : i + 1])
                        except zlib.error:
                            break
                    self.used = at if at > start else self.used
                    return
                at += len(piece) - len(reader.unused_data)
            self.used = at


def _windows(stream: _Stream, budget: Budget) -> Iterator[bytes]:
    """What a stream unfolds to, in overlapping windows."""
    held = bytearray()
    for piece in stream:
        if budget.rest < 0:
            break
        budget.rest -= len(piece)
        if budget.rest < 0:
            budget.left += 1
            break
        held += piece
        if len(held) >= WINDOW:
            yield bytes(held)
            del held[: len(held) - OVERLAP]
    if held:
        yield bytes(held)


def _texts(layer: Layer, data: bytes, place: Place) -> Iterator[Layer]:
    """Bytes as text; ``place``: range of bytes to range of the layer's characters."""
    if not LIVE.search(data):
        return
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    if len(text) == len(data):
        yield Layer(text, place=lambda a, b: layer.span(*place(a, b)))
        return
    firsts = list(accumulate([1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass")) for c in text], initial=0))
    yield Layer(text, place=lambda a, b: layer.span(*place(firsts[a], firsts[b])))


def _byte_layers(layer: Layer, data: bytes, place: Place, budget: Budget, bare: bool = True) -> Iterator[Layer]:
    """The layers of bytes: their text (if ``bare``), and that of what streams among them
    unfold to, layer by layer. A stream's text stands where the stream does."""
    work: list[tuple[bytes, Place, bool]] = [(data, place, bare)]
    while work:
        data, place, shown = work.pop()
        if shown:
            yield from _texts(layer, data, place)
            if data.count(0) >= 12:  # UTF-16 has every other byte zero
                for k in (0, 1):
                    yield from _texts(layer, data[k::2], lambda a, b, k=k, place=place: place(2 * a, min(2 * b + k, len(data))))
        found = []
        at = 0
        while at < len(data):
            head = HEAD.search(data, at)
            start = at if at == 0 and _packed(data) else head.start() if head else len(data)
            if start == len(data):
                break
            stream = _Stream(data[start:])
            found += [(start, stream, w) for w in _windows(stream, budget)]
            at = start + max(stream.used, 1)
        if not found and len(data) >= 12:
            stream = _Stream(data, bare=True)
            found = [(0, stream, w) for w in _windows(stream, budget)]
        for start, stream, inner in found:
            # the span is all of the stream, or of what is there of a faulty one
            s, e = place(start, start + (stream.used or len(data) - start))
            work.append((inner, lambda a, b, s=s, e=e: (s, e), True))


def _escaped_layers(layer: Layer, budget: Budget) -> Iterator[Layer]:
    """The layers of compressed bytes that stand as percent or backslash escapes."""
    for head, unit in ((PERCENT_PACKED, PERCENT_BYTE), (ESCAPE_PACKED, ESCAPE_BYTE)):
        for m in head.finditer(layer.text):
            data, ends, at = bytearray(), [], m.start()
            while u := unit.match(layer.text, at):
                if len(data) == 64 and _faulty(bytes(data)):  # many heads, each with a long text behind it
                    break
                data.append(int(u[1], 16) if u[1] else NAMED[u[2]] if u[2] else ord(u[0]))
                ends.append(at := u.end())
            if data:
                yield from _byte_layers(layer, bytes(data), lambda a, b, m=m, ends=ends: (m.start(), ends[b - 1]), budget, False)


def _wrapped(lines: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Ranges of lines that may be one token: all, all but the first or the last, and
    lines of one width with the line that ends them."""
    n = len(lines)
    ranges = {(a, b) for a in (0, 1) for b in (n - 1, n)}
    a = 0
    for k in range(1, n + 1):
        if k == n or lines[k][1] - lines[k][0] != lines[a][1] - lines[a][0]:
            ranges |= {(a, k), (a, min(k + 1, n))}
            a = k
    return {(a, b) for a, b in ranges if b - a > 1}


def _base64_layers(layer: Layer, budget: Budget) -> Iterator[Layer]:
    """The layers of each base64 token, at each alignment. A token may span line breaks."""

    def decoded(pieces: list[tuple[int, int]], whole: bool) -> Iterator[Layer]:
        token = "".join([layer.text[a:b] for a, b in pieces]).replace("-", "+").replace("_", "/")
        firsts = list(accumulate([b - a for a, b in pieces], initial=0))

        def spot(i: int) -> int:
            k = bisect_right(firsts, i, 0, len(pieces)) - 1
            return pieces[k][0] + i - firsts[k]

        for skip in range(4 if whole else 1):
            part = token[skip:]
            if len(part) % 4 == 1:
                part = part[:-1]
            if len(part) < 16:
                return

            def place(a: int, b: int, skip: int = skip, size: int = len(part)) -> tuple[int, int]:
                return spot(skip + a * 8 // 6), spot(skip + min(-(-b * 8 // 6), size) - 1) + 1

            data = binascii.a2b_base64(part + "=" * (-len(part) % 4))
            yield from _byte_layers(layer, data, place, budget)

    for m in BASE64.finditer(layer.text):
        body = m[0].rstrip("=")
        yield from decoded([(m.start(), m.start() + len(body))], True)
        # a path or a list may stand around the token: its parts are tried too
        plain = body.replace("-", "+").replace("_", "/")
        if "/" in plain or "+" in plain:
            for x in PART.finditer(plain):
                if len(x[0]) < len(plain):
                    yield from decoded([(m.start() + x.start(), m.start() + x.end())], True)
    if "\n" in layer.text:
        for m in WRAPPED.finditer(layer.text):
            lines = [(m.start() + x.start(), m.start() + x.end()) for x in LINE.finditer(m[0])]
            for a, b in sorted(_wrapped(lines)):
                yield from decoded(lines[a:b], False)


def find_secrets(text: str, max_inflated: int = 1 << 30) -> tuple[Spans, Spans, int, int]:
    """Base spans, all spans (original code points, sorted), layers scanned, and whether
    streams were left that unfold to more than ``max_inflated`` bytes."""
    first = Layer(text)
    base = sorted(scan(text))
    spans, budget = set(base), Budget(max_inflated)
    seen, work, n = {first.key()} if text else set(), [first], 0
    while work:
        layer = work.pop()
        n += 1
        if layer is not first:
            for a, kind, b in scan(layer.text):
                s, e = layer.span(a, b)
                spans.add((s, kind, e))
        found: list[Layer] = []
        if "%" in layer.text:
            found.append(_replaced(layer, PERCENT, _percent) or layer)
        if "\\" in layer.text:
            found.append(_replaced(layer, ESCAPE, _escapes) or layer)
        for new in chain(found, _escaped_layers(layer, budget), _base64_layers(layer, budget)):
            if new is not layer and new.text and (key := new.key()) not in seen:
                seen.add(key)
                work.append(new)
    return base, sorted(spans), n, budget.left


def joined(spans: Spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_inflated: int = 1 << 30
) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_spans, spans, n_layers, n_left) per row."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["_text"]:
                base, spans, n, left = find_secrets(text or "", max_inflated)
                counts = [sum(1 for _, k, _ in base if k == kind) for kind in range(3)]
                out.append((*counts, joined(base), joined(spans), n, left))
            columns = ["n_assign", "n_access", "n_hex", "base_spans", "spans", "n_layers", "n_left"]
            yield pd.concat([batch[["_id"]].reset_index(drop=True), pd.DataFrame(out, columns=columns)], axis=1)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = rows.mapInPandas(
        each, f"_id {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string, n_layers long, n_left long"
    )
    return found.withColumnRenamed("_id", id_col)
