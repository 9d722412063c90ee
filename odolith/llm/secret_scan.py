r"""Secrets in whole texts, also under nested encodings.

Base scan: three kinds, leftmost non-overlapping each. Then a worklist of layers: every layer of a text is scanned, and
whatever in it decodes is a new layer, until none is new: percent escapes, \\\\uXXXX and \\\\xXX escapes, base64 of both alphabets from each of
the four places it can begin at, over line breaks too, gzip, zlib, bzip2 and xz data anywhere in decoded and in inflated bytes, deflate without a header where a base64 run begins, and
text of two bytes a character, by leaving out its zero bytes. A layer maps its characters to ranges of the layer above, so a
secret found at any depth gets the span of the original that it came from. Layers already seen at the same place end a cycle.

Escapes of escapes are taken off one level at a time, each level a layer, down to the last. Depth comes from chains like ``%252525``, where an escape gives
the sign that opens the next one. Levels in which nothing happens but that all chains lose a link are taken together: a chain's own characters can't be
part of a secret but for a run of hex digits behind its sign, and these runs are noted for each level that is passed over.

Bytes that are no UTF-8 stay in a layer as one character each, which no pattern matches, so what is readable around them is
scanned. Compressed data is inflated to its end, or to where it is damaged, in pieces that are cut where no match can be; what is found in it has the
span of all of it. Compressed data in it that goes on behind a piece is read on by inflating what holds it once more.

A null text counts as empty and has no spans. Positions are code points, ends exclusive. Each row is on its own: rows that
repeat give equal results, an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import give_back

# fixed values: the kinds in their order and their patterns
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: links of a chain of escapes that are taken off one by one before its end, so that what follows the chain is met with enough of it in front
LINKS = 16

_ESCAPES = re.compile(r"[%\\](?:(?<=%)[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2})*|(?<=\\)(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})*)")
_LINK = r"(?:x|u00)?(?:25(?=[25])|5[cC](?=[xu]))"  # behind % or a backslash: an escape of either sign, with another one behind it
_CHAIN = re.compile(rf"[%\\](?:{_LINK}){{{2 * LINKS},}}+")
_LINK = re.compile(_LINK)
_DIGITS = re.compile("[0-9a-f]+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_PERCENT = re.compile(rb"%[0-9A-Fa-f]{2}")
_BREAK = re.compile(rb"[A-Za-z0-9+/_-][\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]")
_WIDE = re.compile(rb"(?:[\x21-\x7e]\x00){6}|(?:\x00[\x21-\x7e]){6}")  # a secret has six characters without a space
_ALPHABET = bytes(97 if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/_-") else 32 for c in range(256))
# the heads of gzip, bzip2, xz and zlib data
_HEADS = (b"\x1f\x8b\x08", b"BZh", b"\xfd7zXZ\x00", b"x\x01", b"x\x5e", b"x\x9c", b"x\xda")
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?=1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|x[\x01\x5e\x9c\xda]")
_HEAD = 9  # bytes of the longest head but one
_PIECE = 1 << 20  # characters of inflated text that are scanned at once; a piece grows until it has a place to cut
# Where neither a secret nor an encoded run, also under more escapes, can go across: before a character of none of them, or
# before spaces that have no sign of an assignment and no escape at either side.
_CUT = re.compile(r"""[^A-Za-z0-9+/_.=\-"'\x20:%\\\r\n\t\x00]|(?<=[G-Zg-z,;.!?])\x20+(?=[A-Za-z0-9])""")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base matches, sorted."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _worth(data: bytes) -> bool:
    """Whether decoded bytes that aren't compressed can hold a secret or a layer."""
    if b"a" * 16 in data.translate(_ALPHABET) or b"\\u" in data or b"\\x" in data or (b"\0" in data and _WIDE.search(data) is not None):
        return True
    low = data.lower()
    return any(w in low for w in (b"passw", b"secret", b"token", b"apikey", b"api_key")) or (b"%" in data and _PERCENT.search(data) is not None) or (b"\n" in data and _BREAK.search(data) is not None)


class _Layer:
    """A text; ``above`` gives the range of the layer ``up`` that a range of its characters stands for. ``passed`` are spans of ``up`` from levels in between. ``piece``: of what stream it is one."""

    def __init__(self, text: str, up: _Layer | None = None, above=None, passed: tuple | list = (), piece: _Piece | None = None):
        self.text, self.up, self.above, self.passed, self.piece = text, up, above, passed, piece

    def origin(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.up is not None:
            start, end = layer.above(start, end)
            layer = layer.up
        return int(start), int(end)


class _Bytes:
    """Bytes that come in parts, taken a few at a time."""

    def __init__(self, parts):
        self.parts, self.held, self.at = iter(parts), b"", 0

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end."""
        while len(self.held) - self.at < n:
            part = next(self.parts, None)
            if part is None:
                break
            self.held, self.at = self.held[self.at :] + part, 0
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out

    def back(self, data: bytes) -> None:
        self.held, self.at = data + self.held[self.at :], 0


def _cut_up(data):
    view = memoryview(data)
    return (bytes(view[k : k + 4096]) for k in range(0, len(view), 4096))


class _Inflated:
    """Iterates over what compressed data holds, member by member, up to its end or the first damage; ``used`` is how much was read, ``failed_at`` where the member with damage begins. ``parts()`` gives the data."""

    def __init__(self, parts, raw: bool = False):
        self.parts, self.raw, self.used, self.done, self._length = parts, raw, 0, False, 0
        self.failed_at: int | None = None

    def length(self) -> int:
        """``used`` as it will be in the end."""
        if not self._length:
            again = _Inflated(self.parts, self.raw)
            for _ in again:
                pass
            self._length = again.used
        return self._length

    def behind(self, start: int):
        """What is inflated from byte ``start`` of it on."""
        for part in _Inflated(self.parts, self.raw):
            if start < len(part):
                yield part[start:]
            start = max(0, start - len(part))

    def _reader(self, head: bytes):
        if self.raw:
            return zlib.decompressobj(-15)
        if head[:3] == b"BZh":
            return bz2.BZ2Decompressor()
        if head == b"\xfd7zXZ\x00":
            return lzma.LZMADecompressor()
        if head[:2] == b"\x1f\x8b":
            return zlib.decompressobj(31)
        return zlib.decompressobj(15) if len(head) > 2 and head[0] & 15 == 8 and (head[0] * 256 + head[1]) % 31 == 0 else None

    def __iter__(self):
        data = _Bytes(self.parts())
        while head := data.take(6):
            data.back(head)
            if not (z := self._reader(head)):
                break
            at = 0
            try:
                while not z.eof and (part := data.take(256)):
                    at += len(part)
                    if hasattr(z, "unconsumed_tail"):
                        while len(part) and not z.eof:
                            yield z.decompress(part, 1 << 16)
                            part = z.unconsumed_tail
                    else:
                        yield z.decompress(part, 1 << 16)
                        while not z.needs_input and not z.eof:
                            yield z.decompress(b"", 1 << 16)
                if not z.eof and hasattr(z, "flush"):
                    yield z.flush()
            except (zlib.error, lzma.LZMAError, OSError, EOFError):
                self.failed_at = self.used
                self.used += at
                break
            self.used += at - (len(z.unused_data) if z.eof else 0)
            if self.raw or not z.eof:
                break
            data.back(z.unused_data)
        self.done = True


class _Piece:
    """A piece of what ``of`` inflates to, from byte ``first`` on: its bytes behind the last few in front of it. ``known``, of all pieces: up to which byte streams were looked for."""

    def __init__(self, of: _Inflated, first: int, data: bytes, known: list[int]):
        self.of, self.first, self.data, self.known = of, first, data, known


def _pieces(parts):
    """Yields the text that inflated ``parts`` hold in pieces of about ``_PIECE`` characters."""
    decode, held, size = codecs.getincrementaldecoder("utf-8")("surrogateescape").decode, [], 0
    limit = _PIECE
    for part in parts:
        held.append(decode(part))
        size += len(held[-1])
        if size < limit:
            continue
        text, back = "".join(held), 4096
        cuts = []
        while not cuts:
            lo = max(0, len(text) - back)
            cuts = [m.start() for m in _CUT.finditer(text, lo) if m.start()]
            if not lo:
                break
            back *= 4
        if cuts:
            yield text[: cuts[-1]]
            text, limit = text[cuts[-1] :], _PIECE
        limit = max(limit, 2 * len(text))
        held, size = [text], len(text)
    text = "".join(held) + decode(b"", True)
    if text:
        yield text


def _has_head(data: bytes) -> bool:
    return any(h in data for h in _HEADS)


def _past(m: re.Match, got: _Inflated) -> int:
    """Where the next stream may begin: what failed was read some way on, over bytes that may begin another one."""
    return max(m.end(), m.start() + (got.used if got.failed_at is None else got.failed_at + 1))


def _inflated_layers(layer: _Layer, data, above):
    """Layers of compressed data anywhere in ``data``; ``above`` gives the range of ``layer`` for a range of its bytes."""
    at = 0 if _has_head(data) else len(data)
    while m := _PACKED.search(data, at):
        got = _Inflated(partial(_cut_up, memoryview(data)[m.start() :]))
        yield from _unpacked(layer, got, _over_all(above, m.start(), got))
        at = _past(m, got)


def _unpacked(layer: _Layer, got: _Inflated, above):
    """A layer for each piece of what ``got`` inflates to."""
    first, tail, known = 0, b"", [0]
    for text in _pieces(got):
        own = text.encode("utf-8", "surrogateescape")
        data = tail + own  # a head may lie across
        yield _Layer(text, layer, above, piece=_Piece(got, first - len(tail), data, known) if _has_head(data) else None)
        first += len(own)
        tail = data[-_HEAD:]


def _within(layer: _Layer):
    """Layers of compressed data in a piece of inflated data."""
    p = layer.piece
    at = max(0, p.known[0] - p.first)
    while m := _PACKED.search(p.data, at):
        rest = memoryview(p.data)[m.start() :]
        got = _Inflated(lambda rest=rest: chain(_cut_up(rest), p.of.behind(p.first + len(p.data))))
        yield from _unpacked(layer, got, lambda s, e: (0, len(layer.text)))
        at = _past(m, got)
    p.known[0] = max(p.known[0], p.first + at)


def _over_all(above, start: int, got: _Inflated):
    """``above`` for what is inflated from ``start`` on: all of it. Before its end has been met, it is looked for once more."""
    known = []

    def whole(s, e):
        if not known:
            known.append(got.used if got.done else got.length())
        return above(start, start + known[0])

    return whole


def _widths(text: str) -> np.ndarray:
    """Places of the characters of text decoded with surrogateescape among its bytes, and the number of bytes."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    w = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000) - 2 * ((c >= 0xDC80) & (c <= 0xDCFF))
    return np.concatenate([[0], np.cumsum(w)])


def _by_bytes(text: str, n: int, above):
    """``above`` for the text of ``n`` bytes, from that of the bytes."""
    if len(text) == n:
        return above
    cum = []

    def of(s, e):
        if not cum:
            cum.append(_widths(text))
        return above(int(cum[0][s]), int(cum[0][e]))

    return of


def _escaped(run: str) -> tuple[str, list[int]]:
    """An escape run decoded, and for each character the position in the run where it begins (with the run's end at last)."""
    if run[0] == "%":
        data = bytes.fromhex(run.replace("%", ""))
        text = data.decode("utf-8", "surrogateescape")
        return text, range(0, len(run) + 1, 3) if len(text) == len(data) else (3 * _widths(text)).tolist()
    parts = [(m.start(), int(m[0][2:], 16)) for m in re.finditer(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}", run)]
    out, cuts, k = [], [], 0
    while k < len(parts):
        at, c = parts[k]
        if 0xD800 <= c < 0xDC00 and k + 1 < len(parts) and 0xDC00 <= parts[k + 1][1] < 0xE000:
            c = 0x10000 + ((c - 0xD800) << 10) + (parts[k + 1][1] - 0xDC00)
            k += 1
        out.append(chr(c) if not 0xD800 <= c < 0xE000 else "\ufffd")
        cuts.append(at)
        k += 1
    return "".join(out), [*cuts, len(run)]


def _edited(layer: _Layer, edits: list[tuple[int, int, str, list[int]]], passed: tuple | list = ()) -> _Layer:
    """The layer with each range (start, end) of ``edits`` replaced by a text, whose characters begin at the given places of the range (its end at last)."""
    parts, runs, at, size = [], [], 0, 0
    for start, end, text, cuts in edits:
        parts += [layer.text[at:start], text]
        size += start - at
        runs.append((size, start, cuts))
        size += len(text)
        at = end
    firsts = [r[0] for r in runs]

    def place(i: int) -> tuple[int, int]:
        """The range of character i."""
        k = bisect_right(firsts, i) - 1
        if k < 0:
            return i, i + 1
        first, start, cuts = runs[k]
        i -= first
        if i < len(cuts) - 1:
            return start + cuts[i], start + cuts[i + 1]
        return start + cuts[-1] + i - len(cuts) + 1, start + cuts[-1] + i - len(cuts) + 2

    return _Layer("".join(parts) + layer.text[at:], layer, lambda s, e: (place(s)[0], place(e - 1)[1]), passed)


def _one_level(layer: _Layer) -> _Layer:
    """The layer with its escape runs decoded in place."""
    return _edited(layer, [(m.start(), m.end(), *_escaped(m[0])) for m in _ESCAPES.finditer(layer.text)])


def _many_levels(layer: _Layer) -> _Layer | None:
    """The layer after as many levels as all of its escapes are long chains in; None if one isn't."""
    text, chains = layer.text, []
    for m in _ESCAPES.finditer(text):
        chain = _CHAIN.match(text, m.start())
        if not chain:
            return None
        chains.append(chain)
    links = [(c.start(), [m.end() for m in _LINK.finditer(text, c.start() + 1, c.end() + 1)]) for c in chains]
    levels = min(len(ends) for _, ends in links) - LINKS
    edits, passed = [], []
    for start, ends in links:
        stop = ends[levels - 1]
        edits.append((start, stop, "%" if text[stop - 1] == "5" else "\\", [0, stop - start]))
        reach = start
        for end in ends[: levels - 1]:
            if end > reach:
                digits = _DIGITS.match(text, end)
                reach = digits.end() if digits else end
            if reach - end >= 24:
                passed.append((end, 2, reach))
    return _edited(layer, edits, passed)


def _escape_layers(layer: _Layer):
    """The layer with its escapes decoded, and what is compressed in it then."""
    if not _ESCAPES.search(layer.text):
        return
    plain = _many_levels(layer) or _one_level(layer)
    yield plain
    for kind in ("utf-8", "latin-1"):  # bytes as percent escapes, and as \\x or \\u00 escapes
        if kind == "utf-8" or "\\x" in layer.text or "\\u00" in layer.text:
            data = plain.text.encode(kind, "surrogateescape" if kind == "utf-8" else "replace")
            yield from _inflated_layers(plain, data, _by_characters(plain.text, len(data)))


def _by_characters(text: str, n: int):
    """The range of characters for a range of the text's bytes."""
    if len(text) == n:
        return lambda s, e: (s, e)
    cum = _widths(text)
    return lambda s, e: (int(np.searchsorted(cum, s, "right")) - 1, int(np.searchsorted(cum, e)))


def _decoded(bare: str) -> bytes:
    """Base64 of either alphabet without padding; a single character over, which holds no byte, is left out."""
    bare = bare[: len(bare) - (len(bare) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(bare + "=" * (-len(bare) % 4))


def _run_layers(layer: _Layer, bare: str, place):
    """Layers of the base64 characters ``bare``; ``place`` gives the position of one of them in the layer."""
    for k in range(4):
        data = _decoded(bare[k:])

        def above(s, e, k=k):
            return place(k + s * 4 // 3), place(k + -(-e * 4 // 3) - 1) + 1

        if _worth(data):
            text = data.decode("utf-8", "surrogateescape")
            yield _Layer(text, layer, _by_bytes(text, len(data), above))
        yield from _inflated_layers(layer, data, above)
        if not k and len(data) > 8 and data[0] & 6 != 6 and not _PACKED.match(data) and (data[0] & 6 or data[1] ^ data[3] == data[2] ^ data[4] == 255):
            got = _Inflated(partial(_cut_up, data), raw=True)
            yield from _unpacked(layer, got, _over_all(above, 0, got))


def _base64_layers(layer: _Layer):
    for m in _BASE64.finditer(layer.text):
        yield from _run_layers(layer, m[0], lambda i, at=m.start(): at + i)
        # deflate has no head to be found by, so it is looked for where a path or a name ends too
        for p in re.finditer(r"(?<=[/_-])[A-Za-z0-9+]{16,}", m[0]):
            data = _decoded(p[0])
            if data[0] & 6 in (2, 4):
                at = m.start() + p.start()
                yield from _unpacked(layer, _Inflated(partial(_cut_up, data), raw=True), lambda s, e, at=at, n=len(p[0]): (at, at + n))
    for m in _LINES.finditer(layer.text) if "\n" in layer.text else ():
        lines = [(m.start() + p.start(), p[0]) for p in _LINE.finditer(m[0])]
        bare = "".join(p for _, p in lines)
        if len(bare) >= 16:
            first = np.cumsum([0, *[len(p) for _, p in lines]])

            def place(i, lines=lines, first=first):
                k = int(np.searchsorted(first, i, "right")) - 1
                return lines[k][0] + i - int(first[k])

            yield from _run_layers(layer, bare, place)


def _without_zeros(layer: _Layer) -> _Layer:
    kept = []

    def above(s, e):
        if not kept:
            kept.append(np.flatnonzero(np.frombuffer(layer.text.encode("utf-32-le", "surrogatepass"), "<u4")))
        return int(kept[0][s]), int(kept[0][e - 1]) + 1

    return _Layer(layer.text.replace("\0", ""), layer, above)


def _below(layer: _Layer):
    if layer.piece:
        yield from _within(layer)
    if "\0" in layer.text:
        plain = _without_zeros(layer)
        yield plain
        data = plain.text.encode("utf-8", "surrogateescape")
        yield from _inflated_layers(plain, data, _by_characters(plain.text, len(data)))
    if "%" in layer.text or "\\" in layer.text:
        yield from _escape_layers(layer)
    yield from _base64_layers(layer)


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): (start, kind, end) each, sorted, the latter with those found under decoded layers."""
    base = base_spans(text)
    found = set(base)
    todo, seen = [_below(_Layer(text))], set()
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
            continue
        if not layer.text:
            continue
        for s, k, e in layer.passed:
            lo, hi = layer.up.origin(s, e)
            found.add((lo, k, hi))
        spans = base_spans(layer.text)
        key = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.piece and layer.piece.first, *layer.origin(0, len(layer.text)))
        if key in seen:
            continue
        seen.add(key)
        for s, k, e in spans:
            lo, hi = layer.origin(s, e)
            found.add((lo, k, hi))
        todo.append(_below(layer))
    return base, sorted(found)


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCAN = "doc_id long, base array<struct<start: long, kind: int, end: long>>, found array<struct<start: long, kind: int, end: long>>, base_spans string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """Rows of ``SCAN``, one for each row of ``docs`` (doc_id, text)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            got = [all_spans(t.as_py() or "") for t in b.column(1)]
            records = [pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in g[i]] for g in got], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *records, *(pa.array([render(g[i]) for g in got], pa.string()) for i in (0, 1))], ["doc_id", "base", "found", "base_spans", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCAN)


def redact_text(text: str) -> str:
    """The text with every secret, spans that overlap taken together, replaced by ``[SECRET]``."""
    spans = all_spans(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with the secrets in text replaced; n_chars, where it is a column, follows. Null stays null."""
    names = docs.columns

    def run(batches):
        for b in batches:
            texts = b.column(names.index("text")).to_pylist()
            new = [None if t is None else redact_text(t) for t in texts]
            cols = dict(zip(names, b.columns, strict=True))
            cols["text"] = pa.array(new, b.schema.field(names.index("text")).type)
            if "n_chars" in cols:
                old = cols["n_chars"].to_pylist()
                cols["n_chars"] = pa.array([n if t is u or t == u else len(u) for n, t, u in zip(old, texts, new, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)
        give_back()

    fields = [T.StructField(f.name, T.LongType()) if f.name == "n_chars" else f for f in docs.schema.fields]
    return docs.mapInArrow(run, T.StructType(fields))
