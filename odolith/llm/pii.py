r"""Personal data in whole texts, also under disguises.

Base scan: four kinds, leftmost non-overlapping each. Then transducers rewrite the text and keep, for every piece they replace, the range that it came from:

- signs: look-alike letters of other scripts, digits of any script, full-width and other compatibility forms, dashes and spaces of all kinds become ASCII; invisible characters go;
- marks: ``(at)``, ``[dot]``, ``{@}``, ``&#64;``, ``%40``, `` @ `` become ``@`` and ``.``. The bare words at and dot (of four languages) do so only together: ``ann at mail dot org``
  is an address, ``look at mail.org`` isn't;
- words: digits spelled in four languages, with double and triple, with spaces, commas or hyphens between; a single one only between digits or beside a dot; and plus before a digit;
- letters: O, o, l and I within numbers.

Chains of them (``CHAINS``) give normalised texts, each of which is scanned with the same patterns; a match that touches a replaced piece is mapped back to the source characters it stands for. Base
spans always stay. Everything takes time linear in a text's length.

A null text counts as empty and has no spans. Positions are code points, ends exclusive. Each row is on its own: rows that repeat give equal results, an empty table
gives no rows; other columns are left out by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the kinds in their order and their patterns
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?+")  # all runs of digits, of which those with a group count, so that none is walked over again
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# fixed values: look-alikes that no compatibility form has, and what they look like
LOOK_ALIKES = str.maketrans(
    "аеорсухіјѕԁһӏԛԝкмтнвАВЕКМНОРСТУХІЈЅԌαοντρυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑɡℓ․‧∙·⸱۔。∣٫",
    "aeopcyxijsdhlqwkmthbABEKMHOPCTYXIJSGaovtpuikABEZHIKMNOPTYXiagl.......l.",
)
# fixed values: digits spelled
SPELLED = {
    word: str(k % 10)
    for words in (
        "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for k, word in enumerate(words.split())
} | {"oh": "0", "zwo": "2", "fuenf": "5"}
TIMES = {"double": 2, "triple": 3}
AT_WORDS, DOT_WORDS = ("at", "arroba"), ("dot", "punkt", "point", "punto")

_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_TOKEN = re.compile(r"[^\W\d_]+")
_NUMBER = rf"(?:(?:{'|'.join(TIMES)})[\x20-])?(?:{'|'.join(sorted(SPELLED, key=len, reverse=True))})"
_SPELLED = re.compile(rf"(?<![^\W_])(?:{_NUMBER})(?:[\x20,-]{{1,2}}(?:{_NUMBER}))*(?![^\W_])")
_SPELLED_ONE = re.compile(_NUMBER)
_SEVERAL = re.compile(r"[\x20,-]")
_DOT_BEFORE, _DOT_AFTER = re.compile(rf"(?:[^\s]\.|(?<![^\W_])(?:{_DOT})[\x20_-]{{1,2}})\Z"), re.compile(rf"\.[^\W_]|[\x20_-]{{1,2}}(?:{_DOT})(?![^\W_])")
_DIGIT_BEFORE, _DIGIT_AFTER = re.compile(r"[0-9][\x20-]?\Z"), re.compile(r"[\x20-]?[0-9]")
_PLUS = re.compile(r"(?<![^\W_])plus[\x20]{1,2}(?=[0-9])")
# marks begin with characters that are rare in prose; spaces around them are taken afterwards
_MARK = re.compile(rf"[\[({{<][\x20\t]{{0,4}}(?:({_AT}|@)|(?:{_DOT}|\.))[\x20\t]{{0,4}}[\])}}>]|&(?:(#0{{0,4}}64|#x0{{0,4}}40|commat)|#0{{0,4}}46|#x0{{0,4}}2e|period);|%(?:(40)|2e)|(?<=\x20)(@)(?=\x20)", re.IGNORECASE)
_GAP = r"(?:\x20{1,4}|_|-)"
_DOT_WORD = re.compile(rf"{_GAP}(?:{_DOT}){_GAP}", re.IGNORECASE)
_BARE_DOT = re.compile(rf"(?<=[A-Za-z0-9]){_DOT_WORD.pattern}(?=[A-Za-z0-9])", re.IGNORECASE)
_LABEL = r"[A-Za-z0-9][A-Za-z0-9-]{0,62}"
_BARE_AT = re.compile(rf"(?<=[A-Za-z0-9]){_GAP}(?:{_AT}){_GAP}(?=({_LABEL}(?:(?:\.|{_DOT_WORD.pattern}){_LABEL}){{1,8}}))", re.IGNORECASE)
_LETTER_BY_DIGIT = re.compile(r"[0-9](?:(?<=[OoIl].)|(?<=[OoIl][.()-].)|(?=[.()-]?[OoIl]))")
_NEAR_DIGITS = re.compile(r"(?<![^\W_])(?=[OoIl.()-]*[0-9])[0-9OoIl]+(?:[.()-]{1,2}[0-9OoIl]+)*(?![^\W_])")
_LETTERS = re.compile(r"[OoIl]")

Span = tuple[int, int, int]
Edit = tuple[int, int, str]


def _emails(text: str) -> list[tuple[int, int]]:
    """Addresses, found from their @ backwards: a name that no @ follows is never walked over twice."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base matches, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Rewritten:
    """A text made of another by edits; of these it keeps where each replacement begins here, its length, and the range it has the place of. Without edits all places are the same."""

    def __init__(self, text: str, up: Rewritten | None = None, edits: list[Edit] = ()):
        self.up, self.firsts, self.lengths, self.ranges = up, [], [], []
        parts, at, size = [], 0, 0
        for s, e, new in edits:
            parts += [text[at:s], new]
            size += s - at
            self.firsts.append(size)
            self.lengths.append(len(new))
            self.ranges.append((s, e))
            size += len(new)
            at = e
        self.text = "".join([*parts, text[at:]]) if parts else text

    def _above(self, i: int) -> tuple[int, int]:
        """The range, in the text above, that character i stands for."""
        k = bisect_right(self.firsts, i) - 1
        if k < 0:
            return i, i + 1
        past = i - self.firsts[k] - self.lengths[k]
        return self.ranges[k] if past < 0 else (self.ranges[k][1] + past, self.ranges[k][1] + past + 1)

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The range of the source."""
        layer = self
        while layer.up is not None:
            start, end = layer._above(start)[0], layer._above(end - 1)[1]
            layer = layer.up
        return start, end

    def disguised(self, start: int, end: int) -> bool:
        """Whether the source has other characters there."""
        lo, hi = self.origin(start, end)
        source = self
        while source.up is not None:
            source = source.up
        return source.text[lo:hi] != self.text[start:end]


class _Signs(dict):
    """ASCII of a character, itself where it has none."""

    def __missing__(self, c: str) -> str:
        self[c] = out = self._of(c)
        return out

    @staticmethod
    def _of(c: str) -> str:
        if c.isascii():
            return c
        kind = unicodedata.category(c)
        if kind == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F or c == "͏":
            return ""
        if kind == "Zs":
            return " "
        if kind == "Pd" or c == "−":
            return "-"
        if kind == "Nd":
            return str(unicodedata.decimal(c))
        plain = unicodedata.normalize("NFKC", c).translate(LOOK_ALIKES)
        return plain if plain.isascii() and plain.isprintable() and plain else c


_SIGNS = _Signs()


def signs(source: Rewritten) -> Rewritten:
    """Characters for characters first, which moves nothing; then those that several or no characters stand for."""
    text = source.text
    if text.isascii() or not (changed := {c for c in set(text) if _SIGNS[c] != c}):
        return source
    single = {ord(c): _SIGNS[c] for c in changed if len(_SIGNS[c]) == 1}
    out = Rewritten(text.translate(single), source)
    rest = "".join(c for c in changed if len(_SIGNS[c]) != 1)
    return Rewritten(out.text, out, [(m.start(), m.end(), _SIGNS[m[0]]) for m in re.finditer(f"[{re.escape(rest)}]", out.text)]) if rest else out


def _low(text: str) -> str:
    """The text in lower case, each character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def marks(layer: Rewritten) -> list[Edit]:
    text, out, done = layer.text, [], 0
    for m in _MARK.finditer(text):
        s, e = m.span()
        if m[0][0] not in "%&":
            while s > done and m.start() - s < 4 and text[s - 1] in " \t":
                s -= 1
            while e < len(text) and e - m.end() < 4 and text[e] in " \t":
                e += 1
        if s > done and e < len(text) and text[s - 1].isascii() and text[s - 1].isalnum() and text[e].isascii() and text[e].isalnum():
            out.append((s, e, "@" if any(m.groups()) else "."))
            done = e
    return out


def bare_marks(layer: Rewritten) -> list[Edit]:
    """Dots that are words, and an at that is one before a host of which a dot is a word or was disguised."""
    text = layer.text
    low = _low(text)
    if not any(w in low for w in DOT_WORDS) and (layer.up is None or not any(w in low for w in AT_WORDS)):
        return []
    dots = [(m.start(), m.end(), ".") for m in _BARE_DOT.finditer(text)]
    ats = [(m.start(), m.end(), "@") for m in _BARE_AT.finditer(text) if _DOT_WORD.search(m[1]) or layer.disguised(*m.span(1))]
    out, at = [], 0
    for s, e, new in sorted(dots + ats):
        if s >= at:
            out.append((s, e, new))
            at = e
    return out


def _within(low: str, start: int, end: int) -> bool:
    """Whether a single word stands between digits or beside a dot, as parts of numbers do and articles don't."""
    before, after = low[max(0, start - 8) : start], low[end : end + 8]
    return bool(_DOT_BEFORE.search(before) or _DOT_AFTER.match(after) or (_DIGIT_BEFORE.search(before) and _DIGIT_AFTER.match(after)))


def words(layer: Rewritten) -> list[Edit]:
    low, out = _low(layer.text), []
    if SPELLED.keys().isdisjoint(_TOKEN.findall(low)):
        return []
    for run in _SPELLED.finditer(low):
        at = run.start()
        if not _SEVERAL.search(run[0]) and not _within(low, at, run.end()):
            continue
        for m in _SPELLED_ONE.finditer(low, run.start(), run.end()):
            if m.start() > at:
                out.append((at, m.start(), ""))
            parts = re.split(r"[\x20-]", m[0])
            out.append((m.start(), m.end(), SPELLED[parts[-1]] * TIMES.get(parts[0], 1)))
            at = m.end()
    return out


def plus(layer: Rewritten) -> list[Edit]:
    low = _low(layer.text)
    return [(m.start(), m.end(), "+") for m in _PLUS.finditer(low)] if "plus" in low else []


def letters(layer: Rewritten) -> list[Edit]:
    if not _LETTER_BY_DIGIT.search(layer.text):
        return []
    return [(run.start() + m.start(), run.start() + m.end(), "0" if m[0] in "Oo" else "1") for run in _NEAR_DIGITS.finditer(layer.text) for m in _LETTERS.finditer(run[0])]


#: what is done in turn to the text whose signs are ASCII; each chain's end is scanned
CHAINS = ((), (letters,), (marks, bare_marks), (words, plus), (words, plus, letters, marks, bare_marks))


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): (start, kind, end) each, sorted, the latter with those found under disguises."""
    base = base_spans(text)
    found, seen = set(base), {text}
    made = {(): signs(Rewritten(text))}
    for chain in CHAINS:
        for k in range(1, len(chain) + 1):
            if chain[:k] not in made:
                layer = made[chain[: k - 1]]
                edits = chain[k - 1](layer)
                made[chain[:k]] = Rewritten(layer.text, layer, edits) if edits else layer
        layer = made[chain]
        if layer.text in seen:
            continue
        seen.add(layer.text)
        for s, k, e in base_spans(layer.text):
            if layer.disguised(s, e):
                lo, hi = layer.origin(s, e)
                found.add((lo, k, hi))
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
    """The text with all personal data, spans that overlap taken together, replaced by the kind of the first of them in brackets."""
    out, at = [], 0
    for s, k, e in all_spans(text)[1]:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with the personal data in text replaced; n_chars, where it is a column, follows. Null stays null."""
    names = docs.columns
    fields = [T.StructField(f.name, T.LongType()) if f.name == "n_chars" else f for f in docs.schema.fields]

    def run(batches):
        for b in batches:
            texts = b.column(names.index("text")).to_pylist()
            new = [None if t is None else redact_text(t) for t in texts]
            cols = dict(zip(names, b.columns, strict=True))
            cols["text"] = pa.array(new, b.schema.field(names.index("text")).type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([n if t == u else len(u) for n, t, u in zip(cols["n_chars"].to_pylist(), texts, new, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return docs.mapInArrow(run, T.StructType(fields))
