"""Personal data against plain patterns and cell-by-cell mapping; disguises planted at known places."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from odolith.llm import pii
from odolith.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


ODD = st.text("ab1240 .-+@()[]%oOlI&#6;_dtéаЅ４​ .", max_size=40)
BITS = st.lists(st.sampled_from(["ann", "@", "mail", ".", "org", " at ", " dot ", "(at)", "[dot]", "one", "two", " ", "-", "double five", "plus ", "4111", "1111", "O", "l", "192", ".168", "１", "а", "​", "&#64;", "%40", "+1", "(555)", "...", "\n"]), max_size=20).map("".join)


@settings(deadline=None, max_examples=600)
@given(st.one_of(ODD, BITS))
def test_base_spans_are_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def cells(text, edits):
    """Edits on a list of (character, start, end)."""
    out, at = [], 0
    for s, e, new in edits:
        out += text[at:s] + [(c, text[s][1], text[e - 1][2]) for c in new]
        at = e
    return out + text[at:]


def slow_spans(text):
    """The same rules, with every character carrying its range of the source."""
    base = plain_spans(text)
    found = set(base)
    plain = [(n, i, i + 1) for i, c in enumerate(text) for n in pii._SIGNS[c]]
    for chain in pii.CHAINS:
        now, layer = plain, pii.signs(pii.Rewritten(text))
        for step in chain:
            edits = step(layer)
            now, layer = cells(now, edits), pii.Rewritten(layer.text, layer, edits) if edits else layer
        shown = "".join(c for c, _, _ in now)
        assert shown == layer.text
        for s, k, e in plain_spans(shown):
            if text[now[s][1] : now[e - 1][2]] != shown[s:e]:
                found.add((now[s][1], k, now[e - 1][2]))
    return base, sorted(found)


@settings(deadline=None, max_examples=600)
@given(st.one_of(ODD, BITS))
def test_spans_map_back_as_cells_do(text):
    assert pii.all_spans(text) == slow_spans(text)


DISGUISED = [
    ("email", "ann at mail dot org"), ("email", "ann.lee (at) mail.org"), ("email", "ann [at] mail [dot] co [dot] uk"), ("email", "ann{@}mail.org"), ("email", "ann&#64;mail&#46;org"), ("email", "ann%40mail.org"),
    ("email", "аnn@mаil.org"), ("email", "a​nn@mail.org"), ("email", "ａｎｎ＠ｍａｉｌ．ｏｒｇ"), ("email", "ann@mail dot org"), ("email", "ann at mail[.]org"), ("email", "Ann AT Mail DOT Org"), ("email", "ann_at_mail_dot_org"), ("email", "ana arroba correo punto es"), ("email", "ann @ mail.org"),
    ("ip", "192[.]168[.]1[.]10"), ("ip", "192 dot 168 dot 1 dot 10"), ("ip", "one nine two dot one six eight dot one dot one zero"), ("ip", "１９２．１６８．１．１０"), ("ip", "l92.l68.O.1"), ("ip", "192.168.1.one"), ("ip", "١٩٢.١٦٨.١.١"),
    ("card", "４１１１ １１１１ １１１１ １１１１"), ("card", "4111\u00a01111\u00a01111\u00a01111"), ("card", "four one one one one one one one one one one one one one one one"), ("card", "4111 1111 one one one one 1111"), ("card", "4111–1111–1111–1111"), ("card", "41ll 1111 1111 11l1"), ("card", "4111 1111 1111 triple one 1"),
    ("phone", "plus four nine three zero one two three four five six"), ("phone", "+1 (555) five five five oh one two three"), ("phone", "＋１ ５５５ １２３ ４５６７"), ("phone", "+1 555 O12 3456"), ("phone", "+1 555 double five 12 34 5"),
]


@pytest.mark.parametrize("kind,text", DISGUISED)
def test_disguises_are_found_at_their_places(kind, text):
    for before, after in (("Write to: ", ", please."), ("é😀 ", " !"), ("", "")):
        base, spans = pii.all_spans(before + text + after)
        want = (len(before), pii.KINDS.index(kind), len(before) + len(text))
        assert want in spans and want not in base


CLEAN = ["We met at noon. The dot is small.", "look at mail.org for more", "one of the two, or three. Four at most", "In 1990 I bought 10 l of oil at 3.50", "version 1.2.3, point 4", "Точка в конце. Один два", "see (at) the [dot]", "I ate at Bob's; un día, dos"]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_prose_has_none(text):
    assert pii.all_spans(text) == ([], [])


def test_words_after_a_number_do_not_stretch_it():
    assert [s for s in pii.all_spans("tel +1 (848) 555-1373 Un dia")[1]] == [(4, 3, 21)]


@pytest.mark.parametrize("text", ["a" * 10**6, "1" * 10**6, "+1" + " " * 10**6, "a at " * 10**5, "one " * 10**5, "1." * 10**5, "а" * 10**6, "-dot-" * 10**5, "l0." * 10**5, "a@" * 10**5, "​" * 10**5, "(at " * 10**5])
def test_long_texts_take_linear_time(text):
    pii.all_spans(text)


def test_scan_redact_and_the_query(spark):
    rows = [(1, "mail ann@mail.org or ann at mail dot org", "a", 1, "x"), (2, None, "b", 2, "y"), (3, "", "c", 3, "z"), (1, "mail ann@mail.org or ann at mail dot org", "a", 1, "x"), (None, "+1 (743) 555-3824", "d", 4, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, n_chars int, spans string")
    got = sorted(((r["doc_id"], r["base_spans"], r["spans"]) for r in pii.scan(docs).collect()), key=str)
    one = (1, "email:5:17", "email:5:17,email:21:40")
    assert got == sorted([one, one, (2, "", ""), (3, "", ""), (None, "phone:0:17", "phone:0:17")], key=str)
    red = sorted(((r["doc_id"], r["text"], r["n_chars"], r["spans"]) for r in pii.redact(docs).collect()), key=str)
    assert red == sorted([(1, "mail [EMAIL] or [EMAIL]", 23, "x")] * 2 + [(2, None, 2, "y"), (3, "", 3, "z"), (None, "[PHONE]", 7, "w")], key=str)
    assert not pii.scan(docs.where("false")).collect() and not pii.redact(docs.where("false")).collect()


def test_the_query_equals_plain_patterns(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op13_personal_data"](spark, sf).collect():
        base, found = slow_spans(texts[r["doc_id"]])
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["spans"] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in found)
        assert [r[f"n_{kind}"] for kind in pii.KINDS] == [sum(b[1] == k for b in base) for k in range(4)]


def test_disguises_survive_any_mixture():
    rng = random.Random(4)
    for _ in range(300):
        name, host = "".join(rng.choices("bcdfg", k=5)), "".join(rng.choices("kmnpr", k=4))
        at = rng.choice(["@", "(at)", " [at] ", "&#64;", " at "])
        dot = rng.choice([" dot ", "[dot]", "(.)", " (dot) "]) if at == " at " else rng.choice([".", " dot ", "[dot]", "(.)"])
        planted = "".join(rng.choice([c, c, chr(ord(c) + 0xFEE0)]) for c in name) + at + host + dot + "org"
        spans = pii.all_spans(f"x, {planted}, y")[1]
        assert (3, 0, 3 + len(planted)) in spans
