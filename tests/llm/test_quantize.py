"""Codes against plain Lloyd rounds in Python's integers: ties, boxes, lengths, huge components, odd rows."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from odolith.llm import quantize

KIND = "vec_id long, embedding array<double>, label int, code string, x long, own int"


def frame(spark, rows, kind=KIND):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], lab, "c", 1, 2) for i, v, lab in rows], kind).repartition(3)


def plain(rows):
    """[(vec_id, code, error)] and the digest for rows of one length."""
    d = len(rows[0][1])
    width = max(1, -(-d // 16))
    clip = lambda c: int(np.floor(min(max(256 * float(c), -(2.0**53)), 2.0**53)))
    x = [(i, [clip(c) for c in v] + [0] * (16 * width - d)) for i, v, _ in rows]
    first = {}
    for i, v in x:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    smallest = [first[i] for i in sorted(first)[:64]]
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for v in smallest] for p in range(16)]
    gap = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    pick = lambda y, book: min(range(len(book)), key=lambda k: (gap(y, book[k]), k))
    for _ in range(2):
        for p in range(16):
            own = {}
            for _, v in x:
                own.setdefault(pick(part(v, p), books[p]), []).append(part(v, p))
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else z for k, z in enumerate(books[p])]
    out = []
    for i, v in x:
        code = [pick(part(v, p), books[p]) for p in range(16)]
        out.append((i, "".join(f"{k:02x}" for k in code), sum(gap(part(v, p), books[p][k]) for p, k in enumerate(code))))
    return out, hashlib.sha256(",".join(str(c) for b in books for z in b for c in z).encode()).hexdigest()


def check(spark, rows, tail=()):
    got = quantize.codes(frame(spark, [*rows, *tail])).collect()
    want, digest = plain(rows)
    lab = [r[2] for r in rows]
    total = {k: sum(w[2] for w, own in zip(want, lab, strict=True) if own == k) for k in set(lab)}
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    fit = lambda v: v if v < 1 << 63 else None
    assert sorted(((r["vec_id"], r["code"], str(r["error"]), str(r["label_error"])) for r in got), key=key) == sorted(((*w[:2], str(fit(w[2])), str(fit(total[k]))) for w, k in zip(want, lab, strict=True)), key=key)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_equals_plain_rounds_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v, int(i % 3) if i % 7 else None) for i, v in enumerate(np.round(rng.normal(size=(300, 32)) * 3) / 256)]  # few values: many ties
    rows += [(400 + i, rows[0][1], 1) for i in range(150)] + [(5, rows[9][1], 2), (None, rows[3][1], 2), rows[8]]
    bad = [None, [None] * 32, [float("nan")] * 32, [float("inf")] + [0.0] * 31]
    check(spark, rows, [(900 + k, v, 1) for k, v in enumerate(bad)])


@pytest.mark.parametrize("d", [1, 16, 20])
def test_lengths_and_few_ids(spark, d):
    rng = np.random.default_rng(d)
    check(spark, [(i, v, 1) for i, v in enumerate(rng.normal(size=(40, d)))])


def test_huge_components_stay_exact(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 16)) * 1e12
    v[3, 0], v[4, 0] = 1e300, -1e300
    check(spark, [(i, x, i % 2) for i, x in enumerate(v)])


def test_each_length_has_codebooks_of_its_own(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16 if i % 2 else 32), 1) for i in range(80)] + [(100, [], 1)]
    got = {r["vec_id"]: r for r in quantize.codes(frame(spark, rows)).collect()}
    for k in (0, 1):
        want, digest = plain([r for r in rows[:80] if r[0] % 2 == k])
        assert all((got[i]["code"], got[i]["error"], got[i]["codebooks_sha256"]) == (c, e, digest) for i, c, e in want)
    assert got[100]["code"] == "00" * 16 and got[100]["error"] == 0
    assert len({r["label_error"] for r in got.values()}) == 1
    assert not quantize.codes(frame(spark, [])).collect() and not quantize.codes(frame(spark, [(1, None, 1)])).collect()
    assert not quantize.codes(frame(spark, [(None, [1.0] * 16, 1)])).collect()


@settings(deadline=None, max_examples=40)
@given(st.integers(1, 700), st.integers(1, 5), st.integers(1, 64), st.integers(1, 40), st.integers(0, 10**6), st.booleans())
def test_trees_equal_plain_assignment(n, w, k, spread, seed, big):
    rng = np.random.default_rng(seed)
    y, book = rng.integers(-spread, spread + 1, (n, w)), rng.integers(-spread, spread + 1, (k, w))
    d = ((y[:, None] - book[None]) ** 2).sum(2)
    kind = object if big else np.float64
    tree = quantize.Tree(y.astype(kind))
    code, sums, counts = tree.assign(book.astype(kind))
    want = d.argmin(1)
    assert (tree.filled(code) == want).all() and (counts == np.bincount(want, minlength=k)).all()
    assert all((sums[e] == y[want == e].sum(0)).all() for e in range(k))


def test_subtrees_are_given_away_whole():
    """Far groups: every entry but one is out at a node, and points are never compared."""
    rng = np.random.default_rng(8)
    centres = np.array([[0, 0], [10**4, 0], [0, 10**4], [10**4, 10**4]])
    y = np.concatenate([c + rng.integers(-9, 10, (256, 2)) for c in centres]).astype(float)
    tree = quantize.Tree(y)
    old = quantize._least
    seen = []
    quantize._least = lambda d, live: (seen.append(d.shape), old(d, live))[1]
    try:
        tree.assign(centres.astype(float))
    finally:
        quantize._least = old
    assert sum(s[0] for s in seen) <= 1 + 2 + 4 and all(len(s) == 2 for s in seen)
