"""The toxicity learner and its features against plain loops, and the choice of its parameters inside the rows that aren't held out."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from odolith.llm import toxicity

M = 0xFFFFFFFF


def slow_features(text):
    words = [zlib.crc32(w.encode("utf-8", "replace")) for w in re.findall(r"\w+", (text or "").lower())]
    a, b, c, d = 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F

    def bucket(h):
        h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & M
        h = ((h ^ (h >> 12)) * 0x297A2D39) & M
        return (h ^ (h >> 15)) >> (32 - toxicity.BUCKET_BITS)

    out = [bucket(w) for w in words]
    for i in range(len(words)):
        if i + 1 < len(words):
            out.append(bucket((words[i] * a + words[i + 1] * b + 1) & M))
        if i + 2 < len(words):
            out.append(bucket((((words[i] * a + words[i + 1] * b) & M) * c + words[i + 2] * d + 2) & M))
            out.append(bucket((words[i] * a + words[i + 2] * b + 3) & M))
        if i + 3 < len(words):
            out.append(bucket((words[i] * a + words[i + 3] * b + 4) & M))
    return sorted(out)


def test_features_equal_a_loop():
    rng = random.Random(1)
    for text in [None, "", "a", "a b", "a b c", "one two three four", "Ünï 漢字 x_1 \ud800?".replace("\ud800", ""), *(" ".join(rng.choices(["x", "yy", "Zé", "7"], k=rng.randint(0, 30))) for _ in range(50)), "w" * 5000]:
        assert sorted(toxicity.features(text).tolist()) == slow_features(text), text


def slow_ftrl(rows, passes, alpha, l1):
    """Per-coordinate FTRL-proximal with a bias that has no penalty, one feature at a time."""
    z, n, zb, nb = {}, {}, 0.0, 0.0

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / alpha + toxicity.L2)

    for _ in range(passes):
        for idx, y in rows:
            w = {i: weight(i) for i in idx}
            b = -zb / ((toxicity.BETA + math.sqrt(nb)) / alpha)
            g = 1 / (1 + math.exp(-(b + sum(w.values())))) - y
            for i in idx:
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * b
            nb += g * g
    return {i: weight(i) for i in z if weight(i)}, -zb / ((toxicity.BETA + math.sqrt(nb)) / alpha)


@pytest.mark.parametrize("setting", [(0.5, 0.1), (2.0, 1.0), (4.0, 12.0)])
def test_learner_equals_a_loop(setting):
    rng = random.Random(2)
    rows = [(sorted(rng.sample(range(60), rng.randint(0, 20))), rng.randint(0, 1)) for _ in range(150)]
    rows += [([1, 2], int(1 in (1,)))] * 20
    want, bias = slow_ftrl(rows, 3, *setting)
    idx, w, b = toxicity.ftrl([(np.array(i, "<u4"), y) for i, y in rows], 3, *setting)
    assert b == pytest.approx(bias, abs=1e-3)
    got = dict(zip(idx.tolist(), w.tolist(), strict=True))
    for i in set(got) | set(want):  # the learner keeps single precision
        assert got.get(i, 0.0) == pytest.approx(want.get(i, 0.0), abs=2e-3)


def test_sample_keeps_to_its_bounds():
    rows = [(k, 0, np.arange(10, dtype="<u4").tobytes()) for k in range(8)]
    assert len(toxicity._bounded(rows, 35)) == 3 and len(toxicity._bounded(rows, 1000)) == 8 and toxicity._bounded([], 5) == []


def test_cross_validation_uses_no_held_out_row(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps"], k=12)) + (" nasty brute" if i % 4 == 0 else "") for i in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    got = toxicity.cross_validate(docs, labels, [(2.0, 1.0), (0.01, 12.0)]).collect()
    assert len(got) == 6 and {r["fold"] for r in got} == {0, 1, 3}
    held = sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(240))
    assert sum(r["n"] for r in got) == 2 * (240 - held)
    loss = {a: np.mean([r["log_loss"] for r in got if r["alpha"] == a]) for a in (2.0, 0.01)}
    assert loss[2.0] < loss[0.01] and all(r["caught"] == r["toxic"] for r in got if r["alpha"] == 2.0)
    wrong = labels.selectExpr("doc_id", "case when crc32(string(doc_id)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    again = toxicity.cross_validate(docs, wrong, [(2.0, 1.0)]).collect()
    assert sorted(r["log_loss"] for r in again) == sorted(r["log_loss"] for r in got if r["alpha"] == 2.0)
