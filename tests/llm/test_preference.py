"""Preference formatting against a plain restatement, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import random
from collections import Counter, defaultdict

import pytest

from odolith.llm import preference, queries

TURNS = "pair_id long, side string, turn long, role string, text string"
CLASH = TURNS + ", segment string, first long, digest string, c long, block long, shares long, chosen string"


def slow_records(rows):
    """{pair: (prompt, chosen, chosen mask, rejected, rejected mask)}, masks a 0 or 1 for each character."""
    pairs = defaultdict(lambda: {"chosen": [], "rejected": []})
    for pair, side, turn, role, text in rows:
        if pair is not None and turn is not None and side in ("chosen", "rejected"):
            pairs[pair][side].append((turn, role or "", text or ""))
    out = {}
    for pair, s in pairs.items():
        turns = sorted({t for side in s.values() for t, _, _ in side})
        cut = next((t for t in turns if Counter(x for x in s["chosen"] if x[0] == t) != Counter(x for x in s["rejected"] if x[0] == t)), None)
        text, mask = {}, {}
        for name, side in (("prompt", "chosen"), ("chosen", "chosen"), ("rejected", "rejected")):
            text[name], mask[name] = "", ""
            for t, role, said in sorted(s[side]):
                if (name == "prompt") == (cut is None or t < cut):
                    head, rest = f"<|{role}|>\n", f"{said}\n<|end|>\n"
                    text[name] += head + rest
                    mask[name] += "0" * len(head) + ("1" if role == "assistant" else "0") * len(rest)
        out[pair] = (text["prompt"], text["chosen"], mask["chosen"], text["rejected"], mask["rejected"])
    return out


def spread(mask):
    return "".join(x[0] * int(x[2:]) for x in mask.split(",")) if mask else ""


def got_records(df):
    return {r["pair_id"]: (r["prompt"], r["chosen"], spread(r["chosen_mask"]), r["rejected"], spread(r["rejected_mask"])) for r in df.collect()}


def random_rows(n, seed=1):
    rng, rows = random.Random(seed), []
    roles, texts = ["user", "assistant", "system", None, ""], ["a", "b", "", None, "Ünï 漢字 𝒳", "x\n<|end|>\n"]
    for p in range(n):
        base = [(t, rng.choice(roles), rng.choice(texts)) for t in range(rng.randint(0, 6))]
        for side in rng.choice([("chosen",), ("rejected",), ("chosen", "rejected"), ("chosen", "rejected"), ("chosen", "rejected")]):
            own = base[: rng.randint(0, len(base))] + [(t, rng.choice(roles), rng.choice(texts)) for t in range(len(base), len(base) + rng.randint(0, 2))] if rng.random() < 0.7 else base
            rows += [(p, side, *x) for x in own]
            rows += [(p, side, *rng.choice(own))] if own and rng.random() < 0.3 else []  # a turn that is there twice
    return rows


def test_records_equal_a_plain_restatement(spark):
    rows = random_rows(150)
    rows += [(900, "chosen", 0, "user", "q"), (900, "chosen", 1, "assistant", "long " * 40_000), (900, "rejected", 0, "user", "q"), (900, "rejected", 1, "assistant", "short")]
    rows += [(901, s, t, "user", "q") for s in ("chosen", "rejected") for t in range(900)] + [(901, "chosen", 900, "assistant", "end")]
    odd = [(None, "chosen", 0, "user", "lost"), (5, None, 0, "user", "lost"), (5, "chosen", None, "user", "lost"), (5, "other", 0, "user", "lost")]
    df = spark.createDataFrame([(*r, "s", 1, "d", 2, 3, 4, "k") for r in rows + odd], CLASH)
    want = slow_records(rows)
    got = preference.records(df)
    assert got.columns == ["pair_id", "from_turn", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"]
    assert got.count() == len(want) and got_records(got) == want
    assert sum(bool(p) for p, *_ in want.values()) > 30 and sum(bool(c and r) for _, c, _, r, _ in want.values()) > 20
    turns = preference.format_pairs(df)
    assert turns.where("segment = 'unplaced'").count() == len(odd) and turns.where("segment = 'unplaced' and loss = 0").count() == len(odd)
    joined = Counter()
    for r in turns.where("segment <> 'unplaced'").collect():
        joined[r["pair_id"], r["segment"]] += len(r["rendered"])
    for p, (prompt, chosen, _, rejected, _) in want.items():
        assert [joined[p, s] for s in ("prompt", "chosen", "rejected")] == [len(prompt), len(chosen), len(rejected)]


@pytest.mark.parametrize("limits", [{"rows": 3}, {"chars": 10}])
def test_long_pairs_are_several_records_that_join_up(spark, limits):
    rows = [(7, s, t, ("user", "assistant")[t % 2], f"text {t}" + (" other" if s == "rejected" and t > 1000 else "")) for s in ("chosen", "rejected") for t in range(1500)]
    parts = sorted(preference.records(spark.createDataFrame(rows, TURNS), **limits).collect(), key=lambda r: r["from_turn"])
    assert len(parts) > 2 and max(len(r["chosen"]) for r in parts) < 30_000
    want = slow_records(rows)[7]
    assert "".join(r["prompt"] for r in parts) == want[0] and "".join(r["chosen"] for r in parts) == want[1] and "".join(r["rejected"] for r in parts) == want[3]
    assert "".join(spread(r["chosen_mask"]) for r in parts) == want[2] and "".join(spread(r["rejected_mask"]) for r in parts) == want[4]


def test_sample_pairs_share_a_prompt_and_differ_in_the_last_answer(spark):
    talk = [(c, t, ("user", "assistant")[t % 2], f"{c % 7} {t}") for c in range(41) for t in range(5)]
    talk += [(50, 0, "user", "alone"), (51, 0, "assistant", None), (52, 0, "assistant", "x"), (None, 0, "user", "lost"), (53, None, "assistant", "lost")]
    got = got_records(preference.records(preference.sample_pairs(spark.createDataFrame([(*t, "e") for t in talk], "conv_id long, turn long, role string, text string, last string"))))
    assert len(got) == 44
    for c in range(41):
        prompt, chosen, _, rejected, mask = got[c]
        assert prompt.startswith(f"<|user|>\n{c % 7} 0\n<|end|>\n")
        if c % 10 == 5:
            assert not chosen and not rejected
        elif c % 10 == 0:
            assert chosen and not rejected
        else:
            assert f"{(c + 1) % 7} 3\n" in rejected and f"{c % 7} 3\n" in chosen and set(mask) == {"0", "1"}
    assert got[50] == ("<|user|>\nalone\n<|end|>\n", "", "", "", "") and got[51][3] and not got[52][3]


def test_empty_tables(spark):
    none = spark.createDataFrame([], TURNS)
    assert preference.records(none).count() == 0 and preference.format_pairs(none).count() == 0
    assert preference.sample_pairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query_has_prompts_and_both_completions(spark):
    got = queries.op3_preference_format(spark, "/root/testdata/sf0.001").toPandas()
    assert (got.prompt != "").sum() > len(got) / 2 and ((got.chosen != "") & (got.rejected != "")).sum() > len(got) / 4
