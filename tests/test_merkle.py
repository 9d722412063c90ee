"""Hash trees: roots follow contents only, and the first difference is found in each group."""

import random

import pytest

from odolith.operators import merkle

KIND = "g string, o long, v string, w double"


def rows_of(n=400, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), i - 20, rng.choice(["x", "y|", None, ""]), rng.choice([1.5, None])) for i in range(n)]


def tree(spark, rows, parts=3, span=8, fan=3):
    leaf = merkle.leaves(spark.createDataFrame(rows, KIND).repartition(parts), "g", "o", ["v", "w"], span)
    return merkle.levels(leaf, merkle.height(leaf, fan=fan), fan)


def test_roots_follow_contents(spark):
    rows = rows_of()
    one = merkle.root(tree(spark, rows)[-1]).first()
    mixed = list(rows)
    random.Random(2).shuffle(mixed)
    assert merkle.root(tree(spark, mixed, 7)[-1]).first() == one and one["n"] == len(rows)
    for k in (0, 199, 399):
        other = list(rows)
        other[k] = (*other[k][:2], (other[k][2] or "") + "!", other[k][3])
        assert merkle.root(tree(spark, other)[-1]).first()["hash"] != one["hash"]
    assert merkle.root(tree(spark, [*rows, rows[5]])[-1]).first()["hash"] != one["hash"]
    assert not merkle.root(tree(spark, [])[-1]).collect()


def test_no_node_has_many_children(spark):
    n = [t.groupBy("grp").count().agg({"count": "max"}).first()[0] for t in tree(spark, [("a", i, "x", 1.0) for i in range(1000)])]
    assert n[0] == 125 and n[-1] == 1 and all(x <= 3 * y for x, y in zip(n, n[1:], strict=False))


@pytest.mark.parametrize("fan", [2, 5, 64])
def test_first_differences(spark, fan):
    rows = rows_of()
    other = [r for r in rows if not (r[0] == "a" and r[1] == 77)] + [("new", 5, "x", 1.0)]
    other = [(g, o, "changed" if g is None and o in (203, 250) else v, w) for g, o, v, w in other]
    other += [r for r in rows if r[0] == "b"][100:101]
    want = {}
    for g in {r[0] for r in rows + other}:
        a, b = ([r for r in x if r[0] == g] for x in (rows, other))
        odd = [r[1] for r in a + b if a.count(r) != b.count(r)]
        if odd:
            want[g] = min(odd)
    got = merkle.first_differences(spark.createDataFrame(rows, KIND), spark.createDataFrame(other, KIND), "g", "o", ["v", "w"], span=8, fan=fan)
    assert {r["grp"]: r["o"] for r in got.collect()} == want and "new" in want
    assert not merkle.first_differences(spark.createDataFrame(rows, KIND), spark.createDataFrame(rows[::-1], KIND), "g", "o", ["v", "w"], span=8, fan=fan).collect()


def test_plans_do_not_double_with_levels(spark):
    """The plan that finds the blocks is as long for many levels as for few."""
    rows, size = rows_of(), {}
    for fan in (4, 64):
        leaf = merkle.leaves(spark.createDataFrame(rows, KIND), "g", "o", ["v", "w"], 8)
        odd = merkle.differing_blocks(leaf, leaf.where("idx <> 3"), fan)
        size[fan] = odd._jdf.queryExecution().optimizedPlan().toString().count("Join")
        assert {r["idx"] for r in odd.collect()} == {3}
    assert size[4] <= size[64]
