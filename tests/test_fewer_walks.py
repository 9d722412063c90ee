"""Boosting that counts one of two siblings, and importance that walks again only from where a row turns off."""

import numpy as np

from odolith.operators import trees


def made(n=600, size=7):
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 30, (n, size)).astype(np.uint8)
    return codes, np.abs(codes[:, 0] / 5.0 + (codes[:, 1] > 9) * codes[:, 2] / 7.0 + rng.normal(size=n))


def boosted(every: bool):
    """Trees from pieces in this process, and how many nodes' sums were counted, and how many weren't."""
    codes, y = made()
    s = trees.Spec("m", tuple(range(7)), "second_order", 6, 5, 0.3, l2=1.0, least=2.0)
    held = [(np.ascontiguousarray(codes[a : a + 250].T), [(None, y[a : a + 250] - y.mean())]) for a in range(0, 600, 250)]
    above, seen = {}, [0, 0]

    def level(since, open_):
        if every:
            open_ = [(i, walk, nodes, [None] * len(nodes)) for i, walk, nodes, _ in open_]
        for *_, rest in open_:
            for x in rest:
                seen[x is not None] += 1
        for (q, k), sums in trees._counted(held, since, open_, [s], 31).items():
            above[k] = trees._completed(sums, above.get(k), open_[q][3], 31)
            yield from trees._chosen(q, k, *above[k], open_, [s], 31)

    def taken_in(since):
        held[:] = [trees._after(p, since) for p in held]

    return trees._rounds([s], level, taken_in)[0], seen


def test_boosting_counts_the_smaller_of_two_siblings():
    (few, (counted, left_out)), (every, (all_, none)) = boosted(False), boosted(True)
    assert counted + left_out == all_ and none == 0 and counted < 0.6 * all_ + 6
    for a, b in zip(few, every, strict=True):
        assert (a.feature, a.bin, a.left) == (b.feature, b.bin, b.left) and np.allclose(a.value, b.value) and len(a.feature) > 20


def test_moved_rows_are_those_whose_leaf_changes():
    codes, y = made()
    other = codes[np.random.default_rng(2).permutation(len(codes))]
    tree = trees.grow(codes, -y, np.ones(len(y)), y, 7, trees.Spec("m", tuple(range(7)), depth=7), 31).arrays()
    assert np.array_equal(tree.leaves(np.ascontiguousarray(codes.T)), tree.nodes(codes))
    some = np.arange(5, 400, 3)
    assert np.array_equal(tree.leaves(np.ascontiguousarray(codes.T), some), tree.nodes(codes[some]))
    rows, f, change = tree.moved(codes, other)
    assert len(set(zip(rows, f, strict=True))) == len(rows) and 0 < len(rows) < 0.7 * codes.size
    for k in range(7):
        mixed, want = codes.copy(), np.zeros(len(codes))
        mixed[:, k] = other[:, k]
        want[rows[f == k]] = change[f == k]
        assert np.array_equal(want, tree.value[tree.nodes(mixed)] - tree.value[tree.nodes(codes)]), k
    leaf = trees.Tree().arrays()
    assert [len(x) for x in leaf.moved(codes, other)] == [0, 0, 0]
