"""What a stream's state costs: one call for all drives of a bucket, whatever their number, with each drive's rows as if it were alone."""

import numpy as np
import pandas as pd

from odolith.operators.signals import signals_of
from odolith.streaming import sequences


class _State:
    """A state in memory that counts its calls; a handle, too."""

    def __init__(self):
        self.calls, self.value, self.made = 0, None, []

    def getValueState(self, *_):  # noqa: N802
        self.made.append(_State())
        return self.made[-1]

    getListState = getValueState  # noqa: N815

    def _counted(self):
        self.calls += 1

    def registerTimer(self, at):  # noqa: N802
        self._counted()

    deleteTimer = registerTimer  # noqa: N815

    def exists(self):
        self._counted()
        return self.value is not None

    def get(self):
        self._counted()
        return self.value

    def update(self, value):
        self._counted()
        self.value = value

    put = update

    def clear(self):
        self.update(None)

    def appendValue(self, value):  # noqa: N802
        self.update([*(self.value or []), value])

    def appendList(self, values):  # noqa: N802
        self.update([*(self.value or []), *values])


class _Times:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def _events(drives, first, last, seed):
    rng = np.random.default_rng(seed)
    rows = [(d, 100_000 * k, 0, k, [*rng.normal(size=6), k / 10, 5.0]) for d in range(drives) for k in range(first, last)]
    return pd.DataFrame(rows, columns=["drive_id", "t", "kind", "rn", "v"]).sample(frac=1, random_state=seed)


def _through(drives):
    """Two triggers and the end of all drives; rows that came out and calls of states."""
    p, h, out = sequences._Windows(15, 2, False, 1000), _State(), []
    p.init(h)
    for pdf, ms in ((_events(drives, 1, 21, 1), 1500), (_events(drives, 21, 41, 2), 3000)):
        out += list(p.handleInputRows((0,), iter([pdf]), _Times(ms)))
    out += list(p.handleExpiredTimer((0,), _Times(100_000), None))
    return pd.concat(out), h.calls + sum(s.calls for s in h.made), h.made


def test_calls_do_not_grow_with_drives():
    few, calls, _ = _through(1)
    many, more, states = _through(50)
    assert more == calls and all(s.value is None for s in states)  # and nothing is left once all have ended
    assert len(few) == 13 and len(many) == 50 * 13
    assert (many.groupby("drive_id")["rn"].apply(sorted).apply(tuple) == tuple(range(15, 40, 2))).all()


def test_signals_of_several_drives_equal_those_of_each():
    x, start = np.random.default_rng(3).normal(size=(30, 6)), np.array([0, 1, 3, 12, 29])
    for causal in (False, True):
        got, each = signals_of(x, causal=causal, start=start), [signals_of(p, causal=causal) for p in np.split(x, start[1:])]
        for s, v in got.items():
            assert (v == np.concatenate([e[s] for e in each])).all(), s
