"""The sequential machines against row-by-row folds, whole and composed from random pieces."""

import random

import numpy as np
import pandas as pd
import pytest

from rfsense.operators import scan as S


def fold_debounce(t, above, debounce, persistence):
    state, consec, t0, out = 0, 0, 0, []
    for ti, a in zip(t, above):
        fell = False
        if state == 0:
            consec = consec + 1 if a else 0
            if a and consec >= debounce:
                state, t0 = 1, ti
        elif not a and ti - t0 > persistence:
            state, consec, fell = 0, 0, True
        out.append((state, fell))
    return out


def fold_gate(t, s, v, delta, heartbeat):
    last, out = None, []
    for ti, si, vi in zip(t, s, v):
        send = last is None or si != last[1] or abs(vi - last[2]) > delta or ti - last[0] >= heartbeat
        last = (ti, si, vi) if send else last
        out.append(send)
    return out


def fold_segments(mv, thr, longest):
    found, start, length = [], 0, 0
    for i, x in enumerate(mv):
        if not length:
            if x > thr:
                start, length = i, 1
        else:
            length += 1
            if x < thr or length >= longest:
                found.append((start, length))
                length = 0
    return found


def in_pieces(cols, m, rng):
    """Walk random pieces, checking that the reported ways through give the walked end states."""
    n = len(next(iter(cols.values())))
    cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 6))))
    state, outs = m.start, []
    for lo, hi in zip([0, *cuts], [*cuts, n]):
        piece = {c: v[lo:hi] for c, v in cols.items()}
        out, end = m.walk(piece, state)
        told = m.through(state, m.ways_in(piece))
        assert str(told) == str(end) or [str(v) for v in told] == [str(v) for v in end]
        outs.append(pd.DataFrame(out))
        state = told
    return pd.concat(outs, ignore_index=True)


@pytest.mark.parametrize("block", range(4))
def test_machines_equal_folds(block):
    for seed in range(block * 400, block * 400 + 400):
        rng = random.Random(seed)
        n = rng.randint(1, 60)
        t = np.cumsum([rng.choice([0, 0, 1, 1, 2, 5]) for _ in range(n)]).astype("int64")
        p = rng.choice([0.3, 0.6, 0.85])
        above = np.array([rng.random() < p for _ in range(n)])
        debounce, persistence = rng.randint(1, 4), rng.randint(0, 6)
        o = in_pieces({"_sec": t, "above": above}, S.debounce_machine(debounce, persistence), rng)
        assert [(int(x == "DETECTED"), bool(y)) for x, y in zip(o.state, o.downgraded)] == \
            fold_debounce(t, above, debounce, persistence)

        s = np.array([rng.choice(["IDLE", "IDLE", "IDLE", "DETECTED"]) for _ in range(n)], dtype=object)
        v = np.round(np.cumsum([rng.gauss(0, 0.03) for _ in range(n)]), 3)
        o = in_pieces({"_ms": t, "state": s, "score": v}, S.gate_machine(0.05, 7), rng)
        assert list(o.published) == fold_gate(t, s, v, 0.05, 7)

        # Values equal to the threshold neither open nor close.
        mv = np.array([rng.choice([0, 1, 1, 2, 2, 2, 3]) for _ in range(n)], dtype=float)
        longest = rng.randint(1, 7)
        o = in_pieces({"_pos": np.arange(n), "mv": mv, "th": np.ones(n)},
                      S.segment_machine([(0, "mv", "th", longest)]), rng)
        assert list(zip(o.start_pos, o.length)) == fold_segments(mv, 1.0, longest)


def test_debounce_must_be_positive():
    with pytest.raises(ValueError):
        S.debounce_machine(0)
