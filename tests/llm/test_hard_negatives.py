"""Hard negatives against brute force, the Hilbert curve and the bounds by themselves."""

import math

import numpy as np
import pytest

from panelspan.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, v int, size string, block map<string,int>"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", {"a": 1}) for r in rows], SCHEMA).repartition(5)


def brute(rows):
    whole = []
    for i, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        whole.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * c) for c in x]))
    out = []
    for n, (i, label, v) in enumerate(whole):
        if i is None or i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j, other) for m, (j, other, w) in enumerate(whole) if m != n and len(w) == len(v)), key=lambda s: s[:3])
        for p, _, _, j, _ in [s for s in scored if s[4] == label][:5]:
            among = [s for s in scored if s[4] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(i, j, rank + 1, s[3], -p, -s[0]) for rank, s in enumerate(among)]
    return sorted(map(repr, out))


def vectors(seed, n=600, size=6, labels=4, scale=0.4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, scale, (labels, size))
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        rows.append((i * 5, [float(np.float32(x)) for x in centre[label] * rng.integers(0, 2) + rng.normal(0, scale, size)], label))
    rows += [(50, rows[0][1], 1), (100, rows[7][1], 1), (None, rows[3][1], 2), (None, rows[3][1], 1), (700, None, 1), (750, [1.0] * size, None),
             (800, [math.nan] * size, 1), (850, [math.inf] * size, 1), (900, [None] + [0.5] * (size - 1), 2), (950, [], 1), (951, [], 2), (1000, [0.0] * size, 3),
             (1050, [0.5] * 3, 1), (1051, [0.5] * 3, 1), (1052, [0.3, 0.4, 0.5], 2), (1053, [-0.5] * 3, 2)]
    rows += [(i, rows[5][1], rows[5][2]) for i in range(20000, 20600, 4)]           # a large group of copies
    return rows


@pytest.mark.parametrize("seed, block, chunk", [(1, 1024, 1024), (2, 40, 16), (3, 7, 3)])
def test_against_brute_force(spark, monkeypatch, seed, block, chunk):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "CHUNK", chunk)
    monkeypatch.setattr(hn, "ZONES", 20)
    rows = vectors(seed)
    if seed == 3:
        rows = [(i, x and [c and c * 1e6 for c in x], label) for i, x, label in rows[:250] + rows[600:620]]
    found = hn.mine(frame(spark, rows)).collect()
    assert sorted(repr(tuple(r)) for r in found) == brute(rows) and found


@pytest.mark.parametrize("size, bits", [(2, 3), (3, 2), (4, 1), (1, 4)])
def test_curve_visits_neighbours(size, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * size, indexing="ij"), -1).reshape(-1, size)
    keys = [k.tobytes() for k in hn.hilbert(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    block, a = rng.integers(-200, 200, (50, 8)), rng.integers(-200, 200, (30, 8))
    least, most = hn.bounds(a, block.min(axis=0)[None], block.max(axis=0)[None])
    scores = a @ block.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= most[:, 0]).all()
    huge = np.array([[2**62, 2**62]])
    assert hn.products(huge, huge)[0, 0] == 2**63 - 1 and hn.products(huge, -huge)[0, 0] == -(2**63 - 1)


def test_best_breaks_ties_by_column():
    scores = np.array([[3, 9, 9, 1], [5, 5, 5, 5]])
    for factor in (1, 2**55):
        row, column = hn.best(scores * factor, np.array([[True, True, True, False], [False, True, True, True]]), 2)
        assert list(zip(row, column)) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    row, column = hn.best(scores, np.zeros((2, 4), bool), 2)
    assert len(row) == 0


def test_empty(spark):
    assert hn.mine(frame(spark, [])).count() == 0
    assert hn.mine(frame(spark, [(1, [0.5], 1), (50, None, 1)])).count() == 0
    assert hn.mine(frame(spark, [(50, [0.5], 1)])).count() == 0
