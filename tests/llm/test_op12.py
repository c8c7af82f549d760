"""Operator 12 against a search of all rows."""

import random

import pytest

from auditlake.llm import op12_negatives as op
from auditlake.llm.common import Scratch


def brute(rows, scale=256, positives=5, negatives=10):
    import math

    part = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        part.append((i, [math.floor(scale * float(x)) for x in v], label))
    last = lambda i: op.NO_ID if i is None else i
    out = []
    for a, (i, v, label) in enumerate(part):
        if i is None or i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), last(j), b, other) for b, (j, w, other) in enumerate(part) if b != a]
        scored.sort()
        for p in [r for r in scored if r[3] == label][:positives]:
            hits = [r for r in scored if r[3] != label and 30 * -p[0] <= 100 * -r[0] <= 90 * -p[0]][:negatives]
            out += [(i, p[1], k + 1, n[1], -p[0], -n[0]) for k, n in enumerate(hits)]
    return sorted(out)


def found(rows, spark, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, target string, row int").repartition(3)
    got = op.hard_negatives(op.prepared(op.relabelled(df)), "id % 100 = 0", Scratch(spark), **options).collect()
    return sorted(tuple(op.NO_ID if x is None else x for x in r) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_op12_against_all_rows(spark, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = []
    for i in range(900):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 0.1) for x in c], rng.randint(0, 3) if rng.random() > 0.3 else 5))
    rows += [(i, rows[3][1], 2) for i in range(1000, 1040)]  # equal vectors
    rows += [rows[300], rows[100], (None, rows[200][1], 1), (1100, None, 1), (1200, [1.0, None], 1), (1300, [float("nan")] * 8, 1), (1400, [0.5] * 8, None), (1500, [], 3), (1600, [1.0, -1.0], 3), (1700, [float("inf")], 2), (-100, [0.25] * 9, 1)]
    want = brute(rows)
    assert len(want) > 100
    assert found(rows, spark) == want
    assert found(rows, spark, shard_rows=100, block_rows=2) == want


def test_op12_hard_inputs(spark):
    assert found([], spark) == []
    assert found([(0, [1.0], 1)], spark) == []
    huge = [(0, [3e38, 3e38], 1), (5, [3e38, 1.0], 1), (7, [1e38, 0.0], 2), (8, [1e10, 1e10], 2), (9, [1e5, 3.0], 2)]
    got = found(huge, spark)
    assert all(abs(r[4]) <= op.NO_ID for r in got)
    large = [(0, [1e5, 77777.0], 1), (1, [1e5, 3e4], 1), (2, [7e4, 3e4], 3), (3, [5e4, -3e4], 3), (4, [5e4, 1e4], 3), (200, [12345.678, 9876.5], 3)]
    import numpy as np

    exact = [(i, [float(np.float32(x)) for x in v], c) for i, v, c in large]
    assert found(exact, spark) == brute(exact)


def test_op12_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(4)
    x, y = rng.integers(-300, 300, (500, 6)).astype(float), rng.integers(-300, 300, (300, 6)).astype(float)
    a, b = op.Tree(x, np.zeros(500, np.int64), 16), op.Tree(y, np.zeros(300, np.int64), 16)
    for i in range(len(a.begin)):
        for j in range(len(b.begin)):
            s = x[a.order[a.begin[i] : a.end[i]]] @ y[b.order[b.begin[j] : b.end[j]]].T
            low, high = op.intervals(a, np.array([i]), b, np.array([j]))
            assert low[0] <= s.min() and s.max() <= high[0]


def test_op12_drops_pairs_of_nodes(monkeypatch):
    """On clustered vectors most products are never made, and the best are those of all rows."""
    import numpy as np

    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(0, 200, (96, 16)), 128, axis=0).round() + rng.integers(-4, 5, (96 * 128, 16))
    labels, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    a = np.arange(0, len(x) // 8, 4)  # enough targets a cluster to fill leaves
    n, made, real = len(a), [], op.scores
    monkeypatch.setattr(op, "scores", lambda p, q, kind: made.append(len(p) * len(q)) or real(p, q, kind))
    ones = np.ones(n, np.int64)
    block = op.Block(x[a], a, labels[a], np.arange(n), ones.astype(bool), op.LEAST * ones, op.GREATEST * ones, op.LEAST * ones)
    target, place, score = op.search(block, x, rows, rows, labels, op.Tree(x, labels, op.LEAF_ROWS), 5)
    every = x[a] @ x.T
    every[np.arange(n), a] = -np.inf
    best = np.lexsort((np.broadcast_to(rows, every.shape), -every), axis=1)[:, :5]
    assert sorted(zip(target.tolist(), place.tolist(), strict=True)) == sorted((i, int(j)) for i in range(n) for j in best[i])
    assert sum(made) < 0.5 * n * len(x)
