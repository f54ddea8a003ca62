"""Hard negatives: against a plain search; bounds against exact products."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chatprep.llm import hard_negatives as H
from chatprep.llm.common import Scratch


def slow_mine(rows, step):
    data = set()
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            data.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for a, la, va in data:
        if a % step:
            continue
        scored = {(lb == la, sum(x * y for x, y in zip(va, vb)), b) for b, lb, vb in data if b != a}
        order = lambda same: sorted(((-s, b) for m, s, b in scored if m == same))
        for p, pid in order(True)[:5]:
            fits = [(n, nid) for n, nid in order(False) if 50 * -p <= 100 * -n <= 95 * -p]
            out += [(a, pid, k + 1, nid, -p, -n) for k, (n, nid) in enumerate(fits[:3])]
    return sorted(out)


def run(spark, rows, step):
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, label int, embedding array<float>, id int, score int").repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in H.mine(df, F.col("id") % step == 0, Scratch(spark, "t"), label=label).collect())


def vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    v = centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).tolist()


def test_equals_plain_search(spark, monkeypatch):
    """Small blocks, so that anchors and rows meet in many cells; odd rows among them."""
    monkeypatch.setattr(H, "BLOCK", 32)
    monkeypatch.setattr(H, "ANCHORS", 16)
    v = vectors(500, 12)
    rows = [(k, k % 3, v[k]) for k in range(500)]
    rows += [(None, 1, v[0]), (1000, None, v[1]), (1001, 1, None), (1002, 1, [None, 1.0]), (1003, 1, [math.nan, 1.0]),
             (1004, 1, [math.inf, 1.0]), (1005, 1, []), (1006, 1, [0.5]), (1010, 2, v[3] + v[4]), (1008, 1, [0.0] * 12)]
    rows += [rows[10]] * 40 + [rows[7]] * 40 + [(20, 1, v[21]), (31, 2, v[30]), (2010, 0, v[40]), (2020, 1, v[40])]  # repeats, ties, shared ids
    got = run(spark, rows, 10)
    assert got == slow_mine(rows, 10) and len(got) > 100


def test_small_inputs(spark):
    assert run(spark, [], 5) == []
    assert run(spark, [(5, 1, [1.0]), (6, 1, [1.0]), (8, 2, [0.9])], 5) == [(5, 6, 1, 8, 256 * 256, 256 * 230)]


def test_large_components_raise_or_are_exact():
    a = np.array([[2.0 ** 27, 1.0]])
    assert H.exact(a, a).tolist() == [[2 ** 54 + 1]]
    with pytest.raises(ValueError):
        H.exact(a * 4, a * 4)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 20), st.integers(0, 10 ** 6))
def test_bounds_hold(dim, count, seed):
    rng = np.random.default_rng(seed)
    a, b = (np.floor(rng.normal(size=(8, dim)) * 10.0 ** rng.integers(0, 5)) for _ in range(2))
    low, high = H.bounds(H.summary(a, count), H.summary(b, count))
    s = a @ b.T
    assert (low <= s).all() and (s <= high).all()
    if count >= dim:  # segments of one component: the bounds meet
        assert np.allclose(low, high, rtol=0, atol=1e-3 * (1 + np.abs(a).max() * np.abs(b).max() * dim))


def test_bounds_rule_out_most_pairs_of_smooth_vectors():
    rng = np.random.default_rng(2)
    make = lambda n: np.floor(256 * np.repeat(rng.normal(size=(n, 8)), 8, axis=1) + rng.normal(size=(n, 64)))
    def block(v):
        rows = [(k, 0, x) for k, x in enumerate(v)]
        return H._Block({c: x[0] for c, x in H._pack(0, rows).to_pydict().items()})
    a, b, settled = block(make(50)), block(make(400)), [0, 0]
    s = H.exact(a.vectors, b.vectors)
    least = np.sort(s, axis=1)[:, -5][:, None]
    i, j, score = H.candidates(a, b, np.arange(50), np.arange(400), least, np.full((50, 1), 2 ** 62), settled)
    assert sum(settled) > 0.9 * 50 * 400 and settled[0] > 0
    assert {(x, y) for x, y in zip(i, j)} >= {(x, y) for x, y in zip(*np.nonzero(s >= least))}
