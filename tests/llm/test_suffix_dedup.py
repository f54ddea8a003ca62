"""Suffix-array dedup: against brute force; suffix arrays against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from chatprep.llm import suffix_array as A, suffix_dedup as D
from chatprep.llm.common import Scratch
from tests.conftest import SF0001


def slow_dedup(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append(str((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def run(spark, rows, length, **options):
    df = spark.createDataFrame([(d, t, b"", 1) for d, t in rows], "doc_id long, text string, body binary, n_bytes int").repartition(3)
    return sorted(str(tuple(r)) for r in D.dedup(df, Scratch(spark, "t"), length, **options).collect())


def sample():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, line = prose(60), prose(9)
    rows = [(k, prose(30) + shared[rng.randrange(40):rng.randrange(60, 250)] + prose(20)) for k in range(40)]
    rows += [(50 + k, f"{shared[:150]}{k}{shared[150:]}") for k in range(30)]  # near copies
    rows += [(100 + k, shared) for k in range(5)] + [(110, "a" * 900), (111, "ab" * 300), (112, (line + "\n") * 30)]
    rows += [(120, None), (121, ""), (122, "short"), (122, "short"), (None, prose(50)), (None, None), (123, "x" * 39), (124, "y" * 40)]
    rows += [(130, prose(20) + line + prose(3) + line), (131, prose(40)), (131, prose(40))] + [rows[3]] * 4
    return rows


def test_equals_brute_force(spark):
    rows = sample()
    assert run(spark, rows, 40, gram=8) == slow_dedup(rows, 40)


def test_split_marks_and_shards_give_the_same(spark, monkeypatch):
    """Tiny shards and units: marks dealt out over many shards, groups beyond a shard, merge lanes."""
    rows = sample()
    want = slow_dedup(rows, 40)
    monkeypatch.setattr(D, "SHARD", 700)
    monkeypatch.setattr(D, "MAX_TEXT", 1200)
    monkeypatch.setattr(D, "MAX_UNIT", 20)
    monkeypatch.setattr(D, "STRETCH", 300)
    monkeypatch.setattr(D, "FILTER_BITS", 6)
    assert run(spark, rows, 40, gram=5) == want


def test_kept_text_and_empty_table(spark):
    rows = [(1, "0123456789" * 3 + "é"), (2, "x" + "0123456789" * 2), (3, "lone"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), r.n_removed) for r in D.dedup(df, Scratch(spark, "t"), 15, 4, with_text=True).collect()}
    assert got == {1: ("é".encode(), 30), 2: (b"x", 20), 3: (b"lone", 0), 4: (b"", 0)}
    assert D.dedup(df.limit(0), Scratch(spark, "t"), 15).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(str(tuple(r)) for r in D.dedup(docs, Scratch(spark, "t")).collect())
    assert got == slow_dedup(rows, 400)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 97, 255]), max_size=200), st.integers(1, 60), st.integers(1, 5))
def test_suffix_array_and_prefixes(values, depth, times):
    data = np.array(values * times, np.uint8)
    padded = data.tobytes() + b"\0" * depth
    want = [padded[i:i + depth] for i in range(len(data))]
    order = A.suffix_array(data, depth)
    assert sorted(order.tolist()) == list(range(len(data))) and [want[i] for i in order] == sorted(want)
    common = A.common_prefixes(data, order, depth)
    for a, b in zip(order, order[1:]):
        assert common[b] == next((k for k in range(depth) if want[a][k] != want[b][k]), depth)
    seen = Counter(want)
    again, speaks = A.repeated(data, depth)
    assert again.tolist() == [seen[w] > 1 for w in want]
    assert sorted(want[i] for i in np.flatnonzero(speaks)) == sorted(seen)


def test_prefix_walk_goes_on_only_in_order(monkeypatch):
    """Long lanes: where two places share exactly ``depth`` bytes, the suffixes after them may stand the
    other way round, so the walk may not go on from there; nor past the end of a text that ends in zeros."""
    monkeypatch.setattr(A, "LANES", 2)
    rng, depth = np.random.default_rng(3), 12
    data = rng.integers(97, 101, 4000).astype(np.uint8)
    for a, b, k in rng.integers([0, 0, 8], [3950, 3950, 40], (60, 3)):
        data[b:b + k] = data[a:a + k].copy()
    zeros = np.concatenate([data[:300], np.zeros(20, np.uint8), data[:50], np.zeros(30, np.uint8)])
    for x in (data, zeros):
        padded = x.tobytes() + b"\0" * depth
        want = [padded[i:i + depth] for i in range(len(x))]
        seen = Counter(want)
        again, speaks = A.repeated(x, depth)
        assert again.tolist() == [seen[w] > 1 for w in want]
        assert sorted(want[i] for i in np.flatnonzero(speaks)) == sorted(seen)


def test_hashes_of_windows():
    data = np.frombuffer(random.Random(1).randbytes(300), np.uint8)
    for size in (1, 2, 3, 7, 32, 100, 300, 301):
        got = D.window_hashes(data, size)
        h = [0] * max(0, 300 - size + 1)
        for i in range(len(h)):
            for c in data[i:i + size]:
                h[i] = (h[i] * int(D._BASES[0]) + int(D._CODE[c])) % 2 ** 64
        assert got.tolist() == h
    with pytest.raises(ValueError):
        A.suffix_array(np.zeros(A.MAX_TEXT + 1, np.uint8), 8)
