"""SimHash groups, connected components, decontamination: against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from chatprep.llm import decontaminate as D
from chatprep.llm import simhash as S
from chatprep.llm.common import Scratch, skew_join
from chatprep.llm.components import connected_components


def lower_az(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def slow_fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower_az(text))
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < k else [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows, bits=3):
    fps = [slow_fingerprint(t) for _, t in rows]
    near = lambda a, b: bin(a ^ b).count("1") <= bits
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and near(fps[i], fps[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    smallest = {}
    for (d, _), g in zip(rows, label):
        if d is not None:
            smallest[g] = min(d, smallest.get(g, d))
    return sorted((str(d), f"{f:016x}", smallest.get(g)) for (d, _), f, g in zip(rows, fps, label))


@pytest.fixture(scope="module")
def texts():
    random.seed(1)
    words = "the quick brown fox jumps over the lazy dog and runs away from all other animals at night".split() * 7
    rows = []
    for k in range(50):  # near copies: one word changed
        w = list(words)
        w[random.randrange(len(w))] = f"x{k}"
        rows.append((k, " ".join(w)))
    for k in range(60):
        rows.append((100 + k, " ".join(random.choice("abcdefgh") * random.randrange(1, 4) for _ in range(30))))
    rows += [(200, None), (201, ""), (202, "A b"), (202, "a B"), (None, " \n"), (203, "one"), (None, "lone words here now"),
             (204, " ".join(words) * 40)]
    return rows


@pytest.mark.parametrize("block,runs", [(8192, (512, 64)), (16, (8, 4))])
def test_simhash_groups(spark, texts, block, runs, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "RUNS", runs)
    monkeypatch.setattr(S, "BLOCKS_PER_RANGE", 1)
    df = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, fp int").repartition(3)
    out = S.near_groups(df, Scratch(spark, "t")).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in out) == slow_groups(texts)
    assert S.near_groups(df.limit(0), Scratch(spark, "t")).count() == 0


def test_forest_joins_what_lies_near():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40), base ^ np.uint64(0xF0)]))
    u, v = S.forest(fps, None, 3)
    assert len(u) < len(fps)
    assert len(u) == 80  # each base with its copies at 1 and 2 bits; those at 4 bits stay alone
    a, b = fps[::2], fps[1::2]
    x, y = S.forest(a, b, 3)
    assert all(bin(int(p) ^ int(q)).count("1") <= 6 for p, q in zip(x, y)) and len(x)


@pytest.mark.parametrize("ranges", [32, 64])
def test_links_over_roots_that_differ_in_the_top_bit(spark, ranges, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    monkeypatch.setattr(S, "BLOCKS_PER_RANGE", 1)
    rnd = random.Random(7)
    fps = set()
    for _ in range(ranges // 4):  # two ranges of near fingerprints, and their copies across bit 63
        base = rnd.getrandbits(63)
        fps |= {base ^ low ^ top for low in (0, 1, 2, 3, 4, 5, 6, 7) for top in (0, 1 << 63 | 1 << 59)}
    fps = sorted(fps)
    assert len(fps) == ranges * 4
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    member = connected_components(S.links(df, len(fps), 3, Scratch(spark, "t")), Scratch(spark, "t"))
    groups = {}
    for r in member.collect():
        groups.setdefault(r.label, set()).add(r.node % (1 << 64))
    label = {f: f for f in fps}
    for a, b in itertools.combinations(fps, 2):
        if bin(a ^ b).count("1") <= 3 and label[a] != label[b]:
            old, new = label[a], label[b]
            label = {f: new if g == old else g for f, g in label.items()}
    want = {}
    for f, g in label.items():
        want.setdefault(g, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_one_of_each_group(spark, texts):
    df = spark.createDataFrame([(d, t, 7, "s") for d, t in texts] + [(203, "one", 7, "s")],
                               "doc_id long, text string, group_key int, fingerprint string")
    out = S.one_of_each_group(df, Scratch(spark, "t"))
    assert out.columns == df.columns
    got = [r.doc_id for r in out.collect()]
    want = {c for _, _, c in slow_groups(texts)}
    assert len(got) == len(set(got)) and {x for x in got if x is not None} == want - {None}
    assert None in got  # the text that only a row without id has


def test_components(spark):
    random.seed(4)
    edges = [(i, i + 1) for i in range(100, 150)] + [(0, random.randrange(200, 240)) for _ in range(30)]
    edges += [(random.randrange(300, 360), random.randrange(300, 360)) for _ in range(40)] + [(5, 5), (None, 3), (0, 200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in connected_components(df, Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_skew_join_deals_out_hot_keys(spark):
    left = spark.range(1000).selectExpr("id", "if(id < 600, 7, id) as k")
    right = spark.range(1000).selectExpr("id as k", "id * 2 as v")
    hot = skew_join(left, right, "k", left["id"], hot=[7])
    assert sorted(map(tuple, hot.collect())) == sorted(map(tuple, left.join(right, "k").select(*hot.columns).collect()))


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(t))


def slow_report(docs, items):
    windows = {}
    for i, t in items:
        w = words_of(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s:s + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words_of(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s:s + n])]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((str(d), len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out)


def test_decontamination(spark):
    random.seed(2)
    some = lambda n: " ".join(random.choice("a b c É d ß".split()) for _ in range(n))
    long_items = [(i, some(random.choice([10, 11, 12, 14]))) for i in range(15)]
    short_items = long_items + [(50 + n, some(n)) for n in (1, 3, 7, 9)] + [(60, None), (61, ""), (62, "!!"), (53, "a b"),
                                                                            (53, "a b"), (None, some(12))]
    docs = [(k, some(random.randrange(0, 50))) for k in range(40)] + [
        (200, None), (201, ""), (202, long_items[3][1].upper()), (202, long_items[3][1].upper()),
        (None, f"x, {long_items[4][1]}! {long_items[5][1]}"), (203, "z" * 200 + " " + long_items[6][1] + " " + "y" * 300)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_words int").repartition(3)
    for items in (long_items, short_items[:-1]):
        got = D.report(df, spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t")).collect()
        assert sorted((str(r.doc_id), *list(r)[1:]) for r in got) == slow_report(docs, items)
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert D.report(df, no_items, Scratch(spark, "t")).filter("contaminated").count() == 0
    assert D.report(df.limit(0), no_items, Scratch(spark, "t")).count() == 0
    clean = D.clean_rows(df, spark.createDataFrame(long_items, "item_id long, text string"), Scratch(spark, "t"))
    assert clean.columns == df.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(d for d, *_, bad in slow_report(docs, long_items) if not bad)


def test_long_texts_are_read_in_stretches(spark, monkeypatch):
    """With stretches of 64 bytes nearly every text is long; windows cross their ends."""
    monkeypatch.setattr(D, "WORK_BYTES", 64)
    random.seed(9)
    word = lambda: random.choice(["ab", "cde", "Fgh", "é", "x" * 40])
    items = [(k, " ".join(word() for _ in range(14))) for k in range(6)] + [(7, "lone " + "y" * 90)]
    rows = [(k, " ".join(word() for _ in range(20)) + ", " + items[k % 7][1] + "; " + " ".join(word() for _ in range(9))) for k in range(30)]
    rows += [(31, "z" * 300), (32, None), (33, "-" * 500 + items[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = D.report(docs, spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t"))
    assert sorted(tuple(map(str, r)) for r in got.collect()) == sorted(tuple(map(str, r)) for r in slow_report(rows, items))


def test_winnowing_keeps_a_fingerprint_of_every_window():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 50, 500).astype(np.uint64)
    kept = set(D.winnow(hashes, 6).tolist())
    for s in range(len(hashes) - 5):
        window = hashes[s:s + 6]
        assert any(s + k in kept and window[k] == window.min() for k in range(6))
