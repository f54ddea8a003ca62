"""Merkle manifest: against a brute-force tree; minimal unions against every smaller set."""

import hashlib
import random
import zlib
from itertools import groupby

import numpy as np
from pyspark.sql import functions as F

from chatprep.llm import merkle as M
from chatprep.llm.common import Scratch

H = lambda x: hashlib.sha256(x.encode()).hexdigest()


def slow_leaf(row, low=False):
    d, text, lang, source, n = row
    if low and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def slow_path(hashes, place):
    """(before, after) level by level, and the root."""
    sides = []
    while len(hashes) > 1:
        run, at = place // 16 * 16, place % 16
        mine = hashes[run:run + 16]
        sides.append(("".join(mine[:at]), "".join(mine[at + 1:])))
        hashes, place = [H("".join(hashes[i:i + 16])) for i in range(0, len(hashes), 16)], place // 16
    return sides, hashes[0]


def slow_report(rows):
    leaves = sorted(((r[3] is not None, (r[3] or "").encode(), r[0] is not None, r[0] or 0, slow_leaf(r)), r) for r in rows)
    trees = [list(g) for _, g in groupby(leaves, key=lambda x: x[0][:2])]
    roots = [slow_path([x[0][-1] for x in t], 0)[1] for t in trees]
    out = []
    for rank, t in enumerate(trees):
        above, root = slow_path(roots, rank)
        for place, (k, r) in enumerate(t):
            sides = slow_path([x[0][-1] for x in t], place)[0] + above
            cur = slow_leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for a, b in sides:
                cur = H(a + cur + b)
            out.append((r[0], k[-1], roots[rank], root, H("".join(a + b for a, b in sides)), cur, cur == root))
    return sorted(map(str, out))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int"


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def sample():
    rng = random.Random(3)
    rows = [(k, f"Text {k} É", rng.choice(["en", None]), "hot", k) for k in range(600)]
    rows += [(k, "A b" * 3, "fr", f"s{k % 40}é", None) for k in range(60)]
    rows += [(None, None, None, None, None), (None, "X", None, None, 1), (5, "", "en", "", 0), (7, "Long " * 40_000, "en", "hot", 1)]
    return rows + [rows[0]] * 20 + [rows[-3]] * 3  # repeated rows


def test_report_equals_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = M.manifest_report(docs, Scratch(spark, "t"), tampered())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(str(tuple(r)) for r in got.collect()) == slow_report(rows)


def test_small_and_empty_tables(spark):
    for rows in ([], [(1, "One", "en", "s", 3)], [(1, "t", None, f"s{k}", 1) for k in range(17)]):
        docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
        got = M.manifest_report(docs, Scratch(spark, "t"), tampered()).collect()
        assert sorted(str(tuple(r)) for r in got) == slow_report(rows)


def test_proofs_of_selected_leaves_fold_to_the_root(spark, monkeypatch):
    """Blocks of 16 leaves, so that proofs need nodes of many levels from other partitions."""
    monkeypatch.setattr(M, "BLOCK_LEVELS", 1)
    rows = sample()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    tree = M.build(M.document_leaves(docs, tampered=tampered()), Scratch(spark, "t"))
    some = M.prove(tree, ["key"], selected=F.col("pos") % 7 == 3, candidate="candidate", whole=True)
    got = some.select("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", M.fold(F.col("leaf"), F.col("proof")).alias("r"),
                      F.sha2(F.array_join(F.flatten(F.transform("proof", lambda x: x["siblings"])), ""), 256).alias("p")).collect()
    want = set(slow_report(rows))
    assert len(got) > 80
    for r in got:
        assert r.r == r.root and r.p == r.proof_sha256
        assert str((r.key, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.folded_root == r.root)) in want


def test_octopus_is_the_minimal_union():
    rng = random.Random(5)
    for n in (1, 2, 16, 17, 300, 4097):
        for size in (1, 3, 40):
            places = np.array(sorted(rng.sample(range(n), min(size, n))))
            got = M.octopus(places, n)
            need, known = set(), {(0, int(p)) for p in places}
            for p in places.tolist():  # what each proof needs, and what the leaves' paths give
                for level in range(10):
                    if M.width(n, level) <= 1:
                        break
                    need |= {(level, i) for i in range(p // 16 * 16, min(p // 16 * 16 + 16, M.width(n, level)))}
                    known.add((level, p))
                    p //= 16
            assert len(got) == len(set(got)) and set(got) == need - known
