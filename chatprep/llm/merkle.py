"""Merkle manifest of a dataset, with octopus multiproofs.

Every row is a leaf. The leaves of a group (a source) form a tree of runs of sixteen, ordered by
id; the roots of the groups form a tree of their own, whose root stands for the dataset. Leaves
and nodes are tables: ``leaves`` with each leaf's place, ``nodes`` with every interior node by
tree, level and index.

Proofs are made by leaf partition, a block of at most FAN^3 consecutive places of one tree. A
partition works out which node coordinates all its proofs need and its own leaves can't give (the
minimal union, in both trees), fetches these once with one join, derives the interior nodes that
its proofs share, and expands each leaf's proof on the spot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import Scratch, skew_join
from chatprep.operators.positions import number_rows

#: Children of a node, as a power of two, and the levels of a leaf partition.
FAN_BITS = 4
BLOCK_LEVELS = 3
FAN = 1 << FAN_BITS
#: The tree of the groups' roots; groups have the trees "n" (null) and "s" + the group's value.
TOP = "t"

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """One field of a leaf: ``-`` for null, else its UTF-8 byte count, a colon and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def width(n: int, level: int) -> int:
    """Nodes of a level of a tree with ``n`` leaves."""
    return n + (1 << FAN_BITS * level) - 1 >> FAN_BITS * level


def _width(n: Column, level: int) -> Column:
    return F.shiftright(n + F.lit((1 << FAN_BITS * level) - 1), FAN_BITS * level)


def _node(tree: Column, level: Column, idx: Column) -> Column:
    return F.concat_ws(":", level, idx, tree)


@dataclass
class Manifest:
    leaves: DataFrame  # tree, pos, n (leaves of the tree), block, leaf, and the rows' kept columns
    nodes: DataFrame   # node ("level:idx:tree"), tree, level, idx, h
    trees: DataFrame   # tree, grp, n, h (the tree's root), rank (its place among the trees)
    n_trees: int


def _levels(rows: DataFrame, largest: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """Interior levels above ``rows`` (tree, n, idx, h), each written once: tree, n, level, idx, h.

    A tree ends at the level that has one node. Neighbours meet in the map side of the grouping,
    which leaves a run of sixteen as one row.
    """
    out, level = [], 0
    while width(largest, level) > 1:
        run = F.array_sort(F.collect_list(F.struct("idx", "h")))
        rows = (rows.filter(_width(F.col("n"), level) > 1)
                .groupBy("tree", "n", F.shiftright("idx", FAN_BITS).alias("up")).agg(run.alias("run"))
                .select("tree", "n", F.lit(level + 1).alias("level"), F.col("up").alias("idx"),
                        F.sha2(F.array_join(F.col("run.h"), ""), 256).alias("h")))
        level += 1
        rows = scratch.table(rows, f"{name}-{level}")
        out.append(rows)
    return out


def build(leaves: DataFrame, scratch: Scratch, group: str = "grp", key: str = "key") -> Manifest:
    """The manifest of ``leaves``: ``group``, ``key``, ``leaf``, and columns to keep.

    Leaves of a group ascend by key, nulls first; rows that repeat a key ascend by leaf, and equal
    leaves may stand in any order. Groups ascend bytewise, null first. No rows: no trees.
    """
    kept = [c for c in leaves.columns if c != group]
    grp = F.col(group).cast("string")
    tree = F.coalesce(F.concat(F.lit("s"), grp), F.lit("n"))
    # the number only tells equal leaves apart, so that a group of copies is no single block
    rows = leaves.select(tree.alias("tree"), grp.alias("grp"), *kept, F.monotonically_increasing_id().alias("_copy"))
    rows = scratch.table(rows, "rows")
    numbered = number_rows(rows, ["tree"], [key, "leaf", "_copy"], block_col="_copy", pos_col="pos", total_col="n",
                           dense=False)
    placed = scratch.table(numbered.select(
        "tree", "grp", "pos", "n", F.shiftright("pos", FAN_BITS * BLOCK_LEVELS).alias("block"), *kept), "leaves")
    largest = placed.agg(F.max("n")).first()[0] or 0
    levels = _levels(placed.select("tree", "n", F.col("pos").alias("idx"), F.col("leaf").alias("h")), largest, scratch, "level")
    # a tree's root: the only leaf, or the node of the first level with one node
    roots = placed.filter("n = 1").select("tree", "n", F.col("leaf").alias("h"))
    for k, x in enumerate(levels, 1):
        roots = roots.unionByName(x.filter(_width(F.col("n"), k) == 1).select("tree", "n", "h"))
    named = roots.withColumn("grp", F.when(F.startswith("tree", F.lit("s")), F.expr("substring(tree, 2)")))
    ranked = number_rows(named.withColumn("_all", F.lit(0)), ["_all"], ["grp"], block_col="_all", pos_col="rank",
                         dense=False)
    trees = scratch.table(ranked.select("tree", "grp", "n", "h", "rank"), "trees")
    n_trees = trees.count()
    top = trees.select(F.lit(TOP).alias("tree"), F.lit(n_trees).cast("bigint").alias("n"), F.col("rank").alias("idx"), "h")
    nodes = top.withColumn("level", F.lit(0))
    for x in levels + _levels(top, n_trees, scratch, "top"):
        nodes = nodes.unionByName(x)
    nodes = nodes.select(_node(F.col("tree"), F.col("level"), F.col("idx")).alias("node"), "tree", "level", "idx", "h")
    return Manifest(placed, nodes, trees, n_trees)


def octopus(places: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(level, index) of the nodes that proofs of the leaves at ``places`` need and can't derive
    from these leaves and from each other, in a tree of ``n`` leaves: the minimal union."""
    out, known, level = [], np.unique(places), 0
    while width(n, level) > 1:
        runs = np.unique(known >> FAN_BITS)
        members = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        members = members[members < width(n, level)]
        out += [(level, int(i)) for i in members[~np.isin(members, known, assume_unique=True)]]
        known, level = runs, level + 1
    return out


class _Path:
    """The derived nodes of a tree along the paths of some of its nodes."""

    def __init__(self, own: dict[int, str], fetched: dict[tuple[int, int], str], n: int):
        self.runs: list[dict[int, str]] = []  # level -> run -> hashes of its members, joined
        level, nodes = 0, dict(own)
        while width(n, level) > 1:
            count, runs = width(n, level), {}
            for r in {i >> FAN_BITS for i in nodes}:
                runs[r] = "".join([nodes[i] if i in nodes else fetched[level, i]
                                   for i in range(r * FAN, min(r * FAN + FAN, count))])
            self.runs.append(runs)
            nodes = {r: _h(x) for r, x in runs.items()}
            level += 1
        self.root = next(iter(nodes.values()))

    def sides(self, place: int) -> list[tuple[str, str]]:
        """What stands before and after the path from ``place``, level by level."""
        out = []
        for runs in self.runs:
            run, at = runs[place >> FAN_BITS], 64 * (place & FAN - 1)
            out.append((run[:at], run[at + 64:]))
            place >>= FAN_BITS
        return out


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _requests(blocks: DataFrame) -> DataFrame:
    """(tree, block, top, level, idx, node) of the nodes that each leaf partition lacks."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows = [(False, *x) for x in octopus(np.array(r["places"], np.int64), r["n"])]
                rows += [(True, *x) for x in octopus(np.array([r["rank"]], np.int64), r["n_trees"])]
                if rows:
                    yield pa.RecordBatch.from_pydict({
                        "tree": [r["tree"]] * len(rows), "block": pa.array([r["block"]] * len(rows), pa.int64()),
                        "top": [x[0] for x in rows], "level": pa.array([x[1] for x in rows], pa.int32()),
                        "idx": pa.array([x[2] for x in rows], pa.int64())})

    rows = blocks.select("tree", "block", "n", "rank", "n_trees", "places").mapInArrow(
        run, "tree string, block bigint, top boolean, level int, idx bigint")
    wanted = F.when(F.col("top"), F.lit(TOP)).otherwise(F.col("tree"))
    return rows.withColumn("node", _node(wanted, F.col("level"), F.col("idx")))


PROOF = "array<struct<place:int,siblings:array<string>>>"


def prove(manifest: Manifest, keep: Sequence[str], selected: Column | None = None, candidate: str | None = None,
          whole: bool = False) -> DataFrame:
    """For each selected leaf (default: all): ``keep``, leaf, subroot, root, proof_sha256 and
    folded_root, the root that ``candidate`` (a kept column; default: the leaf) folds to with the
    leaf's siblings; ``whole`` adds the proof itself, whose entries hold the path's place among
    its run and its siblings, from the leaf's run to the dataset's root.

    Only kept columns and node hashes move, and a block's fetched nodes are few (at most fifteen
    for each level of either tree when the block is whole).
    """
    leaves = manifest.leaves if selected is None else manifest.leaves.filter(selected)
    candidate = candidate or "leaf"
    blocks = leaves.groupBy("tree", "block", "n").agg(F.collect_list("pos").alias("places"))
    ranks = manifest.trees.select("tree", "rank").withColumn("n_trees", F.lit(manifest.n_trees).cast("bigint"))
    blocks = skew_join(blocks, ranks, "tree", F.col("block"))
    nodes = manifest.nodes.select("node", "h")
    if selected is not None:  # a part of a block needs leaves as well; whole blocks lack none
        nodes = nodes.unionByName(manifest.leaves.select(_node(F.col("tree"), F.lit(0), F.col("pos")).alias("node"),
                                                         F.col("leaf").alias("h")))
    got = skew_join(_requests(blocks), nodes, "node", F.col("block"))
    got = got.groupBy("tree", "block").agg(F.collect_list(F.struct("top", "level", "idx", "h")).alias("got"))
    heads = blocks.drop("places").join(got, ["tree", "block"], "left")
    kept = list(dict.fromkeys([*keep, "leaf", candidate]))
    rows = leaves.select("tree", "block", "pos", *kept)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes), "leaf string", "subroot string", "root string",
                        "proof_sha256 string", "folded_root string", *([f"proof {PROOF}"] if whole else [])])
    names = [*keep, "leaf", "subroot", "root", "proof_sha256", "folded_root", *(["proof"] if whole else [])]

    def expand(left: pa.Table, right: pa.Table) -> pa.Table:
        head = right.to_pylist()[0]
        fetched: tuple[dict, dict] = ({}, {})
        for x in head["got"] or ():
            fetched[x["top"]][x["level"], x["idx"]] = x["h"]
        places, own = left["pos"].to_pylist(), left["leaf"].to_pylist()
        path = _Path(dict(zip(places, own)), fetched[0], head["n"])
        top = _Path({head["rank"]: path.root}, fetched[1], head["n_trees"])
        above = top.sides(head["rank"])
        proofs, folded, full = [], [], []
        for place, mine in zip(places, left[candidate].to_pylist()):
            sides = path.sides(place) + above
            proofs.append(_h("".join([a + b for a, b in sides])))
            for a, b in sides:
                mine = _h(a + mine + b)
            folded.append(mine)
            if whole:
                full.append([{"place": len(a) // 64, "siblings": [(a + b)[i:i + 64] for i in range(0, len(a) + len(b), 64)]}
                             for a, b in sides])
        n = len(places)
        cols = [*(left[c] for c in keep), left["leaf"], pa.array([path.root] * n), pa.array([top.root] * n),
                pa.array(proofs), pa.array(folded)]
        if whole:
            kind = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))
            cols.append(pa.array(full, kind))
        return pa.Table.from_arrays(cols, names)

    heads = heads.withColumnsRenamed({"tree": "in_tree", "block": "in_block"})
    return rows.groupBy("tree", "block").cogroup(heads.groupBy("in_tree", "in_block")).applyInArrow(expand, schema)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a whole proof come to: one expression, for any reader of a proof."""
    def step(h: Column, x: Column) -> Column:
        before = F.slice(x["siblings"], F.lit(1), x["place"])
        after = F.slice(x["siblings"], x["place"] + 1, F.greatest(F.size(x["siblings"]) - x["place"], F.lit(0)))
        return F.sha2(F.concat(F.array_join(before, ""), h, F.array_join(after, "")), 256)

    return F.aggregate(proof, leaf, step)


def document_leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", key: str = "doc_id",
                    text: str = "text", tampered: Column | None = None) -> DataFrame:
    """(grp, key, leaf, candidate) of every row: ``candidate`` is the leaf with A-Z of the text
    lower-cased where ``tampered`` holds, else the leaf. Other columns are not read."""
    leaf = leaf_of([F.col(c) for c in fields])
    if tampered is None:
        return docs.select(F.col(group).alias("grp"), F.col(key).alias("key"), leaf.alias("leaf"), leaf.alias("candidate"))
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = leaf_of([low if c == text else F.col(c) for c in fields])
    return docs.select(F.col(group).alias("grp"), F.col(key).alias("key"), leaf.alias("leaf"),
                       F.when(F.coalesce(tampered, F.lit(False)), changed).otherwise(leaf).alias("candidate"))


def manifest_report(docs: DataFrame, scratch: Scratch, tampered: Column, key: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: ``key``, leaf, subroot, root, proof_sha256, folded_root, verified.

    Null ids and null fields are leaves like any other; repeated rows give repeated leaves, one
    place each; an empty table gives an empty result.
    """
    tree = build(document_leaves(docs, key=key, tampered=tampered, **options), scratch)
    rows = prove(tree, ["key"], candidate="candidate")
    return rows.select(F.col("key").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
