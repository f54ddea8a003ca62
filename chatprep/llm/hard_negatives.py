"""Hard negatives: rows of another label that score almost as high as a positive.

Scores are inner products of integer vectors. The rows are packed into blocks, each with a summary
of every vector: the mean and the deviation of each of its segments. For two vectors a segment of
length l adds between l*m1*m2 - d1*d2 and l*m1*m2 + d1*d2 to the product (m: means; d: the length
of what is left of the segment without its mean), so sums over segments bound a score from both
sides. Coarse segments are tried first; pairs that the bounds don't settle are refined with finer
ones, and what is left is scored exactly.

Anchors (queries) and rows meet in the cells of a grid: a cell holds one block of anchors and a
share of the blocks of rows, which a task reads one after the other, so it holds two blocks at a
time and each row is sent once for every block of anchors. Cells return each anchor's best few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import Scratch

#: Vectors of a block, and anchors of a block.
BLOCK = 2048
ANCHORS = 1024
#: Segments of a vector, coarse to fine.
LEVELS = (4, 16)
#: Positives of an anchor, negatives of a positive, and the share of the positive's score, in
#: hundredths, that a negative's must reach and must not exceed.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 3, 50, 95

_PACKED = "block bigint, n int, dim int, ids binary, labels binary, vectors binary, summaries array<binary>"
_TYPES = [("block", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()),
          ("vectors", pa.binary()), ("summaries", pa.list_(pa.binary()))]
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def segments(dim: int, count: int) -> np.ndarray:
    """Starts of ``count`` segments (``dim`` at most) of about equal length."""
    return np.unique(np.linspace(0, dim, min(count, max(dim, 1)), endpoint=False).astype(int))


def summary(vectors: np.ndarray, count: int) -> np.ndarray:
    """Means times the root of the length, then deviations, of each vector's segments."""
    at = segments(vectors.shape[1], count)
    length = np.diff(np.append(at, vectors.shape[1]))
    total = np.add.reduceat(vectors, at, axis=1)
    square = np.add.reduceat(vectors * vectors, at, axis=1)
    mean = total / np.sqrt(length)  # the root of l on either side gives l * m1 * m2
    return np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0))]).astype(np.float32)


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most that the products of two sets of vectors can be, by their summaries."""
    k = a.shape[1] // 2
    middle, spread = a[:, :k] @ b[:, :k].T, a[:, k:] @ b[:, k:].T
    # room for the rounding of single floats, relative to the vectors' lengths: bounds may be loose, never wrong
    room = 1e-5 * np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1)) + 1e-5
    return middle - spread - room, middle + spread + room


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of integer vectors given as doubles; raises where one may not fit a long."""
    largest = a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if largest < 2.0 ** 53:
        return np.rint(a @ b.T).astype(np.int64)
    if largest < 2.0 ** 56:  # a hundred times as much still fits a long
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise ValueError("components too large: scores may not fit a long")


class _Block:
    """Packed vectors with their ids, labels and summaries, in the order of the labels."""

    def __init__(self, row: dict):
        n = row["n"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        kind = np.int16 if len(row["vectors"]) == 2 * n * row["dim"] else np.float64
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(n, row["dim"]).astype(np.float64)
        self.summaries = [np.frombuffer(x, np.float32).reshape(n, -1) for x in row["summaries"]]

    def widen(self, dim: int) -> None:
        """Zeros up to ``dim`` components: vectors of different lengths meet so."""
        if self.vectors.shape[1] < dim:
            self.vectors = np.pad(self.vectors, ((0, 0), (0, dim - self.vectors.shape[1])))
            self.summaries = [summary(self.vectors, k) for k in LEVELS]


def _pack(number: int, rows: list[tuple]) -> pa.RecordBatch:
    rows = sorted(rows, key=lambda r: r[1])
    dim = max(1, *(len(r[2]) for r in rows))
    v = np.zeros((len(rows), dim))
    for k, r in enumerate(rows):
        v[k, :len(r[2])] = r[2]
    small = np.abs(v).max() < 1 << 15
    cols = [number, len(rows), dim, np.array([r[0] for r in rows], np.int64).tobytes(),
            np.array([r[1] for r in rows], np.int64).tobytes(), v.astype(np.int16 if small else np.float64).tobytes(),
            [summary(v, k).tobytes() for k in LEVELS]]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, (_, t) in zip(cols, _TYPES)], [x for x, _ in _TYPES])


def blocks(rows: DataFrame, size: int | None) -> DataFrame:
    """``rows`` (id, label, v) packed where they are, ``size`` to a block (None: a partition is a
    block, and its number the block's)."""
    def pack(batches):
        part, seq, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            values = batch.column(2)
            flat, offsets = values.flatten().to_numpy(zero_copy_only=False), values.offsets.to_numpy()
            offsets = offsets - offsets[0]
            for k, (i, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                held.append((i, label, flat[offsets[k]:offsets[k + 1]].copy()))
                if len(held) == size:
                    yield _pack((part << 32) + seq, held)
                    held, seq = [], seq + 1
        if held:
            yield _pack((part << 32) + seq if size else part, held)

    return rows.select("id", "label", "v").mapInArrow(pack, _PACKED)


def usable(rows: DataFrame, vector: str, label: Column, row_id: str) -> DataFrame:
    """(id, label, v) of the rows that take part: with an id, a label and a vector of finite
    components, each of which becomes ``floor(256 * component)``."""
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return (rows.select(F.col(row_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).alias("v"))
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(finite)
            .withColumn("v", F.transform("v", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))))


class Best:
    """The best ``k`` (score, id) of each query so far: higher scores first, then smaller ids;
    a pair that is met again counts once."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((queries, k), _LOW), np.full((queries, k), _HIGH)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        touched = np.unique(query)
        q = np.concatenate([np.repeat(touched, self.k), query])
        s = np.concatenate([self.scores[touched].ravel(), score])
        i = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((i, ~s, q))  # ~s falls as s rises
        q, s, i = q[order], s[order], i[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        q, s, i = q[fresh], s[fresh], i[fresh]
        first = np.searchsorted(q, touched)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        top = place < self.k
        self.scores[touched], self.ids[touched] = _LOW, _HIGH
        self.scores[q[top], place[top]], self.ids[q[top], place[top]] = s[top], i[top]

    def least(self) -> np.ndarray:
        """What a score must reach to matter: that of the k-th, or anything."""
        return self.scores[:, -1]


def candidates(a: _Block, b: _Block, rows_a: np.ndarray, rows_b: np.ndarray, low: np.ndarray, high: np.ndarray,
               settled: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs whose score may lie in one of the anchor's intervals,
    ``low`` to ``high`` (anchors x intervals): segment bounds coarse to fine, then exact products
    of what is left. ``settled`` counts the pairs that each level rules out."""
    open_ = np.ones((len(rows_a), len(rows_b)), bool)
    for level in range(len(LEVELS)):
        least, most = bounds(a.summaries[level][rows_a], b.summaries[level][rows_b])
        may = np.zeros(open_.shape, bool)
        for k in range(low.shape[1]):
            may |= (most >= low[rows_a, k, None]) & (least <= high[rows_a, k, None])
        may &= open_
        if settled is not None:
            settled[level] += int(open_.sum() - may.sum())
        rows, cols = may.any(1), may.any(0)
        rows_a, rows_b, open_ = rows_a[rows], rows_b[cols], may[np.ix_(rows, cols)]
        if not open_.size:
            none = np.zeros(0, np.int64)
            return none, none, none
    score = exact(a.vectors[rows_a], b.vectors[rows_b])
    i, j = np.nonzero(open_)
    return rows_a[i], rows_b[j], score[i, j]


class _Cell:
    """An anchors' block, its intervals, and the best few of each interval."""

    def __init__(self, a: _Block, low: np.ndarray, high: np.ndarray, k: int):
        self.a, self.low, self.high = a, low, high
        self.best = [Best(len(a.ids), k) for _ in range(low.shape[1])]

    def meet(self, b: _Block, same_label: bool) -> None:
        a = self.a
        dim = max(a.vectors.shape[1], b.vectors.shape[1])
        a.widen(dim)
        b.widen(dim)
        if same_label:
            groups = [(np.flatnonzero(a.labels == v), np.flatnonzero(b.labels == v)) for v in np.intersect1d(a.labels, b.labels)]
        else:
            groups = [(np.arange(len(a.ids)), np.arange(len(b.ids)))]
        for rows_a, rows_b in groups:
            low = np.stack([np.maximum(self.low[:, x], best.least()) for x, best in enumerate(self.best)], 1)
            i, j, score = candidates(a, b, rows_a, rows_b, low, self.high)
            fits = a.ids[i] != b.ids[j]
            if not same_label:
                fits &= a.labels[i] != b.labels[j]
            i, j, score = i[fits], j[fits], score[fits]
            for x, best in enumerate(self.best):
                good = (score >= low[i, x]) & (score <= self.high[i, x])
                best.add(i[good], score[good], b.ids[j[good]])

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        for x, best in enumerate(self.best):
            i, at = np.nonzero(best.scores != _LOW)
            if len(i):
                yield pa.RecordBatch.from_pydict({
                    "a": np.full(len(i), number), "i": i, "x": np.full(len(i), x), "anchor_id": self.a.ids[i],
                    "score": best.scores[i, at], "id": best.ids[i, at]})


def search(anchors: DataFrame, rows: DataFrame, k: int, same_label: bool, n_anchors: int, n_rows: int) -> DataFrame:
    """(a, i, best): for each anchor (block and place) and each of its intervals x, the first ``k``
    rows of its label (or of others) whose score lies in the interval, as structs of the negated
    score and the id. ``anchors`` has the columns of a block and ``intervals``, an array of
    (i, low, high arrays); anchors that it leaves out have none.
    """
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, min(n_rows, -(-tasks // max(n_anchors, 1))))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = [x for x, _ in _TYPES]
    heads = anchors.select(F.col("block").cast("int").alias("a"), each(shares).alias("share"), F.lit(0).alias("kind"), *names, "intervals")
    share = F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int")
    none = F.lit(None).cast(dict(anchors.dtypes)["intervals"])
    base = rows.select(each(max(n_anchors, 1)).alias("a"), share.alias("share"), F.lit(1).alias("kind"), *names, none.alias("intervals"))
    grid = heads.unionByName(base).repartition("a", "share").sortWithinPartitions("a", "share", "kind", "block")

    def run(batches):
        cell, at = None, None
        for batch in batches:
            for k_ in range(batch.num_rows):
                row = batch.slice(k_, 1).to_pylist()[0]
                if cell is not None and (row["a"], row["share"]) != at:
                    yield from cell.rows(at[0])
                    cell = None
                if row["kind"] == 0:
                    block = _Block(row)
                    width = max((len(x["low"]) for x in row["intervals"]), default=1)
                    low, high = np.full((row["n"], width), _HIGH), np.full((row["n"], width), _LOW)
                    for x in row["intervals"]:
                        low[x["i"], :len(x["low"])], high[x["i"], :len(x["high"])] = x["low"], x["high"]
                    cell, at = _Cell(block, low, high, k), (row["a"], row["share"])
                elif cell is not None:
                    cell.meet(_Block(row), same_label)
        if cell is not None:
            yield from cell.rows(at[0])

    found = grid.mapInArrow(run, "a bigint, i bigint, x bigint, anchor_id bigint, score bigint, id bigint")
    best = F.array_sort(F.array_distinct(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))))
    return found.groupBy("a", "i", "x", "anchor_id").agg(F.slice(best, 1, k).alias("best"))


_INTERVALS = "array<struct<i:int,low:array<bigint>,high:array<bigint>>>"


def mine(rows: DataFrame, is_anchor: Column, scratch: Scratch, label: Column | None = None, row_id: str = "vec_id",
         vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST,
         most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which ``is_anchor`` (of the column ``id``) holds; an anchor's
    positives are its best other rows of the same label, and a positive's hard negatives the best
    rows of other labels whose score is ``least`` to ``most`` hundredths of the positive's. Higher
    scores come first, ties by smaller id.

    Rows with a null id or label, or with a null, NaN or infinite component, take no part. Rows
    are other rows if their ids differ. Repeated rows count once; rows that share an id but not
    the vector count for each score of theirs, and as anchors each on its own. Shorter vectors end
    in zeros. Components so large that a
    score may not fit a long raise. No rows, anchors or labels: no result.
    """
    data = usable(rows, vector, F.col("label") if label is None else label, row_id)
    packed = scratch.table(blocks(data, BLOCK), "blocks")
    n_rows = packed.count()
    chosen = scratch.table(data.filter(is_anchor).distinct(), "anchors")
    n_parts = max(1, -(-chosen.count() // ANCHORS))
    heads = scratch.table(blocks(chosen.repartition(n_parts), None), "anchor_blocks")

    whole = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(
        i.alias("i"), F.array(F.lit(int(_LOW) + 1)).alias("low"), F.array(F.lit(int(_HIGH))).alias("high")))
    near = search(heads.withColumn("intervals", whole.cast(_INTERVALS)), packed, positives, True, n_parts, n_rows)
    near = scratch.table(near.select("a", "i", F.transform("best", lambda x: F.struct(
        (-x["minus"]).alias("score"), x["id"].alias("id"))).alias("positives")), "positives")

    # 100 * low >= least * positive and 100 * high <= most * positive, in whole numbers
    def hundredths(x: Column, share: int) -> Column:  # rounded down
        part = x["score"] * F.lit(share)
        return F.call_function("div", part - F.pmod(part, F.lit(100)), F.lit(100))

    low = F.transform("positives", lambda x: -hundredths(x, -least))
    high = F.transform("positives", lambda x: hundredths(x, most))
    wanted = near.groupBy("a").agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), low.alias("low"), high.alias("high")))
                                   .cast(_INTERVALS).alias("intervals"))
    ready = heads.join(wanted.withColumnRenamed("a", "block"), "block")
    far = search(ready, packed, negatives, False, n_parts, n_rows)
    of = near.select("a", "i", F.posexplode("positives").alias("x", "p"))
    out = far.join(of, ["a", "i", "x"]).select("anchor_id", F.col("p.id").alias("positive_id"), "p.score",
                                               F.posexplode("best").alias("at", "n"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"),
                      F.col("score").alias("positive_score"), (-F.col("n.minus")).alias("negative_score"))
