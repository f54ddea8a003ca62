"""SimHash near-duplicates with a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, so neighbours share most of their bits, and cut
into blocks. A node of the index holds the bits in which all fingerprints below it agree: a mask
and a pattern. Above the blocks stand the range partitions and groups of them; inside a block
stand smaller runs. Pairs of nodes are followed from the top down, and a pair is pruned as soon
as its shared masked bits differ in more than the allowed number; what stays is compared bit by
bit. Each pair of blocks gives the edges of a spanning forest only, so a group of a thousand near
copies gives thousands of edges and not millions; connected components join the forests.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from chatprep.llm.common import HOT_SHARE, Scratch, skew_join
from chatprep.llm.components import connected_components

#: Fingerprints of a block, blocks of a range partition, and children of the nodes above.
BLOCK = 8192
BLOCKS_PER_RANGE = 4
FAN = 64
#: Runs inside a block, large to small; pairs of the smallest are compared bit by bit.
RUNS = (512, 64)
SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the words (split at ASCII white space, A-Z lower-cased) of a text.

    Every shingle counts, repeats included; a text of fewer words is one shingle; a text
    without words has fingerprint zero. A bit is set if over half the shingle hashes have it.
    """
    words = text.lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    xx = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return xx(body, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    hashes = np.array([xx(body[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded however long the text is
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text",
                      keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and fp (the fingerprint's 64 bits as a bigint); null texts have no words."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes), "fp bigint"])
    n = len(keep)

    def run(batches):
        for batch in batches:
            col = batch.column(n)
            fps = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in col), np.uint64, len(col))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + [pa.array(fps.view(np.int64))],
                                             [*keep, "fp"])

    return docs.select(*keep, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern in Gray order, as a bigint whose signed order is that order."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _runs(sorted_fps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks and patterns of consecutive runs of ``size`` fingerprints."""
    at = np.arange(0, len(sorted_fps), size)
    both, some = np.bitwise_and.reduceat(sorted_fps, at), np.bitwise_or.reduceat(sorted_fps, at)
    mask = ~(both ^ some)
    return mask, both & mask


def build_index(fps: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    """Blocks of the distinct ``fps`` in Gray order: range_id, block, mask, pattern, fps (packed)."""
    ranges = max(1, ceil(count / (BLOCK * BLOCKS_PER_RANGE)))

    def pack(range_id: int, seq: int, part: np.ndarray):
        mask, pattern = _runs(part, len(part))
        return pa.RecordBatch.from_pydict({
            "range_id": pa.array([range_id], pa.int64()), "block": pa.array([(range_id << 32) + seq], pa.int64()),
            "mask": pa.array(mask.view(np.int64)), "pattern": pa.array(pattern.view(np.int64)),
            "fps": pa.array([part.tobytes()], pa.binary())})

    def cut(batches):
        range_id, seq, held = TaskContext.get().partitionId(), 0, np.zeros(0, np.uint64)
        for batch in batches:
            held = np.concatenate([held, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            while len(held) >= BLOCK:
                yield pack(range_id, seq, held[:BLOCK])
                held, seq = held[BLOCK:], seq + 1
        if len(held):
            yield pack(range_id, seq, held)

    ordered = fps.select("fp").repartitionByRange(ranges, gray_rank(F.col("fp"))).sortWithinPartitions(
        gray_rank(F.col("fp")))
    return scratch.table(ordered.mapInArrow(
        cut, "range_id bigint, block bigint, mask bigint, pattern bigint, fps binary"), "blocks")


def _upper(nodes: DataFrame, parent: Column) -> DataFrame:
    """The nodes above: the bits that all children share."""
    both, some = F.bit_and("pattern"), F.bit_or("pattern")
    shared = F.bit_and("mask").bitwiseAND(F.bitwise_not(both.bitwiseXOR(some)))
    return (nodes.groupBy(parent.alias("id")).agg(shared.alias("mask"), both.alias("_both"))
            .select("id", "mask", F.col("_both").bitwiseAND(F.col("mask")).alias("pattern")))


def _near(a: str, b: str, bits: int) -> Column:
    differ = F.col(f"{a}_pattern").bitwiseXOR(F.col(f"{b}_pattern"))
    return F.bit_count(differ.bitwiseAND(F.col(f"{a}_mask")).bitwiseAND(F.col(f"{b}_mask"))) <= bits


def block_pairs(blocks: DataFrame, bits: int) -> DataFrame:
    """(a, b), a <= b: the pairs of blocks whose shared bits differ in at most ``bits``."""
    spark = blocks.sparkSession
    parent = lambda c: F.shiftright(c, FAN.bit_length() - 1)
    levels = [(blocks.select(F.col("block").alias("id"), "mask", "pattern", F.col("range_id").alias("parent"))),
              _upper(blocks, F.col("range_id")).withColumn("parent", parent(F.col("id")))]
    top = blocks.agg(F.max("range_id")).first()[0]
    if top is None:
        return spark.createDataFrame([], "a bigint, b bigint")
    while top >= FAN:
        levels.append(_upper(levels[-1], F.col("parent")).withColumn("parent", parent(F.col("id"))))
        top >>= FAN.bit_length() - 1
    roots = sorted(tuple(r) for r in levels[-1].select("id", "mask", "pattern").collect())  # at most FAN
    # Python counts the bits of the absolute value, so the 64 bits are taken without their sign
    pairs = spark.createDataFrame(
        [(i, j) for i, m, p in roots for j, n, q in roots
         if i <= j and ((p ^ q) & m & n & (1 << 64) - 1).bit_count() <= bits],
        "a bigint, b bigint")
    for nodes in reversed(levels[:-1]):
        side = lambda s: nodes.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "mask", "pattern", "parent")])  # noqa: B023,E731
        pairs = (pairs.join(side("x"), F.col("a") == F.col("x_parent")).join(side("y"), F.col("b") == F.col("y_parent"))
                 .filter((F.col("x_id") <= F.col("y_id")) & _near("x", "y", bits))
                 .select(F.col("x_id").alias("a"), F.col("y_id").alias("b")))
    return pairs


def _joined(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the groups of u and v in place; a label is the smallest index of its group."""
    while True:
        x, y = labels[u], labels[v]
        open_ = x != y
        if not open_.any():
            return
        u, v, x, y = u[open_], v[open_], x[open_], y[open_]
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while True:
            nxt = labels[labels]
            if (nxt == labels).all():
                break
            labels[:] = nxt


def forest(a: np.ndarray, b: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, fingerprint) that join what lies within ``bits`` in two sorted blocks.

    ``b`` None: inside ``a``. At most one edge for each fingerprint, however many pairs link.
    """
    same = b is None
    b = a if same else b
    shift = 0 if same else len(a)
    labels = np.arange(len(a) + (0 if same else len(b)))
    ia, ib, width = np.zeros(1, np.int64), np.zeros(1, np.int64), max(len(a), len(b), 1)
    for size in RUNS:
        (ma, pa_), (mb, pb) = _runs(a, size), _runs(b, size)
        fan = -(-width // size)
        ca = (ia[:, None] * fan + np.arange(fan)).reshape(-1)  # children of each node
        cb = (ib[:, None] * fan + np.arange(fan)).reshape(-1)
        ca = np.repeat(ca.reshape(-1, fan), fan, axis=1).reshape(-1)
        cb = np.tile(cb.reshape(-1, fan), (1, fan)).reshape(-1)
        real = (ca < len(ma)) & (cb < len(mb))
        if same:
            real &= ca <= cb
        ca, cb = ca[real], cb[real]
        close = np.bitwise_count((pa_[ca] ^ pb[cb]) & ma[ca] & mb[cb]) <= bits
        ia, ib, width = ca[close], cb[close], size
    place = np.arange(width)
    for at in range(0, len(ia), 256):
        xa = np.minimum(ia[at:at + 256, None] * width + place, len(a) - 1)
        xb = np.minimum(ib[at:at + 256, None] * width + place, len(b) - 1)
        k, i, j = np.nonzero(np.bitwise_count(a[xa][:, :, None] ^ b[xb][:, None, :]) <= bits)
        u, v = xa[k, i], xb[k, j] + shift
        _joined(labels, u[u != v], v[u != v])
    all_fps = a if same else np.concatenate([a, b])
    moved = np.nonzero(labels != np.arange(len(labels)))[0]
    return all_fps[moved], all_fps[labels[moved]]


def links(fps: DataFrame, count: int, bits: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``bits`` of each other."""
    blocks = build_index(fps, count, scratch)
    pairs = scratch.table(block_pairs(blocks, bits), "block_pairs")
    packed = blocks.select(F.col("block"), "fps")
    work = (pairs.join(packed.select(F.col("block").alias("a"), F.col("fps").alias("a_fps")), "a")
            .join(packed.select(F.col("block").alias("b"), F.col("fps").alias("b_fps")), "b"))

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                a = np.frombuffer(r["a_fps"], np.uint64)
                u, v = forest(a, None if r["a"] == r["b"] else np.frombuffer(r["b_fps"], np.uint64), bits)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["a", "b"])

    return scratch.table(work.select("a", "b", "a_fps", "b_fps").mapInArrow(run, "a bigint, b bigint"), "links")


def near_groups(docs: DataFrame, scratch: Scratch, shingle: int = 3, bits: int = 3, text: str = "text",
                doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``keep``, fp, fingerprint, component_id, n_same, group_key): one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over fingerprints that differ in at most
    ``bits`` bits, ``group_key`` the smallest of these fingerprints; ``n_same`` counts the rows
    with the same fingerprint. Null and empty texts have fingerprint zero and are linked like any
    other; rows with a null id are grouped too and never name a group unless it has no other id;
    repeated rows give repeated results; an empty table gives an empty one.
    """
    rows = scratch.table(with_fingerprints(docs, shingle, text, (doc_id, *keep)), "fingerprints")
    same = scratch.table(rows.groupBy("fp").agg(F.min(doc_id).alias("first"), F.count(F.lit(1)).alias("n_same")), "same")
    count, total = same.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_same"), F.lit(0))).first()
    edges = links(same, count, bits, scratch)
    member = connected_components(edges, scratch).withColumnRenamed("node", "fp")
    member = scratch.table(member.join(same.select("fp", "first"), "fp"), "members")
    smallest = member.groupBy("label").agg(F.min("first").alias("component"))
    of_fp = skew_join(member, smallest, "label", F.col("fp")).select("fp", "component", "label")
    groups = same.join(of_fp, "fp", "left").select(
        "fp", F.coalesce("component", "first").alias("component_id"), "n_same", F.coalesce("label", "fp").alias("group_key"))
    hot = [r[0] for r in same.filter(F.col("n_same") * HOT_SHARE > max(total, 10_000)).select("fp").collect()]
    out = skew_join(rows, groups, "fp", F.xxhash64(doc_id, *keep), hot=hot)
    return out.select(doc_id, *keep, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      "component_id", "n_same", "group_key")


def one_of_each_group(docs: DataFrame, scratch: Scratch, text: str = "text", doc_id: str = "doc_id",
                      **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id (nulls last;
    ties: smallest hash of the text), once if it is repeated. The columns are those of ``docs``."""
    mark = F.xxhash64(text)
    rows = near_groups(docs.select(doc_id, text, mark.alias("_mark")), scratch, text=text, doc_id=doc_id,
                       keep=("_mark",), **options)
    stay = rows.groupBy("group_key").agg(F.min(F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"),
                                                        F.col("_mark").alias("mark"))).alias("k"))
    stay = stay.select(F.col("k.id").alias("_id"), F.col("k.mark").alias("_mark")).distinct()
    found = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_doc_id"), mark.alias("_m"))
    found = found.join(stay, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_m") == F.col("_mark")))
    once = W.partitionBy("_doc_id", "_m").orderBy("_m")
    return found.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select("_row.*")
