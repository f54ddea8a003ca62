"""Reproducible shuffles, exact random splits, ordered splits and draws."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep import constants as K
from chatprep.functions.hashing import seeded_md5, seeded_int
from chatprep.operators.positions import number_rows
from chatprep.session import scratch_path


def shuffle_key(df: DataFrame, keys, seed: int = 42, name: str = "shuffle_key") -> DataFrame:
    """Seeded random order as a column; sort on it only where order matters."""
    return df.withColumn(name, seeded_md5(seed, *keys))


def _cut(hashes: DataFrame, k: int) -> tuple[str, int]:
    """(cut, need): of the rows sorted by ``h`` (``c`` rows each), the k-th has hash ``cut`` and
    is the ``need``-th of the rows with that hash.

    A histogram over 4 more hex digits of the hash (at most 65,536 buckets) locates the bucket
    of the k-th row, until that bucket holds one hash. Only bucket counts reach the driver."""
    prefix, need = "", k
    while True:
        part = hashes.where(F.startswith("h", F.lit(prefix)))
        buckets = part.groupBy(F.substring("h", 1, len(prefix) + 4).alias("b")).agg(
            F.sum("c").alias("c"), F.min("h").alias("low"), F.max("h").alias("high")).collect()
        for b in sorted(buckets, key=lambda r: r["b"]):
            if b["c"] >= need:
                break
            need -= b["c"]
        if b["low"] == b["high"]:
            return b["low"], need
        prefix = b["b"]


def _first_rows(df: DataFrame, key, frac: float, names: tuple[str, str]) -> DataFrame:
    """``df`` with ``split``: names[1] for the first ``int(n * frac)`` rows by the string ``key``,
    names[0] for the rest.

    The table is never sorted, numbered or rewritten: the counted keys are written once to the
    shared folder, and ``_cut`` finds the key of the last row that goes. Where rows share that key,
    a hash of the whole row decides among them, and among identical rows their number.
    """
    h = df.withColumn("_h", key)
    path = scratch_path(df.sparkSession, "split", uuid.uuid4().hex)
    h.groupBy(F.col("_h").alias("h")).agg(F.count(F.lit(1)).alias("c")).write.parquet(path)
    counts = df.sparkSession.read.schema("h string, c bigint").parquet(path)
    n = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    k = int(n * frac)
    if k <= 0 or k >= n:
        return h.drop("_h").withColumn("split", F.lit(names[0] if k <= 0 else names[1]))
    cut, need = _cut(counts, k)
    first = F.col("_h") < F.lit(cut)
    ties = counts.where(F.col("h") == cut).first()["c"]
    label = lambda cond: F.when(cond, F.lit(names[1])).otherwise(F.lit(names[0]))
    if need == ties:
        return h.withColumn("split", label(first | (F.col("_h") == cut))).drop("_h")
    rest = h.where(F.col("_h") != cut).withColumn("split", label(first)).drop("_h")
    same = h.where(F.col("_h") == cut).drop("_h").groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c")) \
        .withColumn("_r", F.md5(F.to_json(F.struct(*df.columns))))
    cut, need = _cut(same.select(F.col("_r").alias("h"), F.col("_c").alias("c")), need)
    copies = same.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_c"))))
    goes = (F.col("_r") < cut) | ((F.col("_r") == cut) & (F.col("_k") <= need))
    return rest.unionByName(copies.withColumn("split", label(goes)).drop("_c", "_r", "_k"))


def split_random(df: DataFrame, keys, frac: float = K.VALIDATION_FRAC, seed: int = 42,
                 names: tuple[str, str] = ("train", "validation")) -> DataFrame:
    """Exactly ``int(n * frac)`` rows (smallest seeded hash of ``keys``) go to the second split, the
    rest to the first; see ``_first_rows`` for rows that share a hash."""
    return _first_rows(df, seeded_md5(seed, *keys), frac, names)


def sortable_text(df: DataFrame, col: str):
    """A column as text whose bytewise order is the column's order, nulls first: integers, dates and
    timestamps as hexadecimal numbers, strings as they are. None for other types."""
    c, kind = F.col(col), dict(df.dtypes)[col]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        number = c.cast("bigint")
    elif kind == "date":
        number = F.unix_date(c).cast("bigint")
    elif kind == "timestamp":
        number = F.unix_micros(c)
    elif kind == "timestamp_ntz":
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        number = F.timestamp_diff("MICROSECOND", epoch, c)
    elif kind == "string":
        return F.coalesce(F.concat(F.lit("1"), c), F.lit("0"))
    else:
        return None
    text = F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.coalesce(F.concat(F.lit("1"), text), F.lit("0"))


def split_ordered(df: DataFrame, order_col: str, test_frac: float = K.SEGMENT_TEST_FRAC, keys=(),
                  names: tuple[str, str] = ("train", "test"), dense: bool | None = None) -> DataFrame:
    """The first ``int(n * (1 - test_frac))`` rows in order are train, the rest test
    (n per ``keys`` group, or over the whole table). Ties of ``order_col`` are ordered by a hash
    of the row, so every evaluation splits alike.

    Over the whole table the cut is the k-th row by refined counts of the order column (integers,
    dates, timestamps, strings); other types, and groups, are numbered. ``dense``: as in
    ``number_rows``; True takes blocks of the order column over the whole table too."""
    keys = list(keys)
    key = None if keys or dense else sortable_text(df, order_col)
    if key is not None:
        return _first_rows(df, key, 1.0 - test_frac, (names[1], names[0]))
    g = df if keys else df.withColumn("_all", F.lit(0))
    gk = keys or ["_all"]
    m = number_rows(g, gk, [order_col, F.xxhash64(*df.columns)], block_col=order_col, pos_col="_pos", total_col="_n",
                    dense=dense if keys or dense else False)
    train_n = F.floor(F.col("_n") * F.lit(1.0 - test_frac)).cast("bigint")
    out = m.withColumn("split", F.when(F.col("_pos") < train_n, F.lit(names[0])).otherwise(F.lit(names[1])))
    return out.drop("_pos", "_n", *([] if keys else ["_all"]))


def head_sample(df: DataFrame, order_col: str, n: int = K.HEAD_SAMPLE_ROWS) -> DataFrame:
    """The first ``n`` rows in order (trial runs): a top-n, not a sort of the table."""
    return df.orderBy(order_col).limit(n)


def draw_with_replacement(items: DataFrame, index_col: str, n_items: int, num_draws: int,
                          seed: int = 42) -> DataFrame:
    """``num_draws`` seeded draws (with replacement) of rows by a dense 0-based index;
    the draw list is generated by Spark and joined to the items on the index."""
    spark = items.sparkSession
    draws = spark.range(num_draws).withColumnRenamed("id", "draw") \
        .withColumn(index_col, seeded_int(seed, 0, max(n_items - 1, 0), "draw").cast("bigint"))
    return draws.join(items, on=index_col, how="inner")


def draw_segments(segs: DataFrame, num_draws: int, seed: int = 42) -> DataFrame:
    """``num_draws`` seeded draws (with replacement) of whole segments, of any number of chats:
    ``draw`` and the rows of the segment drawn. No segments: no rows."""
    keys = segs.select("chat_id", "seg_id").distinct().withColumn("_all", F.lit(0))
    numbered = number_rows(keys, ["_all"], ["chat_id", "seg_id"], block_col="seg_id", pos_col="_index",
                           dense=False).drop("_all")
    n = numbered.count()  # one number
    return draw_with_replacement(numbered, "_index", n, num_draws if n else 0, seed).drop("_index") \
        .join(segs, ["chat_id", "seg_id"])
