"""Order-dependent numbering inside very large groups.

A plain ``row_number() over (partition by chat_id order by id)`` sends a whole chat
to one task; one chat may hold a third of all rows. Here the order range of each
chat is cut into blocks (``block_col div width``), the window runs per
``(chat, block)`` and a small per-block table supplies each block's offset (rows
and running sums of all earlier blocks of the chat). The data is shuffled once, on
``(chat, block)``; only the block table (one row per block) is aggregated further.
Where ids repeat or lie so far apart that such blocks would grow too large or too
many, the parts of a range partitioning are the blocks instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatprep.session import scratch_path

BLOCK_WIDTH = 1 << 16
NULL_BLOCK = -(1 << 62)
#: Blocks of ids are used while the largest holds at most so many times its width of rows ...
MAX_FILL = 4
#: ... and no key has more blocks than this (the block table is summed up per key).
MAX_BLOCKS = 1 << 20


def block_of(col, width: int = BLOCK_WIDTH) -> Column:
    """Floor division of an integral column by ``width`` (exact for negatives)."""
    c = col if isinstance(col, Column) else F.col(col)
    c = c.cast("bigint")
    return ((c - F.pmod(c, F.lit(width))) / F.lit(width)).cast("bigint")


def _by_range(x: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``x`` dealt out by ranges of (key, order), with the range's number as ``_blk``.

    Whatever the ids (far apart, repeated, null), a range holds about an equal share of the rows,
    and a key's ranges follow its order; rows that agree in all of it are split by a seeded number
    (``_tie``). The dealt rows are written once to the shared folder: range bounds come from a
    sample, so they must not be drawn twice."""
    spark = x.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ranges", uuid.uuid4().hex)
    dealt = x.withColumn("_tie", F.rand(42)).repartitionByRange(n, "_gk", *order, "_tie").withColumn("_blk", F.spark_partition_id().cast("bigint"))
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def blocks_fit(x: DataFrame, width: int) -> bool:
    """Whether the blocks ``_blk`` of the keys ``_gk`` are small and few enough (MAX_FILL, MAX_BLOCKS):
    one count by block, combined map-side; one row reaches the driver."""
    per_key = x.groupBy("_gk", "_blk").agg(F.count(F.lit(1)).alias("_n")) \
        .groupBy("_gk").agg(F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_b"))
    rows, blocks = per_key.agg(F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.max("_b"), F.lit(0))).first()
    return rows <= MAX_FILL * width and blocks <= MAX_BLOCKS


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], *,
                block_col: str, width: int = BLOCK_WIDTH,
                sums: Mapping[str, Column] | None = None,
                pos_col: str = "pos", total_col: str | None = None,
                sum_totals: bool = False, dense: bool | None = None) -> DataFrame:
    """Add a 0-based position ``pos_col`` within ``keys`` following ``order``.

    ``block_col`` must be integral and non-decreasing along ``order`` (normally the
    first order column); nulls come first. A block of ids then holds at most ``width`` rows
    when ``block_col`` is unique per key. Nothing is assumed of it: by default the blocks are
    counted first (``blocks_fit``), and where ids repeat or lie far apart, the parts of a range
    partitioning are the blocks. ``dense=True`` leaves the count out and takes blocks of ids,
    ``dense=False`` takes the range partitioning. ``order`` should end in a unique tie-break for
    reproducible positions. ``sums`` maps new column names to non-negative per-row values and
    adds their running (inclusive) sums; ``total_col`` adds the row count of the key,
    ``sum_totals`` the full sum per key as ``<name>_total``.
    """
    sums = dict(sums or {})
    keys = list(keys)
    # struct(keys) is never null and null fields compare equal, so rows of a null
    # chat are numbered like any other chat; null order values sort first and get
    # the lowest block. Join and window share the key (_gk, _blk): one exchange.
    x = df.withColumns({"_gk": F.struct(*keys), **{f"_v_{n}": c.cast("bigint") for n, c in sums.items()}})
    if dense is not False:
        by_id = x.withColumn("_blk", F.coalesce(block_of(block_col, width), F.lit(NULL_BLOCK)))
        dense = dense or blocks_fit(by_id, width)
    x = by_id if dense else _by_range(x, order)

    aggs = [F.count(F.lit(1)).alias("_bn")] + [F.sum(f"_v_{n}").alias(f"_bs_{n}") for n in sums]
    w_before = Window.partitionBy("_gk").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy("_gk")
    offs = [F.coalesce(F.sum("_bn").over(w_before), F.lit(0)).alias("_off_n")]
    offs += [F.coalesce(F.sum(f"_bs_{n}").over(w_before), F.lit(0)).alias(f"_off_{n}") for n in sums]
    if total_col:
        offs.append(F.sum("_bn").over(w_all).cast("bigint").alias(total_col))
    if sum_totals:
        offs += [F.sum(f"_bs_{n}").over(w_all).cast("bigint").alias(f"{n}_total") for n in sums]
    blocks = x.groupBy("_gk", "_blk").agg(*aggs).select("_gk", "_blk", *offs)

    w = Window.partitionBy("_gk", "_blk").orderBy(*order, *([] if dense else ["_tie"]))
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = [F.col(c) for c in df.columns if c not in {pos_col, *sums}]
    out.append((F.col("_off_n") + F.row_number().over(w) - 1).cast("bigint").alias(pos_col))
    out += [(F.col(f"_off_{n}") + F.sum(f"_v_{n}").over(run)).cast("bigint").alias(n) for n in sums]
    out += [F.col(c) for c in ([total_col] if total_col else []) + ([f"{n}_total" for n in sums] if sum_totals else [])]
    return x.join(blocks, on=["_gk", "_blk"], how="inner").select(*out)
