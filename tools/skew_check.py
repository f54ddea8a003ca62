"""Hot-chat experiment: one chat holding every row (generated with spark.range, a
local timing experiment only, not a registered query).

    python tools/skew_check.py [rows]

Compares the blocked numbering and the bucketed context window with the plain
whole-chat windows on the same rows; prints seconds and checks equal results.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from chatprep import get_spark  # noqa: E402
from chatprep.operators.context import context_at_each_message  # noqa: E402
from chatprep.operators.positions import number_rows  # noqa: E402


def timed(name, df, aggs):
    t = time.perf_counter()
    r = df.agg(*aggs).first()
    print(f"{name:28s} {time.perf_counter() - t:7.2f}s {tuple(r)}")
    return tuple(r)


def main():
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 10_000_000
    spark = get_spark("local[8]", shuffle_partitions=64)
    df = spark.range(0, n, numPartitions=32).select(
        F.lit(7).cast("bigint").alias("chat_id"), F.col("id"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("sent_at"),
        F.concat(F.lit("msg "), F.col("id").cast("string")).alias("text"))
    length = F.length("text") + 2
    w = Window.partitionBy("chat_id").orderBy("id")
    naive = df.withColumn("pos", F.row_number().over(w) - 1) \
        .withColumn("P", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blocked = number_rows(df, ["chat_id"], ["id"], block_col="id", sums={"P": length})
    aggs = [F.max("pos"), F.sum("P")]
    for _ in range(2):
        a = timed("numbering, whole-chat window", naive, aggs)
        b = timed("numbering, blocked", blocked, aggs)
        assert a == b
    budget = 600
    ctx = context_at_each_message(df, length, budget)
    q = naive.withColumn("Q", F.col("P") - length)
    rng = Window.partitionBy("chat_id").orderBy("P").rangeBetween(-budget, 0)
    naive_ctx = q.withColumn("_c", F.collect_list(F.struct("Q")).over(rng)) \
        .withColumn("n_context", F.size(F.filter("_c", lambda e: e["Q"] >= F.col("P") - budget)))
    aggs = [F.sum("n_context"), F.count(F.lit(1))]
    for _ in range(2):
        a = timed("context, whole-chat window", naive_ctx, aggs)
        b = timed("context, bucketed", ctx, aggs)
        assert a == b


if __name__ == "__main__":
    main()
