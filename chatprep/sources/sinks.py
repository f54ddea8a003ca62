"""Writers for training files and chat logs."""

from __future__ import annotations

import time

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jsonl_sink(examples: DataFrame, path: str, split_col: str = "split") -> None:
    """One ``{"messages": [...]}`` document per line, one folder per split
    (``split=train`` / ``split=validation``). Null names are omitted and non-ASCII
    text is written as is."""
    examples.select(split_col, "messages").write.mode("overwrite").partitionBy(split_col) \
        .option("ignoreNullFields", "true").json(path)


#: Folders of a message log. Chats share them by hash, so millions of chats don't make millions of folders.
LOG_BUCKETS = 64


def log_bucket(n: int = LOG_BUCKETS) -> Column:
    return F.pmod(F.xxhash64("chat_id"), F.lit(n)).cast("int")


def parquet_log_sink(msgs: DataFrame, path: str, buckets: int = LOG_BUCKETS) -> None:
    """Message log in folders by a hash of the chat (``log_bucket``); the chat stays a column.
    The rebalance hint keeps the files per folder few while AQE splits a hot chat."""
    msgs.withColumn("log_bucket", log_bucket(buckets)).hint("rebalance", "log_bucket") \
        .write.mode("append").partitionBy("log_bucket").parquet(path)


def read_log(spark, path: str, chat_id: int | None = None, buckets: int = LOG_BUCKETS) -> DataFrame:
    """A message log; of one chat, only its folder is read."""
    log = spark.read.parquet(path)
    if chat_id is not None:
        bucket = F.pmod(F.xxhash64(F.lit(chat_id).cast("bigint")), F.lit(buckets)).cast("int")
        log = log.where((F.col("log_bucket") == bucket) & (F.col("chat_id") == chat_id))
    return log.drop("log_bucket")


#: Arrivals of a landed file, about: a micro-batch of a stream that takes one file for each trigger.
FILE_ROWS = 500_000


def land_arrivals(rows: DataFrame, path: str, work: str, ids: DataFrame | None = None, order_col: str = "message_id",
                  file_rows: int = FILE_ROWS) -> int:
    """Writes ``rows`` below ``path`` one file after the other, in the order of their ids, so that a file
    source takes them in that order (by modification time, a second apart at least); returns the number of files. Files hold
    about ``file_rows`` rows, cut at quantiles of the ids: those of equal rows stay together, rows
    without an id come last. ``ids`` has the ids alone, if they are cheaper to read than ``rows``; the
    cut rows lie in ``work`` meanwhile."""
    ids = (rows if ids is None else ids).select(F.col(order_col).cast("double").alias("_id"))
    n = -(-ids.count() // file_rows)
    cut = rows.withColumn("_id", F.col(order_col).cast("double"))
    if n > 1:
        cuts = QuantileDiscretizer(numBuckets=n, inputCol="_id", outputCol="_slice", relativeError=min(0.01, 0.1 / n),
                                   handleInvalid="keep").fit(ids)
        cut = cuts.transform(cut).withColumn("_slice", F.coalesce(F.col("_slice").cast("int"), F.lit(n)))
    else:
        cut = cut.withColumn("_slice", F.lit(0))
    cut.drop("_id").hint("rebalance", "_slice").write.partitionBy("_slice").parquet(work)
    cut = rows.sparkSession.read.schema(T.StructType([*rows.schema, T.StructField("_slice", T.IntegerType())])).parquet(work)
    slices = sorted(r[0] for r in cut.select("_slice").distinct().collect()) or [0]
    for i, k in enumerate(slices):
        if i:
            time.sleep(1.1)
        cut.where(F.col("_slice") == k).drop("_slice").coalesce(1).write.mode("append").parquet(path)
    return len(slices)


def read_jsonl(spark, path: str) -> DataFrame:
    return spark.read.schema(
        "messages array<struct<role:string,name:string,content:string>>, split string").json(path) \
        .withColumn("doc", F.to_json(F.struct("messages")))
