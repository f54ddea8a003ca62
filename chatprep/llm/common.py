"""Helpers shared by the operators: scratch tables, skew-safe joins, word expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.session import checkpoint_dir

#: White space between words: space, tab, line feed, vertical tab, form feed, return.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Everything ASCII that is neither a digit nor a lower-case letter separates alphanumeric words.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A key is hot when it holds over 1/HOT_SHARE of the rows; so at most HOT_SHARE keys are hot.
HOT_SHARE = 256
#: Parts into which the rows of a hot key are dealt.
HOT_PARTS = 64


class Scratch:
    """A fresh folder for one run, below the folder that all executors share."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_dir(spark)}/chatprep-llm/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read again: the lineage ends in shared files."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def spaced_words(text: Column) -> Column:
    """Words between white space, of a whole text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def alnum_words(text: Column) -> Column:
    """Lower-cased (A-Z) words of letters and digits; null has none.

    ``lower`` also folds letters outside ASCII. Only two of these give ASCII letters (U+0130,
    U+212A); a text that holds one of them takes the slower A-Z translation, so ASCII words
    and word boundaries are exactly those of lower-casing A-Z alone.
    """
    t = F.coalesce(text, F.lit(""))
    odd = t.contains("\u0130") | t.contains("\u212A")
    low = F.when(odd, F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(t))
    return F.array_remove(F.split(low, ALNUM_GAP), "")


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> list:
    """The values of ``key`` that hold over 1/share of the rows: at most ``share`` of them."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    if total < 10_000:  # such a table is small as a whole
        return []
    return [r[0] for r in counts.filter(F.col("_n") * share > total).select(key).collect()]


def skew_join(left: DataFrame, right: DataFrame, key: str, by: Column, how: str = "inner",
              hot: list | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, with the hot keys of ``left`` dealt out.

    Rows of a hot key go to one of HOT_PARTS parts by ``by`` (any column of ``left`` that tells
    its rows apart); the rows of ``right`` with that key are copied to each part.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    part = F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(HOT_PARTS)).cast("int")).otherwise(F.lit(0))
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    return (left.withColumn("_part", part)
            .join(right.withColumn("_part", F.explode(parts)), [key, "_part"], how).drop("_part"))
