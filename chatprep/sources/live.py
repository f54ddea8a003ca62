"""Live chat events: the per-arrival input of the bot, as a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep import constants as K
from chatprep.functions.text import default_sender, hhmm_of, placeholder_text
from chatprep.schema import LIVE


def unix_to_ntz(c, tz: str = "UTC"):
    """Unix seconds -> TIMESTAMP_NTZ wall clock in ``tz`` (session zone not used)."""
    col = c if not isinstance(c, str) else F.col(c)
    utc = F.timestamp_add("SECOND", col.cast("bigint"), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))
    return utc if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def normalize_live(live: DataFrame, tz: str = "UTC", keep=()) -> DataFrame:
    """Live record -> message row plus the live-only columns (content_type, sender_id,
    date, reply_to_sender_id when present) and any ``keep`` columns."""
    sent = unix_to_ntz("date", tz)
    extra = [F.col("reply_to_sender_id")] if "reply_to_sender_id" in live.columns else []
    extra += [F.col(c) for c in keep]
    return live.select(
        F.col("chat_id"), F.col("message_id").alias("id"), sent.alias("sent_at"),
        hhmm_of(sent).alias("hhmm"),
        default_sender("username").alias("sender"),
        placeholder_text(F.col("text"), F.col("sticker_emoji")).alias("text"),
        F.col("reply_to_message_id"), F.col("content_type"), F.col("sender_id"), F.col("date"), *extra)


def live_source(spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None,
                schema=LIVE) -> DataFrame:
    """Stream of live events from files landing in ``path`` (one schema, no
    inference); only the content types the bot handles pass."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path).where(F.col("content_type").isin(*K.CONTENT_TYPES))
