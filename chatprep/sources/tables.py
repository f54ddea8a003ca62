"""Adapters from the given tables onto the ``messages`` and ``live`` schemas.

``events`` becomes a chat log (ids in time order, six senders, some replies);
``conversations`` becomes short chats, one per ``conv_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep import constants as K
from chatprep.functions.text import hhmm_of

CONV_START = "2024-01-01 00:00:00"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def messages_from_events(spark: SparkSession, sf_dir: str, n_chats: int | None = 3) -> DataFrame:
    """``events`` as chat messages. ``n_chats=None`` puts everything in chat 0."""
    e = read_table(spark, sf_dir, "events")
    chat = (F.col("user_id") % n_chats) if n_chats else F.lit(0).cast("bigint")
    reply = F.when((F.col("event_id") % 5 == 0) & (F.col("event_id") >= 12),
                   F.col("event_id") - 1 - (F.col("user_id") % 12))
    return e.select(
        chat.cast("bigint").alias("chat_id"),
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp_ntz").alias("sent_at"),
        hhmm_of(F.col("ts")).alias("hhmm"),
        F.concat(F.lit("user_"), (F.col("user_id") % 6).cast("string")).alias("sender"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("text"),
        reply.cast("bigint").alias("reply_to_message_id"),
    )


def messages_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as chats: one chat per conversation, id = turn + 1,
    sender = role, one minute between turns."""
    c = read_table(spark, sf_dir, "conversations")
    sent = F.timestamp_add("MINUTE", F.col("turn"), F.lit(CONV_START).cast("timestamp_ntz"))
    return c.select(
        F.col("conv_id").alias("chat_id"),
        (F.col("turn") + 1).alias("id"),
        sent.alias("sent_at"),
        hhmm_of(sent).alias("hhmm"),
        F.col("role").alias("sender"),
        F.col("text"),
        F.lit(None).cast("bigint").alias("reply_to_message_id"),
    )


# Content types given to events, by event type (every type the live handler accepts
# occurs; text dominates as in a real chat).
_EVENT_CONTENT = {"click": "text", "view": "text", "signup": "sticker", "purchase": "photo",
                  "error": "text"}


def live_from_events(spark: SparkSession, sf_dir: str, n_chats: int = 3) -> DataFrame:
    """``events`` as live chat events (unix dates, usernames, content types, commands).

    Content types follow the event type (text, sticker, photo). Events with
    ``event_id % 50 == 7`` carry a help command and ``% 40 == 3`` a joke command, so
    the command rules see traffic; users with ``user_id % 6 == 0`` post as the bot
    account (sender id 0) and ``% 6 == 5`` have no username.
    """
    e = read_table(spark, sf_dir, "events")
    ctype = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in _EVENT_CONTENT.items()],
                       F.lit("document"))
    uid = F.col("user_id")
    text = (F.when(F.col("event_id") % 50 == 7, F.concat(F.lit(K.CMD_HELP), F.lit(" ")))
            .when(F.col("event_id") % 40 == 3, F.concat(F.lit(K.CMD_JOKE), F.lit(" "), F.col("event_type")))
            .otherwise(F.concat(F.col("event_type"), F.lit(" "), F.col("props"))))
    username = F.when(uid % 6 == 0, F.lit(K.BOT_NAME_API)).when(uid % 6 == 5, F.lit("")) \
        .otherwise(F.concat(F.lit("user_"), (uid % 6).cast("string")))
    reply = F.when((F.col("event_id") % 5 == 0) & (F.col("event_id") >= 12),
                   F.col("event_id") - 1 - (uid % 12))
    return e.select(
        F.col("event_id").alias("message_id"),
        (uid % n_chats).cast("bigint").alias("chat_id"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("date"),
        (uid % 6).alias("sender_id"),
        username.alias("username"),
        ctype.alias("content_type"),
        F.when(ctype == "text", text).alias("text"),
        F.when(ctype == "sticker", F.lit("😀")).alias("sticker_emoji"),
        reply.cast("bigint").alias("reply_to_message_id"),
    )
