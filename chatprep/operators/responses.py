"""Model answers back into reply rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep import constants as K
from chatprep.functions.records import parse_record_replies, parse_reply_prefix, is_pass_or_placeholder


def parse_responses(responses: DataFrame, mode: str = "api", bot_name: str = K.BOT_NAME_LOCAL,
                    text_col: str = "raw_response") -> DataFrame:
    """responses(chat_id, prompt_id, raw_response) -> one row per reply to send:
    chat_id, prompt_id, reply_idx, text, reply_to_message_id.

    ``api``: ``@<id> text`` answers; replies starting with 'pass' or the placeholder
    are dropped. ``local``: delimited continuations, following records kept while
    they come from ``bot_name``."""
    if mode == "api":
        r = responses.withColumn("_r", parse_reply_prefix(text_col)).where(F.col("_r").isNotNull())
        r = r.select("chat_id", "prompt_id", F.lit(0).cast("bigint").alias("reply_idx"),
                     F.col("_r.text").alias("text"), F.col("_r.reply_to_message_id").alias("reply_to_message_id"))
        return r.where(~is_pass_or_placeholder("text"))
    if mode == "local":
        r = responses.select("chat_id", "prompt_id",
                             F.posexplode(parse_record_replies(text_col, bot_name)).alias("reply_idx", "_r"))
        return r.select("chat_id", "prompt_id", F.col("reply_idx").cast("bigint").alias("reply_idx"),
                        F.col("_r.text").alias("text"), F.col("_r.reply_to_message_id").alias("reply_to_message_id"))
    raise ValueError("mode must be 'api' or 'local'")


def response_violations(responses: DataFrame, mode: str = "local", bot_name: str = K.BOT_NAME_LOCAL,
                        text_col: str = "raw_response") -> DataFrame:
    """Prompts whose answer parses to more than one reply (the API head allows one)."""
    n = F.size(parse_record_replies(text_col, bot_name)) if mode == "local" else F.lit(1)
    return responses.select("chat_id", "prompt_id", n.cast("bigint").alias("n_replies")).where(F.col("n_replies") > 1)


def union_bot_messages(msgs: DataFrame, sent: DataFrame, bot_name: str = K.BOT_NAME_API) -> DataFrame:
    """The bot's sent messages (columns of ``msgs``, without a sender) join the history."""
    return msgs.unionByName(sent.withColumn("sender", F.lit(bot_name)), allowMissingColumns=True)
