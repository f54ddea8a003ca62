"""Fixed schemas of the engine's tables."""

from pyspark.sql import types as T

MESSAGES = T.StructType([
    T.StructField("chat_id", T.LongType(), True),
    T.StructField("id", T.LongType(), True),
    T.StructField("sent_at", T.TimestampNTZType(), True),
    T.StructField("hhmm", T.StringType(), True),
    T.StructField("sender", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("reply_to_message_id", T.LongType(), True),
])
MESSAGE_COLUMNS = [f.name for f in MESSAGES.fields]

# Delimited history CSV (``id;time;from;text;reply_to_message_id``), read with an explicit schema.
HISTORY_CSV = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("time", T.StringType(), True),
    T.StructField("from", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("reply_to_message_id", T.StringType(), True),
])

# One live chat event (a flattened chat-service message object).
LIVE = T.StructType([
    T.StructField("message_id", T.LongType(), True),
    T.StructField("chat_id", T.LongType(), True),
    T.StructField("date", T.LongType(), True),
    T.StructField("sender_id", T.LongType(), True),
    T.StructField("username", T.StringType(), True),
    T.StructField("content_type", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("sticker_emoji", T.StringType(), True),
    T.StructField("reply_to_message_id", T.LongType(), True),
])

RESPONSES = T.StructType([
    T.StructField("chat_id", T.LongType(), True),
    T.StructField("prompt_id", T.LongType(), True),
    T.StructField("raw_response", T.StringType(), True),
])

REPLY_TYPE = "struct<text:string,reply_to_message_id:bigint>"


def with_fields(schema: T.StructType, **fields: T.DataType) -> T.StructType:
    """A copy of ``schema`` with extra nullable fields (the original is not changed)."""
    return T.StructType(list(schema.fields) + [T.StructField(k, v, True) for k, v in fields.items()])
