"""Chat-format turns ``{role, name, content}`` and their content text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatprep import constants as K
from chatprep.functions.text import ascii_handle

__all__ = [
    "TURN_TYPE", "chat_name", "encode_content", "encode_chat_turn", "system_turn", "reply_prefix_content",
    "is_bot_handle", "turn_json_length",
]

TURN_TYPE = "struct<role:string,name:string,content:string>"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def encode_content(id_, hhmm, sender, text, reply) -> Column:
    """The message as a JSON object text (keys id, time, from, text, reply_to_message_id).

    Missing reply ids are kept as JSON null.
    """
    s = F.struct(_c(id_).cast("bigint").alias("id"), _c(hhmm).alias("time"),
                 _c(sender).alias("from"), _c(text).alias("text"),
                 _c(reply).cast("bigint").alias("reply_to_message_id"))
    return F.to_json(s, {"ignoreNullFields": "false"})


def is_bot_handle(handle, bot_name: str = K.BOT_NAME_API, aliases=K.BOT_ALIASES) -> Column:
    """Turn belongs to the bot: folded handle equals the folded bot name or an alias."""
    names = [F.lit(a) for a in aliases] + [ascii_handle(F.lit(bot_name))]
    return _c(handle).isin(*names)


def chat_name(sender) -> Column:
    """Turn name: the folded handle; a handle that folds to nothing (an emoji-only
    name) becomes ``Anonym``."""
    return F.coalesce(F.nullif(ascii_handle(sender), F.lit("")), F.lit(K.DEFAULT_SENDER))


def encode_chat_turn(id_, hhmm, sender, text, reply, bot_name: str = K.BOT_NAME_API) -> Column:
    """Chat turn: the bot's own messages become ``assistant`` turns holding the bare
    text; everyone else is a ``user`` turn named by handle, holding the JSON content."""
    handle = ascii_handle(sender)
    bot = is_bot_handle(handle, bot_name)
    return F.when(bot, F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("name"),
                                _c(text).alias("content"))) \
        .otherwise(F.struct(F.lit("user").alias("role"), chat_name(sender).alias("name"),
                            encode_content(id_, hhmm, sender, text, reply).alias("content")))


def system_turn(text) -> Column:
    t = text if isinstance(text, Column) else F.lit(text)
    return F.struct(F.lit("system").alias("role"), F.lit(None).cast("string").alias("name"),
                    t.alias("content"))


def reply_prefix_content(text, reply) -> Column:
    """Assistant content: ``@<reply> text`` for replies, the text alone otherwise."""
    r = _c(reply)
    return F.when(r.isNotNull(), F.concat(F.lit("@"), r.cast("string"), F.lit(" "), _c(text))) \
        .otherwise(_c(text))


def turn_json_length(turn) -> Column:
    """Length of a turn as the chat prompt writes it (``", "`` and ``": "`` separators):
    compact JSON length plus one per key colon and one per comma."""
    t = _c(turn)
    j = F.to_json(t)
    extra = F.when(t["name"].isNull(), F.lit(3)).otherwise(F.lit(5))
    return F.length(j).cast("bigint") + extra
