"""Delimited message records ``[MSG]id[FS]time[FS]from[FS]text[FS]reply[MEG]`` and model replies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatprep import constants as K

__all__ = [
    "encode_record", "encode_record_prefix", "decode_record", "parse_reply_prefix",
    "parse_record_replies", "is_pass_or_placeholder", "RECORD_FIELDS",
]

RECORD_FIELDS = ("id", "time", "from", "text", "reply_to_message_id")
_SEP_RE = re.escape(K.SEP)
_END_RE = re.escape(K.END_MSG)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _s(x) -> Column:
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def encode_record_prefix(id_, hhmm, sender) -> Column:
    """The record up to and including the separator after the sender (open record)."""
    return F.concat(F.lit(K.BEGIN_MSG), _s(id_), F.lit(K.SEP), _s(hhmm), F.lit(K.SEP),
                    _s(sender), F.lit(K.SEP))


def encode_record(id_, hhmm, sender, text, reply) -> Column:
    """Full delimited record; a missing reply id is the empty field."""
    return F.concat(encode_record_prefix(id_, hhmm, sender), _s(text), F.lit(K.SEP),
                    _s(reply), F.lit(K.END_MSG))


def decode_record(c) -> Column:
    """Delimited string -> struct(id, time, from, text, reply_to_message_id), all strings.

    Null unless both markers occur and the separator splits the unmarked text into
    4 or 5 parts (5 = with reply id). Markers are removed wherever they occur.
    """
    s = _c(c)
    body = F.replace(F.replace(s, F.lit(K.BEGIN_MSG), F.lit("")), F.lit(K.END_MSG), F.lit(""))
    parts = F.split(body, _SEP_RE, -1)
    n = F.size(parts)
    rec = F.struct(
        F.get(parts, 0).alias("id"), F.get(parts, 1).alias("time"),
        F.get(parts, 2).alias("from"), F.get(parts, 3).alias("text"),
        F.when(n == 5, F.get(parts, 4)).alias("reply_to_message_id"),
    )
    ok = s.contains(K.BEGIN_MSG) & s.contains(K.END_MSG) & n.isin(4, 5)
    return F.when(ok, rec)


def parse_reply_prefix(c) -> Column:
    """API-style answer ``@<id> text`` -> struct(text, reply_to_message_id).

    Empty answer -> null (nothing to send). A leading ``@`` with a space: the id is
    the part between ``@`` and the first space (null if not an integer) and the body
    follows the space. Without a space the whole answer is the body and the id null.
    """
    s = _c(c)
    sp = F.instr(s, " ")
    is_ref = F.startswith(s, F.lit("@")) & (sp > 0)
    rid = F.when(is_ref, F.trim(F.substr(s, F.lit(2), sp - 2)).try_cast("bigint"))
    body = F.when(is_ref, F.substr(s, sp + 1)).otherwise(s)
    return F.when(F.length(s) >= 1, F.struct(body.alias("text"), rid.alias("reply_to_message_id")))


def parse_record_replies(c, bot_name) -> Column:
    """Local-model answer -> array<struct(text, reply_to_message_id)>.

    The answer continues an open record, so its first part (up to the end marker) is
    ``text[FS]reply``; nothing is sent unless that part holds a separator. Each
    following part is a record (its end marker was consumed by the split). Records
    are taken while they parse and come from the bot; placeholder texts are skipped.
    """
    bot = bot_name if isinstance(bot_name, Column) else F.lit(bot_name)
    out_type = "array<struct<text:string,reply_to_message_id:bigint>>"
    reply = lambda text, rid: F.struct(text.alias("text"), F.trim(rid).try_cast("bigint").alias("reply_to_message_id"))

    def record(part: Column) -> Column:
        # a part lost its end marker to the split: it is the bot's record when it has a begin
        # marker, 4 or 5 fields and the bot as its sender
        return _bind(F.split(F.replace(part, F.lit(K.BEGIN_MSG), F.lit("")), _SEP_RE, -1), lambda f: F.when(
            part.contains(K.BEGIN_MSG) & F.size(f).isin(4, 5) & (F.get(f, 2) == bot),
            reply(F.get(f, 3), F.when(F.size(f) == 5, F.get(f, 4)))))

    def followed(records: Column) -> Column:
        stop = F.array_position(F.transform(records, lambda r: r.isNull()), True)
        taken = F.when(stop == 0, records).otherwise(F.slice(records, 1, F.greatest(stop - 1, F.lit(0))))
        return F.filter(taken, lambda r: r["text"] != F.lit(K.PLACEHOLDER_TEXT))

    def replies(parts: Column) -> Column:
        first = _bind(F.split(F.get(parts, 0), _SEP_RE, -1), lambda f: F.array(reply(F.get(f, 0), F.get(f, 1))))
        rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), record)
        return F.when(F.get(parts, 0).contains(K.SEP), F.concat(first, _bind(rest, followed))).otherwise(
            F.array().cast(out_type))

    return _bind(F.split(_c(c), _END_RE, -1), replies)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def is_pass_or_placeholder(text) -> Column:
    """Replies the API head drops: starting with 'pass' (any case) or the placeholder."""
    t = _c(text)
    return (F.lower(F.substr(t, F.lit(1), F.lit(4))) == F.lit(K.RESPONSE_PASS)) | \
        F.startswith(t, F.lit(K.PLACEHOLDER_TEXT))
