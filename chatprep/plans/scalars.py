"""Scalar-function queries over whole texts of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatprep import constants as K
from chatprep.functions import chat as CH
from chatprep.functions import records as RC
from chatprep.functions import text as TX
from chatprep.operators.positions import number_rows
from chatprep.plans.live import LIVE_MSGS_SQL, LIVE_SQL
from chatprep.plans.registry import (register, bot_handles_sql, events_messages_sql, CONV_MESSAGES_SQL, ascii_handle_sql, chat_name_sql,
                                     content_json_sql)
from chatprep.sources.live import normalize_live
from chatprep.sources.tables import (messages_from_conversations, messages_from_events, live_from_events,
                                     read_table)


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


DOC_SENDER_SQL = "CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '' ELSE text END"


def _doc_sender():
    k = F.col("doc_id") % 4
    return F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit("")).otherwise(F.col("text"))


@register("default_sender", sql=f"""SELECT doc_id, COALESCE(NULLIF(text, ''), 'Anonym') AS sender,
  COALESCE(NULLIF({DOC_SENDER_SQL}, ''), 'Anonym') AS sender_or_blank FROM documents""")
def q_default_sender(spark, sf):
    """Every whole text as a sender, and the same with some made null or empty."""
    return _docs(spark, sf).select("doc_id", TX.default_sender("text").alias("sender"),
                                   TX.default_sender(_doc_sender()).alias("sender_or_blank"))


@register("ascii_handle", sql=f"""SELECT doc_id, {ascii_handle_sql('text')} AS handle,
  {ascii_handle_sql(DOC_SENDER_SQL)} AS handle_or_blank FROM documents""")
def q_ascii_handle(spark, sf):
    """Handles folded from whole document texts (letters of four languages, '@', quotes), and
    from the same with some made null or empty."""
    return _docs(spark, sf).select("doc_id", TX.ascii_handle("text").alias("handle"),
                                   TX.ascii_handle(_doc_sender()).alias("handle_or_blank"))


@register("iso_to_hhmm", sql="""SELECT event_id, strftime(strptime(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S'), '%H:%M') AS hhmm
FROM events""")
def q_iso_to_hhmm(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", TX.iso_to_hhmm(TX.iso_of("ts")).alias("hhmm"))


@register("unix_to_iso", sql=f"""SELECT message_id, strftime(TIMESTAMP '1970-01-01 00:00:00' + date * INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S') AS iso
FROM ({LIVE_SQL})""")
def q_unix_to_iso(spark, sf):
    return live_from_events(spark, sf).select("message_id", TX.unix_to_iso("date").alias("iso"))


@register("current_hhmm", sql=f"""SELECT chat_id, max(id) AS last_id, strftime(max(sent_at), '%H:%M') AS now
FROM ({events_messages_sql(3)}) GROUP BY chat_id""")
def q_current_hhmm(spark, sf):
    """Clock of the open record, here as of each chat's newest message (so it can be reproduced)."""
    return messages_from_events(spark, sf, 3).groupBy("chat_id").agg(
        F.max("id").alias("last_id"), F.max("sent_at").alias("t")) \
        .select("chat_id", "last_id", TX.current_hhmm(F.col("t")).alias("now"))


@register("placeholder_text", sql=f"""SELECT message_id, COALESCE(NULLIF(text, ''), NULLIF(sticker_emoji, ''), '(image or file)') AS text
FROM ({LIVE_SQL})""")
def q_placeholder(spark, sf):
    lv = live_from_events(spark, sf)
    return lv.select("message_id", TX.placeholder_text("text", "sticker_emoji").alias("text"))


@register("clean_nulls", sql=f"""SELECT message_id, COALESCE(text, '') AS text, COALESCE(sticker_emoji, '') AS sticker_emoji,
  TRY_CAST(CAST(reply_to_message_id AS VARCHAR) AS BIGINT) AS reply_to_message_id FROM ({LIVE_SQL})""")
def q_clean_nulls(spark, sf):
    lv = live_from_events(spark, sf)
    return lv.select("message_id", TX.clean_text("text").alias("text"), TX.clean_text("sticker_emoji").alias("sticker_emoji"),
                     TX.to_reply_id(F.col("reply_to_message_id").cast("string")).alias("reply_to_message_id"))


@register("normalize_live", sql=f"SELECT chat_id, id, hhmm, sender, text, reply_to_message_id, content_type FROM ({LIVE_MSGS_SQL})")
def q_normalize_live(spark, sf):
    return normalize_live(live_from_events(spark, sf)) \
        .select("chat_id", "id", "hhmm", "sender", "text", "reply_to_message_id", "content_type")


REC_SQL = ("'[MSG]' || CAST(id AS VARCHAR) || '[FS]' || hhmm || '[FS]' || sender || '[FS]' || text || '[FS]' "
           "|| COALESCE(CAST(reply_to_message_id AS VARCHAR), '') || '[MEG]'")


@register("encode_record", sql=f"SELECT id, {REC_SQL} AS record FROM ({events_messages_sql(3)})")
def q_encode_record(spark, sf):
    m = messages_from_events(spark, sf, 3)
    return m.select("id", RC.encode_record("id", "hhmm", "sender", "text", "reply_to_message_id").alias("record"))


@register("encode_record_prefix", sql=f"""SELECT chat_id, id, '[MSG]' || CAST(id AS VARCHAR) || '[FS]' || hhmm || '[FS]' || sender || '[FS]' AS prefix
FROM ({CONV_MESSAGES_SQL})""")
def q_encode_record_prefix(spark, sf):
    m = messages_from_conversations(spark, sf)
    return m.select("chat_id", "id", RC.encode_record_prefix("id", "hhmm", "sender").alias("prefix"))


def _mangled_records(spark, sf):
    """Records in three shapes: full, without the reply field, without the end marker."""
    m = messages_from_events(spark, sf, 3)
    full = RC.encode_record("id", "hhmm", "sender", "text", "reply_to_message_id")
    four = F.concat(RC.encode_record_prefix("id", "hhmm", "sender"), F.col("text"), F.lit(K.END_MSG))
    k = F.col("id") % 3
    rec = F.when(k == 0, full).when(k == 1, four).otherwise(F.replace(full, F.lit(K.END_MSG), F.lit("")))
    return m.select("id", rec.alias("s"))


MANGLED_SQL = f"""SELECT id, CASE id % 3 WHEN 0 THEN {REC_SQL}
  WHEN 1 THEN '[MSG]' || CAST(id AS VARCHAR) || '[FS]' || hhmm || '[FS]' || sender || '[FS]' || text || '[MEG]'
  ELSE replace({REC_SQL}, '[MEG]', '') END AS s FROM ({events_messages_sql(3)})"""


@register("decode_record", sql=f"""WITH r AS ({MANGLED_SQL}),
d AS (SELECT id, s, string_split(replace(replace(s, '[MSG]', ''), '[MEG]', ''), '[FS]') AS f FROM r)
SELECT id, f[1] AS rid, f[2] AS rtime, f[3] AS rfrom, f[4] AS rtext, CASE WHEN len(f) = 5 THEN f[5] END AS rreply
FROM d WHERE contains(s, '[MSG]') AND contains(s, '[MEG]') AND len(f) IN (4, 5)""")
def q_decode_record(spark, sf):
    d = _mangled_records(spark, sf).withColumn("r", RC.decode_record("s")).where(F.col("r").isNotNull())
    return d.select("id", F.col("r.id").alias("rid"), F.col("r.time").alias("rtime"), F.col("r.from").alias("rfrom"),
                    F.col("r.text").alias("rtext"), F.col("r.reply_to_message_id").alias("rreply"))


@register("encode_content", sql=f"SELECT id, {content_json_sql()} AS content FROM ({events_messages_sql(3)})")
def q_encode_content(spark, sf):
    m = messages_from_events(spark, sf, 3)
    return m.select("id", CH.encode_content("id", "hhmm", "sender", "text", "reply_to_message_id").alias("content"))


@register("encode_chat_turn", sql=f"""WITH m AS ({CONV_MESSAGES_SQL}),
h AS (SELECT *, CASE WHEN sender = 'assistant' THEN '{K.BOT_NAME_API}' ELSE sender END AS who FROM m)
SELECT chat_id, id, CASE WHEN {ascii_handle_sql('who')} IN ({bot_handles_sql()}) THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN {ascii_handle_sql('who')} IN ({bot_handles_sql()}) THEN NULL ELSE {chat_name_sql('who')} END AS name,
  CASE WHEN {ascii_handle_sql('who')} IN ({bot_handles_sql()}) THEN text ELSE {content_json_sql(sender='who')} END AS content
FROM h""")
def q_encode_chat_turn(spark, sf):
    """Chat turns of conversations, the assistant role standing for the bot account."""
    m = messages_from_conversations(spark, sf)
    who = F.when(F.col("sender") == "assistant", F.lit(K.BOT_NAME_API)).otherwise(F.col("sender"))
    t = CH.encode_chat_turn("id", "hhmm", who, "text", "reply_to_message_id", K.BOT_NAME_API)
    return m.select("chat_id", "id", t["role"].alias("role"), t["name"].alias("name"), t["content"].alias("content"))


@register("strip_prompt", sql="""WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
SELECT conv_id, turn, substr(text || nxt, length(text) + 1) AS completion FROM c WHERE nxt IS NOT NULL""")
def q_strip_prompt(spark, sf):
    """Completion = model output minus the echoed prompt (output = turn text + next turn)."""
    c = number_rows(read_table(spark, sf, "conversations"), ["conv_id"], ["turn"], block_col="turn")
    nxt = c.select("conv_id", (F.col("pos") - 1).alias("pos"), F.col("text").alias("nxt"))
    c = c.join(nxt, ["conv_id", "pos"], "inner")  # the next turn: equi-join on (conversation, position)
    return c.select("conv_id", "turn", TX.strip_prompt(F.concat("text", "nxt"), F.col("text")).alias("completion"))


@register("cut_at_newline", sql="SELECT conv_id, turn, split_part(text, chr(10), 1) AS line FROM conversations")
def q_cut_newline(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", TX.cut_at_newline("text").alias("line"))


@register("cut_at_marker", sql="SELECT doc_id, split_part(text, '.', 1) || '.' AS upto FROM documents")
def q_cut_marker(spark, sf):
    return _docs(spark, sf).select("doc_id", TX.cut_at_marker("text", ".").alias("upto"))


@register("approx_tokens", sql="SELECT doc_id, CAST(length(text) // 3 AS BIGINT) AS n_tokens FROM documents")
def q_approx_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", TX.approx_tokens("text").alias("n_tokens"))


@register("joke_topic", sql=f"""SELECT message_id,
  NULLIF(trim(replace(lower(text), '/vitsi', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '') AS topic_local,
  CASE WHEN len(string_split(text, ' ')) > 1 THEN array_to_string(string_split(text, ' ')[2:], ' ') END AS topic_api
FROM ({LIVE_SQL}) WHERE content_type = 'text' AND starts_with(text, '/vitsi')""")
def q_joke_topic(spark, sf):
    lv = live_from_events(spark, sf).where((F.col("content_type") == "text") & F.startswith("text", F.lit(K.CMD_JOKE)))
    return lv.select("message_id", TX.joke_topic_local("text").alias("topic_local"),
                     TX.joke_topic_api("text").alias("topic_api"))
