"""Source, sink and streaming queries.

Inputs in foreign formats (export JSON, history CSV, live event files) are derived
by Spark from the given tables, written below the shared scratch folder
(``spark.checkpoint.dir``) and read back through the real readers, so every query
exercises the reader on data that grows with the tables.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatprep import constants as K
from chatprep.functions.chat import encode_chat_turn
from chatprep.operators import context as C
from chatprep.operators import routing as R
from chatprep.operators import sequences as S
from chatprep.operators import splits as P
from chatprep.plans.live import (LIVE_SQL, LIVE_MSGS_SQL, ROUTE_INPUT_SQL, route_case_sql, chat_turn_sql, bot_rules,
                                 _bot_sql, _ctx_sql, LOCAL_JOKE_SQL, SEED)
from chatprep.plans.registry import register, events_messages_sql, ascii_handle_sql, seeded_md5_sql
from chatprep.plans.training import seq_sql, docs_sql
from chatprep.schema import with_fields
from chatprep.session import scratch_path
from chatprep.sources import export as X
from chatprep.sources import history_csv as H
from chatprep.sources.live import live_source, normalize_live
from chatprep.sources.sinks import jsonl_sink, land_arrivals, parquet_log_sink, read_jsonl, read_log
from chatprep.sources.tables import messages_from_events, live_from_events
from chatprep.streaming import context as SC


def _tag(sf: str) -> str:
    return hashlib.md5(sf.encode()).hexdigest()[:10]


def _run_dir(spark, *parts) -> str:
    return scratch_path(spark, *parts, uuid.uuid4().hex[:12])


# ------------------------------------------------------------------ exports

_FOLDER_PAT = r"folder=([^/]+)/[^/]+$"


def _exports(spark, sf) -> str:
    path = _run_dir(spark, "derived", "exports", _tag(sf))
    return X.write_exports(messages_from_events(spark, sf, 3), path)


def _export_msgs(spark, sf, exclude=None):
    return X.export_scan(spark, _exports(spark, sf), chat_pattern=_FOLDER_PAT, exclude=exclude)


EXPORT_SQL = f"""m AS ({events_messages_sql(3)}),
x AS (SELECT *, 'chat_' || CAST(chat_id AS VARCHAR) || '_' || strftime(sent_at, '%Y%m%d') || '_' || CAST(id // 10000 AS VARCHAR) AS folder FROM m),
e AS (SELECT folder AS chat_id, CAST(row_number() OVER (PARTITION BY folder ORDER BY id) AS BIGINT) AS pos, id, hhmm, sender, text,
             reply_to_message_id FROM x)"""


@register("export_scan", sql=f"""WITH {EXPORT_SQL}
SELECT chat_id, pos, id FROM e UNION ALL SELECT DISTINCT chat_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT) FROM e""")
def q_export_scan(spark, sf):
    m = _export_msgs(spark, sf)
    return m.select("chat_id", "pos", F.try_variant_get("msg", "$.id", "bigint").alias("id"))


@register("export_skip_head", sql=f"WITH {EXPORT_SQL} SELECT chat_id, pos, id FROM e")
def q_export_skip_head(spark, sf):
    m = X.skip_head(_export_msgs(spark, sf))
    return m.select("chat_id", "pos", F.try_variant_get("msg", "$.id", "bigint").alias("id"))


@register("normalize_export", sql=f"WITH {EXPORT_SQL} SELECT chat_id, pos, id, hhmm, sender, text, reply_to_message_id FROM e")
def q_normalize_export(spark, sf):
    m = X.normalize_export(X.skip_head(_export_msgs(spark, sf)))
    return m.select("chat_id", "pos", "id", "hhmm", "sender", "text", "reply_to_message_id")


@register("export_multi_scan", sql=f"WITH {EXPORT_SQL} SELECT id, sender, text FROM e")
def q_export_multi_scan(spark, sf):
    """All chat folders in one glob read: the combined history, no per-folder loop."""
    m = X.normalize_export(X.skip_head(_export_msgs(spark, sf)))
    return m.select("id", "sender", "text")


@register("export_exclude", sql=f"WITH {EXPORT_SQL} SELECT chat_id, pos, id FROM e WHERE NOT regexp_matches(chat_id, '_20240103_')")
def q_export_exclude(spark, sf):
    m = X.skip_head(_export_msgs(spark, sf, exclude="_20240103_"))
    return m.select("chat_id", "pos", F.try_variant_get("msg", "$.id", "bigint").alias("id"))


@register("flatten_rich_text", sql=f"WITH {EXPORT_SQL} SELECT chat_id, id, text FROM e")
def q_flatten_rich(spark, sf):
    """Every exported text, rich-text lists and plain strings alike, flattened."""
    m = X.skip_head(_export_msgs(spark, sf))
    t = F.try_variant_get("msg", "$.text", "variant")
    return m.select("chat_id", F.try_variant_get("msg", "$.id", "bigint").alias("id"),
                    X.flatten_rich_text(t).alias("text"))


@register("first_message_preview", sql=f"""WITH {EXPORT_SQL}
SELECT chat_id, pos, id, sender, text FROM e WHERE pos = 1""")
def q_first_preview(spark, sf):
    return X.first_message_preview(X.normalize_export(X.skip_head(_export_msgs(spark, sf))))


@register("ingest_stats", sql=f"WITH {EXPORT_SQL} SELECT chat_id, CAST(count(*) AS BIGINT) AS n_messages FROM e GROUP BY chat_id")
def q_ingest_stats(spark, sf):
    m = X.normalize_export(X.skip_head(_export_msgs(spark, sf)))
    return X.ingest_stats(m)


@register("union_exports", sql=f"WITH {EXPORT_SQL} SELECT chat_id, id FROM e")
def q_union_exports(spark, sf):
    """Two export sets read separately and appended by name."""
    glob = _exports(spark, sf)
    a = X.export_scan(spark, glob.replace("folder=*", "folder=chat_0_*"), chat_pattern=_FOLDER_PAT)
    b = X.export_scan(spark, glob.replace("folder=*", "folder=chat_[12]_*"), chat_pattern=_FOLDER_PAT)
    u = X.normalize_export(X.skip_head(a)).unionByName(X.normalize_export(X.skip_head(b)))
    return u.select("chat_id", "id")


@register("export_lines_scan", sql=f"""SELECT 'chat_' || CAST(chat_id AS VARCHAR) AS chat_id, id, hhmm, sender, text,
  reply_to_message_id FROM ({events_messages_sql(3)})""")
def q_export_lines_scan(spark, sf):
    """Exports as JSON lines (one message per line, one folder per chat), read back."""
    glob = X.write_export_lines(messages_from_events(spark, sf, 3), _run_dir(spark, "derived", "export_lines", _tag(sf)))
    m = X.normalize_export(X.export_lines_scan(spark, glob, chat_pattern=_FOLDER_PAT))
    return m.select("chat_id", "id", "hhmm", "sender", "text", "reply_to_message_id")


# ------------------------------------------------------------------ history CSV

def _csv(spark, sf, by_chat=False) -> str:
    path = _run_dir(spark, "derived", "history_csv" + ("_by_chat" if by_chat else ""), _tag(sf))
    H.history_csv_sink(messages_from_events(spark, sf, 3), path, by_chat=by_chat)
    return path


_CSV_ROWS = f"""SELECT id, hhmm AS time, sender AS "from", text, reply_to_message_id FROM ({events_messages_sql(3)})"""


@register("history_csv_lines", sql=f"SELECT doc_id AS id, COALESCE(text, '') AS text FROM documents")
def q_history_csv_lines(spark, sf):
    """Whole document texts, line breaks included, through the form of one line per record."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    path = _run_dir(spark, "derived", "history_csv_lines", _tag(sf))
    H.history_csv_sink(d.select(F.col("doc_id").alias("id"), F.lit("00:00").alias("hhmm"), F.col("source").alias("sender"), "text",
                                F.lit(None).cast("bigint").alias("reply_to_message_id")), path, line_safe=True)
    return H.history_csv_scan(spark, path, line_safe=True).select("id", "text")


@register("history_csv_scan", sql=_CSV_ROWS)
def q_csv_scan(spark, sf):
    return H.history_csv_scan(spark, _csv(spark, sf))


@register("history_csv_raw_scan", sql=f"""SELECT id, hhmm AS time, sender AS "from", text,
  CAST(reply_to_message_id AS VARCHAR) AS reply_to_message_id FROM ({events_messages_sql(3)})""")
def q_csv_raw(spark, sf):
    return H.history_csv_raw_scan(spark, _csv(spark, sf))


@register("history_csv_sink", sql=f"""SELECT chat_id, id, hhmm AS time, sender AS "from", text, reply_to_message_id
FROM ({events_messages_sql(3)})""")
def q_csv_sink(spark, sf):
    """One folder per chat (``chat_id=<id>``); read back with partition discovery."""
    path = _csv(spark, sf, by_chat=True)
    from chatprep.schema import HISTORY_CSV
    df = spark.read.schema(with_fields(HISTORY_CSV, chat_id=T.LongType())).options(**H.CSV_OPTIONS).csv(path)
    return df.select("chat_id", "id", "time", "from", "text",
                     F.col("reply_to_message_id").cast("bigint").alias("reply_to_message_id"))


# ------------------------------------------------------------------ JSONL

@register("jsonl_sink", sql=f"""WITH {seq_sql(15, None)}, d AS ({docs_sql(K.SYSTEM_TEXT_V2)}),
rk AS (SELECT *, row_number() OVER (ORDER BY {seeded_md5_sql(SEED, 'chat_id', 'seq_id')}) AS rk, count(*) OVER () AS n FROM d)
SELECT CASE WHEN rk <= CAST(floor(n * 0.2) AS BIGINT) THEN 'validation' ELSE 'train' END AS split, doc FROM rk""")
def q_jsonl_sink(spark, sf):
    ex = S.training_examples(messages_from_events(spark, sf, None), length=15, system_text=K.SYSTEM_TEXT_V2)
    ex = P.split_random(ex, ["chat_id", "seq_id"], 0.2, SEED)
    path = _run_dir(spark, "derived", "jsonl", _tag(sf))
    jsonl_sink(ex, path)
    return read_jsonl(spark, path).select("split", "doc")


# ------------------------------------------------------------------ logs

_START = 1704067200 + 5 * 86400


@register("chat_log_append", sql=f"SELECT chat_id, id, sender, text FROM ({LIVE_MSGS_SQL})")
def q_chat_log_append(spark, sf):
    """Per-chat log written in two appends (before and after process start)."""
    path = _run_dir(spark, "derived", "chat_log")
    m = normalize_live(live_from_events(spark, sf, 3)).select("chat_id", "id", "sender", "text", "date")
    parquet_log_sink(m.where(F.col("date") < _START).drop("date"), path)
    parquet_log_sink(m.where(F.col("date") >= _START).drop("date"), path)
    return read_log(spark, path).select("chat_id", "id", "sender", "text")


# ------------------------------------------------------------------ streams

def _live(spark, sf):
    """Live events with the author of the replied-to message attached (the service sends it with
    the reply)."""
    lv = live_from_events(spark, sf, 3)
    tgt = lv.groupBy("chat_id", F.col("message_id").alias("_target_id")) \
        .agg(F.max("sender_id").alias("reply_to_sender_id"))
    return R.join_reply_target(lv, tgt, id_col="message_id")


def _live_schema(**more):
    from chatprep.schema import LIVE
    return with_fields(LIVE, reply_to_sender_id=T.LongType(), **more)


def _live_stream(spark, sf):
    """All live events as one micro-batch, for streams without state."""
    path = _run_dir(spark, "derived", "live", _tag(sf))
    _live(spark, sf).write.mode("overwrite").parquet(path)
    return live_source(spark, path, schema=_live_schema())


def _arrivals(spark, sf):
    """Live events landed file after file in the order of their ids, a file for each micro-batch:
    what the state of a chat reads at once stays bounded, however long the log."""
    path = _run_dir(spark, "derived", "arrivals", _tag(sf))
    land_arrivals(_live(spark, sf), path, _run_dir(spark, "derived", "slices"), live_from_events(spark, sf, 3))
    return live_source(spark, path, max_files_per_trigger=1, schema=_live_schema())


@register("live_source", sql=f"SELECT message_id, chat_id, content_type FROM ({LIVE_SQL})")
def q_live_source(spark, sf):
    out = SC.run_available_now(_live_stream(spark, sf).select("message_id", "chat_id", "content_type"), "live_source")
    return spark.read.parquet(out)


@register("stream_append", sql=f"SELECT chat_id, id, sender, text FROM ({LIVE_MSGS_SQL})")
def q_stream_append(spark, sf):
    s = normalize_live(_live_stream(spark, sf)).select("chat_id", "id", "sender", "text")
    path = _run_dir(spark, "streams", "stream_append")
    SC.finish(SC.stream_append(s, f"{path}/out", f"{path}/checkpoint").trigger(availableNow=True).start())
    return read_log(spark, f"{path}/out").select("chat_id", "id", "sender", "text")


_B = 400


@register("stream_context", sql=_ctx_sql(LIVE_MSGS_SQL, "length(text) + 2", _B))
def q_stream_context(spark, sf):
    s = normalize_live(_arrivals(spark, sf))
    ctx = SC.stream_context(s, _B, F.length("text") + 2)
    out = SC.run_available_now(ctx.drop("context", "tag", "is_first"), "stream_context")
    return spark.read.parquet(out).select("chat_id", "id", "n_context", "context_chars", "context_start_id")


@register("stream_context_init", sql=f"""WITH lm AS ({LIVE_MSGS_SQL}),
seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY id DESC) AS rn FROM lm WHERE date < {_START}) WHERE rn <= 20),
u AS (SELECT chat_id, id, text, false AS live FROM seeds UNION ALL SELECT chat_id, id, text, true FROM lm WHERE date >= {_START}),
p AS (SELECT *, sum(length(text) + 2) OVER (PARTITION BY chat_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS P FROM u),
q AS (SELECT *, P - (length(text) + 2) AS Q FROM p)
SELECT a.chat_id, a.id, CAST(count(e.id) AS BIGINT) AS n_context, CAST(COALESCE(a.P - min(e.Q), 0) AS BIGINT) AS context_chars,
       min(e.id) AS context_start_id
FROM q a LEFT JOIN q e ON e.chat_id = a.chat_id AND e.id <= a.id AND e.Q >= a.P - {_B}
WHERE a.live GROUP BY a.chat_id, a.id, a.P""")
def q_stream_context_init(spark, sf):
    """State seeded with the newest 20 stored messages of each chat (stored = before
    process start): a first run over the seeds alone fills the state, and the run over the live
    rows goes on from its checkpoint. Seeds are not emitted."""
    hist = normalize_live(live_from_events(spark, sf, 3)).where(F.col("date") < _START)
    seeds = C.last_n_per_chat(hist, 20).select(
        F.col("id").alias("message_id"), "chat_id", "date", "sender_id", F.col("sender").alias("username"),
        "content_type", "text", F.lit(None).cast("string").alias("sticker_emoji"), "reply_to_message_id",
        F.lit(None).cast("bigint").alias("reply_to_sender_id"), F.lit(True).alias("is_seed"))
    live = _live(spark, sf).where(F.col("date") >= _START).withColumn("is_seed", F.lit(False))
    path, run = _run_dir(spark, "derived", "live_seeded"), uuid.uuid4().hex[:12]
    schema = _live_schema(is_seed=T.BooleanType())

    def arrivals(files=None):
        s = normalize_live(live_source(spark, path, max_files_per_trigger=files, schema=schema), keep=("is_seed",))
        ctx = SC.stream_context(s, _B, F.length("text") + 2, seed=F.col("is_seed"))
        return SC.run_available_now(ctx.drop("context", "tag", "is_first"), "stream_context_init", run)

    seeds.write.parquet(path)
    arrivals()
    land_arrivals(live, path, _run_dir(spark, "derived", "slices"), live_from_events(spark, sf, 3).where(F.col("date") >= _START))
    return spark.read.parquet(arrivals(1)).select("chat_id", "id", "n_context", "context_chars", "context_start_id")


def _rules_after_intro():
    return [r for r in bot_rules("api") if r.name != "intro"]


@register("stream_route", sql=f"WITH {ROUTE_INPUT_SQL} SELECT chat_id, id, {route_case_sql()} AS action FROM ri")
def q_stream_route(spark, sf):
    s = normalize_live(_arrivals(spark, sf))
    routed = SC.stream_route(s, _B, F.length("text") + 2, _rules_after_intro())
    out = SC.run_available_now(routed.select("chat_id", "id", "action"), "stream_route")
    return spark.read.parquet(out)


_MAX_TOK = 400
_PB = C.chat_budget_chars(_MAX_TOK)
_SYS = json.dumps({"role": "system", "content": K.CHAT_PRE_PROMPT}, ensure_ascii=False, separators=(",", ":"))


def _sq(s: str) -> str:
    return s.replace("'", "''")


@register("stream_prompts", sql=f"""WITH {ROUTE_INPUT_SQL}, rt AS (SELECT *, {route_case_sql()} AS action FROM ri),
t AS (SELECT *, {chat_turn_sql()} AS tj FROM rt),
l AS (SELECT *, length(tj) + CASE WHEN {_bot_sql(ascii_handle_sql('sender'))} THEN 3 ELSE 5 END + 2 AS len FROM t),
p AS (SELECT *, sum(len) OVER (PARTITION BY chat_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS P FROM l),
q AS (SELECT *, P - len AS Q FROM p)
SELECT a.chat_id, a.id, a.action,
       '{{"messages":[{_sq(_SYS)}' || COALESCE(',' || string_agg(e.tj, ',' ORDER BY e.id), '') || ']}}' AS prompt
FROM q a LEFT JOIN q e ON e.chat_id = a.chat_id AND e.id <= a.id AND e.Q >= a.P - {_PB}
WHERE a.action IN ('random', 'trigger', 'reply_to_bot') GROUP BY a.chat_id, a.id, a.action""")
def q_stream_prompts(spark, sf):
    """Chat prompt (API head, 400-token budget) for each arrival routed to the model."""
    s = normalize_live(_arrivals(spark, sf))
    turn = encode_chat_turn("id", "hhmm", "sender", "text", "reply_to_message_id", K.BOT_NAME_API)
    routed = SC.stream_route(s, _PB, C.chat_turn_length(), _rules_after_intro(), payload=F.to_json(turn))
    out = SC.run_available_now(SC.stream_prompts(routed, _SYS), "stream_prompts")
    return spark.read.parquet(out)


_API_JOKE = f"""CASE WHEN len(string_split(a.text, ' ')) > 1 THEN '{_sq(K.JOKE_TOPIC_PROMPT)}' || array_to_string(string_split(a.text, ' ')[2:], ' ')
     ELSE '{_sq(K.JOKE_RANDOM_PROMPT)}' END"""


@register("stream_prompts_joke", sql=f"""WITH {ROUTE_INPUT_SQL}, rt AS (SELECT *, {route_case_sql()} AS action FROM ri),
t AS (SELECT *, {chat_turn_sql()} AS tj FROM rt),
l AS (SELECT *, length(tj) + CASE WHEN {_bot_sql(ascii_handle_sql('sender'))} THEN 3 ELSE 5 END + 2 AS len FROM t),
p AS (SELECT *, sum(len) OVER (PARTITION BY chat_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS P FROM l),
q AS (SELECT *, P - len AS Q FROM p)
SELECT a.chat_id, a.id, a.action,
       '{{"messages":[{_sq(_SYS)}' || COALESCE(',' || string_agg(e.tj, ',' ORDER BY e.id), '')
       || ',{{"role":"system","content":' || CAST(to_json({_API_JOKE}) AS VARCHAR) || '}}]}}' AS prompt
FROM q a LEFT JOIN q e ON e.chat_id = a.chat_id AND e.id <= a.id AND e.Q >= a.P - {_PB}
WHERE a.action = 'joke' GROUP BY a.chat_id, a.id, a.action, a.text""")
def q_stream_prompts_joke(spark, sf):
    """Chat prompt of each joke command in the stream: its context, then the joke's instruction."""
    s = normalize_live(_arrivals(spark, sf))
    turn = encode_chat_turn("id", "hhmm", "sender", "text", "reply_to_message_id", K.BOT_NAME_API)
    routed = SC.stream_route(s, _PB, C.chat_turn_length(), _rules_after_intro(), payload=F.to_json(turn),
                             instruction=R.command_prompt("api"))
    out = SC.run_available_now(SC.stream_prompts(routed, _SYS), "stream_prompts_joke")
    return spark.read.parquet(out).where(F.col("action") == "joke")


_LOCAL_PRE = K.local_pre_prompt(K.BOT_NAME_LOCAL)
_LOCAL_CHARS = 900
_LOCAL_FIXED = len(_LOCAL_PRE) + len(f"[MSG][FS][FS]{K.BOT_NAME_LOCAL}[FS]") + 5


@register("stream_prompts_delimited", sql=f"""WITH {ROUTE_INPUT_SQL}, rt AS (SELECT *, {route_case_sql()} AS action FROM ri),
r AS (SELECT *, '[MSG]' || CAST(id AS VARCHAR) || '[FS]' || hhmm || '[FS]' || sender || '[FS]' || COALESCE(text, '') || '[FS]'
      || COALESCE(CAST(reply_to_message_id AS VARCHAR), '') || '[MEG]' || chr(10) AS rec, {LOCAL_JOKE_SQL} AS joke FROM rt),
p AS (SELECT *, sum(length(rec)) OVER (PARTITION BY chat_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS P FROM r),
q AS (SELECT *, P - length(rec) AS Q FROM p)
SELECT a.chat_id, a.id, a.action, CASE WHEN a.action = 'joke' THEN a.joke ELSE '{_sq(_LOCAL_PRE)}'
       || COALESCE(string_agg(e.rec, '' ORDER BY e.id), '') || '[MSG]' || CAST(a.id + 1 AS VARCHAR) || '[FS]12:00[FS]{K.BOT_NAME_LOCAL}[FS]' END AS prompt
FROM q a LEFT JOIN q e ON e.chat_id = a.chat_id AND e.id <= a.id
     AND e.Q >= a.P - ({_LOCAL_CHARS - _LOCAL_FIXED} - length(CAST(a.id + 1 AS VARCHAR)))
WHERE a.action IN ('joke', 'random', 'trigger', 'reply_to_bot') GROUP BY a.chat_id, a.id, a.action, a.joke""")
def q_stream_prompts_delimited(spark, sf):
    """Delimited prompt (records, 900 characters with preamble and open record) for each arrival routed
    to the model by the API head's rules; jokes ask with the local head's opener. A fixed clock."""
    s = normalize_live(_arrivals(spark, sf))
    routed = SC.stream_route(s, SC.record_budget(_LOCAL_CHARS, _LOCAL_PRE), F.length(SC.record_payload()), _rules_after_intro(),
                             payload=SC.record_payload(), instruction=R.command_prompt("local", SEED, clock=F.col("hhmm")))
    prompts = SC.stream_delimited_prompts(routed, _LOCAL_PRE, clock=F.lit("12:00"))
    return spark.read.parquet(SC.run_available_now(prompts, "stream_prompts_delimited"))
