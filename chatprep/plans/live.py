"""Live-path queries in batch: context, prompts, routing, responses."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from chatprep import constants as K
from chatprep.functions.chat import encode_chat_turn
from chatprep.functions.records import encode_record, encode_record_prefix
from chatprep.operators import context as C
from chatprep.operators import routing as R
from chatprep.operators import responses as RS
from chatprep.operators.segments import build_segments
from chatprep.plans.registry import (register, ORACLE_SQL, bot_handles_sql, CONV_MESSAGES_SQL, events_messages_sql, ascii_handle_sql, chat_name_sql,
                                     content_json_sql, seeded_u32_sql, pmod_sql)
from chatprep.sources.live import normalize_live
from chatprep.sources.tables import messages_from_conversations, messages_from_events, live_from_events

SEED = 42
BOT = K.BOT_NAME_API


def _sq(s: str) -> str:
    return s.replace("'", "''")


def _conv(spark, sf):
    return messages_from_conversations(spark, sf)


# ------------------------------------------------------------------ context

@register("last_n_per_chat", sql=f"""WITH m AS ({CONV_MESSAGES_SQL})
SELECT chat_id, id, rn FROM (SELECT chat_id, id, CAST(row_number() OVER (PARTITION BY chat_id ORDER BY id DESC) AS BIGINT) AS rn FROM m)
WHERE rn <= 3""")
def q_last_n(spark, sf):
    return C.last_n_per_chat(_conv(spark, sf), 3).select("chat_id", "id", F.col("rn").cast("bigint").alias("rn"))


@register("context_budget", sql=f"""WITH m AS ({CONV_MESSAGES_SQL}),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY id DESC) AS rn FROM m) WHERE rn <= 20),
s AS (SELECT chat_id, id, CAST(sum(length(text) + 2) OVER (PARTITION BY chat_id ORDER BY id DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS suffix_chars FROM l)
SELECT chat_id, id, suffix_chars FROM s WHERE suffix_chars <= {3 * 400 + 2 - 300}""")
def q_context_budget(spark, sf):
    r = C.context_budget(_conv(spark, sf), F.length("text") + 2, 3 * 400 + 2 - 300, last_n=20)
    return r.select("chat_id", "id", "suffix_chars")


def _ctx_sql(src: str, length: str, B: int) -> str:
    return f"""WITH m AS ({src}), l AS (SELECT *, {length} AS len FROM m),
p AS (SELECT *, sum(len) OVER (PARTITION BY chat_id ORDER BY id, sent_at ROWS UNBOUNDED PRECEDING) AS P,
             row_number() OVER (PARTITION BY chat_id ORDER BY id, sent_at) AS pos FROM l),
q AS (SELECT *, P - len AS Q FROM p)
SELECT a.chat_id, a.id, CAST(count(e.id) AS BIGINT) AS n_context,
       CAST(COALESCE(a.P - min(e.Q), 0) AS BIGINT) AS context_chars, arg_min(e.id, e.pos) AS context_start_id
FROM q a LEFT JOIN q e ON e.chat_id = a.chat_id AND e.pos <= a.pos AND e.Q >= a.P - {B}
GROUP BY a.chat_id, a.id, a.P"""


@register("context_at_each_message", sql=_ctx_sql(CONV_MESSAGES_SQL, "length(text) + 2", 1000))
def q_context_each(spark, sf):
    c = C.context_at_each_message(_conv(spark, sf), F.length("text") + 2, 1000)
    return c.select("chat_id", "id", "n_context", "context_chars", "context_start_id")


@register("context_at_each_message_events", sql=_ctx_sql(events_messages_sql(None), "length(text) + 2", 400))
def q_context_each_events(spark, sf):
    c = C.context_at_each_message(messages_from_events(spark, sf, None), F.length("text") + 2, 400)
    return c.select("chat_id", "id", "n_context", "context_chars", "context_start_id")


# ------------------------------------------------------------------ prompts

def _bot_sql(handle: str) -> str:
    return f"({handle} IN ({bot_handles_sql()}))"


def chat_turn_sql() -> str:
    h = ascii_handle_sql("sender")
    return f"""CASE WHEN {_bot_sql(h)} THEN '{{"role":"assistant","content":' || CAST(to_json(text) AS VARCHAR) || '}}'
        ELSE '{{"role":"user","name":' || CAST(to_json({chat_name_sql('sender')}) AS VARCHAR) || ',"content":'
             || CAST(to_json({content_json_sql()}) AS VARCHAR) || '}}' END"""


_SYS_JSON = json.dumps({"role": "system", "content": K.CHAT_PRE_PROMPT}, ensure_ascii=False, separators=(",", ":"))
_MAX_TOK = 400
_BUDGET = C.chat_budget_chars(_MAX_TOK)


@register("chat_prompt", sql=f"""WITH m AS ({CONV_MESSAGES_SQL}),
t AS (SELECT *, {chat_turn_sql()} AS tj FROM m),
l AS (SELECT *, length(tj) + CASE WHEN {_bot_sql(ascii_handle_sql('sender'))} THEN 3 ELSE 5 END + 2 AS len FROM t),
s AS (SELECT *, sum(len) OVER (PARTITION BY chat_id ORDER BY id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS suf FROM l)
SELECT chat_id, CAST(count(*) AS BIGINT) AS n_turns,
       '{{"messages":[' || '{_sq(_SYS_JSON)}' || ',' || string_agg(tj, ',' ORDER BY id) || ']}}' AS prompt
FROM s WHERE suf <= {_BUDGET} GROUP BY chat_id""")
def q_chat_prompt(spark, sf):
    return C.current_chat_prompts(_conv(spark, sf), _MAX_TOK).select("chat_id", "n_turns", "prompt")


@register("prompt_size", sql=f"""WITH m AS ({CONV_MESSAGES_SQL}),
t AS (SELECT *, {chat_turn_sql()} AS tj FROM m),
l AS (SELECT *, length(tj) + CASE WHEN {_bot_sql(ascii_handle_sql('sender'))} THEN 3 ELSE 5 END + 2 AS len FROM t),
s AS (SELECT *, sum(len) OVER (PARTITION BY chat_id ORDER BY id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS suf FROM l)
SELECT chat_id, CAST(({16 + len(json.dumps({"role": "system", "content": K.CHAT_PRE_PROMPT}, ensure_ascii=False))} + sum(len)) // 3 AS BIGINT) AS n_tokens
FROM s WHERE suf <= {_BUDGET} GROUP BY chat_id""")
def q_prompt_size(spark, sf):
    """Prompt size in tokens (characters div 3) as the budget measures it."""
    return C.current_chat_prompts(_conv(spark, sf), _MAX_TOK).select("chat_id", "n_tokens")


_LOCAL_PRE = K.local_pre_prompt(K.BOT_NAME_LOCAL)


@register("context_prompt", sql=f"""WITH m AS ({CONV_MESSAGES_SQL}),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY id DESC) AS rn FROM m) WHERE rn <= 20)
SELECT chat_id, '{_sq(_LOCAL_PRE)}' || string_agg('[MSG]' || CAST(id AS VARCHAR) || '[FS]' || hhmm || '[FS]' || sender || '[FS]'
       || text || '[FS]' || COALESCE(CAST(reply_to_message_id AS VARCHAR), '') || '[MEG]' || chr(10), '' ORDER BY id)
       || '[MSG]' || CAST(max(id) + 1 AS VARCHAR) || '[FS]12:00[FS]{K.BOT_NAME_LOCAL}[FS]' AS prompt
FROM l GROUP BY chat_id""")
def q_context_prompt(spark, sf):
    """Delimited prompt of the newest 20 messages: preamble, records, open record
    for the bot (last id + 1, a fixed clock here for reproducibility)."""
    return C.context_prompts(_conv(spark, sf), _LOCAL_PRE, clock=F.lit("12:00"), last_n=20)


_PROMPT_CHARS = 900
_OPEN = len(f"[MSG][FS][FS]{K.BOT_NAME_LOCAL}[FS]") + 5 + 19


@register("context_prompt_budget", sql=f"""WITH m AS ({CONV_MESSAGES_SQL}),
r AS (SELECT *, '[MSG]' || CAST(id AS VARCHAR) || '[FS]' || hhmm || '[FS]' || sender || '[FS]' || text || '[FS]'
  || COALESCE(CAST(reply_to_message_id AS VARCHAR), '') || '[MEG]' || chr(10) AS rec FROM m),
s AS (SELECT *, sum(length(rec)) OVER (PARTITION BY chat_id ORDER BY id DESC ROWS UNBOUNDED PRECEDING) AS suf FROM r),
b AS (SELECT chat_id, string_agg(rec, '' ORDER BY id) AS body FROM s WHERE suf <= {_PROMPT_CHARS - len(_LOCAL_PRE) - _OPEN} GROUP BY chat_id)
SELECT chat_id, '{_sq(_LOCAL_PRE)}' || COALESCE(body, '') || '[MSG]' || CAST(max(id) + 1 AS VARCHAR)
  || '[FS]12:00[FS]{K.BOT_NAME_LOCAL}[FS]' AS prompt
FROM m LEFT JOIN b USING (chat_id) GROUP BY chat_id, body""")
def q_context_prompt_budget(spark, sf):
    """The delimited prompt trimmed to a budget of characters, as the local head does."""
    return C.context_prompts(_conv(spark, sf), _LOCAL_PRE, clock=F.lit("12:00"), budget_chars=_PROMPT_CHARS)


@register("next_message_id", sql=f"""SELECT chat_id, max_by(id, id) + 1 AS next_id FROM ({events_messages_sql(3)}) GROUP BY chat_id""")
def q_next_id(spark, sf):
    return C.next_message_id(messages_from_events(spark, sf, 3))


# ------------------------------------------------------------------ live adapter + routing

LIVE_SQL = f"""SELECT event_id AS message_id, CAST(user_id % 3 AS BIGINT) AS chat_id,
  date_diff('second', TIMESTAMP '1970-01-01 00:00:00', ts) AS date, user_id % 6 AS sender_id,
  CASE WHEN user_id % 6 = 0 THEN '{BOT}' WHEN user_id % 6 = 5 THEN '' ELSE 'user_' || CAST(user_id % 6 AS VARCHAR) END AS username,
  ct AS content_type,
  CASE WHEN ct = 'text' THEN (CASE WHEN event_id % 50 = 7 THEN '/gpt-help ' WHEN event_id % 40 = 3 THEN '/vitsi ' || event_type
       ELSE event_type || ' ' || props END) END AS text,
  CASE WHEN ct = 'sticker' THEN '😀' END AS sticker_emoji,
  CASE WHEN event_id % 5 = 0 AND event_id >= 12 THEN event_id - 1 - (user_id % 12) END AS reply_to_message_id
FROM (SELECT *, CASE event_type WHEN 'click' THEN 'text' WHEN 'view' THEN 'text' WHEN 'signup' THEN 'sticker'
                 WHEN 'purchase' THEN 'photo' WHEN 'error' THEN 'text' ELSE 'document' END AS ct FROM events)"""

LIVE_MSGS_SQL = f"""SELECT chat_id, message_id AS id, TIMESTAMP '1970-01-01 00:00:00' + date * INTERVAL 1 SECOND AS sent_at,
  strftime(TIMESTAMP '1970-01-01 00:00:00' + date * INTERVAL 1 SECOND, '%H:%M') AS hhmm,
  COALESCE(NULLIF(username, ''), 'Anonym') AS sender,
  COALESCE(NULLIF(text, ''), NULLIF(sticker_emoji, ''), '(image or file)') AS text,
  reply_to_message_id, content_type, sender_id, date
FROM ({LIVE_SQL})"""

ROUTE_INPUT_SQL = f"""lm AS ({LIVE_MSGS_SQL}),
fm AS (SELECT chat_id, min(id) AS fid FROM lm GROUP BY chat_id),
ta AS (SELECT chat_id, id AS tid, max_by(sender_id, sent_at) AS reply_author FROM lm GROUP BY chat_id, id),
ri AS (SELECT lm.*, (fm.fid IS NOT NULL) AS is_first, ta.reply_author FROM lm
       LEFT JOIN fm ON fm.chat_id = lm.chat_id AND fm.fid = lm.id
       LEFT JOIN ta ON ta.chat_id = lm.chat_id AND ta.tid = lm.reply_to_message_id)"""


def fits_sql() -> str:
    """The message alone fits the app's prompt budget (its context is not empty)."""
    bot = _bot_sql(ascii_handle_sql("sender"))
    return (f"(length({chat_turn_sql()}) + CASE WHEN {bot} THEN 3 ELSE 5 END + 2 "
            f"<= {C.chat_budget_chars(K.TOKEN_BUDGET_APP)})")


def bot_rules(variant: str = "api", **kw):
    """Default rules; the random reply requires a non-empty context under the app budget."""
    return R.default_rules(variant, bot_id=0, seed=SEED, context_nonempty=C.fits_budget(K.TOKEN_BUDGET_APP), **kw)


def route_case_sql(p: float = K.PROB_API, phrases=K.TRIGGERS_API) -> str:
    trig = " OR ".join(f"contains(lower(text), '{_sq(x)}')" for x in phrases)
    frac = f"({seeded_u32_sql(SEED, 'chat_id', 'id')} / 4294967296.0)"
    return f"""CASE WHEN is_first THEN 'intro'
     WHEN content_type = 'text' AND starts_with(text, '/gpt-help') THEN 'help'
     WHEN content_type = 'text' AND starts_with(text, '/vitsi') THEN 'joke'
     WHEN {frac} < {p} AND {fits_sql()} THEN 'random'
     WHEN content_type = 'text' AND ({trig}) THEN 'trigger'
     WHEN content_type = 'text' AND reply_to_message_id IS NOT NULL AND reply_author = 0 THEN 'reply_to_bot'
     ELSE 'none' END"""


def routing_input(spark, sf):
    m = normalize_live(live_from_events(spark, sf, 3))
    return R.with_reply_author(R.with_first_flag(m))


@register("route_messages", sql=f"WITH {ROUTE_INPUT_SQL} SELECT chat_id, id, {route_case_sql()} AS action FROM ri")
def q_route(spark, sf):
    return R.route_messages(routing_input(spark, sf), bot_rules("api")) \
        .select("chat_id", "id", "action")


@register("route_counts", sql=f"""WITH {ROUTE_INPUT_SQL}
SELECT action, CAST(count(*) AS BIGINT) AS n FROM (SELECT {route_case_sql(K.PROB_LOCAL, K.TRIGGERS_LOCAL)} AS action FROM ri) GROUP BY action""")
def q_route_counts(spark, sf):
    rules = bot_rules("local")
    return R.route_counts(R.route_messages(routing_input(spark, sf), rules))


@register("custom_rule", sql=f"""WITH m AS ({CONV_MESSAGES_SQL}),
f AS (SELECT *, id = min(id) OVER (PARTITION BY chat_id) AS is_first FROM m)
SELECT action, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN is_first THEN 'intro' WHEN contains(lower(text), 'bot') THEN 'trigger' ELSE 'none' END AS action FROM f)
GROUP BY action""")
def q_custom_rule(spark, sf):
    """User rules as plain Columns: first message -> intro; 'bot' anywhere -> trigger."""
    m = R.with_first_flag(_conv(spark, sf))
    rules = [R.Rule("intro", F.col("is_first")), R.Rule("trigger", F.contains(F.lower("text"), F.lit("bot")))]
    return R.route_counts(R.route_messages(m, rules))


@register("custom_params", sql=f"""WITH {ROUTE_INPUT_SQL}
SELECT chat_id, id, {route_case_sql(0.3, ('k": 1', 'error'))} AS action FROM ri""")
def q_custom_params(spark, sf):
    """Bot-level overrides: trigger phrases and reply probability."""
    rules = bot_rules("api", trigger_phrases=('k": 1', "error"), probability=0.3)
    return R.route_messages(routing_input(spark, sf), rules).select("chat_id", "id", "action")


@register("match_first_message", sql=f"WITH {ROUTE_INPUT_SQL} SELECT chat_id, id FROM ri WHERE is_first")
def q_first(spark, sf):
    return routing_input(spark, sf).where("is_first").select("chat_id", "id")


@register("reply_author", sql=f"""WITH {ROUTE_INPUT_SQL}
SELECT chat_id, id, reply_to_message_id, reply_author FROM ri WHERE reply_to_message_id IS NOT NULL""")
def q_reply_author(spark, sf):
    return routing_input(spark, sf).where(F.col("reply_to_message_id").isNotNull()) \
        .select("chat_id", "id", "reply_to_message_id", "reply_author")


@register("match_reply_to_bot", sql=f"""WITH {ROUTE_INPUT_SQL}
SELECT chat_id, id FROM ri WHERE content_type = 'text' AND reply_to_message_id IS NOT NULL AND reply_author = 0""")
def q_reply_to_bot(spark, sf):
    return routing_input(spark, sf).where(R.match_reply_to_bot(0)).select("chat_id", "id")


@register("match_random", sql=f"""WITH lm AS ({LIVE_MSGS_SQL})
SELECT chat_id, id FROM lm WHERE ({seeded_u32_sql(SEED, 'chat_id', 'id')} / 4294967296.0) < {K.PROB_LOCAL}""")
def q_random(spark, sf):
    m = normalize_live(live_from_events(spark, sf, 3))
    return m.where(R.match_random(K.PROB_LOCAL, SEED)).select("chat_id", "id")


@register("match_trigger_phrases", sql=f"""WITH lm AS ({LIVE_MSGS_SQL})
SELECT chat_id, id FROM lm WHERE content_type = 'text' AND ({" OR ".join(f"contains(lower(text), '{_sq(x)}')" for x in K.TRIGGERS_LOCAL)})""")
def q_trigger(spark, sf):
    m = normalize_live(live_from_events(spark, sf, 3))
    return m.where(R.match_trigger_phrases(K.TRIGGERS_LOCAL)).select("chat_id", "id")


@register("match_command", sql=f"""WITH lm AS ({LIVE_MSGS_SQL})
SELECT chat_id, id, CASE WHEN starts_with(text, '/gpt-help') THEN 'help' ELSE 'joke' END AS command FROM lm
WHERE content_type = 'text' AND (starts_with(text, '/gpt-help') OR starts_with(text, '/vitsi'))""")
def q_command(spark, sf):
    m = normalize_live(live_from_events(spark, sf, 3))
    m = m.where(R.match_command(K.CMD_HELP) | R.match_command(K.CMD_JOKE))
    return m.select("chat_id", "id", F.when(R.match_command(K.CMD_HELP), "help").otherwise("joke").alias("command"))


@register("filter_text_type", sql=f"WITH lm AS ({LIVE_MSGS_SQL}) SELECT chat_id, id FROM lm WHERE content_type = 'text'")
def q_text_type(spark, sf):
    return normalize_live(live_from_events(spark, sf, 3)).where(R.is_text()).select("chat_id", "id")


@register("filter_allowed_chats", sql=f"WITH lm AS ({LIVE_MSGS_SQL}) SELECT chat_id, id FROM lm WHERE chat_id IN (0, 2)")
def q_allowed(spark, sf):
    return normalize_live(live_from_events(spark, sf, 3)).where(R.default_gate(allowed_chats=[0, 2])) \
        .select("chat_id", "id")


@register("allow_list_semi", sql=f"""WITH lm AS ({LIVE_MSGS_SQL}), al AS (SELECT * FROM (VALUES (0), (2)) t(chat_id))
SELECT chat_id, id FROM lm SEMI JOIN al USING (chat_id)""")
def q_allow_semi(spark, sf):
    """Allow-list as a table."""
    allow = spark.createDataFrame([(0,), (2,)], "chat_id bigint")
    m = normalize_live(live_from_events(spark, sf, 3))
    return R.allow_list_semi(m, allow).select("chat_id", "id")


_START = 1704067200 + 5 * 86400  # process start: midnight of 2024-01-06 UTC


@register("filter_stale", sql=f"WITH lm AS ({LIVE_MSGS_SQL}) SELECT chat_id, id FROM lm WHERE date >= {_START}")
def q_stale(spark, sf):
    return normalize_live(live_from_events(spark, sf, 3)).where(R.default_gate(start_unix=_START)) \
        .select("chat_id", "id")


@register("route_gated", sql=f"""WITH {ROUTE_INPUT_SQL}
SELECT chat_id, id, CASE WHEN chat_id IN (0, 2) AND date >= {_START} THEN {route_case_sql()} ELSE 'none' END AS action FROM ri""")
def q_route_gated(spark, sf):
    """Allow-list and staleness gate routing only; every message still enters the context."""
    gate = R.default_gate(allowed_chats=[0, 2], start_unix=_START)
    return R.route_messages(routing_input(spark, sf), bot_rules("api"), gate) \
        .select("chat_id", "id", "action")


@register("response_plan", sql=f"""WITH {ROUTE_INPUT_SQL}, rt AS (SELECT *, {route_case_sql()} AS action FROM ri)
SELECT chat_id, id, action,
  CASE WHEN action IN ('intro', 'help') THEN 'fixed' WHEN action = 'joke' THEN 'joke_prompt' ELSE 'context_prompt' END AS kind,
  CASE WHEN action = 'intro' THEN '{_sq(K.INTRO_TEXT)}' WHEN action = 'help' THEN '{_sq(K.HELP_TEXT_API)}' END AS fixed_text,
  CASE WHEN action = 'joke' THEN (CASE WHEN len(string_split(text, ' ')) > 1
        THEN '{_sq(K.JOKE_TOPIC_PROMPT)}' || array_to_string(string_split(text, ' ')[2:], ' ') ELSE '{_sq(K.JOKE_RANDOM_PROMPT)}' END) END AS instruction,
  CASE WHEN action IN ('help', 'joke') THEN id END AS reply_to_message_id
FROM rt WHERE action <> 'none'""")
def q_response_plan(spark, sf):
    routed = R.route_messages(routing_input(spark, sf), bot_rules("api"))
    return R.response_plan(routed, "api")


LOCAL_JOKE_SQL = f"""'[MSG]' || CAST(id AS VARCHAR) || '[FS]' || hhmm || '[FS]{K.BOT_NAME_LOCAL}[FS]' ||
  ['{"', '".join(_sq(o) for o in K.JOKE_OPENERS)}'][1 + {pmod_sql(seeded_u32_sql(SEED, 'chat_id', 'id', "'o'"), len(K.JOKE_OPENERS))}]
  || CASE WHEN NULLIF(trim(replace(lower(text), '/vitsi', ''), ' ' || chr(9) || chr(10) || chr(13)), '') IS NOT NULL
          THEN ' aiheesta ''' || trim(replace(lower(text), '/vitsi', ''), ' ' || chr(9) || chr(10) || chr(13)) || '''' ELSE '' END
  || ': ' || ['{"', '".join(_sq(b) for b in K.JOKE_BEGINS)}'][1 + {pmod_sql(seeded_u32_sql(SEED, 'chat_id', 'id', "'b'"), len(K.JOKE_BEGINS))}]""".replace("\"', '\"", "', '")


@register("command_prompt", sql=f"""WITH lm AS ({LIVE_MSGS_SQL})
SELECT chat_id, id, {LOCAL_JOKE_SQL} AS prompt
FROM lm WHERE content_type = 'text' AND starts_with(text, '/vitsi')""")
def q_command_prompt(spark, sf):
    """Local head's joke prompt: seeded opener, topic, seeded joke beginning."""
    m = normalize_live(live_from_events(spark, sf, 3)).where(R.match_command(K.CMD_JOKE))
    return m.select("chat_id", "id", R.command_prompt("local", SEED, clock=F.col("hhmm")).alias("prompt"))


# ------------------------------------------------------------------ responses

API_RESP_SQL = """SELECT CAST(doc_id % 7 AS BIGINT) AS chat_id, doc_id AS prompt_id,
  CASE doc_id % 5 WHEN 0 THEN '@' || CAST(doc_id AS VARCHAR) || ' ' || text
                  WHEN 1 THEN 'pass ' || text
                  WHEN 2 THEN '@x' || CAST(doc_id AS VARCHAR) || ' ' || text
                  WHEN 3 THEN '(image or file) ' || text
                  ELSE text END AS raw_response
FROM documents"""


def api_responses(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    k = F.col("doc_id") % 5
    raw = (F.when(k == 0, F.concat(F.lit("@"), F.col("doc_id").cast("string"), F.lit(" "), F.col("text")))
           .when(k == 1, F.concat(F.lit("pass "), F.col("text")))
           .when(k == 2, F.concat(F.lit("@x"), F.col("doc_id").cast("string"), F.lit(" "), F.col("text")))
           .when(k == 3, F.concat(F.lit("(image or file) "), F.col("text")))
           .otherwise(F.col("text")))
    return d.select((F.col("doc_id") % 7).cast("bigint").alias("chat_id"), F.col("doc_id").alias("prompt_id"),
                    raw.alias("raw_response"))


@register("parse_reply_prefix", sql=f"""WITH r AS ({API_RESP_SQL}),
x AS (SELECT *, strpos(raw_response, ' ') AS sp, starts_with(raw_response, '@') AND strpos(raw_response, ' ') > 0 AS ref FROM r)
SELECT prompt_id, CASE WHEN ref THEN substr(raw_response, sp + 1) ELSE raw_response END AS text,
       CASE WHEN ref THEN TRY_CAST(trim(substr(raw_response, 2, sp - 2)) AS BIGINT) END AS reply_to_message_id
FROM x WHERE length(raw_response) >= 1""")
def q_parse_reply_prefix(spark, sf):
    from chatprep.functions.records import parse_reply_prefix
    r = api_responses(spark, sf).withColumn("_r", parse_reply_prefix("raw_response")).where(F.col("_r").isNotNull())
    return r.select("prompt_id", "_r.text", "_r.reply_to_message_id")


@register("filter_responses", sql=f"""WITH r AS ({API_RESP_SQL}),
x AS (SELECT *, strpos(raw_response, ' ') AS sp, starts_with(raw_response, '@') AND strpos(raw_response, ' ') > 0 AS ref FROM r),
y AS (SELECT chat_id, prompt_id, CASE WHEN ref THEN substr(raw_response, sp + 1) ELSE raw_response END AS text,
       CASE WHEN ref THEN TRY_CAST(trim(substr(raw_response, 2, sp - 2)) AS BIGINT) END AS reply_to_message_id
      FROM x WHERE length(raw_response) >= 1)
SELECT chat_id, prompt_id, CAST(0 AS BIGINT) AS reply_idx, text, reply_to_message_id FROM y
WHERE NOT (lower(substr(text, 1, 4)) = 'pass' OR starts_with(text, '(image or file)'))""")
def q_filter_responses(spark, sf):
    return RS.parse_responses(api_responses(spark, sf), "api")


def local_responses(spark, sf):
    """Model continuations derived from segments: everything after the open record
    of a segment's first message (its text, reply field and the following records)."""
    segs = build_segments(messages_from_events(spark, sf, 3), seed=SEED)
    g = segs.groupBy("chat_id", "seg_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_pos", "record"))), lambda e: e["record"]),
                     "\n").alias("body"),
        F.min_by(F.length(encode_record_prefix("id", "hhmm", "sender")), "seg_pos").alias("plen"))
    return g.select("chat_id", F.col("seg_id").alias("prompt_id"), F.substr("body", F.col("plen") + 1).alias("raw_response"))


def _local_resp_sql() -> str:
    from chatprep.plans.training import seg_sql
    return f"""{seg_sql(events_messages_sql(3))},
resp AS (SELECT chat_id, seg_id AS prompt_id,
       substr(string_agg(record, chr(10) ORDER BY seg_pos),
              arg_min(length('[MSG]' || CAST(id AS VARCHAR) || '[FS]' || hhmm || '[FS]' || sender || '[FS]'), seg_pos) + 1) AS raw_response
FROM rec GROUP BY chat_id, seg_id)"""


_BOT = K.SEGMENT_BOT_NAME


@register("parse_record_replies", sql=f"""WITH {_local_resp_sql()},
x AS (SELECT chat_id, prompt_id, string_split(raw_response, '[MEG]') AS parts FROM resp),
fr AS (SELECT chat_id, prompt_id, CAST(0 AS BIGINT) AS reply_idx, string_split(parts[1], '[FS]')[1] AS text,
              TRY_CAST(trim(string_split(parts[1], '[FS]')[2]) AS BIGINT) AS reply_to_message_id
       FROM x WHERE contains(parts[1], '[FS]')),
rs AS (SELECT chat_id, prompt_id, unnest(parts[2:]) || '[MEG]' AS p, generate_subscripts(parts[2:], 1) AS k
       FROM x WHERE contains(parts[1], '[FS]')),
dc AS (SELECT *, contains(p, '[MSG]') AS ok, string_split(replace(replace(p, '[MSG]', ''), '[MEG]', ''), '[FS]') AS f FROM rs),
flg AS (SELECT *, NOT (ok AND len(f) IN (4, 5)) OR f[3] <> '{_BOT}' AS bad FROM dc),
st AS (SELECT *, min(CASE WHEN bad THEN k END) OVER (PARTITION BY chat_id, prompt_id) AS stop FROM flg),
fw AS (SELECT chat_id, prompt_id, k, f[4] AS text, TRY_CAST(trim(CASE WHEN len(f) = 5 THEN f[5] END) AS BIGINT) AS reply_to_message_id
       FROM st WHERE (stop IS NULL OR k < stop) AND f[4] <> '(image or file)')
SELECT * FROM fr
UNION ALL
SELECT chat_id, prompt_id, CAST(row_number() OVER (PARTITION BY chat_id, prompt_id ORDER BY k) AS BIGINT) AS reply_idx,
       text, reply_to_message_id FROM fw""")
def q_parse_record_replies(spark, sf):
    return RS.parse_responses(local_responses(spark, sf), "local", K.SEGMENT_BOT_NAME)


@register("union_bot_messages", sql=f"""WITH {ROUTE_INPUT_SQL}
SELECT chat_id, id, sender FROM lm
UNION ALL
SELECT chat_id, max(id) + 1 AS id, '{K.BOT_NAME_API}' AS sender FROM lm GROUP BY chat_id""")
def q_union_bot(spark, sf):
    """The bot's sent replies join the history (one reply per chat after its last message here)."""
    m = normalize_live(live_from_events(spark, sf, 3))
    sent = C.next_message_id(m).withColumnRenamed("next_id", "id")
    return RS.union_bot_messages(m.select("chat_id", "id", "sender"), sent)


@register("parse_responses", sql=f"""SELECT 'api' AS mode, * FROM ({ORACLE_SQL['filter_responses']})
UNION ALL SELECT 'local' AS mode, * FROM ({ORACLE_SQL['parse_record_replies']})""")
def q_parse_responses(spark, sf):
    """Both answer formats: API answers (one reply, pass/placeholder dropped) and
    delimited continuations (records kept while from the bot)."""
    a = RS.parse_responses(api_responses(spark, sf), "api").withColumn("mode", F.lit("api"))
    b = RS.parse_responses(local_responses(spark, sf), "local", K.SEGMENT_BOT_NAME).withColumn("mode", F.lit("local"))
    return a.unionByName(b).select("mode", "chat_id", "prompt_id", "reply_idx", "text", "reply_to_message_id")


_RP_TOK = 400


@register("response_prompts", sql=f"""WITH {ROUTE_INPUT_SQL}, rt AS (SELECT *, {route_case_sql()} AS action FROM ri),
t AS (SELECT *, {chat_turn_sql()} AS tj FROM rt),
l AS (SELECT *, length(tj) + CASE WHEN {_bot_sql(ascii_handle_sql('sender'))} THEN 3 ELSE 5 END + 2 AS len FROM t),
p AS (SELECT *, sum(len) OVER (PARTITION BY chat_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS P FROM l),
q AS (SELECT *, P - len AS Q FROM p)
SELECT a.chat_id, a.id, a.action,
       '{{"messages":[{_sq(_SYS_JSON)}' || COALESCE(',' || string_agg(e.tj, ',' ORDER BY e.id), '')
       || CASE WHEN a.action = 'joke' THEN ',{{"role":"system","content":' || CAST(to_json(
            CASE WHEN len(string_split(a.text, ' ')) > 1 THEN '{_sq(K.JOKE_TOPIC_PROMPT)}' || array_to_string(string_split(a.text, ' ')[2:], ' ')
                 ELSE '{_sq(K.JOKE_RANDOM_PROMPT)}' END) AS VARCHAR) || '}}' ELSE '' END || ']}}' AS prompt
FROM q a LEFT JOIN q e ON e.chat_id = a.chat_id AND e.id <= a.id AND e.Q >= a.P - {C.chat_budget_chars(_RP_TOK)}
WHERE a.action IN ('joke', 'random', 'trigger', 'reply_to_bot') GROUP BY a.chat_id, a.id, a.action, a.text""")
def q_response_prompts(spark, sf):
    """Prompts of the routed messages that go to the model (API head, 400 tokens)."""
    routed = R.route_messages(routing_input(spark, sf), bot_rules("api"))
    return C.response_prompts(routed, max_tokens=_RP_TOK, instruction=R.command_prompt("api"))
