"""Query registry shared by ``__spark_entry__``, ``bench.py`` and the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key`` with its oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        old = QUERIES.get(key)
        if old is not None and (old.__module__, old.__qualname__) != (fn.__module__, fn.__qualname__):
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE_SQL[key] = sql.strip()
        return fn
    return deco


# ---- shared SQL fragments (DuckDB dialect) ---------------------------------

def events_messages_sql(n_chats: int | None = 3) -> str:
    chat = f"user_id % {n_chats}" if n_chats else "CAST(0 AS BIGINT)"
    return f"""SELECT CAST({chat} AS BIGINT) AS chat_id, event_id AS id, ts AS sent_at,
       strftime(ts, '%H:%M') AS hhmm,
       CONCAT('user_', CAST(user_id % 6 AS VARCHAR)) AS sender,
       CONCAT(event_type, ' ', props) AS text,
       CASE WHEN event_id % 5 = 0 AND event_id >= 12 THEN event_id - 1 - (user_id % 12) END AS reply_to_message_id
FROM events"""


CONV_MESSAGES_SQL = """SELECT conv_id AS chat_id, turn + 1 AS id,
       TIMESTAMP '2024-01-01 00:00:00' + turn * INTERVAL 1 MINUTE AS sent_at,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + turn * INTERVAL 1 MINUTE, '%H:%M') AS hhmm,
       role AS sender, text, CAST(NULL AS BIGINT) AS reply_to_message_id
FROM conversations"""


def bot_handles_sql(bot_name: str | None = None) -> str:
    """SQL list of the handles that count as the bot (aliases and the folded name)."""
    from chatprep import constants as K
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join([quoted(n) for n in K.BOT_ALIASES] + [ascii_handle_sql(quoted(bot_name or K.BOT_NAME_API))])


def ascii_handle_sql(x: str) -> str:
    s = f"COALESCE(NULLIF({x}, ''), 'Anonym')"
    s = f"regexp_replace({s}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    s = f"substring({s}, 1, 60)"
    s = f"translate({s}, 'äöåÄÖÅ', 'aoaAOA')"
    return f"regexp_replace({s}, '[^\\x00-\\x7F]', '', 'g')"


def chat_name_sql(x: str) -> str:
    return f"COALESCE(NULLIF({ascii_handle_sql(x)}, ''), 'Anonym')"


def pmod_sql(a: str, n: int | str) -> str:
    return f"((({a}) % ({n}) + ({n})) % ({n}))"


def content_json_sql(id_="id", hhmm="hhmm", sender="sender", text="text", reply="reply_to_message_id") -> str:
    return (f"CAST(json_object('id', {id_}, 'time', {hhmm}, 'from', {sender}, 'text', {text}, "
            f"'reply_to_message_id', {reply}) AS VARCHAR)")


def seeded_u32_sql(seed, *keys: str) -> str:
    parts = " || ':' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"CAST(('0x' || substr(md5({parts}), 1, 8)) AS BIGINT)"


def seeded_md5_sql(seed, *keys: str) -> str:
    parts = " || ':' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"md5({parts})"
