"""The scalar functions as SQL functions, for users who write ``spark.sql``.

They are SQL-bodied temporary functions: the body is inlined into the plan like
any built-in expression (no Python). ``register_sql_functions(spark)`` defines
them for the session.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from chatprep import constants as K


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


_ISO = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})T([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})$"
_ISO_TS = ("try_make_timestamp_ntz("
           + ", ".join(f"try_cast(regexp_extract(x, '{_ISO}', {i}) AS INT)" for i in range(1, 7)) + ")")
_ISO_HHMM = (f"CASE WHEN x RLIKE '{_ISO}' AND try_cast(regexp_extract(x, '{_ISO}', 6) AS INT) < 60 "
             f"THEN concat(lpad(cast(hour({_ISO_TS}) AS STRING), 2, '0'), ':', "
             f"lpad(cast(minute({_ISO_TS}) AS STRING), 2, '0')) END")

SQL_FUNCTIONS = {
    "chat_default_sender": ("x STRING", "STRING", f"coalesce(nullif(x, ''), {_q(K.DEFAULT_SENDER)})"),
    "chat_handle": ("x STRING", "STRING",
                    "regexp_replace(translate(substring(regexp_replace(coalesce(nullif(x, ''), "
                    f"{_q(K.DEFAULT_SENDER)}), '[^\\\\p{{L}}\\\\p{{N}}]', ''), 1, {K.HANDLE_MAX_LEN}), "
                    f"{_q(K.HANDLE_FOLD_FROM)}, {_q(K.HANDLE_FOLD_TO)}), '[^\\\\x00-\\\\x7F]', '')"),
    "chat_iso_to_hhmm": ("x STRING", "STRING", _ISO_HHMM),
    "chat_unix_to_iso": ("x BIGINT", "STRING",
                         "concat_ws('T', cast(to_date(timestampadd(SECOND, x, TIMESTAMP_NTZ '1970-01-01 00:00:00')) AS STRING), "
                         "concat(lpad(cast(hour(timestampadd(SECOND, x, TIMESTAMP_NTZ '1970-01-01 00:00:00')) AS STRING), 2, '0'), ':', "
                         "lpad(cast(minute(timestampadd(SECOND, x, TIMESTAMP_NTZ '1970-01-01 00:00:00')) AS STRING), 2, '0'), ':', "
                         "lpad(cast(second(timestampadd(SECOND, x, TIMESTAMP_NTZ '1970-01-01 00:00:00')) AS STRING), 2, '0')))"),
    "chat_placeholder_text": ("t STRING, e STRING", "STRING",
                              f"coalesce(nullif(t, ''), nullif(e, ''), {_q(K.PLACEHOLDER_TEXT)})"),
    "chat_encode_record_prefix": ("id BIGINT, hhmm STRING, sender STRING", "STRING",
                                  f"concat({_q(K.BEGIN_MSG)}, coalesce(cast(id AS STRING), ''), {_q(K.SEP)}, "
                                  f"coalesce(hhmm, ''), {_q(K.SEP)}, coalesce(sender, ''), {_q(K.SEP)})"),
    "chat_encode_record": ("id BIGINT, hhmm STRING, sender STRING, text STRING, reply BIGINT", "STRING",
                           f"concat({_q(K.BEGIN_MSG)}, coalesce(cast(id AS STRING), ''), {_q(K.SEP)}, "
                           f"coalesce(hhmm, ''), {_q(K.SEP)}, coalesce(sender, ''), {_q(K.SEP)}, coalesce(text, ''), "
                           f"{_q(K.SEP)}, coalesce(cast(reply AS STRING), ''), {_q(K.END_MSG)})"),
    "chat_reply_prefix_content": ("text STRING, reply BIGINT", "STRING",
                                  "CASE WHEN reply IS NOT NULL THEN concat('@', cast(reply AS STRING), ' ', text) "
                                  "ELSE text END"),
    "chat_approx_tokens": ("x STRING", "BIGINT", f"CAST(length(x) DIV {K.CHARS_PER_TOKEN} AS BIGINT)"),
    "chat_strip_prompt": ("output STRING, prompt STRING", "STRING", "substr(output, length(prompt) + 1)"),
    "chat_cut_at_newline": ("x STRING", "STRING", "substring_index(x, '\\n', 1)"),
    "chat_cut_at_marker": ("x STRING, token STRING", "STRING", "concat(substring_index(x, token, 1), token)"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Define the ``chat_*`` SQL functions for this session; returns their names."""
    for name, (params, ret, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} RETURN {body}")
    return list(SQL_FUNCTIONS)
