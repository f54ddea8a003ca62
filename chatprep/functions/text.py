"""Message field normalisation: senders, handles, clocks, placeholders, token counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatprep import constants as K

__all__ = [
    "default_sender", "ascii_handle", "iso_to_ntz", "iso_to_hhmm", "hhmm_of", "iso_of", "ymd_of", "unix_to_iso", "current_hhmm",
    "placeholder_text", "clean_text", "to_reply_id", "approx_tokens", "strip_prompt",
    "cut_at_newline", "cut_at_marker", "joke_topic_local", "joke_topic_api", "py_strip",
]


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def default_sender(c) -> Column:
    """Missing or empty sender -> ``Anonym``."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(K.DEFAULT_SENDER))


def ascii_handle(c) -> Column:
    """Chat handle: keep letters and digits, cut to 60, fold å/ä/ö, drop non-ASCII.

    The steps run in this order, so a name of 61+ letters is cut before folding and
    an emoji-only name becomes the empty string.
    """
    s = F.regexp_replace(default_sender(c), r"[^\p{L}\p{N}]", "")
    s = F.substring(s, 1, K.HANDLE_MAX_LEN)
    s = F.translate(s, K.HANDLE_FOLD_FROM, K.HANDLE_FOLD_TO)
    return F.regexp_replace(s, r"[^\x00-\x7F]", "")


_ISO_RE = r"^(\d{4})-(\d{1,2})-(\d{1,2})T(\d{1,2}):(\d{1,2}):(\d{1,2})$"


def iso_to_ntz(c) -> Column:
    """``YYYY-MM-DDTHH:MM:SS`` (fields after the year may have one digit) -> wall-clock
    TIMESTAMP_NTZ, independent of the session zone; null when it is not a valid time."""
    x = _c(c)
    y, mo, d, h, mi, sec = [F.regexp_extract(x, _ISO_RE, i).try_cast("int") for i in range(1, 7)]
    ok = x.rlike(_ISO_RE) & (sec < 60)
    return F.when(ok, F.try_make_timestamp_ntz(y, mo, d, h, mi, sec))


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def hhmm_of(ts) -> Column:
    """``HH:MM`` of a wall-clock timestamp, built from its fields (no session zone)."""
    t = _c(ts)
    return F.concat(_pad(F.hour(t), 2), F.lit(":"), _pad(F.minute(t), 2))


def iso_of(ts) -> Column:
    """``YYYY-MM-DDTHH:MM:SS`` of a wall-clock timestamp, built from its fields."""
    t = _c(ts)
    return F.concat(_pad(F.year(t), 4), F.lit("-"), _pad(F.month(t), 2), F.lit("-"), _pad(F.dayofmonth(t), 2),
                    F.lit("T"), hhmm_of(t), F.lit(":"), _pad(F.second(t), 2))


def ymd_of(ts) -> Column:
    t = _c(ts)
    return F.concat(_pad(F.year(t), 4), _pad(F.month(t), 2), _pad(F.dayofmonth(t), 2))


def iso_to_hhmm(c) -> Column:
    """``YYYY-MM-DDTHH:MM:SS`` -> ``HH:MM``; null when the text does not parse."""
    return hhmm_of(iso_to_ntz(c))


def unix_to_iso(c, tz: str = "UTC") -> Column:
    """Unix seconds -> ISO text in the given zone, independent of the session zone."""
    ntz = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    utc = F.timestamp_add("SECOND", _c(c).cast("bigint"), ntz)
    local = utc if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)
    return iso_of(local)


def current_hhmm(now=None) -> Column:
    """Current clock as ``HH:MM``; pass a literal for reproducible output."""
    if now is None:
        return F.date_format(F.current_timestamp(), K.TIME_FORMAT)
    return F.lit(now) if isinstance(now, str) else hhmm_of(now)


def placeholder_text(text, sticker=None) -> Column:
    """Empty text -> sticker emoji -> ``(image or file)``."""
    parts = [F.nullif(_c(text), F.lit(""))]
    if sticker is not None:
        parts.append(F.nullif(_c(sticker), F.lit("")))
    return F.coalesce(*parts, F.lit(K.PLACEHOLDER_TEXT))


def clean_text(c) -> Column:
    """Null text fields become the empty string (reader clean-up)."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def to_reply_id(c) -> Column:
    """Reply id as nullable BIGINT: empty, non-numeric or missing -> null."""
    s = F.trim(_c(c).cast("string"))
    return F.coalesce(s.try_cast("bigint"), s.try_cast("double").try_cast("bigint"))


def approx_tokens(c) -> Column:
    """Approximate token count: characters (code points) div 3."""
    return (F.length(_c(c)).cast("bigint") / F.lit(K.CHARS_PER_TOKEN)).cast("bigint")


def strip_prompt(output, prompt) -> Column:
    """Drop the echoed prompt from a completion."""
    return F.substr(_c(output), F.length(_c(prompt)) + 1)


def cut_at_newline(c) -> Column:
    """First line of a completion."""
    return F.substring_index(_c(c), "\n", 1)


def cut_at_marker(c, token: str = K.END_MSG) -> Column:
    """Completion up to the first marker, with the marker appended (even if absent)."""
    return F.concat(F.substring_index(_c(c), token, 1), F.lit(token))


def py_strip(c) -> Column:
    """Whitespace trim on both ends (spaces, tabs, newlines)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def joke_topic_local(text, command: str = K.CMD_JOKE) -> Column:
    """Command argument: lower-case, remove the command, trim; empty -> null."""
    t = py_strip(F.replace(F.lower(_c(text)), F.lit(command), F.lit("")))
    return F.nullif(t, F.lit(""))


def joke_topic_api(text) -> Column:
    """Words after the first one (split on single spaces); none -> null."""
    parts = F.split(_c(text), " ", -1)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(F.size(rest) > 0, F.array_join(rest, " "))
