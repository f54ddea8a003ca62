"""The ``;``-separated history CSV (``id;time;from;text;reply_to_message_id``).

Read with an explicit schema (no inference pass). Quoted fields of the plain form may hold
newlines; ``sources/ranges.py`` finds the ends of its records in ranges of a file. The
``line_safe`` form escapes line breaks (and backslashes) in its texts: a record is a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.functions.text import clean_text, to_reply_id
from chatprep.schema import HISTORY_CSV
from chatprep.sources.ranges import CsvScan, scan_records

CSV_OPTIONS = {"sep": ";", "header": "true", "multiLine": "true", "quote": '"', "escape": '"',
               "encoding": "UTF-8"}


TEXT_FIELDS = ("from", "text")


def escape_lines(c) -> Column:
    """Backslash, line feed and return as two characters each."""
    c = F.replace(_c(c), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def unescape_lines(c) -> Column:
    """Undoes ``escape_lines``: the parts between escaped backslashes hold no other backslash
    than those of line breaks."""
    parts = F.split(_c(c), r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(plain, "\\")


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _options(line_safe: bool) -> dict:
    return CSV_OPTIONS | ({"multiLine": "false"} if line_safe else {})


def history_csv_raw_scan(spark: SparkSession, path: str, line_safe: bool = False) -> DataFrame:
    """The CSV as written: empty fields are null, reply id kept as text.

    The plain form is cut into records at the line breaks outside quotes, by byte ranges, so that
    one big file is read by many tasks; each record is then parsed on its own. Line breaks in
    quotes stay as they are written (Spark's ``multiLine`` reader turns CR LF into LF)."""
    if line_safe:
        raw = spark.read.schema(HISTORY_CSV).options(**_options(line_safe)).csv(path)
        return raw.withColumns({f: unescape_lines(f) for f in TEXT_FIELDS})
    line = F.regexp_replace("text", r"\r?\n?\z", "")
    records = scan_records(spark, path, CsvScan(), "\n").where((F.col("number") > 0) & (line != ""))
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"} | {"mode": "FAILFAST"}
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in HISTORY_CSV.fields)
    return records.select(F.from_csv(line, fields, options).alias("r")).select("r.*")


def history_csv_scan(spark: SparkSession, path: str, line_safe: bool = False) -> DataFrame:
    """Cleaned history: null text fields become empty strings, reply id a nullable BIGINT."""
    raw = history_csv_raw_scan(spark, path, line_safe)
    return raw.select(
        F.col("id"), clean_text("time").alias("time"), clean_text("from").alias("from"),
        clean_text("text").alias("text"), to_reply_id("reply_to_message_id").alias("reply_to_message_id"))


def to_history_rows(msgs: DataFrame) -> DataFrame:
    """messages -> the five history columns."""
    return msgs.select(F.col("id"), F.col("hhmm").alias("time"), F.col("sender").alias("from"), "text",
                       F.col("reply_to_message_id").cast("string").alias("reply_to_message_id"))


def history_csv_sink(msgs: DataFrame, path: str, by_chat: bool = False, line_safe: bool = False) -> None:
    """Write the history CSV (header in every file). ``by_chat`` writes one folder
    per chat (``chat_id=<id>``), the per-chat log layout; ``line_safe`` one line per record."""
    cols = [F.col("id"), F.col("hhmm").alias("time"), F.col("sender").alias("from"), F.col("text"),
            F.col("reply_to_message_id").cast("string").alias("reply_to_message_id")]
    rows = msgs.select(*([F.col("chat_id")] if by_chat else []), *cols)
    if line_safe:
        rows = rows.withColumns({f: escape_lines(f) for f in TEXT_FIELDS})
    if by_chat:
        # few files per chat folder; AQE splits a hot chat over several tasks
        rows = rows.hint("rebalance", "chat_id")
    w = rows.write.mode("overwrite").options(**_options(line_safe))
    if by_chat:
        w = w.partitionBy("chat_id")
    w.csv(path)
