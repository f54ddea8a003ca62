"""Chat exports: one JSON document ``{"messages": [...]}`` per chat folder.

A document is read by byte ranges (``sources/ranges.py``), so one huge export is the work of many
tasks; each message becomes a VARIANT. Exports as JSON lines (``export_lines_scan``) need no such
scan. Message fields are optional and the text is a string or a list of strings and
``{"text": ...}`` parts.
"""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatprep import constants as K
from chatprep.functions.text import default_sender, iso_of, iso_to_hhmm, iso_to_ntz, placeholder_text, ymd_of
from chatprep.sources.ranges import JsonScan, scan_records

EXPORT_FILE = "result.json"

# Python workers need not have this package installed: its UDF code travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def export_scan(spark: SparkSession, path_glob: str, chat_pattern: str = r"([^/]+)/[^/]+$",
                exclude: str | None = None, repartition: int | None = None) -> DataFrame:
    """Read export files -> (chat_id STRING, pos BIGINT, msg VARIANT).

    ``chat_pattern`` extracts the chat id from the file path (default: the folder
    name). ``exclude`` is a regex on that chat id; matching folders are skipped.
    A document of any size is read by byte ranges, and each message is a VARIANT of its own.
    A message that is no valid JSON, or a document that ends too early, raises."""
    chat = F.regexp_extract(F.col("file"), chat_pattern, 1)
    raw = scan_records(spark, path_glob, JsonScan("messages"), "}").select(
        chat.alias("chat_id"), F.col("number").alias("pos"), F.ltrim("text", F.lit(", \t\r\n")).alias("text"))
    if exclude:
        raw = raw.where(~F.col("chat_id").rlike(exclude))
    msgs = raw.where(F.trim(F.col("text"), F.lit(" \t\r\n")) != "").select("chat_id", "pos", F.parse_json("text").alias("msg"))
    if repartition:
        msgs = msgs.repartition(repartition, "chat_id", "pos")
    return msgs


def export_lines_scan(spark: SparkSession, path_glob: str, chat_pattern: str = r"([^/]+)/[^/]+$",
                      exclude: str | None = None) -> DataFrame:
    """Exports converted to JSON lines (one message object per line) -> (chat_id,
    pos, msg VARIANT). Line files split across tasks, so one huge chat reads in
    parallel. ``pos`` is the record's place in its file, from 0 (the head), whatever its id:
    places inside a split are counted there, and a small table of splits gives their offsets."""
    raw = spark.read.option("singleVariantColumn", "msg").option("mode", "FAILFAST").json(path_glob)
    raw = raw.select(F.regexp_extract(F.col("_metadata.file_path"), chat_pattern, 1).alias("chat_id"), "msg",
                     F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
                     F.monotonically_increasing_id().alias("_row"))
    if exclude:
        raw = raw.where(~F.col("chat_id").rlike(exclude))
    splits = raw.groupBy("_file", "_at").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return raw.join(splits, ["_file", "_at"]).select(
        "chat_id", (F.col("_off") + F.col("_row") - F.col("_first")).cast("bigint").alias("pos"), "msg")


def skip_head(msgs: DataFrame, n: int = 1) -> DataFrame:
    """Drop the first ``n`` records of every export (a service record)."""
    return msgs.where(F.col("pos") >= n)


def plain_text(value) -> str:
    """The text of a rich-text value of any depth: strings as they are, lists end to end, objects
    by their ``text``. Anything else is no text and raises."""
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict) and "text" in x:
            todo.append(x["text"])
        else:
            raise ValueError(f"not a text: {json.dumps(x)[:100]}")
    return "".join(out)


def flatten_rich_text(v) -> Column:
    """VARIANT text -> string: strings as they are, lists joined without separator, objects by
    their ``text``, to any depth; null stays null, other values raise.

    Strings and flat lists are column expressions; only deeper texts go through Python, as JSON."""
    c = v if isinstance(v, Column) else F.col(v)
    arr = F.try_variant_get(c, "$", "array<variant>")
    is_text = lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))
    inner = lambda e: F.try_variant_get(e, "$.text", "variant")
    flat = F.schema_of_variant(c).startswith("ARRAY") & F.forall(arr, lambda e: is_text(e) | is_text(inner(e)))
    joined = F.array_join(F.transform(arr, lambda e: F.when(is_text(e), F.try_variant_get(e, "$", "string"))
                                      .otherwise(F.try_variant_get(e, "$.text", "string"))), "")

    @F.pandas_udf("string")
    def deep_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else plain_text(json.loads(x)))

    void = c.isNull() | (F.schema_of_variant(c) == "VOID")
    simple = F.coalesce(void | is_text(c) | flat, F.lit(False))
    return F.when(void, F.lit(None).cast("string")).when(is_text(c), F.try_variant_get(c, "$", "string")) \
        .when(F.coalesce(flat, F.lit(False)), joined).otherwise(deep_text(F.when(~simple, F.to_json(c))))


def normalize_export(msgs: DataFrame, col: str = "msg") -> DataFrame:
    """Raw export record -> message row (chat_id, pos, id, sent_at, hhmm, sender, text,
    reply_to_message_id): empty text falls back to the sticker emoji, then to the
    placeholder; a missing sender becomes ``Anonym``."""
    m = F.col(col)
    date = F.try_variant_get(m, "$.date", "string")
    text = F.coalesce(flatten_rich_text(F.try_variant_get(m, "$.text", "variant")), F.lit(""))
    return msgs.select(
        "chat_id", "pos",
        F.try_variant_get(m, "$.id", "bigint").alias("id"),
        iso_to_ntz(date).alias("sent_at"),
        iso_to_hhmm(date).alias("hhmm"),
        default_sender(F.try_variant_get(m, "$.from", "string")).alias("sender"),
        placeholder_text(text, F.try_variant_get(m, "$.sticker_emoji", "string")).alias("text"),
        F.try_variant_get(m, "$.reply_to_message_id", "bigint").alias("reply_to_message_id"),
    )


def ingest_stats(msgs: DataFrame) -> DataFrame:
    """Messages read of each export."""
    return msgs.groupBy("chat_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_messages"))


def first_message_preview(msgs: DataFrame) -> DataFrame:
    """First message of each export (after the head is skipped)."""
    return msgs.groupBy("chat_id").agg(F.min_by(F.struct("pos", "id", "sender", "text"), "pos").alias("first")) \
        .select("chat_id", "first.*")


def _json_str(c: Column) -> Column:
    """A string as a JSON string literal (quoted and escaped)."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def _message_json(rich_every: int = 7) -> Column:
    """One export message object as JSON text; every ``rich_every``-th text is a
    rich-text list ``["head ", {"type": "bold", "text": "tail"}]``, and the one after it nests deeper."""
    text = F.col("text")
    sp = F.instr(text, " ")
    rich = F.concat(F.lit("["), _json_str(F.substr(text, F.lit(1), sp)), F.lit(',{"type":"bold","text":'),
                    _json_str(F.substr(text, sp + 1)), F.lit("}]"))
    deep = F.concat(F.lit('{"type":"quote","text":['), _json_str(F.substr(text, F.lit(1), sp)), F.lit(',[{"text":{"text":['),
                    _json_str(F.substr(text, sp + 1)), F.lit("]}}]]}"))
    nth = F.pmod(F.col("id"), F.lit(rich_every))
    text_json = F.when((nth == 0) & (sp > 0), rich).when((nth == 1) & (sp > 0), deep).otherwise(_json_str(text))
    reply = F.when(F.col("reply_to_message_id").isNotNull(),
                   F.concat(F.lit(',"reply_to_message_id":'), F.col("reply_to_message_id").cast("string"))) \
        .otherwise(F.lit(""))
    return F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"date":'), _json_str(iso_of("sent_at")),
                    F.lit(',"from":'), F.coalesce(_json_str(F.col("sender")), F.lit("null")),
                    F.lit(',"text":'), text_json, reply, F.lit("}"))


def write_export_lines(msgs: DataFrame, path: str, rich_every: int = 7) -> str:
    """Write messages as JSON-lines exports, one folder per chat (``chat_<id>``);
    returns the glob to read them back."""
    folder = F.concat(F.lit("chat_"), F.col("chat_id").cast("string"))
    msgs.select(folder.alias("folder"), _message_json(rich_every).alias("value")) \
        .hint("rebalance", "folder").write.mode("overwrite").partitionBy("folder").text(path)
    return f"{path}/folder=*/*.txt"


def write_exports(msgs: DataFrame, path: str, rich_every: int = 7, docs_max_rows: int = 10000) -> str:
    """Write messages as export documents, one file per ``chat_<chat>_<day>_<part>``
    folder (at most ``docs_max_rows`` messages per document, so no group is
    unbounded), each starting with a service record. Every ``rich_every``-th text is
    written as a rich-text list ``["head ", {"type": "bold", "text": "tail"}]``.
    Returns the glob to read them back."""
    date = iso_of("sent_at")
    rec = _message_json(rich_every)
    part = F.floor(F.col("id") / docs_max_rows).cast("bigint")
    folder = F.concat(F.lit("chat_"), F.col("chat_id").cast("string"), F.lit("_"),
                      ymd_of("sent_at"), F.lit("_"), part.cast("string"))
    docs = msgs.withColumn("folder", folder).groupBy("folder").agg(
        F.array_sort(F.collect_list(F.struct(F.col("id").alias("k"), rec.alias("r")))).alias("items"),
        F.min(date).alias("d0"))
    service = F.concat(F.lit('{"id":-1,"type":"service","date":'), _json_str(F.col("d0")),
                       F.lit(',"from":null,"text":""}'))
    body = F.concat(F.lit('{"name":'), _json_str(F.col("folder")), F.lit(',"messages":['), service, F.lit(","),
                    F.array_join(F.transform("items", lambda e: e["r"]), ","), F.lit("]}"))
    docs.select("folder", body.alias("value")).repartition("folder") \
        .write.mode("overwrite").partitionBy("folder").text(path)
    return f"{path}/folder=*/*.txt"
