"""Delimited-record training segments: fixed-size slices of a (filtered) history.

Every window here is partitioned by ``(chat, segment)``; a segment has at most
``segment_len`` rows, so renumbering and reply remapping are bounded per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatprep import constants as K
from chatprep.functions.hashing import seeded_int
from chatprep.functions.records import encode_record, encode_record_prefix
from chatprep.operators.positions import BLOCK_WIDTH, number_rows

SEG_KEY = ["chat_id", "seg_id"]


def filter_length(msgs: DataFrame, max_chars: int = K.SEGMENT_MAX_CHARS) -> DataFrame:
    """Keep messages whose text is shorter than ``max_chars`` code points (null dropped)."""
    return msgs.where(F.length("text") < max_chars)


def segment_fixed(msgs: DataFrame, segment_len: int = K.SEGMENT_LEN, order_col: str = "id",
                  by: tuple[str, ...] = (), width: int = BLOCK_WIDTH, dense: bool | None = None) -> DataFrame:
    """Consecutive segments of ``segment_len`` rows; the short tail segment is kept.
    ``by`` names columns that split a chat into parts, each segmented on its own."""
    order = [order_col] + [c for c in ("sent_at", "sender", "text") if c in msgs.columns]
    m = number_rows(msgs, ["chat_id", *by], order, block_col=order_col, width=width, dense=dense)
    return m.withColumn("seg_id", F.floor(F.col("pos") / segment_len).cast("bigint")) \
        .withColumn("seg_pos", F.pmod(F.col("pos"), F.lit(segment_len)).cast("bigint"))


def relabel_segment_speaker(segs: DataFrame, bot_name: str = K.SEGMENT_BOT_NAME,
                            by: tuple[str, ...] = ()) -> DataFrame:
    """Every message by the segment's last sender is attributed to ``bot_name``
    (``orig_sender`` keeps the original)."""
    w = Window.partitionBy(*SEG_KEY, *by).orderBy("seg_pos") \
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last("sender").over(w)
    return segs.withColumn("orig_sender", F.col("sender")) \
        .withColumn("sender", F.when(F.col("sender").eqNullSafe(last), F.lit(bot_name)).otherwise(F.col("sender")))


def renumber_ids(segs: DataFrame, seed: int = 42, lo: int = K.SEGMENT_ID_BASE_MIN,
                 hi: int = K.SEGMENT_ID_BASE_MAX) -> DataFrame:
    """New ids: a seeded base in [lo, hi] per segment plus the position in the segment."""
    base = seeded_int(seed, lo, hi, "chat_id", "seg_id")
    return segs.withColumn("orig_id", F.col("id")).withColumn("id", (base + F.col("seg_pos")).cast("bigint"))


def reply_remap(segs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Map reply ids onto the renumbered ids of the same segment; a target outside
    the segment becomes null. With duplicate ids the later row wins.

    The segment's (old id, new id) pairs are gathered by a window over the bounded
    segment, so no join is needed."""
    w = Window.partitionBy(*SEG_KEY, *by).orderBy("seg_pos") \
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pairs = F.collect_list(F.struct("seg_pos", "orig_id", "id")).over(w)
    hits = F.filter(F.array_sort(pairs), lambda e: e["orig_id"] == F.col("orig_reply_to_message_id"))
    new = F.when(F.size(hits) > 0, F.element_at(hits, -1)["id"])
    return segs.withColumn("orig_reply_to_message_id", F.col("reply_to_message_id")) \
        .withColumn("reply_to_message_id", new.cast("bigint"))


def build_segments(msgs: DataFrame, *, max_chars: int = K.SEGMENT_MAX_CHARS, segment_len: int = K.SEGMENT_LEN,
                   bot_name: str = K.SEGMENT_BOT_NAME, seed: int = 42, by: tuple[str, ...] = (),
                   width: int = BLOCK_WIDTH, dense: bool | None = None) -> DataFrame:
    """messages -> prepared segment rows with the delimited ``record`` column."""
    s = segment_fixed(filter_length(msgs, max_chars), segment_len, by=by, width=width, dense=dense)
    s = reply_remap(renumber_ids(relabel_segment_speaker(s, bot_name, by), seed), by)
    return s.withColumn("record", encode_record("id", "hhmm", "sender", "text", "reply_to_message_id"))


def segment_prompt(segs: DataFrame, render=None) -> DataFrame:
    """One prompt per segment: its records in order, each followed by a newline.
    ``render`` (a Column) replaces the delimited record as the per-message text."""
    rec = F.col("record") if render is None else render
    recs = F.transform(F.array_sort(F.collect_list(F.struct(F.col("seg_pos"), rec.alias("record")))),
                       lambda e: e["record"])
    return segs.groupBy(*SEG_KEY).agg(F.count(F.lit(1)).cast("bigint").alias("n_messages"),
                                     F.concat(F.array_join(recs, "\n"), F.lit("\n")).alias("prompt"))


def eval_pairs(segs: DataFrame, pre_prompt: str = "") -> DataFrame:
    """Per segment: prompt = preamble + all records but the last + the open record
    of the last message; truth = the last message's text."""
    last_pos = F.max("seg_pos")
    items = F.array_sort(F.collect_list(F.struct("seg_pos", "record")))
    g = segs.groupBy(*SEG_KEY).agg(
        items.alias("_items"), last_pos.alias("_last"),
        F.max_by(encode_record_prefix("id", "hhmm", "sender"), "seg_pos").alias("_open"),
        F.max_by("text", "seg_pos").alias("truth"))
    body = F.transform(F.filter("_items", lambda e: e["seg_pos"] < F.col("_last")), lambda e: e["record"])
    body_text = F.when(F.size(body) > 0, F.concat(F.array_join(body, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return g.select(*SEG_KEY, F.concat(F.lit(pre_prompt), body_text, F.col("_open")).alias("prompt"), "truth")


def segments_per_split(msgs: DataFrame, test_frac: float = K.SEGMENT_TEST_FRAC, order_col: str = "id",
                       **kw) -> DataFrame:
    """The delimited training flow's split: the first ``int(n * (1 - test_frac))``
    messages are train, the rest test; each part is filtered and segmented on its
    own. Returns the prepared segment rows with a ``split`` column."""
    from chatprep.operators.splits import split_ordered
    return build_segments(split_ordered(msgs, order_col, test_frac), by=("split",), **kw)
