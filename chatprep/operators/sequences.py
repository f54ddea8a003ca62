"""Cutting chat histories into bounded training sequences.

All windows after numbering are partitioned by ``(chat, chunk)``: a chunk holds at
most ``length`` rows, so these windows and the per-sequence aggregate share one
exchange and never see a whole chat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatprep import constants as K
from chatprep.functions.chat import chat_name, encode_content, reply_prefix_content, system_turn, TURN_TYPE
from chatprep.functions.text import ascii_handle
from chatprep.operators.positions import number_rows

SEQ_KEY = ["chat_id", "seq_id"]


def with_scope(msgs: DataFrame, scope: str = "chat") -> DataFrame:
    """``scope='global'`` treats the whole table as one history (all chats joined
    end to end, as a combined export is; ``source_chat_id`` keeps the chat), ``'chat'``
    keeps chats apart."""
    if scope == "global":
        return msgs.withColumn("source_chat_id", F.col("chat_id")).withColumn("chat_id", F.lit(0).cast("bigint"))
    if scope != "chat":
        raise ValueError(f"scope must be 'chat' or 'global', not {scope!r}")
    return msgs


TIEBREAK = ("sent_at", "sender", "text")


def positions(msgs: DataFrame, order_col: str = "id", tiebreak=TIEBREAK, **kw) -> DataFrame:
    """0-based ``pos`` and chat size ``n_chat`` per message, ordered by ``order_col``
    (duplicate ids are ordered by time, sender and text, so positions are reproducible).

    In a global scope ids say nothing about the order of different chats: a message's place is
    the size of the chats before its own plus its place there. Ids may repeat and lie far apart,
    in either scope (see ``number_rows``)."""
    order = [order_col] + [c for c in (tiebreak or ()) if c in msgs.columns]
    if order_col == "id" and "source_chat_id" in msgs.columns:
        order, kw = ["source_chat_id", *order], {**kw, "dense": False}
    return number_rows(msgs, ["chat_id"], order, block_col=order_col, total_col="n_chat", **kw)


def minute_of_day(hhmm) -> Column:
    c = hhmm if isinstance(hhmm, Column) else F.col(hhmm)
    return F.substr(c, F.lit(1), F.lit(2)).try_cast("int") * 60 + F.substr(c, F.lit(4), F.lit(2)).try_cast("int")


def chunk_fixed(numbered: DataFrame, length: int = K.SEQ_LEN_V1, drop_tail: bool = True) -> DataFrame:
    """Chunks of ``length`` rows at positions 0, L, 2L, ...

    With ``drop_tail`` a chunk is used only when a row follows it (start < n - L),
    so the last chunk is dropped even when complete and n <= L gives nothing.
    """
    out = numbered.withColumns({"seq_id": F.floor(F.col("pos") / length).cast("bigint"),
                                "seq_pos": F.pmod(F.col("pos"), F.lit(length))})
    if drop_tail:
        out = out.where((F.col("seq_id") + 1) * length < F.col("n_chat"))
    return out


def gap_breaks(chunked: DataFrame, max_id_gap: int | None = K.SEQ_MAX_ID_GAP,
               max_minutes: int | None = K.SEQ_MAX_MINUTES, clock: str = "hhmm") -> DataFrame:
    """Flag rows that break a chunk: id jump above ``max_id_gap`` from the previous
    row, or more than ``max_minutes`` after the chunk's first row.

    ``clock='hhmm'`` compares wall-clock minutes modulo a day (a backward clock reads
    as almost a day later, midnight crossing is fine); ``'timestamp'`` uses real time.
    """
    w = Window.partitionBy(*SEQ_KEY).orderBy("seq_pos")
    w_all = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    id_brk = F.lit(False)
    if max_id_gap is not None:
        prev = F.lag("id").over(w)
        id_brk = F.coalesce(F.abs(F.col("id") - prev) > max_id_gap, F.lit(False))
    t_brk = F.lit(False)
    if max_minutes is not None:
        if clock == "hhmm":
            m = minute_of_day("hhmm")
            first = F.first(m).over(w_all)
            t_brk = F.coalesce(F.pmod(m - first, F.lit(1440)) > max_minutes, F.lit(False))
        elif clock == "timestamp":
            first = F.first("sent_at").over(w_all)
            secs = F.timestamp_diff("SECOND", first, F.col("sent_at"))
            t_brk = F.coalesce(secs > max_minutes * 60, F.lit(False))
        else:
            raise ValueError("clock must be 'hhmm' or 'timestamp'")
    return chunked.withColumns({"brk_id": id_brk, "brk_time": t_brk & ~id_brk})


def prefix_until_break(flagged: DataFrame) -> DataFrame:
    """Keep each chunk's rows before its first break; the rest of the chunk is dropped."""
    w = Window.partitionBy(*SEQ_KEY).orderBy("seq_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.max((F.col("brk_id") | F.col("brk_time")).cast("int")).over(w)
    return flagged.select("*", cut.alias("_cut")).where(F.col("_cut") == 0).drop("_cut")


def filter_min_length(seqs: DataFrame, min_len: int = K.SEQ_MIN_LEN) -> DataFrame:
    """Drop sequences with fewer than ``min_len`` rows (adds ``n_messages``)."""
    w = Window.partitionBy(*SEQ_KEY)
    return seqs.withColumn("n_messages", F.count(F.lit(1)).over(w).cast("bigint")) \
        .where(F.col("n_messages") >= min_len)


def relabel_last_speaker(seqs: DataFrame, by: str = "sender") -> DataFrame:
    """Every row by the sequence's last speaker becomes the model (``role='assistant'``).

    ``by='handle'`` compares folded handles instead of raw senders."""
    w = Window.partitionBy(*SEQ_KEY).orderBy("seq_pos") \
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    who = F.col("sender") if by == "sender" else ascii_handle("sender")
    last = F.last(who).over(w)
    return seqs.withColumn("role", F.when(who.eqNullSafe(last), F.lit("assistant")).otherwise(F.lit("user")))


def sequence_turns(seqs: DataFrame) -> DataFrame:
    """Chat turn per row: the model's turns hold ``@<reply> text`` and no name; the
    others are named by handle and hold the message as JSON."""
    user = F.struct(F.lit("user").alias("role"), chat_name("sender").alias("name"),
                    encode_content("id", "hhmm", "sender", "text", "reply_to_message_id").alias("content"))
    bot = F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("name"),
                   reply_prefix_content("text", "reply_to_message_id").alias("content"))
    return seqs.withColumn("turn", F.when(F.col("role") == "assistant", bot).otherwise(user))


def assemble_examples(turns: DataFrame, system_text: str | None = K.SYSTEM_TEXT_V1) -> DataFrame:
    """One training document per sequence: system turn, then the turns in order.

    Output: chat_id, seq_id, n_messages, messages, doc (JSON text, null names omitted).
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq_pos", "turn"))), lambda e: e["turn"])
    if system_text is not None:
        ordered = F.concat(F.array(system_turn(system_text)), ordered)
    ex = turns.groupBy(*SEQ_KEY).agg(F.count(F.lit(1)).cast("bigint").alias("n_messages"),
                                    ordered.cast(f"array<{TURN_TYPE}>").alias("messages"))
    return ex.withColumn("doc", F.to_json(F.struct("messages")))


def build_sequences(msgs: DataFrame, *, length: int = K.SEQ_LEN_V1, min_len: int = K.SEQ_MIN_LEN,
                    max_id_gap: int | None = K.SEQ_MAX_ID_GAP, max_minutes: int | None = K.SEQ_MAX_MINUTES,
                    clock: str = "hhmm", drop_tail: bool = True, scope: str = "chat",
                    relabel_by: str = "sender", order_col: str = "id", dense: bool | None = None) -> DataFrame:
    """messages -> one row per kept sequence message, with seq ids and roles.

    Rows are taken in ``order_col`` order (an integral column: the message id, or an
    ingest position when ids repeat across the chats of a combined history)."""
    m = positions(with_scope(msgs, scope), order_col=order_col, dense=dense)
    m = chunk_fixed(m, length, drop_tail)
    m = prefix_until_break(gap_breaks(m, max_id_gap, max_minutes, clock))
    m = filter_min_length(m, min_len)
    return relabel_last_speaker(m, relabel_by)


def training_examples(msgs: DataFrame, *, system_text: str | None = K.SYSTEM_TEXT_V1, **kw) -> DataFrame:
    """messages -> chat-format training documents (one per sequence)."""
    return assemble_examples(sequence_turns(build_sequences(msgs, **kw)), system_text)


def sequence_stats(msgs: DataFrame, *, length: int = K.SEQ_LEN_V1, min_len: int = K.SEQ_MIN_LEN,
                   max_id_gap: int | None = K.SEQ_MAX_ID_GAP, max_minutes: int | None = K.SEQ_MAX_MINUTES,
                   clock: str = "hhmm", drop_tail: bool = True, scope: str = "chat", order_col: str = "id",
                   dense: bool | None = None) -> DataFrame:
    """Per candidate chunk: how it ended (``full`` / ``id_gap`` / ``time_gap``), kept
    length and whether it was discarded as too short. Aggregated by reason, with the number of
    assistant turns of kept sequences that the byte-compatible recovery can't read back (``n_failed``)."""
    from chatprep.operators.compat import content_recover_compat

    m = chunk_fixed(positions(with_scope(msgs, scope), order_col=order_col, dense=dense), length, drop_tail)
    m = gap_breaks(m, max_id_gap, max_minutes, clock)
    w = Window.partitionBy(*SEQ_KEY).orderBy("seq_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("_cut", F.max((F.col("brk_id") | F.col("brk_time")).cast("int")).over(w))
    # the last speaker of what is kept: these messages become the assistant's
    last = F.max(F.when(F.col("_cut") == 0, F.struct("seq_pos", "sender"))).over(Window.partitionBy(*SEQ_KEY))["sender"]
    spoken = (F.col("_cut") == 0) & F.col("sender").eqNullSafe(F.col("_last"))
    m = m.withColumn("_last", last).withColumn("_failed", spoken & F.when(spoken, content_recover_compat()["failed"]))
    per = m.groupBy(*SEQ_KEY).agg(
        F.sum(1 - F.col("_cut")).cast("bigint").alias("kept"),
        F.count_if("_failed").alias("_n_failed"),
        F.min(F.when(F.col("brk_id"), F.col("seq_pos"))).alias("_first_id"),
        F.min(F.when(F.col("brk_time"), F.col("seq_pos"))).alias("_first_time"))
    reason = F.when(F.col("_first_id").isNull() & F.col("_first_time").isNull(), F.lit("full")) \
        .when(F.col("_first_time").isNull() | (F.col("_first_id") < F.col("_first_time")), F.lit("id_gap")) \
        .otherwise(F.lit("time_gap"))
    per = per.withColumn("end_reason", reason).withColumn("discarded", F.col("kept") < min_len)
    return per.groupBy("end_reason", "discarded").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_sequences"),
        F.sum("kept").cast("bigint").alias("n_messages"),
        F.sum(F.when(F.col("discarded"), 0).otherwise(F.col("_n_failed"))).cast("bigint").alias("n_failed"))


def observe_examples(examples: DataFrame, name: str = "examples"):
    """Attach counters to the examples (documents, messages, shortest and longest
    sequence) that are filled by whatever action runs next (e.g. the JSONL write),
    without an extra job. Returns ``(df, observation)``; read ``observation.get``
    after the action."""
    from pyspark.sql import Observation
    obs = Observation(name)
    df = examples.observe(obs, F.count(F.lit(1)).alias("n_documents"),
                          F.sum("n_messages").cast("bigint").alias("n_messages"),
                          F.min("n_messages").alias("min_messages"), F.max("n_messages").alias("max_messages"))
    return df, obs
