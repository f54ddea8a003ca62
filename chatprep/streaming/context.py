"""Per-chat bounded context as keyed streaming state.

The state of a chat is its current context: the newest messages whose lengths sum
to at most the budget (ids, lengths and an optional rendered payload), plus
whether the chat has been seen. Each arrival is appended and the oldest messages
are dropped until the budget holds, exactly as the batch
``context_at_each_message`` computes it. State never grows past the budget. Rows
of one micro-batch may arrive unordered and are sorted by id per chat first.
Seed rows (``_seed``) fill the state from stored history and are not emitted.
A budget may depend on the arrival (the open record of a delimited prompt grows with
its id); a message once dropped never returns.

The arrivals of a chat in one micro-batch are held at once, so a long backlog must come in many:
files in the order of their ids (``sources.sinks.land_arrivals``) and ``max_files_per_trigger``.
"""

from __future__ import annotations

import sys

import uuid
import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from chatprep import constants as K
from chatprep.functions.chat import system_turn
from chatprep.functions.records import encode_record, encode_record_prefix
from chatprep.functions.text import current_hhmm
from chatprep.operators import routing as R
from chatprep.operators.context import MODEL_ACTIONS
from chatprep.session import scratch_path
from chatprep.sources.sinks import LOG_BUCKETS, log_bucket

#: Arrivals whose contexts are built and sent on at once.
OUT_ROWS = 4096

# Python workers need not have this package installed: its UDF code travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONTEXT_OUT = T.StructType([
    T.StructField("chat_id", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("n_context", T.LongType()),
    T.StructField("context_chars", T.LongType()),
    T.StructField("context_start_id", T.LongType()),
    T.StructField("is_first", T.BooleanType()),
    T.StructField("tag", T.StringType()),
    T.StructField("instruction", T.StringType()),
    T.StructField("context", T.ArrayType(T.StringType())),
])
_STATE = T.StructType([
    T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("lens", T.ArrayType(T.LongType())),
    T.StructField("payloads", T.ArrayType(T.StringType())),
    T.StructField("seen", T.BooleanType()),
])


def _context_updater():
    """State update for one chat and one micro-batch, vectorised: with the state's
    messages followed by the batch (sorted by id), P = running length and Q = P - len,
    the context after message i starts at the first j with Q_j >= P_i - budget_i
    (``searchsorted`` on the increasing Q), or where an earlier one started, if that is
    later. The new state is the context after the last message."""
    def update(key, pdfs, state):
        if state.exists:
            s_ids, s_lens, s_pays, seen = state.get
        else:
            s_ids, s_lens, s_pays, seen = [], [], [], False
        frames = [p for p in pdfs if len(p)]
        if not frames:
            yield pd.DataFrame([], columns=CONTEXT_OUT.fieldNames())
            return
        batch = pd.concat(frames, ignore_index=True).sort_values("_oid", kind="stable")
        k = len(s_ids or [])
        ids = np.concatenate([np.asarray(s_ids or [], dtype=np.int64), batch["_oid"].to_numpy(dtype=np.int64)])
        lens = np.concatenate([np.asarray(s_lens or [], dtype=np.int64), batch["_len"].to_numpy(dtype=np.int64)])
        pays = list(s_pays or []) + list(batch["_payload"])
        P = np.cumsum(lens)
        Q = P - lens
        new = slice(k, len(ids))
        i = np.arange(len(ids))[new]
        # first j with Q_j >= P_i - budget_i, and never before the start of an earlier message
        first_kept = np.searchsorted(Q, P[new] - batch["_budget"].to_numpy(dtype=np.int64), side="left")
        starts = np.maximum.accumulate(np.minimum(first_kept, i + 1))
        ns = i - starts + 1
        chars = np.where(ns > 0, P[new] - Q[np.minimum(starts, len(ids) - 1)], 0)
        out = ~batch["_seed"].to_numpy(dtype=bool)
        want = batch["_want"].to_numpy(dtype=bool)
        tags, instructions = batch["_tag"].to_numpy(), batch["_instruction"].to_numpy()
        del batch, frames
        last = int(starts[-1])
        state.update((ids[last:].tolist(), lens[last:].tolist(), pays[last:], True))
        rows = np.flatnonzero(out)
        for at in range(0, len(rows), OUT_ROWS):  # a message stands in many contexts, which go in pieces
            r = rows[at:at + OUT_ROWS]
            yield pd.DataFrame({
                "chat_id": key[0], "id": ids[k + r], "n_context": ns[r], "context_chars": chars[r],
                "context_start_id": [int(ids[j]) if c > 0 else None for j, c in zip(starts[r], ns[r])],
                "is_first": (r == 0) & (not seen), "tag": tags[r], "instruction": instructions[r],
                "context": [pays[j:k + x + 1] if (want[x] and ns[x] > 0) else [] for j, x in zip(starts[r], r)],
            })
    return update


def stream_context(stream: DataFrame, budget_chars: int | Column, length: Column, *, payload: Column | None = None,
                   want: Column | None = None, tag: Column | None = None, seed: Column | None = None,
                   order_col: str = "id", instruction: Column | None = None) -> DataFrame:
    """Context after every arrival: ``n_context``, ``context_chars``,
    ``context_start_id``, ``is_first`` (first message of the chat ever seen) and,
    where ``want`` holds, the kept payloads in order. ``budget_chars`` is a number or a
    column of the arrival. ``tag`` and ``instruction`` are carried through."""
    x = stream.select(
        F.col("chat_id"), F.col(order_col).cast("bigint").alias("_oid"), length.cast("bigint").alias("_len"),
        (payload if payload is not None else F.lit(None)).cast("string").alias("_payload"),
        (seed if seed is not None else F.lit(False)).alias("_seed"),
        (want if want is not None else F.lit(False)).alias("_want"),
        (tag if tag is not None else F.lit(None)).cast("string").alias("_tag"),
        (instruction if instruction is not None else F.lit(None)).cast("string").alias("_instruction"),
        (budget_chars if isinstance(budget_chars, Column) else F.lit(int(budget_chars))).cast("bigint").alias("_budget"))
    return x.groupBy("chat_id").applyInPandasWithState(
        _context_updater(), CONTEXT_OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def stream_route(stream: DataFrame, budget_chars: int | Column, length: Column, rules_after_intro, *,
                 payload: Column | None = None, want_actions=MODEL_ACTIONS, seed: Column | None = None,
                 gate: Column | None = None, instruction: Column | None = None) -> DataFrame:
    """Routing per arrival: the stateless rules run on the stream; the first-message
    rule needs state and is decided by ``stream_context``. The reply author comes
    with the live record (``reply_to_sender_id``). Every arrival enters the context;
    ``gate`` (allow-list, staleness) only decides whether it is routed.
    ``instruction`` (``routing.command_prompt``) is kept for jokes."""
    pre = R.route_messages(stream.withColumn("reply_author", F.col("reply_to_sender_id")), rules_after_intro,
                           action_col="_pre")
    gated = F.lit(True) if gate is None else F.coalesce(gate, F.lit(False))
    pre = pre.withColumn("_pre", F.when(gated, F.col("_pre")).otherwise(F.lit("blocked")))
    want = F.col("_pre").isin(*want_actions)
    ctx = stream_context(pre, budget_chars, length, payload=payload, want=want, tag=F.col("_pre"), seed=seed,
                         instruction=None if instruction is None else F.when(F.col("_pre") == "joke", instruction))
    act = F.when(F.col("tag") == "blocked", F.lit(R.NO_ACTION)).when(F.col("is_first"), F.lit("intro")) \
        .otherwise(F.col("tag"))
    return ctx.withColumn("action", act)


def _to_model(routed: DataFrame) -> DataFrame:
    """Arrivals that need the model; jokes only if they were routed with an instruction."""
    a = F.col("action")
    return routed.where(a.isin(*MODEL_ACTIONS) & ((a != "joke") | F.col("instruction").isNotNull()))


def stream_prompts(routed: DataFrame, system_json: str | None) -> DataFrame:
    """Chat prompt text for every routed arrival that needs the model: the system turn, the turns
    of its context and, for a joke, a system turn with the instruction."""
    last = F.when(F.col("action") == "joke", F.to_json(system_turn(F.col("instruction"))))
    lead = F.array(F.lit(system_json)) if system_json else F.array().cast("array<string>")
    turns = F.concat(lead, F.col("context"), F.array_compact(F.array(last)))
    prompt = F.concat(F.lit('{"messages":['), F.array_join(turns, ","), F.lit("]}"))
    return _to_model(routed).select("chat_id", "id", "action", prompt.alias("prompt"))


def record_budget(budget_chars: int, pre_prompt: str, bot_name: str = K.BOT_NAME_LOCAL, id_col: str = "id") -> Column:
    """Characters left for the records of a delimited prompt of at most ``budget_chars``, after the
    preamble and the open record of the bot, whose id follows the arrival's."""
    fixed = len(pre_prompt) + len(K.BEGIN_MSG + 3 * K.SEP + bot_name) + len("00:00")
    return F.lit(budget_chars - fixed) - F.length((F.col(id_col) + 1).cast("string"))


def record_payload() -> Column:
    """A message's record and line break, as delimited prompts hold it."""
    return F.concat(encode_record("id", "hhmm", "sender", "text", "reply_to_message_id"), F.lit("\n"))


def stream_delimited_prompts(routed: DataFrame, pre_prompt: str, bot_name: str = K.BOT_NAME_LOCAL,
                             clock: Column | None = None) -> DataFrame:
    """Delimited prompt for every routed arrival that needs the model: preamble, the records of its
    context (``record_payload``), and an open record of the bot with the id after the arrival's.
    A joke's prompt is its instruction alone (``routing.command_prompt("local")``), as the local head
    asks for jokes without the context. ``stream_route`` with ``record_budget`` keeps the whole prompt within
    a budget."""
    open_record = encode_record_prefix(F.col("id") + 1, clock if clock is not None else current_hhmm(), F.lit(bot_name))
    prompt = F.when(F.col("action") == "joke", F.col("instruction")) \
        .otherwise(F.concat(F.lit(pre_prompt), F.array_join("context", ""), open_record))
    return _to_model(routed).select("chat_id", "id", "action", prompt.alias("prompt"))


def stream_append(stream: DataFrame, path: str, checkpoint: str, buckets: int = LOG_BUCKETS):
    """Durable message log (parquet, append) with a recovery checkpoint, in folders by a hash of
    the chat; ``sources.sinks.read_log`` reads it."""
    return stream.withColumn("log_bucket", log_bucket(buckets)).writeStream.format("parquet") \
        .option("path", path).option("checkpointLocation", checkpoint).partitionBy("log_bucket").outputMode("append")


def finish(query) -> None:
    """Waits for a query with an ``availableNow`` trigger; raises if it failed."""
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def run_available_now(stream: DataFrame, name: str, run: str | None = None) -> str:
    """Run a streaming query over everything available, write it to a parquet sink in
    the shared scratch folder and return the sink path. A query with the ``run`` of an
    earlier one goes on from its checkpoint, state included."""
    spark = stream.sparkSession
    run = run or uuid.uuid4().hex[:12]
    out = scratch_path(spark, "streams", name, run, "out")
    ck = scratch_path(spark, "streams", name, run, "checkpoint")
    finish(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
           .outputMode("append").trigger(availableNow=True).start())
    return out
