"""Bounded per-chat context: last N, budget trimming, and the context as of every message.

The live bot keeps, per chat, the newest messages whose rendered prompt fits a
budget. As of message r that is the longest suffix of the history up to r whose
rendered lengths sum to at most the budget B (a dropped message never returns,
because lengths are positive). With P the running length and Q = P - len, the
context of r is every e <= r with Q_e >= P_r - B.

Lengths must be positive (every rendered message has at least its separators).

Scale: P comes from the blocked numbering (no whole-chat window). The oldest kept
message is an as-of lookup (first e with Q_e >= P_r - B), done per bucket of width
B with a running minimum; when the kept messages themselves are needed, a range
window per ``(chat, bucket)`` collects them, a group of at most 2B/min_len rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatprep import constants as K
from chatprep.functions.chat import encode_chat_turn, system_turn, turn_json_length
from chatprep.functions.records import encode_record, encode_record_prefix
from chatprep.functions.text import ascii_handle, current_hhmm
from chatprep.operators.positions import BLOCK_WIDTH, number_rows

PROMPT_OVERHEAD = 16  # '{"messages": [' + ']}'
TURN_SEPARATOR = 2    # ', '
# the shortest rendered chat turn, '{"role": "assistant", "content": ""}', plus its separator
MIN_CHAT_TURN_CHARS = 36 + TURN_SEPARATOR


def last_n_per_chat(msgs: DataFrame, n: int = K.CONTEXT_INIT_ROWS, order_col: str = "id") -> DataFrame:
    """The newest ``n`` messages of every chat (``rn`` = 1 for the newest), by an order column of
    any orderable type; rows whose order is null come after all others, ties in any order.

    Up to the optimizer's group-limit threshold, ``row_number() <= n`` is planned with
    a partial group limit before the exchange, so a huge chat sends at most n rows per
    input partition to the final window. Beyond it, ranges of (chat, order) are numbered
    instead, by the same order, without a whole-chat window."""
    limit = int(msgs.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    newest = F.col(order_col).desc_nulls_last()
    if n <= limit:
        w = Window.partitionBy("chat_id").orderBy(newest)
        return msgs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    ranked = number_rows(msgs, ["chat_id"], [newest], block_col=order_col, pos_col="_rpos", dense=False)
    return ranked.where(F.col("_rpos") < n).withColumn("rn", (F.col("_rpos") + 1).cast("int")).drop("_rpos")


def _json_literal_length(c: Column) -> Column:
    """Length of a string written as a JSON string literal (quotes and escapes)."""
    return F.length(F.to_json(F.array(c))).cast("bigint") - F.lit(2)


def chat_turn_length(bot_name: str = K.BOT_NAME_API) -> Column:
    """Rendered length of a message's chat turn plus its separator, measured piece by
    piece (each JSON literal once, the handle once) instead of rendering the turn.

    Equal to ``turn_json_length(encode_chat_turn(...)) + 2`` for non-null texts."""
    from chatprep.functions.chat import encode_content
    bot_names = [F.lit(a) for a in K.BOT_ALIASES] + [ascii_handle(F.lit(bot_name))]
    content = encode_content("id", "hhmm", "sender", "text", "reply_to_message_id")

    def measure(handle: Column) -> Column:
        name = F.coalesce(F.nullif(handle, F.lit("")), F.lit(K.DEFAULT_SENDER))
        # '{"role":"assistant","content":' + text + '}' (+3 for the spaced form)
        bot_len = F.lit(30 + 1 + 3) + _json_literal_length(F.col("text"))
        # '{"role":"user","name":' + name + ',"content":' + content + '}' (+5)
        user_len = F.lit(22 + 11 + 1 + 5) + _json_literal_length(name) + _json_literal_length(content)
        return F.when(handle.isin(*bot_names), bot_len).otherwise(user_len) + F.lit(TURN_SEPARATOR)

    return F.get(F.transform(F.array(ascii_handle("sender")), measure), 0)


def fits_budget(max_tokens: int = K.TOKEN_BUDGET_APP, bot_name: str = K.BOT_NAME_API,
                pre_prompt: str | None = K.CHAT_PRE_PROMPT) -> Column:
    """The message alone fits the prompt budget, i.e. the chat's context is not empty
    right after it arrives (the newest message is kept exactly when it fits)."""
    return chat_turn_length(bot_name) <= F.lit(chat_budget_chars(max_tokens, pre_prompt))


def chat_budget_chars(max_tokens: int, pre_prompt: str | None = K.CHAT_PRE_PROMPT) -> int:
    """Characters left for message turns: tokens are characters div 3, so a prompt
    fits while its length is at most 3 * max_tokens + 2."""
    import json
    limit = K.CHARS_PER_TOKEN * max_tokens + (K.CHARS_PER_TOKEN - 1)
    fixed = PROMPT_OVERHEAD
    if pre_prompt is not None:
        fixed += len(json.dumps({"role": "system", "content": pre_prompt}, ensure_ascii=False))
    else:
        fixed -= TURN_SEPARATOR  # the first message turn has no separator before it
    return limit - fixed


def context_budget(msgs: DataFrame, length: Column, budget_chars: int, last_n: int | None = None,
                   order_col: str = "id", min_length: int = 1) -> DataFrame:
    """Current context per chat: of the newest ``last_n`` messages (all when None),
    keep the newest ones whose lengths sum to at most ``budget_chars``.

    Every length is at least ``min_length`` (>= 1), so no more than
    ``budget_chars // min_length`` messages can fit: that exact bound limits the
    candidates per chat, and the suffix sums run over the bounded remainder."""
    m = msgs.withColumn("_len", length.cast("bigint"))
    fit = max(budget_chars, 0) // max(min_length, 1)
    n = fit if last_n is None else min(last_n, fit)
    m = last_n_per_chat(m, max(n, 1), order_col)
    # at most n rows per chat remain: a plain window over them is bounded
    w = Window.partitionBy("chat_id").orderBy(F.col(order_col).desc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("suffix_chars", F.sum("_len").over(w)).drop("rn")
    return m.where(F.col("suffix_chars") <= budget_chars).drop("_len")


def context_at_each_message(msgs: DataFrame, length: Column, budget_chars: int, *,
                            payload: Column | None = None, order_col: str = "id",
                            width: int = BLOCK_WIDTH, wanted: Column | None = None,
                            dense: bool | None = None) -> DataFrame:
    """Per message (anchor): the context the live path holds right after it arrives.

    Output: the anchor's columns plus ``n_context`` (messages kept), ``context_chars``
    (their length sum), ``context_start_id`` and, with ``payload``, ``context``: the
    payload values of the kept messages in order. ``wanted`` limits the anchors (every
    message still counts as a member), and only they collect payloads.
    """
    B = int(budget_chars)
    if B <= 0:
        # the fixed part of the prompt alone exceeds the budget: every context is empty
        empty = {"n_context": F.lit(0).cast("bigint"), "context_chars": F.lit(0).cast("bigint"),
                 "context_start_id": F.lit(None).cast("bigint")}
        if payload is not None:
            item_type = msgs.select(payload.alias("_p")).schema["_p"].dataType
            empty["context"] = F.array().cast(T.ArrayType(item_type))
        return (msgs if wanted is None else msgs.where(wanted)).withColumns(empty)
    m = msgs.withColumn("_len", length.cast("bigint"))
    m = number_rows(m, ["chat_id"], [order_col, "sent_at"], block_col=order_col,
                    width=width, dense=dense, sums={"_P": F.col("_len")})
    m = m.withColumn("_Q", F.col("_P") - F.col("_len"))
    if payload is None:
        return _context_counts(m, B, order_col, wanted)
    if wanted is not None:
        return _wanted_items(m, B, payload, order_col, wanted)
    return _context_items(m, B, payload, order_col)


def _context_counts(m: DataFrame, B: int, order_col: str, wanted: Column | None = None) -> DataFrame:
    """Counts only, as an as-of lookup: the oldest kept message of anchor r is the
    first message e with Q_e >= P_r - B. Anchors (key P - B) and messages (key Q)
    meet in buckets of width B; a running minimum over keys in descending order
    finds it in O(1) per row after the sort (no sliding frame)."""
    cols = [c for c in m.columns if c not in ("_len", "_P", "_Q")]
    anchor_key = F.col("_P") - B
    anchors = (m if wanted is None else m.where(wanted)).select(
        "chat_id", F.floor(anchor_key / B).cast("bigint").alias("_bk"), anchor_key.alias("_key"),
        F.lit(0).alias("_tag"), F.struct(*cols, "_P").alias("_row"),
        F.lit(None).cast("struct<pos:bigint,q:bigint,oid:bigint>").alias("_m"))
    home = F.floor(F.col("_Q") / B).cast("bigint")
    members = m.select(
        "chat_id", F.explode(F.array(home, home - 1)).alias("_bk"), F.col("_Q").alias("_key"),
        F.lit(1).alias("_tag"), F.lit(None).cast(anchors.schema["_row"].dataType).alias("_row"),
        F.struct(F.col("pos").alias("pos"), F.col("_Q").alias("q"), F.col(order_col).cast("bigint").alias("oid"))
        .alias("_m"))
    w = Window.partitionBy("chat_id", "_bk").orderBy(F.col("_key").desc(), F.col("_tag").desc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = anchors.unionByName(members).withColumn("_first", F.min("_m").over(w)).where(F.col("_tag") == 0)
    n = F.col("_row.pos") - F.col("_first.pos") + 1
    ok = F.col("_first").isNotNull() & (F.col("_first.pos") <= F.col("_row.pos"))
    return u.select(
        *[F.col(f"_row.{c}").alias(c) for c in cols],
        F.when(ok, n).otherwise(F.lit(0)).cast("bigint").alias("n_context"),
        F.when(ok, F.col("_row._P") - F.col("_first.q")).otherwise(F.lit(0)).cast("bigint").alias("context_chars"),
        F.when(ok, F.col("_first.oid")).alias("context_start_id"))


def _wanted_items(m: DataFrame, B: int, payload: Column, order_col: str, wanted: Column) -> DataFrame:
    """Kept payloads of the wanted anchors. The messages that an anchor keeps have Q in (Q_r - B, Q_r],
    so they lie in its bucket of width B or the one before: each message goes to both, and anchors and
    members meet in one shuffle on (chat, bucket), in groups of at most 2B/min_length rows."""
    cols = [c for c in m.columns if c not in ("_len", "_P", "_Q", "pos")]
    home = F.floor(F.col("_Q") / B).cast("bigint")
    anchor = F.when(F.coalesce(wanted, F.lit(False)), F.struct(*cols, "_P", "pos"))
    rows = m.select("chat_id", "pos", F.col("_Q").alias("q"), F.col(order_col).cast("bigint").alias("oid"),
                    payload.alias("payload"), anchor.alias("_anchor"), home.alias("_home"))
    rows = rows.withColumn("_bk", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
    own = F.when(F.col("_home") == F.col("_bk"), F.col("_anchor"))  # null elsewhere: not collected
    groups = rows.groupBy("chat_id", "_bk").agg(
        F.sort_array(F.collect_list(F.struct("pos", "q", "oid", "payload"))).alias("_items"),
        F.collect_list(own).alias("_anchors")).where(F.size("_anchors") > 0)
    met = groups.select("_items", F.explode("_anchors").alias("_a"))
    kept = F.filter("_items", lambda e: (e["q"] >= F.col("_a._P") - B) & (e["pos"] <= F.col("_a.pos")))
    out = met.select(*[F.col(f"_a.{c}").alias(c) for c in cols], F.col("_a._P").alias("_P"), kept.alias("_kept"))
    some = F.size("_kept") > 0
    return out.select(
        *cols, F.size("_kept").cast("bigint").alias("n_context"),
        F.when(some, F.col("_P") - F.get("_kept", 0)["q"]).otherwise(F.lit(0)).cast("bigint").alias("context_chars"),
        F.get("_kept", 0)["oid"].alias("context_start_id"),
        F.transform("_kept", lambda e: e["payload"]).alias("context"))


def _context_items(m: DataFrame, B: int, payload: Column, order_col: str) -> DataFrame:
    """Kept payloads per anchor: a range window over the anchor's bucket and the one
    before (each row is copied into both), bounded by the budget."""
    m = m.withColumn("_bk", F.floor(F.col("_P") / B).cast("bigint"))
    item = [F.col("_Q").alias("q"), F.col("pos").alias("pos"), F.col(order_col).alias("oid"),
            payload.alias("payload")]
    m = m.withColumn("_item", F.struct(*item))
    copies = m.withColumn("_mb", F.explode(F.array(F.col("_bk"), F.col("_bk") + 1)))
    w = Window.partitionBy("chat_id", "_mb").orderBy("_P").rangeBetween(-B, 0)
    anchors = copies.withColumn("_ctx", F.collect_list("_item").over(w)).where(F.col("_mb") == F.col("_bk"))
    kept = F.array_sort(F.filter("_ctx", lambda e: e["q"] >= F.col("_P") - B))  # by q: oldest first
    out = anchors.withColumn("_kept", kept) \
        .withColumn("n_context", F.size("_kept").cast("bigint")) \
        .withColumn("context_chars", F.when(F.size("_kept") > 0, F.col("_P") - F.get("_kept", 0)["q"])
                    .otherwise(F.lit(0)).cast("bigint")) \
        .withColumn("context_start_id", F.get("_kept", 0)["oid"]) \
        .withColumn("context", F.transform("_kept", lambda e: e["payload"]))
    return out.drop("_len", "_P", "_Q", "_bk", "_item", "_mb", "_ctx", "_kept")


def chat_prompt_json(turns: Column, pre_prompt: str | None = K.CHAT_PRE_PROMPT,
                     post_prompt: str | None = None) -> Column:
    """``{"messages": [...]}`` text: optional system preamble, the turns, optional
    trailing system turn (only when non-empty)."""
    arr = turns
    if pre_prompt is not None:
        arr = F.concat(F.array(system_turn(pre_prompt)), arr)
    if post_prompt:
        arr = F.concat(arr, F.array(system_turn(post_prompt)))
    return F.to_json(F.struct(arr.alias("messages")))


def chat_prompts_at_each_message(msgs: DataFrame, max_tokens: int = K.TOKEN_BUDGET_APP,
                                 bot_name: str = K.BOT_NAME_API,
                                 pre_prompt: str | None = K.CHAT_PRE_PROMPT,
                                 turn: Column | None = None, length: Column | None = None) -> DataFrame:
    """Chat prompt per message as the API head would send it after that message.

    ``turn`` (a struct<role,name,content> Column) and ``length`` replace the default
    turn renderer and its measured length (a custom renderer / token count)."""
    if length is None:
        length = chat_turn_length(bot_name) if turn is None else turn_json_length(turn) + F.lit(TURN_SEPARATOR)
    turn = turn if turn is not None else encode_chat_turn("id", "hhmm", "sender", "text", "reply_to_message_id",
                                                          bot_name)
    c = context_at_each_message(msgs, length, chat_budget_chars(max_tokens, pre_prompt), payload=turn)
    return c.withColumn("prompt", chat_prompt_json(F.col("context"), pre_prompt)).drop("context")


def current_chat_prompts(msgs: DataFrame, max_tokens: int = K.TOKEN_BUDGET_APP, bot_name: str = K.BOT_NAME_API,
                         pre_prompt: str | None = K.CHAT_PRE_PROMPT) -> DataFrame:
    """(chat_id, n_turns, n_tokens, prompt): the chat prompt of each chat as it stands now, and its
    size as the budget measures it. Chats whose newest message alone is too long have no row."""
    import json
    turn = encode_chat_turn("id", "hhmm", "sender", "text", "reply_to_message_id", bot_name)
    cur = context_budget(msgs.withColumn("turn", turn), chat_turn_length(bot_name), chat_budget_chars(max_tokens, pre_prompt),
                         min_length=MIN_CHAT_TURN_CHARS)
    turns = F.transform(F.array_sort(F.collect_list(F.struct("id", "turn"))), lambda e: e["turn"])
    fixed = PROMPT_OVERHEAD if pre_prompt is None else PROMPT_OVERHEAD + len(
        json.dumps({"role": "system", "content": pre_prompt}, ensure_ascii=False))
    g = cur.groupBy("chat_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_turns"), turns.alias("turns"),
                                   ((F.lit(fixed) + F.max("suffix_chars")) / K.CHARS_PER_TOKEN).cast("bigint").alias("n_tokens"))
    return g.select("chat_id", "n_turns", "n_tokens", chat_prompt_json(F.col("turns"), pre_prompt).alias("prompt"))


def next_message_id(msgs: DataFrame) -> DataFrame:
    """(chat_id, next_id): the id that the next message of each chat would get."""
    return msgs.groupBy("chat_id").agg((F.max("id") + 1).alias("next_id"))


def context_prompts(msgs: DataFrame, pre_prompt: str, bot_name: str = K.BOT_NAME_LOCAL, clock: Column | None = None,
                    budget_chars: int | None = None, last_n: int | None = None) -> DataFrame:
    """(chat_id, prompt): the delimited prompt of each chat: preamble, the newest records, and an
    open record for the bot with the chat's next id.

    ``budget_chars`` bounds the preamble, records and open record together, as the local head's
    budget does; the newest records that fit stay. ``last_n`` bounds their number (both None: all)."""
    rec = F.concat(encode_record("id", "hhmm", "sender", "text", "reply_to_message_id"), F.lit("\n"))
    clock = clock if clock is not None else current_hhmm()
    open_record = lambda i: encode_record_prefix(i, clock, F.lit(bot_name))
    m = msgs.withColumn("_rec", rec)
    if budget_chars is not None:
        # the open record is longest for the largest id there can be
        spare = budget_chars - len(pre_prompt) - len(K.BEGIN_MSG + 3 * K.SEP + bot_name) - 5 - 19
        kept = context_budget(m, F.length("_rec"), spare, last_n, min_length=len(K.BEGIN_MSG + 4 * K.SEP + K.END_MSG) + 1)
    else:
        kept = m if last_n is None else last_n_per_chat(m, last_n)
    body = F.transform(F.array_sort(F.collect_list(F.struct("id", "_rec"))), lambda e: e["_rec"])
    g = next_message_id(msgs).join(kept.groupBy("chat_id").agg(F.array_join(body, "").alias("_body")), "chat_id", "left")
    return g.select("chat_id", F.concat(F.lit(pre_prompt), F.coalesce("_body", F.lit("")), open_record(F.col("next_id")))
                    .alias("prompt"))


MODEL_ACTIONS = ("joke", "random", "trigger", "reply_to_bot")


def response_prompts(routed: DataFrame, max_tokens: int = K.TOKEN_BUDGET_APP, bot_name: str = K.BOT_NAME_API,
                     pre_prompt: str | None = K.CHAT_PRE_PROMPT, instruction: Column | None = None,
                     turn: Column | None = None, length: Column | None = None) -> DataFrame:
    """Prompt text for every routed message that needs the model: the chat prompt of
    the context as of that message; for ``joke`` a trailing system turn holds the
    ``instruction`` (the API head's joke request). ``turn`` / ``length`` override the
    turn renderer and its measured length."""
    import json
    if length is None:
        length = chat_turn_length(bot_name) if turn is None else turn_json_length(turn) + F.lit(TURN_SEPARATOR)
    turn = turn if turn is not None else encode_chat_turn("id", "hhmm", "sender", "text", "reply_to_message_id",
                                                          bot_name)
    c = context_at_each_message(routed, length, chat_budget_chars(max_tokens, pre_prompt),
                                payload=F.to_json(turn), wanted=F.col("action").isin(*MODEL_ACTIONS))
    head = '{"messages":['
    if pre_prompt is not None:
        head += json.dumps({"role": "system", "content": pre_prompt}, ensure_ascii=False, separators=(",", ":"))
    body = F.array_join(F.col("context"), ",")
    sep = F.when((F.size("context") > 0) & F.lit(pre_prompt is not None), F.lit(",")).otherwise(F.lit(""))
    tail = F.lit("")
    if instruction is not None:
        sys_turn = F.to_json(system_turn(instruction))
        lead = F.when((F.size("context") > 0) | F.lit(pre_prompt is not None), F.lit(",")).otherwise(F.lit(""))
        tail = F.when(F.col("action") == "joke", F.concat(lead, sys_turn)).otherwise(F.lit(""))
    prompt = F.concat(F.lit(head), sep, body, tail, F.lit("]}"))
    return c.select("chat_id", "id", "action", prompt.alias("prompt"))
