"""Ordered routing rules: the first rule whose predicate holds decides the action.

A rule is a name plus a boolean Column, so user rules are ordinary expressions and
the whole chain compiles to one ``CASE WHEN`` inside whole-stage codegen. Inputs the
rules need from other rows (first message of a chat, author of the replied-to
message) are attached by equi-joins on ``(chat_id, id)``, which spread evenly even
when one chat holds most messages.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatprep import constants as K
from chatprep.functions.hashing import seeded_fraction, seeded_int
from chatprep.functions.records import encode_record_prefix
from chatprep.functions.text import current_hhmm, joke_topic_api, joke_topic_local

NO_ACTION = "none"


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: Column


def _check_boolean(df: DataFrame, rules: Sequence[Rule]) -> None:
    """Reject non-boolean predicates when the plan is analysed, before any data runs."""
    probe = df.select(*[r.predicate.alias(f"_r{i}") for i, r in enumerate(rules)])
    for i, f in enumerate(probe.schema.fields):
        if not isinstance(f.dataType, T.BooleanType):
            raise TypeError(f"rule {rules[i].name!r} must be boolean, got {f.dataType.simpleString()}")


def route_messages(df: DataFrame, rules: Sequence[Rule], gate: Column | None = None,
                   action_col: str = "action") -> DataFrame:
    """Add ``action``: the name of the first matching rule, else ``none``. Rows failing
    ``gate`` (allow-list, staleness) are not routed."""
    _check_boolean(df, rules)
    expr = None
    for r in rules:
        cond = F.coalesce(r.predicate, F.lit(False))
        expr = F.when(cond, F.lit(r.name)) if expr is None else expr.when(cond, F.lit(r.name))
    act = F.lit(NO_ACTION) if expr is None else expr.otherwise(F.lit(NO_ACTION))
    if gate is not None:
        act = F.when(F.coalesce(gate, F.lit(False)), act).otherwise(F.lit(NO_ACTION))
    return df.withColumn(action_col, act)


def route_counts(routed: DataFrame, action_col: str = "action") -> DataFrame:
    return routed.groupBy(action_col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


# ---- inputs of the default rules -----------------------------------------------

def with_first_flag(msgs: DataFrame, order_col: str = "id") -> DataFrame:
    """``is_first``: the message is the first of its chat's whole history."""
    firsts = msgs.groupBy("chat_id").agg(F.min(order_col).alias(order_col)).withColumn("is_first", F.lit(True))
    return msgs.join(firsts, ["chat_id", order_col], "left") \
        .withColumn("is_first", F.coalesce(F.col("is_first"), F.lit(False)))


def join_reply_target(msgs: DataFrame, targets: DataFrame, id_col: str = "id") -> DataFrame:
    """``msgs`` left-joined with ``targets`` (chat_id, _target_id, ...) on the message replied to.

    Messages that are no reply get a key of their own (their id, marked as no reply), which
    meets no target; so they spread over the partitions however many a chat has."""
    is_reply = F.col("reply_to_message_id").isNotNull()
    left = msgs.withColumn("_target_id", F.coalesce("reply_to_message_id", id_col)).withColumn("_is_reply", is_reply)
    right = targets.where(F.col("_target_id").isNotNull()).withColumn("_is_reply", F.lit(True))
    return left.join(right, ["chat_id", "_target_id", "_is_reply"], "left").drop("_target_id", "_is_reply")


def with_reply_author(msgs: DataFrame, author_col: str = "sender_id") -> DataFrame:
    """``reply_author``: ``author_col`` of the replied-to message (null when not a
    reply or the target is unknown). Duplicate ids: the later message wins (ties: the
    larger author)."""
    tgt = msgs.groupBy("chat_id", F.col("id").alias("_target_id")).agg(
        F.max_by(author_col, F.struct("sent_at", author_col)).alias("reply_author"))
    return join_reply_target(msgs, tgt)


# ---- predicates -----------------------------------------------------------------

def is_text() -> Column:
    return F.col("content_type") == F.lit("text")


def match_command(command: str) -> Column:
    """Case-sensitive prefix command on a text message."""
    return is_text() & F.startswith(F.col("text"), F.lit(command))


def match_trigger_phrases(phrases: Sequence[str]) -> Column:
    low = F.lower(F.col("text"))
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(low, F.lit(p))
    return is_text() & hit


def match_random(p: float, seed: int = 42) -> Column:
    return seeded_fraction(seed, "chat_id", "id") < F.lit(p)


def match_reply_to_bot(bot_id) -> Column:
    b = bot_id if isinstance(bot_id, Column) else F.lit(bot_id)
    return is_text() & F.col("reply_to_message_id").isNotNull() & (F.col("reply_author") == b)


def default_rules(variant: str = "api", *, bot_id: int = 0, seed: int = 42,
                  trigger_phrases: Sequence[str] | None = None, probability: float | None = None,
                  context_nonempty: Column | None = None) -> list[Rule]:
    """The bot's handler order: intro, help, joke, random, trigger, reply-to-bot.

    The random reply needs a non-empty context: pass ``context_nonempty`` (e.g.
    ``context.fits_budget(max_tokens)``); without it every context counts as non-empty."""
    phrases = trigger_phrases or (K.TRIGGERS_API if variant == "api" else K.TRIGGERS_LOCAL)
    p = probability if probability is not None else (K.PROB_API if variant == "api" else K.PROB_LOCAL)
    rand = match_random(p, seed) if context_nonempty is None else (match_random(p, seed) & context_nonempty)
    return [
        Rule("intro", F.col("is_first")),
        Rule("help", match_command(K.CMD_HELP)),
        Rule("joke", match_command(K.CMD_JOKE)),
        Rule("random", rand),
        Rule("trigger", match_trigger_phrases(phrases)),
        Rule("reply_to_bot", match_reply_to_bot(bot_id)),
    ]


def allow_list_semi(msgs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Messages of the chats in the table ``allowed`` (chat_id); Spark picks the join by its size."""
    return msgs.join(allowed.select("chat_id").distinct(), "chat_id", "left_semi")


def default_gate(allowed_chats: Sequence[int] | None = None, start_unix: int | None = None) -> Column | None:
    g = None
    if allowed_chats is not None:
        g = F.col("chat_id").isin(list(allowed_chats))
    if start_unix is not None:
        s = F.col("date") >= F.lit(start_unix)
        g = s if g is None else (g & s)
    return g


# ---- what to send ----------------------------------------------------------------

def command_prompt(variant: str = "api", seed: int = 42, bot_name: str = K.BOT_NAME_LOCAL,
                   clock: Column | None = None) -> Column:
    """Joke command prompt. API head: a system instruction with the words after the
    command; local head: an open record for the bot (message id, ``clock`` or the
    current time, bot name), then an opener (seeded choice), the topic and a joke
    beginning."""
    if variant == "api":
        topic = joke_topic_api(F.col("text"))
        return F.when(topic.isNull(), F.lit(K.JOKE_RANDOM_PROMPT)) \
            .otherwise(F.concat(F.lit(K.JOKE_TOPIC_PROMPT), topic))
    openers = F.array(*[F.lit(o) for o in K.JOKE_OPENERS])
    begins = F.array(*[F.lit(b) for b in K.JOKE_BEGINS])
    opener = F.element_at(openers, (seeded_int(seed, 1, len(K.JOKE_OPENERS), "chat_id", "id", F.lit("o"))).cast("int"))
    begin = F.element_at(begins, (seeded_int(seed, 1, len(K.JOKE_BEGINS), "chat_id", "id", F.lit("b"))).cast("int"))
    topic = joke_topic_local(F.col("text"))
    part1 = F.concat(opener, F.when(topic.isNotNull(), F.concat(F.lit(" aiheesta '"), topic, F.lit("'")))
                     .otherwise(F.lit("")), F.lit(": "))
    head = encode_record_prefix(F.col("id"), clock if clock is not None else current_hhmm(), F.lit(bot_name))
    return F.concat(head, part1, begin)


def response_plan(routed: DataFrame, variant: str = "api") -> DataFrame:
    """Per routed message: fixed text or prompt kind, and the message it replies to.

    help and joke reply to the triggering message; trigger replies to the id the
    model names (known only from the response); intro, random and reply-to-bot send
    without a target."""
    a = F.col("action")
    help_text = K.HELP_TEXT_API if variant == "api" else K.HELP_TEXT_LOCAL
    fixed = F.when(a == "intro", F.lit(K.INTRO_TEXT)).when(a == "help", F.lit(help_text))
    kind = F.when(a.isin("intro", "help"), F.lit("fixed")).when(a == "joke", F.lit("joke_prompt")) \
        .otherwise(F.lit("context_prompt"))
    target = F.when(a.isin("help", "joke"), F.col("id"))
    return routed.where(a != NO_ACTION).select(
        "chat_id", "id", "action", kind.alias("kind"), fixed.alias("fixed_text"),
        F.when(a == "joke", command_prompt(variant)).alias("instruction"),
        target.cast("bigint").alias("reply_to_message_id"))
