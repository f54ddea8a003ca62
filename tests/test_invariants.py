"""Invariants of the outputs and one test per decided reference defect."""

import json

from pyspark.sql import functions as F

from chatprep import constants as K
from chatprep.functions.chat import encode_chat_turn, turn_json_length
from chatprep.operators import context as C
from chatprep.operators import routing as R
from chatprep.operators import segments as G
from chatprep.operators import sequences as S
from chatprep.operators import splits as P
from chatprep.sources.tables import messages_from_conversations, messages_from_events

from .conftest import SF001, messages_df


def test_examples_shape(spark):
    ex = S.training_examples(messages_from_events(spark, SF001, None), length=15)
    for r in ex.select("n_messages", "doc").collect():
        msgs = json.loads(r.doc)["messages"]
        assert msgs[0] == {"role": "system", "content": K.SYSTEM_TEXT_V1}
        assert msgs[-1]["role"] == "assistant" and "name" not in msgs[-1]
        assert 10 <= r.n_messages <= 15 and len(msgs) == r.n_messages + 1


def test_split_disjoint_complete(spark):
    ex = S.build_sequences(messages_from_events(spark, SF001, None), length=15).select("chat_id", "seq_id").distinct()
    sp = P.split_random(ex, ["chat_id", "seq_id"], 0.2)
    counts = {r.split: r["count"] for r in sp.groupBy("split").count().collect()}
    n = ex.count()
    assert counts["validation"] == int(n * 0.2) and counts["train"] + counts["validation"] == n
    assert sp.select("chat_id", "seq_id").distinct().count() == n


def test_chat_prompt_fits_budget_exactly(spark):
    """Measured as the original does (Python JSON text, characters div 3): the kept
    context fits, and one more older message would not."""
    max_tokens = 400
    m = messages_from_conversations(spark, SF001)
    turn = encode_chat_turn("id", "hhmm", "sender", "text", "reply_to_message_id", K.BOT_NAME_API)
    p = C.chat_prompts_at_each_message(m, max_tokens=max_tokens)
    t = m.withColumn("tj", F.to_json(turn)).select("chat_id", "id", "tj").collect()
    turns = {}
    for r in t:
        turns.setdefault(r.chat_id, []).append((r.id, json.loads(r.tj)))
    checked = 0
    for r in p.select("chat_id", "id", "n_context", "prompt").collect():
        prompt = json.loads(r.prompt)
        assert len(json.dumps(prompt, ensure_ascii=False)) // 3 <= max_tokens
        hist = [tj for i, tj in sorted(turns[r.chat_id]) if i <= r.id]
        assert prompt["messages"][1:] == hist[len(hist) - r.n_context:]
        if r.n_context < len(hist):
            bigger = {"messages": prompt["messages"][:1] + hist[len(hist) - r.n_context - 1:]}
            assert len(json.dumps(bigger, ensure_ascii=False)) // 3 > max_tokens
            checked += 1
    assert checked > 0


def test_turn_length_measure(spark):
    m = messages_from_conversations(spark, SF001)
    turn = encode_chat_turn("id", "hhmm", "sender", "text", "reply_to_message_id", "user")
    for r in m.select(F.to_json(turn).alias("j"), turn_json_length(turn).alias("n")).collect():
        assert len(json.dumps(json.loads(r.j), ensure_ascii=False)) == r.n


# ---- decided defects -------------------------------------------------------------

def _seq_rows(n, gap=1):
    return [(1, i * gap, f"2024-01-01 10:{i % 60:02d}:00", "ab"[i % 2], "t", None) for i in range(n)]


def test_drop_tail_boundaries(spark):
    """n = L gives nothing; n = L + 1 gives one chunk; drop_tail=False keeps the last."""
    for n, want in [(15, 0), (16, 1), (30, 1), (31, 2)]:
        got = S.build_sequences(messages_df(spark, _seq_rows(n)), length=15).select("seq_id").distinct().count()
        assert got == want, n
    keep = S.build_sequences(messages_df(spark, _seq_rows(30)), length=15, drop_tail=False)
    assert keep.select("seq_id").distinct().count() == 2


def test_gap_limits(spark):
    """id gap 4 continues, 5 breaks; exactly 60 minutes continues, 61 breaks."""
    rows = [(1, i, "2024-01-01 10:00:00", "a", "t", None) for i in range(11)] + \
           [(1, 14, "2024-01-01 11:00:00", "b", "t", None), (1, 19, "2024-01-01 11:00:00", "b", "t", None)] + \
           [(1, 20 + i, "2024-01-01 11:01:00", "a", "t", None) for i in range(10)]
    m = S.gap_breaks(S.chunk_fixed(S.positions(messages_df(spark, rows)), 25, drop_tail=False))
    flags = {r.id: (r.brk_id, r.brk_time) for r in m.collect()}
    assert flags[14] == (False, False) and flags[19] == (True, False) and flags[20] == (False, True)


def test_zero_validation(spark):
    df = spark.createDataFrame([(i,) for i in range(4)], "k bigint")
    assert {r.split for r in P.split_random(df, ["k"], 0.2).collect()} == {"train"}
    assert {r.split for r in P.split_ordered(df, "k", 0.0).collect()} == {"train"}


def test_random_split_is_exact_on_repeated_keys(spark):
    df = spark.range(100).selectExpr("id % 4 as k", "id div 30 as x", "1 as y")
    sp = P.split_random(df, ["k"], 0.1).collect()
    assert len(sp) == 100 and sum(r.split == "validation" for r in sp) == 10
    same = spark.range(50).selectExpr("7 as k")
    assert P.split_random(same, ["k"], 0.3).where("split = 'validation'").count() == 15


def test_ordered_split_takes_the_rule_without_rounding_up(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    for frac in (0.9, 0.8, 0.1, 0.5):
        got = P.split_ordered(df, "k", frac).where("split = 'train'").count()
        assert got == int(10 * (1 - frac))


def test_last_n_orders_null_ids_last(spark):
    df = spark.createDataFrame([(1, None), (1, 1), (1, 2), (1, 3)], "chat_id bigint, id bigint")
    old = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    try:
        for limit in ("1000", "1"):
            spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", limit)
            assert {r.id for r in C.last_n_per_chat(df, 2).collect()} == {2, 3}
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", old)


def test_reply_join_spreads_non_replies(spark):
    """One chat, four of five messages no replies: no partition holds much more than the others."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = spark.range(40_000).selectExpr("1L as chat_id", "id", "id % 9 as sender_id", "timestamp_seconds(id) as sent_at",
                                           "if(id % 5 = 0, id div 2, null) as reply_to_message_id")
        out = R.with_reply_author(m).withColumn("p", F.spark_partition_id())
        sizes = [r[1] for r in out.groupBy("p").agg(F.count(F.lit(1)), F.max("reply_author")).collect()]
        assert len(sizes) == 32 and max(sizes) < 3 * sorted(sizes)[16]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_duplicate_ids_last_wins(spark):
    rows = [(1, 1, "2024-01-01 10:00:00", "a", "x", None), (1, 1, "2024-01-01 10:01:00", "b", "y", None),
            (1, 2, "2024-01-01 10:02:00", "a", "z", 1)]
    s = G.build_segments(messages_df(spark, rows)).orderBy("seg_pos").collect()
    assert s[2].reply_to_message_id == s[1].id and s[1].id != s[0].id


def test_bot_turns_in_history(spark):
    """A history that contains the bot renders assistant turns (no failure), and the
    bot's folded name matches its folded handle."""
    rows = [(1, 1, "2024-01-01 10:00:00", K.BOT_NAME_API, "moi", None), (1, 2, "2024-01-01 10:01:00", K.BOT_ALIASES[0], "hei", None),
            (1, 3, "2024-01-01 10:02:00", "Anna", "no?", 1)]
    df = messages_df(spark, rows)
    turns = df.select(encode_chat_turn("id", "hhmm", "sender", "text", "reply_to_message_id").alias("t")).collect()
    assert [r.t.role for r in turns] == ["assistant", "assistant", "user"]
    assert turns[0].t.content == "moi" and turns[0].t.name is None


def test_intro_only_first_of_history(spark):
    rows = [(1, i, "2024-01-01 10:00:00", "a", "t", None) for i in range(5)]
    m = R.with_first_flag(messages_df(spark, rows).withColumn("content_type", F.lit("text")))
    routed = R.route_messages(m, [R.Rule("intro", F.col("is_first"))])
    assert [r.id for r in routed.where(F.col("action") == "intro").collect()] == [0]


def test_probability_is_honoured(spark):
    rows = [(1, i, "2024-01-01 10:00:00", "a", "t", None) for i in range(50)]
    m = R.with_reply_author(R.with_first_flag(messages_df(spark, rows).withColumn("content_type", F.lit("text"))
                                              .withColumn("sender_id", F.lit(1))))
    routed = R.route_messages(m, R.default_rules("api", probability=1.0))
    got = {r.action: r["count"] for r in routed.groupBy("action").count().collect()}
    assert got == {"intro": 1, "random": 49}


def test_non_boolean_rule_rejected(spark):
    df = spark.createDataFrame([(1,)], "x bigint")
    try:
        R.route_messages(df, [R.Rule("bad", F.col("x") + 1)])
    except TypeError as e:
        assert "bad" in str(e)
    else:
        raise AssertionError("expected TypeError")


def test_renumbered_id_range(spark):
    """Segment id bases lie in [-1000, 1000]; ids run on from the base."""
    s = G.build_segments(messages_from_events(spark, SF001, 3))
    r = s.groupBy("chat_id", "seg_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi"),
                                           F.count(F.lit(1)).alias("n")).collect()
    assert all(-1000 <= x.lo <= 1000 and x.hi - x.lo + 1 == x.n for x in r)


def test_gates_route_only(spark):
    """Messages outside the allow-list still count in the context; they are only not routed."""
    rows = [(c, i, "2024-01-01 10:00:00", "a", "hello bot", None) for c in (1, 2) for i in range(3)]
    m = messages_df(spark, rows).withColumn("content_type", F.lit("text"))
    m = R.with_reply_author(R.with_first_flag(m.withColumn("sender_id", F.lit(1))))
    routed = R.route_messages(m, R.default_rules("api", probability=0.0), gate=R.default_gate(allowed_chats=[1]))
    acts = {(r.chat_id, r.id): r.action for r in routed.collect()}
    assert acts[(2, 0)] == "none" and acts[(1, 0)] == "intro" and acts[(1, 1)] == "trigger"
    ctx = C.context_at_each_message(m, F.length("text") + 2, 1000)
    assert {r.chat_id: r.n_context for r in ctx.where(F.col("id") == 2).collect()} == {1: 3, 2: 3}


def test_global_scope_ingest_order(spark):
    """Chats appended end to end with repeating ids: an ingest position keeps file order."""
    rows = [(c, i, f"2024-01-01 10:{i:02d}:00", "ab"[i % 2], "t", None) for c in (1, 2) for i in range(12)]
    df = messages_df(spark, rows).withColumn("ingest_pos", (F.col("chat_id") - 1) * 100 + F.col("id"))
    seqs = S.build_sequences(df, length=5, min_len=3, scope="global", order_col="ingest_pos", max_id_gap=None)
    got = sorted((r.seq_id, r.seq_pos, r.id) for r in seqs.collect())
    assert [x[2] for x in got[:5]] == [0, 1, 2, 3, 4]
    # chunk 2 straddles the chats: the clock goes back (10:10 -> 10:00), so it breaks after 2 rows
    assert {x[0] for x in got} == {0, 1, 3}


def test_last_n_above_group_limit_threshold(spark):
    """Beyond the optimizer's group-limit threshold the blocked ranking gives the same rows."""
    m = messages_from_events(spark, SF001, 3)
    old = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    try:
        a = {(r.chat_id, r.id, r.rn) for r in C.last_n_per_chat(m, 40).select("chat_id", "id", "rn").collect()}
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
        b = {(r.chat_id, r.id, r.rn) for r in C.last_n_per_chat(m, 40).select("chat_id", "id", "rn").collect()}
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", old)
    assert a == b and len(a) == 120


def test_min_chat_turn_length(spark):
    df = messages_df(spark, [(1, 1, "2024-01-01 10:00:00", K.BOT_NAME_API, "", None)])
    n = df.select(C.chat_turn_length()).first()[0]
    assert n == C.MIN_CHAT_TURN_CHARS


def test_observed_counters(spark, tmp_path):
    from chatprep.sources.sinks import jsonl_sink
    ex = P.split_random(S.training_examples(messages_from_events(spark, SF001, None), length=15),
                        ["chat_id", "seq_id"], 0.2)
    ex, obs = S.observe_examples(ex)
    jsonl_sink(ex, str(tmp_path / "out"))
    assert obs.get == {"n_documents": 618, "n_messages": 8619, "min_messages": 10, "max_messages": 15}


def test_preamble_longer_than_budget(spark):
    """The fixed prompt alone exceeds the budget: contexts are empty, prompts hold only the preamble."""
    m = messages_from_conversations(spark, SF001)
    assert C.chat_budget_chars(10) < 0
    p = C.chat_prompts_at_each_message(m, max_tokens=10)
    r = p.agg(F.max("n_context"), F.count(F.lit(1))).first()
    assert tuple(r) == (0, 536)
    assert json.loads(p.first().prompt)["messages"] == [{"role": "system", "content": K.CHAT_PRE_PROMPT}]
    assert C.context_budget(m, F.length("text") + 2, -5, last_n=None).count() == 0


def test_random_needs_nonempty_context(spark):
    """A message longer than the whole budget leaves the context empty: no random reply."""
    rows = [(1, 0, "2024-01-01 10:00:00", "a", "hi", None), (1, 1, "2024-01-01 10:01:00", "a", "x" * 5000, None),
            (1, 2, "2024-01-01 10:02:00", "a", "ok", None)]
    m = messages_df(spark, rows).withColumn("content_type", F.lit("text")).withColumn("sender_id", F.lit(1))
    m = R.with_reply_author(R.with_first_flag(m))
    rules = R.default_rules("api", probability=1.0, context_nonempty=C.fits_budget(max_tokens=1000))
    got = {r.id: r.action for r in R.route_messages(m, rules).collect()}
    assert got == {0: "intro", 1: "none", 2: "random"}


def test_fast_turn_length_equals_rendered(spark):
    """The piecewise chat-turn length equals the rendered turn's length (+ separator)."""
    for m in (messages_from_conversations(spark, SF001), messages_from_events(spark, SF001, 3),
              messages_df(spark, [(1, 1, "2024-01-01 10:00:00", K.BOT_NAME_API, 'q"\\\n😀', None),
                                  (1, 2, "2024-01-01 10:00:00", "😀", "x", 1), (1, 3, "2024-01-01 10:00:00", "", "", None)])):
        turn = encode_chat_turn("id", "hhmm", "sender", "text", "reply_to_message_id", K.BOT_NAME_API)
        bad = m.where(C.chat_turn_length() != turn_json_length(turn) + 2).count()
        assert bad == 0


def test_last_n_of_any_order_type_on_either_side_of_the_threshold(spark):
    rows = spark.range(3000).selectExpr("id % 2 as chat_id", "timestamp_micros(1700000000000000 + (id * 7919 % 3000) * 250) as at",
                                        "cast((id * 7919 % 3000) * 0.25 as decimal(20, 2)) as price", "cast(id * 7919 % 3000 as string) as name")
    old = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    try:
        for col in ("at", "price", "name"):
            values = {c: sorted((r[1] for r in rows.select("chat_id", col).where(f"chat_id = {c}").collect()), reverse=True) for c in (0, 1)}
            for limit, n in (("1000", 3), ("1", 3), ("1", 1499)):
                spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", limit)
                got = C.last_n_per_chat(rows, n, order_col=col).select("chat_id", "rn", col).collect()
                assert {(r[0], r[1], r[2]) for r in got} == {(c, k + 1, v) for c in (0, 1) for k, v in enumerate(values[c][:n])}
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", old)


def test_ordered_split_by_any_type_with_ties_and_nulls(spark):
    rows = spark.range(-500, 500).selectExpr(
        "case when id % 10 = 0 then null else id * 1000003 end as big", "cast(date_add(date'1969-12-01', cast(id % 90 as int)) as date) as day",
        "timestamp_ntz'1969-12-31 00:00:00' + make_dt_interval(0, 0, 0, id * 250) as at", "timestamp_micros(id * 999983) as moment",
        "concat('é', id % 40) as name", "cast(id as decimal(10, 1)) as price", "7 as same")
    for col in rows.columns:
        out = P.split_ordered(rows, col, 0.3)
        low = out.where("split = 'train'").select(col).collect()
        high = out.where("split = 'test'").select(col).collect()
        key = lambda r: (r[0] is not None, r[0].encode() if isinstance(r[0], str) else r[0] or 0)
        assert len(low) == 700 and len(high) == 300
        if col != "same":
            assert max(map(key, [r for r in low if r[0] is not None])) <= min(map(key, [r for r in high if r[0] is not None]))
            assert not any(r[0] is None for r in high)


def test_failed_messages_are_counted(spark):
    """A brace in a text sets quotes off, so its turn can't be read back; only the last speaker's turns of kept sequences count."""
    texts = {3: 'he said {"x"', 5: "fine", 11: "it's {'b'} {", 40: "{'q' {"}
    rows = [(1, i, f"2024-01-01 10:{i:02d}:00", "ab"[i % 2], texts.get(i, "t"), None) for i in range(48)]
    df = messages_df(spark, rows)
    seqs = S.build_sequences(df, length=12).where("role = 'assistant'")
    from chatprep.operators.compat import content_recover_compat
    want = seqs.where(content_recover_compat()["failed"]).count()
    stats = S.sequence_stats(df, length=12).collect()
    assert sum(r.n_failed for r in stats) == want > 0
    short = messages_df(spark, rows[:5] + [(1, 500 + i, f"2024-01-01 12:{i:02d}:00", "b", texts[3], None) for i in range(20)])
    assert all(r.n_failed == 0 for r in S.sequence_stats(short, length=5).collect() if r.discarded)
