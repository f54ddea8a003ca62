"""Reference counts on sf0.01 (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from chatprep import constants as K
from chatprep.operators import context as C
from chatprep.operators import routing as R
from chatprep.operators import segments as G
from chatprep.operators import sequences as S
from chatprep.operators import splits as P
from chatprep.sources.tables import messages_from_conversations, messages_from_events

from .conftest import SF001


@pytest.mark.parametrize("n_chats,length,min_len,chunks,kept,msgs", [
    (None, 15, 10, 666, 618, 8619),
    (None, 25, 10, 399, 374, 5711),
    (3, 15, 10, 665, 22, 234),
    (3, 5, 3, 1998, 1272, 5578),
])
def test_sequences(spark, n_chats, length, min_len, chunks, kept, msgs):
    m = messages_from_events(spark, SF001, n_chats)
    cand = S.chunk_fixed(S.positions(m), length).select("chat_id", "seq_id").distinct().count()
    seqs = S.build_sequences(m, length=length, min_len=min_len)
    r = seqs.agg(F.countDistinct("chat_id", "seq_id").alias("k"), F.count(F.lit(1)).alias("n")).first()
    assert (cand, r.k, r.n) == (chunks, kept, msgs)


@pytest.mark.parametrize("src,n_msgs,n_segs,n_last", [
    ("events3", 10000, 1002, 5600), ("events1", 10000, 1000, 2517), ("conv", 176, 91, 145),
])
def test_segments(spark, src, n_msgs, n_segs, n_last):
    m = messages_from_conversations(spark, SF001) if src == "conv" else \
        messages_from_events(spark, SF001, 3 if src == "events3" else None)
    s = G.relabel_segment_speaker(G.segment_fixed(G.filter_length(m)))
    r = s.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chat_id", "seg_id").alias("k"),
              F.sum(F.when(F.col("sender") == K.SEGMENT_BOT_NAME, 1).otherwise(0)).alias("b")).first()
    assert (r.n, r.k, r.b) == (n_msgs, n_segs, n_last)


def test_replies_in_segment(spark):
    s = G.build_segments(messages_from_events(spark, SF001, None))
    r = s.where(F.col("orig_reply_to_message_id").isNotNull()) \
        .agg(F.count(F.lit(1)).alias("n"), F.count("reply_to_message_id").alias("resolved")).first()
    assert (r.n, r.resolved) == (1997, 430)


def test_context_budget(spark):
    m = messages_from_conversations(spark, SF001)
    r = C.context_budget(m, F.length("text") + 2, 3 * 400 + 2 - 300, last_n=20) \
        .agg(F.count(F.lit(1)).alias("n"), F.sum("suffix_chars").alias("s")).first()
    assert (r.n, r.s) == (114, 48993)


@pytest.mark.parametrize("budget,kept", [(300, 294), (1000, 703), (2500, 1516)])
def test_context_at_each_message(spark, budget, kept):
    m = messages_from_conversations(spark, SF001)
    r = C.context_at_each_message(m, F.length("text") + 2, budget) \
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_context").alias("k")).first()
    assert (r.n, r.k) == (536, kept)


def test_route_conversations(spark):
    m = R.with_first_flag(messages_from_conversations(spark, SF001))
    rules = [R.Rule("intro", F.col("is_first")), R.Rule("trigger", F.contains(F.lower("text"), F.lit("bot")))]
    got = {r.action: r.n for r in R.route_counts(R.route_messages(m, rules)).collect()}
    assert got == {"intro": 100, "trigger": 6, "none": 430}


def test_split_conversations(spark):
    convs = spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id").distinct()
    sp = P.split_random(convs, ["conv_id"], 0.2, seed=42)
    val = sp.where(F.col("split") == "validation")
    assert val.count() == 20
    assert val.agg(F.sum("conv_id")).first()[0] == 950
