"""Sequences, segments and contexts on random histories: invariants that hold for every row,
computed with pandas group operations, and one history worked by hand."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from chatprep import constants as K
from chatprep.operators import context as C
from chatprep.operators import segments as G
from chatprep.operators import sequences as S

from .conftest import messages_df

SETTINGS = dict(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@st.composite
def histories(draw):
    rng = np.random.default_rng(draw(st.integers(0, 10_000)))
    rows = []
    for chat in range(int(rng.integers(2, 8))):
        n = int(rng.integers(1, 70))
        ids = np.cumsum(rng.choice([1, 1, 1, 2, 3, 5, 6], n))
        minutes = np.cumsum(rng.choice([0, 1, 2, 5, 30, 59, 60, 61], n)) % 2880
        for i, m in zip(ids.tolist(), minutes.tolist()):
            ts = f"2024-01-{1 + m // 1440:02d} {m % 1440 // 60:02d}:{m % 60:02d}:00"
            text = "x" * int(rng.choice([1, 5, 20, 120, 199, 200, 260]))
            rows.append((chat, i, ts, str(rng.choice(["ann", "bo", "cai"])), text, None))
    return rows


def frame(rows):
    p = pd.DataFrame(rows, columns=["chat_id", "id", "ts", "sender", "text", "reply"])
    p["minute"] = p.ts.str[11:13].astype(int) * 60 + p.ts.str[14:16].astype(int)
    p["pos"] = p.groupby("chat_id").cumcount()
    p["size"] = p.groupby("chat_id").id.transform("size")
    return p


@settings(**SETTINGS)
@given(histories(), st.sampled_from([(5, 3), (15, 10), (4, 1)]))
def test_sequence_members(spark, rows, params):
    length, least = params
    p = frame(rows)
    p["seq_id"] = p.pos // length
    key = ["chat_id", "seq_id"]
    p = p[p.seq_id * length < p["size"] - length]  # the last complete chunk goes with the tail
    gap = p.groupby(key).id.diff().abs().fillna(0) > K.SEQ_MAX_ID_GAP
    late = (p.minute - p.groupby(key).minute.transform("first")) % 1440 > K.SEQ_MAX_MINUTES
    p = p[(gap | late).groupby([p.chat_id, p.seq_id]).cumsum() == 0]
    p = p[p.groupby(key).id.transform("size") >= least]
    last = p.groupby(key).sender.transform("last")
    want = set(zip(p.chat_id, p.seq_id, p.id, np.where(p.sender == last, "assistant", "user")))
    got = S.build_sequences(messages_df(spark, rows), length=length, min_len=least)
    assert {(r.chat_id, r.seq_id, r.id, r.role) for r in got.collect()} == want


@settings(**SETTINGS)
@given(histories())
def test_segment_members(spark, rows):
    p = frame(rows)
    p = p[p.text.str.len() < K.SEGMENT_MAX_CHARS].copy()
    p["seg_id"] = p.groupby("chat_id").cumcount() // K.SEGMENT_LEN
    last = p.groupby(["chat_id", "seg_id"]).sender.transform("last")
    want = set(zip(p.chat_id, p.seg_id, p.id, p.sender.where(p.sender != last, K.SEGMENT_BOT_NAME)))
    got = G.relabel_segment_speaker(G.segment_fixed(G.filter_length(messages_df(spark, rows))))
    assert {(r.chat_id, r.seg_id, r.id, r.sender) for r in got.collect()} == want


@settings(**SETTINGS)
@given(histories(), st.sampled_from([3, 50, 203, 700]))
def test_context_is_the_longest_suffix_that_fits(spark, rows, budget):
    p = frame(rows)
    p["len"] = p.text.str.len() + 2
    p["up_to"] = p.groupby("chat_id").len.cumsum()
    before = p.up_to - p.len
    got = C.context_at_each_message(messages_df(spark, rows), F.length("text") + 2, budget).select(
        "chat_id", "id", "n_context", "context_chars", "context_start_id").toPandas().merge(p, on=["chat_id", "id"])
    assert len(got) == len(p) and (got.context_chars <= budget).all()
    kept = got[got.n_context > 0]
    start = kept.merge(p.assign(before=before)[["chat_id", "id", "pos", "before"]], left_on=["chat_id", "context_start_id"],
                       right_on=["chat_id", "id"], suffixes=("", "_s"))
    assert len(start) == len(kept)
    assert (start.pos - start.pos_s + 1 == start.n_context).all() and (start.up_to - start.before == start.context_chars).all()
    # one message more would not fit
    earlier = start.merge(p.assign(pos=p.pos + 1)[["chat_id", "pos", "len"]], left_on=["chat_id", "pos_s"],
                          right_on=["chat_id", "pos"], suffixes=("", "_e"))
    assert (earlier.context_chars + earlier.len_e > budget).all()
    assert (got[got.n_context == 0].len > budget).all()


def test_history_by_hand(spark):
    """Seven messages, chunks of three: 0-2 whole; 3-5 breaks at an id gap of 5; 6 is the tail."""
    ids = [1, 2, 3, 4, 9, 10, 11]
    rows = [(1, i, f"2024-01-01 10:0{k}:00", "ab"[k % 2], "hello", None) for k, i in enumerate(ids)]
    got = S.build_sequences(messages_df(spark, rows), length=3, min_len=1).collect()
    assert {(r.seq_id, r.id, r.role) for r in got} == {(0, 1, "assistant"), (0, 2, "user"), (0, 3, "assistant"), (1, 4, "assistant")}
    ctx = C.context_at_each_message(messages_df(spark, rows), F.length("text") + 2, 15).collect()
    assert {(r.id, r.n_context, r.context_chars, r.context_start_id) for r in ctx} == {
        (1, 1, 7, 1), (2, 2, 14, 1), (3, 2, 14, 2), (4, 2, 14, 3), (9, 2, 14, 4), (10, 2, 14, 9), (11, 2, 14, 10)}
