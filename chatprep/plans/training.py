"""Training-data queries: sequences, examples, segments, splits (batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatprep import constants as K
from chatprep.operators import segments as G
from chatprep.operators import sequences as S
from chatprep.operators import splits as P
from chatprep.plans.registry import (register, events_messages_sql, CONV_MESSAGES_SQL, chat_name_sql,
                                     pmod_sql, content_json_sql, seeded_md5_sql, seeded_u32_sql)
from chatprep.sources.tables import messages_from_events, messages_from_conversations

SEED = 42


def _sq(s: str) -> str:
    return s.replace("'", "''")


# ---------------------------------------------------------------- sequences SQL

def seq_sql(L: int, n_chats: int | None, gap: int = 4, minutes: int = 60, min_len: int = 10) -> str:
    """CTE chain: m (messages) p (positions) c (chunks) g (break flags) k (kept prefix)
    s (long enough) r (relabelled)."""
    return f"""
m AS ({events_messages_sql(n_chats)}),
p AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY id, sent_at) - 1 AS pos,
             count(*) OVER (PARTITION BY chat_id) AS n_chat FROM m),
c AS (SELECT *, pos // {L} AS seq_id, pos % {L} AS seq_pos,
             CAST(substr(hhmm, 1, 2) AS INT) * 60 + CAST(substr(hhmm, 4, 2) AS INT) AS mod
      FROM p WHERE (pos // {L} + 1) * {L} < n_chat),
f AS (SELECT *, COALESCE(abs(id - lag(id) OVER (PARTITION BY chat_id, seq_id ORDER BY seq_pos)) > {gap}, false) AS brk_id,
             COALESCE({pmod_sql(f"mod - first_value(mod) OVER (PARTITION BY chat_id, seq_id ORDER BY seq_pos)", 1440)} > {minutes}, false) AS t_raw
      FROM c),
g AS (SELECT *, (t_raw AND NOT brk_id) AS brk_time FROM f),
k AS (SELECT * FROM (SELECT *, max(CAST(brk_id OR brk_time AS INT)) OVER (PARTITION BY chat_id, seq_id ORDER BY seq_pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cut FROM g) WHERE cut = 0),
s AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY chat_id, seq_id) AS n_messages FROM k)
      WHERE n_messages >= {min_len}),
r AS (SELECT *, CASE WHEN sender IS NOT DISTINCT FROM last_value(sender) OVER (PARTITION BY chat_id, seq_id ORDER BY seq_pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) THEN 'assistant' ELSE 'user' END AS role FROM s)"""


def turn_json_sql() -> str:
    content_a = "CASE WHEN reply_to_message_id IS NOT NULL THEN '@' || CAST(reply_to_message_id AS VARCHAR) || ' ' || text ELSE text END"
    return (f"""CASE WHEN role = 'assistant' THEN '{{"role":"assistant","content":' || CAST(to_json({content_a}) AS VARCHAR) || '}}'
        ELSE '{{"role":"user","name":' || CAST(to_json({chat_name_sql('sender')}) AS VARCHAR) || ',"content":'
             || CAST(to_json({content_json_sql()}) AS VARCHAR) || '}}' END""")


def docs_sql(system_text: str) -> str:
    return f"""SELECT chat_id, seq_id, CAST(count(*) AS BIGINT) AS n_messages,
       '{{"messages":[{{"role":"system","content":' || CAST(to_json('{_sq(system_text)}') AS VARCHAR) || '}},'
       || string_agg({turn_json_sql()}, ',' ORDER BY seq_pos) || ']}}' AS doc
FROM r GROUP BY chat_id, seq_id"""


def _ev(spark, sf, n_chats=3):
    return messages_from_events(spark, sf, n_chats)


@register("chunk_fixed_drop_tail", sql=f"WITH {seq_sql(15, None)} SELECT chat_id, id, pos, seq_id, seq_pos FROM c")
def q_chunk_fixed(spark, sf):
    m = S.chunk_fixed(S.positions(_ev(spark, sf, None)), 15)
    return m.select("chat_id", "id", "pos", "seq_id", "seq_pos")


@register("gap_break_id", sql=f"WITH {seq_sql(15, 3)} SELECT chat_id, seq_id, seq_pos, id, brk_id FROM g")
def q_gap_break_id(spark, sf):
    m = S.gap_breaks(S.chunk_fixed(S.positions(_ev(spark, sf, 3)), 15))
    return m.select("chat_id", "seq_id", "seq_pos", "id", "brk_id")


@register("gap_break_time", sql=f"WITH {seq_sql(25, None)} SELECT chat_id, seq_id, seq_pos, hhmm, brk_time FROM g")
def q_gap_break_time(spark, sf):
    m = S.gap_breaks(S.chunk_fixed(S.positions(_ev(spark, sf, None)), 25))
    return m.select("chat_id", "seq_id", "seq_pos", "hhmm", "brk_time")


@register("prefix_until_break", sql=f"WITH {seq_sql(15, None)} SELECT chat_id, seq_id, seq_pos, id FROM k")
def q_prefix_until_break(spark, sf):
    m = S.prefix_until_break(S.gap_breaks(S.chunk_fixed(S.positions(_ev(spark, sf, None)), 15)))
    return m.select("chat_id", "seq_id", "seq_pos", "id")


@register("filter_min_length", sql=f"WITH {seq_sql(5, 3, min_len=3)} SELECT DISTINCT chat_id, seq_id, n_messages FROM s")
def q_filter_min_length(spark, sf):
    m = S.build_sequences(_ev(spark, sf, 3), length=5, min_len=3)
    return m.select("chat_id", "seq_id", "n_messages").distinct()


@register("relabel_last_speaker", sql=f"WITH {seq_sql(15, None)} SELECT chat_id, seq_id, seq_pos, sender, role FROM r")
def q_relabel(spark, sf):
    m = S.build_sequences(_ev(spark, sf, None), length=15)
    return m.select("chat_id", "seq_id", "seq_pos", "sender", "role")


@register("last_speaker", sql=f"""WITH {seq_sql(25, None)}
SELECT chat_id, seq_id, max_by(sender, seq_pos) AS last_sender FROM s GROUP BY chat_id, seq_id""")
def q_last_speaker(spark, sf):
    m = S.build_sequences(_ev(spark, sf, None), length=25)
    return m.groupBy("chat_id", "seq_id").agg(F.max_by("sender", "seq_pos").alias("last_sender"))


@register("assemble_examples", sql=f"WITH {seq_sql(25, None)} {docs_sql(K.SYSTEM_TEXT_V1)}")
def q_assemble_examples(spark, sf):
    ex = S.training_examples(_ev(spark, sf, None), length=25, system_text=K.SYSTEM_TEXT_V1)
    return ex.select("chat_id", "seq_id", "n_messages", "doc")


@register("assemble_examples_v2", sql=f"WITH {seq_sql(15, None)} {docs_sql(K.SYSTEM_TEXT_V2)}")
def q_assemble_examples_v2(spark, sf):
    ex = S.training_examples(_ev(spark, sf, None), length=15, system_text=K.SYSTEM_TEXT_V2)
    return ex.select("chat_id", "seq_id", "n_messages", "doc")


@register("reply_prefix_content", sql=f"""WITH {seq_sql(15, None)}
SELECT chat_id, seq_id, seq_pos,
       CASE WHEN reply_to_message_id IS NOT NULL THEN '@' || CAST(reply_to_message_id AS VARCHAR) || ' ' || text ELSE text END AS content
FROM r WHERE role = 'assistant'""")
def q_reply_prefix(spark, sf):
    from chatprep.functions.chat import reply_prefix_content
    m = S.build_sequences(_ev(spark, sf, None), length=15).where(F.col("role") == "assistant")
    return m.select("chat_id", "seq_id", "seq_pos", reply_prefix_content("text", "reply_to_message_id").alias("content"))


_REPR_SQL = """CASE WHEN contains({x}, chr(39)) AND NOT contains({x}, '"') THEN '"' || {e} || '"'
  ELSE chr(39) || replace({e}, chr(39), chr(92) || chr(39)) || chr(39) END"""


def _repr_sql(x: str) -> str:
    e = f"replace(replace(replace(replace({x}, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"
    return _REPR_SQL.format(x=x, e=e)


def _recovered_sql() -> str:
    """CTEs over the built sequences ``r``: ``j``, assistant turns as printed (``raw``), with their
    quotes exchanged (``fixed``), and whether that is no JSON (``failed``)."""
    return f"""raw AS (SELECT *, '{{''id'': ' || id || ', ''time'': ' || {_repr_sql('hhmm')} || ', ''from'': ' || {_repr_sql('sender')}
  || ', ''text'': ' || {_repr_sql('text')} || ', ''reply_to_message_id'': ' || coalesce(CAST(reply_to_message_id AS VARCHAR), 'nan') || '}}' AS raw
  FROM r WHERE role = 'assistant'),
sw AS (SELECT *, replace(replace(replace(raw, '"', chr(39)), 'nan', 'null'), chr(39), '"') AS s FROM raw),
pl AS (SELECT *, instr(substr(s, 2), '{{') AS first, length(s) - instr(reverse(s), '}}') AS last FROM sw),
fx AS (SELECT *, CASE WHEN first = 0 OR last <= first THEN s ELSE
  array_to_string([CASE WHEN substr(s, first + i, 1) = '"' THEN chr(39) ELSE substr(s, i, 1) END FOR i IN range(1, last - first + 1)], '')
  || substr(s, last - first + 1) END AS fixed FROM pl),
j AS (SELECT *, NOT json_valid(fixed) AS failed FROM fx)"""


@register("sequence_stats", sql=f"""WITH {seq_sql(15, 3)},
kk AS (SELECT *, max(CAST(brk_id OR brk_time AS INT)) OVER (PARTITION BY chat_id, seq_id ORDER BY seq_pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cut FROM g),
per AS (SELECT chat_id, seq_id, CAST(sum(1 - cut) AS BIGINT) AS kept,
               min(CASE WHEN brk_id THEN seq_pos END) AS fi, min(CASE WHEN brk_time THEN seq_pos END) AS ft
        FROM kk GROUP BY chat_id, seq_id),
{_recovered_sql()},
ff AS (SELECT chat_id, seq_id, count(*) FILTER (failed) AS nf FROM j GROUP BY chat_id, seq_id)
SELECT CASE WHEN fi IS NULL AND ft IS NULL THEN 'full' WHEN ft IS NULL OR fi < ft THEN 'id_gap' ELSE 'time_gap' END AS end_reason,
       kept < 10 AS discarded, CAST(count(*) AS BIGINT) AS n_sequences, CAST(sum(kept) AS BIGINT) AS n_messages,
       CAST(coalesce(sum(nf), 0) AS BIGINT) AS n_failed
FROM per LEFT JOIN ff USING (chat_id, seq_id) GROUP BY ALL""")
def q_sequence_stats(spark, sf):
    return S.sequence_stats(_ev(spark, sf, 3), length=15)


# ---------------------------------------------------------------- segments SQL

def seg_sql(src: str, seed: int = SEED, max_chars: int = 200, S_: int = 10, bot: str = K.SEGMENT_BOT_NAME) -> str:
    return f"""
m AS ({src}),
fl AS (SELECT * FROM m WHERE length(text) < {max_chars}),
p AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY id, sent_at) - 1 AS pos FROM fl),
sg AS (SELECT *, pos // {S_} AS seg_id, pos % {S_} AS seg_pos FROM p),
lb AS (SELECT *, sender AS orig_sender,
              CASE WHEN sender IS NOT DISTINCT FROM last_value(sender) OVER (PARTITION BY chat_id, seg_id ORDER BY seg_pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) THEN '{bot}' ELSE sender END AS new_sender
       FROM sg),
rn AS (SELECT *, id AS orig_id, -1000 + {pmod_sql(seeded_u32_sql(seed, 'chat_id', 'seg_id'), 2001)} + seg_pos AS new_id FROM lb),
tgt AS (SELECT chat_id, seg_id, orig_id, max_by(new_id, seg_pos) AS tgt_id FROM rn GROUP BY ALL),
sgm AS (SELECT rn.chat_id, rn.seg_id, rn.seg_pos, rn.orig_id, rn.new_id AS id, rn.hhmm, rn.new_sender AS sender,
               rn.orig_sender, rn.text, rn.reply_to_message_id AS orig_reply_to_message_id, t.tgt_id AS reply_to_message_id
        FROM rn LEFT JOIN tgt t ON t.chat_id = rn.chat_id AND t.seg_id = rn.seg_id AND t.orig_id = rn.reply_to_message_id),
rec AS (SELECT *, '[MSG]' || CAST(id AS VARCHAR) || '[FS]' || hhmm || '[FS]' || sender || '[FS]' || text || '[FS]'
                  || COALESCE(CAST(reply_to_message_id AS VARCHAR), '') || '[MEG]' AS record FROM sgm)"""


@register("filter_length", sql=f"""WITH {seg_sql(events_messages_sql(3))}
SELECT chat_id, CAST(count(*) AS BIGINT) AS n_kept FROM fl GROUP BY chat_id""")
def q_filter_length(spark, sf):
    return G.filter_length(_ev(spark, sf, 3)).groupBy("chat_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_kept"))


@register("segment_fixed", sql=f"""WITH {seg_sql(events_messages_sql(3))}
SELECT chat_id, seg_id, CAST(count(*) AS BIGINT) AS n_messages,
       CAST(sum(CASE WHEN new_sender = '{K.SEGMENT_BOT_NAME}' THEN 1 ELSE 0 END) AS BIGINT) AS n_by_last
FROM lb GROUP BY chat_id, seg_id""")
def q_segment_fixed(spark, sf):
    s = G.relabel_segment_speaker(G.segment_fixed(G.filter_length(_ev(spark, sf, 3))))
    return s.groupBy("chat_id", "seg_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_messages"),
        F.sum(F.when(F.col("sender") == K.SEGMENT_BOT_NAME, 1).otherwise(0)).cast("bigint").alias("n_by_last"))


@register("renumber_ids", sql=f"""WITH {seg_sql(CONV_MESSAGES_SQL)}
SELECT chat_id, seg_id, seg_pos, orig_id, new_id AS id FROM rn""")
def q_renumber_ids(spark, sf):
    s = G.renumber_ids(G.segment_fixed(G.filter_length(messages_from_conversations(spark, sf))), SEED)
    return s.select("chat_id", "seg_id", "seg_pos", "orig_id", "id")


@register("reply_remap", sql=f"""WITH {seg_sql(events_messages_sql(None))}
SELECT chat_id, seg_id, seg_pos, id, orig_reply_to_message_id, reply_to_message_id FROM sgm
WHERE orig_reply_to_message_id IS NOT NULL""")
def q_reply_remap(spark, sf):
    s = G.build_segments(_ev(spark, sf, None), seed=SEED)
    return s.where(F.col("orig_reply_to_message_id").isNotNull()) \
        .select("chat_id", "seg_id", "seg_pos", "id", "orig_reply_to_message_id", "reply_to_message_id")


@register("segment_prompt", sql=f"""WITH {seg_sql(events_messages_sql(3))}
SELECT chat_id, seg_id, CAST(count(*) AS BIGINT) AS n_messages, string_agg(record, chr(10) ORDER BY seg_pos) || chr(10) AS prompt
FROM rec GROUP BY chat_id, seg_id""")
def q_segment_prompt(spark, sf):
    return G.segment_prompt(G.build_segments(_ev(spark, sf, 3), seed=SEED))


@register("segment_prompt_conversations", sql=f"""WITH {seg_sql(CONV_MESSAGES_SQL)}
SELECT chat_id, seg_id, CAST(count(*) AS BIGINT) AS n_messages, string_agg(record, chr(10) ORDER BY seg_pos) || chr(10) AS prompt
FROM rec GROUP BY chat_id, seg_id""")
def q_segment_prompt_conv(spark, sf):
    return G.segment_prompt(G.build_segments(messages_from_conversations(spark, sf), seed=SEED))


_PRE = K.local_pre_prompt(K.SEGMENT_BOT_NAME)


@register("eval_pairs", sql=f"""WITH {seg_sql(events_messages_sql(3))}
SELECT chat_id, seg_id,
       '{_sq(_PRE)}' || COALESCE(string_agg(CASE WHEN seg_pos < last THEN record || chr(10) END, '' ORDER BY seg_pos), '')
       || max_by('[MSG]' || CAST(id AS VARCHAR) || '[FS]' || hhmm || '[FS]' || sender || '[FS]', seg_pos) AS prompt,
       max_by(text, seg_pos) AS truth
FROM (SELECT *, max(seg_pos) OVER (PARTITION BY chat_id, seg_id) AS last FROM rec) GROUP BY chat_id, seg_id""")
def q_eval_pairs(spark, sf):
    return G.eval_pairs(G.build_segments(_ev(spark, sf, 3), seed=SEED), pre_prompt=_PRE)


# ---------------------------------------------------------------- splits

def _split_sql(frac: float) -> str:
    return f"""WITH {seq_sql(15, None)}, ex AS (SELECT DISTINCT chat_id, seq_id FROM r),
h AS (SELECT *, {seeded_md5_sql(SEED, 'chat_id', 'seq_id')} AS hh FROM ex),
rk AS (SELECT *, row_number() OVER (ORDER BY hh) AS rk, count(*) OVER () AS n FROM h)
SELECT chat_id, seq_id, CASE WHEN rk <= CAST(floor(n * {frac}) AS BIGINT) THEN 'validation' ELSE 'train' END AS split FROM rk"""


@register("split_random", sql=_split_sql(0.2))
def q_split_random(spark, sf):
    ex = S.build_sequences(_ev(spark, sf, None), length=15).select("chat_id", "seq_id").distinct()
    return P.split_random(ex, ["chat_id", "seq_id"], 0.2, SEED)


@register("split_anti", sql=f"""WITH {seq_sql(15, None)}, ex AS (SELECT DISTINCT chat_id, seq_id FROM r),
h AS (SELECT *, {seeded_md5_sql(SEED, 'chat_id', 'seq_id')} AS hh FROM ex),
v AS (SELECT chat_id, seq_id FROM h ORDER BY hh LIMIT (SELECT CAST(floor(count(*) * 0.2) AS BIGINT) FROM ex))
SELECT chat_id, seq_id FROM ex ANTI JOIN v USING (chat_id, seq_id)""")
def q_split_anti(spark, sf):
    ex = S.build_sequences(_ev(spark, sf, None), length=15).select("chat_id", "seq_id").distinct()
    sp = P.split_random(ex, ["chat_id", "seq_id"], 0.2, SEED)
    return sp.where(F.col("split") == "train").select("chat_id", "seq_id")


@register("shuffle_examples", sql=f"""WITH {seq_sql(25, None)}, ex AS (SELECT DISTINCT chat_id, seq_id FROM r)
SELECT chat_id, seq_id, {seeded_md5_sql(SEED, 'chat_id', 'seq_id')} AS shuffle_key FROM ex""")
def q_shuffle_examples(spark, sf):
    ex = S.build_sequences(_ev(spark, sf, None), length=25).select("chat_id", "seq_id").distinct()
    return P.shuffle_key(ex, ["chat_id", "seq_id"], SEED)


@register("split_ordered", sql=f"""WITH m AS ({events_messages_sql(3)}),
p AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM m)
SELECT id, CASE WHEN pos < CAST(floor(n * (1.0::DOUBLE - 0.1::DOUBLE)) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM p""")
def q_split_ordered(spark, sf):
    return P.split_ordered(_ev(spark, sf, 3), "id", 0.1).select("id", "split")


@register("head_sample", sql=f"SELECT id, sender, text FROM ({events_messages_sql(3)}) ORDER BY id LIMIT 100")
def q_head_sample(spark, sf):
    return P.head_sample(_ev(spark, sf, 3), "id", 100).select("id", "sender", "text")


@register("eval_sample", sql=f"""WITH {seg_sql(events_messages_sql(3))},
segs AS (SELECT chat_id, seg_id, row_number() OVER (ORDER BY chat_id, seg_id) - 1 AS i FROM (SELECT DISTINCT chat_id, seg_id FROM rec)),
d AS (SELECT range AS draw, {pmod_sql(seeded_u32_sql(SEED, 'range'), '(SELECT count(*) FROM segs)')} AS i FROM range(200))
SELECT d.draw, chat_id, seg_id, rec.seg_pos, rec.record FROM d JOIN segs USING (i) JOIN rec USING (chat_id, seg_id)""")
def q_eval_sample(spark, sf):
    """200 draws of segments over all chats."""
    d = P.draw_segments(G.build_segments(_ev(spark, sf, 3), seed=SEED), 200, SEED)
    return d.select("draw", "chat_id", "seg_id", "seg_pos", "record")


@register("custom_renderer", sql=f"""WITH {seg_sql(CONV_MESSAGES_SQL)}
SELECT chat_id, seg_id, CAST(count(*) AS BIGINT) AS n_messages,
       string_agg(sender || ': ' || text, chr(10) ORDER BY seg_pos) || chr(10) AS prompt
FROM rec GROUP BY chat_id, seg_id""")
def q_custom_renderer(spark, sf):
    """A user renderer (``sender: text`` lines) in place of the delimited record."""
    segs = G.build_segments(messages_from_conversations(spark, sf), seed=SEED)
    return G.segment_prompt(segs, render=F.concat(F.col("sender"), F.lit(": "), F.col("text")))


@register("content_recover_compat", sql=f"""WITH {seq_sql(15, None)},
{_recovered_sql()}
SELECT chat_id, seq_id, seq_pos, failed, CASE WHEN failed THEN raw
  ELSE coalesce('@' || (CAST(CASE WHEN failed THEN NULL ELSE fixed END AS JSON)->>'reply_to_message_id') || ' ', '')
       || (CAST(CASE WHEN failed THEN NULL ELSE fixed END AS JSON)->>'text') END AS content
FROM j""")
def q_content_recover_compat(spark, sf):
    """The dict-text recovery of assistant contents: quotes swapped, "nan" made null, quotes of an
    inner brace scrubbed by their places; a text that is no JSON then stays as it is."""
    from chatprep.operators.compat import content_recover_compat
    seqs = S.build_sequences(_ev(spark, sf, None), length=15).where(F.col("role") == "assistant")
    r = seqs.withColumn("_r", content_recover_compat())
    return r.select("chat_id", "seq_id", "seq_pos", F.col("_r.content").alias("content"),
                    F.col("_r.failed").alias("failed"))


@register("segments_per_split", sql=f"""WITH m AS ({events_messages_sql(None)}),
p AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS gpos, count(*) OVER () AS n FROM m),
s AS (SELECT *, CASE WHEN gpos < CAST(floor(n * (1.0::DOUBLE - 0.1::DOUBLE)) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM p),
fl AS (SELECT * FROM s WHERE length(text) < 200),
q AS (SELECT *, (row_number() OVER (PARTITION BY split, chat_id ORDER BY id) - 1) // 10 AS seg_id FROM fl)
SELECT split, CAST(count(*) AS BIGINT) AS n_messages, CAST(count(DISTINCT seg_id) AS BIGINT) AS n_segments
FROM q GROUP BY split""")
def q_segments_per_split(spark, sf):
    """Rows after filtering and segments per split (ordered 90/10 split of one history)."""
    s = G.segments_per_split(_ev(spark, sf, None), 0.1, seed=SEED)
    return s.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n_messages"),
                                  F.countDistinct("chat_id", "seg_id").cast("bigint").alias("n_segments"))
