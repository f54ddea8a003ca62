"""Readers and writers: golden exports, CSV and JSONL round trips, batch = stream."""

import json
import os
import time

import pytest

from pyspark.sql import functions as F

from chatprep import constants as K
from chatprep.operators import context as C
from chatprep.operators import sequences as S
from chatprep.operators import splits as P
from chatprep.schema import LIVE
from chatprep.sources import export as X
from chatprep.sources import history_csv as H
from chatprep.sources.live import live_source, normalize_live
from chatprep.sources.sinks import jsonl_sink, read_jsonl
from chatprep.sources.tables import messages_from_events, live_from_events
from chatprep.streaming import context as SC

from .conftest import SF0001, messages_df

GOLDEN = {
    "chatA": [
        {"id": 1, "type": "service", "date": "2021-11-01T00:00:00", "text": ""},
        {"id": 2, "date": "2021-11-01T23:45:00", "from": None, "text": "", "sticker_emoji": "😀"},
        {"id": 3, "date": "2021-11-01T23:50:00", "from": "Anna", "text": ["Hei ", {"type": "bold", "text": "kaikki"}, "!"]},
        {"id": 4, "date": "2021-11-02T00:10:00", "from": "Bo", "text": "[1] plain"},
        {"id": 5, "date": "2021-11-02T00:11:00", "text": ""},
        {"id": 6, "date": "2021-11-02T00:12:00", "from": "Cai", "text": "quote \" nan \\ ; \n😀", "reply_to_message_id": 3},
        {"id": 6, "date": "2021-11-02T00:13:00", "from": "Cai", "text": [{"type": "link", "text": ["deep ", "list"]}]},
    ],
    "OldData_chat": [
        {"id": 1, "type": "service", "date": "2020-01-01T00:00:00", "text": ""},
        {"id": 2, "date": "2020-01-01T10:00:00", "from": "Old", "text": "old"},
    ],
}


def write_golden(root):
    for chat, msgs in GOLDEN.items():
        os.makedirs(root / chat, exist_ok=True)
        (root / chat / "result.json").write_text(json.dumps({"name": chat, "messages": msgs}, ensure_ascii=False, indent=1))


def test_golden_export(spark, tmp_path):
    write_golden(tmp_path)
    raw = X.export_scan(spark, str(tmp_path / "*" / "result.json"), exclude="(?i)olddata")
    got = X.normalize_export(X.skip_head(raw)).orderBy("pos").collect()
    assert [(r.chat_id, r.pos, r.id, r.hhmm, r.sender, r.text, r.reply_to_message_id) for r in got] == [
        ("chatA", 1, 2, "23:45", "Anonym", "😀", None),
        ("chatA", 2, 3, "23:50", "Anna", "Hei kaikki!", None),
        ("chatA", 3, 4, "00:10", "Bo", "[1] plain", None),
        ("chatA", 4, 5, "00:11", "Anonym", "(image or file)", None),
        ("chatA", 5, 6, "00:12", "Cai", "quote \" nan \\ ; \n😀", 3),
        ("chatA", 6, 6, "00:13", "Cai", "deep list", None),
    ]
    everything = X.export_scan(spark, str(tmp_path / "*" / "result.json"))
    assert everything.select("chat_id").distinct().count() == 2


def test_rich_text_of_any_depth(spark):
    texts = ['"plain"', '{"text":"obj top"}', '["a",["b","c"]]', '["a",{"text":{"text":"deep"}}]', '["a",{"text":["x",["q"]]}]',
             '["a",{"type":"bold","text":"b"}]', "[]", "null"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.flatten_rich_text(F.parse_json("t")).alias("x"))
    assert [r.x for r in df.collect()] == ["plain", "obj top", "abc", "adeep", "axq", "ab", "", None]
    for bad in ("5", '["a",7]', '{"no":"text"}'):
        with pytest.raises(Exception, match="not a text"):
            spark.createDataFrame([(bad,)], "t string").select(X.flatten_rich_text(F.parse_json("t"))).collect()


def test_line_positions_do_not_depend_on_ids(spark, tmp_path):
    (tmp_path / "chatL").mkdir()
    heads = [{"id": 10, "text": "head"}, {"id": -5, "text": "a"}, {"text": "b"}, {"id": 11, "text": "c"}]
    lines = heads + [{"id": 20 + k, "text": "x" * 50} for k in range(400)]
    (tmp_path / "chatL" / "part.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several splits of one file
    try:
        raw = X.export_lines_scan(spark, str(tmp_path / "*" / "part.jsonl"))
        got = sorted((r.pos, r.t) for r in X.skip_head(raw).select("pos", F.variant_get("msg", "$.text", "string").alias("t")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(k, x["text"]) for k, x in enumerate(lines)][1:]


def test_history_csv_roundtrip(spark, tmp_path):
    texts = ['semi;colon', 'quote " inside', 'new\nline', 'back\\slash', 'NA', 'nan', 'null', '😀 emoji', '']
    rows = [(1, i, f"2024-01-01 00:{i:02d}:00", "Anna" if i % 2 else "", t, i - 1 if i % 3 == 0 and i else None)
            for i, t in enumerate(texts)]
    df = messages_df(spark, rows)
    path = str(tmp_path / "csv")
    H.history_csv_sink(df, path)
    back = H.history_csv_scan(spark, path).orderBy("id").collect()
    assert [r.text for r in back] == texts
    assert [r["from"] for r in back] == [r[3] for r in rows]
    assert [r.reply_to_message_id for r in back] == [r[5] for r in rows]
    raw = H.history_csv_raw_scan(spark, path).orderBy("id").collect()
    assert raw[0].reply_to_message_id is None and raw[3].reply_to_message_id == "2"


def test_jsonl_roundtrip(spark, tmp_path):
    ex = S.training_examples(messages_from_events(spark, SF0001, None), length=15, min_len=2)
    ex = P.split_random(ex, ["chat_id", "seq_id"], 0.2)
    assert ex.count() > 10
    path = str(tmp_path / "jsonl")
    jsonl_sink(ex, path)
    back = read_jsonl(spark, path)
    assert sorted(r.doc for r in back.select("doc").collect()) == sorted(r.doc for r in ex.select("doc").collect())
    files = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".json")]
    text = "".join(open(f, encoding="utf-8").read() for f in files)
    assert '"name":null' not in text and "äläkä" in text
    assert {os.path.basename(os.path.dirname(f)) for f in files} == {"split=train", "split=validation"}


def test_stream_equals_batch(spark, tmp_path):
    lv = live_from_events(spark, SF0001, 3)
    src = str(tmp_path / "live")
    ids = sorted(r.message_id for r in lv.select("message_id").collect())
    cuts = [ids[len(ids) // 3], ids[2 * len(ids) // 3]]
    parts = [lv.where(F.col("message_id") < cuts[0]),
             lv.where((F.col("message_id") >= cuts[0]) & (F.col("message_id") < cuts[1])),
             lv.where(F.col("message_id") >= cuts[1])]
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    stream = normalize_live(live_source(spark, src, max_files_per_trigger=1))
    out = SC.run_available_now(SC.stream_context(stream, 300, F.length("text") + 2).drop("context", "tag"), "t")
    got = {tuple(r) for r in spark.read.parquet(out).select("chat_id", "id", "n_context", "context_chars").collect()}
    batch = C.context_at_each_message(normalize_live(lv), F.length("text") + 2, 300)
    want = {tuple(r) for r in batch.select("chat_id", "id", "n_context", "context_chars").collect()}
    assert got == want
    firsts = spark.read.parquet(out).where("is_first").count()
    assert firsts == lv.select("chat_id").distinct().count()


def test_arrivals_land_in_the_order_of_their_ids(spark, tmp_path):
    from chatprep.sources.sinks import land_arrivals
    lv = live_from_events(spark, SF0001, 3).where("message_id < 700")
    odd = lv.where("message_id % 7 = 0").unionByName(lv).withColumn(
        "message_id", F.when(F.col("message_id") % 50 != 49, F.col("message_id")))
    rows = odd.repartition(5, F.xxhash64("date"))
    src = str(tmp_path / "live")
    n = land_arrivals(rows, src, str(tmp_path / "work"), file_rows=200)
    files = sorted((os.path.join(src, f) for f in os.listdir(src) if f.endswith(".parquet")), key=os.path.getmtime)
    held = [[r.message_id for r in spark.read.parquet(f).collect()] for f in files]
    assert n == len(files) > 2 and max(map(len, held)) < 300
    known = [[i for i in h if i is not None] for h in held]
    spans = [(min(h), max(h)) for h in known if h]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert all(None not in h for h in held[:-1]) and None in held[-1]
    assert sorted(map(str, spark.read.parquet(src).collect())) == sorted(map(str, rows.collect()))
    none = str(tmp_path / "none")
    assert land_arrivals(rows.limit(0), none, str(tmp_path / "work0")) == 1 and spark.read.parquet(none).count() == 0


@pytest.mark.parametrize("query", ["stream_prompts_joke", "stream_context_init"])
def test_state_reads_bounded_batches(spark, monkeypatch, query):
    """Registered streams with state land and take their arrivals in several files, with the same results."""
    from functools import partial
    from chatprep.plans import io
    want = sorted(map(str, getattr(io, "q_" + query)(spark, SF0001).collect()))
    land, files = partial(io.land_arrivals, file_rows=600), []
    monkeypatch.setattr(io, "land_arrivals", lambda *a: files.append(land(*a)))
    got = getattr(io, "q_" + query)(spark, SF0001).collect()
    assert files[0] > 1 and sorted(map(str, got)) == want


def test_contexts_go_on_in_pieces(monkeypatch):
    import pandas as pd
    monkeypatch.setattr(SC, "OUT_ROWS", 7)

    class State:
        exists = False

        def update(self, value):
            self.exists, self.get = True, value

    def batch(ids):
        return pd.DataFrame({"_oid": ids, "_len": 10, "_payload": [f"m{i}" for i in ids], "_seed": [i == 3 for i in ids],
                             "_want": True, "_tag": None, "_instruction": None, "_budget": 25})

    state, update = State(), SC._context_updater()
    pieces = list(update((1,), iter([batch([5, 3, 4]), batch(list(range(6, 40)))]), state))
    assert len(pieces) > 1 and max(map(len, pieces)) <= 7
    out = pd.concat(pieces)
    assert out["id"].tolist() == list(range(4, 40)) and not out["is_first"].any()
    assert out["context"].tolist() == [[f"m{j}" for j in range(max(3, i - 1), i + 1)] for i in range(4, 40)]
    assert state.get[0] == [38, 39]


def test_stream_route_gate(spark, tmp_path):
    """Blocked chats still fill the context but are not routed."""
    from chatprep.operators import routing as R
    lv = live_from_events(spark, SF0001, 3).withColumn("reply_to_sender_id", F.lit(None).cast("bigint"))
    src = str(tmp_path / "live")
    lv.coalesce(1).write.mode("overwrite").parquet(src)
    from chatprep.schema import with_fields
    from pyspark.sql import types as T
    stream = normalize_live(live_source(spark, src, schema=with_fields(LIVE, reply_to_sender_id=T.LongType())))
    rules = [r for r in R.default_rules("api", probability=1.0) if r.name != "intro"]
    routed = SC.stream_route(stream, 300, F.length("text") + 2, rules, gate=F.col("chat_id") != 1)
    out = SC.run_available_now(routed.select("chat_id", "id", "action", "n_context"), "gate")
    res = spark.read.parquet(out)
    assert {r.action for r in res.where("chat_id = 1").collect()} == {"none"}
    assert res.where("chat_id = 0").select("action").distinct().count() >= 2
    assert res.where("chat_id = 1").agg(F.max("n_context")).first()[0] > 0


def test_export_lines_match_documents(spark, tmp_path):
    """The JSON-lines form of the golden exports normalises to the same rows."""
    write_golden(tmp_path / "docs")
    for chat, msgs in GOLDEN.items():
        os.makedirs(tmp_path / "lines" / chat, exist_ok=True)
        (tmp_path / "lines" / chat / "part.jsonl").write_text(
            "\n".join(json.dumps(m, ensure_ascii=False) for m in msgs) + "\n")
    a = X.normalize_export(X.skip_head(X.export_scan(spark, str(tmp_path / "docs" / "*" / "result.json"))))
    b = X.normalize_export(X.export_lines_scan(spark, str(tmp_path / "lines" / "*" / "part.jsonl"))
                           .where(F.col("msg").isNotNull() & (F.try_variant_get("msg", "$.type", "string").isNull())))
    cols = ["chat_id", "id", "hhmm", "sender", "text", "reply_to_message_id"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_unreadable_export_fails_loudly(spark, tmp_path):
    os.makedirs(tmp_path / "bad", exist_ok=True)
    (tmp_path / "bad" / "result.json").write_text('{"messages": [{"id": 1, "date": ')
    import pytest
    with pytest.raises(Exception):
        X.export_scan(spark, str(tmp_path / "*" / "result.json")).count()


def test_seeded_stream_over_batches(spark, tmp_path):
    """Seeds (stored history) fill the state first and are not emitted; later micro-batches
    continue the same state, equal to the batch context over seeds + live rows."""
    from pyspark.sql import types as T
    from chatprep.schema import with_fields
    lv = live_from_events(spark, SF0001, 3).withColumn("reply_to_sender_id", F.lit(None).cast("bigint"))
    ids = sorted(r.message_id for r in lv.select("message_id").collect())
    cut1, cut2 = ids[len(ids) // 2], ids[3 * len(ids) // 4]
    seeds = lv.where(F.col("message_id") < cut1).withColumn("is_seed", F.lit(True))
    live = lv.where(F.col("message_id") >= cut1).withColumn("is_seed", F.lit(False))
    src = str(tmp_path / "src")
    for part in (seeds, live.where(F.col("message_id") < cut2), live.where(F.col("message_id") >= cut2)):
        part.coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    schema = with_fields(LIVE, reply_to_sender_id=T.LongType(), is_seed=T.BooleanType())
    stream = normalize_live(live_source(spark, src, max_files_per_trigger=1, schema=schema), keep=("is_seed",))
    out = SC.run_available_now(SC.stream_context(stream, 250, F.length("text") + 2, seed=F.col("is_seed"))
                               .drop("context", "tag"), "seeded")
    res = spark.read.parquet(out)
    assert res.count() == live.count() and res.where("is_first").count() == 0
    got = {tuple(r) for r in res.select("chat_id", "id", "n_context", "context_chars").collect()}
    batch = C.context_at_each_message(normalize_live(lv), F.length("text") + 2, 250).where(F.col("id") >= cut1)
    assert got == {tuple(r) for r in batch.select("chat_id", "id", "n_context", "context_chars").collect()}


def test_history_csv_lines_split_one_file(spark, tmp_path):
    texts = ["a;b", 'quote " in', "new\nline\r\nx", "back\\slash", "\\n", "\\\\n\n", "nan", "😀", ""]
    rows = [(1, i, "2024-01-01 00:00:00", "Ann\nB", texts[i % len(texts)], None) for i in range(2000)]
    path = str(tmp_path / "csv")
    H.history_csv_sink(messages_df(spark, rows).coalesce(1), path, line_safe=True)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        back = H.history_csv_scan(spark, path, line_safe=True)
        assert back.rdd.getNumPartitions() > 3
        assert [(r.id, r["from"], r.text) for r in back.orderBy("id").collect()] == [(r[1], r[3], r[4]) for r in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_stream_prompts_of_both_heads_over_batches(spark, tmp_path):
    """Delimited and joke prompts of a stream in three micro-batches equal a plain loop that keeps the
    records of each chat and drops the oldest while the whole prompt, open record included, is too long."""
    import json
    from chatprep import constants as K
    from chatprep.functions.chat import encode_chat_turn
    from chatprep.operators import routing as R
    from chatprep.schema import with_fields
    from pyspark.sql import types as T
    lv = live_from_events(spark, SF0001, 3).where("message_id < 400")
    src, pre, budget = str(tmp_path / "live"), "Intro.\n", 420
    for lo, hi in ((0, 95), (95, 105), (105, 400)):  # the id in the open record gets a digit more within a batch
        lv.where((F.col("message_id") >= lo) & (F.col("message_id") < hi)).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    schema = with_fields(LIVE, reply_to_sender_id=T.LongType())
    rules = [R.Rule("joke", F.col("id") % 5 == 0), R.Rule("trigger", F.lit(True))]

    def arrivals():
        return normalize_live(live_source(spark, src, max_files_per_trigger=1, schema=schema))

    local = SC.stream_route(arrivals(), SC.record_budget(budget, pre), F.length(SC.record_payload()), rules,
                            payload=SC.record_payload(), instruction=R.command_prompt("local", clock=F.col("hhmm")))
    out = SC.run_available_now(SC.stream_delimited_prompts(local, pre, clock=F.lit("12:00")), "local")
    got = {(r.chat_id, r.id): r.prompt for r in spark.read.parquet(out).collect()}
    rows = normalize_live(lv).select("chat_id", "id", SC.record_payload().alias("rec"),
                                     F.to_json(encode_chat_turn("id", "hhmm", "sender", "text", "reply_to_message_id")).alias("turn"),
                                     R.command_prompt("local", clock=F.col("hhmm")).alias("joke"),
                                     R.command_prompt("api").alias("ask"), C.chat_turn_length().alias("n")).orderBy("id").collect()
    kept, want = {}, {}
    for r in rows:
        first = r.chat_id not in kept
        have = kept.setdefault(r.chat_id, [])
        have.append(r.rec)
        open_ = f"[MSG]{r.id + 1}[FS]12:00[FS]{K.BOT_NAME_LOCAL}[FS]"
        while have and len(pre) + len("".join(have)) + len(open_) > budget:
            have.pop(0)
        if not first:
            want[r.chat_id, r.id] = r.joke if r.id % 5 == 0 else pre + "".join(have) + open_
    assert got == want and len({len(p) for p in want.values()}) > 20

    api = SC.stream_route(arrivals(), C.chat_budget_chars(250, "Sys"), C.chat_turn_length(), rules,
                          payload=F.to_json(encode_chat_turn("id", "hhmm", "sender", "text", "reply_to_message_id")),
                          instruction=R.command_prompt("api"))
    system = {"role": "system", "content": "Sys"}
    out = SC.run_available_now(SC.stream_prompts(api, json.dumps(system, separators=(",", ":"))), "api")
    got = {(r.chat_id, r.id): json.loads(r.prompt)["messages"] for r in spark.read.parquet(out).collect()}
    kept, want = {}, {}
    for r in rows:
        first = r.chat_id not in kept
        have = kept.setdefault(r.chat_id, [])
        have.append(r)
        while sum(x.n for x in have) > C.chat_budget_chars(250, "Sys"):
            have.pop(0)
        if not first:
            tail = [{"role": "system", "content": r.ask}] if r.id % 5 == 0 else []
            want[r.chat_id, r.id] = [system, *(json.loads(x.turn) for x in have), *tail]
    assert got == want and any(len(m) > 4 for m in want.values())
