"""Byte-range readers: documents and CSV files cut into ranges of any size give the same rows."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from chatprep.sources import export as X
from chatprep.sources import history_csv as H
from chatprep.sources import ranges as R

BITS = ["a", "é", '"', "\\", "{", "}", "[", "]", "\n", ",", " ", '"messages": [', "😀", "\r\n", ";", "x" * 30, '""', "'", "\n\n"]


def odd_text(rng):
    return "".join(rng.choice(BITS) for _ in range(rng.randrange(0, 25)))


@pytest.fixture(params=["400b", "410b", "128m"])
def ranges(request, spark, monkeypatch):
    """Ranges of so many bytes: many a record crosses them, some cover several; once with a table
    of ranges that counts as too large to broadcast."""
    if request.param == "410b":
        monkeypatch.setattr(R, "BROADCAST_RANGES", 0)
    keys = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def test_documents(spark, tmp_path, ranges):
    rng = random.Random(1)

    def message(k):
        return {"id": k, "from": odd_text(rng), "text": rng.choice([
            odd_text(rng), [odd_text(rng), {"type": "b", "text": odd_text(rng)}], {"x": {"messages": [{"a": 1}, {"b": []}]}, "text": "t"}])}

    want = {}
    for n, indent in ((0, None), (1, 1), (40, None), (40, 2)):
        folder = tmp_path / f"c{n}_{indent}"
        folder.mkdir()
        doc = {"name": odd_text(rng), "people": [{"a": 1}, {"b": [{}]}], "messages": [message(k) for k in range(n)],
               "after": [{"z": 1}], "more": {"messages": [{"q": 1}]}}
        (folder / "result.json").write_text(json.dumps(doc, ensure_ascii=indent is None, indent=indent))
        want |= {(folder.name, k): m for k, m in enumerate(doc["messages"])}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "result.json").write_text('{"name": "no messages"}\n')
    msgs = X.export_scan(spark, f"{tmp_path}/*/result.json")
    got = {(r[0], r[1]): json.loads(r[2]) for r in msgs.select("chat_id", "pos", F.to_json("msg")).collect()}
    assert got == want
    assert X.export_scan(spark, f"{tmp_path}/*/result.json", exclude="^c40").count() == 1
    if ranges == "400b":
        assert msgs.rdd.getNumPartitions() > 10  # one document, many tasks


@pytest.mark.parametrize("text", ['{"messages": [{"id": 1, "text": "cut o', '{"messages": [{"id": 1}, {"id": 2',
                                  '{"messages": [{"id": 1}, oops {"id": 2}]}', '{"messages": [{"id": 1}, '])
def test_broken_documents_raise(spark, tmp_path, text):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "result.json").write_text(text)
    with pytest.raises(Exception):  # whichever wrapper carries the reason
        X.export_scan(spark, f"{tmp_path}/*/result.json").select(F.to_json("msg")).collect()


def test_csv(spark, tmp_path, ranges):
    rng = random.Random(2)
    want = []
    for f, end in enumerate(("\n", "\r\n", "\n")):
        rows = [(k, "10:00", odd_text(rng), odd_text(rng), str(k - 1) if k % 3 else "") for k in range(60)]
        out = io.StringIO(newline="")
        w = csv.writer(out, delimiter=";", lineterminator=end)
        w.writerow(["id", "time", "from", "text", "reply_to_message_id"])
        w.writerows(rows)
        text = out.getvalue() + ("\n\n" if f == 0 else "")
        (tmp_path / f"f{f}.csv").write_bytes((text if f else text.rstrip("\n")).encode())
        want += [(k, t, a or None, b or None, r or None) for k, t, a, b, r in rows]
    got = [tuple(r) for r in H.history_csv_raw_scan(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_csv_of_a_header_only_and_open_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;time;from;text;reply_to_message_id\n")
    assert H.history_csv_raw_scan(spark, str(tmp_path / "a.csv")).count() == 0
    (tmp_path / "b.csv").write_text('id;time;from;text;reply_to_message_id\n1;10:00;a;"never ends\n')
    with pytest.raises(Exception):  # whichever wrapper carries the reason
        H.history_csv_raw_scan(spark, str(tmp_path / "b.csv")).collect()
