"""Single-process comparison point for bench.py: the three headline workloads with vectorised
pandas group operations on the same tables and parameters.

    python tools/loop_baseline.py [sf_dir]

Prints one JSON line of seconds and result rows per workload.
"""

from __future__ import annotations

import json
import sys
import time

import numpy as np
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from chatprep import constants as K  # noqa: E402


def events(sf: str, n_chats: int | None) -> pd.DataFrame:
    e = pd.read_parquet(f"{sf}/events.parquet").sort_values("event_id", kind="stable")
    m = pd.DataFrame({"chat_id": e.user_id % n_chats if n_chats else 0, "id": e.event_id, "hhmm": e.ts.dt.strftime("%H:%M"),
                      "minute": e.ts.dt.hour * 60 + e.ts.dt.minute, "sender": "user_" + (e.user_id % 6).astype(str),
                      "text": e.event_type + " " + e.props})
    m["reply"] = (e.event_id - 1 - e.user_id % 12).where((e.event_id % 5 == 0) & (e.event_id >= 12))
    m["pos"] = m.groupby("chat_id").cumcount()
    return m


def examples(m: pd.DataFrame, length: int = K.SEQ_LEN_V1) -> int:
    m = m[(m.pos // length) * length < m.groupby("chat_id").id.transform("size") - length].copy()
    m["seq"] = m.pos // length
    by = [m.chat_id, m.seq]
    stop = (m.groupby(by).id.diff().abs() > K.SEQ_MAX_ID_GAP) | (
        (m.minute - m.groupby(by).minute.transform("first")) % 1440 > K.SEQ_MAX_MINUTES)
    m = m[stop.groupby(by).cumsum() == 0]
    m = m[m.groupby(["chat_id", "seq"]).id.transform("size") >= K.SEQ_MIN_LEN]
    own = m.sender == m.groupby(["chat_id", "seq"]).sender.transform("last")
    shown = m.text.where(m.reply.isna(), "@" + m.reply.fillna(0).astype(int).astype(str) + " " + m.text)
    turn = np.where(own, '{"role":"assistant","content":' + shown.map(json.dumps) + "}",
                    '{"role":"user","name":' + m.sender.map(json.dumps) + ',"content":' + m.text.map(json.dumps) + "}")
    return len(pd.Series(turn, index=m.index).groupby([m.chat_id, m.seq]).agg(",".join))


def segments(m: pd.DataFrame) -> int:
    m = m[m.text.str.len() < K.SEGMENT_MAX_CHARS].copy()
    m["seg"] = m.groupby("chat_id").cumcount() // K.SEGMENT_LEN
    by = ["chat_id", "seg"]
    m["sender"] = m.sender.where(m.sender != m.groupby(by).sender.transform("last"), K.SEGMENT_BOT_NAME)
    m["new"] = m.groupby(by).cumcount()
    target = m[["chat_id", "seg", "id", "new"]].rename(columns={"id": "reply", "new": "to"})
    m = m.merge(target, how="left", on=["chat_id", "seg", "reply"])
    to = m.to.map(lambda x: "" if x != x else str(int(x)))
    line = K.BEGIN_MSG + m.new.astype(str) + K.SEP + m.hhmm + K.SEP + m.sender + K.SEP + m.text + K.SEP + to + K.END_MSG
    return len(line.groupby([m.chat_id, m.seg]).agg("\n".join))


def contexts(m: pd.DataFrame, budget: int = 400) -> int:
    n = 0
    for _, lengths in (m.text.str.len() + 2).groupby(m.chat_id):
        total = lengths.cumsum().to_numpy()
        start = np.searchsorted(total - lengths.to_numpy(), total - budget)
        n += len(start)
    return n


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out = {}
    for name, fn, n_chats in (("sequences_examples_L25", examples, None), ("segment_prompts", segments, 3),
                              ("context_at_each_message", contexts, None)):
        t = time.perf_counter()
        out[name + "_rows"] = fn(events(sf, n_chats))
        out[name] = round(time.perf_counter() - t, 3)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
