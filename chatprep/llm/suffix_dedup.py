"""Removal of repeated byte strings by suffix arrays over shards.

Every byte covered by a ``length``-byte string that also starts anywhere else (in any text, the
same one included) goes; strings never cross texts.

Shards hold what can repeat, together. Of the hashes of all grams in a string the smallest is its
mark; equal strings have equal marks, so the strings of a text, taken in order, fall into units of
neighbours with one mark, and two places can only be equal if their units' marks are. Units whose
mark is nowhere else can't repeat and stay out (an exact filter). The units of a mark meet in
one shard, equal ones once. Each shard sorts its bytes into a suffix array (Larsson-Sadakane), and
common prefixes of neighbours (Kasai) tell which strings repeat. A mark with more text than a shard
holds is dealt out over several; their distinct strings are merged by binary search in the sorted
hashes of all of the mark's shards.

Texts are known by the first 128 bits of their SHA-256, units by MD5 and, across the shards of one
mark, strings by 128 bits of polynomial hashes; nothing else rests on hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import Scratch, skew_join
from chatprep.llm.suffix_array import MAX_TEXT, repeated
from chatprep.llm.tokens import by_bytes, mix

#: Bytes of a string that must not repeat, and of the grams whose smallest hash marks it.
LENGTH, GRAM = 400, 32
#: Places of a unit at most, and bytes of texts that are hashed at once.
MAX_UNIT, STRETCH = 4096, 1 << 20
#: Bytes of units above which a mark is dealt out over several shards.
SHARD = MAX_TEXT // 2
#: Bits of the table of texts that have candidates: its size is fixed, 8 MB; a fuller one lets more texts pass.
FILTER_BITS = 26

_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


def window_hashes(data: np.ndarray, size: int, base: np.uint64 = _BASES[0]) -> np.ndarray:
    """Polynomial hashes of all runs of ``size`` bytes."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, run, done, out = np.array([base]), _CODE[data], 0, None
    length = 1
    while True:  # runs of 1, 2, 4, ... bytes, put together by the bits of the size
        if size & length:
            if out is None:
                out = run
            else:
                m = len(run) - done
                out = out[:m] * power + run[done:done + len(out[:m])]
            done += length
        if done == size:
            return out[:n]
        run = run[:-length] * power + run[length:]
        power = power * power
        length *= 2


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours."""
    length = 1
    while 2 * length <= size:
        x = np.minimum(x[:-length], x[length:])
        length *= 2
    rest = size - length
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def units(texts: Sequence[bytes], length: int, gram: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text the starts of its units, their marks, and whether a unit holds its mark more
    than once, so that it may repeat itself. The places of a text where a string starts are cut
    where the mark changes, every MAX_UNIT places, and between stretches of a long text."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    whole = b"".join(texts)
    data = np.frombuffer(whole, np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts, marks, selves = [], [], []
    for at in range(0, len(data), STRETCH):
        part = data[at:at + STRETCH + length - 1]
        hashes, inner = window_hashes(part, gram), length - gram  # grams of a string, less one
        low = sliding_least(hashes, inner + 1)[:STRETCH] if len(part) >= length else np.zeros(0, np.uint64)
        cut = np.ones(len(low), bool)
        np.not_equal(low[1:], low[:-1], out=cut[1:])
        first = ends[:-1] - at
        cut[first[(first > 0) & (first < len(low))]] = True
        s = np.flatnonzero(cut)
        size = np.diff(np.append(s, len(low)))
        if len(s) and size.max() > MAX_UNIT:
            s = np.concatenate([np.arange(a, a + k, MAX_UNIT) for a, k in zip(s.tolist(), size.tolist())])
        starts.append(s + at)
        marks.append(low[s])
        to = np.append(s[1:], len(low)) + inner
        selves.append(np.fromiter((np.count_nonzero(hashes[a:b] == x) > 1 for a, b, x in zip(s.tolist(), to.tolist(), low[s])), bool, len(s)))
    s = np.concatenate([np.zeros(0, np.int64), *starts])
    m = np.concatenate([np.zeros(0, np.uint64), *marks])
    twice = np.concatenate([np.zeros(0, bool), *selves])
    begin = 0
    for end in ends.tolist():
        a, b = np.searchsorted(s, [begin, max(begin, end - length + 1)])
        out.append((s[a:b] - begin, m[a:b], twice[a:b]))
        begin = end
    return out


def marked(docs: DataFrame, doc_id: str, text: str, length: int, gram: int) -> DataFrame:
    """(doc_id, sha, t, n_bytes, starts, keys, selves): each row's text by its hash, and its units."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(body, 256).alias("sha"), body.alias("body"))

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, 2, STRETCH):
                texts = part.column(2).to_pylist()
                found = units(texts, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([s.astype(np.int32) for s, _, _ in found], pa.list_(pa.int32())),
                     pa.array([k.view(np.int64) for _, k, _ in found], pa.list_(pa.int64())),
                     pa.array([x for _, _, x in found], pa.list_(pa.bool_()))],
                    ["doc_id", "sha", "n_bytes", "starts", "keys", "selves"])

    kind = dict(docs.dtypes)[doc_id]
    out = rows.mapInArrow(run, f"doc_id {kind}, sha string, n_bytes bigint, starts array<int>, keys array<bigint>, selves array<boolean>")
    return out.withColumn("t", F.unhex(F.substring("sha", 1, 32)))


def _slot(t: str) -> Column:
    return F.pmod(F.xxhash64(t), F.lit(1 << FILTER_BITS))


def _bit_table(ids: DataFrame) -> np.ndarray:
    """A bit for every text that has candidates; at most 2^(FILTER_BITS - 6) words reach the driver."""
    words = (ids.select(_slot("t").alias("s")).select(F.shiftright("s", 6).cast("int").alias("word"),
                                                     F.expr("shiftleft(1L, cast(s & 63 AS int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    found = words.toArrow()
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint64)


def _passing(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` (t, body) that may be among ``ids``: few others move to the join."""
    shared = texts.sparkSession.sparkContext.broadcast(_bit_table(ids))

    def run(batches):
        bits = shared.value
        for batch in batches:
            s = batch.column(2).to_numpy().astype(np.uint64)
            hit = (bits[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1) == 1
            yield batch.select([0, 1]).filter(pa.array(hit))

    return texts.select("t", "body", _slot("t").alias("s")).mapInArrow(run, "t binary, body binary")


_UNIT = "key bigint, part int, parts int, uid binary, body binary"


def _cut(batches, length: int) -> Iterator[tuple[pa.RecordBatch, int, bytes, dict]]:
    for batch in batches:
        for k in range(batch.num_rows):
            body = batch.column(1)[k].as_py()
            for u in batch.column(2)[k].as_py():
                yield batch.column(0)[k].as_py(), body[u["start"]:u["start"] + u["places"] + length - 1], u


def _bodies(texts: DataFrame, length: int) -> DataFrame:
    """The candidates' bytes, equal ones of a task once: rows for the shards."""
    def run(batches):
        seen, rows, held = set(), [], 0
        kind = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("uid", pa.binary()), ("body", pa.binary())])

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

        for _, body, u in _cut(batches, length):
            uid = hashlib.md5(body).digest()
            if uid in seen:
                continue
            seen.add(uid)
            rows.append((u["key"], int.from_bytes(uid[:4], "little") % u["parts"], u["parts"], uid, body))
            held += len(body)
            if held > STRETCH:
                yield flush()
                rows, held = [], 0
            if len(seen) > 1 << 18:
                seen.clear()
        if rows:
            yield flush()

    return texts.mapInArrow(run, _UNIT)


def _occurrences(texts: DataFrame, length: int) -> DataFrame:
    """(t, start, places, uid) of every candidate unit."""
    def run(batches):
        rows: list[tuple] = []

        def flush():
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["t", "start", "places", "uid"])

        for t, body, u in _cut(batches, length):
            rows.append((t, u["start"], u["places"], hashlib.md5(body).digest()))
            if len(rows) == 10_000:
                yield flush()
                rows = []
        if rows:
            yield flush()

    return texts.mapInArrow(run, "t binary, start int, places int, uid binary")


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs (from, to) of set places."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_FOUND = "uid binary, runs array<struct<a:int,b:int>>, key bigint, lanes array<struct<lane:int,hashes:binary,places:binary>>"
_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_LANES = pa.list_(pa.struct([("lane", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary())]))


def _for_merge(body: np.ndarray, speaks: np.ndarray, length: int, n_lanes: int) -> list[dict]:
    """The strings that a unit speaks for in its shard, by lane of the merge: hashes (two numbers
    a string) in order, with their places."""
    at = np.flatnonzero(speaks)
    pair = np.stack([mix(window_hashes(body, length, b)[at]) for b in _BASES], 1)
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    pair, at = pair[order], at[order].astype(np.int32)
    lane = ((pair[:, 0] >> np.uint64(32)) * np.uint64(n_lanes)) >> np.uint64(32)  # ranges of the first number
    cut = np.searchsorted(lane, np.arange(n_lanes + 1))
    return [{"lane": k, "hashes": pair[a:b].tobytes(), "places": at[a:b].tobytes()}
            for k, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]


def _shards(bodies: DataFrame, length: int) -> DataFrame:
    """The runs of places that repeat within the shard, for each unit that has any; of marks with
    several shards also the shard's distinct strings. A shard is what a task reads of whole (mark, part)
    groups until the next might not fit; a group beyond that is sorted on, unit by unit, in shards
    of its own, which then merge like the parts of a mark."""
    def run(batches):
        held: list[tuple[int, int, int, bytes, bytes]] = []

        def work(rows: list[tuple], split: bool) -> Iterator[pa.RecordBatch]:
            inside = np.ones(sum(len(r[4]) for r in rows), bool)
            for end in np.cumsum([len(r[4]) for r in rows]):
                inside[end - length + 1:end] = False  # no string runs from one unit into the next
            flags, speaks = repeated(np.frombuffer(b"".join([r[4] for r in rows]), np.uint8), length, inside)
            at, out = 0, []
            for key, _, parts, uid, body in rows:
                mine, said = flags[at:at + len(body) - length + 1], speaks[at:at + len(body) - length + 1]
                at += len(body)
                shared = parts > 1 or split  # each string of the shard once, whether it repeats in it or not
                lanes = _for_merge(np.frombuffer(body, np.uint8), said, length, parts + 1) if shared else []
                if mine.any() or lanes:
                    out.append((uid, [{"a": a, "b": b} for a, b in _runs(mine)], key, lanes))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), _RUNS, pa.int64(), _LANES))],
                                                 ["uid", "runs", "key", "lanes"])

        group: list[tuple] = []  # the units of the group that is being read
        size = {"held": 0, "group": 0}
        split = False            # whether the group went into shards of its own

        def end_group() -> Iterator[pa.RecordBatch]:
            nonlocal group, held, split
            if split:
                yield from work(group, True)
            elif group:
                if size["held"] + size["group"] > MAX_TEXT:
                    yield from work(held, False)
                    held, size["held"] = [], 0
                held += group
                size["held"] += size["group"]
            group, size["group"], split = [], 0, False

        last = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != (last[:2] if last else None):
                    yield from end_group()
                elif row[3] == last[3]:  # the same unit from another task
                    continue
                last = row
                if size["group"] + len(row[4]) > MAX_TEXT:
                    yield from work(group, True)
                    group, size["group"], split = [], 0, True
                group.append(row)
                size["group"] += len(row[4])
        yield from end_group()
        if held:
            yield from work(held, False)

    dealt = bodies.repartition("key", "part").sortWithinPartitions("key", "part", "uid")
    return dealt.mapInArrow(run, _FOUND)


def _merged(found: DataFrame) -> DataFrame:
    """(uid, runs) of the strings that repeat across shards of one mark: the sorted hashes of each
    unit are searched in those of all of the mark's units, lane by lane."""
    lanes = found.filter(F.size("lanes") > 0).select("key", "uid", F.explode("lanes").alias("x")).select(
        "key", "x.lane", "uid", "x.hashes", "x.places")

    def merge(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in table["hashes"].to_pylist()]
        kind = np.dtype([("x", "u8"), ("y", "u8")])
        every = np.sort(np.concatenate([np.ascontiguousarray(h).view(kind).ravel() for h in hashes]))
        uids, runs = [], []
        for uid, h, places in zip(table["uid"].to_pylist(), hashes, table["places"].to_pylist()):
            mine = np.ascontiguousarray(h).view(kind).ravel()
            again = np.searchsorted(every, mine, "right") - np.searchsorted(every, mine, "left") > 1
            at = np.sort(np.frombuffer(places, np.int32)[again])
            if len(at):
                flags = np.zeros(int(at[-1]) + 1, bool)
                flags[at] = True
                uids.append(uid)
                runs.append([{"a": a, "b": b} for a, b in _runs(flags)])
        return pa.Table.from_arrays([pa.array(uids, pa.binary()), pa.array(runs, _RUNS)], ["uid", "runs"])

    return lanes.groupBy("key", "lane").applyInArrow(merge, "uid binary, runs array<struct<a:int,b:int>>")


def removed(text: bytes, runs: list[tuple[int, int]], length: int) -> tuple[int, int, bytes]:
    """(bytes removed, spans removed, what is left) for runs (from, to) of places whose strings go."""
    spans: list[list[int]] = []
    for a, b in sorted(runs):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b + length - 1)
        else:
            spans.append([a, b + length - 1])
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return sum(b - a for a, b in spans), len(spans), b"".join(kept)


def dedup(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id",
          text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, n_bytes, n_removed, n_spans, kept_sha256 and, where
    asked for, kept (the bytes that stay; a cut may fall inside a character).

    Texts count as UTF-8 bytes; null and empty texts have none. Repeated rows are texts of their
    own, so each repeats the other; texts shorter than ``length`` lose nothing. An empty table gives
    an empty result. Other columns of ``docs`` are not read.
    """
    rows = scratch.table(marked(docs, doc_id, text, length, min(gram, length)), "marks")
    texts = scratch.table(rows.groupBy("t").agg(
        F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("starts").alias("starts"),
        F.first("keys").alias("keys"), F.first("selves").alias("selves")), "texts")
    last = (F.col("n_bytes") - (length - 1)).cast("int")  # the first place where no string starts
    ends = F.concat(F.slice("starts", F.lit(2), F.greatest(F.size("starts"), F.lit(1))), F.array(last))
    unit = texts.filter(F.size("keys") > 0).select("t", F.explode(F.arrays_zip(
        F.col("keys").alias("key"), F.col("starts").alias("start"), ends.alias("end"),
        F.col("selves").alias("self"))).alias("u")).select("t", "u.key", "u.start", (F.col("u.end") - F.col("u.start")).alias("places"), "u.self")
    again = unit.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("self").alias("self"), F.sum(
        F.col("places") + (length - 1)).alias("bytes")).filter("n > 1 or self")
    again = again.select("key", F.ceil(F.col("bytes") / SHARD).cast("int").alias("parts"))
    wanted = scratch.table(unit.drop("self").join(again, "key").groupBy("t").agg(F.collect_list(F.struct(
        "key", "start", "places", "parts")).alias("units")), "candidates")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    whole = docs.select(F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("t"), body.alias("body"))
    one = _passing(whole, wanted.select("t")).dropDuplicates(["t"]).join(wanted, "t").select("t", "body", "units")
    one = scratch.table(one, "candidate_texts")
    found = scratch.table(_shards(_bodies(one, length), length), "shards")
    at = scratch.table(_occurrences(one, length), "places")
    runs = found.filter(F.size("runs") > 0).select("uid", "runs").unionByName(_merged(found))
    # equal units at several places: all their strings repeat
    runs = runs.unionByName(at.groupBy("uid", "places").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "uid", F.array(F.struct(F.lit(0).alias("a"), F.col("places").alias("b"))).alias("runs")))
    runs = scratch.table(runs.groupBy("uid").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")
    hits = skew_join(at, runs, "uid", F.xxhash64("t", "start")).select("t", F.transform("runs", lambda r: F.struct(
        (r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b"))).alias("runs"))
    hits = hits.groupBy("t").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    names = ["t", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]

    def cut(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                n, spans, kept = removed(batch.column(1)[k].as_py(), [(r["a"], r["b"]) for r in batch.column(2)[k].as_py()], length)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), pa.array([n]), pa.array([spans]), pa.array([hashlib.sha256(kept).hexdigest()]),
                     pa.array([kept], pa.binary())][:len(names)], names)

    done = one.select("t", "body").join(hits, "t").mapInArrow(
        cut, "t binary, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)
    known = texts.select("t", ((F.col("copies") > 1) & (F.col("n_bytes") >= length)).alias("gone")).join(done, "t", "left")
    base = rows.select("doc_id", "sha", "t", "n_bytes")
    if with_text:
        base = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(body, 256).alias("sha"), body.alias("body")).withColumn(
            "t", F.unhex(F.substring("sha", 1, 32))).withColumn("n_bytes", F.octet_length("body").cast("bigint"))
    # a text that stands in several rows repeats itself as a whole
    pick = lambda gone, other: F.when(F.col("gone"), gone).otherwise(other)
    zero, one_ = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    cols = [F.col("doc_id").alias(doc_id), "n_bytes", pick(F.col("n_bytes"), F.coalesce("n_removed", zero)).alias("n_removed"),
            pick(one_, F.coalesce("n_spans", zero)).alias("n_spans"),
            pick(F.sha2(F.lit(b""), 256), F.coalesce("kept_sha256", "sha")).alias("kept_sha256")]
    if with_text:
        cols.append(pick(F.lit(b""), F.coalesce("kept", "body")).alias("kept"))
    return skew_join(base, known, "t", F.xxhash64("doc_id")).select(*cols)
