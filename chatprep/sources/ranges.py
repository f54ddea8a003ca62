"""Big documents read by byte ranges: JSON exports and quoted CSV files.

Both are cut by Spark's own splittable text reader at a byte that ends every record (``}`` or the
line break) but also stands inside records and strings. What a piece is depends on all bytes before
it, so a first pass sums up every range for either state of the quotes at its start, a scan over
the ranges of a file (a few numbers each) gives each range's real state, and a second pass cuts
its records. Records that cross ranges leave fragments, which are put together by their number.
Nothing holds more than a range's open record.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.session import scratch_path

# Python workers need not have this package installed: its code travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes that are looked at together.
CHUNK = 1 << 20
#: Rows of the table of ranges that are broadcast at most.
BROADCAST_RANGES = 20_000
_ESCAPE = re.compile(rb"\\.", re.S)
_QUOTE, _OPEN, _CLOSE = ord('"'), b"{[", b"}]"


def _pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, at, row, piece): the text between separators, by file and start of its range, in order."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", sep).text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("at"),
        F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("piece"))


#: Records of a range that follow each other: number of the first, their bytes end to end, their
#: bounds in these, and whether they are whole.
Block = tuple[int, bytes, np.ndarray, bool]


def _one(number: int, text: bytes, whole: bool) -> Block:
    return number, text, np.array([0, len(text)], np.int32), whole


def _runs(batches, sep: bytes) -> Iterator[tuple[int, bytes, pa.RecordBatch]]:
    """(first row, bytes, batch) of neighbouring pieces of one range, CHUNK bytes or one
    piece at a time, each piece with its separator."""
    for batch in batches:
        files, starts, pieces = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "at", "piece"))
        first, size = 0, 0
        for k in range(len(pieces) + 1):
            end = k == len(pieces)
            if k > first and (end or size > CHUNK or starts[k] != starts[k - 1] or files[k] != files[k - 1]):
                yield first, b"".join([x for p in pieces[first:k] for x in (p, sep)]), batch
                first, size = k, 0
            if not end:
                size += len(pieces[k])


class JsonScan:
    """Where objects end in the array under a key of a document's root object."""

    def __init__(self, key: str):
        self.opening = re.compile(b'"' + re.escape(key.encode()) + rb'"\s*:\s*\[')

    def brackets(self, data: bytes, quoted: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places of the brackets outside strings, +1 or -1 for each, and the quote state at the end."""
        if b"\\" in data:
            data = _ESCAPE.sub(b"__", data)
        a = np.frombuffer(data, np.uint8)
        kind = np.zeros(256, np.int8)
        kind[list(_OPEN)], kind[list(_CLOSE)], kind[_QUOTE] = 1, -1, 2
        at = np.flatnonzero(kind[a])
        step = kind[a[at]]
        quotes = np.cumsum(step == 2) + quoted
        outside = (step != 2) & (quotes & 1 == 0)
        return at[outside], step[outside], int(quotes[-1] & 1) if len(quotes) else quoted

    def openings(self, data: bytes) -> set[int]:
        """Places of the bracket after the key."""
        return {m.end() - 1 for m in self.opening.finditer(data)}

    def empty(self, quoted: int) -> dict:
        """What a range does, started with ``quoted`` at depth 0: its quote state, depth and lowest
        depth so far; ``head``: by depth of an array open at the start, the objects that end in it;
        ``found``: [depth, objects, whether open] of arrays under the key that begin here."""
        return {"quoted": quoted, "depth": 0, "low": 0, "head": {}, "found": []}

    def add(self, s: dict, data: bytes) -> None:
        at, step, s["quoted"] = self.brackets(data, s["quoted"])
        if not len(at):
            return
        level = s["depth"] + np.cumsum(step, dtype=np.int64)
        # the lowest depth before each bracket: an array is open while depth stays at or above its own
        lowest = np.minimum.accumulate(np.concatenate([[s["low"]], level]))
        ends = np.flatnonzero((step < 0) & (np.frombuffer(data, np.uint8)[at] == ord("}")) & (level <= lowest[:-1]))
        for e, n in zip(*np.unique(level[ends], return_counts=True)):
            s["head"][int(e)] = s["head"].get(int(e), 0) + int(n)
        for x in s["found"]:
            self._count(x, 0, at, step, level, data)
        for k in np.flatnonzero(np.isin(at, list(self.openings(data)))).tolist():
            s["found"].append([int(level[k]), 0, True])
            self._count(s["found"][-1], k + 1, at, step, level, data)
        s["low"], s["depth"] = int(lowest[-1]), int(level[-1])

    @staticmethod
    def side(s: dict) -> dict:
        return s | {"head": [{"level": k, "n": v} for k, v in sorted(s["head"].items())],
                    "found": [{"level": x[0], "n": x[1], "open": x[2]} for x in s["found"]]}

    @staticmethod
    def _count(x: list, k: int, at: np.ndarray, step: np.ndarray, level: np.ndarray, data: bytes) -> None:
        """Adds to x = [depth, objects, open] what follows from bracket k on."""
        if not x[2]:
            return
        out = np.flatnonzero(level[k:] < x[0])
        to = k + int(out[0]) if len(out) else len(level)
        x[1] += int(((level[k:to] == x[0]) & (step[k:to] < 0) & (np.frombuffer(data, np.uint8)[at[k:to]] == ord("}"))).sum())
        x[2] = not len(out)

    @staticmethod
    def follow(state: dict, s: list[dict]) -> dict:
        """The state after a range, from the state before it and the range's two summaries."""
        got = s[state["quoted"]]
        level, inside, number = 2 - state["depth"], state["inside"], state["number"]
        if inside:
            number += sum(x["n"] for x in got["head"] if x["level"] == level)
            inside = got["low"] >= level
        for x in got["found"]:
            if x["level"] == level:  # under the key, in the root object
                number, inside = number + x["n"], x["open"]
        return {"quoted": got["quoted"], "depth": state["depth"] + got["depth"], "inside": inside, "number": number}

    start = {"quoted": 0, "depth": 0, "inside": False, "number": 0}

    @staticmethod
    def check_end(state: dict, file: str) -> None:
        if state["quoted"] or state["inside"]:
            raise ValueError(f"the document ends inside its records: {file}")

    def records(self, chunks: Iterator[bytes], state: dict, alone: bool) -> Iterator[Block]:
        """The objects that end in a range; the first, which may begin before it, and what is open
        at its end are fragments. ``alone``: the range is a whole file."""
        quoted, depth, inside, number = (state[k] for k in ("quoted", "depth", "inside", "number"))
        held, first = b"", inside  # bytes since the last end; whether the record began before the range
        for data in chunks:
            at, step, quoted = self.brackets(data, quoted)
            level = depth + np.cumsum(step, dtype=np.int64)
            opens = self.openings(data)
            done = 0  # bytes of this chunk that belong to finished records, or to none
            # brackets that matter: ends of objects at depth 2, ends of the array, and its opening
            matter = np.flatnonzero(((level == 2) & (step < 0)) | ((level == 1) & (step < 0)) | ((level == 2) & (step > 0)))
            ends_object = (np.frombuffer(data, np.uint8)[at[matter]] == ord("}")) & (level[matter] == 2) & (step[matter] < 0)
            other = np.flatnonzero(~ends_object).tolist()
            for begin, end in zip([0, *(k + 1 for k in other)], [*other, len(matter)]):
                if inside and end > begin:  # objects that end one after the other
                    ends = (at[matter[begin:end]] + 1).astype(np.int32)
                    yield _one(number, held + data[done:ends[0]], not first)
                    if len(ends) > 1:
                        yield number + 1, data, ends, True
                    held, done, first, number = b"", int(ends[-1]), False, number + len(ends)
                if end == len(matter):
                    break
                k, place = matter[end], int(at[matter[end]])
                if not inside:
                    if level[k] == 2 and step[k] > 0 and place in opens:
                        inside, held, done, first = True, b"", place + 1, False
                elif level[k] == 1:
                    if data[place] != ord("]"):
                        raise ValueError("the document ends inside its records")
                    rest = held + data[done:place]
                    if first or rest.strip(b" \t\r\n,"):  # the end of a fragment, or something that is no object
                        yield _one(number, rest, not first)
                    inside, held = False, b""
            if inside:
                held += data[done:]
            depth = int(level[-1]) if len(level) else depth
        if alone and (inside or quoted):
            raise ValueError("the document ends inside its records")
        if inside and held:
            yield _one(number, held, False)


class CsvScan:
    """Where records end: at line breaks outside quotes. A doubled quote leaves the state as it was."""

    start = {"quoted": 0, "number": 0}

    def _ends(self, data: bytes, quoted: int) -> tuple[np.ndarray, int]:
        a = np.frombuffer(data, np.uint8)
        at = np.flatnonzero((a == _QUOTE) | (a == 10))
        quotes = np.cumsum(a[at] == _QUOTE) + quoted
        return at[(a[at] == 10) & (quotes & 1 == 0)], int(quotes[-1] & 1) if len(quotes) else quoted

    def empty(self, quoted: int) -> dict:
        return {"quoted": quoted, "depth": 0, "low": 0, "head": [], "found": []}

    def add(self, s: dict, data: bytes) -> None:
        at, s["quoted"] = self._ends(data, s["quoted"])
        s["depth"] += len(at)  # records that end

    @staticmethod
    def side(s: dict) -> dict:
        return s

    @staticmethod
    def check_end(state: dict, file: str) -> None:
        if state["quoted"]:
            raise ValueError(f"the file ends inside quotes: {file}")

    @staticmethod
    def follow(state: dict, s: list[dict]) -> dict:
        got = s[state["quoted"]]
        return {"quoted": got["quoted"], "number": state["number"] + got["depth"]}

    def records(self, chunks: Iterator[bytes], state: dict, alone: bool) -> Iterator[Block]:
        quoted, number = state["quoted"], state["number"]
        held, first = b"", bool(quoted)
        for data in chunks:
            at, quoted = self._ends(data, quoted)
            ends = (at + 1).astype(np.int32)
            if len(ends):
                yield _one(number, held + data[:ends[0]], not first)
                if len(ends) > 1:
                    yield number + 1, data, ends, True
                held, first, number = b"", False, number + len(ends)
            held += data[ends[-1] if len(ends) else 0:]
        if alone and quoted:
            raise ValueError("the file ends inside quotes")
        if held:
            yield _one(number, held, False)


_SIDE = "struct<quoted:int,depth:bigint,low:bigint,head:array<struct<level:bigint,n:bigint>>,found:array<struct<level:bigint,n:bigint,open:boolean>>>"


def _grouped(batches, sep: str) -> Iterator[tuple[tuple, Iterator[bytes], dict]]:
    """For each range, in order: (file, at), its chunks, and the other columns of its first row."""
    runs = _runs(batches, sep.encode())
    now = next(runs, None)
    while now is not None:
        first, _, batch = now
        row = {c: batch.column(i)[first].as_py() for i, c in enumerate(batch.schema.names) if c != "piece"}
        key = row["file"], row["at"]

        def chunks():
            nonlocal now
            while now is not None:
                k, data, b = now
                if (b.column(b.schema.get_field_index("file"))[k].as_py(), b.column(b.schema.get_field_index("at"))[k].as_py()) != key:
                    return
                now = next(runs, None)
                yield data

        body = chunks()
        yield key, body, row
        for _ in body:  # what the caller left
            pass


def scan_records(spark: SparkSession, path: str, scan, sep: str) -> DataFrame:
    """(file, number, text): the records of every file that ``path`` names, numbered from 0 in it.

    Where every file is one range, it is cut in one reading. Else the files are read three times:
    for the summaries, for the records within a range, and for the fragments of files of several
    ranges, two for each range. A range's state reaches its pieces by a join on (file, range). The
    table of ranges is written to the shared folder, by a job that runs at the call, and counted:
    up to BROADCAST_RANGES rows of about a hundred bytes are broadcast, beyond that the pieces of a
    range meet in one task and are put in order again.
    """
    pieces = _pieces(spark, path, sep)

    def sum_up(batches):
        for (file, at), body, _ in _grouped(batches, sep):
            sides = [scan.empty(0), scan.empty(1)]
            for data in body:
                for s in sides:
                    scan.add(s, data)
            yield pa.RecordBatch.from_pylist([{"file": file, "at": at, "sides": [scan.side(s) for s in sides]}], pa.schema([
                ("file", pa.string()), ("at", pa.int64()), ("sides", pa.list_(_arrow_side()))]))

    def follow(table: pa.Table) -> pa.Table:
        state, out = dict(scan.start), []
        for r in sorted(table.to_pylist(), key=lambda r: r["at"]):
            out.append({"file": r["file"], "at": r["at"], "quoted": 0, "depth": 0, "inside": False, "number": 0,
                        "ranges": table.num_rows} | state)
            state = scan.follow(state, r["sides"])
        scan.check_end(state, out[0]["file"])
        return pa.Table.from_pylist(out, pa.schema([
            ("file", pa.string()), ("at", pa.int64()), ("quoted", pa.int32()), ("depth", pa.int64()), ("inside", pa.bool_()),
            ("number", pa.int64()), ("ranges", pa.int64())]))

    names = ["file", "at", "number", "text"]

    def cut(wanted: bool):
        def run(batches):
            for (file, at), body, row in _grouped(batches, sep):
                alone = "number" not in row
                single: list[tuple[int, bytes]] = []
                for number, data, bounds, whole in scan.records(body, scan.start if alone else row, alone):
                    if whole != wanted:
                        continue
                    n = len(bounds) - 1
                    if n == 1:
                        single.append((number, data[bounds[0]:bounds[1]]))
                        continue
                    text = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([pa.repeat(file, n), pa.repeat(at, n), pa.array(np.arange(number, number + n)), text], names)
                if single:  # one or two for each chunk
                    n = len(single)
                    yield pa.RecordBatch.from_arrays([pa.repeat(file, n), pa.repeat(at, n), pa.array([x[0] for x in single]),
                                                      pa.array([x[1] for x in single], pa.binary())], names)
        return run

    schema = "file string, at bigint, number bigint, text binary"
    if pieces.where("at > 0").isEmpty():  # every file is one range, whose start is that of the file
        return pieces.drop("row").mapInArrow(cut(True), schema).select("file", "number", F.col("text").cast("string").alias("text"))
    ranges = pieces.select("file", "at", "piece").mapInArrow(sum_up, f"file string, at bigint, sides array<{_SIDE}>")
    table = scratch_path(spark, "file_ranges", uuid.uuid4().hex)
    state_schema = "file string, at bigint, quoted int, depth bigint, inside boolean, number bigint, ranges bigint"
    ranges.groupBy("file").applyInArrow(follow, state_schema).write.parquet(table)
    states = spark.read.schema(state_schema).parquet(table)

    small = states.count() <= BROADCAST_RANGES

    def ready(some: DataFrame) -> DataFrame:
        if small:  # the pieces stay where they are, in order
            return pieces.join(F.broadcast(some), ["file", "at"]).drop("row", "ranges")
        return pieces.join(some, ["file", "at"]).sortWithinPartitions("file", "at", "row").drop("row", "ranges")

    whole = ready(states).mapInArrow(cut(True), schema).select("file", "number", "text")
    parts = ready(states.where("ranges > 1")).mapInArrow(cut(False), schema).groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("at", "text")))["text"].alias("parts"))
    parts = parts.select("file", "number", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x)).alias("text"))
    return whole.unionByName(parts).withColumn("text", F.col("text").cast("string"))


def _arrow_side() -> pa.DataType:
    level = [("level", pa.int64()), ("n", pa.int64())]
    return pa.struct([("quoted", pa.int32()), ("depth", pa.int64()), ("low", pa.int64()), ("head", pa.list_(pa.struct(level))),
                      ("found", pa.list_(pa.struct([*level, ("open", pa.bool_())])))])
