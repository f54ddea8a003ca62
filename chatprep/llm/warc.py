"""WARC archives, written and read through an index.

Writing: payload digests decide which record carries a payload (response) and which only points
to it (revisit); each task writes its records, one gzip member each, to a file of its own in the
shared folder, and the index keeps file, offset, length, url and digest of every record. Reading
starts from the index: selected records are sorted by file and offset, neighbouring byte ranges
are coalesced, and each coalesced range is one read. Files are opened with ``pyarrow.fs``, which
takes the uri of the shared folder (local, HDFS, S3, ...). A task that is run again writes a file
of another name; only files named by the index count.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from chatprep.llm.common import HOT_SHARE, Scratch, skew_join

#: Ranges are coalesced over gaps of at most GAP bytes, into reads of at most about READ bytes.
GAP = 64 << 10
READ = 4 << 20
#: A file is closed, and the next begun, at this size.
FILE_BYTES = 512 << 20
#: A reading task has about so many bytes of the archives.
TASK_BYTES = 128 << 20

INDEX = ("file string, offset bigint, length bigint, url string, page_id bigint, digest string, "
         "payload_bytes bigint, record_type string, refers_to bigint")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _field(value: object) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in str(value))


def record_bytes(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str,
                 refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header but not the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            ).encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {url} {digest} {kind}')}>",
            "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {len(payload)}",
            f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers (lower-case names), payload (None for a revisit) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("record of another length than its header says")
    payload = block.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else None
    return {"fields": fields, "payload": payload}


def record_types(pages: DataFrame, scratch: Scratch, min_bytes: int, page_id: str, payload: str) -> DataFrame:
    """(page_id, sha, n_bytes, first): of each payload, the smallest page_id that has it.

    Small rows only: payloads don't move here.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    keys = scratch.table(pages.select(F.col(page_id).alias("page_id"), F.sha1(body).alias("sha"),
                                      F.octet_length(body).cast("bigint").alias("n_bytes")), "keys")
    groups = scratch.table(keys.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")), "groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r[0] for r in groups.filter(F.col("n") * HOT_SHARE > max(total, 10_000)).select("sha").collect()]
    return skew_join(keys.distinct(), groups.select("sha", "first"), "sha", F.col("page_id"), hot=hot).withColumn(
        "first", F.when(F.col("n_bytes") >= min_bytes, F.col("first")).otherwise(F.col("page_id")))


def write_archives(pages: DataFrame, scratch: Scratch, min_bytes: int = 0, page_id: str = "page_id",
                   url: str = "url", payload: str = "html") -> DataFrame:
    """Writes a record for every row of ``pages`` and returns the index (columns of INDEX).

    Equal payloads of at least ``min_bytes`` bytes: the row with the smallest id is a response,
    the others revisit it (rows that repeat an id and payload: one of them is the response).
    Null payloads count as empty; rows with a null id come after all others. An empty table
    gives no file and an empty index.
    """
    types = record_types(pages, scratch, min_bytes, page_id, payload)
    body = F.coalesce(F.col(payload), F.lit(""))
    same = ["id", "no_id", "sha"]  # the join's keys, null ids told by the second
    keyed = lambda df: df.withColumn("id", F.coalesce("page_id", F.lit(0))).withColumn("no_id", F.isnull("page_id"))
    rows = keyed(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.cast("binary").alias("body"),
                              F.sha1(body.cast("binary")).alias("sha")))
    # the window keeps rows of one id and payload in one task, however the join is run; one of them is new
    rows = rows.join(keyed(types).select(*same, "first"), same).withColumn(
        "new", F.row_number().over(W.partitionBy(*same).orderBy("url")) == 1).select("page_id", "url", "body", "first", "new")
    folder = f"{scratch.path}/archives"

    def write(batches):
        files, at = None, ("", 0)
        out = None
        try:
            for batch in batches:
                index = []
                for k in range(batch.num_rows):
                    pid, link, data, first, new = (batch.column(c)[k].as_py() for c in range(5))
                    digest = base32_sha1(data)
                    kind = "response" if pid == first and (new or len(data) < min_bytes) else "revisit"
                    refers = first if kind == "revisit" else None
                    member = _member(record_bytes(kind, pid, link, data, digest, refers))
                    if out is None or at[1] + len(member) > FILE_BYTES:
                        if out is not None:
                            out.close()
                        files, path = _open(folder)
                        files.create_dir(path, recursive=True)
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out, at = files.open_output_stream(f"{path}/{name}", compression=None), (f"{folder}/{name}", 0)
                    out.write(member)
                    index.append((at[0], at[1], len(member), link, pid, digest, len(data), kind, refers))
                    at = at[0], at[1] + len(member)
                yield pa.RecordBatch.from_pydict({
                    name: pa.array([r[c] for r in index], kind_) for c, (name, kind_) in enumerate(_INDEX_TYPES)})
        finally:
            if out is not None:
                out.close()

    return scratch.table(rows.mapInArrow(write, INDEX), "index")


_INDEX_TYPES = [(x.split()[0], pa.string() if x.split()[1] == "string" else pa.int64()) for x in INDEX.split(", ")]


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def coalesced(selected: DataFrame, gap: int = GAP, read: int = READ) -> DataFrame:
    """(file, begin, end, records): byte ranges that cover the selected index rows.

    Records of a file, sorted by offset, share a range while the gap to the next is at most
    ``gap`` and the range begins in the same stretch of ``read`` bytes.
    """
    by_file = W.partitionBy("file", "stretch").orderBy("offset")
    fresh = F.when(F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(by_file) <= gap, 0).otherwise(1)
    return (selected.select("file", "offset", "length").withColumn("stretch", F.floor(F.col("offset") / read))
            .withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by_file))
            .groupBy("file", "stretch", "run")
            .agg(F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"),
                 F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
            .select("file", "begin", "end", "records"))


def dealt_ranges(selected: DataFrame, gap: int = GAP, read: int = READ, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``coalesced`` ranges, dealt out by the bytes they cover of the archives, not by the small rows
    that name them: a task for every ``task_bytes``, and for small reads one for every range, up to the
    cores there are. Each task reads its ranges in order of file and offset."""
    total = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    cores = selected.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, math.ceil(total / task_bytes), min(cores, math.ceil(total / read)))
    return coalesced(selected, gap, read).repartition(tasks, "file", "begin").sortWithinPartitions("file", "begin")


def read_records(selected: DataFrame, with_payload: bool = False, gap: int = GAP, read: int = READ,
                 task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records of the selected index rows, from the archives: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, and the payload where asked for (null for revisits).
    Page ids are integers, as the index keeps them.

    Every payload that is read is checked against its digest and length; a mismatch raises.
    """
    schema = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
              "refers_to bigint" + (", payload binary" if with_payload else ""))

    def run(batches):
        for batch in batches:
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                files, path = _open(r["file"])
                with files.open_input_file(path) as f:
                    f.seek(r["begin"])
                    data = f.read(r["end"] - r["begin"])
                cols: list[list] = [[] for _ in range(6 + with_payload)]
                for rec in r["records"]:
                    at = rec["offset"] - r["begin"]
                    got = parse_record(zlib.decompress(data[at:at + rec["length"]], 31))
                    f, body = got["fields"], got["payload"]
                    digest, size = f["warc-payload-digest"].removeprefix("sha1:"), int(f["x-payload-bytes"])
                    if body is not None and (base32_sha1(body) != digest or len(body) != size):
                        raise ValueError(f"payload of {r['file']} at {rec['offset']} does not match its digest")
                    number = lambda name: int(f[name]) if name in f else None  # noqa: B023,E731
                    for col, v in zip(cols, (number("x-page-id"), f.get("warc-target-uri"), size, digest,
                                             f["warc-type"], number("x-refers-to-page"), body)):
                        col.append(v)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return dealt_ranges(selected, gap, read, task_bytes).mapInArrow(run, schema)
