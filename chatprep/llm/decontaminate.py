"""Benchmark decontamination by winnowing.

A window is a run of ``window`` words of a benchmark item. Of the k-gram hashes of each window
the smallest is kept, in texts as in items; so a text and an item that share a whole window keep
a common fingerprint inside it, whatever surrounds it. Text fingerprints are joined to item
fingerprints, and each hit is extended over the windows around it, word by word. Items shorter
than a window are windows of their own length, whose fingerprint is the hash of all their words;
texts give the hashes of those lengths too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import Scratch, skew_join
from chatprep.llm.tokens import WORK_BYTES, Words, by_bytes, gram_hashes, stretches

WINDOW = 10
GRAM = 5
#: Bits of the filter of item fingerprints that every task reads: its size is fixed, 2 MB.
FILTER_BITS = 24


def winnow(hashes: np.ndarray, per_window: int) -> np.ndarray:
    """Places of the hashes that are the smallest of some run of ``per_window`` hashes (ties: all)."""
    n = len(hashes) - per_window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = hashes[:n].copy()
    for k in range(1, per_window):
        np.minimum(low, hashes[k:k + n], out=low)
    kept = np.zeros(len(hashes), bool)
    for k in range(per_window):
        kept[k:k + n] |= hashes[k:k + n] == low
    return np.flatnonzero(kept)


def item_windows(items: DataFrame, window: int, gram: int, text: str, item_id: str) -> DataFrame:
    """(item_id, size, body, h, at): each window's words and its fingerprints, with their place."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                w = Words(batch.column(1).slice(k, 1))
                n = len(w.hash)
                if not n:
                    continue
                size = min(window, n)
                g = min(gram, size) if n >= window else size
                rows = {}
                for s in range(n - size + 1):
                    body = w.text(s, s + size)
                    if body not in rows:
                        hs = gram_hashes(w.hash[s:s + size], g)
                        rows[body] = [(int(hs[i]), int(i)) for i in winnow(hs, len(hs))]
                flat = [(body, h, at) for body, x in rows.items() for h, at in x]
                yield pa.RecordBatch.from_pydict({
                    "item_id": pa.array([batch.column(0)[k].as_py()] * len(flat), batch.column(0).type),
                    "size": pa.array([size] * len(flat), pa.int32()), "body": [x[0] for x in flat],
                    "h": pa.array(np.array([x[1] for x in flat], np.uint64).view(np.int64)),
                    "at": pa.array([x[2] for x in flat], pa.int32())})

    kind = dict(items.dtypes)[item_id]
    return (items.select(F.col(item_id).alias("item_id"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
            .mapInArrow(run, f"item_id {kind}, size int, body string, h bigint, at int"))


def fingerprint_filter(fingerprints: DataFrame) -> np.ndarray:
    """A bit table of the hashes: bit (h mod 2^FILTER_BITS). At most 2^(FILTER_BITS - 6) words of
    64 bits reach the driver, whatever the number of fingerprints; fuller tables let more pass."""
    slot = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = (fingerprints.select(F.shiftright(slot, 6).cast("int").alias("word"),
                                 F.expr(f"shiftleft(1L, cast(h & 63 AS int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in words:
        table[r["word"]] = r["bits"]
    return table.view(np.uint64)


def text_fingerprints(docs: DataFrame, table: np.ndarray, sizes: list[int], window: int, gram: int, text: str,
                      keep: tuple[str, ...]) -> DataFrame:
    """``keep``, n_words, hits: fingerprints of each text that pass the filter.

    A hit holds its hash, its place, the window size that it stands for, and the words around it
    (those of all windows that it lies in), from word ``from``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)
    n_keep = len(keep)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes), "n_words bigint",
                        "hits array<struct<h:bigint,pos:int,size:int,from:int,words:string>>"])
    hit_type = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()),
                                   ("from", pa.int32()), ("words", pa.string())]))

    def run(batches):
        bits = shared.value

        def passes(h):
            slot = h & np.uint64((1 << FILTER_BITS) - 1)
            return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

        def hits_of(w, number):
            """The hits of each text of ``w``, whose words are numbered from ``number``."""
            found = [[] for _ in range(len(w.first) - 1)]
            for size in sizes:
                g = gram if size == window else size
                hashes = gram_hashes(w.hash, g)
                per = size - g + 1
                whole = w.doc[:len(hashes)] == w.doc[g - 1:] if len(hashes) else np.zeros(0, bool)
                # winnowing works on runs inside one text; fingerprints of runs across two are no match for any item
                pick = winnow(hashes, per)
                pick = pick[whole[pick]]
                pick = pick[passes(hashes[pick])]
                for p in pick.tolist():
                    d = int(w.doc[p])
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    lo, hi = max(a, p - (per - 1)), min(b, p + size)
                    found[d].append({"h": int(hashes[p].view(np.int64)), "pos": p - a + number, "size": size,
                                     "from": lo - a + number, "words": w.text(lo, hi)})
            return found

        for batch in batches:
            for part in by_bytes(batch, n_keep, WORK_BYTES):
                if part.num_rows > 1 or len(part.column(n_keep)[0].as_buffer()) <= WORK_BYTES:
                    w = Words(part.column(n_keep))
                    counts, found = np.diff(w.first), hits_of(w, 0)
                else:  # a long text, a stretch at a time; a hit in what two stretches share may come twice
                    counts, found = [0], [[]]
                    for w, number in stretches(part.column(n_keep)[0].as_py(), window - 1, WORK_BYTES):
                        counts[0] = number + len(w.start)
                        found[0] += hits_of(w, number)[0]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(n_keep)]
                    + [pa.array(counts, pa.int64()), pa.array(found, hit_type)], [*keep, "n_words", "hits"])

    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text")).mapInArrow(run, schema)


def contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM,
                 text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_text: str = "text",
                 item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(texts, hits). texts: rid, ``keep``, n_words, one row per row of ``docs``. hits: rid,
    item_id, start, size, body: the windows of items that stand in a text, word for word.

    Null texts and items have no words. Repeated rows are searched each on its own; repeated
    items (same id and words) count once. Empty tables give empty results.
    """
    windows = scratch.table(item_windows(items, window, gram, item_text, item_id), "windows")
    prints = windows.select("size", "body", "h", "at").distinct()
    sizes = sorted({window, *(r[0] for r in prints.select("size").distinct().collect())})  # 1 to window
    table = fingerprint_filter(prints.select("h"))
    rows = text_fingerprints(docs, table, sizes, window, gram, text, keep)
    rows = scratch.table(rows.select(F.monotonically_increasing_id().alias("rid"), *keep, "n_words", "hits"), "texts")
    hits = rows.select("rid", F.explode("hits").alias("x")).select("rid", "x.h", "x.pos", F.col("x.size").alias("size"),
                                                                   "x.from", "x.words")
    met = skew_join(hits, prints.withColumnRenamed("size", "item_size"), "h", F.xxhash64("rid", "pos"))
    start = F.col("pos") - F.col("at")
    span = F.array_join(F.slice(F.split("words", " "), F.greatest(start - F.col("from"), F.lit(0)) + 1,
                                F.col("size")), " ")
    met = (met.filter((F.col("size") == F.col("item_size")) & (start >= F.col("from")) & (span == F.col("body")))
           .select("rid", start.alias("start"), "size", "body").distinct())
    return rows.drop("hits"), scratch.table(met, "met"), windows.select("item_id", "body").distinct()


def report(docs: DataFrame, items: DataFrame, scratch: Scratch, keep: tuple[str, ...] = ("doc_id",),
           **options) -> DataFrame:
    """One row per row of ``docs``: ``keep``, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, met, windows = contaminated(docs, items, scratch, keep=keep, **options)
    words = met.groupBy("rid").agg(F.size(F.array_distinct(F.flatten(F.collect_list(
        F.sequence("start", F.col("start") + F.col("size") - 1))))).cast("long").alias("n_hit"))
    found = skew_join(met.select("rid", "body").distinct(), windows, "body", F.col("rid"))
    ids = (found.select("rid", F.col("item_id").cast("string").alias("i")).distinct().groupBy("rid")
           .agg(F.count("i").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("i")), ","), 256)
                .alias("items_sha256")))
    out = rows.join(words.join(ids, "rid"), "rid", "left")
    none = F.lit(0).cast("long")
    return out.select(*keep, "n_words", F.coalesce("n_hit", none).alias("n_hit"),
                      F.coalesce("n_items", none).alias("n_items"),
                      F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                      (F.coalesce("n_hit", none) > 0).alias("contaminated"))


def clean_rows(docs: DataFrame, items: DataFrame, scratch: Scratch, text: str = "text", doc_id: str = "doc_id",
               **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item; the columns are those of ``docs``."""
    mark = F.xxhash64(text)
    rows = report(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"), mark.alias("_mark")), items, scratch,
                  keep=("_id", "_mark"), **options)
    hit = rows.filter("contaminated").select("_id", "_mark").distinct()
    found = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_doc_id"), mark.alias("_m"))
    same = F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_m") == F.col("_mark"))
    return found.join(hit, same, "left_anti").select("_row.*")
