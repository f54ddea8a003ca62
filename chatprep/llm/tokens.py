"""Words of a batch of texts as arrays: places and hashes, for a whole Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are worked on at once: arrays of words take some sixty times as much.
WORK_BYTES = 256 << 10

#: Odd multipliers of the word hash and of its final mixing (any odd numbers do).
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Bytes of lower-cased alphanumeric words: 0-9, a-z and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_POWERS = np.cumprod(np.full(64, _BASE, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def by_bytes(batch: pa.RecordBatch, column: int, limit: int = WORK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about ``limit`` bytes of a binary or string column at a time, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    sizes = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a batch: ``start``/``end`` in ``data`` (lower-cased bytes), ``doc``, ``hash``;
    ``first[d]:first[d + 1]`` are the words of text d."""

    def __init__(self, column: pa.Array, kind: np.ndarray = ALNUM):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        raw = column.buffers()[2]
        base = int(offsets[0])
        data = np.frombuffer(raw, np.uint8)[base:int(offsets[-1])] if raw is not None else np.zeros(0, np.uint8)
        data = _LOWER[data]
        offsets = offsets - base
        inside = kind[data]
        # a word begins where a word byte follows another byte or the start of a text
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        cut = offsets[1:-1]
        before[cut[cut < len(before)]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        last = cut[(cut > 0) & (cut <= len(after))] - 1
        after[last] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.data = data
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(column)), np.diff(self.first))
        # polynomial hash of each word's bytes, with the place counted modulo 64 and then mixed
        place = np.arange(len(data), dtype=np.int64)
        if len(self.start):
            lengths = self.end - self.start
            mine = np.repeat(np.arange(len(self.start)), lengths)
            at = place[inside] - self.start[mine]
            value = (data[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[at & 63]
            long_ = at >= 64
            if long_.any():  # far places get a multiplier of their own
                value[long_] = mix(value[long_] + at[long_].astype(np.uint64) * _MIX1)
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            self.hash = mix(np.add.reduceat(value, begin) + lengths.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def text(self, a: int, b: int) -> str:
        """Words a to b (exclusive) joined by spaces."""
        return " ".join([bytes(self.data[self.start[i]:self.end[i]]).decode() for i in range(a, b)])


def stretches(text: bytes, overlap: int, limit: int = WORK_BYTES, kind: np.ndarray = ALNUM) -> Iterator[tuple[Words, int]]:
    """The words of a long text, ``limit`` bytes or little more at a time, each time with the number
    of its first word. Stretches end between words and share ``overlap`` words, so that every run
    of overlap + 1 words lies in one of them."""
    data = np.frombuffer(text, np.uint8)
    at, number, size = 0, 0, limit
    while True:
        end = at + size
        while end < len(data):  # to the end of a word
            gap = np.flatnonzero(~kind[_LOWER[data[end:end + 4096]]])
            if len(gap):
                end += int(gap[0])
                break
            end += 4096
        words = Words(pa.array([text[at:end]], pa.binary()), kind)
        if end < len(data) and len(words.start) <= overlap:  # very long words
            size *= 2
            continue
        yield words, number
        if end >= len(data):
            return
        skip = len(words.start) - overlap
        at, number, size = at + (int(words.start[skip]) if overlap else end - at), number + skip, limit


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes, in order."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * _BASE + words[k:k + m]
    return mix(out)
