"""BPE encoding and decoding over a trie of distinct words.

A vocabulary file of the ``tokenizers`` library (BPE with word ends) is applied word by word.
Words are sequences of symbols; the distinct words of a batch go into a trie, and a depth-first
walk carries, for every prefix, the last token of its encoding. The encoding of a prefix that
ends in token t is the encoding of what stands before t, plus t, if t may follow that prefix's
own last token; so each shared prefix is worked out once, and a word's ids are read back along
the chain of last tokens. Whether two tokens may stand side by side follows from the merges that
make them, undone from the last one back, and is looked up once per pair.
"""

from __future__ import annotations

import gc
import hashlib
import re
import sys
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words that a worker remembers: when half as many are new, those not met meanwhile go.
MAX_REMEMBERED = 300_000
_SPLIT = re.compile(r"[ \n\t\r\f\v]+")
# A common split pattern, and what it comes to for lower-case printable ASCII.
_KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class WordBpe:
    """Encoder for one vocabulary file (its path is a parameter; nothing is copied)."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = self.library.normalizer, self.library.pre_tokenizer
        # files of this kind need no library call for printable ASCII
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.simple_ascii = (steps == ["NFC", "Replace", "Lowercase"] and len(cuts) == 2
                             and cuts[0].get("pattern", {}).get("Regex") == _KNOWN_SPLIT
                             and cuts[1]["type"] == "ByteLevel" and not cuts[1]["add_prefix_space"])
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ranks: dict[tuple[str, str], int] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[a, b] = k
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        marks = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.special_re = re.compile(f"({marks})") if marks else None
        # tokens by their symbols, as a trie over the reversed symbols: all tokens that end here
        self.suffixes: dict = {}
        self.tokens: list[dict] = []
        for token in {a + b for a, b in self.ranks} | {s for s in self.vocab if len(self._symbols(s)) == 1}:
            if token in self.vocab:
                node = self.suffixes
                for s in reversed(self._symbols(token)):
                    node = node.setdefault(s, {})
                node[None] = {0: token}  # and whether it may follow others, by their names
                self.tokens.append(node[None])
        self.id_bytes = {s: i.to_bytes(4, "little") for s, i in self.vocab.items()}
        self.n_pairs = 0
        self.last_merges: dict[str, tuple[str, str, int] | None] = {}
        # what is known of pieces of text: ids as little-endian uint32, and names; the older half, too
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}
        self.old: tuple[dict[str, bytes], dict[str, str]] = ({}, {})

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[:-len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _last_merge(self, token: str) -> tuple[str, str, int] | None:
        """The two parts whose merge makes the token, and that merge's rank; rank -1 and no parts
        for one symbol; None for a token that merging its symbols by rank doesn't give."""
        if token not in self.last_merges:
            parts, found = self._symbols(token), ("", "", -1)
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), sys.maxsize))
                pair = parts[best], parts[best + 1]
                if pair not in self.ranks:
                    break
                found = *pair, self.ranks[pair]
                parts[best:best + 2] = ["".join(pair)]  # the leftmost of the lowest rank
            self.last_merges[token] = found if parts == [token] else None
        return self.last_merges[token]

    def _may_follow(self, a: str | None, follows: dict) -> bool:
        """Whether the symbols of two tokens, or of one (``a`` None), merge to these tokens again;
        kept in ``follows``, the second token's entry.

        Seen backwards, the merge of the higher rank is the last; of equal ranks the one further
        to the right. Before it, its part at the border stood beside the other token, and these
        two must not have been merged earlier.
        """
        b = follows[0]
        right = self._last_merge(b)
        left = self._last_merge(a) if a else None
        ok = right is not None and (a is None or left is not None)
        x, y, limit = a, b, sys.maxsize
        while ok and a is not None:
            if self.ranks.get((x, y), sys.maxsize) < limit:
                ok = False
            elif left[2] > right[2]:
                x, limit = left[1], left[2]
                left = self._last_merge(x)
            elif right[2] >= 0:
                y, limit = right[0], right[2] + 1
                right = self._last_merge(y)
            else:
                break
        if self.n_pairs == MAX_REMEMBERED:
            for entry in self.tokens:
                token = entry[0]
                entry.clear()
                entry[0] = token
            self.n_pairs = 0
        self.n_pairs += 1
        follows[a] = ok
        return ok

    def encode_words(self, words: Iterable[str], ids: dict[str, bytes], shown: dict[str, str]) -> None:
        """Fills in the ids (little-endian uint32) and token names of words, normalised and split.

        Sorted words are the leaves of their trie in depth-first order, so the walk keeps one
        branch: a word goes on from the prefix that it shares with the word before it.
        """
        # of the branch's first d symbols: the last token of their encoding, and where it begins
        last: list[str | None] = [None]
        begin: list[int] = [0]
        suffixes, end, id_bytes, before = self.suffixes, self.end, self.id_bytes, ""
        for word in sorted(words):
            n, shared = len(word), 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            # a word's last symbol carries the word end, so it is no prefix of another word
            shared = min(shared, n - 1, len(before) - 1) if before else 0
            del last[shared + 1:]
            del begin[shared + 1:]
            before = word
            for d in range(shared, n):
                node, at = suffixes.get(word[d] + end if d == n - 1 else word[d]), d
                while node is not None:
                    follows = node.get(None)
                    if follows is not None:  # a token, and what is known of the tokens before it
                        known = follows.get(last[at])
                        if known is None:
                            known = self._may_follow(last[at], follows)
                        if known:
                            last.append(follows[0])
                            begin.append(at)
                            break
                    at -= 1
                    node = node.get(word[at]) if at >= 0 else None
                if node is None:
                    raise ValueError(f"symbol outside the vocabulary: {word[d]!r}")
            tokens, at = [], n
            while at:
                tokens.append(last[at])
                at = begin[at]
            tokens.reverse()
            ids[word], shown[word] = b"".join([id_bytes[t] for t in tokens]), " ".join(tokens)

    def pieces(self, chunk: str) -> list[str]:
        """The library's normalised words of a text without special tokens."""
        if self.simple_ascii and chunk.isascii() and chunk.isprintable():
            return [chunk.lower()] if chunk.isalpha() else _ASCII_WORDS.findall(chunk.lower())
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]

    def remember(self, chunks: set[str]) -> None:
        """Fills ``ids`` and ``shown`` for pieces of text without white space."""
        if len(self.ids) > MAX_REMEMBERED // 2:
            self.old, self.ids, self.shown = (self.ids, self.shown), {}, {}
        ids, shown, (old_ids, old_shown) = self.ids, self.shown, self.old
        fresh = chunks.difference(ids)
        for chunk in fresh.intersection(old_ids):
            ids[chunk], shown[chunk] = old_ids[chunk], old_shown[chunk]
        fresh.difference_update(ids)
        words: set[str] = set()  # of small ASCII letters: each is its own only piece
        odd: set[str] = set()
        split: list[tuple[str, list]] = []
        for chunk in fresh:
            if self.simple_ascii and chunk.isascii() and chunk.isalpha():
                parts = [chunk.lower()]
            elif self.special_re and self.special_re.search(chunk):
                parts = []
                for k, piece in enumerate(self.special_re.split(chunk)):
                    parts += [self.special[piece]] if k % 2 else self.pieces(piece) if piece else []
            else:
                parts = self.pieces(chunk)
            for p in parts:
                if isinstance(p, str):
                    (words if self.simple_ascii and p.isascii() and p.isalpha() else odd).add(p)
            if len(parts) != 1 or parts[0] != chunk:
                split.append((chunk, parts))
            elif chunk in odd:  # its own only piece, too
                words.add(chunk)
        for word in words.intersection(old_ids):
            ids[word], shown[word] = old_ids[word], old_shown[word]
        self.encode_words(words.difference(ids), ids, shown)
        odd.difference_update(words)
        odd_ids, odd_shown = {}, {}
        self.encode_words(odd, odd_ids, odd_shown)
        for chunk, parts in split:
            got = [(p.to_bytes(4, "little"), self.names[p]) if isinstance(p, int) else
                   (odd_ids[p], odd_shown[p]) if p in odd else (ids[p], shown[p]) for p in parts]
            ids[chunk], shown[chunk] = got[0] if len(got) == 1 else (b"".join([g[0] for g in got]), " ".join([g[1] for g in got]))

    def encode_texts(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """(ids, decoded) of each whole text; null counts as empty.

        Texts are cut at ASCII white space, which every step of the tokenizer keeps apart.
        """
        cut = [[c for c in _SPLIT.split(t) if c] if t else [] for t in texts]
        chunks: set[str] = set()
        group: list[list[str]] = []
        for words in cut:  # a few hundred thousand distinct pieces at a time
            chunks.update(words)
            group.append(words)
            if len(chunks) > MAX_REMEMBERED // 2:
                yield from self._joined(group, chunks)
                group, chunks = [], set()
        yield from self._joined(group, chunks)

    def _joined(self, group: list[list[str]], chunks: set[str]) -> Iterator[tuple[bytes, str]]:
        collecting = gc.isenabled()
        gc.disable()  # no cycles are made here, and collections would walk all that is remembered
        try:
            self.remember(chunks)
        finally:
            if collecting:
                gc.enable()
        ids, shown = self.ids, self.shown
        empty = {c for c in chunks if not ids[c]}  # pieces that the tokenizer drops
        for words in group:
            if empty:
                words = [w for w in words if w not in empty]
            yield b"".join(map(ids.__getitem__, words)), " ".join(map(shown.__getitem__, words))

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decode without a decoder: token names joined by spaces."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_ENCODERS: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
        gc.freeze()  # the vocabulary's many small objects stay; no collection need look at them again
    return _ENCODERS[path]


def _map_texts(docs: DataFrame, path: str, text: str, keep: tuple[str, ...], extra: str,
               row: Callable[[bytes, str], tuple], kinds: list[pa.DataType]) -> DataFrame:
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes), extra])
    n_keep = len(keep)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [row(*x) for x in enc.encode_texts(part.column(n_keep).to_pylist())]
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(n_keep)] + cols,
                    [*keep, *(x.split()[0] for x in extra.split(", "))])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ids (array<bigint>), decoded (string): one row per row of ``docs``."""
    import numpy as np

    return _map_texts(docs, path, text, keep, "ids array<bigint>, decoded string",
                      lambda ids, decoded: (np.frombuffer(ids, "<u4").astype("int64").tolist(), decoded),
                      [pa.list_(pa.int64()), pa.string()])


def digests(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, ids_sha256, decoded_sha256: one row per row of ``docs``.

    Null and empty texts have no tokens and the digests of nothing; repeated rows give repeated
    results; columns of ``docs`` outside ``keep`` are not read.
    """
    return _map_texts(docs, path, text, keep, "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
                      lambda ids, decoded: (len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                                            hashlib.sha256(decoded.encode()).hexdigest()),
                      [pa.int64(), pa.string(), pa.string()])


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the decoded text of an id array; null ids give null."""

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        enc = encoder(path)
        return col.map(lambda x: None if x is None else enc.decode(int(i) for i in x))

    return rows.withColumn(into, run(F.col(ids)))
