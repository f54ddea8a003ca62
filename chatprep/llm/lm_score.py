"""Language-model scores by deleted interpolation.

Word bigrams: P(w | c) = l(c) n(c, w) / n(c) + (1 - l(c)) P1(w), and P1(w) = m n(w) / N +
(1 - m) / (V + 1). The weight l(c) is shared by contexts of like frequency (a bucket for each
power of two); all weights are learned by expectation-maximisation on the counts of a deleted
part of the training texts, against maximum-likelihood estimates from the rest. The scores then
use the counts of all training texts.

Texts are packed into shards: a dictionary of distinct words and the texts' word numbers. Each
shard sends its distinct words and word pairs once, as hashes with counts, to buckets by hash;
a bucket sums the counts over all shards and sends them back in the shard's order. So a frequent
word or pair is one entry of each shard, nothing depends on how often it occurs, and no table of
counts is ever gathered in one place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zlib
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import Scratch

#: Words of a shard (a longer text is a shard of its own) and entries of a bucket, about.
SHARD_WORDS = 1_000_000
BUCKET_ENTRIES = 500_000
#: Buckets of context frequency: one for each power of two up to 2^FREQ_BUCKETS.
FREQ_BUCKETS = 24
#: Steps of a ratio of probabilities, per factor e, in the table of deleted counts, and its range.
STEPS, RANGE = 64, 32
ROUNDS = 60
#: Word numbers with a meaning of their own: start and end of a text.
START, END = 0, 1
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _pack(a: np.ndarray) -> bytes:
    """An array as bytes, plane by plane (equal high bytes pack well)."""
    return zlib.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).reshape(-1)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """One hash for each dictionary entry; start and end have values that no word needs."""
    out = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    out[START], out[END] = 1, 2
    return out


def _pair_hashes(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (context ^ (context >> np.uint64(29))) * _MULTIPLY + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shards(docs: DataFrame, scratch: Scratch, part: Column, text: str, keep: tuple[str, ...],
           shard_words: int = SHARD_WORDS) -> DataFrame:
    """The texts, packed: shard, learning (of deleted texts), n_words, words (dictionary), ids, lengths, parts, rows (``keep``).

    ``part``: 0 held out, 1 deleted, 2 retained. Each text is its words and one END.
    """
    spark = docs.sparkSession
    source = docs.select(F.struct(*keep).alias("row"), part.cast("int").alias("part"),
                         F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    row_type = source.schema["row"].dataType.simpleString()

    def pack(shard, learning, numbers, ids, lengths, parts, rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([learning]), pa.array([len(ids)], pa.int64()),
             pa.array([zlib.compress(b" ".join(numbers)[2:], 1)], pa.binary()),
             pa.array([_pack(np.array(ids, np.uint32))], pa.binary()), pa.array([lengths], pa.list_(pa.int64())),
             pa.array([parts], pa.list_(pa.int32())), pa.array([rows])],
            ["shard", "learning", "n_words", "words", "ids", "lengths", "parts", "rows"])

    def run(batches):
        # texts of the deleted part get shards of their own, so learning reads no others
        open_, seq = {}, TaskContext.get().partitionId() << 32
        for batch in batches:
            for k in range(batch.num_rows):
                words, used = batch.column(2)[k].as_py().lower().split(), batch.column(1)[k].as_py()
                mine = open_.get(used == 1)
                if mine and len(mine[1]) + len(words) > shard_words:
                    yield pack(seq, used == 1, *mine)
                    seq, mine = seq + 1, None
                if mine is None:
                    mine = open_[used == 1] = ({b"": START, b" ": END}, [], [], [], [])
                numbers, ids, lengths, parts, rows = mine
                for w in words:
                    n = numbers.get(w)
                    if n is None:
                        n = numbers[w] = len(numbers)
                    ids.append(n)
                ids.append(END)
                lengths.append(len(words) + 1)
                parts.append(used)
                rows.append(batch.column(0)[k].as_py())
        for learning, mine in open_.items():
            yield pack(seq, learning, *mine)
            seq += 1

    packed = source.mapInArrow(run, "shard bigint, learning boolean, n_words bigint, words binary, ids binary, lengths array<bigint>, "
                                    f"parts array<int>, rows array<{row_type}>")
    return scratch.table(packed, "shards")


@dataclass
class _Shard:
    """A shard, unpacked: distinct words and pairs with counts in the deleted and retained parts."""
    hashes: np.ndarray        # of each dictionary word
    ids: np.ndarray
    doc: np.ndarray           # text of each token
    pairs: np.ndarray         # hash of each distinct pair
    pair_of: np.ndarray       # pair of each token
    context: np.ndarray       # word before each token
    part: np.ndarray          # of each token

    @classmethod
    def of(cls, words: bytes, ids: bytes, lengths: list[int], parts: list[int]) -> _Shard:
        names = zlib.decompress(words).split(b" ")
        hashes = _word_hashes([b"", b" ", *names[1:]])
        tokens = _unpack(ids, np.uint32).astype(np.int32)
        n = np.array(lengths, np.int64)
        context = np.empty_like(tokens)
        context[1:] = tokens[:-1]
        context[np.concatenate([[0], np.cumsum(n)[:-1]])] = START
        keys, pair_of = np.unique(context.astype(np.int64) * len(hashes) + tokens, return_inverse=True)
        pairs = _pair_hashes(hashes[keys // len(hashes)], hashes[keys % len(hashes)])
        return cls(hashes, tokens, np.repeat(np.arange(len(n), dtype=np.int32), n), pairs, pair_of.astype(np.int32),
                   context, np.repeat(np.array(parts, np.int8), n))

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, deleted count, retained count) of words, with START counted once a text, then pairs."""
        nw, npairs = len(self.hashes), len(self.pairs)
        starts = self.context == START
        out = []
        for part in (1, 2):
            mine = self.part == part
            words = np.bincount(self.ids[mine], minlength=nw)
            words[START] = (mine & starts).sum()
            out.append(np.concatenate([words, np.bincount(self.pair_of[mine], minlength=npairs)]))
        # words and pairs are told apart by the hash's last bit
        one = np.uint64(1)
        return np.concatenate([self.hashes & ~one, self.pairs | one]), out[0], out[1]


def _spread(hashes: np.ndarray, n: int) -> list[np.ndarray]:
    """Places of the entries of each of n buckets, sorted by hash."""
    bucket = ((hashes >> np.uint64(33)) % np.uint64(n)).astype(np.int64)
    order = np.lexsort((hashes, bucket))
    return np.split(order, np.searchsorted(bucket[order], np.arange(1, n)))


def counted(packed: DataFrame, n_buckets: int, scratch: Scratch) -> tuple[DataFrame, dict, dict]:
    """(counts, sizes, steps). counts: shard, buckets (bucket, deleted, retained), the corpus-wide
    counts of each shard's entries in the order of ``_spread``. sizes: n_types and n_tokens of the
    training words, and n_deleted of them. steps: deleted tokens by the step of their word's
    retained count (the log scale bounds their number)."""
    def send(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                hashes, deleted, retained = _Shard.of(r["words"], r["ids"], r["lengths"], r["parts"]).entries()
                rows = [(b, _pack(np.diff(hashes[at], prepend=np.uint64(0))), _pack(deleted[at].astype(np.uint32)),
                         _pack(retained[at].astype(np.uint32))) for b, at in enumerate(_spread(hashes, n_buckets)) if len(at)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in rows], pa.int32()), pa.array([r["shard"]] * len(rows), pa.int64()),
                     *(pa.array([x[c] for x in rows], pa.binary()) for c in (1, 2, 3))],
                    ["bucket", "shard", "hashes", "deleted", "retained"])

    sent = packed.select("shard", "words", "ids", "lengths", "parts").mapInArrow(
        send, "bucket int, shard bigint, hashes binary, deleted binary, retained binary")

    def add(table: pa.Table) -> pa.Table:
        each = [np.cumsum(_unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("hashes")]
        hashes, place = np.unique(np.concatenate(each), return_inverse=True)
        total, out = {}, {}
        cuts = np.cumsum([len(x) for x in each])[:-1]
        for name in ("deleted", "retained"):
            counts = np.concatenate([_unpack(x.as_py(), np.uint32) for x in table.column(name)])
            total[name] = np.bincount(place, weights=counts, minlength=len(hashes)).astype(np.int64)
            out[name] = [_pack(x) for x in np.split(total[name][place], cuts)]
        is_word = (hashes & np.uint64(1) == 0) & (hashes != np.uint64(0))  # START hashes to 0
        training = (total["deleted"] + total["retained"])[is_word]
        # deleted tokens by the step of their word's retained count, for the weight of words
        steps, at = np.unique(_count_step(total["retained"][is_word]), return_inverse=True)
        n_at = np.bincount(at, weights=total["deleted"][is_word], minlength=len(steps)).astype(np.int64)
        n = table.num_rows
        first = [0] * (n - 1)
        return pa.table({
            "shard": table.column("shard"), "bucket": table.column("bucket"),
            "deleted": pa.array(out["deleted"], pa.binary()), "retained": pa.array(out["retained"], pa.binary()),
            "n_types": pa.array([int((training > 0).sum()), *first], pa.int64()),
            "n_tokens": pa.array([int(training.sum()), *first], pa.int64()),
            "n_deleted": pa.array([int(total["deleted"][is_word].sum()), *first], pa.int64()),
            "steps": pa.array([[{"step": int(x), "n": int(y)} for x, y in zip(steps, n_at) if y], *([[]] * (n - 1))],
                              pa.list_(pa.struct([("step", pa.int64()), ("n", pa.int64())])))})

    rows = scratch.table(sent.groupBy("bucket").applyInArrow(
        add, "shard bigint, bucket int, deleted binary, retained binary, n_types bigint, n_tokens bigint, "
             "n_deleted bigint, steps array<struct<step:bigint,n:bigint>>"), "counts")
    by_shard = rows.groupBy("shard").agg(F.collect_list(F.struct("bucket", "deleted", "retained")).alias("buckets"))
    sizes = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_types", "n_tokens", "n_deleted")])
    steps = rows.select(F.explode("steps").alias("s")).groupBy("s.step").agg(F.sum("s.n").alias("n"))
    return by_shard, sizes.first().asDict(), {r["step"]: r["n"] for r in steps.collect()}


def _back(shard: _Shard, buckets: list[dict], n_buckets: int) -> tuple[np.ndarray, ...]:
    """Corpus-wide counts of a shard's words and pairs: (word, pair) deleted and retained."""
    hashes = shard.entries()[0]
    deleted, retained = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
    places = _spread(hashes, n_buckets)
    for b in buckets:
        at = places[b["bucket"]]
        deleted[at], retained[at] = _unpack(b["deleted"], np.int64), _unpack(b["retained"], np.int64)
    n = len(shard.hashes)
    return deleted[:n], retained[:n], deleted[n:], retained[n:]


def freq_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), FREQ_BUCKETS - 1)


def _count_step(count: np.ndarray) -> np.ndarray:
    """The step of a count on the log scale; 0 for a count of zero."""
    return np.where(count > 0, 1 + np.rint(np.log(np.maximum(count, 1)) * STEPS), 0).astype(np.int64)


def _ratio_step(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The step of upper / lower on a log scale; 0 stands for an upper estimate of zero."""
    x = np.log(np.where(upper > 0, upper, 1) / lower)
    return np.where(upper > 0, 1 + np.clip(np.rint((x + RANGE / 2) * STEPS), 0, RANGE * STEPS), 0).astype(np.int64)


def em_weight(ratio: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> float:
    """The weight of the upper estimate that makes the deleted counts most likely, given the
    ratios of the upper to the lower estimate."""
    if not len(counts):
        return 0.5
    weight = 0.5
    for _ in range(rounds):
        weight = float((counts * weight * ratio / (weight * ratio + 1 - weight)).sum() / counts.sum())
        weight = min(max(weight, 1e-6), 1 - 1e-6)
    return weight


@dataclass(frozen=True)
class Model:
    n_types: int
    n_tokens: int
    word_weight: float
    context_weights: tuple[float, ...]

    def word_prob(self, count: np.ndarray) -> np.ndarray:
        w = self.word_weight if self.n_tokens else 0.0
        return w * count / max(1, self.n_tokens) + (1 - w) / (self.n_types + 1)

    def pair_prob(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        w = np.array(self.context_weights)[freq_bucket(context)] * (context > 0)
        return w * pair / np.maximum(context, 1) + (1 - w) * self.word_prob(word)


def _learn(joined: DataFrame, n_buckets: int, sizes: dict, steps: dict) -> Model:
    """EM over tables of deleted counts, by bucket and step of the ratio of the two estimates.

    The tables have a fixed size (FREQ_BUCKETS by RANGE * STEPS + 2), whatever the corpus; every
    deleted token counts in them.
    """
    retained_tokens, n_types, width = max(1, sizes["n_tokens"] - sizes["n_deleted"]), sizes["n_types"], RANGE * STEPS + 2
    step = np.array(sorted(steps), np.int64)
    ratio = np.where(step > 0, np.exp((step - 1) / STEPS), 0.0) / retained_tokens * (n_types + 1)
    word_weight = em_weight(ratio, np.array([steps[k] for k in step.tolist()], np.float64))

    def run(batches):
        sums: dict[int, int] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                s = _Shard.of(r["words"], r["ids"], r["lengths"], r["parts"])
                _, words, _, pairs = _back(s, r["buckets"], n_buckets)
                context = words[s.context]
                seen = (s.part == 1) & (context > 0)
                context = context[seen]
                lower = word_weight * words[s.ids[seen]] / retained_tokens + (1 - word_weight) / (n_types + 1)
                keys = freq_bucket(context) * width + _ratio_step(pairs[s.pair_of[seen]] / context, lower)
                for key, c in zip(*(x.tolist() for x in np.unique(keys, return_counts=True))):
                    sums[key] = sums.get(key, 0) + c
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(sums), pa.int64()), "n": pa.array(list(sums.values()), pa.int64())})

    rows = joined.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    keys, n = np.array([r["k"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.float64)
    bucket, step, weights = keys // width, keys % width, []
    ratio = np.where(step > 0, np.exp((step - 1) / STEPS - RANGE / 2), 0.0)
    for b in range(FREQ_BUCKETS):  # a bucket without deleted counts takes the weight of the bucket below
        mine = bucket == b
        weights.append(em_weight(ratio[mine], n[mine]) if mine.any() or not weights else weights[-1])
    return Model(n_types, sizes["n_tokens"], word_weight, tuple(weights))


def score(docs: DataFrame, scratch: Scratch, part: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
          shard_words: int = SHARD_WORDS, bucket_entries: int = BUCKET_ENTRIES) -> tuple[DataFrame, Model]:
    """(scores, model). scores: ``keep``, n_tokens, n_known, train_tokens, base_score, score: one row per
    row of ``docs``, whole texts, base 10 logarithms.

    ``part`` says how a text is used: 0 held out, 1 deleted (weights), 2 retained (estimates); parts
    1 and 2 are the training texts. Null and empty texts are one END. Without training texts every
    word is unknown and the model is uniform. Repeated rows count and are scored each. An empty
    table gives an empty one.
    """
    packed = shards(docs, scratch, part, text, keep, shard_words)
    total = packed.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    n_buckets = max(1, math.ceil(total / bucket_entries))
    by_shard, sizes, steps = counted(packed, n_buckets, scratch)
    learning = packed.filter("learning").select("shard", "words", "ids", "lengths", "parts").join(by_shard, "shard")
    model = _learn(learning.drop("shard"), n_buckets, sizes, steps)
    joined = packed.join(by_shard, "shard")
    row_type = packed.schema["rows"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1)
                at = {n: c for c, n in enumerate(r.schema.names)}
                v = {n: r.column(at[n])[0].as_py() for n in ("words", "ids", "lengths", "parts", "buckets")}
                s = _Shard.of(v["words"], v["ids"], v["lengths"], v["parts"])
                d_word, r_word, d_pair, r_pair = _back(s, v["buckets"], n_buckets)
                word, pair = d_word + r_word, d_pair + r_pair
                n = len(v["lengths"])
                mine = word[s.ids]
                base = np.log10((word + 0.1) / (model.n_tokens + 0.1 * (model.n_types + 1)))[s.ids]
                prob = model.pair_prob(pair[s.pair_of], word[s.context], mine)
                sums = lambda x: np.bincount(s.doc, weights=x, minlength=n)  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays(
                    [r.column(at["rows"]).flatten(), pa.array(v["lengths"], pa.int64()),
                     pa.array(sums(mine > 0).astype(np.int64)), pa.array(sums(base)), pa.array(sums(np.log10(prob)))],
                    ["row", "n_tokens", "n_known", "base_score", "score"])

    out = joined.mapInArrow(run, f"row {row_type}, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("row.*", "n_tokens", "n_known", F.lit(model.n_tokens).cast("bigint").alias("train_tokens"),
                      "base_score", "score"), model


def crc_part(key: Column, parts: int = 10) -> Column:
    """0 where crc32 of the key as text leaves 0 (held out), 1 where it leaves 1 (deleted), else 2.
    Null keys are retained."""
    rest = F.crc32(key.cast("string").cast("binary")) % parts
    return F.when(rest == 0, 0).when(rest == 1, 1).otherwise(2)
