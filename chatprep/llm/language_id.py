"""Language ID with a string kernel.

The kernel of two texts is the blended spectrum of presence: the number of byte n-grams
(lengths 1 to ``max_gram`` of the lower-cased UTF-8) that occur in both, whatever their counts,
divided by the root of the two texts' own numbers. Nystroem landmarks give the feature map, and
one-versus-rest kernel ridge regression a score for each language. The features are the n-grams
of the landmarks: others never meet one. Scoring is two products of matrices for each block of
texts: presence times landmarks, and kernel values times coefficients.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

UNDETERMINED = "und"
#: The classifier is fitted on at most FIT_ROWS labelled rows, as many of each language as fit
#: (at least one), chosen by hash; LANDMARKS of them, again by language, are landmarks.
FIT_ROWS = 1024
LANDMARKS = 96
MAX_GRAM = 3
RIDGE = 1e-2
#: Texts of a block; a block's presence matrix has that many rows.
BLOCK = 128
#: Bytes of a text that are worked on at once.
STRETCH = 1 << 20

_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or any(unicodedata.category(c)[0] == "L" for c in text)


def gram_codes(text: str, max_gram: int = MAX_GRAM) -> Iterator[np.ndarray]:
    """The codes of all n-grams of a whole text, repeats included, a stretch of it at a time.

    A code is an n-gram's bytes in base 256, offset by its length; stretches overlap by as much
    as an n-gram needs, so none is lost and memory stays bounded however long the text is.
    """
    whole = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    for at in range(0, len(whole), STRETCH):
        data = whole[at:at + STRETCH + max_gram - 1].astype(np.int32)
        run, offset = np.zeros(len(data), np.int32), 0
        for n in range(1, max_gram + 1):
            m = len(data) - n + 1
            if m <= 0:
                break
            run = run[:m] * 256 + data[n - 1:]
            yield run + offset
            offset += 256 ** n


def code_space(max_gram: int = MAX_GRAM) -> int:
    return sum(256 ** n for n in range(1, max_gram + 1))


def code_set(text: str, max_gram: int = MAX_GRAM) -> np.ndarray:
    found = np.zeros(0, np.int32)
    for codes in gram_codes(text, max_gram):
        found = np.union1d(found, codes)
    return found.astype(np.int32)


@dataclass
class KernelModel:
    languages: list[str]
    features: np.ndarray      # sorted codes of the landmarks' n-grams
    landmarks: np.ndarray     # features x landmarks, presence divided by the root of its number
    coefficients: np.ndarray  # landmarks x languages
    max_gram: int = MAX_GRAM

    def __post_init__(self):
        self._place = None

    def presence(self, texts: list[str]) -> np.ndarray:
        if self._place is None:  # once per worker: a bit for each code, and the features before each 64 codes
            bits = np.zeros(code_space(self.max_gram) + 63 >> 6, np.uint64)
            codes = self.features.astype(np.int64)
            np.bitwise_or.at(bits, codes >> 6, np.uint64(1) << (codes & 63).astype(np.uint64))
            before = np.cumsum(np.bitwise_count(bits), dtype=np.int32) - np.bitwise_count(bits)
            self._place = bits, before
        bits, before = self._place
        x = np.zeros((len(texts), len(self.features)), np.float32)
        for row, text in zip(x, texts):
            for codes in gram_codes(text, self.max_gram):
                word, bit = codes >> 6, (codes & 63).astype(np.uint64)
                known = np.flatnonzero((bits[word] >> bit) & np.uint64(1))
                word, bit = word[known], bit[known]
                row[before[word] + np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))] = 1
        return x

    def kernel(self, texts: list[str]) -> np.ndarray:
        x = self.presence(texts)
        norm = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return (x @ self.landmarks) / norm

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(texts) @ self.coefficients

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_place"} | {"_place": None}


def sample_rows(rows: DataFrame, lang: str, key: Column, fit_rows: int) -> DataFrame:
    """At most ``fit_rows`` rows, the same number of each language, smallest hash of ``key`` first."""
    n_lang = rows.select(lang).distinct().count()
    each = max(1, fit_rows // max(1, n_lang))
    # first within parts of a language, so that a frequent language is not one task
    order = (F.xxhash64(key), key)
    some = rows.withColumn("_part", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(16)))
    for by in (W.partitionBy(lang, "_part").orderBy(*order), W.partitionBy(lang).orderBy(*order)):
        some = some.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= each).drop("_r")
    return some.drop("_part")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS, max_gram: int = MAX_GRAM,
        ridge: float = RIDGE) -> KernelModel:
    """Fits on labelled rows; rows without a language, a key or a letter are left out.

    The sample is chosen from (key, lang) alone; only its texts are read, and what reaches the
    driver are their sets of n-gram codes, one for each chosen (key, lang) (at most fit_rows sets,
    or one a language). No rows: a model without languages, which finds every text undetermined.
    """
    rows = labelled.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("key").isNotNull() & F.col("text").rlike(r"\p{L}"))
    chosen = [tuple(r) for r in sample_rows(rows.select("key", "lang"), "lang", F.col("key"), fit_rows).collect()]

    def codes(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array([r["key"]], batch.column(0).type), "lang": [r["lang"]],
                    "codes": pa.array([code_set(r["text"], max_gram).tobytes()], pa.binary())})

    kind = dict(rows.dtypes)["key"]
    pairs = rows.sparkSession.createDataFrame(sorted(set(chosen), key=str), f"key {kind}, lang string")
    wanted = rows.filter(F.col("key").isin([k for k, _ in chosen])).join(F.broadcast(pairs), ["key", "lang"], "left_semi")
    # repeated keys: one row each, whichever text has the smaller set of codes
    got = (wanted.select("key", "lang", "text").mapInArrow(codes, f"key {kind}, lang string, codes binary")
           .groupBy("key", "lang").agg(F.min("codes").alias("codes")).collect()) if chosen else []
    sets = {}
    for r in sorted(got, key=lambda r: (str(r["key"]), r["lang"], bytes(r["codes"]))):
        sets.setdefault((r["lang"], r["key"]), np.frombuffer(bytes(r["codes"]), np.int32))
    names = sorted({k[0] for k in sets})
    by_lang = {name: [v for k, v in sets.items() if k[0] == name] for name in names}
    marks = [s for name in names for s in by_lang[name][:max(1, landmarks // max(1, len(names)))]]
    if not marks:
        return KernelModel([], np.zeros(0, np.int32), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), max_gram)
    features = np.unique(np.concatenate(marks))

    def columns(group: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(features), len(group)), np.float32)
        for k, s in enumerate(group):
            x[np.searchsorted(features, s[np.isin(s, features, assume_unique=True)]), k] = 1
        return x / np.sqrt(np.maximum(x.sum(axis=0), 1))

    mark_cols = columns(marks)
    # Nystroem: features of a text are its kernel row times the root of the inverse landmark kernel
    values, vectors = np.linalg.eigh((mark_cols.T @ mark_cols).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    gram, target = np.zeros((len(marks), len(marks))), np.zeros((len(marks), len(names)))
    n_rows = 0
    for k, name in enumerate(names):
        for at in range(0, len(by_lang[name]), BLOCK):
            phi = (columns(by_lang[name][at:at + BLOCK]).T @ mark_cols).astype(np.float64) @ root
            gram += phi.T @ phi
            target -= phi.sum(axis=0)[:, None]  # -1 for every language, and +1 for its own
            target[:, k] += 2 * phi.sum(axis=0)
            n_rows += len(phi)
    weights = np.linalg.solve(gram + ridge * n_rows / len(marks) * np.eye(len(marks)), target)
    return KernelModel(names, features, mark_cols, (root @ weights).astype(np.float32), max_gram)


def prediction(model: KernelModel, text: Column) -> Column:
    """struct(lang_pred, score) of whole texts, by the text alone.

    A text that is null or has no letter is ``und`` with score 0; the score is that of the best
    one-versus-rest regression (about 1 for its own language, -1 for others). Ties go to the
    language that sorts first.
    """
    def run(texts: pd.Series) -> pd.DataFrame:
        pred, best = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        real = [k for k, t in enumerate(texts) if model.languages and has_letter(t)]
        for at in range(0, len(real), BLOCK):
            rows = real[at:at + BLOCK]
            scores = model.scores([texts.iloc[k] for k in rows])
            for k, j, s in zip(rows, scores.argmax(axis=1), scores.max(axis=1)):
                pred[k], best[k] = model.languages[j], s
        return pd.DataFrame({"lang_pred": pred, "score": best})

    return F.pandas_udf(run, "struct<lang_pred:string,score:double>")(text)


def predict(docs: DataFrame, model: KernelModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred, score: one row per row of ``docs``, repeated rows included."""
    rows = docs.select(*keep, prediction(model, F.col(text)).alias("_p"))
    return rows.select(*keep, "_p.lang_pred", "_p.score")


def held_out(key: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the key, written as text, has remainder ``part``; null keys are not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))
