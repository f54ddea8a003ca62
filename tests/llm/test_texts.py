"""Quality rules, language ID, LM scores, BPE, licence scans: against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatprep.llm import bpe, language_id as L, license_scan as C, lm_score as M, quality as Q
from chatprep.llm.common import Scratch
from tests.conftest import SF0001

ODD = [(1, None), (2, ""), (3, "  \n "), (4, "a b c a b c a b c"), (5, "a a a a\na a a a\n\n\n"), (6, "x y z\x0bq 😀 😀"),
       (7, "a b"), (7, "a b"), (None, "#*$%&|<> Up UP"), (8, "Word " * 3000)]


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, -1, "x") for d, t in rows], "doc_id long, text string, n_words int, fail_bits string")


def slow_measures(t):
    t = t or ""
    w, seen, covered = re.findall(r"[^\x20\x09-\x0D]+", t), {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + j for i in at for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    sample = [tuple(r) for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    out = Q.apply_policy(Q.ledger(docs_of(spark, ODD + sample))).collect()
    assert len(out) == len(ODD) + len(sample)
    for r in out:
        want = slow_measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    assert Q.ledger(docs_of(spark, ODD).limit(0)).count() == 0


def test_quality_exact_path_agrees(spark, monkeypatch):
    """Texts beyond the packed numbers (here: of 16 words and more) are sorted by words."""
    monkeypatch.setattr(Q, "_POS_BITS", 4)
    rows = [(k, " ".join(random.Random(k).choice("abc") for _ in range(60))) for k in range(20)]
    for r in Q.measure(docs_of(spark, rows)).collect():
        assert r.n_repeat_words == slow_measures(r.text)[4]


def test_ablations_count_bits(spark):
    ledger = Q.ledger(docs_of(spark, ODD + [(20, " ".join(f"w{i}" for i in range(60))), (21, " ".join(f"W{i}" for i in range(60)))]))
    bits = [r.fail_bits for r in ledger.select("fail_bits").collect()]
    mask = Q.policy_mask("v1")
    for r in Q.ablations(ledger, "v1").collect():
        bit = 1 << next(x.bit for x in Q.default_rules() if x.name == r.rule)
        assert r.n_failed == sum(bool(b & bit) for b in bits)
        assert r.n_kept_without == sum(not b & mask & ~bit for b in bits)
        assert r.n_only_this == sum((b & mask) == bit for b in bits)


def test_filter_is_not_pushed_into_measures(spark):
    plan = Q.apply_policy(Q.ledger(docs_of(spark, ODD))).filter("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


@pytest.fixture(scope="module")
def languages(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").withColumn("score", F.lit("clash"))
    return docs, L.fit(docs.filter(~L.held_out(F.col("doc_id"))))


def test_language_held_out_accuracy(languages):
    docs, model = languages
    held = docs.filter(L.held_out(F.col("doc_id")))
    rows = L.predict(held, model, keep=("doc_id", "lang")).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_language_odd_texts(spark, languages):
    docs, model = languages
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "é"), (5, "the and of that is " * 50_000), (5, "the and of that is " * 50_000)]
    got = [(r.doc_id, r.lang_pred) for r in L.predict(docs_of(spark, rows), model).collect()]
    assert [x for _, x in got[:3]] == ["und"] * 3 and got[3][1] != "und" and got[4] == got[5] == (5, "en")
    none = L.fit(docs.limit(0))
    assert {r.lang_pred for r in L.predict(docs_of(spark, rows), none).collect()} == {"und"}
    assert L.predict(docs_of(spark, rows).limit(0), model).count() == 0


def test_fit_collects_one_set_of_codes_a_row(spark, monkeypatch):
    rows = [(k, f"text number {k} of {lang}", lang) for k in range(6) for lang in ("en", "fr")]
    repeated = rows + [(3, f"other words {k}", "en") for k in range(200)] + [(3, "a", "en")]
    schema = "doc_id long, text string, lang string"
    frame = spark.createDataFrame(repeated, schema).repartition(3)
    seen, collect = [], type(frame).collect

    def counted(df):
        out = collect(df)
        seen.extend(r for r in out if "codes" in df.columns)
        return out

    monkeypatch.setattr(type(frame), "collect", counted)
    model = L.fit(frame, fit_rows=1024)
    assert len(seen) == 12 and len({(r.key, r.lang) for r in seen}) == 12
    smallest = min((t for k, t, lang in repeated if (k, lang) == (3, "en")), key=lambda t: L.code_set(t).tobytes())
    once = [(k, smallest if (k, lang) == (3, "en") else t, lang) for k, t, lang in rows]
    want = L.fit(spark.createDataFrame(once, schema), fit_rows=1024)
    assert (model.features == want.features).all() and np.allclose(model.coefficients, want.coefficients)
    seen.clear()
    L.fit(frame, fit_rows=4)  # a key of two languages counts for those it was chosen in
    assert len(seen) <= 4


def test_kernel_is_presence_overlap(languages, monkeypatch):
    _, model = languages
    texts = ["some words in a text", "et le reste", "x"]
    feats = set(model.features.tolist())
    sets = [set(L.code_set(t).tolist()) & feats for t in texts]
    for t, s, row in zip(texts, sets, model.kernel(texts)):
        for k in range(0, model.landmarks.shape[1], 17):
            mark = set(model.features[model.landmarks[:, k] > 0].tolist())
            assert abs(row[k] - len(s & mark) / math.sqrt(max(1, len(s)) * len(mark))) < 1e-5
    whole = np.unique(np.concatenate(list(L.gram_codes("abcdé" * 100))))
    monkeypatch.setattr(L, "STRETCH", 7)  # stretches overlap: nothing is lost
    assert (np.unique(np.concatenate(list(L.gram_codes("abcdé" * 100)))) == whole).all()


def tokens(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]


def slow_scores(rows, model):
    training = [tokens(t) for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 10]
    c = Counter(w for x in training for w in x)
    n, v = sum(c.values()), len(c)
    context, pair = Counter(), Counter()
    for x in training:
        for a, b in zip([0, *x], x):
            context[a] += 1
            pair[a, b] += 1
    assert (n, v) == (model.n_tokens, model.n_types)
    for d, t in rows:
        x = tokens(t)
        base, score = sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in x), 0
        for a, b in zip([0, *x], x):
            p1 = model.word_weight * c[b] / n + (1 - model.word_weight) / (v + 1)
            w = model.context_weights[int(math.log2(context[a]))] if context[a] else 0
            score += math.log10(w * pair[a, b] / max(1, context[a]) + (1 - w) * p1)
        yield str(d), len(x), sum(c[w] > 0 for w in x), n, round(base, 6), round(score, 6)


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 3000, "bucket_entries": 5000}])
def test_lm_scores(spark, sizes):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").limit(120).collect()]
    rows += [(9000, None), (9001, ""), (None, "a b a b É é"), (9002, "x  y\x0bz"), (9002, "x  y\x0bz"), (9003, "the " * 5000)]
    df = docs_of(spark, rows).repartition(3)
    out, model = M.score(df, Scratch(spark, "t"), M.crc_part(F.col("doc_id")), **sizes)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                 for r in out.collect())
    assert got == sorted(slow_scores(rows, model))
    assert all(0 < w < 1 for w in (model.word_weight, *model.context_weights))


def test_lm_without_training_or_rows(spark):
    df = docs_of(spark, [(1, "a b"), (2, None)])
    out, model = M.score(df, Scratch(spark, "t"), F.lit(0))
    assert model.n_tokens == 0 and {(r.n_known, r.score) for r in out.collect()} == {(0, 0.0)}
    assert M.score(df.limit(0), Scratch(spark, "t"), F.lit(0))[0].count() == 0


def test_em_finds_the_mixture():
    ratio, counts = np.array([0.0, 4.0]), np.array([40.0, 60.0])
    w = M.em_weight(ratio, counts, rounds=400)
    assert abs(w - max(np.linspace(0.01, 0.99, 981), key=lambda x: (counts * np.log(x * ratio + 1 - x)).sum())) < 5e-3


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    from chatprep.llm.queries import tokenizer_path

    lib, random_ = Tokenizer.from_file(tokenizer_path()), random.Random(3)
    texts = [None, "", "  ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|> x", "İstanbul ΟΔΥΣΣΕΥΣ", "é é", "it's we'll I'VE",
             "😀 x​y z\x85w", "123 45", "\x00\x01 ﻿", "ﬁ Å K", "a" * 3000, "日本語 ไทย हिन्दी", "<|ENDOFTEXT|>", "a\x1cb\x1fc"]
    pool = [chr(random_.choice([random_.randrange(32, 127), random_.randrange(0xa0, 0x600), random_.randrange(0x3000, 0x9fff)]))
            for _ in range(500)]
    texts += ["".join(random_.choice(pool + [" "] * 50) for _ in range(60)) for _ in range(60)]
    texts += [" ".join("".join(random_.choice("etaoinshr's.") for _ in range(random_.randrange(1, 25))) for _ in range(8)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(1, "")]
    out = bpe.encode(docs_of(spark, rows), tokenizer_path()).collect()
    assert len(out) == len(rows)
    for r in out:
        want = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == lib.decode(want, skip_special_tokens=False)
    assert bpe.digests(docs_of(spark, rows).limit(0), tokenizer_path()).count() == 0
    again = bpe.decode(spark.createDataFrame([([320, 49407],), (None,)], "ids array<bigint>"), tokenizer_path()).collect()
    assert [r.decoded for r in again] == [lib.decode([320, 49407], skip_special_tokens=False), None]


def test_bpe_forgets_without_harm(monkeypatch):
    from chatprep.llm.queries import tokenizer_path

    texts = [" ".join(f"word{i} w{i}ing" for i in range(k, k + 40)) for k in range(0, 200, 20)]
    whole = list(bpe.WordBpe(tokenizer_path()).encode_texts(texts))
    monkeypatch.setattr(bpe, "MAX_REMEMBERED", 30)
    assert list(bpe.WordBpe(tokenizer_path()).encode_texts(texts)) == whole


def test_license_scan(spark):
    notice = C.MORE_TEMPLATES[0].text.split()
    rows = [(1, None), (2, ""), (3, "a b"), (4, "Under the MIT license, under the mit license under the mit"),
            (5, "x " * 10 + " ".join(notice[:15] + ["foo", "bar"] + notice[15:]) + " y"), (6, "CC BY-NC 4.0 cc by nc"),
            (7, "Apache License, Version 2.0"), (8, "under the mit the mit license"), (4, "cc by"), (None, "cc by nc")]
    got = {(r.doc_id, r.n_words): r for r in C.scan(docs_of(spark, rows).drop("n_words"), Scratch(spark, "t")).collect()}
    assert len(got) == len(rows)
    base = {k: (r.n_base, r.first_word, r.last_word, r.base_labels) for k, r in got.items() if r.n_base}
    assert base == {(4, 11): (2, 0, 4, "mit"), (6, 8): (2, 0, 5, "cc-by-nc"), (7, 5): (1, 0, 0, "apache-2"),
                    (None, 3): (1, 0, 0, "cc-by-nc")}
    long_ = next(r for (d, _), r in got.items() if d == 5)
    assert long_.labels == "mit" and 0.9 < long_.score < 1  # two diagonals merged over the words put in
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got.values())
    assert C.scan(docs_of(spark, rows).limit(0), Scratch(spark, "t")).count() == 0
