"""One registered query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatprep.llm import (bpe, decontaminate, hard_negatives, html_extract, language_id, license_scan, lm_score, merkle, quality,
                          simhash, suffix_dedup, url_filter, warc)
from chatprep.llm import sql as S
from chatprep.llm.common import Scratch
from chatprep.llm.registry import ORACLE_SQL, QUERIES, register, table  # noqa: F401

QUALITY_POLICY = "v1"


@register("op3_quality_rules", S.OP3)
def op3_quality_rules(spark, sf_dir):
    rows = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality.apply_policy(rows, QUALITY_POLICY).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


URL_RULES = [
    url_filter.UrlRule("org", "/", "allow"),
    url_filter.UrlRule("example.org", "/es/", "block"),
    url_filter.UrlRule("example.org", "/en/1", "block"),
    url_filter.UrlRule("com", "/fr/", "allow"),
    url_filter.UrlRule("com", "/de/", "block"),
]


@register("op7_url_filters", S.OP7)
def op7_url_filters(spark, sf_dir):
    rows = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, Scratch(spark, "op7"))
    return rows.select("page_id", "host", "path", "rule", "verdict")


@register("op9_license_scans", S.OP9)
def op9_license_scans(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))


TOKENIZER_FILE = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


@register("op8_bpe")
def op8_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


#: The near-duplicate contract: words of a shingle, bits that may differ.
SIMHASH = {"shingle": 3, "bits": 3}


@register("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark, sf_dir):
    rows = simhash.near_groups(table(spark, sf_dir, "documents"), Scratch(spark, "op1"), **SIMHASH)
    return rows.select("doc_id", "fingerprint", "component_id", "n_same")


@register("op6_decontamination", S.OP6)
def op6_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                Scratch(spark, "op6"))


@register("op10_language_id")
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    rows = language_id.predict(docs, model)
    return rows.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@register("op5_warc", S.OP5)
def op5_warc(spark, sf_dir):
    index = warc.write_archives(table(spark, sf_dir, "pages"), Scratch(spark, "op5"), min_bytes=0)
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op2_html_extraction")
def op2_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@register("op4_lm_scoring")
def op4_lm_scoring(spark, sf_dir):
    part = lm_score.crc_part(F.col("doc_id"))
    rows, _ = lm_score.score(table(spark, sf_dir, "documents"), Scratch(spark, "op4"), part)
    return rows.withColumn("held_out", lm_score.crc_part(F.col("doc_id")) == 0)


#: Every fifth crc32 of an id: the rows whose text is tampered with before their proof is checked.
TAMPERED_PART = 5


@register("op13_merkle_manifest", S.OP13)
def op13_merkle_manifest(spark, sf_dir):
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_PART
    return merkle.manifest_report(table(spark, sf_dir, "documents"), Scratch(spark, "op13"), part == 0)


#: Rows whose id is a multiple of this are anchors; those of a multiple of LABEL_STEP move one label on.
ANCHOR_STEP, LABEL_STEP, LABELS = 50, 7, 10


@register("op11_hard_negatives", S.OP11)
def op11_hard_negatives(spark, sf_dir):
    moved = (F.col("label") + 1) % LABELS
    label = F.when(F.col("vec_id") % LABEL_STEP == 0, moved).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % ANCHOR_STEP == 0,
                               Scratch(spark, "op11"), label=label)


@register("op12_suffix_dedup")
def op12_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op12"))
