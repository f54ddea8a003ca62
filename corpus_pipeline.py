"""Corpus pipeline: quality rules, language ID, near-duplicates, decontamination, BPE.

Every stage works on all that its predecessor kept, and its decisions take effect: what it
rejects is gone. All stages but the last return the columns of ``documents``; the last returns
token counts and digests by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.llm import bpe, decontaminate, language_id, quality, simhash
from chatprep.llm.common import Scratch
from chatprep.llm.queries import QUALITY_POLICY, SIMHASH, tokenizer_path
from chatprep.llm.registry import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the production policy keeps. Rows with null or blank text have no words and go."""
    rows = quality.ledger(docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("_doc_text")),
                          text="_doc_text")
    return quality.apply_policy(rows, QUALITY_POLICY).filter("kept").select("_doc.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is undetermined: those without a letter, and no others.

    Fitted on the labels of the documents it gets; the score is not used. Without a labelled
    document there is no language to tell, and every row stays.
    """
    model = language_id.fit(docs)
    if not model.languages:
        return docs
    return docs.filter(language_id.prediction(model, F.col("text"))["lang_pred"] != language_id.UNDETERMINED)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group: the one with the smallest id."""
    return simhash.one_of_each_group(docs, Scratch(spark, "pipeline-simhash"), **SIMHASH)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "pipeline-winnow"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe", encoding),
]

#: Language ID and BPE can't be written in SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
