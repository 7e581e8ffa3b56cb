"""Corpus preparation: quality rules, near duplicates, decontamination, PII, token ids.

``STAGES`` are (name, function) pairs.  Each function takes (spark, docs, sf_dir) and gives a DataFrame that
is written as Parquet and read again as the next one's ``docs``.  All but the last return the columns of
``documents``; nothing is sampled, and each stage works on every row and whole text that it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, decontam, jaccard, pii, quality
from quillgraph.llm.queries import split_pattern, table, tokenizer_file
from quillgraph.llm.runtime import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go.

    Null, empty and blank texts, and texts of fewer than 50 words, fail the base rules and go; long texts are
    measured whole; rows that repeat are judged each for itself; an empty table stays one.
    """
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, that with the smallest ``doc_id``.

    Null and empty texts link with nothing, and rows with a null ``doc_id`` are in no group: they stay.  Of rows
    equal in ``doc_id`` and text one stays, that whose columns, as JSON, come first.  Texts are compared whole.
    """
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go: any window of 13 words of an item, or an item of fewer words.

    Null and empty texts stay; long texts are scanned whole; rows that repeat are judged each for itself; an
    empty benchmark drops nothing.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; ``n_chars`` follows the text.

    The classifier of loose spans is fitted on the whole table.  Null texts stay null, with a null ``n_chars``;
    empty texts stay empty; long texts are read whole; rows that repeat change alike.
    """
    clean = pii.redact(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and the text's digest after decoding them; null and empty texts have no ids."""
    return bpe.encode_checked(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), split_pattern(), keep=["doc_id"])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: SQL has no byte-level BPE and no classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
