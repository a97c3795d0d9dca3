"""A corpus pipeline of five operators: each stage's rows are written as Parquet and read by the next.

Stages take ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``. The
first drops documents that break the quality rules, the second those that the classifier scores
below its cutoff, the third keeps the smallest doc_id of each group of near duplicates, the fourth
blanks out secrets, and the last places all pieces in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import read, work_dir
from quillspark.llm.factorization import keep_good
from quillspark.llm.packing import pack
from quillspark.llm.quality_rules import quality_rules as apply_rules
from quillspark.llm.secret_scan import redact_secrets
from quillspark.llm.simhash import drop_near_duplicates
from quillspark.llm.tokens import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and the certified cutoffs.

    Null and empty texts fail the base checks; repeated rows are judged each by itself; an empty table
    gives an empty one; further columns, of any name, are kept.
    """
    return apply_rules(docs, read(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on those that are left, scores as good.

    Without labelled documents of both kinds every document has one score, the share of good labels. Null
    texts are scored as empty ones; repeated rows have one verdict; an empty table gives an empty one.
    """
    return keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: by SimHash, or by 0.8 of five-word shingles and more.

    The smallest doc_id of a group stays, of groups without any one of its rows; of repeated rows one. Null,
    empty and wordless texts are one group. An empty table gives an empty one; further columns are kept.
    """
    return drop_near_duplicates(docs, similarity=0.8, shingle=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; null texts stay null, repeated rows stay, further columns are kept."""
    return redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes.

    Null texts are empty and have the end id alone; rows that share a doc_id are packed each by itself; an
    empty table gives no row. Which of several documents of one length takes which place is free.
    """
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier's and the packing's rows have no form in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
