"""A pipeline from documents to token ids: rules, classifier, near-duplicates, mix, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept; ``run`` writes each
stage's rows as Parquet to the folder that all executors share and reads them again for the next.

Null and empty texts fail the plain rules and go in the first stage; given to a later one alone, they are scored by
length, are copies of each other, are not taken by the mix, or have no ids. A row without ``doc_id`` is judged like others and
teaches nothing. Repeated rows are judged each and leave one. Long texts are read whole. An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factsheet.llm import byte_bpe, mixing, quality_classifier, quality_rules, simhash
from factsheet.llm.common import shared_folder, ship, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and the forest."""
    ship(spark)
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores as good."""
    ship(spark)
    return quality_classifier.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of three words, two bits."""
    ship(spark)
    return simhash.representatives(docs, width=3, radius=2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, ``n_tokens`` and ``ids`` of every document."""
    ship(spark)
    return byte_bpe.encoded(docs, keep=["doc_id", "lang", "source"], offsets=False)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near-duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: Forest, classifier, fingerprints, seeded draws and ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
