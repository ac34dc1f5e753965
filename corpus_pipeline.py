"""A training-data pipeline of the operators in lineweave.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs; all but the last keep the columns of documents.

1. quality rules: documents that the repetition rules reject go.
2. near duplicates: of each group of documents linked by the n-gram Jaccard join, the one with the smallest doc_id stays.
3. benchmark decontamination: contaminated documents go.
4. secret scan: each secret in a text is masked, n_chars follows; every document stays.
5. best-fit packing: the pieces of all documents and their places in token sequences.

Edge cases: a null or empty text, or one of few words, fails the quality rules and goes; of repeated rows, and of copies, one
stays; rows without doc_id are like others; very long texts are worked on whole; an empty benchmark removes nothing; an
empty table gives an empty one, with no pieces; further columns, whatever their names, stay up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineweave.llm import common, decontaminate, jaccard, packing, repetition, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.rejected_removed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_removed(docs, common.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: The rules' verdict, links between all documents and token ids can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
