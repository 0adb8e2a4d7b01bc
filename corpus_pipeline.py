"""Corpus pipeline: documents to packed sequences, in five stages.

Quality rules drop what they reject, near-duplicate classes keep their smallest doc_id, documents with a
benchmark window go, secrets are masked, and what is left is packed. All but the last stage return
the columns of ``documents``.

Defined results: a null, empty or blank text fails the quality rules and goes; without labelled rows of
both kinds only the fixed limits apply; rows without an id or with a repeated one stay if their classes
differ, and of equal rows one stays; very long texts pass whole and are cut into pieces only when packed;
an empty table gives an empty result; columns beside id and text pass through the first four stages
whatever their names, but for n_chars, which is counted again where a secret is masked.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontam, packing, rules, secret_scan, simhash
from quadrille.llm.common import checkpoint_dir
from quadrille.llm.tokens import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.new_ledger(spark).redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Isolation forests, fingerprints and tokenizers are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
