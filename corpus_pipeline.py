"""A training corpus from ``documents``: known languages, lines once, one of near copies, no secrets, packed.

Every stage takes what its predecessor kept.  ``run`` writes each stage's rows to the shared folder
and reads them again, so a stage is never computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sabaki.llm.common import materialise, table
from sabaki.llm.jaccard import keep_one_of_near_copies
from sabaki.llm.language_id import keep_known_languages, train
from sabaki.llm.line_dedup import dedup_lines
from sabaki.llm.packing import pack_documents
from sabaki.llm.secrets import redact_secrets


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars, where there is one, as the text now is."""
    at = [c.lower() for c in docs.columns]
    return docs.withColumn(docs.columns[at.index("n_chars")], F.length("text").cast("long")) if "n_chars" in at else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages learned from the labelled ones go; those in several stay."""
    return keep_known_languages(docs, train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that repeat in the corpus stay in one place."""
    return _measured(dedup_lines(docs, counts=False))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the smallest doc_id stays: SimHash of five-word shingles, confirmed at similarity 0.8; prefixes find what lies beyond its radius."""
    return keep_one_of_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; all documents stay."""
    return _measured(redact_secrets(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes: a row for each piece."""
    return pack_documents(docs, special_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't tell languages or tokenise; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
