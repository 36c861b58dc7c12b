"""Corpus pipeline: the stages of a training-data run, each written as Parquet and read again by the next.

Documents that the toxicity classifier rejects go, one document of each near-duplicate group stays, documents with benchmark items
go, personal data is replaced by its kind, and what is left is packed into training sequences.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parent)
if _ROOT not in sys.path:
    sys.path.insert(0, _ROOT)

from trialweave.llm import decontaminate, packing, pii, queries, simhash  # noqa: E402
from trialweave.llm import toxicity as classifier  # noqa: E402
from trialweave.llm.common import stored, table  # noqa: E402

#: Documents whose score reaches it are rejected.
TOXIC_FROM = 0.3


def columns(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under ``TOXIC_FROM``; null and empty texts have the score of no words."""
    model = queries.toxicity_model(spark, sf_dir, docs)
    return classifier.score(docs, model, into="__score").where(F.col("__score") < TOXIC_FROM).select(*columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked by a Jaccard similarity of five-word shingles of 0.8 or more."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in ``text``; ``n_chars`` follows the new text."""
    found = pii.find(docs, pii.fit(docs), prefix="__").withColumn("__clean", pii.redact(F.col("text"), F.col("__spans")))
    new = {"text": F.col("__clean"), "n_chars": F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("__clean").cast("long"))}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack(docs, queries.vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", packed),
]

#: Tokens and the fitted classifier cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
