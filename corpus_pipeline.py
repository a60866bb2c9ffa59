"""A pipeline of four stages over documents: language ID, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() applies them in order, writing each result as Parquet and reading it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import langid, omh, packing, pii
from kinweave.llm.common import ensure_checkpoint_dir
from kinweave.ship import ship

#: Below this share of the best language a document is rejected, like one without any letter.
LEAST_SHARE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; learns from the documents it is given.

    Rejected: null texts, texts without a letter, and texts whose best language has less than LEAST_SHARE.
    """
    ship(spark)
    found = langid.identify_rows(docs, langid.train(docs))
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("lang_score") >= LEAST_SHARE)).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one of smallest id."""
    ship(spark)
    return omh.keep_one(docs, omh.near_duplicates(docs))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that reveal it; keeps every document."""
    ship(spark)
    return pii.sanitise_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row per piece."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("near_dedup", dedup_stage),
    ("privacy", privacy_stage),
    ("packing", packing_stage),
]
#: SQL can't express the stages; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
