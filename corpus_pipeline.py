"""From raw documents to packed sequences: quality, near duplicates, personal data, mixing, packing.

Each stage takes what the one before kept. All but the last return the columns
of ``documents``; :func:`run` writes every stage as Parquet into the shared
checkpoint folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseloom.llm import minhash, mixing, packing, pii, quality
from pulseloom.session import checkpointed

#: The draws of the mix and the learned scores have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts (score of at least 0.7)."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    aside = {c: f"documents_{c}" for c in ("score", "predicted")}  # columns of these names are not the classifier's
    scored = quality.score(docs.withColumnsRenamed(aside), model).where("predicted = 1").drop("score", "predicted")
    return scored.withColumnsRenamed({v: k for k, v in aside.items()})


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity from 0.8 on."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked; every document stays."""
    return pii.mask_personal_data(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.draw(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
