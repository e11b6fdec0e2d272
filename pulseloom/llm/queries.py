"""The named queries of the thirteen operators and of the pipeline, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pulseloom.llm import divergence, gnat, minhash, mixing, mtree, ngram_join, onebit, packing, pii, ppm, quality, tokens, toxicity
from pulseloom.llm.sql import CODES_SQL, DIVERGENCE_SQL, INNER_PRODUCT_SQL, MINHASH_SQL, MIXING_SQL, NGRAM_SQL, PII_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_inner_products(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def toxicity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.grade(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(_table(spark, sf_dir, "documents"))


def one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda kind: kind == F.lit(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]  # noqa: B023 - used at once
    digest = F.sha2(pii.digest(F.col("base_spans")).cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_table(spark, sf_dir, "documents"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_table(spark, sf_dir, "documents"), width=4, percent=85)


def gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gnat.compress(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mtree_top_k": mtree_top_k,
        "op2_minhash_near_duplicates": minhash_near_duplicates,
        "op3_toxicity_grades": toxicity_grades,
        "op4_token_counts": token_counts,
        "op5_mix_sources": mix_sources,
        "op6_one_bit_neighbours": one_bit_neighbours,
        "op7_best_fit_packing": pack_documents,
        "op8_personal_data": personal_data,
        "op9_ppm_scores": ppm_scores,
        "op10_quality_classifier": quality_scores,
        "op11_source_divergence": source_divergence,
        "op12_ngram_join": ngram_jaccard_join,
        "op13_gnat_codes": gnat_codes,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mtree_top_k": INNER_PRODUCT_SQL,
        "op2_minhash_near_duplicates": MINHASH_SQL,
        "op5_mix_sources": MIXING_SQL,
        "op8_personal_data": PII_SQL,
        "op11_source_divergence": DIVERGENCE_SQL,
        "op12_ngram_join": NGRAM_SQL,
        "op13_gnat_codes": CODES_SQL,
    }
