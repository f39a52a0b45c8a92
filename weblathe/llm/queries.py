"""The queries of this subpackage over the corpus tables; their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boosting, chunking, decontaminate, html_text, lattice, licences, merkle, mixing, quality, ranking, runindex, sharding, simhash
from .oracle import ORACLE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_label_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op3_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.repeats_report(table(spark, sf_dir, "documents"))


def op4_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op6_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_report(table(spark, sf_dir, "documents"))


def op9_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_report(table(spark, sf_dir, "documents"))


def op10_licence_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_report(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosting.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hierarchical_mix": op1_hierarchical_mix,
    "op2_label_model": op2_label_model,
    "op3_run_length_index": op3_run_length_index,
    "op4_jump_hash_shards": op4_jump_hash_shards,
    "op5_simhash_bktree": op5_simhash_bktree,
    "op6_winnowing_decontamination": op6_winnowing_decontamination,
    "op7_tag_path_ratios": op7_tag_path_ratios,
    "op8_lattice_likelihood": op8_lattice_likelihood,
    "op9_gear_chunks": op9_gear_chunks,
    "op10_licence_inheritance": op10_licence_inheritance,
    "op11_ranked_search": op11_ranked_search,
    "op12_boosted_quality": op12_boosted_quality,
    "op13_merkle_manifest": op13_merkle_manifest,
}
