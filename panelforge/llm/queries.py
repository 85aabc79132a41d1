"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, cosine_dedup, decontaminate, license_scan, line_dedup, mixing, pseudo_lm, quality_fm, simhash, source_divergence, spelling, toxicity, url_cascade


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_int8_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.spread(_table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(_table(spark, sf_dir, "documents"))


def op4_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op6_license_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(_table(spark, sf_dir, "documents"))


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_lm.score(_table(spark, sf_dir, "documents"))


def op8_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_cascade.judge(pages, listed=url_cascade.stuffed_hosts(pages))


def op10_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_hyperplane_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_dedup.groups(_table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, sf_dir, "documents"))


def op13_errata_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_int8_block_join,
        op2_line_spread,
        op3_source_mixing,
        op4_factorisation_machine,
        op5_simhash_popcount,
        op6_license_alignment,
        op7_pseudo_likelihood,
        op8_kneser_ney_toxicity,
        op9_url_cascade,
        op10_benchmark_containment,
        op11_hyperplane_groups,
        op12_source_divergence,
        op13_errata_trie,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_int8_block_join": ann.SQL,
        "op2_line_spread": line_dedup.SQL,
        "op3_source_mixing": mixing.SQL,
        "op9_url_cascade": url_cascade.SQL,
        "op10_benchmark_containment": decontaminate.SQL,
        "op11_hyperplane_groups": cosine_dedup.SQL,
        "op12_source_divergence": source_divergence.SQL,
        "op13_errata_trie": spelling.SQL,
    }
