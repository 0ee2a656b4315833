"""opN_ queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import imatch, jaccard, licenses, mixing, onebit, packing, pseudonyms, repeats, toxicity, warc


#: For the queries alone: a deployment passes a key of its own.
PSEUDONYM_KEY = b"veriloom example key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive_and_index(_table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_targets(_table(spark, sf_dir, "documents"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonym_report(_table(spark, sf_dir, "documents"), key=PSEUDONYM_KEY)


def op5_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_onebit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return onebit.search(table, table.where("vec_id % 20 = 0"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_index, op2_jaccard_components, op3_mix_sources, op4_pii_pseudonyms, op5_toxicity_trees, op6_license_scan, op7_onebit_search, op8_best_fit_packing, op9_repeated_passages, op10_imatch_fingerprints)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_index": warc.ORACLE_SQL,
        "op2_jaccard_components": jaccard.ORACLE_SQL,
        "op3_mix_sources": mixing.ORACLE_SQL,
        "op9_repeated_passages": repeats.ORACLE_SQL,
    }
