"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import common, fingerprint, langid, license, media, mixing, neardup, packing, pii, ppm, tokencount

Query = Callable[[SparkSession, str], DataFrame]


def on(name: str, fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(common.table(spark, sf_dir, name))


def _contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fingerprint.sketch(common.table(spark, sf_dir, "benchmark"), "item_id")
    return fingerprint.containment(items, fingerprint.sketch(common.table(spark, sf_dir, "documents")), "item_id", "doc_id")


QUERIES: dict[str, Query] = {
    "op1_ppm_code_length": on("documents", ppm.score),
    "op2_language_id": on("documents", langid.identify),
    "op3_media_chunks": on("pages", media.chunked),
    "op4_license_scan": on("documents", license.scan),
    "op5_near_duplicates": on("documents", neardup.duplicates),
    "op6_best_fit_packing": on("documents", packing.pack),
    "op7_fingerprints": on("documents", fingerprint.fingerprints),
    "op8_token_counts": on("documents", tokencount.revised),
    "op9_source_mixing": on("documents", mixing.rates),
    "op10_personal_data": on("documents", pii.scan),
    "fingerprint_containment": _contained,
    "fingerprint_passages": lambda spark, sf_dir: fingerprint.passages(common.table(spark, sf_dir, "benchmark"), common.table(spark, sf_dir, "documents")),
}

SQL: dict[str, str] = {"op7_fingerprints": fingerprint.SKETCH_SQL, "fingerprint_containment": fingerprint.CONTAINMENT_SQL, "fingerprint_passages": fingerprint.PASSAGES_SQL}
