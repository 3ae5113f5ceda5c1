"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir) and returns a DataFrame, written and reread before the next.

Documents without an identifiable language go; one document of each group of near
copies stays; personal data is replaced; documents are copied until the sources have
their target weights; the rest is packed into training sequences.

Nulls and the like: a document whose text is null, empty or wordless has no language and
goes first. A null doc_id stays, is in no group of near copies, and is packed; a null
source is a source of its own; other nulls pass through. Rows that repeat a doc_id share
its fate. Texts of any length are handled whole. An empty table gives an empty result.
Further columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import common, langid, mixing, neardup, packing, pii


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language can't be told. Every other row is kept as it is."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id. Rows with a null id stay."""
    name = common.fresh(docs, "gone")
    gone = neardup.duplicates(docs).select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings in text are replaced by their kind; n_chars follows. No row goes."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its rounded rate says; by default no rate is under 1, so none goes."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each copy: doc_id, piece, n_tokens, bin, capacity, offset. An empty text has a row with a null bin."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the stages write on the way is deleted when the result is written."""

    def through(k: int) -> DataFrame:
        name, stage = STAGES[k]
        before = through(k - 1) if k else common.table(spark, sf_dir, "documents")
        return common.settled(lambda: stage(spark, before, sf_dir), f"pipeline-{name}")

    return common.settled(lambda: through(len(STAGES) - 1), "pipeline")


#: Trained models, permuted tries and packing can't be put in SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None
