"""Readers of red-team logs, normalised to one failures table. A malformed line fails the job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FAILURES = "id string, input string, output string, was_violation boolean, attack_category string, severity string, scorer string, score double, metadata string, timestamp double, source string, idx long"
#: A source of failures: whatever gives a frame of FAILURES.
Source = Callable[[SparkSession], DataFrame]
TRUE_WORDS = ("true", "violation", "unsafe", "fail", "1", "yes")


def falsy(c: Column) -> Column:
    """Whether a value, as JSON text, counts as missing."""
    return c.isNull() | c.isin("", "0", "0.0", "false", "null", "[]", "{}")


def first_truthy(*columns: Column) -> Column:
    return F.coalesce(*(F.when(~falsy(c), c) for c in columns))


def truthy(c: Column) -> Column:
    """Words that say so, numbers other than 0; null is false."""
    low, number = F.lower(c), F.expr("1.0")
    number = c.try_cast("double")
    return F.coalesce(low.isin(*TRUE_WORDS) | (number.isNotNull() & (number != 0)), F.lit(False))


def as_float(c: Column) -> Column:
    return F.when(F.lower(c) == "true", 1.0).when(F.lower(c) == "false", 0.0).otherwise(c.try_cast("double"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, line, obj): the non-blank lines with their number, blank ones counted; parsed, or the job fails."""
    split = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"), "value")
    number = F.row_number().over(Window.partitionBy("file").orderBy("_b", "_m")) - 1
    rows = split.select("file", number.cast("long").alias("idx"), F.trim("value").alias("line")).where("line <> ''")
    return rows.withColumn("obj", F.parse_json("line"))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("obj", path, kind)


def _failures(df: DataFrame, source: str, only: bool, **columns: Column) -> DataFrame:
    base = {"attack_category": F.lit(None), "severity": F.lit("medium"), "scorer": F.lit(None), "score": F.lit(None), "metadata": F.col("line"), "timestamp": F.lit(None), "source": F.lit(source), "idx": F.col("idx")} | columns
    kinds = dict(x.split() for x in FAILURES.split(", "))
    out = df.select(*(base[name].cast(kind).alias(name) for name, kind in kinds.items()))
    return out.where("was_violation") if only else out


def conversation_memory(spark: SparkSession, path: str, only_violations: bool = True) -> DataFrame:
    """Prompt memory as JSON lines: the converted prompt, the response and its score."""
    df = _lines(spark, path)
    return _failures(
        df, "memory", only_violations,
        id=F.coalesce(first_truthy(_get("$.conversation_id"), _get("$.id")), F.concat(F.lit("memory-"), F.col("idx").cast("string"))),
        input=F.coalesce(first_truthy(_get("$.converted_value"), _get("$.original_value")), _get("$.input"), F.lit("")),
        output=F.coalesce(first_truthy(_get("$.response_text")), _get("$.output"), F.lit("")),
        was_violation=truthy(first_truthy(_get("$.score_value"), _get("$.scorer_result"), _get("$.was_violation"))),
        attack_category=_get("$.labels.attack_category"), scorer=_get("$.scorer"), score=as_float(first_truthy(_get("$.score"), _get("$.score_value"))), timestamp=_get("$.timestamp", "double"),
    )


def memory_export(df: DataFrame, only_violations: bool = True) -> DataFrame:
    """The same from an exported table, columns taken by name; those it lacks are null."""
    return _failures(
        df.select(F.to_json(F.struct(*df.columns)).alias("line")).withColumns({"obj": F.parse_json("line"), "idx": F.monotonically_increasing_id()}), "memory", only_violations,
        id=F.coalesce(first_truthy(_get("$.conversation_id"), _get("$.id")), F.concat(F.lit("memory-"), F.col("idx").cast("string"))), input=F.coalesce(first_truthy(_get("$.converted_value"), _get("$.original_value")), _get("$.input"), F.lit("")), output=F.coalesce(first_truthy(_get("$.response_text")), _get("$.output"), F.lit("")),
        was_violation=truthy(first_truthy(_get("$.score_value"), _get("$.scorer_result"), _get("$.was_violation"))), scorer=_get("$.scorer"), score=as_float(first_truthy(_get("$.score"), _get("$.score_value"))), timestamp=_get("$.timestamp", "double"),
    )


def probe_report(spark: SparkSession, path: str, only_violations: bool = True) -> DataFrame:
    """Vulnerability probes as JSON lines; attempts and digests count, and any truthy detector result (also in lists) is a violation."""
    df = _lines(spark, path)
    df = df.where(F.coalesce(_get("$.entry_type"), F.lit("attempt")).isin("attempt", "digest"))
    results = F.map_values(F.coalesce(F.try_variant_get("obj", "$.detector_results", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    hit = F.exists(results, lambda v: truthy(F.try_variant_get(v, "$", "string")) | F.exists(F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array().cast("array<string>")), truthy))
    return _failures(
        df, "probe", only_violations,
        id=F.coalesce(first_truthy(_get("$.uuid")), F.concat(F.lit("probe-"), F.col("idx").cast("string"))), input=F.coalesce(_get("$.prompt"), F.lit("")), output=F.coalesce(_get("$.outputs[0]"), F.lit("")),
        was_violation=hit, attack_category=F.coalesce(first_truthy(_get("$.probe_classname")), _get("$.probe_name"), F.lit("")), scorer=F.coalesce(_get("$.detector_classname"), F.lit("")),
    )


def evaluation_log(spark: SparkSession, path: str, only_violations: bool = True) -> DataFrame:
    """Evaluations: a file that is one JSON object has its samples (or results) in it, any other is JSON lines. So a file of one line has none of its own."""
    lines = F.filter(F.transform(F.split("value", "\r\n|\r|\n"), F.trim), lambda x: x != "")
    whole = spark.read.text(path, wholetext=True).select("value", lines.alias("ls"))
    # the parser ignores what follows a first object, so several lines of which the first is one are told by that
    by_line = (F.size("ls") > 1) & F.try_parse_json(F.try_element_at("ls", F.lit(1))).isNotNull()
    whole = whole.withColumn("doc", F.when(~by_line, F.try_parse_json("value")))
    listed = F.coalesce(F.try_variant_get("doc", "$.samples", "array<variant>"), F.try_variant_get("doc", "$.results", "array<variant>"), F.array().cast("array<variant>"))
    inside = whole.where(F.col("doc").isNotNull()).select(F.posexplode(listed).alias("idx", "obj")).select(F.col("idx").cast("long").alias("idx"), "obj", F.to_json("obj").alias("line"))
    rest = whole.where(F.col("doc").isNull()).select(F.posexplode("ls").alias("idx", "line")).select(F.col("idx").cast("long").alias("idx"), F.parse_json("line").alias("obj"), "line")
    return _failures(
        inside.unionByName(rest), "evaluation", only_violations,
        id=F.coalesce(first_truthy(_get("$.id")), F.concat(F.lit("evaluation-"), F.col("idx").cast("string"))), input=F.coalesce(_get("$.input"), F.lit("")), output=F.coalesce(_get("$.output"), F.lit("")),
        was_violation=truthy(F.coalesce(first_truthy(_get("$.score")), _get("$.scores[0].value"))), attack_category=F.coalesce(_get("$.task"), F.lit("")),
    )


def gathered(spark: SparkSession, *sources: Source) -> DataFrame:
    """The failures of several sources in one table, with its columns in order and of its types."""
    kinds = [x.split() for x in FAILURES.split(", ")]
    out = spark.createDataFrame([], FAILURES)
    for source in sources:
        out = out.unionByName(source(spark).select(*(F.col(name).cast(kind).alias(name) for name, kind in kinds)))
    return out


def traces(df: DataFrame, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Production traces (id, input, output, metadata map): a violation is any guard action but allow. All rows are kept, or those of a filter, or the first by id."""
    df = df if where is None else df.where(where)
    df = df if limit is None else df.orderBy("id").limit(limit)
    action = F.element_at("metadata", F.lit("guard_action"))
    rows = df.withColumns({"line": F.to_json("metadata"), "idx": F.monotonically_increasing_id()})
    return _failures(rows, "traces", False, id=F.coalesce(F.col("id").cast("string"), F.concat(F.lit("trace-"), F.col("idx").cast("string"))), input=F.coalesce("input", F.lit("")), output=F.coalesce("output", F.lit("")), was_violation=F.coalesce(action != "allow", F.lit(False)), attack_category=F.element_at("metadata", F.lit("attack_category")))


def append_log(df: DataFrame, path: str) -> None:
    """Structured log rows as JSON lines."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)
