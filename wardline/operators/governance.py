"""Canary promotion and tamper-evident audit chains."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wardline.functions import decision as D
from wardline.functions import text
from wardline.operators.cascade import Guard, GuardPipeline
from wardline.session import staged

AUDIT = "chain string, seq long, id string, event string, timestamp double, actor string, payload string, prev_hash string, hash string"
DEPLOYABLE = ("regex", "classifier")


def bucket(id_: Column) -> Column:
    """0..99 by a hash of the id, the same on every run."""
    return F.conv(F.substring(F.md5(id_.cast("string")), 1, 8), 16, 10).cast("long") % 100


def in_canary(id_: Column, percent: float) -> Column:
    return bucket(id_) < percent


def promote(artifacts: DataFrame, shadow: bool = False) -> DataFrame:
    """Adds status and note: promoted or shadow for kinds that can run by themselves, skipped without a payload, refused otherwise."""
    status = F.when(F.col("payload").isNull(), "skipped").when(~F.col("kind").isin(*DEPLOYABLE), "refused").otherwise("shadow" if shadow else "promoted")
    return artifacts.withColumn("status", status).withColumn("note", F.when(F.col("status") == "skipped", F.concat("name", F.lit(": deferred"))).when(F.col("status") == "refused", F.concat("name", F.lit(": not deployed automatically"))))


def guards_of(patterns: DataFrame, label: int) -> dict[str, str]:
    """The promoted patterns of a cluster as named patterns for a guard: a bounded number by construction."""
    rows = patterns.where(F.col("label") == label).orderBy("r").select("span").collect()
    return {f"cluster_{label}_{i}": "\\Q" + r.span + "\\E" for i, r in enumerate(rows)}


def materialize(kind: str, name: str, payload) -> Guard:
    """A guard of an artifact: named patterns for regex, a callable of texts for classifier; other kinds aren't deployed by themselves."""
    if kind == "regex":
        return text.pattern_guard(payload if isinstance(payload, dict) else {f"{name}_{i}": p for i, p in enumerate(json.loads(payload))}, name=name)
    if kind == "classifier":
        return text.python_guard(payload, name)
    raise ValueError(f"not deployed automatically: {kind}")


def attach(pipeline: GuardPipeline, kind: str, guard: Guard) -> GuardPipeline:
    """The pipeline with one more guard: patterns in tier 1, anything else in tier 2."""
    tier = "tier1" if kind == "regex" else "tier2"
    return replace(pipeline, **{tier: [*getattr(pipeline, tier), guard]})


def canaried(df: DataFrame, base: GuardPipeline, promoted: GuardPipeline, chunk: str, id_: str, percent: float, shadow: bool = False) -> DataFrame:
    """decision and canary of each row: the promoted pipeline decides the rows in the canary, the base all others.

    With shadow, the base decides every row and a column shadow holds what the promoted one would say in the canary.
    """
    mine = in_canary(F.col(id_), percent)
    both = promoted.apply(base.apply(df.withColumn("canary", mine), chunk, name="decision"), chunk, name="_p")
    if shadow:
        return both.withColumn("shadow", F.when(F.col("canary"), F.col("_p"))).drop("_p")
    return both.withColumn("decision", F.when(F.col("canary"), F.col("_p")).otherwise(F.col("decision"))).drop("_p")


STATE = "promoted array<string>, shadow_only boolean, fp_budget double, canary_percent double, timestamp double"


def write_state_of(promoted: DataFrame, path: str, timestamp: float, shadow: bool = False, fp_budget: float = 0.005, percent: float = 1.0) -> None:
    """What was promoted (rows of promote), as one JSON row: the state names guards, one for each cluster at most."""
    names = F.array_sort(F.collect_list(F.when(F.col("status") == ("shadow" if shadow else "promoted"), F.col("name"))))
    row = promoted.agg(names.alias("promoted"), F.lit(shadow).alias("shadow_only"), F.lit(fp_budget).alias("fp_budget"), F.lit(percent).alias("canary_percent"), F.lit(timestamp).alias("timestamp"))
    row.write.mode("overwrite").json(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE).json(path)


def false_positives(decisions: DataFrame, blocked: Column, benign: Column, budget: float = 0.005, by: list[str] | None = None) -> DataFrame:
    """fp_rate among benign rows, and rolled_back if it exceeds the budget."""
    rate = F.avg(F.when(benign, blocked.cast("double")))
    return decisions.groupBy(*(by or [])).agg(F.count_if(benign).alias("n_benign"), rate.alias("fp_rate"), F.coalesce(rate > budget, F.lit(False)).alias("rolled_back"))


def canonical(prev: Column) -> Column:
    """The hashed form of an entry: its fields and the previous hash, keys sorted, compact."""
    text = lambda c: F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})
    return F.concat_ws("|", *(text(c) for c in ("actor", "event", "id", "payload")), F.coalesce(prev, F.lit("null")), F.coalesce(F.col("timestamp").cast("string"), F.lit("null")))


def entry_hash(prev: Column) -> Column:
    return F.sha2(canonical(prev), 256)


def append_chain(entries: DataFrame, chain: str = "chain", last: DataFrame | None = None) -> DataFrame:
    """entries (chain, seq, id, event, timestamp, actor, payload) with prev_hash and hash; last (chain, hash) resumes.

    Serial within a chain, parallel over chains: a chain's entries stream through one task in order, which holds one hash.
    """
    text = lambda c: F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})
    names = ["id", "event", "timestamp", "actor", "payload"]
    rows = entries.select(F.col(chain), "seq", *names, F.concat_ws("|", *(text(c) for c in ("actor", "event", "id", "payload"))).alias("_body"), F.coalesce(F.col("timestamp").cast("string"), F.lit("null")).alias("_ts"))
    if last is not None:
        given = last.select(F.col(chain).alias("_chain"), F.col("hash").alias("_last"))
        rows = rows.join(given, F.col(chain).eqNullSafe(F.col("_chain")), "left").drop("_chain")
    else:
        rows = rows.withColumn("_last", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, prev, begun = None, None, False
        for batch in batches:
            before, after = [], []
            for key, body, ts, given in zip(*(batch.column(c).to_pylist() for c in (chain, "_body", "_ts", "_last"))):
                if not begun or key != here:
                    here, prev, begun = key, given, True
                before.append(prev)
                prev = hashlib.sha256(f"{body}|{'null' if prev is None else prev}|{ts}".encode()).hexdigest()
                after.append(prev)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (chain, "seq", *names)), pa.array(before, pa.string()), pa.array(after, pa.string())], [chain, "seq", *names, "prev_hash", "hash"])

    schema = entries.select(chain, "seq", *names, F.lit("").cast("string").alias("prev_hash"), F.lit("").cast("string").alias("hash")).schema
    # by a hash of the chain: a shuffle by the chain itself counts as a repetition of the join's and is left out, and the join's may then be read in other parts than whole chains
    ordered = rows.repartition(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(chain)).sortWithinPartitions(chain, "seq")
    return ordered.mapInArrow(run, StructType([StructField(f.name, f.dataType, True) for f in schema]))


def write_log(entries: DataFrame, path: str) -> None:
    """Appends hashed entries to a log of JSON lines."""
    line = F.to_json(F.struct(*entries.columns), {"ignoreNullFields": "false"})
    entries.select(line.alias("value")).write.mode("append").text(path)


def log_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a log; none where it isn't there. A malformed line fails the job."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], AUDIT)
    return spark.read.text(path).select(F.from_json("value", AUDIT, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def append_log(entries: DataFrame, path: str) -> None:
    """Entries hashed on from the last of their chain in the log, and appended to it. One writer at a time."""
    old = log_entries(entries.sparkSession, path)
    last = old.groupBy("chain").agg(F.max_by("hash", "seq").alias("hash"))
    write_log(staged(append_chain(entries, last=last)), path)


def verify_chain(audit: DataFrame, chain: str = "chain") -> DataFrame:
    """chain, n, valid: every entry names its predecessor's hash, and hashes to its own; entries are checked in parallel."""
    w = Window.partitionBy(chain).orderBy("seq")
    ok = F.lag("hash").over(w).eqNullSafe(F.col("prev_hash")) & F.col("hash").eqNullSafe(entry_hash(F.col("prev_hash")))
    return audit.withColumn("_ok", ok).groupBy(chain).agg(F.count("*").alias("n"), F.bool_and("_ok").alias("valid"))
