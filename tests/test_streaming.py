"""Streams give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from wardline.functions import text
from wardline.operators import ordered
from wardline.operators.cascade import GuardPipeline
from wardline.streaming import stateful

SF = "/root/testdata/sf0.001"


def drain(spark, tmp_path, fn, table):
    src = spark.read.parquet(f"{SF}/{table}.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = fn(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_guard_stream(spark, tmp_path):
    def verdict(chunk, buffer):
        return ("block", "-") if "token" in buffer.lower() or "idiot" in buffer.lower() else ("allow", chunk)

    out = drain(spark, tmp_path, lambda s: stateful.guard_stream(s, "conv_id", "turn", "text", verdict), "conversations")
    batch = GuardPipeline(tier2=[text.trigger_guard(["token", "idiot"])]).guard_stream(spark.read.parquet(f"{SF}/conversations.parquet"), "conv_id", "turn", "text")
    assert {(r.key, r.seq, r.action) for r in out.collect()} == {(str(r.conv_id), r.turn, r.decision.action) for r in batch.collect()}


def test_running_budget(spark, tmp_path):
    out = drain(spark, tmp_path, lambda s: stateful.running_budget(s, "user_id", "event_id", "value", 500.0), "events")
    batch = ordered.running(spark.read.parquet(f"{SF}/events.parquet"), ["user_id"], ["event_id"], F.col("value"), 500.0)
    assert {r.seq: pytest.approx(r.used) for r in out.collect()} == {r.event_id: r.used for r in batch.collect()}


def test_duplicates(spark, tmp_path):
    out = drain(spark, tmp_path, lambda s: stateful.duplicate_calls(s, "user_id", "event_id", "event_type"), "events")
    batch = ordered.Progress().observe(spark.read.parquet(f"{SF}/events.parquet"), ["user_id"], ["event_id"], F.col("event_type"))
    assert {r.seq: r.duplicate for r in out.collect()} == {r.event_id: r.duplicate is not None for r in batch.collect()}
