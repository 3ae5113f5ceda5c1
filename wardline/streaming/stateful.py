"""The ordered operators over streams: guarded chunks, running budgets, loop detection; and rates by event time."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guard_stream(stream: DataFrame, key: str, seq: str, chunk: str, verdict: Callable[[str, str], tuple[str, str]]) -> DataFrame:
    """key, seq, action, emitted, error of each chunk up to a stream's first block or escalate. verdict(chunk, buffer) gives (action, text); one that raises allows the chunk, and the error is told. State: the buffer and whether the stream is over."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        buffer, over = state.get if state.exists else ("", False)
        rows = []
        fresh = pd.concat(list(batches)).sort_values("seq")
        for number, text in zip(fresh["seq"].tolist(), fresh["chunk"].tolist()):
            if over:
                break
            text, error = text or "", None
            buffer += text
            try:
                action, out = verdict(text, buffer)
            except Exception as e:
                action, out, error = "allow", text, type(e).__name__
            rows.append((k[0], number, action, out, error))
            over = action in ("block", "escalate")
        state.update(("" if over else buffer, over))
        yield pd.DataFrame(rows, columns=["key", "seq", "action", "emitted", "error"])

    flat = stream.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(chunk).alias("chunk"))
    return flat.groupBy("key").applyInPandasWithState(run, "key string, seq long, action string, emitted string, error string", "buffer string, over boolean", "append", "NoTimeout")


def running_budget(stream: DataFrame, key: str, seq: str, amount: str, limit: float) -> DataFrame:
    """key, seq, used, exceeded of each step; the state is one number."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values("seq")
        total = used + rows["amount"].cumsum()
        state.update((float(total.iloc[-1]),))
        yield pd.DataFrame({"key": k[0], "seq": rows["seq"], "used": total, "exceeded": total > limit})

    flat = stream.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(amount).cast("double").alias("amount"))
    return flat.groupBy("key").applyInPandasWithState(run, "key string, seq long, used double, exceeded boolean", "used double", "append", "NoTimeout")


def duplicate_calls(stream: DataFrame, key: str, seq: str, fingerprint: str, window: int = 12, threshold: int = 3) -> DataFrame:
    """key, seq, duplicate of each step: whether the window holds a fingerprint threshold times. State: the window."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0] if state.exists else [], maxlen=window)
        rows = pd.concat(list(batches)).sort_values("seq")
        hit = []
        for fp in rows["fp"]:
            held.append(fp)
            hit.append(any(held.count(x) >= threshold for x in set(held)))
        state.update((list(held),))
        yield pd.DataFrame({"key": k[0], "seq": rows["seq"], "duplicate": hit})

    flat = stream.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(fingerprint).cast("string").alias("fp"))
    return flat.groupBy("key").applyInPandasWithState(run, "key string, seq long, duplicate boolean", "held array<string>", "append", "NoTimeout")


def decision_rates(events: DataFrame, ts: str, by: Column, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window; events later than the watermark are dropped when the frame streams."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", width).alias("w"), by.alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
