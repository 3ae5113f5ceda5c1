"""Typed decisions as struct columns, and how several become one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIONS = ("allow", "transform", "escalate", "block")  # by rising precedence
FALLBACK = "This request can't be answered."
TYPE = "struct<action:string,confidence:double,tier:int,rationale:string,evidence:string,severity:string,fallback:string,guard_name:string,transformed_content:string>"


def decide(action: str, confidence: Column | float = 1.0, *, tier: int = 0, rationale: Column | str = "passed", evidence: Column | None = None, severity: Column | str = "info", fallback: str | None = None, guard: str = "", transformed: Column | None = None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(action).alias("action"), as_col(confidence).cast("double").alias("confidence"), F.lit(tier).alias("tier"), as_col(rationale).cast("string").alias("rationale"),
        (evidence if evidence is not None else F.lit("{}")).alias("evidence"), as_col(severity).cast("string").alias("severity"), F.lit(fallback).cast("string").alias("fallback"),
        F.lit(guard).alias("guard_name"), (transformed if transformed is not None else F.lit(None)).cast("string").alias("transformed_content"),
    ).cast(TYPE)


def allow(**kw) -> Column:
    return decide("allow", **kw)


def block(confidence=1.0, **kw) -> Column:
    return decide("block", confidence, **{"severity": "high", "fallback": FALLBACK} | kw)


def transform(new: Column, confidence=1.0, **kw) -> Column:
    return decide("transform", confidence, transformed=new, **{"severity": "low"} | kw)


def escalate(confidence=1.0, **kw) -> Column:
    return decide("escalate", confidence, **{"severity": "medium"} | kw)


def terminal(d: Column) -> Column:
    """Ends a cascade or a stream."""
    return d["action"].isin("block", "escalate")


def blocked(d: Column) -> Column:
    return d["action"] == "block"


def rank(action: Column) -> Column:
    return F.when(action == "block", 3).when(action == "escalate", 2).when(action == "transform", 1).otherwise(0)


def combine(decisions: list[Column], tier: int = 0) -> Column:
    """Block over escalate over transform over allow; then the higher confidence, except that the first transform wins; then the earlier guard. No guards: allow."""
    if not decisions:
        return allow(tier=tier)
    keyed = [F.struct(rank(d["action"]).alias("r"), F.when(d["action"] == "transform", 0.0).otherwise(d["confidence"]).alias("c"), F.lit(-i).alias("p"), d.alias("d")) for i, d in enumerate(decisions)]
    return F.array_max(F.array(*keyed))["d"]


def render(d: Column, text: Column) -> Column:
    """What a caller gets to see."""
    return F.when(d["action"] == "allow", text).when(d["action"] == "transform", d["transformed_content"]).otherwise(F.coalesce(F.nullif(d["fallback"], F.lit("")), F.lit("[blocked]")))


def stable_id(*parts: Column) -> Column:
    """A reproducible decision id."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def span(d: Column, name: str, start: Column, end: Column, parent: Column | None = None) -> Column:
    """A trace span of a decision: name, ids, times, status and attributes, with the evidence as an event where it is a violation."""
    kind = "struct<name:string,at:timestamp,attributes:map<string,string>>"
    event = F.struct(F.lit("violation"), end.cast("timestamp"), F.map_from_arrays(F.array(F.lit("violation.severity"), F.lit("violation.rationale")), F.array(d["severity"], d["rationale"]))).cast(kind)
    return F.struct(
        F.lit(name).alias("name"), F.substring(stable_id(F.lit(name), start, end, d["guard_name"]), 1, 16).alias("span_id"), (parent if parent is not None else F.lit(None)).cast("string").alias("parent_id"), start.cast("timestamp").alias("start"), end.cast("timestamp").alias("end"),
        F.when(terminal(d), "ERROR").otherwise("OK").alias("status"), attributes(d).alias("attributes"), F.when(terminal(d), F.array(event)).otherwise(F.array().cast(f"array<{kind}>")).alias("events"),
    )


def attributes(d: Column, namespace: str = "guard") -> Column:
    """The decision as a flat telemetry map; nulls are left out."""
    from wardline.functions.redaction import clip

    pairs = {f: d[f].cast("string") for f in ("action", "confidence", "tier", "severity", "fallback", "guard_name")} | {f: clip(d[f]) for f in ("rationale", "evidence")}
    return F.map_filter(F.map_from_arrays(F.array(*(F.lit(f"{namespace}.{k}") for k in pairs)), F.array(*pairs.values())), lambda k, v: v.isNotNull())
