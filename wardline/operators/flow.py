"""Information flow: labels of values, their joins, and the authorisation of tool calls against a policy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTEGRITY = ("TRUSTED", "UNTRUSTED", "QUARANTINED")
CAPABILITIES = ("read.public", "read.private", "read.secrets", "write.internal", "write.external", "execute.code", "network.egress")
MODES = ("strict", "mediated")
REASONS = ("cfi_too_low", "arg_integrity_too_low", "forbidden_caps", "tool_integrity_too_low", "deny_rule")


def rank(integrity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, INTEGRITY)), integrity).cast("int") - 1


def label(rank_: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, INTEGRITY)), rank_ + 1)


def meets(actual: Column, required: Column) -> Column:
    return actual <= required


def strings(c: Column | None = None) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))) if c is not None else F.array().cast("array<string>")


def tainted(value: Column, provenance: Column, capabilities: Column, integrity: Column, annotations: Column | None = None) -> Column:
    return F.struct(value.alias("value"), strings(provenance).alias("provenance"), strings(capabilities).alias("capabilities"), integrity.cast("int").alias("integrity"), (annotations if annotations is not None else F.create_map().cast("map<string,string>")).alias("annotations"))


def lift(value: Column, source: Column | str, integrity: str = "UNTRUSTED", capabilities: tuple[str, ...] = ()) -> Column:
    return tainted(value, F.array(source if isinstance(source, Column) else F.lit(source)), F.array(*map(F.lit, capabilities)).cast("array<string>"), F.lit(INTEGRITY.index(integrity)))


def lower(t: Column) -> Column:
    return t["value"]


def map_value(t: Column, fn: Callable[[Column], Column]) -> Column:
    return t.withField("value", fn(t["value"]))


def join(a: Column, b: Column, value: Column | None = None) -> Column:
    """The first's value (or the given one) under both labels: unions, and the worse integrity."""
    return tainted(value if value is not None else a["value"], F.array_union(a["provenance"], b["provenance"]), F.array_union(a["capabilities"], b["capabilities"]), F.greatest(a["integrity"], b["integrity"]))


def concat(a: Column, b: Column) -> Column:
    return join(a, b, F.concat(a["value"], b["value"]))


def with_label(t: Column, integrity: str | None = None, provenance: tuple[str, ...] = (), capabilities: tuple[str, ...] = ()) -> Column:
    """Integrity is overwritten; provenance and capabilities are added."""
    if integrity:
        t = t.withField("integrity", F.lit(INTEGRITY.index(integrity)))
    for name, more in (("provenance", provenance), ("capabilities", capabilities)):
        if more:
            t = t.withField(name, strings(F.array_union(t[name], F.array(*map(F.lit, more)))))
    return t


def elements(df: DataFrame, column: str) -> DataFrame:
    """A row for each element of a labelled array; it inherits the labels."""
    t = F.col(column)
    return df.withColumn("_e", F.explode(t["value"])).withColumn(column, tainted(F.col("_e"), t["provenance"], t["capabilities"], t["integrity"])).drop("_e")


def item(t: Column, key) -> Column:
    """The element of a labelled array (by its number from 1) or map; it inherits the labels."""
    return tainted(F.try_element_at(t["value"], key if isinstance(key, Column) else F.lit(key)), t["provenance"], t["capabilities"], t["integrity"])


def length(t: Column) -> Column:
    """A bare number of elements."""
    return F.size(t["value"])


def holds(t: Column, value) -> Column:
    """A bare truth value."""
    return F.array_contains(t["value"], value)


def join_all(args: DataFrame, *keys: str, **more: Column) -> DataFrame:
    """provenance, capabilities and integrity of each group of labelled arguments (columns of those names), and further aggregates; no arguments: empty and trusted."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    return args.groupBy(*keys).agg(union(F.col("provenance")).alias("provenance"), union(F.col("capabilities")).alias("capabilities"), F.coalesce(F.max("integrity"), F.lit(0)).alias("integrity"), *(c.alias(k) for k, c in more.items()))


def lift_args(df: DataFrame, arg: str = "value", surface: str = "llm.output") -> DataFrame:
    """Adds labels to bare text arguments: the surface they came from, untrusted. Other types stay unlabelled."""
    textual = dict(df.dtypes)[arg] == "string"
    given = (F.col(arg).isNotNull()) if textual else F.lit(False)
    return df.withColumns({"provenance": F.when(given, F.array(F.lit(surface))).otherwise(strings()), "capabilities": strings(), "integrity": F.when(given, 1).otherwise(0)})


@dataclass
class Policy:
    """Requirements and denials by tool. The last registration of a name wins; deny rules add up in order."""

    name: str = "policy"
    mode: str = "strict"
    sources: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    requirements: dict[str, dict] = field(default_factory=dict)
    deny_rules: list[tuple[str | None, Callable[[dict[str, Column]], Column], str]] = field(default_factory=list)
    declassifiers: dict[str, str] = field(default_factory=dict)
    tools: dict[str, dict] = field(default_factory=dict)

    def label_source(self, name: str, integrity: str, capabilities: tuple[str, ...] = ()) -> Policy:
        self.sources[name] = (integrity, tuple(sorted(set(capabilities))))
        return self

    def require(self, tool: str, cfi: str = "UNTRUSTED", capabilities: tuple[str, ...] = (), arg_max_integrity: str | None = None) -> Policy:
        self.requirements[tool] = {"cfi": cfi, "capabilities": tuple(sorted(set(capabilities))), "arg": arg_max_integrity}
        return self

    def deny_if(self, tool: str | None, when: Callable[[dict[str, Column]], Column], reason: str) -> Policy:
        self.deny_rules.append((tool, when, reason))
        return self

    def declassify(self, name: str, to: str) -> Policy:
        self.declassifiers[name] = to
        return self

    def secure_tool(self, name: str, integrity: str | None = None, capabilities: tuple[str, ...] = ()) -> Policy:
        """What a tool declares of itself; its capabilities are reported, not checked."""
        self.tools[name] = {"integrity": integrity, "capabilities": tuple(sorted(set(capabilities)))}
        return self

    def with_mode(self, mode: str) -> Policy:
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.mode = mode
        return self

    def to_dict(self) -> dict:
        return {"name": self.name, "mode": self.mode, "sources": {k: {"integrity": i, "capabilities": list(c)} for k, (i, c) in self.sources.items()}, "requirements": {k: v | {"capabilities": list(v["capabilities"])} for k, v in self.requirements.items()}, "deny": [{"tool": t, "reason": r} for t, _, r in self.deny_rules], "declassify": dict(self.declassifiers)}

    def requirement_table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, INTEGRITY.index(r["cfi"]), list(r["capabilities"]), None if r["arg"] is None else INTEGRITY.index(r["arg"])) for t, r in self.requirements.items()]
        return spark.createDataFrame(rows, "tool string, _cfi int, _caps array<string>, _arg int")

    def tool_table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, None if m["integrity"] is None else INTEGRITY.index(m["integrity"])) for t, m in self.tools.items()]
        return spark.createDataFrame(rows, "tool string, _own int")


def _why(code: Column, reason: Column) -> Column:
    return F.struct(code.alias("c"), reason.alias("r"))


def authorize(calls: DataFrame, policy: Policy, approvals: DataFrame | None = None, key: str = "call_id") -> DataFrame:
    """The calls (key, tool, cfi rank, provenance, capabilities, integrity) with allowed, mediated, reason_code and reason.

    The first failing rung counts: control flow, integrity of arguments, capabilities not
    granted (none is, by default), integrity the tool declares, deny rules in order. A
    deny rule that yields null doesn't match. In mediated mode a violation whose key is
    in approvals is allowed. The policy tables are small; Catalyst broadcasts them.
    """
    spark = calls.sparkSession
    df = calls.join(policy.requirement_table(spark), "tool", "left").join(policy.tool_table(spark), "tool", "left")
    known = F.col("_cfi").isNotNull()
    forbidden = F.array_except("capabilities", "_caps")
    code = F.when(known & ~meets(F.col("cfi"), F.col("_cfi")), F.struct(F.lit(REASONS[0]).alias("c"), F.concat(F.lit("control flow is "), label(F.col("cfi")), F.lit(", needs "), label(F.col("_cfi"))).alias("r")))
    code = code.when(known & F.col("_arg").isNotNull() & ~meets(F.col("integrity"), F.col("_arg")), _why(F.lit(REASONS[1]), F.concat(F.lit("arguments are "), label(F.col("integrity")), F.lit(", needs "), label(F.col("_arg")))))
    code = code.when(known & (F.size(forbidden) > 0), _why(F.lit(REASONS[2]), F.concat(F.lit("not granted: "), F.array_join(forbidden, ", "))))
    code = code.when(F.col("_own").isNotNull() & ~meets(F.col("integrity"), F.col("_own")), _why(F.lit(REASONS[3]), F.concat(F.lit("arguments are "), label(F.col("integrity")), F.lit(", the tool needs "), label(F.col("_own")))))
    ctx = {c: F.col(c) for c in calls.columns}
    for tool, when, reason in policy.deny_rules:
        hit = F.coalesce(when(ctx), F.lit(False))
        code = code.when(hit if tool is None else (F.col("tool") == tool) & hit, _why(F.lit(REASONS[4]), F.lit(reason)))
    df = df.withColumn("_v", code)
    mediated = F.lit(False)
    if policy.mode == "mediated" and approvals is not None:
        df = df.join(approvals.select(key).distinct().withColumn("_ok", F.lit(True)), key, "left")
        mediated = F.col("_v").isNotNull() & F.coalesce(F.col("_ok"), F.lit(False))
    return df.select(*calls.columns, (F.col("_v").isNull() | mediated).alias("allowed"), mediated.alias("mediated"), F.col("_v.c").alias("reason_code"), F.col("_v.r").alias("reason"))


def violation_decision(verdicts: DataFrame) -> DataFrame:
    """Adds the decision of each verdict."""
    from wardline.functions import decision as D

    evidence = F.to_json(F.struct("provenance", "capabilities", label(F.col("integrity")).alias("integrity")))
    bad = D.block(rationale=F.col("reason"), severity="critical", evidence=evidence, guard="flow")
    named = F.when(F.col("mediated"), F.concat(F.lit("flow:"), F.col("tool"), F.lit(":mediated"))).otherwise(F.concat(F.lit("flow:"), F.col("tool")))
    return verdicts.withColumn("decision", F.when(F.col("allowed"), D.allow()).otherwise(bad).withField("guard_name", named))


def taint_trail(records: DataFrame, key: str, seq: str) -> DataFrame:
    """key, trail: the recorded (src, op, dst) edges in order."""
    return records.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), "src", "op", "dst"))), lambda x: F.struct(x["src"].alias("src"), x["op"].alias("op"), x["dst"].alias("dst"))).alias("trail"))


def registry_status(tools: DataFrame, manifest: DataFrame | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """tools (name, description, schema) with matched patterns, schema_hash and status: poisoned, drift or ok. Tools that the manifest doesn't pin can't drift."""
    from wardline.functions.text import schema_hash, screen

    df = tools.withColumns({"matched": screen(F.coalesce("description", F.lit("")), extra), "schema_hash": schema_hash(F.col("schema"))})
    pinned = F.lit(None).cast("string")
    if manifest is not None:
        df = df.join(manifest.select("name", F.col("schema_hash").alias("_pinned")), "name", "left")
        pinned = F.col("_pinned")
    status = F.when(F.size("matched") > 0, "poisoned").when(pinned.isNotNull() & ~pinned.eqNullSafe(F.col("schema_hash")), "drift").otherwise("ok")
    return df.withColumn("status", status).drop("_pinned")
