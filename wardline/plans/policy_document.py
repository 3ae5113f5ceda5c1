"""Ordered policy rules: the first that matches decides. Selectors compile to expressions that never fail."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.text import DIALECT_IM

Selector = Callable[[dict[str, Column]], Column]


def selector(spec: dict, kinds: dict[str, T.DataType] | None = None) -> Selector:
    """pattern over contains over equals over not_empty; anything else never matches. A field that is absent counts as null."""
    name, kinds = spec.get("field", "content"), kinds or {}

    def build(ctx: dict[str, Column]) -> Column:
        c = ctx.get(name, F.lit(None).cast("string"))
        textual = isinstance(kinds.get(name, T.StringType()), T.StringType)
        if spec.get("pattern") is not None:
            return F.coalesce(c.rlike(DIALECT_IM + spec["pattern"]), F.lit(False)) if textual else F.lit(False)
        if spec.get("contains") is not None:
            needles = [spec["contains"]] if isinstance(spec["contains"], str) else spec["contains"]
            out = F.lit(False)
            for n in needles if textual else []:
                out = out | F.contains(F.lower(c), F.lit(n.lower()))
            return F.coalesce(out, F.lit(False))
        if "equals" in spec:
            return c.eqNullSafe(F.lit(spec["equals"]))
        if spec.get("not_empty"):
            empty = (c == "") if textual else (F.size(c) <= 0) if isinstance(kinds.get(name), T.ArrayType | T.MapType) else F.lit(False)
            return c.isNotNull() & ~F.coalesce(empty, F.lit(False))
        return F.lit(False)

    return build


@dataclass
class Rule:
    id: str
    when: Selector
    decision: str
    rationale: str = ""
    severity: str = "medium"
    metadata: dict = field(default_factory=dict)


@dataclass
class PolicyDocument:
    name: str
    version: str = "0.0.1"
    rules: list[Rule] = field(default_factory=list)

    def add(self, rule: Rule) -> PolicyDocument:
        self.rules.append(rule)
        return self

    @classmethod
    def from_dict(cls, doc: dict, kinds: dict[str, T.DataType] | None = None) -> PolicyDocument:
        rules = [Rule(str(r["id"]), selector(r, kinds), r["decision"], r.get("rationale", ""), r.get("severity", "medium"), r.get("metadata", {})) for r in doc.get("rules", [])]
        return cls(doc.get("name", ""), str(doc.get("version", "0.0.1")), rules)

    @classmethod
    def from_yaml(cls, text: str, kinds: dict[str, T.DataType] | None = None) -> PolicyDocument:
        import yaml

        return cls.from_dict(yaml.safe_load(text) or {}, kinds)

    def evaluate(self, ctx: dict[str, Column]) -> Column:
        """struct<rule, decision, rationale, severity> of the first match, or null."""
        if not self.rules:
            return F.lit(None).cast("struct<rule:string,decision:string,rationale:string,severity:string>")
        found = [F.when(F.coalesce(r.when(ctx), F.lit(False)), F.struct(*(F.lit(v).alias(k) for k, v in (("rule", r.id), ("decision", r.decision), ("rationale", r.rationale), ("severity", r.severity))))) for r in self.rules]
        return F.coalesce(*found)
