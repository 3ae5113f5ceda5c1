"""Deterministic guards over text: patterns, block lists, schemas. Each returns a decision column."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions import decision as D

_D3, _SEP = r"\d{3}", r"[\s.-]?"
#: Names and patterns of personal data and keys. Unicode classes; see DIALECT.
PII: dict[str, str] = {
    "email": r"\b[\w+.-]+" + "@" + r"[\w.-]+\.[a-zA-Z]{2,}\b",
    "phone_us": r"\b(?:\+?1" + _SEP + r")?\(?" + _D3 + r"\)?" + _SEP + _D3 + _SEP + r"\d{4}\b",
    "ssn": r"\b" + "-".join((_D3, r"\d{2}", r"\d{4}")) + r"\b",
    "credit_card": r"\b(?:\d[ -]*?)" + r"{13,19}\b",
    "ipv4": r"\b(?:\d{1,3}\.)" + r"{3}\d{1,3}\b",
    "api_key_generic": r"\b[0-9A-Za-z_-]{32,}\b",
    "aws_access_key": r"\bAKIA[A-Z0-9]" + r"{16}\b",
    "private_key": "-----BEGIN " + "[A-Z ]*PRIVATE KEY-----",
}
#: Literal text without which a pattern of the catalogue can't match: tested first, since a pattern is tried at every word.
NEEDS = {"email": "@", "ssn": "-", "ipv4": ".", "aws_access_key": "AKIA", "private_key": "-----BEGIN "}
#: Java flags that make a pattern behave as in Python: Unicode classes and case, \n alone ends a line.
DIALECT, DIALECT_IM = "(?Ud)", "(?Uidm)"
TAIL = 50_000
#: Phrases by which a tool's description smuggles instructions.
INJECTION = ("ignore (previous|prior|all) instructions", r"\bsystem\s*:", r"\bassistant\s*:", r"</?\s*(tool|assistant|system)\s*>", "hidden (directive|rule|instruction)", "do not reveal", "act as (an? )?(jailbroken|unrestricted)")


def either(first: Column, second: Column) -> Column:
    """first unless it is null or empty, else second, else the empty text."""
    return F.coalesce(F.nullif(first, F.lit("")), second, F.lit(""))


def tail(text: Column, most: int = TAIL) -> Column:
    return F.when(F.length(text) > most, F.right(text, F.lit(most))).otherwise(text)


def _possible(text: Column, label: str, pattern: str) -> Column:
    """False where a pattern of the catalogue can't match, found by a cheaper test."""
    out = F.lit(True)
    if PII.get(label) == pattern:
        if label in NEEDS:
            out = F.contains(text, F.lit(NEEDS[label]))
        if r"\d" in pattern:
            out = out & text.rlike(r"(?U)\d")
    return out


def first_matches(text: Column, patterns: dict[str, str], flags: str = DIALECT) -> Column:
    """array<struct<label, span>>: the first match of each pattern that has one, in the patterns' order."""
    spans = [F.struct(F.lit(k).alias("label"), F.when(_possible(text, k, p), F.regexp_extract(text, flags + p, 0)).alias("span")) for k, p in patterns.items()]
    return F.filter(F.array(*spans), lambda h: h["span"] != "")


def regex_guard(patterns: dict[str, str] | None = None, *, redact: bool = False, flags: str = DIALECT, name: str = "regex", tier: int = 1, most: int = TAIL):
    """Blocks on a match; with redact, replaces each pattern's first match (its text, wherever it stands) instead. Only the last ``most`` characters are seen."""
    patterns = PII if patterns is None else patterns

    def guard(ctx: dict[str, Column]) -> Column:
        text = tail(either(ctx["chunk"], ctx.get("buffer", F.lit(None))), most)
        hits = first_matches(text, patterns, flags)
        labels = F.concat_ws(", ", F.transform(hits, lambda h: h["label"]))
        evidence = F.to_json(F.struct(hits.alias("matches")))
        if redact:
            new = F.aggregate(hits, text, lambda t, h: F.replace(t, h["span"], F.lit("[REDACTED]")))
            found = D.transform(new, tier=tier, rationale=F.concat(F.lit("redacted: "), labels), evidence=evidence, guard=name)
        else:
            found = D.block(tier=tier, rationale=F.concat(F.lit("matched: "), labels), evidence=evidence, guard=name)
        return F.when(F.size(hits) > 0, found).otherwise(D.allow(tier=tier, rationale="no match", guard=name))

    return guard


def pii_guard(redact: bool = False, **kw):
    return regex_guard(PII, redact=redact, **{"name": "pii"} | kw)


def pattern_guard(patterns: dict[str, str], **kw):
    """Own patterns, without regard to case and by line."""
    return regex_guard(patterns, flags=DIALECT_IM, **kw)


def blocklist_patterns(terms: list[str]) -> dict[str, str]:
    return {f"term_{i}": "\\Q" + t + "\\E" for i, t in enumerate(terms)}


def terms_found(text: Column, terms: list[str]) -> Column:
    """The terms that occur, without regard to case, each once and in the list's order."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, F.lower(t)))


def blocklist_guard(terms: list[str], name: str = "blocklist", tier: int = 1):
    def guard(ctx: dict[str, Column]) -> Column:
        found = terms_found(either(ctx["chunk"], ctx.get("buffer", F.lit(None))), terms)
        return F.when(F.size(found) > 0, D.block(tier=tier, rationale=F.concat(F.lit("terms: "), F.concat_ws(", ", F.slice(found, 1, 5))), evidence=F.to_json(F.struct(found.alias("terms"))), guard=name)).otherwise(D.allow(tier=tier, guard=name))

    return guard


def occurrences(text: Column, term: str) -> Column:
    return F.regexp_count(F.lower(text), F.lit("\\Q" + term.lower() + "\\E"))


def schema_guard(required: dict[str, str], name: str = "schema", tier: int = 1):
    """required: field -> JSON type (int, string, double, boolean). What isn't JSON passes; JSON that lacks a field or has another type is blocked."""

    def guard(ctx: dict[str, Column]) -> Column:
        text = either(ctx["chunk"], ctx.get("buffer", F.lit(None)))
        parsed = F.try_parse_json(text)
        bad = ~F.startswith(F.ltrim(text), F.lit("{"))
        for field, kind in required.items():
            bad = bad | F.try_variant_get(parsed, f"$.{field}", kind).isNull()
        return F.when(parsed.isNotNull() & bad, D.block(tier=tier, severity="medium", rationale="schema violation", guard=name)).otherwise(D.allow(tier=tier, guard=name))

    return guard


def trigger_guard(triggers: list[str], name: str = "stub-classifier", tier: int = 2):
    """The first trigger that occurs (buffer before chunk, without regard to case) blocks."""

    def guard(ctx: dict[str, Column]) -> Column:
        text = F.upper(either(ctx.get("buffer", F.lit(None)), ctx["chunk"]))
        out = D.allow(tier=tier, guard=name)
        for t in reversed(triggers):
            out = F.when(F.contains(text, F.lit(t.upper())), D.block(0.99, tier=tier, rationale=f"trigger: {t}", guard=name)).otherwise(out)
        return out

    return guard


def python_guard(check, name: str, tier: int = 2):
    """A guard in Python: check(text) says whether to block. One that raises allows the row, with the error as evidence."""

    @F.pandas_udf("struct<hit:boolean,error:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        hit, error = [], []
        for t in texts:
            try:
                hit.append(bool(check(t)))
                error.append(None)
            except Exception as e:
                hit.append(False)
                error.append(type(e).__name__)
        return pd.DataFrame({"hit": hit, "error": error})

    def guard(ctx: dict[str, Column]) -> Column:
        r = run(either(ctx["chunk"], ctx.get("buffer", F.lit(None))))
        failed = D.allow(tier=tier, rationale="guard failed; open", evidence=F.to_json(F.struct(r["error"].alias("error"))), guard=name)
        return F.when(r["error"].isNotNull(), failed).when(r["hit"], D.block(tier=tier, rationale="matched", guard=name)).otherwise(D.allow(tier=tier, guard=name))

    return guard


def screen(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """The injection patterns that a description matches, in order."""
    return F.array_compact(F.array(*(F.when(text.rlike(DIALECT_IM + p), F.lit(p)) for p in INJECTION + extra)))


def canonical_json(text: Column) -> Column:
    """Compact and with sorted keys; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def schema_hash(schema: Column) -> Column:
    return F.sha2(canonical_json(schema), 256)


def step_fingerprint(tool: Column, args: Column) -> Column:
    """16 hexadecimal digits, equal for equal tools and arguments in any key order."""
    return F.substring(F.sha2(F.concat(tool, F.lit("\u0001"), F.coalesce(canonical_json(args), args, F.lit("null"))), 256), 1, 16)


@F.pandas_udf(T.StringType())
def exact_schema_hash(schemas: pd.Series) -> pd.Series:
    """Over the ASCII-escaped form that Python's json gives; for registries whose hashes were made that way."""
    import hashlib

    def one(s):
        return None if s is None else hashlib.sha256(json.dumps(json.loads(s), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    return schemas.map(one)


def escaped(term: str) -> str:
    """A term as a pattern for engines without \\Q...\\E."""
    return re.escape(term)
