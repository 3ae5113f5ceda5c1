"""Redaction of evidence: sensitive keys, long strings, deep nesting. Driven by the schema, so that Catalyst sees plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACEHOLDER = "[REDACTED]"
LONGEST, DEEPEST = 4096, 8
PARTS = ("secret", "token", "password", "apikey", "api_key", "authorization")
EXACT = tuple("api-key auth access_token refresh_token passwd private_key ssh_key cookie session sessionid session_id card_number credit_card social_security ssn x_api_key x-api-key".split())


def clip(c: Column) -> Column:
    return F.when(F.length(c) > LONGEST, F.concat(F.substring(c, 1, LONGEST - 3), F.lit("..."))).otherwise(c)


def is_sensitive(key: str) -> bool:
    low = key.lower()
    return low in EXACT or any(p in low for p in PARTS)


def sensitive(key: Column) -> Column:
    low = F.lower(key)
    return low.isin(*EXACT) | low.rlike("|".join(PARTS))


def redact(c: Column, kind: T.DataType, depth: int = 0) -> Column:
    """The column with what is sensitive replaced; a container beyond the deepest level becomes the placeholder's null of its type."""
    if isinstance(kind, T.StringType):
        return F.lit(PLACEHOLDER) if depth > DEEPEST else clip(c)
    if depth > DEEPEST:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        hidden = lambda f: F.lit(PLACEHOLDER) if isinstance(f.dataType, T.StringType) else F.lit(None).cast(f.dataType)
        return F.when(c.isNotNull(), F.struct(*((F.when(c[f.name].isNotNull(), hidden(f)) if is_sensitive(f.name) else redact(c[f.name], f.dataType, depth + 1)).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: redact(x, kind.elementType, depth + 1))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        hide = F.lit(PLACEHOLDER) if isinstance(kind.valueType, T.StringType) else F.lit(None).cast(kind.valueType)
        return F.transform_values(c, lambda k, v: F.when(sensitive(k), hide).otherwise(redact(v, kind.valueType, depth + 1)))
    return c


def redact_json(value, depth: int = 0):
    """The same for a parsed document without a schema; for use in a pandas UDF."""
    if depth > DEEPEST:
        return PLACEHOLDER
    if isinstance(value, dict):
        return {k: PLACEHOLDER if isinstance(k, str) and is_sensitive(k) else redact_json(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [redact_json(v, depth + 1) for v in value]
    return value[: LONGEST - 3] + "..." if isinstance(value, str) and len(value) > LONGEST else value
