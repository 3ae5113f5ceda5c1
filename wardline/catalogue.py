"""Every query of the guardrail engine, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions import decision as D
from wardline.functions import redaction, text
from wardline.operators import flow, governance, mining, ordered, scorers
from wardline.operators.cascade import GuardPipeline
from wardline.plans.policy_document import PolicyDocument

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TERMS = ["token", "worthless", "pathetic", "license"]
PHRASES = {"gnu": r"gnu\s+general", "mit": r"^released under the mit"}
TRIGGERS = ["worthless", "idiot", "token"]
RULES = {
    "name": "content",
    "rules": [
        {"id": "long-key", "pattern": r"[0-9a-f]{32}", "decision": "block", "rationale": "looks like a key", "severity": "high"},
        {"id": "insult", "contains": ["idiot", "moron"], "decision": "escalate", "rationale": "insult"},
        {"id": "german", "field": "lang", "equals": "de", "decision": "transform", "rationale": "translate"},
        {"id": "any", "not_empty": True, "decision": "allow", "rationale": "has text", "severity": "info"},
    ],
}
PROGRESS = ordered.Progress()
LIMIT = 2000.0
PROBE = [round(((i * 37) % 64 - 31.5) / 16, 4) for i in range(64)]


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ctx(chunk: str = "text", buffer: str | None = None) -> dict:
    return {"chunk": F.col(chunk), "buffer": F.col(buffer) if buffer else F.lit(None).cast("string"), "content": F.col(chunk)}


# ---- text guards ------------------------------------------------------------------------------

_T = "CASE WHEN length(coalesce(text, '')) > 50000 THEN right(text, 50000) ELSE coalesce(text, '') END"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hits(col: str = "t") -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({col}, {q(p)}) THEN {q(k)} END" for k, p in text.PII.items()) + "], lambda x: x IS NOT NULL)"


@query("pii_block_summary", f"SELECT CASE WHEN len({_hits()}) > 0 THEN 'block' ELSE 'allow' END AS action, count(*) AS n FROM (SELECT {_T} AS t FROM documents) GROUP BY 1")
def pii_block_summary(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(text.pii_guard()(ctx())["action"].alias("action"))
    return d.groupBy("action").agg(F.count("*").alias("n"))


@query("pii_hits_by_pattern", f"SELECT label, count(*) AS n FROM (SELECT unnest({_hits()}) AS label FROM (SELECT {_T} AS t FROM documents)) GROUP BY label")
def pii_hits_by_pattern(spark, sf_dir):
    hits = text.first_matches(text.tail(F.coalesce("text", F.lit(""))), text.PII)
    return read(spark, sf_dir, "documents").select(F.explode(hits).alias("h")).groupBy(F.col("h.label").alias("label")).agg(F.count("*").alias("n"))


@query("pii_first_match", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, regexp_extract(t, {q(p)}) AS span FROM (SELECT doc_id, {_T} AS t FROM documents) WHERE regexp_matches(t, {q(p)})" for k, p in text.PII.items()))
def pii_first_match(spark, sf_dir):
    hits = text.first_matches(text.tail(F.coalesce("text", F.lit(""))), text.PII)
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.label", "h.span")


@query("pii_redact")
def pii_redact(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text.pii_guard(redact=True)(ctx()).alias("d"))
    return d.select("doc_id", F.col("d.action").alias("action"), F.md5(D.render(F.col("d"), text.tail(F.col("text")))).alias("digest"))


def _nested_redaction() -> str:
    """Replacement after replacement, one subquery each, so that the SQL stays linear in the patterns."""
    src = f"SELECT doc_id, {_T} AS t, {_T} AS n FROM documents"
    for p in text.PII.values():
        src = f"SELECT doc_id, t, CASE WHEN regexp_matches(t, {q(p)}) THEN replace(n, regexp_extract(t, {q(p)}), '[REDACTED]') ELSE n END AS n FROM ({src})"
    return f"SELECT doc_id, CASE WHEN len({_hits()}) > 0 THEN 'transform' ELSE 'allow' END AS action, md5(n) AS digest FROM ({src})"


SQL["pii_redact"] = _nested_redaction()


@query("blocklist_hits", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN '{t}' END" for t in TERMS) + "], lambda x: x IS NOT NULL), ',') AS terms FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{t}')" for t in TERMS))
def blocklist_hits(spark, sf_dir):
    found = text.terms_found(F.col("text"), TERMS)
    return read(spark, sf_dir, "documents").where(F.size(found) > 0).select("doc_id", F.array_join(found, ",").alias("terms"))


@query("blocklist_regex", "SELECT label, count(*) AS n FROM (SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){t}') THEN 'term_{i}' END" for i, t in enumerate(TERMS)) + "], lambda x: x IS NOT NULL)) AS label FROM documents) GROUP BY label")
def blocklist_regex(spark, sf_dir):
    hits = text.first_matches(F.col("text"), text.blocklist_patterns(TERMS), text.DIALECT_IM)
    return read(spark, sf_dir, "documents").select(F.explode(hits).alias("h")).groupBy(F.col("h.label").alias("label")).agg(F.count("*").alias("n"))


@query("blocklist_occurrences", "SELECT doc_id, len(regexp_extract_all(lower(text), 'token')) AS n FROM documents WHERE contains(lower(text), 'token')")
def blocklist_occurrences(spark, sf_dir):
    n = text.occurrences(F.col("text"), "token").cast("long")
    return read(spark, sf_dir, "documents").where(n > 0).select("doc_id", n.alias("n"))


@query("pattern_guard", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {q('(?im)' + p)}) THEN '{k}' END" for k, p in PHRASES.items()) + "], lambda x: x IS NOT NULL), ', ') AS labels FROM documents WHERE " + " OR ".join(f"regexp_matches(text, {q('(?im)' + p)})" for p in PHRASES.values()))
def pattern_guard(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", text.pattern_guard(PHRASES)(ctx()).alias("d")).where(D.blocked(F.col("d")))
    return d.select("doc_id", F.regexp_replace("d.rationale", "^matched: ", "").alias("labels"))


@query("schema_guard_props", "SELECT event_type, count(*) FILTER (WHERE json_valid(props) AND coalesce(json_type(props, '$.k') NOT IN ('UBIGINT', 'BIGINT'), true)) AS blocked, count(*) AS n FROM events GROUP BY event_type")
def schema_guard_props(spark, sf_dir):
    d = text.schema_guard({"k": "int"})(ctx("props"))
    return read(spark, sf_dir, "events").select("event_type", d.alias("d")).groupBy("event_type").agg(F.count_if(D.blocked(F.col("d"))).alias("blocked"), F.count("*").alias("n"))


_TRIG = "CASE " + " ".join(f"WHEN contains(upper(text), '{t.upper()}') THEN '{t}'" for t in TRIGGERS) + " END"


@query("stub_classifier", f"SELECT conv_id, turn, CASE WHEN {_TRIG} IS NULL THEN 'allow' ELSE 'block' END AS action, CASE WHEN {_TRIG} IS NULL THEN 1.0 ELSE 0.99 END::DOUBLE AS confidence FROM conversations")
def stub_classifier(spark, sf_dir):
    d = read(spark, sf_dir, "conversations").select("conv_id", "turn", text.trigger_guard(TRIGGERS)(ctx()).alias("d"))
    return d.select("conv_id", "turn", "d.action", "d.confidence")


@query("policy_first_match", """SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)[0-9a-f]{32}') THEN 'long-key' WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'moron') THEN 'insult'
WHEN lang IS NOT DISTINCT FROM 'de' THEN 'german' WHEN text IS NOT NULL AND text <> '' THEN 'any' END AS rule FROM documents""")
def policy_first_match(spark, sf_dir):
    found = PolicyDocument.from_dict(RULES).evaluate(ctx() | {"lang": F.col("lang")})
    return read(spark, sf_dir, "documents").select("doc_id", found.alias("f")).select("doc_id", F.col("f.rule").alias("rule"))


@query("redact_props", "SELECT event_id, CASE WHEN event_type IS NULL THEN NULL ELSE '[REDACTED]' END AS access_token, event_type AS kind, props AS secret_free FROM events".replace("props AS secret_free", "'[REDACTED]' AS secret_free"))
def redact_props(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.struct(F.col("event_type").alias("access_token"), F.col("event_type").alias("kind"), F.coalesce("props", F.lit("")).alias("secret_free")).alias("s"))
    return e.select("event_id", redaction.redact(F.col("s"), e.schema["s"].dataType).alias("s")).select("event_id", "s.*")


@query("truncate_long_text", "SELECT doc_id, md5(CASE WHEN length(text) > 4096 THEN substr(text, 1, 4093) || '...' ELSE text END) AS digest FROM documents")
def truncate_long_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(redaction.clip(F.col("text"))).alias("digest"))


@query("telemetry_attributes", "SELECT doc_id, count(*) AS n_attributes FROM (SELECT doc_id, unnest(CASE WHEN " + _TRIG.replace("upper(text)", "upper(coalesce(text, ''))") + " IS NULL THEN range(7) ELSE range(8) END) FROM documents) GROUP BY doc_id")
def telemetry_attributes(spark, sf_dir):
    d = D.attributes(text.trigger_guard(TRIGGERS)(ctx()))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(d).cast("long").alias("n_attributes"))


_SCREEN = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(html, {q('(?im)' + p)}) THEN {q(p)} END" for p in text.INJECTION) + "], lambda x: x IS NOT NULL)"


@query("screen_descriptions", f"SELECT page_id, len({_SCREEN}) AS n_patterns, array_to_string({_SCREEN}, ' ; ') AS patterns FROM pages")
def screen_descriptions(spark, sf_dir):
    m = text.screen(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.size(m).cast("long").alias("n_patterns"), F.array_join(m, " ; ").alias("patterns"))


@query("manifest_drift", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'drift' ELSE 'ok' END AS status FROM events")
def manifest_drift(spark, sf_dir):
    """Registered schemas are the events' props; the manifest pins another schema for every third."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("name"), F.lit("lists items").alias("description"), F.col("props").alias("schema"), "event_id")
    pinned = e.select("name", F.when(F.col("event_id") % 3 == 0, "0").otherwise(F.sha2(F.regexp_replace("schema", " ", ""), 256)).alias("schema_hash"))
    return flow.registry_status(e, pinned).select("event_id", "status")


# ---- cascade ----------------------------------------------------------------------------------

_PII_ANY = " OR ".join(f"regexp_matches(coalesce(text, ''), {q(p)})" for p in text.PII.values())


@query("tier_reduce", f"SELECT doc_id, CASE WHEN {_PII_ANY} THEN 'pii' WHEN contains(lower(text), 'license') THEN 'blocklist' ELSE 'pii' END AS winner FROM documents")
def tier_reduce(spark, sf_dir):
    p = GuardPipeline(tier1=[text.pii_guard(), text.blocklist_guard(["license"])])
    return p.apply(read(spark, sf_dir, "documents"), "text").select("doc_id", F.col("decision.guard_name").alias("winner"))


_TRIG_B = "CASE " + " ".join(f"WHEN contains(upper(text), '{t.upper()}') THEN '{t}'" for t in TRIGGERS) + " END"


@query("cascade_two_tier", f"SELECT action, tier, count(*) AS n FROM (SELECT CASE WHEN {_TRIG_B} IS NOT NULL THEN 'block' ELSE 'allow' END AS action, 2 AS tier FROM documents) GROUP BY 1, 2")
def cascade_two_tier(spark, sf_dir):
    """Tier 1 redacts, which doesn't end the cascade: what tier 2 says replaces it."""
    p = GuardPipeline(tier1=[text.pii_guard(redact=True)], tier2=[text.trigger_guard(TRIGGERS)])
    d = p.apply(read(spark, sf_dir, "documents"), "text").select("decision.action", "decision.tier")
    return d.groupBy("action", "tier").agg(F.count("*").alias("n"))


def _length_guard(tier: int):
    def guard(c):
        p = F.least(F.lit(1.0), F.length(c["chunk"]) / 4000.0)
        return scorers.threshold_decision(p, 0.9, tier=tier, name=f"length-{tier}")

    return guard


_P = "least(1.0, length(text) / 4000.0)"


@query("cascade_band", f"""SELECT action, tier, count(*) AS n FROM (SELECT CASE WHEN {_PII_ANY} THEN 'block' WHEN p >= 0.9 THEN 'block' WHEN 1 - p BETWEEN 0.3 AND 0.7 AND {_TRIG_B} IS NOT NULL THEN 'block' ELSE 'allow' END AS action,
CASE WHEN {_PII_ANY} THEN 1 WHEN p >= 0.9 THEN 2 WHEN 1 - p BETWEEN 0.3 AND 0.7 THEN 3 ELSE 2 END AS tier FROM (SELECT text, {_P} AS p FROM documents)) GROUP BY 1, 2""")
def cascade_band(spark, sf_dir):
    p = GuardPipeline(tier1=[text.pii_guard()], tier2=[_length_guard(2)], tier3=[text.trigger_guard(TRIGGERS, tier=3)])
    d = p.apply(read(spark, sf_dir, "documents"), "text").select("decision.action", "decision.tier")
    return d.groupBy("action", "tier").agg(F.count("*").alias("n"))


@query("budget_fail_open", f"""SELECT rationale, action, count(*) AS n FROM (SELECT CASE WHEN {_PII_ANY} THEN 'block' WHEN doc_id % 200 > 80 THEN 'allow' WHEN {_TRIG_B} IS NOT NULL THEN 'block' ELSE 'allow' END AS action,
CASE WHEN {_PII_ANY} THEN 'hit' WHEN doc_id % 200 > 80 THEN 'budget' WHEN {_TRIG_B} IS NOT NULL THEN 'trigger' ELSE 'passed' END AS rationale FROM documents) GROUP BY 1, 2""")
def budget_fail_open(spark, sf_dir):
    p = GuardPipeline(tier1=[text.pii_guard()], tier2=[text.trigger_guard(TRIGGERS)])
    d = p.apply(read(spark, sf_dir, "documents"), "text", name="d", t1_ms=F.pmod("doc_id", F.lit(200)))
    r = F.col("d.rationale")
    short = F.when(r.startswith("matched"), "hit").when(r.startswith("latency"), "budget").when(r.startswith("trigger"), "trigger").otherwise("passed")
    return d.groupBy(short.alias("rationale"), F.col("d.action").alias("action")).agg(F.count("*").alias("n"))


_GS = f"""SELECT conv_id, turn, t, CASE WHEN {" OR ".join(f"contains(upper(b), '{t.upper()}')" for t in TRIGGERS)} THEN 1 ELSE 0 END AS bad FROM
(SELECT conv_id, turn, coalesce(text, '') AS t, string_agg(coalesce(text, ''), '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS b FROM conversations)"""
_GS2 = f"SELECT * FROM (SELECT *, coalesce(max(bad) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM ({_GS})) WHERE done = 0"


@query("guard_stream_batch", f"SELECT conv_id, turn, CASE WHEN bad = 1 THEN 'block' ELSE 'allow' END AS action FROM ({_GS2})")
def guard_stream_batch(spark, sf_dir):
    p = GuardPipeline(tier2=[text.trigger_guard(TRIGGERS)])
    return p.guard_stream(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "decision.action")


@query("render_output", f"SELECT conv_id, turn, md5(CASE WHEN bad = 1 THEN {q(D.FALLBACK)} ELSE t END) AS digest FROM ({_GS2})")
def render_output(spark, sf_dir):
    p = GuardPipeline(tier2=[text.trigger_guard(TRIGGERS)])
    return p.guard_stream(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.md5("emitted").alias("digest"))


# ---- information flow -------------------------------------------------------------------------

_SRC = {"click": ("web", 1, ["read.public"]), "purchase": ("crm", 0, ["read.private", "write.external"]), "view": ("web", 1, []), "login": ("idp", 0, ["read.secrets"])}


def _args(spark, sf_dir) -> DataFrame:
    """Calls are users' days; every event is an argument whose source, capabilities and integrity follow its type and value."""
    e = read(spark, sf_dir, "events")
    kind = F.pmod("event_id", F.lit(4))
    return e.select("user_id", "event_id", "event_type", F.concat(F.lit("src"), kind.cast("string")).alias("source"), F.array(F.concat(F.lit("src"), kind.cast("string"))).alias("provenance"), F.when(kind == 0, F.array(F.lit("read.secrets"))).when(kind == 1, F.array(F.lit("read.public"), F.lit("write.external"))).otherwise(F.array().cast("array<string>")).alias("capabilities"), F.when(F.col("value") > 100, 2).when(F.col("value") > 20, 1).otherwise(0).alias("integrity"), "value")


_ARGS = """(SELECT user_id, event_id, event_type, 'src' || (event_id % 4) AS source, CASE event_id % 4 WHEN 0 THEN ['read.secrets'] WHEN 1 THEN ['read.public', 'write.external'] ELSE [] END AS caps,
CASE WHEN value > 100 THEN 2 WHEN value > 20 THEN 1 ELSE 0 END AS integrity, value FROM events)"""


@query("label_join", f"SELECT user_id, event_type, array_to_string(list_sort(list_distinct(list(source))), ',') AS provenance, array_to_string(list_sort(list_distinct(flatten(list(caps)))), ',') AS capabilities, max(integrity) AS integrity FROM {_ARGS} GROUP BY user_id, event_type")
def label_join(spark, sf_dir):
    j = flow.join_all(_args(spark, sf_dir), "user_id", "event_type")
    return j.select("user_id", "event_type", F.array_join("provenance", ",").alias("provenance"), F.array_join("capabilities", ",").alias("capabilities"), "integrity")


def _policy(mode: str = "strict") -> flow.Policy:
    p = flow.Policy("events").require("click", "UNTRUSTED", ("read.public", "write.external", "read.secrets"), "UNTRUSTED").require("purchase", "TRUSTED", ("read.public", "write.external")).secure_tool("view", "UNTRUSTED")
    return p.deny_if("login", lambda c: F.array_contains(c["provenance"], "src0"), "secrets at login").deny_if(None, lambda c: F.size(c["provenance"]) > 3, "too many sources").with_mode(mode)


def _calls(spark, sf_dir) -> DataFrame:
    a = _args(spark, sf_dir).withColumn("call_id", F.floor(F.col("event_id") / 3).cast("long"))
    return flow.join_all(a, "call_id", tool=F.min_by("event_type", "event_id")).withColumn("cfi", F.pmod(F.col("call_id"), F.lit(3)).cast("int"))


_AUTH = f"""WITH a AS (SELECT *, event_id // 3 AS call_id FROM {_ARGS}),
c AS (SELECT call_id, min_by(event_type, event_id) AS tool, (call_id % 3)::INT AS cfi, list_sort(list_distinct(list(source))) AS prov, list_sort(list_distinct(flatten(list(caps)))) AS caps, max(integrity) AS integrity FROM a GROUP BY call_id),
v AS (SELECT *, CASE WHEN tool = 'click' AND cfi > 1 THEN 'cfi_too_low' WHEN tool = 'purchase' AND cfi > 0 THEN 'cfi_too_low' WHEN tool = 'click' AND integrity > 1 THEN 'arg_integrity_too_low'
WHEN tool = 'purchase' AND list_contains(caps, 'read.secrets') THEN 'forbidden_caps' WHEN tool = 'view' AND integrity > 1 THEN 'tool_integrity_too_low'
WHEN tool = 'login' AND list_contains(prov, 'src0') THEN 'deny_rule' WHEN len(prov) > 3 THEN 'deny_rule' END AS reason_code FROM c)"""


@query("authorize_calls", _AUTH + " SELECT call_id, tool, reason_code IS NULL AS allowed, reason_code FROM v")
def authorize_calls(spark, sf_dir):
    return flow.authorize(_calls(spark, sf_dir), _policy()).select("call_id", "tool", "allowed", "reason_code")


@query("authorize_mediated", _AUTH + " SELECT call_id, reason_code IS NULL OR call_id % 5 = 0 AS allowed, reason_code IS NOT NULL AND call_id % 5 = 0 AS mediated FROM v")
def authorize_mediated(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    approvals = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).cast("long").alias("call_id")).where("call_id % 5 = 0").distinct()
    return flow.authorize(calls, _policy("mediated"), approvals).select("call_id", "allowed", "mediated")


@query("deny_reasons", _AUTH + " SELECT tool, coalesce(reason_code, 'allow') AS reason_code, count(*) AS n FROM v GROUP BY 1, 2")
def deny_reasons(spark, sf_dir):
    v = flow.authorize(_calls(spark, sf_dir), _policy())
    return v.groupBy("tool", F.coalesce("reason_code", F.lit("allow")).alias("reason_code")).agg(F.count("*").alias("n"))


@query("lift_args", "SELECT event_id, CASE WHEN props IS NULL THEN '' ELSE 'llm.output' END AS provenance, CASE WHEN props IS NULL THEN 0 ELSE 1 END AS integrity FROM events")
def lift_args(spark, sf_dir):
    return flow.lift_args(read(spark, sf_dir, "events"), "props").select("event_id", F.array_join("provenance", ",").alias("provenance"), "integrity")


@query("taint_trail", "SELECT user_id, string_agg(event_type || '>' || event_id, ' ' ORDER BY ts, event_id) AS trail FROM events GROUP BY user_id")
def taint_trail(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("src"), F.lit("observe").alias("op"), F.col("event_id").cast("string").alias("dst"))
    t = flow.taint_trail(e, "user_id", "seq")
    return t.select("user_id", F.array_join(F.transform("trail", lambda x: F.concat(x["src"], F.lit(">"), x["dst"])), " ").alias("trail"))


# ---- budgets and loops ------------------------------------------------------------------------

_RUN = "SELECT event_id, user_id, ts, value, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events"


def _budget(spark, sf_dir) -> DataFrame:
    return ordered.running(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value"), LIMIT)


@query("budget_running", f"SELECT event_id, round(used, 4) AS used, round(greatest(0, {LIMIT} - used), 4) AS remaining FROM ({_RUN})")
def budget_running(spark, sf_dir):
    return _budget(spark, sf_dir).select("event_id", F.round("used", 4).alias("used"), F.round("remaining", 4).alias("remaining"))


@query("budget_exceeded", f"SELECT user_id, count(*) AS n FROM ({_RUN}) WHERE used > {LIMIT} GROUP BY user_id")
def budget_exceeded(spark, sf_dir):
    return _budget(spark, sf_dir).where("exceeded").groupBy("user_id").agg(F.count("*").alias("n"))


@query("budget_checkpoints", f"""SELECT event_id, user_id, c AS checkpoint FROM (SELECT event_id, user_id, floor(used / {LIMIT} * 100) AS pct, coalesce(lag(floor(used / {LIMIT} * 100)) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS prev FROM ({_RUN})), (SELECT unnest([25, 50, 75, 100]) AS c) WHERE pct >= c AND prev < c""")
def budget_checkpoints(spark, sf_dir):
    return _budget(spark, sf_dir).select("event_id", "user_id", F.explode("checkpoints").alias("checkpoint"))


@query("wallclock", "SELECT event_id, epoch(ts) - epoch(first_value(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 86400 * 7 AS exceeded FROM events")
def wallclock(spark, sf_dir):
    return ordered.wall_clock(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "ts", 86400 * 7).select("event_id", "exceeded")


@query("composite_budgets", f"""SELECT user_id, budget, round(used, 4) AS used, used > lim AS exceeded FROM (SELECT user_id, sum(value) AS used, {LIMIT} AS lim, 'dollar' AS budget FROM events GROUP BY user_id UNION ALL SELECT user_id, count(*)::DOUBLE, 60.0, 'iteration' FROM events GROUP BY user_id)""")
def composite_budgets(spark, sf_dir):
    c = ordered.composite(read(spark, sf_dir, "events"), ["user_id"], {"dollar": (F.col("value"), LIMIT), "iteration": (F.lit(1), 60.0)})
    return c.select("user_id", "budget", F.round("used", 4).alias("used"), "exceeded")


_W = "(PARTITION BY user_id ORDER BY ts, event_id ROWS {} PRECEDING)"
_LAG = lambda i: f"lag(event_type, {i}) OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_CYC = f"CASE WHEN event_type = {_LAG(2)} AND {_LAG(1)} = {_LAG(3)} THEN 2 WHEN event_type = {_LAG(3)} AND {_LAG(1)} = {_LAG(4)} AND {_LAG(2)} = {_LAG(5)} THEN 3 END"
_DUP = f"list(event_type) OVER {_W.format(11)}"
_STAG = f"count(event_type) OVER {_W.format(3)} = 4 AND min(event_type) OVER {_W.format(3)} = max(event_type) OVER {_W.format(3)}"


def _loops(spark, sf_dir) -> DataFrame:
    return PROGRESS.observe(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"), F.col("event_type"))


@query("loop_duplicate", f"SELECT event_id, len(list_filter(list_distinct(l), lambda x: len(list_filter(l, lambda y: y = x)) >= 3)) > 0 AS duplicate FROM (SELECT event_id, {_DUP} AS l FROM events)")
def loop_duplicate(spark, sf_dir):
    return _loops(spark, sf_dir).select("event_id", F.col("duplicate").isNotNull().alias("duplicate"))


@query("loop_cycle", f"SELECT event_id, {_CYC} AS cycle FROM events")
def loop_cycle(spark, sf_dir):
    return _loops(spark, sf_dir).select("event_id", "cycle")


@query("loop_stagnation", f"SELECT event_id, {_STAG} AS stagnant FROM events")
def loop_stagnation(spark, sf_dir):
    return _loops(spark, sf_dir).select("event_id", "stagnant")


@query("loop_first_reason", f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN len(list_filter(list_distinct(l), lambda x: len(list_filter(l, lambda y: y = x)) >= 3)) > 0 THEN 'duplicate_call' WHEN c IS NOT NULL THEN 'cycle' WHEN s THEN 'stagnation' ELSE 'none' END AS reason FROM (SELECT {_DUP} AS l, {_CYC} AS c, {_STAG} AS s FROM events)) GROUP BY reason")
def loop_first_reason(spark, sf_dir):
    return _loops(spark, sf_dir).groupBy(F.coalesce("loop_reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query("semantic_no_progress", """WITH s AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)) AS c FROM embeddings)
SELECT vec_id, coalesce(count(c) OVER w = 3 AND min(round(least(1, greatest(0, c)), 9)) OVER w >= 0.3, false) AS no_progress FROM s WINDOW w AS (PARTITION BY label ORDER BY vec_id ROWS 2 PRECEDING)""")
def semantic_no_progress(spark, sf_dir):
    """Cosine of successive embeddings of a label (they have unit length)."""
    w = Window.partitionBy("label").orderBy("vec_id")
    prev = F.lag("embedding").over(w)
    c = F.aggregate(F.zip_with("embedding", prev, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 9).alias("c"), prev.isNotNull().alias("has"))
    p = ordered.Progress(similarity=0.3)
    return e.select("vec_id", p.no_progress(F.when(F.col("has"), F.col("c")), w).alias("no_progress"))


# ---- failures ---------------------------------------------------------------------------------


def _failed(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("input"), F.lit("").alias("output"), (F.col("toxic") == 1).alias("was_violation"), F.col("lang").alias("attack_category"), "source", F.col("doc_id").alias("idx"))


_FAIL = "(SELECT doc_id AS idx, text AS input, toxic = 1 AS was_violation, lang AS attack_category, source FROM documents JOIN labels USING (doc_id))"
_WORD = r"coalesce(nullif(regexp_extract(lower(input), '[\p{L}\p{N}_]+'), ''), '_')"
_LAB = f"(SELECT *, dense_rank() OVER (ORDER BY f) - 1 AS label FROM (SELECT *, min(idx) OVER (PARTITION BY {_WORD}) AS f FROM {_FAIL}))"


@query("asr_by_source", f"SELECT attack_category, source, count(*) AS n, round(avg(was_violation::INT), 6) AS asr FROM {_FAIL} GROUP BY 1, 2")
def asr_by_source(spark, sf_dir):
    return mining.asr_by(_failed(spark, sf_dir), "attack_category", "source").select("attack_category", "source", "n", F.round("asr", 6).alias("asr"))


@query("failures_normalize", """SELECT coalesce(nullif(event_type, ''), 'x') AS category, lower(event_type) IN ('true', 'violation', 'unsafe', 'fail', '1', 'yes') OR coalesce(TRY_CAST(event_type AS DOUBLE) <> 0, false) AS truthy, count(*) AS n FROM events GROUP BY 1, 2""")
def failures_normalize(spark, sf_dir):
    from wardline.sources import logs

    e = read(spark, sf_dir, "events").select(F.coalesce(logs.first_truthy(F.col("event_type")), F.lit("x")).alias("category"), logs.truthy(F.col("event_type")).alias("truthy"))
    return e.groupBy("category", "truthy").agg(F.count("*").alias("n"))


@query("first_word_clusters", f"SELECT idx, label FROM {_LAB}")
def first_word_clusters(spark, sf_dir):
    return mining.first_word_clusters(_failed(spark, sf_dir)).select("idx", F.col("label").cast("long").alias("label"))


@query("cluster_sizes", f"SELECT label, count(*) AS n, round(avg(was_violation::INT), 6) AS asr, row_number() OVER (ORDER BY count(*) DESC, min(idx)) AS ord FROM {_LAB} GROUP BY label")
def cluster_sizes(spark, sf_dir):
    c = mining.clusters(mining.first_word_clusters(_failed(spark, sf_dir)))
    return c.select(F.col("label").cast("long").alias("label"), "n", F.round("asr", 6).alias("asr"), F.col("ord").cast("long").alias("ord"))


@query("cluster_summary_phrases", rf"""WITH s AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY idx) AS s, regexp_extract_all(lower(substr(input, 1, 300)), '[\p{{L}}\p{{N}}_]+') AS w FROM {_LAB} QUALIFY s <= 8),
g AS (SELECT label, s, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT label, s, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM s, (SELECT unnest([2, 3]) AS n))),
c AS (SELECT label, p, count(*) AS c, min((s, n, i)) AS place FROM g GROUP BY label, p), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY c DESC, place) AS r FROM c QUALIFY r <= 3)
SELECT label, n || ' failures; common phrases: ' || coalesce(top, '') AS summary FROM (SELECT label, count(*) AS n FROM {_LAB} GROUP BY label) LEFT JOIN (SELECT label, string_agg(p, ', ' ORDER BY r) AS top FROM r GROUP BY label) USING (label)""")
def cluster_summary_phrases(spark, sf_dir):
    return mining.phrases(mining.first_word_clusters(_failed(spark, sf_dir))).select(F.col("label").cast("long").alias("label"), "summary")


_FIRST = f"(SELECT label, replace(substr(min_by(input, idx), 1, 80), '\"', '\\\"') AS s FROM {_LAB} GROUP BY label)"


@query("cedar_rules", f"""SELECT label, md5('forbid (principal, action == Action::"submitPrompt", resource) when {{ context.prompt like "*' || s || '*" }};') AS digest FROM {_FIRST}""")
def cedar_rules(spark, sf_dir):
    return mining.policy_rules(mining.first_word_clusters(_failed(spark, sf_dir))).select(F.col("label").cast("long").alias("label"), F.md5("rule").alias("digest"))


@query("rego_rules", f"""SELECT label, md5('package guard.cluster_' || label || chr(10) || 'deny {{ contains(input.prompt, "' || s || '") }}') AS digest FROM {_FIRST}""")
def rego_rules(spark, sf_dir):
    return mining.policy_rules(mining.first_word_clusters(_failed(spark, sf_dir)), "rego").select(F.col("label").cast("long").alias("label"), F.md5("rule").alias("digest"))


@query("deliberative_cases", f"""SELECT label, count(*) AS n_cases, md5('# Cases of cluster ' || label || chr(10) || chr(10) || string_agg('## Case ' || r || chr(10) || 'Input: ' || input, chr(10) || chr(10) ORDER BY r)) AS digest
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY idx) AS r FROM {_LAB} WHERE was_violation QUALIFY r <= 8) GROUP BY label""")
def deliberative_cases(spark, sf_dir):
    d = mining.deliberative_cases(mining.first_word_clusters(_failed(spark, sf_dir)))
    return d.select(F.col("label").cast("long").alias("label"), "n_cases", F.md5("rendered").alias("digest"))


@query("steering_vector", """WITH e AS (SELECT label = 0 AS pos, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), v AS (SELECT dim, avg(x) FILTER (WHERE NOT pos) - avg(x) FILTER (WHERE pos) AS d FROM e GROUP BY dim)
SELECT dim::INT AS dim, round(d / greatest(sqrt(sum(d * d) OVER ()), 1e-8), 5) AS value FROM v""")
def steering_vector(spark, sf_dir):
    v = mining.steering_vector(read(spark, sf_dir, "embeddings"), "embedding", F.col("label") == 0)
    return v.select("dim", F.round("value", 5).alias("value"))


@query("linear_probe_score", f"SELECT vec_id, round(1 / (1 + exp(-(list_dot_product(embedding::DOUBLE[], {PROBE}::DOUBLE[]) + 0.25))), 6) AS p, CASE WHEN list_dot_product(embedding::DOUBLE[], {PROBE}::DOUBLE[]) + 0.25 >= 0 THEN 'block' ELSE 'allow' END AS action FROM embeddings")
def linear_probe_score(spark, sf_dir):
    probe = scorers.LinearProbe(PROBE, 0.25)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(probe.score(F.col("embedding")), 6).alias("p"), probe.decide(F.col("embedding"))["action"].alias("action"))


# ---- canary and audit -------------------------------------------------------------------------

_BUCKET = "('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100"


@query("canary_split", f"SELECT doc_id, {_BUCKET} < 10 AS canary FROM documents")
def canary_split(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", governance.in_canary(F.col("doc_id"), 10).alias("canary"))


@query("canary_fp_rate", f"SELECT lang, count(*) FILTER (WHERE toxic = 0) AS n_benign, round(avg(CASE WHEN toxic = 0 THEN ({_PII_ANY})::INT END), 6) AS fp_rate, coalesce(avg(CASE WHEN toxic = 0 THEN ({_PII_ANY})::INT END) > 0.005, false) AS rolled_back FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def canary_fp_rate(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").withColumn("d", text.pii_guard()(ctx()))
    return governance.false_positives(d, D.blocked(F.col("d")), F.col("toxic") == 0, by=["lang"]).select("lang", "n_benign", F.round("fp_rate", 6).alias("fp_rate"), "rolled_back")


def _chain(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("chain"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("event"), F.lit(None).cast("double").alias("timestamp"), F.lit("engine").alias("actor"), F.lit("{}").alias("payload"))
    return governance.append_chain(e)


@query("audit_chain_verify", "SELECT user_id::VARCHAR AS chain, count(*) AS n, true AS valid FROM events GROUP BY user_id")
def audit_chain_verify(spark, sf_dir):
    return governance.verify_chain(_chain(spark, sf_dir))


@query("audit_tamper", "SELECT user_id::VARCHAR AS chain, NOT bool_or(event_id % 97 = 5) AS valid FROM events GROUP BY user_id")
def audit_tamper(spark, sf_dir):
    bad = _chain(spark, sf_dir).withColumn("payload", F.when(F.col("seq") % 97 == 5, F.lit('{"x":1}')).otherwise(F.col("payload")))
    return governance.verify_chain(bad).select("chain", "valid")


@query("decision_rate_windows", "SELECT date_trunc('day', ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def decision_rate_windows(spark, sf_dir):
    from wardline.streaming.stateful import decision_rates

    return decision_rates(read(spark, sf_dir, "events"), "ts", F.col("event_type")).withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---- models: no SQL ---------------------------------------------------------------------------


@query("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "embedding")
    return mining.kmeans_clusters(e, "embedding", min_cluster_size=50).select("idx", "label")


@query("probe_fit")
def probe_fit(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") == 0).cast("int"))
    probe = scorers.LinearProbe().fit(e, "embedding", "y")
    return e.select("vec_id", "y", F.round(probe.score(F.col("embedding")), 6).alias("p"))


@query("distilled_classifier")
def distilled_classifier(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", "toxic")
    return mining.distilled_classifier(d, "text", "toxic").transform(d).select("doc_id", "toxic", F.col("prediction").cast("int").alias("predicted"))


@query("compile_guards")
def compile_guards(spark, sf_dir):
    rows = mining.first_word_clusters(_failed(spark, sf_dir))
    targets = {"cedar": lambda x: mining.policy_rules(x).withColumnRenamed("rule", "payload"), "cases": lambda x: mining.deliberative_cases(x).withColumnRenamed("rendered", "payload")}
    return mining.compile_guards(rows, targets)[0].select("kind", "name", "label", "n", "summary")


from wardline import catalogue_io  # noqa: E402, F401 - registers the queries that write and read
