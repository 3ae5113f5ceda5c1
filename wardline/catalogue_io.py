"""Queries that write logs, audit files and promotion states to the shared folder and read them back, and those of guards in use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.catalogue import _FAIL, _LAB, _PII_ANY, TRIGGERS, _failed, ctx, query, read
from wardline.functions import decision as D
from wardline.functions import text
from wardline.operators import flow, governance, mining, ordered
from wardline.operators.cascade import GuardPipeline, violations
from wardline.session import fresh_path
from wardline.sources import logs

# ---- log sources ------------------------------------------------------------------------------


def written(lines: DataFrame) -> str:
    """The path of a log with a JSON line for each row; columns that are null are left out of the line."""
    path = fresh_path(lines.sparkSession)
    logs.append_log(lines, path)
    return path


def _flag(k: int) -> str:
    """A value that says violation or not in one of the ways that logs do."""
    return f"CASE event_id % {k} WHEN 0 THEN 'true' WHEN 1 THEN '0' WHEN 2 THEN 'unsafe' WHEN 3 THEN '0.7' WHEN 4 THEN 'no' END"


_TRUTHY = "lower(v) IN ('true', 'violation', 'unsafe', 'fail', '1', 'yes') OR coalesce(TRY_CAST(v AS DOUBLE) <> 0, false)"
_COLUMNS = ["id", "input", "output", "was_violation", "attack_category", "score"]


def _memory(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('c', event_id) END AS conversation_id", "concat('i', event_id) AS id", "CASE WHEN event_id % 2 = 0 THEN event_type END AS converted_value", "'original' AS original_value",
        "CASE WHEN event_id % 4 = 0 THEN '' ELSE props END AS response_text", "'none' AS output", f"{_flag(6)} AS score_value", "CASE WHEN event_id % 6 = 5 THEN true END AS was_violation", "CASE WHEN event_id % 5 > 0 THEN named_struct('attack_category', event_type) END AS labels",
    )


_MEMORY = f"""SELECT CASE WHEN event_id % 3 = 0 THEN 'i' ELSE 'c' END || event_id AS id, CASE WHEN event_id % 2 = 0 AND event_type <> '' THEN event_type ELSE 'original' END AS input, CASE WHEN event_id % 4 = 0 OR coalesce(props, '') IN ('', '0', '{{{{}}}}', '[]', 'null', 'false') THEN 'none' ELSE props END AS output,
CASE WHEN event_id % 6 = 5 THEN true ELSE {_TRUTHY} END AS was_violation, {{}} AS attack_category, CASE event_id % 6 WHEN 0 THEN 1.0 WHEN 3 THEN 0.7 END::DOUBLE AS score FROM (SELECT *, {_flag(6)} AS v FROM events)"""


@query("log_conversation_memory", _MEMORY.format("CASE WHEN event_id % 5 > 0 THEN event_type END"))
def log_conversation_memory(spark, sf_dir):
    return logs.conversation_memory(spark, written(_memory(spark, sf_dir)), only_violations=False).select(*_COLUMNS)


@query("log_memory_export", _MEMORY.format("NULL::VARCHAR") + " WHERE CASE WHEN event_id % 6 = 5 THEN true ELSE " + _TRUTHY + " END")
def log_memory_export(spark, sf_dir):
    """The same from a table, violations only."""
    path = fresh_path(spark)
    _memory(spark, sf_dir).write.parquet(path)
    return logs.memory_export(spark.read.parquet(path)).select(*_COLUMNS)


@query("log_probe_report", """SELECT 'u' || event_id AS id, event_type AS input, CASE WHEN event_id % 2 = 0 THEN props ELSE '' END AS output, event_id % 4 IN (0, 1) AS was_violation, CASE WHEN event_id % 5 = 0 THEN 'name' ELSE 'class' END AS attack_category FROM events WHERE event_id % 3 < 2""")
def log_probe_report(spark, sf_dir):
    e = read(spark, sf_dir, "events").selectExpr(
        "CASE event_id % 3 WHEN 0 THEN 'attempt' WHEN 1 THEN CAST(NULL AS STRING) ELSE 'setup' END AS entry_type", "concat('u', event_id) AS uuid", "event_type AS prompt", "CASE WHEN event_id % 2 = 0 THEN array(props, 'second') END AS outputs",
        "CASE event_id % 4 WHEN 0 THEN map('d', array(0.0D, 1.0D)) WHEN 1 THEN map('d', array(0.0D), 'e', array(0.5D)) WHEN 2 THEN map('d', array(0.0D)) END AS detector_results", "CASE WHEN event_id % 5 > 0 THEN 'class' END AS probe_classname", "'name' AS probe_name",
    )
    return logs.probe_report(spark, written(e), only_violations=False).select("id", "input", "output", "was_violation", "attack_category")


@query("log_evaluations", """SELECT 'e' || event_id AS id, event_type AS input, props AS output, CASE WHEN event_id % 2 = 0 THEN event_id % 3 = 0 ELSE event_id % 5 = 0 END AS was_violation, 'task' AS attack_category FROM events""")
def log_evaluations(spark, sf_dir):
    e = read(spark, sf_dir, "events").selectExpr("concat('e', event_id) AS id", "event_type AS input", "props AS output", "'task' AS task", "CASE WHEN event_id % 2 = 0 THEN IF(event_id % 3 = 0, 'unsafe', 'ok') END AS score", "CASE WHEN event_id % 2 = 1 THEN array(named_struct('value', IF(event_id % 5 = 0, 1, 0))) END AS scores")
    return logs.evaluation_log(spark, written(e), only_violations=False).select("id", "input", "output", "was_violation", "attack_category")


_TRACE = "CASE event_id % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'block' END"


def _traces(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("concat('t', event_id) AS id", "event_type AS input", "props AS output", "map('guard_action', CASE event_id % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'block' END, 'attack_category', event_type) AS metadata")


@query("log_traces", f"SELECT 't' || event_id AS id, event_type AS input, coalesce(props, '') AS output, coalesce({_TRACE} <> 'allow', false) AS was_violation, event_type AS attack_category FROM events")
def log_traces(spark, sf_dir):
    return logs.traces(_traces(spark, sf_dir)).select("id", "input", "output", "was_violation", "attack_category")


@query("log_traces_first", "SELECT 't' || event_id AS id FROM events WHERE event_type = 'purchase' ORDER BY 't' || event_id LIMIT 1000")
def log_traces_first(spark, sf_dir):
    """A filter, and the first thousand by id: both are features of the reader."""
    return logs.traces(_traces(spark, sf_dir), F.col("input") == "purchase", 1000).select("id")


@query("failures_gathered", f"SELECT source, count(*) AS n, count(*) FILTER (WHERE was_violation) AS n_violations FROM (SELECT 'traces' AS source, coalesce({_TRACE} <> 'allow', false) AS was_violation FROM events UNION ALL SELECT 'memory', CASE WHEN event_id % 6 = 5 THEN true ELSE {_TRUTHY} END FROM (SELECT *, {_flag(6)} AS v FROM events)) GROUP BY source")
def failures_gathered(spark, sf_dir):
    path = written(_memory(spark, sf_dir))
    both = logs.gathered(spark, lambda s: logs.traces(_traces(s, sf_dir)), lambda s: logs.conversation_memory(s, path, only_violations=False))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count_if("was_violation").alias("n_violations"))


@query("values_as_float", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 1.0 WHEN event_id % 4 = 1 THEN 0.0 ELSE TRY_CAST(CASE WHEN event_id % 4 = 2 THEN value::VARCHAR ELSE event_type END AS DOUBLE) END AS x FROM events")
def values_as_float(spark, sf_dir):
    said = F.expr("CASE event_id % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'false' WHEN 2 THEN CAST(value AS STRING) ELSE event_type END")
    return read(spark, sf_dir, "events").select("event_id", logs.as_float(said).alias("x"))


# ---- guards in use ----------------------------------------------------------------------------


def _fails(t: str) -> bool:
    if "token" in t:
        raise ValueError(t)
    return "License" in t


@query("failing_guard_fails_open", """SELECT doc_id, CASE WHEN NOT contains(t, 'token') AND contains(t, 'License') THEN 'block' ELSE 'allow' END AS action, CASE WHEN contains(t, 'token') THEN '{"error":"ValueError"}' ELSE '{}' END AS evidence FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def failing_guard_fails_open(spark, sf_dir):
    d = GuardPipeline(tier2=[text.python_guard(_fails, "python")]).apply(read(spark, sf_dir, "documents"), "text")
    return d.select("doc_id", "decision.action", "decision.evidence")


@query("violations", f"SELECT doc_id, CASE WHEN {_PII_ANY} THEN 'pii' ELSE 'stub-classifier' END AS guard FROM documents WHERE {_PII_ANY} OR " + " OR ".join(f"contains(upper(text), '{t.upper()}')" for t in TRIGGERS))
def violating_documents(spark, sf_dir):
    p = GuardPipeline(tier1=[text.pii_guard()], tier2=[text.trigger_guard(TRIGGERS)])
    return violations(p.apply(read(spark, sf_dir, "documents"), "text")).select("doc_id", F.col("decision.guard_name").alias("guard"))


@query("decision_spans", "SELECT doc_id, CASE WHEN blocked THEN 'ERROR' ELSE 'OK' END AS status, CASE WHEN blocked THEN 'high' END AS severity, CASE WHEN blocked THEN 'block' ELSE 'allow' END AS action FROM (SELECT doc_id, " + " OR ".join(f"contains(upper(coalesce(text, '')), '{t.upper()}')" for t in TRIGGERS) + " AS blocked FROM documents)")
def decision_spans(spark, sf_dir):
    at = F.timestamp_seconds(F.col("doc_id"))
    d = read(spark, sf_dir, "documents").withColumn("d", text.trigger_guard(TRIGGERS)(ctx()))
    s = d.select("doc_id", D.span(F.col("d"), "guard.evaluate", at, at + F.expr("INTERVAL 1 SECOND")).alias("s"))
    return s.select("doc_id", "s.status", F.try_element_at("s.events", F.lit(1))["attributes"]["violation.severity"].alias("severity"), F.col("s.attributes")["guard.action"].alias("action"))


@query("labelled_items", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN props END AS item, 2 AS n, coalesce(event_type = 'click', false) OR coalesce(props = 'click', false) AS has_click, 1 AS integrity FROM events WHERE event_type IS NOT NULL AND props IS NOT NULL")
def labelled_items(spark, sf_dir):
    """Elements, lengths and membership of labelled lists: an element keeps the labels, the others are bare values."""
    e = read(spark, sf_dir, "events").where("event_type IS NOT NULL AND props IS NOT NULL")
    t = flow.lift(F.array("event_type", "props"), "web")
    e = e.withColumn("t", t).withColumn("one", flow.item(F.col("t"), (F.col("event_id") % 3 + 1).cast("int")))
    return e.select("event_id", F.col("one.value").alias("item"), flow.length(F.col("t")).alias("n"), flow.holds(F.col("t"), "click").alias("has_click"), F.col("one.integrity").alias("integrity"))


@query("loop_history", "SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 11 PRECEDING), ',') AS history FROM events")
def loop_history(spark, sf_dir):
    p = ordered.Progress()
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.array_join(p.history(F.col("event_type"), p.over(["user_id"], ["ts", "event_id"])), ",").alias("history"))


@query("step_fingerprints", "SELECT event_id, substr(sha256(event_type || chr(1) || '{\"a\":' || (event_id % 7) || ',\"b\":\"' || user_id || '\"}'), 1, 16) AS fingerprint FROM events")
def step_fingerprints(spark, sf_dir):
    """Arguments whose keys stand in either order have one fingerprint."""
    args = F.when(F.col("event_id") % 2 == 0, F.format_string('{"b": "%s", "a": %d}', F.col("user_id").cast("string"), F.col("event_id") % 7)).otherwise(F.format_string('{"a":%d,"b":"%s"}', F.col("event_id") % 7, F.col("user_id").cast("string")))
    return read(spark, sf_dir, "events").select("event_id", text.step_fingerprint(F.col("event_type"), args).alias("fingerprint"))


# ---- promotion and audit ----------------------------------------------------------------------

_WORDS = ["idiot", "worthless"]
_HAS = " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in _WORDS)
_CANARY = "('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 30"


def _pipelines() -> tuple[GuardPipeline, GuardPipeline]:
    base = GuardPipeline(tier1=[text.pii_guard()])
    return base, governance.attach(base, "regex", governance.materialize("regex", "cluster_0", {f"cluster_0_{i}": w for i, w in enumerate(_WORDS)}))


@query("canary_promoted", f"SELECT doc_id, {_CANARY} AS canary, CASE WHEN {_PII_ANY} THEN 'pii' WHEN {_CANARY} AND ({_HAS}) THEN 'cluster_0' ELSE 'none' END AS blocked_by FROM documents")
def canary_promoted(spark, sf_dir):
    d = governance.canaried(read(spark, sf_dir, "documents"), *_pipelines(), "text", "doc_id", 30)
    return d.select("doc_id", "canary", F.when(D.blocked(F.col("decision")), F.col("decision.guard_name")).otherwise("none").alias("blocked_by"))


@query("canary_shadow", f"SELECT doc_id, CASE WHEN {_PII_ANY} THEN 'block' ELSE 'allow' END AS action, CASE WHEN {_CANARY} THEN CASE WHEN {_PII_ANY} OR {_HAS} THEN 'block' ELSE 'allow' END END AS shadow FROM documents")
def canary_shadow(spark, sf_dir):
    d = governance.canaried(read(spark, sf_dir, "documents"), *_pipelines(), "text", "doc_id", 30, shadow=True)
    return d.select("doc_id", "decision.action", F.col("shadow.action").alias("shadow"))


@query("promotion_state", f"SELECT count(DISTINCT label) AS n_promoted, false AS shadow_only, 0.005::DOUBLE AS fp_budget FROM {_LAB}")
def promotion_state(spark, sf_dir):
    """Patterns on each cluster's first words are promoted, and the state is written and read back."""
    artifacts = governance.promote(_artifacts(spark, sf_dir))
    path = fresh_path(spark)
    governance.write_state_of(artifacts, path, timestamp=0.0)
    return governance.read_state(spark, path).select(F.size("promoted").cast("long").alias("n_promoted"), "shadow_only", "fp_budget")


def _artifacts(spark, sf_dir) -> DataFrame:
    """Of every cluster of failures a pattern, a policy and, where it has violations, cases; without them the cases have no payload."""
    rows = mining.first_word_clusters(_failed(spark, sf_dir))
    word = rows.groupBy("label").agg(F.min_by(F.regexp_extract(F.lower("input"), mining.WORDS, 1), "idx").alias("w"))
    made = [word.select(F.lit("regex").alias("kind"), "label", F.to_json(F.array("w")).alias("payload")), mining.policy_rules(rows).select(F.lit("policy").alias("kind"), "label", F.col("rule").alias("payload"))]
    cases = rows.select("label").distinct().join(mining.deliberative_cases(rows), "label", "left").select(F.lit("deliberative").alias("kind"), "label", F.col("rendered").alias("payload"))
    return made[0].unionByName(made[1]).unionByName(cases).withColumn("name", F.concat("kind", F.lit("-"), F.col("label").cast("string")))


@query("promote_artifacts", f"""SELECT kind || '-' || label AS name, CASE WHEN kind = 'regex' THEN 'promoted' WHEN kind = 'policy' OR bad THEN 'refused' ELSE 'skipped' END AS status FROM (SELECT label, bool_or(was_violation) AS bad FROM {_LAB} GROUP BY label), (SELECT unnest(['regex', 'policy', 'deliberative']) AS kind)""")
def promote_artifacts(spark, sf_dir):
    return governance.promote(_artifacts(spark, sf_dir)).select("name", "status")


@query("audit_log", "SELECT user_id::VARCHAR AS chain, count(*) AS n, true AS valid FROM events GROUP BY user_id")
def audit_log(spark, sf_dir):
    """Entries appended to a log in two goes, read back and verified: the second go resumes each chain from the log."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("chain"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("event"), F.col("value").alias("timestamp"), F.lit("engine").alias("actor"), F.coalesce("props", F.lit("{}")).alias("payload"))
    path = fresh_path(spark)
    half = e.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    governance.append_log(e.where(F.col("seq") <= half), path)
    governance.append_log(e.where(F.col("seq") > half), path)
    return governance.verify_chain(governance.log_entries(spark, path))


@query("audit_entries", "SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS chain, event_type AS event, coalesce(props, '{}') AS payload FROM events")
def audit_entries(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("chain"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("event"), F.lit(None).cast("double").alias("timestamp"), F.lit("engine").alias("actor"), F.coalesce("props", F.lit("{}")).alias("payload"))
    path = fresh_path(spark)
    governance.append_log(e, path)
    return governance.log_entries(spark, path).select("id", "chain", "event", "payload")


# ---- mined patterns ---------------------------------------------------------------------------


def _sub(keep: int, where: str = "") -> str:
    """The commonest substrings of each cluster's violations."""
    return f"""SELECT label, span, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, place) AS r FROM (SELECT label, substr(t, i, k) AS span, count(*) AS n, min((k, idx, i)) AS place FROM
(SELECT label, idx, t, k, unnest(range(1, length(t) - k + 2)) AS i FROM (SELECT label, idx, lower(input || ' ') AS t, unnest(range(8, 30)) AS k FROM {_LAB} WHERE was_violation {where})) GROUP BY label, span HAVING count(*) >= 2) QUALIFY r <= {keep}"""


@query("regex_candidates", f"SELECT label, span, n, r FROM ({_sub(50)})")
def regex_candidates(spark, sf_dir):
    s = mining.candidate_spans(mining.positives(mining.first_word_clusters(_failed(spark, sf_dir))))
    return s.select(F.col("label").cast("long").alias("label"), "span", "n", F.col("r").cast("long").alias("r"))


_FOUR = f"(SELECT label, count(*) AS m FROM {_LAB} WHERE was_violation GROUP BY label HAVING count(*) >= 4)"


_TWENTY = _sub(20, f"AND label IN (SELECT label FROM {_FOUR})")


@query("regex_patterns", f"""SELECT label, r, span, c / m AS recall, coalesce(b, 0) / (SELECT count(*) FROM {_FAIL} WHERE NOT was_violation) AS benign_rate FROM (SELECT s.label, r, span, count(*) AS c, any_value(m) AS m FROM ({_TWENTY}) s JOIN {_FOUR} f ON f.label = s.label
JOIN {_LAB} t ON t.label = s.label AND t.was_violation AND contains(lower(t.input || ' '), span) GROUP BY s.label, r, span HAVING count(*) >= 0.99 * any_value(m)) p LEFT JOIN (SELECT span AS bs, count(*) AS b FROM (SELECT DISTINCT span FROM ({_TWENTY})) JOIN {_FAIL} d ON NOT d.was_violation AND contains(lower(d.input), span) GROUP BY span) ON bs = span""")
def regex_patterns(spark, sf_dir):
    rows = _failed(spark, sf_dir)
    p = mining.regex_patterns(mining.first_word_clusters(rows), benign=rows.where("NOT was_violation").select(F.col("input").alias("text")))
    return p.select(F.col("label").cast("long").alias("label"), F.col("r").cast("long").alias("r"), "span", "recall", "benign_rate")
