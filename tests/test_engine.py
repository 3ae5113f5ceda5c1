"""Cascades that stop early, guards that fail, hooks, promotion, logs, and numbering in parallel."""

import pytest
from pyspark.sql import functions as F

from wardline.functions import decision as D
from wardline.functions import text
from wardline.operators import flow, governance, scorers
from wardline.operators.cascade import GuardPipeline, on_violation, violations
from wardline.session import numbered, shared_dir


def test_later_tiers_run_on_open_rows_only(spark):
    """A tier-2 guard that raises wherever it is evaluated is never evaluated where tier 1 blocks."""
    bomb = lambda ctx: F.when(F.length(ctx["chunk"]) > 0, F.raise_error(F.lit("evaluated")).cast(D.TYPE)).otherwise(D.allow())
    df = spark.createDataFrame([(1, "write to a.b@example.com"), (2, "")], "id int, chunk string")
    got = {r.id: r.decision for r in GuardPipeline([text.pii_guard()], [bomb]).apply(df).collect()}
    assert (got[1].action, got[1].tier) == ("block", 1) and got[2].action == "allow"
    with pytest.raises(Exception, match="evaluated"):
        GuardPipeline([text.pii_guard()], [bomb]).apply(spark.createDataFrame([(3, "clean")], "id int, chunk string")).collect()


def test_guard_that_raises_allows_with_evidence(spark):
    def check(t):
        if t == "bad":
            raise KeyError(t)
        return t == "hit"

    df = spark.createDataFrame([("bad",), ("hit",), ("fine",)], "chunk string")
    got = {r.chunk: (r.decision.action, r.decision.evidence) for r in GuardPipeline(tier2=[text.python_guard(check, "p")]).apply(df).collect()}
    assert got == {"bad": ("allow", '{"error":"KeyError"}'), "hit": ("block", "{}"), "fine": ("allow", "{}")}


def test_model_scorer_scores_batches_and_falls_back_to_rows(spark):
    def load():
        def model(texts):
            if len(texts) > 1 and "poison" in texts:
                raise ValueError("whole batch")
            if texts == ["poison"]:
                raise ValueError("one")
            return [len(t) / 10 for t in texts]

        return model

    df = spark.createDataFrame([("ab",), ("poison",), (None,), ("abcd",)], "t string").coalesce(1)
    got = {r.t: (r.s.p, r.s.error) for r in df.select("t", scorers.model_scorer(load)("t").alias("s")).collect()}
    assert got["ab"] == (0.2, None) and got["abcd"] == (0.4, None) and got[None] == (None, None) and got["poison"][0] is None and "one" in got["poison"][1]


def test_violation_hook(spark, tmp_path):
    spark.createDataFrame([("bad token",), ("fine",)], "chunk string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("chunk string").parquet(str(tmp_path / "in"))
    seen = []

    def hook(batch, number):
        seen.extend(r.chunk for r in batch.collect())
        raise RuntimeError("hooks may fail")

    p = GuardPipeline(tier2=[text.trigger_guard(["token"])])
    q = on_violation(p.apply(stream), hook).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == ["bad token"]
    assert [r.chunk for r in violations(p.apply(spark.read.parquet(str(tmp_path / "in")))).collect()] == ["bad token"]


def test_promotion_attaches_or_shadows(spark):
    base = GuardPipeline()
    with pytest.raises(ValueError):
        governance.materialize("policy", "x", "y")
    more = governance.attach(governance.attach(base, "regex", governance.materialize("regex", "r", '["worthless"]')), "classifier", governance.materialize("classifier", "c", lambda t: "idiot" in t))
    assert (len(base.tier1), len(more.tier1), len(more.tier2)) == (0, 1, 1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["worthless", "idiot", "fine"] * 10)], "id long, chunk string")
    live = governance.canaried(df, base, more, "chunk", "id", 50).collect()
    assert {r.canary for r in live} == {True, False}
    assert all((r.decision.action == "block") == (r.canary and r.chunk != "fine") for r in live)
    dark = governance.canaried(df, base, more, "chunk", "id", 50, shadow=True).collect()
    assert all(r.decision.action == "allow" and (r.shadow is None) == (not r.canary) for r in dark)
    assert all((r.shadow.action == "block") == (r.chunk != "fine") for r in dark if r.canary)


def test_audit_log_resumes_and_notices_changes(spark, tmp_path):
    path = str(tmp_path / "log")
    assert governance.log_entries(spark, path).collect() == []
    rows = [(c, i, str(i), "e", None if i == 3 else float(i), "me", '{"k":"ü\\n"}') for c in ("a", "b", None) for i in range(6)]
    entries = spark.createDataFrame(rows, "chain string, seq long, id string, event string, timestamp double, actor string, payload string")
    for part in ("seq < 2", "seq >= 2 and chain = 'a'", "seq >= 2 and chain = 'b'"):
        governance.append_log(entries.where("chain is not null").where(part), path)
    log = governance.log_entries(spark, path)
    assert {(r.chain, r.n, r.valid) for r in governance.verify_chain(log).collect()} == {("a", 6, True), ("b", 6, True)}
    changed = log.withColumn("actor", F.when((F.col("seq") == 4) & (F.col("chain") == "a"), "you").otherwise(F.col("actor")))
    assert {(r.chain, r.valid) for r in governance.verify_chain(changed).collect()} == {("a", False), ("b", True)}
    assert governance.append_chain(entries.limit(0)).collect() == []


def test_audit_chains_stay_whole_after_the_join(spark, tmp_path):
    """The join with the log's last hashes is planned by sorting and, once they turn out few, done by broadcasting."""
    entries = spark.range(4000, numPartitions=8).selectExpr("CASE WHEN id % 40 > 0 THEN 'c' || id % 40 END AS chain", "id AS seq", "'' || id AS id", "'e' AS event", "1D AS timestamp", "'me' AS actor", "'{}' AS payload")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    try:
        for part in ("seq < 2000", "seq >= 2000"):
            governance.append_log(entries.where(part), str(tmp_path / "log"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    got = governance.verify_chain(governance.log_entries(spark, str(tmp_path / "log"))).collect()
    assert len(got) == 40 and all(r.valid and r.n == 100 for r in got)


def test_labelled_collections(spark):
    df = spark.createDataFrame([(["x", "y"], {"k": "v"})], "a array<string>, m map<string,string>")
    t, m = flow.lift(F.col("a"), "web"), flow.lift(F.col("m"), "web")
    r = df.select(flow.item(t, 2).alias("i"), flow.item(t, 9).alias("none"), flow.item(m, "k").alias("k"), flow.length(t).alias("n"), flow.holds(t, "y").alias("h")).first()
    assert (r.i.value, r.i.integrity, r.none.value, r.k.value, r.n, r.h) == ("y", 1, None, "v", 2, True) and list(r.i.provenance) == ["web"]


def test_numbered_counts_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = numbered(df.repartition(5), "at", F.col("x")).collect()
    assert [r.x for r in sorted(got, key=lambda r: r["at"])] == sorted(r.x for r in df.collect()) and sorted(r["at"] for r in got) == list(range(1000))
    assert numbered(df.limit(0), "at", F.col("x")).collect() == []


def test_shared_folder_of_a_local_session(spark):
    assert shared_dir(spark) == shared_dir(spark)
