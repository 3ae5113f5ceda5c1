"""Model-backed guards: linear probes in SQL, MLlib fits, and external scorers behind pandas UDFs that fail open."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import decision as D


def dot(x: Column, w: list[float]) -> Column:
    return F.aggregate(F.zip_with(x.cast("array<double>"), F.array(*(F.lit(float(v)) for v in w)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def mean_pool(tokens: Column) -> Column:
    """The mean vector of an array of vectors; null if empty."""
    summed = F.reduce(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), F.element_at(tokens, 1).cast("array<double>"), lambda s, x: F.zip_with(s, x.cast("array<double>"), lambda a, b: a + b))
    return F.when(F.size(tokens) > 0, F.transform(summed, lambda v: v / F.size(tokens)))


def collect_features(layers: list[Column]) -> Column:
    return F.concat(*(mean_pool(x) for x in layers))


def threshold_decision(p: Column, threshold: float = 0.5, *, tier: int = 2, name: str = "classifier", always_high: bool = False) -> Column:
    """Block with confidence p at or above the threshold, else allow with 1 - p; a null score allows and says so."""
    severity = F.lit("high") if always_high else F.when(p > 0.9, "high").otherwise("medium")
    return F.when(p.isNull(), D.allow(tier=tier, rationale="no score", evidence=F.lit('{"no_model":true}'), guard=name)).when(p >= threshold, D.block(p, tier=tier, rationale="unsafe", severity=severity, guard=name)).otherwise(D.allow(confidence=1 - p, tier=tier, guard=name))


class LinearProbe:
    """Logistic regression over pooled features; scoring is a plain expression."""

    def __init__(self, weights: list[float] | None = None, bias: float = 0.0, threshold: float = 0.5):
        self.weights, self.bias, self.threshold = weights, bias, threshold

    def fit(self, df: DataFrame, features: str, label: str, l2: float = 1e-2, iterations: int = 100) -> LinearProbe:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import array_to_vector

        n = df.count()
        data = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
        model = LogisticRegression(regParam=max(l2, 1e-6) / max(n, 1), standardization=False, maxIter=iterations).fit(data)
        self.weights, self.bias = [float(x) for x in model.coefficients], float(model.intercept)
        return self

    def score(self, x: Column) -> Column:
        return F.when(x.isNotNull(), sigmoid(dot(x, self.weights) + self.bias)) if self.weights is not None else F.lit(None).cast("double")

    def decide(self, x: Column) -> Column:
        return threshold_decision(self.score(x), self.threshold, tier=2, name="linear-probe")

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([("w", list(self.weights or []), self.bias, self.threshold)], "kind string, weights array<double>, bias double, threshold double")

    @classmethod
    def from_table(cls, df: DataFrame) -> LinearProbe:
        r = df.first()
        return cls(list(r.weights), r.bias, r.threshold)


class MLPProbe:
    """One hidden ReLU layer, fitted with Adam on at most train_rows rows (a documented bound); scored by expressions."""

    def __init__(self, hidden: int = 32, threshold: float = 0.5):
        self.hidden, self.threshold, self.layers = hidden, threshold, None

    def fit(self, df: DataFrame, features: str, label: str, epochs: int = 30, train_rows: int = 20_000, seed: int = 0) -> MLPProbe:
        got = df.select(features, F.col(label).cast("double").alias("y")).orderBy(F.xxhash64(features)).limit(train_rows).toPandas()
        x, y = np.stack(got[features].to_numpy()).astype(float), got.y.to_numpy()
        rng = np.random.default_rng(seed)
        p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                t += 1
                a = np.maximum(x[part] @ p[0] + p[1], 0)
                e = (1 / (1 + np.exp(-(a @ p[2] + p[3][0]))) - y[part]) / len(part)
                back = np.outer(e, p[2]) * (a > 0)
                for i, g in enumerate((x[part].T @ back, back.sum(0), a.T @ e, np.array([e.sum()]))):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - 1e-2 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.layers = [a.tolist() for a in p]
        return self

    def score(self, x: Column) -> Column:
        w1, b1, w2, b2 = self.layers
        rows = F.array(*(F.greatest(dot(x, [r[k] for r in w1]) + b1[k], F.lit(0.0)) for k in range(self.hidden)))
        return sigmoid(dot(rows, w2) + b2[0])

    def decide(self, x: Column) -> Column:
        return threshold_decision(self.score(x), self.threshold, name="mlp-probe")


def model_scorer(load: Callable[[], Callable[[list[str]], list[float]]]):
    """A pandas UDF text -> struct(p, error). load runs once in a worker; the model scores a batch at a time, and its rows one by one if that fails. A row whose model or call fails gets a null p and the error."""

    @F.pandas_udf("struct<p:double,error:string>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            model, broken = load(), None
        except Exception as e:
            model, broken = None, repr(e)
        for texts in batches:
            rows = texts.tolist()
            p: list[float | None] = [None] * len(rows)
            error: list[str | None] = [repr(RuntimeError(broken)) if broken else None] * len(rows)
            at = [i for i, t in enumerate(rows) if t and not broken]
            try:
                got = [float(x) for x in model([rows[i] for i in at])] if at else []
                if len(got) != len(at):
                    raise ValueError("a score for each text is needed")
                for i, x in zip(at, got):
                    p[i] = x
            except Exception:
                for i in at:
                    try:
                        p[i] = float(model([rows[i]])[0])
                    except Exception as e:
                        error[i] = repr(e)
            yield pd.DataFrame({"p": p, "error": error})

    return score


def classifier_guard(df: DataFrame, text: str, load, threshold: float = 0.5, tier: int = 2, name: str = "classifier", column: str = "decision", forecaster: bool = False) -> DataFrame:
    """Adds the decision of an external model. Presets differ in name, threshold and tier only."""
    scored = df.withColumn("_s", model_scorer(load)(F.col(text)))
    d = threshold_decision(F.col("_s.p"), threshold, tier=tier, name=name, always_high=forecaster)
    return scored.withColumn(column, d.withField("evidence", F.when(F.col("_s.error").isNotNull(), F.to_json(F.struct(F.col("_s.error").alias("error")))).otherwise(d["evidence"]))).drop("_s")


#: name -> (threshold, tier, forecaster)
PRESETS = {"prompt-injection": (0.5, 2, False), "policy-model": (0.5, 2, False), "stream-forecast": (0.5, 3, True), "partial-detector": (0.5, 3, True), "latent-forecast": (0.5, 3, True)}


def generated_verdict(answer: Column, tier: int = 3) -> Column:
    """From a generating model's answer: it begins with "unsafe" or not."""
    return F.when(F.startswith(F.lower(F.trim(answer)), F.lit("unsafe")), D.block(0.95, tier=tier, rationale=answer, guard="generator")).otherwise(D.allow(tier=tier, guard="generator"))


def hosted_verdict(flagged: Column, categories: Column, breakers: tuple[str, ...] = ("prompt_attack",), tier: int = 2) -> Column:
    """From a service's answer: flagged, or a breaker category above 0.5. A missing answer allows."""
    broken = F.exists(F.map_entries(categories), lambda e: e["key"].isin(*breakers) & (e["value"] > 0.5))
    top = F.coalesce(F.array_max(F.map_values(categories)), F.lit(0.9))
    return F.when(F.coalesce(flagged | broken, F.lit(False)), D.block(top, tier=tier, rationale="flagged by service", guard="hosted")).otherwise(D.allow(tier=tier, guard="hosted"))


def scanner_verdict(text: Column, sanitized: Column, valid: Column, risk: Column, tier: int = 2) -> Column:
    """From a scanner's (sanitized, valid, risk); a risk outside 0..1 is an error, which allows."""
    ok = risk.between(0, 1)
    return F.when(~F.coalesce(ok, F.lit(False)), D.allow(tier=tier, evidence=F.lit('{"error":"risk out of range"}'), guard="scanner")).when(~valid, D.block(risk, tier=tier, rationale="scanner", guard="scanner")).when(sanitized != text, D.transform(sanitized, 1 - risk, tier=tier, guard="scanner")).otherwise(D.allow(tier=tier, guard="scanner"))


def entity_guard(redact: bool = True, entities: tuple[str, ...] = ("email", "phone_us", "credit_card", "ssn", "ipv4")):
    """Named entities by the pattern catalogue, with the confidence of a recogniser."""
    from wardline.functions.text import PII, regex_guard

    base = regex_guard({k: PII[k] for k in entities}, redact=redact, name="entities")
    return lambda ctx: (lambda d: F.when(d["action"] == "allow", d).otherwise(d.withField("confidence", F.lit(0.95))))(base(ctx))
