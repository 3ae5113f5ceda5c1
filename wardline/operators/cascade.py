"""The three-tier cascade over contexts, and over ordered streams of chunks."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import decision as D

Guard = Callable[[dict[str, Column]], Column]


@dataclass
class GuardPipeline:
    """Tier 1 ends with a terminal decision; tier 3 is asked only where tier 2's confidence lies in the band.

    A transform of tier 1 is replaced by what tier 2 says, as an empty tier 2 says allow with confidence 1.
    keep_transform=True keeps it where tier 2 allows.
    """

    tier1: list[Guard] = field(default_factory=list)
    tier2: list[Guard] = field(default_factory=list)
    tier3: list[Guard] = field(default_factory=list)
    band: tuple[float, float] = (0.30, 0.70)
    budget_ms: float = 80.0
    fail_closed: bool = False
    keep_transform: bool = False

    def run_tier(self, n: int, ctx: dict[str, Column]) -> Column:
        return D.combine([g(ctx) for g in (self.tier1, self.tier2, self.tier3)[n - 1]], n)

    def in_band(self, confidence: Column) -> Column:
        return confidence.between(*self.band)

    def over_budget(self) -> Column:
        if self.fail_closed:
            return D.block(0.5, severity="medium", rationale="latency budget exceeded; closed")
        return D.allow(rationale="latency budget exceeded; open", evidence=F.lit('{"budget_exceeded":true}'))

    def resolve(self, one: Column, two: Column, three: Column, t1_ms: Column | None = None, t2_ms: Column | None = None) -> Column:
        """The cascade over the tiers' decisions. t1_ms, t2_ms: time spent up to each tier's end, as data."""
        last = F.when(D.terminal(two) | ~self.in_band(two["confidence"]), two)
        if t2_ms is not None and self.tier3:
            last = last.when(t2_ms > self.budget_ms, self.over_budget())
        out = last.otherwise(three) if self.tier3 else two
        if self.keep_transform:
            out = F.when((one["action"] == "transform") & (out["action"] == "allow"), one).otherwise(out)
        if not self.tier2 and not self.tier3:
            return one
        first = F.when(D.terminal(one), one)
        if t1_ms is not None:
            first = first.when(t1_ms > self.budget_ms, self.over_budget())
        return first.otherwise(out)

    def evaluate(self, ctx: dict[str, Column], **ms: Column) -> Column:
        return self.resolve(*(self.run_tier(n, ctx) for n in (1, 2, 3)), **ms)

    def apply(self, df: DataFrame, chunk: str = "chunk", buffer: str | None = None, name: str = "decision", **ms: Column) -> DataFrame:
        """Adds the decision.

        Each guard and each tier is a column of its own first, so that no pattern is matched once for every use of its
        result. The guards of a tier run where the tiers before leave the row open, and are null elsewhere.
        """
        ctx = {"chunk": F.col(chunk), "buffer": F.col(buffer) if buffer else F.lit(None).cast("string")}
        out, open_ = df, F.lit(True)
        for n, tier in enumerate((self.tier1, self.tier2, self.tier3), 1):
            if tier:
                out = out.withColumns({f"_g{n}_{i}": g(ctx) if n == 1 else F.when(open_, g(ctx)) for i, g in enumerate(tier)})
            one = D.combine([F.col(f"_g{n}_{i}") for i in range(len(tier))], n)
            out = out.withColumn(f"_t{n}", one if n == 1 else F.when(open_, one))
            if n < 3:
                left = ~D.terminal(F.col(f"_t{n}"))
                left = left & self.in_band(F.col("_t2.confidence")) if n == 2 else left
                out = out.withColumn(f"_o{n}", F.coalesce(left, F.lit(False)))
                open_ = F.col(f"_o{n}")
        return out.select(*(F.col(c) for c in df.columns if c != name), self.resolve(F.col("_t1"), F.col("_t2"), F.col("_t3"), **ms).alias(name))

    def apply_split(self, df: DataFrame, heavy: Callable[[DataFrame], DataFrame], chunk: str = "chunk", name: str = "decision") -> DataFrame:
        """For scorers in Python, which a CASE would run on every row: only rows that tier 1 leaves open reach heavy, which must add the column."""
        from wardline.session import staged

        cheap = staged(df.withColumn(name, self.run_tier(1, {"chunk": F.col(chunk), "buffer": F.lit(None).cast("string")})))
        return cheap.where(D.terminal(F.col(name))).unionByName(heavy(cheap.where(~D.terminal(F.col(name))).drop(name)))

    def guard_stream(self, df: DataFrame, key: str, seq: str, chunk: str) -> DataFrame:
        """Chunks up to the first terminal decision of their stream: key, seq, decision, emitted. The buffer holds all original chunks so far."""
        order = Window.partitionBy(key).orderBy(seq)
        so_far = order.rowsBetween(Window.unboundedPreceding, 0)
        one = df.select(key, seq, F.col(chunk).alias("_c"), F.array_join(F.collect_list(F.coalesce(chunk, F.lit(""))).over(so_far), "").alias("_b"))
        two = self.apply(one, "_c", "_b").select(key, seq, "_c", "decision")
        before = F.coalesce(F.max(D.terminal(F.col("decision")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return two.withColumn("_d", before).where("_d = 0").select(key, seq, "decision", D.render(F.col("decision"), F.col("_c")).alias("emitted"))


def violations(decided: DataFrame, name: str = "decision") -> DataFrame:
    """The rows whose decision is terminal: what a violation hook is given.

    The numbered rows keep the filter above the decision; below it, every guard would be evaluated once for each use.
    """
    return decided.withColumn("_n", F.monotonically_increasing_id()).where(D.terminal(F.col(name)) & (F.col("_n") >= 0)).drop("_n")


def on_violation(stream: DataFrame, hook: Callable[[DataFrame, int], None], name: str = "decision"):
    """A stream writer that hands each batch's violations to hook; a hook that raises is reported and doesn't stop the stream."""
    log = logging.getLogger(__name__)

    def each(batch: DataFrame, number: int) -> None:
        try:
            hook(violations(batch, name), number)
        except Exception:
            log.exception("violation hook failed on batch %d", number)

    return stream.writeStream.foreachBatch(each)


def latency_report(df: DataFrame, column: str = "latency_ms", by: list[str] | None = None) -> DataFrame:
    """Percentiles of measured latencies: what the budget's name promises."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), *(F.percentile_approx(column, q).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)))
