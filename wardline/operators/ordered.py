"""Budgets, loops and progress over ordered steps: running windows on one ordering, so that one exchange and one sort serve them all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHECKPOINTS = (25, 50, 75, 100)
KINDS = ("iteration", "token", "dollar", "wall_clock")


def total(amount: Column, over=None) -> Column:
    """The sum of the amounts as a double. It doesn't depend on the order of addition: amounts of up to 12 decimal places are added as decimals.

    Where an amount is of more places, too large or not a number, that sum is one of doubles.
    """
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    exact = amount.try_cast("decimal(38,12)")
    inexact = F.count_if(amount.isNotNull() & ~F.coalesce(exact.cast("double") == amount.cast("double"), F.lit(False)))
    return F.coalesce(F.when(at(inexact) == 0, at(F.try_sum(exact)).cast("double")), at(F.sum(amount.cast("double"))))


def running(df: DataFrame, key: list[str], seq: list[str], amount: Column, limit: float, name: str = "budget", kind: str = "token") -> DataFrame:
    """Adds used, limit, fraction, remaining, exceeded (strictly above the limit, the amount counted first) and checkpoints reached by the step.

    A negative amount raises. To reset a budget, make an epoch part of the key.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    w = Window.partitionBy(*key).orderBy(*seq)
    checked = F.when(amount < 0, F.raise_error(F.lit("negative amount"))).otherwise(amount)
    df = df.withColumn("used", total(checked, w.rowsBetween(Window.unboundedPreceding, 0)))
    percent = F.floor(F.col("used") / limit * 100)
    before = F.coalesce(F.lag(percent).over(w), F.lit(-1))
    return df.withColumns({
        "budget": F.lit(name), "kind": F.lit(kind), "limit": F.lit(float(limit)), "fraction": F.col("used") / limit, "remaining": F.greatest(F.lit(0.0), limit - F.col("used")), "exceeded": F.col("used") > limit,
        "checkpoints": F.filter(F.array(*map(F.lit, CHECKPOINTS)), lambda c: (percent >= c) & (before < c)),
    })


def wall_clock(df: DataFrame, key: list[str], seq: list[str], ts: str, limit_s: float) -> DataFrame:
    """Adds elapsed_s since the key's first step, and exceeded."""
    w = Window.partitionBy(*key).orderBy(*seq).rowsBetween(Window.unboundedPreceding, 0)
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    return df.withColumn("elapsed_s", at - F.first(at).over(w)).withColumn("exceeded", F.col("elapsed_s") > limit_s)


def composite(df: DataFrame, key: list[str], budgets: dict[str, tuple[Column, float]]) -> DataFrame:
    """key, budget, used, limit, fraction, exceeded: a row for each budget of each key; one pass."""
    sums = df.groupBy(*key).agg(*(total(a).alias(n) for n, (a, _) in budgets.items()))
    each = F.array(*(F.struct(F.lit(n).alias("budget"), F.col(n).alias("used"), F.lit(float(limit)).alias("limit")) for n, (_, limit) in budgets.items()))
    rows = sums.select(*key, F.explode(each).alias("b")).select(*key, "b.*")
    return rows.withColumns({"fraction": F.col("used") / F.col("limit"), "exceeded": F.col("used") > F.col("limit")})


@dataclass(frozen=True)
class Progress:
    window: int = 12
    duplicates: int = 3
    cycles: tuple[int, ...] = (2, 3)
    stagnation: int = 4
    semantic: int = 3
    similarity: float = 0.95

    def __post_init__(self):
        if self.duplicates < 2 or self.window < 2 * max(self.cycles, default=0):
            raise ValueError("window must be at least twice the longest cycle, duplicates at least 2")

    def over(self, key: list[str], seq: list[str]):
        return Window.partitionBy(*key).orderBy(*seq)

    def duplicate(self, fp: Column, w) -> Column:
        """The fingerprint that first reached the threshold in the window, or null; it keeps firing until it leaves the window."""
        seen = F.collect_list(fp).over(w.rowsBetween(1 - self.window, 0))
        # the copy that completes the threshold, oldest first: each candidate with the position of its n-th copy
        nth = F.transform(F.array_distinct(seen), lambda f: F.struct(F.try_element_at(F.filter(F.transform(seen, lambda x, i: F.when(x == f, i)), lambda i: i.isNotNull()), F.lit(self.duplicates)).alias("at"), f.alias("fp")))
        return F.array_min(F.filter(nth, lambda x: x["at"].isNotNull()))["fp"]

    def cycle(self, fp: Column, w) -> Column:
        """The first of the cycle lengths whose last two rounds are equal, or null."""
        out = F.lit(None).cast("int")
        for n in reversed(self.cycles):
            same = F.lit(True)
            for i in range(n):
                recent = fp if i == 0 else F.lag(fp, i).over(w)
                same = same & F.coalesce(recent == F.lag(fp, i + n).over(w), F.lit(False))
            out = F.when(same, F.lit(n)).otherwise(out)
        return out

    def stagnant(self, obs: Column, w) -> Column:
        f = w.rowsBetween(1 - self.stagnation, 0)
        return (F.count(obs).over(f) == self.stagnation) & (F.min(obs).over(f) == F.max(obs).over(f))

    def no_progress(self, score: Column, w) -> Column:
        f = w.rowsBetween(1 - self.semantic, 0)
        checked = F.when((score < 0) | (score > 1), F.raise_error(F.lit("score outside 0..1"))).otherwise(score)
        return F.coalesce((F.count(checked).over(f) == self.semantic) & (F.min(checked).over(f) >= self.similarity), F.lit(False))

    def observe(self, df: DataFrame, key: list[str], seq: list[str], fp: Column, observation: Column | None = None, score: Column | None = None) -> DataFrame:
        """Adds duplicate, cycle, stagnant, no_progress and loop_reason, the first of them."""
        w = self.over(key, seq)
        df = df.withColumns({
            "duplicate": self.duplicate(fp, w), "cycle": self.cycle(fp, w),
            "stagnant": self.stagnant(observation, w) if observation is not None else F.lit(False),
            "no_progress": self.no_progress(score, w) if score is not None else F.lit(False),
        })
        reason = F.when(F.col("duplicate").isNotNull(), "duplicate_call").when(F.col("cycle").isNotNull(), "cycle").when(F.col("stagnant"), "stagnation").when(F.col("no_progress"), "semantic")
        return df.withColumn("loop_reason", reason)

    def history(self, fp: Column, w) -> Column:
        """The fingerprints of the window up to each step, the oldest first."""
        return F.collect_list(fp).over(w.rowsBetween(1 - self.window, 0))

    def decision(self) -> Column:
        from wardline.functions import decision as D

        found = D.escalate(0.99, rationale=F.concat(F.lit("loop: "), F.col("loop_reason")), guard="progress", fallback="No progress is being made; stopping here.")
        return F.when(F.col("loop_reason").isNotNull(), found).otherwise(D.allow())
