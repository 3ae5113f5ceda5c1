"""Mixing sources to target weights by entropy balancing.

Each document i with t_i tokens gets a rate w_i, the expected number of its copies. Of
all rates with which every source (or any other dimension's value) reaches its target
number of tokens, entropy balancing takes those nearest to 1 in relative entropy:
w_i = exp(t_i * sum of the multipliers of its values). The multipliers minimise the
convex dual; Newton iterations find them, each one aggregation over the distributed
(values, tokens) histogram, with steps halved until the dual falls. Tokens are counted by
the tokenizer over whole texts, once. Rates are rounded to copies at random, by a hash of
doc_id, so that the expected copies equal the rate. Targets that the iterations can't
reach are an error.

Default targets raise each source's share of tokens to ``TEMPERATURE`` and take the
least total for which no source shrinks.

Nulls and the like: a null source is a source of its own; a null or empty text has no
tokens, rate 1 and one copy; repeated rows have equal rates and copies; a null doc_id is
rounded like an id of its own; a target for a source without tokens can't be met and
is dropped; a value without a target is left free (alone, it keeps its tokens); an empty table gives no rows;
columns other than doc_id, text and the dimensions are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import common, tokencount

TEMPERATURE = 0.9
#: Relative error of a target at which the iterations end, that above which they have failed, and their largest number.
TOLERANCE, FAILED, MOST_ROUNDS = 1e-9, 1e-5, 200
#: Bound of a rate's logarithm, so that sums stay finite.
_LARGEST_LOG = 500.0
SEED = 11


@dataclass
class Solution:
    dims: tuple[str, ...]
    scale: float  # mean tokens of a document
    multipliers: dict[tuple[str, str | None], float]
    iterations: int

    def rate(self, t: Column, names: dict[str, Column]) -> Column:
        """exp(sum of multipliers * t / scale), by one map look-up for each dimension."""
        total = F.lit(0.0)
        for d in self.dims:
            mine = [(v, x) for (dim, v), x in self.multipliers.items() if dim == d]
            if mine:
                table = F.map_from_arrays(F.array(*(F.lit(_key(v)) for v, _ in mine)), F.array(*(F.lit(x) for _, x in mine)))
                total = total + F.coalesce(F.element_at(table, _name(names[d])), F.lit(0.0))
        return F.exp(F.least(total * t / self.scale, F.lit(_LARGEST_LOG)))


def _key(v: str | None) -> str:
    return "n" if v is None else f"v{v}"


def _name(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def tempered(totals: dict[str | None, float], temperature: float = TEMPERATURE) -> dict[str | None, float]:
    """Target tokens of each source: shares to the power of temperature, the least total that shrinks none."""
    whole = sum(totals.values())
    weight = {s: (n / whole) ** temperature for s, n in totals.items() if n > 0}
    factor = max((totals[s] / w for s, w in weight.items()), default=0.0)
    return {s: factor * w for s, w in weight.items()}


def solve(docs: DataFrame, targets: dict[str, dict[str | None, float]] | None = None, dims: tuple[str, ...] = ("source",), most: int = MOST_ROUNDS) -> Solution:
    """The multipliers that meet targets: {dimension: {value: tokens}}; by default the tempered shares of the first dimension."""
    return solve_counted(tokencount.token_counts(docs, dims), targets, dims, most)


def solve_counted(counts: DataFrame, targets: dict[str, dict[str | None, float]] | None = None, dims: tuple[str, ...] = ("source",), most: int = MOST_ROUNDS, t: str = "n_tokens") -> Solution:
    """The same from rows that hold the dimensions and the tokens of each document."""
    counted = counts.select(*(_name(F.col(d)).alias(f"d{k}") for k, d in enumerate(dims)), F.col(t).alias("t")).where("t > 0")
    cells = common.staged(counted.groupBy(*(f"d{k}" for k in range(len(dims))), "t").agg(F.count("*").alias("n")), "mix-cells")
    groups = [f"d{k}" for k in range(len(dims))]
    base = cells.groupBy(*groups).agg(F.sum(F.col("n") * F.col("t")).alias("s"), F.sum("n").alias("n")).collect()
    if not base:
        return Solution(dims, 1.0, {}, 0)
    scale = sum(r.s for r in base) / sum(r.n for r in base)
    have: list[dict[str, float]] = [{} for _ in dims]
    for r in base:
        for k in range(len(dims)):
            have[k][r[f"d{k}"]] = have[k].get(r[f"d{k}"], 0.0) + r.s
    if targets is None:
        back = {_key(None): None} | {v: v[1:] for v in have[0] if v != "n"}
        targets = {dims[0]: tempered({back[v]: n for v, n in have[0].items()})}
    wanted = {(k, _key(v)): n for k, d in enumerate(dims) for v, n in targets.get(d, {}).items() if _key(v) in have[k]}
    names = sorted(wanted)
    goal = np.array([wanted[x] for x in names]) / scale
    index = {x: i for i, x in enumerate(names)}

    def dual(lam: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value, gradient and Hessian, from sums over each combination of values; one pass over the cells."""
        total = F.lit(0.0)
        for k in range(len(dims)):
            mine = [(v, lam[i]) for (kk, v), i in index.items() if kk == k]
            if mine:
                total = total + F.coalesce(F.element_at(F.map_from_arrays(F.array(*(F.lit(v) for v, _ in mine)), F.array(*(F.lit(float(x)) for _, x in mine))), F.col(f"d{k}")), F.lit(0.0))
        x = F.col("t") / scale
        w = F.col("n") * F.exp(F.least(total * x, F.lit(_LARGEST_LOG)))
        f, g, h = -float(lam @ goal), -goal.copy(), np.zeros((len(names), len(names)))
        for r in cells.groupBy(*groups).agg(F.sum(w).alias("w0"), F.sum(w * x).alias("w1"), F.sum(w * x * x).alias("w2")).collect():
            at = [index[k, r[f"d{k}"]] for k in range(len(dims)) if (k, r[f"d{k}"]) in index]
            f += r.w0
            g[at] += r.w1
            h[np.ix_(at, at)] += r.w2
        return f, g, h

    lam, rounds = np.zeros(len(names)), 0
    f, g, h = dual(lam)
    while names and rounds < most and np.abs(g / np.maximum(goal, 1)).max() > TOLERANCE:
        step = np.linalg.lstsq(h, -g, rcond=1e-12)[0]
        size = 1.0
        while True:
            new = dual(lam + size * step)
            rounds += 1
            if new[0] <= f + 1e-4 * size * float(g @ step) or size < 1e-6 or abs(float(g @ step)) < 1e-12 * max(1.0, abs(f)):
                break
            size /= 2
        lam, (f, g, h) = lam + size * step, new
    if names and (left := np.abs(g / np.maximum(goal, 1)).max()) > FAILED:
        raise ArithmeticError(f"targets are missed by {left:.2g} after {rounds} rounds")
    return Solution(dims, scale, {(dims[k], None if v == "n" else v[1:]): float(lam[i]) for (k, v), i in index.items()}, rounds)


def copies(rate: Column, doc_id: Column) -> Column:
    """The rate rounded down, and one more with the probability of the rest."""
    u = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(SEED)), 11) / float(1 << 53)
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("long")


def rates(docs: DataFrame, solution: Solution | None = None) -> DataFrame:
    """doc_id, source, n_tokens, rate, copies: a row for each document."""
    dims = solution.dims if solution else ("source",)
    counts = common.staged(tokencount.token_counts(docs, tuple(dict.fromkeys(("source", *dims)))), "mix-counts")
    solution = solution or solve_counted(counts)
    rated = counts.withColumn("rate", solution.rate(F.col("n_tokens"), {d: F.col(d) for d in dims}))
    return rated.select("doc_id", "source", "n_tokens", F.round("rate", 9).alias("rate"), copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def mixed(docs: DataFrame, solution: Solution | None = None) -> DataFrame:
    """The documents, each as many times as it has copies, with the columns of docs."""
    t = common.fresh(docs, "n_tokens")
    counted = common.staged(tokencount.with_counts(docs, t), "mix-docs")
    solution = solution or solve_counted(counted, t=t)
    rate = solution.rate(F.col(t), {d: F.col(d) for d in solution.dims})
    many = F.array_repeat(F.lit(0), copies(rate, F.col("doc_id")).cast("int"))
    struct = counted.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), many.alias("many"))
    return struct.select("row", F.explode("many")).select("row.*")
