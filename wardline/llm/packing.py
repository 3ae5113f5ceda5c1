"""Best-fit packing into sequences of several permitted lengths.

A document's tokens are counted by the tokenizer (``tokencount``) over its whole text,
and it is cut into pieces of at most the largest length. Within a shard, pieces are
placed from the longest down: each goes into the open bin in which it leaves the least
room; if none has room, a bin of the least-cost size is opened, by cost a token of
capacity among the sizes that hold the piece. The lengths are chosen jointly: every set of
lengths to open freely is tried on the shard, the cheapest total wins, and at the end each
bin shrinks to the smallest permitted length that holds its contents. The cost of a length
is ``length * (1 + length / QUADRATIC) + FIXED``: work linear and quadratic in the length,
and a fixed price for a sequence.

Shards take documents by a hash of doc_id, tokens and the number of the copy, and hold
about ``PER_SHARD`` of them at any size of the corpus, so that their number follows the
input, none needs another, and a repeated or null doc_id fills none.

Nulls and the like: a text that is null or empty has 0 tokens and one row with a null
bin; repeated rows are items of their own; a null doc_id is packed too; equal lengths go
by doc_id and piece; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import common, tokencount

LENGTHS = (512, 1024, 2048, 4096, 8192)
QUADRATIC, FIXED = 32768, 64
PER_SHARD = 50_000
#: Copies of one document that are listed at a time.
_LISTED = 4096


def cost(length: int) -> float:
    return length * (1 + length / QUADRATIC) + FIXED


def opened(n: int, lengths: tuple[int, ...], freely: int | frozenset[int]) -> int:
    """The length to open for a piece of n: of those in freely that hold it the one of least cost a token, else the shortest that does."""
    hold = [x for x in sorted(lengths) if x >= n]
    mine = [x for x in hold if (x in freely if isinstance(freely, frozenset) else x <= freely)]
    return min(mine or hold[:1], key=lambda x: (cost(x) / x, x))


def place(sizes: list[int], lengths: tuple[int, ...], freely: int | frozenset[int]) -> tuple[list[int], list[int], list[int], float]:
    """Bin and offset of each piece (sizes in falling order), the capacity of each bin after shrinking, and the total cost.

    freely: the lengths (or all up to one) to open for a piece that a shorter one could hold.
    """
    choice, rank = {}, sorted(lengths)
    bins: list[int] = []
    offsets: list[int] = []
    used: list[int] = []
    room: dict[int, list[int]] = {}
    mask = 0  # bit r: some open bin has r tokens of room
    for n in sizes:
        fit = mask >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            c = choice.get(n)
            if c is None:
                c = choice[n] = opened(n, lengths, freely)
            b, r = len(used), c
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        r -= n
        if r:
            if mask >> r & 1:
                room[r].append(b)
            else:
                room[r] = [b]
                mask |= 1 << r
    final = [rank[int(i)] for i in np.searchsorted(rank, used)]
    return bins, offsets, final, sum(map(cost, final))


def best(sizes: list[int], lengths: tuple[int, ...]) -> tuple[list[int], list[int], list[int], float]:
    """The cheapest placement over all sets of lengths to open freely; sets that open the same lengths are tried once."""
    sets = [frozenset(x) for k in range(1, len(lengths) + 1) for x in combinations(lengths, k)]
    ways = {tuple(opened(n, lengths, x) for n in lengths): x for x in sets}
    return min((place(sizes, lengths, x) for _, x in sorted(ways.items())), key=lambda x: x[3])


SCHEMA = "doc_id long, piece int, n_tokens long, bin long, capacity int, offset long"


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, n_tokens: Column | None = None, per_shard: int = PER_SHARD) -> DataFrame:
    """doc_id, piece, n_tokens, bin, capacity, offset: a row for each piece of each row of docs."""
    most = max(lengths)
    if n_tokens is None:
        items = tokencount.token_counts(docs).withColumnRenamed("n_tokens", "t")
    else:
        items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(n_tokens.cast("long"), F.lit(0)).alias("t"))
    items = common.staged(items.groupBy("doc_id", "t").agg(F.count("*").alias("copies")), "pack-items")
    shards = max(1, math.ceil((items.agg(F.sum("copies")).first()[0] or 0) / per_shard))
    last = F.col("copies") - 1
    items = items.select("doc_id", "t", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / _LISTED))).alias("c"))
    items = items.select("doc_id", "t", F.explode(F.sequence(F.col("c") * _LISTED, F.least(F.col("c") * _LISTED + _LISTED - 1, F.col("last")))).alias("copy"))
    pieces = items.where("t > 0").select(
        "doc_id",
        "copy",
        F.pmod(F.xxhash64("doc_id", "t", "copy"), F.lit(shards)).cast("long").alias("shard"),
        F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.col("t") / most).cast("long") - 1), lambda i: F.least(F.lit(most).cast("long"), F.col("t") - i * most))).alias("piece", "n"),
    )

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        n = rows.column("n").to_numpy()
        doc = pc.fill_null(rows.column("doc_id"), -1).to_numpy()
        order = np.lexsort((rows.column("piece").to_numpy(), rows.column("copy").to_numpy(), doc, -n))
        bins, offsets, final, _ = best(n[order].tolist(), lengths)
        bins = np.array(bins, np.int64)
        rows = rows.take(pa.array(order))
        return pa.table({"doc_id": rows.column("doc_id"), "piece": rows.column("piece"), "n_tokens": rows.column("n"), "bin": pa.array((key[0].as_py() << 32) + bins), "capacity": pa.array(np.array(final, np.int32)[bins]), "offset": pa.array(np.array(offsets, np.int64))})

    packed = pieces.groupBy("shard").applyInArrow(run, SCHEMA)
    empty = items.where("t <= 0").select("doc_id", F.lit(0).alias("piece"), F.col("t").alias("n_tokens"), F.lit(None).cast("long").alias("bin"), F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("long").alias("offset"))
    return packed.unionByName(empty)
