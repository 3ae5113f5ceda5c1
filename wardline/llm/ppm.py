"""Prediction by partial matching: code lengths of documents under a byte-context trie.

The trie of contexts of up to ``order`` bytes is held as counts of the byte strings of
``order + 1`` bytes; shorter contexts are its marginals, because every document is
preceded by ``order`` zero bytes. A symbol is coded from its longest context that was
seen: with escape estimate C, symbol probability n / (N + q) and escape probability
q / (N + q), where N occurrences of q distinct symbols remain after the symbols of the
longer context are excluded. As the symbols of a context are a subset of those of its
suffix, what is excluded depends on the context alone and is summed once per context.

Code lengths are pretrained (``score``) or adaptive (``adaptive_bits``: the trie starts
empty and learns each byte after coding it). Pretrained without counts of its own, a
corpus is cross-fitted: documents fall into ``FOLDS`` folds by a hash of doc_id, and each
is priced under the counts of all documents of the other folds, so that no document's
own strings make it cheap and what only it holds escapes to shorter contexts.

Nulls and the like: a null text gives null bits; an empty one 0 bits over 0 bytes and a
null rate; a zero byte in a text counts as the padding; rows of one doc_id are in one
fold, so equal rows are scored alike, and each counts for the other folds; an empty table
gives an empty result; columns other than doc_id and text are ignored; rows with a null
doc_id are scored like any other, in a fold together; bytes priced without any counts
(a corpus of one fold) cost 8 bits.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import common, textvec

ORDER = 4
#: Trie entries that are sent to every worker; a larger trie stays distributed and is joined.
BROADCAST_ENTRIES = 6_000_000
#: Parts of the corpus, each priced under the counts of the others; and the seed of the hash that deals documents to them.
FOLDS, SEED = 4, 29
#: Bytes of context by which a trie that stays distributed is split.
SPLIT = 2
#: Entries that a task gathers before it hands them on.
FLUSH = 2_000_000


def gram_keys(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts the integer of its order + 1 last bytes, and the texts' offsets."""
    buf, offsets = textvec.raw(column, "")
    keys = buf.astype(np.int64)
    position = np.arange(len(buf)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order + 1):
        part = np.zeros(len(buf), np.int64)
        part[k:] = buf[:-k] if k < len(buf) else 0
        part[position < k] = 0
        keys |= part << (8 * k)
    return keys, offsets


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def fold() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(FOLDS)).cast("long")


def _partial_counts(docs: DataFrame, order: int) -> DataFrame:
    """(key, n) by task, from (text, fold); the fold stands above the order + 1 bytes of the string."""
    textvec.tune(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, n = merge(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

        for step in textvec.steps(batches):
            keys, offsets = gram_keys(step.column("text"), order)
            keys |= np.repeat(step.column("fold").to_numpy() << (8 * (order + 1)), np.diff(offsets))
            if len(keys):
                found = pc.value_counts(pa.array(keys))
                held.append((found.field("values").to_numpy(), found.field("counts").to_numpy()))
                size += len(found)
            if size > FLUSH:
                keys, n = merge(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
                held, size = [(keys, n)], len(keys)
                if size > FLUSH // 2:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(count, "key long, n long")


def corpus_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n) of every byte string of order + 1 bytes in all documents; tasks count, then one shuffle sums."""
    partial = _partial_counts(docs.select(F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("fold")), order)
    return partial.groupBy("key").agg(F.sum("n").alias("n"))


def other_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n0, n1, ...): of every byte string, how often it occurs outside of each fold."""
    bits = 8 * (order + 1)
    partial = _partial_counts(docs.select("text", fold().alias("fold")), order)
    split = partial.select(F.col("key").bitwiseAND((1 << bits) - 1).alias("key"), F.shiftright("key", bits).alias("fold"), "n")
    return split.groupBy("key").agg(*(F.sum(F.when(F.col("fold") != k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(FOLDS)))


class Trie:
    """Contexts of up to order bytes; bits() gives the code length of the last byte of each key."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER, low: dict[int, tuple[np.ndarray, np.ndarray]] | None = None):
        """low: the strings and counts of the lowest levels, by their order, if keys hold a part of the trie only."""
        self.order, self.level = order, []
        keys, counts = merge(np.asarray(keys, np.int64), np.asarray(counts, np.int64))
        for k in range(order, -1, -1):
            if k < order:
                keys, counts = merge(keys & ((1 << (8 * (k + 1))) - 1), counts)
            if low and k in low:
                keys, counts = merge(np.asarray(low[k][0], np.int64), np.asarray(low[k][1], np.int64))
            context = keys >> 8
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(keys) else np.zeros(0, np.int64)
            self.level.append({"keys": keys, "n": counts, "context": context[first], "total": np.add.reduceat(counts, first) if len(first) else counts, "q": np.diff(np.append(first, len(keys))), "first": first})
        for at, (upper, lower) in enumerate(zip(self.level, self.level[1:])):
            k = order - at
            where = np.searchsorted(lower["keys"], upper["keys"] & ((1 << (8 * k)) - 1))
            upper["excluded"] = np.add.reduceat(lower["n"][where], upper["first"]) if len(upper["first"]) else lower["n"][:0]

    def bits(self, keys: np.ndarray) -> np.ndarray:
        cost, left = np.zeros(len(keys)), np.arange(len(keys))
        cut_n, cut_q = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for at, level in enumerate(self.level):
            if not len(left) or not len(level["keys"]):
                continue
            k = self.order - at
            key = keys[left] & ((1 << (8 * (k + 1))) - 1)
            where = np.minimum(np.searchsorted(level["keys"], key), len(level["keys"]) - 1)
            found = level["keys"][where] == key
            ctx = np.minimum(np.searchsorted(level["context"], key >> 8), len(level["context"]) - 1)
            seen = level["context"][ctx] == key >> 8
            total, q = level["total"][ctx] - cut_n[left], level["q"][ctx] - cut_q[left]
            whole = np.maximum(total + q, 1)
            cost[left[found]] += np.log2(whole[found] / level["n"][where[found]])
            escape = ~found & seen & (q > 0)
            cost[left[escape]] += np.log2(whole[escape] / q[escape])
            below = ~found & seen
            if k:
                cut_n[left[below]] = level["excluded"][ctx[below]]
            cut_q[left[below]] = level["q"][ctx[below]]
            left = left[~found]
        cost[left] += np.log2(np.maximum(256 - cut_q[left], 1))
        return cost


def adaptive_bits(data: bytes, order: int = ORDER) -> float:
    """Code length of one text when the trie starts empty: each byte is coded, then counted in all its contexts."""
    counts: dict[bytes, dict[int, int]] = {}
    padded, bits = bytes(order) + data, 0.0
    for i in range(order, len(padded)):
        symbol, excluded, done = padded[i], set(), False
        for k in range(order, -1, -1):
            seen = counts.get(padded[i - k : i])
            if not seen or done:
                continue
            rest = {s: n for s, n in seen.items() if s not in excluded}
            whole = sum(rest.values()) + len(rest)
            if symbol in rest:
                bits += math.log2(whole / rest[symbol])
                done = True
            elif rest:
                bits += math.log2(whole / len(rest))
                excluded |= set(rest)
        if not done:
            bits += math.log2(max(256 - len(excluded), 1))
        for k in range(order + 1):
            node = counts.setdefault(padded[i - k : i], {})
            node[symbol] = node.get(symbol, 0) + 1
    return bits


def adaptive(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_bytes, bits, bits_per_byte with a trie of each document's own. Sequential per byte: for smaller corpora."""

    def run(step: pa.RecordBatch) -> pa.RecordBatch:
        texts = step.column("text").to_pylist()
        bits = [None if t is None else adaptive_bits(t.encode(), order) for t in texts]
        return _result(step, np.array([len((t or "").encode()) for t in texts], np.int64), np.array([b or 0.0 for b in bits]))

    return common.map_steps(common.id_text(docs), run, SCHEMA)


SCHEMA = "doc_id long, n_bytes long, bits double, bits_per_byte double"


def _result(step: pa.RecordBatch, size: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    null = pc.is_null(step.column("text")).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", divide="ignore"):
        rate = bits / size
    return pa.RecordBatch.from_arrays(
        [step.column("doc_id"), pa.array(size), pa.array(np.round(bits, 6), mask=null), pa.array(np.round(rate, 6), mask=null | (size == 0))],
        ["doc_id", "n_bytes", "bits", "bits_per_byte"],
    )


_held: dict[str, tuple] = {}


def score(docs: DataFrame, counts: DataFrame | None = None, order: int = ORDER, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, bits, bits_per_byte of each document under a trie of counts (by default those of docs in the other folds)."""
    own = common.id_text(docs)
    if counts is not None:
        return _score(own, common.staged(counts, "ppm-counts"), order, broadcast_entries)
    others = common.staged(other_counts(own, order), "ppm-counts")
    parts = [_score(own.where(fold() == k), others.where(F.col(f"n{k}") > 0).select("key", F.col(f"n{k}").alias("n")), order, broadcast_entries) for k in range(FOLDS)]
    return reduce(DataFrame.unionByName, parts)


def _score(own: DataFrame, counts: DataFrame, order: int, broadcast_entries: int) -> DataFrame:
    if counts.count() > broadcast_entries:
        return _score_joined(own, counts, order)
    got = counts.toArrow()
    model = own.sparkSession.sparkContext.broadcast((got.column("key").to_numpy(), got.column("n").to_numpy()))
    name = uuid.uuid4().hex

    def run(step: pa.RecordBatch) -> pa.RecordBatch:
        if name not in _held:
            _held.clear()
            keys, n = merge(*model.value)
            trie = Trie(keys, n, order)
            _held[name] = (trie, pa.array(keys), trie.bits(keys))
        trie, known, cost = _held[name]
        keys, offsets = gram_keys(step.column("text"), order)
        at = pc.fill_null(pc.index_in(pa.array(keys), value_set=known), -1).to_numpy(zero_copy_only=False)
        bits = cost[at] if len(cost) else np.zeros(len(keys))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh, back = np.unique(keys[missing], return_inverse=True)
            bits[missing] = trie.bits(fresh)[back]
        doc = np.repeat(np.arange(step.num_rows), np.diff(offsets))
        return _result(step, np.diff(offsets), np.bincount(doc, bits, step.num_rows).astype(float))

    return common.map_steps(own, run, SCHEMA)


def _score_joined(docs: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """The same for a trie of any size: its parts price the strings that documents hold, which are joined back.

    A part has all strings with the same last ``SPLIT`` bytes of context, at most 256 ** (order + 1 - SPLIT) of them
    however large the corpus; the levels below, at most 256 ** SPLIT strings each, are sent to every part.
    """
    shared = min(SPLIT, order)
    low = {}
    for k in range(shared):
        got = counts.groupBy(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("s")).agg(F.sum("n").alias("n")).toArrow()
        low[k] = (got.column("s").to_numpy(), got.column("n").to_numpy())
    sent = docs.sparkSession.sparkContext.broadcast(low)

    def grams(step: pa.RecordBatch) -> pa.RecordBatch:
        keys, offsets = gram_keys(step.column("text"), order)
        doc = np.repeat(np.arange(step.num_rows), np.diff(offsets))
        both = np.stack([doc, keys], 1)
        pair, n = np.unique(both, axis=0, return_counts=True) if len(both) else (both, np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([step.column("row").take(pa.array(pair[:, 0])), pa.array(pair[:, 1]), pa.array(n.astype(np.int64))], ["row", "key", "times"])

    numbered = common.staged(docs.withColumn("row", F.monotonically_increasing_id()), "ppm-rows")
    times = common.map_steps(numbered.select("row", "text"), grams, "row long, key long, times long")
    before = F.shiftright("key", 8).bitwiseAND((1 << 8 * shared) - 1)

    def price(_, trie_part: pa.Table, asked: pa.Table) -> pa.Table:
        trie = Trie(trie_part.column("key").to_numpy(), trie_part.column("n").to_numpy(), order, sent.value)
        keys = asked.column("key").to_numpy()
        return pa.table({"key": keys, "cost": trie.bits(keys)})

    prices = counts.groupBy(before.alias("b")).cogroup(times.select("key").distinct().groupBy(before.alias("b"))).applyInArrow(price, "key long, cost double")
    sums = times.join(prices, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("bits"))
    size = F.octet_length("text").cast("long")
    bits = F.when(F.col("text").isNotNull(), F.round(F.coalesce("bits", F.lit(0.0)), 6))
    return numbered.join(sums, "row", "left").select("doc_id", F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes"), bits.alias("bits"), F.when(size > 0, F.round(F.col("bits") / size, 6)).alias("bits_per_byte"))
