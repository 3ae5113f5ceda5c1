"""Near-duplicates by an LSH forest over SimHash signatures.

Each document has a 128-bit SimHash of its distinct words, a word weighing less the more
often the document repeats it, and a bottom-k sketch of its word 3-shingles; both depend
on the text alone, however rows are cut into batches. Documents with the same signature
and sketch are one point. Every trie of the forest permutes the bits, and points that
share a prefix of the permuted bits are compared.

How deep the prefix is follows the density. At the first level it is that of the whole
table: from the depth at which random points are alone the search climbs to shorter
prefixes while meeting more points costs less than the further tries that the target
recall takes at the deeper one (``plan``). How many points each prefix really holds is
then counted. A prefix of at most ``DENSE`` points is compared in one task. In a denser
one all points are compared with one of them (a pivot); where that joins all, as among
copies of one text, the prefix is done. Else its points go to the next level, whose tries
are ``DEEPER`` bits deeper and as many more as the target recall needs. Prefixes that are
still dense at the last level are compared in full, block by block.

Candidates within the (wider) boundary of bits form clusters, of which only a spanning
forest is passed on. It tells which points to compare: all of a cluster are compared
again with their sketches, and a pair within the boundary is passed over only if pairs
that were verified by the Jaccard similarity of their sketches join it already. Clusters
of more than ``DENSE`` points go through a forest of their own that compares sketches.
Groups are the connected components of verified pairs; the smallest doc_id of each stays.

Nulls and the like: null texts and null ids are in no group; texts without any word
match only if they are equal; rows that repeat a doc_id share its fate (a document is
never removed for a row with its own id); an empty table gives no pairs; columns other
than doc_id and text are ignored. A document without a row in the result is a class of
its own, without links.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import common, textvec

BITS = 128
#: Distance (bits of 128) for which the forest's recall is planned, and up to which pairs that it meets are verified.
PLANNED, BOUNDARY = 20, 28
TARGET_RECALL = 0.95
#: Recall that each deeper level is planned for, levels, and bits that each goes deeper.
DEEP_RECALL, LEVELS, DEEPER = 0.98, 3, 6
#: A level that takes more tries than this costs more than comparing its points in full.
MOST_TRIES = 512
#: Points of a prefix, a cluster or a block that one task compares with each other.
DENSE = 4096
#: Comparisons of two signatures that cost as much as one row of one trie.
PER_ROW = 256
#: Keys of dense prefixes (8 bytes, with their pivots 40) that are sent to every worker; more are joined by a shuffle.
BROADCAST_KEYS = 200_000
SHINGLE = 3
SKETCH = 128
#: Jaccard similarity of 3-shingles from which a pair is a near copy.
MIN_JACCARD = 0.55
_WEIGHT = 12
#: Bits of a word's hash that stand beside the document's number in one integer, whatever the size of the step.
_HASH_BITS = 43
#: Documents whose histograms are held at once.
_ROWS = 1 << 12
#: Sketches that are compared with one at a time, rows of a distance matrix, and rows gathered before groups are compared.
_COMPARED, _MATRIX, _HELD = 1 << 12, 64, 1 << 14
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(float)


def simhash(w: textvec.Words, rows: int) -> np.ndarray:
    """(rows, 2) uint64: the signs of the weighted bit sums of each document's distinct words."""
    if not len(w.h):
        return np.zeros((rows, 2), np.uint64)
    if rows > 1 << (64 - _HASH_BITS):
        raise ValueError("too many documents in one step")
    key = np.sort((w.doc.astype(np.uint64) << np.uint64(_HASH_BITS)) | (w.h >> np.uint64(64 - _HASH_BITS)))
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    times = np.diff(np.append(new, len(key)))
    key = key[new]
    doc, h = (key >> np.uint64(_HASH_BITS)).astype(np.int64), textvec.mix(key & np.uint64((1 << _HASH_BITS) - 1))
    weight = np.maximum(_WEIGHT // times, 1).astype(float)
    # per document and byte of the hash a histogram of its values; a table of bits turns it into the sums of 8 bits
    whole = np.bincount(doc, weight, rows)
    signs = np.zeros((rows, BITS), bool)
    for a in range(0, rows, _ROWS):
        lo, hi = np.searchsorted(doc, (a, a + _ROWS))
        n = min(_ROWS, rows - a)
        for half, word in enumerate((h[lo:hi], textvec.mix(h[lo:hi] + np.uint64(0x9E3779B97F4A7C15)))):
            for byte, values in enumerate(np.ascontiguousarray(word).view(np.uint8).reshape(-1, 8).T):
                seen = np.bincount((doc[lo:hi] - a) * 256 + values, weight[lo:hi], n * 256).reshape(n, 256)
                at = half * 64 + byte * 8
                signs[a : a + n, at : at + 8] = 2 * (seen @ _BYTE_BITS) > whole[a : a + n, None]
    return np.packbits(signs, axis=1).view(np.uint64)


def sketches(w: textvec.Words, rows: int, size: int = SKETCH) -> tuple[np.ndarray, np.ndarray]:
    """The size smallest distinct shingle hashes (31 bits) of each document, one after another, and the rows + 1 offsets."""
    h, doc = textvec.shingles(w, SHINGLE)
    h = (textvec.mix(h) >> np.uint64(33)).astype(np.int64)
    key = np.sort((doc.astype(np.int64) << 31) | h)
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    doc = key >> 31
    rank = np.arange(len(key)) - np.searchsorted(doc, doc)
    key = key[rank < size]
    return (key & 0x7FFFFFFF).astype(np.int32), np.searchsorted(key >> 31, np.arange(rows + 1))


def points(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo, sketch, same): signature, sketch, and a key equal for documents that are one point."""

    def run(step: pa.RecordBatch) -> pa.RecordBatch:
        text, n = step.column("text"), step.num_rows
        w = textvec.words(text)
        sig = simhash(w, n)
        values, offsets = sketches(w, n)
        wordless = np.flatnonzero(np.diff(w.first) == 0)
        if len(wordless):  # compared as whole texts
            buf, at = textvec.raw(text, "\n")
            own = textvec.range_hash(buf, at[wordless], at[wordless + 1])
            sig[wordless, 0], sig[wordless, 1] = own, textvec.mix(own + np.uint64(7))
        mixed = textvec.mix(values.astype(np.uint64) + np.uint64(1))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed)))
        same = textvec.mix(sig[:, 0] ^ textvec.mix(sig[:, 1] ^ textvec.mix(total[offsets[1:]] - total[offsets[:-1]])))
        sketch = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
        return pa.RecordBatch.from_arrays([step.column("doc_id"), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (sig[:, 0], sig[:, 1])), sketch, pa.array(same.view(np.int64))], ["doc_id", "hi", "lo", "sketch", "same"])

    own = common.id_text(docs).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return common.map_steps(own, run, "doc_id long, hi long, lo long, sketch array<int>, same long")


def plan(n: float, planned: int = PLANNED, target: float = TARGET_RECALL) -> tuple[int, int]:
    """(tries, depth) for n points: the cheapest with the target recall for pairs at the planned distance.

    Beginning at the depth at which random points are alone, each step climbs one bit; the cost of a choice is a row
    for each try plus the n / 2^depth random points met there, ``PER_ROW`` comparisons being worth a row.
    """
    best = None
    for depth in range(max(8, math.ceil(math.log2(max(n, 2))) + 3), 5, -1):
        tries = tries_at(depth, planned, target)
        cost = tries * (1 + n / 2 ** (depth + 1) / PER_ROW)
        if best is None or cost < best[0]:
            best = (cost, tries, depth)
    return best[1], best[2]


def tries_at(depth: int, planned: int = PLANNED, target: float = TARGET_RECALL) -> int:
    """A prefix is shared by a pair at distance r with the hypergeometric probability p; L tries find it with 1 - (1 - p)^L."""
    p = math.prod((BITS - planned - i) / (BITS - i) for i in range(depth))
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - p)))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _join(comp: np.ndarray, i: int, others: np.ndarray) -> list[int]:
    """One of others for each component that i joins by them; comp, the component of each point, follows."""
    met, first = np.unique(comp[others], return_index=True)
    new = met != comp[i]
    if not new.any():
        return []
    comp[np.isin(comp, met[new])] = comp[i]
    return others[first[new]].tolist()


def forest_edges(label: np.ndarray, ids: np.ndarray, sig: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within the boundary that share a label. Rows come ordered by label."""
    n = len(label)
    a_out, b_out = [], []
    begin = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
    size = np.diff(np.append(begin, n))
    stop = np.repeat(begin + size, size)
    comp = np.arange(n)

    def root(x: int) -> int:
        while comp[x] != x:
            comp[x] = comp[comp[x]]
            x = comp[x]
        return x

    def union(pairs_a: np.ndarray, pairs_b: np.ndarray) -> None:
        apart = comp[pairs_a] != comp[pairs_b]
        for a, b in zip(pairs_a[apart].tolist(), pairs_b[apart].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                comp[max(ra, rb)] = min(ra, rb)
                a_out.append(a)
                b_out.append(b)

    here = np.flatnonzero(np.repeat((size > 1) & (size <= _MATRIX), size))
    shift = 1
    while len(here := here[here + shift < stop[here]]):
        other = here + shift
        close = popcount(sig[here, 0] ^ sig[other, 0]).astype(np.int16) + popcount(sig[here, 1] ^ sig[other, 1]) <= boundary
        union(here[close], other[close])
        shift += 1
    for s, m in zip(begin[size > _MATRIX].tolist(), size[size > _MATRIX].tolist()):
        own, flat = sig[s : s + m], np.arange(m)
        for at in range(0, m, _MATRIX):  # a band of the distance matrix
            rows = own[at : at + _MATRIX]
            near = popcount(rows[:, None, 0] ^ own[None, at:, 0]) + popcount(rows[:, None, 1] ^ own[None, at:, 1]) <= boundary
            for i in np.flatnonzero(near.sum(1) > 1).tolist():
                for j in _join(flat, at + i, np.flatnonzero(near[i]) + at):
                    a_out.append(s + at + i)
                    b_out.append(s + j)
    return ids[np.array(a_out, np.int64)], ids[np.array(b_out, np.int64)]


def labeller(level: int, tries: int, depth: int):
    """A map of Arrow batches: the rows once for each trie of a level, after the prefix they have in it."""
    rng = np.random.default_rng(20240229 + level)
    picked = np.stack([rng.permutation(BITS)[:depth] for _ in range(tries)])

    def labels(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo")], 1)
            bits = np.unpackbits(np.ascontiguousarray(sig).view(np.uint8), axis=1)
            for t in range(tries):
                label = np.full(batch.num_rows, t, np.uint64)
                for k in picked[t]:
                    label = (label << np.uint64(1)) | bits[:, k]
                yield pa.RecordBatch.from_arrays([pa.array(label.view(np.int64)), *batch.columns], ["key", *batch.schema.names])

    return labels


def jaccards(values: np.ndarray, offsets: np.ndarray, one: int, others: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """Of sketch one with each of the others, from the bottom-k sketches; exact where both hold fewer than size hashes."""
    own, first, many = values[offsets[one] : offsets[one + 1]], offsets[others], offsets[others + 1] - offsets[others]
    if not len(own) or not many.sum():
        return np.zeros(len(others))
    row = np.repeat(np.arange(len(others)), many)
    begin = np.cumsum(many) - many
    q = np.arange(len(row)) - begin[row]
    v = values[first[row] + q]
    p = np.minimum(np.searchsorted(own, v), len(own) - 1)
    hit = np.flatnonzero(own[p] == v)
    common_ = np.bincount(row[hit], minlength=len(others))
    before = np.arange(len(hit)) - (np.cumsum(common_) - common_)[row[hit]]
    union = len(own) + many - common_
    cut = np.where((len(own) >= size) | (many >= size), np.minimum(union, size), union)
    inside = p[hit] + q[hit] - before < cut[row[hit]]  # the place in the ordered union
    return np.bincount(row[hit][inside], minlength=len(others)) / cut


def verified_edges(sig: np.ndarray, values: np.ndarray | None, offsets: np.ndarray | None, boundary: int, min_jaccard: float, probe: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (of a probe and another, if probes are marked) within the boundary whose sketches are alike.

    A pair is passed over only if verified pairs join it already, so that each copy of a text costs one comparison.
    """
    n = len(sig)
    comp, out = np.arange(n), []
    for i in range(n - 1) if probe is None else np.flatnonzero(probe).tolist():
        other = np.flatnonzero(comp[i:] != comp[i]) + i if probe is None else np.flatnonzero((comp != comp[i]) & ~probe)
        if not len(other):
            continue
        near = popcount(sig[i, 0] ^ sig[other, 0]).astype(np.int16) + popcount(sig[i, 1] ^ sig[other, 1]) <= boundary
        other = other[near]
        for a in range(0, len(other), _COMPARED):
            part = other[a : a + _COMPARED]
            alike = part[jaccards(values, offsets, i, part) >= min_jaccard] if values is not None else part
            out += [(i, j) for j in _join(comp, i, alike)]
    return out


def _signatures(rows: pa.Table) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo")], 1)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    sketch = column.combine_chunks()
    return sketch.flatten().to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(sketch).to_numpy().astype(np.int64))))


def _edges(rows: pa.Table, keys: list[str], boundary: int, min_jaccard: float | None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that join what is related in each group of equal keys; where rows have a probe column, only pairs of a probe."""
    ids, sig = rows.column("doc_id").to_numpy(), _signatures(rows)
    columns = [rows.column(k).to_numpy() for k in keys]
    probe = rows.column("probe").to_numpy(zero_copy_only=False) if "probe" in rows.schema.names else None
    if min_jaccard is None and probe is None:
        return forest_edges(columns[0], ids, sig, boundary)
    values, offsets = _lists(rows.column("sketch")) if min_jaccard is not None else (None, None)
    begin = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))))
    found = []
    for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(ids)]):
        found += [(s + i, s + j) for i, j in verified_edges(sig[s:e], values, offsets[s : e + 1] if offsets is not None else None, boundary, min_jaccard or 0, None if probe is None else probe[s:e])]
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return ids[a], ids[b]


def by_groups(rows: DataFrame, keys: list[str], parts: int, boundary: int, min_jaccard: float | None) -> DataFrame:
    """(a, b): the related pairs within groups of equal keys. A group is held whole; the caller bounds it."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= _HELD:
                table = pa.Table.from_batches(held).combine_chunks()
                other = np.flatnonzero(np.any([(c := table.column(k).to_numpy()) != c[-1] for k in keys], axis=0))
                if len(other):
                    cut = int(other[-1]) + 1
                    yield from edges(table.slice(0, cut))
                    table = table.slice(cut).combine_chunks()
                held, n = table.to_batches(), table.num_rows
        if held:
            yield from edges(pa.Table.from_batches(held).combine_chunks())

    def edges(table: pa.Table):
        a, b = _edges(table, keys, boundary, min_jaccard)
        apart = a != b
        if apart.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[apart]), pa.array(np.maximum(a, b)[apart])], ["a", "b"])

    textvec.tune(rows.sparkSession)
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, "doc_id").mapInArrow(run, "a long, b long")


def _parts(spark, rows: float, per_task: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // per_task))


def _far(crowd: DataFrame, pivots: DataFrame, boundary: int, min_jaccard: float | None) -> DataFrame:
    """crowd with the pivot of its key, and far: whether the two are unrelated."""
    met = crowd.join(pivots, "key")
    bits = F.bit_count(F.col("hi").bitwiseXOR(F.col("p_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("p_lo")))
    met = met.withColumn("far", bits > boundary).drop("p_hi", "p_lo")
    if min_jaccard is None:
        return met

    def compare(batches):
        for batch in batches:
            far = batch.column("far").to_numpy(zero_copy_only=False).copy()
            one, two = (_lists(pa.chunked_array([batch.column(c)])) for c in ("sketch", "p_sketch"))
            for i in np.flatnonzero(~far).tolist():
                values = np.concatenate((one[0][one[1][i] : one[1][i + 1]], two[0][two[1][i] : two[1][i + 1]]))
                offsets = np.array([0, one[1][i + 1] - one[1][i], len(values)])
                far[i] = jaccards(values, offsets, 0, np.array([1]))[0] < min_jaccard
            keep = [c for c in batch.schema.names if c not in ("far", "p_sketch")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(far)], [*keep, "far"])

    return met.mapInArrow(compare, "key long, doc_id long, hi long, lo long, sketch array<int>, pivot long, far boolean")


def in_blocks(met: DataFrame, sizes: DataFrame, dense: int, boundary: int, min_jaccard: float | None) -> DataFrame:
    """(a, b): every far point of a key against all points of it. Points are dealt to blocks of about dense, far ones are sent to each."""
    blocks = sizes.select("key", F.ceil(F.col("n") / dense).cast("int").alias("blocks"))
    rows = met.drop("pivot").join(blocks, "key")
    every = rows.select(*rows.columns, F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("probe"))
    probes = rows.where("far").select(*rows.columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("probe"))
    both = every.unionByName(probes).drop("far", "blocks")
    many = rows.agg(F.coalesce(F.sum(F.when(F.col("far"), F.col("blocks")).otherwise(0) + 1), F.lit(0))).first()[0]
    return by_groups(both, ["key", "block"], _parts(met.sparkSession, many, 200_000), boundary, min_jaccard)


def candidate_pairs(sigs: DataFrame, n: int, boundary: int = BOUNDARY, target: float = TARGET_RECALL, min_jaccard: float | None = None, dense: int = DENSE) -> DataFrame:
    """(a, b) pairs of points, a < b, that join what the forest finds within the boundary (and, with min_jaccard, alike in sketch)."""
    spark, columns = sigs.sparkSession, ["doc_id", "hi", "lo"] + ["sketch"] * (min_jaccard is not None)
    schema = "key long, doc_id long, hi long, lo long" + ", sketch array<int>" * (min_jaccard is not None)
    points = sigs.select(*columns)
    tries, depth = plan(n, target=target)
    here, many, found = points, n, []
    for level in range(LEVELS):
        labelled = here.mapInArrow(labeller(level, tries, depth), schema)
        parts = _parts(spark, many * tries, 1_000_000 if min_jaccard is None else 200_000)
        keys = here.select("doc_id", "hi", "lo").mapInArrow(labeller(level, tries, depth), "key long, doc_id long, hi long, lo long").groupBy("key").agg(F.count("*").alias("n"))
        sizes = common.staged(keys.where(F.col("n") > dense), "near-dense")
        few = sizes.count()
        if not few:
            found.append(by_groups(labelled, ["key"], parts, boundary, min_jaccard))
            break
        sent = (lambda df: F.broadcast(df)) if few <= BROADCAST_KEYS else (lambda df: df)
        found.append(by_groups(labelled.join(sent(sizes.select("key")), "key", "left_anti"), ["key"], parts, boundary, min_jaccard))
        crowd = common.staged(labelled.join(sent(sizes.select("key")), "key"), "near-crowd")
        pivots = crowd.groupBy("key").agg(F.min("doc_id").alias("pivot")).join(points.select(F.col("doc_id").alias("pivot"), *(F.col(c).alias(f"p_{c}") for c in columns[1:])), "pivot")
        pivots = common.staged(pivots, "near-pivots")
        met = common.staged(_far(crowd, sent(pivots) if min_jaccard is None or few <= BROADCAST_KEYS // 16 else pivots, boundary, min_jaccard), "near-met")
        found.append(met.where(~F.col("far") & (F.col("doc_id") != F.col("pivot"))).select(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")))
        unsettled = met.join(sent(met.where("far").select("key").distinct()), "key", "left_semi")
        depth += DEEPER
        tries = tries_at(depth, target=max(target, DEEP_RECALL))
        if level == LEVELS - 1 or tries > MOST_TRIES:
            found.append(in_blocks(unsettled, sizes, dense, boundary, min_jaccard))
            break
        here = common.staged(points.join(unsettled.select("doc_id").distinct(), "doc_id", "left_semi"), "near-deeper")
        many = here.count()
        if not many:
            break
    return reduce(DataFrame.union, found).distinct()


def verified(pairs: DataFrame, points: DataFrame, n: int, boundary: int = BOUNDARY, target: float = TARGET_RECALL, min_jaccard: float = MIN_JACCARD, largest: int = DENSE) -> DataFrame:
    """(a, b): edges that join whatever pairs of points within the boundary and alike in sketch join.

    Points that pairs connect, however indirectly, form a cluster, which one task compares with all sketches at hand.
    Points of clusters of more than largest go through a forest that compares sketches.
    """
    cluster = components(pairs).withColumnRenamed("keep_id", "key")
    big = common.staged(cluster.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > largest), "near-big")
    few, many = big.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = points.join(cluster, "doc_id").select("key", "doc_id", "hi", "lo", "sketch")
    if not few:
        return by_groups(rows, ["key"], _parts(pairs.sparkSession, n, 500_000), boundary, min_jaccard)
    sent = F.broadcast(big.select("key")) if few <= BROADCAST_KEYS else big.select("key")
    small = by_groups(rows.join(sent, "key", "left_anti"), ["key"], _parts(pairs.sparkSession, n, 500_000), boundary, min_jaccard)
    large = common.staged(rows.join(sent, "key", "left_semi").drop("key"), "near-large")
    return small.union(candidate_pairs(large, many, boundary, target, min_jaccard, largest))


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, keep_id): for each vertex the smallest of its component. Rounds of taking the smallest neighbour's label, then the label's label."""
    edges = common.staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near-edges")
    label = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l"))
    while True:
        label = common.staged(label, "near-labels")
        best = edges.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(best, "a").select("a", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        jumped = step.join(label.select(F.col("a").alias("l"), F.col("l").alias("ll")), "l", "left").select("a", "was", F.coalesce(F.least("l", "ll"), "l").alias("l"))
        jumped = common.staged(jumped, "near-labels")
        if jumped.where("was <> l").isEmpty():
            return jumped.select(F.col("a").alias("doc_id"), F.col("l").alias("keep_id"))
        label = jumped.select("a", "l")


def duplicates(docs: DataFrame, boundary: int = BOUNDARY, target: float = TARGET_RECALL, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """(doc_id, keep_id, n_links): each document that repeats another, the one of its class that stays, and how many others the class links it to."""
    return common.settled(lambda: _duplicates(docs, boundary, target, min_jaccard), "near-result")


def _duplicates(docs: DataFrame, boundary: int, target: float, min_jaccard: float) -> DataFrame:
    all_points = common.staged(points(docs), "near-points")
    same = all_points.groupBy("same").agg(F.min("doc_id").alias("point"))
    exact = all_points.select("same", "doc_id").join(same, "same").select("doc_id", "point")
    exact = common.staged(exact.distinct(), "near-exact")
    chosen = exact.where("doc_id = point").select(F.col("point").alias("doc_id"))
    unique = common.staged(all_points.join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "hi", "lo", "sketch"), "near-unique")
    n = unique.count()
    pairs = common.staged(candidate_pairs(unique, n, boundary, target), "near-pairs")
    groups = components(verified(pairs, unique, n, boundary, target, min_jaccard))
    whole = exact.join(groups.select(F.col("doc_id").alias("point"), "keep_id"), "point", "left")
    whole = whole.select("doc_id", F.coalesce("keep_id", "point").alias("keep_id")).groupBy("doc_id").agg(F.min("keep_id").alias("keep_id"))
    whole = common.staged(whole, "near-classes")
    size = whole.groupBy("keep_id").agg((F.count("*") - 1).alias("n_links")).where("n_links > 0")
    return whole.where("doc_id <> keep_id").join(size, "keep_id").select("doc_id", "keep_id", "n_links")
