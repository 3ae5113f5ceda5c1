"""Content-defined chunking of payload columns.

A gear hash rolls over the bytes of each payload: every byte shifts the hash left and
adds a random number of its own, so that the hash depends on the last 64 bytes. A chunk
ends where the ``AVERAGE_BITS`` top bits are zero, or at ``LARGEST`` bytes, but not
within ``SMALLEST`` bytes. Chunks are named by their SHA-256; Spark joins on digests find
which are new, each payload becomes an ordered list of digests (its recipe), and
``reconstruct`` puts payloads together from the store and verifies them.

Nulls and the like: every row of the input has a row in what ``chunked`` and
``reconstruct`` return. A null payload has nulls throughout and stays null when
reconstructed; an empty one has no chunks, zero length and is verified as empty; payloads
of any length are cut whole; payloads are told apart by their SHA-256, so that rows that
share an id (or have a null one) but not the bytes keep recipes of their own, and equal
rows have equal results, each; chunks that many payloads share are stored once; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import common, textvec

SMALLEST, AVERAGE_BITS, LARGEST = 512, 11, 8192
GEAR = textvec.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gear(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte; it begins anew with each payload. Sums of 64 terms by six doublings."""
    h = GEAR[buf]
    position = np.arange(len(buf)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in (1, 2, 4, 8, 16, 32):
        more = np.zeros(len(buf), np.uint64)
        more[k:] = h[:-k] << np.uint64(k) if k < len(buf) else 0
        more[position < k] = 0
        h = h + more
    return h


def cuts(buf: np.ndarray, offsets: np.ndarray, bits: int = AVERAGE_BITS, smallest: int = SMALLEST, largest: int = LARGEST) -> list[list[int]]:
    """The ends of the chunks of each payload, in bytes of buf."""
    where = np.flatnonzero(gear(buf, offsets) >> np.uint64(64 - bits) == 0) + 1
    place = np.searchsorted(where, offsets, side="right")
    out = []
    for d in range(len(offsets) - 1):
        at, end, found = int(offsets[d]), int(offsets[d + 1]), []
        for c in where[place[d] : place[d + 1]].tolist():
            while c - at > largest:
                at += largest
                found.append(at)
            if c - at >= smallest:
                at = c
                found.append(at)
        while end - at > largest:
            at += largest
            found.append(at)
        if end > at:
            found.append(end)
        out.append(found)
    return out


def _whole(payload: str = "payload"):
    return F.unhex(F.sha2(F.col(payload), 256))


def _short(whole):
    """Half of a payload's SHA-256: enough to group by."""
    return F.substring(whole, 1, 16)


def _rows(payloads: DataFrame, key: str, column: str) -> DataFrame:
    return payloads.select(F.col(key).cast("long").alias("id"), F.col(column).cast("binary").alias("payload"))


def chunks(payloads: DataFrame, key: str, column: str, with_bytes: bool) -> DataFrame:
    """(id, whole, ord, digest, length, total[, packed]): the chunks of each payload, packed by zstd if with_bytes.

    whole is the SHA-256 of the payload, total its polynomial hash.
    """
    textvec.tune(payloads.sparkSession)
    names = ["id", "whole", "ord", "digest", "length", "total"] + ["packed"] * with_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for step in textvec.steps(batches, "payload"):
            buf, offsets = _bytes(step.column("payload"))
            total = textvec.polynomial(buf, offsets[:-1], offsets[1:]).view(np.int64).tolist()
            view, keys = memoryview(buf), step.column("id").to_pylist()
            out: list[list] = [[] for _ in names]
            for d, ends in enumerate(cuts(buf, offsets)):
                at = int(offsets[d])
                whole = hashlib.sha256(view[at : int(offsets[d + 1])]).digest() if ends else b""
                for i, end in enumerate(ends):
                    part = view[at:end]
                    for col, x in zip(out, (keys[d], whole, i, hashlib.sha256(part).digest(), end - at, total[d], pack(part) if with_bytes else None)):
                        col.append(x)
                    at = end
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names)

    return _rows(payloads, key, column).mapInArrow(run, "id long, whole binary, ord int, digest binary, length long, total long" + ", packed binary" * with_bytes)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), np.uint8), np.concatenate(([0], np.cumsum(size)))


def store(payloads: DataFrame, key: str, column: str) -> DataFrame:
    """(digest, packed, length, refs, owner, intact, poly): every distinct chunk once.

    owner: the payload of least id that holds it. intact: what is stored has the digest; poly: its polynomial hash.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            parts = [unpack(p) for p in batch.column("packed").to_pylist()]
            ok = [hashlib.sha256(p).digest() == d for p, d in zip(parts, batch.column("digest").to_pylist())]
            ends = np.cumsum([0, *map(len, parts)])
            poly = textvec.polynomial(np.frombuffer(b"".join(parts), np.uint8), ends[:-1], ends[1:])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_()), pa.array(poly.view(np.int64))], [*batch.schema.names, "intact", "poly"])

    owner = F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", _short("whole").alias("whole"), "ord")).alias("owner")
    one = chunks(payloads, key, column, True).groupBy("digest").agg(F.first("packed").alias("packed"), F.first("length").alias("length"), F.count("*").alias("refs"), owner)
    return one.mapInArrow(check, "digest binary, packed binary, length long, refs long, owner struct<known:boolean,id:long,whole:binary,ord:int>, intact boolean, poly long")


def recipes(payloads: DataFrame, key: str, column: str) -> DataFrame:
    """(key, whole, recipe): a row for each row of payloads, with the SHA-256 and the ordered digests of its bytes; nulls for a null payload."""
    listed = F.array_sort(F.collect_set(F.struct("ord", "digest")))
    of = chunks(payloads, key, column, False).groupBy("whole").agg(F.transform(listed, lambda x: x.digest).alias("recipe"))
    rows = _rows(payloads, key, column).select("id", _whole().alias("whole"))
    recipe = F.when(F.col("whole").isNotNull(), F.coalesce("recipe", F.array().cast("array<binary>")))
    return rows.join(of, "whole", "left").select(F.col("id").alias(key), "whole", recipe.alias("recipe"))


def reconstruct(recipe: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, payload, verified) from recipes and a store: a row for each recipe, verified by the SHA-256 of the payload put together."""
    parts = recipe.groupBy("whole").agg(F.first("recipe").alias("recipe")).select("whole", F.posexplode("recipe").alias("ord", "digest")).join(stored.select("digest", "packed"), "digest")
    listed = parts.groupBy("whole").agg(F.array_sort(F.collect_list(F.struct("ord", "packed"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            whole = [b"".join(unpack(p) for p in parts) for parts in batch.column("packed").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("whole"), pa.array(whole, pa.binary())], ["whole", "payload"])

    built = listed.select("whole", F.transform("parts", lambda x: x.packed).alias("packed")).mapInArrow(run, "whole binary, payload binary")
    payload = F.when(F.size("recipe") == 0, F.lit(b"")).otherwise(F.col("payload"))
    out = recipe.join(built, "whole", "left").select(key, "whole", payload.alias("payload"))
    return out.select(key, "payload", F.when(F.col("whole").isNotNull(), F.coalesce(_whole() == F.col("whole"), F.lit(False))).alias("verified"))


PARTS = "whole binary, n_bytes long, verified boolean, digests array<binary>, lengths array<long>, owned array<boolean>, owners array<long>"


def chunked(payloads: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """A row for each payload: n_bytes, n_chunks, n_new (chunks that it is the first to hold, by id), new_bytes, recipe, verified.

    recipe: the whole digests, joined by commas. verified: every chunk of the recipe is in the store and what is stored
    there is intact, positions are complete, and the polynomial hashes of the stored chunks, put together in the
    recipe's order, give that of the payload. The bytes are shuffled once, compressed, into the store; recipes travel
    as digests.
    """
    kept = store(payloads, key, column).select("digest", F.col("length").alias("stored"), "owner", "intact", "poly")
    mine = chunks(payloads, key, column, False).select(_short("whole").alias("whole"), "ord", "digest", "length", "total").distinct().join(kept, "digest", "left")
    part = F.struct("ord", "digest", "length", "stored", "intact", "poly", (F.col("owner.whole") == F.col("whole")).alias("owned"), F.col("owner.id").alias("owner"))
    listed = mine.groupBy("whole").agg(F.first("total").alias("total"), F.array_sort(F.collect_list(part)).alias("parts"))
    names = ("ord", "digest", "length", "stored", "intact", "poly", "owned", "owner")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: batch.column(c) for c in names}
            many = pc.list_value_length(lists["ord"]).to_numpy().astype(np.int64)
            first = np.concatenate(([0], np.cumsum(many)))
            flat = {c: lists[c].flatten() for c in ("ord", "length", "stored", "intact", "poly")}
            row = np.repeat(np.arange(len(many)), many)
            length = flat["length"].to_numpy()
            stored, poly = (pc.fill_null(flat[c], 0).to_numpy() for c in ("stored", "poly"))
            good = pc.fill_null(flat["intact"], False).to_numpy(zero_copy_only=False) & (stored == length) & (flat["ord"].to_numpy() == np.arange(len(row)) - first[row])
            before = np.cumsum(length) - length
            at = before - before[np.minimum(first[row], max(len(row) - 1, 0))] if len(row) else before
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(poly.view(np.uint64) * textvec.power(at))))
            same = sums[first[1:]] - sums[first[:-1]] == batch.column("total").to_numpy().view(np.uint64)
            n_bytes = np.bincount(row, length, len(many)).astype(np.int64)
            ok = same & (np.bincount(row, good, len(many)) == many)
            yield pa.RecordBatch.from_arrays([batch.column("whole"), pa.array(n_bytes), pa.array(ok), lists["digest"], lists["length"], lists["owned"], lists["owner"]], [x.split()[0] for x in PARTS.split(", ")])

    checked = listed.select("whole", "total", *(F.col(f"parts.{c}").alias(c) for c in names)).mapInArrow(verify, PARTS)
    rows = _rows(payloads, key, column).select("id", _short(_whole()).alias("whole"), F.octet_length("payload").cast("long").alias("size"))
    new = F.filter(F.arrays_zip("lengths", "owned", "owners"), lambda x: F.coalesce(x.owned, F.lit(False)) & x.owners.eqNullSafe(F.col("id")))
    there = F.col("whole").isNotNull()
    out = rows.join(checked, "whole", "left").select("id", "whole", "size", "n_bytes", "verified", "digests", F.coalesce(new, F.array().cast("array<struct<lengths:long,owned:boolean,owners:long>>")).alias("new"))
    return out.select(
        F.col("id").alias(key),
        F.col("size").alias("n_bytes"),
        F.when(there, F.coalesce(F.size("digests"), F.lit(0)).cast("long") * (F.col("size") > 0).cast("long")).alias("n_chunks"),
        F.when(there, F.size("new").cast("long")).alias("n_new"),
        F.when(there, F.aggregate("new", F.lit(0).cast("long"), lambda s, x: s + x.lengths)).alias("new_bytes"),
        F.when(there, F.coalesce(F.array_join(F.transform("digests", lambda d: F.lower(F.hex(d))), ","), F.lit(""))).alias("recipe"),
        F.when(there, (F.col("size") == 0) | F.coalesce(F.col("verified") & (F.col("n_bytes") == F.col("size")), F.lit(False))).alias("verified"),
    )
