"""Threshold-scaled document sketches.

A document's words are the runs of letters, marks and digits of its lower-cased text;
in scripts that set no spaces between words (``UNSPACED``) each character is a word. Its
shingles are the runs of ``SIZE`` words (all its words where it has fewer). A shingle's
hash is the first half of the MD5 of its words, joined by spaces; the sketch retains every
distinct hash below a fixed fraction of the hash space, so that its size follows the
document's. Sketches of the same fraction merge by union, and the containment of one
text in another, however unequal, is estimated by the share of the first one's sketch
that the other holds.

A short passage may have no hash below the bound; ``passages`` therefore compares all
shingles. Many texts are cut into shingles at once, and each distinct shingle of a step is
hashed once; ``SKETCH_SQL`` is the same query for DuckDB.

Nulls and the like: a null, empty or wordless text has no shingles and an empty sketch;
repeated shingles count once; equal rows give equal sketches, a row for each; the
containment of an empty sketch is null; columns other than the id and the text are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import common, textvec

SIZE = 5
#: One hash in this many is retained.
SCALE = 16
#: Quick hashes of items that workers hold at a time; bytes of text that they search for them at a time.
QUICK, PASSAGE_BYTES = 1 << 20, 1 << 19
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
#: A word for RE2 and for Python's regex: a run of letters, marks and digits of other scripts, or one such character of these.
_SPACED = "|".join(rf"[^\P{{{c}}}{UNSPACED}]" for c in "LMN")
WORD = rf"(?:{_SPACED})+|[\p{{L}}\p{{M}}\p{{N}}]"


def bound(scale: int) -> str:
    """The first 16 hexadecimal digits that a hash must lie below."""
    return f"{(1 << 64) // scale:016x}" if scale > 1 else "g"


def _kinds() -> np.ndarray:
    """Of every code point: 0 no part of a word, 1 a letter, mark or digit, 2 a word of its own."""
    found = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, part in ((1, r"[\p{L}\p{M}\p{N}]+"), (2, f"[{UNSPACED}]+")):
        for m in regex.finditer(part, every):
            codes = np.frombuffer(m.group().encode("utf-32-le"), np.uint32)
            found[codes] = np.where(found[codes] > 0, kind, 0) if kind == 2 else kind
    return found


_held: list[np.ndarray] = []


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words of all texts, one space after each: the bytes, where each word begins and ends, and the first word of each text (n + 1)."""
    if not _held:
        _held.append(_kinds())
    buf, offsets = textvec.raw(pc.utf8_lower(column), "\n")
    kind = np.append(_held[0][np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)], 0)
    at = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
    before = np.concatenate(([0], kind[:-2])) if len(kind) > 1 else kind[:0]
    start = at[np.flatnonzero((kind[:-1] == 2) | ((kind[:-1] == 1) & (before != 1)))]
    end = at[np.flatnonzero((kind[:-1] == 2) | ((kind[:-1] == 1) & (kind[1:] != 1))) + 1]
    size = end - start + 1
    begin = np.cumsum(size) - size
    out = buf[np.arange(int(size.sum())) + np.repeat(start - begin, size)]
    stop = begin + size - 1
    out[stop] = 32
    return out, begin, stop, np.searchsorted(start, offsets)


def _shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words, and of each shingle, repeated ones too: where it begins and ends, its quick hash and its text."""
    buf, begin, stop, first = normalised(column)
    many = np.diff(first)
    doc = np.repeat(np.arange(len(many)), many)
    rank = np.arange(len(doc)) - first[doc]
    one = np.flatnonzero((rank == 0) | (rank <= many[doc] - size))  # the first word of each shingle
    last = np.minimum(one + size - 1, first[doc[one] + 1] - 1)
    return buf, begin[one], stop[last], textvec.range_hash(buf, begin[one], stop[last]), doc[one]


def _values(buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each distinct shingle of each text, and its text."""
    order = np.lexsort((h, doc))
    distinct = order[np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])))] if len(order) else order
    _, some, back = np.unique(h[distinct], return_index=True, return_inverse=True)
    some, view = distinct[some], memoryview(buf)
    digest = b"".join(hashlib.md5(view[a:b]).digest()[:8] for a, b in zip(start[some].tolist(), end[some].tolist()))
    return np.frombuffer(digest, ">u8").astype(np.uint64)[back], doc[distinct]


def sketch(docs: DataFrame, key: str = "doc_id", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """key, n_shingles (distinct), n_kept, sketch: the retained hashes (16 digits) in order, an array."""
    limit = (1 << 64) // scale - 1

    def run(step: pa.RecordBatch) -> pa.RecordBatch:
        rows = step.num_rows
        value, owner = _values(*_shingles(step.column("text"), size))
        kept = value <= np.uint64(limit)
        pair = np.unique(np.stack([owner[kept].astype(np.uint64), value[kept]], 1), axis=0) if kept.any() else np.zeros((0, 2), np.uint64)
        offsets = np.searchsorted(pair[:, 0], np.arange(rows + 1, dtype=np.uint64)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array([f"{v:016x}" for v in pair[:, 1].tolist()], pa.string()))
        return pa.RecordBatch.from_arrays([step.column(key), pa.array(np.bincount(owner, minlength=rows).astype(np.int64)), pa.array(np.diff(offsets).astype(np.int64)), lists], [key, "n_shingles", "n_kept", "sketch"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
    return common.map_steps(rows, run, f"{key} long, n_shingles long, n_kept long, sketch array<string>")


def _quick(items: DataFrame, size: int) -> DataFrame:
    """q: the distinct quick hashes of all shingles."""

    def run(step: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.unique(_shingles(step.column("text"), size)[3]).view(np.int64))], ["q"])

    return common.map_steps(items.select(F.col("text").cast("string").alias("text")), run, "q long").distinct()


def _among(docs: DataFrame, quick: np.ndarray, size: int) -> DataFrame:
    """doc_id, sketch: of each document that has any of them, the hashes of those shingles whose quick hash is among those given (in order)."""
    sent = docs.sparkSession.sparkContext.broadcast(quick)

    def run(step: pa.RecordBatch) -> pa.RecordBatch | None:
        buf, start, end, h, doc = _shingles(step.column("text"), size)
        among = sent.value
        met = np.flatnonzero(among[np.minimum(np.searchsorted(among, h), len(among) - 1)] == h) if len(among) else np.zeros(0, np.int64)
        if not len(met):
            return None
        value, owner = _values(buf, start[met], end[met], h[met], doc[met])
        some, offsets = np.unique(owner, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(offsets, len(owner)).astype(np.int32)), pa.array([f"{v:016x}" for v in value.tolist()], pa.string()))
        return pa.RecordBatch.from_arrays([step.column("doc_id").take(pa.array(some)), lists], ["doc_id", "sketch"])

    return common.map_steps(common.id_text(docs), run, "doc_id long, sketch array<string>", step_bytes=PASSAGE_BYTES)


def merge(sketches: DataFrame, by: str) -> DataFrame:
    """by, sketch: the union of the sketches of each group; equal to the sketch of all its texts together."""
    return sketches.groupBy(by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))).alias("sketch"))


def containment(small: DataFrame, large: DataFrame, small_key: str, large_key: str) -> DataFrame:
    """small_key, large_key, shared, contained: for each pair that shares a hash, the estimated share of small in large."""
    # explode would have the optimiser test the sketch's size below, and so evaluate it again; nulls don't join
    one = small.select(F.col(small_key), F.size("sketch").alias("_n"), F.explode_outer("sketch").alias("_h"))
    two = large.select(F.col(large_key), F.explode_outer("sketch").alias("_h"))
    met = one.join(two, "_h").groupBy(small_key, large_key, "_n").agg(F.count("*").alias("shared"))
    return met.select(small_key, large_key, "shared", F.round(F.col("shared") / F.col("_n"), 6).alias("contained"))


def passages(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id, shared, contained: the exact share of each item's shingles in each document that has any of them.

    Workers get the items' quick hashes and hand on only what meets one of them; the documents are read once for each QUICK hashes.
    """
    quick = common.staged(_quick(items, SIZE), "quick")
    parts = max(1, -(-quick.count() // QUICK))
    found = None
    for k in range(parts):
        some = quick.where(F.pmod("q", F.lit(parts)) == k).toPandas()["q"].to_numpy(np.int64).view(np.uint64)
        part = _among(docs, np.sort(some), SIZE)
        found = part if found is None else found.unionByName(part)
    return containment(sketch(items, "item_id", scale=1), found, "item_id", "doc_id")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The sketch of each document, its hashes joined by commas."""
    return sketch(docs).select("doc_id", "n_shingles", "n_kept", F.array_join("sketch", ",").alias("sketch"))


def _sql(table: str, key: str, size: int = SIZE, scale: int = SCALE) -> str:
    return f"""SELECT {key}, len(s) AS n_shingles, list_sort(list_distinct(list_filter(list_transform(s, lambda x: substr(md5(x), 1, 16)), lambda h: h < '{bound(scale)}'))) AS sketch
FROM (SELECT {key}, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - {size - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {size - 1}], ' '))) END AS s
FROM (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM {table}))"""


SKETCH_SQL = f"SELECT doc_id, n_shingles, len(sketch) AS n_kept, array_to_string(sketch, ',') AS sketch FROM ({_sql('documents', 'doc_id')})"


def _containment_sql(scale: int) -> str:
    return f"""WITH s AS ({_sql('benchmark', 'item_id', scale=scale)}), l AS ({_sql('documents', 'doc_id', scale=scale)}),
a AS (SELECT item_id, len(sketch) AS n, unnest(sketch) AS h FROM s), b AS (SELECT doc_id, unnest(sketch) AS h FROM l)
SELECT item_id, doc_id, count(*) AS shared, round(count(*) / n, 6) AS contained FROM a JOIN b USING (h) GROUP BY item_id, doc_id, n"""


CONTAINMENT_SQL = _containment_sql(SCALE)
PASSAGES_SQL = _containment_sql(1)
