"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on Arrow string columns, many documents at a time: the UTF-8
bytes of a batch form one numpy array in which words, paragraphs and n-grams
are ranges, so that no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy step handles; a longer document is a step of its own.
STEP_BYTES = 2 << 20
#: Rows of an Arrow batch between the JVM and Python.
BATCH_ROWS = 512

_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"mul": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}

#: Letters, digits and every byte of a multi-byte character.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


def tune(spark) -> None:
    """Keep Arrow batches small: a batch of long documents must fit a worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def powers(kind: str, n: int) -> np.ndarray:
    """The first n powers of the multiplier, or of its inverse, modulo 2**64."""
    if len(_powers[kind]) < n:
        base = np.full(max(n, 1 << 21), _MUL if kind == "mul" else _INV, np.uint64)
        base[0] = 1
        _powers[kind] = np.multiply.accumulate(base)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the text of each holds at most step_bytes unless it is one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, base = 0, 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, base + step_bytes, side="right")))
            yield batch.slice(at, to - at)
            at, base = to, int(ends[to - 1])


def raw(column: pa.Array, tail: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by tail, and the n + 1 offsets. A null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    joined = pc.binary_join_element_wise(pc.fill_null(column, ""), "", tail)
    if pa.types.is_large_string(joined.type) or pa.types.is_large_binary(joined.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(joined.buffers()[1], kind, len(joined) + 1, joined.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = joined.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix(buf: np.ndarray) -> np.ndarray:
    """Sums from which range hashes are differences."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers("mul", len(buf)), out=total[1:])
    return total


def power(at: np.ndarray) -> np.ndarray:
    """The multiplier to each of the powers given, by squares: they may be large."""
    out, base, left = np.ones(len(at), np.uint64), _MUL, np.asarray(at, np.uint64)
    while len(left) and left.any():
        out = np.where(left & np.uint64(1), out * base, out)
        base = base * base
        left = left >> np.uint64(1)
    return out


def polynomial(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial of each byte range at the multiplier: that of two ranges together is the first plus the second times a power of the multiplier."""
    total = prefix(buf)
    return (total[end] - total[start]) * powers("inv", len(buf) + 1)[start]


def range_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte range; equal bytes give equal hashes wherever they stand. total: prefix(buf), if at hand."""
    total = prefix(buf) if total is None else total
    h = (total[end] - total[start]) * powers("inv", len(buf) + 1)[start]
    return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(56)))


@dataclass
class Words:
    buf: np.ndarray  # bytes of the step
    offsets: np.ndarray  # of the documents
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # index of the document of each word
    first: np.ndarray  # n + 1: the first word of each document
    h: np.ndarray  # hash of each word
    total: np.ndarray | None = None  # prefix sums of buf


def words(column: pa.Array, lower: bool = True) -> Words:
    """The runs of word bytes of each text, with their hashes."""
    if lower:
        column = pc.utf8_lower(column)
    buf, offsets = raw(column)
    inside = WORD_BYTES[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    total = prefix(buf)
    return Words(buf, offsets, start, end, doc, first, range_hash(buf, start, end, total), total)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of size words, and its document; a document of fewer words gives one shingle of all it has."""
    n = len(w.h)
    count = np.diff(w.first)
    h = np.zeros(n, np.uint64)
    for k in range(size):  # the k-th word of each shingle, where the document has it
        at = np.arange(n) + k
        ok = at < w.first[w.doc + 1] if n else np.zeros(0, bool)
        h = np.where(ok, mix(h * np.uint64(0x100000001B3) + w.h[np.minimum(at, max(n - 1, 0))]), h) if n else h
    position = np.arange(n) - w.first[w.doc] if n else np.zeros(0, np.int64)
    keep = (position == 0) | (position <= count[w.doc] - size) if n else np.zeros(0, bool)
    return h[keep], w.doc[keep]
