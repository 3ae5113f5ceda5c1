"""Token counts of whole texts, and edit-aware recounting from kept segment trees.

A text is split into pre-tokens by the tokenizer's pattern. ``token_counts`` splits many
texts at once: characters are looked up in a table of the pattern's classes, runs and
contractions give the boundaries, and each distinct pre-token is encoded once.

``trees`` keeps for each document the sums of characters and of tokens of its blocks of
pre-tokens, the leaves of a segment tree. ``apply_edits`` starts from these kept sums: an
edit replaces a range of characters, the tree leads to the block where it begins, the
split starts again a few characters before it (the pattern looks that far ahead) and goes
on until a boundary falls on one of the old ones. Only the blocks touched are split and
encoded again, and only the sums on the way from them to the root change.

Texts are encoded with a public byte-level BPE vocabulary, whose path is a parameter;
special tokens are not recognised in texts.

Nulls and the like: a null text has null counts, and an edit of it does nothing; an
empty one has 0 tokens; an edit's range is clipped to the text and a null replacement is
empty; edits refer to the original characters and may touch, but where two of a document
overlap none is applied and the edited count is null; repeated rows are counted each, and
edits of a null doc_id belong to the rows with a null doc_id; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wardline.llm import common, textvec

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of a block, and characters that the split goes back before an edit.
BLOCK, CONTEXT = 64, 4
#: Distinct pre-tokens of which a worker remembers the number of tokens before it starts anew.
REMEMBERED = 1_000_000

_LETTER, _NUMBER, _OTHER, _SPACE, _END = range(5)
_held: dict[str, Counter] = {}


class Counter:
    """Tokens of single pre-tokens, and the pre-tokens of many texts."""

    def __init__(self, vocabulary: str = VOCABULARY):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(vocabulary, "rb") if line.strip())}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.hashes, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.kind = np.full(0x110000, _OTHER, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for k, letters in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(letters, every):
                self.kind[ord(m.group()[0]) : ord(m.group()[-1]) + 1] = k

    def count(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for p in pieces:
                if p not in known:
                    known[p] = len(self.encoding._encode_single_piece(p))
            return [known[p] for p in pieces]

    def pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pre-tokens of all texts in order: the text of each, its characters and its tokens."""
        buf, offsets = textvec.raw(column, "\n")
        code = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((buf & 0xC0) != 0x80)  # the byte at which each character begins
        kind = self.kind[code]
        ends = np.searchsorted(at, offsets[1:] - 1)
        kind[ends] = _END
        n = len(code)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        start = np.concatenate(([True], kind[1:] != kind[:-1]))
        start[ends] = True
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] < _SPACE))  # white space before something else
        start[last] = True
        start[last[code[last] == 32] + 1] = False
        quote = np.flatnonzero((code[:-1] == 39) & start[:-1] & (kind[1:] == _LETTER))
        one, two = code[quote + 1], code[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for size, where in ((1, quote[short]), (2, quote[long & ~short])):
            start[where + 1] = False
            start[where + 1 + size] = True
        begin = np.flatnonzero(start)
        stop = np.append(begin[1:], n)
        real = kind[begin] != _END
        begin, stop = begin[real], stop[real]
        h = textvec.range_hash(buf, at[begin], np.append(at, len(buf))[stop])
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        new = np.flatnonzero(self.hashes[np.minimum(place, len(self.hashes) - 1)] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(new):
            whole = memoryview(buf)
            limits = np.append(at, len(buf))
            found = [len(self.encoding._encode_single_piece(bytes(whole[limits[begin[i]] : limits[stop[i]]]))) for i in first[new].tolist()]
            if len(self.hashes) > REMEMBERED:
                self.hashes, self.sizes = self.hashes[:0], self.sizes[:0]
            hashes = np.concatenate((self.hashes, distinct[new]))
            sizes = np.concatenate((self.sizes, np.array(found, np.int64)))
            if len(self.hashes) == 0 and len(new) < len(distinct):  # all was forgotten: what this step knew as well
                return self.pieces(column)
            order = np.argsort(hashes)
            self.hashes, self.sizes = hashes[order], sizes[order]
            place = np.searchsorted(self.hashes, distinct)
        tokens = self.sizes[place][back]
        return np.searchsorted(ends, begin), stop - begin, tokens

    def totals(self, column: pa.Array) -> np.ndarray:
        """The tokens of each text; 0 for null."""
        doc, _, tokens = self.pieces(column)
        return np.bincount(doc, tokens, len(column)).astype(np.int64)


def counter(vocabulary: str = VOCABULARY) -> Counter:
    if vocabulary not in _held:
        _held[vocabulary] = Counter(vocabulary)
    return _held[vocabulary]


def token_counts(docs: DataFrame, columns: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, the columns given (as strings), and n_tokens of each text (0 for null); a row for each document."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)))

    def run(step: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([step.column("doc_id"), *step.columns[2:], pa.array(counter(vocabulary).totals(step.column("text")))], names)

    names = ["doc_id", *columns, "n_tokens"]
    return common.map_steps(picked, run, "doc_id long, " + "".join(f"`{c}` string, " for c in columns) + "n_tokens long")


def with_counts(docs: DataFrame, name: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with the tokens of each text in a further column."""

    def run(step: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*step.columns, pa.array(counter(vocabulary).totals(step.column("text")))], [*step.schema.names, name])

    return common.map_steps(docs, run, StructType([*docs.schema.fields, StructField(name, LongType())]))


class Tree:
    """The pre-tokens of one text in blocks, under a segment tree of (characters, tokens).

    kept: the (characters, tokens) of each block from an earlier count; a block is then split only when an edit touches it.
    """

    def __init__(self, text: str, counter: Counter, kept: tuple[list[int], list[int]] | None = None):
        self.counter, self.original = counter, text
        if kept is None:
            pieces = counter.split.findall(text)
            blocks: list[list[str] | None] = [pieces[i : i + BLOCK] for i in range(0, len(pieces), BLOCK)] or [[]]
            counts = [counter.count(b) for b in blocks]
            chars, tokens = [sum(map(len, b)) for b in blocks], [sum(n) for n in counts]
        else:
            chars, tokens = (list(x) or [0] for x in kept)
            blocks, counts = [None] * len(chars), [None] * len(chars)
        self._blocks, self.counts = blocks, counts
        self._begin = [0, *accumulate(chars)]
        self.leaves = 1 << (len(chars) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.leaves), [0] * (2 * self.leaves)
        self.chars[self.leaves : self.leaves + len(chars)], self.tokens[self.leaves : self.leaves + len(chars)] = chars, tokens
        for i in range(self.leaves - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.reencoded = 0

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def blocks(self) -> list[list[str]]:
        return [self._block(i) for i in range(len(self._blocks))]

    def _block(self, i: int) -> list[str]:
        """The pre-tokens of a block; one that was not touched yet is split here, in sight of the original text after it."""
        if self._blocks[i] is None:
            a, b = self._begin[i], self._begin[i + 1]
            pieces, at = [], a
            for m in self.counter.split.finditer(self.original, a):
                if at >= b:
                    break
                pieces.append(m.group())
                at = m.end()
            self._blocks[i] = pieces
            self.counts[i] = self.counter.count(pieces)
        return self._blocks[i]

    def text(self) -> str:
        return "".join(p for b in self.blocks for p in b)

    def _update(self, i: int) -> None:
        at = self.leaves + i
        self.chars[at], self.tokens[at] = sum(map(len, self._block(i))), sum(self.counts[i])
        at >>= 1
        while at:
            self.chars[at], self.tokens[at] = self.chars[2 * at] + self.chars[2 * at + 1], self.tokens[2 * at] + self.tokens[2 * at + 1]
            at >>= 1

    def _locate(self, char: int) -> tuple[int, int, int]:
        """Block and index of the pre-token that holds a character, and where it begins."""
        at, begin = 1, 0
        while at < self.leaves:
            at *= 2
            if char - begin >= self.chars[at] and self.chars[at + 1]:
                begin += self.chars[at]
                at += 1
        block = at - self.leaves
        pieces = self._block(block)
        for i, p in enumerate(pieces):
            if char < begin + len(p):
                return block, i, begin
            begin += len(p)
        return (block, len(pieces) - 1, begin - len(pieces[-1])) if pieces else (block, 0, begin)

    def _from(self, block: int, index: int) -> Iterator[tuple[int, int, str]]:
        for b in range(block, len(self._blocks)):
            pieces = self._block(b)
            for i in range(index if b == block else 0, len(pieces)):
                yield b, i, pieces[i]

    def edit(self, start: int, end: int, new: str) -> None:
        size = self.chars[1]
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        block, index, begin = self._locate(max(start - CONTEXT, 0))
        source, old, ends, places = self._from(block, index), [], [], []
        length, want = 0, end - begin + 64
        while True:
            for b, i, p in source:
                old.append(p)
                length += len(p)
                ends.append(length)
                places.append((b, i))
                if length >= want:
                    break
            else:
                want = length  # all of the text
            whole = begin + length >= size
            before = "".join(old)
            text = before[: start - begin] + new + before[end - begin :]
            shift = len(text) - len(before)
            edited = start - begin + len(new)
            pieces, stop = [], len(old)
            for m in self.counter.split.finditer(text):
                pieces.append(m.group())
                if m.end() >= edited and (whole or m.end() + CONTEXT <= len(text)):
                    k = bisect.bisect_left(ends, m.end() - shift)
                    if k < len(ends) and ends[k] == m.end() - shift and ends[k] >= end - begin:
                        stop = k + 1
                        break
            else:
                if not whole:
                    want = 2 * length + 64
                    continue
            break
        counts = self.counter.count(pieces)
        self.reencoded += len(pieces)
        last_block, last_index = places[stop - 1] if stop else (block, index - 1)
        for b in range(block, last_block + 1):
            lo, hi = (index if b == block else 0), (last_index + 1 if b == last_block else len(self._block(b)))
            self._block(b)[lo:hi] = pieces if b == block else []
            self.counts[b][lo:hi] = counts if b == block else []
            self._update(b)


TREES = "doc_id long, text string, n_pretokens long, n_tokens long, chars array<int>, tokens array<int>"
SCHEMA = "doc_id long, n_pretokens long, n_tokens long, n_tokens_edited long, n_reencoded long"


def _rows_of(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])


def trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text, n_pretokens, n_tokens, and the characters and tokens of each block: what is kept of each document."""

    def run(step: pa.RecordBatch) -> pa.RecordBatch:
        rows, null = step.num_rows, pc.is_null(step.column("text")).to_numpy(zero_copy_only=False)
        doc, chars, tokens = counter(vocabulary).pieces(step.column("text"))
        first = np.searchsorted(doc, np.arange(rows + 1))
        many = np.diff(first)
        per = -(-many // BLOCK)
        offsets = np.concatenate(([0], np.cumsum(per)))
        begin = np.repeat(first[:-1] - BLOCK * offsets[:-1], per) + BLOCK * np.arange(offsets[-1])
        sums = [np.add.reduceat(x, begin).astype(np.int32) if len(begin) else np.zeros(0, np.int32) for x in (chars, tokens)]
        whole = np.bincount(doc, tokens, rows).astype(np.int64)
        lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x)) for x in sums]
        return _rows_of(TREES, [step.column("doc_id"), step.column("text"), pa.array(many.astype(np.int64), mask=null), pa.array(whole, mask=null), *lists])

    return common.map_steps(common.id_text(docs), run, TREES)


def apply_edits(kept: DataFrame, edits: DataFrame | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, n_tokens_edited, n_reencoded: a row for each kept tree.

    edits: (doc_id, edits array<struct<start int, stop int, new string>>), all rows of a doc_id together; by default kept's own column ``edits``.
    """
    rows = kept
    if edits is not None:
        mine = edits.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.flatten(F.collect_list("edits")).alias("edits"))
        rows = kept.join(mine, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    rows = rows.select("doc_id", "text", "n_pretokens", "n_tokens", "chars", "tokens", "edits")

    def run(step: pa.RecordBatch) -> pa.RecordBatch:
        use, edited, again = counter(vocabulary), [], []
        columns = [step.column(c).to_pylist() for c in ("text", "n_tokens", "chars", "tokens", "edits")]
        for text, n, chars, tokens, edits in zip(*columns):
            asked = sorted(((e["start"] or 0, e["stop"] or 0, e["new"] or "") for e in edits or () if e), key=lambda e: e[:2])
            if text is None or not asked:
                edited.append(n)
                again.append(None if text is None else 0)
            elif any(max(a, s) > b for (_, a, _), (b, _, _), (s, _, _) in zip(asked, asked[1:], asked)):
                edited.append(None)
                again.append(0)
            else:
                tree = Tree(text, use, (chars, tokens))
                for start, stop, new in reversed(asked):
                    tree.edit(start, stop, new)
                edited.append(tree.total)
                again.append(tree.reencoded)
        return _rows_of(SCHEMA, [step.column("doc_id"), step.column("n_pretokens"), step.column("n_tokens"), pa.array(edited, pa.int64()), pa.array(again, pa.int64())])

    return common.map_steps(rows, run, SCHEMA)


def count_edits(docs: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The same from documents: their trees are built, written to the shared folder, and the edits applied to what is read back."""
    return apply_edits(common.staged(trees(docs, vocabulary), "token-trees"), edits, vocabulary)


def revised(docs: DataFrame) -> DataFrame:
    """Counts of documents and of a revision of each, from kept trees: a note at the start, a range in the middle replaced, characters near the end deleted."""
    kept = common.staged(trees(docs), "token-trees")
    n = F.length("text")
    edit = lambda a, b, new: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), F.lit(new).alias("new"))
    middle, late = F.floor(n / 2), F.greatest(F.floor(n * 3 / 4) + 24, F.floor(n / 2) + 20)
    listed = F.array(edit(F.lit(0), F.lit(0), "Revised: "), edit(middle, F.least(middle + 20, n), " it's 2024, isn't it? "), edit(F.least(late, n), F.least(late + 10, n), ""))
    return apply_edits(kept.withColumn("edits", listed))
