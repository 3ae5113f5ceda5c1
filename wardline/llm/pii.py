"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, scheme separators, cues such as
"token" or "password" (in any case), groups of four digits, digits after a plus sign or
an opening bracket or on both sides of a separator, and dotted digits. From each anchor a deterministic
parser walks outwards over the characters its kind allows, fixes the boundaries and
validates what it holds: e-mail addresses (local part, domain labels, alphabetic top
level), URLs with credentials, IPv4 addresses (four octets up to 255), payment cards
(13 to 19 digits, Luhn), IBANs (mod 97), social security and telephone numbers, AWS and
other prefixed keys, private-key blocks, and values assigned to a secret's name.

Whole texts are searched. Where findings overlap, the one that begins first is taken,
and of those the longest. ``scan`` replaces each finding by its kind in brackets.

Nulls and the like: a null text stays null with n_pii 0 and empty spans; an empty one
stays empty; offsets count characters of the given text; rows with null or repeated
doc_id are handled each for itself; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wardline.llm import common

Span = tuple[int, int, str]

CUES = ("token", "secret", "passwd", "password", "pwd", "api_key", "apikey", "api-key", "access_key", "private_key", "auth_key")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "xoxp-")

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/@:\"'<>]+:[^\s/@\"'<>]+@[^\s\"'<>]+")
_IPV4 = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_CARD = re.compile(r"\d(?:[ -]?\d){12,18}")
_SSN = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}|\+\d{8,15}|\+\d{1,3}(?:[ .-]\d{2,4}){2,5}")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
_VALUE = re.compile(r"[A-Za-z_-]{0,24}[\"']?\s{0,3}(?:=>|:=|[=:])\s{0,3}([\"']?)([A-Za-z0-9_\-./+=]{8,})\1")
#: Prefixes of keys: the characters that follow, and how many of them at least (16 exactly for the first two).
_BODY = {"AKIA": ("[A-Z0-9]{0,16}", 16), "ASIA": ("[A-Z0-9]{0,16}", 16), "ghp_": ("[A-Za-z0-9]*", 30), "gho_": ("[A-Za-z0-9]*", 30), "sk-": ("[A-Za-z0-9_-]*", 20), "sk_live_": ("[A-Za-z0-9]*", 16), "xoxb-": ("[A-Za-z0-9-]*", 20), "xoxp-": ("[A-Za-z0-9-]*", 20)}
_BODY = {k: (re.compile(c), n) for k, (c, n) in _BODY.items()}
_DOTTED = re.compile(r"[0-9.]*")
_BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.S)
#: Characters that may stand in a written telephone, card or account number.
_RUN = frozenset("0123456789 -.()+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _alone(text: str, a: int, b: int) -> bool:
    """No letter, digit or underscore touches the range."""
    return not (a and (text[a - 1].isalnum() or text[a - 1] == "_")) and not (b < len(text) and (text[b].isalnum() or text[b] == "_"))


def at_sign(text: str, i: int, floor: int) -> Span | None:
    a = i
    while a > floor and text[a - 1] in LOCAL:
        a -= 1
    while a < i and text[a] in ".-%+":
        a += 1
    m = _DOMAIN.match(text, i + 1)
    if a == i or text[i - 1] == "." or ".." in text[a:i] or not m:
        return None
    labels = m.group().split(".")
    end = m.end()
    while len(labels) > 1 and not (labels[-1].isalpha() and len(labels[-1]) >= 2):  # the sentence's next word or a number isn't a top level
        end -= len(labels.pop()) + 1
    return (a, end, "EMAIL") if len(labels) > 1 else None


def scheme(text: str, i: int, floor: int) -> Span | None:
    a = i
    while a > floor and text[a - 1].isascii() and text[a - 1].isalnum():
        a -= 1
    m = _URL.match(text, a)
    return (a, m.end(), "URL") if m else None


def dotted(text: str, i: int, end: int) -> Span | None:
    """The address that the run of digits and dots around i is, if it is one; the run ends at end."""
    a, b = i, end
    while a > max(i - 16, 0) and (text[a - 1] in DIGITS or text[a - 1] == "."):  # an address has 15 characters at most
        a -= 1
    while b > a and text[b - 1] == ".":
        b -= 1
    m = _IPV4.fullmatch(text, a, b)
    return (a, b, "IP") if m and _alone(text, a, b) and all(int(x) < 256 for x in m.group().split(".")) else None


def digit_run(text: str, i: int, floor: int) -> list[Span]:
    """Every number of the run of digits and separators around i."""
    a, b = i, i
    while a > floor and text[a - 1] in _RUN:
        a -= 1
    while b < len(text) and text[b] in _RUN:
        b += 1
    found: list[Span] = []
    s = a
    while s < b:
        if text[s] not in "0123456789(+" or (s > 0 and (text[s - 1].isalnum() or text[s - 1] == "_")):
            s += 1
            continue
        best = None
        for kind, pattern in (("CARD", _CARD), ("SSN", _SSN), ("PHONE", _PHONE)):
            m = pattern.match(text, s, b)
            end = 0 if m is None else card(text, s, m.end()) if kind == "CARD" else m.end()
            if end and _alone(text, s, end) and (best is None or end > best[1]):
                best = (s, end, kind)
        if best:
            found.append(best)
            s = best[1]
        else:
            s += 1
    return found


def card(text: str, s: int, e: int) -> int:
    """The largest end, at e or after a group of digits before it, at which the digits from s are 13 or more and pass Luhn; 0 if none does."""
    even, odd, n, best = 0, 0, 0, 0  # check sums if the digits of even, or of odd, places are doubled
    for i in range(s, e):
        c = text[i]
        if c in DIGITS:
            d = ord(c) - 48
            twice = 2 * d - 9 if d > 4 else 2 * d
            if n & 1:
                even, odd = even + d, odd + twice
            else:
                even, odd = even + twice, odd + d
            n += 1
        elif n >= 13 and (odd if n & 1 else even) % 10 == 0 and text[i - 1] in DIGITS:
            best = i
    return e if n >= 13 and (odd if n & 1 else even) % 10 == 0 and _alone(text, s, e) else best


def account(text: str, i: int, floor: int) -> Span | None:
    a = i
    while a > floor and i - a < 40 and (text[a - 1] == " " or text[a - 1].isascii() and (text[a - 1].isupper() or text[a - 1].isdigit())):
        a -= 1
    for m in _IBAN.finditer(text, a, min(len(text), a + 80)):
        e = m.end()
        while e > m.start() + 14:
            held = text[m.start() : e].replace(" ", "")
            if _alone(text, m.start(), e) and 15 <= len(held) <= 34 and mod97(held):
                return m.start(), e, "IBAN"
            e = text.rfind(" ", m.start(), e)
    return None


def assigned(text: str, i: int) -> tuple[int, int, bool] | None:
    """Where the value assigned after i begins and ends, and whether it has a digit, as secrets do."""
    m = _VALUE.match(text, i)
    return (m.start(2), m.end(2), any(c in DIGITS for c in m.group(2))) if m else None


def secrets(text: str, cues: list[int]) -> list[Span]:
    """The values assigned after cues. A cue within a value that was looked at ends the same value, and is passed over."""
    found, done = [], 0
    for i in cues:
        if i >= done and (got := assigned(text, i)):
            done = got[1]
            if got[2]:
                found.append((got[0], got[1], "SECRET"))
    return found


def run_of(characters: re.Pattern, text: str, i: int, ends: dict[re.Pattern, int]) -> int:
    """The end of the run of characters that holds i. Each run is walked once: ends remembers the last one's end."""
    if i >= ends.get(characters, 0):
        ends[characters] = characters.match(text, i).end()
    return ends[characters]


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("@", ["@"]), ("s", ["://"]), ("d", [f".{d}" for d in range(10)]), ("k", PREFIXES), ("b", ["-----BEGIN "])):
        for x in words:
            found.add_word(x, (kind, len(x)))
    for n in range(10_000):
        found.add_word(f"{n:04d}", ("n", 4))
    for a in range(10):
        found.add_word(f"+{a}", ("n", 2))
        found.add_word(f"({a}", ("n", 2))
        for separator in " -.":
            for b in range(10):
                found.add_word(f"{a}{separator}{b}", ("n", 3))
    found.make_automaton()
    return found


#: Capital letters of the cues; every other character keeps its place and its length.
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _cues() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for x in CUES:
        found.add_word(x, len(x))
    found.make_automaton()
    return found


_held: list[ahocorasick.Automaton] = []


def _folded(text: str) -> str:
    """The text with its ASCII letters in lower case; every character keeps its place."""
    return text.lower() if text.isascii() else text.translate(_FOLD)


def find(text: str) -> list[Span]:
    """The findings of a text as (start, end, kind), in order and without overlap."""
    if not _held:
        _held.extend((_automaton(), _cues()))
    spans = secrets(text, [end + 1 for end, _ in _held[1].iter(_folded(text))])
    run_end, block_end, ends = 0, 0, {}
    for end, (kind, size) in _held[0].iter(text):
        start = end + 1 - size
        got: Span | None = None
        if kind == "@":
            got = at_sign(text, start, 0)
        elif kind == "n":
            if start < run_end:
                continue
            spans += digit_run(text, start, 0)
            run_end = end + 1
            while run_end < len(text) and text[run_end] in _RUN:
                run_end += 1
            got = account(text, start, 0)
        elif kind == "d":
            stop = run_of(_DOTTED, text, start, ends)
            got = dotted(text, start, stop) if stop - start <= 16 else None
        elif kind == "s":
            got = scheme(text, start, 0)
        elif kind == "k":
            characters, least = _BODY[text[start : end + 1]]
            stop = run_of(characters, text, end + 1, ends) if least != 16 or size > 4 else characters.match(text, end + 1).end()
            got = (start, stop, "KEY") if stop - end - 1 >= least and _alone(text, start, stop) else None
        elif start >= block_end:
            m = _BLOCK.match(text, start)
            block_end = m.end() if m else block_end
            got = (start, m.end(), "PRIVATE_KEY") if m else None
        if got:
            spans.append(got)
    if not spans:
        return spans
    spans.sort(key=lambda x: (x[0], -x[1], x[2]))
    kept = spans[:1]
    for x in spans[1:]:
        if x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def redact(text: str, spans: list[Span]) -> str:
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*parts, text[at:]])


SCHEMA = "doc_id long, text string, n_pii long, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text with findings replaced, n_pii, and spans as "KIND:start-end" joined by commas; a row for each document."""

    def run(step: pa.RecordBatch) -> pa.RecordBatch:
        texts = step.column("text").to_pylist()
        spans = [find(t) if t else [] for t in texts]
        if any(spans):
            new = pa.array([redact(t, s) if s else t for t, s in zip(texts, spans)], pa.string())
        else:
            new = step.column("text")
        return pa.RecordBatch.from_arrays(
            [step.column("doc_id"), new.cast(pa.string()), pa.array(np.array([len(s) for s in spans], np.int64)), pa.array([",".join(f"{k}:{a}-{b}" for a, b, k in s) for s in spans], pa.string())],
            ["doc_id", "text", "n_pii", "spans"],
        )

    return common.map_steps(common.id_text(docs), run, SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with findings in text replaced, and n_chars (if there is such a column) the new length where a text changed."""

    def run(step: pa.RecordBatch) -> pa.RecordBatch:
        texts = step.column("text").to_pylist()
        spans = [find(t) if t else [] for t in texts]
        if not any(spans):
            return step
        new = [redact(t, s) if s else t for t, s in zip(texts, spans)]
        columns = list(step.columns)
        columns[step.schema.get_field_index("text")] = pa.array(new, pa.string())
        at = step.schema.get_field_index("n_chars")
        if at >= 0:
            columns[at] = pa.array([len(t) if s else n for t, s, n in zip(new, spans, columns[at].to_pylist())], columns[at].type)
        return pa.RecordBatch.from_arrays(columns, step.schema.names)

    return common.map_steps(docs, run, docs.schema)
