"""Secrets in text: fixed patterns, and values in credential context that would take many guesses.

The guess cost of a value is the least total over its segmentations into words, dates, repeats, keyboard walks or
runs, and brute-force spans, in bits, by dynamic programming.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Names before a value that may be a credential, and credentials in an address.
CONTEXT = re.compile(r"""\b(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|bearer|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credentials?)["']?[ \t]*(?::=|=>|->|[:=])[ \t]*["']?([^\s"'<>]{8,})|://[^\s/:@]+:([^\s/@]{8,})@""", re.IGNORECASE | re.ASCII)
HINTS = ("pass", "pwd", "secret", "token", "bearer", "key", "auth", "credential")
#: Common parts of passwords, the most common first.
WORDS = "password the admin letmein welcome login monkey dragon master qwerty football baseball shadow sunshine princess iloveyou trustno michael superman batman hello freedom whatever charlie secret summer winter spring autumn flower love test user root pass changeme default example your key token none null true false string value here insert placeholder".split()
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("4@301!5$7", "aaeoiisst")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
_RANK = {w: k + 1 for k, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))
#: More than a word or a date is long.
NEAR = 12


def _steps() -> set[str]:
    """Pairs of neighbours on a row, either way."""
    return {p for row in ROWS for a, b in zip(row, row[1:], strict=False) for p in (a + b, b + a)}


_STEPS = _steps()


def _letters(value: str) -> float:
    """Bits of a character, from the kinds that the value uses."""
    size = 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value) + 10 * any("0" <= c <= "9" for c in value) + 32 * any(c.isascii() and not c.isalnum() for c in value) + 100 * any(not c.isascii() for c in value)
    return math.log2(max(size, 2))


def _runs(n: int, joined) -> tuple[list[int], list[int]]:
    """First place and end of the longest run around every place; joined(k): whether k - 1 and k are in one."""
    first, end = list(range(n)), list(range(1, n + 1))
    for k in range(1, n):
        if joined(k):
            first[k] = first[k - 1]
    for k in reversed(range(n - 1)):
        if first[k + 1] == first[k]:
            end[k] = end[k + 1]
    return first, end


def guess_bits(value: str, enough: float = math.inf) -> float:
    """log2 of the guesses that the cheapest segmentation needs; stops with a lower bound that is at least enough.

    A repeat or walk is worth no break inside: two of them cost more than one, and so does anything between them.  So
    it begins within NEAR places of its longest run's start and ends within NEAR of that run's end, where a word or a
    date may reach into it, and the steps are linear in the length.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # a few letters have two in lower case
        low = "".join(c.lower()[0] for c in value)
    plain, bits = low.translate(LEET), _letters(value)
    best = [0.0] + [math.inf] * n
    same = _runs(n, lambda k: value[k] == value[k - 1])
    walk = _runs(n, lambda k: low[k - 1 : k + 1] in _STEPS)
    reach = 1
    for i in range(n):
        here = best[i]
        if i % 32 == 0 and reach - i <= 64 and min(best[i : reach + 1]) >= enough:
            return min(best[i : reach + 1])  # every segmentation passes one of these places
        best[i + 1] = min(best[i + 1], here + bits)
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            rank = _RANK.get(low[i:j]) or _RANK.get(plain[i:j])
            if rank:
                turned = 1.0 * (value[i:j] != low[i:j]) + 1.0 * (low[i:j] not in _RANK)
                best[j] = min(best[j], here + 1 + math.log2(rank + 1) + turned)
                reach = max(reach, j)
        if m := DATE.match(value, i):
            best[m.end()] = min(best[m.end()], here + 1 + math.log2(366 * 120))
            reach = max(reach, m.end())
        for (first, end), cost in ((same, bits), (walk, 6)):
            if i - first[i] <= NEAR and end[i] - i >= 3:
                for j in range(max(i + 3, end[i] - NEAR), end[i] + 1):
                    best[j] = min(best[j], here + cost + math.log2(j - i))
                reach = max(reach, end[i])
        reach = max(reach, i + 2)
    return best[n]


def spans(text: str, least_bits: float = 45.0) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start and then kind as listed; base spans first found stay whatever the method says."""
    low = text.lower()
    found: list[tuple[int, int, str]] = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "://" in text or any(h in low for h in HINTS):
        base = frozenset(found)
        for m in CONTEXT.finditer(text):
            k = 1 if m[1] is not None else 2
            value = m[k].rstrip(".,;:)]}")
            start, end = m.start(k), m.start(k) + len(value)
            if len(value) < 8 or any(s <= start and end <= e for s, e, _ in base):
                continue
            if guess_bits(value, least_bits) >= least_bits:
                found.append((start, end, "guess"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _scan(least_bits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in spans(t or "", least_bits)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, kind)], names=["row", "found"])

    return run


def clean(text: str, least_bits: float = 45.0) -> str:
    """The text with every span replaced by <kind>; overlapping spans, together, by the first of them."""
    out, at = [], 0
    for start, end, kind in spans(text, least_bits):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _clean(least_bits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else clean(t, least_bits) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return run


def scanned(docs: DataFrame, least_bits: float = 45.0, text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """struct row (the columns in carry, by default all) and found: array of (start, end, kind) in code points.

    Kinds assign, access and hex are fixed patterns; guess is a whole value in credential context of at least
    least_bits, unless one of those covers all of it; it may overlap them.  A null or empty text has none; rows may repeat, and a
    text of any length is read whole.  Rows need no shuffle.
    """
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)]).alias("row"), F.col(text_column).cast("string").alias("text"))
    schema = StructType([StructField("row", rows.schema["row"].dataType), *_parse_datatype_string("found array<struct<start:long,end:long,kind:string>>").fields])
    return rows.mapInArrow(_scan(least_bits), schema)


def redacted(docs: DataFrame, least_bits: float = 45.0, text_column: str = "text") -> DataFrame:
    """docs with every span of the text replaced by <kind>; overlapping spans, together, by the first of them.

    A null text stays null; rows may repeat, a text of any length is read whole, and an empty table gives no rows.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    others = [c for c in docs.columns if c != text_column]
    row = F.struct(*([F.col(f"`{c}`") for c in others] or [F.lit(None).cast("int").alias("nothing")])).alias("row")
    rows = docs.select(row, F.col(f"`{text_column}`").cast("string").alias("text"))
    made = rows.mapInArrow(_clean(least_bits), StructType([rows.schema["row"], StructField("text", StringType())]))
    return made.select(*[F.col("text").alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
