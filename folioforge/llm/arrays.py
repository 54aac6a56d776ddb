"""Texts as numpy arrays: words, hashes and packed rows of a whole Arrow batch at once.

A word is ``[^\\x20\\x09-\\x0D]+``.  Those separators are ASCII, so words are cut on UTF-8 bytes without decoding.
Hashes are 64-bit polynomials over the bytes (or over the hashes of words), computed from one running sum, and
then mixed; equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 3 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Odd multipliers of the polynomials, first and second hash.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """multiplier**i and its inverse modulo 2**64, for i < n at least."""
    have = _powers.get(multiplier)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(multiplier, -1, 1 << 64)
        with np.errstate(over="ignore"):
            have = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, m, np.uint64)])) for m in (multiplier, inverse))
        _powers[multiplier] = have
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, multiplier: int = MULTIPLIERS[0]) -> np.ndarray:
    """Hash of values[starts[i]:ends[i]] for every i."""
    power, inverse = powers(multiplier, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] if len(offsets) else 0 : offsets[-1] if len(offsets) else 0]
    return data, offsets - (offsets[0] if len(offsets) else 0)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of text; a longer text makes a piece of its own."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """Words of a batch of texts.

    starts, ends: byte positions; first[i]: index of row i's first word, first[-1] the number of all words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = (_LOWER[data] if lower else data), offsets
        n = len(data)
        space = _SPACE[data]
        before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
        before[1:n] = space[: n - 1] if n else False
        after[: n - 1 if n else 0] = space[1:]
        before[offsets[:-1]] = True
        after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
        if n:
            after[n - 1] = True
        self.starts = np.flatnonzero(~space & before[:n])
        self.ends = np.flatnonzero(~space & after[:n]) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.rows = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self, multiplier: int = MULTIPLIERS[0]) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, multiplier)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word of every window of `size` words inside one row, and the row."""
        n = len(self.starts)
        at = np.arange(max(0, n - size + 1))
        inside = self.rows[at] == self.rows[at + size - 1] if len(at) else np.zeros(0, bool)
        at = at[inside]
        return at, self.rows[at]


def window_hashes(word_hashes: np.ndarray, at: np.ndarray, size: int, multiplier: int = MULTIPLIERS[0]) -> np.ndarray:
    return span_hashes(word_hashes, at, at + size, multiplier)


def unique_per_row(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key), sorted by row and then key."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[new], keys[new]


def bucketed(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """For every bucket that occurs, the bytes of each column's values that belong there."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
        if hi > lo:
            yield int(bucket[lo]), [c[lo:hi].tobytes() for c in columns]


def grouped_cells(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices first[i], first[i]+1, ... first[i]+count[i]-1 for every i, one after another."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(count) - count
    return np.arange(total) - np.repeat(at - first, count)
