"""Byte-pair encoding over numpy matrices.

A chunk of texts is one array of code points: character classes give the pieces of the pattern, equal pieces are
encoded once, and distinct pieces of like length stand as rows of a padded matrix.  Every round merges, in every
row, its leftmost pair of minimum rank; pairs are looked up in an open-addressing hash table, and finished rows
leave the matrix.  Pieces too long for a matrix take the same merges from a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import grouped_cells, slices, span_hashes, text_buffer

OTHER, LETTER, NUMBER, SPACE = range(4)
#: The code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
NONE = np.iinfo(np.int32).max
LONGEST_ROW = 192
CACHED_PIECES = 1_000_000
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point."""
    global _classes
    if _classes is None:
        table = np.zeros(0x110000, np.uint8)
        kinds = {"L": LETTER, "N": NUMBER}
        for c in range(0x110000):
            kind = kinds.get(unicodedata.category(chr(c))[0])
            if kind:
                table[c] = kind
        table[WHITE_SPACE] = SPACE
        _classes = table
    return _classes


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts and the offsets of the rows among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return points, heads[offsets]


def _contractions(points: np.ndarray, kind: np.ndarray, at: np.ndarray, end_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the apostrophes `at`, those that begin 's 't 'm 'd 're 've 'll, and the number of letters taken."""
    last = len(points) - 1
    one, two = points[np.minimum(at + 1, last)], points[np.minimum(at + 2, last)]
    has_one, has_two = at + 1 < end_of, at + 2 < end_of
    short = has_one & np.isin(one, [ord(c) for c in "stmd"])
    long = has_two & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    return at[short | long], np.where(short, 1, 2)[short | long]


def pieces(points: np.ndarray, offsets: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every piece.

    spaced: the pattern in which one space belongs to the piece that follows and white space is kept; otherwise the
    pattern that drops white space and takes every number character alone.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[points]
    new_row = np.zeros(n + 1, bool)
    new_row[offsets] = True
    cut = np.ones(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut |= new_row
    runs = cut.copy()
    space = kind == SPACE
    if spaced:
        # the last character of white space before a word stands alone, or goes with the word if it is a space
        final = np.flatnonzero(space[: n - 1] & ~space[1:] & ~new_row[1:n])
        cut[final] = True
        cut[final[points[final] == 0x20] + 1] = False
    else:
        cut[np.flatnonzero(kind == NUMBER)] = True
        cut[np.flatnonzero(kind[: n - 1] == NUMBER) + 1] = True
    quotes = np.flatnonzero((points == 0x27) & cut[:n] & runs[:n])
    if len(quotes):
        end_of = offsets[np.searchsorted(offsets, quotes, "right")]
        at, letters = _contractions(points, kind, quotes, end_of)
        cut[at + 1] = False
        cut[at + 1 + letters] = True
    starts = np.flatnonzero(cut[:n])
    ends = np.append(starts[1:], n)
    if not spaced:
        word = ~space[starts]
        starts, ends = starts[word], ends[word]
    return starts, ends


class Pairs:
    """(left id, right id) -> (rank, merged id), by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        keys, first = np.unique(keys, return_index=True)
        rank, merged = rank[first], merged[first]
        self.mask = np.uint64((1 << int(len(keys) * 3).bit_length()) - 1)
        self.keys = np.full(int(self.mask) + 1, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.rank, self.merged = np.full(len(self.keys), NONE, np.int32), np.zeros(len(self.keys), np.int32)
        slot, left_over = self.slot(keys), np.arange(len(keys))
        while len(left_over):
            at = slot[left_over]
            free = self.keys[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.keys[at[free]] = keys[left_over[free]]  # of several, the last one written has it
            done = self.keys[at] == keys[left_over]
            self.rank[at[done]], self.merged[at[done]] = rank[left_over[done]], merged[left_over[done]]
            left_over = left_over[~done]
            slot[left_over] = (slot[left_over] + np.uint64(1)) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; a pair that does not merge gets a slot of rank NONE."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self.slot(keys)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
            found = self.keys[slot[open_]]
            open_ = open_[(found != keys[open_]) & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return slot


class Known:
    """Hash of a piece -> its number, by open addressing; numbers count up from 0."""

    def __init__(self, most: int):
        self.shift = np.uint64(64 - (most * 2 - 1).bit_length())
        self.slots = 1 << (most * 2 - 1).bit_length()
        self.keys, self.number, self.count = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys, -1 where unknown."""
        slot = (keys >> self.shift).astype(np.int64)
        number = self.number[slot]
        open_ = np.flatnonzero((self.keys[slot] != keys) & (number >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % self.slots
            number[open_] = self.number[slot[open_]]
            open_ = open_[(self.keys[slot[open_]] != keys[open_]) & (number[open_] >= 0)]
        return number

    def add(self, keys: np.ndarray) -> None:
        """New, distinct keys."""
        numbers = np.arange(self.count, self.count + len(keys), dtype=np.int32)
        self.count += len(keys)
        slot = (keys >> self.shift).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = self.number[slot[left]] < 0
            self.number[slot[left[free]]], self.keys[slot[left[free]]] = numbers[left[free]], keys[left[free]]
            left = left[self.number[slot[left]] != numbers[left]]
            slot[left] = (slot[left] + 1) % self.slots


class Encoder:
    """A byte-pair vocabulary.

    spaced: which pattern cuts the text (see pieces).  whole: a piece that is itself a token is not merged.
    first_ids, last_ids: id of each byte, and of each byte that ends a piece.
    """

    def __init__(self, pairs: Pairs, first_ids: np.ndarray, last_ids: np.ndarray, spaced: bool, tokens: dict[bytes, int] | None, token_bytes: list[bytes] | None):
        self.pairs, self.first_ids, self.last_ids, self.spaced, self.tokens = pairs, first_ids, last_ids, spaced, tokens
        if token_bytes is not None:
            self.token_data = np.frombuffer(b"".join(token_bytes), np.uint8)
            self.token_first = np.concatenate([[0], np.cumsum([len(b) for b in token_bytes])])
        self.forget()

    def forget(self) -> None:
        self.known = Known(CACHED_PIECES)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    @classmethod
    def from_ranks(cls, path: str) -> Encoder:
        """A file of lines `base64 rank`; two tokens merge if their concatenation is a token."""
        with open(path, "rb") as file:
            tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        left, right, rank = [], [], []
        for token, r in tokens.items():
            for k in range(1, len(token)):
                a, b = tokens.get(token[:k]), tokens.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        ranks = np.array(rank, np.int32)
        single = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        names = [b""] * (max(tokens.values()) + 1)
        for token, r in tokens.items():
            names[r] = token
        return cls(Pairs(np.array(left), np.array(right), ranks, ranks), single, single, True, tokens, names)

    @classmethod
    def from_merges(cls, path: str) -> Encoder:
        """A tokenizer file with a list of merges over byte characters, the last of a piece marked by a suffix."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        pairs = Pairs(np.array([ids[a] for a, _ in merges]), np.array([ids[b] for _, b in merges]), np.arange(len(merges), dtype=np.int32), np.array([ids[a + b] for a, b in merges], np.int32))
        return cls(pairs, np.array([ids[letters[b]] for b in range(256)], np.int32), np.array([ids[letters[b] + suffix] for b in range(256)], np.int32), False, None, None)

    # -- distinct pieces

    def _start(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
        at = starts[:, None] + np.arange(width)
        inside = np.arange(width) < sizes[:, None]
        ids = np.where(inside, self.first_ids[data[np.minimum(at, len(data) - 1)]], -1)
        ids[np.arange(len(sizes)), sizes - 1] = self.last_ids[data[starts + sizes - 1]]
        return ids

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        ranks = np.full(left.shape, NONE, np.int32)
        real = (left >= 0) & (right >= 0)
        ranks[real] = self.pairs.rank[self.pairs.find(left[real], right[real])]
        return ranks

    def _matrix(self, ids: np.ndarray, sizes: np.ndarray, rows: np.ndarray, out: list) -> None:
        width = ids.shape[1]
        ranks = np.full(ids.shape, NONE, np.int32)
        ranks[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
        columns = np.arange(width)
        while len(rows):
            best = ranks.argmin(axis=1)
            lanes = np.arange(len(rows))
            live = ranks[lanes, best] != NONE
            if not live.all():
                done = ~live
                out.append((rows[done], sizes[done], ids[done]))
                sizes, rows, best = sizes[live], rows[live], best[live]
                if not len(rows):
                    return
                width = int(sizes.max())
                ids, ranks, columns = ids[live, :width], ranks[live, :width], columns[:width]
                lanes = np.arange(len(rows))
            merged = self.pairs.merged[self.pairs.find(ids[lanes, best], ids[lanes, best + 1])]
            # every column right of the merge moves one to the left
            right, last = columns[:-1] > best[:, None], sizes - 1
            np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=right)
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=right)
            ids[lanes, last], ranks[lanes, last] = -1, NONE
            ids[lanes, best] = merged
            sizes = last
            after = np.where(best + 1 < width, ids[lanes, np.minimum(best + 1, width - 1)], -1)
            ranks[lanes, best] = self._ranks(merged, after)
            has_before = np.flatnonzero(best > 0)
            ranks[has_before, best[has_before] - 1] = self._ranks(ids[has_before, best[has_before] - 1], merged[has_before])

    def _heap(self, ids: list[int]) -> list[int]:
        """The same merges for one long piece."""
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        left = np.array(ids[:-1], np.int64)
        slots = self.pairs.find(left, np.array(ids[1:], np.int64))
        heap = [(int(r), k, ids[k], ids[k + 1], int(m)) for k, (r, m) in enumerate(zip(self.pairs.rank[slots], self.pairs.merged[slots], strict=True)) if r != NONE]
        heapq.heapify(heap)

        def push(k: int) -> None:
            slot = int(self.pairs.find(np.array([ids[k]]), np.array([ids[after[k]]]))[0])
            if self.pairs.rank[slot] != NONE:
                heapq.heappush(heap, (int(self.pairs.rank[slot]), k, ids[k], ids[after[k]], int(self.pairs.merged[slot])))

        while heap:
            _, k, a, b, merged = heapq.heappop(heap)
            other = after[k] if k < n and ids[k] == a else n
            if other >= n or ids[other] != b:
                continue
            ids[k], ids[other] = merged, -1
            after[k] = after[other]
            if after[k] < n:
                before[after[k]] = k
                push(k)
            if before[k] >= 0:
                push(before[k])
        return [x for x in ids if x >= 0]

    def encode_distinct(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte strings data[starts:starts+sizes], and where each one's begin."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        left = np.ones(len(starts), bool)
        if self.tokens is not None:
            raw = data.tobytes()
            whole = np.array([self.tokens.get(raw[s : s + k], -1) for s, k in zip(starts.tolist(), sizes.tolist(), strict=True)], np.int32)
            is_token = whole >= 0
            if is_token.any():
                out.append((np.flatnonzero(is_token), np.ones(int(is_token.sum()), np.int64), whole[is_token][:, None]))
            left = ~is_token
        low = 0
        for width in (4, 6, 8, 11, 14, 18, 24, 32, 48, 72, 128, LONGEST_ROW):
            rows = np.flatnonzero(left & (sizes > low) & (sizes <= width))
            step = max(1, (1 << 19) // width)
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                self._matrix(self._start(data, starts[some], sizes[some], width), sizes[some].copy(), some, out)
            low = width
        for row in np.flatnonzero(left & (sizes > low)).tolist():
            ids = self._heap(self._start(data, starts[row : row + 1], sizes[row : row + 1], int(sizes[row]))[0].tolist())
            out.append((np.array([row]), np.array([len(ids)]), np.array([ids], np.int32)))
        counts = np.zeros(len(starts), np.int64)
        for rows, n, _ in out:
            counts[rows] = n
        first = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(int(first[-1]), np.int32)
        for rows, n, matrix in out:
            inside = np.arange(matrix.shape[1]) < n[:, None]
            ids[grouped_cells(first[rows], n)] = matrix[inside]
        return ids, first

    # -- texts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a chunk, one after another, and where each text's begin."""
        points, rows = code_points(data, offsets)
        starts, ends = pieces(points, rows, self.spaced)
        hashes = span_hashes(points, starts, ends)
        place = self.known.find(hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            distinct, example = np.unique(hashes[new], return_index=True)
            if self.known.count + len(distinct) > CACHED_PIECES and self.known.count:
                self.forget()
                new = np.arange(len(hashes))
                distinct, example = np.unique(hashes, return_index=True)
            if len(distinct) > CACHED_PIECES:  # one enormous text
                self.known = Known(len(distinct))
            self._learn(points, starts[new[example]], ends[new[example]], distinct)
            place[new] = self.known.find(hashes[new])
        count = self.first[place + 1] - self.first[place]
        ids = self.ids[grouped_cells(self.first[place], count)]
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, total[np.searchsorted(starts, rows)]

    def _learn(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        sizes = ends - starts
        cells = points[grouped_cells(starts, sizes)]
        data = np.frombuffer(cells.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        width = 1 + (cells > 0x7F).astype(np.int64) + (cells > 0x7FF) + (cells > 0xFFFF)
        total = np.concatenate([[0], np.cumsum(width)])
        edges = total[np.concatenate([[0], np.cumsum(sizes)])]
        ids, first = self.encode_distinct(data, edges[:-1], np.diff(edges))
        self.known.add(hashes)
        self.first = np.concatenate([self.first, self.first[-1] + first[1:]])
        self.ids = np.concatenate([self.ids, ids])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        first = self.token_first[ids]
        return self.token_data[grouped_cells(first, self.token_first[ids + 1] - first)]


def lowered(column: pa.Array) -> pa.Array:
    """NFC and lower case, code point by code point (a final sigma stays an ordinary one)."""
    return pa.array([unicodedata.normalize("NFC", t or "").replace("Σ", "σ").lower() for t in column.to_pylist()], pa.large_string())


_encoders: dict[tuple, Encoder] = {}


def encoder(kind: str, path: str) -> Encoder:
    """One encoder for each Python worker."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = {"ranks": Encoder.from_ranks, "merges": Encoder.from_merges}[kind](path)
    return _encoders[kind, path]


def _encode_rows(path: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder("ranks", path)
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_buffer(part.column("text"))
                ids, first = made.encode(data, offsets)
                raw = ids.astype("<u4").tobytes()
                bounds = (first * 4).tolist()
                columns = [part.column("doc_id"), pa.array(np.diff(first)), pa.array([raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())]
                if decode:
                    back = made.decode(ids)
                    size = np.concatenate([[0], np.cumsum(made.token_first[ids + 1] - made.token_first[ids])])[first].tolist()
                    text = back.tobytes()
                    columns.append(pa.array([text[a:b] for a, b in zip(size, size[1:], strict=False)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    return run


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", decode: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) of every row and, with decode, the bytes of the ids.

    path: a file of byte-level ranks.  A null text is empty and has no ids.  Rows need no shuffle.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encode_rows(path, decode), f"doc_id {kind}, n_tokens long, ids binary" + ", decoded binary" * decode)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
