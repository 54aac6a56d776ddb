"""Exact Jaccard join of word n-gram sets by vertical partitioning.

The global order of n-grams is the order of their hashes, cut into fragments.  Sets of like size whose Jaccard
similarity reaches the threshold differ in at most d n-grams; cut into more than d fragments, they agree on whole
fragments, so documents meet where a fragment of one has the same content as that of the other.  Documents that meet
are kept together only if their counts per coarse fragment leave room for the required overlap (the counts' L1
distance is a lower bound of the difference).  The sets of each group that remains are cut into fragments of the
order, and a task has one fragment of one pair of blocks of a group: it counts partial overlaps of all its pairs as
products of 0/1 matrices and sends those that may still reach the threshold; another step sums them per pair and decides.

Equal sets are one class throughout, so copies cost one row; no step lists all pairs of a group as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, bucketed, grouped_cells, mixed, slices, span_hashes, text_buffer, unique_per_row, window_hashes
from .components import components, forest
from .storage import depends, drop, shuffle_buckets, written

COARSE = 6
BLOCK = 1024
PARTS = 4
COLUMNS = 4096
#: n-grams of a pair of blocks that a task compares at once: a group has as many fragments as that takes.
VOLUME = 1 << 19
#: Members of a group of candidates in one row.
PIECE = 1 << 16


class Threshold:
    """Similarity of at least percent / 100, and the size classes and fragment counts that follow from it."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges = [1]
        self.extra: list[int] = []
        self.fragments: list[int] = []

    def difference(self, total):
        """Most n-grams in which two linked sets differ whose sizes sum to total."""
        return total * (100 - self.percent) // (100 + self.percent)

    def linked(self, overlap, size_a, size_b):
        return 100 * overlap >= self.percent * (size_a + size_b - overlap)

    def upto(self, size: int) -> None:
        """Size classes [edges[k], edges[k + 1]) as far as size and one more."""
        while len(self.edges) < 2 or self.edges[-2] <= size:
            low = self.edges[-1]
            self.edges.append(max(low + 1, low * 3 // 2))
            d = self.difference(2 * (self.edges[-1] - 1))
            least, extra = max(1, low * self.percent // 100), 0
            for _ in range(30):  # room for the empty fragments of nearly every set of the class
                mean = (d + 1 + extra) * np.exp(-least / (d + 1 + extra))
                extra = int(np.ceil(mean + 4 * np.sqrt(mean))) if d else 0
            self.extra.append(extra)
            self.fragments.append(d + 1 + extra)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every text, sorted; a text of fewer words has one shingle of all."""
    words = Words(data, offsets, lower=True)
    hashes = words.hashes()
    at, rows = words.windows(size)
    keys = window_hashes(hashes, at, size)
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        rows = np.concatenate([rows, short])
        keys = np.concatenate([keys, span_hashes(hashes, words.first[short], words.first[short + 1])])
    return unique_per_row(rows, keys)


def fingerprints(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of shingles of every row and a hash of its set, as signed 64-bit."""
    first = np.searchsorted(rows, np.arange(n + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(keys ^ np.uint64(0x5851F42D4C957F2D)))])
    size = np.diff(first)
    return size, mixed(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64)).view(np.int64)


def outline_bits(size: np.ndarray) -> np.ndarray:
    """Binary logarithm of the number of coarse fragments: no more than 8 n-grams in each on average, so that the
    counts of unrelated long sets differ by more than a link allows."""
    return np.maximum(COARSE, np.ceil(np.log2(np.maximum(size, 1) / 8)).astype(np.int64))


def _outlines(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n = part.num_rows
                rows, keys = shingle_sets(*text_buffer(part.column("text")), size)
                count, print_ = fingerprints(rows, keys, n)
                bits = outline_bits(count)
                at = np.concatenate([[0], np.cumsum(1 << bits)])
                cell = (keys >> (64 - bits[rows]).astype(np.uint64)).astype(np.int64)
                outline = np.minimum(np.bincount(at[rows] + cell, minlength=at[-1]), 65535).astype("<u2")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(count, pa.int64()), pa.array(print_), pa.array([outline[at[k] : at[k + 1]].tobytes() for k in range(n)], pa.binary())], names=["doc_id", "text_hash", "n", "print", "outline"])

    return run


def _fragment_keys(rows: np.ndarray, keys: np.ndarray, size: np.ndarray, limit: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each whole fragment of each row, in its own size class and, where it reaches, the next."""
    out_rows, out_keys = [], []
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(keys + np.uint64(0x2545F4914F6CDD1D)))])
    first = np.concatenate([[0], np.cumsum(size)])
    limit.upto(int(size.max()) if len(size) else 1)
    edges = np.array(limit.edges)
    own = np.searchsorted(edges, size, "right") - 1
    for ahead in (0, 1):
        level = own + ahead
        some = size > 0
        if ahead:
            some &= size * 100 >= limit.percent * edges[np.minimum(level, len(edges) - 1)]
        for k in np.unique(level[some]).tolist():
            chosen = np.flatnonzero(some & (level == k))
            n = limit.fragments[k]
            cells = grouped_cells(first[chosen], size[chosen])
            row = np.repeat(np.arange(len(chosen)), size[chosen])
            fragment = ((keys[cells] >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
            slot = row * n + fragment
            start = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            end = np.append(start[1:], len(slot))
            content = total[cells[end - 1] + 1] - total[cells[start]]
            level_tag = np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            tag = level_tag + fragment[start].astype(np.uint64)
            out_rows.append(chosen[row[start]])
            out_keys.append(mixed(mixed(tag) ^ content + (end - start).astype(np.uint64)))
            filled = np.bincount(row[start], minlength=len(chosen))
            for thin in np.flatnonzero(n - filled > limit.extra[k]).tolist():  # too many empty fragments: they count too
                empty = np.setdiff1d(np.arange(n), fragment[start[row[start] == thin]])
                out_rows.append(np.full(len(empty), chosen[thin]))
                out_keys.append(mixed(mixed(level_tag + empty.astype(np.uint64)) ^ np.uint64(0x1234567)))
    return (np.concatenate(out_rows), np.concatenate(out_keys)) if out_rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _keys(size: int, percent: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit, seen = Threshold(percent), set()
        for batch in batches:
            for part in slices(batch):
                rows, keys = shingle_sets(*text_buffer(part.column("text")), size)
                count, print_ = fingerprints(rows, keys, part.num_rows)
                if len(seen) > 1_000_000:
                    seen.clear()
                fresh = np.zeros(part.num_rows, bool)
                for k, x in enumerate(print_.tolist()):
                    fresh[k] = x not in seen
                    seen.add(x)
                keep = fresh[rows]
                row, key = _fragment_keys(rows[keep], keys[keep], np.where(fresh, count, 0), limit)
                made = list(bucketed((key % np.uint64(buckets)).astype(np.int64), [key, print_[row]]))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int32()), pa.array([c[0] for _, c in made], pa.binary()), pa.array([c[1] for _, c in made], pa.binary())], names=["bucket", "keys", "prints"])

    return run


def _meetings(piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of classes that share a fragment: a hash of the members, their number, and the members."""
        keys, prints = [], []
        for batch in batches:
            keys += [np.frombuffer(b, np.uint64) for b in batch.column("keys").to_pylist()]
            prints += [np.frombuffer(b, np.int64) for b in batch.column("prints").to_pylist()]
        if not keys:
            return
        key, print_ = np.concatenate(keys), np.concatenate(prints)
        del keys, prints
        order = np.argsort(key)
        key, print_ = key[order], print_[order]
        shared = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        key, print_ = key[shared], print_[shared]
        order = np.lexsort((print_, key))
        key, print_ = key[order], print_[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (print_[1:] != print_[:-1])
        key, print_ = key[new], print_[new]
        if not len(key):
            return
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(print_.view(np.uint64)))])
        group = mixed(total[start + size] - total[start] + size.astype(np.uint64))
        _, one = np.unique(group, return_index=True)
        one = one[size[one] > 1]
        # a large group is several rows, none of which has more members than piece
        for k in range(0, len(one), 5000):
            cuts = [(g, n, s, at) for g, n, s in zip(group[one[k : k + 5000]].view(np.int64).tolist(), size[one[k : k + 5000]].tolist(), start[one[k : k + 5000]].tolist(), strict=True) for at in range(0, n, piece)]
            for j in range(0, len(cuts), 5000):
                some = cuts[j : j + 5000]
                yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in some], pa.int64()), pa.array([c[1] for c in some], pa.int64()), pa.array([c[3] for c in some], pa.int64()), pa.array([print_[s + at : min(s + n, s + at + piece)].tobytes() for _, n, s, at in some], pa.binary())], names=["meeting", "size", "first", "members"])

    return run


def _members(block: int):
    """A row for each member and each pair of blocks that it takes part in, a few thousand at once; every two members of a
    group stand together in one pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["meeting", "low", "high", "print"]
        out: list[tuple[np.ndarray, ...]] = []
        held = 0

        def made() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=names)

        for batch in batches:
            for meeting, size, first, blob in zip(*(batch.column(c).to_pylist() for c in ("meeting", "size", "first", "members")), strict=True):
                member = np.frombuffer(blob, np.int64)
                of = (first + np.arange(len(member))) // block
                for other in range(-(-size // block)):
                    out.append((np.full(len(member), meeting), np.minimum(of, other), np.maximum(of, other), member))
                    held += len(member)
                    if held > 1 << 16:
                        yield made()
                        out, held = [], 0
        if out:
            yield made()

    return run


def _keyed(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """Groups of rows that stand together in a sorted partition: the key and the columns as lists."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in keys), *(batch.column(c).to_pylist() for c in columns), strict=True)

    for key, group in groupby(rows(), key=lambda r: r[: len(keys)]):
        yield key, [list(c) for c in list(zip(*group, strict=True))[len(keys) :]]


def _close(percent: int):
    """Edges between members of a meeting whose outlines leave room for a link: a forest for each task."""
    limit = Threshold(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        held = 0

        def made() -> pa.RecordBatch:
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            nodes, index = np.unique(pairs, return_inverse=True)
            index = index.reshape(-1, 2)
            root = forest(index[:, 0], index[:, 1], len(nodes))
            tied = np.flatnonzero(root != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], names=["a", "b"])

        for _, (prints, sizes, outlines) in _keyed(batches, ["meeting", "low", "high"], ["print", "n", "outline"]):
            print_, n = np.array(prints), np.array(sizes)
            order = np.argsort(n, kind="stable")
            print_, n = print_[order], n[order]
            bits = outline_bits(n)
            levels = {v: np.flatnonzero(bits == v) for v in np.unique(bits).tolist()}  # runs of rows, as n is sorted
            cells = {(v, v): np.frombuffer(b"".join([outlines[k] for k in order[at].tolist()]), "<u2").reshape(len(at), 1 << v) for v, at in levels.items()}
            tied = np.zeros(len(n), bool)
            for k in range(len(n) - 1):
                last, own, near = np.searchsorted(n, n[k] * 100 // percent, "right"), int(bits[k]), []
                mine = cells[own, own][k - levels[own][0]].astype(np.int32)
                for v, at in levels.items():
                    lo, hi = max(k + 1, int(at[0])), min(last, int(at[-1]) + 1)
                    if hi > lo and (v, own) not in cells:  # finer outlines add up to coarser ones
                        cells[v, own] = cells[v, v].reshape(len(at), 1 << own, -1).sum(axis=2, dtype=np.int32)
                    step = max(1, 1 << 20 >> own)
                    for some in range(lo, hi, step):
                        end = min(hi, some + step)
                        distance = np.abs(cells[v, own][some - at[0] : end - at[0]] - mine).sum(axis=1)
                        near.append(some + np.flatnonzero(distance <= limit.difference(n[k] + n[some:end])))
                near = np.concatenate(near) if near else np.zeros(0, np.int64)
                if len(near):
                    found.append(np.column_stack([np.full(len(near), print_[k]), print_[near]]))
                    held += len(near)
                    tied[near] = True
            if held > 500_000:
                batch = made()
                found, held = [np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])], batch.num_rows
        yield made()

    return run


def _sets(size: int):
    """Sets of class representatives, a row for each fragment of the order in which they have an n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = ("grp", "part", "blocks", "print", "copies", "n")
        for batch in batches:
            for part in slices(batch):
                rows, keys = shingle_sets(*text_buffer(part.column("text")), size)
                fragments = part.column("fragments").to_numpy()
                fragment = ((keys >> np.uint64(32)) * fragments[rows].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                start = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (fragment[1:] != fragment[:-1])])) if len(rows) else rows
                end = np.append(start[1:], len(rows))
                taken, raw = pa.array(rows[start]), keys.tobytes()
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(taken) for c in carried), pa.array(fragment[start], pa.int32()), pa.array([raw[8 * i : 8 * j] for i, j in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())], names=[*carried, "fragment", "grams"])

    return run


def packed_sets(about: np.ndarray, sets: list[np.ndarray]) -> bytes:
    """Sets that have much in common, compressed: their n-grams once, the most frequent first, and each set as the
    steps between the places of its n-grams in that list.  about: (sets, 3) integers that go along."""
    size = np.array([len(s) for s in sets], np.int64)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = np.repeat(np.arange(len(sets)), size)
    place = place[column]
    place = place[np.lexsort((place, row))]
    step = np.diff(place, prepend=0)
    starts = np.cumsum(size) - size
    step[starts] = place[starts]
    return squeezed(np.array([len(sets), len(values)], np.int64), about.astype(np.int64), size, values[order], step.astype("<u4"))


def squeezed(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def expanded(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


def unpacked_sets(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What went along, sizes, and the n-grams of the sets one after another."""
    raw = expanded(blob)
    n, distinct = np.frombuffer(raw, np.int64, 2).tolist()
    about, size = np.frombuffer(raw, np.int64, 3 * n, 16).reshape(n, 3), np.frombuffer(raw, np.int64, n, 16 + 24 * n)
    values = np.frombuffer(raw, np.uint64, distinct, 16 + 32 * n)
    step = np.frombuffer(raw, "<u4", -1, 16 + 32 * n + 8 * distinct).astype(np.int64)
    total = np.cumsum(step)
    starts = np.cumsum(size) - size
    return about, size, values[total - np.repeat(total[starts] - step[starts], size)]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A fragment of a part of a block as one row for each pair of blocks that it takes part in."""
    kinds = {"grp": pa.int64(), "fragment": pa.int32(), "low": pa.int32(), "high": pa.int32(), "block": pa.int32(), "packed": pa.binary()}
    out: list[tuple] = []
    held = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))

    for (grp, fragment, part), (blocks, prints, copies, sizes, blobs) in _keyed(batches, ["grp", "fragment", "part"], ["blocks", "print", "copies", "n", "grams"]):
        rows = list({x: k for k, x in enumerate(prints)}.values())
        about = np.column_stack([prints, copies, sizes])[rows]
        blob = packed_sets(about, [np.frombuffer(blobs[k], np.uint64) for k in rows])
        block = part // PARTS
        for other in range(blocks[0]):
            out.append((grp, fragment, min(block, other), max(block, other), block, blob))
            held += len(blob) + 100
            if held > 4 << 20:
                yield made()
                out, held = [], 0
    yield made()


def overlaps(first: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Overlap of every two sets: products of 0/1 matrices, one for each step through the order, summed per pair."""
    values, column, count = np.unique(grams, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    rows, column = rows[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    sums = np.zeros((len(first) - 1, len(first) - 1), np.float32)
    for low in range(0, int((count > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [low, low + COLUMNS])
        matrix = np.zeros((len(first) - 1, min(COLUMNS, int((count > 1).sum()) - low)), np.float32)
        matrix[rows[lo:hi], column[lo:hi] - low] = 1
        sums += matrix @ matrix.T
    return sums.astype(np.int64)


def _partial(percent: int):
    """Partial overlaps of the pairs of a fragment.  A pair stays out if its sizes, or its difference in this fragment
    alone, already exclude a link: then it has too small a sum, or none."""
    limit = Threshold(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp, _, low, high), (blocks, blobs) in _keyed(batches, ["grp", "fragment", "low", "high"], ["block", "packed"]):
            parts = [unpacked_sets(x) for x in blobs]
            about, size, grams = (np.concatenate(x) for x in zip(*parts, strict=True))
            block = np.repeat(blocks, [len(p[0]) for p in parts])
            overlap = overlaps(np.concatenate([[0], np.cumsum(size)]), grams)
            n = about[:, 2]
            least, most = np.minimum(n[:, None], n), np.maximum(n[:, None], n)
            stays = (overlap > 0) & (100 * least >= percent * most) & (size[:, None] + size - 2 * overlap <= limit.difference(n[:, None] + n))
            if low != high:
                stays &= block[:, None] != block
            u, v = np.nonzero(np.triu(stays, 1))
            if len(u):
                used, index = np.unique(np.concatenate([u, v]), return_inverse=True)
                index = index.reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([low], pa.int32()), pa.array([high], pa.int32()), pa.array([squeezed(np.array([len(used), len(u)], np.int64), about[used], index.astype("<u4"), overlap[u, v].astype("<u4"))], pa.binary())], names=["grp", "low", "high", "partial"])

    return run


def _links(percent: int):
    """Sums of partial overlaps per pair of a pair of blocks: a forest of the links, and the links of each class."""
    limit = Threshold(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (blobs,) in _keyed(batches, ["grp", "low", "high"], ["partial"]):
            told, pairs, counts = [], [], []
            for blob in blobs:
                raw = expanded(blob)
                n, m = np.frombuffer(raw, np.int64, 2).tolist()
                about = np.frombuffer(raw, np.int64, 3 * n, 16).reshape(n, 3)
                u, v = np.frombuffer(raw, "<u4", 2 * m, 16 + 24 * n).reshape(2, m)
                told.append(about)
                pairs.append(about[:, 0][np.stack([u, v])])
                counts.append(np.frombuffer(raw, "<u4", m, 16 + 24 * n + 8 * m))
            print_, one = np.unique(np.concatenate(told)[:, 0], return_index=True)
            copies, size = np.concatenate(told)[one][:, 1], np.concatenate(told)[one][:, 2]
            index = np.sort(np.searchsorted(print_, np.concatenate(pairs, axis=1)), axis=0)
            key, of = np.unique(index[0] * len(print_) + index[1], return_inverse=True)
            overlap = np.bincount(of, np.concatenate(counts)).astype(np.int64)
            u, v = key // len(print_), key % len(print_)
            linked = limit.linked(overlap, size[u], size[v])
            u, v = u[linked], v[linked]
            root = forest(u, v, len(print_))
            tied = np.flatnonzero(root != np.arange(len(print_)))
            total = np.bincount(u, copies[v], len(print_)).astype(np.int64) + np.bincount(v, copies[u], len(print_)).astype(np.int64)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([print_[tied], print_[some]])), pa.array([*print_[root[tied]].tolist(), *[None] * len(some)], pa.int64()), pa.array(np.concatenate([np.zeros(len(tied), np.int64), total[some]]))], names=["a", "b", "links"])

    return run


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text", keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of docs; with keys also text_hash (xxhash64 of the text)
    and component (a number of the component, null for an empty set).

    Sets of distinct `words`-word shingles, A-Z lower-cased; a text of fewer words is one shingle, and one without
    words is empty and linked with nothing. Linked: 100 * intersection >= percent * union.  component_id: the smallest
    id reachable by links, the row's own included; n_links: how many other rows it links with.  A null text is empty.
    A row with a null id links like any other and gives no component its id; rows may repeat, ids too.  An empty table
    gives no rows.  A long text is a chunk of its own and needs some thirty times its size in memory.
    Shingles and sets are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    buckets = shuffle_buckets(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    info = written(rows.mapInArrow(_outlines(words), "doc_id long, text_hash long, n long, print long, outline binary"), "outlines")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = info.where("n > 0").groupBy("print").agg(one.alias("one"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("outline").alias("outline"))
    classes = written(classes.select("print", "one.doc_id", "one.text_hash", "copies", "n", "outline"), "classes")

    made = rows.mapInArrow(_keys(words, percent, buckets), "bucket int, keys binary, prints binary")
    meetings = made.repartitionById(buckets, F.col("bucket")).mapInArrow(_meetings(PIECE), "meeting long, size long, first long, members binary")
    meetings = written(meetings.groupBy("meeting", "first").agg(F.first("size").alias("size"), F.first("members").alias("members")), "meetings")
    members = meetings.mapInArrow(_members(4 * BLOCK), "meeting long, low int, high int, print long").join(classes.select("print", "n", "outline"), "print")
    close = members.repartition(buckets, "meeting", "low", "high").sortWithinPartitions("meeting", "low", "high").mapInArrow(_close(percent), "a long, b long")
    groups = components(close)
    drop(meetings)

    near = groups.select(F.col("node").alias("print"), "root").union(groups.select(F.col("root").alias("print"), "root").distinct())
    near = classes.drop("outline").join(near, "print").select("doc_id", "text_hash", "print", "copies", F.col("root").alias("grp"), "n")
    count = near.groupBy("grp").agg(F.count("*").alias("members"), F.sum("n").alias("grams"))
    parts, blocks = F.ceil(F.col("members") / (BLOCK // PARTS)).cast("int"), F.ceil(F.col("parts") / PARTS).cast("int")
    near = near.join(count, "grp").withColumn("parts", parts).withColumn("blocks", blocks)
    # as many fragments as a pair of blocks needs
    near = near.withColumn("fragments", F.greatest(F.lit(1), F.ceil(F.col("grams") * F.least(F.lit(2), F.col("blocks")) / F.col("blocks") / VOLUME)).cast("int"))
    near = written(near.select("doc_id", "text_hash", "grp", "print", "copies", "n", "fragments", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int").alias("part"), "blocks"), "near")
    # equal rows have the same key, and one of them is enough (see _packed); the join shuffles at every size
    key = lambda df: df.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    texts = key(rows).hint("merge").join(key(near).drop("doc_id"), ["id", "text_hash"])
    kinds = "grp long, part int, blocks int, print long, copies long, n long, fragment int, grams binary"
    sets = texts.mapInArrow(_sets(words), kinds)
    order = ["grp", "fragment", "part"]
    made = sets.repartition(buckets, *order).sortWithinPartitions(*order).mapInArrow(_packed, "grp long, fragment int, low int, high int, block int, packed binary")
    order = ["grp", "fragment", "low", "high"]
    partial = made.repartition(buckets, *order).sortWithinPartitions(*order).mapInArrow(_partial(percent), "grp long, low int, high int, partial binary")
    order = ["grp", "low", "high"]
    found = written(partial.repartition(buckets, *order).sortWithinPartitions(*order).mapInArrow(_links(percent), "a long, b long, links long"), "links")
    drop(groups, near)

    linked = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("print")).agg(F.sum("links").alias("links"))
    rooted = classes.select("print", "doc_id", "copies").join(linked.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = rooted.join(least, "root").join(links, "print", "left").select("print", F.col("root").alias("component"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    labels = written(labels, "labels")
    drop(classes, found, linked)
    out = info.drop("outline").join(labels, "print", "left")
    some = F.col("n") > 0
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), "text_hash", F.when(some, F.col("component")).alias("component"))
    return depends(out if keys else out.drop("text_hash", "component"), info, labels)
