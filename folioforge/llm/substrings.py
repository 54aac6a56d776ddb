"""Repeated word passages by a compacted token de Bruijn graph.

A window of `size` words is an edge from its first size - 1 words to its last.  Consecutive edges of a document that share
their minimizer (the inner k-mer of least hash) are compacted into one path.  A minimizer all of whose occurrences have
the same path does not branch: the earliest source of the path is that of each of its edges, so no edge is looked at.
Of a minimizer that branches, only the earliest source of each different path is taken apart into edges, and these are
compared by two hashes.  Paths and edges are dealt and grouped by Spark, and what is decided about a source goes back to
its document by a Spark join on coordinates.  The earliest source of an edge stays, and words under any later one go.

A path that repeats within a task leaves it once, at its earliest source: later ones are decided there and then.  So a
passage in a third of all documents is a few rows, and copies of a document never reach the comparison of edges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import MULTIPLIERS, Words, bucketed, grouped_cells, mixed, slices, span_hashes, text_buffer, window_hashes
from .storage import shuffle_buckets, written

INNER = 8
#: Paths that a task remembers as repeated; beyond it keeps those it met again since.
HOT = 500_000

_PATH = np.dtype([("hash", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("print", "<u4"), ("place", "<i4"), ("count", "<u2")])
_SPAN = np.dtype([("doc", "<i8"), ("print", "<u4"), ("place", "<i4"), ("count", "<u2"), ("open", "u1")])
_PART = np.dtype([("place", "<i4"), ("count", "<u2"), ("open", "u1")])
FLOW = "bucket int, spans binary, rows binary"
TOLD = "bucket int, spans binary"


def paths(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every path: hash of its minimizer, hash of all its words, its first word and its number of windows."""
    at, _ = words.windows(size)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), at, at
    inner = min(INNER, size)
    grams = window_hashes(hashes, np.arange(len(hashes) - inner + 1), inner)
    best, where = grams[at], np.zeros(len(at), np.int64)
    for step in range(1, size - inner + 1):
        other = grams[at + step]
        less = other < best
        best = np.where(less, other, best)
        where[less] = step
    where += at
    start = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    count = np.diff(np.append(start, len(at)))
    first = at[start]
    return grams[where[start]], span_hashes(hashes, first, first + count + size - 1), first, count


def _spans(rows: np.ndarray, opened: bool) -> np.ndarray:
    told = np.zeros(len(rows), _SPAN)
    for c in ("doc", "print", "place", "count"):
        told[c] = rows[c]
    told["open"] = opened
    return told


def _by_document(told: np.ndarray, buckets: int) -> list[tuple[int, list[bytes]]]:
    return list(bucketed((mixed(told["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), [told]))


def _flow(told: np.ndarray, sent: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Decided spans, by document, and records still to be compared, by hash: a row for each bucket of either."""
    spans, rows = _by_document(told, buckets), list(bucketed((sent["hash"] % np.uint64(buckets)).astype(np.int64), [sent]))
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in spans] + [b for b, _ in rows], pa.int32()), pa.array([c[0] for _, c in spans] + [None] * len(rows), pa.binary()), pa.array([None] * len(spans) + [c[0] for _, c in rows], pa.binary())], names=["bucket", "spans", "rows"])


def _told(told: np.ndarray, buckets: int) -> pa.RecordBatch:
    made = _by_document(told, buckets)
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int32()), pa.array([c[0] for _, c in made], pa.binary())], names=["bucket", "spans"])


def _ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by hash, check and source; the first row of each (hash, check); which rows have a later source than it."""
    rows = rows[np.lexsort((rows["place"], rows["doc"], rows["check"], rows["hash"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["hash"][1:] != rows["hash"][:-1]) | (rows["check"][1:] != rows["check"][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0)) if len(rows) else np.zeros(0, np.int64)
    return rows, head, (rows["doc"] > rows["doc"][head]) | (rows["place"] > rows["place"][head])


def _records(part: pa.RecordBatch, words: Words, first: np.ndarray, count, hash_: np.ndarray, check: np.ndarray) -> np.ndarray:
    ids, prints = part.column("doc_id").to_numpy(), part.column("print").to_numpy()
    row = words.rows[first]
    made = np.zeros(len(first), _PATH)
    made["hash"], made["check"], made["doc"], made["print"] = hash_, check, ids[row], prints[row].astype(np.uint64) & np.uint64(0xFFFFFFFF)
    made["place"], made["count"] = first - words.first[row], count
    return made


class Repeated:
    """Paths that repeated in this task, at the earliest source so far."""

    def __init__(self):
        self.rows, self.met = np.zeros(0, _PATH), np.zeros(0, bool)

    def later(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.rows):
            return np.zeros(len(rows), bool)
        near = np.minimum(np.searchsorted(self.rows["hash"], rows["hash"]), len(self.rows) - 1)
        known = self.rows[near]
        same = (known["hash"] == rows["hash"]) & (known["check"] == rows["check"])
        self.met[near[same]] = True
        return same & ((rows["doc"] > known["doc"]) | (rows["doc"] == known["doc"]) & (rows["place"] > known["place"]))

    def add(self, rows: np.ndarray) -> None:
        if len(self.rows) + len(rows) > HOT:
            self.rows, self.met = self.rows[self.met], np.zeros(int(self.met.sum()), bool)
        fresh = rows[~np.isin(rows["hash"], self.rows["hash"])]
        fresh = fresh[np.unique(fresh["hash"], return_index=True)[1]][:HOT]
        both, met = np.concatenate([self.rows, fresh]), np.concatenate([self.met, np.zeros(len(fresh), bool)])
        order = np.argsort(both["hash"], kind="stable")
        self.rows, self.met = both[order], met[order]


def _paths_of(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Repeated()
        for batch in batches:
            for part in slices(batch):
                words = Words(*text_buffer(part.column("text")))
                hash_, check, first, count = paths(words, words.hashes(), size)
                rows, head, later = _ranked(_records(part, words, first, count, hash_, check))
                repeats = rows[np.unique(head[later])]
                later |= seen.later(rows)
                seen.add(repeats)
                yield _flow(_spans(rows[later], False), rows[~later], buckets)

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass decided spans on; at the end the records, as one array, are the generator's value."""
    blobs = []
    for batch in batches:
        keep = pa.array(np.flatnonzero(~np.asarray(batch.column("spans").is_null())))
        if len(keep):
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("bucket", "spans")], names=["bucket", "spans"])
        blobs += [np.frombuffer(b, _PATH) for b in batch.column("rows").to_pylist() if b]
    return np.concatenate(blobs) if blobs else np.zeros(0, _PATH)


def _joined_paths(buckets: int):
    """Later sources of a path go; the earliest ones of the paths of a minimizer that branches are opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, head, later = _ranked((yield from _read(batches)))
        first = np.searchsorted(rows["hash"], rows["hash"])
        last = np.searchsorted(rows["hash"], rows["hash"], "right") - 1
        branches = rows["check"][first] != rows["check"][last] if len(rows) else later
        yield _told(np.concatenate([_spans(rows[later], False), _spans(rows[~later & branches], True)]), buckets)

    return run


def _joined_edges(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, _, later = _ranked((yield from _read(batches)))
        yield _told(_spans(rows[later], False), buckets)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document: its spans by place, and whether any is open."""
    blobs = [np.frombuffer(b, _SPAN) for batch in batches for b in batch.column("spans").to_pylist()]
    if not blobs:
        return
    told = np.concatenate(blobs)
    told = told[np.lexsort((told["place"], told["print"], told["doc"]))]
    starts = np.flatnonzero(np.concatenate([[True], (told["doc"][1:] != told["doc"][:-1]) | (told["print"][1:] != told["print"][:-1])]))
    ends = np.append(starts[1:], len(told))
    part = np.zeros(len(told), _PART)
    for c in _PART.names:
        part[c] = told[c]
    raw, size = part.tobytes(), _PART.itemsize
    opened = np.add.reduceat(told["open"].astype(np.int64), starts) > 0
    for k in range(0, len(starts), 10_000):
        a, b = starts[k : k + 10_000], ends[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(told["doc"][a]), pa.array(told["print"][a].astype(np.int64)), pa.array(opened[k : k + 10_000]), pa.array([raw[i * size : j * size] for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())], names=["doc_id", "print", "open", "spans"])


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, _PART) if x else np.zeros(0, _PART) for x in column.to_pylist()]


def _edges_of(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(*text_buffer(part.column("text")))
                first, count = [], []
                for k, spans in enumerate(_unpacked(part.column("spans"))):
                    spans = spans[spans["open"] > 0]
                    first.append(words.first[k] + spans["place"].astype(np.int64))
                    count.append(spans["count"].astype(np.int64))
                at = grouped_cells(np.concatenate(first), np.concatenate(count))
                hash_ = window_hashes(words.hashes(), at, size)
                check = window_hashes(words.hashes(MULTIPLIERS[1]), at, size, MULTIPLIERS[1])
                rows, _, later = _ranked(_records(part, words, at, 1, hash_, check))
                yield _flow(_spans(rows[later], False), rows[~later], buckets)

    return run


def _removed(size: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(*text_buffer(part.column("text")))
                cover = np.zeros(len(words.starts) + size + 1, np.int32)
                for column in ("paths", "edges"):
                    for k, spans in enumerate(_unpacked(part.column(column))):
                        spans = spans[spans["open"] == 0]
                        at = words.first[k] + spans["place"].astype(np.int64)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + spans["count"] + size - 1, -1)
                gone = np.cumsum(cover)[: len(words.starts)] > 0
                removed = np.bincount(words.rows[gone], minlength=part.num_rows)
                raw = words.data.tobytes()
                kept, starts, ends = [], words.starts.tolist(), words.ends.tolist()
                stay = (~gone).tolist()
                for a, b in zip(words.first.tolist(), words.first[1:].tolist(), strict=False):
                    kept.append(b" ".join([raw[starts[k] : ends[k]] for k in range(a, b) if stay[k]]))
                last = pa.array([k.decode() for k in kept], pa.string()) if texts else pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.diff(words.first)), pa.array(removed.astype(np.int64)), last], names=["row", "n_words", "n_removed", "kept_text" if texts else "kept_sha256"])

    return run


def without_repeats(docs: DataFrame, size: int = 20, carry: list[str] | None = None, texts: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """struct row (columns in carry, by default the id), n_words, n_removed, and kept_text (or, without texts, kept_sha256).

    A word goes if a window of `size` words that covers it also starts earlier: in a row of smaller id, or before it in
    the same row.  Windows are those of the input.  Of rows with the same id the place in the text decides; where that
    is the same too, neither loses anything.  A null text has no words; a row with a null id keeps all its words and
    removes none.  A long text is a chunk of its own and needs some fifteen times its size in memory.  An empty table gives no rows.
    """
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    buckets = shuffle_buckets(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (carry or [id_column])]).alias("row"), F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("print", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)))
    plain = rows.where("doc_id is not null").select("doc_id", "print", "text")
    key = ["doc_id", "print"]

    def by_document(flow: DataFrame, decide, label: str) -> DataFrame:
        told = flow.repartitionById(buckets, F.col("bucket")).mapInArrow(decide(buckets), TOLD)
        return written(told.repartitionById(buckets, F.col("bucket")).mapInArrow(_gathered, "doc_id long, print long, open boolean, spans binary"), label)

    # a join that shuffles at every size: the texts are dealt by document once here and once at the end
    by_path = by_document(plain.mapInArrow(_paths_of(size, buckets), FLOW), _joined_paths, "paths")
    opened = plain.hint("merge").join(by_path.where("open").drop("open"), key).mapInArrow(_edges_of(size, buckets), FLOW)
    by_edge = by_document(opened, _joined_edges, "edges")
    schema = StructType([StructField("row", rows.schema["row"].dataType), *_parse_datatype_string(f"n_words long, n_removed long, {'kept_text' if texts else 'kept_sha256'} string").fields])
    told = by_path.select(*key, F.col("spans").alias("paths")).join(by_edge.select(*key, F.col("spans").alias("edges")), key, "full")
    return rows.hint("merge").join(told, key, "left").select("row", "text", "paths", "edges").mapInArrow(_removed(size, texts), schema)
