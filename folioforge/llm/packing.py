"""Packing documents into training windows with a controlled mixture.

Every source is a queue of tokens.  Deficit round-robin grants each window its share of every queue: a queue's credit
grows by its proportion of the window, whole tokens are served, and the fraction left over is carried into the next
window.  The carried deficits have a closed form (running sums of shares, cut to whole tokens), so no task waits for
another: a document's place in its queue alone gives the windows that its tokens fill.  A queue that runs dry leaves
its share to the others.  What is left at the end, under one grant of each queue, fills windows in queue order, and the
last tokens make sequences of falling powers of two, so nothing is padded.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import grouped_cells, slices, text_buffer
from .bpe import encoder, lowered
from .storage import written

SHARE_BITS = 28


@dataclass
class Phase:
    """Windows during which the same queues are served. below[q], upto[q]: running shares in units of 2**-28."""

    first: int
    windows: int
    below: dict[int, int]
    upto: dict[int, int]
    begun: dict[int, int]


@dataclass
class Schedule:
    window: int
    phases: list[Phase] = field(default_factory=list)
    tail_window: int = 0
    tail: dict[int, tuple[int, int, int]] = field(default_factory=dict)  # queue: first token, how many, place in the tail
    tail_tokens: int = 0

    def served(self, share: int, windows):
        return windows * share * self.window >> SHARE_BITS if isinstance(windows, int) else (windows * share) >> (SHARE_BITS - self.window.bit_length() + 1)


def schedule(totals: list[int], shares: list[float], window: int) -> Schedule:
    """totals: tokens of each queue; shares: its target proportion. window: a power of two."""
    plan, left, at = Schedule(window), list(totals), 0
    active = [q for q in range(len(totals)) if totals[q] and shares[q] > 0]
    waiting = [q for q in range(len(totals)) if totals[q] and not shares[q] > 0]
    while active or waiting:
        if not active:
            active, waiting = waiting, []
            shares = [float(t) for t in left]
        whole = sum(shares[q] for q in active)
        edges, running = [0], 0.0
        for q in active:
            running += shares[q]
            edges.append(min(1 << SHARE_BITS, round(running / whole * (1 << SHARE_BITS))))
        edges[-1] = 1 << SHARE_BITS
        grants = {q: edges[k + 1] - edges[k] for k, q in enumerate(active)}
        n = min((left[q] << SHARE_BITS) // (grants[q] * window) if grants[q] else 0 for q in active)
        if n:
            begun = {q: totals[q] - left[q] for q in active}
            below, upto = {q: edges[k] for k, q in enumerate(active)}, {q: edges[k + 1] for k, q in enumerate(active)}
            plan.phases.append(Phase(at, n, below, upto, begun))
            for q in active:
                left[q] -= plan.served(upto[q], n) - plan.served(below[q], n)
            at += n
        active = [q for q in active if grants[q] and (left[q] << SHARE_BITS) // (grants[q] * window)]
    plan.tail_window = at
    for q, n in enumerate(left):
        if n:
            plan.tail[q] = (totals[q] - n, n, plan.tail_tokens)
            plan.tail_tokens += n
    return plan


def _window_of(plan: Schedule, below: int, upto: int, x: np.ndarray) -> np.ndarray:
    """The window of a phase in which a queue's x-th token of the phase stands."""
    served = lambda w: plan.served(upto, w) - plan.served(below, w)
    w = (x << (SHARE_BITS - plan.window.bit_length() + 1)) // (upto - below)
    for _ in range(2):
        w = w - (served(w) > x)
    for _ in range(2):
        w = w + (served(w + 1) <= x)
    return w


def cut(plan: Schedule, queue: int, place: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Pieces (row, start in the row, length, sequence, offset) of documents that stand at `place` of a queue."""
    out = []
    lo, hi = int(place.min()), int((place + size).max())
    for phase in plan.phases:
        if queue not in phase.upto:
            continue
        below, upto, begun = phase.below[queue], phase.upto[queue], phase.begun[queue]
        length = plan.served(upto, phase.windows) - plan.served(below, phase.windows)
        if begun >= hi or begun + length <= lo:
            continue
        first, last = np.maximum(place, begun) - begun, np.minimum(place + size, begun + length) - begun
        rows = np.flatnonzero(last > first)
        first, last = first[rows], last[rows]
        w0, w1 = _window_of(plan, below, upto, first), _window_of(plan, below, upto, last - 1)
        count = w1 - w0 + 1
        w, of = grouped_cells(w0, count), np.repeat(np.arange(len(rows)), count)
        base = plan.served(below, w)
        open_ = plan.served(upto, w) - base
        close = plan.served(upto, w + 1) - plan.served(below, w + 1)
        begin, end = np.maximum(first[of], open_), np.minimum(last[of], close)
        some = end > begin
        offset = plan.served(below, w + 1) - base + begin - open_
        out.append((rows[of][some], (begin + begun - place[rows[of]])[some], (end - begin)[some], (phase.first + w)[some], offset[some]))
    if queue in plan.tail:
        begun, length, at = plan.tail[queue]
        first, last = np.maximum(place, begun) - begun + at, np.minimum(place + size, begun + length) - begun + at
        rows = np.flatnonzero(last > first)
        full = plan.tail_tokens // plan.window
        edges = [k * plan.window for k in range(full + 1)]
        for bit in reversed(range(plan.window.bit_length() - 1)):
            if plan.tail_tokens % plan.window >> bit & 1:
                edges.append(edges[-1] + (1 << bit))
        edges = np.array(edges)
        first, last = first[rows], last[rows]
        s0, s1 = np.searchsorted(edges, first, "right") - 1, np.searchsorted(edges, last - 1, "right") - 1
        count = s1 - s0 + 1
        s, of = grouped_cells(s0, count), np.repeat(np.arange(len(rows)), count)
        begin, end = np.maximum(first[of], edges[s]), np.minimum(last[of], edges[s + 1]) if len(s) else last[of]
        out.append((rows[of], begin - at + begun - place[rows[of]], end - begin, plan.tail_window + s, begin - edges[s]))
    return out


def ids_of(texts: pa.Array, path: str, added: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts one after another, and where each text's begin.  Texts that name an added token of the vocabulary, which is
    found before anything else, go through the tokenizer library itself."""
    odd = np.zeros(len(texts), bool)
    for token in added:
        odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
    plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
    ids, first = encoder("merges", path).encode(*text_buffer(lowered(plain)))
    if odd.any():
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        rows = [np.array(library.encode(texts[k].as_py(), add_special_tokens=False).ids, ids.dtype) if odd[k] else ids[first[k] : first[k + 1]] for k in range(len(texts))]
        ids, first = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return ids, first


def _tokens(path: str, end_id: int, wide: bool, added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_no, used = TaskContext.get().partitionId(), {}
        for batch in batches:
            for part in slices(batch, most=3 << 19):
                ids, first = ids_of(part.column("text"), path, added)
                rows = part.num_rows
                raw = np.insert(ids, first[1:], end_id).astype("<u4" if wide else "<u2").tobytes()
                size = np.diff(first) + 1
                bounds = (np.concatenate([[0], np.cumsum(size)]) * (4 if wide else 2)).tolist()
                places, sources = [], part.column("source").to_pylist()
                for source, n in zip(sources, size.tolist(), strict=True):
                    places.append(used.get(source, 0))
                    used[source] = places[-1] + n
                columns = [part.column("doc_id"), part.column("source"), pa.array([part_no] * rows, pa.int32()), pa.array(places, pa.int64()), pa.array(size, pa.int64()), pa.array([raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "part", "place", "doc_tokens", "ids"])

    return run


def _pieces(plan: Schedule, wide: bool, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                queue, place, size = (part.column(k).to_numpy(zero_copy_only=False) for k in ("queue", "place", "doc_tokens"))
                found: list[tuple[np.ndarray, ...]] = []
                for q in np.unique(queue).tolist():
                    rows = np.flatnonzero(queue == q)
                    found += [(rows[x[0]], *x[1:]) for x in cut(plan, int(q), place[rows], size[rows])]
                row, start, length, sequence, offset = (np.concatenate(x) for x in zip(*found, strict=True))
                data, offsets = text_buffer(part.column("ids"))
                width = 4 if wide else 2
                raw = data.view("<u4" if wide else "<u2").astype("<u4").tobytes()
                begin = (offsets[row] // width + start) * 4
                spans = zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)
                last = pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64()) if digest else pa.array([raw[a:b] for a, b in spans], pa.binary())
                taken = pa.array(row)
                columns = [part.column("doc_id").take(taken), pa.array(start), pa.array(length), last, pa.array(size[row]), pa.array(sequence), pa.array(offset), part.column("source").take(taken)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset", "source"])

    return run


def packed(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, shares: dict[str, float] | None = None, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", digest: bool = False) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids (or with digest ids_crc32), doc_tokens, sequence_id, offset, source.

    Each document is its ids and end_id; each id lies in exactly one piece; sequences have `window` ids, or a smaller
    power of two at the very end, without padding.  shares: target proportion of each source named; what they
    leave goes to all other sources in the proportions of the corpus, as by default all of it does.  Every source is a
    queue of its own.
    A null text is empty and gives the end id alone; a null source counts as one source of that kind; an empty table
    gives no piece; rows may repeat, and a text of any length is cut wherever windows end.  The driver and the tasks hold the
    schedule, a few numbers for each source.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    added = [t["content"] for t in stored.get("added_tokens", [])]
    wide = max([*stored["model"]["vocab"].values(), *(t["id"] for t in stored.get("added_tokens", []))]) >= 1 << 16
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), F.col(source_column).cast("string").alias("source"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    # a null source is a source of its own: names are kept apart from it by a mark
    rows = rows.withColumn("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    tokens = written(rows.mapInArrow(_tokens(path, end_id, wide, added), f"doc_id {kind}, source string, part int, place long, doc_tokens long, ids binary"), "tokens")
    parts = written(tokens.groupBy("source", "part").agg(F.sum("doc_tokens").alias("n")), "parts")
    totals = [(r["source"], r["n"]) for r in parts.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").collect()]
    named = {f"={k}": v for k, v in (shares or {}).items()}
    rest = sum(n for source, n in totals if source not in named)
    left = max(0.0, 1 - sum(named.values()))
    targets = [named[source] if source in named else left * n / rest for source, n in totals]
    plan = schedule([n for _, n in totals], targets, window)
    queues = docs.sparkSession.createDataFrame([(source, k) for k, (source, _) in enumerate(totals)], "source string, queue int")
    order = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(parts.join(F.broadcast(queues), "source").withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n"), "places")
    rows = tokens.join(placed, ["source", "part"]).select("doc_id", "source", "queue", (F.col("place") + F.col("before")).alias("place"), "doc_tokens", "ids")
    last = "ids_crc32 long" if digest else "ids binary"
    made = rows.mapInArrow(_pieces(plan, wide, digest), f"doc_id {kind}, start long, length long, {last}, doc_tokens long, sequence_id long, offset long, source string")
    return made.withColumn("source", F.when(F.col("source") != "", F.expr("substring(source, 2)")))
