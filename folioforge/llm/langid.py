"""Language labels of mixed text: script ranges, per-word scores, Viterbi with a switching penalty.

The script of a word's first letter leaves the languages seen in it; hashed trigrams and the whole word give each of
these a log-likelihood; Viterbi then labels the words, paying a penalty for each switch, and runs of one label are
spans.  The dynamic program runs over all texts of a chunk at once: blocks of 64 words are solved for every language
that may come before them, and then joined text by text, which gives the same path as word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import _SPACE, mixed, slices, span_hashes, text_buffer
from .bpe import LETTER, classes, code_points
from .storage import written

BUCKETS = 1 << 16
BLOCK = 64
#: Bytes of text labelled at once; a chunk takes some hundred times as much memory.
CHUNK = 3 << 19
#: Languages whose counts a task holds before it sends them on.
HELD = 64
#: With more languages the dynamic program goes word by word: in blocks its memory grows with their square.
FEW = 16
#: Words times languages that are scored at once then.
PART = 1 << 20
#: First code point of each script range; what lies between is named by the last one at or below it.
SCRIPTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "indic"), (0xE00, "thai"), (0xF00, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other")]
NAMES = sorted({n for _, n in SCRIPTS})
_starts = np.array([s for s, _ in SCRIPTS])
_numbers = np.array([NAMES.index(n) for _, n in SCRIPTS])
_lower: np.ndarray | None = None


def lower_table() -> np.ndarray:
    global _lower
    if _lower is None:
        _lower = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x24F):
            if len(chr(c).lower()) == 1:
                _lower[c] = ord(chr(c).lower())
        for c in (*range(0x370, 0x590), *range(0x10A0, 0x1100), *range(0x1E00, 0x2000)):
            if len(chr(c).lower()) == 1:
                _lower[c] = ord(chr(c).lower())
    return _lower


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words (runs of letters): row, length, script, bucket of the word; of each trigram, the word and the bucket."""
    points, rows = code_points(data, offsets)
    letter = classes()[points] == LETTER
    low = lower_table()[points]
    edge = np.zeros(len(points) + 1, bool)
    edge[rows] = True
    starts = np.flatnonzero(letter & (edge[:-1] | ~np.concatenate([[False], letter[:-1]])))
    ends = np.flatnonzero(letter & (edge[1:] | ~np.concatenate([letter[1:], [False]]))) + 1
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    size = ends - starts
    row = np.searchsorted(rows, starts, "right") - 1
    script = _numbers[np.searchsorted(_starts, points[starts], "right") - 1]
    word = (span_hashes(low, starts, ends) >> np.uint64(48)).astype(np.int64)
    of = np.repeat(np.arange(len(starts)), size)
    at = np.flatnonzero(letter)
    first, last = at == starts[of], at == ends[of] - 1
    space = np.uint64(32)
    left = np.where(first, space, low[np.maximum(at - 1, 0)].astype(np.uint64))
    right = np.where(last, space, low[np.minimum(at + 1, len(low) - 1)].astype(np.uint64))
    gram = (mixed(left << np.uint64(42) | low[at].astype(np.uint64) << np.uint64(21) | right) >> np.uint64(48)).astype(np.int64)
    return row, size, script, word, of, gram


def _count(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        number = {x: k for k, x in enumerate(languages)}

        def counted() -> pa.RecordBatch:
            found = [(k, np.flatnonzero(t)) for k, t in total.items()]
            lang = np.concatenate([np.zeros(0, np.int32), *(np.full(len(cell), k, np.int32) for k, cell in found)])
            cells = np.concatenate([np.zeros(0, np.int32), *(cell.astype(np.int32) for _, cell in found)])
            n = np.concatenate([np.zeros(0, np.int64), *(total[k][cell] for k, cell in found)])
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(cells), pa.array(n)], names=["lang", "cell", "n"])

        for batch in batches:
            for part in slices(batch, most=CHUNK):
                lang = np.array([number[x] for x in part.column("lang").to_pylist()])
                row, size, script, word, of, gram = features(*text_buffer(part.column("text")))
                for k in np.unique(lang[row]).tolist():
                    mine = lang[row] == k
                    total[k] = total.get(k, 0) + np.bincount(np.concatenate([gram[mine[of]], BUCKETS + word[mine], 2 * BUCKETS + np.repeat(script[mine], size[mine])]), minlength=2 * BUCKETS + len(NAMES))
                    if len(total) >= HELD:
                        yield counted()
        yield counted()

    return run


class Model:
    """Log-likelihood tables: grams (bucket, language), words (bucket, language), scripts (script, language) allowed."""

    def __init__(self, languages: list[str], counts: np.ndarray, penalty: float):
        self.languages, self.penalty = languages, penalty
        logs = lambda c: (np.log(c + 0.1) - np.log(c.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)).T.astype(np.float32)
        self.grams, self.words = logs(counts[:, :BUCKETS]), logs(counts[:, BUCKETS : 2 * BUCKETS])
        letters = counts[:, 2 * BUCKETS :].T
        self.allowed = letters > 0.001 * np.maximum(1, letters.sum(axis=0))

    def scores(self, size, script, word, of, gram) -> np.ndarray:
        many = len(self.languages)
        if many > FEW and len(size) * many > PART:  # in parts, since every trigram has a row of scores
            step, ends = max(1, PART // many), np.concatenate([[0], np.cumsum(size)])
            out = np.empty((len(size), many), np.float32)
            for a in range(0, len(size), step):
                b = min(len(size), a + step)
                out[a:b] = self._scores(size[a:b], script[a:b], word[a:b], gram[ends[a] : ends[b]])
            return out
        return self._scores(size, script, word, gram)

    def _scores(self, size, script, word, gram) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        table = 0.5 * np.add.reduceat(self.grams[gram], starts, axis=0) + self.words[word] * 0.5
        allowed = self.allowed[script]
        allowed |= ~allowed.any(axis=1, keepdims=True)  # a script never seen leaves every language
        return np.where(allowed, table - table.max(axis=1, keepdims=True), -50.0).clip(-50, 0).astype(np.float32)

    def path(self, row: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
        """The best label of every word."""
        many = len(self.languages)
        if many > FEW:
            return self.path_by_word(row, scores, n)
        count = np.bincount(row, minlength=n)
        blocks = -(-count // BLOCK)
        first_block = np.concatenate([[0], np.cumsum(blocks)])
        first_word = np.concatenate([[0], np.cumsum(count)])
        place = np.arange(len(row)) - first_word[row]
        block, at = first_block[row] + place // BLOCK, place % BLOCK
        total = int(first_block[-1])
        padded = np.zeros((BLOCK, total, many), np.float32)
        padded[at, block] = scores
        value = np.full((total, many, many), -1e9, np.float32)
        value[:, np.arange(many), np.arange(many)] = 0
        back = np.empty((BLOCK, total, many, many), np.int8)
        own = np.arange(many, dtype=np.int8)
        for t in range(BLOCK):
            best = value.argmax(axis=2)
            top = np.take_along_axis(value, best[:, :, None], 2) - self.penalty
            stay = value >= top
            back[t] = np.where(stay, own, best[:, :, None].astype(np.int8))
            value = np.where(stay, value, top) + padded[t][:, None, :]
        # joining the blocks of each text
        before = np.zeros((total, many), np.int8)
        running = np.zeros((n, many), np.float32)
        order = np.argsort(-blocks, kind="stable")
        steps = int(blocks.max()) if n else 0
        for k in range(steps):
            rows = order[: int((blocks > k).sum())]
            b = first_block[rows] + k
            joined = running[rows][:, :, None] + value[b]
            before[b] = joined.argmax(axis=1)
            running[rows] = joined.max(axis=1)
        end = np.zeros(total, np.int8)
        label = running.argmax(axis=1)
        start = np.zeros(total, np.int8)
        for k in reversed(range(steps)):
            rows = order[: int((blocks > k).sum())]
            b = first_block[rows] + k
            end[b] = label[rows]
            start[b] = before[b, label[rows]]
            label[rows] = start[b]
        labels = np.empty((BLOCK, total), np.int8)
        lanes, now = np.arange(total), end
        for t in reversed(range(BLOCK)):
            labels[t] = now
            now = back[t, lanes, start, now]
        return labels[at, block].astype(np.int64)


    def path_by_word(self, row: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
        """The same for any number of languages: all texts go on by one word at a time."""
        many = len(self.languages)
        count = np.bincount(row, minlength=n)
        first = np.concatenate([[0], np.cumsum(count)])
        order = np.argsort(-count, kind="stable")
        longer = np.searchsorted(-count[order], -np.arange(int(count.max()) if n else 0), "left")  # texts of more than t words
        value, stay, best = np.zeros((n, many)), np.empty((len(row), many), bool), np.empty(len(row), np.int32)
        for t, m in enumerate(longer.tolist()):
            rows = order[:m]
            at, now = first[rows] + t, value[rows]
            best[at] = now.argmax(axis=1)
            top = now.max(axis=1, keepdims=True) - self.penalty
            stay[at] = now >= top
            value[rows] = np.maximum(now, top) + scores[at]
        labels, label = np.empty(len(row), np.int64), value.argmax(axis=1)
        for t in reversed(range(len(longer))):
            rows = order[: longer[t]]
            at = first[rows] + t
            labels[at] = label[rows]
            label[rows] = np.where(stay[at, label[rows]], label[rows], best[at])
        return labels


def pieces(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of parts of at most about `most` bytes, cut after white space, so that no word is cut."""
    for row, (at, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while end - at > most:
            space = np.flatnonzero(_SPACE[data[at : at + most]])
            if len(space):
                cut = at + int(space[-1]) + 1
            else:  # a word longer than that: up to where it ends
                space = np.flatnonzero(_SPACE[data[at + most : end]])
                cut = at + most + int(space[0]) + 1 if len(space) else end
            yield row, at, cut
            at = cut
        yield row, at, end


def word_scores(model: Model, data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, length and scores of every word.  A long text is scored part by part: what stays of it is a row of scores a word."""
    scored = lambda found: model.scores(*found) if len(found[0]) and model.languages else np.zeros((len(found[0]), len(model.languages)), np.float32)
    if len(data) <= 2 * most:
        row, *found = features(data, offsets)
        return row, found[0], scored(found)
    made = []
    for k, a, b in pieces(data, offsets, most):
        row, *found = features(data[a:b], np.array([0, b - a]))
        made.append((row + k, found[0], scored(found)))
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


def _label(model_state: tuple, with_spans: bool):
    made: list[Model] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Model(*model_state))
        model = made[0]
        many = len(model.languages)
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            most = CHUNK * FEW // max(many, FEW)
            for part in slices(batch, most=most):
                n = part.num_rows
                row, size, scores = word_scores(model, *text_buffer(part.column("text")), most)
                pred, score = np.full(n, many), np.zeros(n)
                found: list[list[dict]] = [[] for _ in range(n)]
                if len(row) and many:
                    label = model.path(row, scores, n)
                    letters = np.bincount(row * many + label, weights=size, minlength=n * many).reshape(n, many)
                    likely = np.stack([np.bincount(row, weights=scores[:, k], minlength=n) for k in range(many)], axis=1)
                    has = letters.sum(axis=1) > 0
                    best = letters.argmax(axis=1)
                    weight = np.exp(likely - likely.max(axis=1, keepdims=True))
                    sure = (weight / weight.sum(axis=1, keepdims=True))[np.arange(n), best]
                    share = letters[np.arange(n), best] / np.maximum(1, letters.sum(axis=1))
                    pred[has], score[has] = best[has], (share * np.where(share < 1, 1, sure))[has]
                    if with_spans:
                        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (label[1:] != label[:-1])]))
                        first = np.searchsorted(row, np.arange(n + 1))
                        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(row)], strict=True):
                            found[row[a]].append({"first_word": int(a - first[row[a]]), "words": b - a, "lang": model.languages[label[a]]})
                columns = [part.column("row"), pa.array(names[pred], pa.string()), pa.array(score)]
                if with_spans:
                    columns.append(pa.array(found, pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, names=["row", "lang_pred", "score", "spans"][: len(columns)])

    return run


def trained(docs: DataFrame, sample: int = 4000, penalty: float = 12.0, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id") -> tuple:
    """A model from docs, which must hold training rows only.

    Fitted on about `sample` rows of each language that occurs (chosen by a hash of the id), so what the driver and a
    task hold is bounded for each language: 2 * 65536 counts.
    """
    rows = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    rows = rows.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"), F.xxhash64(F.col(id_column).cast("string")).alias("draw"))
    sizes = written(rows.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    known = sorted(r["lang"] for r in sizes.collect())
    if not known:
        return known, np.zeros((0, 2 * BUCKETS + len(NAMES))), penalty
    lucky = F.pmod("draw", F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(sample) / F.col("rows")) * (1 << 30)
    some = rows.join(F.broadcast(sizes), "lang").where(lucky).select("lang", "text")
    counts = np.zeros((len(known), 2 * BUCKETS + len(NAMES)), np.float32)
    table = some.mapInArrow(_count(known), "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts[table["lang"], table["cell"]] = table["n"]
    return known, counts, penalty


def labelled(docs: DataFrame, model: tuple, carry: list[str] | None = None, spans: bool = False, text_column: str = "text") -> DataFrame:
    """struct row (columns in carry, by default all), lang_pred, score and, if asked for, spans of words.

    A text that is null or has no letter is `und` with score 0; so is every text if the model learned nothing.  score:
    the share of letters in the language's spans; where all are, the posterior of the language.  A text of any length is
    labelled whole; rows may repeat, and an empty table gives no rows.
    """
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)]).alias("row"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    more = ", spans array<struct<first_word:long,words:long,lang:string>>" * spans
    schema = StructType([StructField("row", rows.schema["row"].dataType), *_parse_datatype_string("lang_pred string, score double" + more).fields])
    return rows.mapInArrow(_label(model, spans), schema)


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string")) % 5 == 0
