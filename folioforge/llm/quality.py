"""Quality rules whose cutoffs are chosen under a guarantee.

Each rule rejects a text whose signal is at or above a cutoff.  On labelled texts (none of which fitted anything
else) the cutoffs of one rule and stratum are tried from the mildest on; one passes while the exact binomial
(Clopper-Pearson) upper bound of its rate of false rejection stays under its part of the limit.  Trying in a fixed
order and stopping at the first failure needs no correction within a family; across families (rules x strata) the
error level is divided by their number.  The parts of one stratum's rules sum to the limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, slices, span_hashes, text_buffer, window_hashes
from .storage import written

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
BINS = 64
RULES = ("symbols", "dup_lines", "repeats", "capitals", "marks")
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marked")
_IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])


def _repeats(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of keys in each row beyond its distinct ones; whether each key occurs twice or more in its row."""
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    same = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    again = np.zeros(len(r), bool)
    again[1:] |= same
    twice = again.copy()
    twice[:-1] |= same
    flags = np.zeros(len(r), bool)
    flags[order] = twice
    return np.bincount(r[again], minlength=n), flags


def measured(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The counts of COLUMNS for every text."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    per_row = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[words.starts] += 1
    in_word[words.ends] -= 1
    inside = np.cumsum(in_word[:-1]).astype(bool)
    # lines with a word
    cut = np.zeros(len(data) + 1, bool)
    cut[np.flatnonzero(data == 10) + 1] = True
    cut[offsets] = True
    starts = np.flatnonzero(cut[:-1])
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == 10) if len(ends) else ends
    lines = np.unique(np.searchsorted(starts, words.starts, "right") - 1)
    line_rows = np.searchsorted(offsets, starts[lines], "right") - 1
    dup, _ = _repeats(line_rows, span_hashes(data, starts[lines], ends[lines]), n)
    # words in windows of three that occur twice or more
    at, rows = words.windows(3)
    _, twice = _repeats(rows, window_hashes(words.hashes(), at, 3), n)
    cover = np.zeros(len(words.starts) + 3, np.int32)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 3, -1)
    repeated = np.bincount(words.rows[np.cumsum(cover)[: len(words.starts)] > 0], minlength=n)
    capital = (data >= 65) & (data <= 90)
    shout = np.concatenate([[0], np.cumsum(capital)])
    long_caps = (shout[words.ends] - shout[words.starts] >= 2) & (shout[words.ends] - shout[words.starts] == np.add.reduceat(((data | 32) >= 97) & ((data | 32) <= 122), words.starts)) if len(words.starts) else np.zeros(0, bool)
    # words whose last two bytes are ASCII marks: neither letters, digits nor parts of longer characters
    mark = (data > 32) & (data < 127) & ~capital & ~((data >= 97) & (data <= 122)) & ~((data >= 48) & (data <= 57))
    wide = words.ends - words.starts >= 3
    marked = wide & mark[words.ends - 1] & mark[np.maximum(words.ends - 2, 0)]
    return [np.diff(words.first), per_row(inside & ((data & 0xC0) != 0x80)), per_row(_IS_SYMBOL[data]), dup, repeated, np.bincount(line_rows, minlength=n), np.bincount(words.rows[long_caps], minlength=n), np.bincount(words.rows[marked], minlength=n)]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            counts = measured(*text_buffer(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("stratum"), *(pa.array(c.astype(np.int64)) for c in counts)], names=["doc_id", "stratum", *COLUMNS])


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-13:
            break
    return value


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial, by the incomplete beta function: the steps do not grow with k."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1 or k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * _fraction(a, b, x) / a)
    return min(1.0, max(0.0, 1 - front * _fraction(b, a, 1 - x) / b))


def upper_bound_holds(rejected: int, n: int, limit: float, level: float) -> bool:
    """Whether the exact upper confidence bound of the rate, at 1 - level, is at most limit."""
    return rejected < n * limit and binomial_cdf(rejected, n, limit) <= level


def cutoffs(histogram: dict[tuple[str, int], dict[int, int]], sizes: dict[str, int], limit: float, level: float, strata: int | None = None) -> dict[tuple[str, int], int]:
    """(stratum, rule) -> lowest bin that may be rejected. histogram: good texts per bin; sizes: good texts;
    strata: how many there are in all, where sizes has only some."""
    families = max(1, (strata or len(sizes)) * len(RULES))
    chosen = {}
    for stratum, n in sizes.items():
        for rule in range(len(RULES)):
            bins, rejected = histogram.get((stratum, rule), {}), 0
            for at in range(BINS - 1, 0, -1):
                rejected += bins.get(at, 0)
                if not upper_bound_holds(rejected, n, limit / len(RULES), level / families):
                    break
                chosen[stratum, rule] = at
    return chosen


def _cutoffs(strata: int, limit: float, level: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rows = batch.column("stratum").to_pylist(), []
            for name, n, bins in zip(names, batch.column("n").to_pylist(), batch.column("bins").to_pylist(), strict=True):
                histogram: dict[tuple[str, int], dict[int, int]] = {}
                for x in bins:
                    histogram.setdefault((name, x["rule"]), {})[x["bin"]] = x["n"]
                chosen = cutoffs(histogram, {name: n}, limit, level, strata)
                rows.append([chosen.get((name, k), BINS) for k in range(len(RULES))])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rows, pa.list_(pa.int32()))], names=["stratum", "least"])

    return run


def judged(docs: DataFrame, labels: DataFrame, limit: float = 0.05, level: float = 0.05, id_column: str = "doc_id", text_column: str = "text", stratum_column: str = "lang") -> DataFrame:
    """doc_id, the counts, base_failed, kept of every row.

    labels: doc_id and quality (1 good). limit: the rate of good texts of a stratum that the learned rules may reject,
    with probability 1 - level for all strata at once.  A stratum with too few labels gets no learned rule.
    A null text has no words; a null stratum is one of its own (names have a mark before them); a document labelled
    twice counts as good if any label says so; rows may repeat, an empty table gives no rows, and a text of any length is counted
    whole, at some twenty times its size in memory.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), F.coalesce(F.concat(F.lit("="), F.col(stratum_column).cast("string")), F.lit("")).alias("stratum"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = written(rows.mapInArrow(_measure, f"doc_id {kind}, stratum string, " + ", ".join(f"{c} long" for c in COLUMNS)), "counts")
    words = F.greatest(F.col("n_words"), F.lit(1))
    signals = [F.col("n_symbols") / words, F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_repeat_words") / words, F.col("n_capitals") / words, F.col("n_marked") / words]
    bins = [F.least(F.floor(s * BINS), F.lit(BINS - 1)).cast("int") for s in signals]
    good = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("doc_id")).agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = counts.join(good, "doc_id").select("stratum", F.array(*bins).alias("bins"))
    table = written(held.select("stratum", F.posexplode("bins").alias("rule", "bin")).groupBy("stratum", "rule", "bin").agg(F.count("*").alias("n")), "histograms")
    # every text has one bin for each rule; at most BINS bins and rules meet in one row
    lists = table.groupBy("stratum").agg(F.sum(F.when(F.col("rule") == 0, F.col("n"))).alias("n"), F.collect_list(F.struct("rule", "bin", "n")).alias("bins"))
    strata = table.select("stratum").distinct().count()
    least = written(lists.mapInArrow(_cutoffs(strata, limit, level), "stratum string, least array<int>"), "cutoffs")
    counts = counts.join(least, "stratum", "left")
    verdict = F.lit(False)
    for k in range(len(RULES)):
        # the last bin may be a cutoff, BINS is none
        verdict = verdict | F.coalesce(bins[k] >= F.col("least")[k], F.lit(False))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.select("doc_id", *COLUMNS[:5], base.alias("base_failed"), (~base & ~verdict).alias("kept"))
