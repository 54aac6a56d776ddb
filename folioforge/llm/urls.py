"""URL verdicts: explicit rules first, then a ratio of two character language models.

Both models are variable-order Markov chains with Witten-Bell smoothing.  Their counts are exact, in tables of distinct
contexts and characters that grow with the input; URLs are scored by joins with them.
A URL is rejected if its log-likelihood per character under the model of rejected URLs exceeds that under the model
of accepted ones by more than a threshold, calibrated on accepted URLs.  Hosts are dealt into folds, and a URL, judged or
used for calibration, is scored by models that learned nothing from the hosts of its own fold: so a host is never judged by
what was said about its other pages, and the accepted URLs are scored as the judged ones are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import text_buffer
from .storage import depends, drop, written

ORDERS = 5
#: Bits of one byte, or of the start, in a gram; a chunk of URLs judged together has 2 ** CHUNK_BITS of them.
DIGIT = 9
MASKED = 257
BOTH = 3
CHUNK_BITS = 12
BINS = 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDS = 5
#: The fold stands above the bytes of a gram, so each fold has grams and contexts of its own.
FOLD_AT = DIGIT * (ORDERS + 1)
FOLD_MASK = 7 << FOLD_AT


def with_verdict_rule(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """pages (page_id, url) with host, path, text (the URL after its scheme), rule and, where a rule decides, its verdict
    and the bytes of the text that the rule matched (masked_from, masked_to)."""
    df = pages.withColumn("url_", F.coalesce(F.col("url").cast("string"), F.lit("")))
    df = df.withColumn("rest_", F.when(F.locate("://", F.col("url_")) > 0, F.expr("substring(url_, locate('://', url_) + 3)")).otherwise(""))
    host = F.regexp_extract("rest_", r"\A[^/?#]*", 0)
    df = df.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", F.regexp_extract("rest_", r"\A[^/?#]*([^?#]*)", 1))
    df = df.withColumn("text", F.concat("host", F.expr("substring(rest_, char_length(host) + 1)")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    masked_from, masked_to = F.lit(None).cast("int"), F.lit(None).cast("int")
    # the longest rule is looked at first; of equally long ones, a block
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block")):
        site, slash, under = text.partition("/")
        fits = ((F.col("host") == site) | F.col("host").endswith("." + site)) & F.col("path").startswith(slash + under)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
        masked_from = F.when(fits, F.octet_length("host") - len(site.encode())).otherwise(masked_from)
        masked_to = F.when(fits, F.octet_length("host") + len((slash + under).encode())).otherwise(masked_to)
    return df.withColumns({"rule": rule, "said": verdict, "masked_from": masked_from, "masked_to": masked_to}).drop("url_", "rest_")


def grams(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray | None = None, masked_from: np.ndarray | None = None, masked_to: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row of every byte, and the byte with the ORDERS bytes before it and the row's fold as one number, without loss: each byte
    plus one takes DIGIT bits, and what is before the start is zero.  Masked bytes have no gram, and are MASKED in others."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.arange(len(data)) - offsets[rows]
    digits = data.astype(np.int64) + 1
    if masked_from is not None:
        digits[(place >= masked_from[rows]) & (place < masked_to[rows])] = MASKED
    gram = np.zeros(len(data), np.int64)
    for order in range(min(ORDERS + 1, len(data))):
        before = np.concatenate([np.zeros(order, np.int64), digits[: len(data) - order]])
        gram |= np.where(place >= order, before, 0) << DIGIT * order
    if fold is not None:
        gram |= fold.astype(np.int64)[rows] << FOLD_AT
    stays = digits != MASKED
    return rows[stays], gram[stays]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, good, bad, wanted): its uses in lessons of either kind, or one that a URL to be judged has."""
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        fold, *masks = [batch.column(c).to_numpy() for c in ("fold", "masked_from", "masked_to")]
        rows, gram = grams(data, offsets, fold, *masks)
        whole, every = grams(data, offsets, fold)
        place = np.arange(len(data)) - offsets[whole]
        matched = (place >= masks[0][whole]) & (place < masks[1][whole])
        kind = np.concatenate([np.array(batch.column("kind").to_pylist(), np.int64)[rows], np.full(int(matched.sum()), BOTH)])
        keys, n = np.unique(np.stack([np.concatenate([gram, every[matched]]), kind]), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys[0]), *(pa.array(np.where((keys[1] == k) | (keys[1] == BOTH) & (k < 2), n, 0)) for k in range(3))], names=["gram", "good", "bad", "wanted"])


def models(lessons: DataFrame, urls: DataFrame) -> DataFrame:
    """(gram, value): log P(byte | rejected) - log P(byte | accepted) for every gram of urls (text, fold).

    lessons: text, wrong, masked_from, masked_to, and folds, those whose models they teach.  What the rule matched is learned by both models alike, so that they
    do not learn the rules again; after it, a context counts for the orders that do not reach into it.  Counts are exact: a table of distinct grams for each order, which grows with the input, has
    the uses of each gram, and a window over a context (at most 256 rows) has the context's.
    """
    masks = ("masked_from", "masked_to")
    both = lessons.select("text", F.col("wrong").cast("int").alias("kind"), F.explode("folds").alias("fold"), *(F.coalesce(c, F.lit(0)).alias(c) for c in masks))
    both = both.unionByName(urls.select("text", F.lit(2).alias("kind"), "fold", *(F.lit(0).alias(c) for c in masks)))
    sums = [F.sum(c).alias(c) for c in ("good", "bad", "wanted")]
    tables = [written(both.mapInArrow(_count, "gram long, good long, bad long, wanted long").groupBy("gram").agg(*sums), "grams")]
    for order in range(ORDERS, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << DIGIT * order) - 1 | FOLD_MASK))
        tables.append(written(tables[-1].groupBy(shorter.alias("gram")).agg(*sums), "grams"))
    known, held = None, []
    for order, table in enumerate(reversed(tables)):
        context = Window.partitionBy(F.shiftright("gram", DIGIT))
        for place in range(1, order + 1):
            table = table.where(F.shiftright("gram", DIGIT * place).bitwiseAND(F.lit((1 << DIGIT) - 1)) != MASKED)
        made = table.withColumns({f"{c}_{x}": f.over(context) for c in ("good", "bad") for x, f in (("all", F.sum(c)), ("kinds", F.count(F.when(F.col(c) > 0, 1))))})
        if known is None:
            made = made.withColumns({"p_good": F.lit(1 / 256), "p_bad": F.lit(1 / 256)})
        else:
            made = made.withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << DIGIT * order) - 1 | FOLD_MASK))).join(known, "shorter")
        none = lambda c: (F.col(f"{c}_all") == 0).cast("int")
        p = lambda c: (F.col(c) + (F.col(f"{c}_kinds") + none(c)) * F.col(f"p_{c}")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds") + none(c))
        known = made.select(F.col("gram").alias("shorter"), p("good").alias("p_good"), p("bad").alias("p_bad"), "wanted")
        known = written(known.where("wanted > 0").drop("wanted"), "chances")
        held.append(known)
    drop(*tables, *held[:-1])
    return depends(known.select(F.col("shorter").alias("gram"), (F.log("p_bad") - F.log("p_good")).alias("value")), known)


def _needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (chunk, gram): a common gram is one row for a chunk of URLs."""
    for batch in batches:
        rows, gram = grams(*text_buffer(batch.column("text")), batch.column("fold").to_numpy())
        keys = np.unique(np.stack([batch.column("chunk").to_numpy()[rows], gram]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1])], names=["chunk", "gram"])


def _score(urls: pa.Table, values: pa.Table) -> pa.Table:
    rows, gram = grams(*text_buffer(urls.column("text")), urls.column("fold").to_numpy())
    known, first = np.unique(values.column("gram").to_numpy(), return_index=True)
    value = values.column("value").to_numpy()[first]
    total = np.bincount(rows, weights=value[np.searchsorted(known, gram)] if len(gram) else None, minlength=urls.num_rows)
    size = np.bincount(rows, minlength=urls.num_rows)
    return urls.select(["page_id", "host", "path", "rule", "said"]).append_column("ratio", pa.array(total / np.maximum(1, size)))


def judged_urls(pages: DataFrame, rules: list[tuple[str, str]], seeds: tuple[str, ...] = (), seed_weight: int = 5, false_rejects: float = 0.01, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, ratio of every row.

    rules: (host/path, `allow` or `block`); the longest that fits decides, of equally long ones a block.  Other URLs are judged by
    the models, which learn from the URLs that rules decide and from seeds, names of unwanted sites that the caller may know.  The
    threshold is the least one, zero or more, that rejects at most false_rejects of the accepted URLs, each scored by models
    that did not see its host; without such URLs it is zero.
    Null, empty and odd URLs have an empty host and path and, with nothing to judge, are allowed; rows may repeat, and a URL
    of any length is read whole.
    """
    urls = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"))
    ruled = with_verdict_rule(urls, rules).drop("url").withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    # written, so that chunks stay the same; rows of a chunk stand together
    ruled = written(ruled.withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)), "urls")
    kind = urls.schema["page_id"].dataType.simpleString()
    spark = pages.sparkSession
    every = F.sequence(F.lit(0), F.lit(FOLDS - 1))
    lessons = ruled.where(F.col("said").isNotNull()).select("text", (F.col("said") == "block").alias("wrong"), F.array_remove(every, F.col("fold")).alias("folds"), "masked_from", "masked_to")
    if seeds:
        planted = spark.range(seed_weight * len(seeds)).select(F.element_at(F.array(*[F.lit(s) for s in seeds]), (F.col("id") % len(seeds) + 1).cast("int")).alias("text"), F.lit(True).alias("wrong"), every.alias("folds"))
        lessons = lessons.unionByName(planted, allowMissingColumns=True)
    known = models(lessons, ruled.where("text <> ''"))
    needs = ruled.where("text <> ''").mapInArrow(_needs, "chunk long, gram long").distinct()
    values = needs.join(known, "gram").select("chunk", "gram", "value")
    scored = written(ruled.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(_score, f"page_id {kind}, host string, path string, rule string, said string, ratio double"), "scored")
    drop(ruled, known)
    # the histogram has a fixed number of bins; a bin's upper edge is the threshold, so rounding is to the mild side
    at = F.least(F.greatest(F.floor(F.col("ratio") * 256), F.lit(-1)), F.lit(BINS)).cast("int")
    tally = {r["at"]: r["n"] for r in scored.where(F.col("said") == "allow").groupBy(at.alias("at")).agg(F.count("*").alias("n")).collect()}
    allowed, threshold, above = sum(tally.values()), 0.0, 0
    for k in range(BINS, -1, -1):
        above += tally.get(k, 0)
        if above > false_rejects * allowed:
            threshold = (k + 1) / 256
            break
    wrong = (F.length("host") > 0) & (F.col("ratio") > threshold)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(wrong, "block").otherwise("allow")).alias("verdict"), "ratio")
