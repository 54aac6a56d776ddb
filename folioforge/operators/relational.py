"""As-of lookups, merges, trees, search and pixel comparison, all with built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """points with the values of the last range that starts at or before them, null before the first.

    One union and one window: no row is compared with more than its neighbour, and a shuffle on the keys is all.
    """
    fields = F.struct(*[F.col(v) for v in values])
    both = points.select(*points.columns, F.lit(None).cast(ranges.select(fields.alias("r")).schema["r"].dataType).alias("range_"), F.lit(1).alias("kind_"))
    marks = ranges.select(*[F.col(c) if c in [*keys, at] else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns], fields.alias("range_"), F.lit(0).alias("kind_"))
    window = Window.partitionBy(*keys).orderBy(at, "kind_").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.unionByName(marks).withColumn("range_", F.last("range_", ignorenulls=True).over(window)).where("kind_ = 1")
    return joined.select(*points.columns, *[F.col(f"range_.{v}").alias(v) for v in values])


def first_wins(rows: DataFrame, keys: list[str], order: list[Column], tombstone: Column) -> DataFrame:
    """The first row of each key; keys whose first row is a tombstone are gone (deletions shadow older rows)."""
    best = rows.withColumn("dead_", tombstone).groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys], "dead_"), F.struct(*order)).alias("v"))
    return best.where(~F.col("v.dead_")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in rows.columns if c not in keys])


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])


def needle_pattern(needle: str) -> str | None:
    """A needle as a pattern: case folded one character to one; each white space takes any run of white space."""
    if not needle.strip():
        return None
    return "(?iu)" + "".join(r"\s+" if c.isspace() else re.escape(c) for c in needle)


def hits(rows: DataFrame, text: str, needle: str, most: int = 1000) -> DataFrame:
    """rows with ord and hit of every leftmost, non-overlapping match of a needle, at most `most` a row."""
    pattern = needle_pattern(needle)
    if pattern is None:
        return rows.select("*", F.lit(0).alias("ord"), F.lit("").alias("hit")).limit(0)
    found = F.slice(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0)), 1, most)
    return rows.select("*", F.posexplode(found).alias("ord", "hit"))


def islands(rows: DataFrame, keys: list[str], order: list[str], breaks: Column) -> DataFrame:
    """rows with island, counted from 0: a new one wherever `breaks` (which may look at the row before) holds."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("break_", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn("island", F.sum("break_").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("break_")


def capped(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key."""
    return rows.withColumn("ord_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("ord_") <= most).drop("ord_")
