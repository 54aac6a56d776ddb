"""Page-label numerals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the styles; beyond them a label is decimal.
ROMAN_MOST, ALPHA_MOST = 65_536, 1_664


def _digit(n: Column, unit: int, one: str, five: str, ten: str) -> Column:
    forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
    return F.element_at(F.array(*[F.lit(f) for f in forms]), (F.floor(n / unit) % 10 + 1).cast("int"))


def roman(n: Column) -> Column:
    """Lower-case roman numeral; thousands repeat m."""
    safe = F.when(n.between(1, ROMAN_MOST), n).otherwise(F.lit(1))
    text = F.concat(F.repeat(F.lit("m"), F.floor(safe / 1000).cast("int")), _digit(safe, 100, "c", "d", "m"), _digit(safe, 10, "x", "l", "c"), _digit(safe, 1, "i", "v", "x"))
    return F.when(n.between(1, ROMAN_MOST), text).otherwise(n.cast("string"))


def alpha(n: Column) -> Column:
    """a to z, then aa, bb and so on."""
    safe = F.when(n.between(1, ALPHA_MOST), n).otherwise(F.lit(1))
    text = F.repeat(F.chr((97 + (safe - 1) % 26).cast("long")), (F.floor((safe - 1) / 26) + 1).cast("int"))
    return F.when(n.between(1, ALPHA_MOST), text).otherwise(n.cast("string"))


def label(style: Column, prefix: Column, number: Column) -> Column:
    """Prefix and number in a style: D, R, r, A, a; any other style leaves the prefix alone."""
    shown = F.when(style == "D", number.cast("string")).when(style == "r", roman(number)).when(style == "R", F.upper(roman(number))).when(style == "a", alpha(number)).when(style == "A", F.upper(alpha(number))).otherwise("")
    return F.concat(F.coalesce(prefix, F.lit("")), shown)
