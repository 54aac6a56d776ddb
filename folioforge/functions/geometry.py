"""Page geometry: boxes, rotation, matrices, pixel space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIXELS_MOST = 268_435_456


def rotation(degrees: Column) -> Column:
    """The nearest quarter turn, 0 to 270."""
    return F.pmod(F.floor((F.pmod(degrees, F.lit(360)) + 45) / 90) * 90, F.lit(360)).cast("int")


def display_size(width: Column, height: Column, turn: Column) -> tuple[Column, Column]:
    sideways = turn.isin(90, 270)
    return F.when(sideways, height).otherwise(width), F.when(sideways, width).otherwise(height)


def to_top_left(x: Column, y: Column, width: Column, height: Column, turn: Column) -> tuple[Column, Column]:
    """A point of an unrotated page, y upwards, on the displayed page, y downwards."""
    return (
        F.when(turn == 90, y).when(turn == 180, width - x).when(turn == 270, height - y).otherwise(x),
        F.when(turn == 90, x).when(turn == 180, y).when(turn == 270, width - x).otherwise(height - y),
    )


def effective_box(media: tuple[Column, ...], crop: tuple[Column, ...]) -> tuple[Column, ...]:
    """The part of the media box inside the crop box; the media box where they do not meet."""
    x0, y0 = F.greatest(media[0], crop[0]), F.greatest(media[1], crop[1])
    x1, y1 = F.least(media[2], crop[2]), F.least(media[3], crop[3])
    meets = (x0 < x1) & (y0 < y1)
    return tuple(F.when(meets, a).otherwise(b) for a, b in zip((x0, y0, x1, y1), media, strict=True))


def scale_of(dpi: Column) -> Column:
    return F.least(F.greatest(dpi.cast("double"), F.lit(1.0)) / 72.0, F.lit(10.0))


def fit_scale(width: Column, height: Column, most_width: float, most_height: float) -> Column:
    return F.least(F.lit(most_width) / width, F.lit(most_height) / height)


def extent(length: Column, scale: Column) -> Column:
    """Pixels of a side: the product in single precision, rounded up with a hair of tolerance."""
    product = (length.cast("float") * scale.cast("float")).cast("double")
    return F.when(F.isnan(product) | (product <= 0) | (product > 1e9), F.lit(0)).otherwise(F.ceil(product - 0.001)).cast("long")


def to_pixels(value: Column) -> Column:
    """A double as a 64-bit integer; what does not fit is 0."""
    bad = F.isnan(value) | (value < -9.223372036854775e18) | (value >= 9.223372036854775e18)
    return F.when(bad, F.lit(0)).otherwise(F.floor(F.when(bad, F.lit(0.0)).otherwise(value))).cast("long")


def scale_rect(x0: Column, y0: Column, x1: Column, y1: Column, scale: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """Outward to whole pixels and cut to the image; nothing left gives zeros."""
    a, b = F.greatest(F.floor(x0 * scale), F.lit(0)), F.greatest(F.floor(y0 * scale), F.lit(0))
    c, d = F.least(F.ceil(x1 * scale), width), F.least(F.ceil(y1 * scale), height)
    some = (a < c) & (b < d)
    return tuple(F.when(some, v).otherwise(F.lit(0)).cast("long") for v in (a, b, c, d))


def scale_point(value: Column, scale: Column, most: Column) -> Column:
    return F.least(F.greatest(F.floor(value * scale), F.lit(0)), most).cast("long")


def bounds(xs: list[Column], ys: list[Column]) -> tuple[Column, ...]:
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def apply_matrix(m: tuple[Column, ...], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return x * a + y * c + e, x * b + y * d + f


def multiply(m: tuple[Column, ...], n: tuple[Column, ...]) -> tuple[Column, ...]:
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o


def invert(m: tuple[Column, ...]) -> tuple[Column, ...]:
    """Null where the matrix has no inverse."""
    a, b, c, d, e, f = m
    det = F.nullif(a * d - b * c, F.lit(0.0))
    return d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det
