"""Search over positioned characters.

A page's characters (at most CHARS_MOST of them) are one group, as arrays.  Where a line ends or a wide gap lies between two
characters, a mark is put into the page's text; a needle becomes a pattern over text and marks, so that finding, order and
overlap are those of a regular expression.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

HITS_MOST, CHARS_MOST = 1000, 1 << 20
LINE_EMS, GAP_EMS, STEP = 0.1, 0.2, 1 / 9
#: Marks before a character, and what stands for a character without text: code points that no text has.
LINE, GAP, NONE = "\U0010fffe", "\U0010fffd", "\U0010fffc"


class PageText:
    """rune (n), quad (n, 8: upper left, upper right, lower left, lower right), origin (n, 2), end (n, 2), size (n), axis (n)."""

    def __init__(self, rune, quad, origin, end, size, axis):
        self.quad, self.axis = np.asarray(quad, float).reshape(-1, 8), np.asarray(axis, bool)
        origin, end, size = np.asarray(origin, float).reshape(-1, 2), np.asarray(end, float).reshape(-1, 2), np.asarray(size, float)
        shown = [chr(r) if r else NONE for r in np.asarray(rune, np.int64).tolist()]
        shown = [" " if c.isspace() else c for c in shown]
        along = end[:-1] - origin[:-1]
        length = np.hypot(along[:, 0], along[:, 1])[:, None]
        along = np.where(length > 0, along / np.where(length > 0, length, 1), [1.0, 0.0])
        step, ahead = origin[1:] - origin[:-1], origin[1:] - end[:-1]
        self.breaks = np.zeros(len(shown), bool)
        self.breaks[1:] = np.abs(along[:, 0] * step[:, 1] - along[:, 1] * step[:, 0]) > LINE_EMS * size[:-1]
        gaps = np.zeros(len(shown), bool)
        gaps[1:] = (along * ahead).sum(axis=1) >= GAP_EMS * size[:-1]
        gaps &= ~self.breaks
        self.space = np.array([c == " " for c in shown], bool)
        self.text = "".join(LINE + c if b else GAP + c if g else c for c, b, g in zip(shown, self.breaks.tolist(), gaps.tolist(), strict=True))
        #: place of each character in text
        self.places = np.cumsum(1 + (self.breaks | gaps)) - 1

    def segments(self, first: int, last: int) -> list[tuple[int, int]]:
        """The characters of a match, by line: a new one begins where a break stands before what is no space."""
        inner = np.arange(first + 1, last)
        cuts = inner[self.breaks[inner] & ~self.space[inner]].tolist()
        return list(zip([first, *cuts], [*cuts, last], strict=True))

    def quads(self, first: int, last: int) -> list[list[float]]:
        """Quads of the characters of one line: a new one where top or bottom leaves the first character's by a ninth of
        its height; of turned text, the corners of the first and last character."""
        q = self.quad[first:last]
        if not self.axis[first:last].all():
            return [[*q[0, :2], *q[-1, 2:4], *q[0, 4:6], *q[-1, 6:]]]
        out, at = [], 0
        left, right = np.minimum(q[:, 0], q[:, 2]), np.maximum(q[:, 0], q[:, 2])
        while at < len(q):
            top, bottom = q[at, 1], q[at, 5]
            far = np.maximum(np.abs(q[at:, 1] - top), np.abs(q[at:, 5] - bottom)) > STEP * abs(bottom - top)
            end = at + (int(far.argmax()) if far.any() else len(far))
            x0, x1 = left[at:end].min(), right[at:end].max()
            out.append([x0, top, x1, top, x0, bottom, x1, bottom])
            at = end
        return out


def pattern(needle: str) -> re.Pattern | None:
    """A needle over marked text; None for one without any character but white space.

    White space takes a run of spaces, or stands where a mark does; each one needs a separator of its own.  Any other
    character may follow a gap, and a line break only after white space.
    """
    if not needle.strip():
        return None
    out, after_space = [], False
    for c in needle:
        if c.isspace():
            out.append(f"(?:(?:[{LINE}{GAP}]?[ ])++|(?=[{LINE}{GAP}]))")
            after_space = True
        else:
            out.append((f"[{LINE}{GAP}]?" if after_space or not out else f"{GAP}?") + re.escape(c))
            after_space = False
    return re.compile("".join(out), re.IGNORECASE)


def search(page: PageText, needle: str, most: int = HITS_MOST) -> list[list[float]]:
    """Quads of leftmost, non-overlapping matches in order; the limit counts quads and may cut the last match."""
    wanted, most, out = pattern(needle), min(most, HITS_MOST), []
    for m in wanted.finditer(page.text) if wanted else ():
        if len(out) >= most:
            break
        first, last = (int(np.searchsorted(page.places, at)) for at in m.span())
        for a, b in page.segments(first, last):
            out += page.quads(a, b)
    return out[:most]


def search_pages(chars: DataFrame, needle: str, most: int = HITS_MOST) -> DataFrame:
    """doc_id, page_no, ord and quad of every hit. chars: doc_id, page_no, seq, rune, quad, ox, oy, ex, ey, size, axis."""
    kinds = StructType([*(StructField(c, chars.schema[c].dataType) for c in ("doc_id", "page_no")), *_parse_datatype_string("ord int, quad array<double>").fields])

    def one(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("seq").slice(0, CHARS_MOST).combine_chunks()
        column = lambda c: table.column(c).to_numpy()
        quads = np.concatenate([c.values.to_numpy() if not c.offset else c.flatten().to_numpy() for c in table.column("quad").chunks])
        page = PageText(column("rune"), quads, np.column_stack([column("ox"), column("oy")]), np.column_stack([column("ex"), column("ey")]), column("size"), column("axis"))
        hits = search(page, needle, most)
        keys = [pa.array([k.as_py()] * len(hits), k.type) for k in key]
        return pa.table([*keys, pa.array(range(len(hits)), pa.int32()), pa.array(hits, pa.list_(pa.float64()))], names=["doc_id", "page_no", "ord", "quad"])

    columns = ["doc_id", "page_no", "seq", "rune", "quad", "ox", "oy", "ex", "ey", "size", "axis"]
    return chars.select(*columns).groupBy("doc_id", "page_no").applyInArrow(one, kinds)


def with_line_flags(chars: DataFrame) -> DataFrame:
    """chars with `line`, counted from 0, by built-in windows: for tables that only need lines, not matches."""
    from pyspark.sql import Window

    from .relational import islands

    w = Window.partitionBy("doc_id", "page_no").orderBy("seq")
    before = lambda c: F.lag(c).over(w)
    dx, dy = before("ex") - before("ox"), before("ey") - before("oy")
    across = F.abs(dx * (F.col("oy") - before("ey")) - dy * (F.col("ox") - before("ex"))) / F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    return islands(chars, ["doc_id", "page_no"], ["seq"], across > LINE_EMS * before("size")).withColumnRenamed("island", "line")
