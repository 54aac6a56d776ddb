"""Fonts as far as text needs them: how strings split into codes, and each code's text, advance and heights."""

from __future__ import annotations

import math
from bisect import bisect_right

from . import charstrings, cmaps, glyphs, metrics
from .objects import File, Name, Stream
from .truetype import NoProgram, TrueType

WIDTHS_MOST = 256
#: Where a descriptor may hold a program, in the order of preference, and what it may be.
PROGRAMS = {"FontFile2": (TrueType,), "FontFile3": (charstrings.Cff, TrueType), "FontFile": (charstrings.TypeOne,)}


def compact(data: bytes) -> bytes:
    """The CFF table of an OpenType file, or the data itself."""
    if data[:4] != b"OTTO":
        return data
    count = int.from_bytes(data[4:6], "big")
    for k in range(min(count, 64)):
        entry = data[12 + 16 * k : 28 + 16 * k]
        if entry[:4] == b"CFF ":
            at, size = int.from_bytes(entry[8:12], "big"), int.from_bytes(entry[12:16], "big")
            return data[at : at + size]
    return data


def number(value) -> float | None:
    """A finite number, or None."""
    if isinstance(value, bool) or not isinstance(value, int | float):
        return None
    try:
        value = float(value)
    except OverflowError:
        return None
    return value if math.isfinite(value) and abs(value) < 3.4e38 else None


class Font:
    """A font dictionary.  afm: a folder of metric files that refine the widths of standard fonts."""

    def __init__(self, file: File, entries: dict | None, afm: str | None = None):
        self.file, self.entries, self.afm = file, entries if isinstance(entries, dict) else {}, afm
        get = lambda k, of=self.entries: file.get(of.get(k))
        self.kind, self.base = str(get("Subtype") or ""), str(get("BaseFont") or "")
        self.wide, self.vertical, self.three = self.kind == "Type0", False, self.kind == "Type3"
        described = self.entries
        if self.wide:
            below = get("DescendantFonts")
            below = file.get(below[0]) if isinstance(below, list) and below else None
            described = below if isinstance(below, dict) else {}
        info = file.get(described.get("FontDescriptor"))
        self.info = info if isinstance(info, dict) else None
        flags = file.get(info.get("Flags")) if self.info else 0
        self.standard = metrics.standard_name(self.base, flags if isinstance(flags, int) else 0)
        self.ascent, self.descent = self._heights()
        unicode_map = get("ToUnicode")
        self.map = cmaps.parse(file.content(unicode_map)) if isinstance(unicode_map, Stream) else None
        if self.wide:
            self._wide(described)
        else:
            self._simple()

    def _heights(self) -> tuple[float, float]:
        if self.info is None:
            high, low = metrics.HEIGHTS.get(self.standard, (800, -200)) if not self.three else (800, -200)
            return high / 1000, low / 1000
        found = [number(self.file.get(self.info.get(k))) for k in ("Ascent", "Descent")]
        return (found[0] / 1000 if found[0] else 0.8), (found[1] / 1000 if found[1] else -0.2)

    def _simple(self) -> None:
        file = self.file
        own = file.get(self.entries.get("Encoding"))
        base, changes = (file.get(own.get("BaseEncoding")), file.get(own.get("Differences"))) if isinstance(own, dict) else (own, None)
        self.named = base is not None or isinstance(own, dict)
        own_codes = self.standard == "Symbol" and base is None
        self.texts = {} if self.three else metrics.symbols() if own_codes else dict(glyphs.encoding(str(base or "")))
        self.names: dict[int, str] = {}
        at = 0
        for item in changes if isinstance(changes, list) else ():
            item = file.get(item)
            if isinstance(item, Name) and 0 <= at < 256:
                self.names[at], self.texts[at] = str(item), glyphs.text_of(str(item))
                at += 1
            elif isinstance(item, int) and not isinstance(item, bool):
                at = item
        given = file.get(self.entries.get("Widths"))
        first = file.get(self.entries.get("FirstChar"))
        first = first if isinstance(first, int) else 0
        found = {first + k: number(file.get(w)) for k, w in enumerate(given[:WIDTHS_MOST])} if isinstance(given, list) else {}
        self.widths = {code: w for code, w in found.items() if w is not None and 0 <= code < 256}
        self.has_widths = isinstance(given, list)
        self.missing = (number(file.get(self.info.get("MissingWidth"))) if self.info else None) or 0.0

    def _wide(self, below: dict) -> None:
        file, get = self.file, lambda k: self.file.get(below.get(k))
        named = file.get(self.entries.get("Encoding"))
        if isinstance(named, Stream):
            base = file.get(named.entries.get("UseCMap"))
            self.codes = cmaps.parse(file.content(named))
            self.codes.vertical |= file.get(named.entries.get("WMode")) == 1
            if self.codes.base is None and base is not None:
                self.codes.base = cmaps.parse(file.content(base)) if isinstance(base, Stream) else cmaps.predefined(str(base))
        else:
            self.codes = cmaps.predefined(str(named or "")) or cmaps.CMap(identity=True)
        self.vertical = self.codes.vertical
        default = number(get("DW"))
        self.default = 1000.0 if default is None else default
        down = get("DW2")
        down = [number(file.get(v)) for v in down[:2]] if isinstance(down, list) and len(down) >= 2 else [880.0, -1000.0]
        self.default_down = (880.0 if down[0] is None else down[0], -1000.0 if down[1] is None else down[1])
        numbers = get("CIDToGIDMap")
        self.glyph_numbers = file.content(numbers) if isinstance(numbers, Stream) else b""
        self.across, self.down = spans(self._ranges(get("W"), 1)), spans(self._ranges(get("W2"), 3))

    def _ranges(self, value, size: int) -> list[tuple[int, int, tuple[float, ...]]]:
        """(first, last, numbers) of a width array in either of its two forms, in file order."""
        items, out, k = [self.file.get(v) for v in value[: 1 << 18]] if isinstance(value, list) else [], [], 0
        while k + 1 < len(items):
            first, then = items[k], items[k + 1]
            if isinstance(first, bool) or not isinstance(first, int):
                k += 1
            elif isinstance(then, list):
                each = [number(self.file.get(v)) for v in then]
                out += [(first + j // size, first + j // size, tuple(each[j : j + size])) for j in range(0, len(each) - size + 1, size) if None not in each[j : j + size]]
                k += 2
            elif k + 1 + size < len(items) and isinstance(then, int):
                each = [number(v) for v in items[k + 2 : k + 2 + size]]
                if None not in each and then >= first:
                    out.append((first, then, tuple(each)))
                k += 2 + size
            else:
                break
        return out

    def split(self, raw: bytes) -> list[tuple[int, int]]:
        return self.codes.split(raw) if self.wide else [(code, 1) for code in raw]

    def width(self, code: int, size: int = 1) -> float:
        """Advance in ems (Type 3: in glyph space over 1000)."""
        if self.wide:
            found = within(self.across, self.codes.cid(code, size))
            return (found[0] if found else self.default) / 1000
        if code in self.widths or self.has_widths:
            return self.widths.get(code, self.missing) / 1000
        if self.program() is not None:
            known = self.own_advance(code, size)
            return self.missing / 1000 if known is None else known
        known = metrics.width(self.standard, self.texts.get(code, ""), self.afm)
        return (self.missing if known is None else known) / 1000

    def upright(self, code: int, size: int) -> tuple[float, float, float]:
        """Vertical writing: advance down, and the place of the glyph's upper origin, in ems."""
        cid = self.codes.cid(code, size)
        found = within(self.down, cid)
        if found:
            return found[0] / 1000, found[1] / 1000, found[2] / 1000
        return self.default_down[1] / 1000, self.width(code, size) / 2, self.default_down[0] / 1000

    def program(self) -> TrueType | charstrings.Cff | charstrings.TypeOne | None:
        """The font program in the file, if there is one that can be read."""
        if not hasattr(self, "_program"):
            self._program = None
            for key, kinds in PROGRAMS.items():
                held = self.file.get(self.info.get(key)) if self.info else None
                data = self.file.content(held) if isinstance(held, Stream) and self._program is None else b""
                for kind in kinds if data else ():
                    try:
                        self._program = kind(compact(data) if kind is charstrings.Cff else data)
                        break
                    except (NoProgram, charstrings.NoProgram):
                        continue
        return self._program

    def glyph(self, code: int, size: int = 1):
        """A code's glyph in the program."""
        made = self.program()
        if self.wide:
            cid = self.codes.cid(code, size)
            if self.glyph_numbers:
                return int.from_bytes(self.glyph_numbers[2 * cid : 2 * cid + 2], "big")
            return made.glyph_of.get(cid, 0) if isinstance(made, charstrings.Cff) and made.by_cid else cid
        text = self.texts.get(code, "")
        if isinstance(made, TrueType):
            return made.glyph(code, text)
        return made.glyph(code, self.names.get(code, ""), text if self.named else "") if made else 0

    def path(self, code: int, size: int = 1) -> list[tuple]:
        """The outline of a code's glyph in ems; none where the file holds no program."""
        made = self.program()
        if made is None:
            return []
        glyph = self.glyph(code, size)
        return made.path(glyph) if isinstance(made, TrueType) else made.drawn(glyph)[0]

    def own_advance(self, code: int, size: int = 1) -> float | None:
        made = self.program()
        glyph = self.glyph(code, size)
        return made.advance(glyph) if isinstance(made, TrueType) else made.drawn(glyph)[1]

    def text(self, code: int, size: int = 1) -> str:
        """What a code shows; empty if nothing is known."""
        if self.map is not None and (said := self.map.text(code, size)) is not None:
            return said
        if self.wide:
            return ""
        return self.texts.get(code) or (chr(code) if 32 <= code < 127 and code not in self.names else "")


def spans(ranges: list[tuple]) -> tuple[list[int], list[tuple]]:
    """Ranges made disjoint: where some overlap, the one that starts lower has the numbers, then the earlier one."""
    out, reached = [], -1
    for low, high, values in sorted(ranges, key=lambda r: r[0]):
        low = max(low, reached + 1)
        if low <= high:
            out.append((low, high, values))
            reached = high
    return [r[0] for r in out], out


def within(table: tuple[list[int], list[tuple]], cid: int) -> tuple | None:
    k = bisect_right(table[0], cid) - 1
    return table[1][k][2] if k >= 0 and cid <= table[1][k][1] else None
