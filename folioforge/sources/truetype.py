"""TrueType programs: character tables, advances and outlines, by the public specification."""

from __future__ import annotations

import struct

NESTED_MOST, POINTS_MOST = 6, 1 << 16
Point = tuple[float, float]


class NoProgram(ValueError):
    pass


class TrueType:
    def __init__(self, data: bytes):
        self.data, self.tables = data, {}
        try:
            if data[:4] == b"ttcf":
                start = struct.unpack_from(">I", data, 12)[0]
            else:
                start = 0
            (count,) = struct.unpack_from(">H", data, start + 4)
            for k in range(min(count, 256)):
                tag, _, at, size = struct.unpack_from(">4sIII", data, start + 12 + 16 * k)
                self.tables.setdefault(tag.decode("latin-1"), data[at : at + size])
            head, most = self.tables["head"], self.tables["maxp"]
            self.units = struct.unpack_from(">H", head, 18)[0] or 1000
            self.wide_offsets = struct.unpack_from(">h", head, 50)[0] != 0
            (self.glyphs,) = struct.unpack_from(">H", most, 4)
            (self.advances,) = struct.unpack_from(">H", self.tables.get("hhea", bytes(36)), 34)
        except (struct.error, KeyError) as error:
            raise NoProgram("tables") from error
        self.maps = self._maps()

    def heights(self) -> tuple[float, float] | None:
        """Ascent and descent in ems."""
        found = self.tables.get("hhea", b"")
        if len(found) < 8:
            return None
        high, low = struct.unpack_from(">hh", found, 4)
        return high / self.units, low / self.units

    def advance(self, glyph: int) -> float | None:
        """In ems; glyphs past the last advance share it."""
        found = self.tables.get("hmtx", b"")
        at = 4 * min(glyph, self.advances - 1)
        return struct.unpack_from(">H", found, at)[0] / self.units if self.advances and at + 2 <= len(found) else None

    # character tables

    def _maps(self) -> dict[tuple[int, int], dict[int, int]]:
        out, table = {}, self.tables.get("cmap", b"")
        try:
            (count,) = struct.unpack_from(">H", table, 2)
            for k in range(min(count, 64)):
                platform, encoding, at = struct.unpack_from(">HHI", table, 4 + 8 * k)
                out.setdefault((platform, encoding), self._map(table, at))
        except struct.error:
            pass
        return out

    def _map(self, table: bytes, at: int) -> dict[int, int]:
        made: dict[int, int] = {}
        try:
            (kind,) = struct.unpack_from(">H", table, at)
            if kind == 0:
                return {code: glyph for code, glyph in enumerate(table[at + 6 : at + 262]) if glyph}
            if kind == 6:
                first, count = struct.unpack_from(">HH", table, at + 6)
                return {first + k: g for k, g in enumerate(struct.unpack_from(f">{count}H", table, at + 10)) if g}
            if kind == 12:
                (groups,) = struct.unpack_from(">I", table, at + 12)
                for k in range(min(groups, 1 << 14)):
                    first, last, glyph = struct.unpack_from(">III", table, at + 16 + 12 * k)
                    made |= {code: glyph + code - first for code in range(first, min(last, first + 0xFFFF) + 1)}
                return made
            if kind == 4:
                n = struct.unpack_from(">H", table, at + 6)[0] // 2
                ends = struct.unpack_from(f">{n}H", table, at + 14)
                starts = struct.unpack_from(f">{n}H", table, at + 16 + 2 * n)
                shifts = struct.unpack_from(f">{n}H", table, at + 16 + 4 * n)
                places = at + 16 + 6 * n
                offsets = struct.unpack_from(f">{n}H", table, places)
                for k, (first, last, shift, offset) in enumerate(zip(starts, ends, shifts, offsets, strict=True)):
                    for code in range(first, min(last, 0xFFFE) + 1):
                        if offset:
                            where = places + 2 * k + offset + 2 * (code - first)
                            glyph = struct.unpack_from(">H", table, where)[0] if where + 2 <= len(table) else 0
                            glyph = glyph + shift & 0xFFFF if glyph else 0
                        else:
                            glyph = code + shift & 0xFFFF
                        if glyph:
                            made[code] = glyph
        except struct.error:
            pass
        return made

    def glyph(self, code: int, text: str) -> int:
        """The glyph of a simple font's code: by its text, then by the symbol table, then by the code itself."""
        for key in ((3, 10), (3, 1), (0, 4), (0, 3), (0, 1)):
            if len(text) == 1 and ord(text) in self.maps.get(key, {}):
                return self.maps[key][ord(text)]
        for key in ((3, 0), (1, 0)):
            for at in (code, 0xF000 + code):
                if at in self.maps.get(key, {}):
                    return self.maps[key][at]
        return 0

    # outlines

    def _bytes(self, glyph: int) -> bytes:
        places, data = self.tables.get("loca", b""), self.tables.get("glyf", b"")
        if not 0 <= glyph < self.glyphs:
            return b""
        size, unit = (4, 1) if self.wide_offsets else (2, 2)
        if (glyph + 2) * size > len(places):
            return b""
        a, b = struct.unpack_from(">II" if self.wide_offsets else ">HH", places, glyph * size)
        return data[a * unit : b * unit]

    def outline(self, glyph: int, depth: int = 0) -> list[list[tuple[float, float, bool]]]:
        """Contours of (x, y, whether on the curve) in ems; none for a glyph without, or a broken one."""
        raw = self._bytes(glyph)
        if len(raw) < 10 or depth > NESTED_MOST:
            return []
        (contours,) = struct.unpack_from(">h", raw, 0)
        try:
            return self._simple(raw, contours) if contours >= 0 else self._composite(raw, depth)
        except (struct.error, IndexError):
            return []

    def _simple(self, raw: bytes, contours: int) -> list:
        ends = struct.unpack_from(f">{contours}H", raw, 10)
        at = 10 + 2 * contours
        at += 2 + struct.unpack_from(">H", raw, at)[0]
        count = ends[-1] + 1 if ends else 0
        if count > POINTS_MOST:
            return []
        flags: list[int] = []
        while len(flags) < count:
            flag = raw[at]
            at += 1
            again = 1
            if flag & 8:
                again += raw[at]
                at += 1
            flags += [flag] * again
        axes = []
        for short, same in ((2, 16), (4, 32)):
            value, axis = 0, []
            for flag in flags[:count]:
                if flag & short:
                    value += raw[at] if flag & same else -raw[at]
                    at += 1
                elif not flag & same:
                    value += struct.unpack_from(">h", raw, at)[0]
                    at += 2
                axis.append(value / self.units)
            axes.append(axis)
        points = [(x, y, bool(f & 1)) for x, y, f in zip(*axes, flags, strict=False)]
        return [points[a : b + 1] for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True) if b >= a]

    def _composite(self, raw: bytes, depth: int) -> list:
        out, at, more = [], 10, True
        while more:
            flag, part = struct.unpack_from(">HH", raw, at)
            at += 4
            x, y = struct.unpack_from(">hh" if flag & 1 else ">bb", raw, at)
            at += 4 if flag & 1 else 2
            a, b, c, d = 1.0, 0.0, 0.0, 1.0
            unit = lambda n, at=at: [v / 16384 for v in struct.unpack_from(f">{n}h", raw, at)]
            if flag & 8:
                a, at = unit(1)[0], at + 2
                d = a
            elif flag & 0x40:
                (a, d), at = unit(2), at + 4
            elif flag & 0x80:
                (a, b, c, d), at = unit(4), at + 8
            if not flag & 2:  # points that meet instead of a shift: not used by text of documents
                x = y = 0
            out += [[(a * px + c * py + x / self.units, b * px + d * py + y / self.units, on) for px, py, on in contour] for contour in self.outline(part, depth + 1)]
            more = bool(flag & 0x20)
        return out

    def path(self, glyph: int) -> list[tuple]:
        """M, Q (control and end) and Z in ems; between two points off the curve lies one on it."""
        out: list[tuple] = []
        for contour in self.outline(glyph):
            full: list[tuple[float, float, bool]] = []
            for k, p in enumerate(contour):
                before = contour[k - 1]
                if not p[2] and not before[2]:
                    full.append(((p[0] + before[0]) / 2, (p[1] + before[1]) / 2, True))
                full.append(p)
            start = next((k for k, p in enumerate(full) if p[2]), None)
            if start is None:
                continue
            full = full[start:] + full[:start]
            out.append(("M", *full[0][:2]))
            k = 1
            while k <= len(full):
                p, after = full[k % len(full)], full[(k + 1) % len(full)]
                if p[2]:
                    out.append(("L", *p[:2]))
                    k += 1
                else:
                    out.append(("Q", *p[:2], *after[:2]))
                    k += 2
            out.append(("Z",))
        return out
