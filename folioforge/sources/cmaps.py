"""Character maps: code lengths, codes to glyph numbers and codes to text, as tables of ranges."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

from .objects import Damaged, Name, Reader

RANGES_MOST, SPACES_MOST, BASES_MOST, UNITS_MOST = 1 << 16, 128, 4, 256


@dataclass
class CMap:
    """spaces: (bytes, low, high).  cids and texts: length of the code in bytes -> (low, high, value) in file order;
    value is the number, or the UTF-16 units, of the lowest code."""

    spaces: list[tuple[int, int, int]] = field(default_factory=list)
    cids: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    texts: dict[int, list[tuple[int, int, tuple[int, ...]]]] = field(default_factory=dict)
    vertical: bool = False
    base: CMap | None = None
    identity: bool = False

    def __post_init__(self):
        self._sorted: dict = {}

    def split(self, raw: bytes) -> list[tuple[int, int]]:
        """(code, its length) of each character of a string."""
        if self.identity or not self.spaces:
            return [(int.from_bytes(raw[k : k + 2], "big"), min(2, len(raw) - k)) for k in range(0, len(raw), 2)]
        out, at = [], 0
        sizes = sorted({n for n, _, _ in self.spaces})
        while at < len(raw):
            for n in sizes:
                part = raw[at : at + n]
                if len(part) == n and any(size == n and _inside(part, low, high) for size, low, high in self.spaces):
                    break
            else:  # no range has this code: the shortest length whose first byte fits, or the shortest of all
                n = next((n for n in sizes if any(size == n and low >> 8 * (n - 1) <= raw[at] <= high >> 8 * (n - 1) for size, low, high in self.spaces)), sizes[0])
            part = raw[at : at + n]
            out.append((int.from_bytes(part, "big"), len(part)))
            at += n
        return out

    def _find(self, kind: str, code: int, size: int):
        """The last range in order of its start that holds the code; those of the code's own length come first."""
        table = getattr(self, kind)
        for n in [size, *sorted(n for n in table if n != size)]:
            if n not in table:
                continue
            if (kind, n) not in self._sorted:
                ranges = sorted(enumerate(table[n]), key=lambda r: (r[1][0], r[0]))
                self._sorted[kind, n] = [r[0] for _, r in ranges], [r for _, r in ranges]
            starts, ranges = self._sorted[kind, n]
            for k in range(bisect_right(starts, code) - 1, -1, -1):
                low, high, value = ranges[k]
                if code <= high:
                    return low, value
                if code - low > 1 << 16:
                    break
        return None

    def cid(self, code: int, size: int) -> int:
        if self.identity:
            return code
        found = self._find("cids", code, size)
        if found:
            return found[1] + code - found[0]
        return self.base.cid(code, size) if self.base else 0

    def text(self, code: int, size: int) -> str | None:
        found = self._find("texts", code, size)
        if not found:
            return self.base.text(code, size) if self.base else None
        low, units = found
        units = (*units[:-1], (units[-1] + code - low) & 0xFFFF)
        return b"".join(u.to_bytes(2, "big") for u in units).decode("utf-16-be", "replace")


def _inside(part: bytes, low: int, high: int) -> bool:
    n = len(part)
    return all(a <= x <= b for a, x, b in zip(low.to_bytes(n, "big"), part, high.to_bytes(n, "big"), strict=True))


def predefined(name: str) -> CMap | None:
    return CMap(identity=True, vertical=name == "Identity-V") if name in ("Identity-H", "Identity-V") else None


def _units(value) -> tuple[int, ...] | None:
    if not isinstance(value, bytes) or not value:
        return None
    value = value[: 2 * UNITS_MOST]
    return (value[0],) if len(value) == 1 else tuple(int.from_bytes(value[k : k + 2], "big") for k in range(0, len(value) - 1, 2))


def parse(data: bytes, find=None, depth: int = 0) -> CMap:
    """A character map from its program; find(name) gives the data or the map that `usecmap` names."""
    made, stack, reader = CMap(), [], Reader(data)
    counted = 0
    from .content import WORD

    while reader.at < len(data):
        m = WORD.match(data, reader.at)
        if not m or m[1] in (b"true", b"false", b"null"):
            before = reader.at
            try:
                stack.append(reader.value())
            except (Damaged, ValueError):
                reader.at = max(reader.at, before + 1)
            del stack[: -4 * 256]
            continue
        reader.at, word = m.end(), m[1].decode()
        if word == "usecmap" and stack and isinstance(stack[-1], Name) and depth < BASES_MOST:
            base = predefined(str(stack[-1])) or (find(str(stack[-1])) if find else None)
            made.base = parse(base, find, depth + 1) if isinstance(base, bytes) else base
        elif word == "def" and len(stack) >= 2 and stack[-2] == "WMode":
            made.vertical = stack[-1] == 1
        elif word == "endcodespacerange":
            for low, high in zip(stack[::2], stack[1::2], strict=False):
                if isinstance(low, bytes) and isinstance(high, bytes) and 1 <= len(low) == len(high) <= 4 and len(made.spaces) < SPACES_MOST:
                    made.spaces.append((len(low), int.from_bytes(low, "big"), int.from_bytes(high, "big")))
        elif word in ("endcidrange", "endbfrange", "endcidchar", "endbfchar"):
            step = 3 if "range" in word else 2
            table = made.cids if "cid" in word else made.texts
            for k in range(0, len(stack) - step + 1, step):
                low, high, value = stack[k], stack[k + step - 2], stack[k + step - 1]
                if not isinstance(low, bytes) or not isinstance(high, bytes) or not 1 <= len(low) <= 4:
                    continue
                a, b = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                found = table.setdefault(len(low), [])
                if "cid" in word:
                    each = [(a, b, value)] if isinstance(value, int) and not isinstance(value, bool) else []
                elif isinstance(value, list):
                    each = [(a + j, a + j, _units(v)) for j, v in enumerate(value[: b - a + 1])]
                else:
                    each = [(a, b, _units(value))]
                for one in each:
                    if one[1] >= one[0] and one[2] is not None and counted < RANGES_MOST:
                        found.append(one)
                        counted += 1
        elif not word.startswith("begin"):
            pass
        stack = []
    return made


def ranges(made: CMap) -> list[dict]:
    """Rows of the table of ranges: kind, depth of the base it comes from, code length, low, high, number or text."""
    out, depth = [], 0
    while made is not None:
        out += [{"kind": "space", "depth": depth, "size": n, "low": a, "high": b, "number": None, "text": None} for n, a, b in made.spaces]
        out += [{"kind": "cid", "depth": depth, "size": n, "low": a, "high": b, "number": v, "text": None} for n, rows in made.cids.items() for a, b, v in rows]
        out += [{"kind": "text", "depth": depth, "size": n, "low": a, "high": b, "number": None, "text": b"".join(u.to_bytes(2, "big") for u in v).decode("utf-16-be", "replace")} for n, rows in made.texts.items() for a, b, v in rows]
        made, depth = made.base, depth + 1
    return out
