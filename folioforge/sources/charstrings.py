"""CFF and Type 1 programs: names, advances and outlines of glyphs, by the public specifications."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

from . import glyphs

CALLS_MOST, STACK_MOST, STEPS_MOST, GLYPHS_MOST = 10, 513, 1 << 16, 1 << 16
MATRIX = [0.001, 0.0, 0.0, 0.001, 0.0, 0.0]


class NoProgram(ValueError):
    pass


class _Stops(Exception):
    pass


class Pen:
    """An outline in em units as it is drawn; subpaths are closed when the next begins."""

    def __init__(self):
        self.path: list[tuple] = []
        self.x = self.y = 0.0
        self.open = False

    def move(self, dx: float, dy: float) -> None:
        self.close()
        self.x, self.y = self.x + dx, self.y + dy
        self.path.append(("M", self.x, self.y))
        self.open = True

    def line(self, dx: float, dy: float) -> None:
        self.x, self.y = self.x + dx, self.y + dy
        self.path.append(("L", self.x, self.y))

    def curve(self, a: float, b: float, c: float, d: float, e: float, f: float) -> None:
        x1, y1 = self.x + a, self.y + b
        x2, y2 = x1 + c, y1 + d
        self.x, self.y = x2 + e, y2 + f
        self.path.append(("C", x1, y1, x2, y2, self.x, self.y))

    def close(self) -> None:
        if self.open:
            self.path.append(("Z",))
        self.open = False


def mapped(path: list[tuple], m: list[float]) -> list[tuple]:
    return [(p[0], *(v for k in range(1, len(p), 2) for v in (m[0] * p[k] + m[2] * p[k + 1] + m[4], m[1] * p[k] + m[3] * p[k + 1] + m[5]))) for p in path]


# ---- CFF


def standard_strings() -> list[str]:
    """The first 229 standard names by their rule: ASCII and the upper half in the order of the standard encoding, then 21 signs, then
    letters with accents by name, capitals first."""
    of = {text: name for name, text in glyphs.NAMED.items()} | {d: n for n, d in zip(glyphs.DIGITS, "0123456789", strict=True)}
    ascii_ = [glyphs.STANDARD.get(code) or of.get(chr(code), chr(code)) for code in range(32, 127)]
    upper = [name for code, name in sorted(glyphs.STANDARD.items()) if code > 127]
    signs = "onesuperior logicalnot mu trademark Eth onehalf plusminus Thorn onequarter divide brokenbar degree thorn threequarters twosuperior registered minus eth multiply threesuperior copyright".split()
    accents = {"acute": "AEIOUY", "circumflex": "AEIOU", "dieresis": "AEIOUY", "grave": "AEIOU", "ring": "A", "tilde": "ANO", "cedilla": "C", "caron": "SZ"}
    capitals = sorted(letter + accent for accent, letters in accents.items() for letter in letters)
    return [".notdef", *ascii_, *upper, *signs, *capitals, *(n[0].lower() + n[1:] for n in capitals)]


def _index(data: bytes, at: int) -> tuple[list[bytes], int]:
    (count,) = struct.unpack_from(">H", data, at)
    if not count:
        return [], at + 2
    size = data[at + 2]
    if not 1 <= size <= 4:
        raise NoProgram("index")
    offsets = [int.from_bytes(data[at + 3 + size * k : at + 3 + size * (k + 1)], "big") for k in range(count + 1)]
    base = at + 2 + size * (count + 1)
    return [data[base + a : base + b] for a, b in zip(offsets, offsets[1:], strict=False)], base + offsets[-1]


def _dict(data: bytes) -> dict[int, list[float]]:
    """Operator (two-byte ones from 1200 on) to operands."""
    out, stack, at = {}, [], 0
    while at < len(data):
        b = data[at]
        at += 1
        if b <= 21:
            if b == 12 and at < len(data):
                b = 1200 + data[at]
                at += 1
            out[b] = stack
            stack = []
        elif b == 28:
            stack.append(int.from_bytes(data[at : at + 2], "big", signed=True))
            at += 2
        elif b == 29:
            stack.append(int.from_bytes(data[at : at + 4], "big", signed=True))
            at += 4
        elif b == 30:
            text = ""
            while at < len(data):
                pair = data[at]
                at += 1
                text += "".join("0123456789.EN?-"[n] if n < 15 else " " for n in (pair >> 4, pair & 15))
                if 15 in (pair >> 4, pair & 15):
                    break
            try:
                stack.append(float(text.split(" ")[0].replace("N", "E-")))
            except ValueError:
                stack.append(0.0)
        elif 32 <= b <= 246:
            stack.append(b - 139)
        elif 247 <= b <= 250 and at < len(data):
            stack.append((b - 247) * 256 + data[at] + 108)
            at += 1
        elif 251 <= b <= 254 and at < len(data):
            stack.append(-(b - 251) * 256 - data[at] - 108)
            at += 1
    return out


class Cff:
    def __init__(self, data: bytes):
        try:
            self._read(data)
        except (struct.error, IndexError, ValueError) as error:
            raise NoProgram("CFF") from error

    def _read(self, data: bytes) -> None:
        _, at = _index(data, data[2])
        tops, at = _index(data, at)
        strings, at = _index(data, at)
        self.subrs, _ = _index(data, at)
        top = _dict(tops[0])
        self.matrix = [float(v) for v in top.get(1207, MATRIX)]
        self.strings, _ = _index(data, int(top[17][0]))
        if len(self.strings) > GLYPHS_MOST:
            raise NoProgram("too many glyphs")
        names = standard_strings()
        said = lambda sid: names[sid] if sid < len(names) else strings[sid - 391].decode("latin-1") if 391 <= sid < 391 + len(strings) else ""
        self.by_cid = 1230 in top
        sids = self._charset(data, int(top.get(15, [0])[0]))
        self.glyph_of = {(s if self.by_cid else said(s)): k for k, s in reversed(list(enumerate(sids)))}
        self.names = [said(s) for s in sids] if not self.by_cid else []
        self.codes = {} if self.by_cid else self._encoding(data, int(top.get(16, [0])[0]))
        if self.by_cid:
            dicts, _ = _index(data, int(top[1236][0]))
            fonts = [_dict(d) for d in dicts]
            self.privates = [self._private(data, d) for d in fonts]
            self.matrices = [[float(v) for v in d[1207]] if 1207 in d else None for d in fonts]
            self.select = self._select(data, int(top[1237][0]))
        else:
            self.privates, self.matrices, self.select = [self._private(data, top)], [None], [0] * len(self.strings)

    def _charset(self, data: bytes, at: int) -> list[int]:
        n, out = len(self.strings), [0]
        if at <= 2:
            return list(range(n))
        kind, at = data[at], at + 1
        while len(out) < n:
            (first,) = struct.unpack_from(">H", data, at)
            left = 0 if kind == 0 else data[at + 2] if kind == 1 else struct.unpack_from(">H", data, at + 2)[0]
            at += (2, 3, 4)[kind]
            out += range(first, first + left + 1)
        return out[:n]

    def _encoding(self, data: bytes, at: int) -> dict[int, int]:
        if at <= 1:
            return {code: self.glyph_of[name] for code, name in _standard_names().items() if name in self.glyph_of}
        out, kind, count, glyph = {}, data[at] & 127, data[at + 1], 1
        for k in range(count):
            first, left = (data[at + 2 + k], 0) if kind == 0 else (data[at + 2 + 2 * k], data[at + 3 + 2 * k])
            for code in range(first, first + left + 1):
                out[code] = glyph
                glyph += 1
        return out

    def _select(self, data: bytes, at: int) -> list[int]:
        n = len(self.strings)
        if data[at] == 0:
            return list(data[at + 1 : at + 1 + n])
        (ranges,) = struct.unpack_from(">H", data, at + 1)
        out: list[int] = []
        for k in range(ranges):
            first, which, after = struct.unpack_from(">HBH", data, at + 3 + 3 * k)
            out += [which] * (min(after, n) - first)
        return out

    def _private(self, data: bytes, entries: dict) -> tuple[list[bytes], float, float]:
        """Subroutines, and the advance that is left out and the one that others are counted from."""
        if 18 not in entries or len(entries[18]) < 2:
            return [], 0.0, 0.0
        size, at = (int(v) for v in entries[18])
        found = _dict(data[at : at + size])
        subrs, _ = _index(data, at + int(found[19][0])) if 19 in found else ([], 0)
        return subrs, float(found.get(20, [0])[-1]), float(found.get(21, [0])[-1])

    def glyph(self, code: int, name: str, text: str) -> int:
        """By glyph name, by what names show, or by the program's own codes."""
        if name in self.glyph_of:
            return self.glyph_of[name]
        if text:
            for k, own in enumerate(self.names):
                if own and glyphs.text_of(own) == text:
                    return k
        return self.codes.get(code, 0)

    def drawn(self, glyph: int) -> tuple[list[tuple], float]:
        """Outline and advance in ems; nothing for what is no glyph."""
        if not 0 <= glyph < len(self.strings):
            return [], 0.0
        which = self.select[glyph] if glyph < len(self.select) else 0
        subrs, left_out, counted_from = self.privates[min(which, len(self.privates) - 1)]
        run = _TypeTwo(self, subrs)
        run.all(self.strings[glyph])
        m = self.matrices[min(which, len(self.matrices) - 1)] or self.matrix
        advance = left_out if run.advance is None else counted_from + run.advance
        return mapped(run.pen.path, m), advance * m[0]


def _standard_names() -> dict[int, str]:
    names = standard_strings()
    return {32 + k: n for k, n in enumerate(names[1:96])} | {code: name for code, name in glyphs.STANDARD.items() if code > 127}


class _TypeTwo:
    """One charstring of a CFF program."""

    def __init__(self, font: Cff, subrs: list[bytes]):
        self.font, self.subrs, self.pen, self.stack = font, subrs, Pen(), []
        self.hints, self.advance, self.first, self.steps, self.kept = 0, None, True, 0, [0.0] * 32

    def all(self, data: bytes) -> None:
        try:
            self.run(data, 0)
        except (_Stops, IndexError, ValueError, ZeroDivisionError, OverflowError):
            pass
        self.pen.close()

    def taken(self, even: bool | None, n: int = 0) -> list[float]:
        """The operands; the first drawing operator may have the advance before its own."""
        args, self.stack = self.stack, []
        if self.first:
            self.first = False
            if len(args) % 2 if even else len(args) > n:
                self.advance, args = args[0], args[1:]
        return args

    def run(self, data: bytes, depth: int) -> None:
        if depth > CALLS_MOST:
            raise _Stops
        at = 0
        while at < len(data):
            self.steps += 1
            if self.steps > STEPS_MOST or len(self.stack) > STACK_MOST:
                raise _Stops
            b = data[at]
            at += 1
            if b == 28:
                self.stack.append(int.from_bytes(data[at : at + 2], "big", signed=True))
                at += 2
            elif b == 255:
                self.stack.append(int.from_bytes(data[at : at + 4], "big", signed=True) / 65536)
                at += 4
            elif b >= 32:
                if b <= 246:
                    self.stack.append(b - 139)
                else:
                    more = data[at]
                    at += 1
                    self.stack.append((b - 247) * 256 + more + 108 if b <= 250 else -(b - 251) * 256 - more - 108)
            elif b in (1, 3, 18, 23):
                self.hints += len(self.taken(True)) // 2
            elif b in (19, 20):
                self.hints += len(self.taken(True)) // 2
                at += (self.hints + 7) // 8
            elif b in (10, 29):
                table = self.subrs if b == 10 else self.font.subrs
                shift = 107 if len(table) < 1240 else 1131 if len(table) < 33900 else 32768
                self.run(table[int(self.stack.pop()) + shift], depth + 1)
            elif b == 11:
                return
            elif b == 14:
                args = self.taken(None, 4 if len(self.stack) >= 4 else 0)
                if len(args) >= 4:
                    self.accented(args[-4:])
                raise _Stops
            elif b == 12:
                b2 = data[at]
                at += 1
                self.more(b2)
            else:
                self.draw(b)

    def accented(self, args: list[float]) -> None:
        x, y, base, accent = args
        self.pen.close()
        for code, dx, dy in ((base, 0.0, 0.0), (accent, x, y)):
            glyph = self.font.glyph_of.get(_standard_names().get(int(code), ""))
            if glyph:
                part = _TypeTwo(self.font, self.subrs)
                part.all(self.font.strings[glyph])
                self.pen.path += mapped(part.pen.path, [1.0, 0.0, 0.0, 1.0, dx, dy])

    def draw(self, b: int) -> None:
        pen = self.pen
        if b == 21:
            pen.move(*self.taken(None, 2)[-2:])
        elif b == 22:
            pen.move(self.taken(None, 1)[-1], 0.0)
        elif b == 4:
            pen.move(0.0, self.taken(None, 1)[-1])
        else:
            args, self.stack = self.stack, []
            if b == 5:
                for k in range(0, len(args) - 1, 2):
                    pen.line(args[k], args[k + 1])
            elif b in (6, 7):
                for k, v in enumerate(args):
                    pen.line(*((v, 0.0) if (k % 2 == 0) == (b == 6) else (0.0, v)))
            elif b == 8:
                for k in range(0, len(args) - 5, 6):
                    pen.curve(*args[k : k + 6])
            elif b == 24:
                for k in range(0, len(args) - 7, 6):
                    pen.curve(*args[k : k + 6])
                pen.line(*args[-2:])
            elif b == 25:
                for k in range(0, len(args) - 7, 2):
                    pen.line(args[k], args[k + 1])
                pen.curve(*args[-6:])
            elif b in (26, 27):
                across = args.pop(0) if len(args) % 4 else 0.0
                for k in range(0, len(args) - 3, 4):
                    a, c, d, e = args[k : k + 4]
                    pen.curve(*((across, a, c, d, 0.0, e) if b == 26 else (a, across, c, d, e, 0.0)))
                    across = 0.0
            elif b in (30, 31):
                flat = b == 31
                while len(args) >= 4:
                    a, c, d, e = args[:4]
                    last = args[4] if len(args) == 5 else 0.0
                    pen.curve(*((a, 0.0, c, d, last, e) if flat else (0.0, a, c, d, e, last)))
                    args, flat = args[4:], not flat

    def more(self, b: int) -> None:
        s = self.stack
        if b in (34, 35, 36, 37):
            args, self.stack = s, []
            if b == 35:
                curves = args[:6], args[6:12]
            elif b == 34:
                a, c, d, e, f, g, h = args[:7]
                curves = (a, 0.0, c, d, e, 0.0), (f, 0.0, g, -d, h, 0.0)
            elif b == 36:
                a, c, d, e, f, g, h, i, j = args[:9]
                curves = (a, c, d, e, f, 0.0), (g, 0.0, h, i, j, -(c + e + i))
            else:
                x, y = sum(args[0:10:2]), sum(args[1:10:2])
                last = (args[10], -y) if abs(x) > abs(y) else (-x, args[10])
                curves = args[:6], (*args[6:10], *last)
            for c in curves:
                self.pen.curve(*c)
            return
        one = {9: abs, 14: lambda v: -v, 26: lambda v: v**0.5, 5: lambda v: float(not v)}
        two: dict[int, Callable] = {3: lambda a, c: float(bool(a and c)), 4: lambda a, c: float(bool(a or c)), 10: lambda a, c: a + c, 11: lambda a, c: a - c, 12: lambda a, c: a / c, 15: lambda a, c: float(a == c), 24: lambda a, c: a * c}
        if b in one:
            s.append(one[b](s.pop()))
        elif b in two:
            c, a = s.pop(), s.pop()
            s.append(two[b](a, c))
        elif b == 18:
            s.pop()
        elif b == 20:
            k, v = int(s.pop()), s.pop()
            self.kept[k] = v
        elif b == 21:
            s.append(self.kept[int(s.pop())])
        elif b == 22:
            v2, v1, s2, s1 = s.pop(), s.pop(), s.pop(), s.pop()
            s.append(s1 if v1 <= v2 else s2)
        elif b == 23:
            s.append(0.5)
        elif b == 27:
            s.append(s[-1])
        elif b == 28:
            s[-2:] = s[-1], s[-2]
        elif b == 29:
            k = int(s.pop())
            s.append(s[-1 - max(k, 0)])
        elif b == 30:
            turn, n = int(s.pop()), int(s.pop())
            if 0 < n <= len(s) and (turn := turn % n):
                s[-n:] = s[-turn:] + s[-n:-turn]


# ---- Type 1


def decrypted(data: bytes, key: int, skip: int) -> bytes:
    out = bytearray()
    for c in data:
        out.append(c ^ key >> 8)
        key = (c + key) * 52845 + 22719 & 0xFFFF
    return bytes(out[skip:])


class TypeOne:
    def __init__(self, data: bytes):
        data = self._joined(data)
        begin = data.find(b"eexec")
        if begin < 0:
            raise NoProgram("no private part")
        clear, sealed = data[:begin], data[begin + 5 :].lstrip(b" \t\r\n")
        if re.fullmatch(rb"[0-9A-Fa-f\s]{8}", sealed[:8]):
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", sealed)
            sealed = bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
        private = decrypted(sealed, 55665, 4)
        m = re.search(rb"/FontMatrix\s*\[([^\]]*)\]", clear)
        try:
            found = [float(v) for v in m[1].split()] if m else []
        except ValueError:
            found = []
        self.matrix = found if len(found) == 6 else MATRIX
        self.codes = {int(c): n.decode("latin-1") for c, n in re.findall(rb"dup\s+(\d+)\s*/([^\s/]+)\s+put", clear)}
        m = re.search(rb"/lenIV\s+(-?\d+)", private)
        skip = int(m[1]) if m else 4
        opened = lambda raw: raw if skip < 0 else decrypted(raw, 4330, skip)
        self.subrs, self.strings = {}, {}
        at = 0
        pattern = re.compile(rb"(?:dup\s+(\d+)|/([^\s/]+))\s+(\d+)\s+(?:RD|-\||\S+)\s")
        while (m := pattern.search(private, at)) and len(self.strings) < GLYPHS_MOST:
            size = int(m[3])
            raw = private[m.end() : m.end() + size]
            follows = private[m.end() + size : m.end() + size + 12].split()
            word = private[m.start(3) : m.end()].split()[-1]
            if len(raw) < size or word not in (b"RD", b"-|") and (not follows or follows[0] not in (b"ND", b"|-", b"NP", b"|", b"noaccess", b"def", b"put")):
                at = m.start() + 1
                continue
            if m[1] is not None:
                self.subrs.setdefault(int(m[1]), opened(raw))
            else:
                self.strings.setdefault(m[2].decode("latin-1"), opened(raw))
            at = m.end() + size
        if not self.strings:
            raise NoProgram("no glyphs")

    @staticmethod
    def _joined(data: bytes) -> bytes:
        """The segments of a file that has them, one after another."""
        if data[:1] != b"\x80":
            return data
        out, at = b"", 0
        while at + 6 <= len(data) and data[at] == 0x80 and data[at + 1] in (1, 2):
            size = int.from_bytes(data[at + 2 : at + 6], "little")
            out += data[at + 6 : at + 6 + size]
            at += 6 + size
        return out

    def glyph(self, code: int, name: str, text: str) -> str:
        if name in self.strings:
            return name
        if text:
            found = next((n for n in self.strings if glyphs.text_of(n) == text), None)
            if found is not None:
                return found
        return self.codes.get(code, ".notdef")

    def drawn(self, glyph: str) -> tuple[list[tuple], float]:
        """Outline and advance in ems."""
        if glyph not in self.strings:
            return [], 0.0
        run = _TypeOne(self)
        run.all(self.strings[glyph])
        return mapped(run.pen.path, self.matrix), run.advance * self.matrix[0]


class _TypeOne:
    """One charstring of a Type 1 program."""

    def __init__(self, font: TypeOne):
        self.font, self.pen, self.stack, self.given = font, Pen(), [], []
        self.advance, self.flex, self.steps, self.side = 0.0, None, 0, 0.0

    def all(self, data: bytes) -> None:
        try:
            self.run(data, 0)
        except (_Stops, IndexError, ValueError, KeyError, ZeroDivisionError, TypeError):
            pass
        self.pen.close()

    def run(self, data: bytes, depth: int) -> None:
        if depth > CALLS_MOST:
            raise _Stops
        at, s = 0, self.stack
        while at < len(data):
            self.steps += 1
            if self.steps > STEPS_MOST:
                raise _Stops
            b = data[at]
            at += 1
            if b >= 32:
                if b <= 246:
                    s.append(b - 139)
                elif b == 255:
                    s.append(int.from_bytes(data[at : at + 4], "big", signed=True))
                    at += 4
                else:
                    s.append((b - 247) * 256 + data[at] + 108 if b <= 250 else -(b - 251) * 256 - data[at] - 108)
                    at += 1
            elif b == 10:
                self.run(self.font.subrs[int(s.pop())], depth + 1)
            elif b == 11:
                return
            elif b == 12:
                b2 = data[at]
                at += 1
                if b2 == 12:
                    c, a = s.pop(), s.pop()
                    s.append(a / c)
                elif b2 == 16:
                    self.other()
                elif b2 == 17:
                    s.append(self.given.pop() if self.given else 0.0)
                else:
                    self.more(b2)
                    s.clear()
            else:
                self.draw(b)
                s.clear()

    def move(self, dx: float, dy: float) -> None:
        if self.flex is not None:
            self.flex.append((dx, dy))
        else:
            self.pen.move(dx, dy)

    def draw(self, b: int) -> None:
        s, pen = self.stack, self.pen
        if b == 13:
            self.side, self.advance = s[0], s[1]
            pen.x = s[0]
        elif b == 21:
            self.move(s[-2], s[-1])
        elif b == 22:
            self.move(s[-1], 0.0)
        elif b == 4:
            self.move(0.0, s[-1])
        elif b == 5:
            pen.line(s[0], s[1])
        elif b == 6:
            pen.line(s[0], 0.0)
        elif b == 7:
            pen.line(0.0, s[0])
        elif b == 8:
            pen.curve(*s[:6])
        elif b == 30:
            pen.curve(0.0, s[0], s[1], s[2], s[3], 0.0)
        elif b == 31:
            pen.curve(s[0], 0.0, s[1], s[2], 0.0, s[3])
        elif b == 9:
            pen.close()
        elif b == 14:
            raise _Stops

    def more(self, b: int) -> None:
        s = self.stack
        if b == 7:
            self.side, self.advance = s[0], s[2]
            self.pen.x, self.pen.y = s[0], s[1]
        elif b == 33:
            self.pen.x, self.pen.y = s[0], s[1]
        elif b == 6:
            side, x, y, base, accent = s[:5]
            names = _standard_names()
            for code, dx, dy in ((base, 0.0, 0.0), (accent, self.side - side + x, y)):
                part = _TypeOne(self.font)
                part.all(self.font.strings[names[int(code)]])
                self.pen.path += mapped(part.pen.path, [1.0, 0.0, 0.0, 1.0, dx, dy])
            raise _Stops

    def other(self) -> None:
        """Subroutines outside the font: a flex is two curves over seven points, the first of them only a reference."""
        s = self.stack
        which, n = int(s.pop()), int(s.pop())
        args = [s.pop() for _ in range(n)]
        if which == 1:
            self.flex = []
        elif which == 0 and self.flex is not None and len(self.flex) >= 7:
            p, self.flex = self.flex, None
            start = (p[0][0] + p[1][0], p[0][1] + p[1][1])
            self.pen.curve(*start, *p[2], *p[3])
            self.pen.curve(*p[4], *p[5], *p[6])
            self.given = [self.pen.y, self.pen.x]
        elif which == 3:
            self.given = [3.0]
        elif which != 2:
            self.given = args
