"""CFF and Type 1 programs made here."""

import struct

import pytest

from folioforge.sources import charstrings as cs
from folioforge.sources.interpreter import drawn
from folioforge.sources.raster import rendered

from .test_content import page, stream


def num(v: int) -> bytes:
    if -107 <= v <= 107:
        return bytes([v + 139])
    if 108 <= v <= 1131:
        return bytes([247 + (v - 108) // 256, (v - 108) % 256])
    if -1131 <= v <= -108:
        return bytes([251 + (-v - 108) // 256, (-v - 108) % 256])
    return b"\x1c" + struct.pack(">h", v)


def code(*items) -> bytes:
    return b"".join(num(i) if isinstance(i, int) else i for i in items)


def op(*b: int) -> bytes:
    return bytes(b)


def index(items: list[bytes]) -> bytes:
    if not items:
        return b"\0\0"
    ends = [1]
    for i in items:
        ends.append(ends[-1] + len(i))
    return struct.pack(">HB", len(items), 2) + b"".join(struct.pack(">H", e) for e in ends) + b"".join(items)


SQUARE = code(0, 0, op(21), 500, op(6), 500, op(7), -500, op(6), op(14))


def cff(glyph_strings: list[bytes], sids: list[int], names: list[bytes] = (), subrs: list[bytes] = ()) -> bytes:
    head, title = b"\1\0\4\2", index([b"X"])
    place = lambda v: b"\x1d" + struct.pack(">i", v)
    private_body = code(300, op(20), 500, op(21)) + (code(len(code(300, op(20), 500, op(21))) + 2, op(19)) if subrs else b"")
    private = private_body + (index(list(subrs)) if subrs else b"")
    top = lambda a, b, c: place(a) + op(15) + place(b) + op(17) + place(len(private_body)) + place(c) + op(18)
    size = len(head + title + index([top(0, 0, 0)]) + index(list(names)) + index([]))
    charset = b"\0" + b"".join(struct.pack(">H", s) for s in sids[1:])
    strings = index(glyph_strings)
    return head + title + index([top(size, size + len(charset), size + len(charset) + len(strings))]) + index(list(names)) + index([]) + charset + strings + private


def test_standard_names():
    names = cs.standard_strings()
    assert len(names) == 229 and [names[k] for k in (1, 34, 66, 96, 149, 150, 170, 171, 200, 228)] == ["space", "A", "a", "exclamdown", "germandbls", "onesuperior", "copyright", "Aacute", "aacute", "zcaron"]


def test_cff():
    made = cs.Cff(cff([op(14), code(100) + SQUARE, code(107, op(14))], [0, 34, 391], [b"own"]))
    assert made.glyph(65, "A", "") == 1 and made.glyph(65, "", "A") == 1 and made.glyph(65, "", "") == 1 and made.glyph(0, "own", "") == 2 and made.glyph(9, "zz", "") == 0
    path, advance = made.drawn(1)
    assert [p[0] for p in path] == ["M", "L", "L", "L", "Z"] and path[2][1:] == (0.5, 0.5) and advance == pytest.approx(0.6)
    assert made.drawn(0) == ([], 0.3) and made.drawn(2) == ([], pytest.approx(0.607)) and made.drawn(9) == ([], 0)
    for bad in (b"", b"\1\0\4\1\0\0", cff([op(14)], [0])[:25]):
        with pytest.raises(cs.NoProgram):
            cs.Cff(bad)


@pytest.mark.parametrize(
    ("body", "ends"),
    [
        (code(1, 2, op(21), 1, 2, 3, 4, 5, 6, op(8)), (10, 14)),
        (code(1, op(22), 1, 2, 3, 4, op(26)), (3, 8)),
        (code(1, op(4), 9, 1, 2, 3, 4, op(27)), (7, 13)),
        (code(0, op(22), 1, 2, 3, 4, 5, op(31)), (8, 7)),
        (code(0, op(22), 1, 2, 3, 4, 1, 2, 3, 4, op(30)), (9, 11)),
        (code(0, op(22), 1, 2, 3, 4, 5, 6, 7, 8, op(24)), (16, 20)),
        (code(0, op(22), 7, 8, 1, 2, 3, 4, 5, 6, op(25)), (16, 20)),
        (code(0, op(22), 1, 2, 3, 4, 5, 6, 7, op(12, 34)), (25, 0)),
        (code(0, op(22), 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 50, op(12, 35)), (36, 42)),
        (code(0, op(22), 1, 2, 3, 4, 5, 6, 7, 8, 9, op(12, 36)), (31, 0)),
        (code(0, op(22), 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 40, op(12, 37)), (0, 70)),
        (code(10, 3, op(1), 1, 2, 3, 4, op(23), 0, 0, op(21), 5, op(6)), (5, 0)),
        (code(1, 2, 3, 4, op(18), 5, 6, op(19), op(0xE0), 3, op(22), 5, op(6)), (8, 0)),
        (code(-107, op(10), 4, op(6)), (11, 0)),
        (code(0, op(22), 5, 3, op(12, 10), 2, op(12, 24), 4, op(12, 12), op(12, 14), op(12, 9), 1, 2, op(12, 28), op(12, 18), 2, 1, op(12, 30), op(5)), (2, 4)),
    ],
)
def test_type_two_operators(body, ends):
    font = cs.Cff(cff([op(14), body + op(14)], [0, 34], (), [code(7, op(22), op(11))]))
    run = cs._TypeTwo(font, font.privates[0][0])
    run.all(font.strings[1])
    assert (run.pen.x, run.pen.y) == pytest.approx(ends)


def sealed(data: bytes, key: int) -> bytes:
    out = bytearray()
    for c in data:
        v = c ^ key >> 8
        out.append(v)
        key = (v + key) * 52845 + 22719 & 0xFFFF
    return bytes(out)


def type_one(strings: dict[str, bytes], subrs: list[bytes] = (), hexed: bool = False) -> bytes:
    body = lambda raw: sealed(b"\0\0\0\0" + raw, 4330)
    private = b"dup /Private 8 dict dup begin /lenIV 4 def /Subrs %d array\n" % len(subrs) + b"".join(b"dup %d %d RD " % (k, len(body(x))) + body(x) + b" NP\n" for k, x in enumerate(subrs))
    private += b"2 index /CharStrings 9 dict dup begin\n" + b"".join(b"/%s %d RD " % (n.encode(), len(body(x))) + body(x) + b" ND\n" for n, x in strings.items()) + b"end"
    made = sealed(b"\0\0\0\0" + private, 55665)
    return b"%!PS-AdobeFont-1.0: X\n/FontMatrix [0.001 0 0 0.001 0 0] readonly def /Encoding 256 array dup 66 /box put readonly def currentfile eexec\n" + (made.hex().encode() if hexed else made)


def test_type_one():
    box = code(50, 600, op(13), 0, 0, op(21), 500, op(6), 500, op(7), -500, op(6), op(9), op(14))
    e_acute = code(0, 700, op(13), 0, 100, 200, 101, 194, op(12, 6))
    strings = {".notdef": code(0, 250, op(13), op(14)), "box": box, "e": box, "acute": code(0, 300, op(13), 10, op(22), 20, op(6), 20, op(7), op(9), op(14)), "eacute": e_acute}
    for hexed in (False, True):
        made = cs.TypeOne(type_one(strings, (), hexed))
        assert made.glyph(66, "", "") == "box" and made.glyph(0, "", "é") == "eacute" and made.glyph(9, "", "") == ".notdef"
        path, advance = made.drawn("box")
        assert path[0] == ("M", 0.05, 0) and path[2] == ("L", pytest.approx(0.55), 0.5) and advance == 0.6
        path, advance = made.drawn("eacute")
        assert advance == pytest.approx(0.7) and [p[0] for p in path].count("M") == 2 and path[5][1:] == pytest.approx((0.11, 0.2))
    flex = [code(0, 400, op(13), 0, op(22), 0, 1, op(12, 16)), *[code(v, 0, op(21), 0, 2, op(12, 16)) for v in (1, 1, 2, 3, 4, 5, 6)], code(50, 21, 0, 3, 0, op(12, 16), op(12, 17), op(12, 17), op(12, 33), op(14))]
    run = cs._TypeOne(cs.TypeOne(type_one({"f": b"".join(flex)})))
    run.all(run.font.strings["f"])
    assert [p[0] for p in run.pen.path] == ["M", "C", "C", "Z"] and run.pen.path[2][5:] == (22, 0)
    divided = cs._TypeOne(made)
    divided.all(code(0, 100, op(13), 0, op(22), 9, 3, op(12, 12), op(6), 1, 2, 3, 4, op(30), 1, 2, 3, 4, op(31)))
    assert (divided.pen.x, divided.pen.y) == (3 + 2 + 4 + 1 + 2, 1 + 3 + 3 + 4)
    segments = lambda data: b"\x80\1" + struct.pack("<I", 5) + data[:5] + b"\x80\2" + struct.pack("<I", len(data) - 5) + data[5:] + b"\x80\3"
    assert cs.TypeOne(segments(type_one(strings))).drawn("box")[1] == 0.6
    for bad in (b"", b"eexec", type_one({})):
        with pytest.raises(cs.NoProgram):
            cs.TypeOne(bad)


def test_pages_use_programs():
    data = cff([op(14), code(100) + SQUARE], [0, 34])
    font = "/Font << /F << /Subtype /Type1 /BaseFont /X /FontDescriptor << /FontFile3 5 0 R >> >> >>"
    d = page("BT /F 40 Tf 10 10 Td (AA) Tj ET", font, stream(data.decode("latin-1")))
    out = drawn(d, d.pages[0])
    assert [round(c["ox"], 6) for c in out.chars] == [10, 34]
    made = rendered(d, d.pages[0], 1.0).astype(int)
    assert made[80, 20, 0] == 0 and made[80, 32, 0] == 255 and made[80, 40, 0] == 0
    wide = "/Font << /F << /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [<< /DW 600 /FontDescriptor << /FontFile3 5 0 R >> >>] >> >>"
    d = page("BT /F 40 Tf 10 10 Td <0001> Tj ET", wide, stream(data.decode("latin-1")))
    assert rendered(d, d.pages[0], 1.0).astype(int)[80, 20, 0] == 0
    one = type_one({".notdef": code(0, 250, op(13), op(14)), "box": code(0, 600, op(13), 0, 0, op(21), 500, op(6), 500, op(7), -500, op(6), op(9), op(14))})
    d = page("BT /F 40 Tf 10 10 Td (B) Tj ET", "/Font << /F << /Subtype /Type1 /BaseFont /X /FontDescriptor << /FontFile 5 0 R >> >> >>", stream(one.decode("latin-1")))
    assert rendered(d, d.pages[0], 1.0).astype(int)[80, 20, 0] == 0
