"""Fonts, character maps, functions, colours and what pages draw, on small files made here."""

import math

import pytest

from folioforge.sources import cmaps, colours, formulas, fonts, glyphs, metrics
from folioforge.sources.content import operations
from folioforge.sources.document import Document, percent_decoded
from folioforge.sources.documents import authenticated, character_maps, chars, draw_ops, has_labels, labels, objects, page_sizes, pages_with_label, parsed, parsed_one, public_links, table_of_contents
from folioforge.sources.interpreter import drawn
from folioforge.sources.objects import File, Name, Stream

from .test_documents import SMALL, file_of


def stream(data: str, entries: str = "") -> str:
    return f"<< {entries} /Length {len(data)} >>\nstream\n{data}\nendstream"


def page(content: str, resources: str = "", *more: str, extra: str = "") -> Document:
    return Document(file_of("<< /Type /Catalog /Pages 2 0 R >>", "<< /Kids [3 0 R] >>", f"<< /Type /Page /MediaBox [0 0 200 100] /Contents 4 0 R /Resources << {resources} >> {extra} >>", stream(content), *more))


def ops(doc: Document) -> list[dict]:
    return drawn(doc, doc.pages[0]).ops


HELVETICA = "/Font << /F << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> >>"


def test_standard_fonts_have_their_widths_and_heights():
    made = drawn(d := page("BT /F 20 Tf 30 40 Td (Repaired) Tj ET", HELVETICA), d.pages[0]).chars
    assert "".join(chr(c["rune"]) for c in made) == "Repaired"
    assert abs(made[-1]["ex"] - 111.14) < 1e-6 and made[0]["quad"][1] == pytest.approx(60 - 21.5) and made[0]["quad"][5] == pytest.approx(60 + 5.98)
    assert metrics.standard_name("ABCDEF+Arial,BoldItalic") == "Helvetica-BoldOblique" and metrics.standard_name("Arial", metrics.SERIF) == "Helvetica"
    assert metrics.standard_name("Georgia") == "Times-Roman" and metrics.standard_name("X", metrics.FIXED_PITCH | metrics.ITALIC) == "Courier-Oblique"
    for name, table in metrics.WIDTHS.items():
        assert sorted("".join(table.values())) == [chr(c) for c in range(32, 127)], name
    assert metrics.width("Times-Roman", "Á") == 722 and metrics.width("Helvetica", "í") == 278 and metrics.width("Symbol", "α") == 631


def test_glyph_names_and_encodings():
    assert [glyphs.text_of(n) for n in ("Aacute", "five", "alpha", "Omega", "uni00410042", "u1F600", "f_i", "a.alt", "quoteright", "nothing", ".notdef")] == ["Á", "5", "α", "Ω", "AB", "😀", "fi", "a", "’", "", ""]
    assert glyphs.encoding("WinAnsiEncoding")[0x80] == "€" and glyphs.encoding("MacRomanEncoding")[0x80] == "Ä" and glyphs.encoding("")[0x27] == "’" and glyphs.encoding("")[0xAE] == "ﬁ"
    d = page(r"BT /F 10 Tf (A\256B) Tj ET", "/Font << /F << /Subtype /Type1 /BaseFont /Helvetica /Encoding << /Differences [65 /eacute 174 /ffi] >> >> >>")
    assert "".join(chr(c["rune"]) for c in drawn(d, d.pages[0]).chars) == "éffiB"


CMAP = """/CIDInit /ProcSet findresource begin begincmap /WMode 0 def
2 begincodespacerange <00> <7f> <8000> <ffff> endcodespacerange
2 begincidrange <00> <10> 5 <8000> <80ff> 100 endcidrange 1 begincidchar <8005> 7 endcidchar
1 beginbfchar <41> <00660069> endbfchar 2 beginbfrange <50> <52> <0061> <8000> <8001> [<0062> <D83DDE00>] endbfrange endcmap"""


def test_character_maps():
    made = cmaps.parse(CMAP.encode())
    assert made.split(b"\x05\x80\x05\x7f") == [(5, 1), (0x8005, 2), (0x7F, 1)]
    assert (made.cid(3, 1), made.cid(0x8004, 2), made.cid(0x8005, 2), made.cid(0x20, 1)) == (8, 104, 7, 0)
    assert [made.text(*c) for c in ((0x41, 1), (0x51, 1), (0x8000, 2), (0x8001, 2), (9, 1))] == ["fi", "b", "b", "😀", None]
    derived = cmaps.parse(b"/Base usecmap 1 begincidchar <01> 99 endcidchar", lambda name: CMAP.encode() if name == "Base" else None)
    assert derived.cid(1, 1) == 99 and derived.cid(2, 1) == 7
    assert cmaps.predefined("Identity-V").vertical and cmaps.predefined("Identity-H").split(b"\x01\x02\x03") == [(258, 2), (3, 1)]


def test_composite_fonts():
    font = "/Font << /F << /Subtype /Type0 /Encoding /Identity-H /ToUnicode 5 0 R /DescendantFonts [<< /DW 500 /W [1 [100 200] 5 9 300 8 20 999] >>] >> >>"
    d = page("BT /F 10 Tf 0 50 Td <000100020008000a0063> Tj ET", font, stream("1 beginbfrange <0001> <0002> <0041> endbfrange"))
    made = drawn(d, d.pages[0]).chars
    assert [round(c["ex"] - c["ox"], 6) for c in made] == [1, 2, 3, 9.99, 5] and [c["rune"] for c in made] == [65, 66, 0, 0, 0]


def test_one_glyph_may_show_several_characters():
    d = page("BT /F 10 Tf 0 50 Td (xy) Tj ET", "/Font << /F << /Subtype /Type1 /BaseFont /Helvetica /ToUnicode 5 0 R >> >>", stream("1 beginbfchar <78> <FB0200410042> endbfchar"))
    made = drawn(d, d.pages[0]).chars
    assert "".join(chr(c["rune"]) for c in made) == "flABy" and made[1]["ox"] == made[1]["ex"] == made[0]["ex"] == made[4]["ox"]


def test_painting():
    made = ops(page("q 2 0 0 2 0 0 cm 0.5 g 1 0 0 RG 3 w [4 2] 1 d 10 10 20 5 re B* Q 0 0 m 10 0 l 10 10 10 20 0 20 c h W n 0 1 0 rg 5 5 m 6 6 l f W* n"))
    assert [o["op"] for o in made] == ["FillPath", "StrokePath", "ClipPath", "FillPath", "ClipPath", "PopClip", "PopClip"]
    assert made[0]["path_data"] == "M 20 80 L 60 80 L 60 70 L 20 70 Z" and made[0]["even_odd"] and (made[0]["red"], made[1]["red"], made[1]["green"]) == (127, 255, 0)
    assert made[1]["line_width"] == 3 and made[1]["dash"] == [4, 2] and (made[0]["x0"], made[0]["y0"], made[0]["x1"], made[0]["y1"]) == (20, 70, 60, 80)
    assert made[2]["path_data"] == "M 0 100 L 10 100 C 10 90 10 80 0 80 Z" and not made[2]["even_odd"]


def test_state_operators_keep_what_is_wrong_out():
    made = ops(page("-1 w 7 J 1 0 0 rg (x) rg 1 2 3 4 5 cm 0 0 1 1 re S q q Q Q Q 0 0 1 1 re f [1 -1] 0 d 1e39 0 m 5 5 l 0 0 m 1 1 l S"))
    assert [o["op"] for o in made] == ["StrokePath", "FillPath", "StrokePath"] and made[0]["line_width"] == 1 and made[0]["cap"] == 0 and made[1]["red"] == 255 and made[2]["dash"] == []
    deep = "q " * 300 + "1 0 0 rg " + "Q " * 45 + "0 0 1 1 re f"  # 44 of the 45 undo what was too deep, and one the 256th
    assert ops(page(deep))[0]["red"] == 0 and ops(page(deep.replace("Q " * 45, "Q " * 44)))[0]["red"] == 255
    many = " ".join(str(k) for k in range(70)) + " re f"
    assert ops(page(many))[0]["path_data"].startswith("M 0 99 L 2 99")  # the first operands count


def test_graphics_states_groups_masks_and_tiles():
    resources = "/ExtGState << /G << /ca .5 /CA .25 /BM [/Odd /Multiply] /LW 4 /SMask << /S /Luminosity /G 6 0 R >> >> /N << /SMask /None >> >> /XObject << /X 5 0 R /Y 7 0 R >> /Pattern << /P 8 0 R >>"
    form = stream("0 0 5 5 re f /X Do", "/Subtype /Form /BBox [0 0 10 10] /Matrix [1 0 0 1 20 0] /Group << /S /Transparency /I true >> /Resources << /XObject << /X 5 0 R >> >>")
    mask, image = stream("1 g 0 0 9 9 re f", "/Subtype /Form /BBox [0 0 9 9]"), stream("abc", "/Subtype /Image /Width 3 /Height 1")
    tile = stream("0 0 2 2 re f", "/PatternType 1 /PaintType 2 /BBox [0 0 2 2] /XStep 4 /YStep -4")
    made = ops(page("/X Do /G gs 0 0 1 1 re f /N gs /Y Do /Cs cs 1 0 0 /P scn 0 0 3 3 re f", resources + " /ColorSpace << /Cs [/Pattern /DeviceRGB] >>", form, mask, image, tile))
    names = [o["op"] for o in made]
    assert names[:6] == ["BeginGroup", "ClipPath", "FillPath", "PopClip", "EndGroup", "BeginMask"] and made[0]["isolated"] and made[1]["x0"] == 20 and made[2]["level"] == 1
    assert names[6:] == ["ClipPath", "FillPath", "PopClip", "EndMask", "FillPath", "PopMask", "FillImage", "BeginTile", "FillPath", "EndTile", "FillPath"]
    assert made[10]["alpha"] == 0.5 and made[10]["blend"] == "Multiply" and made[13]["steps"] == [4, 4] and made[-1]["pattern"] == "P"


def test_text_modes_type3_and_annotations():
    d = page("BT /F 10 Tf 2 Tr (a) Tj 3 Tr (b) Tj 7 Tr (c) Tj ET", HELVETICA)
    out = drawn(d, d.pages[0])
    assert [o["op"] for o in out.ops] == ["FillText", "StrokeText", "IgnoreText", "ClipText", "EndTextClip", "PopClip"] and [chr(c["rune"]) for c in out.chars] == ["a", "b", "c"]
    three = "/Font << /T << /Subtype /Type3 /FontMatrix [.01 0 0 .01 0 0] /FirstChar 97 /Widths [50] /Encoding << /Differences [97 /box] >> /CharProcs << /box 5 0 R >> >> >>"
    d = page("1 0 0 rg BT /T 20 Tf 10 10 Td (aa) Tj ET", three, stream("50 0 0 0 40 40 d1 0 1 0 rg 0 0 40 40 re f"))
    out = drawn(d, d.pages[0])
    assert [(o["op"], o["x0"], o["x1"], o["red"]) for o in out.ops] == [("FillPath", 10, 18, 255), ("FillPath", 20, 28, 255)] and len(out.chars) == 2
    looks = [stream("0 0 1 1 re f", "/Subtype /Form /BBox [0 0 1 1]"), "<< /Subtype /Stamp /Rect [50 50 70 90] /AP << /N 5 0 R >> >>", "<< /Subtype /Stamp /F 2 /Rect [0 0 9 9] /AP << /N 5 0 R >> >>", "<< /Subtype /Widget /Parent 9 0 R /Rect [0 0 10 10] /AS /On /AP << /N << /On 5 0 R >> >> >>", "<< /FT /Btn >>", "<< /Subtype /Widget /Rect [0 0 9 9] /AP << /N 5 0 R >> >>"]
    d = page("", "", *looks, extra="/Annots [6 0 R 7 0 R 8 0 R 10 0 R]")
    assert [(o["x0"], o["y0"], o["x1"], o["y1"]) for o in ops(d) if o["op"] == "FillPath"] == [(50, 10, 70, 50), (0, 90, 10, 100)]


def test_inline_images():
    found = list(operations(b"q BI /W 2 /H 2 /BPC 8 /CS /G ID EI E EI Q BI /W 1 /H 1 /IM true /F [/Fl] ID xx EI f"))
    assert [n for n, _ in found] == ["q", "BI", "Q", "BI", "f"] and found[1][1][0].raw == b"EI E" and found[3][1][0].entries["Filter"] == ["FlateDecode"]


def function(text: str) -> formulas.Function:
    body = file_of("<< /Type /Catalog /F 2 0 R >>", text)
    return formulas.parsed(file := File(body), file.get(file.trailer["Root"])["F"])


def test_functions():
    assert function("<< /FunctionType 2 /Domain [0 1] /C0 [1 0] /C1 [0 2] /N 2 >>")([0.5]) == [0.75, 0.5]
    two = function("<< /FunctionType 3 /Domain [0 1] /Bounds [.5] /Encode [0 1 1 0] /Functions [<< /FunctionType 2 /Domain [0 1] /N 1 >> << /FunctionType 2 /Domain [0 1] /N 1 >>] >>")
    assert [two([x])[0] for x in (0.25, 0.5, 0.75, 2)] == [0.5, 1.0, 0.5, 0.0]
    table = function(stream("\x00\x40\x80\xff", "/FunctionType 0 /Domain [0 1 0 1] /Range [0 255] /Size [2 2] /BitsPerSample 8"))
    assert table([0, 0]) == [0] and table([1, 0]) == [64] and table([0, 1]) == [128] and table([0.5, 0.5]) == [pytest.approx(111.75)]
    bits = function(stream("\xa0", "/FunctionType 0 /Domain [0 3] /Range [0 1] /Size [4] /BitsPerSample 1 /Encode [0 3]"))
    assert [bits([k])[0] for k in range(4)] == [1, 0, 1, 0]
    for text in ("<< /FunctionType 2 /N 1 >>", "<< /FunctionType 9 /Domain [0 1] >>", "<< /FunctionType 3 /Domain [0 1] /Functions [] /Bounds [] /Encode [0 1] >>"):
        with pytest.raises(formulas.NoFunction):
            function(text)


@pytest.mark.parametrize(
    ("program", "stack"),
    [
        ("-2.5 round 2.5 round 3.7 truncate -3.2 floor", [-3, 3, 3, -4]),
        ("-7 2 idiv -7 3 mod 7 -2 idiv", [-3, -1, -3]),
        ("1 2 3 3 1 roll", [3, 1, 2]),
        ("1 2 3 3 -1 roll", [2, 3, 1]),
        ("5 6 1 index 2 copy", [5, 6, 5, 6, 5]),
        ("1 0 div", [math.inf]),
        ("1 0 idiv 9", []),
        ("true 1 eq 1 1 eq true false xor 6 3 xor", [False, True, True, 5]),
        ("1 3 bitshift -1 -28 bitshift 1 40 bitshift", [8, 15, 0]),
        ("1 1 atan -1 0 atan 2 10 exp 100 log", [45, 270, 1024, 2]),
        ("3 2 gt {1} {2} ifelse false {9} if", [1]),
        ("true not 5 not 3.9 cvi 4 cvr", [False, -6, 3, 4]),
        ("pop pop 1", []),
    ],
)
def test_calculator(program, stack):
    made = formulas.calculated(formulas.compiled(b"{" + program.encode() + b"}"), [])
    assert made == pytest.approx(stack)


def test_colour_spaces():
    file = File(file_of("<< /Type /Catalog /I [/Indexed /DeviceRGB 1 <ff000000ff00>] /S [/Separation /Spot /DeviceCMYK << /FunctionType 2 /Domain [0 1] /C0 [0 0 0 0] /C1 [0 1 1 0] /N 1 >>] /P [/ICCBased 2 0 R] /N [/Separation /None /DeviceGray 3 0 R] /L [/Lab << >>] >>", stream("", "/N 4")))
    root = file.get(file.trailer["Root"])
    of = lambda k: colours.space(file, root[k])
    assert [of("I").rgb([v]) for v in (0, 1, 7, -1)] == [(255, 0, 0), (0, 255, 0), (0, 255, 0), (255, 0, 0)]
    assert of("S").rgb([1]) == (255, 0, 0) and of("P") is colours.CMYK and of("N").rgb([1]) is None and of("L") is None
    assert colours.space(file, Name("CalRGB")) is colours.RGB and colours.from_cmyk([0, 0.5, 1, 0.25]) == (191, 63, 0) and colours.from_gray([math.nan]) == (0, 0, 0)


def test_hostile_files_have_a_status():
    for text in ("/Rotate " + "9" * 400, "/Annots [<< /Subtype /Link /Rect [0 0 1 1] /Dest [3 0 R /XYZ " + "9" * 400 + " 0 0] >>]", "/MediaBox [0 0 " + "9" * 400 + " 1]"):
        row = parsed_one("x", file_of("<< /Type /Catalog /Pages 2 0 R /PageLabels << /Nums [(a) << >> 0 << /S /D >>] >> >>", "<< /Kids [3 0 R] >>", f"<< /Type /Page {text} >>"))
        assert row["status"] == "open" and row["page_count"] == 1 and len(row["label_ranges"]) == 1
    locked = file_of("<< /Type /Catalog /Pages 2 0 R >>", "<< /Kids [] >>", tail="trailer << /Root 1 0 R /Encrypt << /Filter /Standard /V 1 /R 2 /P 99999999999 /O (" + "o" * 32 + ") /U (" + "u" * 32 + ") >> >>\nstartxref\n0\n%%EOF")
    assert parsed_one("x", locked)["status"] == "locked"


def test_internal_addresses():
    doc = Document(SMALL)
    assert doc.fragment("#page=2&zoom=100,5,7") == (1, 5.0, 7.0) and doc.fragment("#page=3") == (-1, None, None) and doc.fragment("#page=1&zoom=1,nan,x") == (0, None, None)
    assert percent_decoded("a%20b%zz%4") == b"a b%zz%4"


def test_document_tables(spark):
    files = spark.createDataFrame([("a", bytearray(SMALL)), ("b", bytearray(b"no document")), ("c", None)], "path string, content binary")
    made = parsed(files).cache()
    assert {r.path: r.status.split(":")[0] for r in made.collect()} == {"a": "open", "b": "damaged", "c": "damaged"}
    assert [tuple(r) for r in labels(made).orderBy("page").collect()] == [("a", 0, "i"), ("a", 1, "A-7")]
    assert [r.page for r in pages_with_label(made, "a-7").collect()] == [1] and pages_with_label(made, "").count() == 0
    assert {r.path: r.has_labels for r in has_labels(made).collect()} == {"a": True, "b": False, "c": False}
    assert [tuple(r)[3:] for r in page_sizes(made, 144).orderBy("page").collect()] == [(300.0, 400, 600), (100.0, 100, 200)]
    assert [r.pixels_across for r in page_sizes(made, 144, 120).orderBy("page").collect()] == [120, 100]
    toc = table_of_contents(made, 144).orderBy("ord").collect()
    assert [(r.title, r.depth, r.page) for r in toc] == [("One", 0, 0), ("Inner", 1, 1), ("T", 0, -1)]
    link = public_links(made, 144).collect()
    assert [tuple(r)[1:] for r in link] == [(0, 0, "", 1, 100, 0, 20, 340, 180, 380)]
    assert authenticated(files, "x").collect() == [("a", False, 1)] and objects(files).where("kind = 'dictionary'").count() >= 8


def test_drawing_tables(spark):
    body = file_of("<< /Type /Catalog /Pages 2 0 R >>", "<< /Kids [3 0 R] >>", f"<< /Type /Page /Contents 4 0 R /Resources << {HELVETICA} >> >>", stream("0 0 9 9 re f BT /F 10 Tf (hi) Tj ET"), stream(CMAP, "/Type /CMap"))
    files = spark.createDataFrame([("a", bytearray(body)), ("b", bytearray(b"%PDF junk"))], "path string, content binary")
    assert [(r.op, r.text) for r in draw_ops(files).orderBy("seq").collect()] == [("FillPath", None), ("FillText", "hi")]
    assert chars(files).count() == 2
    found = {(r.kind, r.low): (r.number, r.text) for r in character_maps(files).collect()}
    assert found["cid", 0x8005] == (7, None) and found["text", 0x41] == (None, "fi") and ("space", 0x8000) in found


def test_fonts_survive_nonsense():
    file = File(SMALL)
    assert fonts.Font(file, {"Widths": [1, "x", Name("y")], "Encoding": {"Differences": [1e9, Name("a")]}, "FontDescriptor": {"Ascent": math.inf, "Flags": 1.5}}).width(0) == 0.001
    assert fonts.Font(file, {"Subtype": Name("Type0"), "DescendantFonts": [{"W": [1, [], 2, 1, 3], "DW2": [1]}], "Encoding": Stream({}, b"junk")}).split(b"ab") == [(24930, 2)]
