"""More queries over document files: syntax, filters, cross references, text state, functions and images, each from rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import documents as docs
from .catalog import query
from .files import _ROOT, _TREE, _files, _key, _page, _said, _spread, _stream, _typed

_FONT = "/Font << /F << /Subtype /Type1 /BaseFont /Courier >> >>"


def _byte(value: Column) -> Column:
    return F.chr(value.cast("long"))


def _stored(data: Column) -> Column:
    """Data as an uncompressed block in a deflate stream."""
    n = F.octet_length(F.encode(data, "ISO-8859-1"))
    low, high = n % 256, F.floor(n / 256)
    return F.concat(F.lit("\x78\x01\x01"), _byte(low), _byte(high), _byte(255 - low), _byte(255 - high), data)


def _texts(chars: DataFrame) -> DataFrame:
    """p_partkey, what is shown, and the first and last place."""
    made = chars.groupBy(_key()).agg(F.array_sort(F.collect_list(F.struct("seq", "rune", "ox", "oy", "ex"))).alias("c"))
    text = F.array_join(F.transform("c", lambda r: F.chr(r["rune"].cast("long"))), "")
    return made.select("p_partkey", text.alias("text"), *[F.round(F.element_at("c", k)[c], 6).alias(n) for k, c, n in ((1, "ox", "x"), (1, "oy", "y"), (-1, "ex", "x_end"))])


@query("SELECT p_partkey, p_name AS text FROM part")
def file_flate(spark, sf_dir):
    """Contents in a deflate stream, in two parts."""
    one, two = _said("BT /F 9 Tf (", F.col("p_name"), ") "), F.lit("Tj ET")
    parts = [_stream_of(_stored(one), "/Filter /FlateDecode"), _stream_of(_stored(two), "/Filter [/Fl]")]
    page = _said("<< /Type /Page /Contents [4 0 R 9 0 R 5 0 R] /Resources << ", _FONT, " >> >>")
    return docs.draw_ops(_files(spark, sf_dir, [_ROOT, _TREE, page, *parts])).select(_key(), "text")


def _stream_of(data: Column, entries: str) -> Column:
    n = F.octet_length(F.encode(data, "ISO-8859-1"))
    return _said(f"<< {entries} /Length ", n, " >>\nstream\n", data, "\nendstream")


@query("SELECT p_partkey, (p_size % 256)::INT AS a, ((p_size + p_partkey % 200) % 256)::INT AS b, ((p_size + p_partkey % 200 + 100) % 256)::INT AS c FROM part")
def file_predictor(spark, sf_dir):
    """Rows that are differences to the row above (Up), and within the last row to the left (Sub)."""
    data = F.concat(F.lit("\x02"), _byte(F.col("p_size") % 256), F.lit("\x00"), F.lit("\x02"), _byte(F.col("p_partkey") % 200), F.lit("\x00"), F.lit("\x04"), F.lit("\x64"), F.lit("\x00"))
    image = _stream_of(_stored(data), "/Subtype /Image /Width 2 /Height 3 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /FlateDecode /DecodeParms << /Predictor 15 /Columns 2 >>")
    made = docs.images(_page(spark, sf_dir, F.lit(""), "", image))
    value = lambda at: F.conv(F.hex(F.substring("pixels", at, 1)), 16, 10).cast("int")
    return made.select(_key(), value(1).alias("a"), value(9).alias("b"), value(17).alias("c"))


@query("SELECT p_partkey, p_name || 'zzzzz' AS text FROM part")
def file_run_length(spark, sf_dir):
    plain = _said("BT /F 9 Tf (", F.col("p_name"))
    data = F.concat(_byte(F.length(plain) - 1), plain, F.lit("\xfcz"), _byte(F.lit(6)), F.lit(") Tj ET"), F.lit("\x80"))
    files = _page(spark, sf_dir, data, _FONT, filters="/Filter /RunLengthDecode")
    return docs.draw_ops(files).select(_key(), "text")


@query("SELECT p_partkey, ord::INT AS ord, CASE ord WHEN 0 THEN 'a(' || p_name || ')' || chr((65 + p_partkey % 20)::INT) ELSE p_brand || 'é' END AS title FROM part, range(2) r(ord)")
def file_strings(spark, sf_dir):
    """Escapes, octal digits, line continuations, hexadecimal strings and UTF-16."""
    octal = F.conv((F.col("p_partkey") % 20 + 65).cast("string"), 10, 8)
    wide = F.regexp_replace(F.hex(F.encode("p_brand", "UTF-8")), "(..)", "00$1 ")
    objects = [F.lit("<< /Type /Catalog /Pages 2 0 R /Outlines << /First 3 0 R >> >>"), F.lit("<< /Kids [] >>"), _said("<< /Title (a\\(", F.col("p_name"), "\\\n)\\", octal, ") /Next 4 0 R >>"), _said("<< /T#69tle <feff", wide, "00E9> >>")]
    objects[2] = _said("<< /Title (a\\(", F.col("p_name"), "\\\n\\)\\", octal, ") /Next 4 0 R >>")
    return docs.table_of_contents(docs.parsed(_files(spark, sf_dir, objects))).select(_key(), "ord", "title")


@query("SELECT p_partkey, false AS repaired, (p_size + 10)::DOUBLE AS width FROM part")
def file_cross_references(spark, sf_dir):
    """A true table, and a newer one that hides one of its objects."""
    objects = [F.lit("<< /Type /Catalog /Pages 2 0 R >>"), F.lit("<< /Kids [3 0 R] >>"), F.lit("<< /Type /Page /MediaBox [0 0 7 7] >>")]
    body, places = F.lit("%PDF-1.4\n"), []
    for n, o in enumerate(objects, 1):
        places.append(F.length(body))
        body = _said(body, f"{n} 0 obj\n", o, "\nendobj\n")
    line = lambda at: F.concat(F.lpad(at.cast("string"), 10, "0"), F.lit(" 00000 n \n"))
    first = F.length(body)
    body = _said(body, "xref\n0 4\n0000000000 65535 f \n", *[line(p) for p in places], "trailer << /Root 1 0 R /Size 4 >>\n")
    newer = F.length(body)
    body = _said(body, "3 0 obj\n<< /Type /Page /MediaBox [0 0 ", F.col("p_size") + 10, " 7] >>\nendobj\n")
    second = F.length(body)
    body = _said(body, "xref\n3 1\n", line(newer), "trailer << /Prev ", first, " >>\nstartxref\n", second, "\n%%EOF")
    files = _rows(spark, sf_dir, body)
    return docs.parsed(files).select(_key(), "repaired", F.col("pages")[0]["width"].alias("width"))


def _rows(spark, sf_dir: str, body: Column) -> DataFrame:
    from .catalog import table

    return _spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("string").alias("path"), F.encode(body, "ISO-8859-1").alias("content"))


@query("SELECT p_partkey, 2 AS pages, (p_size + 1)::DOUBLE AS width FROM part")
def file_object_streams(spark, sf_dir):
    """Objects inside a stream."""
    inner = [F.lit("<< /Type /Catalog /Pages 2 0 R >>"), F.lit("<< /Kids [3 0 R 4 0 R] >>"), _said("<< /Type /Page /MediaBox [0 0 ", F.col("p_size") + 1, " 5] >>"), F.lit("<< /Type /Page >>")]
    head, at = F.lit(""), F.lit(0)
    for n, o in enumerate(inner, 1):
        head = _said(head, f"{n} ", at, " ")
        at = at + F.length(o) + 1
    data = _said(head, *[v for o in inner for v in (o, " ")])
    holder = _said("<< /Type /ObjStm /N 4 /First ", F.length(head), " /Length ", F.length(data), " >>\nstream\n", data, "\nendstream")
    made = docs.parsed(_files(spark, sf_dir, [(9, holder)]))
    return made.select(_key(), F.col("page_count").alias("pages"), F.col("pages")[0]["width"].alias("width"))


@query("""SELECT p_partkey, 'abcd' AS text, round(10 + 2 * (p_size % 5), 6)::DOUBLE AS x, round(100 - (20 + 3 + p_partkey % 4), 6)::DOUBLE AS y,
round(10 + 2 * (p_size % 5) + 0.5 * (2 * (0.6 * 10 + 1) + 0.2 * 10 + 0.6 * 10 + 1) + 0.5 * 0.6 * 10, 6)::DOUBLE AS x_end FROM part""")
def file_text_state(spark, sf_dir):
    """Character spacing, scaling, rise, moves, and kerns within a run."""
    content = _said("2 0 0 2 0 0 cm q Q 0.5 0 0 0.5 0 0 cm BT /F 10 Tf 1 Tc 50 Tz ", F.col("p_partkey") % 4, " Ts 1 0 0 1 10 20 Tm ", F.col("p_size") % 5 * 2, " 3 Td [(ab) -200 (cd)] TJ ET")
    return _texts(docs.chars(_page(spark, sf_dir, content, _FONT)))


@query("SELECT p_partkey, 'A BC' AS text, 30.0::DOUBLE AS x, 50.0::DOUBLE AS y, (30 + 6 + p_size % 7 + 6 + p_size % 5)::DOUBLE AS x_end FROM part")
def file_text_lines(spark, sf_dir):
    """Leading, new lines, and the spacing of words and characters that the quote operator sets."""
    content = _said("BT /F 10 Tf 30 50 Td (A) Tj 8 TL T* ", F.col("p_size") % 7, " ", F.col("p_size") % 5, " ( B) \" 0 Tc 0 -8 Td 8 TL (C) ' ET")
    chars = docs.chars(_page(spark, sf_dir, content, _FONT))
    last = chars.where("rune = 67").select(_key(), (F.col("ox") - 30).alias("back"))
    made = _texts(chars.where("rune <> 67")).join(last, "p_partkey")
    return made.select("p_partkey", F.concat("text", F.lit("C")).alias("text"), "x", "y", F.round(F.col("x_end") + F.col("back"), 6).alias("x_end"))


@query("SELECT p_partkey, op, n FROM part, (VALUES ('BeginGroup', 1), ('EndGroup', 1), ('ClipPath', 2), ('PopClip', 2), ('FillPath', 2)) o(op, n)")
def file_forms(spark, sf_dir):
    """Forms inside forms, one of them a group, one that calls itself."""
    outer = _stream(_said("0 0 ", F.col("p_size"), " 1 re f /B Do /A Do"), "/Subtype /Form /BBox [0 0 50 50] /Resources << /XObject << /A 5 0 R /B 6 0 R >> >>")
    inner = _stream(F.lit("0 0 1 1 re f"), "/Subtype /Form /BBox [0 0 9 9] /Group << /S /Transparency >>")
    made = docs.draw_ops(_page(spark, sf_dir, F.lit("/A Do"), "/XObject << /A 5 0 R >>", outer, inner))
    return made.groupBy(_key(), "op").agg(F.count("*").cast("int").alias("n"))


@query("SELECT p_partkey, (p_size * 4 % 250)::INT AS red, if(p_size % 10 < 5, p_size % 10 * 50, 250 - (p_size % 10 - 5) * 50)::INT AS green, CASE WHEN p_size % 3 = 0 THEN 10 WHEN p_size % 3 = 1 THEN 105 ELSE 200 END::INT AS blue FROM part")
def file_functions(spark, sf_dir):
    """Tints by an exponential, a stitching and a sampled function, one component each."""
    one = "<< /FunctionType 2 /Domain [0 1] /N 1 /C0 [{0}] /C1 [{1}] >>"
    content = _said("/R cs ", F.col("p_size") * 4 % 250 / F.lit(250.0), " scn 0 0 1 1 re f /G cs ", F.col("p_size") % 10 / F.lit(10.0), " scn 0 0 2 1 re f /B cs ", F.col("p_size") % 3 / F.lit(2.0), " scn 0 0 3 1 re f")
    tint = lambda f: f"[/Separation /X /DeviceGray {f}]"
    spaces = " ".join((f"/R {tint(one.format('0.0001', '0.98050'))}", f"/G {tint('<< /FunctionType 3 /Domain [0 1] /Bounds [0.5] /Encode [0 1 0 1] /Functions [' + one.format('0.0001', '0.98050') + ' ' + one.format('0.98050', '0.0001') + '] >>')}", "/B [/Separation /X /DeviceGray 5 0 R]"))
    table = _stream(F.lit("\x0a\x69\xc8"), "/FunctionType 0 /Domain [0 1] /Range [0 1] /Size [3] /BitsPerSample 8 /Decode [0.0001 1.0001]")
    made = docs.draw_ops(_page(spark, sf_dir, content, f"/ColorSpace << {spaces} >>", table))
    at = lambda n: F.max(F.when(F.col("x1") == n, F.col("red")))
    return made.groupBy(_key()).agg(at(1).alias("red"), at(2).alias("green"), at(3).alias("blue"))


@query("SELECT p_partkey, op, x0::DOUBLE AS x0, x1::DOUBLE AS x1 FROM (SELECT p_partkey, 'FillImageMask' AS op, p_size % 50 AS x0, p_size % 50 + 8 AS x1 FROM part UNION ALL SELECT p_partkey, 'FillImage', 0, 100 FROM part UNION ALL SELECT p_partkey, 'FillPath', p_size % 50 + 0.5, p_size % 50 + 4.5 FROM part)")
def file_inline_images(spark, sf_dir):
    """A stencil within the contents, an image object, and a glyph that is a drawing."""
    content = _said("q 8 0 0 8 ", F.col("p_size") % 50, " 0 cm BI /W 8 /H 2 /IM true ID \xaaE EI Q q 100 0 0 100 0 0 cm /I Do Q BT /T 10 Tf ", F.col("p_size") % 50, " 0 Td (a) Tj ET")
    fonts = "/XObject << /I 5 0 R >> /Font << /T << /Subtype /Type3 /FontMatrix [.1 0 0 .1 0 0] /FirstChar 97 /Widths [9] /Encoding << /Differences [97 /x] >> /CharProcs << /x 6 0 R >> >> >>"
    image, glyph = _stream(F.lit("\x01"), "/Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray"), _stream(F.lit("9 0 d0 0.5 0 4 4 re f"))
    return docs.draw_ops(_page(spark, sf_dir, content, fonts, image, glyph)).select(_key(), "op", "x0", "x1")


@query("SELECT p_partkey, 'decoded' AS status, (p_size % 4)::INT AS n, [255, 0, 0, 255][p_size % 4 + 1]::INT AS red, [0, 255, 0, 255][p_size % 4 + 1]::INT AS green FROM part")
def file_indexed_images(spark, sf_dir):
    """Two-bit samples into a palette."""
    data = _byte(F.col("p_size") % 4 * 64)
    image = _stream_of(data, "/Subtype /Image /Width 1 /Height 1 /BitsPerComponent 2 /ColorSpace [/Indexed /DeviceRGB 3 <ff000000ff000000ffffff00>]")
    made = docs.images(_page(spark, sf_dir, F.lit(""), "", image))
    value = lambda at: F.conv(F.hex(F.substring("pixels", at, 1)), 16, 10).cast("int")
    n = F.when((value(1) == 255) & (value(2) == 0), 0).when(value(1) == 255, 3).when(value(2) == 255, 1).otherwise(2)
    return made.select(_key(), "status", n.alias("n"), value(1).alias("red"), value(2).alias("green"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS needs_password, if(p_partkey % 3 = 0, 0, 1)::INT AS status FROM part")
def file_locked(spark, sf_dir):
    """Files under a handler that nothing opens, and open ones."""
    tail = F.when(F.col("p_partkey") % 3 == 0, "trailer << /Root 1 0 R /Encrypt << /Filter /Other >> >>").otherwise("trailer << /Root 1 0 R >>")
    body = _said("%PDF-1.4\n1 0 obj\n", _ROOT, "\nendobj\n2 0 obj\n<< /Kids [] >>\nendobj\n", tail, "\nstartxref\n0\n%%EOF")
    return docs.authenticated(_rows(spark, sf_dir, body), "word").select(_key(), "needs_password", "status")


@query("SELECT p_partkey, p_name AS text, (5 + 0.6 * (p_size % 9 + 4) * length(p_name))::DECIMAL(18,4)::DOUBLE AS width FROM part")
def file_encodings(spark, sf_dir):
    """Codes with other meanings: each letter a is coded as é by a table of differences."""
    said = _said("(", F.regexp_replace("p_name", "a", "\\\\351"), ")")
    made = _texts(docs.chars(_typed(spark, sf_dir, said, "/BaseFont /CourierNew,Bold /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [233 /a] >>")))
    return made.select("p_partkey", "text", F.round("x_end", 4).alias("width"))
