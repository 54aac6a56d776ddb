"""Queries over document files: each row of a table becomes a file, Spark reads the files back through the document tables, and DuckDB
says from the same rows what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.textsearch import search_pages
from ..sources import documents as docs
from .catalog import query, table


def _key() -> Column:
    return F.col("path").cast("long").alias("p_partkey")


def _said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _stream(data: Column, entries: str = "") -> Column:
    return _said(f"<< {entries} /Length ", F.octet_length(data), " >>\nstream\n", data, "\nendstream")


def _files(spark: SparkSession, sf_dir: str, objects, tail: str = "trailer << /Root 1 0 R >>\nstartxref\n0\n%%EOF") -> DataFrame:
    """path (the part's key) and content; objects: columns of part, numbered from 1, or (number, column)."""
    numbered = [o if isinstance(o, tuple) else (k, o) for k, o in enumerate(objects, 1)]
    body = _said("%PDF-1.4\n", *[v for n, o in numbered for v in (f"{n} 0 obj\n", o, "\nendobj\n")], tail)
    return _spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("string").alias("path"), F.encode(body, "ISO-8859-1").alias("content"))


def _spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores: a small table is one partition, and a document takes longer to read than a row."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


_ROOT, _TREE = "<< /Type /Catalog /Pages 2 0 R >>", "<< /Kids [3 0 R] >>"


def _page(spark, sf_dir, content: Column, resources: str | Column = "", *more, entries: str | Column = "", filters: str = "") -> DataFrame:
    """Files of one page of 200 by 100 points."""
    page = _said("<< /Type /Page /MediaBox [0 0 200 100] /Contents 4 0 R /Resources << ", F.lit(resources) if isinstance(resources, str) else resources, " >> ", F.lit(entries) if isinstance(entries, str) else entries, " >>")
    return _files(spark, sf_dir, [_ROOT, _TREE, page, _stream(content, filters), *more])


@query("""WITH p AS (SELECT *, 100 + p_size AS w, 200 + p_partkey % 97 AS h, p_partkey % 5 * 90 % 360 AS turn FROM part)
SELECT p_partkey, 0 AS page, turn::INT AS rotate, if(turn IN (90, 270), h, w)::DOUBLE AS width, if(turn IN (90, 270), w, h)::DOUBLE AS height FROM p
UNION ALL SELECT p_partkey, 1, 180, (least(w, 110) - 10)::DOUBLE, 50.0::DOUBLE FROM p""")
def file_pages(spark, sf_dir):
    """Boxes and turns, own and inherited."""
    key = F.col("p_partkey")
    tree = _said("<< /Type /Pages /Rotate 180 /Kids [3 0 R 4 0 R] /MediaBox [0 0 ", F.col("p_size") + 100, " ", key % 97 + 200, "] >>")
    made = docs.parsed(_files(spark, sf_dir, [_ROOT, tree, _said("<< /Type /Page /Rotate ", key % 5 * 90, " >>"), F.lit("<< /Type /Page /CropBox [110 60 10 10] >>")]))
    return docs.rows_of(made, "pages").select(_key(), "page", "rotate", "width", "height")


@query("""SELECT p_partkey, page::INT AS page, CASE page WHEN 0 THEN 'iv' WHEN 1 THEN 'v' WHEN 2 THEN 'p' || p_size || '-' || upper(repeat(chr((97 + k % 26)::INT), (k // 26 + 1)::BIGINT)) ELSE (p_size * 2 + 1)::VARCHAR END AS label
FROM (SELECT *, p_partkey % 60 AS k FROM part), range(4) r(page)""")
def file_labels(spark, sf_dir):
    root = _said("<< /Type /Catalog /Pages 2 0 R /PageLabels << /Nums [0 << /S /r /St 4 >> (bad) 1 2 << /S /A /P (p", F.col("p_size"), "-) /St ", F.col("p_partkey") % 60 + 1, " >> 3 << /S /D /St ", F.col("p_size") * 2 + 1, " >> 3 << /S /R >>] >> >>")
    made = docs.parsed(_files(spark, sf_dir, [root, F.lit("<< /Kids [3 0 R 4 0 R 5 0 R 6 0 R] >>"), *[F.lit("<< /Type /Page >>")] * 4]))
    return docs.labels(made).select(_key(), "page", "label")


@query("SELECT p_partkey, p_partkey % 2 AS page FROM part WHERE p_partkey % 3 = 1")
def file_pages_with_label(spark, sf_dir):
    """Reverse lookup, in any case."""
    key = F.col("p_partkey")
    root = _said("<< /Type /Catalog /Pages 2 0 R /PageLabels << /Nums [0 << /P (x) >> ", key % 2, " << /P (", F.when(key % 3 == 1, "Anhang").otherwise("Anhang-"), ") >> ", key % 2 + 1, " << /P (y) >>] >> >>")
    made = docs.parsed(_files(spark, sf_dir, [F.when(key % 2 == 0, F.regexp_replace(root, r"0 << /P \(x\) >> ", "")).otherwise(root), F.lit("<< /Kids [3 0 R 4 0 R] >>"), *[F.lit("<< /Type /Page >>")] * 2]))
    return docs.pages_with_label(made, "aNHANG").select(_key(), F.col("page").cast("long").alias("page"))


@query("""SELECT p_partkey, ord::INT AS ord, CASE ord WHEN 1 THEN 1 ELSE 0 END::INT AS depth, CASE ord WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_brand END AS title, CASE ord WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END::INT AS page,
CASE ord WHEN 0 THEN p_size * 2 ELSE 0 END::BIGINT AS x, CASE ord WHEN 0 THEN 2 * (792 - p_partkey % 700) WHEN 1 THEN 2 * (792 - 700) ELSE 0 END::BIGINT AS y FROM part, range(3) r(ord)""")
def file_contents_table(spark, sf_dir):
    """An outline with a child, destinations of three kinds, one unresolved."""
    made = docs.parsed(_files(spark, sf_dir, [
        F.lit("<< /Type /Catalog /Pages 2 0 R /Outlines << /First 5 0 R >> /Names << /Dests << /Names [(there) [4 0 R /FitH 700]] >> >> >>"), F.lit("<< /Kids [3 0 R 4 0 R] >>"), F.lit("<< /Type /Page >>"), F.lit("<< /Type /Page >>"),
        _said("<< /Title (", F.col("p_name"), ") /First 6 0 R /Next 7 0 R /Dest [3 0 R /XYZ ", F.col("p_size"), " ", F.col("p_partkey") % 700, " 0] >>"),
        _said("<< /Title (", F.col("p_type"), ") /A << /S /GoTo /D (there) >> >>"), _said("<< /Title ( ", F.col("p_brand"), "\\001 ) /Next 5 0 R /Dest (nowhere) >>"),
    ]))
    return docs.table_of_contents(made, 144).select(_key(), "ord", "depth", "title", "page", "x", "y")


@query("""SELECT p_partkey, ord::INT AS ord, if(ord = 0, 'https://example.org/' || p_size, '') AS uri, if(ord = 0, -1, 1)::INT AS target, if(ord = 0, 0, least(p_size * 2, 612 * 2))::BIGINT AS x, if(ord = 0, 0, 2 * (792 - 90))::BIGINT AS y,
(2 * (p_partkey % 50))::BIGINT AS x0, (2 * (792 - 40))::BIGINT AS y0, (2 * (p_partkey % 50 + 30))::BIGINT AS x1, (2 * (792 - 20))::BIGINT AS y1 FROM part, range(2) r(ord)""")
def file_links(spark, sf_dir):
    """Links in pixels: one outside, one to a named place, one to nowhere and one that is no link."""
    box = _said("/Rect [", F.col("p_partkey") % 50, " 20 ", F.col("p_partkey") % 50 + 30, " 40]")
    links = [_said("<< /Subtype /Link ", box, " /A << /S /URI /URI (https://example.org/", F.col("p_size"), ") >> >>"), _said("<< /Subtype /Text ", box, " >>"), _said("<< /Subtype /Link ", box, " /Dest [9 0 R /Fit] >>"), _said("<< /Subtype /Link ", box, " /A << /S /URI /URI (#page=2&zoom=1,", F.col("p_size"), ",702) >> >>")]
    made = docs.parsed(_files(spark, sf_dir, [_ROOT, F.lit("<< /Kids [3 0 R 4 0 R] >>"), _said("<< /Type /Page /Annots [", *links, "] >>"), F.lit("<< /Type /Page >>")]))
    return docs.public_links(made, 144).select(_key(), "ord", "uri", "target", "x", "y", "x0", "y0", "x1", "y1")


def _typed(spark, sf_dir, said: Column, font: str = "/BaseFont /Courier", *more) -> DataFrame:
    return _page(spark, sf_dir, _said("BT /F ", F.col("p_size") % 9 + 4, " Tf 1 0 0 1 5 40 Tm ", said, " Tj ET"), f"/Font << /F << /Subtype /Type1 {font} >> >>", *more)


_SIZE = "(p_size % 9 + 4)"


@query(f"SELECT p_partkey, p_name AS text, round(5 + 0.6 * {_SIZE} * length(p_name), 6)::DOUBLE AS x_end, round(60 - 0.932 * {_SIZE}, 6)::DOUBLE AS top, round(60 + 0.317 * {_SIZE}, 6)::DOUBLE AS bottom FROM part")
def file_characters(spark, sf_dir):
    made = docs.chars(_typed(spark, sf_dir, _said("(", F.col("p_name"), ")")))
    rows = F.array_sort(F.collect_list(F.struct("seq", "rune", "ex", "quad")))
    made = made.groupBy(_key()).agg(rows.alias("c"))
    last = F.element_at("c", -1)
    return made.select("p_partkey", F.array_join(F.transform("c", lambda r: F.chr(r["rune"].cast("long"))), "").alias("text"), F.round(last["ex"], 6).alias("x_end"), F.round(last["quad"][1], 6).alias("top"), F.round(last["quad"][5], 6).alias("bottom"))


@query(f"""SELECT p_partkey, ord::INT AS ord, round(5 + 0.6 * {_SIZE} * (starts[ord + 1] - 1), 4)::DOUBLE AS x0, round(5 + 0.6 * {_SIZE} * (starts[ord + 1] + 1), 4)::DOUBLE AS x1
FROM (SELECT *, list_filter(range(1, length(p_type)), lambda i: p_type[i:i + 1] = 'AR') AS starts FROM part), range(9) r(ord) WHERE ord < len(starts)""")
def file_search(spark, sf_dir):
    """Hits of a needle in lower case among capitals."""
    chars = docs.chars(_typed(spark, sf_dir, _said("(", F.regexp_replace("p_type", "ND", "nd"), ")"))).withColumnRenamed("path", "doc_id")
    return search_pages(chars, "ar").select(F.col("doc_id").cast("long").alias("p_partkey"), "ord", F.round(F.col("quad")[0], 4).alias("x0"), F.round(F.col("quad")[2], 4).alias("x1"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ''), lambda c: chr((ascii(c) + 1)::INT)), '') AS text, round((6 * (5 + length(p_type)) - 30) / 6.0, 6)::DOUBLE AS letters FROM part")
def file_character_map(spark, sf_dir):
    """Codes of a composite font through a map of ranges to text; widths by range."""
    cmap = F.lit("1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0020> <007e> <0021> endbfrange")
    codes = F.regexp_replace(F.hex(F.encode("p_type", "UTF-8")), "(..)", "00$1")
    files = _page(spark, sf_dir, _said("BT /F 10 Tf <", codes, "> Tj ET"), "/Font << /F << /Subtype /Type0 /Encoding /Identity-H /ToUnicode 5 0 R /DescendantFonts [<< /DW 1 /W [32 126 600] >>] >> >>", _stream(cmap))
    made = docs.chars(files).groupBy(_key()).agg(F.array_sort(F.collect_list(F.struct("seq", "rune"))).alias("c"), F.max("ex").alias("x"))
    return made.select("p_partkey", F.array_join(F.transform("c", lambda r: F.chr(r["rune"].cast("long"))), "").alias("text"), F.round(F.col("x") / 6, 6).alias("letters"))


@query("SELECT p_partkey, kind, low::BIGINT AS low, high::BIGINT AS high, number::BIGINT AS number, text FROM (SELECT p_partkey, 'cid' AS kind, 10 AS low, 10 + p_size AS high, 7 AS number, NULL AS text FROM part UNION ALL SELECT p_partkey, 'text', 65, 65, NULL, p_name[1:1] || '1' FROM part)")
def file_map_ranges(spark, sf_dir):
    cmap = _said("/CMapName /X def begincmap 1 begincidrange <0a> <", F.lpad(F.hex(F.col("p_size").cast("long") + 10), 2, "0"), "> 7 endcidrange 1 beginbfchar <41> <00", F.hex(F.encode(F.substring("p_name", 1, 1), "UTF-8")), "0031> endbfchar")
    return docs.character_maps(_page(spark, sf_dir, F.lit(""), "", _stream(cmap))).select(_key(), "kind", "low", "high", "number", "text")


@query("SELECT p_partkey, op, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, red::INT AS red FROM (SELECT p_partkey, 'FillPath' AS op, 10 + 2 * (p_size % 20) AS x0, 100 - (5 + 2 * 9) AS y0, 10 + 2 * (p_size % 20 + 7) AS x1, 100 - (5 + 2 * 3) AS y1, trunc(p_size % 11 / 10.0::DOUBLE * 255) AS red FROM part UNION ALL SELECT p_partkey, 'StrokePath', 0, 90 - p_partkey % 80, 50, 100, 0 FROM part UNION ALL SELECT p_partkey, 'ClipPath', 0, 99, 1, 100, NULL FROM part UNION ALL SELECT p_partkey, 'PopClip', NULL, NULL, NULL, NULL, NULL FROM part)")
def file_drawing(spark, sf_dir):
    """Paths under a matrix, with colours and a clip."""
    content = _said("q 2 0 0 2 10 5 cm ", F.col("p_size") % 11 / F.lit(10.0), " 0 0 rg ", F.col("p_size") % 20, " 3 7 6 re f Q 0 0 m 50 ", F.col("p_partkey") % 80 + 10, " l s 0 0 1 1 re W n")
    return docs.draw_ops(_page(spark, sf_dir, content)).select(_key(), "op", "x0", "y0", "x1", "y1", "red")


@query("""WITH p AS (SELECT *, p_size % 10 / 10.0::DOUBLE AS t FROM part), q AS (SELECT *, pow(t, 2) AS sq, if(t > 0.5, 1 - t, t * 0.5) AS st FROM p)
SELECT p_partkey, trunc(255 * (1 - least(1, sq + 0.1)) + 1e-9)::INT AS red, trunc(255 * (1 - least(1, st + 0.1)) + 1e-9)::INT AS green, trunc(255 * (1 - least(1, 0.25 + 0.1)) + 1e-9)::INT AS blue FROM q""")
def file_tints(spark, sf_dir):
    """A separation colour whose tint is a program for four inks."""
    program = F.lit("{ dup dup mul exch dup 0.5 gt { 1 exch sub } { 0.5 mul } ifelse 0.25 0.1 }")
    files = _page(spark, sf_dir, _said("/S cs ", F.col("p_size") % 10 / F.lit(10.0), " scn 0 0 1 1 re f"), "/ColorSpace << /S [/Separation /Spot /DeviceCMYK 5 0 R] >>", _stream(program, "/FunctionType 4 /Domain [0 1] /Range [0 1 0 1 0 1 0 1]"))
    return docs.draw_ops(files).select(_key(), "red", "green", "blue")


@query("SELECT p_partkey, p_name AS text FROM part")
def file_filters(spark, sf_dir):
    """Contents under two filters."""
    plain = _said("BT /F 9 Tf (", F.col("p_name"), ") Tj ET")
    once = F.hex(F.encode(plain, "UTF-8"))
    twice = F.hex(F.encode(F.concat(once, F.lit(">")), "UTF-8"))
    files = _page(spark, sf_dir, F.concat(twice, F.lit(">")), "/Font << /F << /Subtype /Type1 /BaseFont /Times-Roman >> >>", filters="/Filter [/ASCIIHexDecode /AHx]")
    return docs.draw_ops(files).select(_key(), "text")


@query("SELECT p_partkey, (50 + p_size)::DOUBLE AS width, if(p_partkey % 2 = 0, 1, 2)::INT AS pages FROM part")
def file_updates(spark, sf_dir):
    """Objects defined again: the last definition counts."""
    objects = [(1, _ROOT), (2, F.lit("<< /Kids [3 0 R 4 0 R] >>")), (3, F.lit("<< /Type /Page /MediaBox [0 0 10 10] >>")), (4, F.lit("<< /Type /Page >>")), (3, _said("<< /Type /Page /MediaBox [0 0 ", F.col("p_size") + 50, " 10] >>")), (4, F.when(F.col("p_partkey") % 2 == 0, "null").otherwise("<< /Type /Page /MediaBox [0 0 1 1] >>"))]
    made = docs.parsed(_files(spark, sf_dir, objects))
    return made.select(_key(), F.col("pages")[0]["width"].alias("width"), F.col("page_count").alias("pages"))


@query("SELECT p_partkey, p_size % 256 AS first, (p_partkey % 256)::INT AS second, if(p_size % 256 BETWEEN 5 AND 9, 0, 1) + if(p_partkey % 256 BETWEEN 5 AND 9, 0, 1) + 2 AS seen FROM part")
def file_images(spark, sf_dir):
    """Gray samples of two widths with a colour key."""
    byte = lambda v: F.lpad(F.hex(v.cast("long") % 256), 2, "0")
    image = _stream(F.concat(byte(F.col("p_size")), byte(F.col("p_partkey")), F.lit("ff00>")), "/Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /ASCIIHexDecode /Mask [5 9]")
    made = docs.images(_page(spark, sf_dir, F.lit(""), "", image))
    value = lambda at: F.conv(F.hex(F.substring("pixels", at, 1)), 16, 10).cast("int")
    return made.select(_key(), value(1).alias("first"), value(5).alias("second"), F.col("seen").cast("int").alias("seen"))


@query("SELECT p_partkey, count(*) AS stops, sum(trunc((r / 255.0::DOUBLE) * (p_size % 11 / 10.0::DOUBLE) * 255))::BIGINT AS red FROM part, range(256) t(r) GROUP BY p_partkey")
def file_shadings(spark, sf_dir):
    """The ramp of an axial shading."""
    resources = _said("/Shading << /A << /ShadingType 2 /ColorSpace /DeviceRGB /Coords [0 0 9 0] /Function << /FunctionType 2 /Domain [0 1] /N 1 /C0 [0 0 0] /C1 [", F.col("p_size") % 11 / F.lit(10.0), " 0 0] >> >> >>")
    return docs.shading_colours(_page(spark, sf_dir, F.lit("/A sh"), resources)).groupBy(_key()).agg(F.count("*").alias("stops"), F.sum(F.col("red").cast("long")).alias("red"))


@query("SELECT p_partkey, (p_size + 10)::DOUBLE AS x0, (p_size + 50)::DOUBLE AS x1, 20.0::DOUBLE AS y0, 80.0::DOUBLE AS y1 FROM part WHERE p_partkey % 4 <> 0")
def file_annotations(spark, sf_dir):
    """Appearances fitted to their rectangles; hidden ones are not drawn."""
    stamp = _said("<< /Subtype /Stamp /F ", F.when(F.col("p_partkey") % 4 == 0, 2).otherwise(4), " /Rect [", F.col("p_size") + 10, " 20 ", F.col("p_size") + 50, " 80] /AP << /N << /On 6 0 R >> >> /AS /On >>")
    files = _page(spark, sf_dir, F.lit(""), "", stamp, _stream(F.lit("0 0 4 4 re f"), "/Subtype /Form /BBox [0 0 4 4] /Matrix [0 1 -1 0 3 3]"), entries="/Annots [5 0 R]")
    return docs.draw_ops(files).where("op = 'FillPath'").select(_key(), *[F.round(c, 6).alias(c) for c in ("x0", "x1", "y0", "y1")])


@query("SELECT p_partkey, kind, n::BIGINT AS n FROM part, (VALUES ('dictionary', 3), ('stream', 1), ('string', 1), ('array', 1)) k(kind, n)")
def file_objects(spark, sf_dir):
    return docs.objects(_page(spark, sf_dir, F.lit("q Q"), "", _said("(", F.col("p_name"), ")"), F.lit("[1 2]"))).groupBy(_key(), "kind").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, if(p_partkey % 7 = 0, 'damaged', 'open') AS status FROM part")
def file_status(spark, sf_dir):
    """Files that are none of this kind have a status, and the others are read."""
    head = F.when(F.col("p_partkey") % 7 == 0, F.lit("%none")).otherwise(F.lit("%PDF-1.4"))
    body = _said(head, "\n1 0 obj\n", _ROOT, "\nendobj\n2 0 obj\n<< /Kids [] >>\nendobj\ntrailer << /Root 1 0 R >>")
    files = _spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("string").alias("path"), F.encode(body, "ISO-8859-1").alias("content"))
    return docs.parsed(files).select(_key(), F.split("status", ":")[0].alias("status"))


@query("SELECT p_partkey, 200 AS width, 100 AS height, ((p_size % 100 + 1) * least(50, p_partkey % 60))::BIGINT AS black, (20000 - (p_size % 100 + 1) * least(50, p_partkey % 60))::BIGINT AS white FROM part")
def file_rendering(spark, sf_dir):
    """Pixels of a black rectangle on white paper."""
    files = _page(spark, sf_dir, _said("0 0 ", F.col("p_size") % 100 + 1, " ", F.least(F.lit(50), F.col("p_partkey") % 60), " re f"))
    made = docs.rendered_pages(files).withColumn("all", F.hex("pixels"))
    count = lambda colour: F.floor((F.length("all") - F.length(F.replace(F.col("all"), F.lit(colour), F.lit("")))) / 8).alias
    return made.select(_key(), "width", "height", count("000000FF")("black"), count("FFFFFFFF")("white"))
