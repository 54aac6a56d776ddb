"""Binary documents as tables: one parse per file, spread over the files.

A file that cannot be read, in whatever way, has a status and costs no other file anything.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType, _parse_datatype_string

from ..functions import geometry, labels as numerals, scalars
from . import cmaps, shadings
from .document import Document, Page
from .images import about
from .interpreter import characters, drawn
from .objects import Damaged, Stream
from .raster import rendered

TOC_MOST, LINKS_MOST, AREA_MOST = 1000, 1000, 268_435_456
#: Rows of one batch, and bytes of pixels that are held back for one.
ROWS_HELD, BYTES_HELD = 1000, 8 << 20
SCHEMA = """path string, status string, page_count int, repaired boolean, decoded_bytes long,
 pages array<struct<page:int,x0:double,y0:double,x1:double,y1:double,rotate:int,width:double,height:double>>,
 label_ranges array<struct<first:int,style:string,prefix:string,start:long>>,
 outline array<struct<ord:int,depth:int,title:string,uri:string,page:int,x:double,y:double>>,
 links array<struct<page:int,ord:int,uri:string,target:int,x:double,y:double,x0:double,y0:double,x1:double,y1:double>>"""


def binary_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path and content of the files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def opened(content: bytes | None, password: str | None = None) -> Document:
    return Document(content or b"", None if password is None else password.encode())


def parsed_one(path: str, content: bytes | None, password: str | None = None) -> dict:
    """A row of SCHEMA; a file that cannot be opened has a status and nothing else."""
    try:
        doc = opened(content, password)
        pages = [{"page": p.number, **dict(zip(("x0", "y0", "x1", "y1"), p.box, strict=True)), "rotate": p.turn, "width": p.size[0], "height": p.size[1]} for p in doc.pages]
        names = ("page", "ord", "uri", "target", "x", "y", "x0", "y0", "x1", "y1")
        return {"path": path, "status": "open" if doc.file.status else "locked", "page_count": len(pages), "repaired": doc.file.repaired, "pages": pages, "label_ranges": [dict(zip(("first", "style", "prefix", "start"), r, strict=True)) for r in doc.label_ranges()], "decoded_bytes": doc.file.produced, "outline": [dict(zip(("ord", "depth", "title", "uri", "page", "x", "y"), r, strict=True)) for r in doc.outline()], "links": [dict(zip(names, r, strict=True)) for r in doc.links()]}
    except Damaged as error:
        return {"path": path, "status": f"damaged: {error}"}
    except Exception as error:  # noqa: BLE001  a hostile file must not end the job
        return {"path": path, "status": f"damaged: {type(error).__name__}"}


def _rows(schema: pa.Schema, make: Callable[[str, bytes, str | None], Iterator[list[dict]]]):
    """mapInArrow over path, content, password; make gives lists of rows of one file, and a file that fails ends there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for path, content, password in zip(batch.column("path").to_pylist(), batch.column("content"), batch.column("password").to_pylist(), strict=True):
                found = make(path, content.as_py(), password)
                while True:
                    try:
                        rows = next(found)
                    except StopIteration:
                        break
                    except Exception:  # noqa: BLE001  a hostile file must not end the job
                        break
                    held += rows
                    size += sum(len(r.get("pixels") or b"") for r in rows)
                    while len(held) >= ROWS_HELD or held and size >= BYTES_HELD:
                        yield pa.RecordBatch.from_pylist(held[:ROWS_HELD], schema=schema)
                        held, size = held[ROWS_HELD:], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def _table(files: DataFrame, kinds: str, make, password: str | Column | None = None) -> DataFrame:
    schema = _parse_datatype_string(kinds)
    said = password if isinstance(password, Column) else F.lit(password).cast("string")
    return files.select("path", "content", said.alias("password")).mapInArrow(_rows(to_arrow_schema(schema), make), schema)


def parsed(files: DataFrame, password: str | Column | None = None) -> DataFrame:
    """One row per file (columns path, content); write it once and take the tables below from it.  password: one for all
    files, or a column of files."""
    return _table(files, SCHEMA, lambda path, content, word: iter([[parsed_one(path, content, word)]]), password)


CHARS = "path string, page_no int, seq long, rune int, quad array<double>, ox double, oy double, ex double, ey double, size double, axis boolean"
DRAW = """path string, page int, seq long, op string, level int, x0 double, y0 double, x1 double, y1 double, path_data string, even_odd boolean, red int, green int, blue int, pattern string, alpha double, blend string,
 line_width double, cap int, join int, miter double, dash array<double>, phase double, text string, font string, size double, name string, width int, height int, matrix array<double>, steps array<double>, isolated boolean, knockout boolean"""


def _each_page(rows: Callable[[Document, Page], list[dict]]):
    def make(path: str, content: bytes, password: str | None) -> Iterator[list[dict]]:
        doc = opened(content, password)
        for page in doc.pages:
            try:
                found = rows(doc, page)
            except Exception:  # noqa: BLE001  the next page may be sound
                continue
            yield [{"path": path} | r for r in found]

    return make


def chars(files: DataFrame, password: str | Column | None = None) -> DataFrame:
    """Positioned characters of every page, for search; batches of a page."""
    return _table(files, CHARS, _each_page(characters), password)


def draw_ops(files: DataFrame, password: str | Column | None = None) -> DataFrame:
    """Every drawing operation of every page, in order: paths and clips, text runs, images, shadings, groups, masks, tiles."""
    return _table(files, DRAW, _each_page(lambda doc, page: drawn(doc, page).ops), password)


def character_maps(files: DataFrame, password: str | Column | None = None) -> DataFrame:
    """The ranges of every character map in the files: the stream's object number, kind (space, cid, text), depth of the base map, code
    length, low and high code, and the number or text of the lowest."""

    def make(path: str, content: bytes, word: str | None) -> Iterator[list[dict]]:
        doc = opened(content, word)
        for at, value in _objects(doc):
            if isinstance(value, Stream) and (value.entries.get("Type") == "CMap" or b"begincmap" in (data := doc.file.content(value))[:4096]):
                data = doc.file.content(value)
                yield [{"path": path, "object": at} | r for r in cmaps.ranges(cmaps.parse(data))]

    return _table(files, "path string, object int, kind string, depth int, size int, low long, high long, number long, text string", make, password)


def _objects(doc: Document) -> Iterator[tuple[int, object]]:
    from .objects import Ref

    for at in sorted(doc.file.places):
        try:
            yield at, doc.file.get(Ref(at, 0))
        except Exception:  # noqa: BLE001  a broken object is none
            continue


def objects(files: DataFrame, password: str | Column | None = None) -> DataFrame:
    """Every object of every file: number, kind, its /Type and /Subtype, its keys, and bytes of a stream before and after its filters."""

    def make(path: str, content: bytes, word: str | None) -> Iterator[list[dict]]:
        doc = opened(content, word)
        for at, value in _objects(doc):
            entries = value.entries if isinstance(value, Stream) else value if isinstance(value, dict) else {}
            kind = "stream" if isinstance(value, Stream) else {dict: "dictionary", list: "array", bytes: "string", bool: "boolean", int: "integer", float: "real", type(None): "null"}.get(type(value), "name")
            said = {k.lower(): (str(entries[k]) if isinstance(entries.get(k), str) else None) for k in ("Type", "Subtype")}
            sizes = {"raw": len(value.raw), "decoded": len(doc.file.content(value))} if isinstance(value, Stream) else {}
            yield [{"path": path, "object": at, "kind": kind, "keys": [str(k) for k in entries]} | said | sizes]

    return _table(files, "path string, object int, kind string, type string, subtype string, keys array<string>, raw long, decoded long", make, password)


def authenticated(files: DataFrame, password: str | Column) -> DataFrame:
    """path, whether a password is needed at all, and what the password opens: 0 nothing, 1 none needed, 2 as user, 4 as owner."""

    def make(path: str, content: bytes, word: str | None) -> Iterator[list[dict]]:
        doc = opened(content)
        yield [{"path": path, "needs_password": not doc.file.status, "status": doc.authenticate((word or "").encode())}]

    return _table(files, "path string, needs_password boolean, status int", make, password)


def soak(files: DataFrame) -> DataFrame:
    """path, whether the file opens, needs a password, and its pages: one row for every file, however broken."""

    def make(path: str, content: bytes, word: str | None) -> Iterator[list[dict]]:
        try:
            doc = opened(content)
        except Exception:  # noqa: BLE001  that is what the row says
            yield [{"path": path, "open": False, "needs_password": False, "page_count": 0}]
            return
        yield [{"path": path, "open": True, "needs_password": not doc.file.status, "page_count": len(doc.pages)}]

    return _table(files, "path string, open boolean, needs_password boolean, page_count int", make)


def rows_of(parsed_files: DataFrame, column: str) -> DataFrame:
    """The table `pages`, `label_ranges`, `outline` or `links` with the path of its document."""
    return parsed_files.select("path", F.explode(column).alias("r")).select("path", "r.*")


def labels(parsed_files: DataFrame) -> DataFrame:
    """path, page, label: the last range that starts at or before the page, or the page's number where none does.  Ranges and pages
    stand in one row of the parsed table, so nothing is shuffled."""
    of = F.expr("element_at(filter(label_ranges, r -> r.first <= p.page), -1)")
    found = parsed_files.select("path", "label_ranges", F.explode("pages").alias("p")).where("p.page is not null")
    found = found.select("path", F.col("p.page").alias("page"), F.when(F.exists("label_ranges", lambda r: r["first"] <= F.col("p.page")), of).alias("r"))
    said = numerals.label(F.col("r.style"), F.col("r.prefix"), F.col("r.start") + F.col("page") - F.col("r.first"))
    return found.select("path", "page", scalars.sanitized(F.when(F.col("r").isNull(), (F.col("page") + 1).cast("string")).otherwise(said)).alias("label"))


def has_labels(parsed_files: DataFrame) -> DataFrame:
    return parsed_files.select("path", (F.coalesce(F.size("label_ranges"), F.lit(0)) > 0).alias("has_labels"))


def pages_with_label(parsed_files: DataFrame, label: str) -> DataFrame:
    """path and page of every page with this label, in any case; an empty label finds none."""
    import re

    fits = F.col("label").rlike(r"\A(?iu:" + re.escape(label) + r")\z") if label else F.lit(False)
    return labels(parsed_files).where(fits).select("path", "page")


def page_sizes(parsed_files: DataFrame, dpi: float = 72.0, most_width: int = 0, most_height: int = 0) -> DataFrame:
    """path, page, width and height in points and in pixels at this resolution, cut to the limits that are positive."""
    pages = rows_of(parsed_files, "pages")
    scale = geometry.scale_of(F.lit(dpi))
    across, down = geometry.extent(F.col("width"), scale), geometry.extent(F.col("height"), scale)
    across, down = (F.least(v, F.lit(most)) if most > 0 else v for v, most in ((across, most_width), (down, most_height)))
    return pages.select("path", "page", "width", "height", across.alias("pixels_across"), down.alias("pixels_down"))


def table_of_contents(parsed_files: DataFrame, dpi: float = 72.0) -> DataFrame:
    """path, ord, depth, title, page, x, y in reading order, TOC_MOST entries a document at most; a parent counts before its children."""
    scale = geometry.scale_of(F.lit(dpi))
    at = lambda c: F.coalesce(geometry.to_pixels(F.col(c) * scale), F.lit(0)).alias(c)
    return rows_of(parsed_files, "outline").where(F.col("ord") < TOC_MOST).select("path", "ord", "depth", scalars.sanitized(F.col("title")).alias("title"), "page", at("x"), at("y"))


def public_links(parsed_files: DataFrame, dpi: float = 72.0) -> DataFrame:
    """path, page, ord, uri, target, x, y and the rectangle in pixels: links that lead somewhere, LINKS_MOST a page at most, counted after
    those that do not are gone.  The point is cut to the target page's image.  Pages and links of a document stand in one row."""
    scale = geometry.scale_of(F.lit(dpi))
    found = parsed_files.select("path", "pages", F.explode("links").alias("l")).select("path", "pages", "l.*")
    own = F.expr("element_at(pages, page + 1)")
    there = F.when(F.col("target") >= 0, F.expr("element_at(pages, greatest(target, 0) + 1)")).otherwise(own)
    found = found.withColumns({"own": own, "there": there, "uri": F.when(F.col("target") >= 0, "").otherwise(scalars.sanitized(F.col("uri")))})
    size = lambda of, side: geometry.extent(F.col(f"{of}.{side}"), scale)
    box = geometry.scale_rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), scale, size("own", "width"), size("own", "height"))
    point = lambda c, side: F.when(F.col("target") >= 0, F.coalesce(geometry.scale_point(F.col(c), scale, size("there", side)), F.lit(0))).otherwise(0).cast("long").alias(c)
    made = found.where("target >= 0 or uri <> ''").select("path", "page", "ord", "uri", "target", point("x", "width"), point("y", "height"), *[v.alias(c) for v, c in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])
    from pyspark.sql import Window

    # at most 65,536 links stand on a page
    order = Window.partitionBy("path", "page").orderBy("ord")
    return made.withColumn("n_", F.row_number().over(order)).where(F.col("n_") <= LINKS_MOST).drop("n_")


def images(files: DataFrame, password: str | Column | None = None) -> DataFrame:
    """Every image of every file: its object number, size, status, pixels (four bytes each) and how many are not clear."""

    def make(path: str, content: bytes, word: str | None) -> Iterator[list[dict]]:
        doc = opened(content, word)
        for at, value in _objects(doc):
            if isinstance(value, Stream) and value.entries.get("Subtype") == "Image":
                yield [{"path": path, "object": at} | about(doc, value)]

    return _table(files, "path string, object int, width int, height int, status string, stencil boolean, pixels binary, seen long", make, password)


def shading_colours(files: DataFrame, password: str | Column | None = None) -> DataFrame:
    """Every shading named in a page's resources: the stops of a ramp (x: its place from 0 to 1), the cells of a grid (x, y) or the corners of
    triangles (n: three to each), with their colours."""

    def rows(doc: Document, page: Page) -> list[dict]:
        named = doc.file.get((doc.file.get(page.resources) or {}).get("Shading"))
        out = []
        for name, value in named.items() if isinstance(named, dict) else ():
            try:
                made = shadings.parsed(doc.file, value)
            except shadings.NoShading:
                continue
            points = [(t, None, c) for t, c in made.stops] + made.grid + [(*p, c) for ps, cs in made.triangles for p, c in zip(ps, cs, strict=True)]
            out += [{"page": page.number, "name": str(name), "kind": made.kind, "n": n, "x": x, "y": y, "red": c[0], "green": c[1], "blue": c[2]} for n, (x, y, c) in enumerate(points)]
        return out

    return _table(files, "path string, page int, name string, kind int, n int, x double, y double, red int, green int, blue int", _each_page(rows), password)


def rendered_pages(files: DataFrame, dpi: float = 72.0, most_width: int = 0, most_height: int = 0, password: str | Column | None = None) -> DataFrame:
    """Every page as pixels: path, page, width, height and four bytes (red, green, blue, alpha) a pixel; a page of no or too large a size has no row."""
    scale = min(max(dpi, 1.0) / 72.0, 10.0)

    def rows(doc: Document, page: Page) -> list[dict]:
        made = rendered(doc, page, scale, most_width, most_height)
        return [] if made is None else [{"page": page.number, "width": made.shape[1], "height": made.shape[0], "pixels": made.tobytes()}]

    return _table(files, "path string, page int, width int, height int, pixels binary", _each_page(rows), password)


def pixel_differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """path, page, and of all bytes of two renderings of a page: the share over 8 and over 24 apart, and the mean and largest distance;
    pages of different sizes have no numbers."""
    both = one.alias("a").join(other.alias("b"), ["path", "page"]).select("path", "page", F.when((F.col("a.width") == F.col("b.width")) & (F.col("a.height") == F.col("b.height")), F.struct(F.col("a.pixels").alias("a"), F.col("b.pixels").alias("b"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out: list[list[float | None]] = []
            for p in batch.column("p").to_pylist():
                if p is None:
                    out.append([None] * 4)
                    continue
                d = np.abs(np.frombuffer(p["a"], np.uint8).astype(np.int16) - np.frombuffer(p["b"], np.uint8))
                out.append([float((d > 8).mean()), float((d > 24).mean()), float(d.mean()), float(d.max())])
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("page"), *(pa.array([r[k] for r in out], pa.float64()) for k in range(4))], names=["path", "page", "over8", "over24", "mean", "most"])

    return both.mapInArrow(run, "path string, page int, over8 double, over24 double, mean double, most double")


def within_thresholds(differences: DataFrame, over8: float = 0.10, over24: float = 0.02, mean: float = 2.0) -> DataFrame:
    """differences with `passes`: whether a page keeps within the limits; a page without numbers does not."""
    return differences.withColumn("passes", F.coalesce((F.col("over8") <= over8) & (F.col("over24") <= over24) & (F.col("mean") <= mean), F.lit(False)))


def png(pixels: bytes, width: int, height: int) -> bytes:
    """Four bytes a pixel as a PNG file."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + pixels[4 * width * y : 4 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def with_png(rendered: DataFrame) -> DataFrame:
    """A table of pixels with a PNG file of each page."""
    schema = StructType([*rendered.schema.fields, StructField("png", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [png(p, w, h) for p, w, h in zip(*(batch.column(c).to_pylist() for c in ("pixels", "width", "height")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "png"])

    return rendered.mapInArrow(run, schema)
