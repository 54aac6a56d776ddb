"""Caches, expected results, paths as columns and the command."""

import json
import subprocess
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioforge.functions import paths
from folioforge.sources import goldens
from folioforge.sources.documents import png, soak, with_png
from folioforge.sources.store import Store

from .test_content import stream
from .test_documents import SMALL, file_of


def test_store():
    made, asked = Store(10), []
    get = lambda k, n: made.get(k, lambda: asked.append(k) or b"x" * n)
    assert get("a", 4) == get("a", 4) == b"xxxx" and asked == ["a"]
    get("b", 4)
    get("a", 4)
    get("c", 4)  # b was used least recently
    assert list(made.held) == ["a", "c"] and made.used == 8
    assert len(get("d", 11)) == 11 and "d" not in made.held and get("e", 0) == b""
    assert made.get("none", lambda: None) is None and made.held["none"] == (None, 1)
    made.clear()
    assert made.used == 0 and not made.held
    free = Store()
    free.get("a", lambda: b"x" * 10**6)
    assert free.used == 10**6


def test_decoded_streams_are_counted_once():
    from folioforge.sources.document import Document

    doc = Document(file_of("<< /Type /Catalog /Pages 2 0 R /X 3 0 R >>", "<< /Kids [] >>", stream("414243>", "/Filter /ASCIIHexDecode")))
    held = doc.file.get(doc.root["X"])
    assert doc.file.content(held) == doc.file.content(held) == b"ABC" and doc.file.produced == 3


def test_goldens(spark, tmp_path):
    quad = [0, 0, 10, 0, 0, 5, 10, 5]
    for name, quads in (("one", [quad, quad]), ("two", [quad])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "truth.json").write_text(json.dumps({"file": name, "pageCount": 1, "needles": ["x"], "pages": [{"page": 0, "bounds": [0, 0, 1, 1], "searchRaw": {"x": quads, "y": []}}]}, indent=1))
    (tmp_path / "two" / "thresholds.json").write_text(json.dumps({"justification": "thin lines", "maxOver24Pct": 5}))
    expected = goldens.expected_quads(goldens.truths(spark, str(tmp_path)))
    assert expected.count() == 3
    near = [v + 0.005 for v in quad]
    found = spark.createDataFrame([("one", 0, "x", 0, near), ("one", 0, "x", 1, [v + 0.02 for v in quad]), ("two", 0, "x", 0, near), ("two", 0, "z", 0, near)], "name string, page int, needle string, ord int, quad array<double>")
    got = {(r.name, r.needle): r for r in goldens.quad_errors(found, expected).collect()}
    assert not got["one", "x"].passes and got["one", "x"].most == pytest.approx(0.02) and got["two", "x"].passes and not got["two", "z"].passes
    limits = goldens.thresholds(spark, str(tmp_path))
    assert [tuple(r) for r in limits.collect()] == [("two", 5.0, 10.0, 2.0)]
    rows = spark.createDataFrame([("one", 0, 0.0, 0.04, 1.0), ("two", 0, 0.0, 0.04, 1.0), ("two", 1, None, None, None)], "name string, page int, over8 double, over24 double, mean double")
    assert sorted((r.name, r.page, r.passes) for r in goldens.judged_renderings(rows, limits).collect()) == [("one", 0, False), ("two", 0, True), ("two", 1, False)]
    (tmp_path / "one" / "thresholds.json").write_text('{"other": 1}')
    with pytest.raises(ValueError):
        goldens.thresholds(spark, str(tmp_path))


def test_paths(spark):
    lit = lambda v: F.lit(float(v))
    made = paths.close(paths.cubic_to(paths.line_to(paths.move_to(paths.empty(), lit(1), lit(2)), lit(3), lit(4)), (lit(0), lit(0)), (lit(9), lit(9)), (lit(5), lit(6))))
    m = tuple(lit(v) for v in (2, 0, 0, 1, 10, 0))
    row = spark.range(1).select(made.alias("p"), paths.box(made).alias("b"), paths.box(paths.transformed(made, m)).alias("t"), paths.closed_corners(paths.rectangle(lit(0), lit(0), lit(2), lit(1))).alias("r"), paths.closed_corners(made).alias("n"), paths.box(paths.empty()).alias("e")).first()
    assert [s.verb for s in row.p] == ["M", "L", "C", "Z"] and tuple(row.b) == (0, 0, 9, 9) and tuple(row.t) == (10, 0, 28, 9)
    assert tuple(row.r) == (0, 0, 2, 1) and row.n is None and row.e.x0 is None


def test_soak_and_png(spark):
    locked = file_of("<< /Type /Catalog /Pages 2 0 R >>", "<< /Kids [] >>", tail="trailer << /Root 1 0 R /Encrypt << /Filter /Other >> >>\nstartxref\n0\n%%EOF")
    files = spark.createDataFrame([("a", bytearray(SMALL)), ("b", bytearray(b"x")), ("c", None), ("d", bytearray(locked))], "path string, content binary")
    assert sorted(map(tuple, soak(files).collect())) == [("a", True, False, 2), ("b", False, False, 0), ("c", False, False, 0), ("d", True, True, 0)]
    made = png(bytes(range(16)), 2, 2)
    assert made[:8] == b"\x89PNG\r\n\x1a\n" and zlib.decompress(made[41 : 41 + int.from_bytes(made[33:37], "big")]) == b"\0" + bytes(range(8)) + b"\0" + bytes(range(8, 16))
    rows = spark.createDataFrame([(2, 2, bytearray(range(16)))], "width int, height int, pixels binary")
    assert bytes(with_png(rows).first().png) == made


def test_command(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(SMALL)
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-m", "folioforge", str(tmp_path / "in"), str(tmp_path / "out"), "36"], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-500:]
    import pyarrow.parquet as pq

    assert pq.read_table(tmp_path / "out" / "pages").num_rows == 2 and pq.read_table(tmp_path / "out" / "labels").num_rows == 2
