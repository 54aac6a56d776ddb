import zlib

import pytest

from folioforge.sources import codecs
from folioforge.sources.document import Document
from folioforge.sources.documents import binary_files, parsed, parsed_one, rows_of
from folioforge.sources.objects import Reader, Ref, text_string


def file_of(*objects: str, tail: str = "trailer << /Root 1 0 R >>\nstartxref\n0\n%%EOF") -> bytes:
    return ("%PDF-1.4\n" + "\n".join(f"{n} 0 obj\n{body}\nendobj" for n, body in enumerate(objects, 1)) + "\n" + tail).encode("latin-1")


SMALL = file_of(
    "<< /Type /Catalog /Pages 2 0 R /PageLabels << /Nums [0 << /S /r >> 1 << /S /D /P (A-) /St 7 >> 1 << /S /a >>] >> /Outlines 6 0 R >>",
    "<< /Type /Pages /Kids [3 0 R 4 0 R 3 0 R] /Count 99 /MediaBox [0 0 200 300] >>",
    "<< /Type /Page /Parent 2 0 R /Annots [5 0 R << /Subtype /Link /Rect [0 0 1 1] >>] >>",
    "<< /Type /Page /Parent 2 0 R /Rotate 90 /CropBox [10 10 110 60] >>",
    "<< /Subtype /Link /Rect [90 110 10 130] /A << /S /GoTo /D [4 0 R /XYZ 10 60 0] >> >>",
    "<< /First 7 0 R >>",
    "<< /Title (One) /Next 8 0 R /First 9 0 R /Dest [3 0 R /Fit] >>",
    "<< /Title <FEFF0054> /A << /S /URI /URI (https://example.org/) >> /Next 7 0 R >>",
    "<< /Title (Inner) /Dest [4 0 R /FitH 60] >>",
)


def test_pages_links_labels_outline():
    doc = Document(SMALL)
    assert [(p.size, p.turn) for p in doc.pages] == [((200, 300), 0), ((50, 100), 90)]
    assert doc.links() == [(0, 0, "", 1, 50.0, 0.0, 10.0, 170.0, 90.0, 190.0)]
    assert doc.label_ranges() == [(0, "r", "", 1), (1, "D", "A-", 7)]
    assert [(o[0], o[1], o[2], o[3], o[4]) for o in doc.outline()] == [(0, 0, "One", "", 0), (1, 1, "Inner", "", 1), (2, 0, "T", "https://example.org/", -1)]


def test_cross_reference_tables():
    body = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"
    two = len(body)
    body += b"2 0 obj\n<< /Kids [3 0 R] >>\nendobj\n"
    three = len(body)
    body += b"3 0 obj\n<< /Type /Page >>\nendobj\n"
    table = len(body)
    body += b"xref\n0 4\n0000000000 65535 f \n%010d 00000 n \n%010d 00000 n \n%010d 00000 n \ntrailer << /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (9, two, three, table)
    doc = Document(body)
    assert not doc.file.repaired and len(doc.pages) == 1 and doc.pages[0].size == (612, 792)


def test_object_streams():
    inner = b"1 0 2 33 3 60 << /Type /Catalog /Pages 2 0 R >> << /Kids [3 0 R]           >> << /Type /Page >>"
    first = inner.index(b"<<")
    rel = [inner.index(b"<< /Type /Cat") - first, inner.index(b"<< /Kids") - first, inner.index(b"<< /Type /Page") - first]
    head = b"1 %d 2 %d 3 %d " % tuple(rel)
    packed = zlib.compress(head + inner[first:])
    body = b"%%PDF-1.5\n9 0 obj\n<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(head), len(packed)) + packed + b"\nendstream\nendobj\n"
    assert len(Document(body).pages) == 1


def test_values():
    assert Reader(rb"<< /A#42 [1 -2.5 (a\(b\)\101\
c) <4a4> 3 0 R true null] >>").value() == {"AB": [1, -2.5, b"a(b)Ac", b"J@", Ref(3, 0), True, None]}
    assert text_string(b"\xfe\xff\x00A\x01") == "A" and text_string(b"\x80") == "•"


@pytest.mark.parametrize("bad", [b"", b"%PDF", b"%PDF-1.4 1 0 obj << /Type", b"x" * 3000 + b"%PDF"])
def test_damaged_files_have_a_status(bad):
    assert parsed_one("x", bad)["status"].startswith("damaged")


def test_codecs():
    assert codecs.ascii_hex(b"4a 4B x4>zz") == b"JK@"
    assert codecs.run_length(bytes([2, 65, 66, 67, 254, 68, 128, 9])) == b"ABCDDD"
    assert codecs.ascii_85(b"<~87cURD]j7BEbo80~>") == b"Hello world!"
    assert codecs.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert codecs.inflate(zlib.compress(b"abc" * 50)[:-6])[:3] == b"abc"
    assert codecs.unpredicted(bytes([1, 1, 1, 1, 2, 1, 1, 1]), 12, 1, 8, 3) == bytes([1, 2, 3, 2, 3, 4])
    assert codecs.unpredicted(bytes([1, 1, 1]), 2, 1, 8, 3) == bytes([1, 2, 3])
    with pytest.raises(codecs.FilterError):
        codecs.decoded(b"", [("Fl", {})] * 9)


def test_tables_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(SMALL)
    (tmp_path / "in" / "b.pdf").write_bytes(b"no")
    made = parsed(binary_files(spark, str(tmp_path / "in")))
    assert sorted(r.status[:7] for r in made.collect()) == ["damaged", "open"]
    assert rows_of(made, "pages").count() == 2 and rows_of(made, "links").first().target == 1
    from folioforge.streaming.arrivals import arriving

    q = arriving(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from arrived").count() == 2


def test_characters_and_search(spark, tmp_path):
    from folioforge.operators.textsearch import search_pages
    from folioforge.sources.content import operations
    from folioforge.sources.documents import chars

    body = "q 1 0 0 1 10 20 cm BT /F 10 Tf 5 50 Td (Hi) Tj [(A) -500 (B)] TJ T* ET Q BI /W 1 ID xx EI /X Do"
    data = file_of("<< /Type /Catalog /Pages 2 0 R >>", "<< /Kids [3 0 R] /MediaBox [0 0 200 100] /Resources << /Font << /F << /BaseFont /Courier >> >> >> >>", "<< /Type /Page /Contents 4 0 R >>", f"<< /Length {len(body)} >>\nstream\n{body}\nendstream")
    (tmp_path / "c.pdf").write_bytes(data)
    assert [name for name, _ in operations(body.encode())] == ["q", "cm", "BT", "Tf", "Td", "Tj", "TJ", "T*", "ET", "Q", "BI", "Do"]
    table = chars(binary_files(spark, str(tmp_path)))
    rows = table.orderBy("seq").collect()
    assert [(chr(r.rune), round(r.ox, 3), round(r.oy, 3)) for r in rows] == [("H", 15.0, 30.0), ("i", 21.0, 30.0), ("A", 27.0, 30.0), ("B", 38.0, 30.0)]
    assert search_pages(table.withColumnRenamed("path", "doc_id"), "a b").count() == 1
