from folioforge.operators.textsearch import PageText, search_pages, with_line_flags
from folioforge.operators.textsearch import search as search_page
from folioforge.sources import crypt


def line(text, x=0.0, y=100.0, size=10.0, step=5.0, axis=True):
    """Rows (rune, quad, origin, end, size, axis)."""
    return [(ord(c), [x + k * step, y - size, x + (k + 1) * step, y - size, x + k * step, y, x + (k + 1) * step, y], (x + k * step, y), (x + (k + 1) * step, y), size, axis) for k, c in enumerate(text)]


def search(rows, needle, most=1000):
    return search_page(PageText(*map(list, zip(*rows, strict=True))), needle, most)


def test_matches_fold_case_and_do_not_overlap():
    assert len(search(line("aAaA"), "aa")) == 2 and search(line("abc"), "  ") == []
    assert search(line("abc"), "BC") == [[5.0, 90.0, 15.0, 90.0, 5.0, 100.0, 15.0, 100.0]]


def test_white_space_is_a_character_a_gap_or_a_line():
    assert len(search(line("ab cd"), "ab cd")) == 1 and search(line("abcd"), "ab cd") == []
    assert len(search(line("ab") + line("cd", x=13), "ab cd")) == 1
    wrapped = line("ab") + line("cd", y=120)
    assert len(search(wrapped, "ab cd")) == 2 and search(wrapped, "abcd") == []
    assert search(line("ab cd"), "ab  cd") == []


def test_taller_characters_split_quads_and_the_limit_counts_quads():
    mixed = line("alpha") + [(32, [25.0, 60.0, 35.0, 60.0, 25.0, 110.0, 35.0, 110.0], (25.0, 100.0), (35.0, 100.0), 40.0, True)] + line("beta", x=35)
    assert len(search(mixed, "alpha beta")) == 3 and len(search(mixed, "alpha beta", 2)) == 2


def test_small_steps_keep_the_first_height_and_turned_text_is_one_quad():
    taller = line("ab", size=9.5) + line("cd", x=10, size=10.0)
    assert search(taller, "abcd") == [[0.0, 90.5, 20.0, 90.5, 0.0, 100.0, 20.0, 100.0]]
    turned = [(ord(c), [10.0, 5.0 * k, 10.0, 5.0 * k + 5, 0.0, 5.0 * k, 0.0, 5.0 * k + 5], (2.0, 5.0 * k), (2.0, 5.0 * k + 5), 10.0, False) for k, c in enumerate("turn")]
    assert search(turned, "turn") == [[10.0, 0.0, 10.0, 20.0, 0.0, 0.0, 0.0, 20.0]]
    assert search([(0, *line("x")[0][1:])], "x") == [] and search(line("ab ") + line("cd", y=120), "b cd") == [[5.0, 90.0, 15.0, 90.0, 5.0, 100.0, 15.0, 100.0], [0.0, 110.0, 10.0, 110.0, 0.0, 120.0, 10.0, 120.0]]


def test_pages_as_tables(spark):
    rows = [("d", p, k, c[0], c[1], *c[2], *c[3], c[4], c[5]) for p in (0, 1) for k, c in enumerate(line("find me") + line("again", y=130.0))]
    chars = spark.createDataFrame(rows, "doc_id string, page_no int, seq long, rune int, quad array<double>, ox double, oy double, ex double, ey double, size double, axis boolean")
    assert search_pages(chars, "ME").count() == 2
    assert {r.line for r in with_line_flags(chars).select("line").distinct().collect()} == {0, 1}


def test_ciphers():
    assert crypt.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"
    key, block = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypt.AES(key).encrypt(block).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypt.AES(bytes(range(32))).encrypt(block).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert crypt.AES(bytes(range(32))).decrypt(crypt.AES(bytes(range(32))).encrypt(block)) == block
    sealed = crypt.cbc_encrypt(key, b"hello" + bytes([11]) * 11, bytes(16))
    assert crypt.cbc_decrypt(key, bytes(16) + sealed) == b"hello" and crypt.cbc_decrypt(key, b"short") == b"short"


def test_passwords():
    for revision, length in ((2, 40), (3, 128)):
        owner = b"o" * 32
        key = crypt.file_key(b"secret", owner, -44, b"id", revision, length)
        entries = {"R": revision, "O": owner, "U": crypt.user_entry(key, b"id", revision), "P": -44, "Length": length}
        assert crypt.authenticate(b"secret", entries, b"id") == (2, key) and crypt.authenticate(b"x", entries, b"id") == (0, None)
    salt, fk = b"saltsaltkeysalt!", bytes(range(32))
    for revision in (5, 6):
        user = crypt.hardened(b"pw", salt[:8], b"", revision) + salt
        wrapped = crypt.cbc_encrypt(crypt.hardened(b"pw", salt[8:], b"", revision), fk, bytes(16))
        assert crypt.authenticate(b"pw", {"R": revision, "O": bytes(48), "U": user, "UE": wrapped}, b"") == (2, fk)


def test_encrypted_document():
    from folioforge.sources.document import Document
    from tests.test_documents import file_of

    key = crypt.file_key(b"", b"o" * 32, -4, b"id", 3, 128)
    title = crypt.rc4(crypt.object_key(key, 5, 0, False), b"Sealed").hex()
    lock = f"<< /Filter /Standard /V 2 /R 3 /Length 128 /P -4 /O <{(b'o' * 32).hex()}> /U <{crypt.user_entry(key, b'id', 3).hex() + '00' * 16}> >>"
    data = file_of("<< /Type /Catalog /Pages 2 0 R /Outlines 4 0 R >>", "<< /Kids [3 0 R] >>", "<< /Type /Page >>", "<< /First 5 0 R >>", f"<< /Title <{title}> /Dest [3 0 R /Fit] >>", lock, tail="trailer << /Root 1 0 R /Encrypt 6 0 R /ID [<6964> <6964>] >>")
    doc = Document(data)
    assert doc.file.status == 2 and doc.outline()[0][2] == "Sealed"
