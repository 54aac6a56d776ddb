"""Content streams: their operations, one after another."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .document import Document, Page
from .objects import Damaged, Name, Reader, Stream

OPERANDS_MOST, PARTS_MOST, CONTENT_MOST = 64, 8192, 1 << 28
INLINE_END = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|\Z)")
WORD = re.compile(rb"[\0\t\n\f\r ]*([A-Za-z'\"*][A-Za-z0-9'\"*]*)")
#: Short names in inline images.
SHORT = {"BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width"}
SHORT_FILTERS = {"AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "Fl": "FlateDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
SAMPLES = {"DeviceGray": 1, "G": 1, "CalGray": 1, "Indexed": 1, "I": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "DeviceCMYK": 4, "CMYK": 4}


def contents(doc: Document, page: Page) -> bytes:
    """The page's streams, joined by line ends; parts that are none are skipped, and a total too large is cut."""
    value = doc.file.get(page.entries.get("Contents"))
    parts, held, out = value[:PARTS_MOST] if isinstance(value, list) else [value], 0, []
    for part in parts:
        part = doc.file.get(part)
        if isinstance(part, Stream):
            out.append(doc.file.content(part))
            held += len(out[-1]) + 1
            if held > CONTENT_MOST:
                break
    return b"\n".join(out)[:CONTENT_MOST]


def operations(data: bytes) -> Iterator[tuple[str, list]]:
    """(operator, its first operands) in order; what cannot be read is passed over.  An inline image is one operation
    `BI` with a stream as its operand."""
    reader, operands = Reader(data), []
    while reader.at < len(data):
        m = WORD.match(data, reader.at)
        if m and m[1] not in (b"true", b"false", b"null"):
            reader.at = m.end()
            name = m[1].decode()
            yield (name, [_inline(reader)]) if name == "BI" else (name, operands)
            operands = []
            continue
        before = reader.at
        try:
            value = reader.value()
            if len(operands) < OPERANDS_MOST:
                operands.append(value)
        except (Damaged, ValueError):
            reader.at = max(reader.at, before + 1)


def _inline(reader: Reader) -> Stream | None:
    """The image after BI: as many bytes as its size takes where nothing is encoded, else up to EI."""
    entries: dict = {}
    data = reader.data
    while reader.at < len(data) and len(entries) < OPERANDS_MOST:
        m = WORD.match(data, reader.at)
        if m and m[1] == b"ID":
            reader.at = m.end() + 1
            break
        before = reader.at
        try:
            key = reader.value()
            if isinstance(key, Name):
                entries[SHORT.get(str(key), str(key))] = reader.value()
        except (Damaged, ValueError):
            reader.at = max(reader.at, before + 1)
    else:
        return None
    filters = entries.get("Filter")
    filters = filters if isinstance(filters, list) else [filters] if filters is not None else []
    if filters:
        entries["Filter"] = [Name(SHORT_FILTERS.get(str(f), str(f))) for f in filters]
    width, height = entries.get("Width"), entries.get("Height")
    bits = 1 if entries.get("ImageMask") is True else entries.get("BitsPerComponent", 8)
    space = entries.get("ColorSpace")
    space = space[0] if isinstance(space, list) and space else space
    samples = 1 if entries.get("ImageMask") is True else SAMPLES.get(str(space))
    start = reader.at
    if not filters and samples and all(isinstance(v, int) and v > 0 for v in (width, height, bits)):
        size = (width * samples * bits + 7) // 8 * height
        end = re.compile(rb"[\0\t\n\f\r ]*EI(?=[\0\t\n\f\r ]|\Z)").match(data, start + size)
        if end:
            reader.at = end.end()
            return Stream(entries, data[start : start + size])
    end = INLINE_END.search(data, start)
    reader.at = end.end() if end else len(data)
    return Stream(entries, data[start : end.start()] if end else data[start:])
