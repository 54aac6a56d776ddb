"""The object layer of a document file: values, cross references, repair.

Values are Python ones: bool, int, float, None, bytes (strings), list, dict; names, references and streams have types.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import crypt
from .codecs import FilterError, decoded
from .store import Store

DEEPEST, HOPS, OBJECT_MOST = 512, 64, 1 << 24
#: Bytes of decoded streams that a document keeps.
DECODED_MOST = 32 << 20
SPACE = b"\0\t\n\f\r "
TOKEN = re.compile(rb"[\0\t\n\f\r ]*(?:%[^\r\n]*[\0\t\n\f\r ]*)*(?:(?P<number>[+-]*(?:\d+\.?\d*|\.\d+)(?![^\0\t\n\f\r ()<>\[\]{}/%]))|/(?P<name>[^\0\t\n\f\r ()<>\[\]{}/%]*)|(?P<open><<|>>|[\[\]{}(<])|(?P<word>[^\0\t\n\f\r ()<>\[\]{}/%]+)|(?P<odd>[)>]))")
REFERENCE = re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
HEADER = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj")
ESCAPES = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}


class Name(str):
    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int


@dataclass
class Stream:
    entries: dict
    raw: bytes


class Damaged(ValueError):
    pass


class Reader:
    """Values from bytes, one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self):
        m = TOKEN.match(self.data, self.at)
        if not m or m.end() == self.at and m.lastgroup is None:
            raise Damaged("no token")
        self.at = m.end()
        return m.lastgroup, m[m.lastgroup]

    def value(self, depth: int = 0):
        if depth > DEEPEST:
            raise Damaged("nested too deeply")
        kind, text = self.token()
        if kind == "number":
            return self._number(text)
        if kind == "name":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text).decode("latin-1"))
        if kind == "open" and text == b"(":
            return self._literal()
        if kind == "open" and text == b"<":
            end = self.data.find(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at : end if end >= 0 else len(self.data)])
            self.at = end + 1 if end >= 0 else len(self.data)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if text == b"[":
            out = []
            while True:
                item = self._inner(depth)
                if item is StopIteration:
                    return out
                out.append(item)
        if text == b"<<":
            entries: dict = {}
            while True:
                key = self._inner(depth)
                if key is StopIteration:
                    return entries
                if not isinstance(key, Name):
                    continue
                value = self._inner(depth)
                if value is StopIteration:
                    return entries
                entries.setdefault(str(key), value)
        if kind == "word":
            return {b"true": True, b"false": False}.get(text)
        raise Damaged("unexpected token")

    def _inner(self, depth: int):
        """The next value inside a container, or StopIteration at its end."""
        m = TOKEN.match(self.data, self.at)
        if not m:
            return StopIteration
        if m["open"] in (b"]", b">>"):
            self.at = m.end()
            return StopIteration
        if m["word"] in (b"endobj", b"stream", b"endstream"):
            return StopIteration
        return self.value(depth + 1)

    def _number(self, text: bytes):
        sign = -1 if text.startswith(b"-") else 1
        body = text.lstrip(b"+-")
        if b"." in body:
            return sign * float(body if body != b"." else b"0")
        if sign == 1 and (m := REFERENCE.match(self.data, self.at)):
            self.at = m.end()
            return Ref(int(body[-18:]), int(m[1][-18:]))
        if len(body) > 18:  # more than 64 bits hold, perhaps: a real, and infinite from 310 digits on
            return sign * float(body)
        return sign * int(body)

    def _literal(self) -> bytes:
        out, depth, data = bytearray(), 1, self.data
        while self.at < len(data):
            c = data[self.at]
            self.at += 1
            if c == 40:
                depth += 1
            elif c == 41:
                depth -= 1
                if not depth:
                    break
            elif c == 92 and self.at < len(data):
                e = data[self.at]
                if m := re.compile(rb"[0-7]{1,3}").match(data, self.at):
                    out.append(int(m[0], 8) & 255)
                    self.at = m.end()
                    continue
                self.at += 1
                if e == 13:
                    self.at += data[self.at : self.at + 1] == b"\n"
                elif e != 10:
                    out += ESCAPES.get(e, bytes([e]))
                continue
            elif c == 13:
                self.at += data[self.at : self.at + 1] == b"\n"
                c = 10
            out.append(c)
        return bytes(out)


class File:
    """A document file: objects by number, newest definition first; rebuilt by a sweep where its tables are damaged."""

    def __init__(self, data: bytes):
        if b"%PDF" not in data[:1024]:
            raise Damaged("not a document of this kind")
        self.data, self.places, self.trailer, self.cache, self.repaired, self.open, self.key = data, {}, {}, {}, False, set(), None
        self.decoded, self.produced = Store(DECODED_MOST), 0
        try:
            self._tables()
        except (Damaged, ValueError, IndexError, TypeError, FilterError):
            self.places, self.trailer = {}, {}
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            self._repair()
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            raise Damaged("no catalogue")
        self.status = self.unlock(b"") if "Encrypt" in self.trailer else 1

    # -- encryption

    def unlock(self, password: bytes) -> int:
        """Status bits: 1 none needed, 2 user, 4 owner; 0 leaves the file locked. Tables made before are read anew."""
        self.key = None
        entries = self.get(self.trailer.get("Encrypt"))
        if not isinstance(entries, dict) or self.get(entries.get("Filter")) != "Standard":
            return 0
        plain = {k: self.get(v) for k, v in entries.items()}
        ids = self.get(self.trailer.get("ID"))
        first = self.get(ids[0]) if isinstance(ids, list) and ids else b""
        filters = {k: self.get(v) for k, v in (plain.get("CF") or {}).items()}
        method = lambda use: str(self.get((filters.get(str(plain.get(use))) or {}).get("CFM"))) if plain.get("V", 0) >= 4 else "V2"
        try:
            status, self.key = crypt.authenticate(password, plain, first if isinstance(first, bytes) else b"")
        except (KeyError, TypeError, IndexError):
            return 0
        self.methods = {"StmF": method("StmF"), "StrF": method("StrF")}
        self.open_metadata = plain.get("EncryptMetadata") is False
        self.cache = {}
        self.decoded.clear()
        return status

    def _decrypted(self, value, number: int, generation: int):
        if isinstance(value, bytes):
            return self._plain(value, "StrF", number, generation)
        if isinstance(value, list):
            return [self._decrypted(v, number, generation) for v in value]
        if isinstance(value, dict):
            return {k: self._decrypted(v, number, generation) for k, v in value.items()}
        if isinstance(value, Stream) and value.entries.get("Type") != "XRef":
            if value.entries.get("Type") == "Metadata" and self.open_metadata:
                return value
            return Stream(self._decrypted(value.entries, number, generation), self._plain(value.raw, "StmF", number, generation))
        return value

    def _plain(self, data: bytes, use: str, number: int, generation: int) -> bytes:
        method = self.methods[use]
        if method == "AESV3":
            return crypt.cbc_decrypt(self.key, data)
        if method == "AESV2":
            return crypt.cbc_decrypt(crypt.object_key(self.key, number, generation, True), data)
        return crypt.rc4(crypt.object_key(self.key, number, generation, False), data) if method == "V2" and data else data

    # -- cross references

    def _tables(self) -> None:
        tail = self.data[-2048:]
        found = tail.rfind(b"startxref")
        if found < 0:
            raise Damaged("no startxref")
        at, seen = Reader(tail, found + 9).value(), set()
        while isinstance(at, int) and at not in seen:
            seen.add(at)
            trailer = self._section(at)
            for key, value in trailer.items():
                self.trailer.setdefault(key, value)
            at = trailer.get("Prev")

    def _section(self, at: int) -> dict:
        if at < 0 or at >= len(self.data):
            raise Damaged("bad offset")
        reader = Reader(self.data, at)
        if not re.compile(rb"[\0\t\n\f\r ]*xref").match(self.data, at):
            return self._stream_section(at)
        reader.token()
        free = set()
        while True:
            kind, text = reader.token()
            if text == b"trailer":
                break
            if kind != "number":
                raise Damaged("bad table")
            first, count = int(text), reader.value()
            for k in range(count):
                offset, generation = reader.value(), reader.value()
                _, state = reader.token()
                if first + k in self.places or first + k > OBJECT_MOST:
                    continue
                if state == b"n":
                    self.places[first + k] = ("at", offset, generation)
                else:
                    self.places[first + k] = None  # a deletion hides older definitions
                    free.add(first + k)
        trailer = reader.value()
        if isinstance(trailer.get("XRefStm"), int):
            for number in free:
                del self.places[number]
            self._stream_section(trailer["XRefStm"])
            for number in free:
                self.places.setdefault(number, None)
        return trailer

    def _stream_section(self, at: int) -> dict:
        _, stream = self._object(at)
        if not isinstance(stream, Stream) or stream.entries.get("Type") != "XRef":
            raise Damaged("no cross-reference stream")
        widths, size = stream.entries["W"], stream.entries.get("Size", 0)
        index, data, row = stream.entries.get("Index") or [0, size], self.content(stream), 0
        for first, count in zip(index[::2], index[1::2], strict=False):
            for number in range(first, first + count):
                fields = []
                for k, width in enumerate(widths[:3]):
                    fields.append(int.from_bytes(data[row : row + width], "big") if width else (1 if k == 0 else 0))
                    row += width
                if row > len(data):
                    return stream.entries
                if number not in self.places and number <= OBJECT_MOST:
                    self.places[number] = {1: ("at", fields[1], fields[2]), 2: ("in", fields[1], fields[2])}.get(fields[0])
        return stream.entries

    def _repair(self) -> None:
        """Sweep for definitions; the last of each number counts."""
        self.places, self.cache, self.repaired = {}, {}, True
        trailer: dict = {}
        for m in HEADER.finditer(self.data):
            if int(m[1]) <= OBJECT_MOST and (not m.start() or self.data[m.start() - 1 : m.start()] not in b"0123456789"):
                self.places[int(m[1])] = ("at", m.start(), int(m[2]))
        for m in re.finditer(rb"trailer", self.data):
            try:
                entries = Reader(self.data, m.end()).value()
            except (Damaged, ValueError):
                continue
            if isinstance(entries, dict):
                trailer |= {k: v for k, v in entries.items() if k in ("Root", "Info", "Encrypt", "ID")}
        for number in list(self.places):
            stream = self.get(Ref(number, 0))
            if isinstance(stream, Stream) and stream.entries.get("Type") == "ObjStm":
                for k, inner in enumerate(self._pairs(stream)):
                    self.places.setdefault(inner[0], ("in", number, k))
        if not isinstance(self.get(trailer.get("Root")), dict):
            for number in sorted(self.places, reverse=True):
                value = self.get(Ref(number, 0))
                if isinstance(value, dict) and value.get("Type") == "Catalog":
                    trailer["Root"] = Ref(number, 0)
                    break
        self.trailer = trailer

    # -- objects

    def _object(self, at: int):
        m = re.compile(rb"[\0\t\n\f\r ]*(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj").match(self.data, at)
        if not m:
            raise Damaged("no object here")
        reader = Reader(self.data, m.end())
        value = reader.value()
        if isinstance(value, dict) and (s := re.compile(rb"[\0\t\n\f\r ]*stream(\r\n|\n|\r)?").match(self.data, reader.at)):
            start, size = s.end(), value.get("Length")
            size = self.get(size) if isinstance(size, Ref) else size
            if not isinstance(size, int) or size < 0 or not re.compile(rb"[\0\t\n\f\r ]*endstream").match(self.data, start + size):
                end = self.data.find(b"endstream", start)
                end = len(self.data) if end < 0 else end
                size = end - start
                body = self.data[start:end]
                size -= 2 if body.endswith(b"\r\n") else body.endswith((b"\n", b"\r"))
            value = Stream(value, self.data[start : start + size])
        return int(m[1]), value

    def _pairs(self, stream: Stream) -> list[tuple[int, int]]:
        try:
            reader = Reader(self.content(stream))
            return [(reader.value(), reader.value()) for _ in range(min(int(self.get(stream.entries.get("N")) or 0), 1 << 20))]
        except (Damaged, ValueError, TypeError):
            return []

    def get(self, value):
        """The value behind references; null where there is none."""
        for _ in range(HOPS):
            if not isinstance(value, Ref):
                return value
            value = self._load(value.number)
        return None

    def _load(self, number: int):
        if number in self.cache:
            return self.cache[number]
        place = self.places.get(number)
        if place is None or number in self.open:
            return None
        self.open.add(number)
        try:
            if place[0] == "at":
                found, value = self._object(place[1])
                if found != number:
                    raise Damaged("another object is here")
                lock = self.trailer.get("Encrypt")
                if self.key is not None and not (isinstance(lock, Ref) and lock.number == number):
                    value = self._decrypted(value, number, place[2])
            else:
                holder = self._load(place[1])
                pairs = self._pairs(holder)
                k = next((k for k, p in enumerate(pairs) if p[0] == number), None)
                value = None if k is None else Reader(self.content(holder), int(self.get(holder.entries.get("First")) or 0) + pairs[k][1]).value()
        except (Damaged, ValueError, TypeError, AttributeError):
            self.open.discard(number)
            if not self.repaired and place[0] == "at":
                root = self.trailer.get("Root")
                self._repair()
                self.trailer.setdefault("Root", root)
                return self._load(number)
            value = None
        self.open.discard(number)
        self.cache[number] = value
        return value

    def stages(self, stream: Stream) -> list[tuple[str, dict]]:
        """The filters of a stream, each with its parameters."""
        listed = lambda v: v if isinstance(v, list) else [v] if v is not None else []
        names = listed(self.get(stream.entries.get("Filter", stream.entries.get("F"))))
        given = listed(self.get(stream.entries.get("DecodeParms", stream.entries.get("DP"))))
        stages = []
        for k, name in enumerate(names):
            entries = self.get(given[k]) if k < len(given) else None
            stages.append((str(self.get(name)), {a: self.get(b) for a, b in entries.items()} if isinstance(entries, dict) else {}))
        return stages

    def content(self, stream: Stream) -> bytes:
        """A stream's decoded data; what cannot be decoded is empty.  produced counts all bytes that filters gave."""
        return self.decoded.get(id(stream), lambda: self._content(stream), lambda found: len(found[1]) + 64)[1]

    def _content(self, stream: Stream) -> tuple[Stream, bytes]:
        try:
            made = decoded(stream.raw, self.stages(stream))
        except FilterError:
            made = b""
        self.produced += len(made)
        return stream, made  # the stream stays, so that no other one takes its place in memory

    def content_until(self, stream: Stream, stage: int) -> tuple[bytes, dict]:
        """A stream's data before a filter, and that filter's parameters: for the codecs of images."""
        stages = self.stages(stream)
        try:
            return decoded(stream.raw, stages[:stage]), stages[stage][1] if stage < len(stages) else {}
        except FilterError:
            return b"", {}


def text_string(raw: bytes) -> str:
    """UTF-16 or UTF-8 by their marks, else the document encoding (which is Latin-1 but for its control range)."""
    if raw.startswith(b"\xfe\xff"):
        return raw[2 : len(raw) - len(raw) % 2].decode("utf-16-be", "replace")
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("latin-1").translate(DOCUMENT)


#: Characters of the document encoding that differ from Latin-1.
DOCUMENT = {0x18 + k: c for k, c in enumerate("˘ˇˆ˙˝˛˚˜")} | {0x80 + k: c for k, c in enumerate("•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž�€")} | {0x7F: "�", 0xAD: "�"}
