"""Pages, labels, outline and links of one document file."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from .fonts import number as finite
from .objects import File, Name, Ref, Stream, text_string

PAGES_MOST, DEEPEST, LINKS_MOST, ENTRIES_MOST = 65_536, 64, 65_536, 262_144
DEFAULT_BOX = (0.0, 0.0, 612.0, 792.0)
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})")
#: Hidden, not to be shown, invisible: flags of annotations that are not drawn.
UNSEEN, PARENTS_MOST = 1 | 2 | 32, 32


def percent_decoded(text: str) -> bytes:
    """Escapes that are not two hexadecimal digits stay."""
    return ESCAPE.sub(lambda m: bytes([int(m[1], 16)]), text.encode("utf-8", "surrogateescape"))


def rectangle(file: File, value) -> tuple[float, ...] | None:
    value = file.get(value)
    if not isinstance(value, list) or len(value) < 4:
        return None
    sides = [finite(file.get(v)) for v in value[:4]]
    if None in sides:
        return None
    x0, y0, x1, y1 = sides
    return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)


class Page:
    def __init__(self, file: File, number: int, entries: dict, inherited: dict):
        own = {k: v for k, v in entries.items() if file.get(v) is not None}
        both = inherited | own
        media = rectangle(file, both.get("MediaBox"))
        media = media if media and media[0] < media[2] and media[1] < media[3] else DEFAULT_BOX
        crop = rectangle(file, both.get("CropBox")) or media
        cut = (max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3]))
        self.box = cut if cut[0] < cut[2] and cut[1] < cut[3] else media
        turn = file.get(both.get("Rotate"))
        turn = int(finite(turn) or 0)
        self.resources = both.get("Resources")
        self.number, self.entries, self.turn = number, entries, (turn % 360 + 45) // 90 * 90 % 360
        w, h = self.box[2] - self.box[0], self.box[3] - self.box[1]
        self.size = (h, w) if self.turn in (90, 270) else (w, h)

    def top_left(self, x: float, y: float) -> tuple[float, float]:
        u, v = x - self.box[0], y - self.box[1]
        w, h = self.box[2] - self.box[0], self.box[3] - self.box[1]
        return {0: (u, h - v), 90: (v, u), 180: (w - u, v), 270: (h - v, w - u)}[self.turn]


def _coordinate(text: str) -> float | None:
    try:
        return finite(float(text))
    except ValueError:
        return None


class Document:
    def __init__(self, data: bytes, password: bytes | None = None):
        self.file = File(data)
        if password is not None and "Encrypt" in self.file.trailer:
            self.file.status |= self.file.unlock(password)
        self.root = self.file.get(self.file.trailer["Root"])
        self.pages: list[Page] = []
        self.page_of: dict[int, int] = {}
        self._walk(self.root.get("Pages"), {}, 0, set())

    def _walk(self, node, inherited: dict, depth: int, seen: set) -> None:
        entries, number = self.file.get(node), node.number if isinstance(node, Ref) else None
        if not isinstance(entries, dict) or depth > DEEPEST or number in seen or len(self.pages) >= PAGES_MOST:
            return
        if number is not None:
            seen.add(number)
        kids, kind = self.file.get(entries.get("Kids")), self.file.get(entries.get("Type"))
        if kind == "Page" or not isinstance(kids, list) and kind != "Pages":
            if number is not None:
                self.page_of[number] = len(self.pages)
            self.pages.append(Page(self.file, len(self.pages), entries, inherited))
            return
        passed = inherited | {k: entries[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if self.file.get(entries.get(k)) is not None}
        for kid in kids if isinstance(kids, list) else ():
            self._walk(kid, passed, depth + 1, seen)

    def _tree(self, node, key: str, depth: int = 0, seen: set | None = None, out: dict | None = None) -> dict:
        """Pairs of a name or number tree; the first of a key counts."""
        seen, out = set() if seen is None else seen, {} if out is None else out
        entries, number = self.file.get(node), node.number if isinstance(node, Ref) else None
        if not isinstance(entries, dict) or depth > DEEPEST or number in seen or len(seen) > 1 << 16:
            return out
        if number is not None:
            seen.add(number)
        pairs = self.file.get(entries.get(key))
        for k, v in zip(pairs[::2], pairs[1::2], strict=False) if isinstance(pairs, list) else ():
            k = self.file.get(k)
            # a key of the wrong kind costs its pair only
            if isinstance(k, bytes if key == "Names" else int) and not isinstance(k, bool) and len(out) < ENTRIES_MOST:
                out.setdefault(k, v)
        kids = self.file.get(entries.get("Kids"))
        for kid in kids if isinstance(kids, list) else ():
            self._tree(kid, key, depth + 1, seen, out)
        return out

    def label_ranges(self) -> list[tuple[int, str, str, int]]:
        out = []
        for first, value in sorted(self._tree(self.root.get("PageLabels"), "Nums").items()):
            entries = self.file.get(value)
            if isinstance(entries, dict) and 0 <= first < 65_536:
                style, prefix, start = (self.file.get(entries.get(k)) for k in ("S", "P", "St"))
                start = start if isinstance(start, int) and not isinstance(start, bool) else 1
                out.append((first, str(style) if style in ("D", "R", "r", "A", "a") else "", text_string(prefix) if isinstance(prefix, bytes) else "", max(-(1 << 62), min(1 << 62, start))))
        return out

    def authenticate(self, password: bytes) -> int:
        """0 fails, 1 none is needed, 2 the user password, 4 the owner password, or the sum of both."""
        return self.file.unlock(password) if "Encrypt" in self.file.trailer else 1

    def names(self) -> dict:
        if not hasattr(self, "_names"):
            names = self.file.get(self.root.get("Names"))
            self._names = self._tree(names.get("Dests") if isinstance(names, dict) else None, "Names")
        return self._names

    def destination(self, value) -> tuple[int, float | None, float | None]:
        """Page (-1 if none), and the point in page space, of a destination in any form."""
        for _ in range(8):
            value = self.file.get(value)
            if isinstance(value, Name | bytes):
                old = self.file.get(self.root.get("Dests"))
                key = value.decode("latin-1") if isinstance(value, bytes) else str(value)
                value = old[key] if isinstance(old, dict) and key in old else self.names().get(key.encode("latin-1", "replace"))
            elif isinstance(value, dict):
                value = value.get("D")
            else:
                break
        if not isinstance(value, list) or not value:
            return -1, None, None
        page = self.page_of.get(value[0].number, -1) if isinstance(value[0], Ref) else value[0] if isinstance(value[0], int) else -1
        if not 0 <= page < len(self.pages):
            return -1, None, None
        kind, rest = self.file.get(value[1]) if len(value) > 1 else None, [self.file.get(v) for v in value[2:]]
        at = lambda k: finite(rest[k]) if k < len(rest) else None
        x, y = {"XYZ": (at(0), at(1)), "FitH": (None, at(0)), "FitBH": (None, at(0)), "FitV": (at(0), None), "FitBV": (at(0), None), "FitR": (at(0), at(3))}.get(str(kind), (None, None))
        if x is None and y is None:
            return page, None, None
        u, v = self.pages[page].top_left(x if x is not None else math.nan, y if y is not None else math.nan)
        return page, None if math.isnan(u) else u, None if math.isnan(v) else v

    def fragment(self, uri: str) -> tuple[int, float | None, float | None]:
        """What `#page=N&zoom=z,x,y` or `#nameddest=NAME` points to; its point is measured from the top left already."""
        if uri.startswith("#nameddest="):
            return self.destination(percent_decoded(uri.removeprefix("#nameddest=")))
        page, x, y = -1, None, None
        for part in uri[1:].split("&") if uri.startswith("#") else ():
            name, _, value = part.partition("=")
            if name == "page" and re.fullmatch(r"[+-]?\d{1,18}", value) and 1 <= int(value) <= len(self.pages):
                page = int(value) - 1
            elif name == "zoom":
                x, y = (_coordinate(v) for v in (value.split(",") + ["", "", ""])[1:3])
        return (page, x, y) if page >= 0 else (-1, None, None)

    def appearances(self, page: Page) -> Iterator[tuple[Stream, tuple[float, ...]]]:
        """(stream, matrix into page space) of every annotation of a page that is drawn."""
        found, n = self.file.get(page.entries.get("Annots")), 0
        for annotation in found if isinstance(found, list) else ():
            entries = self.file.get(annotation)
            made = self._appearance(entries) if isinstance(entries, dict) else None
            if made and n < LINKS_MOST:
                n += 1
                yield made

    def _appearance(self, entries: dict) -> tuple[Stream, tuple[float, ...]] | None:
        get = lambda k, of=entries: self.file.get(of.get(k))
        flags, kind, looks = get("F"), get("Subtype"), get("AP")
        if isinstance(flags, int) and flags & UNSEEN or kind in ("Link", "Popup") or kind == "Widget" and not self._is_field(entries) or not isinstance(looks, dict):
            return None
        form = get("N", looks)
        if isinstance(form, dict):
            form = get(str(get("AS")), form) if isinstance(get("AS"), Name) else None
        if not isinstance(form, Stream):
            return None
        place, box = rectangle(self.file, entries.get("Rect")), rectangle(self.file, form.entries.get("BBox"))
        given = get("Matrix", form.entries)
        given = [finite(self.file.get(v)) for v in given] if isinstance(given, list) else []
        m = given if len(given) == 6 and None not in given else [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
        if place is None or box is None:
            return None
        corners = [(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]) for x in (box[0], box[2]) for y in (box[1], box[3])]
        x0, x1 = min(c[0] for c in corners), max(c[0] for c in corners)
        y0, y1 = min(c[1] for c in corners), max(c[1] for c in corners)
        if not (x0 < x1 and y0 < y1):
            return None
        sx, sy = (place[2] - place[0]) / (x1 - x0), (place[3] - place[1]) / (y1 - y0)
        made = (sx, 0.0, 0.0, sy, place[0] - x0 * sx, place[1] - y0 * sy)
        return (form, made) if all(finite(v) is not None for v in made) else None

    def _is_field(self, entries: dict) -> bool:
        for _ in range(PARENTS_MOST):
            if isinstance(self.file.get(entries.get("FT")), Name):
                return True
            entries = self.file.get(entries.get("Parent"))
            if not isinstance(entries, dict):
                return False
        return False

    def _target(self, entries: dict) -> tuple[str, int, float | None, float | None]:
        if "Dest" in entries:
            return ("", *self.destination(entries["Dest"]))
        action = self.file.get(entries.get("A"))
        if isinstance(action, dict):
            kind = self.file.get(action.get("S"))
            if kind == "GoTo":
                return ("", *self.destination(action.get("D")))
            target = self.file.get(action.get("URI" if kind == "URI" else "F"))
            target = self.file.get(target.get("F")) if isinstance(target, dict) else target
            if kind in ("URI", "GoToR", "Launch") and isinstance(target, bytes):
                uri = text_string(target)
                if SCHEME.match(uri):
                    return uri, -1, None, None
                if kind == "URI":
                    return ("", *self.fragment(uri))
                return "file:" + uri, -1, None, None
        return "", -1, None, None

    def links(self) -> list[tuple]:
        """(page, ord, uri, target page, x, y, and the rectangle from the top left) of every link that leads somewhere."""
        out = []
        for page in self.pages:
            found = self.file.get(page.entries.get("Annots"))
            n = 0
            for annotation in found if isinstance(found, list) else ():
                if n >= LINKS_MOST:
                    break
                entries = self.file.get(annotation)
                if not isinstance(entries, dict) or self.file.get(entries.get("Subtype")) != "Link":
                    continue
                box = rectangle(self.file, entries.get("Rect"))
                uri, target, x, y = self._target(entries)
                if box is None or target < 0 and not uri:
                    continue
                (a, b), (c, d) = page.top_left(box[0], box[1]), page.top_left(box[2], box[3])
                out.append((page.number, n, uri, target, x, y, min(a, c), min(b, d), max(a, c), max(b, d)))
                n += 1
        return out

    def outline(self) -> list[tuple]:
        """(ord, depth, title, uri, page, x, y) in reading order."""
        out: list[tuple] = []
        seen: set[int] = set()
        top = self.file.get(self.root.get("Outlines"))
        stack = [(top.get("First"), 0)] if isinstance(top, dict) else []
        while stack and len(out) < PAGES_MOST:
            node, depth = stack.pop()
            entries = self.file.get(node)
            if not isinstance(entries, dict) or not isinstance(node, Ref) or node.number in seen or depth > DEEPEST:
                continue
            seen.add(node.number)
            title = self.file.get(entries.get("Title"))
            out.append((len(out), depth, text_string(title) if isinstance(title, bytes) else "", *self._target(entries)))
            stack += [(entries.get("Next"), depth), (entries.get("First"), depth + 1)]
        return out
