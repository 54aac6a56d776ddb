"""What a page draws: an ordered list of drawing operations, and the characters that it shows.

Coordinates are measured from the page's top left, at one unit a point.  A page is one fold over its operations, so a
page is the unit of work; its rows are ordinary table rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from . import colours, fonts, formulas
from .content import contents, operations
from .document import Document, Page
from .objects import Name, Stream

WORK_MOST, SAVES_MOST, FORMS_MOST, RUN_MOST, CHARS_MOST, DASHES_MOST, TILES_MOST = 1 << 22, 256, 12, 1 << 16, 1 << 20, 32, 1 << 16
Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: What a ligature shows.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
BLENDS = frozenset("Normal Multiply Screen Overlay Darken Lighten ColorDodge ColorBurn HardLight SoftLight Difference Exclusion Hue Saturation Color Luminosity".split())


def times(m: Matrix, n: Matrix) -> Matrix:
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o


def finite(m) -> bool:
    return all(math.isfinite(v) and abs(v) < 3.4e38 for v in m)


def apply(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def page_matrix(page: Page) -> Matrix:
    x0, y0, x1, y1 = page.box
    return {0: (1.0, 0.0, 0.0, -1.0, -x0, y1), 90: (0.0, 1.0, 1.0, 0.0, -y0, -x0), 180: (-1.0, 0.0, 0.0, 1.0, x1, -y0), 270: (0.0, -1.0, -1.0, 0.0, y1, x1)}[page.turn]


def box_of(m: Matrix, box) -> tuple[float, float, float, float]:
    corners = [apply(m, x, y) for x in (box[0], box[2]) for y in (box[1], box[3])]
    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
    return min(xs), min(ys), max(xs), max(ys)


@dataclass(frozen=True)
class Paint:
    space: colours.Space = colours.GRAY
    rgb: tuple[int, int, int] | None = (0, 0, 0)
    pattern: str | None = None


@dataclass
class State:
    ctm: Matrix
    fill: Paint = Paint()
    stroke: Paint = Paint()
    fill_alpha: float = 1.0
    stroke_alpha: float = 1.0
    blend: str = "Normal"
    width: float = 1.0
    cap: int = 0
    join: int = 0
    miter: float = 10.0
    dash: tuple = ()
    phase: float = 0.0
    clips: int = 0
    mask: dict | None = None
    mask_ctm: Matrix = IDENTITY
    font: fonts.Font | None = None
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    scale: float = 1.0
    lead: float = 0.0
    rise: float = 0.0
    mode: int = 0


@dataclass
class Output:
    ops: list[dict] = field(default_factory=list)
    chars: list[dict] = field(default_factory=list)
    work: int = 0
    level: int = 0


class Interpreter:
    """Runs one stream and what it calls.  Streams called share the output and its budget of work."""

    def __init__(self, doc: Document, page: Page, resources, ctm: Matrix, out: Output, depth: int = 0, active: frozenset = frozenset(), known: dict | None = None, draw: bool = True):
        self.doc, self.page, self.get, self.out, self.depth, self.active, self.draw = doc, page, doc.file.get, out, depth, active, draw
        resources = self.get(resources)
        self.resources = resources if isinstance(resources, dict) else {}
        self.known = known if known is not None else {}
        self.state, self.saved, self.skipped = State(ctm), [], 0
        self.path: list[tuple] = []
        self.at = self.start = None
        self.pending: str | None = None
        self.text = self.line = IDENTITY
        self.in_text = False
        self.text_clip = False
        self.uncoloured = False

    # output

    def emit(self, op: str, box=None, **more) -> None:
        if self.draw:
            x0, y0, x1, y1 = box if box is not None else (None,) * 4
            self.out.ops.append({"page": self.page.number, "seq": len(self.out.ops), "op": op, "level": self.out.level, "x0": x0, "y0": y0, "x1": x1, "y1": y1} | more)

    def painted(self, fill: bool) -> dict:
        s = self.state
        paint, alpha = (s.fill, s.fill_alpha) if fill else (s.stroke, s.stroke_alpha)
        return self._shading_of(paint) | {"red": paint.rgb[0] if paint.rgb else None, "green": paint.rgb[1] if paint.rgb else None, "blue": paint.rgb[2] if paint.rgb else None, "pattern": paint.pattern, "alpha": alpha, "blend": s.blend}

    def _shading_of(self, paint: Paint) -> dict:
        """What a painter needs for a pattern that is a shading."""
        found = self.named("Pattern", paint.pattern) if paint.pattern is not None and self.draw else None
        entries = found.entries if isinstance(found, Stream) else found
        if not isinstance(entries, dict) or self.get(entries.get("PatternType")) != 2:
            return {}
        return {"_shading": entries.get("Shading"), "_pattern_matrix": list(times(self._matrix(self.get(entries.get("Matrix"))), page_matrix(self.page)))}

    def marks(self, fill: bool) -> bool:
        paint = self.state.fill if fill else self.state.stroke
        return paint.rgb is not None or paint.pattern is not None

    def called(self, resources, ctm: Matrix, key) -> Interpreter:
        made = Interpreter(self.doc, self.page, resources if resources is not None else self.resources, ctm, self.out, self.depth + 1, self.active | {key}, self.known, self.draw)
        made.state = replace(self.state, ctm=ctm, clips=0)
        made.uncoloured = self.uncoloured
        return made

    # running

    def run(self, data: bytes) -> None:
        for name, args in operations(data):
            self.out.work += 1
            if self.out.work > WORK_MOST:
                break
            handler = HANDLERS.get(name)
            if handler is None or self.uncoloured and name in COLOURING:
                continue
            try:
                handler(self, args)
            except (IndexError, TypeError, KeyError, ValueError, OverflowError, AttributeError, ArithmeticError):
                continue  # an operation with wrong operands does nothing
        self.end_text(None)
        while self.saved:
            self.restore([])
        self.pop_clips(0)

    def pop_clips(self, to: int) -> None:
        while self.state.clips > to:
            self.emit("PopClip")
            self.state.clips -= 1

    # state

    def save(self, args) -> None:
        if len(self.saved) >= SAVES_MOST:
            self.skipped += 1
        else:
            self.saved.append(replace(self.state))

    def restore(self, args) -> None:
        if self.skipped:
            self.skipped -= 1
        elif self.saved:
            self.pop_clips(self.saved[-1].clips)
            self.state = self.saved.pop()

    def concat(self, args) -> None:
        made = times(floats(args, 6), self.state.ctm)
        if finite(made):
            self.state.ctm = made

    def dashes(self, args) -> None:
        lengths = [fonts.number(v) for v in self.get(args[0])]
        phase = floats(args[1:], 1)[0]
        if len(lengths) <= DASHES_MOST and None not in lengths and min(lengths, default=0) >= 0 and (not lengths or sum(lengths) > 0):
            self.state.dash, self.state.phase = tuple(lengths), phase

    def graphics_state(self, args) -> None:
        entries = self.get(self.named("ExtGState", args[-1]))
        s = self.state
        for key, value in entries.items():
            value = self.get(value)
            n = fonts.number(value)
            if key == "LW" and n is not None and n >= 0:
                s.width = n
            elif key == "LC" and n in (0, 1, 2):
                s.cap = int(n)
            elif key == "LJ" and n in (0, 1, 2):
                s.join = int(n)
            elif key == "ML" and n is not None and n > 0:
                s.miter = n
            elif key == "D" and isinstance(value, list) and len(value) == 2:
                self.dashes(value)
            elif key == "CA" and n is not None:
                s.stroke_alpha = colours.unit(n)
            elif key == "ca" and n is not None:
                s.fill_alpha = colours.unit(n)
            elif key == "BM":
                found = value if isinstance(value, list) else [value]
                s.blend = next((str(b) for b in map(self.get, found) if str(b) in BLENDS), "Normal")
            elif key == "SMask":
                s.mask, s.mask_ctm = (value if isinstance(value, dict) else None), s.ctm

    def named(self, kind: str, name):
        return self.get((self.get(self.resources.get(kind)) or {}).get(str(name)))

    # paths

    def move(self, args) -> None:
        x, y = floats(args, 2)
        self.at = self.start = (x, y)
        self.path.append(("M", *apply(self.state.ctm, x, y)))

    def lined(self, args) -> None:
        x, y = floats(args, 2)
        self._needs()
        self.at = (x, y)
        self.path.append(("L", *apply(self.state.ctm, x, y)))

    def _needs(self) -> None:
        if self.at is None:
            raise ValueError("no current point")

    def curve(self, *points) -> None:
        self._needs()
        self.at = points[-1]
        self.path.append(("C", *(v for p in points for v in apply(self.state.ctm, *p))))

    def curve_c(self, args) -> None:
        a, b, c, d, e, f = floats(args, 6)
        self.curve((a, b), (c, d), (e, f))

    def curve_v(self, args) -> None:
        c, d, e, f = floats(args, 4)
        self._needs()
        self.curve(self.at, (c, d), (e, f))

    def curve_y(self, args) -> None:
        a, b, e, f = floats(args, 4)
        self.curve((a, b), (e, f), (e, f))

    def close(self, args) -> None:
        if self.at is not None:
            self.path.append(("Z",))
            self.at = self.start

    def rectangle(self, args) -> None:
        x, y, w, h = floats(args, 4)
        corners = [apply(self.state.ctm, *p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
        if not finite([v for p in corners for v in p]):
            return
        self.path += [("M", *corners[0]), *(("L", *p) for p in corners[1:]), ("Z",)]
        self.at = self.start = (x, y)

    def paint(self, fill: str | None, stroke: bool, closes: bool) -> None:
        if closes:
            self.close(None)
        path, m = self.path, self.state.ctm
        unit = math.sqrt(abs(m[0] * m[3] - m[1] * m[2]))
        if self.path:
            if fill and self.marks(True):
                self._drawn(lambda: self.emit("FillPath", path_box(self.path), path_data=written(self.path), even_odd=fill == "f*", **self.painted(True), _path=list(path)), True)
            if stroke and self.marks(False):
                s = self.state
                self._drawn(lambda: self.emit("StrokePath", path_box(self.path), path_data=written(self.path), line_width=s.width, cap=s.cap, join=s.join, miter=s.miter, dash=list(s.dash), phase=s.phase, **self.painted(False), _path=list(path), _unit=unit), False)
        if self.pending:
            self.emit("ClipPath", path_box(self.path) if self.path else (0.0,) * 4, path_data=written(self.path), even_odd=self.pending == "W*", _path=list(path))
            self.state.clips += 1
        self.path, self.at, self.start, self.pending = [], None, None, None

    def _drawn(self, draw, fill: bool | None) -> None:
        """Draws under the soft mask of the state, with the tile of its pattern."""
        mask = self.state.mask
        masked = mask is not None and self._mask(mask)
        paint = self.state.fill if fill else self.state.stroke
        if fill is not None and paint.pattern is not None:
            self._tile(paint)
        draw()
        if masked:
            self.emit("PopMask")

    def _mask(self, mask: dict) -> bool:
        group = self.get(mask.get("G"))
        if not isinstance(group, Stream) or self.depth >= FORMS_MOST or id(group) in self.active:
            return False
        kind = str(self.get(mask.get("S")))
        self.emit("BeginMask", name=kind, **self._mask_rules(mask, group))
        self.out.level += 1
        held, self.state.mask = self.state.mask, None
        self._form(group, self.state.mask_ctm, fresh=True)
        self.state.mask = held
        self.out.level -= 1
        self.emit("EndMask")
        return True

    def _mask_rules(self, mask: dict, group: Stream) -> dict:
        """The colour behind a luminosity group, and what turns its values into those of the mask."""
        if not self.draw:
            return {}
        about = self.get(group.entries.get("Group"))
        space = colours.space(self.doc.file, about.get("CS")) if isinstance(about, dict) else None
        given, turn = self.get(mask.get("BC")), self.get(mask.get("TR"))
        numbers = [fonts.number(self.get(v)) for v in given] if isinstance(given, list) else []
        behind = space.rgb(numbers) if space and len(numbers) == space.size and None not in numbers else (0, 0, 0)
        table = None
        if turn is not None and turn != "Identity":
            try:
                rule = formulas.parsed(self.doc.file, turn)
                table = [colours.unit(rule([k / 255])[0]) for k in range(256)]
            except (formulas.NoFunction, IndexError):
                pass
        return {"_behind": behind or (0, 0, 0), "_turn": table}

    def _tile(self, paint: Paint) -> None:
        cell = self.named("Pattern", paint.pattern)
        if not isinstance(cell, Stream) or self.depth >= FORMS_MOST or id(cell) in self.active:
            return
        get = lambda k: self.get(cell.entries.get(k))
        matrix = self._matrix(get("Matrix"))
        steps = [fonts.number(get(k)) for k in ("XStep", "YStep")]
        box = [fonts.number(self.get(v)) for v in get("BBox")]
        if get("PatternType") != 1 or None in steps or 0 in steps or None in box:
            return
        base = times(matrix, page_matrix(self.page))
        self.emit("BeginTile", box_of(base, box), name=paint.pattern, matrix=list(base), width=None, steps=[abs(s) for s in steps], _box=box)
        self.out.level += 1
        inner = self.called(get("Resources"), base, id(cell))
        inner.state = State(base)
        if get("PaintType") == 2:
            inner.state.fill = inner.state.stroke = Paint(colours.GRAY, paint.rgb)
            inner.uncoloured = True
        inner.run(self.doc.file.content(cell))
        self.out.level -= 1
        self.emit("EndTile")

    # colours

    def set_space(self, args, fill: bool) -> None:
        name = args[-1]
        found = colours.space(self.doc.file, name) if name in ("DeviceGray", "DeviceRGB", "DeviceCMYK", "Pattern") else None
        found = found or colours.space(self.doc.file, self.named("ColorSpace", name)) or colours.GRAY
        self._set(fill, Paint(found, found.rgb(found.first) if found.first else None))

    def set_device(self, args, fill: bool, space: colours.Space) -> None:
        self._set(fill, Paint(space, space.rgb(floats(args, space.size))))

    def set_colour(self, args, fill: bool) -> None:
        paint = self.state.fill if fill else self.state.stroke
        space = paint.space
        if space.name == "Pattern":
            if args and isinstance(args[-1], Name):
                below = floats(args[:-1], space.base.size) if space.base and len(args) > 1 else None
                pattern = self.named("Pattern", args[-1])
                if pattern is not None:
                    self._set(fill, Paint(space, space.base.rgb(below) if below else None, str(args[-1])))
            return
        self._set(fill, Paint(space, space.rgb(floats(args, space.size))))

    def _set(self, fill: bool, paint: Paint) -> None:
        if fill:
            self.state.fill = paint
        else:
            self.state.stroke = paint

    # forms, images, shadings

    def _matrix(self, value) -> Matrix:
        found = [fonts.number(self.get(v)) for v in value] if isinstance(value, list) else []
        return tuple(found) if len(found) == 6 and None not in found else IDENTITY

    def invoke(self, args) -> None:
        found = self.named("XObject", args[-1])
        if not isinstance(found, Stream):
            return
        kind = self.get(found.entries.get("Subtype"))
        if kind == "Image":
            self.image(found, str(args[-1]))
        elif kind == "Form" and self.depth < FORMS_MOST and id(found) not in self.active:
            self._form(found, self.state.ctm)

    def _form(self, form: Stream, ctm: Matrix, fresh: bool = False) -> None:
        get = lambda k: self.get(form.entries.get(k))
        made = times(self._matrix(get("Matrix")), ctm)
        if not finite(made):
            return
        inner = self.called(get("Resources"), made, id(form))
        if fresh:
            inner.state = State(made)
        group = get("Group")
        grouped = isinstance(group, dict) and self.get(group.get("S")) == "Transparency" and not fresh
        box = get("BBox")
        sides = [fonts.number(self.get(v)) for v in box[:4]] if isinstance(box, list) else []
        clip = box_of(made, sides) if len(sides) == 4 and None not in sides else None
        if grouped:
            self.emit("BeginGroup", clip, alpha=self.state.fill_alpha, blend=self.state.blend, isolated=self.get(group.get("I")) is True, knockout=self.get(group.get("K")) is True)
            self.out.level += 1
            inner.state.fill_alpha = inner.state.stroke_alpha = 1.0
            inner.state.blend, inner.state.mask = "Normal", None
        if clip:
            around = [("M", *apply(made, sides[0], sides[1])), *(("L", *apply(made, x, y)) for x, y in ((sides[2], sides[1]), (sides[2], sides[3]), (sides[0], sides[3]))), ("Z",)]
            self.emit("ClipPath", clip, path_data=written(around), even_odd=False, _path=around)
            inner.state.clips = 1
        inner.run(self.doc.file.content(form))
        if grouped:
            self.out.level -= 1
            self.emit("EndGroup")

    def image(self, image: Stream, name: str | None) -> None:
        get = lambda k: self.get(image.entries.get(k))
        width, height = get("Width"), get("Height")
        if not all(isinstance(v, int) and v > 0 for v in (width, height)):
            return
        stencil = get("ImageMask") is True
        if stencil and not self.marks(True):
            return
        draw = lambda: self.emit("FillImageMask" if stencil else "FillImage", box_of(self.state.ctm, (0, 0, 1, 1)), name=name, width=width, height=height, matrix=list(self.state.ctm), _image=image, _spaces=self.get(self.resources.get("ColorSpace")), **(self.painted(True) if stencil else {"alpha": self.state.fill_alpha, "blend": self.state.blend}))
        self._drawn(draw, True if stencil else None)

    def shade(self, args) -> None:
        found = self.named("Shading", args[-1])
        entries = found.entries if isinstance(found, Stream) else found
        kind = self.get(entries.get("ShadingType"))
        if kind in range(1, 8):
            self._drawn(lambda: self.emit("FillShading", None, name=str(args[-1]), width=kind, matrix=list(self.state.ctm), _shading=found, alpha=self.state.fill_alpha, blend=self.state.blend), None)

    # text

    def begin_text(self, args) -> None:
        self.end_text(None)
        self.text = self.line = IDENTITY
        self.in_text = True

    def end_text(self, args) -> None:
        if self.text_clip:
            self.emit("EndTextClip")
            self.state.clips += 1
        self.text_clip = self.in_text = False

    def set_font(self, args) -> None:
        size = floats(args[1:], 1)[0]
        entries = self.named("Font", args[0])
        if isinstance(entries, dict):
            font = self.known.get(id(entries))
            if font is None:
                font = self.known[id(entries)] = fonts.Font(self.doc.file, entries)
            self.state.font, self.state.size = font, size
        elif self.state.font is not None:
            self.state.size = size

    def set_number(self, args, name: str, scale: float = 1.0, low: float = -math.inf) -> None:
        value = floats(args, 1)[0]
        if value >= low:
            setattr(self.state, name, value * scale)

    def set_whole(self, args, name: str, most: int) -> None:
        value = int(floats(args, 1)[0])
        if 0 <= value <= most:
            setattr(self.state, name, value)

    def next_line(self, x: float, y: float) -> None:
        made = times((1.0, 0.0, 0.0, 1.0, x, y), self.line)
        if finite(made):
            self.text = self.line = made

    def moved(self, args, leads: bool = False) -> None:
        x, y = floats(args, 2)
        if leads:
            self.state.lead = -y
        self.next_line(x, y)

    def text_matrix(self, args) -> None:
        made = floats(args, 6)
        if finite(made):
            self.text = self.line = tuple(made)

    def show(self, args) -> None:
        self.run_of([self.get(args[-1])])

    def show_next(self, args) -> None:
        self.next_line(0.0, -self.state.lead)
        self.show(args)

    def show_spaced(self, args) -> None:
        self.state.word, self.state.char = floats(args, 2)
        self.show_next(args)

    def run_of(self, items: list) -> None:
        """Shows strings and kerns as one run: its characters are recorded once, however it is painted."""
        s = self.state
        if s.font is None:
            return
        if s.font.three:
            self._type3(items)
            return
        shown, corners = [], []
        for item in items:
            if isinstance(item, bytes):
                for code, size in s.font.split(item):
                    self.out.work += 1
                    if len(shown) >= RUN_MOST or self.out.work > WORK_MOST:
                        break
                    trm, advance = self._placed(code, size)
                    if finite(trm):
                        shown.append((s.font.text(code, size), trm, advance, code, size))
            elif (kern := fonts.number(item)) is not None:
                self._advance(-kern / 1000 * s.size, s.font.vertical)
        if not shown:
            return
        for text, trm, advance, _, _ in shown:
            corners += self._record(text, trm, advance)
        drawing = [(s.font, code, size, trm) for _, trm, _, code, size in shown] if self.draw else []
        xs, ys = corners[::2], corners[1::2]
        box = (min(xs), min(ys), max(xs), max(ys))
        said = "".join(r[0] for r in shown)
        if s.mode in (0, 2, 4, 6) and self.marks(True):
            self._drawn(lambda: self.emit("FillText", box, text=said, font=s.font.base, size=s.size, **self.painted(True), _glyphs=drawing), True)
        if s.mode in (1, 2, 5, 6) and self.marks(False):
            self._drawn(lambda: self.emit("StrokeText", box, text=said, font=s.font.base, size=s.size, line_width=s.width, **self.painted(False), _glyphs=drawing), False)
        if s.mode == 3:
            self.emit("IgnoreText", box, text=said, font=s.font.base, size=s.size)
        if s.mode >= 4:
            self.emit("ClipText", box, text=said, font=s.font.base, size=s.size, _glyphs=drawing)
            self.text_clip = True

    def _placed(self, code: int, size: int) -> tuple[Matrix, float]:
        """The matrix of a glyph and its advance; the pen moves on."""
        s = self.state
        trm = times(times((s.size * s.scale, 0.0, 0.0, s.size, 0.0, s.rise), self.text), s.ctm)
        advance = s.font.width(code, size)
        space = s.word if size == 1 and code == 32 else 0.0
        if s.font.vertical:
            advance, x, y = s.font.upright(code, size)
            trm = times((1.0, 0.0, 0.0, 1.0, -x, -y), trm)
        self._advance(advance * s.size + s.char + space, s.font.vertical)
        return trm, advance

    def _advance(self, by: float, down: bool) -> None:
        made = times((1.0, 0.0, 0.0, 1.0, 0.0, by) if down else (1.0, 0.0, 0.0, 1.0, by * self.state.scale, 0.0), self.text)
        if finite(made):
            self.text = made

    def _record(self, text: str, trm: Matrix, advance: float) -> list[float]:
        """A row for the glyph's first character and, at its end and without width, for each further one."""
        font, chars = self.state.font, self.out.chars
        at = [apply(trm, x, y) for x, y in ((0, font.ascent), (advance, font.ascent), (0, font.descent), (advance, font.descent), (0, 0), (advance, 0))]
        quad = [v for p in at[:4] for v in p]
        text = "".join(LIGATURES.get(c, c) for c in text)
        about = {"page_no": self.page.number, "size": math.hypot(trm[2], trm[3]), "axis": trm[1] == 0 and trm[2] == 0}
        (ox, oy), (ex, ey) = at[4], at[5]
        if len(chars) < CHARS_MOST:
            chars.append(about | {"seq": len(chars), "rune": ord(text[0]) if text else 0, "quad": quad, "ox": ox, "oy": oy, "ex": ex, "ey": ey})
        up, low = (ex + quad[0] - ox, ey + quad[1] - oy), (ex + quad[4] - ox, ey + quad[5] - oy)
        for c in text[1:]:
            if len(chars) < CHARS_MOST:
                chars.append(about | {"seq": len(chars), "rune": ord(c), "quad": [*up, *up, *low, *low], "ox": ex, "oy": ey, "ex": ex, "ey": ey})
        return quad

    def _type3(self, items: list) -> None:
        """Each glyph is a stream of its own, drawn where it stands."""
        s, font = self.state, self.state.font
        glyph_space = self._matrix(self.get(font.entries.get("FontMatrix")))
        procs = self.get(font.entries.get("CharProcs"))
        for item in items:
            if not isinstance(item, bytes):
                if (kern := fonts.number(item)) is not None:
                    self._advance(-kern / 1000 * s.size, False)
                continue
            for code in item:
                self.out.work += 1
                if self.out.work > WORK_MOST:
                    return
                advance = font.width(code) * 1000 * glyph_space[0]
                trm = times(times((s.size * s.scale, 0.0, 0.0, s.size, 0.0, s.rise), self.text), s.ctm)
                if finite(trm):
                    self._record(font.text(code), trm, advance)
                    proc = self.get(procs.get(font.names.get(code, ""))) if isinstance(procs, dict) else None
                    if s.mode != 3 and isinstance(proc, Stream) and self.depth < FORMS_MOST and id(proc) not in self.active:
                        inner = self.called(self.get(font.entries.get("Resources")), times(glyph_space, trm), id(proc))
                        inner.run(self.doc.file.content(proc))
                self._advance(advance * s.size + s.char + (s.word if code == 32 else 0.0), False)

    def masked_glyph(self, args) -> None:
        self.uncoloured = True


def floats(args: list, n: int) -> list[float]:
    """The first n operands, all finite numbers."""
    found = [fonts.number(v) for v in args[:n]]
    if len(found) < n or None in found:
        raise ValueError("numbers are missing")
    return found


def written(path: list[tuple]) -> str:
    return " ".join(p[0] + "".join(f" {v:.6g}" for v in p[1:]) for p in path)


def path_box(path: list[tuple]) -> tuple[float, float, float, float]:
    xs, ys = [v for p in path for v in p[1::2]], [v for p in path for v in p[2::2]]
    return min(xs), min(ys), max(xs), max(ys)


def _painter(fill: str | None, stroke: bool, closes: bool = False):
    return lambda i, args: i.paint(fill, stroke, closes)


def _clip(rule: str):
    def run(i: Interpreter, args) -> None:
        i.pending = rule

    return run


def _whole(name: str, most: int):
    return lambda i, args: i.set_whole(args, name, most)


def _number(name: str, scale: float = 1.0, low: float = -math.inf):
    return lambda i, args: i.set_number(args, name, scale, low)


def _device(fill: bool, space: colours.Space):
    return lambda i, args: i.set_device(args, fill, space)


HANDLERS = {
    "q": Interpreter.save,
    "Q": Interpreter.restore,
    "cm": Interpreter.concat,
    "w": _number("width", low=0.0),
    "J": _whole("cap", 2),
    "j": _whole("join", 2),
    "M": _number("miter", low=1e-30),
    "d": Interpreter.dashes,
    "gs": Interpreter.graphics_state,
    "m": Interpreter.move,
    "l": Interpreter.lined,
    "c": Interpreter.curve_c,
    "v": Interpreter.curve_v,
    "y": Interpreter.curve_y,
    "h": Interpreter.close,
    "re": Interpreter.rectangle,
    "S": _painter(None, True),
    "s": _painter(None, True, True),
    "f": _painter("f", False),
    "F": _painter("f", False),
    "f*": _painter("f*", False),
    "B": _painter("f", True),
    "B*": _painter("f*", True),
    "b": _painter("f", True, True),
    "b*": _painter("f*", True, True),
    "n": _painter(None, False),
    "W": _clip("W"),
    "W*": _clip("W*"),
    "g": _device(True, colours.GRAY),
    "G": _device(False, colours.GRAY),
    "rg": _device(True, colours.RGB),
    "RG": _device(False, colours.RGB),
    "k": _device(True, colours.CMYK),
    "K": _device(False, colours.CMYK),
    "cs": lambda i, args: i.set_space(args, True),
    "CS": lambda i, args: i.set_space(args, False),
    "sc": lambda i, args: i.set_colour(args, True),
    "scn": lambda i, args: i.set_colour(args, True),
    "SC": lambda i, args: i.set_colour(args, False),
    "SCN": lambda i, args: i.set_colour(args, False),
    "Do": Interpreter.invoke,
    "sh": Interpreter.shade,
    "BI": lambda i, args: i.image(args[0], None),
    "BT": Interpreter.begin_text,
    "ET": Interpreter.end_text,
    "Tc": _number("char"),
    "Tw": _number("word"),
    "Tz": _number("scale", 0.01),
    "TL": _number("lead"),
    "Ts": _number("rise"),
    "Tr": _whole("mode", 7),
    "Tf": Interpreter.set_font,
    "Td": Interpreter.moved,
    "TD": lambda i, args: i.moved(args, True),
    "Tm": Interpreter.text_matrix,
    "T*": lambda i, args: i.next_line(0.0, -i.state.lead),
    "Tj": Interpreter.show,
    "TJ": lambda i, args: i.run_of(i.get(args[0])),
    "'": Interpreter.show_next,
    '"': Interpreter.show_spaced,
    "d1": Interpreter.masked_glyph,
}
#: What a glyph that is only a mask may not do.
COLOURING = frozenset("g G rg RG k K cs CS sc scn SC SCN ri sh".split())


def drawn(doc: Document, page: Page, draw: bool = True) -> Output:
    """Everything a page draws: its contents, then the appearances of its annotations, under one budget of work."""
    out, known = Output(), {}
    Interpreter(doc, page, page.resources, page_matrix(page), out, known=known, draw=draw).run(contents(doc, page))
    for form, matrix in doc.appearances(page):
        made = Interpreter(doc, page, page.resources, page_matrix(page), out, known=known, draw=draw)
        made._form(form, times(matrix, page_matrix(page)))
    return out


def characters(doc: Document, page: Page) -> list[dict]:
    """Rows of the character table, in the order shown."""
    return drawn(doc, page, draw=False).chars
