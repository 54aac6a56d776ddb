"""Colour spaces: numbers of components, and their bytes of red, green and blue.

Gray and CMYK use the plain formulas: the measured tables of a profile are not part of this package.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from . import formulas
from .objects import File, Name, Stream

Rgb = tuple[int, int, int]
NESTED_MOST = 8


def unit(v: float) -> float:
    return 0.0 if math.isnan(v) or v < 0 else min(float(v), 1.0)


def byte(v: float) -> int:
    return int(unit(v) * 255)


def from_gray(c: list[float]) -> Rgb:
    return (byte(c[0]),) * 3


def from_rgb(c: list[float]) -> Rgb:
    return byte(c[0]), byte(c[1]), byte(c[2])


def from_cmyk(c: list[float]) -> Rgb:
    k = unit(c[3])
    return tuple(int(255 * (1 - min(1.0, unit(v) + k))) for v in c[:3])


@dataclass(frozen=True, eq=False)
class Space:
    """size: components; rgb: their colour, None where nothing is marked; first: the initial components; limits: for
    decoding samples, None for those of an index."""

    name: str
    size: int
    rgb: Callable[[list[float]], Rgb | None]
    first: list[float]
    base: Space | None = None
    limits: list[tuple[float, float]] | None = field(default=None)


GRAY = Space("DeviceGray", 1, from_gray, [0.0])
RGB = Space("DeviceRGB", 3, from_rgb, [0.0] * 3)
CMYK = Space("DeviceCMYK", 4, from_cmyk, [0.0, 0.0, 0.0, 1.0])
NAMES = {"DeviceGray": GRAY, "G": GRAY, "CalGray": GRAY, "DeviceRGB": RGB, "RGB": RGB, "CalRGB": RGB, "DeviceCMYK": CMYK, "CMYK": CMYK}


def pattern(base: Space | None = None) -> Space:
    return Space("Pattern", base.size if base else 0, lambda c: None, [], base)


def space(file: File, value, depth: int = 0) -> Space | None:
    """The space that a name or an array means; None for one that is not supported, as Lab."""
    value = file.get(value)
    if isinstance(value, Name):
        return pattern() if value == "Pattern" else NAMES.get(str(value))
    if not isinstance(value, list) or not value or depth > NESTED_MOST:
        return None
    family, rest = str(file.get(value[0])), value[1:]
    if family in NAMES:
        return NAMES[family]
    if family == "Pattern":
        return pattern(space(file, rest[0], depth + 1) if rest else None)
    if family == "ICCBased" and rest:
        profile = file.get(rest[0])
        entries = profile.entries if isinstance(profile, Stream) else profile
        if not isinstance(entries, dict):
            return None
        made = {1: GRAY, 3: RGB, 4: CMYK}.get(file.get(entries.get("N")))
        return made or (space(file, entries["Alternate"], depth + 1) if "Alternate" in entries else None)
    if family in ("Indexed", "I") and len(rest) >= 3:
        return _indexed(file, rest, depth)
    if family in ("Separation", "DeviceN") and len(rest) >= 3:
        names = file.get(rest[0])
        names = names if isinstance(names, list) else [names]
        below = space(file, rest[1], depth + 1)
        none = bool(names) and all(file.get(n) == "None" for n in names)
        try:
            tint = formulas.parsed(file, rest[2])
        except formulas.NoFunction:
            return Space(family, len(names), lambda c: None, [1.0] * len(names), below) if none else None
        if below is None or below.size == 0 or len(tint.domain) != len(names):
            return None
        full = lambda out: (out + [0.0] * below.size)[: below.size]
        return Space(family, len(names), lambda c: None if none else below.rgb(full(tint(c))), [1.0] * len(names), below)
    return None


def _indexed(file: File, rest: list, depth: int) -> Space | None:
    base, most, table = space(file, rest[0], depth + 1), file.get(rest[1]), file.get(rest[2])
    if base is None or base.size == 0 or base.name == "Indexed" or not isinstance(most, int | float):
        return None
    most = int(max(0, min(255, most)))
    raw = file.content(table) if isinstance(table, Stream) else table if isinstance(table, bytes) else b""
    raw = raw.ljust((most + 1) * base.size, b"\0")
    palette = [base.rgb([raw[k * base.size + j] / 255 for j in range(base.size)]) for k in range(most + 1)]

    def rgb(c: list[float]) -> Rgb | None:
        return palette[0 if math.isnan(c[0]) else int(max(0, min(most, c[0])))]

    return Space("Indexed", 1, rgb, [0.0], base)
