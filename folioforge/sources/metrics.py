"""Advance widths and heights of the standard fonts."""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

#: Widths of printable ASCII in thousandths of an em, and the characters that have them.
WIDTHS = {
    "Helvetica": {191: "'", 222: "ijl", 260: "|", 278: " !,./:;I[\\]ft", 333: "()-`r", 334: "{}", 355: '"', 389: "*", 469: "^", 500: "Jcksvxyz", 556: "#$0123456789?L_abdeghnopqu", 584: "+<=>~", 611: "FTZ", 667: "&ABEKPSVXY", 722: "CDHNRUw", 778: "GOQ", 833: "Mm", 889: "%", 944: "W", 1015: "@"},
    "Helvetica-Bold": {238: "'", 278: " ,./I\\ijl", 280: "|", 333: "!()-:;[]`ft", 389: "*r{}", 474: '"', 500: "z", 556: "#$0123456789J_aceksvxy", 584: "+<=>^~", 611: "?FLTZbdghnopqu", 667: "EPSVXY", 722: "&ABCDHKNRU", 778: "GOQw", 833: "M", 889: "%m", 944: "W", 975: "@"},
    "Times-Roman": {180: "'", 200: "|", 250: " ,.", 278: "/:;\\ijlt", 333: "!()-I[]`fr", 389: "Js", 408: '"', 444: "?acez", 469: "^", 480: "{}", 500: "#$*0123456789_bdghknopquvxy", 541: "~", 556: "FPS", 564: "+<=>", 611: "ELTZ", 667: "BCR", 722: "ADGHKNOQUVXYw", 778: "&m", 833: "%", 889: "M", 921: "@", 944: "W"},
    "Times-Bold": {220: "|", 250: " ,.", 278: "'/\\il", 333: "!()-:;[]`fjt", 389: "Is", 394: "{}", 444: "cerz", 500: "#$*0123456789?J_agovxy", 520: "~", 555: '"', 556: "Sbdhknpqu", 570: "+<=>", 581: "^", 611: "FP", 667: "BELTZ", 722: "ACDNRUVXYw", 778: "GHKOQ", 833: "&m", 930: "@", 944: "M", 1000: "%W"},
    "Times-Italic": {214: "'", 250: " ,.", 275: "|", 278: "/\\fijlt", 333: "!()-:;I`", 389: "[]rsz", 400: "{}", 420: '"', 422: "^", 444: "Jcekvxy", 500: "#$*0123456789?S_abdghnopqu", 541: "~", 556: "LTYZ", 611: "ABEFPRVX", 667: "CKNw", 675: "+<=>", 722: "DGHOQUm", 778: "&", 833: "%MW", 920: "@"},
    "Times-BoldItalic": {220: "|", 250: " ,.", 278: "'/\\ijlt", 333: "()-:;[]`f", 348: "{}", 389: "!Irsz", 444: "cevy", 500: "#$*0123456789?J_abdgkopqx", 555: '"', 556: "Shnu", 570: "+<=>^~", 611: "LPTYZ", 667: "ABCEFKRVXw", 722: "DGNOQU", 778: "&Hm", 832: "@", 833: "%", 889: "MW"},
}
#: What the letters of the symbol font show, from A and a on, and their widths.
SYMBOL_LETTERS = "ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ", "αβχδεφγηιϕκλμνοπθρστυϖωξψζ"
SYMBOL_WIDTHS = "722 667 722 612 611 763 603 722 333 631 722 686 889 722 722 768 741 556 592 611 690 439 768 645 795 611", "631 549 549 494 439 521 411 603 329 603 549 549 576 521 549 549 521 549 603 439 576 713 686 493 686 494"
#: Ascent and descent, in thousandths of an em, of the fonts that stand in for the standard ones.
HEIGHTS = {
    "Courier": (932, -317),
    "Courier-Bold": (1007, -393),
    "Courier-BoldOblique": (997, -393),
    "Courier-Oblique": (920, -317),
    "Helvetica": (1075, -299),
    "Helvetica-Bold": (1070, -307),
    "Helvetica-BoldOblique": (1073, -309),
    "Helvetica-Oblique": (1070, -284),
    "Symbol": (1010, -293),
    "Times-Bold": (1044, -341),
    "Times-BoldItalic": (972, -324),
    "Times-Italic": (951, -270),
    "Times-Roman": (1053, -281),
    "ZapfDingbats": (820, -143),
}
#: Widths of what stands outside ASCII and is no letter with an accent, in the roman faces.
OTHERS = {"sans": {"‘": 222, "’": 222, "‚": 222, "“": 333, "”": 333, "„": 333, "•": 350, "–": 556, "—": 1000, "…": 1000, "ı": 278, "ﬁ": 500, "ﬂ": 500}, "serif": {"‘": 333, "’": 333, "‚": 333, "“": 444, "”": 444, "„": 444, "•": 350, "–": 500, "—": 1000, "…": 1000, "ı": 278, "ﬁ": 556, "ﬂ": 556}, "bold": {"‘": 278, "’": 278, "‚": 278, "“": 500, "”": 500, "„": 500, "•": 350, "–": 556, "—": 1000, "…": 1000, "ı": 278, "ﬁ": 611, "ﬂ": 611}}
#: Names that mean a standard font whatever the flags of the font say.
EXACT = re.compile(r"(?:Arial(?:UnicodeMS|MT)?|Courier(?:New(?:PS)?)?(?:MT)?|Helvetica|Times(?:NewRoman(?:PS)?)?(?:MT)?)(?:-(?:Roman|(?:Bold)?(?:Italic|Oblique)?)(?:MT)?)?\Z")
FIXED_PITCH, SERIF, ITALIC, FORCE_BOLD = 1 << 0, 1 << 1, 1 << 6, 1 << 18


def standard_name(base: str, flags: int = 0) -> str:
    """The standard font that stands in for a base font name and descriptor flags."""
    name = re.sub(r"\A[A-Z]{6}\+", "", base).replace(" ", "").replace(",", "-")
    if name in ("Symbol", "ZapfDingbats"):
        return name
    if EXACT.match(name):
        flags = 0
    low = name.lower()
    bold, italic = "bold" in low or bool(flags & FORCE_BOLD), "italic" in low or "oblique" in low or bool(flags & ITALIC)
    if "courier" in low or "mono" in low or flags & FIXED_PITCH:
        family, slant = "Courier", "Oblique"
    elif any(w in low for w in ("times", "georgia", "garamond", "book")) or flags & SERIF:
        family, slant = "Times", "Italic"
    else:
        family, slant = "Helvetica", "Oblique"
    style = "Bold" * bold + slant * italic
    return f"{family}-{style}" if style else "Times-Roman" if family == "Times" else family


def symbols() -> dict[int, str]:
    """Code to text of the symbol font's own encoding, as far as letters, digits and marks of ASCII go."""
    kept = {code: chr(code) for code in range(32, 64)}
    return kept | {start + k: c for start, letters in zip((65, 97), SYMBOL_LETTERS, strict=True) for k, c in enumerate(letters)}


@lru_cache(32)
def widths(name: str, folder: str | None = None) -> dict[str, int]:
    """Text to width of a standard font: from <folder>/<name>.afm where that is there, else of ASCII from the table above
    and of letters with accents by their base letter."""
    if folder and os.path.exists(path := os.path.join(folder, name + ".afm")):
        from .glyphs import text_of

        with open(path, encoding="latin-1") as file:
            found = re.findall(r"^C\s+-?\d+\s*;\s*WX\s+(-?\d+)\s*;\s*N\s+(\S+)", file.read(), re.MULTILINE)
        return {text_of(glyph): int(width) for width, glyph in found if text_of(glyph)}
    if name == "Symbol":
        return {c: int(w) for letters, of in zip(SYMBOL_LETTERS, SYMBOL_WIDTHS, strict=True) for c, w in zip(letters, of.split(), strict=True)} | {c: 500 for c in "0123456789"} | {c: 250 for c in " .,"}
    table = WIDTHS.get(name.replace("Oblique", "").rstrip("-") if name.startswith("Helvetica") else name)
    return {c: width for width, characters in (table or {}).items() for c in characters}


def width(name: str, text: str, folder: str | None = None) -> int | None:
    """Width of one character of a standard font, in thousandths of an em; None if nothing says it."""
    if name.startswith("Courier"):
        return 600
    known = widths(name, folder)
    if text in known:
        return known[text]
    if not known or len(text) != 1:
        return None
    others = OTHERS["serif" if name.startswith("Times") else "bold" if "Bold" in name else "sans"]
    if text in others:
        return others[text]
    base = unicodedata.normalize("NFD", text)[0]
    return others["ı"] if base == "i" and base != text else known.get(base)
