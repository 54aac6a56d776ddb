"""Names of glyphs and encodings of simple fonts."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Accents in glyph names and their combining characters.
ACCENTS = {"grave": 0x300, "acute": 0x301, "circumflex": 0x302, "tilde": 0x303, "macron": 0x304, "breve": 0x306, "dotaccent": 0x307, "dieresis": 0x308, "ring": 0x30A, "hungarumlaut": 0x30B, "caron": 0x30C, "commaaccent": 0x326, "cedilla": 0x327, "ogonek": 0x328}
#: Names of single glyphs that are not letters with accents, and what they show.
NAMED = dict(pair.split("=", 1) for pair in "exclam=! quotedbl=\" numbersign=# dollar=$ percent=% ampersand=& quotesingle=' parenleft=( parenright=) asterisk=* plus=+ comma=, hyphen=- period=. slash=/ colon=: semicolon=; less=< equal== greater=> question=? at=@ bracketleft=[ backslash=\\ bracketright=] asciicircum=^ underscore=_ grave=` braceleft={ bar=| braceright=} asciitilde=~ quoteleft=‘ quoteright=’ quotedblleft=“ quotedblright=” quotesinglbase=‚ quotedblbase=„ exclamdown=¡ cent=¢ sterling=£ fraction=⁄ yen=¥ florin=ƒ section=§ currency=¤ guillemotleft=« guillemotright=» guilsinglleft=‹ guilsinglright=› fi=ﬁ fl=ﬂ ff=ﬀ ffi=ﬃ ffl=ﬄ endash=– emdash=— dagger=† daggerdbl=‡ periodcentered=· paragraph=¶ bullet=• ellipsis=… perthousand=‰ questiondown=¿ acute=´ circumflex=ˆ tilde=˜ macron=¯ breve=˘ dotaccent=˙ dieresis=¨ ring=˚ cedilla=¸ hungarumlaut=˝ ogonek=˛ caron=ˇ AE=Æ ae=æ OE=Œ oe=œ Oslash=Ø oslash=ø Lslash=Ł lslash=ł Eth=Ð eth=ð Thorn=Þ thorn=þ germandbls=ß dotlessi=ı ordfeminine=ª ordmasculine=º copyright=© registered=® trademark=™ logicalnot=¬ degree=° plusminus=± twosuperior=² threesuperior=³ onesuperior=¹ mu=µ onequarter=¼ onehalf=½ threequarters=¾ multiply=× divide=÷ brokenbar=¦ Euro=€ minus=− infinity=∞ lessequal=≤ greaterequal=≥ notequal=≠ summation=∑ product=∏ integral=∫ radical=√ approxequal=≈ Delta=∆ Omega=Ω pi=π lozenge=◊ partialdiff=∂ Dcroat=Đ dcroat=đ".split(" ")) | {"space": " ", "nbspace": " "}
#: The upper half of the standard encoding, from the code given.
STANDARD = {0x27: "quoteright", 0x60: "quoteleft"} | {start + k: name for start, names in {0xA1: "exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl", 0xB1: "endash dagger daggerdbl periodcentered", 0xB6: "paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand", 0xBF: "questiondown", 0xC1: "grave acute circumflex tilde macron breve dotaccent dieresis", 0xCA: "ring cedilla", 0xCD: "hungarumlaut ogonek caron emdash", 0xE1: "AE", 0xE3: "ordfeminine", 0xE8: "Lslash Oslash OE ordmasculine", 0xF1: "ae", 0xF5: "dotlessi", 0xF8: "lslash oslash oe germandbls"}.items() for k, name in enumerate(names.split())}
DIGITS = "zero one two three four five six seven eight nine".split()
UNITS = re.compile(r"\Auni((?:[0-9A-F]{4})+)\Z|\Au([0-9A-F]{4,6})\Z")
LETTER = re.compile(r"\A([A-Za-z])([a-z]+)\Z")


@lru_cache(4096)
def text_of(name: str) -> str:
    """What a glyph of this name shows; empty if the name says nothing."""
    name = name.split(".", 1)[0] if not name.startswith(".") else ""
    if "_" in name:
        return "".join(text_of(part) for part in name.split("_"))
    if name in NAMED:
        return NAMED[name]
    if name in DIGITS:
        return str(DIGITS.index(name))
    if len(name) == 1 and name.isascii() and name.isalpha():
        return name
    if m := UNITS.match(name):
        units = [int(m[1][k : k + 4], 16) for k in range(0, len(m[1]), 4)] if m[1] else [int(m[2], 16)]
        return "".join(chr(u) for u in units if u < 0xD800 or 0xDFFF < u < 0x110000)
    if (m := LETTER.match(name)) and m[2] in ACCENTS:
        return unicodedata.normalize("NFC", m[1] + chr(ACCENTS[m[2]]))
    for size in ("SMALL", "CAPITAL"):
        if name == (name.lower() if size == "SMALL" else name.capitalize()):
            try:
                return unicodedata.lookup(f"GREEK {size} LETTER {name.upper()}")
            except KeyError:
                pass
    return ""


def by_codec(codec: str) -> dict[int, str]:
    """Code to text of an encoding that Python knows."""
    made = {code: bytes([code]).decode(codec, "ignore") for code in range(32, 256)}
    return {code: text for code, text in made.items() if text}


@lru_cache(8)
def encoding(name: str) -> dict[int, str]:
    """Code to text of a predefined encoding; of an unknown one, the standard encoding."""
    if name == "WinAnsiEncoding":
        # what the code page leaves open shows a bullet; the hard space and hyphen show like the soft ones
        return {code: "•" for code in range(0x7F, 0xA0)} | by_codec("cp1252") | {0xA0: " ", 0xAD: "-", 0x7F: "•"}
    if name == "MacRomanEncoding":
        return by_codec("mac_roman") | {0xCA: " ", 0xDB: "¤"}
    return {code: chr(code) for code in range(32, 127)} | {code: text_of(glyph) for code, glyph in STANDARD.items()}
