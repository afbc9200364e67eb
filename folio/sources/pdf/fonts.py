"""Decoding of the strings of a PDF's fonts: text and widths, in units of the font size."""

from __future__ import annotations

import re
import struct
import unicodedata
from dataclasses import dataclass, field
from typing import Any, Protocol

from folio.sources.pdf.objects import Document, Name, PdfError, Ref, Stream

# Encodings of double-byte fonts that are read as GBK.
GBK = ("GBKp-EUC-H", "GBKp-EUC-V", "GBK-EUC-H", "GBK-EUC-V", "GBKp-EUC", "GBK-EUC", "UniGB-UTF16-H", "UniGB-UTF16-V", "UniGB-UCS2-H", "UniGB-UCS2-V", "GBpc-EUC-H", "GBpc-EUC-V")
# Largest range of codes in a character map, width of a character without one, and default width of a CID.
WIDEST_RANGE, WIDTH, CID_WIDTH = 65_536, 0.5, 1.0
# Published names of punctuation and other characters that no rule gives.
NAMED = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "−",
    "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`",
    "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«",
    "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "ordmasculine": "º", "guillemotright": "»", "onequarter": "¼", "onehalf": "½",
    "threequarters": "¾", "questiondown": "¿", "multiply": "×", "divide": "÷", "germandbls": "ß", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "Lslash": "Ł", "lslash": "ł",
    "dotlessi": "ı", "florin": "ƒ", "circumflex": "ˆ", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚", "ogonek": "˛", "tilde": "˜", "hungarumlaut": "˝", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚",
    "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰", "guilsinglleft": "‹", "guilsinglright": "›", "fraction": "⁄", "Euro": "€", "trademark": "™",
    "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "infinity": "∞", "notequal": "≠", "lessequal": "≤", "greaterequal": "≥", "partialdiff": "∂", "summation": "∑", "product": "∏", "radical": "√", "integral": "∫", "approxequal": "≈", "lozenge": "◊", "nbspace": " ", "softhyphen": "­",
}
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
ACCENTS = {"grave": "GRAVE", "acute": "ACUTE", "circumflex": "CIRCUMFLEX", "tilde": "TILDE", "dieresis": "DIAERESIS", "ring": "RING ABOVE", "cedilla": "CEDILLA", "caron": "CARON", "breve": "BREVE", "macron": "MACRON", "ogonek": "OGONEK", "dotaccent": "DOT ABOVE", "hungarumlaut": "DOUBLE ACUTE", "commaaccent": "CEDILLA"}
# Upper half of the standard encoding, by octal rows of the published table.
STANDARD = {
    0xA1: "exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl",
    0xB1: "endash dagger daggerdbl periodcentered", 0xB6: "paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand", 0xBF: "questiondown",
    0xC1: "grave acute circumflex tilde macron breve dotaccent dieresis", 0xCA: "ring cedilla", 0xCD: "hungarumlaut ogonek caron emdash", 0xE1: "AE", 0xE3: "ordfeminine", 0xE8: "Lslash Oslash OE ordmasculine", 0xF1: "ae", 0xF5: "dotlessi", 0xF8: "lslash oslash oe germandbls",
}


def named(name: str) -> str:
    """The text of a glyph's name, '' if unknown: by the published names, by rule for letters, digits and accents, or by the
    number that the name holds."""
    name = name.split(".")[0] if name[:1] != "." else name
    if name in NAMED:
        return NAMED[name]
    if len(name) == 1:
        return name
    if name in DIGITS:
        return str(DIGITS.index(name))
    if m := re.fullmatch(r"([A-Za-z])([a-z]+)", name):
        accent, size = ACCENTS.get(m[2]), "CAPITAL" if m[1].isupper() else "SMALL"
        tries = [f"LATIN {size} LETTER {m[1].upper()} WITH {accent}"] if accent else []
        for full in (*tries, f"GREEK {size} LETTER {name.upper()}"):
            try:
                return unicodedata.lookup(full)
            except KeyError:
                continue
    if m := re.fullmatch(r"(?:uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6}))", name):
        code = int(m[1] or m[2], 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else ""
    if m := re.fullmatch(r"afii(\d{5})", name):
        for first, base in ((10017, 0x410), (10065, 0x430)):
            k = int(m[1]) - first
            if 0 <= k <= 32:
                return chr(base - 15 if k == 6 and base == 0x410 else base + 33 if k == 6 else base + k - (k > 6))
    return ""


def byte_table(name: str | None) -> dict[int, str]:
    """The characters of a named encoding of bytes; an unknown name counts as the Western one."""
    if name == "StandardEncoding":
        out = {b: chr(b) for b in range(32, 127)} | {0x27: "’", 0x60: "‘"}
        for first, names in STANDARD.items():
            out |= {first + k: named(n) for k, n in enumerate(names.split())}
        return out
    codec = "mac_roman" if name == "MacRomanEncoding" else "cp1252"
    return {b: c for b in range(32, 256) if (c := bytes([b]).decode(codec, "ignore"))}


class Decoder(Protocol):
    """What a font does with a string: pairs of characters and widths."""

    def decode(self, data: bytes) -> list[tuple[str, float]]: ...


@dataclass
class CharMap:
    """Text by code, and how many bytes a code has."""

    single: dict[int, str] = field(default_factory=dict)
    ranges: list[tuple[int, int, int]] = field(default_factory=list)
    digits: int = 0

    def size(self) -> int:
        return 1 if self.digits <= 2 else (self.digits + 1) // 2

    def text(self, code: int) -> str:
        if code in self.single:
            return self.single[code]
        to = next((base + code - a for a, b, base in self.ranges if a <= code <= b), -1)
        return chr(to) if 0 <= to < 0x110000 and not 0xD800 <= to < 0xE000 else ""


_HEX = re.compile(rb"<([0-9A-Fa-f]*)>")


def _units(digits: bytes) -> str:
    """Targets are code units of four digits each."""
    return "".join(chr(u) for k in range(0, len(digits) - 3, 4) if not 0xD800 <= (u := int(digits[k : k + 4], 16)) < 0xE000)


def char_map(data: bytes) -> CharMap:
    """A ToUnicode map: single characters, ranges (one a line) and the space of codes."""
    out = CharMap()
    sections = lambda what: (m[1] for m in re.finditer(rb"begin%s\b(.*?)end%s\b" % (what, what), data, re.S))
    for part in sections(b"bfchar"):
        codes = _HEX.findall(part)
        for code, to in zip(codes[::2], codes[1::2]):
            if code:
                out.digits = max(out.digits, len(code))
                if text := _units(to):
                    out.single[int(code, 16)] = text
    for line in (x for part in sections(b"bfrange") for x in re.split(rb"[\r\n]+", part)):
        codes = _HEX.findall(line)
        if len(codes) < 3 or not all(codes[:3]):
            continue
        first, last = int(codes[0], 16), int(codes[1], 16)
        if not 0 <= last - first <= WIDEST_RANGE:
            continue
        if len(codes) > 3 and b"[" in line:
            for k, to in enumerate(codes[2 : 3 + last - first]):
                if text := _units(to):
                    out.single[first + k] = text
                    out.digits = max(out.digits, len(to))
        else:
            out.ranges.append((first, last, int(codes[2], 16)))
            out.digits = max(out.digits, len(codes[0]))
    for part in list(sections(b"codespacerange"))[:1]:
        out.digits = max([out.digits, *map(len, _HEX.findall(part)[:2])])
    return out


@dataclass
class SimpleFont:
    """One byte a character: by its map, else by its encoding."""

    chars: dict[int, str]
    widths: dict[int, float]
    to_text: CharMap | None = None

    def decode(self, data: bytes) -> list[tuple[str, float]]:
        out = []
        for b in data:
            text = (self.to_text.text(b) or "?") if self.to_text else self.chars.get(b, chr(b))
            out += [(c, self.widths.get(b, WIDTH) / len(text)) for c in text]
        return out


@dataclass
class WideFont:
    """Codes of several bytes, by the font's map."""

    to_text: CharMap
    width: float
    widths: dict[int, float]

    def decode(self, data: bytes) -> list[tuple[str, float]]:
        n, out = self.to_text.size(), []
        for k in range(0, len(data) - n + 1, n):
            code = int.from_bytes(data[k : k + n], "big")
            text = self.to_text.text(code) or "?"
            out += [(c, self.widths.get(code, self.width) / len(text)) for c in text]
        return out


@dataclass
class GbkFont:
    """Text in a Chinese encoding of one or two bytes a character."""

    width: float

    def decode(self, data: bytes) -> list[tuple[str, float]]:
        return [(c if c != "�" else "?", self.width) for c in data.decode("gbk", "replace")]


def true_type_chars(data: bytes) -> dict[int, int]:
    """Code point by glyph of a TrueType font, from its best character table: full Unicode before the basic plane before any."""
    try:
        count = struct.unpack_from(">H", data, 4)[0]
        heads = {data[12 + 16 * k : 16 + 16 * k]: struct.unpack_from(">I", data, 20 + 16 * k)[0] for k in range(count)}
        base = heads[b"cmap"]
        tables = [struct.unpack_from(">HHI", data, base + 4 + 8 * k) for k in range(struct.unpack_from(">H", data, base + 2)[0])]
        order = [(3, 10), (0, 4), (0, 6), (3, 1), (0, 3)]
        tables.sort(key=lambda t: order.index(t[:2]) if t[:2] in order else len(order))
        for _, _, offset in tables:
            if found := _cmap_table(data, base + offset):
                return found
    except (struct.error, KeyError, IndexError):
        pass
    return {}


def _cmap_table(data: bytes, at: int) -> dict[int, int]:
    out: dict[int, int] = {}
    kind = struct.unpack_from(">H", data, at)[0]
    if kind == 0:
        pairs = ((c, data[at + 6 + c]) for c in range(256))
    elif kind == 4:
        n = struct.unpack_from(">H", data, at + 6)[0] // 2
        column = lambda k, code="H": struct.unpack_from(f">{n}{code}", data, at + 14 + 2 * n * k + 2 * (k > 0))
        ends, starts, deltas, offsets = column(0), column(1), column(2), column(3)

        def glyph(k: int, c: int) -> int:
            if not offsets[k]:
                return (c + deltas[k]) & 0xFFFF
            g = struct.unpack_from(">H", data, at + 16 + 6 * n + 2 * k + offsets[k] + 2 * (c - starts[k]))[0]
            return (g + deltas[k]) & 0xFFFF if g else 0

        pairs = ((c, glyph(k, c)) for k in range(n) for c in range(starts[k], ends[k] + 1) if c < 0xFFFF)
    elif kind == 6:
        first, n = struct.unpack_from(">HH", data, at + 6)
        pairs = zip(range(first, first + n), struct.unpack_from(f">{n}H", data, at + 10))
    elif kind == 12:
        groups = (struct.unpack_from(">III", data, at + 16 + 12 * k) for k in range(struct.unpack_from(">I", data, at + 12)[0]))
        pairs = ((c, g + c - a) for a, b, g in groups for c in range(a, min(b, 0x10FFFF) + 1))
    else:
        return out
    for code, gid in pairs:
        if gid:
            out.setdefault(gid, code)
    return out


class Fonts:
    """The decoders of a document's fonts; each font is built once."""

    def __init__(self, doc: Document):
        self.doc, self.known = doc, {}

    def of(self, resources: dict) -> dict[str, Decoder]:
        """By resource name; only fonts that stand as objects of their own are taken."""
        out = {}
        for name, ref in self.doc.dict(resources.get("Font")).items():
            if isinstance(ref, Ref):
                if ref.number not in self.known:
                    try:
                        self.known[ref.number] = self.build(self.doc.dict(ref))
                    except (PdfError, ValueError, TypeError):
                        self.known[ref.number] = None
                if self.known[ref.number] is not None:
                    out[name] = self.known[ref.number]
        return out

    def _map(self, font: dict) -> CharMap | None:
        stream = self.doc.get(font.get("ToUnicode"))
        try:
            return char_map(self.doc.decoded(stream)) if isinstance(stream, Stream) else None
        except (PdfError, ValueError):
            return None

    def _program(self, *fonts: dict) -> bytes:
        for font in fonts:
            parts = self.doc.dict(font.get("FontDescriptor"))
            for key in ("FontFile2", "FontFile3", "FontFile"):
                stream = self.doc.get(parts.get(key))
                if isinstance(stream, Stream):
                    try:
                        if data := self.doc.decoded(stream):
                            return data
                    except (PdfError, ValueError):
                        continue
        return b""

    def build(self, font: dict) -> Decoder | None:
        return self._wide(font) if font.get("Subtype") == "Type0" else self._simple(font)

    def _simple(self, font: dict) -> Decoder:
        encoding = self.doc.get(font.get("Encoding"))
        to_text = self._map(font)
        if isinstance(encoding, dict):
            base = self.doc.get(encoding.get("BaseEncoding"))
            chars, at = byte_table(base), 0
            for x in map(self.doc.get, self.doc.array(encoding.get("Differences"))):
                if isinstance(x, Name):
                    if text := named(x):
                        chars[at] = text
                    at += 1
                elif isinstance(x, (int, float)):
                    at = int(x)
        else:
            chars = byte_table(encoding if isinstance(encoding, Name) else None)
            if encoding is None and to_text is None and (found := true_type_chars(self._program(font))):
                chars |= {g: chr(c) for g, c in found.items() if g < 256}
        first = self.doc.get(font.get("FirstChar")) or 0
        widths = {int(first) + k: w / 1000 for k, w in enumerate(map(self.doc.get, self.doc.array(font.get("Widths")))) if isinstance(w, (int, float)) and w > 0}
        return SimpleFont(chars, widths, to_text)

    def cid_widths(self, values: list[Any]) -> dict[int, float]:
        """c [w ...] and c c w, in thousandths."""
        out, k, values = {}, 0, [self.doc.get(v) for v in values]
        while k + 1 < len(values):
            first, then = values[k], values[k + 1]
            k += 2
            if not isinstance(first, (int, float)):
                k -= 1
            elif isinstance(then, list):
                out |= {int(first) + n: w / 1000 for n, w in enumerate(map(self.doc.get, then)) if isinstance(w, (int, float)) and w > 0}
            elif isinstance(then, int) and k < len(values):
                w = values[k]
                k += 1
                if isinstance(w, (int, float)) and w > 0 and then - first <= WIDEST_RANGE:
                    out |= dict.fromkeys(range(int(first), then + 1), w / 1000)
        return out

    def _wide(self, font: dict) -> Decoder | None:
        """By the map, a known encoding, or the font's own character table (a code is then a glyph)."""
        cid = next(iter(self.doc.array(font.get("DescendantFonts"))), None)
        cid = self.doc.dict(cid)
        usual = self.doc.get(cid.get("DW"))
        usual = usual / 1000 if isinstance(usual, (int, float)) else CID_WIDTH
        widths = self.cid_widths(self.doc.array(cid.get("W")))
        if (to_text := self._map(font)) is not None:
            return WideFont(to_text, usual, widths)
        if self.doc.get(font.get("Encoding")) in GBK:
            return GbkFont(usual)
        if found := true_type_chars(self._program(cid, font)):
            return WideFont(CharMap({g: chr(c) for g, c in found.items()}, digits=4), usual, widths)
        return None
