"""Core fonts: widths, names, and code maps for characters beyond Latin-1."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache

# Widths of printable ASCII from the space on, in thousandths of the size; public metrics of the core fonts.
HELVETICA = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
HELVETICA_BOLD = [
    278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 333, 333, 584, 584, 584, 611,
    975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556,
    333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584,
]
TIMES = [
    250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 278, 278, 564, 564, 564, 444,
    921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500,
    333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541,
]
TIMES_BOLD = [
    250, 333, 555, 500, 500, 1000, 833, 278, 333, 333, 500, 570, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 333, 333, 570, 570, 570, 500,
    930, 722, 667, 722, 722, 667, 611, 778, 778, 389, 500, 778, 667, 944, 722, 778, 611, 778, 722, 556, 667, 722, 722, 1000, 722, 722, 667, 333, 278, 333, 581, 500,
    333, 500, 556, 444, 556, 444, 333, 500, 556, 278, 333, 556, 278, 833, 556, 500, 556, 556, 444, 389, 333, 556, 500, 722, 500, 500, 444, 394, 220, 394, 520,
]
TIMES_ITALIC = [
    250, 333, 420, 500, 500, 833, 778, 214, 333, 333, 500, 675, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 333, 333, 675, 675, 675, 500,
    920, 611, 611, 667, 722, 611, 611, 722, 722, 333, 444, 667, 556, 833, 667, 722, 611, 722, 611, 500, 556, 722, 611, 833, 611, 556, 556, 389, 278, 389, 422, 500,
    333, 500, 500, 444, 500, 444, 278, 500, 500, 278, 278, 444, 278, 722, 500, 500, 500, 500, 389, 389, 278, 500, 444, 667, 444, 444, 389, 400, 275, 400, 541,
]
TIMES_BOLD_ITALIC = [
    250, 389, 555, 500, 500, 833, 778, 278, 333, 333, 500, 570, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 333, 333, 570, 570, 570, 500,
    832, 667, 667, 667, 722, 667, 667, 722, 778, 389, 500, 667, 611, 889, 722, 722, 611, 722, 667, 556, 611, 722, 667, 889, 667, 611, 611, 333, 278, 333, 570, 500,
    333, 500, 500, 444, 500, 444, 333, 500, 556, 278, 278, 500, 278, 778, 556, 500, 500, 500, 389, 389, 278, 556, 444, 667, 500, 444, 389, 348, 220, 348, 570,
]
COURIER = [600] * 95

#: Family and style ("", B, I, BI) to the font's name in files and its widths.
CORE = {
    ("courier", ""): ("Courier", COURIER), ("courier", "B"): ("Courier-Bold", COURIER), ("courier", "I"): ("Courier-Oblique", COURIER), ("courier", "BI"): ("Courier-BoldOblique", COURIER),
    ("helvetica", ""): ("Helvetica", HELVETICA), ("helvetica", "B"): ("Helvetica-Bold", HELVETICA_BOLD),
    ("helvetica", "I"): ("Helvetica-Oblique", HELVETICA), ("helvetica", "BI"): ("Helvetica-BoldOblique", HELVETICA_BOLD),
    ("times", ""): ("Times-Roman", TIMES), ("times", "B"): ("Times-Bold", TIMES_BOLD), ("times", "I"): ("Times-Italic", TIMES_ITALIC), ("times", "BI"): ("Times-BoldItalic", TIMES_BOLD_ITALIC),
}


def style_of(style: str) -> str:
    """B, I, BI or nothing, whatever the order and case; underlining (U) is no style of the font."""
    return "".join(c for c in "BI" if c in style.upper())


def core_font(family: str, style: str = "") -> tuple[str, list[int]]:
    """The name and widths of a core font; Arial is Helvetica."""
    family = family.lower()
    found = CORE.get(("helvetica" if family == "arial" else family, style_of(style)))
    if not found:
        raise ValueError(f"no such core font: {family} {style}".strip())
    return found


def mean_width(widths: list[int]) -> int:
    """What a character without a width takes: the rounded mean of the font."""
    return round(sum(widths) / len(widths))


@lru_cache(maxsize=1 << 14)
def _base(char: str) -> str:
    """The letter below a character's accents."""
    return unicodedata.normalize("NFD", char)[:1]


def char_width(widths: list[int], char: str) -> int:
    """An accented letter is as wide as the plain one."""
    n = ord(char) - 32
    if 0 <= n < len(widths):
        return widths[n]
    n = ord(_base(char) or " ") - 32 if n >= 128 else -1
    return widths[n] if 0 < n < len(widths) else mean_width(widths)


class Widths(dict):
    """Character to its width in one font, filled as characters come."""

    def __init__(self, widths: list[int]):
        self.widths = widths

    def __missing__(self, char: str) -> int:
        width = char_width(self.widths, char)
        if len(self) < 1 << 16:
            self[char] = width
        return width


_TABLES: dict[tuple[int, ...], Widths] = {}


def table_of(widths: list[int]) -> Widths:
    """The one table of a font's widths in this process."""
    key = tuple(widths)
    return _TABLES.get(key) or _TABLES.setdefault(key, Widths(widths))


def text_width(widths: list[int], text: str) -> int:
    """In thousandths of the size."""
    return sum(map(table_of(widths).__getitem__, text))


def codes_for(texts: Iterable[str]) -> dict[str, int]:
    """A code from 1 on for each different character of the texts, in the order of the characters."""
    return {c: i for i, c in enumerate(sorted(set().union(*texts)), 1)}


def to_unicode(codes: dict[str, int]) -> bytes:
    """The code map of two-byte codes: what a reader needs to give the characters back."""
    out = [
        "/CIDInit /ProcSet findresource begin", "12 dict begin", "begincmap", "/CIDSystemInfo", "<</Registry (Adobe) /Ordering (UCS) /Supplement 0>> def",
        "/CMapName /Adobe-Identity-UCS def", "/CMapType 2 def", "1 begincodespacerange", "<0000> <FFFF>", "endcodespacerange",
    ]
    rows = [f"<{n:04X}> <{c.encode('utf-16-be', 'surrogatepass').hex().upper()}>" for c, n in codes.items()]
    for a in range(0, len(rows), 100):  # a section holds at most a hundred
        part = rows[a : a + 100]
        out += [f"{len(part)} beginbfchar", *part, "endbfchar"]
    out += ["endcmap", "CMapName currentdict /CMap defineresource pop", "end", "end"]
    return "\n".join(out).encode()


def coded(text: str, codes: dict[str, int]) -> bytes:
    """A hexadecimal string of two-byte codes."""
    return b"<" + "".join(f"{codes[c]:04X}" for c in text).encode() + b">"
