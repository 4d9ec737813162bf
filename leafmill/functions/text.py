"""Text operators of content streams: scanning, code maps, and joining to page text."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

from leafmill.functions.objects import File, Stream, unescape

_LITERAL = rb"\((?:[^()\\]++|\\.)*+\)"
_HEX = rb"<[0-9A-Fa-f\s]*>"
_SHOW = re.compile(rb"(" + _LITERAL + rb"|" + _HEX + rb")\s*(Tj|'|\")", re.S)
_SHOW_MANY = re.compile(rb"\[((?:" + _LITERAL + rb"|[^\[\]()\\]|\\.)*+)\]\s*TJ", re.S)
_PART = re.compile(rb"(" + _LITERAL + rb"|" + _HEX + rb")|(-?[\d.]+)", re.S)
_FONT = re.compile(rb"/([A-Za-z0-9]+)\s+[\d.]+\s+Tf")
#: Operators and fonts outside of strings: what looks like one within a string is passed with it.
_OUTSIDE = re.compile(rb"\[((?:" + _LITERAL + rb"|[^\[\]()\\]|\\.)*+)\]\s*TJ|(" + _LITERAL + rb"|" + _HEX + rb")\s*(Tj|'|\")|" + _LITERAL + rb"|/([A-Za-z0-9]+)\s+[\d.]+\s+Tf", re.S)
_MOVES = re.compile(rb"T\*|Td|TD|Tm")
#: Bytes that an operator is taken to be long when the gap to the next one is searched for moves.
OPERATOR_BYTES = 50
#: Unicode has no more characters, so a longer range of codes is no range of characters.
_MOST_CODES = 0x10FFFF
_TRIM = " \t\n\r\0\x0b"


def literal_text(body: bytes) -> str:
    """Escapes are replaced one kind after the other and octal escapes are left out, as users of page text know it."""
    out = body.decode("latin-1")
    for escaped, char in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\f", "\f"), ("\\(", "("), ("\\)", ")"), ("\\\\", "\\")):
        out = out.replace(escaped, char)
    return re.sub(r"\\[0-7]{1,3}", "", out)


def units_text(data: bytes) -> str:
    """UTF-16 code units; halves of a character that stand alone are left out, a byte too many is a character."""
    whole = len(data) & ~1
    return data[:whole].decode("utf-16-be", "ignore") + data[whole:].decode("latin-1")


def hex_text(digits: bytes, cmap: dict[tuple[int, int], str] | None = None) -> str:
    """Plain bytes, UTF-16 after its mark, or through a code map: codes of 4, 2 and 1 bytes are tried in turn."""
    digits = re.sub(rb"\s", b"", digits)
    if len(digits) % 2:
        digits += b"0"
    data = bytes.fromhex(digits.decode())
    if not cmap:
        return units_text(data[2:]) if data[:2] == b"\xfe\xff" else data.decode("latin-1")
    codes = {code: t for (_, code), t in cmap.items()}
    out, at = [], 0
    while at < len(data):
        for n in (4, 2, 1):
            if at + n <= len(data) and (code := int.from_bytes(data[at : at + n], "big")) in codes:
                out.append(codes[code])
                at += n
                break
        else:
            at += 1
    return "".join(out)


@lru_cache(maxsize=64)
def _parsed_cmap(text: bytes) -> dict[tuple[int, int], str]:
    """The maps of the fonts seen last: pages of a file share them."""
    return parse_cmap(text)


def parse_cmap(text: bytes) -> dict[tuple[int, int], str]:
    """(digits, code) to text: single characters first, then ranges, which overwrite them."""
    out: dict[tuple[int, int], str] = {}
    word = rb"<([0-9A-Fa-f]+)>"

    def target(h: bytes) -> str:
        return units_text(bytes.fromhex(("0" * (len(h) % 2)) + h.decode()))

    for section in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
        for code, to in re.findall(word + rb"\s*" + word, section):
            out[len(code), int(code, 16)] = target(to)
    for section in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
        for a, b, to, many in re.findall(word + rb"\s*" + word + rb"\s*(?:" + word + rb"|\[([^\]]*)\])", section):
            first, last = int(a, 16), int(b, 16)
            if many:
                for code, one in zip(range(first, last + 1), re.findall(word, many), strict=False):
                    out[len(a), code] = target(one)
            else:
                if last - first > _MOST_CODES:  # no text can hold them all: a damaged range
                    continue
                for code in range(first, last + 1):
                    out[len(a), code] = target(b"%0*x" % (len(to), int(to, 16) + code - first))
    return out


def text_operators(content: bytes, fonts: dict[str, dict] | None = None, exact: bool = False) -> list[dict]:
    """(pos, op, raw, active_font, text) of each text-showing operator in the order of position.

    ``exact`` decodes strings by the rules of the format, octal escapes too, and takes nothing within a
    string for an operator.
    """
    outside = [*_OUTSIDE.finditer(content)] if exact else []
    changes = [(m.start(), m[4].decode("latin-1")) for m in outside if m[4]] if exact else [(m.start(), m[1].decode("latin-1")) for m in _FONT.finditer(content)]
    starts = [c[0] for c in changes]

    def shown(operand: bytes, font: str | None) -> str:
        if operand[:1] == b"(":
            return unescape(operand[1:-1]).decode("latin-1") if exact else literal_text(operand[1:-1])
        return hex_text(operand[1:-1], (fonts or {}).get(font))

    out = []
    if exact:
        found = [(m.start(), "TJ", m[0], m[1]) if m[1] is not None else (m.start(), m[3].decode(), m[2], None) for m in outside if m[1] is not None or m[3]]
    else:
        found = [(m.start(), m[2].decode(), m[1], None) for m in _SHOW.finditer(content)]
        found += [(m.start(), "TJ", m[0], m[1]) for m in _SHOW_MANY.finditer(content)]
    for pos, op, raw, many in sorted(found, key=lambda x: (x[0], x[1])):
        before = bisect_left(starts, pos)
        font = changes[before - 1][1] if before else None
        if many is None:
            text = shown(raw, font)
        else:
            text = "".join(shown(s, font) if s else " " * (float(n) < -100) for s, n in _PART.findall(many) if s or re.fullmatch(rb"-?(?:\d+\.?\d*|\.\d+)", n))
        out.append({"pos": pos, "op": op, "raw": raw, "active_font": font, "text": text})
    return out


def join_operators(content: bytes, ops: list[dict], exact: bool = False) -> str:
    """A newline before an operator if a move lies in the gap that is searched, else a space.

    The gap starts a fixed number of bytes after the operator before; where that is behind this
    operator the search goes on to as many bytes before the end of the stream, as users know it.
    ``exact`` keeps the spaces at both ends, and operators that show nothing add nothing.
    """
    out, before = [], None
    if exact:
        ops = [op for op in ops if op["text"]]
    for op in ops:
        if before is not None:
            start, length = before + OPERATOR_BYTES, op["pos"] - before - OPERATOR_BYTES
            end = start + length if length >= 0 else len(content) + length
            out.append("\n" if _MOVES.search(content[start : max(start, end)]) else " ")
        out.append(op["text"])
        before = op["pos"]
    return "".join(out) if exact else "".join(out).strip(_TRIM)


def fonts_of(file: File, resources: object) -> dict[str, dict]:
    """Font name to its code map, for fonts that have one."""
    resources = file.resolve(resources)
    named = file.resolve(resources.get("Font")) if isinstance(resources, dict) else None
    out = {}
    for name, ref in (named or {}).items():
        font = file.resolve(ref)
        cmap = file.resolve(font.get("ToUnicode")) if isinstance(font, dict) else None
        if isinstance(cmap, Stream):
            out[name] = _parsed_cmap(cmap.data())
    return out


def page_text(file: File, page: dict, inherited: dict, exact: bool = False) -> str:
    """The texts of the page's streams, one after the other: trimmed, or with ``exact`` as they are shown."""
    fonts = fonts_of(file, inherited.get("Resources"))
    return "".join(join_operators(c, text_operators(c, fonts, exact), exact) for c in file.contents(page))
