"""Fax streams (ITU-T T.4 and T.6): group 3 in one and two dimensions and group 4, line by line."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

from leafmill.functions.errors import FilterError

# The run codes of T.4, in the order of their lengths 0 to 63, then 64, 128 ... 1728.
WHITE_SHORT = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"""
WHITE_LONG = """11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011
011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"""
BLACK_SHORT = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111"""
BLACK_LONG = """0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010
0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"""
# The codes of both colours for the lengths 1792, 1856 ... 2560.
COMMON_LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
# The modes of two-dimensional lines; a number is the distance of a1 from b1.
MODES = {"pass": "0001", "runs": "001", 0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
EOL = "000000000001"

CODES = [
    {i if i < 64 else (i - 63) * 64: code for i, code in enumerate(f"{short} {long} {COMMON_LONG}".split())}
    for short, long in ((WHITE_SHORT, WHITE_LONG), (BLACK_SHORT, BLACK_LONG))
]


def _lookup(codes: Mapping, bits: int) -> list:
    """For every value of so many bits the meaning and length of the code that it begins with."""
    table: list = [None] * (1 << bits)
    for meaning, code in codes.items():
        first = int(code, 2) << bits - len(code)
        table[first : first + (1 << bits - len(code))] = [(meaning, len(code))] * (1 << bits - len(code))
    return table


_RUNS, _MODES = [_lookup(c, 13) for c in CODES], _lookup(MODES, 7)


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(4), 0, 8 * len(data)

    def peek(self, n: int) -> int:
        """The next n bits, 24 at most; zeros follow the data."""
        part = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 4].ljust(4, b"\0"))
        return part >> 32 - n - (self.at & 7) & (1 << n) - 1

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8

    def zeros(self) -> int:
        """How many zero bits come next."""
        at = self.at
        while at < self.end:
            byte = self.data[at >> 3] & 255 >> (at & 7)
            if byte:
                return (at | 7) - byte.bit_length() + 1 - self.at
            at = (at | 7) + 1
        return self.end - self.at

    def skip_eol(self) -> bool:
        """Passes one end of line and the fill before it, if they come next."""
        n = self.zeros()
        if n < 11 or self.at + n >= self.end:
            return False
        self.at += n + 1
        return True

    def find_eol(self) -> None:
        """Goes to the next end of line, or to the end of the data."""
        while self.at < self.end:
            n = self.zeros()
            if n >= 11:
                return
            self.at += n + 1

    def run(self, color: int) -> int:
        total, codes, data, at = 0, _RUNS[color], self.data, self.at
        while True:
            if (found := codes[int.from_bytes(data[at >> 3 : (at >> 3) + 4]) >> 19 - (at & 7) & 0x1FFF]) is None or at + found[1] > self.end:
                raise FilterError("CCITTFaxDecode: no such run")
            at += found[1]
            total += found[0]
            if found[0] < 64:
                self.at = at
                return total


def _add(changes: list[int], x: int) -> None:
    """Adds a change of colour; two at one place are none."""
    if changes and changes[-1] == x:
        changes.pop()
    else:
        changes.append(x)


def _line_1d(bits: _Bits, columns: int) -> list[int]:
    changes, x, color = [], 0, 0
    while x < columns:
        x += bits.run(color)
        _add(changes, min(x, columns))
        color ^= 1
    return changes


def _line_2d(bits: _Bits, above: list[int], columns: int) -> list[int]:
    changes, a0, color, k, data = [], -1, 0, 0, bits.data
    while a0 < columns:
        at = bits.at
        if (found := _MODES[int.from_bytes(data[at >> 3 : (at >> 3) + 4]) >> 25 - (at & 7) & 0x7F]) is None or bits.at + found[1] > bits.end:
            raise FilterError("CCITTFaxDecode: no such mode")
        mode = found[0]
        bits.at += found[1]
        if mode == "runs":
            for c in (color, color ^ 1):
                a0 = min(columns, max(a0, 0) + bits.run(c))
                _add(changes, a0)
            continue
        # b1 is the first change above to the other colour right of a0; steps back are at most one pair.
        while k > 0 and above[k - 1 : k] and above[k - 1] > a0:
            k -= 1
        while k < len(above) and (above[k] <= a0 or k % 2 != color):
            k += 1
        if mode == "pass":
            a0 = above[k + 1] if k + 1 < len(above) else columns
        else:
            b1 = above[k] if k < len(above) else columns
            a0 = min(columns, max(b1 + mode, a0, 0))
            _add(changes, a0)
            color ^= 1
    return changes


def _pixels(changes: Sequence[int], columns: int, white: int) -> bytes:
    out, at, color, other = [], 0, bytes([white]), bytes([255 - white])
    for x in [*changes, columns]:
        out.append(color * (x - at))
        at, color, other = x, other, color
    return b"".join(out)


def fax_lines(data: bytes, params: Mapping[str, int] | None = None) -> Iterator[bytes]:
    """The lines of a fax stream, a byte (0 or 255) for each pixel; memory holds two lines.

    ``K`` below 0 (also if not given) is group 4, 0 is group 3 in one dimension, above 0 in both.
    White is 255 in group 4 and 0 in group 3, the other way round with ``BlackIs1``. No data give
    no lines. A line cut off is left out; group 4 ends at a bad mode once it has a line. A damaged
    line of group 3 is left out where ends of lines are promised, up to ``DamagedRowsBeforeError``
    in a row; more raise FilterError.
    """
    p = params or {}
    k, columns, most = int(p.get("K", -1)), int(p.get("Columns", 1728)), int(p.get("Rows", 0))
    ends, aligned, block = bool(p.get("EndOfLine", False)), bool(p.get("EncodedByteAlign", False)), bool(p.get("EndOfBlock", True))
    if columns < 1:
        raise FilterError("CCITTFaxDecode: no columns")
    white = 255 if (k < 0) != bool(p.get("BlackIs1", False)) else 0
    bits, above, lines, damaged, flat = _Bits(data), [], 0, 0, 0
    while not most or lines < most:
        if aligned:
            bits.align()
        marks = 0
        one = k == 0
        if k >= 0:
            while bits.skip_eol():
                marks += 1
                if k > 0 and ends:
                    one = bool(bits.peek(1))
                    bits.at += 1
                if block and marks > 1:
                    return
            if k > 0 and not (ends and marks):
                one = flat % (k + 1) == 0
        if bits.zeros() >= (24 if k < 0 else bits.end - bits.at) or bits.at + bits.zeros() >= bits.end or (k < 0 and bits.peek(24) == 0x001001):
            return
        try:
            above = _line_1d(bits, columns) if one else _line_2d(bits, above, columns)
        except FilterError:
            if k < 0 and lines or bits.end - bits.at < 13 and not any(data[bits.at // 8 + 1 :]):
                return
            if k < 0 or not ends or damaged >= int(p.get("DamagedRowsBeforeError", 0)):
                raise
            damaged += 1
            bits.find_eol()
            continue
        lines, damaged, flat = lines + 1, 0, flat + 1
        yield _pixels(above, columns, white)


def fax_decode(data: bytes, params: Mapping[str, int] | None = None) -> bytes:
    return b"".join(fax_lines(data, params))


def _changes(line: bytes, white: int) -> list[int]:
    before, out = white, []
    for x, v in enumerate(line):
        if v != before:
            out.append(x)
            before = v
    return out


def _run_code(n: int, color: int) -> str:
    code = CODES[color][2560] * (n // 2560)
    n %= 2560
    return code + (CODES[color][n // 64 * 64] if n >= 64 else "") + CODES[color][n % 64]


def _code_1d(changes: list[int], columns: int) -> str:
    edges = [0, *changes, columns]
    return "".join(_run_code(b - a, i % 2) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a or not i)


def _code_2d(changes: list[int], above: list[int], columns: int) -> str:
    out, a0, color, i, j = [], -1, 0, 0, 0
    n, m = len(changes), len(above)
    changes, above = [*changes, columns, columns], [*above, columns, columns]
    while a0 < columns:
        # The first changes to the other colour right of a0: a0 and i only go on, j may have to go back.
        while i < n and (changes[i] <= a0 or i % 2 != color):
            i += 1
        while j > 0 and above[j - 1] > a0:
            j -= 1
        while j < m and (above[j] <= a0 or j % 2 != color):
            j += 1
        a1, a2, b1, b2 = changes[i], changes[i + 1], above[j], above[j + 1]
        if b2 < a1:
            out.append(MODES["pass"])
            a0 = b2
        elif abs(a1 - b1) <= 3:
            out.append(MODES[a1 - b1])
            a0, color = a1, color ^ 1
        else:
            out.append(MODES["runs"] + _run_code(a1 - max(a0, 0), color) + _run_code(a2 - a1, color ^ 1))
            a0 = a2
    return "".join(out)


def fax_encode(lines: Iterable[bytes], params: Mapping[str, int] | None = None) -> bytes:
    """Lines of pixels as ``fax_lines`` gives them, coded with the same parameters."""
    p = params or {}
    k, columns = int(p.get("K", -1)), int(p.get("Columns", 1728))
    white = 255 if (k < 0) != bool(p.get("BlackIs1", False)) else 0
    out, above, held = bytearray(), [], ""
    ends, aligned = bool(p.get("EndOfLine", False)) and k >= 0, bool(p.get("EncodedByteAlign", False))

    def put(code: str, full: bool = False) -> None:
        nonlocal held
        held += code
        held += "0" * (-len(held) % 8 if full else 0)
        whole = len(held) // 8
        if whole:
            out.extend(int(held[: 8 * whole], 2).to_bytes(whole, "big"))
            held = held[8 * whole :]

    for n, line in enumerate(lines):
        changes = _changes(line, white)
        one = k == 0 or (k > 0 and n % (k + 1) == 0)
        put((EOL + ("" if k == 0 else "1" if one else "0") if ends else "") + (_code_1d(changes, columns) if one else _code_2d(changes, above, columns)), aligned)
        above = changes
    if p.get("EndOfBlock", True):
        put(EOL * 2 if k < 0 else (EOL + ("1" if k > 0 and ends else "")) * 6)
    put("", True)
    return bytes(out)
