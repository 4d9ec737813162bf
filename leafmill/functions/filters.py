"""Stream filters of PDF files, decoding and encoding, as plain functions over bytes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Mapping, Sequence

from leafmill.functions.errors import FilterError
from leafmill.functions.fax import fax_decode


def flate_decode(data: bytes) -> bytes:
    d = zlib.decompressobj()
    try:
        return d.decompress(data) + d.flush()
    except zlib.error as e:
        raise FilterError(f"FlateDecode: {e}") from e


def run_length_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and (n := data[at]) != 128:
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


_RUN = re.compile(rb"(.)\1\1+", re.S)


def run_length_encode(data: bytes) -> bytes:
    """Runs of three to 128 equal bytes as repeats, all else in literals of at most 128 bytes."""
    out, at = bytearray(), 0

    def literals(upto: int) -> None:
        for i in range(at, upto, 128):
            part = data[i : min(i + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(data):  # what lies between is passed at once
        literals(m.start())
        byte, left = m[1], len(m[0])
        while left >= 3:
            n = min(left, 128)
            out.append(257 - n)
            out += byte
            left -= n
        at = m.end() - left
    literals(len(data))
    return bytes(out) + b"\x80"


def ascii_hex_decode(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">", 1)[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


_DIGITS85 = bytes(range(33, 118))


def ascii85_decode(data: bytes) -> bytes:
    digits = b"".join(data.split()).split(b"~", 1)[0]  # only the end mark has a tilde; > is a digit as well
    out, group = bytearray(), []
    if not digits.translate(None, _DIGITS85 + b"z") and not any(len(part) % 5 for part in digits.split(b"z")[:-1]):  # all whole groups at once
        import numpy as np

        digits = digits.replace(b"z", b"!!!!!")
        whole = len(digits) // 5 * 5
        values = (np.frombuffer(digits, np.uint8, whole).reshape(-1, 5).astype(np.uint64) - 33) @ np.array([85**4, 85**3, 85**2, 85, 1], np.uint64)
        out += (values & 0xFFFFFFFF).astype(">u4").tobytes()
        digits = digits[whole:]
    for c in digits:
        if c == 0x7A and not group:
            out += bytes(4)
            continue
        if not 33 <= c <= 117:
            raise FilterError("ASCII85Decode: a byte out of range")
        group.append(c - 33)
        if len(group) == 5:
            out += _base85(group)
            group = []
    if len(group) > 1:
        out += _base85(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _base85(group: Sequence[int]) -> bytes:
    value = 0
    for g in group:
        value = value * 85 + g
    return (value & 0xFFFFFFFF).to_bytes(4, "big")


_BYTES = [bytes([i]) for i in range(256)]


def lzw_decode(data: bytes, early: int = 1) -> bytes:
    table: list[bytes] = []
    out, width, bits, held, before = bytearray(), 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256 or not table:
            table, width, before = [*_BYTES, b"", b""], 9, b""
            if code == 256:
                continue
        if code < len(table):
            entry = table[code]
        elif before and code == len(table):
            entry = before + before[:1]
        else:
            raise FilterError("LZWDecode: a code that is not in the table")
        out += entry
        if before:
            table.append(before + entry[:1])
        before = entry
        while width < 12 and len(table) + early >> width > 0:
            width += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of nine to twelve bits; the table begins anew when it is full."""
    out, held, size = bytearray(), 256, 9
    table: dict[int, int] = {}  # the code of a string and the byte behind it, to the code of both
    width, following, now = 9, 258, -1
    for byte in data:
        if now < 0:
            now = byte
            continue
        key = now << 8 | byte
        if key in table:
            now = table[key]
            continue
        held, size = held << width | now, size + width
        if size > 256:
            whole, size = size >> 3, size & 7
            out += (held >> size).to_bytes(whole, "big")
            held &= (1 << size) - 1
        table[key] = following
        following += 1
        if following >> width and width < 12:
            width += 1
        if following == 4095:
            held, size = held << width | 256, size + width
            table, width, following = {}, 9, 258
        now = byte
    if now >= 0:
        held, size = held << width | now, size + width
        width = min(12, max(9, (following + 1).bit_length()))
    held, size = held << width | 257, size + width
    fill = -size % 8
    return bytes(out + (held << fill).to_bytes((size + fill) // 8, "big"))


def ascii85_encode(data: bytes) -> bytes:
    import base64

    return base64.a85encode(data) + b"~>"


def undo_predictor(data: bytes, predictor: int, columns: int = 1, colors: int = 1, bits: int = 8) -> bytes:
    """Reverses the TIFF (2, bytes only) and PNG (10 to 15) predictors."""
    if predictor < 2:
        return data
    step, width = max(1, colors * bits // 8), (columns * colors * bits + 7) // 8
    if predictor == 2:
        out = bytearray(data)
        for row in range(0, len(out), width):
            for i in range(row + step, min(row + width, len(out))):
                out[i] = (out[i] + out[i - step]) & 255
        return bytes(out)
    out, above = bytearray(), bytearray(width)
    for at in range(0, len(data), width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i, x in enumerate(row):
            left = row[i - step] if i >= step else 0
            up, corner = above[i], above[i - step] if i >= step else 0
            if kind == 1:
                x += left
            elif kind == 2:
                x += up
            elif kind == 3:
                x += (left + up) // 2
            elif kind == 4:
                x += min((left, up, corner), key=lambda v, p=left + up - corner: abs(p - v))
            row[i] = x & 255
        out += row
        above = row + bytearray(width - len(row))
    return bytes(out)


#: Names and short names of the filters.
DECODERS: dict[str, Callable[[bytes], bytes]] = {
    "FlateDecode": flate_decode,
    "Fl": flate_decode,
    "RunLengthDecode": run_length_decode,
    "RL": run_length_decode,
    "ASCIIHexDecode": ascii_hex_decode,
    "AHx": ascii_hex_decode,
    "ASCII85Decode": ascii85_decode,
    "A85": ascii85_decode,
    "LZWDecode": lzw_decode,
    "LZW": lzw_decode,
    "DCTDecode": bytes,
    "DCT": bytes,
    "JPXDecode": bytes,
    "CCITTFaxDecode": fax_decode,
    "CCF": fax_decode,
}
ENCODERS: dict[str, Callable[[bytes], bytes]] = {
    "FlateDecode": zlib.compress,
    "RunLengthDecode": run_length_encode,
    "ASCIIHexDecode": lambda data: data.hex().upper().encode() + b">",
    "ASCII85Decode": ascii85_encode,
    "LZWDecode": lzw_encode,
    "DCTDecode": bytes,
    "CCITTFaxDecode": bytes,
}


def decode(data: bytes, filters: Sequence[str], params: Sequence[Mapping[str, int] | None] = ()) -> bytes:
    """Applies the filters from left to right, each with its predictor."""
    for i, name in enumerate(filters):
        if name not in DECODERS:
            raise FilterError(f"unknown filter {name}")
        own = (params[i] if i < len(params) else None) or {}
        if name in ("LZWDecode", "LZW"):
            data = lzw_decode(data, int(own.get("EarlyChange", 1)))
        elif name in ("CCITTFaxDecode", "CCF"):
            data = fax_decode(data, own)
            continue
        else:
            data = DECODERS[name](data)
        data = undo_predictor(data, int(own.get("Predictor", 1)), int(own.get("Columns", 1)), int(own.get("Colors", 1)), int(own.get("BitsPerComponent", 8)))
    return data


def encode(data: bytes, filters: Sequence[str]) -> bytes:
    """Encodes so that ``decode`` with the same filters gives the data back."""
    for name in reversed(filters):
        if name not in ENCODERS:
            raise FilterError(f"cannot encode {name}")
        data = ENCODERS[name](data)
    return data
