"""Headers and pixels of JPEG, PNG and GIF files, as image objects of a PDF file need them."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

from leafmill.functions.errors import ImageError


@dataclass
class Image:
    """Width and height in pixels, colour space, bits of a component, and the data with their filter."""

    w: int
    h: int
    cs: str
    bpc: int
    filter: str
    data: bytes
    params: dict = field(default_factory=dict)
    palette: bytes = b""
    masked: list[int] | None = None  # the colour that is see-through
    alpha: bytes | None = None  # a grey image of how solid each pixel is, coded like the data


# The markers that begin a JPEG frame, and a channel count's colour space.
_FRAMES = frozenset({0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF})
_SPACES = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}


def read_jpeg(data: bytes) -> Image:
    """The data go into the file as they are."""
    if data[:2] != b"\xff\xd8":
        raise ImageError("not a JPEG file")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ImageError("a JPEG marker is missing")
        mark = data[at + 1]
        if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD8:  # fill bytes and marks without a length
            at += 1 if mark == 0xFF else 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if mark in _FRAMES and at + 10 <= len(data):
            bits, h, w, channels = struct.unpack(">BHHB", data[at + 4 : at + 10])
            return Image(w, h, _SPACES.get(channels, "DeviceGray"), bits, "DCTDecode", data)
        at += 2 + size
    raise ImageError("a JPEG file without a frame")


def read_png(data: bytes) -> Image:
    """Image data go into the file as they are; an alpha channel is taken out into a mask of its own."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ImageError("not a PNG file")
    if data[12:16] != b"IHDR" or len(data) < 29:
        raise ImageError("a PNG file without a header")
    w, h, bits, kind, packing, filtering, interlace = struct.unpack(">IIBBBBB", data[16:29])
    space = {0: "DeviceGray", 2: "DeviceRGB", 3: "Indexed", 4: "DeviceGray", 6: "DeviceRGB"}.get(kind)
    for wrong, why in ((bits > 8, "16-bit depth is not supported"), (space is None, "unknown colour type"), (packing, "unknown compression"), (filtering, "unknown filter"), (interlace, "interlacing is not supported")):
        if wrong:
            raise ImageError(why)
    palette, masked, parts, at = b"", None, [], 33
    while at + 8 <= len(data):
        size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if name == b"PLTE":
            palette = body
        elif name == b"tRNS":
            # The low bytes of a grey or RGB value; of a palette the first entry that is wholly see-through.
            masked = [body[1]] if kind == 0 else [*body[1:6:2]] if kind == 2 else [body.index(0)] if 0 in body else masked
        elif name == b"IDAT":
            parts.append(body)
        elif name == b"IEND":
            break
        at += size + 12
    if space == "Indexed" and not palette:
        raise ImageError("a palette is missing")
    colors = 3 if space == "DeviceRGB" else 1
    image = Image(w, h, space, bits, "FlateDecode", b"".join(parts), {"Predictor": 15, "Colors": colors, "BitsPerComponent": bits, "Columns": w}, palette, masked)
    if kind in (4, 6):
        image.data, image.alpha = _split_alpha(image.data, w, h, colors)
    return image


def _split_alpha(data: bytes, w: int, h: int, colors: int) -> tuple[bytes, bytes]:
    """Lines of colours and of alpha; each line's filter goes for both, as it works on each channel alone."""
    import numpy as np

    try:
        raw = zlib.decompress(data)
    except zlib.error as e:
        raise ImageError(str(e)) from e
    step = (colors + 1) * w + 1
    if len(raw) < step * h:
        raise ImageError("image data are cut")
    lines = np.frombuffer(raw, np.uint8, step * h).reshape(h, step)
    pixels = lines[:, 1:].reshape(h, w, colors + 1)
    parts = (pixels[:, :, :colors].reshape(h, -1), pixels[:, :, colors])
    both = [zlib.compress(np.concatenate([lines[:, :1], p], axis=1).tobytes()) for p in parts]
    return both[0], both[1]


def read_gif(data: bytes) -> Image:
    """The first frame, as lines of palette numbers."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ImageError("not a GIF file")
    flags, at = data[10], 13
    palette = data[at : at + 3 * (2 << (flags & 7))] if flags & 0x80 else b""
    at += len(palette)
    masked = None
    while at < len(data):
        lead = data[at]
        if lead == 0x21:
            if data[at + 1] == 0xF9 and data[at + 3] & 1:
                masked = [data[at + 6]]
            _, at = _gif_blocks(data, at + 2)
        elif lead == 0x2C:
            w, h, own = struct.unpack("<HHB", data[at + 5 : at + 10])
            at += 10
            if own & 0x80:
                palette = data[at : at + 3 * (2 << (own & 7))]
                at += len(palette)
            body, _ = _gif_blocks(data, at + 1)
            pixels = _gif_pixels(body, data[at], w * h)
            rows = [pixels[i * w : (i + 1) * w] for i in range(h)]
            if own & 0x40:  # lines come in four passes
                order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                rows = [row for _, row in sorted(zip(order, rows, strict=True))]
            if not palette:
                raise ImageError("a palette is missing")
            lines = zlib.compress(b"".join(b"\0" + r for r in rows))
            return Image(w, h, "Indexed", 8, "FlateDecode", lines, {"Predictor": 15, "Colors": 1, "BitsPerComponent": 8, "Columns": w}, palette, masked)
        else:
            break
    raise ImageError("a GIF file without an image")


def _gif_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _gif_pixels(body: bytes, bits: int, most: int) -> bytes:
    """Codes from the low bit on; their width grows with the table up to twelve bits."""
    clear, out, table, width, before = 1 << bits, bytearray(), [], bits + 1, b""
    held = size = 0
    for byte in body:
        held, size = held | byte << size, size + 8
        while size >= width:
            code, held, size = held & ((1 << width) - 1), held >> width, size - width
            if code == clear + 1 or len(out) >= most:
                return bytes(out[:most].ljust(most, b"\0"))
            if code == clear or not table:
                table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, b""
                if code == clear:
                    continue
            if code < len(table):
                entry = table[code]
            elif before and code == len(table):
                entry = before + before[:1]
            else:
                raise ImageError("a code that is not in the table")
            out += entry
            if before and len(table) < 4096:
                table.append(before + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            before = entry
    return bytes(out[:most].ljust(most, b"\0"))


#: Parsers by type; a type is added by adding a function of the file's bytes.
PARSERS = {"jpg": read_jpeg, "jpeg": read_jpeg, "png": read_png, "gif": read_gif}


def image_type(name: str) -> str:
    """The type that a file's name ends in."""
    head, dot, tail = name.rpartition(".")
    if not dot or not head:
        raise ImageError(f"no extension: {name}")
    return tail.lower()


def read_image(data: bytes, kind: str) -> Image:
    parser = PARSERS.get(kind.lower())
    if not parser:
        raise ImageError(f"unsupported image type: {kind}")
    try:
        return parser(data)
    except (IndexError, struct.error) as e:
        raise ImageError(f"the file is cut: {e}") from e
