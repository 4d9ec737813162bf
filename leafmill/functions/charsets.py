"""Text to the bytes of a charset and back, in Spark's own functions where it has the charset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of charsets in files and elsewhere, and the codec of each.
NAMES = {
    "UTF-8": "utf-8", "UTF-16BE": "utf-16-be", "UTF-16": "utf-16-be", "WinAnsiEncoding": "cp1252", "Windows-1252": "cp1252", "MacRomanEncoding": "mac_roman", "MacRoman": "mac_roman",
    "ISO-8859-1": "latin-1", "Latin1": "latin-1", "PDFDocEncoding": "latin-1",
}
BOM = b"\xfe\xff"


def _codec(charset: str) -> str:
    if charset not in NAMES:
        raise ValueError(f"unsupported charset: {charset}")
    return NAMES[charset]


def encode_text(text: str, charset: str = "UTF-8") -> bytes:
    """The bytes of a PDF string: UTF-8 text that is not ASCII goes as UTF-16 after its mark; what a charset lacks is left out."""
    codec = _codec(charset)
    if codec == "utf-8" and text.isascii():
        return text.encode()
    if codec in ("utf-8", "utf-16-be"):
        return BOM + text.encode("utf-16-be", "surrogatepass")
    return text.encode(codec, "ignore")


def decode_text(data: bytes, charset: str = "UTF-8") -> str:
    """The text of a PDF string; a mark of UTF-16 goes before the charset named."""
    codec = _codec(charset)
    if data.startswith(BOM) and codec in ("utf-8", "utf-16-be"):
        return data[2:].decode("utf-16-be", "ignore")
    return data.decode(codec, "ignore")


def encode(text: Column, charset: str = "UTF-8") -> Column:
    """``encode_text`` of a column."""
    if _codec(charset) in ("utf-8", "utf-16-be"):
        marked = F.concat(F.lit(bytearray(BOM)), F.encode(text, "UTF-16BE"))
        return marked if _codec(charset) == "utf-16-be" else F.when(F.octet_length(text) == F.length(text), F.encode(text, "UTF-8")).otherwise(marked)

    @F.pandas_udf("binary")
    def run(values):
        return values.map(lambda t: None if t is None else encode_text(t, charset))

    return run(text)


def decode(data: Column, charset: str = "UTF-8") -> Column:
    """``decode_text`` of a column."""
    if _codec(charset) == "latin-1":
        return F.decode(data, "ISO-8859-1")

    @F.pandas_udf("string")
    def run(values):
        return values.map(lambda d: None if d is None else decode_text(d, charset))

    return run(data)


def convert(data: Column, source: str, target: str) -> Column:
    """Bytes of one charset as bytes of another, without marks; what the other lacks is left out."""
    if source == target:
        return data
    a, b = _codec(source), _codec(target)

    @F.pandas_udf("binary")
    def run(values):
        return values.map(lambda d: None if d is None else d.decode(a, "ignore").encode(b, "ignore"))

    return run(data)


def latin1_to_utf8(data: Column) -> Column:
    """The UTF-8 bytes of Latin-1 bytes."""
    return F.encode(F.decode(data, "ISO-8859-1"), "UTF-8")
