"""Bitmaps as relations of pixels and of packed bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import fax

#: Fax lines are sent on once they hold so many pixels.
BATCH_PIXELS = 1 << 22
_DIGITS = bytes(49 if i else 48 for i in range(256))
_PIXELS = bytes(255 * (i == 49) for i in range(256))


def pack(pixels: DataFrame) -> DataFrame:
    """(line, place, byte) of (line, col, bit): eight pixels to a byte, the first in the highest bit."""
    value = F.when(F.col("bit"), F.expr("shiftleft(1, cast(7 - col % 8 as int))")).otherwise(0)
    return pixels.groupBy("line", F.floor(F.col("col") / 8).cast("long").alias("place")).agg(F.sum(value).alias("byte"))


def unpack(packed: DataFrame, width: int) -> DataFrame:
    """(line, col, bit) of packed bytes, ``width`` pixels to a line."""
    bits = packed.select("line", "place", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    rows = bits.select("line", (F.col("place") * 8 + F.col("i")).alias("col"), F.expr("(shiftright(byte, 7 - i) & 1) = 1").alias("bit"))
    return rows.where(F.col("col") < width)


def invert(line: Column) -> Column:
    return F.transform(line, lambda x: 255 - x)


def packed_size(width: Column, height: Column) -> Column:
    return F.ceil(width / 8) * height


def fax_lines(streams: DataFrame, data: str = "data", params: str = "params") -> DataFrame:
    """The columns of ``streams`` with (line, bits) in place of ``data`` and ``params``: a row for each fax line.

    ``params`` maps the names of fax parameters to numbers. Pixels are packed, 255 as 1, with zeros
    up to the byte. Works line by line, on tables and on streams alike. Null data give no rows.
    """
    kept = [f for f in streams.schema.fields if f.name not in (data, params)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "line long, bits binary"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, lines, packed, held = [], [], [], 0

            def take(batch=batch, rows=rows, lines=lines, packed=packed):
                own = [batch.column(f.name).take(pa.array(rows, pa.int64())) for f in kept]
                columns = [*own, pa.array(lines, pa.int64()), pa.array(packed, pa.binary())]
                return pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "line", "bits"])

            for i, (stream, named) in enumerate(zip(batch.column(data).to_pylist(), batch.column(params).to_pylist(), strict=True)):
                for n, pixels in enumerate(fax.fax_lines(stream or b"", dict(named or {}))):
                    rows.append(i)
                    lines.append(n)
                    packed.append(pack_line(pixels))
                    held += len(pixels)
                    if held > BATCH_PIXELS:
                        yield take()
                        held = 0
                        for column in (rows, lines, packed):
                            column.clear()
            yield take()

    return streams.mapInArrow(run, schema)


def pack_line(pixels: bytes) -> bytes:
    """Eight pixels to a byte, the first in the highest bit."""
    digits = pixels.translate(_DIGITS).ljust(-(-len(pixels) // 8) * 8, b"0")
    return int(digits or b"0", 2).to_bytes(len(digits) // 8, "big")


def unpack_line(bits: bytes, width: int) -> bytes:
    """The pixels, 0 or 255, of a packed line."""
    return f"{int.from_bytes(bits, 'big'):0{8 * len(bits)}b}".encode()[:width].translate(_PIXELS)
