"""Fax streams: code tables, hand-made lines, and round trips of all kinds."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.functions import fax, filters
from leafmill.operators import bitmap
from leafmill.plans import queries


def test_code_tables_are_complete():
    for codes in fax.CODES:
        assert len(codes) == len(set(codes.values())) == 104
        # Every string of bits begins with one code, but those that begin like an end of line.
        assert sum(2.0 ** -len(c) for c in codes.values()) == 1 - 2**-8


def test_hand_made_lines():
    v0 = bytes([0b10000000])
    assert fax.fax_decode(v0 + bytes(4), {"Columns": 8}) == b"\xff" * 8
    # One dimension: 3 white (1000), 5 black (0011).
    assert fax.fax_decode(bytes([0b10000011]), {"K": 0, "Columns": 8, "Rows": 1}) == bytes(3) + b"\xff" * 5
    assert fax.fax_decode(bytes([0b10000011]), {"K": 0, "Columns": 8, "Rows": 1, "BlackIs1": True}) == b"\xff" * 3 + bytes(5)
    assert fax.fax_decode(b"") == b""
    assert filters.decode(v0 + bytes(4), ["CCITTFaxDecode"], [{"Columns": 8}]) == b"\xff" * 8
    with pytest.raises(filters.FilterError):
        fax.fax_decode(b"\x01\xff\xff", {"Columns": 8})


def test_damaged_line_is_left_out():
    p = {"K": 0, "Columns": 8, "EndOfLine": True, "DamagedRowsBeforeError": 1, "EncodedByteAlign": True}
    lines = [bytes(8), b"\xff" * 8, bytes(4) + b"\xff" * 4]
    parts = [fax.fax_encode([x], p | {"EndOfBlock": False}) for x in lines]
    bad = bytes([0, 0x10, 0x0F])  # after the end of line comes no run
    assert list(fax.fax_lines(parts[0] + bad + parts[2], p)) == [lines[0], lines[2]]
    with pytest.raises(filters.FilterError):
        fax.fax_decode(parts[0] + bad + parts[2], p | {"DamagedRowsBeforeError": 0})


@settings(max_examples=300, deadline=None)
@given(
    st.integers(1, 70).flatmap(lambda w: st.lists(st.lists(st.booleans(), min_size=w, max_size=w), min_size=1, max_size=8)),
    st.sampled_from([-1, 0, 1, 3]),
    st.booleans(),
    st.booleans(),
    st.booleans(),
)
def test_round_trip(rows, k, ends, aligned, black):
    p = {"K": k, "Columns": len(rows[0]), "EndOfLine": ends, "EncodedByteAlign": aligned, "BlackIs1": black}
    lines = [bytes(255 * x for x in r) for r in rows]
    assert list(fax.fax_lines(fax.fax_encode(lines, p), p)) == lines


@pytest.mark.parametrize("k", [-1, 0, 2])
def test_long_runs(k):
    p = {"K": k, "Columns": 6000}
    lines = [bytes(6000), b"\xff" * 6000, bytes(1) + b"\xff" * 5998 + bytes(1), (bytes(1700) + b"\xff" * 100) * 3 + bytes(600)]
    assert list(fax.fax_lines(fax.fax_encode(lines, p), p)) == lines


def test_lines_of_streams(spark, tmp_path):
    params = {"K": 0, "Columns": 12}
    lines = [bytes(5) + b"\xff" * 7, b"\xff" * 12]
    table = spark.createDataFrame([(1, fax.fax_encode(lines, params), params), (2, None, None), (3, b"", params)], "id long, data binary, params map<string,int>")
    want = [(1, 0, b"\x07\xf0"), (1, 1, b"\xff\xf0")]
    assert sorted((r.id, r.line, bytes(r.bits)) for r in bitmap.fax_lines(table).collect()) == want
    table.write.parquet(str(tmp_path / "in"))
    stream = bitmap.fax_lines(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("faxes").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.id, r.line, bytes(r.bits)) for r in spark.table("faxes").collect()) == want


def test_table_of_one_row_group_is_dealt_out(spark):
    streams = queries.QUERIES["fax_lines"](spark, "/root/testdata/sf0.001")
    assert streams.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=90, max_size=90), min_size=2, max_size=6))
def test_two_dimensional_codes_are_those_of_the_first_changes(rows):
    """The code's own definition, with a search from the line's start for each mode."""
    above: list[int] = []
    for row in rows:
        changes = fax._changes(bytes(255 * x for x in row), 255)
        out, a0, color = [], -1, 0
        while a0 < 90:
            a1, a2 = [*[x for i, x in enumerate(changes) if i >= next((i for i, x in enumerate(changes) if x > a0 and i % 2 == color), 99)], 90, 90][:2]
            b1, b2 = [*[x for i, x in enumerate(above) if i >= next((i for i, x in enumerate(above) if x > a0 and i % 2 == color), 99)], 90, 90][:2]
            if b2 < a1:
                out.append(fax.MODES["pass"])
                a0 = b2
            elif abs(a1 - b1) <= 3:
                out.append(fax.MODES[a1 - b1])
                a0, color = a1, 1 - color
            else:
                out.append(fax.MODES["runs"] + fax._run_code(a1 - max(a0, 0), color) + fax._run_code(a2 - a1, 1 - color))
                a0 = a2
        assert fax._code_2d(changes, above, 90) == "".join(out)
        above = changes
