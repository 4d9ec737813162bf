"""Byte-level functions: filters, values, files, text operators."""

import json
import sys
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.functions import assemble, filters
from leafmill.functions.objects import File, Hex, Name, Ref, Stream, json_text, plain, read_value, references, sections, serialize, targets, write_value
from leafmill.functions.text import hex_text, join_operators, literal_text, page_text, parse_cmap, text_operators


def text_of(content):
    f = File(content)
    return [page_text(f, p, i) for _, p, i in f.pages()]


def test_filter_cases():
    assert filters.run_length_decode(b"\x00a\x80") == b"a"
    assert filters.ascii_hex_decode(b"74657374>") == b"test"
    assert filters.ascii_hex_decode(b"7>") == b"p"
    assert filters.ascii85_decode(b"87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert filters.ascii85_decode(b"z~>") == bytes(4)
    assert filters.ascii85_decode(filters.ascii85_encode(b"\x00\x01\x02\x5c")) == b"\x00\x01\x02\x5c"
    assert all(filters.ascii85_decode(filters.ascii85_encode(bytes([i, j]))) == bytes([i, j]) for i in range(256) for j in range(256))
    assert filters.lzw_decode(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    with pytest.raises(filters.FilterError):
        filters.decode(b"", ["Nothing"])
    with pytest.raises(filters.FilterError):
        filters.flate_decode(b"no zlib")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600), st.lists(st.sampled_from(["FlateDecode", "RunLengthDecode", "ASCIIHexDecode", "ASCII85Decode", "LZWDecode"]), max_size=3))
def test_filters_round_trip(data, names):
    assert filters.decode(filters.encode(data, names), names) == data


def test_long_data_round_trip():
    import random

    rng = random.Random(1)
    for data in (bytes(rng.randrange(256) for _ in range(60_000)), bytes(rng.randrange(3) for _ in range(60_000)), b"ab" * 40_000, b"\0" * 70_000):
        for name in ("LZWDecode", "RunLengthDecode", "ASCII85Decode"):
            assert filters.decode(filters.encode(data, [name]), [name]) == data


def test_png_predictors():
    rows = bytes([1, 10, 1, 1]) + bytes([2, 1, 1, 1]) + bytes([0, 7, 8, 9]) + bytes([3, 1, 1, 1]) + bytes([4, 1, 0, 0])
    out = filters.undo_predictor(rows, 12, 3)
    assert out[:9] == bytes([10, 11, 12, 11, 12, 13, 7, 8, 9])
    assert len(out) == 15
    assert filters.undo_predictor(bytes([1, 1, 1, 5, 1, 1]), 2, 3) == bytes([1, 2, 3, 5, 6, 7])


@pytest.mark.parametrize(
    ("text", "value"),
    [(b"<< /A 1 /B [1 2 3 0 R .5 -2.] >>", {"A": 1, "B": [1, 2, Ref(3), 0.5, -2.0]}), (b"(a\\(b\\)(c)\\101)", b"a(b)(c)A"), (b"true", True), (b"null", None), (b"/Na#20me", Name("Na#20me"))],
)
def test_read_value(text, value):
    assert read_value(text, 0)[0] == value


def test_values_round_trip():
    value = {"A": [1, 2.5, True, None, Name("N"), Ref(3, 1), b"x(y)\\", Hex(b"\xfe\xff")], "D": {"E": -7}}
    assert read_value(write_value(value), 0)[0] == value


def test_sections():
    assert sections([0, 1, 2, 5, 6, 9]) == [(0, 3), (5, 2), (9, 1)]


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("compress", [False, True])
def test_create_and_extract(packed, compress):
    pages = [["Hello (World)!", "second"], [], ["äöü \\ end"]]
    content = assemble.text_document(pages, compress, packed=packed)
    # The two lines lie closer together than an operator is taken to be long, so no move is seen between them.
    assert text_of(content) == ["Hello (World)! second", "", "äöü \\ end"]


def test_newest_section_wins_and_cycles_end():
    base = serialize({1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3), Ref(2)], "Count": 1}, 3: {"Type": Name("Page")}}, {"Root": Ref(1)})
    start = base.rindex(b"xref\n0")
    update = base + b"3 0 obj\n<< /Type /Page /Rotate 90 >>\nendobj\n"
    at = len(update)
    update += b"xref\n3 1\n%010d 00000 n \ntrailer\n<< /Root 1 0 R /Size 4 /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (base.__len__(), start, at)
    assert [i.get("Rotate") for _, _, i in File(update).pages()] == [90]
    assert [i.get("Rotate") for _, _, i in File(update, oldest_wins=True).pages()] == [None]
    loop = update.replace(b"/Prev %d" % start, b"/Prev %d" % at)
    assert File(loop).get(3) == {"Type": "Page", "Rotate": 90}


def test_broken_files_are_rebuilt_or_empty():
    content = assemble.text_document([["kept"]], compress=False)
    cut = content[: content.rindex(b"xref\n0")]
    assert text_of(cut + b"trailer << /Root 1 0 R >>") == ["kept"]
    assert text_of(cut) == ["kept"]
    assert text_of(b"") == []
    assert text_of(b"%PDF-1.4 nonsense") == []


def test_xref_stream_widths():
    s = Stream({"W": [1, 2, 2], "Index": [5, 2], "Size": 7}, bytes.fromhex("01006400000100C80000"))
    entries, _ = File(b"")._table_stream(s)
    assert [(e.obj, e.offset) for e in entries] == [(5, 100), (6, 200)]


def test_literals_and_hex():
    assert literal_text(rb"a\nb\101c\(d\)") == "a\nbc(d)"
    assert literal_text(rb"\\n") == "\\\n"
    assert hex_text(b"FEFF00410042") == "AB"
    assert hex_text(b"4") == "@"
    assert hex_text(b"0001 02 ff", {(4, 1): "X", (2, 2): "Y"}) == "XY"


def test_cmap_ranges_overwrite():
    text = b"beginbfchar <01> <0041> <02> <0042> endbfchar beginbfrange <02> <03> <0061> <10> <12> [<0031> <0032>] endbfrange"
    assert parse_cmap(text) == {(2, 1): "A", (2, 2): "a", (2, 3): "b", (2, 16): "1", (2, 17): "2"}


def test_operators_fonts_and_separators():
    content = b"/F1 12 Tf (a) Tj /F2 9 Tf [(b) -200 (c) -50 (d)] TJ <41> Tj" + b" " * 60 + b"0 -14 Td (e) ' () Tj"
    ops = text_operators(content)
    assert [o["text"] for o in ops] == ["a", "b cd", "A", "e", ""]
    assert [o["active_font"] for o in ops] == ["F1", "F2", "F2", "F2", "F2"]
    assert join_operators(content, ops).startswith("a")
    assert text_operators(b"(x) Tj")[0]["active_font"] is None
    near = b"(a) Tj (b) Tj 1 0 Td" + b" " * 80
    assert join_operators(near, text_operators(near)) == "a b"
    exact = b"(a) Tj" + b" " * 44 + b"(b) Tj Td"
    assert join_operators(exact, text_operators(exact)) == "a b"


def test_long_literals():
    assert text_operators(b"(" + b"x" * 1_000_000 + b") Tj")[0]["text"] == "x" * 1_000_000


def test_split_prunes_and_merge_keeps_order():
    font = {"Type": Name("Font")}
    form = Stream({"Type": Name("XObject"), "Subtype": Name("Form")}, b"/F2 9 Tf")
    objects = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3)], "Count": 1, "Resources": Ref(8)},
        3: {"Type": Name("Page"), "Parent": Ref(2), "Contents": Ref(4), "Rotate": 90}, 4: Stream({}, b"/F1 1 Tf (hi) Tj /X Do"),
        5: font | {"N": 1}, 6: font | {"N": 2}, 7: font | {"N": 3}, 8: {"Font": {"F1": Ref(5), "F2": Ref(6), "F3": Ref(7)}, "XObject": {"X": Ref(9), "Y": Ref(9)}}, 9: form,
    }
    f = File(serialize(objects, {"Root": Ref(1)}))
    (_, page, inherited), = f.pages()
    one = File(assemble.single_page(f, page, inherited))
    (_, p, i), = one.pages()
    res = one.resolve(i["Resources"])
    assert sorted(res["Font"]) == ["F1", "F2"]
    assert sorted(res["XObject"]) == ["X"]
    assert "Rotate" not in p
    other = File(assemble.text_document([["a"], ["b"]]))
    both = assemble.merged([("x", f), ("y", other), ("x2", f)])
    assert text_of(both) == ["hi", "a", "b", "hi"]
    assert [i.get("Rotate") for _, _, i in File(both).pages()] == [90, None, None, 90]
    with pytest.raises(ValueError, match="no pages"):
        assemble.merged([])


def test_encrypted_flag_and_indirect_length():
    content = serialize({1: {"Type": Name("Catalog")}}, {"Root": Ref(1), "Encrypt": Ref(9)})
    assert "Encrypt" in File(content).trailer
    body = b"%PDF-1.4\n1 0 obj\n<< /Length 2 0 R >>\nstream\nendobj?\nendstream\nendobj\n2 0 obj\n7\nendobj\n"
    assert File(body).get(1).raw == b"endobj?"
    assert zlib.crc32(b"") == 0


# Steps that reading and making take ---------------------------------------------------------------


def steps(f) -> int:
    """The calls that ``f`` makes, of Python and C functions alike: what its time goes with, on any machine."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def pages_file(n: int, compress: bool = True) -> bytes:
    return assemble.text_document([[f"line {i}"] for i in range(n)], compress)


def test_a_page_is_made_in_few_steps():
    """pages differ in two numbers alone, so their dictionaries are not written value by value."""
    more, fewer = steps(lambda: pages_file(300)), steps(lambda: pages_file(100))
    assert (more - fewer) / 200 < 35
    assert File(pages_file(2)).get(5) == {"Type": Name("Page"), "Parent": Ref(2), "Contents": Ref(4), "Resources": {"Font": {"F1": Ref(3)}}}


def test_an_object_is_read_in_few_steps():
    """a key and its value are read with one match, a list of references with one, a table with one."""

    def read(n: int) -> int:
        content = pages_file(n, False)

        def all_objects():
            f = File(content)
            for k in f.entries:
                targets(f.get(k))

        return steps(all_objects)

    assert (read(300) - read(100)) / 200 < 130


def test_json_texts_are_written_in_one_step():
    """the same texts as of ``json.dumps``, without a copy of the value first."""
    value = {"Type": Name("Página"), "K": [Ref(3, 1), 1.5, None, True, b"a\xff\"", Hex(b"\1"), {}, [], -7], "": {"\"": Name("x")}}
    assert json_text(value) == json.dumps(plain(value))
    assert json_text(Stream(value, b"")) == json.dumps(plain(value))
    page = {"Type": Name("Page"), "Parent": Ref(2), "Resources": {"Font": {"F1": Ref(3)}}}
    assert steps(lambda: json_text(page)) < steps(lambda: json.dumps(plain(page)))


def test_tables_with_odd_lines_are_read_as_they_were():
    sound = pages_file(3)
    offsets = [(e.obj, e.gen, e.offset, e.free) for e in File(sound).all_entries]
    at = sound.index(b"xref\n0")
    for odd in (sound.replace(b" n \n", b" n\r\n"), sound.replace(b" n \n", b" n \n\n", 4), sound.replace(b" n \n", b"  n\n"), sound[:at] + sound[at:].replace(b"xref\n0 10\n", b"xref\n0 10 \r\n\n")):
        assert [(e.obj, e.gen, e.offset, e.free) for e in File(odd).all_entries] == offsets
    short = File(sound.replace(b"xref\n0 10\n", b"xref\n0 4\n"))
    assert [e.obj for e in short.all_entries] == [0, 1, 2, 3]


def test_references_are_found_without_their_paths():
    value = {"A": [Ref(1), {"B": Ref(2)}, [Ref(3)]], "C": Ref(4)}
    assert targets(value) == [r for _, r in references(value)] == [Ref(1), Ref(2), Ref(3), Ref(4)]
    assert targets(Stream(value, b"")) == targets(value)
