"""Damaged files, updates, charsets, images, layout and SQL names."""

import struct
import sys
import time
import zlib

import pytest
from pyspark.sql import functions as F

from leafmill import sql
from leafmill.functions import assemble, charsets, filters, fonts, images, scalar
from leafmill.functions.objects import File, Name, Ref, Stream, last_startxref, read_value, references, serialize
from leafmill.functions.text import page_text, parse_cmap, units_text
from leafmill.operators import documents, render
from leafmill.plans import queries
from leafmill.plans.queries import _jpeg, _png
from leafmill.sources import write_files
from leafmill.sources.ranges import read_ranges


def texts_of(content):
    f = File(content)
    return [page_text(f, p, i) for _, p, i in f.pages()]


# Values and files ----------------------------------------------------------------------------------


def test_values_of_any_depth():
    n = 20 * sys.getrecursionlimit()
    value, end = read_value(b"[" * n + b"7" + b"]" * n, 0)
    assert end == 2 * n + 1
    depth = 0
    while isinstance(value, list):
        value, depth = value[0], depth + 1
    assert (value, depth) == (7, n)
    nested, _ = read_value(b"<</K " * n + b"3 0 R" + b">>" * n, 0)
    assert [r.obj for _, r in references(nested)] == [3]
    assert read_value(b"<</A [1 2 /B 3", 0)[0] == {"A": [1, 2, Name("B"), 3]}
    assert read_value(b"<</A 1 /B>>", 0)[0] == {"A": 1, "B": None}
    with pytest.raises(ValueError, match="no value"):
        read_value(b"  % only a comment", 0)


def test_chains_of_references_have_no_limit_and_cycles_end():
    chain = {n: Ref(n + 1) for n in range(10, 110)} | {110: b"end", 200: Ref(201), 201: Ref(200)}
    f = File(serialize({1: {"Type": Name("Catalog")}} | chain, {"Root": Ref(1)}))
    assert f.resolve(Ref(10)) == b"end"
    assert f.resolve(Ref(200)) is None


def test_forms_of_any_depth_are_followed():
    objects = {1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3)], "Count": 1}}
    forms = {f"X{k}": Ref(10 + k) for k in range(30)}
    objects[3] = {"Type": Name("Page"), "Contents": Ref(4), "Resources": {"XObject": forms, "Font": {"F9": Ref(5)}}}
    objects |= {4: Stream({}, b"/X0 Do"), 5: {"Type": Name("Font")}}
    objects |= {10 + k: Stream({"Subtype": Name("Form")}, b"/X%d Do" % (k + 1) if k < 29 else b"/F9 8 Tf") for k in range(30)}
    f = File(serialize(objects, {"Root": Ref(1)}))
    ((_, page, inherited),) = f.pages()
    assert assemble.used_names(f, page, inherited["Resources"]) == {"Font": {"F9"}, "XObject": set(forms)}


def test_last_startxref():
    assert last_startxref(b"startxref 5 ... startxref\n17\n%%EOF") == 17
    assert last_startxref(b"startxref 5 startxref none") == 5
    assert last_startxref(b"nothing") is None


def test_page_counts_fall_back():
    def made(root, tail=b""):
        return File(serialize({1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 2: {"Type": Name("Pages")} | root}, {"Root": Ref(1)}) + tail).page_counts()

    assert made({"Count": 7}) == (0, 7, 7)
    assert made({"Kids": [Ref(9), Ref(8)]}) == (0, 2, 1)
    assert made({}) == (0, 0, 1)
    assert made({}, b"/Count 12") == (0, 0, 12)
    assert File(b"").page_counts() == (0, 0, 1)


def test_updates_and_added_pages():
    base = assemble.text_document([["a"], ["b"]])
    f = File(base)
    turned = assemble.updated(base, {n: page | {"Rotate": 180} for n, page, _ in f.pages()})
    assert turned.startswith(base)
    assert [i.get("Rotate") for _, _, i in File(turned).pages()] == [180, 180]
    assert texts_of(turned) == ["a", "b"]
    more = assemble.appended(turned, assemble.text_document([["c"]], packed=True))
    assert texts_of(more) == ["a", "b", "c"]
    assert File(more).page_counts() == (3, 3, 3)
    assert texts_of(assemble.appended(more, assemble.text_document([["d"]]))) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError, match="no page tree"):
        assemble.appended(serialize({1: {"Type": Name("Catalog")}}, {"Root": Ref(1)}), base)


def test_merging_keeps_what_is_asked_for():
    note = {"Type": Name("Annot"), "Rect": [0, 0, 1, 1]}
    one = serialize({1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3)], "Count": 1}, 3: {"Type": Name("Page"), "MediaBox": [0, 0, 5, 6], "Annots": [note], "Rotate": 90}}, {"Root": Ref(1)})
    bare = serialize({1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3)], "Count": 1}, 3: {"Type": Name("Page"), "Contents": Ref(9)}}, {"Root": Ref(1)})
    pages = [(k, f, page, inherited) for k, f in enumerate([File(one), File(bare)]) for _, page, inherited in f.pages()]
    plain, noted = (File(assemble.merged_pages(pages, notes=n)) for n in (False, True))
    assert [i["MediaBox"] for _, _, i in plain.pages()] == [[0, 0, 5, 6]] * 2  # the first page's box
    assert ["Annots" in p for _, p, _ in plain.pages()] == [False, False]
    assert ["Annots" in p for _, p, _ in noted.pages()] == [True, False]
    assert assemble.unique_names([["F1", "Im"], ["F1", "F2"], ["F1", "F1_1"]]) == [{"F1": "F1", "Im": "Im"}, {"F1": "F1_1", "F2": "F2"}, {"F1": "F1_2", "F1_1": "F1_1_1"}]


@pytest.fixture(scope="module")
def bad(spark):
    good = assemble.text_document([["one"], ["two"]])
    corrupt = good.replace(b"stream\nx\x9c", b"stream\nzz", 1)
    deep = good.replace(b"1 0 obj\n", b"1 0 obj\n" + b"[" * 5000 + b"]" * 5000 + b"\nendobj\n1 0 obj\n", 1)
    rows = [(1, good), (2, corrupt), (3, b""), (4, None), (5, b"[" * 9000), (6, deep), (7, good.replace(b"trailer\n<<", b"trailer\n<</Encrypt 9 0 R ")), (8, b"%PDF-1.4\nxref\n0 99999999\ntrailer<</Root 1 0 R/Size (x)>>startxref\n9"), (9, good[: len(good) // 2])]
    return spark.createDataFrame([(i, None if c is None else bytearray(c), i % 2, i) for i, c in rows], "doc_id long, content binary, g long, o long").repartition(2)


def test_no_bad_file_fails_a_scan(spark, bad):
    for scan in (documents.pdf_documents, documents.pdf_page_counts, documents.pdf_headers, documents.pdf_text, lambda f: documents.pdf_one_page(f, 1)):
        assert scan(bad).count() == 9
    for scan in (documents.pdf_xref, documents.pdf_objects, documents.pdf_refs, documents.pdf_pages, documents.pdf_page_text, documents.pdf_text_ops, documents.pdf_contents, documents.pdf_fonts, documents.pdf_used_names, documents.pdf_reachable, documents.split_pages):
        assert scan(bad).where("doc_id = 1").count() > 0
    assert {r.doc_id: r.text for r in documents.pdf_text(bad).collect()} == {1: "one\ntwo", 2: "two", 3: "", 4: "", 5: "", 6: "one\ntwo", 7: "", 8: "", 9: "one"} | {6: documents.pdf_text(bad.where("doc_id = 6")).first().text}
    errors = {(r.doc_id, r.part, r.page_no) for r in documents.pdf_errors(bad).collect()}
    assert {(2, "page", 1), (3, "file", None), (4, "file", None), (7, "file", None)} <= errors
    assert not [e for e in errors if e[0] == 1]
    parts = {(r.doc_id, r.page_no): (r.content is None, r.error) for r in documents.split_pages(bad).collect()}
    assert parts[1, 2] == (False, None)
    missing = documents.split_pages(bad.where("doc_id in (1, 3)"), 2, 4, strict=True).where("error is not null")
    assert {(r.doc_id, r.page_no) for r in missing.collect()} == {(1, 3), (3, 2)}
    merged = {r.g: r for r in documents.merge(bad, "g", "o").collect()}
    assert texts_of(bytes(merged[1].content))[:2] == ["one", "two"]
    assert "input 1: no pages" in merged[1].error
    empty = documents.merge(bad.where("doc_id in (3, 4)"), "g", "o").collect()
    assert all(r.content is None and "no pages" in r.error for r in empty)


def test_relations_of_objects(spark):
    tree = assemble.tree_document([(b"(a) Tj", {}), (b"(b) Tj", {}), (b"(c) Tj", {})], {"MediaBox": [0, 0, 9, 9]}, fanout=2)
    flat = assemble.text_document([["x"], ["y"]])
    freed = assemble.updated(flat, {4: None})
    freed = freed[: freed.rindex(b" n ")] + b" f " + freed[freed.rindex(b" n ") + 3 :]
    files = spark.createDataFrame([(1, bytearray(tree)), (2, bytearray(flat)), (3, bytearray(freed))], "doc_id long, content binary")
    assert {r.doc_id: r["count"] for r in documents.pdf_pages(files, deep=False).groupBy("doc_id").count().collect()} == {2: 2, 3: 2}
    assert {r.doc_id: r["count"] for r in documents.pdf_pages(files).groupBy("doc_id").count().collect()} == {1: 3, 2: 2, 3: 2}
    assert 4 in {r.obj for r in documents.live(documents.pdf_xref(files)).where("doc_id = 2").collect()}
    assert 4 not in {r.obj for r in documents.live(documents.pdf_xref(files)).where("doc_id = 3").collect()}
    links = documents.resolved(documents.pdf_refs(files), documents.pdf_objects(files)).collect()
    assert {(r.src_obj, r.key, r.dst_type) for r in links if r.doc_id == 2 and r.key in ("/Pages", "/Parent")} == {(1, "/Pages", "Pages"), (5, "/Parent", "Pages"), (7, "/Parent", "Pages")}
    assert [r.dst_value for r in links if r.doc_id == 3 and r.dst_obj == 4] == [None]
    counted = documents.map_pages(files, lambda i, text: i * len(text), "long").collect()
    assert sorted((r.doc_id, r.page_no, r.result) for r in counted if r.doc_id == 1) == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]
    rows = spark.createDataFrame([(bytearray(b"61>"), ["ASCIIHexDecode"]), (bytearray(b"x"), ["Nothing"]), (None, ["RL"]), (bytearray(b"raw"), None)], "d binary, f array<string>")
    got = [(r.x.data and bytes(r.x.data), r.x.error) for r in rows.select(documents.decoded_or_error(F.col("d"), F.col("f")).alias("x")).collect()]
    assert got == [(b"a", None), (None, "unknown filter Nothing"), (None, None), (b"raw", None)]


def test_bitmap_columns(spark):
    from leafmill.operators import bitmap

    row = spark.createDataFrame([([0, 255, 7], 18, 3)], "line array<int>, w int, h int")
    out = row.select(bitmap.invert(F.col("line")).alias("i"), bitmap.packed_size(F.col("w"), F.col("h")).alias("s")).first()
    assert (list(out.i), out.s) == ([255, 0, 248], 9)
    assert bitmap.unpack_line(bitmap.pack_line(b"\xff\0\xff" * 7), 21) == b"\xff\0\xff" * 7


def test_documents_without_text_keep_their_rows(spark):
    files = documents.create(spark.createDataFrame([(1, "a\n\nb"), (2, ""), (3, None)], "doc_id long, text string"))
    files = files.union(spark.createDataFrame([(4, bytearray(b""))], "doc_id long, content binary"))
    texts = documents.document_text(documents.pdf_page_text(files), files)
    assert {r.doc_id: r.text for r in texts.collect()} == {1: "a\nb", 2: "", 3: "", 4: ""}
    assert {r.doc_id: r.text for r in documents.pdf_one_page(files, 3).collect()} == {1: "b", 2: "", 3: "", 4: ""}
    assert [r.text for r in documents.pdf_page_text(files.where("doc_id = 1"), tail=2).orderBy("page_no").collect()] == ["", "b"]
    assert [r.page_no for r in documents.pdf_page_text(files.where("doc_id = 1"), only=[3, 9, 1]).orderBy("page_no").collect()] == [1, 3]
    sizes = files.select("doc_id", documents.buffered(F.length("content"), F.lit(1), F.lit(10)).alias("b"), documents.buffered(F.lit(10 << 20), F.lit(1), F.lit(10)).alias("c"), documents.buffered(F.lit(10 << 20), F.lit(6), F.lit(10)).alias("d"))
    assert {(r.b, r.c, r.d) for r in sizes.collect()} == {(True, False, True)}


def test_rows_of_large_files_go_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(documents, "ROWS_AT_ONCE", 7)
    files = documents.create(spark.createDataFrame([(i, "\n".join(f"p{i} {k}" for k in range(20 + i))) for i in range(5)], "doc_id long, text string"))
    assert documents.pdf_page_text(files).count() == sum(20 + i for i in range(5))
    monkeypatch.setattr(documents, "BYTES_AT_ONCE", 10)
    parts = documents.split_pages(files).collect()
    assert {(r.doc_id, r.page_no): texts_of(bytes(r.content)) for r in parts} == {(i, k + 1): [f"p{i} {k}"] for i in range(5) for k in range(20 + i)}


def test_deep_graphs_are_walked_to_the_end(spark):
    from leafmill.sources import shared_checkpoints

    shared_checkpoints(spark)
    refs = spark.createDataFrame([(1, k, k + 1) for k in range(70)], "doc_id long, src_obj long, dst_obj long")
    assert documents.reachable(refs, spark.createDataFrame([(1, 0)], "doc_id long, obj long")).count() == 71


# Texts beyond Latin-1 ------------------------------------------------------------------------------


@pytest.mark.parametrize("packed", [False, True])
def test_every_character_comes_back(packed):
    lines = ["plain", "ж漢字 é €", "🙂 𝒳", "(a\\b)", "İ ʼ"]
    assert texts_of(assemble.text_document([[x] for x in lines], packed=packed)) == lines


def test_code_maps():
    codes = fonts.codes_for(["ab€", "🙂b"])
    assert sorted(codes) == list(codes) and set(codes.values()) == {1, 2, 3, 4}
    read = parse_cmap(fonts.to_unicode(codes))
    assert {text: code for (_, code), text in read.items()} == codes
    many = fonts.codes_for([chr(0x4E00 + i) for i in range(250)])
    assert len(parse_cmap(fonts.to_unicode(many))) == 250
    assert units_text(b"\xd8\x3d\xde\x42\x00A") == "🙂A"
    assert units_text(b"\xd8\x3d\x00A") == "A"
    whole = parse_cmap(b"beginbfrange <0000> <1FFFF> <0000> endbfrange")
    assert len(whole) == 0x20000


def test_charsets(spark):
    rows = spark.createDataFrame([(0, "Grüße € – ñ"), (1, "plain"), (2, None), (3, "漢 a")], "i long, t string")
    for charset in ("UTF-8", "UTF-16BE", "WinAnsiEncoding", "MacRoman", "Latin1", "PDFDocEncoding"):
        coded = charsets.encode(F.col("t"), charset)
        for r in rows.select("t", coded.alias("c"), charsets.decode(coded, charset).alias("d")).collect():
            if r.t is None:
                assert r.c is None and r.d is None
                continue
            assert bytes(r.c) == charsets.encode_text(r.t, charset)
            assert r.d == charsets.decode_text(bytes(r.c), charset)
            codec = charsets.NAMES[charset]
            assert r.d == (r.t if codec.startswith("utf") else r.t.encode(codec, "ignore").decode(codec))
    assert charsets.encode_text("€", "Windows-1252") == b"\x80"
    assert charsets.encode_text("é", "MacRoman") == b"\x8e"
    assert charsets.encode_text("é") == b"\xfe\xff\x00\xe9"
    moved = rows.where("i = 0").select(charsets.convert(charsets.encode(F.col("t"), "Windows-1252"), "Windows-1252", "MacRoman").alias("m"), charsets.latin1_to_utf8(F.lit(bytearray(b"\xe9"))).alias("u")).first()
    assert bytes(moved.m).decode("mac_roman") == "Grüße € – ñ"
    assert bytes(moved.u) == "é".encode()
    with pytest.raises(ValueError, match="unsupported charset"):
        charsets.encode_text("a", "EBCDIC")


# Scalars -------------------------------------------------------------------------------------------


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalar_functions(spark):
    ts = F.lit("2024-02-03 04:05:06").cast("timestamp")
    assert one(spark, scalar.pdf_date(ts)) == "D:20240203040506+00'00'"
    assert one(spark, scalar.pdf_date(ts, "Asia/Kolkata")) == "D:20240203093506+05'30'"
    assert one(spark, scalar.pdf_date(ts, "America/St_Johns")) == "D:20240203003506-03'30'"
    assert one(spark, scalar.scale_factor(F.lit("Inch"))) == 72
    assert one(spark, scalar.scale_factor(F.lit("mile"))) is None
    assert one(spark, scalar.page_size(F.lit("A4"), F.lit("in")))["width"] == pytest.approx(595.28 / 72)
    assert one(spark, scalar.page_size(F.lit("b9"))) is None
    assert tuple(one(spark, scalar.upright(F.lit(9), F.lit(4)))) == (4, 9)
    box = F.array(*map(F.lit, (10.0, 20.0, 110.0, 70.0)))
    assert (one(spark, scalar.box_width(box)), one(spark, scalar.box_height(box))) == (100, 50)
    assert bytes(one(spark, scalar.text_string(F.lit("a(b)\\")))) == b"(a\\(b\\)\\\\)"
    assert bytes(one(spark, scalar.text_string(F.lit("é(")))) == b"(\xfe\xff\x00\xe9\x00\\()"
    assert one(spark, scalar.http_parameter("f", F.lit("a b"))) == 'f="a b"'
    assert one(spark, scalar.http_parameter("f", F.lit("é ~*"))) == "f*=UTF-8''%C3%A9%20~%2A"
    for n, shown in ((0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (-(5 << 30), "-5 GB"), (3 << 50, "3072 TB")):
        assert one(spark, scalar.format_bytes(F.lit(n))) == shown
    assert one(spark, scalar.near(F.lit(bytearray(b"x" * 300 + b"stream" + b"x" * 300)), F.lit(250), "stream")) == 300
    assert one(spark, scalar.near(F.lit(bytearray(b"x" * 300 + b"stream")), F.lit(10), "stream")) is None
    assert one(spark, scalar.rename_resource(F.lit("/F1 9 Tf /F11 9 Tf /F1 Do"), "F1", "G$1")) == "/G$1 9 Tf /F11 9 Tf /G$1 Do"
    assert one(spark, scalar.rename_resource(F.lit("/A.B x /AxB x"), "A.B", "C")) == "/C x /AxB x"
    assert one(spark, scalar.replace_text(F.lit("/F1 /F11"), {"/F1": "/G", "/F11": "/H"})) == "/G /H"


def test_dictionaries_and_arrays(spark):
    value = F.lit('{"Type":"/Page","Kids":[1,{"$ref":[3,0]},"/N"],"None":null}')
    assert one(spark, scalar.entry(value, "Type")) == "/Page"
    assert one(spark, scalar.entry(value, "Gone")) is None
    assert one(spark, scalar.has_entry(value, "None")) is True
    assert one(spark, scalar.has_entry(F.lit("[1]"), "Type")) is False
    kids = scalar.entry(value, "Kids")
    assert one(spark, scalar.count_items(kids)) == 3
    assert one(spark, scalar.item(kids, 1)) == '{"$ref":[3,0]}'
    assert one(spark, scalar.item(kids, 7)) is None
    assert one(spark, scalar.with_item(kids, 0, F.lit('"x"'))) == '["x",{"$ref":[3,0]},"/N"]'
    assert one(spark, scalar.added(kids, F.lit("9"))) == '[1,{"$ref":[3,0]},"/N",9]'
    assert one(spark, scalar.entry(scalar.with_entry(value, "Type", F.lit('"/Pages"')), "Type")) == "/Pages"
    assert one(spark, scalar.has_entry(scalar.without_entry(value, "Type"), "Type")) is False


# Images --------------------------------------------------------------------------------------------


def test_png_files():
    grey, rgb, indexed, alpha, rgba = (images.read_image(_png(5, 4, k), "png") for k in (0, 2, 3, 4, 6))
    assert [(i.w, i.h, i.cs) for i in (grey, rgb, indexed)] == [(5, 4, "DeviceGray"), (5, 4, "DeviceRGB"), (5, 4, "Indexed")]
    assert indexed.palette == bytes(range(30))
    assert (grey.alpha, len(zlib.decompress(alpha.alpha)), len(zlib.decompress(rgba.data))) == (None, 4 * 6, 4 * 16)
    raw = zlib.decompress(zlib.compress(b"".join(b"\0" + bytes((x * 7 + y) % 256 for x in range(20)) for y in range(4))))
    assert zlib.decompress(rgba.alpha)[1:6] == raw[1:21][3::4]
    header = struct.pack(">IIBBBBB", 1, 1, 16, 0, 0, 0, 0)
    for broken, why in ((b"GIF", "not a PNG"), (_png(2, 2, 0)[:16] + header + _png(2, 2, 0)[29:], "16-bit"), (_png(2, 2, 0)[:28] + b"\1" + _png(2, 2, 0)[29:], "interlacing")):
        with pytest.raises(images.ImageError, match=why):
            images.read_png(broken)


def test_jpeg_and_gif_files():
    assert [(i.w, i.h, i.cs, i.bpc, i.filter) for i in (images.read_image(_jpeg(7, 9, c), "JPEG") for c in (1, 3, 4))] == [(7, 9, c, 8, "DCTDecode") for c in ("DeviceGray", "DeviceRGB", "DeviceCMYK")]
    # Fixed value: a GIF of 3 x 2 pixels, 0 1 2 / 2 1 0, in four colours.
    gif = b"GIF89a" + struct.pack("<HHBBB", 3, 2, 0x81, 0, 0) + bytes(range(12)) + b"," + struct.pack("<HHHHB", 0, 0, 3, 2, 0) + b"\x02\x04\x44\x14\x82\x02\x00;"
    got = images.read_image(gif, "gif")
    assert (got.w, got.h, got.cs, got.palette) == (3, 2, "Indexed", bytes(range(12)))
    assert len(zlib.decompress(got.data)) == 8
    for broken in (b"", b"\xff\xd8\xff\xd9", _jpeg(1, 1, 1)[:12]):
        with pytest.raises(images.ImageError):
            images.read_image(broken, "jpg")
    with pytest.raises(images.ImageError, match="unsupported"):
        images.read_image(b"", "bmp")
    assert images.image_type("a/b.c.PNG") == "png"
    with pytest.raises(images.ImageError, match="no extension"):
        images.image_type("name")


# Layout --------------------------------------------------------------------------------------------


def test_fonts():
    assert fonts.core_font("Arial", "ib")[0] == "Helvetica-BoldOblique"
    assert fonts.text_width(fonts.core_font("courier")[1], "abc") == 1800
    assert fonts.char_width(fonts.HELVETICA, "é") == fonts.char_width(fonts.HELVETICA, "e")
    assert fonts.char_width(fonts.HELVETICA, "漢") == fonts.mean_width(fonts.HELVETICA)
    with pytest.raises(ValueError, match="no such core font"):
        fonts.core_font("comic")
    c = render.Canvas()
    c.add_font("Own", "", "OwnFont", [500] * 95)
    c.add_page()
    c.set_font("own", "U", 20)
    c.cell(0, 10, "under")
    assert c.string_width("ab") == pytest.approx(1000 * 20 / 1000 / c.k)
    f = File(c.output())
    assert {v.get("BaseFont") for n in f.entries if isinstance(v := f.get(n), dict)} >= {"Helvetica", "OwnFont"}


def test_header_footer_links_and_images():
    hooks = render.Hooks(header=lambda c: c.cell(0, 5, f"Top {c.page_no}"), footer=lambda c: (c.set_y(-10), c.cell(0, 5, f"End {c.page_no} of {{nb}}")))
    c = render.Canvas(hooks=hooks)
    link = c.add_link()
    c.add_page()
    c.multi_cell(0, 6, "words " * 900, border=True, fill=True)
    c.image("a.png", images.read_png(_png(9, 9, 6)), w=20, link=link)
    c.add_page()
    c.set_link(link, y=-1)
    c.image("a.png", images.read_png(_png(9, 9, 6)), x=1, y=1)
    c.set_text_color(200, 0, 0)
    c.cell(0, 5, "漢 red", align="C", link="https://example.com")
    c.write(5, "flowing " * 60 + "\nnext", link="https://example.com/w")
    c.rect(1, 1, 5, 5, "FD")
    c.line(0, 0, 9, 9)
    c.set_display(150, "two")
    content = c.output({"Title": "t"}, compress=True)
    f = File(content)
    texts = texts_of(content)
    assert f.errors == []
    assert len(texts) == 3
    assert [t.split("\n")[0] for t in texts] == ["Top 1", "Top 2", "Top 3"]
    assert [t.split("\n")[-1] for t in texts] == [f"End {k} of 3" for k in (1, 2, 3)]
    assert " ".join(" ".join(texts[:2]).split()).count("words") == 900
    assert texts[2].count("flowing") == 60
    kinds = [v.head.get("Subtype") for n in f.entries if isinstance(v := f.get(n), Stream)]
    assert kinds.count("Image") == 2  # one image and its mask, drawn twice
    notes = [a for _, p, _ in f.pages() for a in p.get("Annots", [])]
    assert [a["Dest"][0] for a in notes if "Dest" in a] == [[r for r, _, _ in f.pages()][2:] and Ref([r for r, _, _ in f.pages()][2])]
    assert {a["A"]["URI"] for a in notes if "A" in a} == {b"https://example.com", b"https://example.com/w"}
    root = f.resolve(f.trailer["Root"])
    assert (root["PageLayout"], root["OpenAction"][-1]) == ("TwoColumnLeft", 1.5)
    with pytest.raises(ValueError, match="display mode"):
        c.set_display("huge")


def test_justified_lines_fill_their_width():
    c = render.Canvas()
    c.add_page()
    c.multi_cell(60, 5, "some words that have to be spread over a few lines of text " * 3)
    ops = b"\n".join(c.pages[0])
    spaces = [float(x.split()[0]) for x in ops.split(b"\n") if x.endswith(b" Tw")]
    assert max(spaces) > 0 and spaces[-1] == 0
    c.pages.clear()
    c.add_page()
    c.set_auto_break(False)
    for _ in range(100):
        c.cell(0, 10, "x")
    assert c.page_no == 1


def test_flowing_text_keeps_all_words():
    c = render.Canvas()
    c.add_page()
    words = [f"w{i}" for i in range(400)]
    for i in range(0, 400, 7):
        c.write(5, " ".join(words[i : i + 7]) + " ")
    c.write(5, "x" * 400)
    assert "".join("".join(texts_of(c.output())).split()) == "".join(words) + "x" * 400


# Sources and SQL -----------------------------------------------------------------------------------


def test_ranges_of_files(spark, tmp_path):
    files = documents.create(spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string"))
    write_files(files.withColumn("name", F.concat("doc_id", F.lit(".pdf"))), f"file://{tmp_path}", "name").count()
    whole = {r.path: bytes(r.content) for r in read_ranges(spark, str(tmp_path)).collect()}
    assert sorted(whole.values()) == sorted(bytes(r.content) for r in files.collect())
    tails = read_ranges(spark, str(tmp_path), start=-40, length=40).collect()
    assert {r.path: bytes(r.content) for r in tails} == {p: c[-40:] for p, c in whole.items()}
    assert all(r.start == r.n_bytes - 40 for r in tails)
    pieces = read_ranges(spark, str(tmp_path), piece=100, overlap=10).collect()
    for p, c in whole.items():
        own = sorted((r.start, bytes(r.content)) for r in pieces if r.path == p)
        assert [x for _, x in own] == [c[a : a + 110] for a in range(0, len(c), 100)]


def test_names_for_sql(spark):
    assert "pdf_page_texts" in sql.register(spark)
    documents.create(spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string")).createOrReplaceTempView("made_files")
    rows = spark.sql("SELECT f.doc_id, p.page_no, p.text FROM made_files f, LATERAL pdf_page_texts(f.content) p").collect()
    assert sorted(map(tuple, rows)) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    assert spark.sql("SELECT count(*) n FROM made_files f, LATERAL pdf_xref_entries(f.content) x WHERE NOT x.free").first().n == 12
    back = spark.sql("SELECT pdf_decode(pdf_encode(encode('hello hello', 'UTF-8'), array('FlateDecode', 'RunLengthDecode')), array('FlateDecode', 'RunLengthDecode')) d, charset_decode(charset_encode('é', 'MacRoman'), 'MacRoman') c, pdf_decode(encode('no zlib', 'UTF-8'), array('FlateDecode')) bad").first()
    assert (bytes(back.d), back.c, back.bad) == (b"hello hello", "é", None)
    assert spark.sql("SELECT text FROM pdf_text_operators(encode('/F1 9 Tf (hi) Tj', 'UTF-8'))").first().text == "hi"


@pytest.mark.parametrize("name", ["png_header", "jpeg_header"])
def test_images_of_one_row_group_are_dealt_out(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_png_rows():
    for width, height, kind in ((1, 3, 0), (50, 52, 6), (13, 300, 2)):
        data = zlib.decompress(images.read_png(queries._png(width, height, kind)).data) if kind != 6 else None
        n = width * {0: 1, 2: 3, 6: 4}[kind]
        rows = b"".join(b"\0" + bytes((x * 7 + y) % 256 for x in range(n)) for y in range(height))
        assert data == rows if data is not None else zlib.compress(rows) in queries._png(width, height, kind)


def test_filters_in_time_and_as_before():
    def slow(digits):
        groups = [[c - 33 for c in digits[a : a + 5]] for a in range(0, len(digits), 5)]
        return b"".join(filters._base85(g + [84] * (5 - len(g)))[: len(g) - 1] for g in groups)

    for n in range(12):
        digits = bytes(33 + (7 * n + 31 * i) % 85 for i in range(n))
        assert filters.ascii85_decode(digits + b"~>") == slow(digits)
    assert filters.ascii85_decode(b"uuuuuz!!~>") == slow(b"uuuuu") + bytes(4) + slow(b"!!")
    data = struct.pack(">500000I", *(i * 2654435761 & 0xFFFFFFFF for i in range(500000)))
    coded = filters.encode(data, ["ASCII85Decode"])
    start = time.process_time()
    assert filters.decode(coded, ["ASCII85Decode"]) == data
    assert time.process_time() - start < 0.4
    for part in (b"", b"a", b"aaaa", data[:30000], b"ab" * 9000):
        assert filters.decode(filters.encode(part, ["LZWDecode"]), ["LZWDecode"]) == part


def test_links_are_the_resolved_references(spark):
    made = [queries._damaged_file(i, "one\ntwo") for i in range(6)] + [queries._tree_file(0, "a\nb\nc\nd"), queries._updated_file(0, "a\nb"), None]
    files = spark.createDataFrame([*enumerate(made)], "doc_id long, content binary")
    joined = documents.resolved(documents.pdf_refs(files), documents.pdf_objects(files)).drop("dst_value")
    links = documents.pdf_links(files)
    assert links.columns == joined.columns
    assert sorted(map(repr, links.collect())) == sorted(map(repr, joined.collect()))
    join = queries.QUERIES["reference_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert join.count("Join ") == 1  # the counts with the entries; no join of all references with all objects


def test_wrapping_takes_few_texts_at_a_time(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    texts = spark.createDataFrame([(i, "î á ú â " * 40) for i in range(50)], "doc_id long, text string")
    lines = render.wrap(texts, width=300.0, size=12.0)
    assert int(spark.conf.get(name)) <= 256
    assert lines.select("doc_id").distinct().count() == 50


def test_accented_lines_are_not_too_wide(spark, tmp_path):
    spark.createDataFrame([(1, "î" * 400 + "\n" + "á ú â " * 90)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["wrap_lines"](spark, str(tmp_path)).first().too_wide == 0


def test_values_read_the_same_in_short_and_long_form():
    for text, want in ((b"<</A 1/B 2 0 R/C[1 2 3 0 R 4 -5 +6 7.5 .5]/D(x)/E/F>>", {"A": 1, "B": Ref(2, 0), "C": [1, 2, Ref(3, 0), 4, -5, 6, 7.5, 0.5], "D": b"x", "E": "F"}), (b"[1 %c\n2 0 R 3", [1, Ref(2, 0), 3]), (b"<</A/B/C>>", {"A": "B", "C": None})):
        assert read_value(text, 0)[0] == want
