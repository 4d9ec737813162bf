"""Building files: from lines of text, from single pages, from many files."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

from leafmill.functions.fonts import coded, codes_for, to_unicode
from leafmill.functions.objects import File, Hex, Name, Ref, Stream, Written, escape, last_startxref, references, sections, serialize, write_value

LETTER = [0, 0, 612, 792]
#: Page attributes that a merged page keeps; a split page keeps none of them.
KEPT_ON_MERGE = ("Rotate", "CropBox", "BleedBox", "TrimBox", "ArtBox")
#: What a merge keeps as well if annotations and transparency groups are asked for.
KEPT_WITH_NOTES = (*KEPT_ON_MERGE, "Annots", "Group")


def text_page(lines: Iterable[str], size: float = 12, leading: float = 14, codes: dict[str, int] | None = None) -> bytes:
    """The content stream of a page that shows each line.

    Lines of Latin-1 characters are in the font F1; others are in F2, by ``codes``, and become question
    marks without them.
    """
    out, font = [b"BT /F1 %g Tf" % size, b"72 720 Td"], "F1"
    for i, line in enumerate(lines):
        if i:
            out.append(b"0 -%g Td" % leading)
        try:
            shown, now = b"(" + escape(line.encode("latin-1", "strict" if codes else "replace")) + b")", "F1"
        except UnicodeEncodeError:
            shown, now = coded(line, codes or {}), "F2"
        if now != font:
            out.append(b"/%s %g Tf" % (now.encode(), size))
            font = now
        out.append(shown + b" Tj")
    return b"\n".join([*out, b"ET"])


def unicode_font(codes: dict[str, int], first: int) -> dict[int, object]:
    """The objects of a font whose two-byte codes a reader turns back into characters; the font is ``first``."""
    system = {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}
    return {
        first: {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Helvetica"), "Encoding": Name("Identity-H"), "DescendantFonts": [Ref(first + 1)], "ToUnicode": Ref(first + 2)},
        first + 1: {"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Helvetica"), "CIDSystemInfo": system},
        first + 2: Stream({"Filter": Name("FlateDecode")}, zlib.compress(to_unicode(codes))),
    }


def text_document(pages: Iterable[Iterable[str]], compress: bool = True, info: dict[str, str] | None = None, packed: bool = False) -> bytes:
    """A file with a page for each group of lines; ``packed`` puts the page dictionaries into an object stream.

    Characters beyond Latin-1 get a font with a code map, so page text gives them back.
    """
    pages = [[*lines] for lines in pages]
    odd = [line for lines in pages for line in lines if not line.isascii() and max(line) > "\xff"]
    codes = codes_for(odd) if odd else None
    if codes and len(codes) > 0xFFFF:
        raise ValueError("too many different characters")
    font = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 3: font}
    fonts, n = {"F1": Ref(3)}, 4
    if codes:
        objects |= unicode_font(codes, n)
        fonts["F2"] = Ref(n)
        n += 3
    kids: list[Ref] = []
    # Pages differ only in their contents' numbers.
    own = write_value({"Font": fonts})
    for lines in pages:
        content = text_page(lines, codes=codes)
        head = {"Filter": Name("FlateDecode")} if compress else {}
        objects[n] = Stream(head, zlib.compress(content) if compress else content)
        objects[n + 1] = Written(b"<</Type /Page /Parent 2 0 R /Contents %d 0 R /Resources %b>>" % (n, own))
        kids.append(Ref(n + 1))
        n += 2
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": LETTER}
    trailer: dict[str, object] = {"Root": Ref(1)}
    if info:
        trailer["Info"] = Ref(n)
        objects[n] = dict(info)
    return _packed(objects, trailer) if packed else serialize(objects, trailer)


def tree_document(pages: Iterable[tuple[bytes, dict]], shared: dict, nodes: Callable[[int], dict] = lambda _: {}, fanout: int = 3) -> bytes:
    """A file of (content, own attributes of the page) whose pages hang in groups of ``fanout`` below nodes.

    ``shared`` holds attributes of the root, ``nodes`` gives those of the nth node; pages inherit them.
    """
    pages = [*pages]
    groups = [pages[a : a + fanout] for a in range(0, len(pages), fanout)]
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2)}}
    n, tops = 3, []
    for g, group in enumerate(groups):
        node, kids = n, []
        n += 1
        for content, own in group:
            objects[n] = Stream({}, content)
            objects[n + 1] = {"Type": Name("Page"), "Parent": Ref(node), "Contents": Ref(n)} | own
            kids.append(Ref(n + 1))
            n += 2
        objects[node] = {"Type": Name("Pages"), "Parent": Ref(2), "Kids": kids, "Count": len(kids)} | nodes(g)
        tops.append(Ref(node))
    objects[2] = {"Type": Name("Pages"), "Kids": tops, "Count": len(pages)} | shared
    return serialize(objects, {"Root": Ref(1)})


def updated(content: bytes, changes: dict[int, object], file: File | None = None) -> bytes:
    """The file with changed or new objects behind, in a section that comes before the ones that it has.

    Nothing of the old bytes is changed or copied twice, so an update costs what it adds. ``file`` is the
    same content, if it has been read already.
    """
    file = file or File(content)
    start = last_startxref(content)
    out, offset = bytearray(content if content.endswith(b"\n") else content + b"\n"), {}
    for n in sorted(changes):
        offset[n] = len(out)
        out += b"%d 0 obj\n" % n + write_value(changes[n]) + b"\nendobj\n"
    at = len(out)
    out += b"xref\n"
    for first, count in sections(sorted(changes)):
        out += b"%d %d\n" % (first, count)
        out += b"".join(b"%010d %05d n \n" % (offset[n], 0) for n in range(first, first + count))
    keys = {k: v for k, v in file.trailer.items() if k in ("Root", "Info", "ID", "Encrypt")}
    trailer = keys | {"Size": max([*file.entries, *changes]) + 1} | ({} if start is None else {"Prev": start})
    out += b"trailer\n" + write_value(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


def appended(content: bytes, added: bytes) -> bytes:
    """The file with the pages of another behind its own, as an update: what it has is not written again."""
    file, other = File(content), File(added)
    root = file.resolve(file.trailer.get("Root"))
    top = root.get("Pages") if isinstance(root, dict) else None
    node = file.resolve(top)
    if not isinstance(top, Ref) or not isinstance(node, dict):
        raise ValueError("no page tree to add to")
    copies = Collector(max(file.entries) + 1)
    kids, changes = [*(file.resolve(node.get("Kids")) or [])], {}
    box = next((i.get("MediaBox") for _, _, i in file.pages() if i.get("MediaBox")), LETTER)
    for _, page, inherited in other.pages():
        body = _page_body(copies, "added", other, page, inherited, top, KEPT_ON_MERGE, file.resolve(box))
        number = copies.next
        copies.next += 1
        changes[number] = body
        kids.append(Ref(number))
    count = sum(1 for _ in file.pages()) + len(kids) - len(file.resolve(node.get("Kids")) or [])
    changes |= copies.objects
    changes[top.obj] = node | {"Kids": kids, "Count": count}
    return updated(content, changes)


def _packed(objects: dict[int, object], trailer: dict) -> bytes:
    """A file of version 1.5: plain objects in one object stream, the table in a stream as well."""
    inner = {n: v for n, v in objects.items() if not isinstance(v, Stream)}
    bodies, pairs, at = [], [], 0
    for n, v in inner.items():
        body = write_value(v) + b" "
        pairs.append(b"%d %d" % (n, at))
        bodies.append(body)
        at += len(body)
    head = b" ".join(pairs) + b" "
    holder, table = max(objects) + 1, max(objects) + 2
    outer = {n: v for n, v in objects.items() if isinstance(v, Stream)}
    outer[holder] = Stream({"Type": Name("ObjStm"), "N": len(inner), "First": len(head), "Filter": Name("FlateDecode")}, zlib.compress(head + b"".join(bodies)))
    out, rows = bytearray(b"%PDF-1.5\n"), {0: (0, 0, 65535)}
    for n in sorted(outer):
        rows[n] = (1, len(out), 0)
        out += b"%d 0 obj\n" % n + write_value(outer[n]) + b"\nendobj\n"
    rows |= {n: (2, holder, i) for i, n in enumerate(inner)}
    rows[table] = (1, len(out), 0)
    data = b"".join(bytes([k]) + a.to_bytes(4, "big") + b.to_bytes(2, "big") for k, a, b in (rows[n] for n in range(table + 1)))
    head = trailer | {"Type": Name("XRef"), "W": [1, 4, 2], "Size": table + 1, "Filter": Name("FlateDecode")}
    out += b"%d 0 obj\n" % table + write_value(Stream(head, zlib.compress(data))) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % rows[table][1]
    return bytes(out)


class Collector:
    """Objects copied from several files under new numbers; each is copied once, cycles included."""

    def __init__(self, first: int):
        self.objects: dict[int, object] = {}
        self.number: dict[tuple[object, int], int] = {}
        self.next = first

    def take(self, source: object, file: File, value: object) -> object:
        """The value with its references renumbered, and with all that they reach copied."""
        open_: list[tuple[int, int]] = []

        def moved(v: object) -> object:
            match v:
                case Ref():
                    key = (source, v.obj)
                    if key not in self.number:
                        self.number[key] = self.next
                        self.next += 1
                        open_.append((v.obj, self.number[key]))
                    return Ref(self.number[key])
                case dict():
                    return {k: moved(x) for k, x in v.items() if k != "Parent"}
                case list():
                    return [moved(x) for x in v]
                case Stream():
                    return Stream({k: moved(x) for k, x in v.head.items() if k != "Length"}, v.raw)
            return v

        out = moved(value)
        while open_:
            old, new = open_.pop()
            self.objects[new] = moved(file.get(old))
        return out


def used_names(file: File, page: dict, resources: object) -> dict[str, set[str]] | None:
    """The fonts and XObjects that a page's operators name, form XObjects included; None keeps all resources."""
    import re

    resources = file.resolve(resources)
    used: dict[str, set[str]] = {"Font": set(), "XObject": set()}
    open_, seen = [(c, resources) for c in file.contents(page)], set()
    while open_:  # each form once, so cycles end
        following = []
        for content, res in open_:
            used["Font"] |= {x.decode("latin-1") for x in re.findall(rb"/([^\s/<>\[\]()]+)\s+[\d.]+\s+Tf", content)}
            names = {x.decode("latin-1") for x in re.findall(rb"/([^\s/<>\[\]()]+)\s+Do", content)}
            used["XObject"] |= names
            forms = file.resolve((res or {}).get("XObject")) or {}
            for n in names - seen:
                seen.add(n)
                form = file.resolve(forms.get(n))
                if isinstance(form, Stream) and form.head.get("Subtype") == "Form":
                    if "Resources" in form.head:
                        return None  # nested resources: names may mean other things there
                    following.append((form.data(), res))
        open_ = following
    return used


def single_page(file: File, page: dict, inherited: dict) -> bytes:
    """A file of one page with the resources that the page uses."""
    resources = file.resolve(inherited.get("Resources")) or {}
    used = used_names(file, page, resources)
    if used is not None:
        pruned = {}
        for kind, value in resources.items():
            value = file.resolve(value)
            keep = used.get(kind)
            pruned[kind] = {k: v for k, v in value.items() if k in keep} if keep and isinstance(value, dict) else value
        resources = pruned
    return _file([("", file, page, inherited | {"Resources": resources})], ())


def merged(files: Iterable[tuple[object, File]]) -> bytes:
    """The pages of all files in order; a page that cannot be read is left out."""
    return merged_pages([(source, f, page, inherited) for source, f in files for _, page, inherited in f.pages()])


def merged_pages(pages: list[tuple[object, File, dict, dict]], notes: bool = False) -> bytes:
    """The same of (source, file, page, what it inherits); ``notes`` keeps annotations and groups too."""
    if not pages:
        raise ValueError("no pages to merge")
    return _file(pages, KEPT_WITH_NOTES if notes else KEPT_ON_MERGE)


def _page_body(copies: Collector, source: object, file: File, page: dict, inherited: dict, parent: Ref, kept: tuple[str, ...], box: object) -> dict[str, object]:
    """A page's dictionary under new numbers, with what it inherits; ``box`` is for a page without one."""
    body: dict[str, object] = {"Type": Name("Page"), "Parent": parent}
    body["MediaBox"] = copies.take(source, file, file.resolve(inherited.get("MediaBox")) or box)
    for key in ("Resources", "Contents"):
        value = inherited.get(key) if key == "Resources" else page.get(key)
        if value is not None:
            body[key] = copies.take(source, file, value)
    for key in kept:
        if key in page or key in inherited:
            body[key] = copies.take(source, file, page.get(key, inherited.get(key)))
    return body


def _file(pages: list, kept: tuple[str, ...]) -> bytes:
    copies, objects, kids = Collector(3), {}, []
    # Merged pages without a box have the first page's; a split page has the letter size.
    first = pages[0][1].resolve(pages[0][3].get("MediaBox")) if kept else None
    for source, file, page, inherited in pages:
        body = _page_body(copies, source, file, page, inherited, Ref(2), kept, first or LETTER)
        number = copies.next
        copies.next += 1
        objects[number] = body
        kids.append(Ref(number))
    objects |= copies.objects
    objects[1] = {"Type": Name("Catalog"), "Pages": Ref(2)}
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    return serialize(objects, {"Root": Ref(1)})


def unique_names(groups: Iterable[Iterable[str]]) -> list[dict[str, str]]:
    """For each group of resource names the new name of each: one that an earlier group has gets _1, _2 and so on."""
    taken: set[str] = set()
    out = []
    for names in groups:
        renamed: dict[str, str] = {}
        for name in names:
            new, k = name, 0
            while new in taken:
                k += 1
                new = f"{name}_{k}"
            taken.add(new)
            renamed[name] = new
        out.append(renamed)
    return out


__all__ = [
    "Collector", "Hex", "appended", "merged", "merged_pages", "references", "single_page", "text_document", "text_page", "tree_document", "unicode_font", "unique_names", "updated", "used_names",
]
