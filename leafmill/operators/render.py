"""Laying out text: wrapping, cells, flowing text, images, links, pages, and files made of them."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.assemble import unicode_font
from leafmill.functions.fonts import HELVETICA, char_width, coded, core_font, mean_width, style_of, table_of, text_width
from leafmill.functions.images import Image
from leafmill.functions.objects import Name, Ref, Stream, escape, serialize
from leafmill.operators.documents import BATCH_FILES, _in_parts, _limit_batches

MISSING = mean_width(HELVETICA)


def width_of(text: str, widths: list[int] = HELVETICA) -> int:
    """In thousandths of the font size."""
    return text_width(widths, text)


def wrap_text(text: str, limit: float, widths: list[int] = HELVETICA) -> list[str]:
    """Greedy lines of at most ``limit`` thousandths; a word that is too long is cut, a letter a line at least."""
    return [line for line, _ in _wrapped(text, limit, widths)]


def _wrapped(text: str, limit: float, widths: list[int]) -> list[tuple[str, bool]]:
    """The lines, and whether each ends its paragraph."""
    out: list[tuple[str, bool]] = []
    table = table_of(widths)
    space, width = table[" "], table.__getitem__
    for paragraph in text.replace("\r", "").removesuffix("\n").split("\n"):
        line, used, empty = "", 0.0, True
        for word in paragraph.split(" "):
            size = sum(map(width, word))
            if empty:
                line, used, empty = word, size, False
            elif used + space + size <= limit:
                line, used = f"{line} {word}", used + space + size
            else:
                out.append((line, False))
                line, used = word, size
            while used > limit and len(line) > 1:
                n, room = 0, limit
                while n < len(line) and (room := room - table[line[n]]) >= 0:
                    n += 1
                n = max(1, n)
                out.append((line[:n], False))
                line = line[n:]
                used = sum(map(width, line))
        out.append((line, True))
    return out


def wrap(texts: DataFrame, width: float, size: float, margin: float = 0.0) -> DataFrame:
    """(doc_id, line_no, line): texts in lines of ``width`` points less the margins."""
    rows = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    limit = (width - 2 * margin) * 1000 / size
    _limit_batches(texts.sparkSession)

    def run(batches):
        for batch in _in_parts(batches, BATCH_FILES):  # lines of few texts are held at a time
            ids, no, lines = [], [], []
            for i, t in enumerate(batch.column("text")):
                made = wrap_text(t.as_py(), limit)
                ids += [i] * len(made)
                no += range(1, len(made) + 1)
                lines += made
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int32())), pa.array(no, pa.int32()), pa.array(lines, pa.string())], ["doc_id", "line_no", "line"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, line_no int, line string")


@dataclass
class Font:
    """A font in use: its number, name in the file, widths and style."""

    number: int
    name: str
    widths: list[int]
    style: str = ""


@dataclass
class State:
    """What holds for what is drawn next."""

    font: Font | None = None
    size: float = 12.0
    underline: bool = False
    text_color: bytes = b"0 g"
    fill_color: bytes = b"0 g"
    draw_color: bytes = b"0 G"
    line_width: float = 0.57
    spacing: float = 0.0


@dataclass
class Hooks:
    """What a user may put in: drawing at the top and the bottom of every page, and whether a full page ends."""

    header: Callable[[Canvas], None] = lambda canvas: None
    footer: Callable[[Canvas], None] = lambda canvas: None
    accept_break: Callable[[Canvas], bool] = lambda canvas: canvas.auto_break


@dataclass
class Canvas:
    """Pages of drawing operators in user units from the top left, as points from the bottom left.

    Texts in Latin-1 are shown in the font that is set (Helvetica at first); characters beyond are
    collected and shown in a font with a code map, which is written with the file.
    """

    width: float = 595.28
    height: float = 841.89
    unit: float = 72 / 25.4
    margin: float = 28.35
    hooks: Hooks = field(default_factory=Hooks)

    def __post_init__(self):
        self.k, self.w, self.h = self.unit, self.width / self.unit, self.height / self.unit
        self.left = self.top = self.right = self.margin / self.unit
        self.cell_margin, self.bottom = self.margin / self.unit / 10, 2 * self.margin / self.unit
        self.auto_break, self.inside_hook = True, False
        self.pages: list[list[bytes]] = []
        self.x, self.y, self.last = self.left, self.top, 0.0
        self.state = State(line_width=0.567 / self.k)
        self.fonts: dict[tuple[str, str], Font] = {}
        self.images: dict[str, tuple[int, Image]] = {}
        self.codes: dict[str, int] = {}
        self.targets: dict[int, tuple[int, float]] = {}
        self.page_links: list[tuple[int, tuple[float, float, float, float], str | int]] = []
        self.info: dict[str, str] = {}
        self.display: tuple[str | int, str] = ("default", "default")
        self.alias = "{nb}"
        self.extra_fonts: dict[tuple[str, str], tuple[str, list[int]]] = {}
        self.set_font("helvetica")

    # Settings ------------------------------------------------------------------------------------

    def add_font(self, family: str, style: str, name: str, widths: list[int]) -> None:
        """A font beside the core ones, by its name in the file and its widths from the space on."""
        self.extra_fonts[family.lower(), style_of(style)] = (name, widths)

    def set_font(self, family: str = "", style: str = "", size: float = 0.0) -> None:
        now = self.state.font
        family = family.lower() or (now.name.split("-")[0].lower() if now else "helvetica")
        family = "helvetica" if family == "arial" else family
        plain = style_of(style)
        if (family, plain) not in self.fonts:
            name, widths = self.extra_fonts.get((family, plain)) or core_font(family, plain)
            self.fonts[family, plain] = Font(len(self.fonts) + 1, name, widths, plain)
        self.state.font, self.state.underline = self.fonts[family, plain], "U" in style.upper()
        self.state.size = size or self.state.size
        self._show_font()

    def set_font_size(self, size: float) -> None:
        self.state.size = size
        self._show_font()

    def _show_font(self) -> None:
        if self.pages:
            self.out(b"BT /F%d %.2f Tf ET" % (self.state.font.number, self.state.size))

    @staticmethod
    def _color(r: int, g: int | None, b: int | None, ops: tuple[bytes, bytes]) -> bytes:
        if g is None or r == g == b:
            return b"%.3f %s" % (r / 255, ops[0])
        return b"%.3f %.3f %.3f %s" % (r / 255, g / 255, (b or 0) / 255, ops[1])

    def set_draw_color(self, r: int, g: int | None = None, b: int | None = None) -> None:
        self.state.draw_color = self._color(r, g, b, (b"G", b"RG"))
        if self.pages:
            self.out(self.state.draw_color)

    def set_fill_color(self, r: int, g: int | None = None, b: int | None = None) -> None:
        self.state.fill_color = self._color(r, g, b, (b"g", b"rg"))
        if self.pages:
            self.out(self.state.fill_color)

    def set_text_color(self, r: int, g: int | None = None, b: int | None = None) -> None:
        self.state.text_color = self._color(r, g, b, (b"g", b"rg"))

    def color(self, r: int, g: int | None = None, b: int | None = None, fill: bool = False) -> None:
        (self.set_fill_color if fill else self.set_draw_color)(r, g, b)

    def set_line_width(self, width: float) -> None:
        self.state.line_width = width
        if self.pages:
            self.out(b"%.2f w" % (width * self.k))

    def set_margins(self, left: float, top: float, right: float | None = None) -> None:
        self.left, self.top, self.right = left, top, left if right is None else right

    def set_auto_break(self, on: bool, margin: float = 0.0) -> None:
        self.auto_break, self.bottom = on, margin

    def set_display(self, zoom: str | int, layout: str = "default") -> None:
        """How a reader opens the file: fullpage, fullwidth, real, default or a percentage; single, continuous, two or default."""
        if not (isinstance(zoom, int) or zoom in ("fullpage", "fullwidth", "real", "default")) or layout not in ("single", "continuous", "two", "default"):
            raise ValueError(f"no such display mode: {zoom} {layout}")
        self.display = (zoom, layout)

    def set_x(self, x: float) -> None:
        self.x = x if x >= 0 else self.w + x

    def set_y(self, y: float, reset_x: bool = True) -> None:
        self.y = y if y >= 0 else self.h + y
        if reset_x:
            self.x = self.left

    def set_xy(self, x: float, y: float) -> None:
        self.set_x(x)
        self.set_y(y, reset_x=False)

    # Pages ---------------------------------------------------------------------------------------

    def add_page(self) -> None:
        """Ends the page with the footer and begins one with the header; what was set goes on."""
        before = self.state
        if self.pages:
            self._hook(self.hooks.footer)
        self.pages.append([b"2 J", b"%.2f w" % (before.line_width * self.k)])
        self._show_font()
        for color, plain in ((before.draw_color, b"0 G"), (before.fill_color, b"0 g")):
            if color != plain:
                self.out(color)
        self.x, self.y = self.left, self.top
        kept = State(**vars(before))
        self._hook(self.hooks.header)
        if vars(self.state) != vars(kept):
            self.state = kept
            self._show_font()
            for line in (kept.draw_color, kept.fill_color, b"%.2f w" % (kept.line_width * self.k)):
                self.out(line)

    def _hook(self, draw: Callable[[Canvas], None]) -> None:
        self.inside_hook = True
        try:
            draw(self)
        finally:
            self.inside_hook = False

    @property
    def page_no(self) -> int:
        return len(self.pages)

    def out(self, op: bytes) -> None:
        self.pages[-1].append(op)

    def _breaks(self, h: float) -> bool:
        """Whether something of this height does not fit and a page may end."""
        return self.y + h > self.h - self.bottom and not self.inside_hook and self.hooks.accept_break(self)

    def _next_page(self) -> None:
        x, spacing = self.x, self.state.spacing
        if spacing:
            self._space(0.0)
        self.add_page()
        self.x = x
        if spacing:
            self._space(spacing)

    def _space(self, width: float) -> None:
        self.state.spacing = width
        self.out(b"0 Tw" if not width else b"%.3f Tw" % (width * self.k))

    # Drawing -------------------------------------------------------------------------------------

    def string_width(self, text: str) -> float:
        return text_width(self.state.font.widths, text) * self.state.size / 1000 / self.k

    def _shown(self, text: str) -> bytes:
        """The operator that shows a text: in codes of the collected characters if the font lacks some."""
        try:
            return b"(" + escape(text.encode("latin-1")) + b") Tj"
        except UnicodeEncodeError:
            for c in text:
                self.codes.setdefault(c, len(self.codes) + 1)
            if len(self.codes) > 0xFFFF:
                raise ValueError("too many different characters") from None
            size = self.state.size
            return b"/FU %.2f Tf " % size + coded(text, self.codes) + b" Tj /F%d %.2f Tf" % (self.state.font.number, size)

    def _text(self, x: float, y: float, text: str) -> bytes:
        op = b"BT %.2f %.2f Td %s ET" % (x * self.k, (self.h - y) * self.k, self._shown(text))
        if self.state.underline and text:
            width = self.string_width(text) + self.state.spacing * text.count(" ")
            thick = 0.05 * self.state.size
            op += b" %.2f %.2f %.2f %.2f re f" % (x * self.k, (self.h - y) * self.k - 0.1 * self.state.size, width * self.k, -thick)
        return op if self.state.text_color == self.state.fill_color else b"q " + self.state.text_color + b" " + op + b" Q"

    def text(self, x: float, y: float, text: str) -> None:
        self.out(self._text(x, y, text))

    def line(self, x1: float, y1: float, x2: float, y2: float) -> None:
        self.out(b"%.2f %.2f m %.2f %.2f l S" % (x1 * self.k, (self.h - y1) * self.k, x2 * self.k, (self.h - y2) * self.k))

    def rect(self, x: float, y: float, w: float, h: float, style: str = "D") -> None:
        op = {"F": b"f", "FD": b"B", "DF": b"B"}.get(style.upper(), b"S")
        self.out(b"%.2f %.2f %.2f %.2f re %s" % (x * self.k, (self.h - y) * self.k, w * self.k, -h * self.k, op))

    def cell(self, w: float, h: float = 0.0, text: str = "", border: bool | str = False, after: int = 1, align: str = "L", link: str | int = "", fill: bool = False) -> None:
        """A box with text; one that would pass the bottom margin begins a page.

        ``border`` is all sides or some of L, T, R and B; ``after`` says what comes next: 0 to the right,
        1 the next line, 2 below.
        """
        if self._breaks(h):
            self._next_page()
        w = w if w > 0 else self.w - self.right - self.x
        if fill or border is True:
            self.rect(self.x, self.y, w, h, "FD" if fill and border is True else "F" if fill else "D")
        if isinstance(border, str):
            a, b, c, d = self.x, self.y, self.x + w, self.y + h
            for side, ends in (("L", (a, b, a, d)), ("T", (a, b, c, b)), ("R", (c, b, c, d)), ("B", (a, d, c, d))):
                if side in border.upper():
                    self.line(*ends)
        if text:
            size = self.state.size / self.k
            own = self.string_width(text)
            dx = {"R": w - self.cell_margin - own, "C": (w - own) / 2}.get(align, self.cell_margin)
            self.text(self.x + dx, self.y + 0.5 * h + 0.3 * size, text)
            if link:
                self.link(self.x + dx, self.y + 0.5 * h - 0.5 * size, own, size, link)
        self.last = h
        if after:
            self.y += h
            self.x = self.left if after == 1 else self.x
        else:
            self.x += w

    def multi_cell(self, w: float, h: float, text: str, border: bool | str = False, align: str = "J", fill: bool = False) -> None:
        """Lines as wide as ``w`` below each other; J widens the spaces of all but a paragraph's last line."""
        w = w if w > 0 else self.w - self.right - self.x
        limit = (w - 2 * self.cell_margin) * 1000 * self.k / self.state.size
        sides = "LTRB" if border is True else (border or "").upper()
        lines = _wrapped(text, limit, self.state.font.widths)
        for i, (line, last) in enumerate(lines):
            spaces = line.count(" ")
            if align == "J" and not last and spaces:
                self._space((limit - text_width(self.state.font.widths, line)) / 1000 * self.state.size / self.k / spaces)
            elif self.state.spacing:
                self._space(0.0)
            own = "".join(s for s in sides if s in "LR" or (s == "T" and i == 0) or (s == "B" and i == len(lines) - 1))
            self.cell(w, h, line, own, 2, "L" if align == "J" else align, fill=fill)
        if self.state.spacing:
            self._space(0.0)
        self.x = self.left

    def write(self, h: float, text: str, link: str | int = "") -> None:
        """Text that flows on from where the last ended, from margin to margin."""
        widths, per = self.state.font.widths, 1000 * self.k / self.state.size
        paragraphs = text.replace("\r", "").split("\n")
        for i, paragraph in enumerate(paragraphs):
            rest = paragraph
            while rest:
                limit = (self.w - self.right - self.x - 2 * self.cell_margin) * per
                used = cut = at = 0
                while at < len(rest) and (used := used + char_width(widths, rest[at])) <= limit:
                    at += 1
                    if at < len(rest) and rest[at] == " ":
                        cut = at
                if at == len(rest):
                    self.cell(used / per + 2 * self.cell_margin, h, rest, False, 0, "L", link)
                    self.x -= 2 * self.cell_margin
                    break
                if not cut and self.x > self.left:  # no room for the first word: the next line
                    self.x, self.y = self.left, self.y + h
                    continue
                end = cut or max(1, at)
                self.cell(0, h, rest[:end], False, 2, "L", link)
                self.x, rest = self.left, rest[end + bool(cut) :]
            if i < len(paragraphs) - 1:
                self.x, self.y = self.left, self.y + h
        self.last = h

    def ln(self, h: float | None = None) -> None:
        self.x, self.y = self.left, self.y + (self.last if h is None else h)

    def image(self, name: str, image: Image, x: float | None = None, y: float | None = None, w: float = 0.0, h: float = 0.0, link: str | int = "") -> None:
        """An image, written once under its name. Sizes that are not given follow from the other one, or from
        96 dots an inch; negative ones are dots an inch. Without ``y`` it flows like a cell."""
        number, image = self.images.setdefault(name, (len(self.images) + 1, image))
        if w == 0 and h == 0:
            w = h = -96
        w = -image.w * 72 / w / self.k if w < 0 else w
        h = -image.h * 72 / h / self.k if h < 0 else h
        w = w or h * image.w / image.h
        h = h or w * image.h / image.w
        if y is None:
            if self._breaks(h):
                self._next_page()
            y, self.y = self.y, self.y + h
        x = self.x if x is None else x
        self.out(b"q %.2f 0 0 %.2f %.2f %.2f cm /I%d Do Q" % (w * self.k, h * self.k, x * self.k, (self.h - y - h) * self.k, number))
        if link:
            self.link(x, y, w, h, link)

    # Links ---------------------------------------------------------------------------------------

    def add_link(self) -> int:
        """A link inside the file; where it leads is set later, the first page's top until then."""
        self.targets[len(self.targets) + 1] = (0, 0.0)
        return len(self.targets)

    def set_link(self, link: int, y: float = 0.0, page: int = -1) -> None:
        """Where a link leads; -1 is the place, or the page, that is drawn now."""
        self.targets[link] = (page if page >= 0 else self.page_no, self.y if y == -1 else max(0.0, y))

    def link(self, x: float, y: float, w: float, h: float, link: str | int) -> None:
        self.page_links.append((self.page_no, (x, y, w, h), link))

    # The file ------------------------------------------------------------------------------------

    def output(self, info: dict[str, str] | None = None, alias: str | None = None, compress: bool = False) -> bytes:
        """The whole file; ``alias`` in texts becomes the number of pages."""
        if not self.pages:
            self.add_page()
        self._hook(self.hooks.footer)
        total, name = str(len(self.pages)).encode(), self.alias if alias is None else alias
        fonts: dict[str, Ref] = {}
        objects: dict[int, object] = {}
        n = 3
        for font in self.fonts.values():
            fonts[f"F{font.number}"] = Ref(n)
            objects[n] = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(font.name), "Encoding": Name("WinAnsiEncoding")}
            n += 1
        if self.codes:
            objects |= unicode_font(self.codes, n)
            fonts["FU"] = Ref(n)
            n += 3
        pictures: dict[str, Ref] = {}
        for number, image in self.images.values():
            made, n = image_objects(image, n)
            pictures[f"I{number}"] = Ref(next(iter(made)))
            objects |= made
        resources = n
        objects[n] = {"ProcSet": [Name(x) for x in ("PDF", "Text", "ImageB", "ImageC", "ImageI")], "Font": fonts} | ({"XObject": pictures} if pictures else {})
        n += 1
        first = n
        by_page: dict[int, list] = {}
        for at, box, link in self.page_links:
            by_page.setdefault(at, []).append((box, link))
        kids = []
        for i, ops in enumerate(self.pages, 1):
            content = b"\n".join(ops)
            if name:
                content = content.replace(name.encode(), total)
            page = {"Type": Name("Page"), "Parent": Ref(2), "Resources": Ref(resources), "Contents": Ref(n + 1)}
            if own := by_page.get(i):
                page["Annots"] = [self._annotation(box, link, first) for box, link in own]
            objects[n] = page
            objects[n + 1] = Stream({"Filter": Name("FlateDecode")}, zlib.compress(content)) if compress else Stream({}, content)
            kids.append(Ref(n))
            n += 2
        objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, round(self.width, 2), round(self.height, 2)]}
        objects[1] = {"Type": Name("Catalog"), "Pages": Ref(2)} | self._opening(kids[0])
        trailer: dict[str, object] = {"Root": Ref(1)}
        if info := self.info | (info or {}):
            objects[n] = dict(info)
            trailer["Info"] = Ref(n)
        return serialize(objects, trailer)

    def _annotation(self, box: tuple[float, float, float, float], link: str | int, first: int) -> dict:
        x, y, w, h = box
        rect = [x * self.k, (self.h - y - h) * self.k, (x + w) * self.k, (self.h - y) * self.k]
        out = {"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": rect, "Border": [0, 0, 0]}
        if isinstance(link, str):
            return out | {"A": {"S": Name("URI"), "URI": link}}
        page, top = self.targets.get(link, (0, 0.0))
        return out | {"Dest": [Ref(first + 2 * (max(1, min(page, len(self.pages))) - 1)), Name("XYZ"), 0, (self.h - top) * self.k, None]}

    def _opening(self, page: Ref) -> dict:
        zoom, layout = self.display
        action = {"fullpage": [page, Name("Fit")], "fullwidth": [page, Name("FitH"), None], "real": [page, Name("XYZ"), None, None, 1]}.get(zoom)
        if isinstance(zoom, int):
            action = [page, Name("XYZ"), None, None, zoom / 100]
        shape = {"single": "SinglePage", "continuous": "OneColumn", "two": "TwoColumnLeft"}.get(layout)
        return ({"OpenAction": action} if action else {}) | ({"PageLayout": Name(shape)} if shape else {})


def image_objects(image: Image, n: int) -> tuple[dict[int, object], int]:
    """The objects of an image from number ``n`` on (itself first, then its palette and mask), and the next number."""
    head: dict[str, object] = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": image.w, "Height": image.h, "BitsPerComponent": image.bpc, "Filter": Name(image.filter)}
    objects: dict[int, object] = {n: None}
    following = n + 1
    head["ColorSpace"] = Name(image.cs)
    if image.cs == "Indexed":
        head["ColorSpace"] = [Name("Indexed"), Name("DeviceRGB"), len(image.palette) // 3 - 1, Ref(following)]
        objects[following] = Stream({}, image.palette)
        following += 1
    if image.cs == "DeviceCMYK":
        head["Decode"] = [1, 0] * 4
    if image.params:
        head["DecodeParms"] = image.params
    if image.masked:
        head["Mask"] = [x for m in image.masked for x in (m, m)]
    if image.alpha is not None:
        grey = Image(image.w, image.h, "DeviceGray", 8, image.filter, image.alpha, {"Predictor": 15, "Colors": 1, "BitsPerComponent": 8, "Columns": image.w})
        made, after = image_objects(grey, following)
        objects |= made
        head["SMask"] = Ref(following)
        following = after
    objects[n] = Stream(head, image.data)
    return objects, following


def documents(cells: DataFrame, height: float = 6.0, hooks: Hooks | None = None, info: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, content) of (doc_id, seq, text): a file for each document, its cells in order, pages as needed.

    ``hooks`` draw at the top and the bottom of each page. A file is laid out in one piece, so the cells
    of a document have to fit into a task.
    """
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        canvas = Canvas(hooks=hooks or Hooks())
        canvas.add_page()
        for text in pdf.sort_values("seq", kind="stable")["text"]:
            canvas.multi_cell(0, height, text or "", align="L")
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "content": [canvas.output(info)]})

    kind = cells.schema["doc_id"].dataType.simpleString()
    return cells.select("doc_id", "seq", "text").groupBy("doc_id").applyInPandas(one, f"doc_id {kind}, content binary")


__all__ = ["MISSING", "Canvas", "Font", "Hooks", "State", "documents", "image_objects", "width_of", "wrap", "wrap_text"]
