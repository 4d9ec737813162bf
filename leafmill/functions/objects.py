"""Values and files of the PDF format: reading, resolving, writing."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from json.encoder import encode_basestring_ascii

from leafmill.functions.filters import FilterError, decode

_SPACE = b"\0\t\n\f\r "
_TOKEN_END = re.compile(rb"[\0\t\n\f\r ()<>\[\]{}/%]")
_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_REF = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![A-Za-z0-9])")
_VALUE = rb"/([^\0\t\n\f\r ()<>\[\]{}/%]*+)|(\d++)[\0\t\n\f\r ]++(\d++)[\0\t\n\f\r ]++R(?![A-Za-z0-9])|([+-]?\d++)(?=[\0\t\n\f\r ()<>\[\]{}/%])"
#: The plain values that are most often, after spaces: a name; a reference; a whole number that ends here.
_OFTEN = re.compile(rb"[\0\t\n\f\r ]*+(?:" + _VALUE + rb")")
#: A dictionary's key and one of these values or the beginning of a dictionary or a list.
_PAIR = re.compile(rb"[\0\t\n\f\r ]*+/([^\0\t\n\f\r ()<>\[\]{}/%]*+)[\0\t\n\f\r ]*+(?:" + _VALUE + rb"|(<<)|(\[))")
_REFS = re.compile(rb"(?:[\0\t\n\f\r ]*+\d++[\0\t\n\f\r ]++\d++[\0\t\n\f\r ]++R(?![A-Za-z0-9]))++")
_DIGITS = re.compile(rb"\d+")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_HEADER = re.compile(rb"%PDF-(\d\.\d)")
_START = re.compile(rb"startxref\s+(\d+)")
_XREF = re.compile(rb"\s*xref\s+")
_STREAM = re.compile(rb"[\0\t\n\f\r ]*stream(\r\n|\n|\r)?")
_ENDSTREAM = re.compile(rb"\s*endstream")
_TABLE_HEAD = re.compile(rb"\s*(\d+)\s+(\d+)\s*")
_SPACES = re.compile(rb"\s*")
_TABLE_LINE = re.compile(rb"(\d{1,10})\s+(\d{1,5})\s+([nf])\s*")
#: Lines of a table as they should be, twenty bytes each.
_TABLE_LINES = re.compile(rb"(?:\d{10} \d{5} [nf](?: \n| \r|\r\n))*+")
_COUNT = re.compile(rb"/Count\s+(\d+)")
_OBJECT = re.compile(rb"(?<![0-9])(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj\b")


class Name(str):
    """A name without its slash."""

    __slots__ = ()


class Written(bytes):
    """A value as it stands in a file."""

    __slots__ = ()


@lru_cache(maxsize=1 << 12)
def _name(raw: bytes) -> Name:
    """The same few names are read again and again."""
    return Name(raw.decode("latin-1"))


@lru_cache(maxsize=1 << 12)
def _key(raw: bytes) -> str:
    return raw.decode("latin-1")


@dataclass(slots=True, unsafe_hash=True)  # not frozen, as such ones take three times as long to make
class Ref:
    obj: int
    gen: int = 0


@dataclass
class Hex:
    """A string that was written in hexadecimal digits."""

    data: bytes


@dataclass(slots=True)
class Stream:
    head: dict
    raw: bytes

    @property
    def filters(self) -> list[str]:
        f = self.head.get("Filter", self.head.get("F"))
        return [] if f is None else [str(x) for x in (f if isinstance(f, list) else [f])]

    def data(self) -> bytes:
        p = self.head.get("DecodeParms", self.head.get("DP"))
        return decode(self.raw, self.filters, p if isinstance(p, list) else [p])


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)


def unescape(body: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        x = m[1]
        if x[:1].isdigit():
            return bytes([int(x, 8) & 255])
        return b"" if x in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(x, x)

    return _ESCAPE.sub(one, body)


def escape(body: bytes) -> bytes:
    return body.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r")


def read_value(data: bytes, at: int) -> tuple[object, int]:
    """The value that begins at or after ``at``, and where it ends; values may be nested to any depth.

    What is open where the data end is closed there; a key without a value has null.
    """
    at = _SKIP.match(data, at).end()
    if data.startswith(b"<<", at):
        held, at = {}, at + 2
    elif data.startswith(b"[", at):
        held, at = [], at + 1
    elif at >= len(data):
        raise ValueError("no value")
    else:
        return _read_plain(data, at, data[at : at + 1])
    open_: list[tuple] = []  # the lists and dictionaries around ``held``, with their keys
    key = None  # what waits for its value
    pair, often = _PAIR.match, _OFTEN.match
    while True:
        named = type(held) is dict
        if named and key is None:
            if m := pair(data, at):
                kind, at, name = m.lastindex, m.end(), _key(m[1])
                if kind == 2:
                    held[name] = _name(m[2])
                elif kind == 4:
                    held[name] = Ref(int(m[3]), int(m[4]))
                elif kind == 5:
                    held[name] = int(m[5])
                else:
                    open_.append((held, name))
                    held = {} if kind == 6 else []
                continue
            if data.startswith(b">>", at):
                value, at = held, at + 2
                if not open_:
                    return value, at
                held, key = open_.pop()
                if type(held) is dict and key is not None:
                    held[key], key = value, None
                    continue
                if type(held) is list:
                    held.append(value)
                else:
                    key = ""
                continue
        elif not named and (m := _REFS.match(data, at)):
            at, numbers = m.end(), [int(x) for x in _DIGITS.findall(m[0])]
            held += map(Ref, numbers[::2], numbers[1::2])
            continue
        if m := often(data, at):
            kind, at = m.lastindex, m.end()
            value = _name(m[1]) if kind == 1 else Ref(int(m[2]), int(m[3])) if kind == 3 else int(m[4])
        else:
            at = _SKIP.match(data, at).end()
            lead = data[at : at + 1]
            if not lead or (lead == b"]" and not named) or (lead == b">" and named and data.startswith(b">>", at)):
                value = held
                if key is not None:
                    held[key] = None
                at += 2 if named else 1
                if not open_:
                    return value, at
                held, key = open_.pop()
                named = type(held) is dict
            elif lead == b"[" or data.startswith(b"<<", at):
                open_.append((held, key))
                held, key, at = ([], None, at + 1) if lead == b"[" else ({}, None, at + 2)
                continue
            else:
                value, at = _read_plain(data, at, lead)
        if not named:
            held.append(value)
        elif key is None:
            key = "" if isinstance(value, (list, dict)) else str(value)
        else:
            held[key], key = value, None


def _read_plain(data: bytes, at: int, lead: bytes) -> tuple[object, int]:
    """The value that begins at ``at`` with the byte ``lead``, if it is neither a list nor a dictionary."""
    if lead == b"/":
        m = _TOKEN_END.search(data, at + 1)
        end = m.start() if m else len(data)
        return Name(data[at + 1 : end].decode("latin-1")), end
    if lead == b"(":
        depth, i = 1, at + 1
        while depth and i < len(data):
            c = data[i]
            i += 2 if c == 0x5C else 1
            depth += (c == 0x28) - (c == 0x29)
        return unescape(data[at + 1 : i - 1]), i
    if lead == b"<":
        end = data.find(b">", at)
        end = len(data) if end < 0 else end
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
        return Hex(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())), end + 1
    if m := _REF.match(data, at):
        return Ref(int(m[1]), int(m[2])), m.end()
    if m := _NUMBER.match(data, at):
        return (float(m[0]) if b"." in m[0] else int(m[0])), m.end()
    m = _TOKEN_END.search(data, at)
    end = max(at + 1, m.start() if m else len(data))
    word = data[at:end]
    return {b"true": True, b"false": False, b"null": None}.get(word, Name(word.decode("latin-1"))), end


@lru_cache(maxsize=1 << 12)
def _written_name(value: str) -> bytes:
    return b"/" + re.sub(rb"[^!-~]|[#()<>\[\]{}/%]", lambda m: b"#%02X" % m[0][0], value.encode("latin-1", "replace"))


@lru_cache(maxsize=1 << 12)
def _written_key(value: str) -> bytes:
    return b"/" + value.encode("latin-1") + b" "


def write_value(value: object) -> bytes:
    kind = type(value)  # the most frequent ones first
    if kind is Ref:
        return b"%d %d R" % (value.obj, value.gen)
    if kind is Name:
        return _written_name(value)
    if kind is int:
        return b"%d" % value
    if kind is dict:
        return b"<<" + b" ".join([_written_key(k) + write_value(v) for k, v in value.items()]) + b">>"
    if kind is list:
        return b"[" + b" ".join([write_value(v) for v in value]) + b"]"
    if kind is Written:
        return value
    if kind is Stream and not value.head:
        return b"<</Length %d>>\nstream\n%b\nendstream" % (len(value.raw), value.raw)
    match value:
        case None:
            return b"null"
        case bool():
            return b"true" if value else b"false"
        case Name():
            return _written_name(value)
        case int():
            return str(value).encode()
        case float():
            return (f"{value:.5f}".rstrip("0").rstrip(".") or "0").encode()
        case bytes():
            return b"(" + escape(value) + b")"
        case str():
            plain = value.isascii()
            return b"(" + escape(value.encode() if plain else b"\xfe\xff" + value.encode("utf-16-be")) + b")"
        case Hex():
            return b"<" + value.data.hex().upper().encode() + b">"
        case Ref():
            return b"%d %d R" % (value.obj, value.gen)
        case list():
            return b"[" + b" ".join(map(write_value, value)) + b"]"
        case dict():
            return b"<<" + b" ".join(_written_key(k) + write_value(v) for k, v in value.items()) + b">>"
        case Stream():
            return write_value(value.head | {"Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    raise TypeError(type(value).__name__)


def serialize(objects: dict[int, object], trailer: dict, version: str = "1.4") -> bytes:
    """A whole file: objects in the order of their numbers, the table of their offsets, the trailer."""
    out, offset = bytearray(b"%%PDF-%s\n%%\xe2\xe3\xcf\xd3\n" % version.encode()), {}
    for n in sorted(objects):
        offset[n] = len(out)
        out += b"%d 0 obj\n" % n + write_value(objects[n]) + b"\nendobj\n"
    start, size = len(out), max(objects, default=0) + 1
    out += b"xref\n"
    for first, count in sections([0, *sorted(objects)]):
        out += b"%d %d\n" % (first, count)
        out += b"".join([b"%010d 00000 n \n" % offset[n] if n else b"0000000000 65535 f \n" for n in range(first, first + count)])
    out += b"trailer\n" + write_value(trailer | {"Size": size}) + b"\nstartxref\n%d\n%%%%EOF\n" % start
    return bytes(out)


def sections(numbers: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (first, count)."""
    runs: list[tuple[int, int]] = []
    for n in numbers:
        if runs and sum(runs[-1]) == n:
            runs[-1] = (runs[-1][0], runs[-1][1] + 1)
        else:
            runs.append((n, 1))
    return runs


def last_startxref(content: bytes) -> int | None:
    """The number after the last startxref that has one, searched from the end."""
    at = content.rfind(b"startxref")
    while at >= 0:
        if m := _START.match(content, at):
            return int(m[1])
        at = content.rfind(b"startxref", 0, at)
    return None


@dataclass(slots=True)
class Entry:
    obj: int
    gen: int = 0
    offset: int = -1
    free: bool = False
    objstm: int | None = None
    index: int | None = None
    section: int = 0


@dataclass
class File:
    """One document: sections of its cross-reference chain from the newest on, and objects on demand."""

    content: bytes
    oldest_wins: bool = False
    entries: dict[int, Entry] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    all_entries: list[Entry] = field(default_factory=list)
    _seen: dict[int, object] = field(default_factory=dict)
    _packed: dict[int, dict[int, object]] = field(default_factory=dict)

    def __post_init__(self):
        m = _HEADER.search(self.content[:8192])
        self.version = m[1].decode() if m else "1.3"
        at, visited, section = last_startxref(self.content), set(), 0
        while at is not None and at not in visited and 0 <= at < len(self.content):
            visited.add(at)
            try:
                entries, trailer = self._section(at)
            except (ValueError, KeyError, TypeError, IndexError, FilterError) as e:
                self.errors.append(f"xref at {at}: {e}")
                break
            for e in entries:
                e.section = section
                self.all_entries.append(e)
                if e.obj not in self.entries or self.oldest_wins:
                    self.entries[e.obj] = e
            self.trailer = trailer | self.trailer
            previous = trailer.get("Prev")
            at, section = previous if isinstance(previous, int) else None, section + 1
        if "Root" not in self.trailer or not self.entries:
            self._rebuild()

    def _section(self, at: int) -> tuple[list[Entry], dict]:
        if m := _XREF.match(self.content, at):
            return self._table(m.end())
        m = _OBJECT.match(self.content, _SKIP.match(self.content, at).end())
        if not m:
            raise ValueError("neither a table nor a stream")
        return self._table_stream(self._body(m.end()))

    def _table(self, at: int) -> tuple[list[Entry], dict]:
        out, head, line = [], _TABLE_HEAD, _TABLE_LINE
        while m := head.match(self.content, at):
            at, first, after = m.end(), int(m[1]), int(m[1]) + int(m[2])
            fast = _TABLE_LINES.match(self.content, at, min(len(self.content), at + 20 * int(m[2])))[0]
            parts = fast.split()
            out += map(Entry, range(first, after), map(int, parts[1::3]), map(int, parts[::3]), [k == b"f" for k in parts[2::3]])
            at, first = at + len(fast), first + len(fast) // 20
            if fast:
                at = _SPACES.match(self.content, at).end()
            for n in range(first, after):
                if not (e := line.match(self.content, at)):
                    break
                out.append(Entry(n, int(e[2]), int(e[1]), e[3] == b"f"))
                at = e.end()
        at = self.content.find(b"trailer", at)
        if at < 0:
            raise ValueError("no trailer")
        return out, read_value(self.content, at + 7)[0]

    def _table_stream(self, s: object) -> tuple[list[Entry], dict]:
        if not isinstance(s, Stream):
            raise ValueError("not a stream")
        data, widths = s.data(), s.head["W"]
        index = s.head.get("Index") or [0, s.head.get("Size", 0)]
        numbers = (n for a, k in zip(index[::2], index[1::2], strict=False) for n in range(a, a + k))
        out, step = [], sum(widths)
        for at, n in zip(range(0, len(data) - step + 1, step), numbers, strict=False):
            parts, p = [], at
            for w in widths:
                parts.append(int.from_bytes(data[p : p + w], "big") if w else None)
                p += w
            kind, a, b = 1 if parts[0] is None else parts[0], parts[1] or 0, parts[2] or 0
            if kind == 2:
                out.append(Entry(n, 0, -1, False, a, b))
            else:
                out.append(Entry(n, b, a, kind == 0))
        return out, {k: v for k, v in s.head.items() if k in ("Root", "Info", "Size", "Encrypt", "ID", "Prev")}

    def _rebuild(self) -> None:
        """Without a usable table: every object that the bytes show, the last of a number wins."""
        for m in _OBJECT.finditer(self.content):
            self.entries[int(m[1])] = Entry(int(m[1]), int(m[2]), m.start())
        for m in re.finditer(rb"trailer\s*(?=<<)", self.content):
            try:
                self.trailer |= read_value(self.content, m.end())[0]
            except ValueError as e:
                self.errors.append(str(e))
        if "Root" not in self.trailer:
            for n in sorted(self.entries):
                if isinstance(v := self.get(n), dict) and v.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(n)
        self.all_entries = self.all_entries or [*self.entries.values()]

    def _body(self, at: int) -> object:
        value, at = read_value(self.content, at)
        if isinstance(value, dict) and (m := _STREAM.match(self.content, at)):
            n = self.resolve(value.get("Length"))
            if not isinstance(n, int) or not _ENDSTREAM.match(self.content, m.end() + n):
                end = self.content.find(b"endstream", m.end())
                end = len(self.content) if end < 0 else end
                raw = self.content[m.end() : end]
                return Stream(value, raw[:-2] if raw.endswith(b"\r\n") else raw[:-1] if raw[-1:] in (b"\n", b"\r") else raw)
            return Stream(value, self.content[m.end() : m.end() + n])
        return value

    def get(self, obj: int) -> object:
        """The value of an object; None for a free or missing one."""
        if obj not in self._seen:
            self._seen[obj] = None
            e = self.entries.get(obj)
            if e and not e.free:
                if e.objstm is not None:
                    self._seen[obj] = self._unpack(e.objstm).get(obj)
                elif m := _OBJECT.match(self.content, e.offset) or _OBJECT.match(self.content, _SKIP.match(self.content, e.offset).end() if e.offset < len(self.content) else e.offset):
                    self._seen[obj] = self._body(m.end())
        return self._seen[obj]

    def _unpack(self, objstm: int) -> dict[int, object]:
        if objstm not in self._packed:
            self._packed[objstm] = out = {}
            s = self.get(objstm)
            if isinstance(s, Stream):
                data, first, n = s.data(), self.resolve(s.head.get("First")), self.resolve(s.head.get("N"))
                numbers = [int(x) for x in data[:first].split()]
                pairs = [*zip(numbers[::2], numbers[1::2], strict=False)][:n]
                if any(a[1] >= b[1] for a, b in zip(pairs, pairs[1:], strict=False)):  # all numbers, then all offsets
                    pairs = [*zip(numbers[:n], numbers[n : 2 * n], strict=False)]
                out |= {obj: read_value(data, first + off)[0] for obj, off in pairs if first + off < len(data)}
        return self._packed[objstm]

    def resolve(self, value: object) -> object:
        """The value at the end of a chain of references of any length; None for one that comes back to itself."""
        if not isinstance(value, Ref):
            return value
        passed: set[int] = set()
        while isinstance(value, Ref):
            if value.obj in passed:
                return None
            passed.add(value.obj)
            value = self.get(value.obj)
        return value

    def pages(self) -> Iterator[tuple[int, dict, dict]]:
        """(object number, page dictionary, what it inherits) in tree order; a node is visited once."""
        root = self.resolve(self.trailer.get("Root"))
        seen: set[int] = set()
        open_ = [(root.get("Pages"), {})] if isinstance(root, dict) else []
        while open_:
            ref, above = open_.pop()
            node = self.resolve(ref)
            number = ref.obj if isinstance(ref, Ref) else -1
            if not isinstance(node, dict) or (number >= 0 and number in seen):
                continue
            seen.add(number)
            here = above | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            kids = self.resolve(node.get("Kids"))
            if node.get("Type") == "Page" or not isinstance(kids, list):
                if node.get("Type") == "Page" or "Contents" in node or "MediaBox" in node:
                    yield number, node, here
            else:
                open_ += [(k, here | {"Parent": number}) for k in reversed(kids)]

    def streams(self, page: dict) -> list[Stream]:
        """The page's content streams, as they are stored."""
        value = self.resolve(page.get("Contents"))
        return [s for s in map(self.resolve, value if isinstance(value, list) else [value]) if isinstance(s, Stream)]

    def contents(self, page: dict) -> list[bytes]:
        return [s.data() for s in self.streams(page)]

    def page_counts(self) -> tuple[int, int, int]:
        """Pages of the tree; by the rule of splitting (the tree, else /Count, else the root's kids); and by that of merging.

        Merging trusts /Count of the root, then the first /Count in the bytes, then the tree, then takes one page.
        """
        tree = sum(1 for _ in self.pages())
        root = self.resolve(self.trailer.get("Root"))
        top = self.resolve(root.get("Pages")) if isinstance(root, dict) else None
        named, kids = (self.resolve(top.get(k)) if isinstance(top, dict) else None for k in ("Count", "Kids"))
        named = named if isinstance(named, int) else None
        split = tree or (named if named is not None else len(kids) if isinstance(kids, list) else 0)
        first = _COUNT.search(self.content)
        merge = (named or 0) if (named or 0) > 0 else int(first[1]) if first and int(first[1]) > 0 else tree or 1
        return tree, split, merge


def references(value: object, key: str = "") -> Iterator[tuple[str, Ref]]:
    """(path of keys, reference) of every reference in a value, nested to any depth."""
    open_ = [(key, value)]
    while open_:
        key, value = open_.pop()
        match value:
            case Ref():
                yield key, value
            case dict():
                open_ += [(f"{key}/{k}", v) for k, v in reversed(value.items()) if isinstance(v, (Ref, dict, list))]
            case list():
                open_ += [(f"{key}[{i}]", v) for i, v in reversed([*enumerate(value)]) if isinstance(v, (Ref, dict, list))]
            case Stream():
                open_.append((key, value.head))


def plain(value: object) -> object:
    """A value as JSON can hold it."""
    match value:
        case Ref():
            return {"$ref": [value.obj, value.gen]}
        case Name():
            return "/" + value
        case bytes():
            return value.decode("latin-1")
        case Hex():
            return {"$hex": value.data.hex()}
        case list():
            return [plain(v) for v in value]
        case dict():
            return {k: plain(v) for k, v in value.items()}
        case Stream():
            return plain(value.head)
    return value


def targets(value: object) -> list[Ref]:
    """The references of a value as ``references`` finds them, without their paths."""
    out, open_ = [], [value]
    while open_:
        value = open_.pop()
        if isinstance(value, Ref):
            out.append(value)
        elif isinstance(value, dict):
            open_ += [v for v in reversed(value.values()) if isinstance(v, (Ref, dict, list))]
        elif isinstance(value, list):
            open_ += [v for v in reversed(value) if isinstance(v, (Ref, dict, list))]
        elif isinstance(value, Stream):
            open_.append(value.head)
    return out


@lru_cache(maxsize=1 << 12)
def _json_name(value: str) -> str:
    return encode_basestring_ascii("/" + value)


_json_key = lru_cache(maxsize=1 << 12)(encode_basestring_ascii)


def json_text(value: object) -> str:
    """``json.dumps(plain(value))`` in one step."""
    kind = type(value)  # the most frequent ones first
    if kind is Ref:
        return f'{{"$ref": [{value.obj}, {value.gen}]}}'
    if kind is Name:
        return _json_name(value)
    if kind is int:
        return int.__repr__(value)
    if kind is dict:
        return "{" + ", ".join([_json_key(k) + ": " + json_text(v) for k, v in value.items()]) + "}"
    if kind is list:
        return "[" + ", ".join([json_text(v) for v in value]) + "]"
    if kind is Stream:
        return json_text(value.head)
    return json.dumps(plain(value))
