"""Scalar functions in Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points to a unit.
UNITS = {"pt": 1.0, "point": 1.0, "mm": 72 / 25.4, "millimeter": 72 / 25.4, "cm": 72 / 2.54, "centimeter": 72 / 2.54, "in": 72.0, "inch": 72.0}
#: Page widths and heights in points.
PAGE_SIZES = {"a3": (841.89, 1190.55), "a4": (595.28, 841.89), "a5": (420.94, 595.28), "letter": (612.0, 792.0), "legal": (612.0, 1008.0)}


def pdf_escape(text: Column) -> Column:
    """Backslashes, parentheses and carriage returns with a backslash before."""
    for plain, escaped in (("\\", "\\\\"), ("(", "\\("), (")", "\\)"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def charset_of(data: Column) -> Column:
    """UTF-16BE by its mark, else UTF-8 if the bytes are valid, else ISO-8859-1."""
    return F.when(F.hex(F.substring(data, 1, 2)) == "FEFF", "UTF-16BE").when(F.is_valid_utf8(data), "UTF-8").otherwise("ISO-8859-1")


def hex_decode(digits: Column) -> Column:
    """Bytes of hexadecimal digits without white space; an odd last digit is followed by 0."""
    plain = F.regexp_replace(F.regexp_replace(digits, ">.*$", ""), r"\s", "")
    return F.unhex(F.concat(plain, F.when(F.length(plain) % 2 == 1, "0").otherwise("")))


def string_width(text: Column, widths: dict[str, int], default: int, size: float) -> Column:
    """Sum of the glyph widths in thousandths, times the size; a missing glyph has the default width."""
    table = F.create_map(*[F.lit(x) for kv in widths.items() for x in kv])
    units = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda acc, c: acc + F.when(c == "", 0).otherwise(F.coalesce(F.element_at(table, c), F.lit(default))))
    return units * F.lit(size / 1000)


def pdf_date(ts: Column, zone: str = "UTC") -> Column:
    """D:YYYYMMDDHHMMSS+HH'MM' of a timestamp, as a clock in ``zone`` shows it, whatever the session's zone is."""
    here = F.convert_timezone(F.current_timezone(), F.lit(zone), ts.cast("timestamp_ntz"))
    away = F.timestamp_diff("MINUTE", F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")), here)
    offset = F.concat(F.when(away < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(away) / 60).cast("string"), 2, "0"), F.lit("'"), F.lpad((F.abs(away) % 60).cast("string"), 2, "0"), F.lit("'"))
    return F.concat(F.lit("D:"), F.date_format(here, "yyyyMMddHHmmss"), offset)


def used_resources(content: Column, operator: str) -> Column:
    """The distinct names before an operator (Tf or Do) in the order of first use."""
    number = r"\s+[\d.]+" if operator == "Tf" else ""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(rf"/([^\s/<>\[\]()]+){number}\s+{operator}"), 1))


def rename_resource(content: Column, old: str, new: str) -> Column:
    """The content with one resource under a new name; names that only begin like it stay."""
    return F.regexp_replace(content, rf"/\Q{old}\E(?![A-Za-z0-9_])", F.lit("/" + new.replace("\\", "\\\\").replace("$", "\\$")))


def replace_text(content: Column, names: dict[str, str]) -> Column:
    """Plain replacements one after the other, longer names first, without a look at what follows."""
    for old, new in sorted(names.items(), key=lambda x: (-len(x[0]), x[0])):
        content = F.replace(content, F.lit(old), F.lit(new))
    return content


def media_box(own: Column, inherited: Column) -> Column:
    """A page's own box, else the inherited one, else letter size."""
    return F.coalesce(own, inherited, F.array(*[F.lit(float(x)) for x in (0, 0, 612, 792)]))


def scale_factor(unit: Column) -> Column:
    """Points to a unit by its name; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.lower(unit))


def page_size(name: Column, unit: Column | None = None) -> Column:
    """(width, height) of a named size in a unit (points without one), null for an unknown one."""
    sizes = F.create_map(*[x for n, (w, h) in PAGE_SIZES.items() for x in (F.lit(n), F.struct(F.lit(w).alias("width"), F.lit(h).alias("height")))])
    found, k = F.element_at(sizes, F.lower(name)), F.lit(1.0) if unit is None else scale_factor(unit)
    return F.when(found.isNotNull() & k.isNotNull(), F.struct((found["width"] / k).alias("width"), (found["height"] / k).alias("height")))


def upright(width: Column, height: Column) -> Column:
    """A size of two numbers as (width, height) of which the width is the smaller."""
    return F.struct(F.least(width, height).alias("width"), F.greatest(width, height).alias("height"))


def same_size(a: Column, b: Column) -> Column:
    return (a["width"] == b["width"]) & (a["height"] == b["height"])


def box_width(box: Column) -> Column:
    """Of [left, bottom, right, top]."""
    return F.get(box, 2) - F.get(box, 0)


def box_height(box: Column) -> Column:
    return F.get(box, 3) - F.get(box, 1)


def text_string(text: Column) -> Column:
    """A text in parentheses: ASCII as it is, all else as UTF-16 after its mark; as bytes."""
    from leafmill.functions import charsets

    def escaped(data: Column) -> Column:
        plain = F.decode(data, "ISO-8859-1")
        return F.encode(F.concat(F.lit("("), pdf_escape(plain), F.lit(")")), "ISO-8859-1")

    return escaped(charsets.encode(text, "UTF-8"))


def http_parameter(name: str, value: Column) -> Column:
    """A header's parameter: quoted if it is ASCII, else in UTF-8 percent codes."""
    coded = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for plain, code in (("~", "%7E"),):
        coded = F.replace(coded, F.lit(code), F.lit(plain))
    coded = F.replace(coded, F.lit("*"), F.lit("%2A"))
    return F.when(is_ascii(value), F.concat(F.lit(f'{name}="'), value, F.lit('"'))).otherwise(F.concat(F.lit(f"{name}*=UTF-8''"), coded))


def format_bytes(n: Column) -> Column:
    """A number of bytes with a unit of 1,024s, at most two decimals."""
    size, out = F.abs(n), None
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        number = F.regexp_replace(F.round(size / 1024**power, 2).cast("decimal(38,2)").cast("string"), r"\.?0+$", "")
        shown = F.concat(number, F.lit(f" {unit}"))
        out = F.when(size >= 1024**power, shown) if out is None else out.when(size >= 1024**power, shown)
    return F.when(n == 0, "0 B").otherwise(F.concat(F.when(n < 0, "-").otherwise(""), out))


def near(content: Column, at: Column, keyword: str, reach: int = 128) -> Column:
    """Where the keyword first stands (from 0 on) within so many bytes of a place; null if it does not."""
    first = F.greatest(at - reach, F.lit(0))
    found = F.instr(F.decode(F.substring(content, first + 1, at + reach - first), "ISO-8859-1"), keyword)
    return F.when(found > 0, first + found - 1)


def _path(key: str) -> str:
    if "'" in key or "]" in key:
        raise ValueError(f"not a key: {key}")
    return f"$['{key}']"


def entry(value: Column, key: str) -> Column:
    """A dictionary's entry, as JSON text (names begin with a slash); null without it. ``value`` is as in ``pdf_objects``."""
    return F.get_json_object(value, _path(key))


def has_entry(value: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(value), key), F.lit(False))


def _entries(value: Column) -> Column:
    return F.from_json(value, "map<string,variant>")


def with_entry(value: Column, key: str, new: Column) -> Column:
    """The dictionary with an entry (JSON text) set; it stands last, also if it was there before."""
    return F.to_json(F.map_concat(F.map_filter(_entries(value), lambda k, _: k != key), F.create_map(F.lit(key), F.parse_json(new))))


def without_entry(value: Column, key: str) -> Column:
    return F.to_json(F.map_filter(_entries(value), lambda k, _: k != key))


def items(value: Column) -> Column:
    """An array's items as JSON texts."""
    return F.transform(F.from_json(value, "array<variant>"), lambda v: F.to_json(v))


def item(value: Column, place: int) -> Column:
    """An array's item from 0 on, as JSON text; null outside."""
    return F.get(items(value), place)


def count_items(value: Column) -> Column:
    return F.size(items(value))


def with_item(value: Column, place: int, new: Column) -> Column:
    """The array with one item (JSON text) in the place of another."""
    return F.to_json(F.transform(F.from_json(value, "array<variant>"), lambda v, i: F.when(i == place, F.parse_json(new)).otherwise(v)))


def added(value: Column, new: Column) -> Column:
    """The array with an item (JSON text) behind."""
    return F.to_json(F.array_append(F.from_json(value, "array<variant>"), F.parse_json(new)))
