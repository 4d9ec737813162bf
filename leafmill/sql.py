"""The engine's functions under names that SQL can use: register(spark), then for example
``SELECT f.doc_id, p.* FROM files f, LATERAL pdf_page_texts(f.content) p``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leafmill.functions import charsets, filters
from leafmill.functions.objects import File
from leafmill.functions.text import page_text, text_operators


def _each(values: pd.Series, others: pd.Series, one) -> pd.Series:
    """``one(value, other)`` of each row; null where a value is null or cannot be done."""

    def safe(a, b):
        try:
            return None if a is None or b is None else one(a, b)
        except Exception:  # this row's bytes only
            return None

    return pd.Series([safe(a, b) for a, b in zip(values, others, strict=True)], dtype=object)


def _decoded(data: pd.Series, names: pd.Series) -> pd.Series:
    return _each(data, names, lambda d, n: filters.decode(d, list(n)))


def _encoded(data: pd.Series, names: pd.Series) -> pd.Series:
    return _each(data, names, lambda d, n: filters.encode(d, list(n)))


def _charset_encoded(text: pd.Series, charset: pd.Series) -> pd.Series:
    return _each(text, charset, charsets.encode_text)


def _charset_decoded(data: pd.Series, charset: pd.Series) -> pd.Series:
    return _each(data, charset, charsets.decode_text)


class PageTexts:
    """(page_no, text) of a file's pages."""

    def eval(self, content: bytes) -> Iterator[tuple[int, str]]:
        try:
            f = File(bytes(content or b""))
            for i, (_, page, inherited) in enumerate(f.pages(), 1):
                try:
                    yield i, "" if "Encrypt" in f.trailer else page_text(f, page, inherited)
                except Exception:  # this page only
                    yield i, ""
        except Exception:  # a file that cannot be read has no pages
            return


class XrefEntries:
    """(obj, gen, offset, free, section_no) of a file's cross-reference sections, the newest being 0."""

    def eval(self, content: bytes) -> Iterator[tuple[int, int, int, bool, int]]:
        try:
            for e in File(bytes(content or b"")).all_entries:
                yield e.obj, e.gen, e.offset, e.free, e.section
        except Exception:  # a file that cannot be read has no entries
            return


class TextOperators:
    """(pos, op, active_font, text) of a decoded content stream's operators."""

    def eval(self, content: bytes) -> Iterator[tuple[int, str, str, str]]:
        for op in text_operators(bytes(content or b"")):
            yield op["pos"], op["op"], op["active_font"], op["text"]


def register(spark: SparkSession) -> list[str]:
    """Registers all functions in the session and gives their names."""
    scalars = {
        "pdf_decode": (_decoded, "binary"), "pdf_encode": (_encoded, "binary"),
        "charset_encode": (_charset_encoded, "binary"), "charset_decode": (_charset_decoded, "string"),
    }
    for name, (f, kind) in scalars.items():
        spark.udf.register(name, F.pandas_udf(f, kind))
    tables = {
        "pdf_page_texts": (PageTexts, "page_no int, text string"), "pdf_xref_entries": (XrefEntries, "obj long, gen int, offset long, free boolean, section_no int"),
        "pdf_text_operators": (TextOperators, "pos int, op string, active_font string, text string"),
    }
    for name, (handler, schema) in tables.items():
        spark.udtf.register(name, F.udtf(handler, returnType=schema))
    return [*scalars, *tables]
