"""Which encoding a response body is in, and its text.

The announced charset wins, and a byte-order mark of that charset is skipped; without
one a mark decides; else UTF-8. UTF-8 is decoded inside the JVM, with U+FFFD for what
is malformed; other charsets go through an Arrow UDF."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: byte-order marks, longest first where one begins another
MARKS = (("EFBBBF", "utf-8", 3), ("FFFE0000", "utf-32le", 4), ("FFFE", "utf-16le", 2), ("FEFF", "utf-16be", 2))


class InvalidCharset(ValueError):
    """An announced charset that no codec knows."""


def header_charset(content_type: str | Column = "content_type") -> Column:
    """The charset of a content-type header without one pair of quotes, null if missing."""
    c = F.col(content_type) if isinstance(content_type, str) else content_type
    raw = F.nullif(F.trim(F.regexp_extract(c, r"(?i)(?:^|;)\s*charset\s*=\s*([^;]*)", 1)), F.lit(""))
    quoted = (F.length(raw) > 2) & raw.startswith('"') & raw.endswith('"')
    return F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)


def _head(body: Column) -> Column:
    return F.hex(F.substring(body, 1, 4))


def sniff(body: str | Column) -> Column:
    """STRUCT<charset, bom_length> by byte-order mark; null without one, or for null."""
    b = F.col(body) if isinstance(body, str) else body
    out = None
    for mark, name, n in MARKS:
        hit = F.struct(F.lit(name).alias("charset"), F.lit(n).alias("bom_length"))
        out = F.when(_head(b).startswith(mark), hit) if out is None else out.when(_head(b).startswith(mark), hit)
    return out


def preamble_length(body: str | Column, charset: str | Column) -> Column:
    """How many bytes of the mark of a given charset a body begins with."""
    b = F.col(body) if isinstance(body, str) else body
    name = F.lower(F.col(charset) if isinstance(charset, str) else charset)
    alias = F.regexp_replace(name, "[^a-z0-9]", "")
    out = F.when(alias.isin("utf8", "unicode11utf8", "65001") & _head(b).startswith("EFBBBF"), 3)
    out = out.when(alias.isin("utf32", "utf32le", "12000") & _head(b).startswith("FFFE0000"), 4)
    out = out.when(alias.isin("utf16", "utf16le", "unicode", "1200") & _head(b).startswith("FFFE"), 2)
    out = out.when(alias.isin("utf16be", "unicodefffe", "1201") & _head(b).startswith("FEFF"), 2)
    return out.otherwise(0)


def determine_encoding(body: str | Column, content_type: str | Column = "content_type") -> Column:
    """STRUCT<charset, bom_length> of a response; UTF-8 where nothing says otherwise."""
    b = F.col(body) if isinstance(body, str) else body
    named = header_charset(content_type)
    return F.when(named.isNotNull(), F.struct(F.lower(named).alias("charset"), preamble_length(b, named).alias("bom_length"))).otherwise(
        F.coalesce(sniff(b), F.struct(F.lit("utf-8").alias("charset"), F.lit(0).alias("bom_length")))
    )


def decode(body: str | Column, content_type: str | Column = "content_type", on_unknown: str = "error") -> Column:
    """The text of a response body, without its mark; null stays null. ``on_unknown``:
    an unknown charset raises InvalidCharset (``error``), gives null (``null``), or is
    taken as UTF-8 (``utf-8``)."""
    if on_unknown not in ("error", "null", "utf-8"):
        raise ValueError("on_unknown must be error, null or utf-8")
    b = F.col(body) if isinstance(body, str) else body
    enc = determine_encoding(b, content_type)
    rest = F.substring(b, enc["bom_length"] + 1, F.length(b))
    native = F.call_function("make_valid_utf8", rest.cast("string"))

    @F.pandas_udf("string")
    def other(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for raw, names in parts:
            out = []
            for r, name in zip(raw, names, strict=True):
                if r is None or name is None:
                    out.append(None)
                    continue
                try:
                    codec = codecs.lookup(name.strip())
                except LookupError:
                    if on_unknown == "error":
                        raise InvalidCharset(f"Invalid charset: {name}") from None
                    if on_unknown == "null":
                        out.append(None)
                        continue
                    codec = codecs.lookup("utf-8")
                out.append(codec.decode(bytes(r), "replace")[0])
            yield pd.Series(out, dtype=object)

    is_native = enc["charset"].isin("utf-8", "utf8")
    # the UDF gets null where the JVM decodes, so those bodies don't travel
    return F.when(is_native, native).otherwise(other(F.when(~is_native, rest), F.when(~is_native, enc["charset"])))
