"""Small helpers of strings, arrays and download statistics, all plain Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How many of the last responses predict the next size.
RING = 16


def try_at(array: str | Column, i: int | Column) -> Column:
    """The element at a 0-based position, null when out of range, negative included."""
    return F.get(array, F.lit(i) if isinstance(i, int) else i)


def endpoint_key(endpoint: str | Column = "endpoint_id", url: str | Column = "url") -> Column:
    """The endpoint, else the host of the url, else 'unknown'."""
    u = F.col(url) if isinstance(url, str) else url
    host = F.nullif(F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    return F.coalesce(F.col(endpoint) if isinstance(endpoint, str) else endpoint, host, F.lit("unknown"))


def _div(a: Column, b: Column) -> Column:
    """Integer division that truncates towards zero; null by zero."""
    return F.call_function("try_divide", a - F.try_mod(a, b), b).cast("bigint")


def ring_average(df: DataFrame, value: str, by: str, order: list[str], size: int = RING, out: str = "ring_avg", slice_of: Column | None = None) -> DataFrame:
    """The truncating integer average of the last ``size`` rows' values before each row,
    by key and in order; null where there are none. A null value takes a place in
    the ring but isn't counted; rows that tie in ``order`` come in any order, so name
    enough columns.

    With ``slice_of`` a key's rows are cut into consecutive slices that follow
    ``order`` (the day, say), so that a key that holds a third of all rows is sorted in
    many tasks. A slice gets what it needs of the slices before it from a table of at
    most ``size`` rows per slice."""
    if slice_of is None:
        w = Window.partitionBy(by).orderBy(*order).rowsBetween(-size, -1)
        return df.withColumn(out, _div(F.sum(value).over(w), F.count(value).over(w)))
    d = df.withColumn("_slice", slice_of)
    last = Window.partitionBy(by, "_slice").orderBy(*[F.desc(c) for c in order])
    ends = d.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= size)
    ends = ends.groupBy(by, "_slice").agg(F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col(value).cast("bigint").alias("v")))).alias("_t"))
    w = Window.partitionBy(by).orderBy("_slice").rowsBetween(-size, -1)
    before = ends.select(by, "_slice", F.slice(F.reverse(F.flatten(F.collect_list("_t").over(w))), 1, size).alias("_b"))
    own = Window.partitionBy(by, "_slice").orderBy(*order).rowsBetween(-size, -1)
    j = d.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_s", F.sum(value).over(own)).withColumn("_c", F.count(value).over(own))
    j = j.withColumn("_key", F.coalesce(F.col(by).cast("string"), F.lit("\x00")))
    before = before.select(F.coalesce(F.col(by).cast("string"), F.lit("\x00")).alias("_bk"), F.col("_slice").alias("_bs"), "_b")
    j = j.join(before, (F.col("_key") == F.col("_bk")) & F.col("_slice").eqNullSafe(F.col("_bs")), "left")
    rest = F.transform(F.slice("_b", F.lit(1), F.greatest(F.lit(0), F.lit(size) - F.col("_n")).cast("int")), lambda x: x["v"])
    known = F.filter(rest, lambda v: v.isNotNull())
    total = F.coalesce("_s", F.lit(0)) + F.aggregate(known, F.lit(0).cast("bigint"), lambda x, v: x + v)
    return j.withColumn(out, _div(total, F.col("_c") + F.size(known))).drop("_slice", "_n", "_s", "_c", "_key", "_bk", "_bs", "_b")


def size_hint(ring: str | Column, content_length: str | Column, expected: str | Column) -> Column:
    """The first that is known: ring average, announced length, expected size, 0."""
    return F.coalesce(ring, content_length, expected, F.lit(0))


def split_set(c: str | Column, chars: str) -> Column:
    """Pieces between any of ``chars``, without the empty ones."""
    col = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(col, "[" + "".join("\\" + x if x in "\\]^-[&" else x for x in chars) + "]"), lambda x: x != "")


def split_on(c: str | Column, sentinel: str) -> Column:
    """Pieces between occurrences of ``sentinel``, without the empty ones. (The reference
    goes on one character behind a match, so that the rest of a longer sentinel leaks
    into the next piece; here the whole sentinel separates.)"""
    if not sentinel:
        raise ValueError("an empty sentinel separates nothing")
    col = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(col, re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", sentinel)), lambda x: x != "")


def contains_i(text: str | Column, part: str | Column) -> Column:
    """Whether a text contains another, whatever the case; an empty part always is."""
    t = F.col(text) if isinstance(text, str) else text
    p = F.lit(part) if isinstance(part, str) else part
    return F.contains(F.upper(t), F.upper(p))


def is_null_or_whitespace(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.isNull() | col.rlike(r"(?U)\A\s*\z")


def combine(prefix: str | Column, local: str | Column) -> Column:
    """``local``, or ``prefix:local`` if there is a prefix."""
    p, n = (F.col(x) if isinstance(x, str) else x for x in (prefix, local))
    return F.when(F.coalesce(p, F.lit("")) == "", n).otherwise(F.concat_ws(":", p, n))
