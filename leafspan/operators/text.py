"""Text of subtrees: an ordered aggregation of the text nodes below a node."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import Predicate
from .query import by_page

# fixed values: four different sets of white space
TAIL_SPACE = "[ \\t\\n\\r\\f]"
UNICODE_TRIM = r"(?U)^\s+|\s+\z"
UNICODE_TRIM_START = r"(?U)\A\s+"


def trim_unicode(c: Column) -> Column:
    return F.regexp_replace(c, UNICODE_TRIM, "")


def strip_tail(c: Column) -> Column:
    """White space at the end goes, except that the first character always stays."""
    return F.regexp_replace(c, rf"(?s)(?<=.){TAIL_SPACE}+\z", "")


def join_texts(texts: Column, trim: str = "none", prefix: Column | None = None) -> Column:
    """One text from an ordered array of them. ``none``: as they are. ``nodes``: each
    trimmed on both sides. ``ends``: the first trimmed at its start, the whole at its
    end. ``prefix`` comes before and takes part in the trimming at the end."""
    if trim == "nodes":
        texts = F.transform(texts, trim_unicode)
    elif trim == "ends":
        texts = F.transform(texts, lambda t, i: F.when(i == 0, F.regexp_replace(t, UNICODE_TRIM_START, "")).otherwise(t))
    elif trim != "none":
        raise ValueError(f"trim must be none, nodes or ends, not {trim}")
    out = F.array_join(texts, "")
    if prefix is not None:
        out = F.concat(F.coalesce(prefix, F.lit("")), out)
    return strip_tail(out) if trim == "ends" else out


def text_content(nodes: DataFrame, of: DataFrame | Predicate, trim: str = "none", key: str = "page_id", prefix: str | None = None, consume: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, node_id, text) for each node of ``of``: the text nodes strictly below it, in
    document order; contents of templates are not below it. A node without text, and a
    text node itself, give ''. ``prefix`` names a column of ``of``; ``consume`` is applied
    to the text. Copies of rows count once; rows with a null key give none.

    With a predicate for ``of`` the table is read once and exchanged once, by page, and
    what isn't wanted stays behind. With a table, both sides are exchanged by page and
    joined there with the interval as a condition. A group is at most one page."""
    if isinstance(of, Predicate):
        target = F.coalesce(of.on_row(), F.lit(False))
        if "template_of" in nodes.columns:
            target = target & F.col("template_of").isNull()
        is_text = F.col("kind") == "text"
        rows = nodes.where((is_text | target) & F.col(key).isNotNull())
        row = F.struct(F.col("node_id").alias("n"), F.col("sub_end").alias("e"), target.alias("of"), F.when(is_text, F.col("content")).alias("t"), (F.col(prefix) if prefix else F.lit(None).cast("string")).alias("x"))
        pages = rows.groupBy(key).agg(F.sort_array(F.collect_set(row)).alias("_l"))
        pages = pages.select(key, F.filter("_l", lambda r: r["of"]).alias("_a"), F.filter("_l", lambda r: r["t"].isNotNull()).alias("_t"))

        def one(a: Column) -> Column:
            below = F.transform(F.filter("_t", lambda r: (r["n"] > a["n"]) & (r["n"] <= a["e"])), lambda r: r["t"])
            return F.struct(a["n"].alias("node_id"), join_texts(below, trim, a["x"] if prefix else None).alias("text"))

        out = pages.select(key, F.inline(F.transform("_a", one)))
        return out.withColumn("text", consume(F.col("text"))) if consume else out
    names = ["node_id", "sub_end", *([prefix] if prefix else [])]
    a = by_page(of, *names, key=key).select(F.col(key).alias("_p"), F.col("node_id").alias("_n"), F.col("sub_end").alias("_e"), *([F.col(prefix).alias("_x")] if prefix else []))
    texts = by_page(nodes.where("kind = 'text'"), "node_id", "content", key=key).select(F.col(key).alias("_tp"), F.col("node_id").alias("_tn"), F.col("content").alias("_t"))
    joined = a.join(texts, (F.col("_p") == F.col("_tp")) & (F.col("_tn") > F.col("_n")) & (F.col("_tn") <= F.col("_e")), "left")
    by = ["_p", "_n"] + (["_x"] if prefix else [])
    grouped = joined.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(F.col("_tn").isNotNull(), F.struct("_tn", "_t")))).alias("_l"))
    out = join_texts(F.transform("_l", lambda x: x["_t"]), trim, F.col("_x") if prefix else None)
    return grouped.select(F.col("_p").alias(key), F.col("_n").alias("node_id"), (consume(out) if consume else out).alias("text"))
