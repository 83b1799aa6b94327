"""Printing subtrees: every element opens at its place and closes behind its last node, so
the text is an ordered concatenation of such events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def serialize(nodes: DataFrame, key: str = "page_id", newline: str = "\n") -> DataFrame:
    """(key, markup) of each document. An element is ``<name a="v">`` and ``</name>``, each
    with a newline behind it; values are not escaped, elements without end tag get one
    too, the document prints as ``#document``, a doctype as ``<!DOCTYPE html PUBLIC
    SYSTEM>`` with a newline, a comment and text as they are, a processing instruction
    as ``<? ?>``. Template contents are not printed. Repeated nodes print once."""
    element = F.col("kind").isin("element", "document")
    attrs = F.concat_ws("", F.transform(F.coalesce("attrs", F.array()), lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), a["value"], F.lit('"'))))
    nl = F.lit(newline)
    kind = F.col("kind")
    pub, sys_ = (F.coalesce(F.col(c), F.lit("")) if c in nodes.columns else F.lit("") for c in ("public_id", "system_id"))
    opening = (
        F.when(element, F.concat(F.lit("<"), F.col("local_name"), attrs, F.lit(">"), nl))
        .when(kind == "text", F.col("content"))
        .when(kind == "comment", F.concat(F.lit("<!--"), F.col("content"), F.lit("-->")))
        .when(kind == "pi", F.lit("<? ?>"))
        .when(kind == "doctype", F.concat(F.lit("<!DOCTYPE html "), pub, F.lit(" "), sys_, F.lit(">"), nl))
    )
    closing = F.when(element, F.concat(F.lit("</"), F.col("local_name"), F.lit(">"), nl))
    rows = nodes.where("template_of is null") if "template_of" in nodes.columns else nodes
    # closing events sort behind all that starts up to sub_end, the deeper ones first
    events = rows.select(
        key,
        F.inline(F.array(
            F.struct(F.col("node_id").alias("at"), F.lit(0).alias("ends"), F.col("node_id").alias("order"), opening.alias("s")),
            F.struct(F.col("sub_end").alias("at"), F.lit(1).alias("ends"), (-F.col("node_id")).alias("order"), closing.alias("s")),
        )),
    ).where("s is not null")
    # copies collapse before the one exchange, by page
    grouped = events.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("at", "ends", "order", "s"))).alias("l"))
    return grouped.select(key, F.array_join(F.transform("l", lambda x: x["s"]), "").alias("markup"))
