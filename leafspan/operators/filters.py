"""Token-stream filters as running windows over a token table.

The window needs a page's tokens together and in order: one exchange on the key,
none if the tokens are partitioned by it already. ``parse(token_filter=...)`` does
the same inside the parser, without exchange and with an early stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tags import VOID


def attribute(name: str, attrs: str | Column = "attrs") -> Column:
    """The value of an attribute, null if missing."""
    a = F.col(attrs) if isinstance(attrs, str) else attrs
    return F.get(F.filter(a, lambda x: x["name"] == name), F.lit(0))["value"]


def token_filter(tokens: DataFrame, is_start: Column, key: str = "page_id", void_aware: bool = False) -> DataFrame:
    """Tokens from the first start tag for which ``is_start`` holds up to, not with, the end
    tag that balances it. Start tags without ``/`` open, whether or not their element
    has an end tag; ``void_aware`` leaves out those that have none. Pages without a
    match keep nothing; a self-closing match keeps nothing; stray end tags count."""
    w = Window.partitionBy(key).orderBy("tok_no").rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("type") == "start") & ~F.col("self_closing")
    if void_aware:
        opens = opens & ~F.col("name").isin(*sorted(VOID))
    step = F.when(opens, 1).when(F.col("type") == "end", -1).otherwise(0)
    df = tokens.withColumn("_started", F.max((F.col("type") == "start") & F.coalesce(is_start, F.lit(False))).over(w))
    df = df.withColumn("_depth", F.sum(F.when(F.col("_started"), step).otherwise(0)).over(w))
    df = df.withColumn("_stopped", F.max(F.col("_started") & (F.col("_depth") <= 0)).over(w))
    return df.where("_started and not _stopped").drop("_started", "_depth", "_stopped")


def first_tag_and_children(tokens: DataFrame, tag: str, key: str = "page_id", void_aware: bool = False) -> DataFrame:
    return token_filter(tokens, F.col("name") == tag, key, void_aware)


def only_element_with_id(tokens: DataFrame, tag: str, ident: str, key: str = "page_id", void_aware: bool = False) -> DataFrame:
    return token_filter(tokens, (F.col("name") == tag) & (attribute("id") == ident), key, void_aware)
