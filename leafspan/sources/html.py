"""Pages to tokens and nodes. One task parses a batch of pages; nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.options import ParseOptions, TokenFilter
from ..functions.tokenizer import tokenize as tokens_of
from ..functions.tree import COLUMNS, parse_nodes
from ..schema import NODE_STRUCT, NODES, TOKENS
from ..session import spread

#: Rows of an output batch, about; a page's rows are never split.
BATCH_ROWS = 16_384


def _keyed(pages: DataFrame, key: str, html: str | Column, length: str | Column | None) -> tuple[DataFrame, str]:
    text = F.col(html) if isinstance(html, str) else html
    if length is not None:
        text = F.substring(text, F.lit(1), F.col(length) if isinstance(length, str) else length)
    return spread(pages.select(F.col(key).alias("k"), text.alias("h"))), pages.schema[key].dataType.simpleString()


def _rows(df: DataFrame, key: str, kind: str, columns: str, of) -> DataFrame:
    schema = f"k {kind}, {columns}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    rest = pa.schema(list(arrow)[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []

            def flush(batch=batch):
                cols = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), rest, strict=True)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())).cast(arrow.field(0).type), *cols], schema=arrow)

            for i, h in enumerate(batch.column(1)):
                new = of(h.as_py())
                rows += new
                at += [i] * len(new)
                if len(rows) >= BATCH_ROWS:
                    yield flush()
                    rows.clear()
                    at.clear()
            if rows:
                yield flush()

    return df.mapInArrow(run, schema).withColumnRenamed("k", key)


#: Ids of repeated pages that are broadcast (some 64 MB); beyond, all pages are exchanged.
MAX_REPEATED = 4_000_000


def distinct_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The distinct rows of ``pages``. A pass over the key alone finds which pages occur more
    than once; only their rows are exchanged to collapse, all others go straight from
    the scan to the parser. The ids are broadcast if their number, which is counted
    first, is within MAX_REPEATED; else all rows are exchanged. A stream is left as it is."""
    if pages.isStreaming:
        return pages
    pages = spread(pages)
    repeated = pages.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_k")
    many = repeated.limit(MAX_REPEATED + 1).count()
    if many > MAX_REPEATED:
        return pages.distinct()
    if not many:
        return pages
    hit = F.col(key).eqNullSafe(F.col("_k"))
    return pages.join(F.broadcast(repeated), hit, "left_anti").unionByName(pages.join(F.broadcast(repeated), hit, "left_semi").distinct())


def tokenize(pages: DataFrame, html: str | Column = "html", key: str = "page_id", options: ParseOptions | None = None, length: str | Column | None = None) -> DataFrame:
    """(key, tok_no, type, name, self_closing, attrs, data): the tokens of each page, the
    last of which is ``eof``. Null html gives none, empty html only ``eof``. Repeated
    rows give their tokens again; other columns are not read."""
    o = options or ParseOptions()

    def of(h):
        return [(i, t, n, c, a if a is not None else None, d) for i, (t, n, c, a, d) in enumerate(tokens_of(h, o))]

    df, kind = _keyed(pages, key, html, length)
    return _rows(df, key, kind, TOKENS, of)


def parse(
    pages: DataFrame,
    html: str | Column = "html",
    key: str = "page_id",
    options: ParseOptions | None = None,
    token_filter: TokenFilter | None = None,
    length: str | Column | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """(key, node columns): one row for each node, in document order within a page.

    ``token_filter`` drops everything but one subtree before nodes exist and stops the
    tokenizer behind it; ``length`` (a column) parses only so many characters.
    ``columns`` names the node columns wanted: what isn't is neither built nor sent.
    ``ancestors`` is null unless named there, as it grows with the square of the depth.
    Null html gives no rows, empty html the document with html, head and body;
    malformed pages never fail. Repeated rows give their nodes again."""
    o = options or ParseOptions()
    names = list(columns or COLUMNS)
    pick = [COLUMNS.index(c) for c in names]
    ddl = {c.strip().split(" ")[0]: c.strip() for c in NODES.split(", ")}
    up = "ancestors" in (columns or ())

    def of(h):
        rows = parse_nodes(h, o, token_filter, up)
        return rows if len(pick) == len(COLUMNS) else [tuple(r[i] for i in pick) for r in rows]

    df, kind = _keyed(pages, key, html, length)
    return _rows(df, key, kind, ", ".join(ddl[c] for c in names), of)


def parse_nested(pages: DataFrame, html: str | Column = "html", key: str = "page_id", options: ParseOptions | None = None, token_filter: TokenFilter | None = None, ancestors: bool = False) -> DataFrame:
    """(key, nodes ARRAY<STRUCT>): one row for each page; a node's position in the array is
    its node_id, so ``parent_id`` and ``ancestors`` (null unless wanted) are positions.
    Null html gives a null array."""
    o = options or ParseOptions()
    df, kind = _keyed(pages, key, html, None)
    schema = f"k {kind}, nodes array<{NODE_STRUCT}>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = []
                for h in part.column(1):
                    h = h.as_py()
                    out.append(None if h is None else [dict(zip(COLUMNS, (*r[:8], None if r[8] is None else [{"name": a, "value": b} for a, b in r[8]], *r[9:]), strict=True)) for r in parse_nodes(h, o, token_filter, ancestors)])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), pa.array(out, arrow.field(1).type)], schema=arrow)

    return df.mapInArrow(run, schema).withColumnRenamed("k", key)


def lexical_tokens(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, tok_no, tok, type, name, self_closing): tokens by pattern alone, inside the
    JVM. Script bodies are emptied first. For counting and selecting on well-formed
    regions; ``tokenize`` is the exact one. Null html gives none."""
    emptied = F.regexp_replace(F.col(html), r"(?is)(<script[^>]*>).*?(</script>)", "$1$2")
    toks = F.expr(r"regexp_extract_all(h, '(?is)<!--.*?-->|<[/!a-z][^>]*>|[^<]+|<', 0)")
    rows = pages.where(F.col(html).isNotNull()).select(F.col(key), emptied.alias("h")).select(key, F.posexplode(toks).alias("tok_no", "tok"))
    kind = (
        F.when(F.col("tok").rlike("(?i)^<[a-z]"), "start").when(F.col("tok").rlike("(?i)^</[a-z]"), "end")
        .when(F.col("tok").rlike("^<!--"), "comment").when(F.col("tok").rlike("(?i)^<!doctype"), "doctype").when(F.col("tok").rlike("^<!"), "comment").otherwise("text")
    )
    return rows.select(key, "tok_no", "tok", kind.alias("type"), F.lower(F.regexp_extract("tok", "(?i)^</?([a-z][a-z0-9]*)", 1)).alias("name"), F.col("tok").rlike("(?s)^<[a-zA-Z].*/>$").alias("self_closing"))
