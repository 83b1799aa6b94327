"""Pages as units: the node table gathered by page, one page at a time in memory.

Rows of ``nodes`` that stand together in a scan are packed into one binary chunk
per page before the shuffle, so that a shuffle moves some rows per page instead
of one row per node. After it the chunks of a page meet, repeated nodes (rows or
whole pages that occur more than once) collapse, and a function sees the page as
lists in document order. A page is the unit the reference parses, and is as large
as one HTML document; no other group is ever held."""

from __future__ import annotations

import marshal
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEP = "\x1f"


class Page:
    """The elements and text nodes of a page, in document order.

    ``ids``, ``parents`` (positions in these lists, -1 for none), ``names`` (None
    for a text node) and ``data``: the text of a text node, the attributes of an
    element as ``name=value`` joined by SEP."""

    __slots__ = ("page_id", "url", "endpoint", "ids", "parents", "names", "data", "in_body", "in_code", "part")

    def __init__(self, page_id, url, endpoint, chunks: list[bytes]):
        self.page_id, self.url, self.endpoint = page_id, url, endpoint
        self._fill(*(marshal.loads(chunks[0]) if len(chunks) == 1 else _merge([marshal.loads(c) for c in chunks])))

    @classmethod
    def of(cls, ids: list, par: list, names: list, data: list) -> Page:
        """A page of lists, which it keeps."""
        page = cls.__new__(cls)
        page.page_id = page.url = page.endpoint = None
        page._fill(ids, par, names, data)
        return page

    def _fill(self, ids: list, par: list, names: list, data: list) -> None:
        self.ids, self.names, self.data = ids, names, data
        at = {n: i for i, n in enumerate(ids)}
        self.parents = [at.get(p, -1) for p in par]
        body = [False] * len(ids)
        code = [False] * len(ids)
        for i, p in enumerate(self.parents):
            name = names[i]
            if p >= 0:
                body[i] = body[p] or names[p] == "body"
                code[i] = code[p]
            if name in ("code", "pre", "script", "style"):
                code[i] = True
        self.in_body, self.in_code = body, code

    def raw(self, i: int) -> bool:
        """Whether node i is text of a script or style element."""
        p = self.parents[i]
        return p >= 0 and self.names[p] in ("script", "style")

    def attr(self, i: int, name: str) -> str | None:
        for part in (self.data[i] or "").split(SEP):
            k, eq, v = part.partition("=")
            if k == name and eq:
                return v
        return None


def _merge(parts):
    rows = {}
    for ids, par, names, data in parts:
        for r in zip(ids, par, names, data, strict=True):
            rows.setdefault(r[0], r)
    rows = sorted(rows.values(), key=lambda r: r[0])
    return tuple(map(list, zip(*rows, strict=True))) if rows else ([], [], [], [])


#: Chunks a task remembers to leave out exact copies of; forgetting some costs nothing but space.
REMEMBERED = 200_000


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to chunks. Copies of rows and of whole chunks go before the shuffle, so that
    a page with very many copies is moved a few times per task."""
    seen: set[int] = set()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        page = batch.column(0)
        keys = page.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), n]
        ids = batch.column(1).to_numpy(zero_copy_only=False)
        # where a page's ids don't rise there are copies
        back = (np.flatnonzero((ids[1:] <= ids[:-1]) & (keys[1:] == keys[:-1])) + 1).tolist()
        # as lists by way of numpy, which makes no object of Arrow's for each value
        cols = [batch.column(k).to_numpy(zero_copy_only=False).tolist() for k in (1, 2, 3, 4)]
        first, blobs, j = [], [], 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            parts = [c[a:b] for c in cols]
            while j < len(back) and back[j] < a:
                j += 1
            if j < len(back) and back[j] < b:
                parts = list(_merge([parts]))
            blob = marshal.dumps(parts)
            mark = hash((int(keys[a]), blob))
            if mark in seen:
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(mark)
            first.append(a)
            blobs.append(blob)
        if blobs:
            at = pa.array(first, pa.int64())
            yield pa.RecordBatch.from_arrays([page.take(at), pa.array(blobs, pa.binary()), batch.column(5).take(at)], names=["page_id", "blob", "endpoint"])


def page_chunks(nodes: DataFrame, pages: DataFrame | None = None, attributes: bool = True) -> DataFrame:
    """(page_id, blob, endpoint, url), partitioned and ordered by page_id. Rows with
    a null page_id or node_id belong to no page and are left out. With ``pages`` the
    page's url arrives in rows of its own (the first in order, if urls differ)."""
    attrs = F.when(F.col("local_name").isNotNull(), F.concat_ws(SEP, F.transform("attrs", lambda a: F.concat(a["name"], F.lit("="), F.coalesce(a["value"], F.lit(""))))))
    rows = nodes.where("kind in ('element', 'text') and page_id is not null and node_id is not null").select(
        "page_id", F.col("node_id").cast("int"), F.coalesce(F.col("parent_id").cast("int"), F.lit(-1)).alias("parent"),
        F.when(F.col("kind") == "element", F.coalesce(F.col("local_name"), F.lit(""))).alias("name"),
        F.coalesce("content", attrs if attributes else F.lit(None).cast("string")).alias("data"), "endpoint_id",
    )
    chunks = rows.mapInArrow(_chunk, "page_id bigint, blob binary, endpoint string").withColumn("url", F.lit(None).cast("string"))
    if pages is not None:
        urls = pages.where("page_id is not null and url is not null").select("page_id", F.lit(None).cast("binary").alias("blob"), F.lit(None).cast("string").alias("endpoint"), "url")
        chunks = chunks.unionByName(urls)
    return chunks.repartition("page_id").sortWithinPartitions("page_id", "url")


def each_page(batches: Iterator[pa.RecordBatch]) -> Iterator[Page]:
    """The pages of a partition of ``page_chunks``."""
    key, chunks, url, endpoint = None, [], None, None
    seen: set[bytes] = set()
    for batch in batches:
        for k, blob, e, u in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if k != key:
                if chunks:
                    yield Page(key, url, endpoint, chunks)
                key, chunks, url, endpoint = k, [], None, None
                seen.clear()
            if blob is not None and blob not in seen:
                seen.add(blob)
                chunks.append(blob)
            url = url or u
            endpoint = endpoint or e
    if chunks:
        yield Page(key, url, endpoint, chunks)


def map_pages(chunks: DataFrame, rows_of: Callable[[Iterator[Page]], Iterator[tuple]], schema: str, rows_per_batch: int = 4096) -> DataFrame:
    """``rows_of`` yields tuples of ``schema`` from a partition's pages."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for row in rows_of(each_page(batches)):
            out.append(row)
            if len(out) >= rows_per_batch:
                yield flush()
                out.clear()
        if out:
            yield flush()

    return chunks.mapInArrow(run, schema)
