"""Problem 2: page boilerplate mixed with main content.

Method: suffix arrays over the pages of a host. A page becomes a stream of tokens, one
for each element (name, identifying attributes, link target) and each text node below
``body``. The streams of a block of pages are concatenated, a suffix array is built by
prefix doubling, and its LCP array groups the suffixes that share LONG tokens. What a
group starts with is a seed; on how many distinct pages of the host each seed occurs is
summed over all blocks of the host, so blocks bound the work of a task and decide
nothing. On a page, frequent seeds that overlap chain into maximal repeated runs: a
substring of LONG tokens or more is on LEAST pages only if all its seeds are, and the
text that maximal repeats cover is the text that their seeds cover. Runs that hold two
texts, or a link and a text, cover them; what no run covers is unique.

Coverage is then summed by element position in the host's layout (the path of
names and attributes), and subtrees that are covered for the most part go as a
whole, so that a unique line of a footer goes with it and a repeated phrase of an
article stays.

Hosts with fewer than LEAST pages, and pages without a host, can't show a repeat by
themselves; they are taken together as if they were one host of many blocks. No group
is ever larger than a block's expected size, whatever share of the pages a host has.
"""

from __future__ import annotations

import marshal
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_table
from .encoding import sample_counts
from .pages import SEP, Page, map_pages, page_chunks
from .residue import kept_finder

#: Pages in a block, about.
BLOCK_PAGES = 64
#: Up to so many hosts (some 10 MB) their page counts are broadcast; beyond, joined by shuffles,
#: those of hosts of more than a block in SALTS parts each.
MAX_BROADCAST_SITES, SALTS = 100_000, 64
#: Tokens that make a substring long.
LONG = 4
#: Distinct pages of a host, of whatever size, that make it repeated; among the pages of hosts that
#: have fewer, taken together, the two that such a host can have.
LEAST, LEAST_POOLED = 3, 2
#: Share of the texts at a place of the layout that is covered, without which a covered subtree is chance.
THERE = 0.15
_KEEP_ATTRS = ("class", "id", "role", "type", "action", "name", "aria-label", "itemprop")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", re.I)


def site_of(url: str | None, endpoint: str | None) -> str:
    """The host of the url, else an endpoint that looks like a host, else ''."""
    m = _HOST.match(url or "")
    if m:
        return m.group(1).lower()
    return endpoint.lower() if endpoint and "." in endpoint else ""


@lru_cache(100_000)
def _element(name: str, data: str) -> tuple[int, int, int]:
    """Of an element: the print of its name and attributes, its token, and what it is."""
    key, href = name, ""
    if data:
        for part in data.split(SEP):
            k, _, v = part.partition("=")
            if k in _KEEP_ATTRS:
                key += SEP + part
            elif k == "href":
                href = SEP + v
    own = crc32(key.encode())
    return own, crc32((key + href).encode()) if href else own, 1 if href else 2 if name == "h1" else 0


def page_tokens(page: Page) -> tuple[list[int], ...]:
    """Of the nodes below body, in document order: node positions, parents (indexes
    into these lists, -1 at the top), tokens, layout paths (of an element its name and
    attributes without link target and its parent's path, of a text its parent's), and what a node is: 0 element, 1 link, 2 heading h1, 3 text, 4 text of code or
    of script and style."""
    pos, par, tok, lay, kind = [], [], [], [], []
    index: dict[int, int] = {}
    for i, name in enumerate(page.names):
        if not page.in_body[i]:
            continue
        index[i] = len(pos)
        pos.append(i)
        par.append(index.get(page.parents[i], -1))
        data = page.data[i] or ""
        if name is None:
            tok.append(crc32(("\x02" + data.strip()).encode()))
            lay.append(lay[par[-1]] if par[-1] >= 0 else 0)
            kind.append(4 if page.raw(i) else 3)
            continue
        own, token, what = _element(name, data)
        lay.append(crc32(own.to_bytes(4, "little"), lay[par[-1]] if par[-1] >= 0 else 0))
        tok.append(token)
        kind.append(what)
    return pos, par, tok, lay, kind


def suffix_array(s: np.ndarray, most: int = 64) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of an integer sequence by prefix doubling, and the ranks by
    prefixes of 1, 2, 4, ... tokens. Suffixes equal in ``most`` tokens count as equal."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    ranks, k, n = [rank], 1, len(s)
    while k < most and (n == 0 or rank.max() < n - 1):
        nxt = np.full(n, -1, np.int64)
        nxt[: n - k] = rank[k:]
        rank = np.unique(rank * (n + 1) + nxt + 1, return_inverse=True)[1].astype(np.int64)
        ranks.append(rank)
        k *= 2
    return np.argsort(rank, kind="stable"), ranks


def lcp_array(sa: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length of the prefix each suffix shares with the one before it in ``sa``."""
    n = len(sa)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    a, b = sa[:-1].copy(), sa[1:].copy()
    got = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        k, r = 1 << level, ranks[level]
        ok = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[ok] = r[a[ok]] == r[b[ok]]
        got[same] += k
        a[same] += k
        b[same] += k
    out[1:] = got
    return out


def shared(tokens: list[list[int]], *longs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By one suffix array, for each of ``longs``: for each position of the concatenated streams
    the group of those that have the same ``long`` tokens from there on; for each group, on
    how many distinct pages."""
    sizes = [len(t) for t in tokens]
    total = sum(sizes) + len(tokens)
    s = np.empty(total, np.int64)
    owner = np.empty(total, np.int64)
    at = 0
    for k, t in enumerate(tokens):
        s[at : at + len(t)] = t
        s[at + len(t)] = -1 - k  # a separator of its own ends each page
        owner[at : at + len(t) + 1] = k
        at += len(t) + 1
    sa, ranks = suffix_array(s, max(4, *longs))
    lcp, pages = lcp_array(sa, ranks), owner[sa]
    for long in longs:
        group = np.cumsum(lcp < long)
        pairs = np.unique(group * len(tokens) + pages)
        support = np.bincount(pairs // len(tokens), minlength=int(group.max()) + 1 if total else 1)
        out = np.empty(total, np.int64)
        out[sa] = group
        yield out, support


def repeated(tokens: list[list[int]], long: int, least: int) -> np.ndarray:
    """For each position of the concatenated streams, whether the ``long`` tokens from
    it on occur on at least ``least`` distinct pages."""
    ((group, support),) = shared(tokens, long)
    return support[group] >= least


_PRIME = np.uint64(0x9E3779B97F4A7C15)


def run_prints(tok: list[int], long: int) -> np.ndarray:
    """A fingerprint of the ``long`` tokens from each position on, the same on every page."""
    t = np.array(tok, np.uint64)
    n = max(0, len(t) - long + 1)
    out = np.full(n, long, np.uint64)
    for j in range(long):
        out = (out ^ t[j : j + n]) * _PRIME
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def maximal_runs(starts: np.ndarray, long: int) -> list[tuple[int, int]]:
    """(start, end) of the runs that seeds of ``long`` tokens at ``starts`` (rising) chain into:
    seeds that overlap or touch are one run."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > long) + 1
    first = starts[np.concatenate([[0], cut])]
    last = starts[np.concatenate([cut - 1, [len(starts) - 1]])]
    return list(zip(first.tolist(), (last + long).tolist(), strict=True))


def _telling(kind: list[int], text: int = 3) -> np.ndarray:
    """For each position, whether the run from it on holds two texts, or a link and a text."""
    k = np.array(kind, np.int64)
    n = max(0, len(k) - LONG + 1)
    texts, link = np.zeros(n, np.int64), np.zeros(n, bool)
    for j in range(LONG):
        w = k[j : j + n]
        texts += (w == 3) | (w == text)
        link |= w == 1
    return texts + link >= 2


def proposed_runs(pages: list[tuple], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, distinct pages in the block) of the runs and links of a block, found
    by its suffix array. Those of a host of several blocks are all needed, as a run
    that is rare in a block may be frequent on the host (``least`` is 1); a block that
    is alone needs only those that ``least`` of its pages have."""
    tokens = [p[2] for p in pages]
    prints, counts = [], []
    tok, kind, left = _joined(tokens, 1), _joined([p[4] for p in pages], 1), _left([len(t) for t in tokens], 1)
    for long, (group, support) in zip((LONG, 1), shared(tokens, LONG, 1), strict=True):
        # what a run's tokens say, and not where it stands, so that each block proposes the same
        good = np.flatnonzero((_telling(kind, 4) if long > 1 else kind == 1) & (left[: max(0, len(tok) - long + 1)] >= long))
        groups, first = np.unique(group[good], return_index=True)
        n = support[groups]
        keep = n >= least
        prints.append(run_prints(tok, long)[good[first[keep]]])
        counts.append(n[keep])
    return np.concatenate(prints), np.concatenate(counts)


def _joined(streams: list, apart: int = 0) -> np.ndarray:
    """The lists or arrays one behind the other, ``apart`` zeros behind each."""
    gap = [np.zeros(apart, np.int64)]
    return np.concatenate([np.asarray(x, np.int64) for t in streams for x in (t, *gap)]) if streams else np.zeros(0, np.int64)


def _left(sizes: list[int], apart: int = 0) -> np.ndarray:
    """For each position of what ``_joined`` gives, how many are left of its stream from it on."""
    return _joined([np.arange(n, 0, -1) for n in sizes], apart)


def levels(parents: np.ndarray) -> list[np.ndarray]:
    """The nodes of a forest by depth, the roots (of parent -1) first."""
    up, depth = parents.copy(), (parents >= 0).astype(np.int64)
    while len(go := np.flatnonzero(up >= 0)):  # twice as far up each time
        depth[go] += depth[up[go]]
        up[go] = up[up[go]]
    return np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


class Block:
    """Pages of one host, or of several small ones, taken together. ``frequent`` are the
    fingerprints of what is repeated on the host, ``sums`` the rows (path, and four sums) by
    layout path over all blocks of the host (those of this block alone if not given)."""

    def __init__(self, pages: list[tuple], frequent: np.ndarray, sums: np.ndarray | None = None):
        # (site, parents, tokens, layout paths, kinds); the nodes of all pages in one array each
        sizes = [len(p[2]) for p in pages]
        self.ends = np.cumsum([0, *sizes])
        owner = np.repeat(np.arange(len(pages)), sizes)
        par, tok, path, kind = (_joined([p[k] for p in pages]) for k in (1, 2, 3, 4))
        par = np.where(par >= 0, par + self.ends[owner], -1)
        # seeds that overlap chain into runs; a run counts if it holds two texts, or a link and a text
        starts = np.flatnonzero(_telling(kind) & (_left(sizes)[: max(0, len(tok) - LONG + 1)] >= LONG))
        starts = starts[np.isin(run_prints(tok, LONG)[starts], frequent)]
        mark = np.zeros(len(tok) + 1, np.int64)
        for a, b in maximal_runs(starts, LONG):
            mark[a] += 1
            mark[b] -= 1
        cov = np.cumsum(mark)[:-1] > 0
        # the target of a repeated link stands for its text, however garbled
        link = np.zeros(len(tok) + 1, bool)
        at = np.flatnonzero(kind == 1)
        link[at] = np.isin(run_prints(tok[at], 1), frequent)
        cov |= (kind >= 3) & link[par]
        texts, head = (kind == 3).astype(np.int64), kind == 2
        hits = texts * cov
        by_depth = levels(par)[1:]
        for at in reversed(by_depth):
            p = par[at]
            np.add.at(texts, p, texts[at])
            np.add.at(hits, p, hits[at])
            head[p[head[at]]] = True
        at = np.flatnonzero((kind < 3) & (texts > 0))
        if sums is None:
            paths, place = np.unique(path[at], return_inverse=True)
            pairs = np.unique(place * max(1, len(pages)) + owner[at]) // max(1, len(pages))
            of = [np.bincount(place, x[at], len(paths)) for x in (texts, hits, head)]
            sums = np.stack([paths, of[0], of[1], np.bincount(pairs, minlength=len(paths)), of[2]], 1).astype(np.int64)
        else:
            sums = sums[np.argsort(sums[:, 0])]
            place = np.searchsorted(sums[:, 0], path[at])
        self.sums = sums
        self.at, self.place, self.par, self.kind, self.by_depth = at, place, par, kind, by_depth
        self.weights = texts, hits, head
        self.gone: list[bool] | None = None

    def removed(self, k: int) -> list[bool]:
        """For the nodes of page k, whether they are boilerplate."""
        if self.gone is None:
            at = self.at
            texts, hits, head = (x[at] for x in self.weights)
            n, c, on, with_head = self.sums[self.place, 1:].T
            own, there = hits / texts, c / n
            block = (on >= 3) & (there >= 0.55)
            gone = ((own >= 0.6) & (there >= THERE)) | block | ((own >= 0.3) & (there >= 0.45))
            # a single phrase in running text or a table is no block
            gone &= (texts > 1) | (self.kind[at] == 1) | block
            # elsewhere this is where the page's own heading stands
            gone &= ~head & (with_head * 2 <= on)
            out = np.zeros(len(self.par), bool)
            out[at] = gone
            for below in self.by_depth:
                out[below] |= out[self.par[below]]
            self.gone = out.tolist()
        return self.gone[self.ends[k] : self.ends[k + 1]]


# ------------------------------------------------------------------ operators
#: Of a summary: node ids, parents, tokens, layout paths, kinds, whether residue.
_TYPES = "iiIIBB"


def _summaries(pages: Iterator[Page], samples, extra: Callable | None, together: int = 20_000):
    """(page_id, site, blob, extra) for each page; ``extra`` sees pages of ``together`` nodes at a
    time, only to share the cost of a call."""
    finder = kept_finder(samples)
    batch: list[tuple] = []
    held = 0

    def out():
        more = extra(finder, [b[:3] for b in batch]) if extra else [None] * len(batch)
        for (page, pos, residue, rest), x in zip(batch, more, strict=True):
            yield page.page_id, site_of(page.url, page.endpoint), b"".join(array(t, v).tobytes() for t, v in zip(_TYPES, ([page.ids[i] for i in pos], *rest, [i in residue for i in pos]), strict=True)), marshal.dumps(x)
        batch.clear()

    for page in pages:
        residue = finder.find(page)
        pos, *rest = page_tokens(page)
        batch.append((page, pos, residue, rest))
        held += 1 + len(page.ids)
        if held >= together:
            yield from out()
            held = 0
    if batch:
        yield from out()


def page_blocks(nodes: DataFrame, pages: DataFrame, lang_samples: DataFrame, extra: Callable | None = None) -> DataFrame:
    """(pool, block, page_id, site, blob, extra, many): page summaries and what ``extra`` says.
    The summaries are written once to scratch, and read for the pages of each host and
    for the blocks."""
    samples = nodes.sparkSession.sparkContext.broadcast(sample_counts(lang_samples))
    rows = map_pages(page_chunks(nodes, pages), lambda it: _summaries(it, samples.value, extra), "page_id bigint, site string, blob binary, extra binary", 256)
    rows = scratch_table(rows, "pages")
    return _in_blocks(rows)


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Adds pool (the host, '' for those taken together), block, and whether the pool has
    several blocks (``many``)."""
    sizes = rows.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    is_small = (F.col("n") < LEAST) | (F.col("site") == "")
    few, sites = sizes.agg(F.coalesce(F.sum(F.when(is_small, F.col("n"))), F.lit(0)), F.count(F.lit(1))).first()
    if sites <= MAX_BROADCAST_SITES:
        sized = rows.join(F.broadcast(sizes), "site")
    else:
        # pages without a host need no count; those of large hosts are spread over salts; what is
        # left has at most a block's pages of any host
        named = rows.where("site <> ''").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        large = sizes.where((F.col("n") > BLOCK_PAGES) & (F.col("site") != "")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = named.join(large.hint("merge"), ["site", "salt"], "left").drop("salt")
        rest = marked.where("n is null").drop("n").join(sizes.where((F.col("n") <= BLOCK_PAGES) & (F.col("site") != "")).hint("merge"), "site")
        sized = marked.where("n is not null").unionByName(rest).unionByName(rows.where("site = ''").withColumn("n", F.lit(0).cast("bigint")))
    blocks = F.greatest(F.lit(1), F.ceil(F.when(is_small, F.lit(int(few))).otherwise(F.col("n")) / BLOCK_PAGES))
    keyed = sized.withColumn("block", F.pmod(F.xxhash64("page_id"), blocks).cast("int")).withColumn("pool", F.when(is_small, "").otherwise(F.col("site")))
    return keyed.select("pool", "block", "page_id", "site", "blob", "extra", (blocks > 1).alias("many"))


def _parsed(table: pa.Table) -> list[tuple]:
    """(page_id, site, ids, parents, tokens, layout paths, kinds, residue, extra) by page, six
    of them arrays; extra is None where the table leaves it out."""
    names = ["page_id", "site", "blob"] + (["extra"] if "extra" in table.column_names else [])
    rows = sorted(zip(*(table.column(c).to_pylist() for c in names), strict=True), key=lambda r: r[0])
    return [(r[0], r[1], *_arrays(r[2]), marshal.loads(r[3]) if len(r) > 3 else None) for r in rows]


def _arrays(blob: bytes) -> Iterator[np.ndarray]:
    at, n = 0, len(blob) // sum(np.dtype(t).itemsize for t in _TYPES)
    for t in _TYPES:
        yield np.frombuffer(blob, t, n, at)
        at += n * np.dtype(t).itemsize


def _streams(parsed: list[tuple]) -> list[tuple]:
    return [(p[1], p[3], p[4], p[5], p[6]) for p in parsed]


def _keys(table: pa.Table, n: int) -> list[pa.Array]:
    return [pa.array([table.column(c)[0].as_py()] * n, t) for c, t in (("pool", pa.string()), ("block", pa.int32()))]


def frequent_runs(blocks: DataFrame) -> DataFrame:
    """(pool, block, prints): of the runs and links of each block those that LEAST pages of
    the host have, in whatever blocks these are."""

    def propose(table: pa.Table) -> pa.Table:
        many = table.column("many")[0].as_py()
        prints, n = proposed_runs(_streams(_parsed(table)), 1 if many else LEAST if table.column("pool")[0].as_py() else LEAST_POOLED)
        return pa.Table.from_arrays([*_keys(table, len(prints)), pa.array(prints), pa.array(n, pa.int64()), pa.array([many] * len(prints), pa.bool_())], names=["pool", "block", "print", "n", "many"])

    rows = blocks.groupBy("pool", "block").applyInArrow(propose, "pool string, block int, print bigint, n bigint, many boolean")
    # as many rows in a group as the host has blocks
    on_host = F.sum("n").over(Window.partitionBy("pool", "print"))
    merged = rows.where("many").withColumn("n", on_host).where(F.col("n") >= F.when(F.col("pool") == "", LEAST_POOLED).otherwise(LEAST)).unionByName(rows.where("not many"))
    return merged.groupBy("pool", "block").agg(F.collect_list("print").alias("prints"))


def _numbers(table: pa.Table, column: str, nested: int = 1) -> np.ndarray:
    """All numbers of a column of lists, or of lists of lists."""
    flat = table.column(column).combine_chunks()
    for _ in range(nested):
        flat = flat.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64)


def _frequent(table: pa.Table) -> np.ndarray:
    return _numbers(table, "prints") if table.num_rows else np.zeros(0, np.int64)


def layout_sums(blocks: DataFrame, runs: DataFrame) -> DataFrame:
    """(pool, block, prints, path, sums): as ``runs``, and for the layout paths of each block
    of a host of several the sums over all its blocks."""

    def summed(table: pa.Table, known: pa.Table) -> pa.Table:
        sums = Block(_streams(_parsed(table)), _frequent(known)).sums if table.num_rows else np.zeros((0, 5), np.int64)
        return pa.Table.from_arrays([*(_keys(table, len(sums)) if len(sums) else [pa.array([], pa.string()), pa.array([], pa.int32())]), *(pa.array(c) for c in sums.T)], names=["pool", "block", "path", "s0", "s1", "s2", "s3"])

    rows = blocks.where("many").groupBy("pool", "block").cogroup(runs.groupBy("pool", "block")).applyInArrow(summed, "pool string, block int, path bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    on_host = Window.partitionBy("pool", "path")
    rows = rows.select("pool", "block", "path", *(F.sum(f"s{j}").over(on_host).alias(f"s{j}") for j in range(4)))
    return rows.groupBy("pool", "block").agg(F.collect_list(F.array("path", "s0", "s1", "s2", "s3")).alias("sums"))


def map_blocks(blocks: DataFrame, rows_of: Callable, schema: str) -> DataFrame:
    """``rows_of(block, summaries)`` yields tuples of ``schema`` for each block. What is
    repeated, and the sums by layout, are merged over the blocks of a host before."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    bare = blocks.drop("extra")  # what is repeated depends on structure alone
    runs = scratch_table(frequent_runs(bare), "runs")
    none = F.lit(None)
    known = runs.select("pool", "block", "prints", none.cast("array<array<bigint>>").alias("sums"))
    known = known.unionByName(layout_sums(bare, runs).select("pool", "block", none.cast("array<bigint>").alias("prints"), "sums"))

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if table.num_rows:
            parsed = _parsed(table)
            sums = _numbers(known, "sums", 2).reshape(-1, 5) if table.column("many")[0].as_py() else None
            out.extend(rows_of(Block(_streams(parsed), _frequent(known), sums), parsed))
        cols = zip(*out, strict=True) if out else [[]] * len(arrow)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return blocks.groupBy("pool", "block").cogroup(known.groupBy("pool", "block")).applyInArrow(run, schema)


def _removed_rows(block: Block, parsed):
    for k, (pid, _, ids, _, _, _, kind, skip, _) in enumerate(parsed):
        for i in ids[np.array(block.removed(k), bool) & (kind == 3) & (skip == 0)].tolist():
            yield pid, i


def boilerplate_nodes(nodes: DataFrame, pages: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(page_id, node_id): body text nodes that are boilerplate of their site. Text of
    script and style and residue (problem 1) are left out. A page without url falls
    back to its endpoint, and without that counts together with other such pages;
    repeated rows count once; a page without nodes gives none."""
    return map_blocks(page_blocks(nodes, pages, lang_samples), _removed_rows, "page_id bigint, node_id int")


def main_bodies(nodes: DataFrame, pages: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(page_id, text): each page's main body in document order, one line for each text
    of a block element; pages that have none give no row."""

    def contents(_, batch):
        return [[page.data[i] if page.names[i] is None else page.names[i] for i in pos] for page, pos, _ in batch]

    def rows(block: Block, parsed):
        for k, (pid, _, _, par, _, _, kind, skip, data) in enumerate(parsed):
            gone, par, skip = block.removed(k), par.tolist(), skip.tolist()
            text, last = [], None
            for i, what in enumerate(kind.tolist()):
                if what != 3 or gone[i] or skip[i]:
                    continue
                p = par[i]
                while p >= 0 and data[p] in _INLINE:
                    p = par[p]
                if last is not None and p != last:
                    text.append("\n")
                text.append(data[i])
                last = p
            if text:
                yield pid, "".join(text).strip()

    return map_blocks(page_blocks(nodes, pages, lang_samples, contents), rows, "page_id bigint, text string")


_INLINE = frozenset("a abbr b bdi bdo cite code del dfn em font i ins kbd mark q s samp small span strong sub sup time u var".split())
