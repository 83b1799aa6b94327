"""Structural queries: a chain of predicates p1 .. pk matches a node for which pk holds and
which has strictly nested ancestors for which p1 .. p(k-1) hold in that order (the
descendant combinator of selectors).

Two forms give the same result. ``query_all`` works on a node table: the rows that match
any predicate are brought together by page (one exchange, before which copies
collapse), and one sort serves all steps of the chain: intervals of nodes are nested or
apart, so a node has an ancestor among earlier matches exactly if the greatest
``sub_end`` of these reaches it. ``query_all_nested`` works on one row per page, with
higher-order functions and no exchange; it is the one for freshly parsed pages.

Contents of templates are no part of the tree: walks from outside pass them by, as their
rows lie behind it. Tables without the column ``template_of`` have none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .predicates import Predicate


def by_page(nodes: DataFrame, *columns: str, key: str = "page_id") -> DataFrame:
    """The distinct rows of ``nodes``, of the columns named or all, those of a page together
    in one task: one exchange by page, which later joins, windows and groups by page
    reuse. Copies collapse before it, so that a page with very many copies is no
    larger than another. Rows with a null key belong to no page and are left out."""
    names = list(columns) or [c for c in nodes.columns if c != key]
    sets = nodes.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set(F.struct(*names)).alias("_n"))
    return sets.select(key, F.inline("_n"))


def in_tree(nodes: DataFrame) -> DataFrame:
    """Without the contents of templates."""
    return nodes.where("template_of is null") if "template_of" in nodes.columns else nodes


def _holds(p: Predicate) -> Column:
    return F.coalesce(p.on_row(), F.lit(False))


def query_all(nodes: DataFrame, *preds: Predicate, start: Predicate | None = None, key: str = "page_id", contents: bool = False) -> DataFrame:
    """The matching rows of ``nodes``. Without predicates, all. ``start`` restricts the last
    match to the nodes for which it holds and what is below them; the ancestors may
    lie outside. With one predicate and no start a plain filter: repeated rows stay
    repeated, null keys count. Else rows come out once, and those with a null key never.

    ``contents`` searches the contents of templates too; what is in them has the
    template and its ancestors as ancestors. It needs whole pages, with the columns
    ``node_id``, ``parent_id`` and ``depth``."""
    rows = nodes if contents else in_tree(nodes)
    if start is None and len(preds) < 2:
        return rows.where(preds[0].on_row()) if preds else rows
    if contents:
        names = [c for c in nodes.columns if c != key]
        page = nodes.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(F.struct("node_id", *[c for c in names if c != "node_id"]))).alias("_n"))
        if start is not None:
            page = page.withColumn("_s", match_nested(F.col("_n"), (start,), True))
        hits = page.withColumn("_h", match_nested(F.col("_n"), preds, True))
        if start is not None:
            hits = hits.withColumn("_h", F.filter("_h", lambda x: F.exists("_s", lambda s: (x["node_id"] >= s["node_id"]) & (x["node_id"] <= s["sub_end"]))))
        return hits.select(key, F.inline("_h")).select(*nodes.columns)
    marks = {f"_m{i}": _holds(p) for i, p in enumerate(preds or (Predicate(lambda f: F.lit(True)),))}
    if start is not None:
        marks["_s"] = _holds(start)
    marked = by_page(rows.where(reduce(lambda a, b: a | b, marks.values())).withColumns(marks), key=key)
    page = Window.partitionBy(key).orderBy("node_id")
    before, upto = page.rangeBetween(Window.unboundedPreceding, -1), page.rangeBetween(Window.unboundedPreceding, 0)
    last = len(preds or (1,)) - 1
    for i in range(1, last + 1):
        above = F.max(F.when(F.col(f"_m{i - 1}"), F.col("sub_end"))).over(before) >= F.col("node_id")
        marked = marked.withColumn(f"_m{i}", F.col(f"_m{i}") & F.coalesce(above, F.lit(False)))
    if start is not None:
        marked = marked.withColumn("_in", F.max(F.when(F.col("_s"), F.col("sub_end"))).over(upto) >= F.col("node_id")).where("_in")
    return marked.where(f"_m{last}").select(*nodes.columns)


def query_one(nodes: DataFrame, *preds: Predicate, start: Predicate | None = None, key: str = "page_id") -> DataFrame:
    """The first match of each page in document order; pages without one give no row."""
    found = query_all(nodes, *preds, start=start, key=key)
    first = found.groupBy(key).agg(F.min_by(F.struct(*[c for c in found.columns if c != key]), "node_id").alias("_n"))
    return first.select(key, "_n.*").select(*found.columns)


def match_nested(nodes_col: Column, preds: tuple[Predicate, ...], contents: bool = False) -> Column:
    """The matching structs of an array of nodes whose position is their node_id. A match
    climbs from parent to parent, so nothing grows with the square of the depth."""
    found = nodes_col if contents else F.filter(nodes_col, lambda x: x["template_of"].isNull())
    if not preds:
        return found
    k = len(preds)

    def climb(x):
        def step(at, _):
            node = F.get(nodes_col, at["up"])
            hit = reduce(lambda a, b: a | b, [(at["left"] == i) & preds[i].on_struct(node) for i in range(k - 1)])
            return F.struct(node["parent_id"].alias("up"), (at["left"] - F.when(hit, 1).otherwise(0)).alias("left"))

        # as many steps as there are ancestors; a document has none
        steps = F.slice(F.sequence(F.lit(0), x["depth"]), F.lit(2), x["depth"])
        return F.aggregate(steps, F.struct(x["parent_id"].alias("up"), F.lit(k - 2).alias("left")), step, lambda at: at["left"]) < 0

    matching = F.filter(found, lambda x: preds[-1].on_struct(x))
    return matching if k == 1 else F.filter(matching, climb)


def query_all_nested(pages: DataFrame, *preds: Predicate, nodes: str = "nodes", contents: bool = False) -> DataFrame:
    """``pages`` with the array of matching nodes in place of ``nodes``; null stays null."""
    return pages.withColumn(nodes, match_nested(F.col(nodes), preds, contents))


def descendants(nodes: DataFrame, of: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """Nodes strictly below those of ``of`` (a part of the table), once for each of them,
    with the ancestor's id in ``under``; without ``of``, all below the document.
    Template contents are below nothing but what is in the template."""
    if of is None:
        return in_tree(nodes).where("node_id > 0").withColumn("under", F.lit(0))
    a = of.select(F.col(key).alias("_p"), F.col("node_id").alias("under"), F.col("sub_end").alias("_e"))
    return nodes.join(a, (F.col(key) == F.col("_p")) & (F.col("node_id") > F.col("under")) & (F.col("node_id") <= F.col("_e"))).drop("_p", "_e")


def _no_contents(nodes: DataFrame) -> DataFrame:
    """Without the topmost nodes of template contents, whose parent is the template."""
    return nodes.where("template_of is null or template_of <> parent_id") if "template_of" in nodes.columns else nodes


def children(nodes: DataFrame, parent: DataFrame, index: int | None = None, key: str = "page_id") -> DataFrame:
    """Child nodes of those of ``parent``, or the one at ``index`` (none when out of range).
    Contents of a template are not its children."""
    nodes = _no_contents(nodes)
    p = parent.select(F.col(key).alias("_p"), F.col("node_id").alias("_n")).distinct()
    kids = nodes if index is None else nodes.where(F.col("child_no") == index)
    return kids.join(p, (F.col(key) == F.col("_p")) & (F.col("parent_id") == F.col("_n"))).drop("_p", "_n")


def child_counts(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, parent_id, n_children) of every node that has any."""
    return _no_contents(nodes).where("parent_id is not null").groupBy(key, "parent_id").agg(F.count(F.lit(1)).alias("n_children"))


def parents(nodes: DataFrame, of: DataFrame, key: str = "page_id") -> DataFrame:
    """The parent rows of the nodes of ``of``; the document has none."""
    p = of.select(F.col(key).alias("_p"), F.col("parent_id").alias("_n")).distinct()
    return nodes.join(p, (F.col(key) == F.col("_p")) & (F.col("node_id") == F.col("_n")), "left_semi")


def accessor(nodes: DataFrame, name: str, key: str = "page_id") -> DataFrame:
    """``head`` or ``body`` of each page: the first such child of the document or of its
    html element; pages without one give no row."""
    found = in_tree(nodes).where((F.col("kind") == "element") & (F.col("local_name") == name) & (F.col("depth") <= 2))
    first = found.groupBy(key).agg(F.min_by(F.struct(*[c for c in found.columns if c != key]), "node_id").alias("_n"))
    return first.select(key, "_n.*").select(*found.columns)


def attributes(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node_id, attr_no, name, value): attributes in their order."""
    return nodes.select(key, "node_id", F.posexplode("attrs").alias("attr_no", "a")).select(key, "node_id", "attr_no", "a.name", "a.value")
