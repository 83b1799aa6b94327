"""The queries of the engine's own operators, each with SQL that gives the same rows.

The node table of the data is the standard tree of the pages, so parsing is checked
against it; operators on nodes run over that table or over freshly parsed pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.options import ParseOptions, first_tag
from ..operators import filters, helpers, predicates as P, query as Q, text as T
from ..operators.serialize import serialize
from ..session import scratch_dir, table
from ..sources import charset, html as H
from ..sources.files import cache_name, with_cached

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _raw_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as they are, for queries whose few result rows per page collapse instead."""
    return table(spark, d, "pages").select("page_id", "html")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pages; only those that occur more than once are exchanged."""
    return H.distinct_pages(_raw_pages(spark, d))


def _raw_nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Node rows of the columns wanted, for operators that collapse copies themselves."""
    return table(spark, d, "nodes").select("page_id", "node_id", *columns)


def _nodes(spark: SparkSession, d: str, *columns: str, where: str | Column | None = None) -> DataFrame:
    """Distinct nodes that pass ``where``, of the columns wanted, together by page: one
    exchange, which the window, group or join behind it reuses."""
    t = table(spark, d, "nodes")
    return Q.by_page(t if where is None else t.where(where), "node_id", *columns)


_N = "n as (select distinct page_id, node_id, parent_id, sub_end, depth, child_no, kind, local_name, attrs, content from nodes)"
_ATTR = "list_filter(attrs, lambda x: x.name = '{0}')[1].value"
_TOKS = "list_filter(regexp_split_to_array(coalesce(" + _ATTR.format("class") + ", ''), '[\\t\\n\\r\\f ]'), lambda x: x <> '')"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Parse, then the chain ``nav li a`` and the text of its matches, in one pass per page."""
    pages = H.parse_nested(_pages(spark, d))
    hits = Q.query_all_nested(pages.withColumn("all", F.col("nodes")), P.tag("nav"), P.tag("li"), P.tag("a"))
    return hits.select("page_id", "all", F.explode("nodes").alias("x")).select(
        "page_id", F.col("x.node_id").alias("node_id"),
        F.array_join(F.transform(F.filter("all", lambda n: (n["kind"] == "text") & (n["node_id"] > F.col("x.node_id")) & (n["node_id"] <= F.col("x.sub_end"))), lambda n: n["content"]), "").alias("text"),
    )


# ------------------------------------------------------------------ parsing
_LINE = "coalesce(array_to_string(list_transform(attrs, lambda x: x.name || '=' || x.value), '|'), '')"


@_query(f"select distinct page_id, node_id, parent_id, sub_end, depth, child_no, kind, local_name, {_LINE} as attr_line, content from nodes")
def q_nodes(spark, d):
    nodes = H.parse(_pages(spark, d), columns=["node_id", "parent_id", "sub_end", "depth", "child_no", "kind", "local_name", "attrs", "content"])
    line = F.coalesce(F.array_join(F.transform("attrs", lambda a: F.concat(a["name"], F.lit("="), a["value"])), "|"), F.lit(""))
    return nodes.withColumn("attr_line", line).drop("attrs")


@_query(f"with {_N} select page_id, count(*) as n_nodes, count(*) filter (kind = 'element') as n_elements, max(depth) as max_depth from n group by page_id")
def q_nested_counts(spark, d):
    pages = H.parse_nested(_raw_pages(spark, d)).where("nodes is not null")
    return pages.select(
        "page_id", F.size("nodes").cast("bigint").alias("n_nodes"), F.size(F.filter("nodes", lambda x: x["kind"] == "element")).cast("bigint").alias("n_elements"),
        F.array_max(F.transform("nodes", lambda x: x["depth"])).alias("max_depth"),
    ).distinct()


@_query(f"with {_N} select page_id, local_name, count(*) as n from n where kind = 'element' group by 1, 2")
def q_tag_counts(spark, d):
    return H.parse(_pages(spark, d), columns=["kind", "local_name"]).where("kind = 'element'").groupBy("page_id", "local_name").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""with {_N}, b as (select page_id, node_id, sub_end from n where kind = 'element' and local_name = 'body' and depth = 2)
select n.page_id, count(*) as n_elements from n join b on n.page_id = b.page_id and n.node_id >= b.node_id and n.node_id <= b.sub_end and n.kind = 'element' group by 1""")
def q_body_subtree(spark, d):
    nodes = Q.query_all(_raw_nodes(spark, d, "sub_end", "kind", "local_name"), start=P.tag("body"))
    return nodes.where("kind = 'element'").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_elements"))


@_query(f"""with {_N}, b as (select n.page_id, node_id as b, sub_end as e from n where kind = 'element' and local_name = 'body' and depth = 2),
x as (select n.page_id, n.node_id, n.parent_id, n.kind, n.local_name, {_ATTR.format('id')} as ident from n join b on n.page_id = b.page_id and n.node_id >= b.b and n.node_id <= b.e left join n u on u.page_id = n.page_id and u.node_id = n.parent_id
  where n.kind in ('element', 'text') and not (n.kind = 'text' and u.local_name in ('script', 'style', 'xmp', 'iframe', 'noembed', 'noframes', 'title', 'textarea', 'plaintext'))),
y as (select *, lag(kind) over (partition by page_id, parent_id order by node_id) as last from x), z as (select * from y where not (kind = 'text' and coalesce(last, '') = 'text')),
r as (select *, 2 + row_number() over (partition by page_id order by node_id) as k from z)
select r.page_id, r.k as node_id, coalesce(u.k, 1) as parent_id, r.kind, r.local_name, case when r.kind = 'element' then coalesce(r.ident, '') end as ident from r left join r u on u.page_id = r.page_id and u.node_id = r.parent_id
union all select page_id, unnest([0, 1, 2]), unnest([null, 0, 1]), unnest(['document', 'element', 'element']), unnest(['#document', 'html', 'head']), unnest([null, '', '']) from b""".replace("{_ATTR", "{_ATTR").replace("n.kind, n.local_name, list_filter(attrs", "n.kind, n.local_name, list_filter(n.attrs"))
def q_parse_body_id_only(spark, d):
    """The benchmark's parse: only ``body``, no comments and scripts, only ids."""
    o = ParseOptions(skip_comments=True, skip_script_text=True, skip_raw_text=True, skip_rcdata_text=True, skip_cdata=True, skip_plaintext=True, keep_attrs={"id"})
    return H.parse(_pages(spark, d), options=o, token_filter=first_tag("body"), columns=["node_id", "parent_id", "kind", "local_name", "attrs"]).select(
        "page_id", "node_id", "parent_id", "kind", "local_name", F.when(F.col("kind") == "element", P.get_attribute("id")).alias("ident"),
    )


# ------------------------------------------------------------------ tokens, lexical
_LEX = r"""
p as (select distinct page_id, html from pages where html is not null),
t0 as (select page_id, regexp_extract_all(regexp_replace(html, '(<script[^>]*>).*?(</script>)', '\1\2', 'gis'), '(?is)<!--.*?-->|<[/!a-z][^>]*>|[^<]+|<') as a from p),
t1 as (select page_id, unnest(a) as tok, generate_subscripts(a, 1) - 1 as tok_no from t0),
tok as (select *, case when regexp_matches(tok, '(?i)^<[a-z]') then 'start' when regexp_matches(tok, '(?i)^</[a-z]') then 'end' when regexp_matches(tok, '^<!--') then 'comment'
  when regexp_matches(tok, '(?i)^<!doctype') then 'doctype' when regexp_matches(tok, '^<!') then 'comment' else 'text' end as type,
  lower(regexp_extract(tok, '(?i)^</?([a-z][a-z0-9]*)', 1)) as name, regexp_matches(tok, '(?s)^<[a-zA-Z].*/>$') as self_closing from t1)
"""


# as the tokenizer has it, a script's body is one text
_EXACT = _LEX.replace(
    "regexp_replace(html, '(<script[^>]*>).*?(</script>)', '\\1\\2', 'gis')",
    "regexp_replace(regexp_replace(html, '<script[^>]*></script>', '<i></i>', 'gis'), '(<script[^>]*>).+?(</script>)', '\\1S\\2', 'gis')",
)


@_query(f"with {_EXACT} select page_id, type, count(*) as n from tok group by 1, 2 union all select page_id, 'eof', 1 from p")
def q_tokens(spark, d):
    """Tokens by the tokenizer itself; by pattern they are the same where markup is sound."""
    return H.tokenize(_pages(spark, d)).groupBy("page_id", "type").agg(F.count(F.lit(1)).alias("n"))


@_query(f"with {_LEX} select page_id, type, count(*) as n from tok group by 1, 2")
def q_token_count(spark, d):
    return H.lexical_tokens(_pages(spark, d)).groupBy("page_id", "type").agg(F.count(F.lit(1)).alias("n"))


def _filter_sql(cond: str, void_aware: bool = False, lex: str = _LEX) -> str:
    skip = " and name not in ('area','base','basefont','bgsound','br','col','embed','frame','hr','img','input','keygen','link','meta','param','source','track','wbr')" if void_aware else ""
    return f"""with {lex},
a as (select *, bool_or(type = 'start' and ({cond})) over w as started from tok window w as (partition by page_id order by tok_no rows between unbounded preceding and current row)),
b as (select *, sum(case when not started then 0 when type = 'start' and not self_closing{skip} then 1 when type = 'end' then -1 else 0 end) over (partition by page_id order by tok_no rows between unbounded preceding and current row) as depth from a),
c as (select *, bool_or(started and depth <= 0) over (partition by page_id order by tok_no rows between unbounded preceding and current row) as stopped from b)
select page_id, count(*) as n, max(tok_no) as last_tok from c where started and not stopped group by 1"""


def _kept(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max("tok_no").cast("bigint").alias("last_tok"))


@_query(_filter_sql("name = 'nav'", lex=_EXACT))
def q_first_tag_nav_exact(spark, d):
    """The filter on the tokenizer's tokens; the end of the page is none."""
    return _kept(filters.first_tag_and_children(H.tokenize(_pages(spark, d)), "nav").where("type <> 'eof'"))


@_query(_filter_sql("name = 'nav'"))
def q_first_tag_nav(spark, d):
    return _kept(filters.first_tag_and_children(H.lexical_tokens(_pages(spark, d)), "nav"))


@_query(_filter_sql("name = 'head'"))
def q_first_tag_head_lexical(spark, d):
    return _kept(filters.first_tag_and_children(H.lexical_tokens(_pages(spark, d)), "head"))


@_query(_filter_sql("name = 'article'", True))
def q_first_tag_article_void_aware(spark, d):
    return _kept(filters.first_tag_and_children(H.lexical_tokens(_pages(spark, d)), "article", void_aware=True))


@_query(_filter_sql("name = 'div' and regexp_matches(tok, ' id=\"topbar\"')"))
def q_only_element_with_id(spark, d):
    """Lexical twin of the filter by id, comparable in SQL."""
    return _kept(filters.token_filter(H.lexical_tokens(_pages(spark, d)), (F.col("name") == "div") & F.col("tok").rlike(' id="topbar"')))


@_query(_filter_sql("name = 'div' and regexp_matches(tok, ' id=\"topbar\"')", lex=_EXACT))
def q_only_element_with_id_exact(spark, d):
    return _kept(filters.only_element_with_id(H.tokenize(_pages(spark, d)), "div", "topbar").where("type <> 'eof'"))


@_query(_filter_sql("regexp_matches(tok, 'role=\"navigation\"')"))
def q_token_filter_delegate(spark, d):
    return _kept(filters.token_filter(H.lexical_tokens(_pages(spark, d)), F.col("tok").rlike('role="navigation"')))


# ------------------------------------------------------------------ scans and projections
@_query(f"with {_N} select page_id, node_id, unnest(attrs).name as name, unnest(attrs).value as value, generate_subscripts(attrs, 1) - 1 as attr_no from n where kind = 'element'")
def q_attributes(spark, d):
    return Q.attributes(_nodes(spark, d, "attrs", where="kind = 'element'")).withColumn("attr_no", F.col("attr_no").cast("bigint"))


@_query(f"with {_N} select page_id, {_ATTR.format('lang')} as lang from n where local_name = 'html' and kind = 'element'")
def q_attr_lang(spark, d):
    html = table(spark, d, "nodes").where(P.tag("html").on_row())
    return html.select("page_id", "node_id", filters.attribute("lang").alias("lang")).distinct().drop("node_id")


@_query(f"with {_N} select page_id, node_id, {_ATTR.format('charset')} as charset from n where local_name = 'meta' and list_contains(list_transform(attrs, lambda x: x.name), 'charset')")
def q_attr_charset(spark, d):
    meta = table(spark, d, "nodes").where((P.tag("meta") & P.with_attr("charset")).on_row())
    return meta.select("page_id", "node_id", filters.attribute("charset").alias("charset")).distinct()


@_query(f"with {_N} select page_id, node_id, coalesce({_ATTR.format('href')}, '') as href, len(attrs) > 0 and list_contains(list_transform(attrs, lambda x: x.name), 'class') as has_class from n where kind = 'element' and local_name = 'a'")
def q_links_href(spark, d):
    links = table(spark, d, "nodes").where(P.tag("a").on_row())
    return links.select("page_id", "node_id", P.get_attribute("href").alias("href"), P.has_attribute("class").alias("has_class")).distinct()


@_query(f"with {_N} select page_id, parent_id, count(*) as n_children from n where parent_id is not null group by 1, 2")
def q_child_counts(spark, d):
    return Q.child_counts(_nodes(spark, d, "parent_id"))


@_query(f"with {_N} select c.page_id, c.node_id, c.kind from n c join n u on c.page_id = u.page_id and c.parent_id = u.node_id where u.local_name = 'ul' and u.kind = 'element' and c.child_no = 1")
def q_second_child(spark, d):
    n = _nodes(spark, d, "parent_id", "child_no", "kind", "local_name")
    return Q.children(n, n.where(P.tag("ul").on_row()), 1).select("page_id", "node_id", "kind")


@_query(f"with {_N} select distinct u.page_id, u.node_id, u.local_name from n c join n u on c.page_id = u.page_id and c.parent_id = u.node_id where c.kind = 'text'")
def q_parents_of_text(spark, d):
    n = _nodes(spark, d, "parent_id", "kind", "local_name")
    return Q.parents(n, n.where("kind = 'text'")).select("page_id", "node_id", "local_name")


@_query(f"with {_N} select page_id, node_id, local_name, sub_end from n where kind = 'element' and local_name in ('head', 'body') and depth = 2")
def q_head_body(spark, d):
    n = _nodes(spark, d, "depth", "kind", "local_name", "sub_end")
    return Q.accessor(n, "head").unionByName(Q.accessor(n, "body")).select("page_id", "node_id", "local_name", "sub_end")


@_query(f"with {_N} select a.page_id, a.node_id as under, count(*) as n_below, count(*) filter (d.kind = 'text') as n_texts from n a join n d on d.page_id = a.page_id and d.node_id > a.node_id and d.node_id <= a.sub_end where a.local_name = 'ul' and a.kind = 'element' group by 1, 2")
def q_descendants(spark, d):
    n = _nodes(spark, d, "sub_end", "kind", "local_name")
    below = Q.descendants(n, n.where(P.tag("ul").on_row()))
    return below.groupBy("page_id", "under").agg(F.count(F.lit(1)).alias("n_below"), F.count(F.when(F.col("kind") == "text", 1)).alias("n_texts"))


# ------------------------------------------------------------------ predicates
@_query(f"""with {_N}, e as (select page_id, {_ATTR.format('class')} as cls, {_TOKS} as toks, local_name from n where kind = 'element'),
i as (select distinct page_id, class_name from class_inputs where class_name is not null)
select i.page_id, i.class_name, count(e.page_id) as n from i left join e on e.page_id = i.page_id and (e.cls = i.class_name or list_contains(e.toks, i.class_name)) group by 1, 2""")
def q_class_inputs(spark, d):
    """How many elements of its page each class input matches, by class tokens and whole
    values; an equi-join on (page, class) over the exploded tokens."""
    n = table(spark, d, "nodes").where("kind = 'element'").select("page_id", "node_id", filters.attribute("class").alias("cls")).where("cls is not null")
    n = Q.by_page(n)
    values = F.array_distinct(F.array_append(helpers.split_set("cls", "\t\n\r\f "), F.col("cls")))
    hits = n.select("page_id", "node_id", F.explode(values).alias("class_name"))
    counts = hits.groupBy("page_id", "class_name").agg(F.count(F.lit(1)).alias("n"))
    inputs = table(spark, d, "class_inputs").where("class_name is not null").select("page_id", "class_name").distinct()
    return inputs.join(counts, ["page_id", "class_name"], "left").select("page_id", "class_name", F.coalesce("n", F.lit(0)).alias("n"))


_PREDICATES = {
    "id_topbar": (P.with_id("topbar"), f"{_ATTR.format('id')} = 'topbar'"),
    "class_menu": (P.with_class("menu"), f"({_ATTR.format('class')} = 'menu' or list_contains({_TOKS}, 'menu'))"),
    "class_whole": (P.with_class("menu main-menu"), f"{_ATTR.format('class')} = 'menu main-menu'"),
    "classes": (P.with_classes("main-menu", "menu"), f"(list_contains({_TOKS}, 'main-menu') and list_contains({_TOKS}, 'menu'))"),
    "classes_same": (P.with_classes("menu", "menu"), "false"),
    "attr": (P.with_attr("role"), "list_contains(list_transform(attrs, lambda x: x.name), 'role')"),
    "attr_value": (P.with_attr("role", "main"), f"{_ATTR.format('role')} = 'main'"),
    "tag_id": (P.tag_id("div", "topbar"), f"local_name = 'div' and {_ATTR.format('id')} = 'topbar'"),
    "tag_class": (P.tag_class("section", "related"), f"local_name = 'section' and list_contains({_TOKS}, 'related')"),
    "tag_classes": (P.tag_classes("div", "menu", "main-menu"), f"local_name = 'div' and list_contains({_TOKS}, 'menu') and list_contains({_TOKS}, 'main-menu')"),
    "lambda": (P.where(lambda f: (f("depth") > 4) & (f("child_no") == 0)) & ~P.tag("a"), "depth > 4 and child_no = 0 and local_name <> 'a'"),
}


@_query(f"with {_N} " + " union all ".join(f"select '{k}' as predicate, page_id, node_id from n where kind = 'element' and coalesce({sql}, false)" for k, (_, sql) in _PREDICATES.items()))
def q_predicates(spark, d):
    """All predicates in one scan."""
    n = table(spark, d, "nodes").where("kind = 'element'")
    hits = F.array_compact(F.array(*[F.when(p.on_row(), F.lit(k)) for k, (p, _) in _PREDICATES.items()]))
    return n.select("page_id", "node_id", F.explode(hits).alias("predicate")).distinct()


@_query(f"with {_N}, s as (select page_id, node_id, list_sort(list_transform(attrs, lambda x: x.name || chr(1) || x.value)) as a from n where kind = 'element' and len(attrs) > 0) select x.page_id, x.node_id, y.node_id as twin from s x join s y on x.page_id = y.page_id and y.node_id = x.node_id + 1 and x.a = y.a")
def q_same_attributes(spark, d):
    w = Window.partitionBy("page_id").orderBy("node_id")
    n = _nodes(spark, d, "attrs", where="kind = 'element'")
    n = n.withColumn("twin", F.lead("node_id").over(w)).withColumn("theirs", F.lead("attrs").over(w))
    return n.where((F.col("twin") == F.col("node_id") + 1) & (F.size("attrs") > 0) & P.same_attributes(F.col("attrs"), F.col("theirs"))).select("page_id", "node_id", "twin")


# ------------------------------------------------------------------ chains
def _chain_sql(*conds: str) -> str:
    steps = [f"m0 as (select page_id, node_id, sub_end from n where {conds[0]})"]
    for i, c in enumerate(conds[1:], 1):
        steps.append(f"m{i} as (select page_id, node_id, sub_end from n where ({c}) and exists (select 1 from m{i - 1} a where a.page_id = n.page_id and n.node_id > a.node_id and n.node_id <= a.sub_end))")
    return f"with {_N}, {', '.join(steps)} select page_id, node_id from m{len(conds) - 1}"


def _is(tag: str) -> str:
    return f"kind = 'element' and local_name = '{tag}'"


@_query(_chain_sql(_is("nav"), _is("li"), _is("a")))
def q_chain_nav_li_a(spark, d):
    n = _raw_nodes(spark, d, "sub_end", "kind", "local_name")
    return Q.query_all(n, P.tag("nav"), P.tag("li"), P.tag("a")).select("page_id", "node_id")


@_query(_chain_sql(_is("nav"), _is("li"), _is("a")))
def q_chain_nested(spark, d):
    pages = Q.query_all_nested(H.parse_nested(_raw_pages(spark, d)), P.tag("nav"), P.tag("li"), P.tag("a"))
    return pages.select("page_id", F.explode("nodes").alias("x")).select("page_id", F.col("x.node_id").alias("node_id")).distinct()


@_query(_chain_sql(_is("div"), _is("div"), _is("a")))
def q_chain_div_div_a(spark, d):
    n = _raw_nodes(spark, d, "sub_end", "kind", "local_name")
    return Q.query_all(n, P.tag("div"), P.tag("div"), P.tag("a")).select("page_id", "node_id")


@_query(_chain_sql(f"{_is('section')} and list_contains({_TOKS}, 'related')", _is("ul"), _is("a")))
def q_chain_class(spark, d):
    # the class is looked at where the row is read; only the verdict goes on
    n = table(spark, d, "nodes").select("page_id", "node_id", "sub_end", "kind", "local_name", P.tag_class("section", "related").on_row().alias("related"))
    return Q.query_all(n, P.where(lambda f: f("related")), P.tag("ul"), P.tag("a")).select("page_id", "node_id")


@_query(f"with {_N}, b as (select page_id, node_id, sub_end from n where kind = 'element' and local_name = 'body') select n.page_id, min(n.node_id) as node_id from n join b on n.page_id = b.page_id and n.node_id >= b.node_id and n.node_id <= b.sub_end where n.kind = 'element' and n.local_name = 'a' group by 1")
def q_query_one_first_link(spark, d):
    n = _raw_nodes(spark, d, "sub_end", "kind", "local_name")
    return Q.query_one(n, P.tag("a"), start=P.tag("body")).select("page_id", "node_id")


# ------------------------------------------------------------------ text and printing
def _text_sql(cond: str, piece: str = "t.content", whole: str = "coalesce(string_agg(s, '' order by tn), '')") -> str:
    return f"""with {_N}, a as (select page_id, node_id, sub_end from n where {cond}),
j as (select a.page_id, a.node_id, t.node_id as tn, {piece} as s from a left join n t on t.page_id = a.page_id and t.kind = 'text' and t.node_id > a.node_id and t.node_id <= a.sub_end)
select page_id, node_id, {whole} as text from j group by 1, 2"""


def _texts(spark, d, pred, trim, **more):
    return T.text_content(_raw_nodes(spark, d, "sub_end", "kind", "local_name", "content"), pred, trim, **more)


@_query(_text_sql(_is("title")))
def q_title_text(spark, d):
    return _texts(spark, d, P.tag("title"), "none")


@_query(_text_sql(_is("h1")))
def q_h1_text(spark, d):
    return _texts(spark, d, P.tag("h1"), "none")


_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
_HTML_SPACE = "chr(9) || chr(10) || chr(12) || chr(13) || ' '"


@_query(_text_sql(_is("li"), f"trim(t.content, {_SPACES})"))
def q_li_text_trim_nodes(spark, d):
    return _texts(spark, d, P.tag("li"), "nodes")


@_query(
    _text_sql(
        _is("p"),
        f"case when t.node_id = min(t.node_id) over (partition by a.page_id, a.node_id) then ltrim(t.content, {_SPACES}) else t.content end",
        f"case when length(rtrim(coalesce(string_agg(s, '' order by tn), ''), {_HTML_SPACE})) = 0 then left(coalesce(string_agg(s, '' order by tn), ''), 1) else rtrim(string_agg(s, '' order by tn), {_HTML_SPACE}) end",
    )
)
def q_p_text_trim_ends(spark, d):
    return _texts(spark, d, P.tag("p"), "ends")


@_query(_text_sql(_is("body"), "t.content", "length(coalesce(string_agg(s, '' order by tn), ''))"))
def q_text_content_body(spark, d):
    """With a consumer: the length of each body's text."""
    return _texts(spark, d, P.tag("body"), "none", consume=lambda c: F.length(c).cast("bigint"))


@_query(f"""with {_N}, e as (
select page_id, node_id as place, 0 as ends, node_id as ord, case when kind = 'document' then '<#document>' || chr(10) when kind = 'element' then '<' || local_name || array_to_string(list_transform(attrs, lambda x: ' ' || x.name || '="' || x.value || '"'), '') || '>' || chr(10) when kind = 'text' then content when kind = 'comment' then '<!--' || content || '-->' when kind = 'doctype' then '<!DOCTYPE html  >' || chr(10) end as s from n
union all select page_id, sub_end, 1, -node_id, case when kind = 'document' then '</#document>' || chr(10) else '</' || local_name || '>' || chr(10) end from n where kind in ('element', 'document'))
select page_id, string_agg(s, '' order by place, ends, ord) as markup from e group by 1""")
def q_print_document(spark, d):
    return serialize(_raw_nodes(spark, d, "sub_end", "kind", "local_name", "attrs", "content"))


# ------------------------------------------------------------------ downloads and helpers
_DL = "dl as (select distinct * from downloads)"
_HOST = "nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '')"


def _downloads(spark, d, *columns: str):
    """Distinct downloads by their key and the columns wanted."""
    return table(spark, d, "downloads").select("download_id", *columns).distinct()


@_query(f"with {_DL} select download_id, coalesce(endpoint_id, {_HOST}, 'unknown') as endpoint from dl")
def q_endpoint_key(spark, d):
    return _downloads(spark, d, "endpoint_id", "url").select("download_id", helpers.endpoint_key().alias("endpoint"))


_RING = f"""with {_DL}, k as (select *, coalesce(endpoint_id, {_HOST}, 'unknown') as endpoint from dl),
r as (select download_id, endpoint, cast(trunc(sum(total_bytes) over w / count(total_bytes) over w) as bigint) as ring_avg, content_length, expected_size from k window w as (partition by endpoint order by received_at, download_id rows between 16 preceding and 1 preceding))
select """


@_query(_RING + "download_id, endpoint, ring_avg from r")
def q_ring_avg(spark, d):
    """The ring cut by day, so that a hot endpoint is sorted in many tasks."""
    k = _downloads(spark, d, "endpoint_id", "url", "total_bytes", "received_at").withColumn("endpoint", helpers.endpoint_key())
    r = helpers.ring_average(k, "total_bytes", "endpoint", ["received_at", "download_id"], slice_of=F.to_date("received_at"))
    return r.select("download_id", "endpoint", "ring_avg")


@_query(_RING + "download_id, coalesce(ring_avg, content_length, expected_size, 0) as size_hint from r")
def q_size_hint(spark, d):
    k = _downloads(spark, d, "endpoint_id", "url", "total_bytes", "received_at", "content_length", "expected_size").withColumn("endpoint", helpers.endpoint_key())
    r = helpers.ring_average(k, "total_bytes", "endpoint", ["received_at", "download_id"], slice_of=F.to_date("received_at"))
    return r.select("download_id", helpers.size_hint("ring_avg", "content_length", "expected_size").alias("size_hint"))


@_query(
    f"""with {_DL}, h as (select download_id, nullif(trim(regexp_extract(content_type, '(?i)(?:^|;)\\s*charset\\s*=\\s*([^;]*)', 1)), '') as c from dl)
select download_id, case when length(c) > 2 and starts_with(c, '"') and ends_with(c, '"') then substring(c, 2, length(c) - 2) else c end as charset from h"""
)
def q_header_charset(spark, d):
    return _downloads(spark, d, "content_type").select("download_id", charset.header_charset().alias("charset"))


@_query("select distinct page_id, md5(html) as h, md5(html) as h_latin, md5(html) as h16 from pages where html is not null and not regexp_matches(html, '[^\\x00-\\xff]')")
def q_charset_decode(spark, d):
    """Bodies with a mark, in the announced Latin-1, and in UTF-16 decode to the text."""
    p = _pages(spark, d).where("html is not null and not html rlike '[^\\\\x00-\\\\xff]'")
    utf8 = F.concat(F.unhex(F.lit("EFBBBF")), F.encode("html", "UTF-8"))
    utf16 = F.concat(F.unhex(F.lit("FFFE")), F.encode("html", "UTF-16LE"))
    none = F.lit(None).cast("string")
    return p.select(
        "page_id", F.md5(charset.decode(utf8, none)).alias("h"), F.md5(charset.decode(F.encode("html", "ISO-8859-1"), F.lit('text/html; charset="iso-8859-1"'))).alias("h_latin"),
        F.md5(charset.decode(utf16, none)).alias("h16"),
    )


@_query(f"with p as (select distinct page_id, url from pages), h as (select page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1) as host from p) select page_id, replace(replace(replace(replace(host, 'www.', ''), '.com', ''), '.de', ''), '.org', '') || '.html' as file from h where coalesce(host, '') <> ''")
def q_cache_name(spark, d):
    return table(spark, d, "pages").select("page_id", cache_name().alias("file")).where("file is not null").distinct()


@_query(
    f"""with {_N}, w as (select page_id, node_id, content, list_filter(regexp_split_to_array(content, '[ ,.]'), lambda x: x <> '') as a, list_filter(string_split(content, ' the '), lambda x: x <> '') as b from n where kind = 'text')
select page_id, node_id, contains(upper(content), upper('the ')) as has, len(a) as n_pieces, a[2] as second, a[100] as far, len(b) as n_split, array_to_string(b, '|') as rejoined,
trim(content, {_SPACES}) = '' as blank from w"""
)
def q_text_helpers(spark, d):
    n = _nodes(spark, d, "content", where="kind = 'text'")
    a, b = helpers.split_set("content", " ,."), helpers.split_on("content", " the ")
    return n.select(
        "page_id", "node_id", helpers.contains_i("content", "the ").alias("has"), F.size(a).cast("bigint").alias("n_pieces"), helpers.try_at(a, 1).alias("second"), helpers.try_at(a, 99).alias("far"),
        F.size(b).cast("bigint").alias("n_split"), F.array_join(b, "|").alias("rejoined"), helpers.is_null_or_whitespace("content").alias("blank"),
    )


@_query(f"with {_DL} select download_id, case when coalesce(endpoint_id, '') = '' then content_type else coalesce(endpoint_id || ':' || content_type, endpoint_id) end as name from dl")
def q_combine(spark, d):
    return _downloads(spark, d, "endpoint_id", "content_type").select("download_id", helpers.combine("endpoint_id", "content_type").alias("name"))


# ------------------------------------------------------------------ what drives the reference's tests
_TAGS = ("a", "b", "i", "p", "q", "ul", "li", "td")


@_query(f"with {_N}, t as (select unnest({list(_TAGS)!r}) as tag), f as (select distinct page_id from n), c as (select page_id, local_name, count(*) as k from n where kind = 'element' group by 1, 2) select f.page_id, t.tag, coalesce(c.k, 0) as n from f cross join t left join c on c.page_id = f.page_id and c.local_name = t.tag")
def q_file_tag_counts(spark, d):
    """Counts for each page and each of a fixed list of tags, zeros included: one pass that
    counts by condition, instead of a product of pages and tags."""
    n = _nodes(spark, d, "kind", "local_name")
    counts = n.groupBy("page_id").agg(*[F.count(F.when((F.col("kind") == "element") & (F.col("local_name") == t), 1)).alias(t) for t in _TAGS])
    return counts.select("page_id", F.explode(F.create_map(*[x for t in _TAGS for x in (F.lit(t), F.col(t))])).alias("tag", "n"))


# fixed values: what names in the reference's tests may not hold, and how many a page uses
_MOST_IDS = 75
_BAD_NAME = r"""[:()\[\]%/.! ?&'",]"""


@_query(f"""with {_N}, i as (select page_id, {_ATTR.format('id')} as ident, min(node_id) as first from n where kind = 'element' and {_ATTR.format('id')} is not null group by 1, 2),
g as (select * from i where not regexp_matches(ident, '{_BAD_NAME.replace(chr(39), chr(39) * 2)}')), r as (select *, row_number() over (partition by page_id order by first) as k from g) select page_id, ident, k from r where k <= {_MOST_IDS}""")
def q_ids_at_most_75(spark, d):
    """The ids a page's tests use: distinct, of harmless characters, the first 75."""
    n = Q.by_page(table(spark, d, "nodes").where("kind = 'element'").select("page_id", "node_id", filters.attribute("id").alias("ident")).where("ident is not null"))
    ids = n.where(~F.col("ident").rlike(_BAD_NAME)).groupBy("page_id", "ident").agg(F.min("node_id").alias("first"))
    return ids.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("first")).cast("bigint")).where(F.col("k") <= _MOST_IDS).select("page_id", "ident", "k")


@_query(f"with {_N}, e as (select page_id, node_id, local_name from n where kind = 'element'), z as (select page_id, node_id, local_name as a, lead(local_name) over w as b, lead(local_name, 2) over w as c from e window w as (partition by page_id order by node_id)) select a, b, c, count(*) as n from z where b is not null group by 1, 2, 3")
def q_zip_tags(spark, d):
    """Sliding pairs and triples of a page's elements."""
    w = Window.partitionBy("page_id").orderBy("node_id")
    e = _nodes(spark, d, "local_name", where="kind = 'element'")
    z = e.select(F.col("local_name").alias("a"), F.lead("local_name").over(w).alias("b"), F.lead("local_name", 2).over(w).alias("c"))
    return z.where("b is not null").groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""with {_N}, i as (select distinct page_id, class_name from class_inputs where class_name is not null), e as (select page_id, {_TOKS} as toks from n where kind = 'element')
select i.page_id, i.class_name from i where not exists (select 1 from e where e.page_id = i.page_id and list_contains(e.toks, i.class_name))""")
def q_class_inputs_missing(spark, d):
    n = table(spark, d, "nodes").where("kind = 'element'")
    toks = n.select("page_id", F.explode(helpers.split_set(F.coalesce(filters.attribute("class"), F.lit("")), "\t\n\r\f ")).alias("class_name"))
    inputs = table(spark, d, "class_inputs").where("class_name is not null").select("page_id", "class_name").distinct()
    return inputs.join(toks, ["page_id", "class_name"], "left_anti")


# ------------------------------------------------------------------ elements the data lacks, written into its pages
# fixed values: markup put behind each page's body tag, and its nodes by the public standard
_SNIPPET = (
    '<div class="tpl"><template id="t1"><a href="/in">IN</a><template id="t2"><b>deep</b></template></template><a href="/out">OUT</a></div>'
    '<svg viewbox="0 0 1 1"><lineargradient id="g"></lineargradient><desc>d</desc></svg><math><mi>x</mi></math>'
)
#: (number below body, parent's number or -1 for body, last number below, depth below body, child_no, kind, local_name, attributes, content, flags, ns)
_SNIPPET_NODES = (
    (1, -1, 4, 1, 0, "element", "div", "class=tpl", None, "HtmlMember Special", "html"),
    (2, 1, 2, 2, 0, "element", "template", "id=t1", None, "HtmlMember Special Scoped HtmlTableScoped HtmlTableSectionScoped", "html"),
    (3, 1, 4, 2, 1, "element", "a", "href=/out", None, "HtmlMember HtmlFormatting", "html"),
    (4, 3, 4, 3, 0, "text", None, "", "OUT", "", None),
    (5, -1, 8, 1, 1, "element", "svg", "viewBox=0 0 1 1", None, "SvgMember", "svg"),
    (6, 5, 6, 2, 0, "element", "linearGradient", "id=g", None, "SvgMember", "svg"),
    (7, 5, 8, 2, 1, "element", "desc", "", None, "SvgMember HtmlTip Special Scoped", "svg"),
    (8, 7, 8, 3, 0, "text", None, "", "d", "", None),
    (9, -1, 11, 1, 2, "element", "math", "", None, "MathMember", "math"),
    (10, 9, 11, 2, 0, "element", "mi", "", None, "MathMember MathTip Special Scoped", "math"),
    (11, 10, 11, 3, 0, "text", None, "", "x", "", None),
)
_SNIPPET_LEN, _SNIPPET_KIDS = len(_SNIPPET_NODES), 3


def _with_snippet(spark: SparkSession, d: str, pages: DataFrame | None = None) -> DataFrame:
    """Pages that have a body tag, with ``_SNIPPET`` behind the first one."""
    p = _pages(spark, d) if pages is None else pages
    return p.where("html rlike '(?i)<body[^>]*>'").withColumn("html", F.regexp_replace("html", r"(?is)\A(.*?<body[^>]*>)", "$1" + _SNIPPET))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("null" if v is None else str(v) if isinstance(v, int) else "'" + v + "'" for v in r) + ")" for r in rows)


def _flags_sql() -> str:
    """Flags of HTML elements as SQL, from the fixed table of names."""
    from ..functions.tags import FLAG_BITS, REFERENCE_FLAGS

    bits = lambda names: sum(FLAG_BITS[n] for n in names.split())
    cases = " ".join(f"when local_name in ({', '.join(repr(t) for t in sorted(tags))}) then {bits('HtmlMember ' + flags)}" for flags, tags in REFERENCE_FLAGS.items())
    return f"case when kind not in ('element', 'document') then 0 {cases} else {FLAG_BITS['HtmlMember']} end"


def _snippet_rows() -> list[tuple]:
    from ..functions.tags import FLAG_BITS

    return [(*r[:9], sum(FLAG_BITS[n] for n in r[9].split()), r[10]) for r in _SNIPPET_NODES]


_HAS_BODY = "h as (select distinct page_id from pages where regexp_matches(html, '<body[^>]*>', 'i')), bd as (select n.page_id, n.node_id as b, n.depth as bdepth from n join h using (page_id) where n.kind = 'element' and n.local_name = 'body' and n.depth = 2)"
_SHIFTED = f"""sn(k, p, e, dp, cn, kind, local_name, attr_line, content, flags, ns) as (values {{rows}}),
old as (select n.page_id, node_id + case when node_id > b then {_SNIPPET_LEN} else 0 end as node_id, parent_id + case when parent_id > b then {_SNIPPET_LEN} else 0 end as parent_id,
  sub_end + case when sub_end >= b then {_SNIPPET_LEN} else 0 end as sub_end, depth, child_no + case when parent_id = b then {_SNIPPET_KIDS} else 0 end as child_no, kind, local_name, {_LINE} as attr_line, content,
  {{flags}} as flags, case when kind = 'element' then 'html' end as ns from n join bd using (page_id)),
w as (select * from old union all select page_id, b + k, case when p < 0 then b else b + p end, b + e, bdepth + dp, cn, kind, local_name, attr_line, content, flags, ns from bd cross join sn)"""


def _injected_sql(rest: str) -> str:
    return f"with {_N}, {_HAS_BODY}, {_SHIFTED.format(rows=_values(_snippet_rows()), flags=_flags_sql())} {rest}"


@_query(_injected_sql("select * from w"))
def q_templates_svg_math(spark, d):
    """Nodes, flags and namespaces of all pages with a template, SVG and MathML written in;
    what the templates hold lies behind the tree."""
    names = ["node_id", "parent_id", "sub_end", "depth", "child_no", "kind", "local_name", "attrs", "content", "flags", "ns", "template_of"]
    nodes = Q.in_tree(H.parse(_with_snippet(spark, d), columns=names))
    line = F.coalesce(F.array_join(F.transform("attrs", lambda a: F.concat(a["name"], F.lit("="), a["value"])), "|"), F.lit(""))
    return nodes.withColumn("attr_line", line).drop("attrs", "template_of")


_CONTENT_SQL = "select page_id, unnest([1, 2, 3, 4, 5]) as no, unnest(['a', 'IN', 'template', 'b', 'deep']) as what, unnest([1, 0, 1, 2, 0]) as under from h"


@_query(f"with h as (select distinct page_id from pages where regexp_matches(html, '<body[^>]*>', 'i')) {_CONTENT_SQL}")
def q_template_contents(spark, d):
    """The contents of the templates, in their order: 0 in another node of the contents, 1
    at the top of the outer template, 2 at the top of the inner one."""
    nodes = H.parse(_with_snippet(spark, d), columns=["node_id", "parent_id", "kind", "local_name", "content", "template_of"]).where("template_of is not null")
    w = Window.partitionBy("page_id").orderBy("node_id")
    outer = F.min("template_of").over(Window.partitionBy("page_id"))
    under = F.when(F.col("parent_id") != F.col("template_of"), 0).when(F.col("template_of") == outer, 1).otherwise(2)
    return nodes.select("page_id", F.row_number().over(w).alias("no"), F.coalesce("local_name", "content").alias("what"), under.alias("under"))


@_query(_injected_sql("""select 'chain' as walk, page_id, node_id, null as text from w l where kind = 'element' and local_name = 'a' and exists (select 1 from w v where v.page_id = l.page_id and v.kind = 'element' and v.local_name = 'div' and l.node_id > v.node_id and l.node_id <= v.sub_end)
union all select 'one', page_id, min(node_id), null from w where kind = 'element' and local_name = 'a' group by page_id
union all select 'text', v.page_id, v.node_id, string_agg(t.content, '' order by t.node_id) from w v join w t on t.page_id = v.page_id and t.kind = 'text' and t.node_id > v.node_id and t.node_id <= v.sub_end where v.local_name = 'div' and v.attr_line = 'class=tpl' group by 1, 2, 3
union all select 'below', page_id, count(*), null from w where node_id > 0 group by page_id"""))
def q_template_walks(spark, d):
    """Chains, the first match, text and descendants pass template contents by."""
    nodes = H.parse(_with_snippet(spark, d), columns=["node_id", "parent_id", "sub_end", "kind", "local_name", "attrs", "content", "template_of"])
    none = F.lit(None).cast("string").alias("text")
    parts = [
        Q.query_all(nodes, P.tag("div"), P.tag("a")).select(F.lit("chain").alias("walk"), "page_id", F.col("node_id").cast("bigint"), none),
        Q.query_one(nodes, P.tag("a")).select(F.lit("one").alias("walk"), "page_id", F.col("node_id").cast("bigint"), none),
        T.text_content(nodes, P.tag_class("div", "tpl")).select(F.lit("text").alias("walk"), "page_id", F.col("node_id").cast("bigint"), "text"),
        Q.descendants(nodes).groupBy("page_id").agg(F.count(F.lit(1)).alias("node_id")).select(F.lit("below").alias("walk"), "page_id", "node_id", none),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@_query(_injected_sql("select page_id, count(*) as n_links, 2 as n_with_contents, 1 as n_in_template from w where kind = 'element' and local_name = 'a' group by page_id").replace("2 as n_with_contents", "count(*) + 1 as n_with_contents"))
def q_template_nested(spark, d):
    """The nested form: links of the tree, links with template contents, and links that have
    a template above them, which the climb through the parent finds."""
    pages = H.parse_nested(_with_snippet(spark, d, _raw_pages(spark, d)))
    n = F.col("nodes")
    size = lambda hits: F.size(hits).cast("bigint")
    return pages.select(
        "page_id", size(Q.match_nested(n, (P.tag("a"),))).alias("n_links"), size(Q.match_nested(n, (P.tag("a"),), True)).alias("n_with_contents"),
        F.size(Q.match_nested(n, (P.tag("div"), P.tag("template"), P.tag("a")), True)).alias("n_in_template"),
    ).distinct()


# ------------------------------------------------------------------ selectors made from the pages
_SEL_BAD = _BAD_NAME.replace(chr(39), chr(39) * 2)


@_query(f"""with {_N}, e as (select page_id, node_id, local_name as tag, case when not regexp_matches({_ATTR.format('id')}, '{_SEL_BAD}') then {_ATTR.format('id')} end as ident, {_TOKS} as toks from n where kind = 'element'),
c as (select page_id, node_id, tag, ident, unnest(list_distinct(list_filter(toks, lambda x: not regexp_matches(x, '{_SEL_BAD}')))) as cls from e),
s as (select page_id, tag, null as ident, null as cls, count(*) as n from e group by 1, 2 union all select page_id, null, ident, null, count(*) from e where ident <> '' group by 1, 3 union all select page_id, tag, ident, null, count(*) from e where ident <> '' group by 1, 2, 3
 union all select page_id, null, null, cls, count(*) from c group by 1, 4 union all select page_id, tag, null, cls, count(*) from c group by 1, 2, 4 union all select page_id, tag, ident, cls, count(*) from c where ident <> '' group by 1, 2, 3, 4)
select page_id, coalesce(tag, '*') || coalesce('#' || ident, '') || coalesce('.' || cls, '') as selector, n from s""")
def q_selector_replay(spark, d):
    """Selectors as the reference's tests make them, from the tags, harmless ids and classes of
    the page itself, all of them; each is then matched against all elements of the page."""
    pages = H.parse_nested(_raw_pages(spark, d)).where("nodes is not null")
    struct = F.struct
    null = F.lit(None).cast("string")
    value = lambda x, name: F.get(F.filter(x["attrs"], lambda a: a["name"] == name), F.lit(0))["value"]
    parts = lambda x: F.filter(F.array_distinct(F.split(F.coalesce(value(x, "class"), F.lit("")), P.CLASS_SPLIT)), lambda c: c != "")

    def elements(x):
        ident = value(x, "id")
        return struct(x["local_name"].alias("tag"), F.when((ident != "") & ~ident.rlike(_BAD_NAME), ident).alias("ident"), F.filter(parts(x), lambda c: ~c.rlike(_BAD_NAME)).alias("cls"))

    def made(e):
        sel = lambda t, i, c: struct(t.alias("tag"), i.alias("ident"), c.alias("cls"))
        by_class = F.flatten(F.transform(e["cls"], lambda c: F.array(sel(null, null, c), sel(e["tag"], null, c), sel(e["tag"], e["ident"], c))))
        return F.concat(F.array(sel(e["tag"], null, null), sel(null, e["ident"], null), sel(e["tag"], e["ident"], null)), by_class)

    def matches(e, s):
        return (s["tag"].isNull() | (e["tag"] == s["tag"])) & (s["ident"].isNull() | (e["ident"] == s["ident"])) & (s["cls"].isNull() | F.array_contains(e["cls"], s["cls"]))

    some = pages.select("page_id", F.transform(F.filter("nodes", lambda x: x["kind"] == "element"), elements).alias("e")).distinct()
    made_of = F.array_distinct(F.filter(F.flatten(F.transform("e", made)), lambda s: s["tag"].isNotNull() | s["ident"].isNotNull() | s["cls"].isNotNull()))
    hits = some.select("page_id", F.inline(F.transform(made_of, lambda s: struct(s["tag"].alias("tag"), s["ident"].alias("ident"), s["cls"].alias("cls"), F.size(F.filter("e", lambda e: F.coalesce(matches(e, s), F.lit(False)))).cast("bigint").alias("n")))))
    name = F.concat(F.coalesce("tag", F.lit("*")), F.coalesce(F.concat(F.lit("#"), F.col("ident")), F.lit("")), F.coalesce(F.concat(F.lit("."), F.col("cls")), F.lit("")))
    return hits.select("page_id", name.alias("selector"), "n")


# ------------------------------------------------------------------ prefixes, caches, responses
@_query(f"""with {_N}, hd as (select page_id, node_id, sub_end, parent_id from n where kind = 'element' and local_name = 'head' and depth = 2), ok as (select distinct page_id from pages where contains(html, '</head>'))
select n.page_id, n.node_id, case when n.node_id = hd.parent_id or n.node_id = 0 then hd.sub_end + 1 else n.sub_end end as sub_end, n.kind, n.local_name from n join hd using (page_id) join ok using (page_id) where n.node_id <= hd.sub_end
union all select page_id, sub_end + 1, sub_end + 1, 'element', 'body' from hd join ok using (page_id)""")
def q_parse_prefix(spark, d):
    """Only the characters up to the end of the head are parsed; the body is implied."""
    p = _pages(spark, d).where("html like '%</head>%'")
    return H.parse(p, length=F.expr("locate('</head>', html) + 6"), columns=["node_id", "sub_end", "kind", "local_name"])


_CYRILLIC = "".join(map(chr, range(0x410, 0x450)))


@_query(f"with p as (select distinct page_id, html, regexp_replace(html, '[^\\x00-\\x7f{_CYRILLIC}]', '', 'g') as c from pages where html is not null) select page_id, md5(html) as named, md5(html) as bare, md5(html) as big, md5(html) as wide, md5(html) as mismatch, md5(c) as cyrillic, md5(html) as unknown from p")
def q_charset_forms(spark, d):
    """Every page as the bytes of a response and back: announced UTF-8 with its mark, UTF-16 in
    both orders and UTF-32 by mark alone, an announced UTF-16 with its mark, Cyrillic as
    windows-1251, and an unknown charset taken as UTF-8."""
    p = _pages(spark, d).where("html is not null")
    none = F.lit(None).cast("string")
    mark = lambda h, body: F.concat(F.unhex(F.lit(h)), body)
    utf8 = F.encode("html", "UTF-8")
    # four bytes a character, last first
    wide = F.unhex(F.regexp_replace(F.hex(F.encode("html", "UTF-32")), "(..)(..)(..)(..)", "$4$3$2$1"))
    only = F.regexp_replace("html", f"[^\\x00-\\x7f{_CYRILLIC}]", "")
    # the letters stand in windows-1251 where Latin-1 has those from U+00C0 on
    as_1251 = F.encode(F.translate(only, _CYRILLIC, "".join(map(chr, range(0xC0, 0x100)))), "ISO-8859-1")
    md5 = lambda body, kind, **kw: F.md5(charset.decode(body, kind, **kw))
    return p.select(
        "page_id", md5(mark("EFBBBF", utf8), F.lit('text/html; charset="UTF-8"')).alias("named"), md5(mark("FFFE", F.encode("html", "UTF-16LE")), none).alias("bare"), md5(mark("FEFF", F.encode("html", "UTF-16BE")), none).alias("big"),
        md5(mark("FFFE0000", wide), none).alias("wide"), md5(mark("FFFE", F.encode("html", "UTF-16LE")), F.lit("text/html;charset=utf-16")).alias("mismatch"), md5(as_1251, F.lit("text/html; charset=windows-1251")).alias("cyrillic"),
        md5(utf8, F.lit("text/html; charset=no-such"), on_unknown="utf-8").alias("unknown"),
    )


# fixed values: addresses that hold their page, in several charsets, and one that can't be had
_ADDRESSES = (
    ("data:text/html;charset=utf-8;base64,77u/PHA+w6k8L3A+", "text/html;charset=utf-8", 12, "<p>é</p>"),
    ("data:text/html;charset=windows-1251;base64,z/Do4uXy", "text/html;charset=windows-1251", 6, "Привет"),
    ("data:text/html;charset=gb2312;base64,xOO6ww==", "text/html;charset=gb2312", 4, "你好"),
    ("data:text/html;base64,//5hAA==", "text/html", 4, "a"),
    ("data:text/html;charset=no-such;base64,w6k=", "text/html;charset=no-such", 2, "é"),
    ("data:text/html;base64,w6k=", "text/html", 2, "é"),
    ("data:text/html;base64,//4AAGEAAAA=", "text/html", 8, "a"),
    ("nothing://x.example/", None, None, None),
)


@_query("select * from (values " + _values(_ADDRESSES) + ") t(url, content_type, total_bytes, html)")
def q_fetch_and_decode(spark, d):
    """Responses fetched by the page source, then decoded to characters."""
    from ..sources import http

    http.register(spark)
    got = spark.read.format("web_pages").option("urls", "\n".join(a[0] for a in _ADDRESSES)).option("urlsPerPartition", "2").load()
    return got.select("url", "content_type", "total_bytes", charset.decode("body", on_unknown="utf-8").alias("html"))


_FILE = "replace(replace(replace(replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), 'www.', ''), '.com', ''), '.de', ''), '.org', '')"


@_query(f"with {_DL}, c as (select distinct {_FILE} as f from pages where html is not null and url is not null), u as (select download_id, {_FILE} as f from dl) select download_id, coalesce(f, '') <> '' and f in (select f from c where f <> '') as cached from u")
def q_cached(spark, d):
    """Which downloads a cache of the pages' files would save."""
    cache = table(spark, d, "pages").where("html is not null and url is not null").select(cache_name().alias("file"), "html").where("file is not null")
    have, rest = with_cached(_downloads(spark, d, "url"), cache)
    return have.select("download_id", F.lit(True).alias("cached")).unionByName(rest.select("download_id", F.lit(False).alias("cached")))


@_query(_text_sql(_is("h1"), "t.content", "'Page ' || page_id || ': ' || coalesce(string_agg(s, '' order by tn), '')"))
def q_text_prefix(spark, d):
    n = _raw_nodes(spark, d, "sub_end", "kind", "local_name", "content").withColumn("before", F.concat(F.lit("Page "), F.col("page_id"), F.lit(": ")))
    return T.text_content(n, P.tag("h1"), prefix="before")


# ------------------------------------------------------------------ streams
@_query("select distinct page_id, count(distinct node_id) as n_nodes from nodes group by page_id")
def q_stream_parse(spark, d):
    """Pages arrive as a stream, are parsed, and the node counts land in a table."""
    import uuid

    from ..streaming import page_stream

    out = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    # a pattern, as the table may be one file
    nodes = H.parse(page_stream(spark, f"{d}/pages.parque[t]"), columns=["node_id"])

    def batch(df: DataFrame, _: int) -> None:
        df.groupBy("page_id").agg(F.countDistinct("node_id").alias("n_nodes")).write.mode("append").parquet(f"{out}/t")

    nodes.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("page_id bigint, n_nodes bigint").parquet(f"{out}/t").distinct()


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
