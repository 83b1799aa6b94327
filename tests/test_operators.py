"""Operators on node tables: quirks one by one, and both chain forms against a matcher in Python."""

import random

import pytest
from pyspark.sql import functions as F

from leafspan.functions.options import ParseOptions, first_tag
from leafspan.functions.tree import COLUMNS, parse_nodes
from leafspan.operators import filters, helpers
from leafspan.operators import predicates as P
from leafspan.operators import query as Q
from leafspan.operators import text as T
from leafspan.operators.serialize import serialize
from leafspan.sources import html as H


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, '<title>t</title><div class="a b" id=x><div class=" c\t"><span>1</span><span id="">2</span></div></div><p class="">q</p>'),
        (2, '<nav><ul><li><a href="/1">one</a></li><li><a href="/2" class="a">two</a></li></ul></nav><p> x <b> y </b> \n</p>'),
        (3, None),
        (4, ""),
    ]
    return spark.createDataFrame(rows, "page_id bigint, html string")


@pytest.fixture(scope="module")
def nodes(pages):
    return H.parse(pages).cache()


def names(df):
    return [(r["page_id"], r["local_name"] or r["content"]) for r in df.orderBy("page_id", "node_id").collect()]


def test_parse_forms_agree(pages, nodes):
    flat = H.parse_nested(pages).select("page_id", F.inline("nodes")).orderBy("page_id", "node_id").collect()
    assert flat == nodes.select(*["page_id", *COLUMNS]).orderBy("page_id", "node_id").collect()
    assert {r["ancestors"] for r in flat} == {None}
    with_up = H.parse_nested(pages, ancestors=True).select("page_id", F.inline("nodes")).where("local_name = 'body' and page_id = 1").first()
    assert with_up["ancestors"] == [1, 0]
    assert {r[0] for r in nodes.select("page_id").distinct().collect()} == {1, 2, 4}
    assert H.parse_nested(pages).where("nodes is null").count() == 1
    narrow = H.parse(pages, columns=["local_name", "node_id"])
    assert narrow.columns == ["page_id", "local_name", "node_id"] and narrow.count() == nodes.count()
    assert names(H.parse(pages, token_filter=first_tag("nav")).where("kind = 'text' and page_id = 2")) == [(2, "one"), (2, "two")]
    short = H.parse(pages, length=F.lit(16))
    assert names(short.where("kind = 'text'")) == [(1, "t")]


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], "page_id bigint, html string")
    assert H.parse(none).count() == 0 and H.tokenize(none).count() == 0 and H.parse_nested(none).count() == 0
    odd = spark.createDataFrame([("k", "<p>x", 1, "n")], "page_id string, html string, k int, node_id string")
    assert H.parse(odd).where("kind = 'text'").select("page_id", "content").collect() == [("k", "x")]
    twice = spark.createDataFrame([(1, "<p>x")] * 2, "page_id bigint, html string")
    assert H.parse(twice).where("kind = 'text'").count() == 2


@pytest.mark.parametrize(
    ("pred", "expected"),
    [
        (P.with_id("x"), ["div"]),
        (P.with_id(""), ["span"]),
        (P.with_class("a"), ["div", "a"]),
        (P.with_class("a b"), ["div"]),
        (P.with_class("c"), ["div"]),
        (P.with_class(""), ["p"]),
        (P.with_classes("b", "a"), ["div"]),
        (P.with_classes("a", "a"), []),
        (P.with_classes("a b", "a"), []),
        (P.with_attr("href"), ["a", "a"]),
        (P.with_attr("href", "/2"), ["a"]),
        (P.tag_id("div", "x"), ["div"]),
        (P.tag_class("a", "a"), ["a"]),
        (P.tag_classes("div", "a", "b"), ["div"]),
        (P.tag("#document"), ["#document"] * 3),
        (P.tag("LI"), []),
        (P.tag("li") | P.tag("ul"), ["ul", "li", "li"]),
        (P.tag("a") & ~P.with_class("a"), ["a"]),
        (P.where(lambda f: f("content") == "one"), ["one"]),
    ],
)
def test_predicates(nodes, pred, expected):
    assert [n for _, n in names(nodes.where(pred.on_row()))] == expected


def test_queries(nodes):
    assert [n for _, n in names(Q.query_all(nodes))] == [n for _, n in names(nodes)]
    assert names(Q.query_all(nodes, P.tag("div"), P.tag("div"), P.tag("span"))) == [(1, "span")] * 2
    assert names(Q.query_all(nodes, P.tag("div"), P.tag("div"), P.tag("div"), P.tag("span"))) == []
    assert names(Q.query_all(nodes, P.tag("span"), P.tag("span"))) == []
    assert names(Q.query_all(nodes, P.tag("#document"), P.tag("li"))) == [(2, "li")] * 2
    assert names(Q.query_all(nodes, P.tag("div"), start=P.tag("div"))) == [(1, "div")] * 2  # the start counts
    assert names(Q.query_all(nodes, P.tag("body"), P.tag("a"), start=P.tag("li"))) == [(2, "a")] * 2  # ancestors may lie outside
    assert names(Q.query_one(nodes, P.tag("li"))) == [(2, "li")]
    assert names(Q.accessor(nodes, "body")) == [(1, "body"), (2, "body"), (4, "body")]
    ul = nodes.where(P.tag("ul").on_row())
    assert names(Q.children(nodes, ul, 1)) == [(2, "li")] and Q.children(nodes, ul, 5).count() == 0 and Q.children(nodes, ul, -1).count() == 0
    assert names(Q.parents(nodes, ul)) == [(2, "nav")]
    assert Q.descendants(nodes, ul).count() == 6
    assert [r[2:] for r in Q.attributes(nodes.where("local_name = 'a'")).orderBy("node_id", "attr_no").collect()] == [(0, "href", "/1"), (0, "href", "/2"), (1, "class", "a")]


def matches(rows, preds):
    """A plain matcher: greedy climb."""
    out = []
    for r in rows:
        if r[7] != preds[-1]:
            continue
        left = list(preds[:-1])
        for a in r[15]:
            if left and rows[a][7] == left[-1]:
                left.pop()
        if not left:
            out.append(r[0])
    return out


def test_chain_forms_agree_on_random_trees(spark):
    r = random.Random(5)

    def tree(depth):
        tag = r.choice(["div", "span", "b"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(r.randint(0, 3)) if depth) + f"</{tag}>"

    docs = [(i, "".join(tree(4) for _ in range(2))) for i in range(12)]
    pages = spark.createDataFrame(docs, "page_id bigint, html string")
    flat, nested = H.parse(pages).cache(), H.parse_nested(pages).cache()
    for preds in (["div"], ["div", "span"], ["div", "div", "span"], ["b", "div", "b", "span"]):
        expected = sorted((i, n) for i, h in docs for n in matches(parse_nodes(h), preds))
        ps = [P.tag(x) for x in preds]
        assert sorted(map(tuple, Q.query_all(flat, *ps).select("page_id", "node_id").collect())) == expected
        got = Q.query_all_nested(nested, *ps).select("page_id", F.explode("nodes").alias("x")).select("page_id", "x.node_id")
        assert sorted(map(tuple, got.collect())) == expected


@pytest.mark.parametrize(
    ("texts", "none", "nodes_", "ends"),
    [([""], "", "", ""), ([" "], " ", "", ""), (["   "], "   ", "", ""), ([" a "], " a ", "a", "a"), (["a \n"], "a \n", "a", "a"), ([" x", "   "], " x   ", "x", "x"), (["  ", " "], "   ", "", " "), ([], "", "", ""), (["a ", "b "], "a b ", "ab", "a b ")],
)
def test_trim_modes(spark, texts, none, nodes_, ends):
    df = spark.createDataFrame([(texts,)], "t array<string>")
    got = df.select(T.join_texts(F.col("t")).alias("a"), T.join_texts(F.col("t"), "nodes").alias("b"), T.join_texts(F.col("t"), "ends").alias("c")).first()
    assert tuple(got) == (none, nodes_, ends)


def test_text_content(nodes):
    p = nodes.where("local_name = 'p'")
    assert sorted(r["text"] for r in T.text_content(nodes, p).collect()) == [" x  y ", "q"]
    assert sorted(r["text"] for r in T.text_content(nodes, p, "nodes").collect()) == ["q", "xy"]
    assert sorted(r["text"] for r in T.text_content(nodes, p, "ends").collect()) == ["q", "x  y"]
    assert {r["text"] for r in T.text_content(nodes, nodes.where("kind = 'text'")).collect()} == {""}
    pre = p.withColumn("pre", F.lit("> "))
    assert sorted(r["text"] for r in T.text_content(nodes, pre, "ends", prefix="pre").collect()) == ["> q", "> x  y"]
    assert {r["text"] for r in T.text_content(nodes, p, consume=F.length).collect()} == {6, 1}
    with pytest.raises(ValueError, match="trim"):
        T.join_texts(F.col("x"), "both")


def test_serialize(spark):
    doc = H.parse(spark.createDataFrame([(1, '<!DOCTYPE html PUBLIC "p" "s"><p a=\'x"y\'>t<br><!--c--></p><template>hidden</template>')], "page_id bigint, html string"))
    out = serialize(doc).first()["markup"]
    assert out == '<#document>\n<!DOCTYPE html p s>\n<html>\n<head>\n</head>\n<body>\n<p a="x"y">\nt<br>\n</br>\n<!--c--></p>\n<template>\n</template>\n</body>\n</html>\n</#document>\n'


def test_filters_by_window_match_the_parser(pages):
    toks = H.tokenize(pages)
    got = filters.first_tag_and_children(toks, "nav").orderBy("tok_no").collect()
    assert [r["name"] for r in got if r["type"] == "start"] == ["nav", "ul", "li", "a", "li", "a"]
    assert filters.only_element_with_id(toks, "div", "x").where("type = 'text'").count() == 2
    assert filters.token_filter(toks, F.lit(None).cast("boolean")).count() == 0
    assert H.tokenize(pages, options=ParseOptions(skip_data_text=True)).where("type = 'text' and name = ''").count() == 1  # the title's


def test_helpers(spark):
    df = spark.createDataFrame([("a b,,c", None, "Straße"), (None, "", "  ")], "s string, p string, t string")
    got = df.select(
        helpers.split_set("s", " ,").alias("a"), helpers.split_on("s", ",,").alias("b"), helpers.contains_i("t", "STRASSE").alias("c"), helpers.contains_i("s", "").alias("d"), helpers.is_null_or_whitespace("t").alias("e"),
        helpers.combine("p", "s").alias("f"), helpers.try_at(helpers.split_set("s", " "), -1).alias("g"), helpers.try_at(helpers.split_set("s", " "), 0).alias("h"), helpers.combine(F.lit("x"), "t").alias("i"),
    ).collect()
    assert tuple(got[0]) == (["a", "b", "c"], ["a b", "c"], True, True, False, "a b,,c", None, "a", "x:Straße")
    assert tuple(got[1])[4:7] == (True, None, None)
    with pytest.raises(ValueError, match="sentinel"):
        helpers.split_on("s", "")
    u = spark.createDataFrame([(None, "https://u:p@Host.example:80/x"), ("e", "http://h/"), (None, None), (None, "junk")], "endpoint_id string, url string")
    assert [r[0] for r in u.select(helpers.endpoint_key()).collect()] == ["host.example", "e", "unknown", "unknown"]


def test_ring_average(spark):
    rows = [("a", i, i // 7, v) for i, v in enumerate([5, 6, None, *range(40)])] + [("b", 0, 0, -3), ("b", 1, 0, -4), ("b", 2, 1, 1), (None, 0, 0, 9), (None, 1, 0, 1)]
    df = spark.createDataFrame(rows, "k string, i int, day int, v bigint")
    plain = {(r["k"], r["i"]): r["ring_avg"] for r in helpers.ring_average(df, "v", "k", ["i"]).collect()}
    sliced = {(r["k"], r["i"]): r["ring_avg"] for r in helpers.ring_average(df, "v", "k", ["i"], slice_of=F.col("day")).collect()}
    assert plain == sliced
    assert plain["a", 0] is None and plain["a", 1] == 5 and plain["a", 3] == 5 and plain["b", 2] == -3 and plain[None, 1] == 9
    for i in range(20, 43):
        ring = [r[3] for r in rows[i - 16 : i] if r[3] is not None]
        assert plain["a", i] == sum(ring) // len(ring)
    assert df.select(helpers.size_hint(F.lit(None), F.lit(None), F.lit(3))).first()[0] == 3


# ------------------------------------------------------------------ templates
TEMPLATE = "<div><template><a>IN</a><p><template><a>deep</a></template></p></template><a>OUT</a></div>"


def test_template_contents_are_passed_by(spark):
    pages = spark.createDataFrame([(1, TEMPLATE), (2, "<a>x</a>")], "page_id bigint, html string")
    nodes = H.parse(pages).cache()
    text = lambda df: sorted(r["text"] for r in T.text_content(nodes, df).collect())
    assert text(Q.query_all(nodes, P.tag("a"))) == ["OUT", "x"]
    assert text(Q.query_all(nodes, P.tag("div"), P.tag("a"))) == ["OUT"] == text(nodes.where("local_name = 'div'"))
    assert sorted(r["text"] for r in T.text_content(nodes, P.tag("a")).collect()) == ["OUT", "x"]
    assert text(Q.query_one(nodes, P.tag("a"))) == ["OUT", "x"]
    assert Q.descendants(nodes).where("page_id = 1").count() == 7  # html head body div template a OUT, without the document
    assert Q.descendants(nodes, nodes.where("local_name = 'template'")).count() == 0
    assert names(Q.children(nodes, nodes.where("local_name = 'template'"))) == []
    assert [r["n_children"] for r in Q.child_counts(nodes.where("page_id = 1")).orderBy("parent_id").collect()] == [1, 2, 1, 2, 1, 1, 1, 1]
    # within the contents walks go on, and the climb leads through the template
    assert text(Q.query_all(nodes, P.tag("a"), contents=True)) == ["IN", "OUT", "deep", "x"]
    assert text(Q.query_all(nodes, P.tag("div"), P.tag("template"), P.tag("a"), contents=True)) == ["IN", "deep"]
    assert text(Q.query_all(nodes, P.tag("div"), P.tag("a"), start=P.tag("p"), contents=True)) == []
    assert text(Q.query_all(nodes, P.tag("p"), P.tag("template"), P.tag("a"), contents=True)) == ["deep"]
    nested = H.parse_nested(pages)
    for preds, contents, n in (((P.tag("a"),), False, 2), ((P.tag("div"), P.tag("a")), False, 1), ((P.tag("div"), P.tag("template"), P.tag("a")), True, 2), ((), False, 14)):
        got = Q.query_all_nested(nested, *preds, contents=contents).select(F.explode("nodes"))
        assert got.count() == n


def test_depth_costs_no_squares():
    deep = parse_nodes("<div>" * 2_000, ancestors=False)
    assert len(deep) == 2_004 and deep[-1][3] == 2_002 and not deep[-1][15]


# ------------------------------------------------------------------ plans
def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange Round") + plan.count("Exchange Single")


def test_one_exchange_by_page(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    if not __import__("os").path.isdir(d):
        pytest.skip("no test data here")
    q = entry.queries()
    for name in ("q_chain_nav_li_a", "q_chain_class", "q_chain_div_div_a", "q_p_text_trim_ends", "q_print_document", "q_same_attributes", "q_attributes", "q_query_one_first_link", "q_file_tag_counts", "q_child_counts"):
        assert exchanges(q[name](spark, d)) == 1, name
    chain = q["q_chain_nav_li_a"](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "attrs" not in chain and "content" not in chain and chain.count("FileScan") == 1


def test_copies_collapse_and_null_keys(spark):
    pages = spark.createDataFrame([(1, "<nav><a>x</a></nav>"), (None, "<nav><a>y</a></nav>")] * 3, "page_id bigint, html string")
    nodes = H.parse(pages)
    assert Q.query_all(nodes, P.tag("a")).count() == 6
    assert Q.query_all(nodes, P.tag("nav"), P.tag("a")).count() == 1
    assert T.text_content(nodes, P.tag("a")).collect() == [(1, nodes.where("local_name = 'a'").first()["node_id"], "x")]
    assert H.distinct_pages(pages).count() == 2 and H.distinct_pages(pages.limit(0)).count() == 0
    assert H.distinct_pages(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], pages.schema)).count() == 3


def test_repeated_pages_beyond_the_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([(i % 5, "a") for i in range(10)], "page_id bigint, html string")
    monkeypatch.setattr(H, "MAX_REPEATED", 2)
    assert H.distinct_pages(pages).count() == 5
