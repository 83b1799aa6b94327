"""Tokenizer and tree builder: goldens worked out from the public standard."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafspan.functions import tags
from leafspan.functions.options import ParseOptions, TokenFilter, element_with_id, first_tag
from leafspan.functions.tokenizer import decode_references, tokenize
from leafspan.functions.tree import COLUMNS, parse_nodes

ID, PARENT, END, KIND, NAME, ATTRS, CONTENT, FLAGS, OWNER, UP = (COLUMNS.index(c) for c in ("node_id", "parent_id", "sub_end", "kind", "local_name", "attrs", "content", "flags", "template_of", "ancestors"))


def shape(html, **kw):
    rows = parse_nodes(html, **kw)
    below = {}
    for r in rows:
        below.setdefault(r[PARENT], []).append(r)

    def show(r):
        kids = [show(k) for k in below.get(r[ID], [])]
        label = repr(r[CONTENT]) if r[KIND] == "text" else r[NAME] if r[KIND] == "element" else r[KIND]
        return label + (f"({', '.join(kids)})" if kids else "")

    return show(rows[0])


def body(html, **kw):
    s = shape(html, **kw)
    return s[s.index("body") :].removesuffix("))")


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<article><p><b>x<br><p>y</article><footer>z</footer>", "body(article(p(b('x', br)), p(b('y'))), footer(b('z')))"),
        ("<ul><li>a<li>b</ul>", "body(ul(li('a'), li('b')))"),
        ("<table><tr><td>1</table>", "body(table(tbody(tr(td('1')))))"),
        ("<table>x<tr><td>1</table>", "body('x', table(tbody(tr(td('1')))))"),
        ("<p>1<b>2<i>3</b>4</i>5</p>", "body(p('1', b('2', i('3')), i('4'), '5'))"),
        ("<a>1<p>2</a>3</p>", "body(a('1'), p(a('2'), '3'))"),
        ("<select><option>a<option>b</select>", "body(select(option('a'), option('b')))"),
        ("<!DOCTYPE html><p><table></table>", "body(p, table)"),
        ("<p><table></table>", "body(p(table))"),
        ("<body><form><div></form></div>z", "body(form(div), 'z')"),
        ("<svg><desc><p>a</p></desc><circle/></svg>", "body(svg(desc(p('a')), circle))"),
        ("<math><mi>x</mi></math>", "body(math(mi('x')))"),
        ("<svg><p>out</svg>", "body(svg, p('out'))"),
        ("<textarea>\nz</textarea>", "body(textarea('z'))"),
        ("a</nothing>b", "body('ab')"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "body(dl(dt('a'), dd('b'), dt('c')))"),
        ("<h1>a<h2>b", "body(h1('a'), h2('b'))"),
        ("<button>a<button>b", "body(button('a'), button('b'))"),
        ("<ruby>x<rt>y<rp>z</ruby>", "body(ruby('x', rt('y'), rp('z')))"),
        ("<nobr>a<nobr>b", "body(nobr('a'), nobr('b'))"),
        ("x</p>", "body('x', p)"),
        ("<table><caption>c<tr><td>d</table>", "body(table(caption('c'), tbody(tr(td('d')))))"),
        ("<table><col><tr><th>h", "body(table(colgroup(col), tbody(tr(th('h')))))"),
        ("<iframe><p></iframe>x", "body(iframe('<p>'), 'x')"),
        ("<plaintext><p>a", "body(plaintext('<p>a'))"),
    ],
)
def test_recovery(html, expected):
    assert body(html) == expected


def test_head_and_raw_text():
    assert shape('<script>var t="</p>";</script><p>q') == "document(html(head(script('var t=\"</p>\";')), body(p('q'))))"
    assert shape("<title>a&amp;<b></title>x") == "document(html(head(title('a&<b>')), body('x')))"
    assert shape("<frameset><frame></frameset>") == "document(html(head, frameset(frame)))"
    assert shape("<noscript><p>x</noscript>y") == "document(html(head(noscript), body(p('xy'))))"
    assert shape("<script><!-- <script></script> --></script>z").endswith("body('z')))")
    assert shape("") == "document(html(head, body))"


def test_text_rules():
    assert body("<p> \t\n</p><p>\f</p>") == "body(p, p('\\x0c'))"
    assert body("<p> </p>", options=ParseOptions(emit_whitespace=True)) == "body(p(' '))"
    assert body("a</x>b", options=ParseOptions(merge_text=False)) == "body('a', 'b')"
    assert body("<p>&amp;</p>", options=ParseOptions(decode_entities=False)) == "body(p('&amp;'))"


def test_options_keep_and_skip():
    o = ParseOptions(skip_comments=True, skip_script_text=True, skip_raw_text=True, skip_rcdata_text=True, keep_attrs={"id"})
    rows = parse_nodes("<title>t</title><style>s</style><script>x</script><!-- c --><p id=a class=b>k</p>", o)
    assert [r[CONTENT] for r in rows if r[KIND] == "text"] == ["k"]
    assert [r[ATTRS] for r in rows if r[NAME] == "p"] == [[("id", "a")]]
    rows = parse_nodes("<p id=a class=b><div id=c class=d>", ParseOptions(keep_attrs={"div": ("class",)}))
    assert {r[NAME]: r[ATTRS] for r in rows if r[NAME] in ("p", "div")} == {"p": [], "div": [("class", "d")]}
    assert parse_nodes("x", ParseOptions(skip_data_text=True))[-1][NAME] == "body"
    assert [r[CONTENT] for r in parse_nodes("<?a b?>", ParseOptions(processing_instructions=True)) if r[KIND] == "pi"] == ["a b?"]
    with pytest.raises(NotImplementedError, match="strict"):
        ParseOptions(strict=True)


def test_attributes():
    rows = parse_nodes('<p A=1 a=2 b=\'x"\' c d="&copy;&copyx" e="?a=1&copy=2">')
    assert next(r for r in rows if r[NAME] == "p")[ATTRS] == [("a", "1"), ("b", 'x"'), ("c", ""), ("d", "©&copyx"), ("e", "?a=1&copy=2")]
    assert next(r for r in parse_nodes("<p Ab=1>", ParseOptions(preserve_attr_case=True)) if r[NAME] == "p")[ATTRS] == [("Ab", "1")]
    assert next(r for r in parse_nodes("<svg viewbox=1>") if r[NAME] == "svg")[ATTRS] == [("viewBox", "1")]


def test_references():
    assert decode_references("&amp &am &notit; &#x80; &#0; &#xD800; &#65 &unknown;") == "& &am ¬it; € � � A &unknown;"


def test_template_content_lies_outside():
    rows = parse_nodes("<div><template><b>in</b></template>out</div>")
    t = next(r for r in rows if r[NAME] == "template")
    inside = [r for r in rows if r[OWNER] == t[ID]]
    assert [r[NAME] or r[CONTENT] for r in inside] == ["b", "in"]
    assert t[END] == t[ID] and t[ID] in inside[0][UP]


def test_flags():
    rows = {r[NAME]: r[FLAGS] for r in parse_nodes("<p><td><svg><desc></desc></svg><math><mi></math><x-y>") if r[NAME]}
    f = tags.FLAG_BITS
    assert rows["p"] == f["HtmlMember"] | f["Special"] | f["ImplicitlyClosed"] | f["ImpliedEnd"]
    assert rows["x-y"] == f["HtmlMember"]
    assert rows["desc"] == f["SvgMember"] | f["HtmlTip"] | f["Special"] | f["Scoped"]
    assert rows["mi"] & f["MathTip"] and not rows["mi"] & f["HtmlMember"]
    assert tags.flags_of("td") == f["HtmlMember"] and tags.flags_of("#document") == f["HtmlMember"]


def test_tokens():
    t = tokenize("<!DOCTYPE html><p class=a>x<br/>&lt;</p><!-- c --><?pi?></1>")
    assert [(x[0], x[1], x[4]) for x in t] == [("doctype", "html", ""), ("start", "p", ""), ("text", "", "x"), ("start", "br", ""), ("text", "", "<"), ("end", "p", ""), ("comment", "", " c "), ("comment", "", "?pi?"), ("comment", "", "1"), ("eof", "", "")]
    assert t[3][2] and t[1][3] == [("class", "a")]
    assert tokenize(None) == [] and [x[0] for x in tokenize("")] == ["eof"]
    assert [x[4] for x in tokenize("a < b <3 <")] == ["a < b <3 <", ""]
    assert [x[0] for x in tokenize("x<p class='a")] == ["text", "eof"]


def kept(html, f):
    return [r[NAME] or r[CONTENT] for r in parse_nodes(html, token_filter=f) if r[KIND] in ("element", "text") and r[NAME] not in ("html", "head", "body")]


def test_token_filters():
    html = "<nav><ul><li>a</li></ul></nav><div id=m><p>b<br>c</p></div>tail"
    assert kept(html, first_tag("nav")) == ["nav", "ul", "li", "a"]
    # br opens and never closes, so the part runs on
    assert kept(html, element_with_id("div", "m")) == ["div", "p", "b", "br", "c", "tail"]
    assert kept(html, element_with_id("div", "m", void_aware=True)) == ["div", "p", "b", "br", "c"]
    assert kept(html, first_tag("none")) == []
    assert kept("<x/><x>a</x>", first_tag("x")) == []
    assert kept("<div>a</b>b</div>", first_tag("div")) == ["div", "a"]  # a stray end tag counts
    assert kept("<i>1</i><i>2</i>", first_tag("i")) == ["i", "1"]
    assert kept("<p a=1>x</p>", TokenFilter(lambda n, a: ("a", "1") in a)) == ["p", "x"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/ab pdivtr=\"'&;!-\n\0", max_size=60))
def test_parser_is_total_and_consistent(html):
    rows = parse_nodes(html)
    for i, r in enumerate(rows):
        assert r[ID] == i and r[END] >= i
        if i:
            p = rows[r[PARENT]]
            assert p[ID] < i and (r[END] <= p[END] or r[OWNER] is not None)
            assert r[UP] == (p[ID], *p[UP])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("<table> <tr> <td> </td> </table> <p> </p> <b> </b> <a> </a> <i> </i> <li> <ul> </ul> <select> <option> <template> </template> <svg> </svg> <form> </form> <h1> <button> <math> <mi> <desc> <div> </div> <caption> <col> x <script> </script> <title> </title> <body> <head> <frameset> <nobr> <dd> <dt> </br> <image> <hr> <object> </object>".split()), max_size=25))
def test_any_tag_soup(parts):
    rows = parse_nodes("".join(parts))
    assert rows[0][KIND] == "document" and [r[ID] for r in rows] == list(range(len(rows)))
