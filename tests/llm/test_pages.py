"""Problems 1 to 5 on small node tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspan.functions.tree import parse_nodes
from leafspan.llm import boilerplate, encoding, language, markup, residue

from .conftest import SAMPLES

TEXTS = [t for _, t in SAMPLES]


# ------------------------------------------------------------------ problem 1
@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("{{ user.name }} – a text", "placeholder"), ("${city}", "placeholder"), ("<%= title %>", "placeholder"), ("%PAGE_TITLE% | X", "placeholder"), ("__COUNT__", "placeholder"), ("@@a.b@@", "placeholder"),
        ("[FIRST NAME]", "placeholder"), ("Dear [First name],", "placeholder"), ("{0} | X", "placeholder"), ("{% block x %}{% endblock %}", "placeholder"), ("a [object Object]", "placeholder"), ("Hello undefined", "placeholder"),
        ("Lorem ipsum dolor sit amet consectetur", "filler"), ("foo bar blah asdf foo", "filler"), ("Sample text. Sample text.", "filler"), ("Text text text. Text text text.", "filler"),
        ("[Insert subtitle here]", "instruction"), ("ENTER THE HEADLINE (MAX. 80 CHARACTERS)", "instruction"), ("Your text goes here", "instruction"), ("Hier Text einfügen", "instruction"), ("TODO: add description", "instruction"), ("Su lema aquí", "instruction"), ("[Введите заголовок]", "instruction"),
        ("Page not found", "error"), ("503 – Sorry, the server is broken or out of date. Status 504.", "error"), ("Die Datenbank antwortet nicht.", "error"), ("Hélas, cet article reste introuvable. Statut 404.", "error"), ("Lo sentimos, la base de datos no responde.", "error"), ("Страница не найдена", "error"),
        ("Please enable JavaScript to view this page.", "notice"), ("To see the map, please allow scripts.", "notice"), ("Приложению нужны скрипты, но браузер их не выполняет.", "notice"),
        ("Room 404 was not found on the first floor plan, which amused the surveyors.", None), ("The fault code 503 was painted on the boiler, above the service door.", None), ("A course on JavaScript and other scripts fills the upper room on Fridays.", None),
        ("Access to the tower was denied to nobody who asked.", None), ("The sign said NOT FOR SALE {but the price was on the back}.", None), ("Some 40% of the roofs and 60% of the barns were lost.", None), (r"\frac{a}{b} x^{2}", None), ("clossed [sic] on Mondays", None), ("[[Target|label]]", None),
        ("", None), (" ", None), ("x" * 50_000, None), ("not found " * 9000, None),
    ],
)
def test_kinds_of_residue(text, kind):
    assert residue.kind_of(text) == kind


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Для работы сайта включите выполнение скриптов.", "notice"), ("Włącz obsługę skryptami.", "notice"), ("Bitte Skripten zulassen", "notice"),
        ("[Escribe una descripción]", "instruction"), ("[Sostituisci il titolo]", "instruction"), ("[Remplacez le titre]", "instruction"), ("[Reemplace el nombre]", "instruction"), ("[Substitua o nome]", "instruction"),
        ("[Aggiungere un sottotitolo]", "instruction"), ("[Dodać opis strony]", "instruction"), ("[Добавить заголовок]", "instruction"), ("[Замените заголовок]", "instruction"), ("Texte d'exemple", "filler"), ("404", "error"),
    ],
)
def test_every_form_of_a_pattern_counts(text, kind):
    assert residue.kind_of(text) == kind


def test_expansions_of_the_patterns_count():
    """Each word that the groups of verbs, subjects and verdicts can stand for, in a text of its own."""
    from itertools import product

    from re import _parser as parser

    def forms(tree):
        parts = []
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                parts.append([chr(arg)])
            elif name == "BRANCH":
                parts.append([f for x in arg[1] for f in forms(x)])
            elif name == "SUBPATTERN":
                parts.append(forms(arg[3]))
            elif name == "IN":
                parts.append(["1" if str(arg[0][0]) == "CATEGORY" and "DIGIT" in str(arg[0][1]) else " " if str(arg[0][0]) == "CATEGORY" and "SPACE" in str(arg[0][1]) else "x"] if str(arg[0][0]) == "CATEGORY" else [chr(v) for o, v in arg if str(o) == "LITERAL"])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, sub = arg
                parts.append(sorted({"" if n == 0 else f * n for n in {low, 1} if n <= high for f in forms(sub)}))
            elif name != "AT":
                raise AssertionError(name)
        return ["".join(p) for p in product(*parts)]

    verbs = forms(parser.parse(residue._VERB))
    assert len(verbs) > 50
    assert [v for v in verbs if residue.kind_of(f"[{v} abc def]") != "instruction"] == []
    subject = {"en": "the page", "de": "die Seite", "fr": "la page", "es": "la página", "pt": "a página", "it": "la pagina", "pl": "strona", "ru": "страница"}
    for k, s in subject.items():
        assert [v for v in forms(parser.parse(residue._VERDICT[k])) if residue.kind_of(f"{s} {v}.") != "error"] == []
        assert [x for x in forms(parser.parse(residue._SUBJECT[k].replace(r"(?:\w+\s){0,2}?", ""))) if residue.kind_of(f"{x} {forms(parser.parse(residue._VERDICT[k]))[0]}.") != "error"] == []


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("In Jinja you write {{ user.name }} inside the template to print the name of the user.", None), ("Use ${HOME} to refer to your home directory in bash.", None), ("The placeholder %USERNAME% is replaced by the shell when the script runs.", None),
        ("Write {{ user.name }} where the name should go", None), ("The tag {% block x %} opens a block", None), ("Im Template schreibt man {{ titel }} für den Titel der Seite.", None),
        ("The mill of {{ town }} was built in {{ year }} by the town council.", "placeholder"), ("[SUMMARY] – The quiet pier replaced the keeper’s notebook of the harbour.", "placeholder"),
        # wordings the grammar doesn't list
        ("We're sorry, the resource cannot be located on our system", "error"), ("Your session has timed out, please log in", "error"), ("Die Anfrage wurde abgelehnt: Zugriff verweigert, bitte später erneut versuchen", "error"), ("The server of the inn was found asleep in the garden", None),
        # beyond the lengths that were looked at before
        ("Please enable JavaScript to view this page. " * 12, "notice"), ("JavaScript is disabled in your browser. You can turn it on in the settings. Then reload the page. Without scripts the site does not work. Please allow it to run. Contact support, please.", "notice"),
        ("Lorem ipsum dolor sit amet " * 400, "filler"), ("Chapter One: some words before it all. " + "lorem ipsum dolor sit amet " * 60, "filler"), ("Page not found. " + "Please try again later. " * 30, "error"), ("[Insert the subtitle of this page here] " * 6, "instruction"),
    ],
)
def test_context_density_and_length(text, kind):
    assert residue.kind_of(text) == kind


def test_surroundings_speak_for_a_placeholder(node_table, lang_samples, contents):
    nodes = node_table([
        (1, "<h1>Templates</h1><p>The variable {{ name }} of the user comes first in the list.</p><pre>{{ name }}</pre><p>More on syntax below, where a template is loaded.</p>"),
        (2, "<h1>Mills</h1><p>The variable {{ name }} of the user comes first in the list.</p><p>Built by hand.</p>"),
    ])
    assert contents(residue.residue_nodes(nodes, lang_samples), nodes) == [(2, "The variable {{ name }} of the user comes first in the list.")]


def test_lines_of_a_long_error_page(node_table, lang_samples):
    lines = "".join(f"<p>The requested page could not be found, attempt {i}</p>" for i in range(9))
    article = "".join(f"<p>The mill number {i} stands by the river and grinds.</p>" for i in range(9))
    nodes = node_table([(1, f"<h1>Page not found</h1>{lines}"), (2, f"<h1>Page not found</h1>{article}")])
    got = [r["page_id"] for r in residue.residue_nodes(nodes, lang_samples).collect()]
    assert got.count(1) == 10 and got.count(2) == 1


def test_residue(node_table, lang_samples, no_nodes, contents, spark):
    nodes = node_table([
        (1, "<title>Page not found</title><h1>404</h1><p>The server is no longer here. Status 410.</p><small>Request id 5430f0f2-fcfb, node 32</small><nav><a>Home</a></nav>"),
        (2, "<p>Good text of the page.</p><code>{{ x }}</code><pre>Page not found</pre><td>507</td><script>var a='{{x}}'</script><p>${a}</p>"),
        (3, "<body><noscript>Scripts, please</noscript>"),
        (4, "<p>Hier Text einfÃ¼gen</p>"),
    ])
    found = residue.residue_nodes(nodes.union(nodes), lang_samples)
    assert contents(found, nodes) == [
        (1, "404"), (1, "Page not found"), (1, "Request id 5430f0f2-fcfb, node 32"), (1, "The server is no longer here. Status 410."), (2, "${a}"), (3, "Scripts, please"), (4, "Hier Text einfÃ¼gen"),
    ]
    left = {r["page_id"]: r["text"] for r in residue.residue_free_pages(nodes, lang_samples).collect()}
    assert set(left) == {1, 2} and left[1] == "Home" and left[2].startswith("Good text")
    assert residue.residue_nodes(no_nodes, lang_samples).count() == 0
    odd = spark.createDataFrame([(None, 1, 0, 1, 1, 0, "text", None, None, "404", None, "", None, ""), (5, None, 0, 1, 1, 0, "text", None, None, "{{x}}", None, "", None, ""), (5, 2, None, 2, 1, 0, "text", None, None, None, None, "", None, ""), (5, 3, None, 3, 1, 0, "element", None, None, None, None, "", None, ""), (5, 4, 99, 4, 1, 0, "text", None, None, "{{x}}", None, "", None, "")], no_nodes.schema)
    assert [tuple(r)[:2] for r in residue.residue_nodes(odd, lang_samples).collect()] == [(5, 4)]


def test_copies_collapse_before_the_shuffle(node_table, lang_samples):
    from leafspan.llm.pages import page_chunks

    one = node_table([(1, "<p>{{x}}</p><p>text</p>"), (2, "<p>other</p>")])
    many = one.where("page_id = 1").crossJoin(one.sparkSession.range(400)).drop("id").coalesce(2).union(one)
    assert page_chunks(many).where("page_id = 1").count() <= 8
    assert residue.residue_nodes(many, lang_samples).count() == 1


# ------------------------------------------------------------------ problem 2
@pytest.fixture(scope="module")
def late_samples(spark, lang_samples):
    """The samples behind 20,000 others that say nothing of letters outside ASCII."""
    first = spark.range(20_000).select(F.col("id").cast("int").alias("sample_id"), F.lit("en").alias("lang"), F.lit("x").alias("text"))
    return first.union(lang_samples.withColumn("sample_id", F.col("sample_id") + 30_000))


def test_residue_knows_all_samples(node_table, late_samples, lang_samples, contents):
    bad = "Die Seite ist nicht mehr verfügbar".encode().decode("cp1252")
    nodes = node_table([(1, f"<p>{bad}</p>")])
    assert contents(residue.residue_nodes(nodes, late_samples), nodes) == [(1, bad)]
    all_, some = encoding.sample_counts(late_samples), encoding.sample_counts(lang_samples)
    assert all_.words == some.words and all_.tri == some.tri + encoding.SampleCounts(["x"] * 20_000).tri


def test_suffix_array_against_sorting():
    r = np.random.default_rng(1)
    for _ in range(20):
        s = r.integers(0, 4, r.integers(1, 60))
        sa, ranks = boilerplate.suffix_array(s)
        tails = [tuple(s[i:]) for i in sa]
        assert tails == sorted(tails)
        lcp = boilerplate.lcp_array(sa, ranks)
        for a, b, n in zip(tails, tails[1:], lcp[1:], strict=False):
            assert n == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert list(boilerplate.repeated([[1, 2, 3], [9, 1, 2, 3], [1, 2, 4]], 3, 2)) == [True, False, False, False, False, True, False, False, False] + [False] * 4


def site(i, extra=""):
    words = ["harbour", "bridge", "mill", "garden", "tower", "quarry", "chapel", "stable", "meadow", "cellar"]
    text = f"The {words[i % 10]} number {i} borders the {words[(i * 7 + 3) % 10]} of year {1700 + i}."
    return f'<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Shop</a></li></ul></nav><main><h1>Title {i}</h1><p>{text}</p>{extra}<table><tr><td>the {words[i % 10]}</td><td>{i * 37}</td></tr></table></main><div class="foot"><p>Line {i} of the day</p><p>Terms of use</p><p>Privacy policy</p><p>Imprint</p></div>'


def test_boilerplate(spark, node_table, lang_samples, no_nodes, contents):
    pages = [(i, site(i)) for i in range(30)] + [(100, "<p>Page not found</p>")]
    nodes = node_table(pages)
    urls = spark.createDataFrame([(i, "https://www.site.example/x", None) for i, _ in pages] + [(500, "https://y.example", None), (0, "https://www.site.example/x", None)], "page_id bigint, url string, html string")
    rows = boilerplate.boilerplate_nodes(nodes.union(nodes), urls, lang_samples)
    for i, text in contents(rows, nodes):
        assert text in ("Home", "News", "Shop", "Terms of use", "Privacy policy", "Imprint", f"Line {i} of the day"), text
    assert rows.count() == rows.distinct().count() == 30 * 7
    main = {r["page_id"]: r["text"] for r in boilerplate.main_bodies(nodes, urls, lang_samples).collect()}
    assert main[7].splitlines()[0] == "Title 7" and len(main[7].splitlines()) == 4 and 100 not in main
    assert boilerplate.boilerplate_nodes(no_nodes, urls.limit(0), lang_samples).count() == 0
    assert boilerplate.boilerplate_nodes(nodes, urls.limit(0), lang_samples).count() == 30 * 7  # by endpoint


def test_what_is_rare_in_blocks_is_merged_over_the_host(spark, node_table, lang_samples, contents, monkeypatch):
    monkeypatch.setattr(boilerplate, "BLOCK_PAGES", 4)
    box = '<aside><p>Sign up for the letter</p><p>Every week</p><p>No spam at all</p></aside>'
    pages = [(i, site(i, box if i % 12 == 0 else "")) for i in range(48)]  # on 4 pages of 48, in blocks of some 4
    nodes = node_table(pages)
    urls = spark.createDataFrame([(i, "https://www.site.example/x") for i, _ in pages], "page_id bigint, url string")
    found = [t for _, t in contents(boilerplate.boilerplate_nodes(nodes, urls, lang_samples), nodes)]
    assert [found.count(t) for t in ("Sign up for the letter", "Every week", "No spam at all", "Home", "Imprint")] == [4, 4, 4, 48, 48]


@pytest.mark.parametrize(("block", "broadcast"), [(4, 100_000), (7, 0), (1000, 0)])
def test_blocks_and_joins_decide_nothing(spark, node_table, lang_samples, monkeypatch, block, broadcast):
    pages = [(i, site(i)) for i in range(40)]
    nodes = node_table(pages).cache()
    host = lambda i: "https://big.example/x" if i < 26 else None if i < 30 else f"https://h{i // 2}.example/"
    urls = spark.createDataFrame([(i, host(i)) for i, _ in pages], "page_id bigint, url string")
    nodes = nodes.drop("endpoint_id").withColumn("endpoint_id", F.lit(None).cast("string"))
    expected = sorted(map(tuple, boilerplate.boilerplate_nodes(nodes, urls, lang_samples).collect()))
    monkeypatch.setattr(boilerplate, "BLOCK_PAGES", block)
    monkeypatch.setattr(boilerplate, "MAX_BROADCAST_SITES", broadcast)
    assert sorted(map(tuple, boilerplate.boilerplate_nodes(nodes, urls, lang_samples).collect())) == expected and len(expected) == 40 * 7


def test_runs_are_the_maximal_repeats():
    """Against all substrings: what runs of seeds cover is what maximal repeats cover."""
    r = np.random.default_rng(4)
    for _ in range(30):
        pages = [r.integers(0, 4, r.integers(1, 30)).tolist() for _ in range(6)]
        seed = boilerplate.repeated(pages, 4, 3)
        at = 0
        for page in pages:
            got = {i for a, b in boilerplate.maximal_runs(np.flatnonzero(seed[at : at + len(page)]), 4) for i in range(a, b)}
            every = set()
            for a in range(len(page)):
                for b in range(a + 4, len(page) + 1):
                    on = sum(any(q[j : j + b - a] == page[a:b] for j in range(len(q) - (b - a) + 1)) for q in pages)
                    every |= set(range(a, b)) if on >= 3 else set()
            assert got == every
            at += len(page) + 1


@pytest.mark.parametrize("size", [11, 12, 39, 40])
def test_support_is_the_same_on_hosts_of_every_size(size):
    page = lambda k, extra: ("s", [-1] * 4, [100 * k + j for j in range(4)] if not extra else [1, 2, 3, 4], [0] * 4, [0, 3, 0, 3])
    for on in (2, 3):
        prints, n = boilerplate.proposed_runs([page(k + 1, k < on) for k in range(size)], boilerplate.LEAST)
        assert n.tolist() == ([3] if on == 3 else [])


def test_sums_of_a_block_node_by_node():
    """Sums and verdicts for all nodes of a block at once, against one node after the other."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        pages = []
        for _ in range(int(rng.integers(1, 9))):
            n = int(rng.integers(0, 30))
            par = [int(rng.integers(-1, i)) if i else -1 for i in range(n)]
            kind = [int(k) for k in rng.choice([0, 0, 1, 2, 3, 3, 3, 4], n)]
            par = [p if p < 0 or kind[p] < 3 else -1 for p in par]
            pages.append(("s", par, [int(x) for x in rng.integers(1, 4, n)], [int(x) for x in rng.integers(1, 6, n)], kind))
        frequent = boilerplate.proposed_runs(pages, 2)[0]
        block, sums, seen = boilerplate.Block(pages, frequent), {}, []
        for k, (_, par, tok, path, kind) in enumerate(pages):
            n = len(tok)
            starts = np.flatnonzero(np.isin(boilerplate.run_prints(tok, 4), frequent) & boilerplate._telling(kind))
            link = np.isin(boilerplate.run_prints(tok, 1), frequent)
            cov = {i for a, b in boilerplate.maximal_runs(starts, 4) for i in range(a, b)} | {i for i in range(n) if kind[i] >= 3 and par[i] >= 0 and kind[par[i]] == 1 and link[par[i]]}
            texts, hits, head = [0] * n, [0] * n, [False] * n
            for i in reversed(range(n)):
                if kind[i] == 3:
                    texts[i], hits[i] = 1, int(i in cov)
                head[i] |= kind[i] == 2
                if par[i] >= 0:
                    texts[par[i]] += texts[i]
                    hits[par[i]] += hits[i]
                    head[par[i]] |= head[i]
            for i in range(n):
                if kind[i] < 3 and texts[i]:
                    s = sums.setdefault(path[i], [0, 0, set(), 0])
                    s[0] += texts[i]
                    s[1] += hits[i]
                    s[2].add(k)
                    s[3] += head[i]
            seen.append((texts, hits, head))
        assert {r[0]: r[1:] for r in block.sums.tolist()} == {p: [a, b, len(c), d] for p, (a, b, c, d) in sums.items()}
        for given in (None, block.sums[::-1]):
            other = boilerplate.Block(pages, frequent, given)
            for k, ((_, par, _, path, kind), (texts, hits, head)) in enumerate(zip(pages, seen, strict=True)):
                out = []
                for i, p in enumerate(par):
                    gone = p >= 0 and out[p]
                    if not gone and kind[i] < 3 and texts[i] and not head[i]:
                        n, c, on, heads = sums[path[i]][0], sums[path[i]][1], len(sums[path[i]][2]), sums[path[i]][3]
                        own, there = hits[i] / texts[i], c / n
                        wide = on >= 3 and there >= 0.55
                        gone = heads * 2 <= on and ((own >= 0.6 and there >= boilerplate.THERE) or wide or (own >= 0.3 and there >= 0.45)) and (texts[i] > 1 or kind[i] == 1 or wide)
                    out.append(bool(gone))
                assert other.removed(k) == out


def test_sites():
    assert boilerplate.site_of("HTTPS://u@WWW.A.example:80/x?y", None) == "www.a.example"
    assert boilerplate.site_of(None, "b.example") == "b.example" and boilerplate.site_of(None, "pool-1") == "" and boilerplate.site_of(None, None) == ""


# ------------------------------------------------------------------ problem 3
def test_language_model():
    m = language.LanguageModel(SAMPLES)
    texts = ["Die grüne Brücke schützt das alte Rathaus", "the river and the road of the town", "", "1234 !!", "La forêt protège une école du village"]
    best = [m.langs[x[0].index(max(x[0]))] if x[2] else None for x in m.label(texts)]
    assert best == ["de", "en", None, None, "fr"]
    mixed = "The town council was rebuilt before the road. Die alte Brücke überragt das Rathaus seit hundert Jahren."
    assert [s[2] for s in m.spans(mixed)] == ["en", "de"] and m.spans(mixed)[1][0] == mixed.index("Die")
    one = m.label([mixed])[0]
    spans = {}
    for a, b, k in m.spans(mixed):
        spans[k] = spans.get(k, 0) + sum(c.isalpha() for c in mixed[a:b])
    assert {k: n for k, n in zip([*m.langs, "und"], one[0], strict=True) if n} == spans  # both searches agree
    assert [language.primary_subtag(x) for x in (" EN_us ", "de-AT", None, "")] == ["en", "de", "", ""]


def test_languages(spark, node_table, lang_samples, no_nodes):
    de = "Die alte Brücke überragt das Rathaus seit fast hundert Jahren und die Bücherei."
    en = "The old harbour was rebuilt by the town council before the road was built."
    nodes = node_table([(1, f"<html lang='EN_gb '><p>{en}<p>{de}<p>{en} It belongs to the school.<p>{en}"), (2, f"<p>{de}"), (3, "<html lang=fr><p>{{x}}"), (4, f"<html lang=en><p>{en}<code>{de}</code>"), (5, "<p>12345</p>"), (6, "<html lang=de><p>" + en.replace("old", "oldâ€™s"))])
    none = spark.createDataFrame([], "page_id bigint, url string")
    rows = language.language_labels(nodes, none, lang_samples).collect()
    got = {(r["page_id"], r["lang"], r["kind"]) for r in rows if r["kind"] in ("page", "text", "right")}
    assert got == {(1, "en", "right"), (1, "de", "text"), (2, "de", "page"), (4, "en", "right"), (6, "en", "page")}
    assert all(0 <= r["confidence"] <= 1 for r in rows)
    assert language.language_labels(no_nodes, none, lang_samples).count() == 0
    t = spark.createDataFrame([(1, de), (2, None), (3, "")], "doc_id bigint, text string")
    got = [tuple(r) for r in language.text_spans(t, lang_samples).collect()]
    assert [r[:4] for r in got] == [(1, 0, len(de) - 1, "de")] and 0.5 < got[0][4] <= 1
    mixed = node_table([(1, f"<html lang=en><p>{en} {de}<p>{en}<p>これは日本語の文章です"), (2, "<p>Η γέφυρα είναι παλιά και όμορφη στην πόλη")])
    rows = [tuple(r) for r in language.language_segments(mixed, none, lang_samples).orderBy("page_id", "node_id", "start_char").collect()]
    assert [(r[0], r[4]) for r in rows] == [(1, "en"), (1, "de"), (1, "en"), (1, "und"), (2, "und")]
    assert rows[0][2] == 0 and rows[1][2] == len(en) + 1 and rows[1][3] == len(en) + len(de) and all(0 < r[5] <= 1 for r in rows)
    kinds = {(r["page_id"], r["lang"], r["kind"]) for r in language.language_labels(mixed, none, lang_samples).collect()}
    assert (2, "und", "unknown") in kinds and (1, "en", "right") in kinds and not any(k == "page" for _, _, k in kinds)


def test_unknown_scripts_and_many_languages():
    m = language.LanguageModel([(f"l{i:03}", "".join(chr(97 + (i * k) % 26) for k in range(1, 6)) + " alpha beta") for i in range(140)])
    assert len(m.langs) == 140 and m.segments("αβγ")[0][2] == "und" and m.label(["שלום עולם"])[0][0][-1] == 8
    assert [language._script(w) for w in ("über", "мост", "γη", "日本", "かな", "한글", "سلام", "שלום")] == ["latin", "cyrillic", "greek", "han", "kana", "hangul", "arabic", "hebrew"]
    word = m.segments("".join(chr(97 + (139 * k) % 26) for k in range(1, 6)))[0]
    assert word[2].startswith("l")


# ------------------------------------------------------------------ problem 4
@pytest.mark.parametrize(("right", "wrong"), [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("utf-8", "latin-1"), ("cp1252", "mac_roman"), ("cp850", "cp1252"), ("cp1252", "cp437")])
def test_undo(right, wrong):
    words = {}
    for t in TEXTS:
        for w in encoding._FOREIGN_WORD.findall(t):
            words[w] = words.get(w, 0) + 9
    fixer = encoding.Repairer(TEXTS, words)
    for text in ("Die Brücke überragt das Gewächshaus", "Le théâtre protège la forêt"):
        bad = text.encode(right).decode(wrong, "replace")
        if "�" in bad:
            continue
        assert fixer.repair(bad)[0] == text
    assert all(fixer.repair(t) is None for t in TEXTS)


def test_lost_and_double(spark):
    words = {"Brücke": 9, "überragt": 9, "früher": 5, "été": 4}
    fixer = encoding.Repairer(TEXTS, words)
    assert fixer.repair("Die Br�cke �berragt") == ("Die Brücke überragt", "lost")
    assert fixer.repair("d�xyz�")[1] == "lost"
    twice = "Die Brücke überragt".encode().decode("cp1252").encode().decode("cp1252")
    assert fixer.repair(twice)[0] == "Die Brücke überragt"
    assert fixer.repair("plain") is None and fixer.repair("CAFÉ DÉJÀ VU") is None and fixer.repair("© 2020 X – y") is None
    assert fixer.repair("it\x92s")[0] == "it’s"


@pytest.mark.parametrize(
    ("bad", "good"),
    [
        ("caf? ist sch?n", "café ist schön"), ("caf� und grÃ¶ÃŸer", "café und größer"), ("â€œschÃ¶n grÃ¶ÃŸerâ€�", "“schön größer”"), ("Die Br?cke ?berragt das Tal. Warum? Weil sie alt ist.", "Die Brücke überragt das Tal. Warum? Weil sie alt ist."),
        ("你好世界，我们是朋友".encode("gb2312").decode("latin-1"), "你好世界，我们是朋友"), ("こんにちは世界".encode("shift_jis").decode("latin-1"), "こんにちは世界"), ("日本語の文章です".encode("euc_jp").decode("latin-1"), "日本語の文章です"),
        ("What? no way", None), ("See a.example/x?b=1 or a?b=c", None), ("ÄÖÜ äöü ß", None), ("Wer?wie", None),
    ],
)
def test_byte_lattice(bad, good):
    words = {w: 9 for t in TEXTS for w in encoding._FOREIGN_WORD.findall(t)} | {"café": 9, "schön": 9, "größer": 5, "Brücke": 9, "überragt": 9, "“": 9, "”": 9}
    got = encoding.Repairer(TEXTS, words).repair(bad)
    assert (got and got[0]) == good


def test_lattice_against_all_byte_sequences():
    """The best path is the best of all readings, written out."""
    words = {"größer": 9, "schön": 9, "über": 4}
    fixer = encoding.Repairer(TEXTS, words)
    i = encoding.Repairer.BY_NAME["utf-8>cp1252"]
    for chunk in ("gr\ufffd¶ÃŸer", "grÃ\ufffdÃŸer", "sch\ufffd\ufffdn"):
        readings = [(b"", 0)]
        for c in chunk:
            bytes_ = [(c.encode("cp1252"), 0)] if c != encoding.LOST else [(bytes([b]), b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)) for b in range(128, 256)]
            readings = [(r + b, n + k) for r, n in readings for b, k in bytes_]
        best = {}
        for r, defined in readings:
            t = r.decode(errors="replace")
            if encoding.LOST not in t and all(c < "\x80" or c in fixer.alphabet for c in t):
                best[t] = fixer.score(t) - encoding.DEFINED_BYTE * defined
        assert fixer.lattice(chunk, i)[1] == max(best, key=best.get)


def test_endpoints_say_how_likely_damage_is(node_table):
    from pyspark.sql import functions as F

    nodes = node_table([(i, "<p>grÃ¶ÃŸer</p>" if i % 2 else "<p>größer</p>") for i in range(60)]).withColumn("endpoint_id", F.when(F.col("page_id") % 2 == 1, "bad").otherwise("good"))
    shifts = encoding.endpoint_shifts(nodes)
    part = {r["endpoint_id"]: r["part"] for r in nodes.select("endpoint_id", F.pmod(F.xxhash64("endpoint_id"), F.lit(encoding.ENDPOINT_PARTS)).cast("int").alias("part")).distinct().collect()}
    assert shifts[part["bad"]] > 0.2 > 0 > shifts[part["good"]] and len(shifts) == encoding.ENDPOINT_PARTS


def test_damaged_nodes(spark, node_table, lang_samples, no_nodes, contents):
    good = "Die alte Brücke überragt das Gewächshaus"
    bad = good.encode().decode("cp1252")
    nodes = node_table([(1, f"<p>{good}<p>{bad}<script>var a='{bad}'</script>"), (2, "<p>plain"), (3, f"<title>{bad}</title>")])
    rows = encoding.damaged_nodes(nodes.union(nodes), lang_samples)
    assert contents(rows, nodes) == [(1, bad), (3, bad)] and {r["restored"] for r in rows.collect()} == {good}
    assert encoding.damaged_nodes(no_nodes, lang_samples).count() == 0


def test_channels_that_cannot_win_are_left_early():
    for chunk in ("größer", "grÃ¶ÃŸer", "für", "Ð¼Ð¸Ñ€"):
        fixer, full = encoding.Repairer(TEXTS), encoding.Repairer(TEXTS)
        base, every = full.score(chunk), {}
        for i, c in enumerate(full.CHANNELS):
            if (t := encoding.undo(chunk, *c)) is not None:
                every[i] = (full.score(t), t)
        assert fixer._chunk(chunk) == {i: x for i, x in every.items() if x[0] > base} != every


def test_channels_below_the_bar_are_left_early():
    texts = ["Der größte Müller zählt die schönen Bücher für jährlich fünf Gäste", "Le thÃ©Ã¢tre de la forÃªt protÃ¨ge l’Ã©cole", "Żółw śpi über größeren Gärten, während Ærø fährt", "Ð¼Ð¸Ñ€ größer"]
    tried = {}
    for bar in (-np.inf, encoding.PRIOR):
        fixer = encoding.Repairer(TEXTS)
        for t in texts:
            every = encoding.Repairer(TEXTS).gains(t)
            got = fixer.gains(t, bar=bar)
            assert {i: g for i, g in got.items() if g >= bar} == pytest.approx({i: g for i, g in every.items() if g >= bar})
            for i in (0, 3, 40):
                full, left = encoding.Repairer(TEXTS).gains(t, i)[i], fixer.gains(t, i, bar)
                assert left.get(i, -np.inf) == pytest.approx(full) if full >= bar else left.get(i, -np.inf) < bar
        tried[bar] = fixer.n_ones
    assert 3 * tried[encoding.PRIOR] < 2 * tried[-np.inf]


def test_a_finder_is_kept_for_the_next_task(monkeypatch):
    samples = encoding.SampleCounts(TEXTS)
    finder = residue.kept_finder(samples)
    assert residue.kept_finder(samples) is finder and residue.kept_finder(encoding.SampleCounts(TEXTS)) is not finder
    monkeypatch.setattr(residue, "KEEP", 0)
    assert residue.kept_finder(samples) is not residue.kept_finder(samples)


def test_encodings_know_all_samples(node_table, late_samples, contents):
    bad = "grün".encode().decode("cp1252")
    nodes = node_table([(1, f"<p>{bad}</p>")])
    rows = encoding.damaged_nodes(nodes, late_samples)
    assert contents(rows, nodes) == [(1, bad)] and [r["restored"] for r in rows.collect()] == ["grün"]


# ------------------------------------------------------------------ problem 5
def pages_of(first, n):
    """Pages of headings, paragraphs, lists and a menu, as chunks have them."""
    import random

    r, out = random.Random(first), []
    for k in range(first, first + n):
        html = "".join(f"<li><a href=/{j}>menu {j}</a></li>" for j in range(5))
        body = "".join(r.choice(["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li><li>{}</li></ul>", "<div class='box wide'><p>{}</p></div>"]).replace("{}", r.choice(TEXTS)) for _ in range(8))
        rows = parse_nodes(f"<nav class=menu><ul>{html}</ul></nav><main><h1>Title {k}</h1>{body}</main>")
        kept = [x for x in rows if x[5] in ("element", "text")]
        out.append(([x[0] for x in kept], [-1 if x[1] is None else x[1] for x in kept], [x[7] if x[5] == "element" else None for x in kept], [markup.SEP.join(f"{a}={b}" for a, b in x[8]) if x[5] == "element" else x[9] for x in kept]))
    return out


@pytest.fixture(scope="module")
def trees():
    return markup.train(TEXTS, pages_of(0, 30), rows=3000)


def test_held_out_accuracy_needs_the_dom(trees):
    x, y = markup.training_rows(["A sentence the trees have never seen stands here. Noch ein Satz, der neu ist, steht da. Une phrase nouvelle se trouve ici."], pages_of(1000, 20), 800, seed=5)
    right = lambda rows: sum(p.index(max(p)) == k for p, k in zip(map(trees.log_probs, rows), y, strict=True)) / len(y)
    with_dom = right(x)
    n = len(x[0]) - markup.N_DOM
    assert with_dom > 0.95
    assert right([f[:n] + [0] * markup.N_DOM for f in x]) < with_dom - 0.005
    assert any(node[0] >= n for layer in trees.trees for tree in layer for node in tree)


def test_training_has_every_sentence(monkeypatch):
    seen, features = [], markup.text_features
    monkeypatch.setattr(markup, "_write_in", lambda kind, text, r: text)
    monkeypatch.setattr(markup, "_leave_clean", lambda text, r: text)
    monkeypatch.setattr(markup, "text_features", lambda text: seen.append(text) or features(text))
    texts = [f"Sentence number n{i} stands here." for i in range(400)]
    x, y = markup.training_rows(texts, pages_of(0, 3), 100)
    assert len(x) == len(y) >= 400 and not [t for t in texts if not any(t in s for s in seen)]


def test_training_uses_all_samples(late_samples, monkeypatch):
    at = len(markup._FEATURES)  # the length of the text
    assert markup.training_table(late_samples)[0][:, at].max() > max(f[at] for f in markup.training_rows(["x"], [])[0])
    one = markup.training_table(late_samples.where("sample_id >= 30000"))
    x, y = markup.training_rows([*TEXTS, "x"], [])
    assert (one[0] == np.minimum(x, markup.BINS - 1)).all() and (one[1] == y).all()
    monkeypatch.setattr(markup, "TRAIN_TEXTS", 2)
    assert len(markup.training_table(late_samples)[1]) >= 2 * markup.TRAIN_ROWS
    assert len(markup.training_table(late_samples.limit(0))[1]) >= markup.TRAIN_ROWS


def test_ancestor_and_descendant_never_differ():
    page = markup.Page.of(list(range(8)), [-1, 0, 1, 2, 2, 4, 1, 6], ["html", "body", "td", None, "p", None, "p", None], ["", "", "", "a", "", "b", "", "c"])
    none, low = 0.0, -9.0
    scores = {3: [none, low, low, 4.0, low], 5: [none, low, 1.0, 0.6, low], 7: [none, low, 3.0, low, low]}
    # the cell is wiki, so the paragraph in it can't be markdown; the one beside it can
    assert markup.decode(page, scores) == {3: 3, 5: 3, 7: 2}
    scores[5] = [none, low, 9.0, low, low]
    assert markup.decode(page, scores) == {5: 2, 7: 2}  # or the cell takes up none
    scores[3] = [none, low, low, low, low]
    assert markup.decode(page, {i: [0.0, -1.0, 0.1, -1.0, -1.0] for i in (3, 5)}, cost=0.15) == {3: 2, 5: 2}  # together they are worth the cost
    assert markup.decode(page, {3: [0.0, -1.0, 0.1, -1.0, -1.0]}, cost=0.15) == {}


@pytest.mark.parametrize(("text", "kind"), [("Growth was 50% of the total.\nCosts {net} & gross", "none"), ("\\section{A} text \\cite{b}\n\nMore $x^2$ text of \\emph{it}", "latex"), ("# T\n\n**bold** and [a](/b)\n\n* a\n* b", "markdown"), ("", "none")])
def test_kind_of_a_document(trees, text, kind):
    assert markup.document_kind(text, trees) == kind


def test_markup(node_table, lang_samples, no_nodes, contents):
    nodes = node_table([
        (1, "<p>A &lt;b&gt;bold&lt;/b&gt; word here<p>**bold** and [link](/x)<p>== Head ==\nText of it<p>\\emph{x} and \\cite{y}<p>Entry costs $5 for one and $12 for two.<code>**x**</code><p>{{ name }} &lt;b&gt;x&lt;/b&gt;"),
        (2, "<p>[[A|the mill]] stands<p>&amp;nbsp;x"),
    ])
    rows = markup.markup_nodes(nodes.union(nodes), lang_samples).collect()
    got = {(r["page_id"], r["markup"], r["text"]) for r in rows}
    assert {(1, "html", "A bold word here"), (1, "markdown", "bold and link"), (1, "wiki", "## Head\nText of it"), (2, "wiki", "the mill stands")} <= got
    assert {k for _, k, _ in got} == {"html", "markdown", "wiki", "latex"} and len(rows) == 6
    assert markup.markup_nodes(no_nodes, lang_samples).count() == 0


@pytest.mark.parametrize(
    ("kind", "text", "clean"),
    [
        ("html", "<h2>T</h2><ul><li>a</li><li>b</li></ul><pre>x&lt;1</pre>", "## T\n\n- a\n- b\n\n```\nx<1\n```"),
        ("markdown", "# T\n\n* a\n* b\n\n```\n**x**\n```\n> **q**", "# T\n\n- a\n- b\n\n```\n**x**\n```\nq"),
        ("wiki", "== T ==\n* [[A|a]]\n* ''b''<ref>r</ref>", "## T\n- a\n- b"),
        ("latex", "\\section{T} Text~\\cite{a} % c\n\\begin{itemize}\\item $x^2$\\item \\emph{b}\\end{itemize}\\begin{verbatim}\n% k\n\\end{verbatim}", "## T\nText [a] \n\n- $x^2$\n- b\n\n```\n% k\n```"),
        ("latex", "", ""),
        ("latex", "\\begin{verbatim} never ends {{{", "```\n never ends {{{\n```"),
    ],
)
def test_strip(kind, text, clean):
    assert [x.rstrip() for x in markup.strip_markup(text, kind).splitlines() if x.strip()] == [x.rstrip() for x in clean.splitlines() if x.strip()]


def test_clean_documents(spark, lang_samples):
    plain = "Growth was 50% of the total.\nCosts {net} & gross"
    long = "$" + "a+" * 900 + "\\text{b}$"
    tex = "\\title{A}\\begin{document}\\section{S} b \\emph{x \\textbf{y \\textit{z \\textsf{u \\textsc{v}}}}} and $x^2$ \\cite{k}\\end{document}c"
    docs = spark.createDataFrame([(1, tex, 1), (2, None, 1), (3, "", 1), (4, "{" * 20_000, 1), (5, "$" * 9_999, 1), (6, plain, 1), (7, "\\section{T} " + long, 1)], "doc_id bigint, text string, t int")
    got = {r["doc_id"]: r["text"] for r in markup.clean_documents(docs, lang_samples).collect()}
    assert got[1] == "# A\n\n## S\nb x y z u v and $x^2$ [k]" and got[2] is None and got[3] == "" and got[6] == plain
    assert long[1:-1] in got[7]
