"""Problem 5: markup residue in text.

Method: gradient-boosted trees over features of a text node (markup constructs by
grammar) and of the DOM around it (depth, parent, attribute tokens, density of text,
elements and links in the block, and what its siblings hold), then hierarchical
decoding. The trees are trained on the driver on texts made of all labelled samples, in
the DOM of a bounded sample of real pages of the table: markup of each kind is written into text nodes where they stand, alone or
together with their siblings, and into others what only resembles it (prices, paths,
formulas in words, brackets). Decoding is a dynamic programme over the DOM: a block
takes up one kind at a cost, for all that is below it, so that no ancestor and
descendant contradict each other; nothing below a code sample has any.

``strip_markup`` then turns a text of a known kind into clean text that keeps
headings (``#``), lists (``-``), code (fences) and formulas (``$``) visible.
"""

from __future__ import annotations

import html
import marshal
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

from .encoding import sample_counts
from .pages import SEP, Page, _merge, map_pages, page_chunks
from .residue import Finder

KINDS = ("none", "html", "markdown", "wiki", "latex")
#: Training texts made of each TRAIN_TEXTS labelled samples at least, boosting rounds and depth of the trees.
TRAIN_ROWS, TRAIN_TEXTS, ROUNDS, DEPTH, BINS = 5000, 1000, 30, 3, 16
#: Training texts whose histograms are added up at a time.
SLAB = 100_000
#: Pages of the table that give the DOM of the training sample, and nodes taken of each.
TRAIN_PAGES, TRAIN_NODES = 250, 4000
#: Nats that it costs a block to take up a kind of markup.
TAKE_UP = 0.4

# fixed values: element names of the HTML standard that texts are marked up with
_TAGS = "a|abbr|address|article|aside|b|big|blockquote|body|br|center|cite|code|dd|del|div|dl|dt|em|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|li|link|main|mark|meta|nav|ol|option|p|pre|q|s|script|section|select|small|span|strike|strong|style|sub|sup|table|tbody|td|tfoot|th|thead|title|tr|tt|u|ul|var|video"
_FEATURES = [re.compile(p, f) for p, f in (
    # html
    (rf"</?(?:{_TAGS})(?:\s+[\w-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>]+))?)*\s*/?>", re.I),
    (r"&(?:[a-zA-Z]{2,8}|#\d{2,7}|#x[0-9a-fA-F]{2,6});", 0),
    (r"<!--|-->|<!DOCTYPE", re.I),
    # markdown
    (r"(?<![*\w])\*\*\S(?:[^*\n]*\S)?\*\*(?!\*)|(?<!\w)__(?![A-Z_]+__)[^\s_](?:[^_\n]*[^\s_])?__(?!\w)", 0),
    (r"(?<!\[)\[[^\[\]\n]+\]\([^()\s]+\)", 0),
    (r"^#{1,6} \S", re.M),
    (r"^> ?\S|^>$", re.M),
    (r"^[-*+] (?!\[\[)\S", re.M),
    (r"^\d{1,2}\. \S", re.M),
    (r"^(?:```|~~~)", re.M),
    (r"(?<!`)`[^`\n]+`(?!`)", 0),
    (r"\|\s?:?-{2,}:?\s?\|", 0),
    (r"(?<![\w_])_[^_\s][^_\n]*_(?![\w_])", 0),
    (r"~~\S[^~]*~~|(?<![*\w])\*[^*\s][^*\n]*[^*\s]\*(?![*\w])", 0),
    # wiki
    (r"\[\[[^\[\]\n]+\]\]", 0),
    (r"\[\[(?:File|Image|Datei|Fichier|Archivo|Category|Kategorie)\s?:", re.I),
    (r"(?<!')'{2,5}(?!')\S[^\n]*?'{2,5}(?!')", 0),
    (r"^={2,5} ?[^=\n]+? ?={2,5}\s*$", re.M),
    (r"\{\|[^\n]*$|^\|-|^\|\}", re.M),
    (r"<ref\b[^>]*>|</ref>|<nowiki>|__TOC__", re.I),
    (r"\{\{[^{}|\n]+\|[^{}\n]*\}\}|\[https?://[^\s\]]+ [^\]]+\]", 0),
    (r"^[*#:;]+ ?\[\[", re.M),
    # latex
    (r"\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{", 0),
    (r"\\(?:begin|end)\{\w+\*?\}", 0),
    (r"\\[\[\]()]", 0),
    (r"(?<![\\\w$])\$[^$\n]*[\\^_{=][^$\n]*\$(?!\d)|(?<![\\\w$])\$[A-Za-z]{1,2}\$(?!\w)", 0),
    (r"\\(?:alpha|beta|gamma|delta|lambda|mu|pi|sigma|omega|le|ge|leq|geq|times|cdot|to|infty|sum|int|frac|sqrt|item|ldots|dots|quad|par|noindent|newline)\b", 0),
    (r"~\\(?:cite|ref|eqref)|\\\\(?:\s|$)|\\(?:[%&_#]|[\"'`^~]\{?[A-Za-z])", 0),
    # what only looks like it
    (r"[A-Z]:\\\w|\\\w+\\\w+\.\w", 0),
    (r"\$\d", 0),
    (r"\w [<>*] \w", 0),
    (r"\w_\w+_\w+\.\w|\w+_\w+_\w+", 0),
    (r"\[(?:sic|\d+|…|\.\.\.)\]", 0),
)]
#: What every construct of ``_FEATURES`` holds.
_HAS_SIGN = re.compile(r"[<&*_\[\]{}\\$`~]|''|==|^#|\|[^|]*\||^[-+:;>]|^\d+\. ", re.M)
_PARENTS = {n: i for i, n in enumerate("p h1 h2 h3 li td div span a title figcaption b strong em i q blockquote section article".split(), 1)}
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt div figcaption blockquote title caption section article main body a button q small".split())
_SIGNS = "<>&*_[]{}\\$#|`=~'"


def text_features(text: str) -> list[int]:
    """Counts of constructs, by the order of ``_FEATURES``, and shape of the text."""
    out = [len(rx.findall(text)) for rx in _FEATURES]
    signs = sum(map(text.count, _SIGNS))
    out += [min(15, len(text) // 24), min(15, text.count("\n")), min(15, signs), min(15, 120 * signs // (len(text) + 1))]
    return out


#: Places of the constructs of each kind in ``_FEATURES``.
_GROUPS = ((0, 3), (3, 14), (14, 22), (22, 28))
N_DOM = 12


class Dom:
    """Statistics of a page's elements that features of its text nodes need."""

    def __init__(self, page: Page):
        n = len(page.ids)
        self.page = page
        self.kids, self.chars, self.elements, self.linked = [0] * n, [0] * n, [0] * n, [0] * n
        self.depth, self.tokens, self.block = [0] * n, [0] * n, [-1] * n
        for i, p in enumerate(page.parents):
            own = page.data[i].count(SEP) + 1 if page.names[i] is not None and page.data[i] else 0
            if p >= 0:
                self.depth[i] = self.depth[p] + 1
                self.tokens[i] = self.tokens[p] + own
                self.block[i] = p if page.names[p] in _BLOCKS else self.block[p]
            else:
                self.tokens[i] = own
        for i in range(n - 1, -1, -1):
            p = page.parents[i]
            if page.names[i] is None:
                self.chars[i] = len(page.data[i] or "")
            if p >= 0:
                self.kids[p] += 1
                self.chars[p] += self.chars[i]
                self.elements[p] += self.elements[i] + (page.names[i] is not None)
                self.linked[p] += self.chars[i] if page.names[i] == "a" else self.linked[i]

    def features(self, found: dict[int, list[int]]) -> dict[int, list[int]]:
        """Of each text node of ``found`` (with its text features): depth, siblings, attribute
        tokens, text of the parent, the parent's name, elements, text and links of its
        block, and how many other texts of the blocks beside it hold constructs of each kind."""
        page = self.page
        beside: dict[int, list[int]] = {}
        has: dict[int, list[int]] = {}
        for i, f in found.items():
            has[i] = [int(any(f[a:b])) for a, b in _GROUPS]
            box = self.box(i)
            beside[box] = [x + y for x, y in zip(beside.get(box, (0,) * 4), has[i], strict=True)]
        out = {}
        for i in found:
            p, block = page.parents[i], self.block[i]
            near = [x - y for x, y in zip(beside[self.box(i)], has[i], strict=True)]
            chars = self.chars[block] if block >= 0 else self.chars[i]
            out[i] = [min(15, x) for x in (
                self.depth[i], self.kids[p] if p >= 0 else 0, self.tokens[p] if p >= 0 else 0, (self.chars[p] if p >= 0 else 0) // 40, _PARENTS.get(page.names[p] if p >= 0 else "", 0) % BINS,
                self.elements[block] if block >= 0 else 0, chars // 80, 15 * (self.linked[block] if block >= 0 else 0) // (chars + 1), *near,
            )]
        return out

    def box(self, i: int) -> int:
        """The element that holds a text node's block, and so its siblings."""
        b = self.block[i]
        return self.page.parents[b] if b >= 0 else -1


# --------------------------------------------------------- boosted trees
class BoostedTrees:
    """Multi-class gradient boosting on small integer features."""

    def __init__(self, trees: list[list[tuple]]):
        self.trees = trees  # [round][class] -> nodes (feature, bin, left, right, value)

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, classes: int, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = 0.4, reg: float = 1.0) -> BoostedTrees:
        n, f = x.shape
        x = np.minimum(x, BINS - 1).astype(np.uint8)
        score = np.zeros((n, classes))
        hot = np.eye(classes)[y]
        trees = []
        for _ in range(rounds):
            e = np.exp(score - score.max(1, keepdims=True))
            prob = e / e.sum(1, keepdims=True)
            layer = []
            for k in range(classes):
                g, h = hot[:, k] - prob[:, k], prob[:, k] * (1 - prob[:, k]) + 1e-6
                nodes: list = []
                score[:, k] += rate * cls._grow(x, g, h, np.arange(n), depth, reg, nodes, f)[1]
                layer.append([(a, b, c, d, rate * v) for a, b, c, d, v in nodes])
            trees.append(layer)
        return cls(trees)

    @staticmethod
    def _grow(x, g, h, rows, depth, reg, nodes, f):
        at = len(nodes)
        nodes.append(None)
        out = np.zeros(len(g))
        gs, hs = g[rows].sum(), h[rows].sum()
        best = None
        if depth and len(rows) > 20:
            gh, hh = np.zeros(f * BINS), np.zeros(f * BINS)
            for i in range(0, len(rows), SLAB):
                part = rows[i : i + SLAB]
                idx = (x[part] + np.arange(f) * BINS).ravel()
                gh += np.bincount(idx, np.repeat(g[part], f), f * BINS)
                hh += np.bincount(idx, np.repeat(h[part], f), f * BINS)
            gh, hh = gh.reshape(f, BINS).cumsum(1), hh.reshape(f, BINS).cumsum(1)
            gain = gh**2 / (hh + reg) + (gs - gh) ** 2 / (hs - hh + reg) - gs**2 / (hs + reg)
            gain[:, -1] = -1
            j = int(gain.argmax())
            if gain.flat[j] > 1e-3:
                best = divmod(j, BINS)
        if best is None:
            v = gs / (hs + reg)
            nodes[at] = (-1, 0, 0, 0, v)
            out[rows] = v
            return at, out
        left = x[rows, best[0]] <= best[1]
        a, oa = BoostedTrees._grow(x, g, h, rows[left], depth - 1, reg, nodes, f)
        b, ob = BoostedTrees._grow(x, g, h, rows[~left], depth - 1, reg, nodes, f)
        nodes[at] = (best[0], best[1], a, b, 0.0)
        return at, oa + ob

    def log_probs(self, row: list[int]) -> list[float]:
        score = [0.0] * len(self.trees[0])
        for layer in self.trees:
            for k, nodes in enumerate(layer):
                f, b, left, right, v = nodes[0]
                while f >= 0:
                    f, b, left, right, v = nodes[left if row[f] <= b else right]
                score[k] += v
        top = max(score)
        z = top + np.log(sum(np.exp(s - top) for s in score))
        return [float(s - z) for s in score]


# --------------------------------------------------------- training sample
def _write_in(kind: str, text: str, r: random.Random) -> str:
    """A text with markup of one kind written into it."""
    words = text.split()
    i = r.randrange(len(words))
    j = min(len(words), i + r.randint(1, 4))
    part, n = " ".join(words[i:j]), r.randint(1, 99)
    put = lambda s: " ".join([*words[:i], s, *words[j:]])
    two = [" ".join(r.sample(words, min(3, len(words)))) for _ in range(r.randint(2, 3))]
    name = (part.split() or ["x"])[0].strip(".,;").capitalize() or "X"
    if kind == "html":
        tag = r.choice(["b", "i", "em", "strong", "u", "span", "small", "h2", "code"])
        ent = re.sub(r"[à-ü]", lambda m: html.entities.codepoint2name.get(ord(m[0]), "amp").join("&;"), text) if re.search("[à-ü]", text) else text.replace(" ", "&nbsp;", r.randint(1, 4))
        return r.choice([put(f"<{tag}>{part}</{tag}>"), f"{text}<br{r.choice(['', ' ', ' /'])}>{part}", f'<a href="/a/{n}">{part}</a> {text}', f"{text}</{r.choice(['div', 'p', 'span', 'td'])}>", "<ul>" + "".join(f"<li>{t}</li>" for t in two) + "</ul>", f"<font size={n % 7}>{part}</font> – {text}", f'<img src="{n}.jpg" alt="{part}"> {text}', ent, put(part + r.choice(["&amp;", "&quot;", "&lt;", "&#39;", "&mdash;"])), f'<p class="c{n}">{text}</p>', f"<!-- {part} --> {text}", f"<table><tr><td>{part}</td></tr></table>", f"<{tag}>{text}"])
    if kind == "markdown":
        return r.choice([put(f"**{part}**"), put(f"[{part}](/a/{n})"), f"{text} [{part}](https://x.example/{n})", f"![{part}](img/p{n}.png) {text}", f"{'#' * r.randint(1, 4)} {part}\n\n{text}", f"> {text}\n>\n> {part}", "\n".join("- " + t for t in two), "\n".join(f"{k}. {t}" for k, t in enumerate(two, 1)), "\n".join("* " + t for t in two), f"```\nx = {n}\n```\n{text}", f"{text} `run_{n} --all` _{part}_", f"| {part} | {n} |\n|---|---|\n| {two[0]} | {n + 1} |", put(f"*{part}*"), put(f"_{part}_"), f"~~{part}~~ {text}", put(f"`{part}`")])
    if kind == "wiki":
        return r.choice([put(f"[[{name}|{part}]]"), f"{text} [[{name}]]", f"[[File:{name}.jpg|thumb|{part}]] {text}", f"== {part} ==\n{text}", f"=== {part} ===\n{text}", f"'''{name}''' – {text}", put(f"''{part}''"), f'{text}<ref name="{name}" /> \'\'{part}\'\'', f"{text}<ref>{part}</ref>", f'{{| class="wikitable"\n! {part}\n|-\n| {n}\n|}}', "\n".join(f"* [[{t.split()[0].capitalize()}]]" for t in two), f"{{{{cite|{part}|{n}}}}} {text}", f"{text} [http://x.example {part}]", "\n".join(f"# [[{t.split()[0]}]]" for t in two), f"[[Category:{name}]] {text}"])
    return r.choice([put(rf"\emph{{{part}}}"), put(rf"\textbf{{{part}}}"), rf"{text} \textbf{{{part}}}\footnote{{{two[0]}}}", rf"\section{{{part}}} {text}", rf"\begin{{itemize}} \item {two[0]} \item {part} \end{{itemize}}", rf"{text.rstrip('.')}~\cite{{{name.lower()}{n}}}.", rf"{text} $\alpha_{{{n}}} \le \beta^2$", rf"\[ \frac{{x_{n}}}{{y}} = \sqrt{{z}} \] {text}", rf"{text} $x_{n} = y^2$", rf"\textit{{{part}}} -- {text}", rf"{text} \ref{{sec:{n}}} \\ {part}", rf"{text} \(a^{{{n}}}\)", rf"\begin{{quote}} {text} \end{{quote}}", rf"\'{{e}}t\'e \"a {text}", rf"{text} \ldots{{}} $\sum_{{i=1}}^{{{n}}} x_i$", rf"\noindent {text} \label{{eq:{n}}}"])


def _leave_clean(text: str, r: random.Random) -> str:
    """A text without markup but with signs as prose has them."""
    n, m = r.randint(1, 99), r.randint(1, 400)
    words = text.split()
    part = " ".join(words[: r.randint(1, 4)])
    return r.choice([text, text, f"{text} [{m}]", f"{part} [sic] {text}", f"{part} costs ${n} for one and ${m} for two.", rf"{part} C:\temp\new\list.txt {text}", rf"{part} D:\data\{n}.doc", f"{text} {n} * {m} * 5 = {n * m * 5}.", f"If x < {n} and y > {m} then {part}.", f"The file a_line_{n}_final.txt {part}", f"{part} [about {m}] {text}; see note [{n}].", f"It stayed at #{n} {text}", f"{part} {{but {text}}}", f"{n}% & {m}%: {text}", f"{part} = {n} {text}", f"{text} 'quoted' {part}", f"{part} – {text}", f"- {text}", f"{text} (~{n} km)", f"{part} a|b {text}", f"* {text}", f"{n}. {text}", f"R&D {text}", f"{part} <{n} {text}", f"{text} 5'{n}\"", f"x_{n} {text}", f"# {n}", f"{part}* {text}"])


def _sentences(samples: list[str]) -> list[str]:
    return sorted({s.strip() for t in samples for s in re.split(r"(?<=[.!?…])\s+", t) if len(s.split()) >= 3}) or ["a plain text of some words"]


def _plain_page(sentences: list[str], r: random.Random) -> tuple:
    """A page of headings, paragraphs and a list, as chunks have it, for tables with few pages."""
    ids, par, names, data = [0, 1], [-1, 0], ["html", "body"], ["", ""]
    for k in range(r.randint(4, 9)):
        at = len(ids)
        ids += [at, at + 1]
        par += [1, at]
        names += [r.choice(["p", "p", "p", "h2", "li"]), None]
        data += ["", r.choice(sentences)]
    return ids, par, names, data


def sample_pages(nodes: DataFrame, pages: int = TRAIN_PAGES, rows: int = TRAIN_NODES) -> list[tuple]:
    """Elements and texts of at most ``pages`` pages of at most ``rows`` nodes, those first by a
    hash of their ids: (ids, parents, names, data). For training only."""
    counted = nodes.where("page_id is not null and kind in ('element', 'text')").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    chosen = [r["page_id"] for r in counted.where(F.col("n") <= rows).orderBy(F.xxhash64("page_id"), "page_id").limit(pages).collect()]
    if not chosen:
        return []
    got = page_chunks(nodes.where(F.col("page_id").isin(chosen))).where("blob is not null").select("page_id", "blob").collect()
    blobs: dict[int, list[bytes]] = {}
    for r in sorted(got, key=lambda r: (r["page_id"], bytes(r["blob"]))):
        blobs.setdefault(r["page_id"], []).append(bytes(r["blob"]))
    return [_merge([marshal.loads(b) for b in bs]) for bs in blobs.values()]


def training_rows(samples: list[str], pages: list[tuple], rows: int = TRAIN_ROWS, seed: int = 7) -> tuple[list[list[int]], list[int]]:
    """Features and kinds of ``rows`` texts or more written into pages where they stand; every
    sentence of the samples is among them. Some blocks take
    markup of one kind in several texts, some in one; what only resembles it stands
    alone or beside it; the page's other texts with constructs, whose kind is not known,
    take part as siblings only. The same for equal input."""
    r = random.Random(seed)
    sentences = _sentences(samples)
    x: list[list[int]] = []
    y: list[int] = []
    memo: dict[str, list[int]] = {}
    drawn: set[str] = set()
    rest: list[str] | None = None  # the sentences that the first ``rows`` texts leave out

    def draw() -> str:
        s = rest.pop() if rest else r.choice(sentences)
        drawn.add(s)
        return s

    while len(x) < rows or rest:
        source = r.choice(pages) if r.random() < 0.8 * min(1.0, len(pages) / 50) else _plain_page(sentences, r)
        page = Page.of(*(list(c) for c in source))
        places = [i for i, n in enumerate(page.names) if n is None and page.in_body[i] and not page.in_code[i] and len((page.data[i] or "").split()) >= 2]
        if not places:
            pages = [p for p in pages if p is not source]
            continue
        dom = Dom(page)
        boxes: dict[int, list[int]] = {}
        for i in places:
            boxes.setdefault(dom.box(i), []).append(i)
        label: dict[int, int] = {}
        unclear = _constructs(page, memo)
        for box in r.sample(sorted(boxes), min(len(boxes), 3)):
            here = boxes[box]
            kind = r.choice((0, 0, 1, 2, 3, 4))
            many = 1 if kind == 0 or r.random() < 0.4 else min(len(here), r.randint(2, 5))
            mixed = r.random() < 0.3  # every text its own way
            for i in sorted(r.sample(here, many)):
                kind = r.choice((0, 1, 2, 3, 4)) if mixed else kind
                text = page.data[i] if i not in unclear and len(page.data[i].split()) >= 3 and r.random() < 0.5 else draw()
                if kind and many > 1 and not mixed and r.random() < 0.3:
                    # a line of a list or a heading, that alone says little
                    page.data[i] = r.choice({1: ["{}<br>", "&nbsp;{}"], 2: ["- {}", "* {}", "{n}. {}", "# {}"], 3: ["* {}", "# {}", "=={}=="], 4: ["{} \\\\", "\\item {}"]}[kind]).replace("{n}", str(r.randint(1, 9))).replace("{}", text)
                else:
                    page.data[i] = _write_in(KINDS[kind], text, r) if kind else _leave_clean(text, r)
                label[i] = kind
            # what only resembles markup stands beside it too, and so does markup of another kind
            for i in here:
                if i not in label and r.random() < 0.35:
                    other = r.choice((0, 0, 0, 1, 2, 3, 4))
                    text = draw()
                    page.data[i] = _write_in(KINDS[other], text, r) if other else _leave_clean(text, r)
                    label[i] = other
        dom = Dom(page)
        found = _constructs(page, memo)
        for i, more in dom.features(found | {i: text_features(page.data[i]) for i in label if i not in found}).items():
            if i in label:
                x.append((found.get(i) or text_features(page.data[i])) + more)
                y.append(label[i])
        if rest is None and len(x) >= rows:
            rest = [s for s in sentences if s not in drawn]
            r.shuffle(rest)
    return x, y


def train(samples: list[str], pages: list[tuple] = (), rows: int = TRAIN_ROWS, seed: int = 7) -> BoostedTrees:
    """Trees trained on ``rows`` texts or more, written into ``pages`` (of ``sample_pages``)."""
    x, y = training_rows(samples, list(pages), rows, seed)
    return BoostedTrees.train(np.array(x), np.array(y), len(KINDS))


def training_table(lang_samples: DataFrame, pages: list[tuple] = (), seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """``training_rows`` of all labelled samples, by parts of about TRAIN_TEXTS texts, which tasks
    work off; what comes to the driver is a byte for each feature."""
    texts = lang_samples.where("text is not null").select("text").distinct()
    parts = max(1, -(-texts.count() // TRAIN_TEXTS))
    source = lang_samples.sparkSession.sparkContext.broadcast(list(pages))

    def packed(part: int, samples: list[str], pages: list[tuple]) -> tuple[int, bytes, bytes]:
        x, y = training_rows(samples, list(pages), TRAIN_ROWS, seed + part)
        return part, np.minimum(x, BINS - 1).astype(np.uint8).tobytes(), bytes(y)

    def write(key: tuple, table: pa.Table) -> pa.Table:
        part, x, y = packed(key[0].as_py(), table.column("text").to_pylist(), source.value)
        return pa.Table.from_arrays([pa.array([part], pa.int32()), pa.array([x], pa.binary()), pa.array([y], pa.binary())], names=["part", "x", "y"])

    rows = texts.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(write, "part int, x binary, y binary")
    found = sorted((r["part"], bytes(r["x"]), bytes(r["y"])) for r in rows.collect()) or [packed(0, [], pages)]
    y = np.frombuffer(b"".join(f[2] for f in found), np.uint8)
    return np.frombuffer(b"".join(f[1] for f in found), np.uint8).reshape(len(y), -1), y


def fit(lang_samples: DataFrame, pages: list[tuple] = ()) -> BoostedTrees:
    """Trees trained on texts of all labelled samples, written into ``pages``."""
    return BoostedTrees.train(*training_table(lang_samples, pages), len(KINDS))


# --------------------------------------------------------- decoding
def decode(page: Page, scores: dict[int, list[float]], cost: float = TAKE_UP) -> dict[int, int]:
    """Kinds of text nodes from their log probabilities: the best assignment to the tree in
    which a block either leaves open what is below it, or takes up one kind, at ``cost``,
    that all text below it has, or none. Text counts only below a block that has taken
    up a kind, so ancestors and descendants never differ; below code there is none."""
    # gain over none of the best choice below each element: left open, and under each kind
    opened: dict[int, float] = {}
    under: dict[int, list[float]] = {}
    above: set[int] = set()
    for i in scores:
        if page.in_code[i]:
            continue
        p = page.parents[i]
        gains = [0.0] + [max(0.0, scores[i][k] - scores[i][0]) for k in range(1, len(KINDS))]
        under[p] = [a + b for a, b in zip(under.get(p, (0.0,) * len(KINDS)), gains, strict=True)]
        while p >= 0 and p not in above:
            above.add(p)
            p = page.parents[p]
    took: dict[int, int] = {}
    for e in sorted(above | {-1}, reverse=True):
        mine = under.get(e, [0.0] * len(KINDS))
        best = max(range(1, len(KINDS)), key=lambda k: mine[k])
        free = opened.get(e, 0.0)
        if (e < 0 or page.names[e] in _BLOCKS) and mine[best] - cost > free:
            took[e], free = best, mine[best] - cost
        if e >= 0:
            p = page.parents[e]
            under[p] = [a + b for a, b in zip(under.get(p, (0.0,) * len(KINDS)), mine, strict=True)]
            opened[p] = opened.get(p, 0.0) + free
    out: dict[int, int] = {}
    state: dict[int, int] = {-1: took.get(-1, 0)}
    for e in sorted(above):
        state[e] = state[page.parents[e]] or took.get(e, 0)
    for i in scores:
        kind = 0 if page.in_code[i] else state[page.parents[i]]
        if kind and scores[i][kind] > scores[i][0]:
            out[i] = kind
    return out


def _constructs(page: Page, memo: dict[str, list[int]]) -> dict[int, list[int]]:
    """Position -> text features, of the text nodes outside code that hold a construct of
    any grammar; in others there is nothing to classify."""
    found = {}
    for i, n in enumerate(page.names):
        t = page.data[i]
        if n is None and t and not page.in_code[i] and _HAS_SIGN.search(t):
            f = memo.get(t)
            if f is None:
                f = text_features(t)
                if len(memo) < 100_000:
                    memo[t] = f
            if any(f[: len(_FEATURES)]):
                found[i] = f
    return found


def find_markup(page: Page, model: BoostedTrees, memo: dict[str, list[int]], residue: Callable[[Page], dict]) -> dict[int, int]:
    """Position -> kind of markup, for the text nodes of a page that hold any; what
    ``residue`` finds on the page is left out."""
    found = _constructs(page, memo)
    if not found:
        return {}
    skip = residue(page)
    found = {i: f for i, f in found.items() if i not in skip}
    around = Dom(page).features(found)
    return decode(page, {i: model.log_probs(f + around[i]) for i, f in found.items()})


# --------------------------------------------------------- conversion
_HTML_BLOCK = re.compile(r"</?(?:p|div|section|article|table|tr|ul|ol|blockquote|br)\b[^>]*>", re.I)


def _html_text(s: str) -> str:
    s = re.sub(r"<!--.*?-->", "", s, flags=re.S)
    s = re.sub(r"<(script|style)\b.*?</\1>", "", s, flags=re.S | re.I)
    s = re.sub(r"<pre\b[^>]*>(.*?)</pre>", r"\n```\n\1\n```\n", s, flags=re.S | re.I)
    s = re.sub(r"<code\b[^>]*>(.*?)</code>", r"`\1`", s, flags=re.S | re.I)
    s = re.sub(r"<h([1-6])\b[^>]*>(.*?)</h\1>", lambda m: "\n" + "#" * int(m[1]) + " " + m[2] + "\n", s, flags=re.S | re.I)
    s = re.sub(r"<li\b[^>]*>", "\n- ", s, flags=re.I)
    s = re.sub(r"</t[dh]>", " | ", s, flags=re.I)
    s = _HTML_BLOCK.sub("\n", s)
    s = re.sub(rf"</?(?:{_TAGS})\b[^<>]*>", "", s, flags=re.I)
    return html.unescape(s).replace("\u00a0", " ")


def _markdown_text(s: str) -> str:
    keep: list[str] = []

    def hold(m):
        keep.append(m.group())
        return f"\x00{len(keep) - 1}\x00"

    s = re.sub(r"^(```|~~~).*?^\1[ \t]*$", hold, s, flags=re.S | re.M)
    s = re.sub(r"`[^`\n]+`", hold, s)
    s = re.sub(r"!\[([^\]]*)\]\([^()\s]+\)", r"\1", s)
    s = re.sub(r"\[([^\[\]]+)\]\([^()\s]+\)", r"\1", s)
    s = re.sub(r"(\*\*|__)(\S(?:.*?\S)?)\1", r"\2", s)
    s = re.sub(r"(?<![\w*])\*(\S(?:[^*\n]*\S)?)\*(?![\w*])", r"\1", s)
    s = re.sub(r"(?<![\w_])_(\S(?:[^_\n]*\S)?)_(?![\w_])", r"\1", s)
    s = re.sub(r"~~(\S.*?)~~", r"\1", s)
    s = re.sub(r"^> ?", "", s, flags=re.M)
    s = re.sub(r"^[*+] ", "- ", s, flags=re.M)
    s = re.sub(r"^\|?[\s:|-]*-{2,}[\s:|-]*\|?[ \t]*\n?", "", s, flags=re.M)
    return re.sub("\x00(\\d+)\x00", lambda m: keep[int(m[1])], s)


def _wiki_text(s: str) -> str:
    s = re.sub(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>", "", s, flags=re.S | re.I)
    s = re.sub(r"\[\[(?:File|Image|Datei|Fichier|Archivo)\s?:[^\[\]]*?\|?([^\[\]|]*)\]\]", r"\1", s, flags=re.I)
    s = re.sub(r"\[\[Category:[^\]]*\]\]", "", s, flags=re.I)
    s = re.sub(r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", r"\1", s)
    s = re.sub(r"\[\[([^\[\]]*)\]\]", r"\1", s)
    s = re.sub(r"\[https?://\S+ ([^\]]+)\]", r"\1", s)
    s = re.sub(r"'{2,5}", "", s)
    s = re.sub(r"^\{\|.*$|^\|-.*$|^\|\}.*$", "", s, flags=re.M)
    s = re.sub(r"^[!|]\s?", "", s, flags=re.M)
    s = re.sub(r"^([*#]+) ?", lambda m: "  " * (len(m[1]) - 1) + "- ", s, flags=re.M)
    s = re.sub(r"^(={2,5}) ?(.+?) ?\1[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2], s, flags=re.M)
    s = re.sub(r"\{\{[^{}|]*\|([^{}]*)\}\}", lambda m: m[1].split("|")[0], s)
    return re.sub(r"\{\{[^{}]*\}\}", "", s)


_TEX_HOLD = re.compile(
    r"\\begin\{(verbatim|lstlisting|minted|equation|align|gather|multline|eqnarray|displaymath|math)(\*?)\}(?:\[[^\]]*\])?(.*?)(?:\\end\{\1\2\}|\Z)"
    r"|\\\[(.*?)\\\]|\$\$(.*?)\$\$|(?<!\\)\$((?:[^$\\]|\\.)+?)\$|\\\((.*?)\\\)|\\verb\*?([|!+@/])(.*?)\8", re.S
)
_TEX_COMMENT = re.compile(r"(?<!\\)%[^\n]*(?:\n|\Z)")
_TEX_ACCENT = re.compile(r"\\([\"'`^~=.])\s?(?:\{\\?([A-Za-z])\s?\}|\\([ij])(?![A-Za-z])|([A-Za-z]))|\\([uvHcdbrk])\{([A-Za-z])\}")
_TEX_LETTER = re.compile(r"\{?\\(aa|AA|ae|AE|oe|OE|ss|[oOlL]|i|j)(?:\{\}|\}|(?![A-Za-z])\s?)")
_TEX_DROP = re.compile(r"\\(?:label|vspace|hspace|input|include|bibliographystyle|bibliography|usepackage|documentclass|includegraphics|pagestyle|thispagestyle|setlength|newtheorem|theoremstyle|addtolength|setcounter|hypersetup|maketitle|tableofcontents|makeatletter|makeatother|centering|noindent|hline|toprule|midrule|bottomrule|newpage|clearpage|appendix|qed)\*?(?![A-Za-z])(?:\[[^\]]*\])*(?:\{[^{}]*\})*")
_TEX_HEAD = {"part": 1, "chapter": 1, "title": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}


def latex_text(s: str) -> str:
    """Readable text of LaTeX source. Comments, preamble and layout commands go;
    headings, lists, listings, formulas, captions and the bibliography stay."""
    import unicodedata

    from .pii import _COMBINING, _TEX_LETTERS

    s = s.replace("\r\n", "\n").replace("\r", "\n")
    keep: list[str] = []

    def hold(m):
        env, code = m[1], m[3]
        if env in ("verbatim", "lstlisting", "minted"):
            out = "\n```\n" + code.strip("\n") + "\n```\n"
        elif env or m[4] is not None or m[5] is not None:
            body = code if env else (m[4] if m[4] is not None else m[5])
            out = "\n$$ " + re.sub(r"\\label\{[^}]*\}", "", body).strip() + " $$\n"
        elif m[9] is not None:
            out = "`" + m[9] + "`"
        else:
            out = "$" + (m[6] if m[6] is not None else m[7]).strip() + "$"
        keep.append(out)
        return f"\x00{len(keep) - 1}\x00"

    head, found, body = s.partition("\\begin{document}")
    if found:
        titles = re.findall(r"\\title(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}", head)
        s = ("\\title{" + titles[0] + "}\n" if titles else "") + body
    s = s.partition("\\end{document}")[0]
    parts = re.split(r"(\\begin\{(?:verbatim|lstlisting|minted)\}.*?\\end\{(?:verbatim|lstlisting|minted)\})", s, flags=re.S)
    s = "".join(p if k % 2 else _TEX_COMMENT.sub("", p) for k, p in enumerate(parts))
    s = re.sub(r"\\iffalse.*?\\fi\b", "", s, flags=re.S)
    s = _TEX_HOLD.sub(hold, s)
    s = re.sub(r"\\(?:re|provide)?newcommand\*?\s*\{?\\\w+\}?(?:\[[^\]]*\])*\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}|\\(?:let|def)\\\w+[^\n]*|\\DeclareMathOperator\*?\{[^}]*\}\{[^}]*\}", "", s)

    def accent(m):
        base = m[2] or m[3] or m[4] or m[6]
        return unicodedata.normalize("NFC", base + _COMBINING[m[1] or m[5]])

    s = _TEX_ACCENT.sub(accent, s)
    s = _TEX_LETTER.sub(lambda m: _TEX_LETTERS[m[1]], s)
    s = _TEX_DROP.sub("", s)
    s = re.sub(r"\\(part|chapter|title|section|subsection|subsubsection|paragraph)\*?(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}", lambda m: "\n" + "#" * _TEX_HEAD[m[1]] + " " + m[2] + "\n", s)
    s = re.sub(r"\\item(?![A-Za-z])\s*(?:\[([^\]]*)\])?\s*", lambda m: "\n- " + (m[1] + " " if m[1] else ""), s)
    s = re.sub(r"\\bibitem(?:\[[^\]]*\])?\{[^}]*\}\s*", "\n- ", s)
    s = re.sub(r"\\(?:cite[tp]?|ref|eqref|pageref)\*?(?:\[[^\]]*\])*\{([^}]*)\}", r"[\1]", s)
    s = re.sub(r"\\href\{[^}]*\}\{((?:[^{}]|\{[^{}]*\})*)\}", r"\1", s)
    s = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?(?:\{[^{}]*\})?", "\n", s)
    s = re.sub(r"(?<!\\)&", " | ", s)
    s = re.sub(r"\\\\(?:\[[^\]]*\])?", "\n", s)
    s = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{", "", s)  # groups at any depth; what closes them goes below
    s = re.sub(r"\\([%&_#$@{}])", r"\1", s)
    s = re.sub(r"\\[A-Za-z]+\*?\s?", "", s)
    s = re.sub(r"\\[,;:!/ ]", " ", s)
    s = s.replace("~", " ").replace("``", "“").replace("''", "”").replace("---", "—").replace("--", "–")
    s = re.sub(r"[{}]", "", s)
    s = re.sub(r"\n[ \t]+", "\n", s)
    for _ in range(3):
        s = re.sub("\x00(\\d+)\x00", lambda m: keep[int(m[1])], s)
    s = re.sub(r"[ \t]+", " ", s)
    return re.sub(r"\n[ \t]*(?:\n[ \t]*)+", "\n\n", s).strip()


def strip_markup(text: str, kind: str) -> str:
    """Clean text of ``text``, which holds markup of ``kind``."""
    if kind == "latex":
        return latex_text(text)
    out = {"html": _html_text, "markdown": _markdown_text, "wiki": _wiki_text}.get(kind, lambda s: s)(text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", out)).strip()


# --------------------------------------------------------- operators
def markup_nodes(nodes: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(page_id, node_id, markup, text): text nodes that hold markup, its kind, and
    their clean text. Null, empty and blank contents hold none; code samples, text
    of script and style and residue (problem 1) are left out; repeated rows count
    once."""
    model = nodes.sparkSession.sparkContext.broadcast((sample_counts(lang_samples), fit(lang_samples, sample_pages(nodes)).trees))

    def rows(pages: Iterator[Page]):
        trees, finder, memo = BoostedTrees(model.value[1]), Finder(model.value[0]), {}
        for page in pages:
            for i, k in find_markup(page, trees, memo, finder.find).items():
                yield page.page_id, page.ids[i], KINDS[k], strip_markup(page.data[i], KINDS[k])

    return map_pages(page_chunks(nodes), rows, "page_id bigint, node_id int, markup string, text string")


def document_kind(text: str, model: BoostedTrees) -> str:
    """The kind of markup of a whole document: that of its paragraphs together, each weighed
    by its log probabilities as a paragraph of a page."""
    parts = [f for part in re.split(r"\n\s*\n", text) if any((f := text_features(part))[: len(_FEATURES)])]
    has = [[int(any(f[a:b])) for a, b in _GROUPS] for f in parts]
    beside = [sum(h[k] for h in has) for k in range(len(_GROUPS))]
    total = [0.0] * len(KINDS)
    for f, own in zip(parts, has, strict=True):
        around = [min(15, x - y) for x, y in zip(beside, own, strict=True)]
        total = [x + y for x, y in zip(total, model.log_probs(f + _PARAGRAPH + around), strict=True)]
    return KINDS[max(range(len(KINDS)), key=lambda k: (total[k], -k))]


#: DOM features of a paragraph of an article, without those of its siblings.
_PARAGRAPH = [4, 1, 2, 8, 1, 1, 4, 0]


def clean_documents(docs: DataFrame, lang_samples: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): each document as clean text, converted from the kind of markup that the
    classifier finds in it; a document without any stays as it is. Null stays null,
    empty stays empty; rows stay one for one."""
    kind = docs.schema[key].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(fit(lang_samples).trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = BoostedTrees(model.value)
        for batch in batches:
            out = [None if t is None else strip_markup(t, k) if (k := document_kind(t, trees)) != "none" else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["k", "t"])

    return spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInArrow(run, f"k {kind}, t string").toDF(key, text)
