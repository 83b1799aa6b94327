"""Problem 3: missing or wrong language labels, and mixed-language text.

Method: the script of a word narrows its candidate languages, a model of character
sequences and known words scores it in each of them, and Viterbi search over the
words of a text, with a penalty for each switch, labels spans. The model is trained
on the labelled samples. A page's language is the one with most characters in the
spans of its main body; its confidence is that share times the mean posterior.

Words in a script that none of the model's languages is written in are of unknown
language (``und``) and take no part in the search.

Texts in damaged encodings are undone first; residue (problem 1) and boilerplate
(problem 2) don't count.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .boilerplate import Block, map_blocks, page_blocks
from .pages import Page
from .residue import Finder

#: Nats a switch of language costs between two words.
SWITCH = 6.0
#: Share of a text's letters that must be in one language for the text to be wholly in it.
WHOLE = 0.85
#: Words, padding included, that one search holds.
SLAB_WORDS = 300_000
#: Characters from which a text node is given a language of its own.
MIN_CHARS = 40
_WORD = re.compile(r"[^\W\d_]+")


UNKNOWN = "und"
# fixed values: first and last code points of the letters of scripts
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x531, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x139F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7A3),
)
_FIRST = [a for _, a, _ in SCRIPTS]


def _script(word: str) -> str:
    """The script of a word, by its first letter's range; ``other`` if it is in none."""
    o = ord(word[0])
    name, _, last = SCRIPTS[max(0, bisect_right(_FIRST, o) - 1)]
    return name if o <= last else "other"


class LanguageModel:
    """Per-word scores in each language, from labelled texts."""

    def __init__(self, samples: Iterable[tuple[str, str]], order: int = 4):
        grams: dict[str, Counter] = {}
        words: dict[str, Counter] = {}
        scripts: dict[str, Counter] = {}
        for lang, text in samples:
            for w in _WORD.findall((text or "").lower()):
                words.setdefault(lang, Counter())[w] += 1
                scripts.setdefault(lang, Counter())[_script(w)] += 1
                s = f"^{w}$"
                g = grams.setdefault(lang, Counter())
                for n in range(1, order + 1):
                    for i in range(len(s) - n + 1):
                        g[s[i : i + n]] += 1
        self.langs = sorted(words)
        self.order = order
        self.grams = [grams[k] for k in self.langs]
        self.words = [words[k] for k in self.langs]
        self.total = [sum(words[k].values()) for k in self.langs]
        # languages written in a script: a tenth of their words at least
        self.written = {s: can for s in {n for n, _, _ in SCRIPTS} if (can := [i for i, k in enumerate(self.langs) if scripts[k][s] * 10 > sum(scripts[k].values())])}
        self.memo: dict[str, np.ndarray] = {}
        self.logs: list[dict[str, float]] = [{} for _ in self.langs]
        # scores and letters of the words seen so far; row 0 stands for no word
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs)))
        self.shares = np.zeros_like(self.table)  # posteriors of the languages
        self.letters = np.zeros(1024)
        self.foreign = np.zeros(1024, bool)  # in a script of no language of the model

    def _ids(self, words: list[str]) -> list[int]:
        """Rows of words in ``table`` and ``letters``."""
        out = list(map(self.rows.get, words))
        if None in out:
            had = len(self.rows) + 1
            for i, at in enumerate(out):
                if at is None:
                    w = words[i]
                    if w not in self.rows:
                        n = len(self.rows) + 1
                        if n == len(self.table):
                            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                            self.shares = np.concatenate([self.shares, np.zeros_like(self.shares)])
                            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
                            self.foreign = np.concatenate([self.foreign, np.zeros_like(self.foreign)])
                        self.table[n], self.letters[n], self.foreign[n], self.rows[w] = self.score(w), len(w), _script(w) not in self.written, n
                    out[i] = self.rows[w]
            share = np.exp(self.table[had : len(self.rows) + 1])
            self.shares[had : len(self.rows) + 1] = share / share.sum(1, keepdims=True)
        return out

    def _log(self, i: int, gram: str) -> float:
        """Log score of the last character of ``gram`` behind the others, in language i."""
        g, got = self.grams[i], -9.0
        # longest context that occurred, discounted for each step back
        for n in range(len(gram), 0, -1):
            c = g.get(gram[-n:], 0)
            if c:
                base = g.get(gram[-n:-1], 0) if n > 1 else sum(map(g.get, "^$", (0, 0))) * 6
                got = math.log(0.4 ** (len(gram) - n) * c / max(base, c, 1))
                break
        if len(self.logs[i]) < 300_000:
            self.logs[i][gram] = got
        return got

    def score(self, word: str) -> np.ndarray:
        """Log scores of a word, relative to the best; languages of other scripts get a
        low one, and a word of no known script scores alike in all."""
        got = self.memo.get(word)
        if got is None:
            w = word.lower()
            out = np.full(len(self.langs), -12.0)
            can = self.written.get(_script(w), [])
            if not can:  # of a script that none of them is written in
                out[:] = 0.0
            else:
                s = f"^{w}$"
                raw = []
                for i in can:
                    logs, total = self.logs[i], 0.0
                    for j in range(1, len(s)):
                        gram = s[max(0, j + 1 - self.order) : j + 1]
                        total += logs[gram] if gram in logs else self._log(i, gram)
                    known = self.words[i].get(w, 0)
                    raw.append(0.5 * total + 1.0 * math.log((known + 0.1) / (self.total[i] + 1)))
                top = max(raw)
                for i, v in zip(can, raw, strict=True):
                    out[i] = max(-12.0, v - top)
            got = out
            if len(self.memo) < 300_000:
                self.memo[word] = got
        return got

    def label(self, texts: list[str]) -> list[tuple[list[int], float, float]]:
        """For each text: letters in each language by the best path, and last those of unknown
        language; the mean posterior of its words, and all letters."""
        if len(self.rows) > 1_000_000:
            self.rows.clear()
        found = [_WORD.findall(t) for t in texts]
        out: list[tuple[list[int], float, float]] = [([0] * (len(self.langs) + 1), 0.0, 0.0)] * len(texts)
        order = sorted((i for i, w in enumerate(found) if w), key=lambda i: -len(found[i]))
        at = 0
        while at < len(order):
            # texts of like length go together, so many that the table of their words stays small
            many = max(1, SLAB_WORDS // len(found[order[at]]))
            self._search([(i, found[i]) for i in order[at : at + many]], out)
            at += many
        return out

    def _search(self, texts: list[tuple[int, list[str]]], out: list) -> None:
        """Viterbi over some texts at once, word by word, longest text first."""
        n_langs, n = len(self.langs), len(texts)
        lens = np.array([len(w) for _, w in texts])
        longest = int(lens[0])
        words = np.zeros((longest, n), np.int64)
        for r, (_, ws) in enumerate(texts):
            words[: len(ws), r] = self._ids(ws)
        scores, sizes = self.table[words], self.letters[words]
        going = [int(x) for x in (lens[None, :] > np.arange(longest)[:, None]).sum(1)]  # texts that have a t-th word
        best = np.zeros((n, n_langs))
        back = np.zeros((longest, n, n_langs), np.int16)
        ranks = np.arange(n_langs, dtype=np.int16)[None, :]
        every = np.arange(n)
        for t, m in enumerate(going):
            b = best[:m]
            top = b.argmax(1)
            switch = b[every[:m], top][:, None] - (SWITCH if t else 0.0)
            stay = b >= switch
            back[t, :m] = np.where(stay, ranks, top[:, None])
            best[:m] = np.where(stay, b, switch) + scores[t, :m]
        path = np.zeros((longest, n), np.int64)
        state = best.argmax(1)
        for t in range(longest - 1, -1, -1):
            m = going[t]
            path[t, :m] = s = state[:m]
            state[:m] = back[t, every[:m], s]
        post = self.shares[words, path]
        foreign = self.foreign[words]
        if foreign.any():
            path[foreign], post[foreign] = n_langs, 1.0
        # all languages at once: letters by text and language
        flat = np.bincount((path + np.arange(n) * (n_langs + 1)).ravel(), sizes.ravel(), n * (n_langs + 1))
        letters = flat.reshape(n, n_langs + 1)
        post = post.sum(0) / lens
        total = letters.sum(1).tolist()
        for (i, _), by, p, k in zip(texts, letters.astype(np.int64).tolist(), post.tolist(), total, strict=True):
            out[i] = (by, p, k)

    def segments(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, language, confidence) of the spans of one text, by the best path; the
        confidence is the mean posterior of the span's words."""
        words = list(_WORD.finditer(text))
        if not words:
            return []
        rows = np.array(self._ids([m.group() for m in words]))
        scores, foreign = self.table[rows], self.foreign[rows]
        best, back = np.zeros(len(self.langs)), []
        for t in range(len(words)):
            top = int(best.argmax())
            switch = best[top] - (SWITCH if t else 0.0)
            stay = best >= switch
            back.append(np.where(stay, np.arange(len(best)), top))
            best = np.where(stay, best, switch) + scores[t]
        post = self.shares[rows]
        k, out = int(best.argmax()), []
        for t in range(len(words) - 1, -1, -1):
            a, b = words[t].span()
            lang, p = (UNKNOWN, 1.0) if foreign[t] else (self.langs[k], float(post[t, k]))
            if out and out[-1][2] == lang:
                out[-1] = (a, out[-1][1], lang, out[-1][3] + p, out[-1][4] + 1)
            else:
                out.append((a, b, lang, p, 1))
            k = int(back[t][k])
        return [(a, b, lang, round(p / n, 4)) for a, b, lang, p, n in reversed(out)]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of the spans of one text."""
        return [x[:3] for x in self.segments(text)]


def primary_subtag(label: str | None) -> str:
    """The language of a label, without case, blanks, region and script."""
    return re.split(r"[-_\s]", (label or "").strip().lower(), maxsplit=1)[0]


def labelled_samples(lang_samples: DataFrame, limit: int = 20_000) -> list[tuple[str, str]]:
    """Training texts; a bounded, fixed table of labelled samples."""
    rows = lang_samples.where("text is not null and lang is not null").orderBy("sample_id").limit(limit).collect()
    return [(primary_subtag(r["lang"]), r["text"]) for r in rows]


#: Words up to which a model is kept for the next task of its process.
KEEP_WORDS = 100_000
_KEPT: list[tuple[list[tuple[str, str]], LanguageModel, dict[str, tuple]]] = []


class _Labeller:
    """Adds to a page summary what languages its texts are in."""

    def __init__(self, samples: list[tuple[str, str]], segments: bool = False):
        self.samples, self.segments = samples, segments

    def __getstate__(self):
        return {"samples": self.samples, "segments": self.segments}

    def __call__(self, finder: Finder, batch: list[tuple[Page, list[int], dict]]) -> list[tuple]:
        if not hasattr(self, "model"):
            # those of the task before in this process, unless they are of other samples or large
            if not (_KEPT and _KEPT[0][0] == self.samples and len(_KEPT[0][1].rows) < KEEP_WORDS):
                _KEPT[:] = [(self.samples, LanguageModel(self.samples), {})]
            self.model: LanguageModel = _KEPT[0][1]
            self.known: dict[str, tuple] = _KEPT[0][2]
        todo = []
        for page, pos, residue in batch:
            at = [k for k, i in enumerate(pos) if page.names[i] is None and page.data[i] and not page.in_code[i] and i not in residue and not page.raw(i)]
            texts = [page.data[pos[k]] for k in at]
            odd = [k for k, t in enumerate(texts) if not t.isascii()]
            for k, r in zip(odd, finder.fixer.repair_all([texts[k] for k in odd]), strict=True):
                if r:
                    texts[k] = r[0]
            todo.append((page, at, texts))
        # short texts, as menus have them, come again and again
        known = self.known
        new = list(dict.fromkeys(t for _, _, texts in todo for t in texts if t not in known))
        # of the letters only the languages that have any
        seen = {t: ([x for x in enumerate(letters) if x[1]], post, n, len(t)) for t, (letters, post, n) in zip(new, self.model.label(new), strict=True)}
        out = []
        for page, at, texts in todo:
            html = next((i for i, n in enumerate(page.names) if n == "html"), None)
            label = page.attr(html, "lang") if html is not None else None
            info = [known[t] if t in known else seen[t] for t in texts]
            if self.segments:
                info = [self.model.segments(t) for t in texts]
            out.append((page.ids[html] if html is not None else None, label, at, info))
        if len(known) > 100_000:
            known.clear()
        known.update((t, x) for t, x in seen.items() if len(t) < 160)
        return out


def _labels(langs: list[str]):
    names = [*langs, UNKNOWN]

    def rows(block: Block, parsed):
        for k, (pid, _, ids, _, _, _, _, _, (html, label, at, info)) in enumerate(parsed):
            gone, ids = block.removed(k), ids.tolist()
            main = [(ids[j], x) for j, x in zip(at, info, strict=True) if not gone[j]]
            letters = [0.0] * (len(langs) + 1)
            post = 0.0
            for _, (by, p, n, _) in main:
                for i, x in by:
                    letters[i] += x
                post += p * n
            total = sum(letters)
            if total <= 0:
                continue
            top = max(range(len(letters)), key=lambda i: (letters[i], -i))
            page_lang = names[top]
            if html is not None:
                yield pid, html, page_lang, round(letters[top] / total * post / total, 4), "unknown" if page_lang == UNKNOWN else "page" if primary_subtag(label) != page_lang else "right"
            for node, (by, p, n, chars) in main:
                if n > 0:
                    best, most = max(by, key=lambda x: (x[1], -x[0]))
                    whole = most >= WHOLE * n
                    kind = "unknown" if names[best] == UNKNOWN else "text" if best != top and whole and chars >= MIN_CHARS else "same" if best == top else "part"
                    yield pid, node, names[best], round(p * most / n, 4), kind

    return rows


def language_labels(nodes: DataFrame, pages: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(page_id, node_id, lang, confidence, kind) for the html element of each page with
    a main body, and for each text of the main body. ``kind`` is ``page`` where the
    label is missing or wrong and ``right`` where it is right; ``text`` where a text
    of MIN_CHARS or more is wholly in another language than the page's, ``same`` where
    it is in the page's, ``part`` otherwise; ``unknown`` (with the language ``und``) where
    it is in a script of no language of the samples. Pages whose main body has no letters, or
    only residue, give no rows; repeated rows count once."""
    samples = labelled_samples(lang_samples)
    langs = sorted({k for k, _ in samples})
    return map_blocks(page_blocks(nodes, pages, lang_samples, _Labeller(samples)), _labels(langs), "page_id bigint, node_id int, lang string, confidence double, kind string")


def language_segments(nodes: DataFrame, pages: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(page_id, node_id, start_char, end_char, lang, confidence): the spans of one language of
    each text of a page's main body, from the first to the last letter; offsets are those
    of the content, restored where it was damaged. Texts without letters give none."""
    samples = labelled_samples(lang_samples)

    def rows(block: Block, parsed):
        for k, (pid, _, ids, _, _, _, _, _, (_, _, at, found)) in enumerate(parsed):
            gone, ids = block.removed(k), ids.tolist()
            for j, spans in zip(at, found, strict=True):
                if not gone[j]:
                    for a, b, lang, p in spans:
                        yield pid, ids[j], a, b, lang, p

    return map_blocks(page_blocks(nodes, pages, lang_samples, _Labeller(samples, True)), rows, "page_id bigint, node_id int, start_char int, end_char int, lang string, confidence double")


def text_spans(texts: DataFrame, lang_samples: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_char, end_char, lang, confidence): spans of one language in each text;
    null, empty and wordless texts give none."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    samples = labelled_samples(lang_samples)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(samples)
        for batch in batches:
            rows, spans = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for s in model.segments(t or ""):
                    rows.append(i)
                    spans.append(s)
            a, b, c, p = zip(*spans, strict=True) if spans else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(p, pa.float64())], names=["k", "a", "b", "c", "p"])

    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, a bigint, b bigint, c string, p double").toDF(key, "start_char", "end_char", "lang", "confidence")
