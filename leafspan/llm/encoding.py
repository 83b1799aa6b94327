"""Problem 4: text decoded from its bytes with the wrong encoding.

Method: noisy-channel decoding. For a text the bytes it was decoded from are rebuilt
under each encoding that could have been used wrongly, and read again under each that
could have been right. Where a byte was lost (U+FFFD, or ``?`` inside a word) the bytes
are a lattice with a wildcard there: every sequence of bytes that fits and that the right
encoding reads as letters of correct text is a path, and Viterbi search over characters
finds the best paths, which the corpus frequencies of their words then order. Words the
corpus doesn't know are backed by a character model. A text is damaged if some channel
explains it clearly better than no channel; how clearly depends on how much damage its
endpoint has. Everything is memoised by chunk (the characters between ASCII blanks), of
which a corpus has few distinct ones outside ASCII.
"""

from __future__ import annotations

import math
import re
from codecs import charmap_decode
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: single-byte encodings of the public standards that web pages use
SINGLE = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "cp852", "mac_roman", "mac_latin2", "mac_cyrillic", "iso8859-15", "iso8859-5", "cp1254", "koi8-u")
# signs that correct text of any language may hold
COMMON_SIGNS = "©®™°·•–—…‘’‚“”„«»‹›€£§¿¡ºª→×½¼²³№"
# encodings that pages seldom have; a channel with one costs more
RARE = frozenset(("mac_latin2", "mac_cyrillic", "koi8-u", "iso8859-5", "cp1254", "iso8859-15", "cp852"))
# encodings of several bytes a character; those of Chinese, Japanese and Korean
SEVERAL = ("gb18030", "big5", "shift_jis", "euc_jp", "euc_kr")
LOST = "�"
#: Nats of a frequent character of such an encoding, of a rare one, and of the channel.
SEVERAL_FREQUENT, SEVERAL_RARE, SEVERAL_COST = 7.5, 14.0, 4.0
#: Nats of a wildcard that stands for a byte the wrong encoding has a character for.
DEFINED_BYTE = 6.0
#: Paths that a search keeps at each place, and that it hands on.
BEAM, BEST = 64, 8
#: Parts that endpoints are hashed to for their damage rates, a fixed bound of what is broadcast.
ENDPOINT_PARTS = 1 << 16
#: Vocabulary bound: the most frequent non-ASCII words of the corpus, counted over all of it.
MAX_WORDS = 200_000
MEMO_CHUNKS = 200_000
#: Nats by which a channel must beat the text as it stands.
PRIOR = 7.0
#: The same where other texts of the page are damaged by that channel, and where most are.
PRIOR_ON_PAGE, PRIOR_ON_BAD_PAGE = 2.5, -4.5
#: Nats that a chunk costs which a channel can't have made.
UNMADE = 6.0

_WORD = re.compile(r"[^\W\d_]+")
#: A word with a character outside ASCII, or one sign outside ASCII.
_FOREIGN_WORD = re.compile(r"[^\W\d_]*[^\x00-\x7f\W\d_][^\W\d_]*|[^\x00-\x7f\w]")
_ODD = re.compile(r"[^\x00-\x7f" + COMMON_SIGNS + "]")
#: A sign within a word, where only apostrophes belong.
_SIGN_IN_WORD = re.compile(r"[^\W\d_][" + COMMON_SIGNS.replace("’", "").replace("º", "").replace("ª", "") + r"][^\W\d_]")
_C1 = re.compile("[\x80-\x9f]")
_CHUNK = re.compile(r"[^ \t\r\n\x0b\x0c]+")
_NON_ASCII = re.compile(r"[^\x00-\x7f]")
#: A question mark in a word, or behind one within a sentence.
_ASKED = re.compile(r"[^\W\d_]\?(?:[^\W\d_]|\s[a-zà-ÿ])|(?<!\S)\?[^\W\d_]")
_WIDE = "\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3"
#: Characters that two bytes of such an encoding, or more, come out as.
_PAIRS = re.compile("[\x80-\xff" + "".join(c for c in bytes(range(128, 160)).decode("cp1252", "ignore")) + "]{4}")
_WIDE_IN_LATIN = re.compile(f"[A-Za-z][{_WIDE}]|[{_WIDE}][A-Za-z]")
_WIDE_WORD = re.compile(f"[{_WIDE}]{{2}}")
_ASKED_WORD = re.compile(r"(?<![\w?/=&.])(?:[^\W\d_]|\?(?=[^\W\d_]))+(?:\?(?=\s[a-zà-ÿ]))?(?![\w/=&])")


def _to_bytes(enc: str) -> dict[int, int]:
    """Code point -> byte, where bytes an encoding leaves open are C1 controls."""
    out = {}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(enc)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ord(ch), b)
    for b in range(128, 160):
        out.setdefault(b, b)
    return out


_BYTES = {e: _to_bytes(e) for e in SINGLE}
_CHARS = {e: "".join(map(chr, range(128))) + "".join(bytes([b]).decode(e, "replace") for b in range(128, 256)) for e in SINGLE}
#: What each byte is read as; bytes an encoding leaves open are C1 controls.
_FIXED = {e: "".join(c if c != LOST else chr(b) for b, c in enumerate(_CHARS[e])) for e in SINGLE}


def _translation(enc: str) -> dict[int, str]:
    """To characters below 256 that stand for bytes; what has no byte goes beyond."""
    out = dict.fromkeys(range(128, 256), "\uffff")
    out.update((o, chr(b)) for o, b in _BYTES[enc].items())
    return out


_TRANSLATE = {e: _translation(e) for e in SINGLE}


def _bytes_of(text: str, wrong: str) -> bytes | None:
    try:
        return text.translate(_TRANSLATE[wrong]).encode("latin-1")
    except UnicodeEncodeError:
        return None


def undo(text: str, wrong: str, right: str) -> str | None:
    """The text whose bytes in ``right``, read as ``wrong``, give ``text``; None if
    there is none. A no-break space that was turned into a blank is tried as a byte."""
    raw = _bytes_of(text, wrong)
    if raw is None:
        return None
    if right == "utf-8":
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
    return charmap_decode(raw, "strict", _FIXED[right])[0]


class SampleCounts:
    """What the character model and the lost bytes need of correct texts: how often each three
    characters in a row and each word outside ASCII occur. Counts of parts of the texts
    add up to those of all."""

    def __init__(self, texts: Iterable[str] = ()):
        self.tri: Counter = Counter()
        self.words: Counter = Counter()
        self.add(texts)

    def add(self, texts: Iterable[str]) -> None:
        chunks: Counter = Counter()
        for t in texts:
            chunks.update(_CHUNK.findall(t))
        for w, k in chunks.items():
            for v in (w, w.lower()):
                s = "  " + v + " "
                for i in range(2, len(s)):
                    self.tri[s[i - 2 : i + 1]] += k
            if not w.isascii():
                for v in _FOREIGN_WORD.findall(w):
                    self.words[v] += k


class CharModel:
    """Order-2 character model of correct text, with add-alpha smoothing."""

    def __init__(self, tri: Counter, signs: Iterable[str] = (), alpha: float = 0.02):
        bi: Counter = Counter()
        for t, n in tri.items():
            bi[t[:2]] += n
        chars = set().union(*tri)
        self.sound = frozenset(tri)  # what correct text surely has
        self.tri, self.bi, self.alpha, self.size = tri, bi, alpha, len(chars) + 400
        self.chars = chars | set(signs)
        self.memo: dict[str, float] = {}
        self.logs: dict[str, float] = {}

    def _log(self, three: str) -> float:
        got = math.log((self.tri.get(three, 0) + self.alpha) / (self.bi.get(three[:2], 0) + self.alpha * self.size))
        if len(self.logs) < MEMO_CHUNKS:
            self.logs[three] = got
        return got

    def score(self, chunk: str, floor: float = -math.inf) -> float:
        """Log score of a chunk; minus infinity if it is not above ``floor``, as a score only
        falls from one character to the next."""
        got = self.memo.get(chunk)
        if got is None:
            s = "  " + chunk + " "
            got, logs, chars = 0.0, self.logs, self.chars
            for i in range(2, len(s)):
                three = s[i - 2 : i + 1]
                got += logs[three] if three in logs else self._log(three)
                if s[i] > "\x7f" and s[i] not in chars:
                    got -= 2.5 if s[i].isalnum() else 3.5
                if got <= floor:
                    return -math.inf
            if len(self.memo) < MEMO_CHUNKS:
                self.memo[chunk] = got
        return got


class Repairer:
    """Finds and undoes wrong decodings. ``words`` are corpus counts of words outside
    ASCII; ``samples`` correct texts for the character model, or the counts of such."""

    CHANNELS = [(w, "utf-8") for w in SINGLE] + [(w, r) for r in SINGLE for w in SINGLE if w != r]
    BY_WRONG = {e: [] for e in SINGLE}
    for _i, (_w, _r) in enumerate(CHANNELS):
        BY_WRONG[_w].append((_i, _r))
    BY_NAME = {">".join(c[::-1]): i for i, c in enumerate(CHANNELS)}
    COST = [(0.0 if r == "utf-8" else 2.0) + 2.0 * (w in RARE) + 2.0 * (r in RARE) for w, r in CHANNELS]

    def __init__(self, samples: Iterable[str] | SampleCounts, words: dict[str, int] | None = None, more: Iterable[str] = ()):
        if not isinstance(samples, SampleCounts):
            samples = SampleCounts(samples)
        self.words = words or {}
        self.model = CharModel(samples.tri, COMMON_SIGNS)
        self.log_total = math.log(sum(self.words.values()) + 1.0)
        self.skeleton: dict[str, list[tuple[str, int]]] = {}
        # words that lost bytes may have stood for: those of the corpus, or else of the samples and ``more``
        known = self.words or samples.words + Counter(w for t in more for w in _FOREIGN_WORD.findall(t))
        if not self.words:
            self.log_total = math.log(sum(known.values()) + 1.0)
        for w, n in known.items():
            if not w[0].isalpha():
                continue
            self.skeleton.setdefault(_NON_ASCII.sub(LOST, w), []).append((w, n))
        for v in self.skeleton.values():
            v.sort(key=lambda x: (-x[1] * math.exp(0.2 * self.model.score(x[0])), x[0]))
        self.fits: dict[str, list[tuple[str, int]]] = {}
        # letters and signs outside ASCII that correct text has, and their bytes
        known = {c for c in self.model.chars if c > "\x7f"}
        self.alphabet = sorted(known | {c.upper() for c in known if len(c.upper()) == 1})
        self.in_utf8 = [(c, c.encode()) for c in self.alphabet]
        self.paths: dict[tuple[str, int], tuple[float, str] | None] = {}
        self.bases: dict[str, tuple[float, float]] = {}
        self.ceilings: dict[str, float] = {}
        self.ones: dict[str, dict[int, float | None]] = {}
        self.n_ones = 0
        self.memo: dict[str, dict[int, tuple[float, str]]] = {}
        self.by_text: dict[str, tuple[str, str] | None] = {}

    # ------------------------------------------------------------ word scores
    def score(self, chunk: str, floor: float = -math.inf) -> float:
        """Log score of a chunk as correct text: its characters, and the corpus
        frequency of its words and signs outside ASCII. Without corpus words minus infinity
        if not above ``floor``."""
        known = self.words
        if not known:
            return self.model.score(chunk, floor)
        s = 0.0
        for m in _FOREIGN_WORD.finditer(chunk):
            w = m.group()
            n = known.get(w) or 0.5 * known.get(w.lower(), 0)
            if len(w) == 1 and w != "’" and not w.isalpha() and chunk[m.start() - 1 : m.start()].isalpha() and chunk[m.end() : m.end() + 1].isalpha():
                n = 0  # a sign within a word, however frequent elsewhere
            s += math.log(n + 0.02) - self.log_total
        if len(chunk) == 1:
            return s
        return 0.6 * s + self.model.score(chunk)

    def _base(self, chunk: str) -> tuple[float, float]:
        """(score, doubt): 0 if the surroundings of each character outside ASCII occur
        in correct text, else minus the mean score of a character."""
        got = self.bases.get(chunk)
        if got is None:
            if not _ODD.search(chunk) and not _SIGN_IN_WORD.search(chunk):
                got = (self.score(chunk), 0.0)
            else:
                s, tri = "  " + chunk + " ", self.model.sound
                ok = all(s[i - 2 : i + 1] in tri for i in range(2, len(s)) if not s[i - 2 : i + 1].isascii())
                got = (self.score(chunk), 0.0 if ok else -self.model.score(chunk) / len(chunk))
            if len(self.bases) < MEMO_CHUNKS:
                self.bases[chunk] = got
        return got

    def _ceiling(self, chunk: str) -> float:
        """What no channel makes a chunk score more than: the log score of its ASCII characters
        beside each other, which all channels leave as they are."""
        got = self.ceilings.get(chunk)
        if got is None:
            s, logs = "  " + chunk + " ", self.model.logs
            got = sum(logs[three] if three in logs else self.model._log(three) for i in range(2, len(s)) if (three := s[i - 2 : i + 1]).isascii())
            if len(self.ceilings) < MEMO_CHUNKS:
                self.ceilings[chunk] = got
        return got

    def _chunk(self, chunk: str) -> dict[int, tuple[float, str]]:
        """(score, text) by channel, of those that score above the chunk as it stands."""
        got = self.memo.get(chunk)
        if got is None:
            got = {}
            floor = self._base(chunk)[0]
            raws = {w: r for w in SINGLE if (r := _bytes_of(chunk, w)) is not None}
            scores: dict[str, float] = {}
            for wrong, raw in raws.items():
                for i, right in self.BY_WRONG[wrong]:
                    if right == "utf-8":
                        try:
                            fixed = raw.decode("utf-8")
                        except UnicodeDecodeError:
                            continue
                    else:
                        fixed = charmap_decode(raw, "strict", _FIXED[right])[0]
                    if fixed not in scores:
                        scores[fixed] = self.score(fixed, floor)
                    if scores[fixed] > floor:
                        got[i] = (scores[fixed], fixed)
            if len(self.memo) < MEMO_CHUNKS:
                self.memo[chunk] = got
        return got

    def gains(self, text: str, only: int | None = None, bar: float = -math.inf) -> dict[int, float]:
        """For each channel that explains the text, its gain in nats over the text as it
        stands; a chunk that the channel can't have made (it may have come as a
        character reference) costs UNMADE. Empty at once if every chunk looks correct; without
        channels that can't gain as much as ``bar``. With ``only`` that channel is tried
        whatever the text looks like."""
        if only is not None:
            total = 0.0
            counts = Counter(filterfalse(str.isascii, _CHUNK.findall(text)))
            most = {c: n * (self._ceiling(c) - self._base(c)[0]) for c, n in counts.items()}
            rest = sum(most.values())
            for c in sorted(most, key=most.get, reverse=True):
                rest -= most[c]
                f = self._one(c, only)
                total += -UNMADE if f is None else counts[c] * (f - self._base(c)[0])
                if total + rest < bar - 1e-6:
                    return {}
            return {only: total}
        if not _ODD.search(text) and not _SIGN_IN_WORD.search(text):
            return {}
        counts = Counter(filterfalse(str.isascii, _CHUNK.findall(text)))
        bases = {c: self._base(c) for c in counts}
        doubt, worst = max([(b[1], c) for c, b in bases.items()])
        if doubt <= 0:
            return {}
        # the most doubtful chunk says which channels come into question
        base = bases[worst][0]
        n = counts.pop(worst)
        total = {i: n * (s - base) - self.COST[i] for i, (s, _) in self._chunk(worst).items() if s - base > 0.5}
        # a fixed chunk scores no more than what channels leave of it, so none can gain more on the rest than this
        most = {c: n * (self._ceiling(c) - bases[c][0]) for c, n in counts.items()} if total else {}
        rest = sum(most.values())
        bar -= 1e-6  # what rounding may take from a sum
        total = {i: g for i, g in total.items() if g + rest >= bar}
        for c in sorted(most, key=most.get, reverse=True):
            if not total:
                break
            base, n, step, known = bases[c][0], counts[c], {}, self.ones.get(c, {})
            rest -= most[c]
            for i, g in total.items():
                f = known[i] if i in known else self._one(c, i)
                g += -UNMADE if f is None else n * (f - base)
                if g + rest >= bar:
                    step[i] = g
            total = step
        return total

    def _one(self, chunk: str, channel: int) -> float | None:
        known = self.ones.get(chunk)
        if known is None or channel not in known:
            fixed = undo(chunk, *self.CHANNELS[channel])
            if self.n_ones > 4 * MEMO_CHUNKS:
                self.ones.clear()
                self.n_ones = 0
            self.n_ones += 1
            known = self.ones.setdefault(chunk, {})
            known[channel] = None if fixed is None else self.score(fixed)
        return known[channel]

    def best_channel(self, text: str, bar: float = -math.inf) -> tuple[int, float]:
        """(channel, gain); -1 if none applies or gains as much as ``bar``."""
        total = self.gains(text, bar=bar)
        if not total:
            return -1, 0.0
        i = max(total, key=lambda k: (total[k], -k))
        return i, total[i]

    def apply(self, text: str, channel: int) -> str:
        wrong, right = self.CHANNELS[channel]

        def fix(m):
            c = m.group()
            return c if c.isascii() else (undo(c, wrong, right) or c)

        return _CHUNK.sub(fix, text)

    # ---------------------------------------------------------- lost bytes
    def fill(self, chunk: str) -> str:
        """Viterbi over a chunk with wildcards: words of the corpus that fit, signs
        for wildcards outside words, each at its log frequency."""
        n = len(chunk)
        best: list[tuple[float, str]] = [(-1e18, "")] * (n + 1)
        best[0] = (0.0, "")
        for i in range(n):
            score, done = best[i]
            if score <= -1e17:
                continue

            def go(j: int, s: float, out: str, score=score, done=done):
                if score + s > best[j][0]:
                    best[j] = (score + s, done + out)

            c = chunk[i]
            if c == LOST:
                opening = i == 0 or not (chunk[i - 1].isalnum() or chunk[i - 1] == LOST)
                nxt = chunk[i + 1] if i + 1 < n else " "
                sign = "’" if (not opening and nxt.isalpha()) else ("“" if opening else "”")
                if n == 1:
                    sign = "–"
                go(i + 1, -9.0, sign)
                go(i + 1, -14.0, LOST)
            else:
                go(i + 1, -0.01 if not c.isalpha() else -3.0, c)
            if c.isalpha() or c == LOST:
                j = i
                while j < n and (chunk[j].isalpha() or chunk[j] == LOST):
                    j += 1
                    piece = chunk[i:j]
                    edge = (i == 0 or not chunk[i - 1].isalpha()) and (j == n or not chunk[j].isalpha())
                    if not edge:
                        continue
                    if piece == LOST:
                        continue
                    if LOST not in piece:
                        go(j, -0.5, piece)
                        continue
                    for low in (piece, piece[:1].lower() + piece[1:], piece.lower()):
                        for w, k in self._fitting(low):
                            w2 = w if low == piece else (w.upper() if piece[1:].isupper() else w[:1].upper() + w[1:])
                            go(j, math.log(k + 1.0) - self.log_total - (0.0 if low == piece else 0.5), w2)
        return best[n][1]

    def _fitting(self, piece: str) -> list[tuple[str, int]]:
        """The words of the corpus that a piece with wildcards can stand for, best first; of
        all that fit, those that can win."""
        got = self.fits.get(piece)
        if got is None:
            words = self.skeleton.get(_NON_ASCII.sub(LOST, piece), ())
            got = [x for x in words if all(a == b or a == LOST for a, b in zip(piece, x[0], strict=True))][:BEST]
            if len(self.fits) < MEMO_CHUNKS:
                self.fits[piece] = got
        return got

    # ---------------------------------------------------------- byte lattice
    def lattice(self, chunk: str, channel: int) -> tuple[float, str] | None:
        """(score, text) of the best reading of a chunk with lost bytes under a channel, None
        if the channel can't have made it. Characters that have no byte in the wrong
        encoding stay as they are, at a cost."""
        key = (chunk, channel)
        if key in self.paths:
            return self.paths[key]
        wrong, right = self.CHANNELS[channel]
        table, chars = _BYTES[wrong], _CHARS[wrong]
        byte = [None if c == LOST else ord(c) if c < "\x80" else table.get(ord(c), -1) for c in chunk]
        n = len(byte)
        free = [chars[b] == LOST for b in range(256)]  # bytes the wrong encoding leaves open are those that get lost

        def steps(i: int) -> list[tuple[int, str, float]]:
            b = byte[i]
            if b == -1:
                return [(i + 1, chunk[i], -UNMADE)]
            if b is not None and b < 128:
                return [(i + 1, chunk[i], 0.0)]
            if right != "utf-8":
                if b is not None:
                    return [(i + 1, _CHARS[right][b], 0.0)] if _CHARS[right][b] != LOST else []
                return [(i + 1, c, 0.0 if free[v] else -DEFINED_BYTE) for c in self.alphabet if (v := _BYTES[right].get(ord(c))) is not None]
            out = []
            for c, raw in self.in_utf8:
                j = i + len(raw)
                if j <= n and all(x is None or x == v for x, v in zip(byte[i:j], raw, strict=True)):
                    out.append((j, c, -DEFINED_BYTE * sum(x is None and not free[v] for x, v in zip(byte[i:j], raw, strict=True))))
            return out

        # states at a place: the last two characters -> (score, text, what its bytes cost)
        at: list[dict[str, tuple[float, str, float]]] = [{} for _ in range(n + 1)]
        at[0]["  "] = (0.0, "", 0.0)
        tri, bi, alpha, total = self.model.tri, self.model.bi, self.model.alpha, self.model.alpha * self.model.size
        for i in range(n):
            here = sorted(at[i].items(), key=lambda x: -x[1][0])[:BEAM]
            if not here:
                continue
            for j, c, cost in steps(i):
                for last, (score, text, paid) in here:
                    s = score + cost + math.log((tri.get(last + c, 0) + alpha) / (bi.get(last, 0) + total))
                    state = last[1] + c
                    if state not in at[j] or s > at[j][state][0]:
                        at[j][state] = (s, text + c, paid + cost)
        ends = sorted(at[n].values(), reverse=True)[:BEST]
        # the corpus frequencies of the words decide between the best paths
        got = max(((self.score(t) + paid, t) for _, t, paid in ends), default=None)
        if len(self.paths) < MEMO_CHUNKS:
            self.paths[key] = got
        return got

    def _lossy(self, text: str) -> tuple[str, str]:
        """A text with lost bytes, restored: under a channel if one explains its other
        characters better than they stand, else by the words that fit."""
        counts = Counter(filterfalse(str.isascii, _CHUNK.findall(text)))
        filled = {c: self.fill(c) for c in counts if LOST in c}
        whole = [c for c in counts if LOST not in c]
        odd = [c for c in filled if _ODD.search(c.replace(LOST, ""))]
        best, found = (0.0 if odd else PRIOR_ON_PAGE), None
        if odd or any(self._base(c)[1] > 0 for c in whole):
            base = {c: self.score(f) - 3.0 * (c.count(LOST) + f.count(LOST)) for c, f in filled.items()}
            for i, (_, right) in enumerate(self.CHANNELS):
                if right != "utf-8" and not any(_ODD.search(c) for c in whole):
                    continue
                gain = -self.COST[i]
                for c in whole:
                    f = self._one(c, i)
                    gain += counts[c] * (-UNMADE if f is None else f - self._base(c)[0])
                for c in odd:
                    f = self.lattice(c, i)
                    gain += counts[c] * (-UNMADE if f is None else max(-UNMADE, f[0] - base[c]))
                if gain > best:
                    best, found = gain, i
        if found is None:
            return _CHUNK.sub(lambda m: filled.get(m.group(), m.group()), text), "lost"

        def fix(m):
            c = m.group()
            if c in filled:
                path = self.lattice(c, found) if c in odd else None
                return path[1] if path else filled[c]
            return c if c.isascii() else (undo(c, *self.CHANNELS[found]) or c)

        return _CHUNK.sub(fix, text), "lost " + ">".join(self.CHANNELS[found][::-1])

    def _asked(self, text: str) -> tuple[str, str] | None:
        """A text in which ``?`` stands for lost bytes within words that the corpus has."""
        hits = 0

        def fix(m):
            nonlocal hits
            w = m.group()
            if "?" not in w or w.count("?") * 2 > len(w) or len(w) < 3:
                return w
            for low in (w, w[:1].lower() + w[1:], w.lower()):
                for word, k in self._fitting(low.replace("?", LOST)):
                    if k >= 2 and all(b > "\x7f" for a, b in zip(low, word, strict=True) if a == "?"):
                        hits += 1
                        return word if low == w else word.upper() if w[1:].isupper() else word[:1].upper() + word[1:]
            return w

        fixed = _ASKED_WORD.sub(fix, text)
        return (fixed, "lost") if hits else None

    def _several(self, text: str) -> tuple[float, str, str] | None:
        """(gain, text, channel) of the best encoding of several bytes a character that reads
        all of a text's characters outside ASCII, if they are mostly in pairs."""
        foreign = [c for c in text if c > "\x7f"]
        if len(foreign) < 4:
            return None
        best = None
        base = sum(self._base(c)[0] for c in _CHUNK.findall(text) if not c.isascii())
        for wrong in ("cp1252", "latin-1"):
            raw = _bytes_of(text, wrong)
            for right in SEVERAL if raw is not None else ():
                try:
                    fixed = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                new = [c for c in fixed if c > "\x7f"]
                wide = [c for c in new if "\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7a3"]
                # such text has words of it, and no Latin letters within them
                if 2 * len(wide) < len(new) or len(new) * 3 > len(foreign) * 2 or _WIDE_IN_LATIN.search(fixed) or not _WIDE_WORD.search(fixed):
                    continue
                cost = sum(SEVERAL_FREQUENT if _frequent(c, right) else SEVERAL_RARE for c in new)
                gain = -cost - base - SEVERAL_COST
                if gain > (best[0] if best else 0.0):
                    best = (gain, fixed, f"{right}>{wrong}")
        return best

    # ------------------------------------------------------------- texts
    def repair(self, text: str) -> tuple[str, str] | None:
        """(restored text, channel) for a damaged text, None for a sound one. What
        cannot be recovered stays as U+FFFD in the restored text."""
        if text.isascii() and "?" not in text:
            return None
        if text in self.by_text:
            return self.by_text[text]
        out = self._repair(text)
        if len(self.by_text) < MEMO_CHUNKS:
            self.by_text[text] = out
        return out

    def _repair(self, text: str, depth: int = 0, only: int | None = None, bar: float = 0.0, shift: float = 0.0) -> tuple[str, str] | None:
        if LOST in text:
            return self._lossy(text)
        if text.isascii():
            return self._asked(text) if "?" in text and _ASKED.search(text) else None
        if only is None:
            # C1 controls stand in no correct text
            least = 0.0 if _C1.search(text) else PRIOR - shift
            channel, gain = self.best_channel(text, least)
            several = self._several(text) if _PAIRS.search(text) else None
            if several and several[0] > max(gain, PRIOR - shift):
                return several[1], several[2]
            if channel < 0 or gain < least:
                if _C1.search(text) and not depth:
                    return text, "unknown"
                return self._asked(text) if "?" in text and _ASKED.search(text) else None
        else:
            channel, gain = only, self.gains(text, only, bar).get(only, -math.inf)
            if gain < bar:
                return None
        fixed = self.apply(text, channel)
        if fixed == text:
            return None
        name = ">".join(self.CHANNELS[channel][::-1])
        if depth < 2:
            again = self._repair(fixed, depth + 1) if not fixed.isascii() else None
            if again:
                return again[0], again[1] + " " + name
        return fixed, name

    def repair_all(self, texts: list[str], shift: float = 0.0) -> list[tuple[str, str] | None]:
        """``repair`` of the texts of one page. The channels found on the page are then
        tried, the most frequent first, with a lower bar, on those that a lone look leaves
        in doubt. ``shift`` is what the page's endpoint says for damage, in nats."""
        out = [self.repair(t) for t in texts]
        if shift > 0:
            out = [r or (None if t.isascii() else self._repair(t, shift=shift)) for r, t in zip(out, texts, strict=True)]
        names = Counter(name for r in out if r and (name := r[1].rpartition(" ")[2]) in self.BY_NAME)
        if names:
            for i, t in enumerate(texts):
                if out[i] is None and not t.isascii():
                    for name, n in names.most_common():
                        out[i] = self._repair(t, 0, self.BY_NAME[name], PRIOR_ON_BAD_PAGE if 2 * n >= len(texts) else PRIOR_ON_PAGE)
                        if out[i]:
                            break
        return out


def _frequent(c: str, encoding: str) -> bool:
    """Whether a character is among the frequent ones of an encoding: kana, and what its
    standard puts into the first of its levels."""
    if c in "。，、・ー「」（）！？：；":
        return True
    if "\u3040" <= c <= "\u30ff":
        return encoding in ("shift_jis", "euc_jp")
    try:
        lead = c.encode(encoding)[0]
    except UnicodeEncodeError:
        return False
    # fixed values: lead bytes of the first level in each standard
    low, high = {"gb18030": (0xB0, 0xD7), "big5": (0xA4, 0xC6), "shift_jis": (0x88, 0x97), "euc_jp": (0xB0, 0xCF), "euc_kr": (0xB0, 0xC8)}[encoding]
    return low <= lead <= high


# ------------------------------------------------------------------- operators
def endpoint_shifts(nodes: DataFrame) -> np.ndarray:
    """For each of ENDPOINT_PARTS hash values of endpoints the log odds that a text of such
    an endpoint is damaged, against all texts, by signs that correct text never has;
    counted over all rows. Between -1 and 2."""
    sign = F.col("content").rlike("[\x80-\x9f\ufffd]|[\u00c2-\u00c5\u00d0\u00d1][\u00a0-\u00bf]")
    part = F.pmod(F.xxhash64("endpoint_id"), F.lit(ENDPOINT_PARTS)).cast("int")
    rows = nodes.where("kind = 'text' and endpoint_id is not null and octet_length(content) <> char_length(content)").groupBy(part.alias("part"))
    hit, seen = np.zeros(ENDPOINT_PARTS), np.zeros(ENDPOINT_PARTS)
    for r in rows.agg(F.count(F.when(sign, 1)).alias("hit"), F.count(F.lit(1)).alias("seen")).collect():  # ENDPOINT_PARTS rows at most
        hit[r["part"]], seen[r["part"]] = r["hit"], r["seen"]
    mean = min(0.5, max(1e-4, float(hit.sum() / max(1.0, seen.sum()))))
    rate = (hit + 50 * mean) / (seen + 50)
    return np.clip(np.log(rate / (1.0 - np.minimum(rate, 0.999))) - math.log(mean / (1 - mean)), -1.0, 2.0).astype(np.float32)


def foreign_word_counts(nodes: DataFrame, content: str = "content") -> DataFrame:
    """(word, n): how often each word with characters outside ASCII occurs in the text
    nodes, over all rows. Counted per partition before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: Counter = Counter()

        def out():
            counts: Counter = Counter()
            for c, n in chunks.items():
                for w in _FOREIGN_WORD.findall(c):
                    counts[w] += n
            chunks.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t.isascii():
                    chunks.update([c for c in t.split() if not c.isascii()])
            if len(chunks) > 500_000:
                yield out()
        if chunks:
            yield out()

    rows = nodes.where("kind = 'text' and octet_length(content) <> char_length(content)").select(content)
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(nodes: DataFrame, max_words: int = MAX_WORDS) -> dict[str, int]:
    """The ``max_words`` most frequent of them; the bound is the model's size."""
    top = foreign_word_counts(nodes).where("n >= 2 and length(word) <= 40").orderBy(F.desc("n"), "word").limit(max_words)
    return {r["word"]: r["n"] for r in top.toLocalIterator()}


def sample_counts(lang_samples: DataFrame, text: str = "text") -> SampleCounts:
    """Counts over all rows of the labelled samples, added up per partition before the shuffle;
    of the size of the models made of them, however many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = SampleCounts()

        def out():
            keys = [*counts.tri, *counts.words]
            whole = [False] * len(counts.tri) + [True] * len(counts.words)
            return pa.RecordBatch.from_arrays([pa.array(whole, pa.bool_()), pa.array(keys, pa.string()), pa.array([*counts.tri.values(), *counts.words.values()], pa.int64())], names=["whole", "key", "n"])

        for batch in batches:
            counts.add(batch.column(0).to_pylist())
            if len(counts.tri) + len(counts.words) > 500_000:
                yield out()
                counts = SampleCounts()
        yield out()

    rows = lang_samples.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "whole boolean, key string, n bigint")
    found = SampleCounts()
    for r in rows.groupBy("whole", "key").agg(F.sum("n").alias("n")).collect():
        (found.words if r["whole"] else found.tri)[r["key"]] = r["n"]
    return found


def _rows(pages, samples, words, shifts):
    fixer = Repairer(samples, words)
    for page in pages:
        at = [i for i, n in enumerate(page.names) if n is None and page.data[i] and not page.raw(i)]
        shift = 0.0 if page.part is None else float(shifts[page.part])
        for i, r in zip(at, fixer.repair_all([page.data[i] for i in at], shift), strict=True):
            if r:
                yield page.page_id, page.ids[i], r[0], r[1]


def damaged_nodes(nodes: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(page_id, node_id, restored, channel): text nodes whose content differs from
    what was written, with the text restored where it can be (what can't stays as
    U+FFFD); text of script and style is left out. Null, empty and ASCII contents
    without a ``?`` in a word are never damaged; repeated rows count once."""
    from .pages import map_pages, page_chunks

    spark = nodes.sparkSession
    model = spark.sparkContext.broadcast((sample_counts(lang_samples), vocabulary(nodes), endpoint_shifts(nodes)))
    # text outside ASCII or with a question mark in a word, and the elements whose text doesn't count
    needed = nodes.where(F.expr("(kind = 'text' and octet_length(content) <> char_length(content)) or local_name in ('script', 'style')") | (F.col("kind").eqNullSafe("text") & F.col("content").rlike(r"[A-Za-z]\?(?:[A-Za-z]|\s[a-z])")))
    # the endpoint goes along as the part it is hashed to
    needed = needed.withColumn("endpoint_id", F.pmod(F.xxhash64("endpoint_id"), F.lit(ENDPOINT_PARTS)).cast("string"))
    return map_pages(page_chunks(needed, attributes=False), lambda pages: _rows(_parts(pages), *model.value), "page_id bigint, node_id int, restored string, channel string")


def _parts(pages):
    for page in pages:
        page.part = int(page.endpoint) if page.endpoint else None
        yield page
