"""Problem 8: personal information inside free text.

Method: offset-preserving deobfuscation. A transducer rewrites a source text to
a normal form: TeX accents become letters, ties and line ends become blanks,
``(at)``/``DOT`` disguises become ``@`` and ``.``, homoglyphs, full-width forms
and spelled digits become what they stand for, invisible characters vanish. It
keeps a table of the places where lengths differ, so that a span of the normal
form maps back to the exact source characters. Detectors run on the normal form
only: e-mail addresses, telephone numbers, identity numbers, street addresses,
names of persons.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "idnum": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# ---------------------------------------------------------------- fixed values
# Given names, in several languages; names in a document's own author fields are added to them.
GIVEN_NAMES = frozenset("""
Adam Adrian Aisling Alan Alexander Alice Amara Amelie Ana Anders Andrea Andrew Anna Anne Anouk Barbara Benjamin Brigitte Bruno
Calvin Carlos Carmen Catherine Charles Christian Clara Claudia Daniel David Deborah Diana Dmitri Edith Elena Elin Elisa Elizabeth
Emil Emma Etienne Eva Fatima Felix Femi Frank Gabriel Georg George Greta Hakon Hanna Hans Henrik Hugo Ibrahim Ilse Ingrid Ivan
James Jan Jaya Jean Johan John Jonas Jose Josef Juan Julia Karl Katarina Katherine Keiko Kofi Laura Lena Leo Leon Lev Liam Linda
Linnea Lisa Louis Luca Lucia Lukas Mara Marco Margaret Maria Mark Martin Mary Mateo Max Michael Mihaly Mohamed Nadia Nina Noah
Noor Nora Olga Oscar Oskar Otto Paul Paula Paulina Peter Pierre Piotr Priya Rafael Rebecca Renata Richard Robert Rosa Ruth Samuel
Sara Sarah Silvio Simon Sofia Sophie Thea Thomas Tobias Tom Tomas Ulrich Vera Victor Wanda Willem William Xenia Yusuf Zoe
""".split())
# Words that look like a family name after an initial but open a sentence.
SENTENCE_WORDS = frozenset("""
a all along although an and any as assume at because both but by combining consider detrás each every figure finally first following for from
further given hence here however if in indeed it let moreover next no note numerically observe on one our perhaps recall section see since
some such suppose table that the then there therefore these they this those thus to under we when where which while with without
das der die ein eine el es im in la las le les los l un una une
""".split())
# What a word group named after a person, not the person, ends with.
NOT_PERSON_NEXT = r"(?:Institut\w*|Universit\w*|Foundation|Laborator\w*|Observatory|College|School|Hospital|Prize|Award|Medal|Chair|Library|Museum|Street|Road|Lane|Avenue|Close|Terrace|Square|Theorem|theorem|Lemma|lemma|inequality|conjecture|equation|flow|operator|constant|algorithm|method|Collaboration|Group)\b"
TITLE_WORDS = frozenset("Anonymous The University Institute Department Dept Observatory Faculty School College Laboratory Centre Center Group Collaboration Section Chapter Figure Table Theorem Lemma Part Appendix Grant Supported Proc Lett".split())
# Capitalised words of articles that are no given names, to fit the model of given names.
NOT_GIVEN = frozenset("""
The This These Those There Then Thus Hence Here However Moreover Furthermore Finally First Second Third Next Since While Where When Which With Without Under Over Into From For Each Every Some Many Most Such
Let Suppose Assume Consider Recall Note Observe Define Denote Given Using Following Proof Theorem Lemma Proposition Corollary Definition Remark Example Equation Section Chapter Figure Table Appendix
University Institute Department Faculty School College Laboratory Observatory Foundation Council Academy Society Centre Station Museum Library Hospital Street Road Lane Avenue Square North South East West New Old Great Upper Lower Mount Lake River Port Saint Royal National International European American British French German Spanish Italian Technical Monte Hilbert Banach Lebesgue Gaussian Euclidean Bayesian Markov Fourier Hamiltonian Lagrangian Newtonian
Januar Februar März Januaries Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December
Der Die Das Ein Eine Wir Es Sei Dann Für Mit Und Aber Satz Beweis Abbildung Tabelle Abschnitt Technische Deutsche Neue Alte Nous Soit Alors Pour Dans Avec Figure Théorème Preuve Section Sea Entonces Para Con Teorema Prueba Sección Tabla
Reisepass Personalausweis Ausweis Steuernummer Passport Identity Tax Insurance Phone Telephone Telefon Mobile Fax Email
Data Model Method Result Results Work Analysis Theory Field Space Group Energy Power Time Phase State Error Noise Signal Code Network System
""".split())
_PERSON_BEFORE = re.compile(r"(?:\b(?:met|meet|meeting|asked|ask|told|tell|thanks?|thanking|visited|contact(?:ed)?|interviewed|married|named|called|hello from|greetings from|regards,?|sincerely,?|dear|by|with help from|signed|advis(?:er|or)|supervis(?:ed by|or)|student|colleagues?|friend|chair(?:ed by)?|secretary|nurse|patient|participant|employee|applicant|tenant|mother|father|sister|brother|wife|husband|son|daughter|née|born|Herr|Frau|Dr|Prof|Mr|Mrs|Ms|Mme|Sr|Sra|traf(?:en)?|dankt|danken|Gruß von|rencontré|remercie|remercions|conocimos|agradece(?:mos)?)\b\.?|\b(?:regards|sincerely|greetings|Grüße|Gruß|saludos|cordialement),|:)[ %]{1,4}$", re.I)
_PERSON_AFTER = re.compile(r" {1,3}(?:(?:has |had |have |kindly |also |then |later )?(?:signed|said|says|wrote|writes|told|asked|thanks|thanked|kindly|agreed|phoned|called us|replied|answered|lives|lived|works|worked|joined|left|married|was born|born|died|helped|suggested|pointed out|proofread|typed|noticed)\b|\((?:private communication|personal communication|born|aged|PhD)|hat |unterschrieb|schrieb|sagte|a signé|a écrit|firmó|escribió|dijo)")
_PARTICLES = r"(?:van der|van den|van de|van|von der|von|zu|de la|de las|de los|del|de|di|da|dos|du|le|la|ten|ter|af|al|el|bin|ibn)"
_STREET_EN = r"(?:Street|St\.|Road|Rd\.?|Lane|Ln\.?|Terrace|Avenue|Ave\.?|Drive|Dr\.|Close|Way|Court|Ct\.?|Square|Sq\.?|Crescent|Grove|Hill|Place|Row|Boulevard|Blvd\.?|Gardens|Mews|Walk|Green|Quay|Parade|Rise|View|Wharf)"
_ID_LABEL = r"(?:social[ -]security|soc\. ?sec\.|SSN|personnummer|personal number|personal code|national ID|national identity|national identification|citizen|residence permit|national insurance|NINO|NI|passport|personal identity|personal id|identity card|identity|ID card|tax ?payer|tax|TIN|Steuer-?ID(?:nummer|entifikationsnummer)?|Steuernummer|Reisepass|Personalausweis|Ausweis|DNI|NIE|NIF|CURP|CPF|PESEL|codice fiscale|pasaporte|passeport|carte d.identit[ée]|s[ée]curit[ée] sociale|seguridad social|num[ée]ro de s[ée]curit[ée] sociale|insurance|driving licen[cs]e)"
_DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_COMBINING = {"'": "\u0301", "`": "\u0300", '"': "\u0308", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "d": "\u0323", "b": "\u0331", "r": "\u030a", "k": "\u0328"}
_TEX_LETTERS = {"aa": "å", "AA": "Å", "o": "ø", "O": "Ø", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "ss": "ß", "l": "ł", "L": "Ł", "i": "i", "j": "j", "dh": "ð", "th": "þ"}
_HOMOGLYPHS = dict(zip("аеорсухіјѕԁһАВЕКМНОРСТХІЈЅαοινΑΒΕΖΗΙΚΜΝΟΡΤΥΧ＠．", "aeopcyxijsdhABEKMHOPCTXIJSaoivABEZHIKMNOPTYX@.", strict=True))
_INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
# ------------------------------------------------------------------------------

_ACC = r"""\\(?:["'`^~=.]\s?(?:\{\\?[A-Za-z]\s?\}|\\[ij](?![A-Za-z])\s?|[A-Za-z])|[uvHcdbrk]\{\\?[A-Za-z]\})"""
# every alternative opens with a character of one set, which lets the scanner skip ahead
_TRANSDUCE = re.compile(
    r"\{" + _ACC + r"\}|" + _ACC
    + r"|\{\\(?:aa|AA|ae|AE|oe|OE|ss|dh|th|[oOlLij])\}|\\(?:aa|AA|ae|AE|oe|OE|ss|[oOlL])(?:\{\}|(?![A-Za-z])\s?)"
    + r"|\$@\$|\\[@_&#%]|\\\\|\\(?=[ ]\d)"
    + r"|[\[({<]\s?(?:[aA][tT]|[dD][oO][tT])\s?[\])}>]\s{0,2}(?=[\w{])"
    + r"|[" + "".join(_HOMOGLYPHS) + _INVISIBLE + "\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff0b\uff08\uff09\uff0d]"
)
_BARE = r"(?<=\w)\s{1,3}(?:AT|at)\s{1,3}(?=[\w-]+\s{1,3}(?:DOT|dot)\s)|(?<=\w)\s{1,3}(?:DOT|dot)\s{1,3}(?=\w)"
_TRANSDUCE_BARE = re.compile(_TRANSDUCE.pattern + "|" + _BARE)
_DIGIT_WORD = r"(?:[zZ]ero|[oO]h|[oO]ne|[tT]wo|[tT]hree|[fF]our|[fF]ive|[sS]ix|[sS]even|[eE]ight|[nN]ine)"
_SPELLED = r"(?<![A-Za-z])" + _DIGIT_WORD + r"(?:[\s,-]{1,2}" + _DIGIT_WORD + r"){4,}(?![A-Za-z])"
_TWO_SPELLED = re.compile(r"[\s,-](?:zero|oh|one|two|three|four|five|six|seven|eight|nine)[\s,-]{1,2}(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)[\s,-]")
_TRANSDUCE_SPELLED = re.compile(_TRANSDUCE.pattern + "|" + _BARE + "|" + _SPELLED)
_COMBINED = re.compile("[\u0300-\u036f]")
_TRANSDUCE_COMBINED = re.compile(_TRANSDUCE_SPELLED.pattern + "|[A-Za-z][\u0300-\u036f]+")
_MEMO: dict[str, str] = {}
_CYRILLIC_WORD = re.compile(r"[\u0370-\u03ff\u0400-\u052f]")


def _letter(m: str) -> str:
    """The normal form of one transduced piece."""
    got = _MEMO.get(m)
    if got is not None:
        return got
    s = m.strip()
    if len(s) > 1 and "\u0300" <= s[1] <= "\u036f":
        out = unicodedata.normalize("NFC", s)
    elif "@" in s:
        out = "@"
    elif s in ("\\_", "\\&", "\\#", "\\%"):
        out = s[1]
    elif m == "\\\\":
        out = m
    elif s == "\\":
        out = ""
    elif re.fullmatch(r"[\[({<]?\s*at\s*[\])}>]?", s, re.I):
        out = "@"
    elif re.fullmatch(r"[\[({<]?\s*dot\s*[\])}>]?", s, re.I):
        out = "."
    elif m in _HOMOGLYPHS:
        out = _HOMOGLYPHS[m]
    elif m and m[0] in _INVISIBLE:
        out = ""
    elif len(m) == 1 and "\uff00" < m < "\uff5f":
        out = chr(ord(m) - 0xFEE0)
    elif re.match(r"[A-Za-z]", s):
        out = "".join(_DIGIT_WORDS[w.lower()] for w in re.findall(r"[A-Za-z]+", s))
    else:
        t = s.strip("{}").lstrip("\\")
        name = t.replace("{", "").replace("}", "").strip()
        if name in _TEX_LETTERS:
            out = _TEX_LETTERS[name]
        else:
            base = re.sub(r"[^A-Za-z]", "", t[1:])[-1:]
            out = unicodedata.normalize("NFC", base + _COMBINING.get(t[:1], ""))
    if len(_MEMO) < 100_000:
        _MEMO[m] = out
    return out


class Normalised:
    """The normal form of a text and the way back to source offsets."""

    __slots__ = ("text", "_at", "_src", "_end")

    def __init__(self, source: str):
        parts: list[str] = []
        self._at: list[int] = []  # start in the normal form of each rewritten piece
        self._src: list[tuple[int, int, int]] = []  # its source span, and its length in the normal form
        last = n = 0
        scan = _TRANSDUCE
        if not source.isascii() and _COMBINED.search(source):
            scan = _TRANSDUCE_COMBINED
        elif _TWO_SPELLED.search(source):
            scan = _TRANSDUCE_SPELLED
        elif " AT " in source or "DOT" in source or " dot " in source:
            scan = _TRANSDUCE_BARE
        for m in scan.finditer(source):
            a, b = m.span()
            piece = m.group()
            if piece[0] in "[({<" and piece[1] not in "\\'":
                while a > last and source[a - 1] in " \n\r\t":
                    a -= 1
                if a == last or not (source[a - 1].isalnum() or source[a - 1] in "}_+-"):
                    continue
            if piece in _HOMOGLYPHS and piece not in "＠．":
                # a lookalike stands for a Latin letter only beside Latin letters
                near = source[max(0, a - 1) : a] + source[b : b + 1]
                if not re.search(r"[A-Za-z0-9@._-]", near) or (_CYRILLIC_WORD.search(near) and not re.search(r"[A-Za-z@]", source[max(0, a - 3) : b + 3])):
                    continue
            new = _letter(piece)
            if len(new) == b - a:
                parts.append(source[last:a])
                parts.append(new)
                n += b - last
                last = b
                continue
            parts.append(source[last:a])
            n += a - last
            self._at.append(n)
            self._src.append((a, b, len(new)))
            parts.append(new)
            n += len(new)
            last = b
        parts.append(source[last:])
        self._end = len(source)
        # one for one, so no offsets change
        self.text = "".join(parts).replace("\n", " ").replace("\r", " ").replace("~", " ").replace("\t", " ").replace("\u00a0", " ")

    def source_start(self, x: int) -> int:
        i = bisect_right(self._at, x) - 1
        if i < 0:
            return x
        a, b, k = self._src[i]
        x -= self._at[i]
        if x < k:
            return a
        return min(b + x - k, self._end)

    def source_end(self, x: int) -> int:
        """The source offset after the character before ``x``."""
        if x <= 0:
            return 0
        i = bisect_right(self._at, x - 1) - 1
        if i < 0:
            return x
        a, b, k = self._src[i]
        x -= self._at[i]
        return b if x <= k else min(b + x - k, self._end)


# ------------------------------------------------------------------- detectors
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+'\u2019-")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}(?![A-Za-z0-9])")


def _emails(t: str) -> Iterator[tuple[int, int]]:
    at = t.find("@")
    while at >= 0:
        m = _DOMAIN.match(t, at + 1)
        if m:
            start = at
            while start > 0 and t[start - 1] in _LOCAL:
                start -= 1
            while start < at and t[start] in ".'%-+\u2019":
                start += 1
            if start < at:
                yield start, m.end()
        at = t.find("@", at + 1)


_NUMBERS = re.compile(r"(?<![\w.,^_{/=-])(?:\+ ?|\()?\d[\d ().,/+-]{5,30}\d(?![\w])")
_PHONE_FORMS = re.compile(
    r"\+ ?\d[\d ()./-]{6,22}\d"
    r"|00 ?[1-9]\d?\d?(?: ?\(0\))?[ \d()/-]{6,18}\d"
    r"|(?:1[ .-])?\(?[2-9]\d{2}\)?[ .-]{1,2}[2-9]\d{2}[ .-]{1,2}\d{4}"
    r"|\(?0\d{1,4}\)? ?[/ -]{1,3}\d[\d -]{4,12}\d"
    r"|0\d(?:[ .]{1,2}\d{2}){4}"
    r"|0\d{8,10}"
)
_PHONE_LABEL = re.compile(r"(?:\b(?:phone|telephone|mobile|cell|call|dial|ring|fax|tel|ph|t[ée]l|tel[ée]fono|telefon|handy|m[óo]vil|contact)\b)[.:]{0,2}\W{0,4}(?:(?:no|number|at|us|is)\b[.:]?\W{0,3})?$", re.I)
_NOT_PHONE = re.compile(r"(?:grant|project|doi|isbn|issn|seed|run|node|id|entry|catalogue|catalog|version|no|nos|number|nr|arxiv|page|pp|eq|art|award|contract|dataset|section|sect)\b[^\w]{0,5}$", re.I)


def _phones(t: str) -> Iterator[tuple[int, int]]:
    for m in _NUMBERS.finditer(t):
        s, e = m.span()
        text = m.group()
        before = t[max(0, s - 32) : s]
        f = _PHONE_FORMS.match(text)
        digits = sum(c.isdigit() for c in (f.group() if f else text))
        if f and 8 <= digits <= 15:
            if "--" in f.group():
                continue
            if not _PHONE_LABEL.search(before):
                if _NOT_PHONE.search(before) or _ID_BEFORE.search(before) or (before.rstrip()[-1:] in ("$", "=", "^", "<", ">", "&")):
                    continue
                if text[0] == "+" and before[-1:] not in ("", " ", "(", "{", "[", ":", ","):
                    continue
            yield s, s + f.end()
        elif 7 <= digits <= 15 and _PHONE_LABEL.search(before) and not _ID_BEFORE.search(before):
            yield s, e


_ID_BEFORE = re.compile(
    r"(?<![A-Za-z])(?:" + _ID_LABEL + r")(?: {1,3}(?:ID|card|insurance|identification|identity))?(?: {1,3}(?:no\.?|number|num\.?|nr\.?|n\.?[\u00ba\u00b0]|nummer|n[\u00fau]mero))?(?: {1,3}is)? ?[:#]? {0,3}$",
    re.I,
)
_ID_NUMBER = re.compile(r"(?<![\w.])(?:[A-Z]{1,3} {0,2})?\d[\d ./+-]{3,}\d(?:[ -]{0,2}[A-Z](?![A-Za-z]))?")
_ID_SHAPE = re.compile(r"\d{3}-\d{2}-\d{4}|\d{8}-[A-Z]|\d{6}[-+]\d{4}|[A-CEGHJ-PR-TW-Z]{2} ?\d{2} \d{2} \d{2} ?[A-D]")


def _idnums(t: str) -> Iterator[tuple[int, int]]:
    for m in _ID_NUMBER.finditer(t):
        s, e = m.span()
        n = m.group()
        if sum(map(n.count, "0123456789")) < 5 or "--" in n:
            continue
        before = t[max(0, s - 48) : s]
        if _ID_BEFORE.search(before) or (_ID_SHAPE.fullmatch(n) and not _NOT_PHONE.search(before)):
            yield s, e
        elif n[0].isalpha():  # the letters may be the label: SSN, DNI, ID
            d = next(i for i, c in enumerate(n) if c.isdigit())
            if _ID_BEFORE.search(before + n[:d]):
                yield s + d, e


_GAP = r"(?: |\\\\){1,6}"
_W = r"[A-ZÀ-Þ][\w'\u2019-]+"
_FLAT = r"(?:(?:Apt|Flat|Unit|Suite|Ste|Apartment|Room)\.?" + _GAP + r"\d+[a-zA-Z]?," + _GAP + r")"
_FLAT_BEFORE = re.compile(_FLAT + "$")
_ADDRESSES = [
    re.compile(r"(?<![\w.-])\d{1,4}[a-zA-Z]?,?" + _GAP + r"(?:" + _W + _GAP + r"){1,3}" + _STREET_EN + r"(?![\w])"),
    re.compile(r"(?<![\w.-])\d{1,4}(?: ?(?:bis|ter|quater)| ?[a-zA-Z])?,?" + _GAP + r"(?:rue|avenue|av\.|boulevard|bd\.?|place|impasse|chemin|all[ée]e|quai|cours|route|square|passage|faubourg)" + _GAP + r"(?:(?:de|du|des|de la|d['\u2019]|de l['\u2019]|la|le|les|Saint|aux?)(?: {0,3}))*" + r"[A-ZÀ-Þ][\w'\u2019-]+", re.I),
    re.compile(r"(?<![\w-])(?:ul\.|al\.|pl\.|os\.|ulica)" + _GAP + r"[A-ZÀ-Þ\u0100-\u017f][\w.-]+(?:" + _GAP + r"[A-ZÀ-Þ\u0100-\u017f][\w.-]+){0,2}" + _GAP + r"\d+[a-zA-Z]?(?:/\d+)?"),
    re.compile(r"(?<![\w-])(?:Calle|C/|Avenida|Avda\.|Av\.|Plaza|Pza\.|Paseo|P\.\u00ba|Camino|Carretera|Ronda|Traves[íi]a|Rua|Travessa|Largo|Pra[çc]a|Via|Viale|V\.le|Corso|Piazza|Vicolo|Largo|Strada)" + _GAP + r"(?:(?:de|del|della|delle|degli|dei|dell['\u2019]|di|da|do|das|dos|los|las|la|el|san|santa)" + _GAP + r")*[A-ZÀ-Þ][\w'\u2019.-]+(?:" + _GAP + r"(?:(?:de|del|della|di|y|e|da|do)" + _GAP + r")?[A-ZÀ-Þ][\w'\u2019.-]+){0,3},?" + _GAP + r"(?:n\.?[\u00ba\u00b0] ?)?\d+[a-zA-Z]?"),
    re.compile(r"(?<![\w-])(?:(?:Am|An der|Im|In der|Auf der|Zum|Zur|Alte|Alter|Neue|Lange|Kleine|Gro(?:ß|ss)e|Obere|Untere)" + _GAP + r")?[A-ZÀ-Þ][\w-]*(?:stra(?:ß|ss)e|str\.|weg|gasse|allee|platz|damm|ufer|ring|steig|pfad|markt|graben|wall|chaussee|hof|tor)" + _GAP + r"\d{1,4} ?[a-zA-Z]?(?![\w-])(?!" + _GAP + r"\.)"),
    re.compile(r"(?<![\w-])(?:Am|An der|Im|In der|Auf der|Auf dem|Zum|Zur|Unter den)" + _GAP + r"[A-ZÀ-Þ][a-zß-ÿ]+" + _GAP + r"\d{1,4}[a-zA-Z]?(?=," + _GAP + r"(?:[A-Z]-)?\d{4,5})"),
    re.compile(r"(?<![\w-])(?:Stra(?:ß|ss)e|Str\.|Platz|Allee)" + _GAP + r"(?:de[srm]" + _GAP + r")?[\w.]+" + _GAP + r"\d{1,4}[a-zA-Z]?(?=," + _GAP + r"(?:[A-Z]-)?\d{4,5})"),
]
_NUMBER_FIRST = re.compile(r"\d(?: ?(?:bis|ter|quater)| ?[a-zA-Z])?,?(?: |\\\\){1,6}(?:[A-Z\u00c0-\u00de]|rue|av|b[od]|place|imp|chemin|all|quai|cours|route|square|passage|faub)")
_NUMBER_LAST = re.compile(r"[a-z\u00df-\u00ff\u0100-\u017f.],?(?: |\\\\){1,6}(?:n[\u00ba\u00b0.]+ ?)?\d")
_LAST_WORDS = ("ul.", "al.", "pl.", "os.", "ulica", "Calle", "C/", "Aven", "Avda", "Av.", "Pla", "Pza", "Paseo", "Camino", "Carret", "Ronda", "Traves", "Rua", "Largo", "Pra", "Via", "V.le", "Corso", "Piazza", "Vicolo", "Strada", "Am ", "An ", "Im ", "In d", "Auf d", "Zum ", "Zur ", "Unter den ", "Stra", "Str.", "Platz", "Allee")
_LAST_ENDS = ("stra\u00dfe", "strasse", "str.", "weg", "gasse", "allee", "platz", "damm", "ufer", "ring", "steig", "pfad", "markt", "graben", "wall", "chaussee", "hof", "tor")


def _words_back(t: str, at: int, words: int = 14) -> int:
    """Where the words before ``at`` begin, of which no address has more before its number."""
    while at > 0 and words:
        at = t.rfind(" ", 0, at)
        if at < 0:
            return 0
        while at > 0 and t[at - 1] == " ":
            at -= 1
        words -= 1
    return at


def _addresses(t: str) -> Iterator[tuple[int, int]]:
    # every form has a house number beside the street; the text around it is searched
    seen = -1
    for m in _NUMBER_FIRST.finditer(t):
        s = m.start()
        while s > 0 and t[s - 1].isdigit():
            s -= 1
        f = _ADDRESSES[0].match(t, s)
        if f:
            flat = _FLAT_BEFORE.search(t[max(0, s - 24) : s])
            yield (s if not flat else s - len(flat.group())), f.end()
        elif f := _ADDRESSES[1].match(t, s):
            yield f.span()
    for m in _NUMBER_LAST.finditer(t):
        s = m.start()
        if s < seen:
            continue
        lo = _words_back(t, s)
        window = t[lo : s + 1]
        if not (window.rstrip(",").endswith(_LAST_ENDS) or any(w in window for w in _LAST_WORDS)):
            continue
        for rx in _ADDRESSES[2:]:
            for f in rx.finditer(t, lo, min(len(t), m.end() + 12)):
                if f.end() >= m.end():
                    seen = f.end()
                    yield f.span()


_SEP = r" {1,3}(?:%+ {0,3})?"
_FAMILY = r"(?:[OD]['\u2019]|Mc|Mac|St\. )?[A-ZÀ-Þ\u0100-\u017f][a-zß-ÿ\u0100-\u017f]+(?:[A-Z][a-z]+)?(?:-[A-ZÀ-Þ\u0100-\u017f][a-zß-ÿ\u0100-\u017f]+)*"
_HEAD = re.compile(r"(?<![\w\\'\u2019.-])[A-ZÀ-Þ\u0100-\u017f](?:\.|[a-zß-ÿ\u0100-\u017f]+(?:-[A-ZÀ-Þ][a-zß-ÿ]+)?)(?= |[A-ZÀ-Þ]\.)")
_TAIL_GIVEN = re.compile(r"(?:" + _SEP + r"[A-ZÀ-Þ]\.)*" + _SEP + r"(?:" + _PARTICLES + _SEP + r")?(?P<f>" + _FAMILY + r")")
_TAIL_TWO_GIVEN = re.compile(_SEP + r"(?P<g>[A-ZÀ-Þ][a-zß-ÿ]+)" + _SEP + r"(?:" + _PARTICLES + _SEP + r")?(?P<f>" + _FAMILY + r")")
_TAIL_INITIAL = re.compile(r"(?:(?:" + _SEP + r"|-)?[A-ZÀ-Þ]\.)*" + _SEP + r"(?:" + _PARTICLES + _SEP + r")?(?P<f>" + _FAMILY + r")")
_NEXT_BAD = re.compile(r" {1,3}" + NOT_PERSON_NEXT + r"|--")
_CONTEXT = re.compile(r"(?:\bthank(?:s to)?|\bAsk|\bkept by|\bParticipant|\bReimbursement for|\bReprints:|\bcontact:?|\bcourtesy of|\bDr\.|\bProf\.|\bMr\.?|\bMrs\.?|\bMs\.?|\bDipl\.-Ing\.|\bHerr|\bFrau|\bMme|\bSr\.|\bSra\.|as well as|and also|\\author(?:\[\d+\])?\{|\\and|\bby)[ %]{0,4}$")
_CONTEXT_ENDS = ("k", "to", "by", "t", "for", ":", "of", ".", "r", "s", "Frau", "me", "a", "as", "so", "{", "and")  # of _CONTEXT, for a quick look
_BIB = re.compile(r"\\begin\{thebibliography\}.*?(?:\\end\{thebibliography\}|\Z)|\\bibitem(?:\[[^\]]*\])?\{.*?(?=\\(?:end|section|bibitem)|\Z)|@(?:article|book|inproceedings|misc|phdthesis|techreport|incollection)\s?\{.*?\}\s*\}", re.S | re.I)
#: Lower-case words; a pair of capitalised words; what stands between names in a list.
_LOWER = re.compile(r"(?<!\w)[^\W\d_A-ZÀ-Þ][^\W_]*(?!\w)")
_WORDS = re.compile(r"[^\W_]+")
_MAY_BE = re.compile(r" {1,3}(?:%+ {0,3})?[A-ZÀ-Þ\u0100-\u017fvzdlt]")
_BESIDE = re.compile(r",? {1,3}(?:and|und|et|y|e) {1,3}|, {1,3}")
_AUTHOR = re.compile(r"\\author(?:\[[^\]]*\])?\{")


def _plain(s: str) -> str:
    """Letters without accents, as the list of given names has them."""
    return s if s.isascii() else "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def _balanced(t: str, at: int) -> int:
    """The end of the group whose content begins at ``at``; of the text if it never ends."""
    depth = 1
    for m in _BRACE.finditer(t, at):
        c = m.group()
        if len(c) == 1:
            depth += 1 if c == "{" else -1
            if not depth:
                return m.start()
    return len(t)


_BRACE = re.compile(r"\\.|[{}]", re.S)
_THANKS = re.compile(r"\\(?:thanks|footnote|inst|orcid|email|affil\w*)\*?\s?(?:\[[^\]]*\])?\{")


def _author_given(t: str) -> set[str]:
    """Given names in the document's own author fields, read to their end without notes."""
    out = set()
    for m in _AUTHOR.finditer(t):
        field, at, end = [], m.end(), _balanced(t, m.end())
        while note := _THANKS.search(t, at, end):
            field.append(t[at : note.start()])
            at = min(end, _balanced(t, note.end()) + 1)
        field.append(t[at:end])
        for part in re.split(r"\\and\b|,| and ", " ".join(field)):
            w = part.split()
            if len(w) >= 2 and re.fullmatch(r"[A-ZÀ-Þ][a-zß-ÿ\u0100-\u017f]{1,14}", w[0]) and re.fullmatch(_FAMILY, w[-1]) and w[0] not in TITLE_WORDS:
                out.add(_plain(w[0]))
    return out


class NameModel:
    """Whether a capitalised word can be a given name, by its letters: logistic regression on
    its sequences of two and three characters, fitted to GIVEN_NAMES against NOT_GIVEN;
    and what the words around a pair of capitalised words say for its being a person."""

    SIZE = 1 << 12

    def __init__(self, names=GIVEN_NAMES, others=None, rounds: int = 200, rate: float = 0.5, keep: float = 1e-3):
        words = [*sorted(names), *sorted(NOT_GIVEN if others is None else others)]
        y = np.array([1.0] * len(names) + [0.0] * (len(words) - len(names)))
        x = np.zeros((len(words), self.SIZE), np.float32)
        for i, w in enumerate(words):
            x[i, self._grams(w)] = 1.0
        x /= np.sqrt(x.sum(1, keepdims=True))
        w, b = np.zeros(self.SIZE), 0.0
        for _ in range(rounds):
            p = 1.0 / (1.0 + np.exp(-(x @ w + b)))
            g = p - y
            w -= rate * (x.T @ g / len(y) * 8 + keep * w)
            b -= rate * g.mean()
        self.w, self.b, self.memo = w, b, {}

    def _grams(self, word: str) -> list[int]:
        s = f"^{_plain(word).lower()}$"
        return sorted({crc32(s[i : i + n].encode()) % self.SIZE for n in (2, 3) for i in range(len(s) - n + 1)})

    def log_odds(self, word: str) -> float:
        got = self.memo.get(word)
        if got is None:
            g = self._grams(word)
            got = float(self.w[g].sum() / len(g) ** 0.5 + self.b)
            if len(self.memo) < 100_000:
                self.memo[word] = got
        return got

    def accepts(self, t: str, start: int, end: int, given: str) -> bool:
        """Whether the pair at ``start`` .. ``end`` is a person by its context, and its given
        name by its letters."""
        before, after = _PERSON_BEFORE.search(t, max(0, start - 40), start), _PERSON_AFTER.match(t, end)
        return bool(before or after) and 1.5 * bool(before) + 1.5 * bool(after) + self.log_odds(given) >= -0.5


_MODEL: list[NameModel] = []


def name_model() -> NameModel:
    if not _MODEL:
        _MODEL.append(NameModel())
    return _MODEL[0]


def _names(t: str) -> Iterator[tuple[int, int]]:
    skip = [m.span() for m in _BIB.finditer(t)] if ("bibitem" in t or "thebibliography" in t or "@" in t) else []
    own = _author_given(t) if "\\author" in t else set()
    lower: set[str] = set()
    model = name_model()

    def common(family: str) -> bool:
        """Whether a family name is also a word of the text."""
        low = family.lower()
        if not lower:
            lower.update(_LOWER.findall(t), ("",))
        return all(x in lower for x in _WORDS.findall(low)) and (low in lower or re.search(r"(?<![\w])" + re.escape(low) + r"(?![\w])", t) is not None)

    k = done = 0
    last = -1  # where the last name ended
    for m in _HEAD.finditer(t):
        s = m.start()
        if s < done:
            continue
        while k < len(skip) and skip[k][1] <= s:
            k += 1
        if k < len(skip) and skip[k][0] <= s:
            continue
        head = m.group()
        if head[-1] == ".":
            n = _TAIL_INITIAL.match(t, m.end())
            if not n:
                continue
            family = n.group("f")
            low = family.lower()
            if low in SENTENCE_WORDS or family in TITLE_WORDS:
                continue
            if not _CONTEXT.search(t[max(0, s - 24) : s]) and (common(family) or t[max(0, s - 1) : s] in ("$", "_", "^")):
                continue
        else:
            known = _plain(head) in GIVEN_NAMES or _plain(head.split("-")[0]) in GIVEN_NAMES or _plain(head) in own
            told = known or (head not in TITLE_WORDS and head not in NOT_GIVEN and t[max(0, s - 12) : s].rstrip(" %").endswith(_CONTEXT_ENDS) and _CONTEXT.search(t[max(0, s - 24) : s]) is not None)
            # a name that neither list nor field knows: by the model, or beside a name
            if not told and (head in TITLE_WORDS or head in NOT_GIVEN or not _MAY_BE.match(t, m.end())):
                continue
            n = _TAIL_GIVEN.match(t, m.end())
            if n and _plain(n.group("f")) in GIVEN_NAMES:
                n = _TAIL_TWO_GIVEN.match(t, m.end()) or n
            if not n or n.group("f") in TITLE_WORDS:
                continue
            if not told and not (len(n.group("f")) > 2 and n.group("f") not in NOT_GIVEN and ((_BESIDE.fullmatch(t, last, s) is not None if 0 <= last < s else False) and model.log_odds(head) > -2.0 or model.accepts(t, s, n.end(), head))):
                continue
            if not known and common(n.group("f")):
                continue
            if not told and common(head):
                continue
        if _NEXT_BAD.match(t, n.end()):
            continue
        done = last = n.end()
        yield s, n.end()


_DETECTORS = (("email", _emails), ("idnum", _idnums), ("phone", _phones), ("address", _addresses), ("name", _names))


def find_mentions(source: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in source characters, ordered by start. Spans of one kind
    don't overlap; where kinds overlap the earlier in the order email, idnum,
    phone, address, name is kept."""
    if not source or source.isspace():
        return []
    norm = Normalised(source)
    taken: list[tuple[int, int]] = []  # sorted, and apart
    out = []
    for kind, detect in _DETECTORS:
        for s, e in sorted(set(detect(norm.text))):
            a, b = norm.source_start(s), norm.source_end(e)
            at = bisect_right(taken, (a, b))
            if (at and taken[at - 1][1] > a) or (at < len(taken) and taken[at][0] < b):
                continue
            taken.insert(at, (a, b))
            out.append((kind, a, b))
    out.sort(key=lambda r: (r[1], r[0]))
    return out


def redact(source: str | None) -> str | None:
    """The text with each mention replaced by its placeholder; null stays null."""
    if source is None:
        return None
    parts, last = [], 0
    for kind, a, b in find_mentions(source):
        parts += [source[last:a], PLACEHOLDERS[kind]]
        last = b
    return "".join([*parts, source[last:]])


def mentions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, start_char BIGINT, end_char BIGINT): one row per mention.

    Null, empty and blank texts give none. A repeated row gives its mentions again;
    where keys are unique so are the rows. Whole texts are searched. Scan -> map, no
    shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, starts, ends = [], [], [], []
            for i, t in enumerate(batch.column(1)):
                for what, a, b in find_mentions(t.as_py()):
                    ids.append(i)
                    kinds.append(what)
                    starts.append(a)
                    ends.append(b)
            keys = batch.column(0).take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["k", "kind", "s", "e"])

    cols = spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return cols.mapInArrow(run, f"k {kind}, kind string, s bigint, e bigint").toDF(key, "kind", "start_char", "end_char")


def redact_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): the texts with typed placeholders. Null stays null."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([redact(t.as_py()) for t in batch.column(1)], pa.string())], names=["k", "t"])

    cols = spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return cols.mapInArrow(run, f"k {kind}, t string").toDF(key, text)
