"""HTML tokenizer after the public HTML parsing standard.

Scans with compiled patterns instead of a character loop. Tokens are tuples
(type, name, self_closing, attrs, data) with types doctype, start, end, text,
comment, pi, cdata and eof; ``attrs`` is a list of (name, value)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5

from .options import ParseOptions

DOCTYPE, START, END, TEXT, COMMENT, PI, CDATA, EOF = "doctype", "start", "end", "text", "comment", "pi", "cdata", "eof"

_NAME = re.compile(r"[A-Za-z][^\t\n\f\r />]*")
_ATTR = re.compile(r"""[\t\n\f\r /]*(?:([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)("?)|'([^']*)('?)|([^\t\n\f\r >"'][^\t\n\f\r >]*)|(?=>)))?|(>)|\Z)""")
_REF = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?|([A-Za-z][A-Za-z0-9]{0,31};?))")
_DOCTYPE = re.compile(r"[\t\n\f\r ]*([^\t\n\f\r >]*)[\t\n\f\r ]*(?:(public|system)[\t\n\f\r ]*(?:\"([^\">]*)\"?|'([^'>]*)'?)?[\t\n\f\r ]*(?:\"([^\">]*)\"?|'([^'>]*)'?)?)?[^>]*>?", re.I)
_COMMENT_END = re.compile(r"--!?>|--!?\Z|-?\Z")
_LONGEST = max(map(len, html5))
# fixed values: numeric references to the C1 range stand for windows-1252
_C1 = {128: 0x20AC, 130: 0x201A, 131: 0x192, 132: 0x201E, 133: 0x2026, 134: 0x2020, 135: 0x2021, 136: 0x2C6, 137: 0x2030, 138: 0x160, 139: 0x2039, 140: 0x152, 142: 0x17D, 145: 0x2018, 146: 0x2019, 147: 0x201C, 148: 0x201D, 149: 0x2022, 150: 0x2013, 151: 0x2014, 152: 0x2DC, 153: 0x2122, 154: 0x161, 155: 0x203A, 156: 0x153, 158: 0x17E, 159: 0x178}


def decode_references(text: str, in_attribute: bool = False) -> str:
    """Character references replaced; names without ``;`` by the longest that is defined,
    in attribute values only where no letter, digit or ``=`` follows."""
    if "&" not in text:
        return text

    def put(m: re.Match) -> str:
        digits = m[1] or m[2]
        if digits:
            n = int(digits, 16 if m[1] else 10)
            n = _C1.get(n, n)
            return "�" if n == 0 or n > 0x10FFFF or 0xD800 <= n < 0xE000 else chr(n)
        name = m[3]
        if name in html5:
            if not (in_attribute and name[-1] != ";" and (text[m.end() : m.end() + 1] == "=" or text[m.end() : m.end() + 1].isalnum())):
                return html5[name]
            return m[0]
        if in_attribute:
            return m[0]
        for k in range(min(len(name), _LONGEST) - 1, 1, -1):
            if name[:k] in html5:
                return html5[name[:k]] + name[k:]
        return m[0]

    return _REF.sub(put, text)


class Tokenizer:
    """Iterates the tokens of a text. The consumer may set ``state`` (data, rcdata,
    rawtext, script, plaintext) after a start tag, and ``foreign`` while the current
    node is no HTML element; with ``alone`` the tokenizer switches by itself."""

    def __init__(self, html: str, options: ParseOptions, alone: bool = True):
        if "\r" in html:
            html = html.replace("\r\n", "\n").replace("\r", "\n")
        if html[:1] == "﻿":
            html = html[1:]
        self.s, self.o, self.alone = html, options, alone
        self.pos, self.state, self.last_start, self.foreign = 0, "data", "", False
        self.start_pos = 0

    def __iter__(self) -> Iterator[tuple]:
        s, o = self.s, self.o
        n = len(s)
        while self.pos < n:
            self.start_pos = self.pos
            if self.state != "data":
                yield from self._raw()
                continue
            lt = s.find("<", self.pos)
            if lt < 0:
                lt = n
            if lt > self.pos:
                text = s[self.pos : lt]
                end = lt
                # a "<" that opens nothing is text
                while end < n and not self._opens(end):
                    nxt = s.find("<", end + 1)
                    nxt = n if nxt < 0 else nxt
                    text += s[end:nxt]
                    end = nxt
                self.pos = end
                if not o.skip_data_text:
                    yield TEXT, "", False, None, decode_references(text) if o.decode_entities else text
                continue
            if not self._opens(lt):
                nxt = s.find("<", lt + 1)
                nxt = n if nxt < 0 else nxt
                while nxt < n and not self._opens(nxt):
                    nxt2 = s.find("<", nxt + 1)
                    nxt = n if nxt2 < 0 else nxt2
                text, self.pos = s[lt:nxt], nxt
                if not o.skip_data_text:
                    yield TEXT, "", False, None, decode_references(text) if o.decode_entities else text
                continue
            c = s[lt + 1]
            if c == "!":
                token = self._markup(lt + 2)
            elif c == "?":
                gt = s.find(">", lt + 2)
                end = n if gt < 0 else gt
                self.pos = min(n, end + 1)
                if o.processing_instructions:
                    token = None if o.skip_processing_instructions else (PI, "", False, None, s[lt + 2 : end])
                else:
                    token = None if o.skip_comments else (COMMENT, "", False, None, s[lt + 1 : end])
            elif c == "/":
                token = self._end(lt + 2)
            else:
                token = self._tag(lt + 1, START)
            if token:
                yield token
        yield EOF, "", False, None, ""

    def _opens(self, at: int) -> bool:
        c = self.s[at + 1 : at + 2]
        if c == "/":
            return at + 2 < len(self.s)
        return c in ("!", "?") or (c.isascii() and c.isalpha())

    def _end(self, at: int):
        s = self.s
        c = s[at]
        if c.isascii() and c.isalpha():
            return self._tag(at, END)
        gt = s.find(">", at)
        if c == ">":
            self.pos = at + 1
            return None
        end = len(s) if gt < 0 else gt
        self.pos = min(len(s), end + 1)
        return None if self.o.skip_comments else (COMMENT, "", False, None, s[at:end].replace("\0", "�"))

    def _tag(self, at: int, kind: str):
        s, o = self.s, self.o
        m = _NAME.match(s, at)
        name = m.group().lower().replace("\0", "�")
        pos = m.end()
        attrs: list[tuple[str, str]] = []
        closing = False
        seen = set()
        n = len(s)
        keep = o.keeps(name) if kind == START else None
        while True:
            m = _ATTR.match(s, pos)
            if m[7]:
                closing = s[m.end() - 2] == "/"
                self.pos = m.end()
                break
            if m.end() >= n and not m[1] or (m[2] is not None and not m[3]) or (m[4] is not None and not m[5]):
                self.pos = n  # the input ends within the tag, which is dropped
                return None
            pos = m.end()
            if pos >= n:
                self.pos = n
                return None
            key = m[1] if o.preserve_attr_case else m[1].lower()
            if kind == START and key not in seen:
                seen.add(key)
                if keep is None or keep(key):
                    value = m[2] if m[2] is not None else m[4] if m[4] is not None else m[6] or ""
                    if "&" in value and o.decode_entities:
                        value = decode_references(value, True)
                    attrs.append((key.replace("\0", "�"), value.replace("\0", "�") if "\0" in value else value))
        if kind == END:
            return END, name, False, None, ""
        self.last_start = name
        if self.alone and not closing:
            self.state = {"script": "script", "style": "rawtext", "xmp": "rawtext", "iframe": "rawtext", "noembed": "rawtext", "noframes": "rawtext", "title": "rcdata", "textarea": "rcdata", "plaintext": "plaintext"}.get(name, "data")
        return START, name, closing, attrs, ""

    def _markup(self, at: int):
        s, o = self.s, self.o
        n = len(s)
        if s.startswith("--", at):
            at += 2
            if s.startswith(">", at) or s.startswith("->", at):
                self.pos = at + (1 if s[at] == ">" else 2)
                return None if o.skip_comments else (COMMENT, "", False, None, "")
            m = _COMMENT_END.search(s, at)
            self.pos = m.end()
            return None if o.skip_comments else (COMMENT, "", False, None, s[at : m.start()].replace("\0", "�"))
        if s[at : at + 7].lower() == "doctype":
            m = _DOCTYPE.match(s, at + 7)
            self.pos = m.end()
            kind = (m[2] or "").lower()
            one = m[3] if m[3] is not None else m[4]
            two = m[5] if m[5] is not None else m[6]
            public, system = (one, two) if kind == "public" else (None, one)
            return DOCTYPE, m[1].lower(), False, [("public", public or ""), ("system", system or "")], ""
        if s.startswith("[CDATA[", at) and self.foreign:
            end = s.find("]]>", at + 7)
            stop = n if end < 0 else end
            self.pos = min(n, stop + 3)
            return None if o.skip_cdata else (CDATA, "", False, None, s[at + 7 : stop])
        gt = s.find(">", at)
        end = n if gt < 0 else gt
        self.pos = min(n, end + 1)
        return None if o.skip_comments else (COMMENT, "", False, None, s[at:end].replace("\0", "�"))

    def _raw(self):
        """Text up to the end tag of the open raw-text element, and that tag."""
        s, o, state = self.s, self.o, self.state
        n = len(s)
        at = n
        if state != "plaintext":
            close = re.compile(r"</" + re.escape(self.last_start) + r"(?=[\t\n\f\r />])", re.I)
            m = close.search(s, self.pos)
            if state == "script" and m:
                m = self._script_end(close, m)
            if m:
                at = m.start()
        text = s[self.pos : at]
        self.pos, self.state = at, "data"
        skip = {"script": o.skip_script_text, "rawtext": o.skip_raw_text, "rcdata": o.skip_rcdata_text, "plaintext": o.skip_plaintext}[state]
        if text and not skip:
            if "\0" in text:
                text = text.replace("\0", "�")
            yield TEXT, "", False, None, decode_references(text) if state == "rcdata" and o.decode_entities else text
        if at < n:
            token = self._tag(at + 2, END)
            if token:
                yield token

    def _script_end(self, close: re.Pattern, m: re.Match) -> re.Match | None:
        """The end tag that really ends a script: one inside ``<!-- <script`` doesn't."""
        s, at = self.s, self.pos
        while m:
            open_ = s.find("<!--", at, m.start())
            if open_ < 0:
                return m
            done = s.find("-->", open_ + 2)
            inner = re.compile(r"<script(?=[\t\n\f\r />])", re.I).search(s, open_ + 4, m.start())
            if 0 <= done < m.start():
                at = done + 3
                continue
            if not inner:
                return m
            # doubly escaped: the next end tag closes the inner script
            at = m.end()
            nxt = close.search(s, at)
            if 0 <= done < (nxt.start() if nxt else len(s)):
                at = done + 3
                m = close.search(s, at)
            else:
                return nxt
        return None


def tokenize(html: str | None, options: ParseOptions | None = None) -> list[tuple]:
    """All tokens of a text; none for null."""
    return [] if html is None else list(Tokenizer(html, options or ParseOptions()))
