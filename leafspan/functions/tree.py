"""HTML tree construction after the public HTML parsing standard: insertion modes, the
stack of open elements, active formatting elements with the adoption agency, foster
parenting, template contents and foreign content. Never fails and runs no scripts."""

from __future__ import annotations

from collections import deque

from . import tags as T
from .options import ParseOptions, TokenFilter
from .tokenizer import CDATA, COMMENT, DOCTYPE, END, EOF, PI, START, TEXT, Tokenizer

_SPACE = "\t\n\f\r "
_DROPPED = " \t\r\n"  # text of only these is dropped
_MARK = None  # marker in the list of active formatting elements


class Node:
    __slots__ = ("kind", "name", "ns", "attrs", "data", "parent", "children", "content", "pos")

    def __init__(self, kind, name="", ns="html", attrs=None, data=None, pos=-1):
        self.kind, self.name, self.ns, self.attrs, self.data, self.pos = kind, name, ns, attrs, data, pos
        self.parent = self.content = None
        self.children = []


class TreeBuilder:
    def __init__(self, html: str, options: ParseOptions, token_filter: TokenFilter | None = None):
        self.o, self.filter = options, token_filter
        self.tok = Tokenizer(html, options, alone=False)
        self.doc = Node("document", "#document")
        self.stack: list[Node] = []
        self.active: list = []
        self.mode = self.initial
        self.back = None
        self.templates: list = []
        self.head = self.form = None
        self.frameset_ok, self.foster, self.quirks = True, False, False
        self.skip_lf = False
        self.table_text: list[str] = []
        self.special = T.REFERENCE_SPECIAL if options.reference_flags else T.SPECIAL

    # ------------------------------------------------------------- driver
    def run(self) -> Node:
        started, depth = False, 0
        f = self.filter
        for token in self.tok:
            if f is not None:
                kind = token[0]
                if not started:
                    started = kind == START and f.starts(token[1], token[3])
                    if not started:
                        if kind == START and not token[2]:
                            self._switch(token[1])
                        continue
                if kind == START and not token[2] and not (f.void_aware and token[1] in T.VOID):
                    depth += 1
                elif kind == END:
                    depth -= 1
                if depth <= 0:
                    break
            self.feed(token)
        else:
            return self.doc
        self.feed((EOF, "", False, None, ""))
        return self.doc

    def _switch(self, name: str) -> None:
        """The tokenizer's state after a start tag that makes no element."""
        if name == "script":
            self.tok.state = "script"
        elif name in T.RAWTEXT:
            self.tok.state = "rawtext"
        elif name in T.RCDATA:
            self.tok.state = "rcdata"
        elif name == "plaintext":
            self.tok.state = "plaintext"

    def feed(self, token) -> None:
        kind = token[0]
        if self.skip_lf:
            self.skip_lf = False
            if kind == TEXT and token[4][:1] == "\n":
                if len(token[4]) == 1:
                    return
                token = (TEXT, "", False, None, token[4][1:])
        if kind == PI:
            self.current().children.append(self._own(Node("pi", "", data=token[4])))
            return
        if kind == CDATA:
            token = (TEXT, "", False, None, token[4])
        if self._in_foreign(token):
            self.foreign(token)
        else:
            while self.mode(token) is True:  # a mode that returns True wants the token handled again
                pass
        self.tok.foreign = bool(self.stack) and self.stack[-1].ns != "html"

    def _own(self, node: Node) -> Node:
        node.parent = self.current()
        return node

    def _in_foreign(self, token) -> bool:
        if not self.stack:
            return False
        c = self.stack[-1]
        if c.ns == "html" or token[0] == EOF:
            return False
        if c.ns == "math" and c.name in T.MATH_TIPS and (token[0] == TEXT or (token[0] == START and token[1] not in ("mglyph", "malignmark"))):
            return False
        if c.ns == "math" and c.name == "annotation-xml" and token[0] == START and token[1] == "svg":
            return False
        return not (self._html_point(c) and token[0] in (START, TEXT))

    @staticmethod
    def _html_point(n: Node) -> bool:
        if n.ns == "svg":
            return n.name in T.SVG_TIPS
        return n.ns == "math" and n.name == "annotation-xml" and any(k == "encoding" and v.lower() in ("text/html", "application/xhtml+xml") for k, v in n.attrs)

    # ------------------------------------------------------------- primitives
    def current(self) -> Node:
        return self.stack[-1] if self.stack else self.doc

    def _place(self, target: Node | None = None) -> tuple[list, Node, int]:
        """(children list, parent, index) where the next node goes."""
        target = target or self.current()
        if self.foster and target.ns == "html" and target.name in ("table", "tbody", "tfoot", "thead", "tr"):
            at = len(self.stack) - 1
            while at >= 0 and not (self.stack[at].ns == "html" and self.stack[at].name in ("table", "template")):
                at -= 1
            if at >= 0 and self.stack[at].name == "template":
                t = self.stack[at]
                return t.content, t, len(t.content)
            if at < 0:
                h = self.stack[0]
                return h.children, h, len(h.children)
            table = self.stack[at]
            if table.parent is not None and table in table.parent.children:
                return table.parent.children, table.parent, table.parent.children.index(table)
            prev = self.stack[at - 1]
            return prev.children, prev, len(prev.children)
        if target.content is not None:
            return target.content, target, len(target.content)
        return target.children, target, len(target.children)

    def insert(self, name: str, attrs=None, ns: str = "html", push: bool = True) -> Node:
        node = Node("element", name, ns, attrs if attrs is not None else [], pos=self.tok.start_pos)
        if ns == "html" and name == "template":
            node.content = []
        kids, parent, at = self._place()
        kids.insert(at, node)
        node.parent = parent
        if push:
            self.stack.append(node)
        return node

    def text(self, data: str) -> None:
        kids, parent, at = self._place()
        if parent.kind == "document":
            return
        if self.o.merge_text and at and kids[at - 1].kind == "text":
            kids[at - 1].data += data
            return
        node = Node("text", data=data, pos=self.tok.start_pos)
        node.parent = parent
        kids.insert(at, node)

    def comment(self, data: str, into: Node | None = None) -> None:
        node = Node("comment", data=data, pos=self.tok.start_pos)
        if into is not None:
            node.parent = into
            into.children.append(node)
            return
        kids, parent, at = self._place()
        node.parent = parent
        kids.insert(at, node)

    def pop_until(self, *names: str) -> None:
        while self.stack:
            n = self.stack.pop()
            if n.ns == "html" and n.name in names:
                return

    def in_scope(self, names, scope=T.SCOPE) -> bool:
        """names: one element name, several, or a node."""
        for n in reversed(self.stack):
            if n is names or (n.ns == "html" and not isinstance(names, Node) and (n.name == names if isinstance(names, str) else n.name in names)):
                return True
            if n.ns == "html":
                if n.name in scope:
                    return False
            elif scope is not T.TABLE_SCOPE and ((n.ns == "math" and n.name in T.MATH_SCOPED) or (n.ns == "svg" and n.name in T.SVG_TIPS)):
                return False
        return False

    def implied_ends(self, but: str = "", names=T.IMPLIED_END) -> None:
        while self.stack and self.stack[-1].ns == "html" and self.stack[-1].name in names and self.stack[-1].name != but:
            self.stack.pop()

    def close_p(self) -> None:
        self.implied_ends("p")
        self.pop_until("p")

    def reconstruct(self) -> None:
        a = self.active
        if not a or a[-1] is _MARK or a[-1] in self.stack:
            return
        i = len(a) - 1
        while i > 0 and a[i - 1] is not _MARK and a[i - 1] not in self.stack:
            i -= 1
        for k in range(i, len(a)):
            a[k] = self.insert(a[k].name, list(a[k].attrs))

    def add_active(self, node: Node) -> None:
        """At most three alike since the last marker."""
        alike = []
        for n in reversed(self.active):
            if n is _MARK:
                break
            if n.name == node.name and n.ns == node.ns and sorted(n.attrs) == sorted(node.attrs):
                alike.append(n)
        if len(alike) >= 3:
            self.active.remove(alike[-1])
        self.active.append(node)

    def clear_active(self) -> None:
        while self.active and self.active.pop() is not _MARK:
            pass

    def adopt(self, name: str) -> None:
        """The adoption agency algorithm for an end tag."""
        c = self.stack[-1]
        if c.ns == "html" and c.name == name and c not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            fmt = None
            for n in reversed(self.active):
                if n is _MARK:
                    break
                if n.name == name:
                    fmt = n
                    break
            if fmt is None:
                self.other_end(name)
                return
            if fmt not in self.stack:
                self.active.remove(fmt)
                return
            if not self.in_scope(fmt):
                return
            at = self.stack.index(fmt)
            block = next((n for n in self.stack[at + 1 :] if (n.name in self.special if n.ns == "html" else n.name in T.MATH_SCOPED or n.name in T.SVG_TIPS)), None)
            if block is None:
                del self.stack[at:]
                self.active.remove(fmt)
                return
            above = self.stack[at - 1]
            mark = self.active.index(fmt)
            node = last = block
            index = self.stack.index(block)
            k = 0
            while True:
                k += 1
                index -= 1
                node = self.stack[index]
                if node is fmt:
                    break
                if k > 3 and node in self.active:
                    if self.active.index(node) < mark:
                        mark -= 1
                    self.active.remove(node)
                if node not in self.active:
                    self.stack.remove(node)
                    continue
                copy = Node("element", node.name, node.ns, list(node.attrs), pos=node.pos)
                self.active[self.active.index(node)] = copy
                self.stack[self.stack.index(node)] = copy
                node = copy
                if last is block:
                    mark = self.active.index(node) + 1
                self._move(last, node)
                last = node
            self._detach(last)
            foster, self.foster = self.foster, True
            kids, parent, where = self._place(above)
            self.foster = foster
            kids.insert(where, last)
            last.parent = parent
            copy = Node("element", fmt.name, fmt.ns, list(fmt.attrs), pos=fmt.pos)
            copy.children, block.children = block.children, []
            for ch in copy.children:
                ch.parent = copy
            if block.content is not None:
                block.content.append(copy)
            else:
                block.children.append(copy)
            copy.parent = block
            if self.active.index(fmt) < mark:
                mark -= 1
            self.active.remove(fmt)
            self.active.insert(mark, copy)
            self.stack.remove(fmt)
            self.stack.insert(self.stack.index(block) + 1, copy)

    @staticmethod
    def _detach(node: Node) -> None:
        p = node.parent
        if p is not None:
            kids = p.content if p.content is not None and node in p.content else p.children
            if node in kids:
                kids.remove(node)

    def _move(self, node: Node, to: Node) -> None:
        self._detach(node)
        node.parent = to
        to.children.append(node)

    def other_end(self, name: str) -> None:
        for n in reversed(self.stack):
            if n.ns == "html" and n.name == name:
                self.implied_ends(name)
                while self.stack.pop() is not n:
                    pass
                return
            if n.ns == "html" and n.name in self.special:
                return

    def raw(self, token, state: str) -> None:
        self.insert(token[1], token[3])
        self.tok.state = state
        self.back, self.mode = self.mode, self.in_text

    def reset_mode(self) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            n = self.stack[i]
            name = n.name if n.ns == "html" else ""
            if name == "select":
                for a in reversed(self.stack[:i]):
                    if a.name == "template":
                        break
                    if a.name == "table":
                        self.mode = self.in_select_in_table
                        return
                self.mode = self.in_select
            elif name in ("td", "th") and i:
                self.mode = self.in_cell
            elif name == "tr":
                self.mode = self.in_row
            elif name in ("tbody", "thead", "tfoot"):
                self.mode = self.in_table_body
            elif name == "caption":
                self.mode = self.in_caption
            elif name == "colgroup":
                self.mode = self.in_column_group
            elif name == "table":
                self.mode = self.in_table
            elif name == "template":
                self.mode = self.templates[-1]
            elif name == "head" and i:
                self.mode = self.in_head
            elif name == "body" or i == 0 and name != "html":
                self.mode = self.in_body
            elif name == "frameset":
                self.mode = self.in_frameset
            elif name == "html":
                self.mode = self.before_head if self.head is None else self.after_head
            else:
                continue
            return
        self.mode = self.in_body

    # ------------------------------------------------------------- modes
    def initial(self, t):
        kind = t[0]
        if kind == TEXT:
            rest = t[4].lstrip(_SPACE)
            if not rest:
                return None
            self.mode = self.before_html
            self.feed((TEXT, "", False, None, rest))
            return None
        if kind == COMMENT:
            self.comment(t[4], self.doc)
            return None
        if kind == DOCTYPE:
            ids = dict(t[3])
            node = Node("doctype", t[1], attrs=t[3], pos=self.tok.start_pos)
            node.parent = self.doc
            self.doc.children.append(node)
            self.quirks = t[1] != "html" or ids["public"].lower().startswith(T.QUIRKY_PUBLIC)
            self.mode = self.before_html
            return None
        self.quirks = True
        self.mode = self.before_html
        return True

    def before_html(self, t):
        kind, name = t[0], t[1]
        if kind == DOCTYPE:
            return None
        if kind == COMMENT:
            self.comment(t[4], self.doc)
            return None
        if kind == TEXT:
            rest = t[4].lstrip(_SPACE)
            if not rest:
                return None
            t = (TEXT, "", False, None, rest)
        elif kind == START and name == "html":
            self.insert("html", t[3])
            self.mode = self.before_head
            return None
        elif kind == END and name not in ("head", "body", "html", "br"):
            return None
        self.insert("html")
        self.mode = self.before_head
        if kind == TEXT:
            self.feed(t)
            return None
        return True

    def before_head(self, t):
        kind, name = t[0], t[1]
        if kind == TEXT:
            rest = t[4].lstrip(_SPACE)
            if not rest:
                return None
            self.head = self.insert("head")
            self.mode = self.in_head
            self.feed((TEXT, "", False, None, rest))
            return None
        if kind == COMMENT:
            self.comment(t[4])
            return None
        if kind == DOCTYPE:
            return None
        if kind == START and name == "html":
            return self.in_body(t)
        if kind == START and name == "head":
            self.head = self.insert("head", t[3])
            self.mode = self.in_head
            return None
        if kind == END and name not in ("head", "body", "html", "br"):
            return None
        self.head = self.insert("head")
        self.mode = self.in_head
        return True

    def _space_prefix(self, t):
        """White space at the start of a text goes in here; the rest comes back."""
        rest = t[4].lstrip(_SPACE)
        lead = t[4][: len(t[4]) - len(rest)]
        if lead:
            self.text(lead)
        return (TEXT, "", False, None, rest) if rest else None

    def in_head(self, t):
        kind, name = t[0], t[1]
        if kind == TEXT:
            t = self._space_prefix(t)
            if t is None:
                return None
            self.stack.pop()
            self.mode = self.after_head
            self.feed(t)
            return None
        if kind == COMMENT:
            self.comment(t[4])
            return None
        if kind == DOCTYPE:
            return None
        if kind == START:
            if name == "html":
                return self.in_body(t)
            if name in ("base", "basefont", "bgsound", "link", "meta"):
                self.insert(name, t[3], push=False)
                return None
            if name == "title":
                self.raw(t, "rcdata")
                return None
            if name in ("noframes", "style") or (name == "noscript" and self.o.scripting):
                self.tok.last_start = name
                self.raw(t, "rawtext")
                return None
            if name == "noscript":
                self.insert(name, t[3])
                self.mode = self.in_head_noscript
                return None
            if name == "script":
                self.raw(t, "script")
                return None
            if name == "template":
                self.insert(name, t[3])
                self.active.append(_MARK)
                self.frameset_ok = False
                self.mode = self.in_template
                self.templates.append(self.in_template)
                return None
            if name == "head":
                return None
        elif kind == END:
            if name == "head":
                self.stack.pop()
                self.mode = self.after_head
                return None
            if name == "template":
                self.end_template()
                return None
            if name not in ("body", "html", "br"):
                return None
        self.stack.pop()
        self.mode = self.after_head
        return True

    def end_template(self) -> None:
        if any(n.name == "template" and n.ns == "html" for n in self.stack):
            self.implied_ends("", T.THOROUGH_END)
            self.pop_until("template")
            self.clear_active()
            if self.templates:
                self.templates.pop()
            self.reset_mode()

    def in_head_noscript(self, t):
        kind, name = t[0], t[1]
        if kind == DOCTYPE:
            return None
        if kind == START and name == "html":
            return self.in_body(t)
        if kind == END and name == "noscript":
            self.stack.pop()
            self.mode = self.in_head
            return None
        if kind == COMMENT or (kind == TEXT and not t[4].strip(_SPACE)) or (kind == START and name in ("basefont", "bgsound", "link", "meta", "noframes", "style")):
            return self.in_head(t)
        if (kind == START and name in ("head", "noscript")) or (kind == END and name != "br"):
            return None
        self.stack.pop()
        self.mode = self.in_head
        return True

    def after_head(self, t):
        kind, name = t[0], t[1]
        if kind == TEXT:
            t = self._space_prefix(t)
            if t is None:
                return None
            self.insert("body")
            self.mode = self.in_body
            self.feed(t)
            return None
        if kind == COMMENT:
            self.comment(t[4])
            return None
        if kind == DOCTYPE:
            return None
        if kind == START:
            if name == "html":
                return self.in_body(t)
            if name == "body":
                self.insert("body", t[3])
                self.frameset_ok = False
                self.mode = self.in_body
                return None
            if name == "frameset":
                self.insert("frameset", t[3])
                self.mode = self.in_frameset
                return None
            if name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
                self.stack.append(self.head)
                self.in_head(t)
                if self.head in self.stack:
                    self.stack.remove(self.head)
                return None
            if name == "head":
                return None
        elif kind == END:
            if name == "template":
                return self.in_head(t)
            if name not in ("body", "html", "br"):
                return None
        self.insert("body")
        self.mode = self.in_body
        return True

    def in_body(self, t):
        kind, name = t[0], t[1]
        if kind == TEXT:
            data = t[4]
            if "\0" in data:
                data = data.replace("\0", "")
                if not data:
                    return None
            self.reconstruct()
            self.text(data)
            if self.frameset_ok and data.strip(_SPACE):
                self.frameset_ok = False
            return None
        if kind == COMMENT:
            self.comment(t[4])
            return None
        if kind == DOCTYPE:
            return None
        if kind == EOF:
            return self.in_template(t) if self.templates else None
        if kind == START:
            return self.body_start(t, name, t[3])
        return self.body_end(t, name)

    def body_start(self, t, name, attrs):
        if name in T.CLOSES_P:
            if self.in_scope("p", T.BUTTON_SCOPE):
                self.close_p()
            self.insert(name, attrs)
        elif name == "a":
            for n in reversed(self.active):
                if n is _MARK:
                    break
                if n.name == "a":
                    self.adopt("a")
                    if n in self.active:
                        self.active.remove(n)
                    if n in self.stack:
                        self.stack.remove(n)
                    break
            self.reconstruct()
            self.add_active(self.insert(name, attrs))
        elif name == "li" or name in ("dd", "dt"):
            self.frameset_ok = False
            ends = ("li",) if name == "li" else ("dd", "dt")
            for n in reversed(self.stack):
                if n.ns == "html" and n.name in ends:
                    self.implied_ends(n.name)
                    self.pop_until(n.name)
                    break
                if (n.name in self.special if n.ns == "html" else True) and n.name not in ("address", "div", "p"):
                    break
            if self.in_scope("p", T.BUTTON_SCOPE):
                self.close_p()
            self.insert(name, attrs)
        elif name in T.HEADINGS:
            if self.in_scope("p", T.BUTTON_SCOPE):
                self.close_p()
            if self.stack[-1].ns == "html" and self.stack[-1].name in T.HEADINGS:
                self.stack.pop()
            self.insert(name, attrs)
        elif name in T.FORMATTING:
            self.reconstruct()
            if name == "nobr" and self.in_scope("nobr"):
                self.adopt("nobr")
                self.reconstruct()
            self.add_active(self.insert(name, attrs))
        elif name in ("area", "br", "embed", "img", "keygen", "wbr", "input"):
            self.reconstruct()
            self.insert(name, attrs, push=False)
            if name != "input" or not any(k == "type" and v.lower() == "hidden" for k, v in attrs):
                self.frameset_ok = False
        elif name in ("pre", "listing"):
            if self.in_scope("p", T.BUTTON_SCOPE):
                self.close_p()
            self.insert(name, attrs)
            self.skip_lf = True
            self.frameset_ok = False
        elif name == "form":
            templated = any(n.name == "template" and n.ns == "html" for n in self.stack)
            if self.form is not None and not templated:
                return None
            if self.in_scope("p", T.BUTTON_SCOPE):
                self.close_p()
            node = self.insert(name, attrs)
            if not templated:
                self.form = node
        elif name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
            return self.in_head(t)
        elif name == "html":
            if not any(n.name == "template" for n in self.stack) and self.stack:
                self._add_attrs(self.stack[0], attrs)
        elif name == "body":
            if len(self.stack) > 1 and self.stack[1].name == "body" and not any(n.name == "template" for n in self.stack):
                self.frameset_ok = False
                self._add_attrs(self.stack[1], attrs)
        elif name == "frameset":
            if len(self.stack) > 1 and self.stack[1].name == "body" and self.frameset_ok:
                self._detach(self.stack[1])
                del self.stack[1:]
                self.insert(name, attrs)
                self.mode = self.in_frameset
        elif name == "plaintext":
            if self.in_scope("p", T.BUTTON_SCOPE):
                self.close_p()
            self.insert(name, attrs)
            self.tok.state = "plaintext"
        elif name == "button":
            if self.in_scope("button"):
                self.implied_ends()
                self.pop_until("button")
            self.reconstruct()
            self.insert(name, attrs)
            self.frameset_ok = False
        elif name in ("applet", "marquee", "object"):
            self.reconstruct()
            self.insert(name, attrs)
            self.active.append(_MARK)
            self.frameset_ok = False
        elif name == "table":
            if not self.quirks and self.in_scope("p", T.BUTTON_SCOPE):
                self.close_p()
            self.insert(name, attrs)
            self.frameset_ok = False
            self.mode = self.in_table
        elif name in ("param", "source", "track"):
            self.insert(name, attrs, push=False)
        elif name == "hr":
            if self.in_scope("p", T.BUTTON_SCOPE):
                self.close_p()
            self.insert(name, attrs, push=False)
            self.frameset_ok = False
        elif name == "image":
            return self.body_start(("start", "img", t[2], attrs, ""), "img", attrs)
        elif name == "textarea":
            self.raw(t, "rcdata")
            self.skip_lf = True
            self.frameset_ok = False
        elif name == "xmp":
            if self.in_scope("p", T.BUTTON_SCOPE):
                self.close_p()
            self.reconstruct()
            self.frameset_ok = False
            self.raw(t, "rawtext")
        elif name == "iframe":
            self.frameset_ok = False
            self.raw(t, "rawtext")
        elif name == "noembed" or (name == "noscript" and self.o.scripting):
            self.raw(t, "rawtext")
        elif name == "select":
            self.reconstruct()
            self.insert(name, attrs)
            self.frameset_ok = False
            in_table = self.mode in (self.in_table, self.in_caption, self.in_table_body, self.in_row, self.in_cell)
            self.mode = self.in_select_in_table if in_table else self.in_select
        elif name in ("optgroup", "option"):
            if self.stack[-1].name == "option":
                self.stack.pop()
            self.reconstruct()
            self.insert(name, attrs)
        elif name in ("rb", "rtc"):
            if self.in_scope("ruby"):
                self.implied_ends()
            self.insert(name, attrs)
        elif name in ("rp", "rt"):
            if self.in_scope("ruby"):
                self.implied_ends("rtc")
            self.insert(name, attrs)
        elif name in ("math", "svg"):
            self.reconstruct()
            self.insert(name, self._foreign_attrs(attrs, name), name, push=not t[2])
        elif name in ("caption", "col", "colgroup", "frame", "head", "tbody", "td", "tfoot", "th", "thead", "tr"):
            return None
        else:
            self.reconstruct()
            self.insert(name, attrs)
        return None

    @staticmethod
    def _add_attrs(node: Node, attrs) -> None:
        have = {k for k, _ in node.attrs}
        node.attrs += [a for a in attrs if a[0] not in have]

    def body_end(self, t, name):
        if name != "p" and (name in T.CLOSES_P or name in ("button", "listing", "pre")):
            if self.in_scope(name):
                self.implied_ends()
                self.pop_until(name)
        elif name == "p":
            if not self.in_scope("p", T.BUTTON_SCOPE):
                self.insert("p")
            self.close_p()
        elif name in T.FORMATTING:
            self.adopt(name)
        elif name == "li":
            if self.in_scope("li", T.LIST_SCOPE):
                self.implied_ends("li")
                self.pop_until("li")
        elif name in ("dd", "dt"):
            if self.in_scope(name):
                self.implied_ends(name)
                self.pop_until(name)
        elif name in T.HEADINGS:
            if self.in_scope(T.HEADINGS):
                self.implied_ends()
                self.pop_until(*T.HEADINGS)
        elif name in ("body", "html"):
            if self.in_scope("body"):
                self.mode = self.after_body
                return name == "html"
        elif name == "form":
            if any(n.name == "template" and n.ns == "html" for n in self.stack):
                if self.in_scope("form"):
                    self.implied_ends()
                    self.pop_until("form")
            else:
                node, self.form = self.form, None
                if node is not None and node in self.stack and self.in_scope(node):
                    self.implied_ends()
                    self.stack.remove(node)
        elif name in ("applet", "marquee", "object"):
            if self.in_scope(name):
                self.implied_ends()
                self.pop_until(name)
                self.clear_active()
        elif name == "br":
            self.reconstruct()
            self.insert("br", push=False)
            self.frameset_ok = False
        elif name == "template":
            self.end_template()
        else:
            self.other_end(name)
        return None

    def in_text(self, t):
        kind = t[0]
        if kind == TEXT:
            self.text(t[4])
            return None
        self.stack.pop()
        self.mode = self.back
        return True if kind == EOF else None

    def in_table(self, t):
        kind, name = t[0], t[1]
        if kind == TEXT and self.stack[-1].name in ("table", "tbody", "template", "tfoot", "thead", "tr"):
            self.table_text = []
            self.back, self.mode = self.mode, self.in_table_text
            return True
        if kind == COMMENT:
            self.comment(t[4])
            return None
        if kind == DOCTYPE:
            return None
        if kind == EOF:
            return self.in_body(t)
        if kind == START:
            if name in ("caption", "colgroup", "col", "tbody", "tfoot", "thead", "td", "th", "tr"):
                self.clear_to(("table", "template", "html"))
                if name == "caption":
                    self.active.append(_MARK)
                    self.insert(name, t[3])
                    self.mode = self.in_caption
                elif name == "colgroup":
                    self.insert(name, t[3])
                    self.mode = self.in_column_group
                elif name == "col":
                    self.insert("colgroup")
                    self.mode = self.in_column_group
                    return True
                elif name in ("tbody", "tfoot", "thead"):
                    self.insert(name, t[3])
                    self.mode = self.in_table_body
                else:
                    self.insert("tbody")
                    self.mode = self.in_table_body
                    return True
                return None
            if name == "table":
                if not self.in_scope("table", T.TABLE_SCOPE):
                    return None
                self.pop_until("table")
                self.reset_mode()
                return True
            if name in ("style", "script", "template"):
                return self.in_head(t)
            if name == "input" and any(k == "type" and v.lower() == "hidden" for k, v in t[3]):
                self.insert(name, t[3], push=False)
                return None
            if name == "form":
                if self.form is None and not any(n.name == "template" for n in self.stack):
                    self.form = self.insert(name, t[3], push=True)
                    self.stack.pop()
                return None
        elif kind == END:
            if name == "table":
                if self.in_scope("table", T.TABLE_SCOPE):
                    self.pop_until("table")
                    self.reset_mode()
                return None
            if name in ("body", "caption", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
                return None
            if name == "template":
                self.end_template()
                return None
        self.foster = True
        again = self.in_body(t)
        self.foster = False
        return again

    def clear_to(self, names) -> None:
        while not (self.stack[-1].ns == "html" and self.stack[-1].name in names):
            self.stack.pop()

    def in_table_text(self, t):
        if t[0] == TEXT:
            data = t[4].replace("\0", "")
            if data:
                self.table_text.append(data)
            return None
        data = "".join(self.table_text)
        self.mode = self.back
        if data.strip(_SPACE):
            self.foster = True
            self.in_body((TEXT, "", False, None, data))
            self.foster = False
        elif data:
            self.text(data)
        return True

    def in_caption(self, t):
        kind, name = t[0], t[1]
        ends = kind == END and name == "caption"
        outer = (kind == START and name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr")) or (kind == END and name == "table")
        if ends or outer:
            if not self.in_scope("caption", T.TABLE_SCOPE):
                return None
            self.implied_ends()
            self.pop_until("caption")
            self.clear_active()
            self.mode = self.in_table
            return outer
        if kind == END and name in ("body", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
            return None
        return self.in_body(t)

    def in_column_group(self, t):
        kind, name = t[0], t[1]
        if kind == TEXT:
            t = self._space_prefix(t)
            if t is None:
                return None
            if self.stack[-1].name != "colgroup":
                return None
            self.stack.pop()
            self.mode = self.in_table
            self.feed(t)
            return None
        if kind == COMMENT:
            self.comment(t[4])
            return None
        if kind == DOCTYPE:
            return None
        if kind == START and name == "html" or kind == EOF:
            return self.in_body(t)
        if kind == START and name == "col":
            self.insert(name, t[3], push=False)
            return None
        if (kind == START or kind == END) and name == "template":
            return self.in_head(t)
        if kind == END and name == "col" or self.stack[-1].name != "colgroup":
            return None
        self.stack.pop()
        self.mode = self.in_table
        return not (kind == END and name == "colgroup")

    def in_table_body(self, t):
        kind, name = t[0], t[1]
        if kind == START and name == "tr":
            self.clear_to(("tbody", "tfoot", "thead", "template", "html"))
            self.insert(name, t[3])
            self.mode = self.in_row
            return None
        if kind == START and name in ("th", "td"):
            self.clear_to(("tbody", "tfoot", "thead", "template", "html"))
            self.insert("tr")
            self.mode = self.in_row
            return True
        if kind == END and name in ("tbody", "tfoot", "thead"):
            if self.in_scope(name, T.TABLE_SCOPE):
                self.clear_to(("tbody", "tfoot", "thead", "template", "html"))
                self.stack.pop()
                self.mode = self.in_table
            return None
        if (kind == START and name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead")) or (kind == END and name == "table"):
            if not self.in_scope(("tbody", "tfoot", "thead"), T.TABLE_SCOPE):
                return None
            self.clear_to(("tbody", "tfoot", "thead", "template", "html"))
            self.stack.pop()
            self.mode = self.in_table
            return True
        if kind == END and name in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            return None
        return self.in_table(t)

    def in_row(self, t):
        kind, name = t[0], t[1]
        if kind == START and name in ("th", "td"):
            self.clear_to(("tr", "template", "html"))
            self.insert(name, t[3])
            self.mode = self.in_cell
            self.active.append(_MARK)
            return None
        row_end = kind == END and name == "tr"
        if row_end or (kind == START and name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr")) or (kind == END and name == "table"):
            if not self.in_scope("tr", T.TABLE_SCOPE):
                return None
            self.clear_to(("tr", "template", "html"))
            self.stack.pop()
            self.mode = self.in_table_body
            return not row_end
        if kind == END and name in ("tbody", "tfoot", "thead"):
            if not self.in_scope(name, T.TABLE_SCOPE) or not self.in_scope("tr", T.TABLE_SCOPE):
                return None
            self.clear_to(("tr", "template", "html"))
            self.stack.pop()
            self.mode = self.in_table_body
            return True
        if kind == END and name in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            return None
        return self.in_table(t)

    def in_cell(self, t):
        kind, name = t[0], t[1]
        if kind == END and name in ("td", "th"):
            if self.in_scope(name, T.TABLE_SCOPE):
                self.implied_ends()
                self.pop_until(name)
                self.clear_active()
                self.mode = self.in_row
            return None
        if kind == START and name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"):
            if not self.in_scope(("td", "th"), T.TABLE_SCOPE):
                return None
            self.close_cell()
            return True
        if kind == END and name in ("body", "caption", "col", "colgroup", "html"):
            return None
        if kind == END and name in ("table", "tbody", "tfoot", "thead", "tr"):
            if not self.in_scope(name, T.TABLE_SCOPE):
                return None
            self.close_cell()
            return True
        return self.in_body(t)

    def close_cell(self) -> None:
        self.implied_ends()
        self.pop_until("td", "th")
        self.clear_active()
        self.mode = self.in_row

    def in_select(self, t):
        kind, name = t[0], t[1]
        if kind == TEXT:
            data = t[4].replace("\0", "")
            if data:
                self.text(data)
            return None
        if kind == COMMENT:
            self.comment(t[4])
            return None
        if kind == DOCTYPE:
            return None
        if kind == EOF:
            return self.in_body(t)
        top = self.stack[-1].name
        if kind == START:
            if name == "html":
                return self.in_body(t)
            if name in ("option", "optgroup", "hr"):
                if top == "option":
                    self.stack.pop()
                if name != "option" and self.stack[-1].name == "optgroup":
                    self.stack.pop()
                self.insert(name, t[3], push=name != "hr")
                return None
            if name in ("select", "input", "keygen", "textarea"):
                if not self.in_scope_select():
                    return None
                self.pop_until("select")
                self.reset_mode()
                return name != "select"
            if name in ("script", "template"):
                return self.in_head(t)
            return None
        if name == "optgroup":
            if top == "option" and len(self.stack) > 1 and self.stack[-2].name == "optgroup":
                self.stack.pop()
            if self.stack[-1].name == "optgroup":
                self.stack.pop()
        elif name == "option":
            if top == "option":
                self.stack.pop()
        elif name == "select":
            if self.in_scope_select():
                self.pop_until("select")
                self.reset_mode()
        elif name == "template":
            self.end_template()
        return None

    def in_scope_select(self) -> bool:
        for n in reversed(self.stack):
            if n.name == "select":
                return True
            if n.name not in ("optgroup", "option"):
                return False
        return False

    def in_select_in_table(self, t):
        kind, name = t[0], t[1]
        if kind in (START, END) and name in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            if kind == END and not self.in_scope(name, T.TABLE_SCOPE):
                return None
            self.pop_until("select")
            self.reset_mode()
            return True
        return self.in_select(t)

    def in_template(self, t):
        kind, name = t[0], t[1]
        if kind in (TEXT, COMMENT, DOCTYPE):
            return self.in_body(t)
        if kind == EOF:
            if not any(n.name == "template" and n.ns == "html" for n in self.stack):
                return None
            self.pop_until("template")
            self.clear_active()
            self.templates.pop()
            self.reset_mode()
            return True
        if kind == END:
            if name == "template":
                self.end_template()
            return None
        if name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
            return self.in_head(t)
        mode = (
            self.in_table if name in ("caption", "colgroup", "tbody", "tfoot", "thead")
            else self.in_column_group if name == "col"
            else self.in_table_body if name == "tr"
            else self.in_row if name in ("td", "th")
            else self.in_body
        )
        self.templates[-1] = self.mode = mode
        return True

    def after_body(self, t):
        kind, name = t[0], t[1]
        if kind == TEXT and not t[4].strip(_SPACE):
            return self.in_body(t)
        if kind == COMMENT:
            self.comment(t[4], self.stack[0])
            return None
        if kind == DOCTYPE or kind == EOF:
            return None
        if kind == START and name == "html":
            return self.in_body(t)
        if kind == END and name == "html":
            self.mode = self.after_after_body
            return None
        self.mode = self.in_body
        return True

    def after_after_body(self, t):
        kind = t[0]
        if kind == COMMENT:
            self.comment(t[4], self.doc)
            return None
        if kind == EOF:
            return None
        if kind == DOCTYPE or (kind == TEXT and not t[4].strip(_SPACE)) or (kind == START and t[1] == "html"):
            return self.in_body(t)
        self.mode = self.in_body
        return True

    def in_frameset(self, t):
        kind, name = t[0], t[1]
        if kind == TEXT:
            data = "".join(c for c in t[4] if c in _SPACE)
            if data:
                self.text(data)
        elif kind == COMMENT:
            self.comment(t[4])
        elif kind == START and name == "frameset":
            self.insert(name, t[3])
        elif kind == START and name == "frame":
            self.insert(name, t[3], push=False)
        elif kind == START and name == "noframes":
            return self.in_head(t)
        elif kind == END and name == "frameset" and len(self.stack) > 1:
            self.stack.pop()
            if self.stack[-1].name != "frameset":
                self.mode = self.after_frameset
        return None

    def after_frameset(self, t):
        kind, name = t[0], t[1]
        if kind == TEXT:
            data = "".join(c for c in t[4] if c in _SPACE)
            if data:
                self.text(data)
        elif kind == COMMENT:
            self.comment(t[4])
        elif kind == START and name == "noframes":
            return self.in_head(t)
        return None

    # ------------------------------------------------------------- foreign content
    def foreign(self, t) -> None:
        kind, name = t[0], t[1]
        if kind == TEXT:
            data = t[4].replace("\0", "�")
            self.text(data)
            if data.strip(_SPACE):
                self.frameset_ok = False
        elif kind == COMMENT:
            self.comment(t[4])
        elif kind == START:
            if name in T.BREAKS_OUT or (name == "font" and any(k in ("color", "face", "size") for k, _ in t[3])):
                while not (self.stack[-1].ns == "html" or self._html_point(self.stack[-1]) or (self.stack[-1].ns == "math" and self.stack[-1].name in T.MATH_TIPS)):
                    self.stack.pop()
                while self.mode(t) is True:
                    pass
                return
            ns = self.stack[-1].ns
            if ns == "svg":
                name = T.SVG_NAMES.get(name, name)
            self.insert(name, self._foreign_attrs(t[3], ns), ns, push=not t[2])
        elif kind == END:
            if name in ("br", "p"):
                while not (self.stack[-1].ns == "html" or self._html_point(self.stack[-1]) or (self.stack[-1].ns == "math" and self.stack[-1].name in T.MATH_TIPS)):
                    self.stack.pop()
                while self.mode(t) is True:
                    pass
                return
            for i in range(len(self.stack) - 1, 0, -1):
                n = self.stack[i]
                if n.ns == "html":
                    while self.mode(t) is True:
                        pass
                    return
                if n.name.lower() == name:
                    del self.stack[i:]
                    return

    @staticmethod
    def _foreign_attrs(attrs, ns):
        if ns == "svg":
            return [(T.SVG_ATTRS.get(k, k), v) for k, v in attrs]
        return [("definitionURL" if k == "definitionurl" else k, v) for k, v in attrs]


#: Columns of a page's nodes, in the order ``parse_nodes`` returns them.
COLUMNS = ("node_id", "parent_id", "sub_end", "depth", "child_no", "kind", "node_name", "local_name", "attrs", "content", "public_id", "system_id", "flags", "ns", "template_of", "ancestors", "src_pos")


def parse_nodes(html: str | None, options: ParseOptions | None = None, token_filter: TokenFilter | None = None, ancestors: bool = True) -> list[tuple]:
    """The nodes of a document as rows (``COLUMNS``): the tree in document order, behind it
    the contents of each template in the order of the templates, and behind these what
    templates within them hold. So no ``sub_end`` but that of a node of the contents
    covers any of them, and walks from outside pass a template by. Contents carry the
    template's node_id as parent and in ``template_of``. Text of only white space is
    dropped unless asked for. Null html gives no rows. ``ancestors`` (nearest first, the
    template's included) grow with the square of the depth; they are null if not wanted."""
    if html is None:
        return []
    o = options or ParseOptions()
    root = TreeBuilder(html, o, token_filter).run()
    rows: list[list] = []
    # explicit stack: (node, parent id, depth, child number, template, ancestors)
    work: list = [(root, None, 0, 0, None, ())]
    later: deque = deque()
    while work or later:
        if not work:
            work += later.popleft()
        item = work.pop()
        if item[0] is None:
            rows[item[1]][2] = len(rows) - 1  # every node below is out by now
            continue
        node, parent, depth, number, owner, up = item
        at = len(rows)
        kind = node.kind
        element = kind == "element"
        is_doc = kind == "document"
        ids = dict(node.attrs) if kind == "doctype" else None
        rows.append([
            at, parent, at, depth, number, kind,
            node.name if element or is_doc or kind == "doctype" else node.data,
            node.name if element or is_doc or kind == "doctype" else None,
            node.attrs if element else None,
            None if element or is_doc or ids is not None else node.data,
            ids["public"] if ids else None, ids["system"] if ids else None,
            T.flags_of(node.name, node.ns) if element or is_doc else 0,
            node.ns if element else None, owner, up if ancestors else None, node.pos if o.positions else None,
        ])
        below = (at, *up) if ancestors else up
        if node.content:
            later.append([(c, at, depth + 1, k, at, below) for k, c in reversed(list(enumerate(_kept(node.content, o))))])
        if node.children:
            work.append((None, at))
            work += [(c, at, depth + 1, k, owner, below) for k, c in reversed(list(enumerate(_kept(node.children, o))))]
    return [tuple(r) for r in rows]


def _kept(children: list[Node], o: ParseOptions) -> list[Node]:
    if o.emit_whitespace:
        return children
    return [c for c in children if c.kind != "text" or c.data.strip(_DROPPED)]
