"""Template and page markup: a tokenizer, the tree of what it yields, and both as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_SKIP = re.compile(r"<%!--|<!--|<%")
_CLOSERS = {"<%!--": "--%>", "<!--": "-->", "<%": "%>"}
_TAG = re.compile(r"(?:[A-Za-z]|[.:])[A-Za-z0-9_.-]*")
_CLOSE = re.compile(r"([A-Za-z.:][A-Za-z0-9_.-]*)\s*>")
_ATTR = re.compile(r"[A-Za-z0-9_:@.-]+")
_SPACE = re.compile(r"[ \t\n\r]*")
_BARE = re.compile(r"(?:(?!/>)[^> \t\n\r])*")
_TEXT = re.compile(r"[^<{]*")
_BRACE = re.compile(r'''"""(?P<doc>.*?)(?:"""|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|(?P<sigil>~[A-Za-z]\{)|[{}]''', re.S)
_SLOT = re.compile(r"\s*render_slot\(\s*(?:@(?P<at>\w+)|assigns\.(?P<dot>\w+)|(?P<var>[a-z_]\w*[?!]?))\s*[,)]")
_SLOT_BARE = re.compile(r"\s*render_slot\s+(?:@(?P<at>\w+)|assigns\.(?P<dot>\w+)|(?P<var>[a-z_]\w*[?!]?))\s*(?:,|$)")
_FOR = re.compile(r"\s*(?P<var>[a-z_]\w*[?!]?)\s*<-\s*@(?P<slot>\w+)\s*$")


@dataclass
class Expr:
    """The source of a braced attribute value."""

    source: str


@dataclass
class Token:
    kind: str  # open, close, self
    tag: str
    attrs: dict = field(default_factory=dict)
    expr: str | None = None


@dataclass
class Element:
    """An element, an expression (``expr``), or a slot placeholder (``slot``, or ``slot_var`` while unbound)."""

    tag: str
    attrs: dict = field(default_factory=dict)
    children: list["Element"] = field(default_factory=list)
    expr: str | None = None
    slot: str | None = None
    slot_var: str | None = None

    @property
    def repeat(self) -> bool:
        return ":for" in self.attrs

    @property
    def class_source(self) -> str | Expr | None:
        value = self.attrs.get("class")
        return value if isinstance(value, (str, Expr)) else None


def braced(text: str, at: int) -> tuple[str, int]:
    """The expression from ``at`` to its closing brace, and where it ends. Strings, heredocs and sigils count as one."""
    start, depth = at, 1
    while m := _BRACE.search(text, at):
        at = m.end()
        if m["sigil"]:
            at = _sigil_end(text, at)
        elif m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                return text[start : m.start()], at
    return text[start:], len(text)


def _sigil_end(text: str, at: int) -> int:
    depth = 1
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def _attributes(text: str, at: int) -> tuple[dict, bool, int] | None:
    """Attributes (the last of a name wins), whether the tag closes itself, and its end; None if it never ends."""
    attrs: dict = {}
    while True:
        at = _SPACE.match(text, at).end()
        if text.startswith("/>", at):
            return attrs, True, at + 2
        if text.startswith(">", at):
            return attrs, False, at + 1
        if at >= len(text):
            return None
        m = _ATTR.match(text, at)
        if not m:
            at += 1
            continue
        name, at = m[0], m.end()
        if not text.startswith("=", at):
            attrs[name] = True
            continue
        at = _SPACE.match(text, at + 1).end()
        quote = text[at : at + 1]
        if quote in ('"', "'"):
            end = text.find(quote, at + 1)
            end = len(text) if end < 0 else end
            attrs[name], at = text[at + 1 : end], min(len(text), end + 1)
        elif quote == "{":
            source, at = braced(text, at + 1)
            attrs[name] = Expr(source)
        else:
            m = _BARE.match(text, at)
            attrs[name], at = m[0], m.end()


def tokenize(text: str) -> Iterator[Token]:
    """Tags and braced expressions. Comments and ``<% %>`` blocks are passed over; one that is never closed ends the text, as does a broken closing tag."""
    at = 0
    while at < len(text):
        at = _TEXT.match(text, at).end()
        if at >= len(text):
            return
        if text[at] == "{":
            source, at = braced(text, at + 1)
            yield Token("self", "", expr=source)
            continue
        if m := _SKIP.match(text, at):
            closer = _CLOSERS[m[0]]
            end = text.find(closer, m.end())
            if end < 0:
                return
            at = end + len(closer)
            continue
        if text.startswith("</", at):
            m = _CLOSE.match(text, at + 2)
            if not m:
                return
            yield Token("close", m[1])
            at = m.end()
            continue
        m = _TAG.match(text, at + 1)
        got = _attributes(text, m.end()) if m else None
        if got is None:
            at += 1
            continue
        attrs, closed, at = got
        yield Token("self" if closed or m[0] in VOID else "open", m[0], attrs)


def _element(token: Token) -> Element:
    e = Element(token.tag, token.attrs, expr=token.expr)
    if token.expr is not None:
        m = _SLOT.match(token.expr) or _SLOT_BARE.match(token.expr)
        if m:
            e.expr, e.slot, e.slot_var = None, m["at"] or m["dot"], m["var"]
    return e


def build_tree(tokens: Iterator[Token]) -> list[Element]:
    """The forest of the tokens.

    A closing tag closes the innermost open element of its name; those open inside it lose their place as
    parents and follow as siblings of its children, each with what it holds. One that closes nothing is
    passed over. What is still open at the end follows the roots, the innermost first.
    """
    roots: list[Element] = []
    stack: list[Element] = []
    for t in tokens:
        if t.kind == "open":
            stack.append(_element(t))
            continue
        if t.kind == "self":
            done = _element(t)
        else:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == t.tag), None)
            if at is None:
                continue
            done = stack[at]
            done.children += stack[at + 1 :]
            del stack[at:]
        (stack[-1].children if stack else roots).append(done)
    return roots + stack[::-1]


def bind_slots(nodes: list[Element], bound: dict[str, str] | None = None) -> None:
    """Give ``render_slot(v)`` below ``:for={v <- @slot}`` the name of the slot."""
    for n in nodes:
        if n.slot_var and n.slot_var in (bound or {}):
            n.slot, n.slot_var = bound[n.slot_var], None
        own = n.attrs.get(":for")
        m = _FOR.match(own.source) if isinstance(own, Expr) else None
        bind_slots(n.children, {**(bound or {}), m["var"]: m["slot"]} if m else bound)


def parse_markup(text: str) -> list[Element]:
    nodes = build_tree(tokenize(text))
    bind_slots(nodes)
    return nodes


def _mapped(docs: DataFrame, key: str, text: str, make, schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *r) for k, t in zip(frame[key], frame[text], strict=True) if t for r in make(t)]
            yield pd.DataFrame(rows, columns=columns)

    return docs.select(key, text).mapInPandas(run, schema)


def _class_text(attrs: dict) -> str | None:
    value = attrs.get("class")
    return value if isinstance(value, str) else None


def token_rows(docs: DataFrame, key: str, text: str, key_type: str = "long") -> DataFrame:
    """``(key, pos, kind, tag, class_text, n_attrs)`` of every tag and expression."""
    return _mapped(docs, key, text, lambda t: [(i, x.kind, x.tag, _class_text(x.attrs), len(x.attrs)) for i, x in enumerate(tokenize(t))], f"{key} {key_type}, pos int, kind string, tag string, class_text string, n_attrs int")


def attribute_rows(docs: DataFrame, key: str, text: str, key_type: str = "long") -> DataFrame:
    """``(key, pos, tag, name, value)`` of every attribute; a boolean one has a null value, an expression its source."""

    def make(t: str) -> list[tuple]:
        out = []
        for i, x in enumerate(tokenize(t)):
            out += [(i, x.tag, n, None if v is True else v.source if isinstance(v, Expr) else v) for n, v in x.attrs.items()]
        return out

    return _mapped(docs, key, text, make, f"{key} {key_type}, pos int, tag string, name string, value string")


def node_rows(docs: DataFrame, key: str, text: str, key_type: str = "long") -> DataFrame:
    """``(key, node, parent, depth, sibling, tag, class_text, repeat)`` of the tree, numbered in document order."""

    def make(t: str) -> list[tuple]:
        out: list[tuple] = []
        stack = [(n, None, 0, i) for i, n in reversed(list(enumerate(parse_markup(t))))]
        while stack:
            n, parent, depth, sibling = stack.pop()
            me = len(out)
            tag = "__expr__" if n.expr is not None else f"__slot__:{n.slot}" if n.slot else f"__slot_var__:{n.slot_var}" if n.slot_var else n.tag
            out.append((me, parent, depth, sibling, tag, _class_text(n.attrs), n.repeat))
            stack += [(c, me, depth + 1, i) for i, c in reversed(list(enumerate(n.children)))]
        return [(a, -1 if p is None else p, *rest) for a, p, *rest in out]

    return _mapped(docs, key, text, make, f"{key} {key_type}, node int, parent int, depth int, sibling int, tag string, class_text string, repeat boolean")
