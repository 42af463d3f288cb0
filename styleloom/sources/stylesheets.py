"""Stylesheets: a tokenizer for rules, at-rules and declarations with line numbers, and a parser for selectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SEGMENT

#: What stands before the name of a rule that was put out of use, and at-rules whose rules are no selectors.
PREFIX = "____unmatched___"
MARKER = f".{PREFIX}"
SKIPPED_AT_RULES = ("source", "plugin", "custom-variant")

#: Rows that a task hands over at a time.
ROWS = 10_000

#: Lines of imports and directives that no file stands for.
SKIPPED_IMPORT = r"""^@import\s+["']tailwindcss["']|^@import\s+["']phoenix-colocated/|^@import\s+(url\()?["']?https?://"""
SKIPPED_DIRECTIVE = r"^@(source|plugin)\s"


@dataclass(slots=True)
class Block:
    """A rule or at-rule: its head, line and place in the text, with what is inside."""

    head: str
    line: int
    start: int
    end: int = 0
    parent: "Block | None" = None
    body: list["Block"] = field(default_factory=list)
    declarations: list[tuple[str, str, int]] = field(default_factory=list)
    open: int = 0
    plain: str = ""

    @property
    def at_rule(self) -> tuple[str, str] | None:
        m = re.match(r"@([\w-]+)\s*(.*)", self.plain, re.S)
        return (m[1], m[2].strip()) if m else None

    def above(self) -> Iterator["Block"]:
        node = self.parent
        while node is not None and node.head:
            yield node
            node = node.parent


_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_BEFORE = re.compile(r"\s*(?:/\*.*?(?:\*/|\Z))?", re.S)
_LEX = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|\\.|[(){};]""", re.S)


def parse_stylesheet(text: str) -> Block:
    """The tree of blocks of a stylesheet; the root has an empty head. Unbalanced braces raise ValueError."""
    root = Block("", 1, 0)
    here, start, depth = root, 0, 0
    line, counted = 1, 0

    def head_of(end: int) -> tuple[str, int, str]:
        a = start
        while (after := _BEFORE.match(text, a, end).end()) > a:
            a = after
        raw = text[a:end].rstrip()
        return raw, a, _COMMENT.sub("", raw).strip()

    def line_of(a: int) -> int:
        """The line of a place; heads are asked for in their order, so that each line break counts once."""
        nonlocal line, counted
        line, counted = line + text.count("\n", counted, a), a
        return line

    def declare(end: int) -> None:
        raw, a, plain = head_of(end)
        if not plain:
            return
        at = line_of(a)
        if plain.startswith("@"):
            here.body.append(Block(raw, at, a, end + 1, here, plain=plain))
        elif ":" in plain:
            name, value = plain.split(":", 1)
            here.declarations.append((name.strip(), value.strip(), at))

    for m in _LEX.finditer(text):
        t = m[0]
        if t == "(":
            depth += 1
        elif t == ")":
            depth = max(0, depth - 1)
        elif depth and t in "{};":
            continue
        elif t == "{":
            raw, a, plain = head_of(m.start())
            block = Block(raw, line_of(a), a, parent=here, open=m.end(), plain=plain)
            here.body.append(block)
            here, start = block, m.end()
        elif t == "}":
            declare(m.start())
            if here is root:
                raise ValueError("a closing brace without a block")
            here.end = m.end()
            here, start = here.parent, m.end()
        elif t == ";":
            declare(m.start())
            start = m.end()
    if here is not root:
        raise ValueError("a block that isn't closed")
    declare(len(text))
    root.end = len(text)
    return root


def walk(block: Block) -> Iterator[Block]:
    for b in block.body:
        yield b
        yield from walk(b)


def rules(root: Block) -> Iterator[Block]:
    """The rules in order, without those inside at-rules that hold no selectors."""
    for b in walk(root):
        if b.at_rule is None and b.open and not any(_no_selectors(a) for a in b.above()):
            yield b


def _no_selectors(block: Block) -> bool:
    at = block.at_rule
    return at is not None and (at[0] in SKIPPED_AT_RULES or at[0] == "import" and "tailwindcss" in at[1])


# --- selectors --------------------------------------------------------------------------------

_NAME = r"(?:\\[0-9a-fA-F]{1,6}\s?|\\.|[\w-]|[^\x00-\x7F])+"
_SIMPLE = re.compile(rf"(?P<cls>\.{_NAME})|(?P<id>\#{_NAME})|(?P<attr>\[(?:[^\]\"']|\"[^\"]*\"|'[^']*')*\])|(?P<pseudo>::?{_NAME})|(?P<all>\*|&)|(?P<tag>{_NAME}%?|[\d.]+%)|(?P<comb>\s*[>+~]\s*|\s+)", re.S)
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", re.S)


def unescape(name: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else m[2], name)


def split_selectors(head: str) -> list[str]:
    """The members of a selector list; commas in brackets and strings don't count."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r"""\\.|"(?:\\.|[^"])*"|'(?:\\.|[^'])*'|[()\[\],]""", head, re.S):
        t = m[0]
        if t in "([":
            depth += 1
        elif t in ")]":
            depth -= 1
        elif t == "," and not depth:
            out.append(head[start : m.start()])
            start = m.end()
    return [s.strip() for s in [*out, head[start:]]]


def parse_selector(text: str) -> list[tuple[str, str, list]]:
    """Simple selectors and combinators in order: (type, value, what a pseudo holds). Anything else raises ValueError."""
    out, at = [], 0
    text = text.strip()
    if not text:
        raise ValueError("an empty selector")
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise ValueError(f"not a selector: {text!r}")
        kind, value, at, inner = m.lastgroup, m[0], m.end(), []
        if kind == "pseudo" and text[at : at + 1] == "(":
            end = _closing(text, at)
            content = text[at + 1 : end - 1]
            try:
                inner = [parse_selector(s) for s in split_selectors(content)] if content.strip() else []
            except ValueError:
                inner = []
            at = end
        out.append((kind, unescape(value[1:]) if kind in ("cls", "id") else unescape(value) if kind == "tag" else value, inner))
    return out


def _closing(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"""\\.|"(?:\\.|[^"])*"|'(?:\\.|[^'])*'|[()]""", re.S).finditer(text, at):
        depth += (m[0] == "(") - (m[0] == ")")
        if not depth:
            return m.end()
    raise ValueError(f"a bracket that isn't closed: {text!r}")


def classes_in(parsed: list) -> list[str]:
    """Every class in a selector, those inside pseudos too."""
    return [c for kind, value, inner in parsed for c in ([value] if kind == "cls" else [x for s in inner for x in classes_in(s)])]


def all_classes(text: str) -> list[str]:
    try:
        return sorted(set(classes_in(parse_selector(text))))
    except ValueError:
        return []


def _pseudos(parsed: list) -> Iterator[tuple[str, list]]:
    for kind, value, inner in parsed:
        if kind == "pseudo":
            yield value, inner
            for s in inner:
                yield from _pseudos(s)


def compounds(parsed: list) -> list[tuple[str | None, list]]:
    """The selector cut at its combinators: what stands before each compound selector (None before the first), and its simple selectors."""
    cuts = [i for i, (kind, *_) in enumerate(parsed) if kind == "comb"]
    before = [None, *((parsed[i][1].strip() or " ") for i in cuts)]
    return [(c, parsed[a:b]) for c, a, b in zip(before, [0, *(i + 1 for i in cuts)], [*cuts, len(parsed)], strict=True)]


def _leaves_no_trace(simple: tuple) -> bool:
    kind, value, _ = simple
    return kind in ("cls", "tag") or (kind, value) in (("pseudo", ":not"), ("all", "&"))


def segments(parsed: list) -> list[dict] | None:
    """The compound selectors with the combinator before each; None if no class is asked for at all.

    A compound of ids, attributes, ``*`` or pseudos alone counts as a wildcard if a combinator stands before
    it. ``:not`` gives the classes in it and, without any, leaves no trace; other pseudos are passed over.
    """
    rows = []
    for combinator, part in compounds(parsed):
        asked = [v for kind, v, _ in part if kind == "cls"]
        excluded = [c for kind, v, inner in part if (kind, v) == ("pseudo", ":not") for s in inner for c in classes_in(s)]
        tag = next((v for kind, v, _ in reversed(part) if kind == "tag"), None)
        named = bool(asked or excluded or tag)
        if named or combinator is not None and not all(map(_leaves_no_trace, part)):
            rows.append({"classes": asked, "not_classes": excluded, "tag": tag, "combinator": combinator, "wildcard": not named})
    return rows if any(r["classes"] or r["not_classes"] for r in rows) else None


def selector_rows(path: str, text: str) -> Iterator[tuple]:
    """(selector, file, line, segments, skip reason) for each member of each rule that isn't put out of use."""
    for rule in rules(parse_stylesheet(text)):
        try:
            parsed = [(s, parse_selector(s)) for s in split_selectors(rule.plain)]
        except ValueError:
            yield rule.plain, path, rule.line, None, "unparseable selector"
            continue
        for selector, p in parsed:
            if MARKER in selector:
                continue
            if any(name == ":has" and any(classes_in(s) for s in inner) for name, inner in _pseudos(p)):
                yield selector, path, rule.line, None, "unsupported structural pseudo-class"
                continue
            found = segments(p)
            yield selector, path, rule.line, found, None if found else "no class selectors" if found is None else "no class selectors after parsing"


def keyframe_facts(root: Block) -> Iterator[tuple[str, str, int]]:
    """(kind, name, line): ``frame`` for each at-rule of keyframes, ``named`` for each name in an ``animation-name``, ``word`` for each distinct word of an ``animation``."""
    for b in (root, *walk(root)):
        if b.at_rule and b.at_rule[0] == "keyframes":
            yield "frame", b.at_rule[1], b.line
        for name, value, line in b.declarations:
            if name == "animation-name":
                yield from (("named", x, line) for x in map(str.strip, value.split(",")) if x not in ("", "none"))
            elif name == "animation":
                yield from (("word", x, line) for x in dict.fromkeys(re.split(r"[\s,]+", value)))


def keyframe_rows(path: str, text: str) -> list[tuple]:
    """(kind, name, file, line): declared and invalidated keyframes, and references: names, and words that are declared in the file."""
    facts = list(keyframe_facts(parse_stylesheet(text)))
    declared = {name for kind, name, _ in facts if kind == "frame" and not name.startswith(PREFIX)}

    def told(kind: str, name: str) -> str | None:
        if kind == "frame":
            return "declared" if name in declared else "invalidated"
        return "reference" if kind == "named" or name in declared else None

    return [(told(kind, name), name.removeprefix(PREFIX) if kind == "frame" else name, path, line) for kind, name, line in facts if told(kind, name)]


def vendor_rows(path: str, text: str) -> Iterator[tuple]:
    """(token, file, line, literal, source) for each class in the rules of a vendor stylesheet that can be parsed."""
    for rule in (b for b in walk(parse_stylesheet(text)) if b.at_rule is None and b.open):
        for s in split_selectors(rule.plain):
            yield from ((c, path, rule.line, rule.plain, "node_modules_css") for c in all_classes(s))


def _rows_of(files: DataFrame, make, schema: str, columns: list[str]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = (r for path, content in zip(frame["path"], frame["content"], strict=True) if content for r in make(path, content))
            for some in batched(rows, ROWS):
                yield pd.DataFrame(some, columns=columns)

    return files.select("path", "content").mapInPandas(run, schema)


def prefiltered(files: DataFrame) -> DataFrame:
    """Stylesheets ``(path, content)`` with imports and directives that no file stands for turned into comments, line by line."""

    def line(x):
        bare = F.trim(x, F.lit(" \t\r"))
        skipped = F.when(bare.rlike(SKIPPED_IMPORT), F.lit("/* skipped import */")).when(bare.rlike(SKIPPED_DIRECTIVE), F.lit("/* skipped directive */"))
        return F.coalesce(skipped, x)

    return files.withColumn("content", F.array_join(F.transform(F.split("content", "\n"), line), "\n"))


def selectors(files: DataFrame) -> DataFrame:
    """``(selector, file, line, segments, skip_reason)`` of all stylesheets ``(path, content)``."""
    return _rows_of(prefiltered(files), selector_rows, f"selector string, file string, line int, segments array<{SEGMENT}>, skip_reason string", ["selector", "file", "line", "segments", "skip_reason"])


def keyframes(files: DataFrame) -> DataFrame:
    return _rows_of(files, keyframe_rows, "kind string, name string, file string, line int", ["kind", "name", "file", "line"])


def unused_keyframes(found: DataFrame) -> DataFrame:
    """``(name, file, line)``: keyframes that no animation refers to; of repeated names the last."""
    declared = found.where("kind = 'declared'").groupBy("name", "file").agg(F.max("line").alias("line"))
    return declared.join(found.where("kind = 'reference'").select("name").distinct(), "name", "left_anti").select("name", "file", "line")


def vendor_evidence(files: DataFrame) -> DataFrame:
    return _rows_of(files, vendor_rows, "token string, file string, line int, literal string, source string", ["token", "file", "line", "literal", "source"])


def selector_classes(found: DataFrame) -> DataFrame:
    """``(selector, class)`` for every class in the text of each distinct selector, those inside pseudos too."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(s, c) for s in frame["selector"] for c in all_classes(s)], columns=["selector", "class"])

    return found.select("selector").distinct().mapInPandas(run, "selector string, class string")
