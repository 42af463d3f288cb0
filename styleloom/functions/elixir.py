"""A parser for the part of the template language's host that class expressions and modules are written in.

Trees are tuples that begin with their kind:
``("str", text)``, ``("interp", source)``, ``("num", text)``, ``("atom", name)``, ``("nil",)``, ``("var", name)``, ``("alias", [parts])``,
``("list", items)``, ``("tuple", items)``, ``("map", items)``, ``("kw", [(key, value)])``, ``("attr", expr)`` for ``@expr``,
``("op", name, left, right)``, ``("unary", name, expr)``, ``("call", target or None, name, args, blocks)``, ``("dot", expr, name)``,
``("arrow", [patterns], body)``, ``("block", exprs)``, ``("fn", clauses)``, ``("sigil", letter, text)``, ``("access", expr, key)``.
``blocks`` maps ``do``, ``else`` and so on to a block or a list of arrows.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r'''(?P<space>[ \t\r]+|\\\n)|(?P<comment>\#[^\n]*)|(?P<nl>\n|;)
    |(?P<heredoc>~?[A-Za-z]?"""(?:\\.|(?!""").)*""")
    |(?P<sigil>~[A-Za-z](?:\{(?:\\.|[^{}]|\{[^{}]*\})*\}|"(?:\\.|[^"])*"|\((?:\\.|[^)])*\)|\[(?:\\.|[^\]])*\]|\|[^|]*\||/(?:\\.|[^/])*/|<[^>]*>)[a-z]*)
    |(?P<str>"(?:\\.|\#\{(?:[^{}"]|"(?:\\.|[^"])*"|\{[^{}]*\})*\}|[^"\\])*")
    |(?P<chars>'(?:\\.|[^'\\])*')
    |(?P<key>(?:[A-Za-z_]\w*[?!]?|"(?:\\.|[^"\\])*"):(?=\s))
    |(?P<num>\d[\d_]*(?:\.\d+(?:[eE][+-]?\d+)?)?|0x[0-9A-Fa-f]+|\?\\?.)
    |(?P<atom>:(?:[A-Za-z_]\w*[?!]?|"(?:\\.|[^"\\])*"|[+\-*/<>=!&|.^%]+))
    |(?P<name>[a-z_]\w*[?!]?)|(?P<alias>[A-Z]\w*)
    |(?P<op>===|!==|<<<|>>>|~>>|<<~|\|\|\||&&&|<-|->|=>|\|>|<>|\+\+|--|==|!=|=~|<=|>=|&&|\|\||::|\.\.|//|\\\\|<<|>>|%\{|[-+*/<>=!&|^@.,(){}\[\]%~])''',
    re.S | re.X,
)
_BINARY = {op: (p, right) for p, right, ops in (
    (1, False, ["<-", "\\\\"]), (2, False, ["when"]), (3, True, ["::"]), (4, True, ["|"]), (5, True, ["=>"]), (6, True, ["="]),
    (8, False, ["||", "|||", "or"]), (9, False, ["&&", "&&&", "and"]), (10, False, ["==", "!=", "=~", "===", "!=="]),
    (11, False, ["<", ">", "<=", ">="]), (12, False, ["|>", "<<<", ">>>", "~>>", "<<~"]), (13, False, ["in"]),
    (15, True, ["<>", "++", "--", "..", "//"]), (16, False, ["+", "-"]), (17, False, ["*", "/"]),
) for op in ops}
_WORDS = {"and", "or", "in", "when"}
_STOPS = {"do", "end", "else", "rescue", "catch", "after"}
_PLAIN_CALL = 5  # the binding power above which an argument of a call without brackets ends


class SyntaxFault(ValueError):
    pass


def lex(text: str) -> list[tuple[str, str, bool]]:
    """(kind, text, whether a space comes before)."""
    out, at, spaced = [], 0, False
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxFault(text[at : at + 20])
        at, kind = m.end(), m.lastgroup
        if kind in ("space", "comment"):
            spaced = True
        elif kind == "nl":
            if out and out[-1][0] != "nl":
                out.append(("nl", "\n", True))
            spaced = True
        else:
            out.append((kind, m[0], spaced))
            spaced = False
    return out


def _unquote(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "s": " ", "r": "\r"}.get(m[1], m[1]), text, flags=re.S)


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = [*lex(text), ("eof", "", True)], 0

    def peek(self, ahead: int = 0) -> tuple[str, str, bool]:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def next(self) -> tuple[str, str, bool]:
        t = self.peek()
        self.at += 1
        return t

    def take(self, text: str) -> bool:
        if self.peek()[1] == text and self.peek()[0] in ("op", "name"):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise SyntaxFault(f"{text!r} wanted, {self.peek()[1]!r} found")

    def lines(self) -> None:
        while self.peek()[0] == "nl":
            self.at += 1

    def whole(self) -> tuple:
        block = self.block(set())
        if self.peek()[0] != "eof":
            raise SyntaxFault(self.peek()[1])
        return block

    def block(self, stops: set[str]) -> tuple:
        """Expressions up to a stop word; if the first is an arrow, a list of arrows."""
        exprs: list[tuple] = []
        self.lines()
        while self.peek()[0] != "eof" and not (self.peek()[0] == "name" and self.peek()[1] in stops) and self.peek()[1] not in (")", "}"):
            start = self.at
            first = [] if self.peek()[1] == "->" else [self.expr(0)]
            while self.take(","):
                self.lines()
                first.append(self.expr(0))
            if self.take("->"):
                self.lines()
                exprs.append(("arrow", first, self.body(stops)))
            elif len(first) > 1:
                raise SyntaxFault(self.peek()[1])
            else:
                exprs += first
            if self.at == start:
                raise SyntaxFault(self.peek()[1])
            self.lines()
        return exprs[0] if len(exprs) == 1 and exprs[0][0] != "arrow" else ("block", exprs)

    def body(self, stops: set[str]) -> tuple:
        """What an arrow leads to: all until the next arrow of the same block."""
        exprs: list[tuple] = []
        while self.peek()[0] != "eof" and not (self.peek()[0] == "name" and self.peek()[1] in stops) and self.peek()[1] not in (")", "}"):
            mark = self.at
            if exprs:
                try:
                    self.expr(0)
                    while self.take(","):
                        self.lines()
                        self.expr(0)
                    arrow = self.peek()[1] == "->"
                except SyntaxFault:
                    arrow = False
                self.at = mark
                if arrow:
                    break
            exprs.append(self.expr(0))
            self.lines()
        return exprs[0] if len(exprs) == 1 else ("block", exprs)

    def expr(self, power: int) -> tuple:
        left = self.postfix(self.prefix(power), power)
        while True:
            mark = self.at
            while self.peek()[0] == "nl":  # an operator may open the next line
                self.at += 1
            kind, op, _ = self.peek()
            negated = kind == "name" and op == "not" and self.peek(1)[1] == "in"
            op = "in" if negated else op
            if not (kind == "op" or kind == "name" and op in _WORDS) or op not in _BINARY or (mark != self.at and op in ("-", "+", "&&") and op in ("-", "+")):
                self.at = mark
                return left
            p, right = _BINARY[op]
            if p <= power and not (right and p == power):
                self.at = mark
                return left
            self.at += 2 if negated else 1
            self.lines()
            left = ("op", op, left, self.expr(p - (1 if right else 0)))

    def prefix(self, power: int) -> tuple:
        kind, text, _ = self.next()
        if kind == "str":
            body = text[1:-1]
            return ("interp", body) if re.search(r"(?<!\\)#\{", body) else ("str", _unquote(body))
        if kind == "heredoc":
            if text[0] == "~":
                return ("sigil", text[1], text[5:-3])
            body = text[text.index('"""') + 3 : -3]
            return ("interp", body) if "#{" in body else ("str", _unquote(body.lstrip("\n")))
        if kind == "sigil":
            inner = re.match(r"~[A-Za-z].(.*).[a-z]*$", text, re.S)[1]
            return ("sigil", text[1], inner)
        if kind in ("num", "chars"):
            return ("num", text)
        if kind == "atom":
            return ("atom", text[1:].strip('"'))
        if kind == "key":
            self.at -= 1
            return self.keywords(power)
        if kind == "alias":
            parts = [text]
            while self.peek()[1] == "." and self.peek(1)[0] == "alias":
                self.at += 1
                parts.append(self.next()[1])
            return ("alias", parts)
        if kind == "name":
            return self.name(text)
        if text == "@":
            return ("attr", self.postfix(self.prefix(20), 20))
        if text in ("!", "-", "+", "^", "&", "~"):
            return ("unary", text, self.expr(2 if text == "&" else 18))
        if text == "(":
            inner = self.block({"end"})
            self.lines()
            self.need(")")
            return inner
        if text == "[":
            return ("list", self.items("]"))
        if text == "{":
            return ("tuple", self.items("}"))
        if text == "<<":
            return ("tuple", self.items(">>"))
        if text == "%{":
            return ("map", self.items("}"))
        if text == "%":
            self.expr(19)
            self.need("{")
            return ("map", self.items("}"))
        raise SyntaxFault(text)

    def items(self, close: str) -> list[tuple]:
        out = []
        self.lines()
        while not self.take(close):
            out.append(self.expr(0))
            self.lines()
            if not self.take(","):
                self.lines()
                self.need(close)
                break
            self.lines()
        return [i for x in out for i in ([x] if x[0] != "kw" else [x])]

    def keywords(self, power: int) -> tuple:
        pairs = []
        while self.peek()[0] == "key":
            name = self.next()[1][:-1].strip('"')
            self.lines()
            pairs.append((name, self.expr(max(power, 0) if power < _PLAIN_CALL else 0)))
            mark = self.at
            if not self.take(","):
                break
            self.lines()
            if self.peek()[0] != "key":
                self.at = mark
                break
        return ("kw", pairs)

    def name(self, text: str) -> tuple:
        if text in ("nil",):
            return ("nil",)
        if text in ("true", "false"):
            return ("atom", text)
        if text == "not":
            return ("unary", "not", self.expr(18))
        if text == "fn":
            body = self.block({"end"})
            self.need("end")
            return ("fn", body)
        if text in _STOPS:
            raise SyntaxFault(text)
        return self.called(None, text)

    def called(self, target: tuple | None, name: str) -> tuple:
        """A variable, a call with brackets, a call whose arguments stand free, each maybe with a block."""
        kind, text, spaced = self.peek()
        args: list[tuple] | None = None
        if text == "(" and kind == "op" and not spaced:
            self.at += 1
            args = self.items(")")
        elif spaced and self.starts_argument():
            args = [self.expr(0)]
            while self.take(","):
                self.lines()
                args.append(self.expr(0))
        blocks: dict = {}
        if self.peek()[0] == "name" and self.peek()[1] == "do" and self.depth_allows():
            self.at += 1
            word = "do"
            while True:
                blocks[word] = self.block(_STOPS)
                stop = self.next()[1]
                if stop == "end":
                    break
                if stop not in _STOPS or stop == "do":
                    raise SyntaxFault(stop)
                word = stop
        if args and args[-1][0] == "kw":
            told = dict(args[-1][1])
            if "do" in told and not blocks:
                blocks, args = {k: told[k] for k in told if k in _STOPS}, args[:-1]
        if args is None and not blocks and target is None:
            return ("var", name)
        return ("call", target, name, args or [], blocks) if args is not None or blocks else ("dot", target, name)

    _free = 0

    def depth_allows(self) -> bool:
        return self._free == 0

    def starts_argument(self) -> bool:
        kind, text, _ = self.peek()
        if kind in ("str", "num", "chars", "atom", "alias", "key", "heredoc", "sigil"):
            return True
        if kind == "name":
            return text not in _STOPS and text not in _WORDS and not (text == "not" and self.peek(1)[1] == "in")
        if kind == "op":
            return text in ("@", "%{", "%", "{", "!", "^", "&", "~") or text in ("[", "(") or text == "-" and not self.peek(1)[2]
        return False

    def postfix(self, left: tuple, power: int) -> tuple:
        while True:
            kind, text, spaced = self.peek()
            if text == "." and kind == "op" and self.peek(1)[0] in ("name", "alias") or text == "." and self.peek(1)[1] in ("(", "{"):
                self.at += 1
                kind, text, _ = self.peek()
                if kind == "name":
                    self.at += 1
                    left = self.called(left, text)
                elif text == "{":
                    self.at += 1
                    left = ("call", left, "{}", self.items("}"), {})
                elif text == "(":
                    self.at += 1
                    left = ("call", left, "()", self.items(")"), {})
                else:
                    self.at += 1
                    left = ("alias", [*left[1], text]) if left[0] == "alias" else ("dot", left, text)
            elif text == "[" and kind == "op" and not spaced and left[0] not in ("str", "num"):
                self.at += 1
                left = ("access", left, self.items("]"))
            else:
                return left


class _Guarded(Parser):
    """Arguments that stand free don't take the block of the call that they belong to."""

    def called(self, target: tuple | None, name: str) -> tuple:
        kind, text, spaced = self.peek()
        if spaced and self.starts_argument() and not (text == "(" and not spaced):
            self._free += 1
            try:
                args = [self.expr(0)]
                while self.take(","):
                    self.lines()
                    args.append(self.expr(0))
            finally:
                self._free -= 1
            return self.blocked(target, name, args)
        return super().called(target, name)

    def blocked(self, target: tuple | None, name: str, args: list[tuple]) -> tuple:
        blocks: dict = {}
        if self.peek()[0] == "name" and self.peek()[1] == "do" and self.depth_allows():
            self.at += 1
            free, self._free = self._free, 0
            word = "do"
            while True:
                blocks[word] = self.block(_STOPS)
                stop = self.next()[1]
                if stop == "end":
                    break
                if stop not in _STOPS or stop == "do":
                    raise SyntaxFault(stop)
                word = stop
            self._free = free
        if args and args[-1][0] == "kw" and not blocks:
            told = dict(args[-1][1])
            if "do" in told:
                blocks, args = {k: told[k] for k in told if k in _STOPS}, args[:-1]
        return ("call", target, name, args, blocks)

    def items(self, close: str) -> list[tuple]:
        free, self._free = self._free, 0
        try:
            return super().items(close)
        finally:
            self._free = free


def parse(text: str) -> tuple:
    """The tree of a source text; SyntaxFault (a ValueError) for what isn't understood."""
    try:
        return _Guarded(text).whole()
    except RecursionError as e:
        raise SyntaxFault("nested too deeply") from e


def show(ast: tuple | None) -> str:
    """A short form of a tree for reports."""
    match ast:
        case None | ("nil",):
            return "nil"
        case ("str", s):
            return f'"{s}"'
        case ("interp", s):
            return f'"{s}"'
        case ("num", s) | ("var", s):
            return s
        case ("atom", s):
            return s if s in ("true", "false") else f":{s}"
        case ("alias", parts):
            return ".".join(parts)
        case ("attr", x):
            return f"@{show(x)}"
        case ("op", op, a, b):
            return f"{show(a)} {op} {show(b)}"
        case ("unary", op, x):
            return f"{op} {show(x)}" if op == "not" else f"{op}{show(x)}"
        case ("dot", x, name):
            return f"{show(x)}.{name}"
        case ("call", target, name, args, _):
            inner = ", ".join(map(show, args))
            return f"{show(target)}.{name}({inner})" if target else f"{name}({inner})"
        case ("list", items):
            return f"[{', '.join(map(show, items))}]"
        case ("kw", pairs):
            return ", ".join(f"{k}: {show(v)}" for k, v in pairs)
        case ("block", exprs):
            return "; ".join(map(show, exprs))
        case ("access", x, key):
            return f"{show(x)}[{', '.join(map(show, key))}]"
    return ast[0]
