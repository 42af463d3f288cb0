"""What a class expression can come to: classes that are always there, and variants.

Variants are dicts with a ``type``: ``toggle`` (``words``), ``either`` (``options``, each a list of words and dynamic
facts), ``fn_call`` (``module`` parts or None, ``name``), ``assign_ref`` (``name``). Dynamic facts are dicts with
``dynamic``, ``reason``, ``expr`` and ``chain``; they stand among the static classes.
"""

from __future__ import annotations

from .elixir import SyntaxFault, parse, show

OPERATORS = {"<>", "|>", "!", "==", "!=", "++", "--", "+", "-", "*", "/", "and", "or", "not", "in", "="}


def dynamic(reason: str, expr: str | None, chain: str | None = None) -> dict:
    return {"dynamic": True, "reason": reason, "expr": expr, "chain": chain}


def _call(module: list[str] | None, name: str) -> dict:
    return {"type": "fn_call", "module": module, "name": name}


def _text(ast: tuple | None) -> str | None:
    return ast[1] if ast is not None and ast[0] == "str" else None


def _branch(ast: tuple | None) -> list[str]:
    """The string that a branch ends in, if it does."""
    if ast is None:
        return []
    if ast[0] == "block":
        return _branch(ast[1][-1]) if ast[1] else []
    return [ast[1]] if ast[0] == "str" else []


def _clauses(block: tuple | None) -> list[tuple]:
    return [x for x in block[1] if x[0] == "arrow"] if block is not None and block[0] == "block" else []


def _values(ast: tuple) -> list:
    """The classes that an operand of ``&&`` may give."""
    match ast:
        case ("str", s):
            return [s]
        case ("op", "||", a, b):
            return _values(a) + _values(b)
        case ("call", None, "if", _, blocks):
            return _branch(blocks.get("do")) + _branch(blocks.get("else"))
        case ("call", None, "case" | "cond", _, blocks):
            return [s for c in _clauses(blocks.get("do")) for s in _branch(c[2])]
        case ("block", exprs) if exprs:
            return _values(exprs[-1])
        case ("attr", _):
            return [dynamic("assign", show(ast))]
        case ("var", _):
            return [dynamic("variable", show(ast))]
    return []


def _option(value: str | dict) -> list:
    return value.split() if isinstance(value, str) else [value]


def _either(values: list) -> dict:
    return {"type": "either", "options": [_option(v) for v in values]}


def _toggle(value: str | dict) -> dict:
    return {"type": "toggle", "words": _option(value)}


def analyze(source: str) -> tuple[list, list[dict]]:
    """(static classes and dynamic facts, variants) of the source of a class expression."""
    try:
        return analyze_tree(parse(source))
    except SyntaxFault:
        return [dynamic("parse_error", source)], []


def analyze_tree(ast: tuple) -> tuple[list, list[dict]]:
    match ast:
        case ("str", s):
            return s.split(), []
        case ("list", items):
            parts = [analyze_tree(i) for i in items]
            return [s for p in parts for s in p[0]], [v for p in parts for v in p[1]]
        case ("op", "&&", a, b):
            for side in (b, a):
                if _text(side) is not None:
                    return [], [_toggle(_text(side))]
            values = _values(b) or _values(a)
            return ([], [_toggle(v) for v in values]) if values else ([dynamic("complex_expression", show(ast))], [])
        case ("op", "||", a, b):
            sides = [_text(a), _text(b)]
            if sides == [None, None]:
                return [dynamic("complex_expression", show(ast))], []
            return [], [_either([t if t is not None else dynamic("unknown_expression", show(x)) for t, x in zip(sides, (a, b), strict=True)])]
        case ("call", None, "if", _, blocks) if "do" in blocks:
            return _if(blocks["do"], blocks.get("else"))
        case ("call", None, "case" | "cond", _, blocks) if "do" in blocks:
            values = list(dict.fromkeys(s for c in _clauses(blocks["do"]) for s in _branch(c[2])))
            return ([], [_either(values)]) if values else ([dynamic("unknown_expression", "case/cond with non-string clauses")], [])
        case ("attr", ("var", name)):
            return [], [{"type": "assign_ref", "name": name}]
        case ("call", ("alias", parts), name, _, _):
            return [], [_call(parts, name)]
        case ("call", None, name, _, _):
            return [], [_call(None, name)]
        case ("op", name, _, _) | ("unary", name, _) if name in OPERATORS:
            return [], [_call(None, name)]
        case ("var", _):
            return [dynamic("variable", show(ast))], []
    return [dynamic("unknown_expression", show(ast))], []


def _if(do: tuple, other: tuple | None) -> tuple[list, list[dict]]:
    text = _text(do)
    if text is None:
        values = list(dict.fromkeys(_branch(do) + _branch(other)))
        return ([], [_either(values)]) if values else ([dynamic("unknown_expression", show(do))], [])
    if other is None:
        return [], [_toggle(text)]
    if _text(other) is not None:
        return [], [_either([text, _text(other)])]
    return [], [_either([text, *(_branch(other) or [dynamic("unknown_expression", show(other))])])]


def _concat(ast: tuple) -> str | None:
    if ast[0] == "op" and ast[1] == "<>":
        a, b = _concat(ast[2]), _concat(ast[3])
        return a + b if a is not None and b is not None else None
    return _text(ast)


def returns(ast: tuple | None) -> list | None:
    """What a function body may return: lists of classes and dynamic facts, calls; None if that can't be told."""
    match ast:
        case None | ("nil",):
            return [[]]
        case ("str", s):
            return [s.split()]
        case ("op", "<>", _, _):
            text = _concat(ast)
            return [text.split()] if text is not None else None
        case ("list", items):
            return [[x for i in items for x in ([i[1]] if i[0] == "str" else [dynamic("non_string_in_list", show(i))])]]
        case ("call", None, "if", _, blocks) if "do" in blocks:
            one, two = returns(blocks["do"]), returns(blocks.get("else"))
            return None if one is None or two is None else one + two
        case ("call", None, "case" | "cond", _, blocks) if "do" in blocks:
            parts = [returns(c[2]) for c in _clauses(blocks["do"])]
            return None if any(p is None for p in parts) else [r for p in parts for r in p]
        case ("block", exprs) if exprs:
            return returns(exprs[-1])
        case ("call", ("alias", parts), name, _, _):
            return [_call(parts, name)]
        case ("call", None, name, _, _):
            return [_call(None, name)]
        case ("attr", _):
            return [[dynamic("assign", show(ast))]]
        case ("var", _):
            return [[dynamic("variable", show(ast))]]
    return None


def facts_of(statics: list, variants: list[dict]) -> dict:
    """Class facts from what analysis and resolution gave: each class and fact once, in order."""
    out: dict[str, list] = {"static": [], "optional": [], "exclusive": [], "dynamic": []}

    def add(key: str, value) -> None:
        if value not in out[key]:
            out[key].append(value)

    for s in statics:
        add("dynamic" if isinstance(s, dict) else "static", s)
    for v in variants:
        if v["type"] == "toggle":
            for w in v["words"]:
                add("dynamic" if isinstance(w, dict) else "optional", w)
        elif v["type"] == "either":
            out["exclusive"].append(v["options"])
            for o in v["options"]:
                for w in o:
                    if isinstance(w, dict):
                        add("dynamic", w)
        else:
            add("dynamic", dynamic("unknown_variant", v.get("name")))
    return out
