"""Template modules: what a scan of source files finds, as tables of modules, function clauses and templates."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elixir import SyntaxFault, parse
from ..functions.expressions import returns
from ..plans.persist import dealt

MODULES = "module string, source_file string, imports array<string>, uses array<string>, aliases map<string,string>, pos int"
CLAUSES = "module string, source_file string, name string, arity int, clause int, heex string, returns string, assigns string, tail string, pos int"


def _children(ast) -> Iterator:
    """The parts of a tree, in order."""
    if isinstance(ast, dict):
        for v in ast.values():
            yield v
    elif isinstance(ast, (tuple, list)):
        for v in ast:
            if isinstance(v, (tuple, list, dict)):
                yield v


def _walk(ast) -> Iterator[tuple]:
    """Every node, each before what it holds."""
    stack = [ast]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple) and x and isinstance(x[0], str):
            yield x
        stack += list(_children(x))[::-1]


def _name(ast: tuple) -> str | None:
    return ".".join(ast[1]) if ast[0] == "alias" else ast[1] if ast[0] == "atom" else None


def _directives(body) -> tuple[list[str], list[str], dict[str, str]]:
    imports, uses, aliases = [], [], {}
    for node in _walk(body):
        match node:
            case ("call", None, "import" | "use" as word, [target, *_], _) if _name(target):
                (imports if word == "import" else uses).append(_name(target))
            case ("call", None, "alias", [("call", ("alias", parts), "{}", members, _)], _):
                aliases |= {m[1][-1]: ".".join([*parts, *m[1]]) for m in members if m[0] == "alias"}
            case ("call", None, "alias", [("alias", parts), *rest], _):
                told = dict(rest[0][1]).get("as") if rest and rest[0][0] == "kw" else None
                aliases[told[1][-1] if told else parts[-1]] = ".".join(parts)
    return list(dict.fromkeys(imports)), list(dict.fromkeys(uses)), aliases


def _head(ast: tuple) -> tuple[str, int] | None:
    if ast[0] == "op" and ast[1] == "when":
        ast = ast[2]
    if ast[0] == "call" and ast[1] is None:
        return ast[2], len(ast[3])
    return (ast[1], 0) if ast[0] == "var" else None


def _assigned(expr: tuple) -> dict:
    """How the value of an assign is told: words, a call, or something else by its kind."""
    from ..functions.elixir import show

    match expr:
        case ("str", s):
            return {"words": s.split()}
        case ("nil",):
            return {"words": []}
        case ("call", ("alias", parts), name, _, _):
            return {"call": [parts, name]}
        case ("call", None, name, _, _) | ("op", name, _, _):
            return {"call": [None, name]}
    return {"other": show(expr)}


def _assigns(body: tuple) -> dict[str, dict]:
    """Assigns that statements before the markup make: ``assign(x, :name, value)`` or ``x |> assign(:name, value)``; later ones win."""
    out: dict[str, dict] = {}
    for s in body[1] if body[0] == "block" else []:
        if s[0] == "sigil":
            break
        value = s[3] if s[0] == "op" and s[1] == "=" else s
        match value:
            case ("call", None, "assign", [_, ("atom", name), expr], _):
                out[name] = _assigned(expr)
            case ("op", "|>", _, ("call", None, "assign", [("atom", name), expr], _)):
                out[name] = _assigned(expr)
    return out


def _tail(body: tuple | None) -> list:
    """The calls that a body ends in, for following raw markup: (module parts or None, name)."""
    if body is None:
        return []
    match body:
        case ("block", exprs) if exprs:
            return _tail(exprs[-1])
        case ("call", ("alias", parts), name, _, _):
            return [[parts, name]]
        case ("op", "|>", _, right):
            return _tail(right)
        case ("call", None, "if" | "case" | "cond", _, blocks):
            found = []
            for b in blocks.values():
                for x in b[1] if b[0] == "block" and b[1] and b[1][0][0] == "arrow" else [("arrow", [], b)]:
                    found += _tail(x[2])
            return found
        case ("call", None, name, _, _):
            return [[None, name]]
        case ("var", name):
            return [[None, name]]
    return []


def parse_modules(path: str, text: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Rows of modules, of clauses with a body, and of embedded template patterns; all empty if the source can't be read."""
    try:
        tree = parse(text)
    except SyntaxFault:
        return [], [], []
    found = [n for n in _walk(tree) if n[:3] == ("call", None, "defmodule") and n[3] and n[3][0][0] == "alias" and "do" in n[4]]
    modules, clauses, embeds = [], [], []
    if not found:
        modules.append((None, path, [], [], {}, 0))
    for pos, m in enumerate(found):
        name, body = ".".join(m[3][0][1]), m[4]["do"]
        modules.append((name, path, *_directives(body), pos))
        counts: dict[tuple[str, int], int] = {}
        for node in _walk(body):
            match node:
                case ("call", None, "embed_templates", [("str", pattern), *_], _):
                    embeds.append((name, path, posixpath.normpath(posixpath.join(posixpath.dirname(path), posixpath.dirname(pattern)))))
                case ("call", None, "def" | "defp", [head, *_], blocks) if set(blocks) == {"do"} and _head(head):
                    key = _head(head)
                    do = blocks["do"]
                    sigil = next((x[2] for x in _walk(do) if x[0] == "sigil" and x[1] == "H"), None)
                    told = returns(do)
                    clauses.append((name, path, *key, counts.get(key, 0), sigil, None if told is None else json.dumps(told), json.dumps(_assigns(do)) if sigil is not None else None, json.dumps(_tail(do)), len(clauses)))
                    counts[key] = counts.get(key, 0) + 1
    return modules, clauses, embeds


def _scan(files: DataFrame, which: int, schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, t in zip(frame["path"], frame["content"], strict=True) if t is not None for r in parse_modules(p, t)[which]]
            yield pd.DataFrame(rows, columns=columns)

    # files made from a small table lie in one partition, though each takes long to parse
    return dealt(files.where(F.col("path").endswith(".ex")).select("path", "content"), "path").mapInPandas(run, schema)


def modules(files: DataFrame) -> DataFrame:
    return _scan(files, 0, MODULES)


def clauses(files: DataFrame) -> DataFrame:
    """Function clauses with a body: markup of the first sigil, what they return, what they assign before it."""
    return _scan(files, 1, CLAUSES)


def embedded(files: DataFrame) -> DataFrame:
    """``(module, source_file, name, heex)`` of the templates that modules embed, by directory."""
    asked = _scan(files, 2, "module string, source_file string, dir string").distinct()
    found = files.where(F.col("path").endswith(".html.heex")).select(F.regexp_extract("path", r"^(.*?)/?([^/]+)$", 1).alias("dir"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("content").alias("heex"))
    return found.join(asked, "dir").select("module", "source_file", "name", "heex")


def standalone(files: DataFrame, taken: DataFrame) -> DataFrame:
    """``(module, source_file, name, heex)`` of templates whose base name no module embeds; module is null."""
    found = files.where(F.col("path").endswith(".heex")).select(F.lit(None).cast("string").alias("module"), F.col("path").alias("source_file"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("content").alias("heex"))
    return found.join(taken.select("name").distinct(), "name", "left_anti").select("module", "source_file", "name", "heex")


def unreadable(files: DataFrame, found: DataFrame) -> DataFrame:
    """``(path)`` of source files that gave no row."""
    return files.where(F.col("path").endswith(".ex")).select("path").join(found.select(F.col("source_file").alias("path")).distinct(), "path", "left_anti")
