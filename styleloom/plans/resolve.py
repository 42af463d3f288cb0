"""From scanned modules to the component graph: every clause with markup becomes a tree of its own, in parallel."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.elixir import SyntaxFault, parse
from ..functions.expressions import analyze, dynamic, facts_of
from ..sources.markup import Element, Expr, parse_markup
from ..sources.modules import clauses, embedded, modules, standalone
from .persist import dealt, materialized
from .registry import Asked, Told, functions_of, is_raw, lookups

#: How deep calls of class helpers are followed.
MAX_DEPTH = 10
ARROW = " → "


def function_ref(module: str, name: str, arity: int, clause: int) -> str:
    return f"fn:{module}:{name}:{arity}:{clause}"


def _variant(v: dict) -> dict:
    """A variant as the graph document tells it."""
    if v["type"] == "toggle":
        return {"type": "toggle", "value": v["words"][0] if len(v["words"]) == 1 else v["words"]}
    return {"type": "either", "values": v["options"]}


class Resolver:
    """Trees of one registry."""

    def __init__(self, registry: Asked | Told):
        self.registry = registry

    # classes

    def called(self, target: list[str] | None, name: str, caller: str | None, visited: frozenset, depth: int, chain: list[str]) -> tuple[list, list[dict]]:
        """(statics, variants) that a call of a class helper comes to."""

        def open_(reason: str, expr: str, last: str) -> tuple[list, list[dict]]:
            return [dynamic(reason, expr, ARROW.join([*chain, last]))], []

        if depth >= MAX_DEPTH:
            return open_("unresolved:max_depth", f"max depth {MAX_DEPTH}", "<max depth>")
        found = self.registry.find(caller, target, name)
        if found is None:
            return open_("unresolved:unknown_fn", name, f"{name} (unknown)")
        module, arity = found
        if (module, name, arity) in visited:
            return open_("unresolved:cycle", f"{name}/{arity}", f"{name}/{arity} (cycle)")
        visited, chain = visited | {(module, name, arity)}, [*chain, f"{name}/{arity}"]
        values: list[list] = []
        nested: list[dict] = []
        for c in self.registry.clauses[module, name, arity]:
            told = json.loads(c["returns"]) if c["returns"] is not None else [[dynamic("unresolved:extract_failed", "unresolved function body")]]
            values += [v for v in told if isinstance(v, list)]
            nested += [v for v in told if isinstance(v, dict)]
        for v in nested:
            statics, variants = self.called(v["module"], v["name"], module, visited, depth + 1, chain)
            inner = statics + [w for x in variants for w in (x["words"] if x["type"] == "toggle" else [w for o in x["options"] for w in o])]
            values += [[w] for w in inner]  # classes of a nested call stand each for itself
        empty = any(not v for v in values)
        options = [[{**w, "chain": w.get("chain") or ARROW.join(chain)} if isinstance(w, dict) else w for w in v] for v in values if v]
        if not options:
            return ([], []) if empty else open_("unresolved:no_returns", name, "<no returns>")
        if len(options) == 1:
            return ([], [{"type": "toggle", "words": options[0]}]) if empty else (options[0], [])
        return [], [{"type": "either", "options": options}]

    def classes(self, source: str | Expr | None, assigns: dict, caller: str | None) -> tuple[list, list[dict]]:
        """(statics, variants) of a class attribute, with what its assigns and calls come to."""
        if source is None:
            return [], []
        statics, variants = analyze(source.source) if isinstance(source, Expr) else (source.split(), [])
        statics = [{**s, "chain": s.get("chain") or s["expr"]} if isinstance(s, dict) else s for s in statics]
        kept: list[dict] = []
        for v in variants:
            more: tuple[list, list[dict]] = ([], [])
            if v["type"] == "assign_ref":
                told = assigns.get(v["name"])
                if told is None:
                    more = [dynamic("unresolved:assign_ref", f"@{v['name']}", f"@{v['name']}")], []
                elif "words" in told:
                    more = told["words"], []
                elif "call" in told:
                    more = self.called(*told["call"], caller, frozenset(), 0, [])
                else:
                    more = [dynamic("unresolved:assign_expr", told["other"], told["other"])], []
            elif v["type"] == "fn_call":
                more = self.called(v["module"], v["name"], caller, frozenset(), 0, [])
            else:
                kept.append(v)
            statics, kept = statics + more[0], kept + more[1]
        return statics, kept

    # markup

    def raw(self, target: list[str] | None, name: str, caller: str | None, visited: frozenset = frozenset()) -> bool:
        """Whether a call gives raw markup: ``raw`` itself, or a helper that ends in such a call."""
        if is_raw(target, name):
            return True
        found = self.registry.find(caller, target, name)
        if found is None or (found, name) in visited:
            return False
        module, arity = found
        calls = [c for x in self.registry.clauses[module, name, arity] for c in json.loads(x["tail"])]
        return any(self.raw(t, n, module, visited | {(found, name)}) for t, n in calls)

    def raw_expression(self, source: str, caller: str | None) -> bool:
        if not re.match(r"\s*(?:[A-Z][\w.]*\.)?[a-z_]\w*[?!]?\s*\(", source) and "|>" not in source:
            return False
        try:
            ast = parse(source)
        except SyntaxFault:
            return False
        if ast[0] == "op" and ast[1] == "|>":
            ast = ast[3]
        if ast[0] != "call" or ast[1] is not None and ast[1][0] != "alias":
            return False
        return self.raw(ast[1][1] if ast[1] else None, ast[2], caller)

    def component(self, tag: str, caller: str | None) -> tuple[bool, tuple[str, int] | None, str]:
        """Whether a tag calls a component, which one, and by what name."""
        if tag.startswith("."):
            return True, self.registry.local(caller, tag[1:]), tag[1:]
        if "." in tag and "A" <= tag[0] <= "Z":
            *target, name = tag.split(".")
            return True, self.registry.remote(caller, ".".join(target), name), name
        return False, None, tag

    def children(self, nodes: list[Element], assigns: dict, caller: str | None, ref: str, open_: list[dict]) -> list[dict]:
        out: list[dict] = []
        for n in nodes:
            if n.slot:
                out.append({"slot_name": n.slot})
            elif n.expr is not None:
                if self.raw_expression(n.expr, caller):
                    out.append({"raw_html": True, "expr": n.expr})
            elif n.tag.startswith(":"):
                out += self.children(n.children, assigns, caller, ref, open_)
            else:
                out += self.child(n, assigns, caller, ref, open_)
        return out

    def child(self, n: Element, assigns: dict, caller: str | None, ref: str, open_: list[dict]) -> list[dict]:
        tag = "a" if n.tag == ".link" else f"__slot_var__:{n.slot_var}" if n.slot_var else n.tag

        def element(children: list[dict]) -> list[dict]:
            statics, variants = self.classes(n.class_source, assigns, caller)
            return [{"tag": tag, "static": statics, "variants": [_variant(v) for v in variants], "classes": facts_of(statics, variants), "repeat": n.repeat, "children": children}]

        calls, found, name = self.component(tag, caller)
        if not calls:
            return element(self.children(n.children, assigns, caller, ref, open_))
        if found is None:
            open_.append({"type": "component", "tag": tag, "from": ref, "reason": "unresolved"})
            return self.children(n.children, assigns, caller, ref, open_)
        slots: dict[str, list[dict]] = {}
        for c in n.children:
            named = c.tag.startswith(":")
            slots.setdefault(c.tag[1:] if named else "inner_block", []).extend(self.children(c.children if named else [c], assigns, caller, ref, open_))
        module, arity = found
        with_markup = [c for c in self.registry.clauses[module, name, arity] if c["heex"] is not None]
        edge = {"component_refs": [function_ref(module, name, arity, i) for i in range(len(with_markup))], "callsite": {"tag": tag, "from": ref}, "slot_children_by_name": slots}
        source = n.class_source
        return element([edge]) if isinstance(source, Expr) or source and source.strip() else [edge]

    def tree(self, heex: str, assigns: dict, caller: str | None, ref: str) -> tuple[list[dict], list[dict]]:
        open_: list[dict] = []
        return self.children(parse_markup(heex), assigns, caller, ref, open_), open_


def _function_calls(found_clauses: DataFrame) -> DataFrame:
    """``(module, name, arity, tail, target, callee, is_raw)``: the calls in what functions return, and those that they end in (``tail``)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for c in frame.itertuples(index=False):
                nested = [(v["module"], v["name"]) for v in json.loads(c.returns) if isinstance(v, dict)] if c.returns is not None else []
                for tail, calls in ((False, nested), (True, json.loads(c.tail))):
                    rows += [(c.module, c.name, c.arity, tail, None if t is None else ".".join(t), n, is_raw(t, n)) for t, n in calls]
            yield pd.DataFrame(rows, columns=["module", "name", "arity", "tail", "target", "callee", "is_raw"])

    thin = found_clauses.select("module", "name", "arity", "returns", "tail")
    return thin.mapInPandas(run, "module string, name string, arity int, tail boolean, target string, callee string, is_raw boolean").distinct()


FUNCTION = ["module", "name", "arity"]


def _reached(steps: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """``start(a..., b...)`` with what its ``b`` leads to over ``steps(b..., c...)``, in ``most`` steps if that is given; keys are structs ``a``, ``b`` and ``c``."""
    found = last = materialized(start.distinct())
    taken = 0
    while (most is None or taken < most) and not last.isEmpty():
        last = materialized(last.join(steps, "b").select("a", F.col("c").alias("b")).distinct().join(found, ["a", "b"], "left_anti"))
        found = found.unionByName(last)
        taken += 1
    return found


def _functions_told(found_modules: DataFrame, found_clauses: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(f, told)``, what trees must know of each function: its clauses, its calls, whether it ends in raw markup; and ``(a, b)``, the functions that the calls in what it returns lead to."""
    calls = materialized(_function_calls(found_clauses))
    meant = lookups(calls.select(F.col("module").alias("caller"), "target", F.col("callee").alias("name")).distinct(), found_modules, functions)
    meant = meant.select(F.col("caller").alias("module"), "target", F.col("name").alias("callee"), F.struct("module", F.col("name"), "arity").alias("to"))
    c, m = calls.alias("c"), meant.alias("m")
    same = (F.col("c.module") == F.col("m.module")) & F.col("c.target").eqNullSafe(F.col("m.target")) & (F.col("c.callee") == F.col("m.callee"))
    key = F.struct(*[F.col(f"c.{k}").alias(k) for k in FUNCTION])
    edges = materialized(c.join(m, same).select(key.alias("f"), "c.tail", "c.target", "c.callee", "m.to"))
    # raw markup: from the functions that end in raw itself back to those that end in them
    ends = calls.where("tail AND is_raw").select(F.lit(True).alias("a"), F.struct(*FUNCTION).alias("b"))
    raw = _reached(edges.where("tail").select(F.col("to").alias("b"), F.col("f").alias("c")), ends).select(F.col("b").alias("f"), F.lit(True).alias("raw"))
    own = edges.where("NOT tail").groupBy("f").agg(F.collect_list(F.struct("target", F.col("callee").alias("name"), F.col("to.module").alias("module"), F.col("to.arity").alias("arity"))).alias("calls"))
    clause = F.struct("source_file", "pos", "returns")
    known = found_clauses.groupBy(F.struct(*FUNCTION).alias("f")).agg(F.count("heex").alias("n_heex"), F.transform(F.array_sort(F.collect_list(clause)), lambda x: F.struct(x["returns"].alias("returns"))).alias("told"))
    known = known.join(own, "f", "left").join(raw, "f", "left")
    none = F.array().cast("array<struct<target:string,name:string,module:string,arity:int>>")
    told = known.select("f", F.struct("f.module", "f.name", "f.arity", "n_heex", F.coalesce("raw", F.lit(False)).alias("raw"), F.coalesce("calls", none).alias("calls"), "told").alias("told"))
    step = edges.where("NOT tail").select(F.col("f").alias("b"), F.col("to").alias("c"))
    return told, _reached(step, step.select(F.col("b").alias("a"), F.col("c").alias("b")), MAX_DEPTH)


def graph_trees(files: DataFrame) -> DataFrame:
    """``(ref, module, source_file, name, tree, unresolved)`` for every clause and template with markup; tree and unresolved as JSON.

    Each tree is resolved with the part of the registry that it asks for: a first reading tells its calls, joins tell what
    they mean and which functions they lead to. No task and no driver holds more than that.
    """
    found_modules, found_clauses = materialized(modules(files)), materialized(clauses(files))
    in_markup = found_clauses.where("heex IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("module", "name", "arity").orderBy("source_file", "pos")) - 1
    trees = in_markup.select(F.concat_ws(":", F.lit("fn"), "module", "name", F.col("arity").cast("string"), nth.cast("string")).alias("ref"), "module", "source_file", "name", "heex", "assigns")
    embeds = embedded(files)
    templates = embeds.unionByName(standalone(files, embeds))
    templates = templates.select(F.concat_ws(":", F.lit("tpl"), F.coalesce("module", "source_file"), "name").alias("ref"), "module", "source_file", "name", "heex", F.lit("{}").alias("assigns"))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asks = []
            for r in frame.itertuples(index=False):
                asked = Asked()
                Resolver(asked).tree(r.heex, json.loads(r.assigns or "{}"), None, r.ref)
                asks.append([{"target": t, "name": n} for t, n in asked.calls])
            yield frame.assign(asks=asks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                module = r.module if isinstance(r.module, str) else None
                told = Told(module, json.loads(r.calls or "[]"), json.loads(r.functions or "[]"))
                tree, open_ = Resolver(told).tree(r.heex, json.loads(r.assigns or "{}"), module, r.ref)
                rows.append((r.ref, module, r.source_file, r.name, json.dumps(tree), json.dumps(open_)))
            yield pd.DataFrame(rows, columns=["ref", "module", "source_file", "name", "tree", "unresolved"])

    columns = "ref string, module string, source_file string, name string, heex string, assigns string"
    asked = dealt(trees.unionByName(templates), "ref").mapInPandas(ask, f"{columns}, asks array<struct<target:string,name:string>>")
    asked = materialized(asked.withColumn("id", F.monotonically_increasing_id()))
    functions = materialized(functions_of(found_clauses))
    calls = asked.select("id", F.col("module").alias("caller"), F.explode("asks").alias("a")).select("id", "caller", "a.target", "a.name")
    meant = lookups(calls.select("caller", "target", "name").distinct(), found_modules, functions)
    c, m = calls.alias("c"), meant.alias("m")
    same = F.col("c.caller").eqNullSafe(F.col("m.caller")) & F.col("c.target").eqNullSafe(F.col("m.target")) & (F.col("c.name") == F.col("m.name"))
    first = materialized(c.join(m, same).select("c.id", "c.target", "c.name", "m.module", "m.arity"))
    told, reach = _functions_told(found_modules, found_clauses, functions)
    direct = first.select("id", F.struct(*FUNCTION).alias("f"))
    needed = direct.unionByName(direct.join(reach.withColumnRenamed("a", "f"), "f").select("id", F.col("b").alias("f"))).distinct()
    theirs = needed.join(told, "f").groupBy("id").agg(F.to_json(F.collect_list("told")).alias("functions"))
    own = first.groupBy("id").agg(F.to_json(F.collect_list(F.struct("target", "name", "module", "arity"))).alias("calls"))
    rows = asked.drop("asks").join(own, "id", "left").join(theirs, "id", "left")
    return dealt(rows, "id").mapInPandas(run, "ref string, module string, source_file string, name string, tree string, unresolved string")


def calls_in(children: list[dict]) -> Iterator[str]:
    """The trees that a tree calls, in the order of the document; what fills the slots of a call comes after it."""
    for c in children:
        yield from c.get("component_refs") or ()
        yield from calls_in(c.get("children") or [])
        for filled in (c.get("slot_children_by_name") or {}).values():
            yield from calls_in(filled)


def component_cycles(trees: dict[str, list[dict]]) -> list[dict]:
    """The cycles of trees in their order, see ``call_cycles``."""
    return call_cycles({ref: list(calls_in(children)) for ref, children in trees.items()})


def call_cycles(calls: dict[str, list[str]]) -> list[dict]:
    """The calls that lead back to a tree on their own way, each with the way from the entry that first came there.

    A tree is followed once, whatever calls it; it is an entry itself if nothing before it has led there.
    """
    found: dict[tuple, None] = {}
    followed: set[str] = set()
    for entry in calls:
        if entry in followed:
            continue
        followed.add(entry)
        way, open_ = [entry], [iter(calls[entry])]
        while open_:
            ref = next(open_[-1], None)
            if ref is None:
                open_.pop()
                way.pop()
            elif ref in way:
                found[*way, ref] = None
            elif ref in calls and ref not in followed:
                followed.add(ref)
                way.append(ref)
                open_.append(iter(calls[ref]))
    return [{"type": "component", "path": list(path)} for path in found]


def _document_order(row) -> tuple:
    return row["ref"].startswith("tpl:"), row["source_file"], row["ref"]


def graph_cycles(files: DataFrame) -> list[dict]:
    """The cycles of the document of a code base, without its trees: the driver holds the refs of those that call something."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            calls = [list(calls_in(json.loads(t))) for t in frame["tree"]]
            rows = frame[["ref", "source_file"]].assign(calls=calls)
            yield rows[[bool(c) for c in calls]]

    found = graph_trees(files).select("ref", "source_file", "tree").mapInPandas(run, "ref string, source_file string, calls array<string>")
    return call_cycles({r["ref"]: r["calls"] for r in sorted(found.collect(), key=_document_order)})


def graph_document(files: DataFrame) -> dict:
    """The graph of a code base as one document, entries in the order of source and ref; cycles and unresolved calls once each."""
    rows = sorted(graph_trees(files).collect(), key=_document_order)
    trees = {r["ref"]: json.loads(r["tree"]) for r in rows}
    unresolved = {json.dumps(u, sort_keys=True): u for r in rows for u in json.loads(r["unresolved"])}
    return {
        "version": 2,
        "entries": [{k: r[k] for k in ("ref", "module", "source_file", "name")} for r in rows],
        "trees": trees,
        "cycles": component_cycles(trees),
        "unresolved": list(unresolved.values()),
    }
