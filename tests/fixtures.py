"""Graphs and stylesheets in small."""


def el(tag, *children, static=(), optional=(), exclusive=(), dynamic=(), repeat=False):
    return {"tag": tag, "repeat": repeat, "children": list(children), "classes": {"static": list(static), "optional": list(optional), "exclusive": [[list(o) for o in g] for g in exclusive], "dynamic": list(dynamic)}}


def call(*refs, slots=None, tag=".c"):
    return {"component_refs": list(refs), "callsite": {"tag": tag, "from": "x"}, "slot_children_by_name": slots or {}}


def slot(name="inner_block"):
    return {"slot_name": name}


def raw():
    return {"raw_html": True, "expr": "raw(@x)"}


def dyn(reason="variable", expr="x"):
    return {"dynamic": True, "reason": reason, "expr": expr, "chain": None}


def graph(trees, entries=None):
    refs = entries or [next(iter(trees))]
    return {"version": 2, "trees": trees, "cycles": [], "unresolved": [], "entries": [{"ref": r, "module": "M", "source_file": "m.ex", "name": r} for r in refs]}


PAGE = graph({"page": [el("section", call("panel"), static=["page"])], "panel": [el("article", el("button", static=["action"]), static=["panel"])]})
SIBLINGS = graph({
    "page": [el("section", call("panel"), call("badge"), el("i", static=["chip"]), static=["page"])],
    "panel": [el("article", static=["panel"])],
    "badge": [el("span", static=["badge"])],
})
CYCLE = graph({"a": [el("div", call("b"), static=["a"])], "b": [el("div", call("a"), static=["b"])]})
FACTS = graph({"p": [
    el("a", static=["btn"], optional=["active"], dynamic=[dyn()]),
    el("b", exclusive=[[["size-sm"], ["size-lg"]], [["tone-danger"], ["tone-neutral"]]]),
]})
