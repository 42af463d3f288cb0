import json
import random

import pytest
from fixtures import CYCLE, FACTS, PAGE, SIBLINGS, call, dyn, el, graph, raw, slot

from styleloom.corpora import selector_table
from styleloom.operators import match
from styleloom.operators.match import class_postings, match_keys
from styleloom.operators.report import coverage, diagnostics, match_details, selector_classes_of
from styleloom.plans.expand import check_limit, contexts, cycles, missing_refs
from styleloom.plans.graph import graph_stats, load_graph
from styleloom.plans.persist import materialized
from styleloom.schema import SELECTORS
from styleloom.sources.scripts import built_in_evidence, script_evidence
from styleloom.sources.stylesheets import all_classes, selector_rows


def run(spark, g, css, scripts=()):
    t = load_graph(spark, json.dumps(g))
    ctx = contexts(t["entries"], t["items"]).cache()
    rows = [(i, *r) for i, r in enumerate(selector_rows("app.css", css))]
    sel = spark.createDataFrame(rows, SELECTORS)
    classes = spark.createDataFrame([(r[0], c) for r in rows for c in all_classes(r[1])], "sel_id long, class string")
    evidence = built_in_evidence(spark)
    if scripts:
        evidence = evidence.unionByName(script_evidence(spark.createDataFrame(list(scripts), "path string, content string")))
    report, results = coverage(sel, classes, ctx, t["nodes"], evidence)
    return {r["selector"]: r["bucket"] for r in sorted(report.collect(), key=lambda r: r["sel_id"])}, t, ctx, sel, results


def css(*selectors):
    return "\n".join(f"{s} {{ color: red }}" for s in selectors)


def test_page(spark):
    got, t, ctx, sel, results = run(spark, PAGE, css(".page .action", ".page > .panel", ".missing", ".page > .action"))
    assert got == {".page .action": "matched", ".page > .panel": "matched", ".missing": "unmatched", ".page > .action": "unmatched"}
    stats = graph_stats(t["entries"], t["trees"], t["items"], ctx, t["nodes"], class_postings(t["nodes"])).first()
    assert (stats["entries"], stats["trees"], stats["canonical_nodes"], stats["contexts"], stats["classes"]) == (1, 2, 3, 3, 3)
    with pytest.raises(ValueError, match="Context limit exceeded"):
        check_limit(ctx, 1)
    details = match_details(sel, results, ctx, t["nodes"]).where("sel_id = 0").first()
    assert details["chain"] == "page → section.page → article.panel → button.action" and details["call_stack"] == ["page", "panel"]
    notes = {r["sel_id"]: (r["found"], r["missing"]) for r in diagnostics(sel.where("sel_id >= 2"), selector_classes_of(sel), class_postings(t["nodes"])).collect()}
    assert notes == {2: ([], ["missing"]), 3: (["action", "page"], [])}


def test_siblings(spark):
    got = run(spark, SIBLINGS, css(".panel + .badge", ".badge + .chip", ".badge + .panel", ".chip + .badge", ".panel ~ .chip", ".panel + .chip"))[0]
    assert {k for k, v in got.items() if v == "matched"} == {".panel + .badge", ".badge + .chip", ".panel ~ .chip"}


def test_repeat_is_its_own_sibling(spark):
    g = graph({"p": [el("li", static=["item"], repeat=True), el("b", static=["once"])]})
    assert run(spark, g, css(".item + .item", ".once + .once", ".item ~ .item"))[0] == {".item + .item": "matched", ".once + .once": "unmatched", ".item ~ .item": "matched"}


def test_cycle_and_missing(spark):
    got, t, ctx, *_ = run(spark, CYCLE, css(".a .b", ".b .a"))
    assert got == {".a .b": "matched", ".b .a": "unmatched"}
    assert [r["path"] for r in cycles(t["entries"], t["items"]).collect()] == [["a", "b", "a"]]
    g = graph({"p": [el("div", call("fn:Nope:nope:1:0"))]})
    _, t, *_ = run(spark, g, css(".x"))
    assert [(r["ref"], r["path"]) for r in missing_refs(t["entries"], t["items"], t["trees"]).collect()] == [("fn:Nope:nope:1:0", ["p", "fn:Nope:nope:1:0"])]


def test_facts(spark):
    got = run(spark, FACTS, css(".btn.active", ".size-sm.tone-danger", ".tone-danger.tone-neutral", ".btn.unknown-runtime-class", ".other", "a.btn:not(.active)", "a.active:not(.btn)"))[0]
    assert got == {".btn.active": "matched", ".size-sm.tone-danger": "matched", ".tone-danger.tone-neutral": "unmatched", ".btn.unknown-runtime-class": "possibly_dynamic", ".other": "unmatched", "a.btn:not(.active)": "matched", "a.active:not(.btn)": "unmatched"}


def test_assign_facts(spark):
    g = graph({"p": [el("div", el("p", static=["podium-name"]), static=["flex"], exclusive=[[["podium-tied", "podium-tied--two"], ["podium-tied", "podium-tied--many"]]])]})
    got = run(spark, g, css(".podium-tied .podium-name", ".podium-tied--two .podium-name", ".missing-parent .podium-name", ".podium-tied--two.podium-tied--many"))[0]
    assert list(got.values()) == ["matched", "matched", "unmatched", "unmatched"]


def test_scripts_explain(spark):
    g = graph({"p": [el("div", static=["item-entry"], repeat=True)]})
    js = [("a.js", "x.add('sortable-ghost'); y = \"sortable-chosen\"; z = `sortable-drag`; w = `sortable-${k}`")]
    got = run(spark, g, css(".sortable-ghost", ".item-entry.sortable-chosen", ".item-entry .sortable-drag", ".runtime-missing", ".item-entry + .sortable-ghost", ".item-entry:not(.sortable-ghost)"), js)[0]
    assert list(got.values()) == ["runtime_matched", "runtime_matched", "runtime_matched", "unmatched", "unmatched", "matched"]


def test_slots_and_self_nesting(spark):
    g = graph({
        "page": [el("div", call("box", slots={"inner_block": [el("b", static=["x"]), call("box", slots={"inner_block": [el("i", static=["y"])]})]}), static=["page"])],
        "box": [el("section", slot(), static=["box"])],
    })
    got, t, ctx, *_ = run(spark, g, css(".box > .x", ".box .y", ".page .x"))
    assert got == {".box > .x": "matched", ".box .y": "unmatched", ".page .x": "matched"}
    assert cycles(t["entries"], t["items"]).count() == 1
    g = graph({"page": [call("outer", slots={"inner_block": [el("b", static=["x"])]})], "outer": [el("div", call("inner", slots={"inner_block": [slot()]}), static=["outer"])], "inner": [el("p", slot(), static=["inner"])]})
    assert run(spark, g, css(".outer > .inner > .x"))[0] == {".outer > .inner > .x": "matched"}


def test_raw_markup(spark):
    g = graph({"p": [el("div", raw(), static=["event-page"])]})
    got = run(spark, g, css(".event-page ul", ".event-page li:last-child", ".event-page ul li", ".event-page .z"))[0]
    assert list(got.values()) == ["matched", "matched", "unmatched", "unmatched"]


def test_body_is_an_ancestor_of_all(spark):
    g = graph({"a": [el("body", static=["dark"])], "b": [el("p", static=["text"])]}, ["a", "b"])
    assert run(spark, g, css(".dark .text", ".dark > .text"))[0] == {".dark .text": "matched", ".dark > .text": "unmatched"}


def test_nearest_dynamic_ancestor_shadows(spark):
    g = graph({"p": [el("div", el("div", el("b", static=["k"]), static=["w"], dynamic=[dyn()]), static=["w", "z"])]})
    assert run(spark, g, css(".w.z .k"))[0] == {".w.z .k": "possibly_dynamic"}


def test_clauses_follow_each_other(spark):
    g = graph({"p": [el("div", call("c0", "c1"))], "c0": [el("b", static=["one"])], "c1": [el("b", static=["two"])]})
    assert run(spark, g, css(".one + .two"))[0] == {".one + .two": "matched"}


def test_skipped_and_once(spark):
    got, *_ = run(spark, PAGE, ".page, .page, p, .page:has(.panel) { }\n@keyframes k { from { } }\n.page::before{}")
    assert got == {".page": "matched", "p": "skipped", ".page:has(.panel)": "skipped", "from": "skipped", ".page::before": "matched"}
    report = run(spark, PAGE, ".page, .page { }")[0]
    assert report == {".page": "matched"}


def test_empty_tables(spark):
    got, t, ctx, sel, results = run(spark, graph({"p": []}), "")
    assert got == {} and ctx.count() == 0 and results.count() == 0


def walk_keys(ctx, kinds, sel):
    """The fold of joins, told as a search with backtracking."""
    by_id = {c["ctx_id"]: c for c in ctx}

    def near(c, comb):
        if comb == ">":
            return [c["parent_id"]] if c["parent_id"] is not None else []
        if comb in ("+", "~"):
            out, p = [], c["prev_sibling_id"]
            while p is not None:
                out.append(p)
                p = by_id[p]["prev_sibling_id"] if comb == "~" else None
            return out + ([c["ctx_id"]] if c["repeat"] else [])
        out, p = [], c["parent_id"]
        while p is not None:
            out.append(p)
            p = by_id[p]["parent_id"]
        return out + [x["ctx_id"] for x in ctx if x["tag"] == "body" and x["ctx_id"] != c["ctx_id"]]

    def walk(c, i, dynamic):
        if i == 0:
            return True, dynamic
        failed = False
        for r in near(by_id[c], sel[i]["combinator"]):
            kind = kinds.get((r, i - 1))
            if kind:
                ok, d = walk(r, i - 1, dynamic or kind == "dynamic")
                if ok:
                    return True, d
                failed |= d
        return False, failed or dynamic

    last = len(sel) - 1
    return {c["ctx_id"]: walk(c["ctx_id"], last, False) for c in ctx if kinds.get((c["ctx_id"], last))}


def test_fold_equals_search(spark):
    rng = random.Random(5)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(rng.randrange(0, 4))] if depth else []
        return el(rng.choice(["div", "p", "body"]) if rng.random() < 0.9 else "b", *kids, static=rng.sample("abc", rng.randrange(0, 3)), dynamic=[dyn()] if rng.random() < 0.4 else [], repeat=rng.random() < 0.2)

    g = graph({f"t{i}": [tree(3), tree(2)] for i in range(4)}, [f"t{i}" for i in range(4)])
    t = load_graph(spark, json.dumps(g))
    ctx = contexts(t["entries"], t["items"]).cache()
    texts = sorted({"".join(p + rng.choice([" ", " > ", " + ", " ~ "]) for p in parts[:-1]) + parts[-1] for parts in ([rng.choice([".a", ".b", ".a.b", "p.c", "div", ".a.z", ".b:not(.c)"]) for _ in range(rng.randrange(2, 5))] for _ in range(24)) if any("." in p for p in parts)})
    rows = [(i, *r) for i, r in enumerate(selector_rows("x.css", css(*texts)))]
    sel = spark.createDataFrame(rows, SELECTORS)
    got = {(r["sel_id"], r["key_ctx"]): (r["matched"], r["dyn"] if r["matched"] else r["failed_dynamic"]) for r in match_keys(sel, ctx, t["nodes"]).collect()}
    facts = {r["node_id"]: r for r in t["nodes"].collect()}
    cs = [{"ctx_id": c["ctx_id"], "parent_id": c["parent_id"], "prev_sibling_id": c["prev_sibling_id"], "tag": facts[c["node_id"]]["tag"], "repeat": facts[c["node_id"]]["repeat"], "facts": facts[c["node_id"]]["facts"]} for c in sorted(ctx.collect(), key=lambda c: c["ctx_id"])]
    for c in cs:
        assert c["prev_sibling_id"] is None or c["prev_sibling_id"] < c["ctx_id"]

    def kind(c, s):
        if s["tag"] and s["tag"] != c["tag"] or set(s["not_classes"]) & set(c["facts"]["static"]):
            return None
        known = set(s["classes"]) & set(c["facts"]["static"])
        if known == set(s["classes"]):
            return "static"
        return "dynamic" if known and c["facts"]["dynamic"] else None

    n = 0
    for i, _, _, _, segs, _ in rows:
        kinds = {(c["ctx_id"], j): kind(c, s) for c in cs for j, s in enumerate(segs)}
        want = walk_keys(cs, kinds, segs)
        for k, w in want.items():
            assert got[i, k] == w, (texts, i, k)
        n += len(want)
    assert n == len(got) > 50


def test_stored_results_are_computed_once(spark):
    """A checkpoint computed its rows once to count and once more to write them."""
    made = spark.sparkContext.accumulator(0)

    def run(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    kept = materialized(spark.range(10, numPartitions=2).mapInPandas(run, "id long"))
    assert sorted(r["id"] for r in kept.collect()) == list(range(10)) and made.value == 10


def test_siblings_ask_for_no_paths(spark, monkeypatch):
    """Contexts carry what the combinators at hand ask for: siblings are found without the closure of the parents."""

    def never(*_):
        raise AssertionError("the closure of the parents")

    monkeypatch.setattr(match, "with_paths", never)
    t = load_graph(spark, json.dumps(SIBLINGS))
    ctx = contexts(t["entries"], t["items"])
    for text, found in ((".panel ~ .chip", 1), (".badge + .chip", 1), (".panel + .chip", 0), (".page > .chip", 1)):
        assert match.key_results(match.match_keys(selector_table(spark, [text]), ctx, t["nodes"])).count() == found
