import json

from styleloom.functions.expressions import analyze, facts_of
from styleloom.operators.rewrite import invalidate_keyframes, invalidate_selectors, invalidated_files, remove_keyframes, remove_selectors, restore_keyframes, restore_selectors, restored_files
from styleloom.plans.graph import load_graph, merged_cycles
from styleloom.plans.registry import functions_of, local_lookup, remote_lookup
from styleloom.plans.resolve import component_cycles, graph_cycles, graph_document, graph_trees
from styleloom.sources.markup import Expr, build_tree, parse_markup, tokenize
from styleloom.sources.modules import clauses, modules, parse_modules
from styleloom.sources.scripts import literals
from styleloom.sources.stylesheets import keyframe_rows, parse_stylesheet, selector_rows, walk

CORE = """
defmodule MyWeb.Core do
  use Phoenix.Component

  def button(assigns) do
    assigns = assign(assigns, :cls, pick(assigns.kind))
    ~H\"\"\"
    <button class={["btn", @cls]}><%= render_slot(@inner_block) %>{render_slot(@inner_block)}</button>
    \"\"\"
  end

  def badge(%{big: true} = assigns), do: ~H"<b class='big'></b>"
  def badge(assigns), do: ~H"<i class='small'></i>"

  def pick(:a), do: "one"
  def pick(_), do: "two three"
  def markdown(x), do: x |> clean() |> raw()
  defp head(x)
end
"""
PAGE = """
defmodule MyWeb.Page do
  use MyWeb, :html
  import MyWeb.Core, only: [button: 1]
  alias MyWeb.Core, as: C

  def show(assigns) do
    ~H\"\"\"
    <main class="page">
      <.button class="wide"><span :if={@x} class={if @on, do: "on"}>hi</span></.button>
      <C.badge />
      <.nothing class="lost"><u>kept</u></.nothing>
      <.link class="go">x</.link>
      <div class="text">{markdown(@body)}</div>
    </main>
    \"\"\"
  end
end
"""


def files(spark, **more):
    rows = [("lib/my_web/core.ex", CORE), ("lib/my_web/page.ex", PAGE), ("lib/my_web/broken.ex", "defmodule X do ("), ("lib/my_web/a/one.html.heex", "<p class='alone'></p>")]
    return spark.createDataFrame(rows, "path string, content string")


def test_graph_of_sources(spark):
    f = files(spark)
    g = graph_document(f)
    assert [e["ref"] for e in g["entries"]] == ["fn:MyWeb.Core:badge:1:0", "fn:MyWeb.Core:badge:1:1", "fn:MyWeb.Core:button:1:0", "fn:MyWeb.Page:show:1:0", "tpl:lib/my_web/a/one.html.heex:one.html.heex"]
    button = g["trees"]["fn:MyWeb.Core:button:1:0"][0]
    assert button["classes"]["static"] == ["btn"] and button["classes"]["exclusive"] == [[["one"], ["two", "three"]]]
    assert button["children"] == [{"slot_name": "inner_block"}]
    main = g["trees"]["fn:MyWeb.Page:show:1:0"][0]
    wrapper, badge, kept, link, text = main["children"]
    assert wrapper["tag"] == ".button" and wrapper["classes"]["static"] == ["wide"]
    edge = wrapper["children"][0]
    assert edge["component_refs"] == ["fn:MyWeb.Core:button:1:0"] and edge["slot_children_by_name"]["inner_block"][0]["classes"]["optional"] == ["on"]
    assert badge["component_refs"] == ["fn:MyWeb.Core:badge:1:0", "fn:MyWeb.Core:badge:1:1"]
    assert kept["tag"] == "u" and link["tag"] == "a" and text["children"] == [{"raw_html": True, "expr": "markdown(@body)"}]
    assert g["unresolved"] == [{"type": "component", "tag": ".nothing", "from": "fn:MyWeb.Page:show:1:0", "reason": "unresolved"}]
    assert load_graph(spark, json.dumps(g))["entries"].count() == 5
    found, fns = modules(f), functions_of(clauses(f))
    calls = spark.createDataFrame([("MyWeb.Page", "button"), ("MyWeb.Page", "pick"), ("MyWeb.Page", "gone")], "caller string, name string")
    assert sorted(map(tuple, local_lookup(calls, found, fns).collect())) == [("MyWeb.Page", "button", "MyWeb.Core", 1), ("MyWeb.Page", "pick", "MyWeb.Core", 1)]
    calls = spark.createDataFrame([("MyWeb.Page", "C", "badge"), ("MyWeb.Page", "Core", "pick"), ("X", "No", "pick")], "caller string, target string, name string")
    assert sorted(r["target"] for r in remote_lookup(calls, found, fns).collect()) == ["C", "Core"]


def test_module_rows():
    mods, found, _ = parse_modules("a.ex", CORE)
    assert mods[0][:4] == ("MyWeb.Core", "a.ex", [], ["Phoenix.Component"])
    assert [(c[2], c[3], c[4]) for c in found] == [("button", 1, 0), ("badge", 1, 0), ("badge", 1, 1), ("pick", 1, 0), ("pick", 1, 1), ("markdown", 1, 0)]
    assert parse_modules("b.ex", "x = 1")[0] == [(None, "b.ex", [], [], {}, 0)] and parse_modules("c.ex", "(") == ([], [], [])


def test_expressions():
    assert analyze('"a  b"') == (["a", "b"], [])
    s, v = analyze('["x", @on && "y z", @k || "d", f(1), cond do @a -> "p"; true -> "q" end]')
    f = facts_of(s, [x for x in v if x["type"] != "fn_call"])
    assert f["static"] == ["x"] and f["optional"] == ["y", "z"] and f["exclusive"][1] == [["p"], ["q"]] and f["dynamic"][0]["reason"] == "unknown_expression"
    assert analyze("(")[0][0]["reason"] == "parse_error" and analyze("x")[0][0]["reason"] == "variable"


def test_markup():
    roots = parse_markup('<div><b>one<p>two</div><!-- <i> --><br/>{x}<%= if y do %><u class={"a}b"}></u><% end %>')
    assert [(r.tag, [c.tag for c in r.children]) for r in roots] == [("div", ["b", "p"]), ("br", []), ("", []), ("u", [])]
    assert roots[3].attrs["class"] == Expr('"a}b"') and roots[2].expr == "x"
    assert [t.tag for t in build_tree(tokenize("<a><b><c>"))] == ["c", "b", "a"]
    assert list(tokenize("<a href=x/>"))[0].kind == "self" and list(tokenize("a < b")) == [] and list(tokenize("</ x><b>")) == []
    node = parse_markup("<ul><li :for={c <- @cell}>{render_slot(c)}{render_slot(d)}{render_slot(@e)}</li></ul>")[0].children[0]
    assert [(c.slot, c.slot_var) for c in node.children] == [("cell", None), (None, "d"), ("e", None)] and node.repeat


def test_literals():
    text = "// 'no'\nf('a\\'b', \"\") /* 'no' */\ng(`x${ {k: 'in'} } y${`z`}`)\n'open"
    assert literals(text) == [("a'b", 2), ("x", 3), (" y", 3), ("open", 4)]


def test_selectors():
    css = '@import "tailwindcss";\n.a, .b > .c:not(.d):hover { color: red }\n@media x {\n  ul li.e + [x] .f { }\n}\n.g:has(.h) { }\n:is(.i) > .j, p { }\n@custom-variant z { .no { } }\n.k { & .l { } }'
    got = {(r[0], r[2]): r[3] if r[4] is None else r[4] for r in selector_rows("x.css", css)}
    short = {k: v if isinstance(v, str) else [(s["combinator"], s["classes"], s["not_classes"], s["tag"], s["wildcard"]) for s in v] for k, v in got.items()}
    assert short == {
        (".a", 2): [(None, ["a"], [], None, False)],
        (".b > .c:not(.d):hover", 2): [(None, ["b"], [], None, False), (">", ["c"], ["d"], None, False)],
        ("ul li.e + [x] .f", 4): [(None, [], [], "ul", False), (" ", ["e"], [], "li", False), ("+", [], [], None, True), (" ", ["f"], [], None, False)],
        (".g:has(.h)", 6): "unsupported structural pseudo-class",
        (":is(.i) > .j", 7): [(">", ["j"], [], None, False)],
        ("p", 7): "no class selectors",
        (".k", 9): [(None, ["k"], [], None, False)],
        ("& .l", 9): [(" ", ["l"], [], None, False)],
    }


def test_stylesheet_lines_count_once():
    """The lines of a long stylesheet come from one pass over its text; before, each rule counted from the start."""
    class Counted(str):
        scanned = 0

        def count(self, sub, start=0, end=None):
            end = len(self) if end is None else end
            Counted.scanned += end - start
            return super().count(sub, start, end)

    text = Counted("".join(f"/* {i} */ /* x */\n.a{i},\n.b{i} {{ color: red;\n animation: k{i} 1s }}\n@import 'x{i}';\n@media x {{\n .c {{ }} }}\n" for i in range(500)))
    found = list(walk(parse_stylesheet(text)))
    assert [b.line for b in found[:4]] == [2, 5, 6, 7] and [b.line for b in found[-4:]] == [3495, 3498, 3499, 3500]
    assert [line for _, _, line in found[-4].declarations] == [3496, 3497]
    assert Counted.scanned <= len(text)


def test_rewrites(spark):
    css = ".a,\n.b { color: red }\n@media x { .a { } }\n@keyframes k { from { } }\n.c { animation: j 1s }"
    marked = invalidate_selectors(css, {(".a", 1)})
    assert marked.startswith(".____unmatched___ .a,\n.b {") and restore_selectors(marked) == (css.replace(".a,", " .a,", 1), 1)
    assert remove_selectors(css, {(".a", 1), (".a", 3)}) == ".b { color: red }\n@keyframes k { from { } }\n.c { animation: j 1s }"
    assert remove_selectors(marked, set()).startswith(".b {")
    off = invalidate_keyframes(css, {"k"})
    assert "@keyframes ____unmatched___k" in off and restore_keyframes(off) == (css, 1) and "@keyframes" not in remove_keyframes(off, set())
    assert sorted(r[:2] for r in keyframe_rows("x", off)) == [("invalidated", "k")]
    f = spark.createDataFrame([("x.css", css), ("y.css", ".a { }")], "path string, content string")
    t = spark.createDataFrame([("x.css", ".a", 1)], "file string, selector string, line int")
    out = {r["path"]: (r["selectors"], r["content"]) for r in restored_files(invalidated_files(f, t)).collect()}
    assert out["y.css"] == (0, ".a { }") and out["x.css"][0] == 1


def test_cycles_merge(spark):
    df = spark.createDataFrame([(["a", "b"], None, "t"), (["a", "b"], ".x", None)], "path array<string>, callsite_tag string, type string")
    assert [tuple(r) for r in merged_cycles(df).collect()] == [(["a", "b"], ".x", "t")]


def test_component_cycles():
    """Each way back once, from the entry that came there first; slot content is followed too, missing trees are not."""
    def calls(*refs, **slots):
        return {"component_refs": list(refs), "slot_children_by_name": slots}

    trees = {"a": [{"children": [calls("b", "gone")]}], "b": [calls("c", inner_block=[calls("a")])], "c": [calls("c"), calls("c")], "d": [calls("b")]}
    assert [c["path"] for c in component_cycles(trees)] == [["a", "b", "c", "c"], ["a", "b", "a"]]
    assert component_cycles({"a": [{"slot_name": "x"}]}) == []


def test_trees_without_a_registry_in_each_task(spark, monkeypatch):
    """Files of one partition are dealt to many tasks; a tree knows nested helpers, raw markup through helpers and cycles, and no registry is broadcast."""
    ring = '''defmodule MyWeb.Ring do
  alias MyWeb.Core, as: C
  def a(assigns), do: ~H"<.b class={far(@x)} />{through(@x)}"
  def b(assigns), do: ~H"<.a /><.alone />"
  def far(x), do: C.pick(x)
  def through(x), do: C.markdown(x)
  def alone(x), do: ~H"<hr />"
end
'''
    f = files(spark).unionByName(spark.createDataFrame([("lib/my_web/ring.ex", ring)], "path string, content string")).coalesce(1)

    def never(*_):
        raise AssertionError("a broadcast")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", never)
    assert clauses(f).rdd.getNumPartitions() >= 8
    trees = {r["ref"]: json.loads(r["tree"]) for r in graph_trees(f).collect()}
    wrapper, raw = trees["fn:MyWeb.Ring:a:1:0"]
    assert wrapper["tag"] == ".b" and wrapper["classes"]["exclusive"] == [[["one"], ["two"], ["three"]]] and raw == {"raw_html": True, "expr": "through(@x)"}
    a, b = "fn:MyWeb.Ring:a:1:0", "fn:MyWeb.Ring:b:1:0"
    assert graph_cycles(f) == [{"type": "component", "path": [a, b, a]}]
