"""The test tables as input of the engine: the star schema as a rendered forest, its parts as stylesheets, pages as markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.facts import dyn, facts, option
from .plans.persist import materialized
from .schema import FACTS, SELECTORS
from .sources.stylesheets import parse_selector, segments

#: Ids of the five levels: level * LEVEL + key (of a line item: order * LINES + place).
LEVEL, LINES = 10**15, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(level: int, key: Column) -> Column:
    return F.lit(level * LEVEL) + key.cast("long")


def forest(spark: SparkSession, sf_dir: str, keep: bool = False) -> DataFrame:
    """Regions, nations, customers, orders and line items as contexts, each its own node.

    Columns ``ctx_id, node_id, entry_ord, parent_id, parent_key, sibling, prev_sibling_id, tag, repeat,
    raw, facts``. Customers may be overdrawn (an optional class), orders have a priority that excludes the
    others of its group, line items of over 45 pieces have a class that isn't known. ``keep`` computes it
    once for a plan that reads it several times. ``path`` holds the ids of the ancestors from the region down.
    """
    region, nation, customer, orders, lineitem = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "lineitem"))
    customers = customer.join(nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = orders.join(customers.select("c_custkey", "c_nationkey", "n_regionkey"), F.col("o_custkey") == F.col("c_custkey"))
    placed = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    # lines stay where their order is: they are numbered, placed and know their neighbours without another shuffle
    lines = lineitem.withColumn("place", F.row_number().over(placed)).join(orders.select("o_orderkey", "o_custkey", "c_nationkey", "n_regionkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    slug = F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]+", "-"))

    def rows(df: DataFrame, ctx: Column, entry: str, parent: Column, tag: str, family: str, found: Column, *above: Column) -> DataFrame:
        """The contexts of a table; those that agree in the column ``family`` have one parent."""
        path = F.array(*[_id(i + 1, k) for i, k in enumerate(above)]).cast("array<bigint>")
        df = df.withColumn("ctx_id", ctx)
        before = F.lag("ctx_id").over(Window.partitionBy(family).orderBy("ctx_id"))
        return df.select("ctx_id", F.col(entry).cast("int").alias("entry_ord"), parent.cast("long").alias("parent_id"), path.alias("path"), F.lit(tag).alias("tag"), before.alias("prev_sibling_id"), found.alias("facts"))

    def word(prefix: str, c: str | Column) -> Column:
        return F.concat(F.lit(f"{prefix}-"), F.col(c) if isinstance(c, str) else c)

    def words(*cs: Column) -> Column:
        return F.array(*cs)

    no = F.lit(None)
    overdrawn = F.when(F.col("c_acctbal") < 0, words(F.lit("overdrawn"))).otherwise(F.array().cast("array<string>"))
    priority = F.array(F.array(option(words(word("prio", slug))), option(words(F.lit("prio-none"), F.lit("waiting")))))
    unknown = F.when(F.col("l_quantity") > 45, F.array(dyn("variable", "large"))).otherwise(F.array().cast("array<struct<reason:string,expr:string,chain:string>>"))
    parts = [
        rows(region, _id(1, F.col("r_regionkey")), "r_regionkey", no, "region", "r_regionkey", facts(words(word("in", "r_name")))),
        rows(nation, _id(2, F.col("n_nationkey")), "n_regionkey", _id(1, F.col("n_regionkey")), "nation", "n_regionkey", facts(words(word("of", "n_name"))), F.col("n_regionkey")),
        rows(customers, _id(3, F.col("c_custkey")), "n_regionkey", _id(2, F.col("c_nationkey")), "customer", "c_nationkey", facts(words(word("seg", "c_mktsegment")), overdrawn), F.col("n_regionkey"), F.col("c_nationkey")),
        rows(orders, _id(4, F.col("o_orderkey")), "n_regionkey", _id(3, F.col("o_custkey")), "order", "o_custkey", facts(words(word("status", "o_orderstatus")), None, priority), F.col("n_regionkey"), F.col("c_nationkey"), F.col("o_custkey")),
        rows(lines, _id(5, F.col("l_orderkey") * LINES + F.col("place")), "n_regionkey", _id(4, F.col("l_orderkey")), "line", "l_orderkey", facts(words(word("flag", "l_returnflag"), word("line", "l_linestatus")), None, None, unknown), F.col("n_regionkey"), F.col("c_nationkey"), F.col("o_custkey"), F.col("l_orderkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = materialized(out) if keep else out
    return out.select("*", F.col("ctx_id").alias("node_id"), F.col("parent_id").alias("parent_key"), F.col("ctx_id").alias("sibling"), F.lit(False).alias("repeat"), F.lit(False).alias("raw"))


def contexts_of(found: DataFrame) -> DataFrame:
    return found.select("ctx_id", "entry_ord", "node_id", "parent_id", "prev_sibling_id", F.coalesce("parent_key", F.lit(-1)).alias("parent_key"), "sibling", "path")


def nodes_of(found: DataFrame) -> DataFrame:
    return found.select("node_id", "tag", "repeat", "raw", "facts")


def selector_table(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Selectors from their texts, numbered from 0, with file ``app.css`` and the line of their place."""
    rows = [(i, t, "app.css", i + 1, segments(parse_selector(t)), None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SELECTORS)


def part_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stylesheet ``(path, content)`` for each brand, with a rule on a line of its own for each part."""
    part = table(spark, sf_dir, "part")
    kind = F.lower(F.regexp_replace("p_type", "[^A-Za-z0-9]+", "-"))
    rule = F.concat(F.lit(".brand > .size-"), F.col("p_size").cast("string"), F.lit(":hover, ."), kind, F.lit(" .k"), F.col("p_partkey").cast("string"), F.lit(":not(.gone) { color: red; animation: spin"), (F.col("p_size") % 7).cast("string"), F.lit(" 1s }"))
    brand = F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "-"))
    rules = part.groupBy(F.concat(brand, F.lit(".css")).alias("path")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", rule.alias("rule")))).alias("r"))
    return rules.select("path", F.array_join(F.concat(F.array(F.lit("@keyframes spin0 { from { top: 0 } }\n@keyframes idle { to { top: 1px } }")), F.transform("r", lambda x: x["rule"])), "\n").alias("content"))


def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scripts ``(path, content)`` of the pages, numbered within each."""
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<script>(.*?)</script>"), F.lit(1))).alias("n", "content"))
    return found.select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit("-"), F.col("n").cast("string"), F.lit(".js")).alias("path"), "content")


def app_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module file ``(path, content)`` for each nation: a function for each of its customers, with markup that calls others.

    The function of a customer has a class of its market segment, a toggle, a helper's class, and calls the
    next customer's function of the same nation, the shared button, and a component that nobody defines.
    """
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.regexp_replace("n_name", "[^A-Za-z0-9]", "")
    after = F.lead("c_custkey").over(Window.partitionBy("n_name").orderBy("c_custkey"))
    seg = F.lower("c_mktsegment")
    markup = F.concat(
        F.lit('    <div class={["seg-'), seg, F.lit('", @on && "open", tone(@x)]}>'),
        F.when(F.col("next").isNull(), F.lit("")).otherwise(F.concat(F.lit("<.c"), F.col("next").cast("string"), F.lit(" />"))),
        F.lit('<Ui.button class="go">{@x}</Ui.button><.nobody><hr /></.nobody></div>'),
    )
    body = F.concat(F.lit("  def c"), F.col("c_custkey").cast("string"), F.lit('(assigns) do\n    ~H"""\n'), markup, F.lit('\n    """\n  end\n'))
    rows = c.withColumn("next", after).withColumn("m", name).groupBy("m").agg(F.array_sort(F.collect_list(F.struct("c_custkey", body.alias("body")))).alias("b"))
    text = F.concat(F.lit("defmodule ShopWeb."), F.col("m"), F.lit(" do\n  use ShopWeb, :html\n  import ShopWeb.Core\n  alias ShopWeb.Kit, as: Ui\n\n"), F.array_join(F.transform("b", lambda x: x["body"]), "\n"), F.lit("end\n"))
    found = rows.select(F.concat(F.lit("lib/shop_web/"), F.lower("m"), F.lit(".ex")).alias("path"), text.alias("content"))
    shared = [
        ("lib/shop_web/core.ex", 'defmodule ShopWeb.Core do\n  def tone(:a), do: "warm"\n  def tone(_), do: nil\nend\n'),
        ("lib/shop_web/kit.ex", 'defmodule ShopWeb.Kit do\n  def button(assigns), do: ~H"<button class=\'btn\'>{render_slot(@inner_block)}</button>"\nend\n'),
    ]
    return found.unionByName(spark.createDataFrame(shared, "path string, content string"))


def shop_graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of a component graph: entries, items, nodes, trees, edges.

    Each nation is an entry with a tree that calls the trees of its customers, and these those of their
    orders, whose slot they fill. Overdrawn customers call their nation again, those of one segment a tree
    that is missing. Orders show their slot, urgent ones raw markup after it. One nation is a ``body``.
    """
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n"), F.col("n_nationkey").cast("int").alias("entry_ord"), "n_name")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("c"), F.col("c_nationkey").cast("string").alias("n"), "c_mktsegment", (F.col("c_acctbal") < 0).alias("overdrawn"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("o"), F.col("o_custkey").cast("string").alias("c"), "o_orderstatus", F.col("o_orderpriority").startswith("1-").alias("urgent"))

    def item(df: DataFrame, list_key: Column, place: Column, kind: str, val: Column, following: Column | None = None, ref: Column | None = None) -> DataFrame:
        none = F.lit(None).cast("string")
        return df.select(list_key.alias("list_key"), F.array(place.cast("int"), F.lit(0)).alias("ord"), F.lit(kind).alias("kind"), val.alias("val"), (none if following is None else following).alias("next_list"), (none if ref is None else ref).alias("ref"))

    def node(df: DataFrame, node_id: Column, ref: Column, tag: Column, found: Column | None, repeat: Column | None = None) -> DataFrame:
        raw = F.lit(found is None)
        return df.select(node_id.alias("node_id"), ref.alias("ref"), tag.cast("string").alias("tag"), (F.lit(False) if repeat is None else repeat).alias("repeat"), raw.alias("raw"), (F.lit(None).cast(FACTS) if found is None else found).alias("facts"))

    def together(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def col(prefix: str, key: str, suffix: str = "") -> Column:
        return F.concat(F.lit(prefix), F.col(key), F.lit(suffix))

    site = F.concat(F.lit("c"), F.col("c"), F.lit("@o"), F.col("o"))
    first, urgent = F.lit(0), o.where("urgent")
    rings, lost = c.where("overdrawn"), c.where("c_mktsegment = 'MACHINERY'")
    items = together([
        item(n, col("t:n", "n"), first, "E", col("n", "n", "#m"), col("n:n", "n", "#m")),
        item(c, col("n:n", "n", "#m"), F.col("c"), "C", F.concat(F.lit("n"), F.col("n"), F.lit("@c"), F.col("c")), col("t:c", "c"), col("c", "c")),
        item(c, col("t:c", "c"), first, "E", col("c", "c", "#s"), col("n:c", "c", "#s")),
        item(o, col("n:c", "c", "#s"), F.col("o"), "C", site, col("t:o", "o"), col("o", "o")),
        item(rings, col("n:c", "c", "#s"), F.lit(2**31 - 1), "C", col("c", "c", "@n"), col("t:n", "n"), col("n", "n")),
        item(lost, col("n:c", "c", "#s"), F.lit(2**31 - 2), "C", col("c", "c", "@gone"), col("t:gone", "c"), col("gone", "c")),
        item(o, col("t:o", "o"), first, "E", col("o", "o", "#a"), col("n:o", "o", "#a")),
        item(o, col("n:o", "o", "#a"), first, "S", F.lit("inner_block")),
        item(urgent, col("n:o", "o", "#a"), F.lit(1), "R", col("o", "o", "#r"), col("n:o", "o", "#r")),
        item(o, F.concat(F.lit("s:"), site, F.lit(":inner_block")), first, "E", F.concat(site, F.lit("#b")), F.concat(F.lit("n:"), site, F.lit("#b"))),
    ])
    none = F.array().cast("array<string>")
    nodes = together([
        node(n, col("n", "n", "#m"), col("n", "n"), F.when(F.col("entry_ord") == 3, "body").otherwise("main"), facts(F.array(F.lit("nation")))),
        node(c, col("c", "c", "#s"), col("c", "c"), F.lit("section"), facts(F.array(col("seg-", "c_mktsegment")), F.when(F.col("overdrawn"), F.array(F.lit("overdrawn"))).otherwise(none))),
        node(o, col("o", "o", "#a"), col("o", "o"), F.lit("article"), facts(F.array(col("status-", "o_orderstatus")))),
        node(o, F.concat(site, F.lit("#b")), col("c", "c"), F.lit("b"), facts(F.array(F.lit("given"))), F.col("o_orderstatus") == "F"),
        node(urgent, col("o", "o", "#r"), col("o", "o"), F.lit(None), None),
    ])
    edges = items.where("kind = 'C'").select(F.col("val").alias("edge_id"), F.col("ref").alias("to"))
    tag = F.when(F.col("edge_id").endswith("@n"), ".nation").otherwise(".part")
    edges = edges.select("edge_id", F.substring_index("edge_id", "@", 1).alias("ref"), tag.alias("callsite_tag"), F.substring_index("edge_id", "@", 1).alias("callsite_from"), F.array("to").alias("component_refs"))
    trees = together([n.select(col("n", "n").alias("ref")), c.select(col("c", "c").alias("ref")), o.select(col("o", "o").alias("ref"))])
    entries = n.select("entry_ord", col("n", "n").alias("ref"), F.lit("Shop").alias("module"), F.lit("shop.ex").alias("source_file"), F.col("n_name").alias("name"))
    return {"entries": entries, "items": items, "nodes": nodes, "trees": trees, "edges": edges}


def shop_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph document ``(path, content)`` for each nation: a tree for each customer, with a call for each order and a slot if overdrawn."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") < 0).alias("overdrawn"))
    calls = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.concat(F.lit('{"component_refs": ["o'), F.col("o_orderkey").cast("string"), F.lit('"]}'))).alias("calls"))
    slot = F.when(F.col("overdrawn"), F.array(F.lit('{"slot_name": "more"}'))).otherwise(F.array().cast("array<string>"))
    children = F.array_join(F.concat(F.coalesce("calls", F.array().cast("array<string>")), slot), ", ")
    tree = F.concat(F.lit('"c'), F.col("c_custkey").cast("string"), F.lit('": [{"tag": "section", "children": ['), children, F.lit("]}]"))
    rows = c.join(calls, "c_custkey", "left").groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(".json")).alias("path")).agg(F.array_join(F.collect_list(tree), ", ").alias("trees"))
    return rows.select("path", F.concat(F.lit('{"version": 2, "entries": [], "trees": {'), "trees", F.lit("}}")).alias("content"))


#: A module of widgets; {k} is the supplier, {n} its nation.
WIDGET = '''defmodule ShopWeb.W{k} do
  use ShopWeb, :html
  embed_templates "w{k}/*"

  def tone(:a), do: "t{k}"
  def tone(_), do: nil
  def both(:x), do: "one"
  def both(_), do: "two three"
  def nested(x), do: both(x)
  def markdown(x), do: x |> clean() |> raw()
  def pair(a, b), do: a
  def either(a, b), do: "far"
  def either(a), do: "near"
  defp bodiless(x)

  def panel(assigns) do
    assigns = assign(assigns, :cls, both(assigns.kind))
    ~H"""
    <section class={["panel", @cls]}><ul><li :for={c <- @item} class="i{k}">{render_slot(c)}</li></ul><.again />{render_slot(@inner_block)}</section>
    """
  end

  def again(assigns) do
    ~H"""
    <.panel class="wrap"><:item><b class="s{k}"></b></:item><u class="u{n}">{markdown(@x)}</u></.panel>
    """
  end

  def deep(assigns) do
    ~H"""
    <em class={["d{k}", nested(@k)]}></em>
    """
  end
end
'''
#: A stylesheet of a widget.
WIDGET_STYLE = """@custom-variant z { .no{k} { } }
@media print { .m{k} { color: red } }
.____unmatched___ .old{k}, .kept{k} { color: red }
.w{k}:has(.h{n}) { color: red }
"""


def _filled(text: str) -> Column:
    """The text with the supplier and its nation in it."""
    told = F.replace(F.lit(text), F.lit("{k}"), F.col("s_suppkey").cast("string"))
    return F.replace(told, F.lit("{n}"), F.col("s_nationkey").cast("string"))


def widget_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files ``(path, content)`` of a module for each supplier with a template that it embeds; some have a template of their own, a broken or a bare file."""
    s = table(spark, sf_dir, "supplier")

    def files(df: DataFrame, path: str, content: str) -> DataFrame:
        return df.select(_filled(path).alias("path"), _filled(content).alias("content"))

    out = files(s, "lib/shop_web/w{k}.ex", WIDGET)
    out = out.unionByName(files(s, "lib/shop_web/w{k}/show{k}.html.heex", "<p class='shown n{n}'><.link class='go'>x</.link></p>"))
    out = out.unionByName(files(s.where("s_acctbal < 0"), "lib/shop_web/alone{k}.html.heex", "<i class='alone'></i>"))
    out = out.unionByName(files(s.where("s_nationkey = 3"), "lib/shop_web/broken{k}.ex", "defmodule X do ("))
    return out.unionByName(files(s.where("s_nationkey = 5"), "lib/shop_web/bare{k}.ex", "x = 1"))


def widget_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(_filled("w{k}.css").alias("path"), _filled(WIDGET_STYLE).alias("content"))
