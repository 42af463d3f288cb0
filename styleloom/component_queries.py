"""Queries over component graphs and template modules that are made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query
from .corpora import selector_table, shop_documents, shop_graph, table, widget_files, widget_styles
from .operators.match import class_postings, key_results, match_keys
from .operators.rewrite import invalidated_selectors
from .plans.expand import contexts, cycles, missing_refs
from .plans.graph import all_cycles, all_unresolved, flatten_graphs, graph_stats, merged_cycles
from .plans.persist import materialized
from .plans.registry import functions_of, local_lookup
from .plans.resolve import graph_cycles, graph_trees
from .sources.modules import clauses, embedded, modules, standalone, unreadable
from .sources.stylesheets import selectors

# --- the graph of nations, customers and orders -------------------------------------------------------

#: The contexts of corpora.shop_graph, in DuckDB: nation, customer, order, place within the order, tag, definition, parent.
SHOP = """
WITH co AS (SELECT n_nationkey AS n, c_custkey AS c, c_acctbal < 0 AS overdrawn, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey),
oo AS (SELECT n, c, o_orderkey AS o, o_orderstatus AS status, o_orderpriority LIKE '1-%' AS urgent FROM orders JOIN co ON o_custkey = c),
r AS (
  SELECT n_nationkey AS n, -1 AS c, -1 AS o, 0 AS place, CASE n_nationkey WHEN 3 THEN 'body' ELSE 'main' END AS tag, 'n' || n_nationkey AS def, NULL AS up FROM nation
  UNION ALL SELECT n, c, -1, 1, 'section', 'c' || c, 'n' || n FROM co
  UNION ALL SELECT n, c, o, 2, 'article', 'o' || o, 'c' || c FROM oo
  UNION ALL SELECT n, c, o, 3, 'b', 'o' || o, 'o' || o FROM oo
  UNION ALL SELECT n, c, o, 4, 'raw', 'o' || o, 'o' || o FROM oo WHERE urgent),
ctx AS (SELECT *, row_number() OVER (ORDER BY n, c, o, place) - 1 AS id FROM r)
"""


@query("g6_expand_contexts", f"""{SHOP}
SELECT x.id AS ctx_id, 'n' || x.n AS entry_ref, x.def AS definition_ref, x.tag, p.id AS parent_id,
  lag(x.id) OVER (PARTITION BY x.n, x.up ORDER BY x.id) AS prev_sibling_id
FROM ctx x LEFT JOIN ctx p ON p.n = x.n AND p.def = x.up AND p.place < 3 AND p.place = CASE x.place WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 0 THEN -1 ELSE 2 END""")
def expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = shop_graph(spark, sf_dir)
    rows = contexts(t["entries"], t["items"]).join(t["nodes"].select("node_id", F.coalesce("tag", F.lit("raw")).alias("tag")), "node_id")
    return rows.select("ctx_id", "entry_ref", "definition_ref", "tag", "parent_id", "prev_sibling_id")


@query("g8_cycles", f"{SHOP} SELECT 'n' || n || ' > c' || c || ' > n' || n AS path, 'c' || c || '@n' AS edge FROM co WHERE overdrawn")
def cycle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = shop_graph(spark, sf_dir)
    return cycles(t["entries"], t["items"]).select(F.array_join("path", " > ").alias("path"), F.col("callsite_edge").alias("edge"))


@query("g9_missing_refs", f"{SHOP} SELECT 'gone' || c AS ref, 'n' || n || ' > c' || c || ' > gone' || c AS path FROM co WHERE seg = 'MACHINERY'")
def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = shop_graph(spark, sf_dir)
    return missing_refs(t["entries"], t["items"], t["trees"]).select("ref", F.array_join("path", " > ").alias("path"))


@query("a5_graph_stats", f"""{SHOP}
SELECT (SELECT count(*) FROM nation) AS entries, (SELECT count(*) FROM nation) + (SELECT count(*) FROM co) + (SELECT count(*) FROM oo) AS trees,
  (SELECT count(*) FROM nation) + (SELECT count(*) FROM co) + (SELECT 2 * count(*) + count(*) FILTER (urgent) FROM oo) AS canonical_nodes,
  (SELECT count(*) FROM ctx) AS contexts, (SELECT CASE WHEN count(*) > 0 THEN 3 END FROM oo) AS deepest_call,
  (SELECT count(DISTINCT seg) FROM co) + (SELECT count(DISTINCT status) FROM oo) + (SELECT CAST(max(overdrawn) AS INTEGER) FROM co) + 2 AS classes,
  (SELECT 1 + CAST(max(overdrawn) AS INTEGER) FROM co) AS widest_node""")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = shop_graph(spark, sf_dir)
    return graph_stats(t["entries"], t["trees"], t["items"], materialized(contexts(t["entries"], t["items"])), t["nodes"], class_postings(t["nodes"]))


@query("s17_graph_items", """SELECT kind, path, count(*) AS n FROM (
  SELECT 'E' AS kind, 'n' || c_nationkey || '.json' AS path FROM customer UNION ALL SELECT 'S', 'n' || c_nationkey || '.json' FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'C', 'n' || c_nationkey || '.json' FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY ALL""")
def items_of_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_graphs(shop_documents(spark, sf_dir)).groupBy("kind", "path").agg(F.count(F.lit(1)).alias("n"))


@query("a11_merged_cycles", """SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS path, min(c_mktsegment) FILTER (c_acctbal < 0) IS NOT NULL AS sited FROM customer GROUP BY 1""")
def cycles_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("path"), F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).alias("callsite_tag"))
    return merged_cycles(rows).select(F.get("path", F.lit(0)).alias("path"), F.col("callsite_tag").isNotNull().alias("sited"))


@query("u3_cycles_of_both_stages", f"""{SHOP}
SELECT 'n' || n || ' > c' || c || ' > n' || n AS path, '.nation' AS tag, CASE WHEN seg = 'BUILDING' THEN 'component' END AS type FROM co WHERE overdrawn
UNION ALL SELECT 'lost > lost', '.lost', 'component' FROM co HAVING count(*) > 0""")
def cycles_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = shop_graph(spark, sf_dir)
    c = table(spark, sf_dir, "customer").where("c_acctbal < 0 AND c_mktsegment = 'BUILDING'")
    n, own = (F.concat(F.lit(p), F.col(k).cast("string")) for p, k in (("n", "c_nationkey"), ("c", "c_custkey")))
    none = F.lit(None).cast("string")
    known = c.select(F.array(n, own, n).alias("path"), none.alias("callsite_tag"), none.alias("callsite_from"), F.lit("component").alias("type"))
    lost = table(spark, sf_dir, "customer").select(F.array(F.lit("lost"), F.lit("lost")).alias("path"), F.lit(".lost").alias("callsite_tag"), none.alias("callsite_from"), F.lit("component").alias("type"))
    both = all_cycles(known.unionByName(lost), cycles(t["entries"], t["items"]), t["edges"])
    return both.select(F.array_join("path", " > ").alias("path"), F.col("callsite_tag").alias("tag"), "type")


@query("a10_unresolved_of_both_stages", f"""{SHOP}
SELECT NULL AS type, 'gone' || c AS ref, NULL AS tag FROM co WHERE seg = 'MACHINERY' UNION ALL SELECT DISTINCT 'component', NULL, '.of-' || n FROM co""")
def unresolved_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = shop_graph(spark, sf_dir)
    none = F.lit(None).cast("string")
    recorded = table(spark, sf_dir, "customer").select(
        none.alias("ref"), F.lit(None).cast("array<string>").alias("path"), F.lit("component").alias("type"), F.concat(F.lit(".of-"), F.col("c_nationkey").cast("string")).alias("tag"), F.lit("x").alias("from"), F.lit("unresolved").alias("reason")
    )
    return all_unresolved(recorded, missing_refs(t["entries"], t["items"], t["trees"])).select("type", "ref", "tag")


def _matched(sel: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = shop_graph(spark, sf_dir)
        items, nodes = materialized(t["items"]), materialized(t["nodes"])
        ctx = materialized(contexts(t["entries"], items).select("ctx_id", "entry_ord", "node_id", "parent_id", "prev_sibling_id", "parent_key", "sibling"))
        results = key_results(match_keys(selector_table(spark, [sel]), ctx, nodes, depth=8))
        return results.groupBy("result").agg(F.count(F.lit(1)).alias("n"), F.sum("key_ctx").alias("checksum"))

    return run


for _name, _sel, _sql in (
    ("j5_ambient_body", "body .given", "place = 3"),
    ("j5_ambient_inner", ".nation > .seg-BUILDING .given", "place = 3 AND c IN (SELECT c FROM co WHERE seg = 'BUILDING')"),
    ("j8_repeat_adjacent", ".given + .given", "place = 3 AND o IN (SELECT o FROM oo WHERE status = 'F')"),
    ("j8_repeat_sibling", ".given ~ .given", "place = 3 AND o IN (SELECT o FROM oo WHERE status = 'F')"),
    ("p10_raw_markup", ".status-O > em", "place = 4 AND o IN (SELECT o FROM oo WHERE status = 'O')"),
    ("g7_slot_content", ".overdrawn .status-P > .given", "place = 3 AND o IN (SELECT o FROM oo JOIN co USING (c) WHERE status = 'P' AND overdrawn)"),
    ("j6_calls_are_siblings", ".status-F + .status-O", "place = 2 AND o IN (SELECT o FROM (SELECT o, status, lag(status) OVER (PARTITION BY c ORDER BY o) AS before FROM oo) WHERE status = 'O' AND before = 'F')"),
):
    query(_name, f"{SHOP} SELECT 'match' AS result, count(*) AS n, CAST(sum(id) AS BIGINT) AS checksum FROM ctx WHERE {_sql} HAVING count(*) > 0")(_matched(_sel))


# --- modules of widgets -----------------------------------------------------------------------------------

#: The suppliers that corpora.widget_files makes modules of.
WIDGETS = "WITH w AS (SELECT s_suppkey AS k, s_nationkey AS n, s_acctbal AS a, 'ShopWeb.W' || s_suppkey AS module, 'lib/shop_web/w' || s_suppkey || '.ex' AS file FROM supplier)"


@query("s2_unreadable_modules", f"{WIDGETS} SELECT 'lib/shop_web/broken' || k || '.ex' AS path FROM w WHERE n = 3")
def unreadable_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = widget_files(spark, sf_dir)
    return unreadable(files, modules(files)).select("path")


@query("s3_bare_files", f"{WIDGETS} SELECT 'lib/shop_web/bare' || k || '.ex' AS path FROM w WHERE n = 5")
def bare_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules(widget_files(spark, sf_dir)).where("module IS NULL").select(F.col("source_file").alias("path"))


@query("s7_heads_and_clauses", f"""{WIDGETS}, c(name, arity, clause, markup) AS (VALUES ('tone', 1, 0, false), ('tone', 1, 1, false), ('both', 1, 0, false), ('both', 1, 1, false), ('nested', 1, 0, false),
  ('markdown', 1, 0, false), ('pair', 2, 0, false), ('either', 2, 0, false), ('either', 1, 0, false), ('panel', 1, 0, true), ('again', 1, 0, true), ('deep', 1, 0, true))
SELECT module, name, arity, clause, markup FROM w, c""")
def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(widget_files(spark, sf_dir)).select("module", "name", "arity", "clause", F.col("heex").isNotNull().alias("markup"))


@query("s9_assign_facts", f"{WIDGETS} SELECT module, 'both' AS called FROM w")
def assign_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(widget_files(spark, sf_dir)).where("name = 'panel'").select("module", F.get_json_object("assigns", "$.cls.call[1]").alias("called"))


_TEMPLATE = "'<p class=''shown n' || n || '''><.link class=''go''>x</.link></p>'"


@query("s10_embedded_templates", f"{WIDGETS} SELECT module, file AS source_file, 'show' || k || '.html.heex' AS name, {_TEMPLATE} AS heex FROM w")
def embedded_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(widget_files(spark, sf_dir)).select("module", "source_file", "name", "heex")


@query("s11_standalone_templates", f"{WIDGETS} SELECT 'lib/shop_web/alone' || k || '.html.heex' AS source_file, 'alone' || k || '.html.heex' AS name FROM w WHERE a < 0")
def standalone_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = widget_files(spark, sf_dir)
    return standalone(files, embedded(files)).select("source_file", "name")


@query("j14_arity_one_first", f"{WIDGETS} SELECT module AS caller, 'either' AS name, 1 AS arity FROM w UNION ALL SELECT module, 'pair', 2 FROM w")
def arities(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = widget_files(spark, sf_dir)
    found = clauses(files)
    calls = found.where("name IN ('either', 'pair')").select(F.col("module").alias("caller"), "name").distinct()
    return local_lookup(calls, modules(files), functions_of(found)).select("caller", "name", "arity")


def _trees(spark: SparkSession, sf_dir: str, name: str, **paths: str) -> DataFrame:
    """For each tree of this name the values at these JSON paths."""
    rows = graph_trees(widget_files(spark, sf_dir)).where(F.col("name").rlike(f"^{name}"))
    return rows.select("ref", *[F.get_json_object("tree", p).alias(c) for c, p in paths.items()])


@query("u6_functions_and_templates", f"{WIDGETS} SELECT 'fn' AS kind, 3 * count(*) AS n FROM w UNION ALL SELECT 'tpl', count(*) + count(*) FILTER (a < 0) FROM w")
def tree_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph_trees(widget_files(spark, sf_dir))
    return rows.groupBy(F.substring_index("ref", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _ref(name: str) -> str:
    return f"'fn:' || module || ':{name}:1:0' AS ref"


@query("j18_assigned_classes", f"""{WIDGETS} SELECT {_ref("panel")}, 'panel' AS static, '[[["one"],["two","three"]]]' AS exclusive FROM w""")
def assigned_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir, "panel$", static="$[0].classes.static[0]", exclusive="$[0].classes.exclusive")


@query("g2_bound_slots", f"""{WIDGETS} SELECT {_ref("panel")}, 'item' AS slot, 'true' AS repeat, 'i' || k AS static, 'inner_block' AS last FROM w""")
def bound_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = "$[0].children[0].children[0]"
    return _trees(spark, sf_dir, "panel$", slot=f"{li}.children[0].slot_name", repeat=f"{li}.repeat", static=f"{li}.classes.static[0]", last="$[0].children[2].slot_name")


@query("g14_wrapper_nodes", f"""{WIDGETS} SELECT {_ref("again")}, '.panel' AS tag, 'wrap' AS static, 'fn:' || module || ':panel:1:0' AS calls FROM w""")
def wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir, "again$", tag="$[0].tag", static="$[0].classes.static[0]", calls="$[0].children[0].component_refs[0]")


@query("a14_slots_by_name", f"""{WIDGETS} SELECT {_ref("again")}, 's' || k AS item, 'u' || n AS block FROM w""")
def slots_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = "$[0].children[0].slot_children_by_name"
    return _trees(spark, sf_dir, "again$", item=f"{slots}.item[0].classes.static[0]", block=f"{slots}.inner_block[0].classes.static[0]")


@query("g11_raw_helpers", f"""{WIDGETS} SELECT {_ref("again")}, 'true' AS raw, 'markdown(@x)' AS expr FROM w""")
def raw_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "$[0].children[0].slot_children_by_name.inner_block[0].children[0]"
    return _trees(spark, sf_dir, "again$", raw=f"{raw}.raw_html", expr=f"{raw}.expr")


@query("g10_nested_returns", f"""{WIDGETS} SELECT {_ref("deep")}, '[[["one"],["two"],["three"]]]' AS exclusive, 'either' AS variant, '["d' || k || '"]' AS static FROM w""")
def nested_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir, "deep$", exclusive="$[0].classes.exclusive", variant="$[0].variants[0].type", static="$[0].static")


@query("p21_link_is_an_anchor", f"{WIDGETS} SELECT 'tpl:' || module || ':show' || k || '.html.heex' AS ref, 'a' AS tag, 'go' AS static, 'n' || n AS owner FROM w")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir, "show", tag="$[0].children[0].tag", static="$[0].children[0].classes.static[0]", owner="$[0].classes.static[1]")


@query("g5_component_cycles", f"{WIDGETS} SELECT 'fn:' || module || ':again:1:0 > fn:' || module || ':panel:1:0 > fn:' || module || ':again:1:0' AS path, 'component' AS type FROM w")
def component_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph_cycles(widget_files(spark, sf_dir))
    return spark.createDataFrame([(" > ".join(c["path"]), c["type"]) for c in found], "path string, type string")


# --- stylesheets of widgets ---------------------------------------------------------------------------------


def _styled(column: str, condition: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = selectors(widget_styles(spark, sf_dir))
        return rows.where(condition).select("file", "selector", "line", F.coalesce("skip_reason", F.lit("")).alias(column))

    return run


_FILE = "'w' || k || '.css' AS file"
query("p2_at_rules", f"{WIDGETS} SELECT {_FILE}, '.m' || k AS selector, 2 AS line, '' AS reason FROM w")(_styled("reason", "selector LIKE '.m%' OR selector LIKE '.no%'"))
query("p4_marked_rules", f"{WIDGETS} SELECT {_FILE}, '.kept' || k AS selector, 3 AS line, '' AS reason FROM w")(_styled("reason", "selector LIKE '%.old%' OR selector LIKE '.kept%'"))
query("p5_structural_pseudos", f"{WIDGETS} SELECT {_FILE}, '.w' || k || ':has(.h' || n || ')' AS selector, 4 AS line, 'unsupported structural pseudo-class' AS reason FROM w")(_styled("reason", "selector LIKE '%:has%'"))


@query("k11_collect_invalidated", f"{WIDGETS} SELECT {_FILE}, '.old' || k AS selector, 3 AS line FROM w")
def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalidated_selectors(widget_styles(spark, sf_dir)).select("file", "selector", "line")

