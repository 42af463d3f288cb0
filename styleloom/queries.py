"""The queries of the engine over the test tables: selectors, markup, scripts, stylesheets, modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import QUERIES, SQL, Query, query
from .corpora import app_modules, contexts_of, forest, nodes_of, page_scripts, part_styles, selector_table, table
from .functions.facts import class_words, concrete_classes, dyn, facts, first_dynamic, holds_classes, node_label, open_option, option, strings, violates_group
from .operators.match import ancestors, buckets, class_postings, key_results, match_keys
from .operators.report import chains, coverage, diagnostics, first_of_each, in_order, selector_classes_of
from .operators.rewrite import invalidated_files, keyframes_invalidated, invalidated_selectors, keyframes_removed, removed_files, restored_files
from .plans.persist import materialized
from .plans.registry import functions_of, local_lookup, remote_lookup
from .plans.resolve import graph_trees
from .sources.markup import VOID, attribute_rows, node_rows, token_rows
from .sources.modules import clauses, modules
from .sources.scripts import class_tokens, evidence_report, script_evidence, script_files, script_literals
from .sources.stylesheets import all_classes, keyframes, prefiltered, selectors, unused_keyframes, vendor_evidence

# --- selectors over the star schema -------------------------------------------------------------

#: The forest of corpora.forest, told in SQL.
FOREST = """
WITH c AS (SELECT c_custkey, c_nationkey, n_regionkey, c_mktsegment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT o_orderkey, o_custkey, n_regionkey, c_nationkey, o_orderstatus, c_mktsegment, o_orderpriority FROM orders JOIN c ON o_custkey = c_custkey),
l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place,
             l_returnflag, l_linestatus, l_quantity, o.* FROM lineitem JOIN o ON l_orderkey = o_orderkey),
li AS (SELECT 5000000000000000 + l_orderkey * 1000 + place AS id, * FROM l)
"""


def _selected(sel: str) -> Query:
    """How often a selector matches for certain, how often perhaps, and a sum over the ids of the keys."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = forest(spark, sf_dir, keep=True)
        results = key_results(match_keys(selector_table(spark, [sel]), contexts_of(found), nodes_of(found), depth=8))
        return results.groupBy("result").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("key_ctx") % 1_000_000_007).cast("long").alias("checksum"))

    return run


def _counted(body: str) -> str:
    """From a statement that gives (id, result)."""
    return f"{FOREST} SELECT result, count(*) AS n, CAST(sum(id % 1000000007) AS BIGINT) AS checksum FROM ({body}) GROUP BY result"


#: Selectors by the operator that they exercise, with the keys that they find.
SELECTED = {
    "j3_child": (".seg-BUILDING > .status-F", "SELECT 4000000000000000 + o_orderkey AS id, 'match' AS result FROM o WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'"),
    "j4_descendant": (".in-ASIA .flag-R", "SELECT id, 'match' AS result FROM li JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND l_returnflag = 'R'"),
    "j6_adjacent": (".flag-R + .flag-N", "SELECT id, 'match' AS result FROM (SELECT *, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY place) AS p FROM li) WHERE l_returnflag = 'N' AND p = 'R'"),
    "j7_general_sibling": (".flag-R ~ .flag-A", "SELECT id, 'match' AS result FROM li a WHERE l_returnflag = 'A' AND EXISTS (SELECT 1 FROM li b WHERE b.l_orderkey = a.l_orderkey AND b.place < a.place AND b.l_returnflag = 'R')"),
    "j9_chain": (".in-EUROPE > nation .seg-MACHINERY > .status-O > .flag-N.line-O", "SELECT id, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'match' ELSE 'dynamic' END AS result FROM li JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND c_mktsegment = 'MACHINERY' AND o_orderstatus = 'O' AND (l_returnflag = 'N' OR l_linestatus = 'O') AND (l_quantity > 45 OR l_returnflag = 'N' AND l_linestatus = 'O')"),
    "j9_chain_siblings": (".status-F + .status-O > .flag-R ~ .line-F", "SELECT id, 'match' AS result FROM li a WHERE l_linestatus = 'F' AND EXISTS (SELECT 1 FROM li b WHERE b.l_orderkey = a.l_orderkey AND b.place < a.place AND b.l_returnflag = 'R') AND o_orderkey IN (SELECT o_orderkey FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM o) WHERE o_orderstatus = 'O' AND p = 'F')"),
    "p7_tag": ("order.status-P", "SELECT 4000000000000000 + o_orderkey AS id, 'match' AS result FROM o WHERE o_orderstatus = 'P'"),
    "j2_tag_ancestor": ("customer .line-F", "SELECT id, 'match' AS result FROM li WHERE l_linestatus = 'F'"),
    "p8_negative": (".flag-R:not(.line-F)", "SELECT id, 'match' AS result FROM li WHERE l_returnflag = 'R' AND l_linestatus <> 'F'"),
    "p9_wildcard": (".seg-FURNITURE > * > .flag-A", "SELECT id, 'match' AS result FROM li WHERE c_mktsegment = 'FURNITURE' AND l_returnflag = 'A'"),
    "p11_dynamic": (".flag-A.runtime-only", "SELECT id, 'dynamic' AS result FROM li WHERE l_returnflag = 'A' AND l_quantity > 45"),
    "p11_dynamic_chain": (".status-F > .flag-A.runtime-only", "SELECT id, 'dynamic' AS result FROM li WHERE o_orderstatus = 'F' AND l_returnflag = 'A' AND l_quantity > 45"),
    "p11_optional": (".overdrawn.seg-HOUSEHOLD", "SELECT 3000000000000000 + c_custkey AS id, 'match' AS result FROM c WHERE c_acctbal < 0 AND c_mktsegment = 'HOUSEHOLD'"),
    "p12_exclusive": (".prio-none.waiting", "SELECT 4000000000000000 + o_orderkey AS id, 'match' AS result FROM o"),
    "j1_class_lookup": (".flag-N.line-O", "SELECT id, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'match' ELSE 'dynamic' END AS result FROM li WHERE (l_returnflag = 'N' OR l_linestatus = 'O') AND (l_quantity > 45 OR l_returnflag = 'N' AND l_linestatus = 'O')"),
}
for _name, (_sel, _sql) in SELECTED.items():
    query(_name, _counted(_sql))(_selected(_sel))


#: Selectors with what decides on their bucket in SQL: a table that must have rows, and the bucket if it has.
BUCKETS = {
    ".flag-R": ("li WHERE l_returnflag = 'R'", "matched"),
    ".seg-BUILDING .flag-N": ("li WHERE c_mktsegment = 'BUILDING' AND l_returnflag = 'N'", "matched"),
    "line.flag-A:hover": ("li WHERE l_returnflag = 'A'", "matched"),
    ".status-F > .line-F": ("li WHERE o_orderstatus = 'F' AND l_linestatus = 'F'", "matched"),
    ".status-F > .line-O": ("li WHERE o_orderstatus = 'F' AND l_linestatus = 'O'", "matched"),
    ".in-ASIA": ("region WHERE r_name = 'ASIA'", "matched"),
    ".in-ATLANTIS": ("region WHERE r_name = 'ATLANTIS'", "matched"),
    ".flag-A.runtime-only": ("li WHERE l_returnflag = 'A' AND l_quantity > 45", "possibly_dynamic"),
    ".is-F": ("orders WHERE o_orderstatus = 'F'", "runtime_matched"),
    ".is-F .flag-A": ("orders WHERE o_orderstatus = 'F'", "runtime_matched"),
    ".is-Q": ("orders WHERE o_orderstatus = 'Q'", "runtime_matched"),
    ".flag-A + .is-F": ("orders WHERE false", "runtime_matched"),
    ".flag-R > .flag-R": ("li a JOIN li b ON a.id = b.l_orderkey WHERE false", "matched"),
    "line": None,
    "order > line": None,
}


@query("a6_buckets", FOREST + " UNION ALL ".join(f"SELECT '{t}' AS selector, {'CAST(2 AS BIGINT)' if t == 'line' else 'CAST(1 AS BIGINT)'} AS n, " + ("'skipped'" if d is None else f"CASE WHEN (SELECT count(*) FROM {d[0]}) > 0 THEN '{d[1]}' ELSE 'unmatched' END") + " AS bucket" for t, d in BUCKETS.items()))
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forest(spark, sf_dir, keep=True)
    sel = selector_table(spark, list(BUCKETS))
    # a selector that is read twice counts once, unless it is skipped
    twice = sel.where(F.col("selector").isin(".flag-R", "line")).withColumn("sel_id", F.col("sel_id") + 100)
    sel = sel.unionByName(twice)
    classes = spark.createDataFrame([(r["sel_id"], c) for r in sel.select("sel_id", "selector").collect() for c in all_classes(r["selector"])], "sel_id long, class string")  # the selectors above
    report, _ = coverage(sel, classes, contexts_of(found), nodes_of(found), script_evidence(_order_scripts(spark, sf_dir)), depth=8)
    return report.groupBy("selector", "bucket").agg(F.count(F.lit(1)).alias("n"))


EXCLUSIVE = [".prio-1-urgent.waiting", ".prio-none.waiting", ".prio-2-high.status-O", ".prio-1-urgent.prio-2-high"]


@query("p12_exclusive_violation", FOREST + " UNION ALL ".join(f"""SELECT '{t}' AS selector, count(*) AS n FROM (
  SELECT ['status-' || o_orderstatus] AS always, [['prio-' || lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g'))], ['prio-none', 'waiting']] AS options, {t.strip('.').split('.')} AS wanted FROM o)
  WHERE len(list_filter(options, lambda x: list_has_all(list_concat(always, x), wanted))) > 0""" for t in EXCLUSIVE))
def exclusive_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forest(spark, sf_dir, keep=True)
    sel = selector_table(spark, EXCLUSIVE)
    results = key_results(match_keys(sel, contexts_of(found), nodes_of(found), depth=8)).groupBy("sel_id").agg(F.count(F.lit(1)).alias("n"))
    return sel.join(results, "sel_id", "left").select("selector", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("a2_class_postings", f"""{FOREST}
SELECT class, count(*) AS n FROM (
  SELECT 'flag-' || l_returnflag AS class FROM li UNION ALL SELECT 'line-' || l_linestatus FROM li
  UNION ALL SELECT 'status-' || o_orderstatus FROM o UNION ALL SELECT 'prio-none' FROM o UNION ALL SELECT 'waiting' FROM o
  UNION ALL SELECT 'prio-' || lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g')) FROM o
  UNION ALL SELECT 'seg-' || c_mktsegment FROM c UNION ALL SELECT 'overdrawn' FROM c WHERE c_acctbal < 0
  UNION ALL SELECT 'of-' || n_name FROM nation UNION ALL SELECT 'in-' || r_name FROM region) GROUP BY class""")
def posting_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_postings(nodes_of(forest(spark, sf_dir))).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("w2_previous_sibling", f"""{FOREST}
SELECT tag, count(prev) AS n_prev, CAST(sum(prev % 1000003) AS BIGINT) AS checksum FROM (
  SELECT 'line' AS tag, lag(id) OVER (PARTITION BY l_orderkey ORDER BY place) AS prev FROM li
  UNION ALL SELECT 'order', lag(4000000000000000 + o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) FROM o
  UNION ALL SELECT 'customer', lag(3000000000000000 + c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) FROM c) GROUP BY tag""")
def previous_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forest(spark, sf_dir).where("tag IN ('line', 'order', 'customer')")
    return rows.groupBy("tag").agg(F.count("prev_sibling_id").alias("n_prev"), F.sum(F.col("prev_sibling_id") % 1_000_003).cast("long").alias("checksum"))


@query("j4_ancestor_closure", f"""{FOREST}
SELECT rank, count(*) AS n FROM (
  SELECT unnest(generate_series(0, 3)) AS rank FROM li UNION ALL SELECT unnest(generate_series(0, 2)) FROM o
  UNION ALL SELECT unnest(generate_series(0, 1)) FROM c UNION ALL SELECT 0 FROM nation) GROUP BY rank""")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forest(spark, sf_dir, keep=True)
    return ancestors(contexts_of(found), depth=8).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


@query("p14_concrete_classes", f"""{FOREST}
SELECT 4000000000000000 + o_orderkey AS node_id, 'status-' || o_orderstatus || ' prio-' || lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g')) || ' prio-none waiting' AS classes FROM o""")
def order_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes_of(forest(spark, sf_dir)).where("tag = 'order'").select("node_id", F.array_join(concrete_classes(F.col("facts")), " ").alias("classes"))


@query("p15_node_label", f"{FOREST} SELECT id AS node_id, 'line.flag-' || l_returnflag || '.line-' || l_linestatus AS label FROM li")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes_of(forest(spark, sf_dir)).where("tag = 'line'").select("node_id", node_label(F.col("tag"), F.col("raw"), F.col("facts")).alias("label"))


@query("p16_first_dynamic", f"{FOREST} SELECT CASE WHEN l_quantity > 45 THEN 'large' ELSE '<unknown>' END AS expr, count(*) AS n FROM li GROUP BY 1")
def open_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes_of(forest(spark, sf_dir)).where("tag = 'line'").select(first_dynamic(F.col("facts")).alias("d"))
    return rows.groupBy(F.col("d.expr").alias("expr")).agg(F.count(F.lit(1)).alias("n"))


@query("p11_containment", f"""{FOREST}
SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'static'
            WHEN (l_returnflag = 'R' OR l_linestatus = 'F') AND l_quantity > 45 THEN 'dynamic' ELSE 'none' END AS kind, count(*) AS n FROM li GROUP BY 1""")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes_of(forest(spark, sf_dir)).where("tag = 'line'").select(F.coalesce(holds_classes(F.col("facts"), strings("flag-R", "line-F")), F.lit("none")).alias("kind"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("p12_group_violation", f"""{FOREST}
SELECT o_orderpriority LIKE '1-%' AS touched, count(*) AS n FROM o GROUP BY 1""")
def group_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes_of(forest(spark, sf_dir)).where("tag = 'order'")
    both = violates_group(F.col("facts"), strings("prio-1-urgent", "prio-none"))
    return rows.select(both.alias("touched")).groupBy("touched").agg(F.count(F.lit(1)).alias("n"))


@query("a4_widest_node", f"""{FOREST}
SELECT CAST(max(n) AS INTEGER) AS widest, CAST(max(n) FILTER (line) AS INTEGER) AS widest_line FROM (
  SELECT true AS line, len(list_distinct(['flag-' || l_returnflag, 'line-' || l_linestatus])) AS n FROM li
  UNION ALL SELECT false, len(list_distinct(['status-' || o_orderstatus, 'prio-' || o_orderpriority, 'prio-none', 'waiting'])) FROM o
  UNION ALL SELECT false, 1 + CAST(c_acctbal < 0 AS INTEGER) FROM c)""")
def widest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes_of(forest(spark, sf_dir)).select("tag", F.size(concrete_classes(F.col("facts"))).alias("n"))
    return rows.agg(F.max("n").alias("widest"), F.max(F.when(F.col("tag") == "line", F.col("n"))).alias("widest_line"))


# --- markup of pages ------------------------------------------------------------------------------

#: Tags of pages without comments, in DuckDB.
PAGE_TAGS = r"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '</?[A-Za-z][A-Za-z0-9_.-]*')) AS t FROM pages),
tags AS (SELECT page_id, starts_with(t, '</') AS closes, regexp_replace(t, '^</?', '') AS tag FROM t)
"""


@query("s13_markup_tokens", f"""{PAGE_TAGS}
SELECT tag, CASE WHEN closes THEN 'close' WHEN tag IN ({", ".join(f"'{v}'" for v in sorted(VOID))}) THEN 'self' ELSE 'open' END AS kind, count(*) AS n, count(DISTINCT page_id) AS pages FROM tags GROUP BY 1, 2""")
def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(table(spark, sf_dir, "pages"), "page_id", "html").where("tag <> ''").groupBy("tag", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


@query("s14_attributes", r"""SELECT name, count(*) AS n, count(DISTINCT value) AS n_values FROM (
  SELECT a[1:strpos(a, '=') - 1] AS name, a[strpos(a, '=') + 2:length(a) - 1] AS value FROM (
    SELECT unnest(regexp_extract_all(html, '[a-z]+="[^"]*"')) AS a FROM (SELECT regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script>.*?</script>', '', 'gs') AS html FROM pages)))
GROUP BY name""")
def page_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attribute_rows(table(spark, sf_dir, "pages"), "page_id", "html")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))


@query("s15_braced_expressions", "SELECT page_id, len(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '\\{[^{}]*\\}')) AS n FROM pages")
def page_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = token_rows(pages, "page_id", "html").where("tag = ''").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return pages.select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("s16_void_elements", f"""{PAGE_TAGS}
SELECT tag, count(*) AS n FROM tags WHERE NOT closes AND tag IN ({", ".join(f"'{v}'" for v in sorted(VOID))}) GROUP BY tag""")
def page_void(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_rows(table(spark, sf_dir, "pages"), "page_id", "html").where((F.col("kind") == "self") & F.col("tag").isin(*sorted(VOID)))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("g1_markup_tree")
def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = node_rows(table(spark, sf_dir, "pages"), "page_id", "html")
    return rows.groupBy("tag", "depth").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


@query("g1_markup_nodes", f"""{PAGE_TAGS}
SELECT tag, count(*) AS n FROM tags WHERE NOT closes GROUP BY tag""")
def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = node_rows(table(spark, sf_dir, "pages"), "page_id", "html").where("NOT startswith(tag, '__')")
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("p20_class_words", """SELECT page_id, string_agg(w, ' ' ORDER BY i) AS words, count(*) AS n FROM (
  SELECT page_id, unnest(string_split_regex(trim(regexp_replace(html, '[^A-Za-z]+', ' ', 'g')), ' +')) AS w, generate_subscripts(string_split_regex(trim(regexp_replace(html, '[^A-Za-z]+', ' ', 'g')), ' +'), 1) AS i FROM pages) GROUP BY page_id""")
def words_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = class_words(F.regexp_replace("html", "[^A-Za-z]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(words, " ").alias("words"), F.size(words).cast("long").alias("n"))


# --- scripts ----------------------------------------------------------------------------------------


@query("s20_script_literals", r"""WITH s AS (SELECT page_id, generate_subscripts(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1), 1) - 1 AS i, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) AS body FROM pages)
SELECT 'page' || page_id || '-' || i || '.js' AS file, 1 AS line, unnest(regexp_extract_all(body, '"([^"]+)"', 1)) AS literal FROM s""")
def literals_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script_literals(page_scripts(spark, sf_dir))


@query("p17_class_tokens", r"""SELECT token, count(*) AS n FROM (
  SELECT DISTINCT event_id, unnest(regexp_extract_all(props || event_type || '- a[b]', '[A-Za-z_][A-Za-z0-9_-]*(?:\[[^\]\s]+\])?')) AS token FROM events) WHERE NOT ends_with(token, '-') GROUP BY token""")
def tokens_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("props", "event_type", F.lit("- a[b]"))
    return table(spark, sf_dir, "events").select(F.explode(class_tokens(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _order_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for each order that names its status and priority in literals, with a comment that names no class."""
    o = table(spark, sf_dir, "orders")
    body = F.concat(F.lit("// 'hidden'\nadd('is-"), F.col("o_orderstatus"), F.lit("');\nadd(`prio "), F.regexp_replace("o_orderpriority", "[^A-Za-z]+", ""), F.lit(" ${'x' + `y`}`)"))
    return o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".js")).alias("path"), body.alias("content"))


@query("a3_evidence", """SELECT token, count(*) AS n, min(line) AS line FROM (
  SELECT 'is-' || o_orderstatus AS token, 2 AS line FROM orders UNION ALL SELECT 'prio', 3 FROM orders
  UNION ALL SELECT regexp_replace(o_orderpriority, '[^A-Za-z]+', '', 'g'), 3 FROM orders) GROUP BY token""")
def evidence_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = script_evidence(_order_scripts(spark, sf_dir))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))


@query("u1_evidence_union", r"""
WITH s AS (SELECT unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) AS body FROM pages),
lit AS (SELECT unnest(regexp_extract_all(body, '"([^"]+)"', 1)) AS literal FROM s)
SELECT token, count(*) AS n FROM (
  SELECT 'is-' || o_orderstatus AS token FROM orders UNION ALL SELECT 'prio' FROM orders
  UNION ALL SELECT regexp_replace(o_orderpriority, '[^A-Za-z]+', '', 'g') FROM orders
  UNION ALL SELECT unnest(list_distinct(regexp_extract_all(literal, '[A-Za-z_][A-Za-z0-9_-]*'))) FROM lit) GROUP BY token""")
def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = script_evidence(_order_scripts(spark, sf_dir)).unionByName(script_evidence(page_scripts(spark, sf_dir)))
    return evidence_report(both).select("token", F.size("uses").cast("long").alias("n"))


# --- stylesheets ---------------------------------------------------------------------------------------

#: The rules of corpora.part_styles with their lines, in DuckDB.
STYLES = """
WITH p AS (SELECT lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g')) || '.css' AS file, lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '-', 'g')) AS kind, p_size, p_partkey,
                  CAST(2 + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS line FROM part),
first AS (SELECT file, line, '.brand > .size-' || p_size || ':hover' AS selector, '[brand]|>[size-' || p_size || ']' AS shape FROM p),
second AS (SELECT file, line, '.' || kind || ' .k' || p_partkey || ':not(.gone)' AS selector, '[' || kind || ']| [k' || p_partkey || ']!gone' AS shape FROM p),
frames AS (SELECT DISTINCT file, 'from' AS selector, 1 AS line FROM p UNION ALL SELECT DISTINCT file, 'to', 2 FROM p)
"""


def _shape() -> Column:
    """Segments as text: the combinator, the classes, the excluded ones."""
    return F.array_join(
        F.transform(
            "segments",
            lambda s: F.concat(F.coalesce(s["combinator"], F.lit("")), F.lit("["), F.array_join(s["classes"], ","), F.lit("]"), F.when(F.size(s["not_classes"]) > 0, F.concat(F.lit("!"), F.array_join(s["not_classes"], ","))).otherwise("")),
        ),
        "|",
    )


@query("s18_selectors", f"""{STYLES}
SELECT file, line, selector, shape FROM first UNION ALL SELECT file, line, selector, shape FROM second UNION ALL SELECT file, line, selector, NULL FROM frames""")
def selectors_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors(part_styles(spark, sf_dir)).select("file", "line", "selector", _shape().alias("shape"))


@query("p3_selector_split", f"{STYLES} SELECT file, CAST(count(*) AS BIGINT) AS n FROM (SELECT file FROM first UNION ALL SELECT file FROM second UNION ALL SELECT file FROM frames) GROUP BY file")
def split_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors(part_styles(spark, sf_dir)).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("p5_skipped", f"{STYLES} SELECT file, line, selector, 'no class selectors' AS skip_reason FROM frames")
def skipped_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors(part_styles(spark, sf_dir)).where("skip_reason IS NOT NULL").select("file", "line", "selector", "skip_reason")


@query("a9_selector_dedupe", f"{STYLES} SELECT count(*) AS n, count(DISTINCT file) AS files FROM (SELECT file, selector FROM first GROUP BY ALL)")
def distinct_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selectors(part_styles(spark, sf_dir)).where(F.col("selector").startswith(".brand")).dropDuplicates(["file", "selector"])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))


@query("s23_keyframes", """
WITH p AS (SELECT p_brand AS file, p_size FROM part)
SELECT kind, name, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'declared' AS kind, 'spin0' AS name FROM (SELECT DISTINCT file FROM p) UNION ALL SELECT 'declared', 'idle' FROM (SELECT DISTINCT file FROM p)
  UNION ALL SELECT 'reference', 'spin0' FROM p WHERE p_size % 7 = 0) GROUP BY kind, name""")
def keyframes_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyframes(part_styles(spark, sf_dir)).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


@query("a7_unused_keyframes", f"{STYLES} SELECT DISTINCT 'idle' AS name, file, 2 AS line FROM p")
def unused_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unused_keyframes(keyframes(part_styles(spark, sf_dir)))


@query("s21_vendor_classes", f"""{STYLES}
SELECT token, count(*) AS n FROM (SELECT 'brand' AS token FROM p UNION ALL SELECT 'size-' || p_size FROM p UNION ALL SELECT kind FROM p
  UNION ALL SELECT 'k' || p_partkey FROM p UNION ALL SELECT 'gone' FROM p) GROUP BY token""")
def vendor_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendor_evidence(part_styles(spark, sf_dir)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("p1_line_prefilter", """SELECT nation_line, count(*) AS n FROM (
  SELECT CASE n_nationkey % 4 WHEN 0 THEN '/* skipped import */' WHEN 1 THEN '/* skipped directive */' WHEN 2 THEN '@import "./' || n_name || '.css";' ELSE '.' || n_name || ' {}' END AS nation_line FROM nation) GROUP BY 1""")
def prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    kind = F.col("n_nationkey") % 4
    text = F.when(kind == 0, F.lit('@import "tailwindcss";')).when(kind == 1, F.concat(F.lit('  @source "../'), "n_name", F.lit('";'))).when(kind == 2, F.concat(F.lit('@import "./'), "n_name", F.lit('.css";'))).otherwise(F.concat(F.lit("."), "n_name", F.lit(" {}")))
    files = n.groupBy(F.lit("a.css").alias("path")).agg(F.array_join(F.collect_list(text), "\n").alias("content"))
    return prefiltered(files).select(F.explode(F.split("content", "\n")).alias("nation_line")).groupBy("nation_line").agg(F.count(F.lit(1)).alias("n"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors(part_styles(spark, sf_dir)).where(F.col("selector").endswith(":not(.gone)") & (F.regexp_extract("selector", r"\.k(\d+):", 1).cast("long") % 3 == 0))


@query("k6_invalidate", f"{STYLES} SELECT file, line, selector FROM second WHERE CAST(regexp_extract(selector, '\\.k([0-9]+):', 1) AS BIGINT) % 3 = 0")
def invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = invalidated_files(part_styles(spark, sf_dir), _targets(spark, sf_dir))
    return invalidated_selectors(files).select("file", "line", "selector")


@query("k7_restore", f"{STYLES} SELECT file AS path, CAST(count(*) FILTER (p_partkey % 3 = 0) AS BIGINT) AS selectors FROM p GROUP BY file")
def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored_files(invalidated_files(part_styles(spark, sf_dir), _targets(spark, sf_dir))).select("path", F.col("selectors").cast("long").alias("selectors"))


@query("k12_remove", f"""{STYLES}
SELECT file, selector FROM first UNION ALL SELECT file, selector FROM second WHERE CAST(regexp_extract(selector, '\\.k([0-9]+):', 1) AS BIGINT) % 3 <> 0 UNION ALL SELECT file, selector FROM frames""")
def removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors(removed_files(part_styles(spark, sf_dir), _targets(spark, sf_dir))).select("file", "selector")


@query("k10_remove_keyframes", "WITH p AS (SELECT DISTINCT p_brand FROM part) SELECT 'spin0' AS name, CAST(count(*) AS BIGINT) AS n FROM p")
def frames_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = part_styles(spark, sf_dir)
    left = keyframes(keyframes_removed(files, unused_keyframes(keyframes(files))))
    return left.where("kind = 'declared'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# --- reports ----------------------------------------------------------------------------------------------


@query("g12_chains", f"""{FOREST}
SELECT id AS ctx_id, r_name || ' → region.in-' || r_name || ' → nation.of-' || n_name || ' → customer.seg-' || c_mktsegment
  || CASE WHEN c_acctbal < 0 THEN '.overdrawn' ELSE '' END || ' → order.status-' || o_orderstatus || '.prio-' || lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g'))
  || '.prio-none.waiting → line.flag-' || l_returnflag || '.line-' || l_linestatus AS chain
FROM li JOIN region ON li.n_regionkey = r_regionkey JOIN nation ON n_nationkey = c_nationkey JOIN (SELECT c_custkey AS ck, c_acctbal FROM c) ON ck = o_custkey WHERE l_quantity > 45""")
def chains_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forest(spark, sf_dir, keep=True)
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("entry_ord"), F.col("r_name").alias("entry_name"))
    ctx = contexts_of(found).join(names, "entry_ord")
    keys = found.where("tag = 'line' AND size(facts.dynamic) > 0").select("ctx_id")
    return chains(keys, ctx, nodes_of(found), depth=8).select("ctx_id", "chain")


@query("a8_first_of_each", f"""{FOREST}
SELECT c_mktsegment AS entry_module, o_orderstatus AS entry_name, min(4000000000000000 + o_orderkey) AS key_ctx FROM o GROUP BY 1, 2""")
def first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.lit(0).alias("sel_id"), F.col("c_mktsegment").alias("entry_module"), F.col("o_orderstatus").alias("entry_name"), F.lit("x").alias("chain"), (F.lit(4 * 10**15) + F.col("o_orderkey")).alias("key_ctx"))
    return first_of_each(rows).select("entry_module", "entry_name", "key_ctx")


#: The rules of STYLES with the classes that part_nodes knows of each.
KNOWN = f"""{STYLES},
big AS (SELECT * FROM p WHERE p_size > 25),
told AS (
  SELECT file, selector, 'brand' AS class, true AS known FROM first
  UNION ALL SELECT file, selector, 'size-' || p_size, p_size IN (SELECT p_size FROM big) FROM (SELECT DISTINCT file, p_size, '.brand > .size-' || p_size || ':hover' AS selector FROM p)
  UNION ALL SELECT p.file, selector, kind, kind IN (SELECT kind FROM big) FROM p JOIN second USING (file, line)
  UNION ALL SELECT p.file, selector, 'k' || p_partkey, p_size > 25 FROM p JOIN second USING (file, line)),
notes AS (SELECT file, selector, list_sort(list_distinct(list(class) FILTER (known))) AS found, list_sort(list_distinct(list(class) FILTER (NOT known))) AS missing FROM told GROUP BY ALL)
"""


def _part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each part above a size, with the classes of its rules."""
    part = table(spark, sf_dir, "part").where("p_size > 25")
    kind = F.lower(F.regexp_replace("p_type", "[^A-Za-z0-9]+", "-"))
    found = facts(F.array(F.lit("brand"), F.concat(F.lit("size-"), F.col("p_size").cast("string")), kind, F.concat(F.lit("k"), F.col("p_partkey").cast("string"))))
    return part.select(F.col("p_partkey").cast("string").alias("node_id"), F.lit("i").alias("tag"), F.lit(False).alias("repeat"), F.lit(False).alias("raw"), found.alias("facts"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selectors(part_styles(spark, sf_dir)).where("segments IS NOT NULL").dropDuplicates(["file", "selector"])
    found = materialized(found.withColumn("sel_id", F.xxhash64("file", "selector")))
    return diagnostics(found, selector_classes_of(found), class_postings(_part_nodes(spark, sf_dir))).join(found.select("sel_id", "file", "selector"), "sel_id")


@query("j11_unmatched", f"{KNOWN} SELECT DISTINCT file, selector FROM told WHERE NOT known")
def unmatched_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selectors(part_styles(spark, sf_dir)).where("segments IS NOT NULL").dropDuplicates(["file", "selector"]).withColumn("sel_id", F.xxhash64("file", "selector"))
    known = class_postings(_part_nodes(spark, sf_dir)).select("class").distinct()
    missing = selector_classes_of(found).join(known, "class", "left_anti").select("sel_id").distinct()
    return found.join(missing, "sel_id", "left_semi").select("file", "selector")


@query("a16_diagnostics", f"""{KNOWN}
SELECT CASE WHEN found IS NULL THEN 'no class is in the graph' WHEN missing IS NOT NULL THEN 'some classes are not in the graph'
            ELSE 'all classes are in the graph, not in this structure' END AS note, count(*) AS n FROM notes GROUP BY 1""")
def notes_of_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).groupBy("note").agg(F.count(F.lit(1)).alias("n"))


@query("o4_sorted_classes", f"{KNOWN} SELECT file, selector, coalesce(array_to_string(found, ','), '') AS found, coalesce(array_to_string(missing, ','), '') AS missing FROM notes")
def sorted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("file", "selector", F.array_join("found", ",").alias("found"), F.array_join("missing", ",").alias("missing"))


@query("j10_evidence_join", """SELECT 'is-' || x AS class, CASE WHEN x IN (SELECT o_orderstatus FROM orders) THEN 'runtime_matched' ELSE 'unmatched' END AS bucket
FROM (SELECT o_orderstatus AS x FROM orders UNION SELECT l_returnflag FROM lineitem)""")
def evidence_of_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("x")).union(table(spark, sf_dir, "lineitem").select("l_returnflag")).distinct()
    wanted = flags.select(F.xxhash64("x").alias("sel_id"), F.concat(F.lit("is-"), "x").alias("class"))
    segment = F.struct(F.array("class").alias("classes"), F.array().cast("array<string>").alias("not_classes"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("combinator"), F.lit(False).alias("wildcard"))
    none = wanted.select("sel_id", F.lit("match").alias("result")).limit(0)
    found = buckets(wanted.select("sel_id", F.array(segment).alias("segments")), none, wanted.withColumn("in_graph", F.lit(False)), script_evidence(_order_scripts(spark, sf_dir)))
    return found.join(wanted, "sel_id").select("class", "bucket")


@query("o2_evidence_order", """SELECT token, arg_min(file, file) AS first_file, arg_max(file, file) AS last_file FROM (
  SELECT 'is-' || o_orderstatus AS token, 'o' || o_orderkey || '.js' AS file FROM orders UNION ALL SELECT 'prio', 'o' || o_orderkey || '.js' FROM orders
  UNION ALL SELECT regexp_replace(o_orderpriority, '[^A-Za-z]+', '', 'g'), 'o' || o_orderkey || '.js' FROM orders) GROUP BY token""")
def evidence_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence_report(script_evidence(_order_scripts(spark, sf_dir)))
    return rows.select("token", F.element_at("uses", 1)["file"].alias("first_file"), F.element_at("uses", -1)["file"].alias("last_file"))


@query("s19_script_files", "SELECT CASE s_nationkey % 4 WHEN 0 THEN 'assets/js/' WHEN 1 THEN 'assets/vendor/' WHEN 2 THEN 'assets/node_modules/x/' ELSE 'lib/' END || 's' || s_suppkey || CASE s_nationkey % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.mjs' ELSE '.ts' END AS path FROM supplier WHERE s_nationkey % 4 <> 2 AND s_nationkey % 3 <> 2")
def files_of_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("s_nationkey")
    folder = F.when(nation % 4 == 0, "assets/js/").when(nation % 4 == 1, "assets/vendor/").when(nation % 4 == 2, "assets/node_modules/x/").otherwise("lib/")
    end = F.when(nation % 3 == 0, ".js").when(nation % 3 == 1, ".mjs").otherwise(".ts")
    return script_files(table(spark, sf_dir, "supplier").select(F.concat(folder, F.lit("s"), F.col("s_suppkey").cast("string"), end).alias("path"))).select("path")


@query("p13_dynamic_option", f"""{FOREST}
SELECT CASE WHEN o_orderstatus = 'F' THEN 'dynamic' ELSE 'none' END AS kind, o_orderstatus = 'F' AS open, count(*) AS n FROM o GROUP BY ALL""")
def open_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.when(F.col("o_orderstatus") == "F", F.array(dyn("variable", "late"))).otherwise(F.array().cast("array<struct<reason:string,expr:string,chain:string>>"))
    found = facts(None, None, F.array(F.array(option(strings("prio-high")), option(strings("prio-none"), some))))
    rows = table(spark, sf_dir, "orders").select(holds_classes(found, strings("prio-none", "late")).alias("kind"), open_option(found, strings("prio-none")).alias("open"))
    return rows.groupBy(F.coalesce("kind", F.lit("none")).alias("kind"), "open").agg(F.count(F.lit(1)).alias("n"))


@query("o3_in_order", f"""{STYLES} SELECT file, line, count(*) AS n FROM (SELECT file, line FROM first UNION ALL SELECT file, line FROM second) GROUP BY ALL""")
def ordered_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selectors(part_styles(spark, sf_dir)).where("segments IS NOT NULL").groupBy("file", "line").agg(F.count(F.lit(1)).alias("n"))
    return in_order(rows)


@query("k8_invalidate_keyframes", "SELECT 'idle' AS name, count(DISTINCT p_brand) AS n FROM part")
def frames_invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = part_styles(spark, sf_dir)
    out = keyframes(keyframes_invalidated(files, unused_keyframes(keyframes(files))))
    return out.where("kind = 'invalidated'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("k9_restore_keyframes", "SELECT lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g')) || '.css' AS path, CAST(1 AS BIGINT) AS keyframes FROM part GROUP BY ALL")
def frames_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = part_styles(spark, sf_dir)
    return restored_files(keyframes_invalidated(files, unused_keyframes(keyframes(files)))).select("path", F.col("keyframes").cast("long").alias("keyframes"))


# --- template modules -------------------------------------------------------------------------------------

#: Customers with the module that corpora.app_modules puts them in.
MODULES = """
WITH f AS (SELECT 'ShopWeb.' || regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g') AS module, c_custkey, 'c' || c_custkey AS name, lower(c_mktsegment) AS seg,
                  lead(c_custkey) OVER (PARTITION BY n_name ORDER BY c_custkey) AS next FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


@query("s4_modules", f"""{MODULES}
SELECT DISTINCT module, 'ShopWeb' AS uses, 'ShopWeb.Core' AS imports, 'Ui=ShopWeb.Kit' AS aliases FROM f UNION ALL VALUES ('ShopWeb.Core', '', '', ''), ('ShopWeb.Kit', '', '', '')""")
def scanned_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = modules(app_modules(spark, sf_dir))
    told = F.array_join(F.transform(F.map_entries("aliases"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select("module", F.array_join("uses", ",").alias("uses"), F.array_join("imports", ",").alias("imports"), told.alias("aliases"))


@query("s6_functions", f"{MODULES} SELECT module, name, 1 AS arity, CAST(1 AS BIGINT) AS n_clauses, CAST(1 AS BIGINT) AS n_heex FROM f UNION ALL VALUES ('ShopWeb.Core', 'tone', 1, 2, 0), ('ShopWeb.Kit', 'button', 1, 1, 1)")
def scanned_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions_of(clauses(app_modules(spark, sf_dir))).select("module", "name", "arity", "n_clauses", "n_heex")


@query("s8_sigils", f"{MODULES} SELECT count(*) + 1 AS n, count(next) AS n_calls FROM f")
def scanned_sigils(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clauses(app_modules(spark, sf_dir)).where("heex IS NOT NULL")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("heex").contains("<.c"), 1)).alias("n_calls"))


@query("j12_local_lookup", f"{MODULES} SELECT module AS caller, 'c' || next AS name, module, 1 AS arity FROM f WHERE next IS NOT NULL UNION ALL SELECT DISTINCT module, 'tone', 'ShopWeb.Core', 1 FROM f")
def local_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = app_modules(spark, sf_dir)
    found = clauses(files)
    own = found.where("heex IS NOT NULL AND name <> 'button'").select(F.col("module").alias("caller"), F.explode(F.regexp_extract_all("heex", F.lit(r"<\.(c\d+|nobody)"), F.lit(1))).alias("name"))
    tones = found.where("name <> 'button' AND name <> 'tone'").select(F.col("module").alias("caller"), F.lit("tone").alias("name"))
    return local_lookup(own.unionByName(tones), modules(files), functions_of(found))


@query("j13_remote_lookup", f"{MODULES} SELECT DISTINCT module AS caller, 'Ui' AS target, 'button' AS name, 'ShopWeb.Kit' AS module, 1 AS arity FROM f UNION ALL SELECT DISTINCT module, 'Kit', 'button', 'ShopWeb.Kit', 1 FROM f")
def remote_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = app_modules(spark, sf_dir)
    found = modules(files)
    calls = found.where("module NOT IN ('ShopWeb.Core', 'ShopWeb.Kit')").select(F.col("module").alias("caller"), F.explode(F.array(F.lit("Ui"), F.lit("Kit"), F.lit("No"))).alias("target"), F.lit("button").alias("name"))
    return remote_lookup(calls, found, functions_of(clauses(files)))


@query("g3_trees", f"""{MODULES}
SELECT 'fn:' || module || ':' || name || ':1:0' AS ref, 'seg-' || seg AS static, 'open,warm' AS optional, CASE WHEN next IS NULL THEN '' ELSE 'fn:' || module || ':c' || next || ':1:0' END AS calls FROM f
UNION ALL VALUES ('fn:ShopWeb.Kit:button:1:0', 'btn', '', '')""")
def resolved_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph_trees(app_modules(spark, sf_dir))
    root = F.from_json("tree", "array<struct<classes:struct<static:array<string>,optional:array<string>>,children:array<struct<component_refs:array<string>>>>>")[0]
    own = F.filter(F.flatten(F.transform(F.filter(root["children"], lambda c: c["component_refs"].isNotNull()), lambda c: c["component_refs"])), lambda r: ~r.contains(":button:"))
    return rows.select("ref", F.array_join(root["classes"]["static"], ",").alias("static"), F.array_join(root["classes"]["optional"], ",").alias("optional"), F.array_join(own, ",").alias("calls"))


@query("g13_unresolved", f"{MODULES} SELECT '.nobody' AS tag, 'unresolved' AS reason, count(*) AS n FROM f")
def unresolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph_trees(app_modules(spark, sf_dir)).select(F.explode(F.from_json("unresolved", "array<struct<tag:string,reason:string>>")).alias("u"))
    return rows.groupBy(F.col("u.tag").alias("tag"), F.col("u.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


from . import component_queries  # noqa: E402,F401  registers the others


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
