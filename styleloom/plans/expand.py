"""Expansion of a component graph into rendered contexts, as one recursive query.

``items(list_key, ord, kind, val, next_list, ref)`` are the children of every list: of a tree (``t:<ref>``), of a
node (``n:<node_id>``), of a slot that a call fills (``s:<edge>:<slot>``). Kinds: E element, R raw markup, C call
(one row for each clause of the callee, ``ref`` its tree, ``val`` the edge), S slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .persist import materialized

#: Levels of nesting that the recursion may reach, and rows that it may make.
MAX_DEPTH, MAX_CONTEXTS = 400, 250_000
#: Spark's own limit of the rows of a recursion, which the ceiling of contexts replaces.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"

_EXPAND = """
WITH RECURSIVE r(entry_ord, entry_ref, kind, val, lk, env, cs, pp, sp) MAX RECURSION LEVEL {depth} AS (
  SELECT entry_ord, ref, 'I', CAST(NULL AS STRING), concat('t:', ref), CAST(array() AS ARRAY<STRING>), array(ref),
         CAST(array() AS ARRAY<INT>), CAST(array() AS ARRAY<INT>)
  FROM {entries}
  UNION ALL
  SELECT r.entry_ord, r.entry_ref, i.kind, i.val,
         CASE i.kind WHEN 'S' THEN concat('s:', coalesce(get(r.env, size(r.env) - 1), ''), ':', i.val) ELSE i.next_list END,
         CASE i.kind WHEN 'C' THEN array_append(r.env, i.val)
                     WHEN 'S' THEN slice(r.env, 1, greatest(size(r.env) - 1, 0)) ELSE r.env END,
         CASE i.kind WHEN 'C' THEN array_append(r.cs, i.ref) ELSE r.cs END,
         CASE WHEN r.kind IN ('E', 'R') THEN r.sp ELSE r.pp END,
         concat(r.sp, i.ord)
  FROM r JOIN {items} i ON i.list_key = r.lk
  WHERE i.kind <> 'C' OR NOT array_contains(r.cs, i.ref))
SELECT * FROM r
"""


def reached(entries: DataFrame, items: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Every step of the expansion: elements, raw markup, calls and slots, with its call stack and paths.

    The lexical scope of slots is a stack of calls: entering a call pushes it, a slot goes on with the list
    of the call on top and pops it. A call whose tree is on the call stack isn't entered.
    """
    spark = entries.sparkSession
    if spark.conf.get(ROW_LIMIT, None) is None:
        spark.conf.set(ROW_LIMIT, "-1")
    names = {n: f"__{n}_{uuid.uuid4().hex}" for n in ("entries", "items")}
    entries.createOrReplaceTempView(names["entries"])
    items.createOrReplaceTempView(names["items"])
    return spark.sql(_EXPAND.format(depth=depth, **names))


def contexts(entries: DataFrame, items: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Rendered contexts in document order.

    ``ctx_id`` counts from 0 in preorder over the entries in their order; ``prev_sibling_id`` is the context
    before it under the same rendered parent, across calls and slots; ``definition_ref`` the tree that
    holds the node. Contexts are numbered within their entries; only the counts of entries meet in one task.
    """
    found = materialized(reached(entries, items, depth).where("kind IN ('E', 'R')"))
    earlier = Window.orderBy("entry_ord").rowsBetween(Window.unboundedPreceding, -1)
    before = found.groupBy("entry_ord").agg(F.count(F.lit(1)).alias("n")).select("entry_ord", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rows = found.join(before, "entry_ord").join(entries.select("entry_ord", "module", "source_file", "name"), "entry_ord")
    rows = rows.withColumn("ctx_id", F.col("before") + F.row_number().over(Window.partitionBy("entry_ord").orderBy("sp")).cast("long") - 1)
    family = Window.partitionBy("entry_ord", "pp").orderBy("sp")
    rows = rows.withColumn("prev_sibling_id", F.lag("ctx_id").over(family))
    parents = rows.select("entry_ord", F.col("sp").alias("pp"), F.col("ctx_id").alias("parent_id"))
    return rows.join(parents, ["entry_ord", "pp"], "left").select(
        "ctx_id", "entry_ord", "entry_ref", F.col("module").alias("entry_module"), F.col("name").alias("entry_name"), "source_file",
        F.element_at("cs", -1).alias("definition_ref"), F.col("val").alias("node_id"), F.col("cs").alias("call_stack"),
        "parent_id", "prev_sibling_id", F.array_join(F.col("pp").cast("array<string>"), "/").alias("parent_key"),
        F.col("ctx_id").alias("sibling"), F.col("pp").alias("parent_path"), F.col("sp").alias("sort_path"),
    )


def cycles(entries: DataFrame, items: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """``(path, callsite_edge)``, the tree references from the entry to the one met again: calls that were not entered since their tree was already open, once for each path."""
    steps = reached(entries, items, depth)
    calls = items.where("kind = 'C'").select("list_key", "val", "ref")
    met = steps.join(calls.withColumnRenamed("val", "edge").withColumnRenamed("ref", "to"), F.col("lk") == F.col("list_key"))
    met = met.where(F.array_contains("cs", F.col("to")))
    return met.select(F.array_append("cs", F.col("to")).alias("path"), F.col("edge").alias("callsite_edge")).groupBy("path").agg(F.min("callsite_edge").alias("callsite_edge"))


def missing_refs(entries: DataFrame, items: DataFrame, trees: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """``(ref, path)``: trees that entries or entered calls ask for and that are not there."""
    steps = reached(entries, items, depth).where("kind IN ('C', 'I')")
    wanted = steps.select(F.element_at("cs", -1).alias("ref"), F.col("cs").alias("path")).distinct()
    return wanted.join(trees.select("ref").distinct(), "ref", "left_anti")


def check_limit(found: DataFrame, limit: int = MAX_CONTEXTS) -> DataFrame:
    """The same contexts, or an error when there are more than ``limit``."""
    n = found.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"Context limit exceeded: more than {limit} rendered contexts")
    return found
