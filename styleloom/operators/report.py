"""From key results to the report: provenance, repeated matches, diagnostics, the summary."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.facts import concrete_classes, first_dynamic, node_label
from ..sources.scripts import evidence_report
from .match import buckets, class_postings, key_results, match_keys, with_paths

ARROW = " → "


def chains(keys: DataFrame, contexts: DataFrame, nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """``(ctx_id, path, chain)`` of the contexts in ``keys(ctx_id)``: labels from the root down, with the entry's name before them."""
    placed = with_paths(contexts, depth).join(keys.select("ctx_id").distinct(), "ctx_id")
    up = placed.select("ctx_id", F.posexplode(F.reverse(F.concat("path", F.array("ctx_id")))).alias("up", "rel_id"))
    labels = contexts.select(F.col("ctx_id").alias("rel_id"), "node_id", "entry_name").join(nodes.select("node_id", node_label(F.col("tag"), F.col("raw"), F.col("facts")).alias("label")), "node_id")
    rows = up.join(labels, "rel_id").groupBy("ctx_id").agg(F.sort_array(F.collect_list(F.struct("up", "label")), asc=False).alias("p"), F.first("entry_name").alias("entry_name"))
    path = F.transform("p", lambda x: x["label"])
    return rows.select("ctx_id", path.alias("path"), F.concat_ws(ARROW, F.concat(F.array("entry_name"), path)).alias("chain"))


def first_of_each(matches: DataFrame) -> DataFrame:
    """Matches of one selector that agree in module, entry and chain count once: the first in document order."""
    others = [c for c in matches.columns if c not in ("sel_id", "entry_module", "entry_name", "chain")]
    least = F.min(F.struct("key_ctx", *[c for c in others if c != "key_ctx"])).alias("m")
    return matches.groupBy("sel_id", "entry_module", "entry_name", "chain").agg(least).select("sel_id", "entry_module", "entry_name", "chain", "m.*")


def match_details(selectors: DataFrame, results: DataFrame, contexts: DataFrame, nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """Every match and dynamic candidate with its entry, chain, and for a candidate the fact that leaves it open."""
    rows = results.join(contexts.select(F.col("ctx_id").alias("key_ctx"), "entry_ref", "entry_module", "entry_name", "definition_ref", "call_stack", "node_id"), "key_ctx")
    rows = rows.join(chains(results.select(F.col("key_ctx").alias("ctx_id")), contexts, nodes, depth).withColumnRenamed("ctx_id", "key_ctx"), "key_ctx")
    open_node = F.when(F.col("key_kind") == "dynamic", F.col("node_id")).otherwise(F.coalesce("dyn_node", "node_id"))
    facts = nodes.select(F.col("node_id").alias("open_node"), first_dynamic(F.col("facts")).alias("dynamic"))
    rows = rows.withColumn("open_node", F.when(F.col("result") == "dynamic", open_node)).join(facts, "open_node", "left")
    lasts = selectors.select("sel_id", F.size("segments").alias("n"), F.element_at("segments", -1).alias("last"))
    rows = rows.join(lasts, "sel_id").join(nodes.select("node_id", concrete_classes(F.col("facts")).alias("known")), "node_id")
    missing = F.when(F.col("n") == 1, F.array_join(F.array_except("last.classes", "known"), ", ")).otherwise(F.lit("element classes"))
    rows = rows.withColumn("unresolved_part", F.when(F.col("result") == "dynamic", missing)).drop("n", "last", "known", "open_node", "node_id", "dyn_node")
    return first_of_each(rows)


def diagnostics(unmatched: DataFrame, segment_classes: DataFrame, postings: DataFrame) -> DataFrame:
    """``(sel_id, found, missing, note)``: which classes of a selector the graph has, and what that says."""
    known = postings.select("class").distinct().withColumn("known", F.lit(True))
    rows = unmatched.select("sel_id", F.size("segments").alias("n")).join(segment_classes, "sel_id", "left").join(known, "class", "left")
    rows = rows.groupBy("sel_id", "n").agg(
        F.array_sort(F.collect_set(F.when(F.col("known"), F.col("class")))).alias("found"),
        F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("class")))).alias("missing"),
    )
    f, m = F.size("found"), F.size("missing")
    note = (
        F.when((m > 0) & (f == 0), "no class is in the graph")
        .when(m > 0, "some classes are not in the graph")
        .when(F.col("n") > 1, "all classes are in the graph, not in this structure")
        .when(f > 1, "all classes are in the graph, not on one element")
    )
    return rows.select("sel_id", "found", "missing", note.alias("note"))


def selector_classes_of(selectors: DataFrame) -> DataFrame:
    """``(sel_id, class)`` of the classes in the segments."""
    return selectors.select("sel_id", F.explode(F.flatten(F.transform("segments", lambda s: s["classes"]))).alias("class")).distinct()


def coverage(selectors: DataFrame, text_classes: DataFrame, contexts: DataFrame, nodes: DataFrame, evidence: DataFrame, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(sel_id, selector, file, line, bucket, skip_reason)`` and the key results.

    Selectors that agree in text, file and line count once unless they are skipped. ``text_classes(sel_id,
    class)`` are all classes of a selector's text.
    """
    ok = F.col("segments").isNotNull() & (F.size("segments") > 0)
    once = selectors.where(ok).groupBy("selector", "file", "line").agg(F.min("sel_id").alias("sel_id")).select("sel_id")
    kept = selectors.where(~F.coalesce(ok, F.lit(False))).unionByName(selectors.join(once, "sel_id", "left_semi"))
    results = key_results(match_keys(kept.where(ok).select("sel_id", "segments"), contexts, nodes, depth))
    known = class_postings(nodes).select("class").distinct().withColumn("k", F.lit(True))
    classes = text_classes.join(known, "class", "left").select("sel_id", "class", F.coalesce("k", F.lit(False)).alias("in_graph"))
    out = kept.join(buckets(kept, results, classes, evidence), "sel_id")
    reason = F.when(F.col("bucket") == "skipped", F.coalesce("skip_reason", F.lit("no class selectors")))
    return out.select("sel_id", "selector", "file", "line", "bucket", reason.alias("skip_reason")), results


def summary(report: DataFrame) -> DataFrame:
    """``(bucket, n)``."""
    return report.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of a report in the order of file and line; null comes first."""
    return rows.orderBy(F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)))


#: The counters that ``--stats`` prints, by their keys in the report.
COUNTERS = {
    "entries": "entries", "tree_refs": "tree refs", "canonical_nodes": "canonical nodes", "contexts": "contexts", "class_index_keys": "class index keys",
    "selector_count": "selectors", "max_classes_per_node": "max classes per node", "max_call_stack_depth": "max call stack depth",
    "cycles": "cycles", "unresolved_refs": "unresolved refs", "runtime_matched_selector_count": "runtime matched selectors",
}
_RENAMED = {"trees": "tree_refs", "classes": "class_index_keys", "widest_node": "max_classes_per_node", "deepest_call": "max_call_stack_depth"}


def report_json(report: DataFrame, evidence: DataFrame, frames: DataFrame, unused: DataFrame, invalidated: DataFrame, cycles: DataFrame, missing: DataFrame, stats: DataFrame, limit: int = 1_000_000) -> str:
    """The report as one JSON object, for a corpus whose selectors the driver can hold (``limit`` rows, else an error)."""

    def rows(df: DataFrame) -> list[dict]:
        got = [json.loads(x) for x in df.limit(limit + 1).toJSON().collect()]
        if len(got) > limit:
            raise ValueError(f"the report has over {limit} rows; write its tables instead")
        return got

    found = rows(in_order(report))
    names = ("matched", "runtime_matched", "possibly_dynamic", "unmatched", "skipped")
    of = {n: [r for r in found if r["bucket"] == n] for n in names}
    out = {
        "matched": len(of["matched"]), "matched_selectors": of["matched"],
        "runtime_matched": len(of["runtime_matched"]), "runtime_matched_selectors": of["runtime_matched"],
        "runtime_evidence": rows(evidence_report(evidence).orderBy("token")),
        "possibly_dynamic": of["possibly_dynamic"],
        "unmatched": len(of["unmatched"]), "unmatched_selectors": of["unmatched"],
        "skipped": of["skipped"],
        "invalidated_selectors": rows(in_order(invalidated)),
        "unused_keyframes": rows(unused.orderBy("file", "line")),
        "cycles": rows(cycles.orderBy("path")), "unresolved_refs": rows(missing.orderBy("ref", "tag", "from")),
    }
    counted = {_RENAMED.get(k, k): v for k, v in (rows(stats) or [{}])[0].items()}
    counted |= {"selector_count": len(found), "cycles": len(out["cycles"]), "unresolved_refs": len(out["unresolved_refs"]), "runtime_matched_selector_count": len(of["runtime_matched"])}
    out["analysis_stats"] = counted
    kinds = {r["kind"]: r["n"] for r in frames.groupBy("kind").agg(F.count_distinct("name").alias("n")).collect()}
    out["summary"] = {n: len(of[n]) for n in names} | {k: len(out[k]) for k in ("unused_keyframes", "cycles", "unresolved_refs")}
    out["summary"] |= {"invalidated": len(out["invalidated_selectors"]), "keyframes_total": kinds.get("declared", 0), "keyframes_unused": len(out["unused_keyframes"]), "keyframes_invalidated": kinds.get("invalidated", 0)}
    return json.dumps(out, ensure_ascii=False, indent=2)
