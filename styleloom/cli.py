"""The command line: ``graph`` scans a project's templates, ``coverage`` holds stylesheets against the graph."""

from __future__ import annotations

import argparse
import json
import posixpath
import re
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.match import class_postings, with_paths
from .operators.report import COUNTERS, coverage, diagnostics, in_order, match_details, report_json, selector_classes_of
from .operators.rewrite import invalidated_files, invalidated_selectors, keyframes_invalidated, keyframes_removed, removed_files, restored_files
from .plans.expand import MAX_CONTEXTS, check_limit, contexts, cycles, missing_refs
from .plans.graph import all_cycles, all_unresolved, graph_stats, load_graph
from .plans.persist import materialized
from .plans.resolve import graph_document
from .sources.modules import modules, unreadable
from .sources.scripts import VENDOR_PATH, built_in_evidence, script_evidence, script_files
from .sources.stylesheets import keyframes, selector_classes, selectors, unused_keyframes, vendor_evidence

GRAPH_FILE = "graph.json"


def read_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``(path, content)`` of the files below a folder, with paths from the folder; null where they aren't UTF-8."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = Path(root).resolve().as_posix() if "://" not in root else root
    path = F.regexp_replace("path", f"^(file:)?/*{re.escape(base.lstrip('/'))}/", "")
    return found.select(path.alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"))


def with_imports(spark: SparkSession, root: str, entry: str) -> DataFrame:
    """The entry stylesheet and what it imports, in the order in which they are first named; the driver follows the names."""
    order, todo = [], [entry]
    while todo:
        path = todo.pop(0)
        file = Path(root, path)
        if path in order or not file.exists():
            continue
        order.append(path)
        for name in re.findall(r"""^\s*@import\s+(?:url\()?["']([^"':]+)["']""", file.read_text(encoding="utf-8"), re.M):
            near = posixpath.normpath(posixpath.join(posixpath.dirname(path), name))
            todo.append(near if Path(root, near).exists() else f"node_modules/{name}")
    rows = [(i, p, Path(root, p).read_text(encoding="utf-8")) for i, p in enumerate(order)]
    return spark.createDataFrame(rows, "pos int, path string, content string")


def max_contexts(text: str) -> int:
    if not re.fullmatch("[0-9]+", text) or not 1 <= int(text) <= 2**53 - 1:
        raise argparse.ArgumentTypeError("--max-contexts wants a whole number of 1 or more")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="styleloom")
    p.add_argument("--root", default=".", help="the project")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("graph", help="write the component graph")
    g.add_argument("--output", default="analysis")
    c = sub.add_parser("coverage", help="report which selectors can match")
    c.add_argument("--css", default="assets/css/app.css")
    c.add_argument("--analysis", default="analysis")
    c.add_argument("--output", default="coverage.json")
    c.add_argument("--js", action="append", default=[])
    c.add_argument("--max-contexts", type=max_contexts, default=MAX_CONTEXTS)
    for flag in ("invalidate-unmatched", "restore-unmatched", "remove-unmatched", "list-unmatched", "list-invalidated", "list-runtime", "stats", "include-node-modules-css"):
        c.add_argument(f"--{flag}", action="store_true")
    return p


def run_graph(spark: SparkSession, args: argparse.Namespace) -> int:
    files = read_files(spark, args.root, "*.{ex,heex}").where(F.col("path").rlike(r"^lib/[^/]*_web/"))
    out = Path(args.root, args.output)
    out.mkdir(parents=True, exist_ok=True)
    files = materialized(files)
    for r in unreadable(files, modules(files)).orderBy("path").collect():
        print(f"{r['path']} can't be read as a module", file=sys.stderr)
    g = graph_document(files)
    (out / GRAPH_FILE).write_text(json.dumps(g, ensure_ascii=False, indent=2), encoding="utf-8")
    print(f"{len(g['entries'])} entries, {len(g['trees'])} trees, {len(g['cycles'])} cycles, {len(g['unresolved'])} unresolved")
    return 0


def run_coverage(spark: SparkSession, args: argparse.Namespace) -> int:
    css, graph = Path(args.root, args.css), Path(args.root, args.analysis, GRAPH_FILE)
    if not css.exists():
        print(f"no stylesheet at {css}", file=sys.stderr)
        return 1

    def entry_file() -> DataFrame:
        return spark.createDataFrame([(args.css, css.read_text(encoding="utf-8"))], "path string, content string")

    def rewrite(files: DataFrame) -> None:
        css.write_text(files.first()["content"], encoding="utf-8")

    if args.restore_unmatched:
        row = restored_files(entry_file()).first()
        css.write_text(row["content"], encoding="utf-8")
        print(f"restored {row['selectors']} selectors, {row['keyframes']} keyframes")
        return 0
    if not graph.exists():
        print(f"no graph at {graph}", file=sys.stderr)
        return 1
    sheets = with_imports(spark, args.root, args.css)
    vendor = F.col("path").rlike(VENDOR_PATH)
    found = selectors(sheets.where(~vendor)).withColumn("sel_id", F.monotonically_increasing_id())
    found = materialized(found.select("sel_id", "selector", "file", "line", "segments", "skip_reason"))
    t = {k: materialized(v) for k, v in load_graph(spark, graph.read_text(encoding="utf-8")).items()}
    ctx = materialized(with_paths(check_limit(materialized(contexts(t["entries"], t["items"])), args.max_contexts)))
    evidence = built_in_evidence(spark)
    for folder in args.js:
        evidence = evidence.unionByName(script_evidence(script_files(read_files(spark, str(Path(args.root, folder)), "*.{js,mjs}"))))
    if args.include_node_modules_css:
        evidence = evidence.unionByName(vendor_evidence(sheets.where(vendor)))
    classes = found.join(selector_classes(found), "selector").select("sel_id", "class")
    report, results = coverage(found, classes, ctx, t["nodes"], evidence)
    report = materialized(report)
    unmatched = report.where("bucket = 'unmatched'")
    notes = diagnostics(found.join(unmatched.select("sel_id"), "sel_id", "left_semi"), selector_classes_of(found), class_postings(t["nodes"]))
    details = match_details(found, results, ctx, t["nodes"]).groupBy("sel_id").agg(F.collect_list(F.struct("entry_module", "entry_name", "chain", "result", "dynamic", "unresolved_part")).alias("matches"))
    frames = materialized(keyframes(entry_file()))
    unused = unused_keyframes(frames)
    rings = all_cycles(t["cycles"], cycles(t["entries"], t["items"]), t["edges"])
    lost = all_unresolved(t["unresolved"], missing_refs(t["entries"], t["items"], t["trees"]))
    stats = graph_stats(t["entries"], t["trees"], t["items"], ctx, t["nodes"], class_postings(t["nodes"]))
    full = report.join(details, "sel_id", "left").join(notes, "sel_id", "left")
    text = report_json(full, evidence, frames, unused, invalidated_selectors(entry_file()), rings, lost, stats)
    Path(args.root, args.output).write_text(text, encoding="utf-8")
    out = json.loads(text)
    print(json.dumps(out["summary"]))
    if args.stats:
        print("Analysis stats:")
        for key, label in COUNTERS.items():
            print(f"  {label}: {out['analysis_stats'][key]}")
    for wanted, bucket in ((args.list_unmatched, "unmatched"), (args.list_runtime, "runtime_matched")):
        if wanted:
            for r in in_order(report.where(F.col("bucket") == bucket)).collect():
                print(f"{r['file']}:{r['line']} {r['selector']}")
    if args.list_invalidated:
        for r in in_order(invalidated_selectors(entry_file())).collect():
            print(f"{r['file']}:{r['line']} {r['selector']}")
    targets = unmatched.select("file", "selector", "line")
    if args.invalidate_unmatched:
        rewrite(invalidated_files(entry_file(), targets))
        rewrite(keyframes_invalidated(entry_file(), unused))
    if args.remove_unmatched:
        rewrite(removed_files(entry_file(), targets))
        rewrite(keyframes_removed(entry_file(), unused))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("styleloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return (run_graph if args.command == "graph" else run_coverage)(spark, args)


if __name__ == "__main__":
    sys.exit(main())
