"""Rewriting stylesheets by what a report says: put rules out of use, bring them back, remove them.

Each function takes files ``(path, content)`` and, where it needs one, a table of targets with the path in
``file``; files without a target keep their text. Targets meet the rules of a fresh parse by selector and line.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stylesheets import MARKER, PREFIX, ROWS, Block, keyframe_rows, parse_stylesheet, rules, split_selectors, walk


def _cut(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced; spans inside a replaced one are passed over."""
    out, at = [], 0
    for a, b, new in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], new]
            at = b
    return "".join(out) + text[at:]


def _head_end(text: str, block: Block) -> int:
    return block.start + len(block.head)


def invalidate_selectors(text: str, targets: set[tuple[str, int]]) -> str:
    """Put the marker before every targeted selector; nothing else moves."""
    spans = []
    for rule in rules(parse_stylesheet(text)):
        at = rule.start
        for s in split_selectors(rule.head):
            at = text.index(s, at)
            if (s, rule.line) in targets and MARKER not in s:
                spans.append((at, at, f"{MARKER} "))
            at += len(s)
    return _cut(text, spans)


def restore_selectors(text: str) -> tuple[str, int]:
    """The text without markers, and how many there were."""
    return text.replace(MARKER, ""), text.count(MARKER)


def _keyframes(text: str) -> Iterator[Block]:
    return (b for b in walk(parse_stylesheet(text)) if b.at_rule and b.at_rule[0] == "keyframes")


def invalidate_keyframes(text: str, names: set[str]) -> str:
    spans = []
    for b in _keyframes(text):
        name = b.at_rule[1]
        if name in names:
            at = b.start + b.head.rindex(name)
            spans.append((at, at + len(name), PREFIX + name))
    return _cut(text, spans)


def restore_keyframes(text: str) -> tuple[str, int]:
    return text.replace(PREFIX, ""), text.count(PREFIX)


def remove_keyframes(text: str, names: set[str]) -> str:
    """Without the keyframes of these names and those that are out of use."""
    return _drop(text, [b for b in _keyframes(text) if b.at_rule[1] in names or b.at_rule[1].startswith(PREFIX)])


def _drop(text: str, blocks: list[Block]) -> str:
    spans = []
    for b in blocks:
        end = b.end
        while end < len(text) and text[end] in " \t":
            end += 1
        spans.append((b.start, end + (text[end : end + 1] == "\n"), ""))
    return _cut(text, spans)


def remove_selectors(text: str, targets: set[tuple[str, int]]) -> str:
    """Without the targeted selectors and those out of use; rules and at-rules left empty go as well."""
    spans, gone = [], []
    for rule in rules(parse_stylesheet(text)):
        members = split_selectors(rule.plain)
        stay = [s for s in members if (s, rule.line) not in targets and MARKER not in s]
        if not stay:
            gone.append(rule)
        elif len(stay) < len(members):
            spans.append((rule.start, _head_end(text, rule), ",\n".join(stay)))
    if not gone and not spans:
        return text
    out = _cut(text, spans + [(b.start, b.end + (text[b.end : b.end + 1] == "\n"), "") for b in gone])
    while empty := [b for b in walk(parse_stylesheet(out)) if b.at_rule and b.open and not b.body and not b.declarations]:
        out = _drop(out, empty)
    return out


def _rewritten(files: DataFrame, targets: DataFrame, rewrite: Callable[[str, list], str]) -> DataFrame:
    """``(path, content)`` after ``rewrite(content, targets of the file)``; targets are gathered for each file."""
    fields = [c for c in targets.columns if c != "file"]
    told = targets.groupBy(F.col("file").alias("path")).agg(F.to_json(F.collect_list(F.struct(*fields))).alias("told"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            new = [c if c is None else rewrite(c, json.loads(t) if t else []) for c, t in zip(frame["content"], frame["told"], strict=True)]
            yield pd.DataFrame({"path": frame["path"], "content": new})

    return files.select("path", "content").join(told, "path", "left").mapInPandas(run, "path string, content string")


def _pairs(told: list[dict]) -> set[tuple[str, int]]:
    return {(t["selector"], t["line"]) for t in told}


def invalidated_files(files: DataFrame, unmatched: DataFrame) -> DataFrame:
    return _rewritten(files, unmatched.select("file", "selector", "line"), lambda text, told: invalidate_selectors(text, _pairs(told)))


def removed_files(files: DataFrame, unmatched: DataFrame) -> DataFrame:
    return _rewritten(files, unmatched.select("file", "selector", "line"), lambda text, told: remove_selectors(text, _pairs(told)))


def keyframes_invalidated(files: DataFrame, unused: DataFrame) -> DataFrame:
    return _rewritten(files, unused.select("file", "name"), lambda text, told: invalidate_keyframes(text, {t["name"] for t in told}))


def keyframes_removed(files: DataFrame, unused: DataFrame) -> DataFrame:
    return _rewritten(files, unused.select("file", "name"), lambda text, told: remove_keyframes(text, {t["name"] for t in told}))


def restored_files(files: DataFrame) -> DataFrame:
    """``(path, content, selectors, keyframes)``: the text without marks, and how many of each there were; on the JVM throughout."""
    marks = F.regexp_count("content", F.lit(MARKER.replace(".", r"\.")))
    bare = F.replace("content", F.lit(MARKER), F.lit(""))
    return files.select("path", F.replace(bare, F.lit(PREFIX), F.lit("")).alias("content"), marks.alias("selectors"), F.regexp_count(bare, F.lit(PREFIX)).alias("keyframes"))


def invalidated_selectors(files: DataFrame) -> DataFrame:
    """``(selector, file, line)`` of the selectors that are out of use, without their mark."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = zip(frame["path"], frame["content"], strict=True)
            rows = ((s.replace(MARKER, "").strip(), path, rule.line) for path, content in texts for rule in rules(parse_stylesheet(content or "")) for s in split_selectors(rule.plain) if MARKER in s)
            for some in batched(rows, ROWS):
                yield pd.DataFrame(some, columns=["selector", "file", "line"])

    return files.select("path", "content").mapInPandas(run, "selector string, file string, line int")


def invalidated_keyframes(path: str, text: str) -> list[tuple]:
    return [r[1:] for r in keyframe_rows(path, text) if r[0] == "invalidated"]
