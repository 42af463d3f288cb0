"""Script sources: string literals with their lines, and the class-like tokens in them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The form of a class token, and the one class that the runtime itself sets.
TOKEN = r"[A-Za-z_][A-Za-z0-9_-]*(?:\[[^\]\s]+\])?"
BUILT_IN = ("phx-drop-target-active", "<phoenix-runtime>")
VENDOR_PATH = r"(^|/)node_modules/"

_CODE = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?P<d>(?:\\.|[^"\\])*)(?:"|\Z)|'(?P<s>(?:\\.|[^'\\])*)(?:'|\Z)|`""", re.S)
_IN_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
_IN_EXPRESSION = re.compile(r"""(?P<str>"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z))|[`{}]""", re.S)


def _plain(body: str) -> str:
    """What a literal says; a backslash stands for the character after it."""
    return re.sub(r"\\(.)", r"\1", body, flags=re.S)


def _template(text: str, at: int) -> tuple[list[tuple[int, str]], int]:
    """The static parts (place, value) of the template literal whose body begins at ``at``, and its end."""
    parts, start = [], at
    while True:
        m = _IN_TEMPLATE.search(text, at)
        if m is None or m[0] == "`":
            end = m.start() if m else len(text)
            parts.append((start, _plain(text[start:end])))
            return parts, m.end() if m else end
        if m[0] == "${":
            parts.append((start, _plain(text[start : m.start()])))
            start = at = _expression(text, m.end())
        else:
            at = m.end()


def _expression(text: str, at: int) -> int:
    depth = 1
    while depth:
        m = _IN_EXPRESSION.search(text, at)
        if m is None:
            return len(text)
        at = m.end()
        if m[0] == "`":
            at = _template(text, at)[1]
        elif not m["str"]:
            depth += 1 if m[0] == "{" else -1
    return at


def literals(text: str) -> list[tuple[str, int]]:
    """(literal, line) of every string and static part of a template outside comments; empty ones are left out.

    Regular expression literals are not known: a quote in one opens a string.
    """
    found, at = [], 0
    while m := _CODE.search(text, at):
        at = m.end()
        if m[0] == "`":
            parts, at = _template(text, at)
            found += parts
        elif m.lastgroup:
            found.append((m.start(), _plain(m[m.lastgroup])))
    out, line, seen = [], 1, 0
    for place, value in found:
        if value:
            line, seen = line + text.count("\n", seen, place), place
            out.append((value, line))
    return out


def script_literals(files: DataFrame) -> DataFrame:
    """``(file, line, literal)`` of script files ``(path, content)``; null content has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, line, value) for path, content in zip(frame["path"], frame["content"], strict=True) if content for value, line in literals(content)]
            yield pd.DataFrame(rows, columns=["file", "line", "literal"])

    return files.select("path", "content").mapInPandas(run, "file string, line int, literal string")


def class_tokens(literal: Column) -> Column:
    """The distinct class-like tokens of a literal; one that ends in a hyphen is a fragment."""
    return F.array_distinct(F.filter(F.regexp_extract_all(literal, F.lit(f"({TOKEN})"), F.lit(1)), lambda t: ~F.endswith(t, F.lit("-"))))


def script_evidence(files: DataFrame) -> DataFrame:
    """``(token, file, line, literal, source)`` for every class-like token that a script names."""
    rows = script_literals(files).select(F.explode(class_tokens(F.col("literal"))).alias("token"), "file", "line", "literal")
    return rows.withColumn("source", F.lit(None).cast("string"))


def built_in_evidence(spark: SparkSession) -> DataFrame:
    token, file = BUILT_IN
    return spark.createDataFrame([(token, file, None, token, "runtime")], "token string, file string, line int, literal string, source string")


def script_files(files: DataFrame) -> DataFrame:
    """Script files in order of path, without those of installed packages."""
    return files.where(F.col("path").rlike(r"\.m?js$") & ~F.col("path").rlike(VENDOR_PATH)).orderBy("path")


def evidence_report(evidence: DataFrame) -> DataFrame:
    """``(token, uses)``: where each token is named, in the order of file and line."""
    return evidence.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("file", "line", "literal", "source"))).alias("uses"))
