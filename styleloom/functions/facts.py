"""Predicates over class facts, as Column expressions that stay on the JVM.

A node's facts tell which classes it always has (``static``), may have (``optional``), has one option of
(``exclusive``: groups of options), and which of its classes are not known (``dynamic``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DYN, FACTS, OPTION

def nothing() -> Column:
    return F.lit(None).cast("string")


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def dyn(reason: str | None = None, expr: str | None = None, chain: str | None = None) -> Column:
    """A dynamic fact: why a class is not known, of which expression, reached through which calls."""
    return F.struct(F.lit(reason).cast("string").alias("reason"), F.lit(expr).cast("string").alias("expr"), F.lit(chain).cast("string").alias("chain"))


def option(classes: Column | None = None, dynamic: Column | None = None) -> Column:
    return F.struct(
        (strings() if classes is None else classes).alias("classes"),
        (F.array().cast(f"array<{DYN}>") if dynamic is None else dynamic).alias("dyn"),
    ).cast(OPTION)


def facts(static: Column | None = None, optional: Column | None = None, exclusive: Column | None = None, dynamic: Column | None = None) -> Column:
    """Facts from their parts; what is left out is empty."""
    return F.struct(
        (strings() if static is None else static).alias("static"),
        (strings() if optional is None else optional).alias("optional"),
        (F.array().cast(f"array<array<{OPTION}>>") if exclusive is None else exclusive).alias("exclusive"),
        (F.array().cast(f"array<{DYN}>") if dynamic is None else dynamic).alias("dynamic"),
    ).cast(FACTS)


def class_words(text: Column) -> Column:
    """The words of a class attribute."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def group_classes(group: Column) -> Column:
    """All classes of the options of one exclusive group."""
    return F.flatten(F.transform(group, lambda o: o["classes"]))


def concrete_classes(f: Column) -> Column:
    """Every class that the facts name; empty for a node without facts."""
    named = F.concat(f["static"], f["optional"], F.flatten(F.transform(f["exclusive"], group_classes)))
    return F.coalesce(F.array_distinct(named), strings())


def violates_group(f: Column, wanted: Column) -> Column:
    """Whether the wanted classes touch an exclusive group without one option that covers what they touch."""

    def broken(group: Column) -> Column:
        touched = F.array_intersect(wanted, group_classes(group))
        covered = F.exists(group, lambda o: F.size(F.array_except(touched, o["classes"])) == 0)
        return (F.size(touched) > 0) & ~covered

    return F.coalesce(F.exists(f["exclusive"], broken), F.lit(False))


def open_option(f: Column, wanted: Column) -> Column:
    """Whether an option with a dynamic part could still hold the wanted classes of its group."""

    def covers(group: Column) -> Column:
        touched = F.array_intersect(wanted, group_classes(group))
        return F.exists(group, lambda o: (F.size(o["dyn"]) > 0) & (F.size(F.array_except(touched, o["classes"])) == 0))

    return F.coalesce(F.exists(f["exclusive"], covers), F.lit(False))


def holds_classes(f: Column, wanted: Column) -> Column:
    """How a node holds the wanted classes: ``static``, ``dynamic``, or null for not at all.

    With none wanted, static. All of them known: static unless a group forbids them together. None known:
    not at all, however dynamic the node. Some known: dynamic if these go together and the node has a
    dynamic fact, or a dynamic option open to them.
    """
    known = F.array_intersect(wanted, concrete_classes(f))
    n, have = F.size(F.array_distinct(wanted)), F.size(known)
    return (
        F.when(n == 0, F.lit("static"))
        .when(f.isNull(), nothing())
        .when((have == 0) | violates_group(f, known), nothing())
        .when(have == n, F.lit("static"))
        .when((F.size(f["dynamic"]) > 0) | open_option(f, known), F.lit("dynamic"))
    )


def node_matches(seg: Column, tag: Column, raw: Column, f: Column) -> Column:
    """How a node meets one segment of a selector: ``static``, ``dynamic``, or null."""
    bare = seg["tag"].isNotNull() & (F.size(seg["classes"]) == 0) & (F.size(seg["not_classes"]) == 0) & ~seg["wildcard"]
    return (
        F.when(raw, F.when(bare, F.lit("static")))
        .when(seg["wildcard"], F.lit("static"))
        .when(seg["tag"].isNotNull() & ~F.equal_null(seg["tag"], tag), nothing())
        .when(F.coalesce(F.arrays_overlap(f["static"], seg["not_classes"]), F.lit(False)), nothing())
        .otherwise(holds_classes(f, seg["classes"]))
    )


def first_dynamic(f: Column) -> Column:
    """The fact to report for a dynamic node: the first dynamic one, else the first in a group, else an unknown one."""
    inner = F.flatten(F.transform(F.flatten(f["exclusive"]), lambda o: o["dyn"]))
    return F.coalesce(F.get(f["dynamic"], F.lit(0)), F.get(inner, F.lit(0)), dyn(None, "<unknown>", None))


def node_label(tag: Column, raw: Column, f: Column) -> Column:
    """``raw-html``, or the tag (``?`` if missing) and all concrete classes joined by points."""
    return F.when(raw, F.lit("raw-html")).otherwise(F.array_join(F.concat(F.array(F.coalesce(tag, F.lit("?"))), concrete_classes(f)), "."))
