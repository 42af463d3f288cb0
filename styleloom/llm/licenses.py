"""License scans, in DataFrame functions only: MinHash bands over overlapping windows of words retrieve license
templates, and the exact containment of the template's shingles verifies them."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a shingle, and the share of a template's shingles that a window must contain.
SHINGLE, CONTAINED = 3, 0.8
#: A template is found by its bands with at least this probability where the containment is just reached.
RECALL = 0.9999
#: MinHash values in a band.
ROWS = 1
#: Bytes of templates up to which they are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20

#: Short notices by which texts state a license. standard() adds to them; other templates are a parameter.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0": "the GNU General Public License, version 3",
    "GPL-2.0": "the GNU General Public License, version 2",
    "LGPL-3.0": "the GNU Lesser General Public License, version 3",
    "MPL-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "MIT-short": "Released under the MIT License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "proprietary": "All rights reserved",
}

_GNU = "the GNU {0}General Public License as published by the Free Software Foundation; {1}version {2}"
_HEADER = "This program is free software; you can redistribute it and/or modify it under the terms of " + _GNU + " of the License, or (at your option) any later version"
_NAMES = {"GPL-2.0": ("", "2"), "GPL-3.0": ("", "3"), "LGPL-2.1": ("Lesser ", "2.1"), "LGPL-3.0": ("Lesser ", "3"), "AGPL-3.0": ("Affero ", "3")}
_TEXTS = Path(__file__).resolve().parent / "license_texts"
#: What a full text must hold too, where licenses that have no template here share most of it (AGPL-3.0, LGPL-2.0, MIT-0).
_MUST = {"GPL-3.0": "Version 3, 29 June 2007", "LGPL-2.1": "Version 2.1, February 1999", "MIT": "The above copyright notice and this permission notice shall be included"}


def standard() -> list[tuple[str, str, str]]:
    """(license, form, words it must hold too) of the notices, titles, standard headers, SPDX lines and full texts."""
    forms = [(name, text, "") for name, text in TEMPLATES.items()]
    for name, (family, version) in _NAMES.items():
        forms += [(name, f"GNU {family}General Public License {v}", "") for v in (f"version {version}", f"v{version}", f"v{version}.0")]
        forms += [(name, _GNU.format(family, either, version), "") for either in ("", "either ")]
        forms.append((name, _HEADER.format(family, "either ", version), ""))
    forms += [
        ("Apache-2.0", "Apache License Version 2.0", ""),
        ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', ""),
        ("MPL-2.0", "Mozilla Public License Version 2.0", ""),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ""),
    ]
    full = {f.stem: f.read_text(encoding="utf-8") for f in sorted(_TEXTS.glob("*.txt"))}
    forms += [(name, text, _MUST.get(name, "")) for name, text in full.items()]
    spdx = {*full, *_NAMES, "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"}
    for name in sorted(spdx):
        ways = [name, f"{name}-only", f"{name}-or-later"] if name in _NAMES else [name]
        forms += [(name, f"SPDX-License-Identifier: {way}", "") for way in ways]
    return forms


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a hyphen or a point between two of them belongs to the word, but in an SPDX key."""
    text = F.replace(F.lower(text), F.lit("spdx-license-identifier"), F.lit("spdx license identifier"))
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+(?:[-.][\p{L}\p{N}]+)*)"), F.lit(1))


def shingles(parts: Column, k: int) -> Column:
    """The hashes of the runs of k words, in order; none if there are fewer words."""
    own = F.transform(F.sequence(F.lit(0), F.size(parts) - k), lambda i: F.xxhash64(*[F.get(parts, i + o) for o in range(k)]))
    return F.when(F.size(parts) >= k, own).otherwise(F.array().cast("array<long>"))


@dataclass(frozen=True)
class Plan:
    """Windows for templates of up to ``most`` words: ``width`` words at every ``stride``, and the bands to compare."""

    most: int
    stride: int
    width: int
    bands: int


def plan(most: int, least: int, k: int, contained: float, recall: float) -> Plan:
    """Any run of ``most`` words lies in one window; the bands follow from the least similarity that a match can have."""
    stride = max(1, most // 2)
    width = most + stride - 1
    t, w = least - k + 1, width - k + 1
    alike = (contained * t / (w + (1 - contained) * t)) ** ROWS
    return Plan(most, stride, width, math.ceil(math.log(1 - recall) / math.log(1 - alike)) if alike < 1 else 1)


def minhash(window: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.array_min(F.transform(window, lambda h: F.xxhash64(h, F.lit(seed * ROWS + r)))) for r in range(ROWS)])


def licenses(docs: DataFrame, templates: dict[str, str] | list[tuple[str, str, str]] | None = None, k: int = SHINGLE, contained: float = CONTAINED, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return ``(doc_id, license, containment, position, n_windows)`` for each document and template found in it.

    A template is found where a window contains at least the share ``contained`` of its shingles of ``k``
    words; containment is the best of them, position the first word of the first such window. A license may
    have several templates, each with words of which the window must hold a shingle too. Where templates of
    two licenses are confusable (one holds that share of the other), the window must hold a shingle that
    only the one has.

    Null or empty text, or one of fewer than k words, holds nothing. Rows of one doc_id, null too, count
    together. Empty table: no row. Templates of fewer than k words raise ValueError.

    Templates are grouped by length, in powers of two. For each group the windows overlap so that any place
    of a template lies in one. A match lacks a known number of shingles at most, so it holds one of any
    larger choice of them; windows without one are passed over before their MinHash values are formed.
    Nothing is grouped but the matches.
    """
    spark = docs.sparkSession
    given = TEMPLATES if templates is None else templates
    forms = [(name, form, "") for name, form in sorted(given.items())] if isinstance(given, dict) else list(given)
    known = spark.createDataFrame([(i, *form) for i, form in enumerate(forms)], "id int, license string, text string, must string")
    known = known.select("id", "license", words(F.col("text")).alias("parts"), shingles(words(F.col("must")), k).alias("must"))
    known = known.select("id", "license", F.size("parts").alias("n"), shingles(F.col("parts"), k).alias("sh"), "must").collect()
    if any(r["n"] < k for r in known):
        raise ValueError(f"a template has fewer than {k} words")
    sets = {r["id"]: set(r["sh"]) for r in known}
    table, groups, chosen = [], {}, {}
    for r in known:
        own, g = sets[r["id"]], 1 << (r["n"] - 1).bit_length()
        groups.setdefault(g, []).append(r["n"])
        chosen.setdefault(g, set()).update(sorted(own)[: len(own) - math.ceil(contained * len(own) - 1e-9) + 1])
        near = [own - sets[o["id"]] for o in known if o["license"] != r["license"] and len(own & sets[o["id"]]) >= contained * len(own) - 1e-9]
        table.append((r["id"], r["license"], g, sorted(own), [sorted(x) for x in [*near, set(r["must"])] if x]))
    plans = {g: plan(max(own), min(own), k, contained, recall) for g, own in groups.items()}
    size = sum(8 * (len(own) + sum(map(len, telling)) + 4 * plans[g].bands) for _, _, g, own, telling in table)
    small = F.broadcast if size <= BROADCAST_BYTES else lambda df: df
    table = spark.createDataFrame(table, "id int, license string, g int, template array<long>, telling array<array<long>>")
    holds_any = in_filter(set().union(*chosen.values()))

    def windows(sh: Column) -> Column:
        made = []
        for g, p in plans.items():
            starts = F.sequence(F.lit(0), F.size(sh) - 1, F.lit(p.stride))
            made.append(F.filter(F.transform(starts, _window(sh, g, p.width - k + 1)), _holds(in_filter(chosen[g]))))
        return F.concat(*made)

    none = F.array().cast("array<struct<g:int,at:int,win:array<bigint>>>")
    found = let(words(F.coalesce(F.col(f"`{text}`"), F.lit(""))), lambda parts: let(shingles(parts, k), lambda sh: F.when(F.exists(sh, holds_any), windows(sh)).otherwise(none)))
    cut = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.explode(found).alias("w")).select("doc_id", "w.*")

    def banded(df: DataFrame, win: str) -> Column:
        bands = [F.when(F.col("g") == g, F.array(*[minhash(F.col(win), s) for s in range(p.bands)])) for g, p in plans.items()]
        return F.coalesce(*bands)

    keyed = table.select("id", "g", F.explode(F.array_distinct(banded(table, "template"))).alias("band"))
    met = cut.select("doc_id", "g", "at", "win", F.explode(F.array_distinct(banded(cut, "win"))).alias("band")).join(small(keyed), ["g", "band"])
    met = met.join(small(table.drop("g")), "id").select("doc_id", "at", "win", "license", "telling", (F.size(F.array_intersect("template", "win")) / F.size("template")).alias("containment"))
    met = met.where(F.col("containment") >= contained).where(F.forall("telling", lambda t: F.arrays_overlap(t, F.col("win"))))
    return met.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("at").alias("position"), F.count_distinct("at").alias("n_windows"))


def in_filter(hashes: set[int]) -> Callable[[Column], Column]:
    """Whether a hash is one of these: a constant set in the plan, as large as the given templates ask for."""
    known = sorted(hashes)
    return lambda h: h.isin(known)


def _window(sh: Column, g: int, width: int) -> Callable[[Column], Column]:
    return lambda i: F.struct(F.lit(g).alias("g"), i.alias("at"), F.slice(sh, i + 1, width).alias("win"))


def _holds(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda w: F.exists(w["win"], test)


def report(docs: DataFrame) -> DataFrame:
    """What the query returns: the licenses that documents state."""
    return licenses(docs, standard())
