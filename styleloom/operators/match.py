"""Matching selectors against rendered contexts as a fold of joins, from the last segment to the first.

Tables:
``nodes(node_id, tag, repeat, raw, facts)``;
``contexts(ctx_id, entry_ord, node_id, parent_id, prev_sibling_id, parent_key, sibling)``, where contexts of
equal (entry_ord, parent_key) are siblings in the order of ``sibling``, and ``path`` holds the ids of all ancestors
from the root down (``with_paths`` adds it);
``selectors(sel_id, segments)``.

A step of the fold asks only for what stands beside the contexts of its frontier: parents and ancestors come from the
path that a context carries, and what they must meet is known before they are looked up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.facts import concrete_classes, node_matches
from ..plans.persist import materialized

#: Rank of a context that every other one counts as an ancestor, after all real ancestors; of a repeated node as its own sibling.
AMBIENT, LAST = 1_000_000, 2**62


def class_postings(nodes: DataFrame) -> DataFrame:
    """``(class, node_id)``: the inverted index, one row for each class that a node may have."""
    return nodes.where("NOT raw").select(F.explode(concrete_classes(F.col("facts"))).alias("class"), "node_id").distinct()


def segment_matches(segments: DataFrame, nodes: DataFrame, by_tag: bool = True, loose: bool = True) -> DataFrame:
    """``(seg_id, node_id, kind, repeat, body)`` for the distinct segments ``(seg_id, seg)`` and the nodes that meet them.

    A segment with classes finds its candidates by an equi-join on the class, and a candidate counts at the
    first of its classes only, so nothing has to be made distinct. One with a tag alone joins on the tag.
    Segments that ask for neither (wildcards, exclusions) meet every node; there are as many distinct ones
    as kinds of combinators and exclusions. ``by_tag`` and ``loose`` tell whether there are segments of these
    two kinds, so that a plan without them has no branch for them.
    """
    kind = node_matches(F.col("seg"), F.col("tag"), F.col("raw"), F.col("facts")).alias("kind")
    columns = ["seg_id", "node_id", kind, "repeat", (F.equal_null("tag", F.lit("body")) & ~F.col("raw")).alias("body")]
    wanted = F.col("seg.classes")
    by_class = segments.select("seg_id", "seg", F.explode(F.array_distinct(wanted)).alias("class"))
    known = nodes.where("NOT raw").select("*", concrete_classes(F.col("facts")).alias("known"))
    found = known.select("*", F.explode("known").alias("class")).join(by_class, "class")
    found = found.where(F.col("class") == F.get(F.array_intersect(wanted, F.col("known")), F.lit(0))).select(*columns)
    bare = segments.where(F.size(wanted) == 0).withColumn("seg_tag", F.col("seg.tag"))
    if by_tag:
        tagged = bare.where("seg_tag IS NOT NULL AND NOT seg.wildcard")
        found = found.unionByName(nodes.where("NOT raw").join(tagged, F.col("tag") == F.col("seg_tag")).select(*columns))
        found = found.unionByName(nodes.where("raw").crossJoin(tagged).select(*columns))
    if loose:
        found = found.unionByName(nodes.where("NOT raw").crossJoin(bare.where("seg_tag IS NULL OR seg.wildcard")).select(*columns))
    return found.where("kind IS NOT NULL")


def ancestors(contexts: DataFrame, depth: int | None = None) -> DataFrame:
    """``(ctx_id, rel_id, rank)``: each context with its ancestors, the nearest of rank 0.

    The closure doubles its reach with each join, so a tree of depth d takes log2(d) joins.
    """
    reach = contexts.where("parent_id IS NOT NULL").select("ctx_id", F.col("parent_id").alias("rel_id"), F.lit(0).cast("long").alias("rank"))
    step, span = reach, 1
    while depth is None or span < depth:
        further = reach.where(F.col("rank") == span - 1).select("ctx_id", F.col("rel_id").alias("via"))
        more = further.join(reach.select(F.col("ctx_id").alias("via"), "rel_id", (F.col("rank") + span).alias("rank")), "via").select("ctx_id", "rel_id", "rank")
        if depth is None and more.limit(1).count() == 0:
            break
        reach = reach.unionByName(more)
        span *= 2
    return reach


def with_paths(contexts: DataFrame, depth: int | None = None) -> DataFrame:
    """The contexts with their ``path``, unless they have it: the closure of the parents, gathered once."""
    if "path" in contexts.columns:
        return contexts
    above = ancestors(contexts, depth).groupBy("ctx_id").agg(F.sort_array(F.collect_list(F.struct("rank", "rel_id")), asc=False)["rel_id"].alias("path"))
    return contexts.join(above, "ctx_id", "left").withColumn("path", F.coalesce("path", F.array().cast("array<bigint>")))


#: What a context carries through the fold to find what stands beside it, by combinator.
PLACE = {">": ["parent_id"], " ": ["path"], "+": ["prev_sibling_id"], "~": ["entry_ord", "parent_key", "sibling"]}


def step_left(frontier: DataFrame, there: DataFrame, combinators: set[str], final: bool) -> DataFrame:
    """The moves ``(frontier's columns, rel_id, r, t)`` of one step: what a combinator relates a context to, if it meets the next segment.

    ``there(sel_id, last, rel_id, t)`` are the contexts that meet it; ``r`` is the order in which they are
    tried: ``>`` the parent; ``+`` the previous sibling, then the context itself if its node repeats; ``~``
    all earlier siblings from the nearest, then likewise itself; anything else the ancestors from the
    nearest, then every ``body`` of any entry.

    Where ``last`` says that no segment follows, only the nearest static and the nearest dynamic one count:
    of siblings they come from a window over each family, of ``body`` contexts the first two are enough,
    as one may be the context itself. ``final`` says whether a selector ends with this step.
    """
    moves = []
    own = frontier.columns

    def by_id(rows: DataFrame, rel, r) -> None:
        moves.append(rows.select(*own, rel.alias("rel_id"), r.cast("long").alias("r")))

    if ">" in combinators:
        by_id(frontier.where("comb = '>' AND at.parent_id IS NOT NULL"), F.col("at.parent_id"), F.lit(0))
    if " " in combinators:
        up = frontier.where("comb = ' '").select(*own, F.posexplode(F.reverse("at.path")).alias("r", "rel_id"))
        by_id(up, F.col("rel_id"), F.col("r"))
    if "+" in combinators:
        by_id(frontier.where("comb = '+' AND at.prev_sibling_id IS NOT NULL"), F.col("at.prev_sibling_id"), F.lit(0))
    if combinators & {"+", "~"}:
        by_id(frontier.where("comb IN ('+', '~') AND at.repeat"), F.col("cur"), F.lit(LAST))
    out = moves[0] if moves else frontier.select(*own, F.lit(0).cast("long").alias("rel_id"), F.lit(0).cast("long").alias("r")).limit(0)
    for m in moves[1:]:
        out = out.unionByName(m)
    out = out.join(there.drop("last"), ["sel_id", "rel_id"])
    if " " in combinators:
        bodies = there.where("t.body")
        nth = F.row_number().over(Window.partitionBy("sel_id", F.col("t.open").isNull()).orderBy("rel_id"))
        bodies = bodies.withColumn("nth", nth).where("NOT last OR nth <= 2").drop("last", "nth")
        ambient = frontier.where("comb = ' '").join(bodies, "sel_id").where("rel_id <> cur")
        out = out.unionByName(ambient.withColumn("r", F.col("rel_id") + AMBIENT).select(out.columns))
    if "~" in combinators:
        family = ["sel_id", "entry_ord", "parent_key"]
        keyed = frontier.where("comb = '~'").withColumns({"entry_ord": F.col("at.entry_ord"), "parent_key": F.col("at.parent_key")})
        beside = there.withColumns({"entry_ord": F.col("t.at.entry_ord"), "parent_key": F.col("t.at.parent_key")})
        inner = keyed.join(beside.where("NOT last").drop("last"), family).where("t.at.sibling < at.sibling")
        out = out.unionByName(inner.withColumn("r", F.col("at.sibling") - F.col("t.at.sibling")).select(out.columns))
        if final:
            rows = keyed.join(beside.where("last").select(*family).distinct(), family, "left_semi")
            rows = rows.select(*family, F.col("at.sibling").alias("sibling"), F.struct(*own).alias("f"), F.lit(None).cast(there.schema["t"].dataType).alias("t"), F.lit(None).cast("long").alias("rel_id"))
            met = beside.where("last").select(*family, F.col("t.at.sibling").alias("sibling"), F.lit(None).cast(rows.schema["f"].dataType).alias("f"), "t", "rel_id")
            before = Window.partitionBy(*family).orderBy("sibling", F.col("t").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
            one = F.struct("rel_id", "t")
            nearest = [F.last(F.when(F.col("t").isNotNull() & cond, one), ignorenulls=True).over(before) for cond in (F.col("t.open").isNull(), F.col("t.open").isNotNull())]
            near = rows.unionByName(met).withColumn("near", F.array(*nearest)).where("f IS NOT NULL")
            near = near.select("f.*", F.explode("near").alias("near")).where("near IS NOT NULL").select(*own, "near.rel_id", "near.t")
            out = out.unionByName(near.withColumn("r", F.col("at.sibling") - F.col("t.at.sibling")).select(out.columns))
    return out


def match_keys(selectors: DataFrame, contexts: DataFrame, nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """``(sel_id, key_ctx, key_kind, matched, dyn, failed_dynamic, dyn_node)`` for each context that meets a last segment.

    Of all chains of contexts that satisfy a selector from its last segment leftwards, the one that comes
    first in the order of tries decides whether it was reached through a dynamic node (``dyn``). A key
    without a full chain is ``failed_dynamic`` if a partial one has a dynamic node.

    The frontier holds (selector, key, current context, dynamic or not) with the least rank: how a chain
    goes on depends on nothing else, so it grows with the contexts, not with the chains.
    """
    selectors = materialized(selectors.select("sel_id", "segments"))  # its size is known then, so that nodes stay in place where it is small
    segs = selectors.select("sel_id", F.size("segments").alias("n"), F.posexplode("segments").alias("pos", "seg"))
    bare = F.size("seg.classes") == 0
    tagged = F.col("seg.tag").isNotNull() & ~F.col("seg.wildcard")
    shape = segs.groupBy("pos", "n").agg(F.collect_set("seg.combinator").alias("combs"), F.bool_or(bare & tagged).alias("tagged"), F.bool_or(bare & ~tagged).alias("loose")).collect()  # a row for each length and position
    longest = max((r["n"] for r in shape), default=0)
    combs = {c if c in (">", "+", "~") else " " for r in shape if r["pos"] > 0 for c in (r["combs"] or [" "])}
    distinct = segs.select(F.xxhash64("seg").alias("seg_id"), "seg").dropDuplicates(["seg_id"])
    kinds = segment_matches(distinct, nodes, any(r["tagged"] for r in shape), any(r["loose"] for r in shape))
    placed = segs.select("sel_id", "n", "pos", F.xxhash64("seg").alias("seg_id"), F.col("seg.combinator").alias("comb"))
    placed = placed.withColumn("comb", F.when(F.col("comb").isin(">", "+", "~"), F.col("comb")).otherwise(F.lit(" ")))

    # who meets which segment, computed once for all steps, with what the combinators at hand ask for
    place = [c for k, cs in PLACE.items() if k in combs for c in cs]
    placed_contexts = (with_paths(contexts, depth) if "path" in place else contexts).select("ctx_id", "node_id", *place)
    met = placed.join(kinds, "seg_id").join(placed_contexts, "node_id")
    met = materialized(met.select("sel_id", "n", "pos", "comb", "ctx_id", F.struct(*place, "repeat").alias("at"), "body", F.when(F.col("kind") == "dynamic", F.col("node_id").cast("string")).alias("dyn_node")))
    keys = met.where("pos = n - 1").select("sel_id", "n", F.col("ctx_id").alias("key_ctx"), F.when(F.col("dyn_node").isNull(), "static").otherwise("dynamic").alias("key_kind"), "comb", "at")

    empty = F.array().cast("array<bigint>")
    frontier = keys.select("sel_id", "n", "key_ctx", F.col("key_ctx").alias("cur"), "comb", F.lit(False).alias("dyn"), empty.alias("rank"), F.lit(None).cast("string").alias("dyn_node"), "at")
    done = frontier.where("n = 1").drop("at")
    partial = None
    for step in range(1, longest):
        there = met.where(F.col("pos") == F.col("n") - 1 - step).select("sel_id", (F.col("pos") == 0).alias("last"), F.col("ctx_id").alias("rel_id"), F.struct(F.col("comb").alias("next"), F.col("dyn_node").alias("open"), "body", "at").alias("t"))
        final = any(r["n"] == step + 1 for r in shape)
        moved = step_left(frontier.where(F.col("n") > step), there, combs, final).select(
            "sel_id", "n", "key_ctx", F.col("rel_id").alias("cur"), F.col("t.next").alias("comb"),
            (F.col("dyn") | F.col("t.open").isNotNull()).alias("dyn"),
            F.concat("rank", F.array("r")).alias("rank"),
            F.coalesce("dyn_node", "t.open").alias("dyn_node"),
            F.col("t.at").alias("at"),
        )
        frontier = moved.groupBy("sel_id", "n", "key_ctx", "cur", "comb", "dyn").agg(F.min(F.struct("rank", "dyn_node", "at")).alias("b")).select("sel_id", "n", "key_ctx", "cur", "comb", "dyn", "b.rank", "b.dyn_node", "b.at")
        if step + 1 < longest:
            frontier = materialized(frontier)  # the next step and two results read it
        done = done.unionByName(frontier.where(F.col("n") == step + 1).drop("at"))
        tries = frontier.where(F.col("dyn") & (F.col("n") > step + 1)).select("sel_id", "key_ctx", "dyn_node")
        partial = tries if partial is None else partial.unionByName(tries)

    best = done.groupBy("sel_id", "key_ctx").agg(F.min(F.struct("rank", "dyn", "dyn_node")).alias("b")).select("sel_id", "key_ctx", F.lit(True).alias("matched"), F.col("b.dyn").alias("dyn"), F.col("b.dyn_node").alias("dyn_node"))
    out = keys.select("sel_id", "key_ctx", "key_kind").join(best, ["sel_id", "key_ctx"], "left")
    if partial is None:
        out = out.withColumn("tried", F.lit(None).cast("string"))
    else:
        out = out.join(partial.groupBy("sel_id", "key_ctx").agg(F.min("dyn_node").alias("tried")), ["sel_id", "key_ctx"], "left")
    matched = F.coalesce("matched", F.lit(False))
    return out.select(
        "sel_id", "key_ctx", "key_kind",
        matched.alias("matched"),
        F.coalesce("dyn", F.lit(False)).alias("dyn"),
        (~matched & F.col("tried").isNotNull()).alias("failed_dynamic"),
        F.coalesce("dyn_node", F.when(~matched, F.col("tried"))).alias("dyn_node"),
    )


def key_results(keys: DataFrame) -> DataFrame:
    """``(sel_id, key_ctx, result, dyn_node)``: a static ``match``, a ``dynamic`` candidate; keys that fail are left out."""
    result = F.when(F.col("matched") & ~F.col("dyn") & (F.col("key_kind") == "static"), "match").when(F.col("matched") | F.col("failed_dynamic"), "dynamic")
    return keys.select("sel_id", "key_ctx", "key_kind", result.alias("result"), "dyn_node").where("result IS NOT NULL")


def buckets(selectors: DataFrame, results: DataFrame, classes: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(sel_id, bucket)``: skipped, matched, possibly_dynamic, runtime_matched or unmatched.

    ``classes(sel_id, class)`` are all classes in the text of a selector, ``evidence(token)`` those that
    scripts name. A selector that nothing matches is explained by evidence if one of its classes has some,
    each is known from the graph or from evidence, and, with several segments, no sibling combinator is
    used and one class is in the graph. ``classes`` carries ``in_graph``.
    """
    best = results.groupBy("sel_id").agg(F.min(F.when(F.col("result") == "match", 0).otherwise(1)).alias("best"))
    known = evidence.select(F.col("token").alias("class"), F.lit(True).alias("in_evidence")).distinct()
    told = classes.join(known, "class", "left").select("sel_id", "in_graph", F.coalesce("in_evidence", F.lit(False)).alias("in_evidence"))
    told = told.groupBy("sel_id").agg(F.bool_or("in_evidence").alias("some"), F.bool_and(F.col("in_graph") | F.col("in_evidence")).alias("each"), F.bool_or("in_graph").alias("graph"))
    several = F.size("segments") > 1
    siblings = F.exists("segments", lambda s: s["combinator"].isin("+", "~"))
    runtime = F.coalesce(F.col("some") & F.col("each") & (~several | (~F.coalesce(siblings, F.lit(False)) & F.col("graph"))), F.lit(False))
    joined = selectors.join(best, "sel_id", "left").join(told, "sel_id", "left")
    return joined.select(
        "sel_id",
        F.when(F.col("segments").isNull() | (F.size("segments") == 0), "skipped")
        .when(F.col("best") == 0, "matched")
        .when(F.col("best") == 1, "possibly_dynamic")
        .when(runtime, "runtime_matched")
        .otherwise("unmatched")
        .alias("bucket"),
    )
