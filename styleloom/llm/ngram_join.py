"""Self-join of documents on the Jaccard similarity of their word shingles, by adaptive multi-match prefixes.

All sets are put in one order of their shingles, rare ones first. Two sets as alike as asked for must then share
at least l shingles of their l-prefixes, the first n - need + l shingles. Each document takes the l that makes its
own work least: a longer prefix costs rows, but asks for more shared shingles before two sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, checkpointed, connected_components, mix, pieces, shingle_sets, stored, sweeping, texts_of, words_of

#: Bits of a shingle by which it is counted, parts of their range that are counted apart, shingles that a task packs at once.
BITS, RANGES, PACKED = 36, 1024, 1 << 20
#: Cells of the table of frequent shingles, the share of them that may be in use, and how often any other shingle occurs at most.
CELLS, FILLED, SELDOM = 1 << 24, 1 / 8, 8
#: What a cell holds is this many times the binary logarithm of a frequency.
FINE = 8
FREQUENCY = np.concatenate([[0], 2 ** (np.arange(1, 256) / FINE)])
#: Up to so many documents that share a prefix shingle are paired; more are tied to one of them and compared in a block.
PAIRED = 32
#: A null doc_id takes this key, the largest, so that no other document has it for its component.
LAST = 2**63 - 1
#: Shingles that one comparing task holds at most, but for a single longer document.
HELD = 4_000_000
#: For the estimate of work: the share of shingles that two unrelated documents share by chance, and what
#: reading a shingle to compare costs against dealing one.
CHANCE, COMPARE = 0.2, 0.5


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of a set of n shingles with any set that is alike."""
    return -(-percent * n // 100)


def pair_needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of two sets of these sizes that are alike."""
    return -(-percent * (a + b) // (100 + percent))


LADDER = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048])


def matches_asked(frequency: np.ndarray, percent: int, paired: float = float("inf")) -> int:
    """The l of a set whose shingles have these estimated frequencies beyond the set itself, in their order.

    Where over ``paired`` others have a shingle, all of them are compared, however many shingles they share.
    """
    n = len(frequency)
    base = n - int(needed(np.int64(n), percent))
    ladder = LADDER[: max(1, int(np.searchsorted(LADDER, n - base, "right")))]
    tied = frequency * (frequency > paired)
    reached = np.cumsum(np.maximum(frequency, CHANCE) - tied)[base + ladder - 1] / ladder + np.cumsum(tied)[base + ladder - 1]
    return int(ladder[np.argmin(base + ladder + COMPARE * n * reached)])


def _sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    words, _, count = words_of(*texts_of(batch.column("text")))
    return shingle_sets(words, count, k)


def _named(sets: list[np.ndarray], salt: int) -> np.ndarray:
    """A hash of each set."""
    n = np.array([len(s) for s in sets], np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix((np.concatenate(sets) if sets else np.zeros(0, U)) + U(salt)))])
    return mix(total[ends[1:]] - total[ends[:-1]] + n.astype(U))


_SURVEY = pa.schema([("to", pa.int32()), ("size", pa.int64()), ("counts", pa.binary()), *[(c, pa.int64()) for c in ("key", "a", "n", "hi", "lo")]])


def _survey(k: int):
    """The size and two hashes of each document's set, and all shingles, sorted and packed by the range that counts them."""

    def packed(sets: list[np.ndarray]) -> pa.RecordBatch:
        cut = np.sort(np.concatenate(sets) >> U(64 - BITS))
        ends = np.searchsorted(cut, np.arange(RANGES + 1, dtype=U) * U((1 << BITS) // RANGES))
        cut = (cut % U((1 << BITS) // RANGES)).astype(np.uint32)
        to = np.flatnonzero(np.diff(ends))
        rows = []
        for r in to.tolist():
            steps = np.diff(cut[ends[r] : ends[r + 1]], prepend=np.uint32(0))
            rows.append(pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True))  # the bytes of a kind together
        none = pa.nulls(len(to), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(np.diff(ends)[to]), pa.array(rows, pa.binary()), *[none] * 5], schema=_SURVEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = number = 0
        for whole in batches:
            for batch in pieces(whole, "text"):
                sets = _sets(batch, k)
                n = np.array([len(s) for s in sets], np.int64)
                held, size = held + sets, size + int(n.sum())
                hashes = [_named(sets, salt).view(np.int64) for salt in (0x51, 0xA7)]
                to = (np.arange(number, number + len(n)) % RANGES).astype(np.int32)  # in turn, so that no task gets many
                number += len(n)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary()), batch.column("key"), batch.column("a"), *[pa.array(x) for x in (n, *hashes)]], schema=_SURVEY)
                if size >= PACKED:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    return run, "to int, size long, counts binary, key long, a long, n long, hi long, lo long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of _survey sorted by where they go: those of documents, and of each range its part of the table of frequent shingles."""
    wide = CELLS // RANGES
    now, held = -1, []

    def ready() -> pa.RecordBatch:
        shingles = np.sort(np.concatenate(held))
        start = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))
        times = np.diff(np.append(start, len(shingles)))
        often = times > SELDOM
        cells = np.zeros(wide, np.uint8)
        at = shingles[start[often]] // np.uint32((1 << BITS) // CELLS)
        np.maximum.at(cells, at, np.minimum(np.rint(FINE * np.log2(times[often])), 255).astype(np.uint8))
        row = [pa.array([now], pa.int32()), pa.array([wide], pa.int64()), pa.array([pa.compress(cells.tobytes(), "zstd", asbytes=True)], pa.binary())]
        return pa.RecordBatch.from_arrays([*row, *[pa.nulls(1, pa.int64())] * 5], schema=_SURVEY)

    for batch in batches:
        counts = batch.column("counts")
        yield batch.filter(counts.is_null())
        for to, size, packed in zip(batch.column("to").to_pylist(), batch.column("size").to_pylist(), counts, strict=True):
            if not packed.is_valid:
                continue
            if to != now and held:
                yield ready()
                held = []
            now = to
            steps = np.frombuffer(pa.decompress(packed.as_buffer(), 4 * size, "zstd"), np.uint8).reshape(4, -1).T
            held.append(np.cumsum(np.ascontiguousarray(steps).view(np.uint32).ravel(), dtype=np.uint32))
    if held:
        yield ready()


def _frequent(surveyed: DataFrame) -> np.ndarray:
    """The table of frequent shingles: CELLS bytes for any corpus. Where too many cells are in use, the least frequent go."""
    table = np.zeros(CELLS, np.uint8)
    wide = CELLS // RANGES
    for r in surveyed.where("counts IS NOT NULL").select("to", "counts").collect():
        table[r["to"] * wide : (r["to"] + 1) * wide] = np.frombuffer(pa.decompress(bytes(r["counts"]), wide, "zstd"), np.uint8)
    used = np.cumsum(np.bincount(table, minlength=256)[::-1])[::-1]  # cells with this number or more
    table[table <= np.argmax(np.append(used[1:], 0) <= FILLED * CELLS)] = 0
    return table


def _prefixes(k: int, percent: int, frequent):
    """A row for each shingle in the prefix of each document: (shingle, set, size, l)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        dealt: set[int] = set()  # sets that this task has dealt, so that copies are not dealt again; forgotten now and then
        for whole in batches:
            for batch in pieces(whole, "text"):
                rows: list[tuple] = []
                for s in _sets(batch, k):
                    n = len(s)
                    if not n:
                        continue
                    lo = mix(mix(s + U(0xA7)).sum(keepdims=True) + U(n))
                    if int(lo[0]) in dealt:
                        continue
                    if len(dealt) > 200_000:
                        dealt.clear()
                    dealt.add(int(lo[0]))
                    f = table[(s // U((1 << 64) // CELLS)).astype(np.int64)]
                    order = np.lexsort((s, f))
                    asked = matches_asked(FREQUENCY[f[order]] - 1, percent, PAIRED)
                    p = n - int(needed(np.int64(n), percent)) + asked
                    rows.append((s[order[:p]], np.repeat(lo, p), n, asked))
                if rows:
                    sizes = [len(r[0]) for r in rows]
                    columns = [np.concatenate([r[0] for r in rows]).view(np.int64), np.concatenate([r[1] for r in rows]).view(np.int64), np.repeat([r[2] for r in rows], sizes).astype(np.int32), np.repeat([r[3] for r in rows], sizes).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "lo", "n", "asked"])

    return run, "shingle long, lo long, n int, asked int"


def _ties(percent: int):
    """From rows sorted by shingle and set: the pairs of each short list, and a star of each long one.

    A pair comes with how many shared shingles it takes, a tie of a long list with 0. Only a list of up to
    PAIRED sets is held; of a longer one just its first set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        star: tuple[int, int] | None = None  # the shingle of a long list and its first set

        def ready(cols: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal star
            shingle, lo, n, asked = cols
            start = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]])) if len(lo) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(lo)))
            size_of, first = np.repeat(size, size), np.repeat(start, size)
            out: list[tuple] = []
            in_star = np.zeros(len(lo), bool)
            if star is not None and len(start) and shingle[0] == star[0]:
                in_star[: size[0]] = True
            if in_star.any():
                out.append((np.full(int(in_star.sum()), star[1]), lo[in_star], np.zeros(int(in_star.sum()), np.int64)))
            long_ = (size_of > PAIRED) & ~in_star
            if long_.any():
                out.append((lo[first[long_]], lo[long_], np.zeros(int(long_.sum()), np.int64)))
            at = np.flatnonzero((size_of > 1) & ~long_ & ~in_star)
            for gap in range(1, PAIRED):
                at = at[at + gap < first[at] + size_of[at]]
                if not len(at):
                    break
                a, b = at, at + gap
                small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                fits = 100 * small >= percent * large
                a, b = a[fits], b[fits]
                both = pair_needed(n[a], n[b], percent)
                bound = np.minimum(both - needed(n[a], percent) + asked[a], both - needed(n[b], percent) + asked[b])
                out.append((lo[a], lo[b], np.maximum(bound, 1)))
            if len(start) and size[-1] > PAIRED and not in_star[-1]:
                star = int(shingle[-1]), int(lo[start[-1]])
            cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v", "bound"])

        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy().astype(np.int64)]) for i, h in enumerate(held)]
            new = np.ones(len(held[0]), bool)
            new[1:] = (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])  # copies have the same set
            held = [h[new] for h in held]
            shingle = held[0]
            cut = int(np.searchsorted(shingle, shingle[-1])) if len(shingle) else 0
            if len(shingle) - cut > 4 * PAIRED:  # a long list: nothing of it but its first set has to stay
                cut = len(shingle)
            if cut:
                done, held = [h[:cut] for h in held], [h[cut:] for h in held]
                yield ready(done)
        yield ready(held)

    return run, "u long, v long, bound long"


def join_block(keys: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """The components of these sets under likeness: (key, smallest key of its component) for all others.

    Prefixes as above, with the frequencies among these sets; two sets that are already in one component
    are not compared.
    """
    m = len(keys)
    parent = list(range(m))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    size = np.array([len(s) for s in sets], np.int64)
    tokens, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(tokens), np.int64)
    place[np.lexsort((tokens, count))] = np.arange(len(tokens))
    frequency = np.sort(count) - 1
    ends = np.concatenate([[0], np.cumsum(size)])
    ranked = [np.sort(place[number[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    asked = np.array([matches_asked(frequency[r], percent) for r in ranked])
    lists: dict[int, list[int]] = {}
    marked = np.zeros(len(tokens), bool)
    for x in np.argsort(size, kind="stable").tolist():
        r, n = ranked[x], int(size[x])
        head = r[: n - int(needed(np.int64(n), percent)) + int(asked[x])]
        head = head[frequency[head] > 0].tolist()
        near: list[int] = []
        for t in head:
            near += lists.get(t, ())
        if near:
            others, shared = np.unique(near, return_counts=True)
            both = pair_needed(size[others], n, percent)
            bound = np.minimum(both - needed(size[others], percent) + asked[others], both - needed(np.int64(n), percent) + asked[x])
            fits = (100 * size[others] >= percent * n) & (shared >= bound)
            others = others[fits][np.argsort(-shared[fits], kind="stable")].tolist()
            marked[r] = True
            for y in others:
                a, b = find(x), find(y)
                if a != b:
                    common = int(np.count_nonzero(marked[ranked[y]]))
                    if 100 * common >= percent * (n + int(size[y]) - common):
                        parent[a] = b
            marked[r] = False
        for t in head:
            lists.setdefault(t, []).append(x)
    least: dict[int, int] = {}
    for x in range(m):
        root = find(x)
        least[root] = min(least.get(root, keys[x]), keys[x])
    return [(keys[x], least[find(x)]) for x in range(m) if keys[x] != least[find(x)]]


def _compare(k: int, percent: int):
    """From rows sorted by (root, i, j, set): the components within each block pair, as edges between the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        los: list[int] = []
        sets: list[np.ndarray] = []
        out: list[tuple[int, int]] = []
        for whole in batches:
            for batch in pieces(whole, "text"):
                at = list(zip(*[batch.column(c).to_pylist() for c in ("root", "i", "j")], strict=True))
                for g, lo, s in zip(at, batch.column("lo").to_pylist(), _sets(batch, k), strict=True):
                    if g != group:
                        out += join_block(los, sets, percent) if len(los) > 1 else []
                        group, los, sets = g, [], []
                    if los and los[-1] == lo:
                        continue  # a repeated row
                    los.append(lo)
                    sets.append(s)
                yield _edges(out)
                out = []
        out += join_block(los, sets, percent) if len(los) > 1 else []
        yield _edges(out)

    return run, "u long, v long"


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], ["u", "v"])


@sweeping
def ngram_components(docs: DataFrame, k: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text", tied: bool = True) -> DataFrame:
    """Return ``(key, a, n_shingles, root, component)`` for each row; documents link when 100 * intersection >= percent * union.

    Words are runs of bytes other than ASCII space, A-Z lower-cased; a set is the distinct runs of ``k``
    words, the whole text if it has fewer. Text that is null, empty or without words has no shingles and
    links with nothing. ``component`` is the smallest key that links reach, ``root`` a name of the
    component (null for an empty set), ``a`` a hash of the text. Empty table: no row.

    Rows of one doc_id are one document: each of its texts has a set of its own, and all have the one
    component that the links of any of them reach, unless ``tied`` is False, which leaves each text by
    itself. A null doc_id is no document that others reach: its rows have the key LAST, are not tied, and
    have the component LAST where they link with such rows only. Repeated rows each give a row.

    Equal sets are one class. Prefix shingles meet in lists: short ones give pairs, which must meet often
    enough, long ones a star; what they tie together is a cluster, whose texts move to one task, or, if it
    has over HELD shingles, to tasks that each compare two blocks of it, so that every pair of the cluster
    meets in one of them. Nothing is capped.
    """
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST)).alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.select("key", F.xxhash64("text").alias("a"), "text")
    survey, fields = _survey(k)
    surveyed = stored(rows.mapInArrow(survey, fields).repartition("to").sortWithinPartitions("to").mapInArrow(_counted, fields))
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(surveyed))

    members = surveyed.where("counts IS NULL").select("key", "a", "n", "hi", "lo")
    classes = members.where("n > 0").groupBy("hi", "lo").agg(F.min(F.struct("key", "a")).alias("rep"), F.first("n").alias("n"))
    classes = classes.select("hi", "lo", "rep.key", "rep.a", "n")

    lists = rows.mapInArrow(*_prefixes(k, percent, shared)).repartition("shingle").sortWithinPartitions("shingle", "lo")
    near = lists.mapInArrow(*_ties(percent)).groupBy("u", "v", "bound").count().where("count >= bound").select("u", "v")
    clusters = connected_components(near)
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    placed = checkpointed(clusters.join(classes, F.col("node") == F.col("lo")).select("key", "a", "lo", "n", "root"))
    blocks = placed.groupBy("root").agg(F.ceil(2 * F.sum("n") / HELD).cast("int").alias("blocks"))
    blocks = blocks.withColumn("blocks", F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks")))
    split = blocks.where("blocks > 1").limit(1).count() > 0
    dealt = placed.join(blocks, "root").select("key", "a", "lo", "root", "blocks", F.pmod(F.xxhash64("lo"), F.col("blocks")).cast("int").alias("b"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j")))
    dealt = dealt.select("key", "a", "lo", "root", F.explode(pairs).alias("at")).select("key", "a", "lo", "root", "at.i", "at.j")

    moved = rows.join(dealt.groupBy("key", "a").agg(F.collect_list(F.struct("root", "i", "j", "lo")).alias("to")).hint("shuffle_hash"), ["key", "a"])
    moved = moved.select("text", F.explode("to").alias("to")).select("to.root", "to.i", "to.j", "to.lo", "text")
    moved = moved.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "lo")
    links = stored(moved.mapInArrow(*_compare(k, percent)))
    several = _several(members) if tied else None
    if several is not None:
        own = members.where("n > 0").join(several, "key").groupBy("key", "lo").count()
        least = stored(own.groupBy("key").agg(F.min("lo").alias("v")))
        links = links.unionByName(own.join(least, "key").where("lo <> v").select(F.col("lo").alias("u"), "v"))
    if split or several is not None:
        links = connected_components(links).select(F.col("node").alias("u"), F.col("root").alias("v"))
    labels = links.groupBy("u").agg(F.min("v").alias("v"))

    classes = classes.join(labels.hint("shuffle_hash"), F.col("lo") == F.col("u"), "left").select("hi", "lo", "key", F.coalesce("v", "lo").alias("root"))
    least = stored(classes.groupBy("root").agg(F.min("key").alias("component"), F.count(F.lit(1)).alias("sets")).where("sets > 1").select("root", "component"))
    classes = classes.join(least, "root", "left").select("hi", "lo", "root", F.coalesce("component", "key").alias("component"))
    out = members.join(classes, ["hi", "lo"], "left").withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")))
    if several is not None:
        least = stored(out.join(several, "key").groupBy("key").agg(F.min("component").alias("least")))
        out = out.join(least, "key", "left").withColumn("component", F.coalesce("least", "component"))
    return out.select("key", "a", F.col("n").alias("n_shingles"), "root", "component")


def _several(members: DataFrame) -> DataFrame | None:
    """The doc_ids that have more than one set."""
    found = stored(members.where(F.col("key") < LAST).groupBy("key").agg(F.min("lo").alias("one"), F.max("lo").alias("other")).where("one <> other").select("key"))
    return found if found.limit(1).count() else None


def digests(docs: DataFrame) -> DataFrame:
    """What the query returns for each row of documents; component_id is null where only null doc_ids are reached."""
    none = F.lit(LAST)
    return ngram_components(docs).select(F.nullif("key", none).alias("doc_id"), "n_shingles", F.nullif("component", none).alias("component_id"))


@sweeping
def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, unchanged: that of the smallest doc_id (null last), of several texts the one with the least hash.

    Rows without words link with nothing and stay. Different texts of one doc_id are told apart; of rows
    with equal doc_id and text one stays.
    """
    found = stored(ngram_components(docs, k, percent, tied=False))
    empty = F.col("root").isNull()
    chosen = found.groupBy(F.coalesce("root", F.lit(0)).alias("r"), F.when(empty, F.struct("key", "a")).alias("e")).agg(F.min(F.struct("key", "a")).alias("own"))
    chosen = stored(chosen.select("own.key", "own.a", F.col("e").isNotNull().alias("empty")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("a"))
    kept = keyed.join(chosen, ["key", "a"])
    if found.where(~empty).groupBy("key", "a").count().where("count > 1").limit(1).count():
        kept = kept.where("empty").unionByName(kept.where("NOT empty").dropDuplicates(["key", "a"]))
    return kept.select("row.*")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.x = w.doc_id
"""
