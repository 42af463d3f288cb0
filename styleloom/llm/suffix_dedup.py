"""Removal of long repeated byte strings with suffix arrays that are built by a difference cover.

A window is a string of LENGTH bytes. Each window is dealt by its content: it goes with the least hash of its
GRAM-byte strings, so that equal windows always meet. Where such a hash occurs once in the corpus, its windows
cannot repeat. The others meet in buckets, whose suffixes are sorted by the difference cover modulo three: sampled
triples are sorted and named, the names are sorted by recursion, the remaining suffixes are merged in, and adjacent
suffixes are compared over a window. The windows of a hash that occurs very often are dealt one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_KEY, U, mix, pieces, powers, rolled, span_hash, stored, texts_of

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1  # GRAM-byte strings of a window
#: Levels of names after which 3**levels bytes or more are told apart: more than a window.
LEVELS = 5
#: Bytes that one suffix array is built over, and occurrences beyond which the windows of a hash are dealt by their own hashes.
TOGETHER, HOT = 1 << 20, 4096
#: Windows that are compared at a time.
NEAR = 4096
#: Contexts that a task remembers, so as not to deal equal ones again.
REMEMBERED = 100_000


def least_grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hash that the windows go with, the first window that does, how many do in a row, and their text."""
    n = len(buf) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, U),) + (np.zeros(0, np.int64),) * 3
    c = rolled(buf)
    h = mix((c[GRAM:] - c[:-GRAM]) * powers(len(c))[1][: len(c) - GRAM])
    # sliding minima of the upper half of the hash with the place below it: of equal ones the leftmost
    packed = np.full(-(-len(h) // SPAN) * SPAN, 2**64 - 1, U)
    packed[: len(h)] = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)
    tiles = packed.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(tiles, axis=1).ravel()
    least = np.minimum(ahead[:n], behind[SPAN - 1 : SPAN - 1 + n]) & U(0xFFFFFFFF)
    inside = np.zeros(n, bool)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= LENGTH:
            inside[a : b - LENGTH + 1] = True
    start = np.flatnonzero(inside)
    place = least[start].astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return h[place[first]], start[first], np.diff(np.append(first, len(start))), np.searchsorted(off, start[first], "right") - 1


def suffix_order(s: np.ndarray, levels: int) -> np.ndarray:
    """The suffixes of s (numbers from 1) in their order, told apart over 3**levels numbers at least."""
    n = len(s)
    k = int(s.max(initial=0)) + 1
    if n < 3 or (k >= 1 << 21 and n < 8):
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([s, np.zeros(6, np.int64)])
    s0, s1, s2, s3, s4 = (s[i::3] for i in range(5))
    n0, n1, n2 = (n + 2) // 3, len(range(1, n + (n % 3 == 1), 3)), n // 3
    parts = (s1[:n1], s2[:n1], s3[:n1]), (s2[:n2], s3[:n2], s4[:n2])
    key = np.concatenate([(a * k + b) * k + c for a, b, c in parts]) if k < 1 << 21 else _triple(*[np.concatenate(p) for p in zip(*parts, strict=True)])
    order, ranked = _sorted(key)
    new = np.ones(len(order), np.int64)
    new[1:] = ranked[1:] != ranked[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    if levels > 1 and names[order[-1]] < len(order):
        order = suffix_order(names, levels - 1)
    rank = np.empty(n1 + n2, np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    rank1, rank2 = np.zeros(n0 + 2, np.int64), np.zeros(n0 + 2, np.int64)
    rank1[:n1], rank2[:n2] = rank[:n1], rank[n1:]
    ones, twos = order[order < n1], order[order >= n1] - n1
    ones = ones[3 * ones + 1 < n]
    sorted_sample = np.where(order < n1, 3 * order + 1, 3 * (order - n1) + 2)
    sorted_sample = sorted_sample[sorted_sample < n]
    wide = n1 + n2 + 2
    by, key = _sorted(s0[:n0] * wide + rank1[:n0])
    zero = 3 * by
    before = np.searchsorted((s1[:n1] * wide + rank2[:n1])[ones], key)
    before += np.searchsorted(((s2[:n2] * k + s3[:n2]) * wide + rank1[1 : n2 + 1])[twos], ((s0[:n0] * k + s1[:n0]) * wide + rank2[:n0])[by])
    out = np.empty(n, np.int64)
    # suffixes that no level told apart may come in any order, which the searches need not agree on
    at = np.arange(len(zero)) + np.maximum.accumulate(before)
    rest = np.ones(n, bool)
    rest[at] = False
    out[at] = zero
    out[rest] = sorted_sample
    return out


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of these numbers from 0 and the numbers in it; small ones are sorted together with their places, which is faster."""
    bits = len(key).bit_length()
    if int(key.max(initial=0)) < 1 << 63 - bits:
        both = np.sort(key << bits | np.arange(len(key)))
        return both & (1 << bits) - 1, both >> bits
    order = np.argsort(key)
    return order, key[order]


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Numbers in the order of the triples (a, b, c)."""
    return _pair(_pair(a, b), c)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers in the order of the pairs (a, b)."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), np.int64)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new)
    return out


def first_windows(contexts: list[bytes], places: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs of windows (key, sub, start, length) that are the first among these contexts, by their places (key, sub, start)."""
    documents = sorted({p[:2] for p in places})
    number = {d: i for i, d in enumerate(documents)}
    keys, starts = np.array([number[p[:2]] for p in places], np.int64), np.array([p[2] for p in places], np.int64)
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"\0".join(contexts) + b"\0" * LENGTH, np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    s = text[: begin[-1] + sizes[-1]].astype(np.int64) + 1
    s[(begin[1:] - 1)] = 0  # between contexts; bytes count from 1
    order = suffix_order(s + 1, LEVELS)
    n_windows = sizes - LENGTH + 1
    owner = np.full(len(s), -1, np.int64)
    flat = np.repeat(begin - np.concatenate([[0], np.cumsum(n_windows)[:-1]]), n_windows) + np.arange(n_windows.sum())
    owner[flat] = np.repeat(np.arange(len(contexts)), n_windows)
    order = order[owner[order] >= 0]
    window = np.ndarray(len(s), f"V{LENGTH}", text, strides=(1,))
    new = np.ones(len(order), bool)
    for a in range(1, len(order), NEAR):  # so few that their windows stay in the cache
        part = window[order[a - 1 : a + NEAR]].view(np.uint32).reshape(-1, LENGTH // 4)
        new[a : a + NEAR] = (part[1:] != part[:-1]).any(axis=1)
    group = np.cumsum(new) - 1
    key, start = keys[owner[order]], (starts - begin)[owner[order]] + order
    by = np.lexsort((start, key, group))
    first = by[np.concatenate([[True], group[by][1:] != group[by][:-1]])]
    key, start = key[first], start[first]
    by = np.lexsort((start, key))
    key, start = key[by], start[by]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return [(*documents[k], s, n) for k, s, n in zip(key[at].tolist(), start[at].tolist(), np.diff(np.append(at, len(key))).tolist(), strict=True)]


#: Of a hash among the rows that are dealt together: it stands there once; it is the first of several; it is another of them.
ALONE, FIRST, OTHER = range(3)


#: Bits of a run: its state, how many windows it has, where it starts; for FIRST also how often the hash stands there.
STATE, COUNT, START = 2, 8, 32
MOST = (1 << 63 - STATE - COUNT - START) - 1
#: In the place of a run: the hash occurs more than HOT times.
MARK = -1


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, key, sub, run) of each run of windows; ``run`` holds where it starts, how many windows it has, and the state of its hash."""
    for batch in batches:
        parts = []
        for piece in pieces(batch, "text"):
            buf, off = texts_of(piece.column("text"))
            h, start, count, text = least_grams(buf, off)
            parts.append((h.view(np.int64), piece.column("key").to_numpy()[text], piece.column("sub").to_numpy()[text], (start - off[text]) << COUNT | count))
        h, key, sub, run = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in range(4))
        _, first, at, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        state = np.where(n[at] == 1, ALONE, OTHER)
        state[first[n > 1]] = FIRST
        run = run << STATE | state
        run[first[n > 1]] |= np.minimum(n[n > 1], MOST) << STATE + COUNT + START
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(key), pa.array(sub), pa.array(run)], ["h", "key", "sub", "run"])


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by hash: those whose hash occurs again, with a row MARK for a hash that occurs more than HOT times.

    One row is held at most, until the next hash comes.
    """
    held = [np.zeros(0, np.int64)] * 5
    told: int | None = None  # the last hash, if it is known to occur again, how often so far, and whether it is marked
    so_far, marked = 0, False
    for batch in batches:
        h, key, sub, run = (batch.column(c).to_numpy() for c in ("h", "key", "sub", "run"))
        state = run & 3
        new = [h, key, sub, run >> STATE & (1 << COUNT + START) - 1, np.where(state == FIRST, run >> STATE + COUNT + START, 1)]
        other = state == OTHER
        out = [[a[other] for a in new[:4]]]
        rows = [np.concatenate([a, b[~other]]) for a, b in zip(held, new, strict=True)]
        h, times = rows[0], rows[4]
        if len(h):
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(start, len(h)))
            total = np.add.reduceat(times, start)
            goes_on = told is not None and int(h[0]) == told
            if goes_on:
                total[0] += so_far
            hot = total > HOT
            fresh = hot.copy()
            fresh[0] &= not (goes_on and marked)
            mark = h[start[fresh]]
            out.append([mark, np.zeros_like(mark), np.zeros_like(mark), np.full_like(mark, MARK)])
            again = total > 1
            keep = np.repeat(again, size)
            out.append([a[keep] for a in rows[:4]])
            if again[-1]:
                held, told, so_far, marked = [a[:0] for a in rows], int(h[-1]), int(total[-1]), bool(hot[-1])
            else:
                held, told = [a[-1:] for a in rows], None
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(4)], ["h", "key", "sub", "run"])


_PLACE = [("key", pa.int64()), ("sub", pa.int64()), ("start", pa.int64())]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, other, key, sub, start, context) of each run of windows that goes with a hash that occurs again.

    The windows of a hash that occurs more than HOT times come one by one, without a context: ``h`` and
    ``other`` are then hashes of the window itself. Equal contexts and windows come once for a task that
    remembers them, and again at a smaller place. Copies of a text in an earlier document are never the
    first place of a window, so they give none.
    """
    schema = pa.schema([("h", pa.int64()), ("other", pa.int64()), *_PLACE, ("context", pa.binary())])
    seen: dict[tuple[int, int], tuple[int, int, int]] = {}
    for whole in batches:
        out: dict[tuple[int, int], tuple] = {}

        def give(name: tuple[int, int], place: tuple[int, int, int], row: tuple, out=out) -> None:
            if name not in seen or place < seen[name]:
                seen[name] = place
                out[name] = row

        texts = whole.column("text").cast(pa.large_binary())
        for key, sub, text, runs, copy in zip(whole.column("key").to_pylist(), whole.column("sub").to_pylist(), texts, whole.column("runs"), whole.column("copy").to_pylist(), strict=True):
            if copy or not runs.is_valid:
                continue
            data, parts = text.as_py(), runs.values
            hot = parts.field(2).to_numpy(zero_copy_only=False)
            hashes, spans = parts.field(0).to_numpy(), parts.field(1).to_numpy()
            for h, run in zip(hashes[~hot].tolist(), spans[~hot].tolist(), strict=True):
                a = run >> COUNT
                context = data[a : a + (run & 255) + LENGTH - 1]
                place = key, sub, a
                give((h, hash(context)), place, (h, 0, *place, context))
            if hot.any():
                a, n = spans[hot] >> COUNT, spans[hot] & 255
                start = np.unique(np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()))
                sums = rolled(np.frombuffer(data, np.uint8))
                one = span_hash(sums, start, start + LENGTH)
                two = span_hash(rolled(np.frombuffer(data, np.uint8) ^ 0xFF), start, start + LENGTH)
                for x, y, s in zip(one.view(np.int64).tolist(), two.view(np.int64).tolist(), start.tolist(), strict=True):
                    place = key, sub, s
                    give((x, y), place, (x, y, *place, None))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out.values()], kind) for i, kind in enumerate(schema.types)], schema=schema)
        if len(seen) > REMEMBERED:
            seen.clear()


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of _contexts sorted by h: the runs of windows (key, sub, start, n) that are the first of their content.

    A hash has HOT contexts at most; of a window by itself only the least place is held.
    """
    schema = pa.schema([*_PLACE, ("n", pa.int64())])

    def ready(groups: list[dict]) -> pa.RecordBatch:
        runs = [(*place, 1) for g in groups for c, place in g.items() if not isinstance(c, bytes)]
        held = [(c, place) for g in groups for c, place in g.items() if isinstance(c, bytes)]
        runs += first_windows([c for c, _ in held], [p for _, p in held]) if held else []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in runs], pa.int64()) for i in range(4)], schema=schema)

    done: list[dict] = []
    own: dict = {}
    size, now = 0, None
    for batch in batches:
        for h, other, key, sub, start, context in zip(*[batch.column(c).to_pylist() for c in ("h", "other", "key", "sub", "start", "context")], strict=True):
            if h != now:
                done.append(own)
                if size >= TOGETHER:
                    yield ready(done)
                    done, size = [], 0
                own, now = {}, h
            place = key, sub, start
            name = other if context is None else context
            if own.setdefault(name, place) is place:
                size += 100 if context is None else len(context)
            elif place < own[name]:
                own[name] = place
    yield ready([*done, own])


def removed_mask(n: int, runs: np.ndarray, firsts: list[tuple[int, int]]) -> np.ndarray:
    """Which of n bytes a repeated window covers: those of ``runs`` but for the first ones."""
    window = np.zeros(n + 1, np.int32)
    a, count = runs >> COUNT, runs & 255
    np.add.at(window, a, 1)
    np.add.at(window, a + count, -1)
    again = np.cumsum(window)[:n] > 0
    for s, size in firsts:
        again[s : s + size] = False
    s = np.flatnonzero(again)
    cover = np.zeros(n + 1, np.int32)
    cover[s] += 1
    np.add.at(cover, s + LENGTH, -1)
    return np.cumsum(cover)[:n] > 0


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            out: list[tuple] = []
            texts = batch.column("text").cast(pa.large_binary())
            for text, runs, firsts in zip(texts, batch.column("runs"), batch.column("firsts"), strict=True):
                data = text.as_py()
                if runs.is_valid:
                    gone = removed_mask(len(data), runs.values.field(1).to_numpy(), [(f["start"], f["n"]) for f in firsts.as_py() or ()])
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    out.append((len(data), len(data) - len(kept), len(edges) // 2, kept, edges.tolist()))
                else:
                    out.append((len(data), 0, 0, data, []))
            columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(3)]
            columns += [pa.array([hashlib.sha256(o[3]).hexdigest() for o in out], pa.string()), pa.array([o[4] for o in out], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "edges"])


def repeats(docs: DataFrame, keep: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return ``(row, n_bytes, n_removed, n_spans, kept_sha256, edges)`` for each row; ``row`` is the struct ``keep``.

    A byte is removed if a string of LENGTH bytes covers it that also starts earlier: in an earlier document, or
    before it in the same text. ``edges`` are the ends of the removed spans, in turn first and one past last.

    Documents follow each other by doc_id, null first. Different texts under one doc_id (null too) are documents
    of their own, in the order of a hash of the text; equal texts under one doc_id are one document, and each of
    its rows is returned with the same result. Null text counts as empty, and a text below LENGTH bytes keeps
    all. Empty table: no row.

    Shuffled are the hashes (one in 40 bytes or so), the texts once by their document, and the contexts of hashes
    that occur again (equal ones once for a task, of whole copies none). A hash that occurs more than HOT times
    has its windows dealt one by one, so that no bucket is too large for a task. The place of a text in the order
    of one doc_id is only formed where some doc_id is repeated.
    """
    rows = docs.select(keep.alias("row"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NULL_KEY)).alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    repeated = rows.groupBy("key").count().where("count > 1").limit(1).count() > 0
    rows = rows.withColumn("sub", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    own = ["key", "sub"]
    dealt = rows.select(*own, "text").mapInArrow(_dealt, "h long, key long, sub long, run long")
    anywhere = F.when(F.col("run").bitwiseAND(3) == OTHER, F.xxhash64("key", "run")).otherwise(F.col("h"))
    again = stored(dealt.repartition(anywhere).sortWithinPartitions("h").mapInArrow(_again, "h long, key long, sub long, run long"))
    often = stored(again.where(F.col("run") == MARK).select("h", F.lit(True).alias("hot")))
    again = again.where(F.col("run") != MARK)
    again = again.join(often, "h", "left") if often.limit(1).count() else again.withColumn("hot", F.lit(None).cast("boolean"))
    runs = again.groupBy(*own).agg(F.collect_set(F.struct("h", "run", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("runs"))

    same = rows.select(*own, F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    held = stored(same.groupBy("a", "b").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most"))
    copies = same.join(held, ["a", "b"]).where("key > least").groupBy(*own).agg(F.lit(True).alias("copy"))

    joined = rows.join(runs, own, "left").join(copies, own, "left")  # read twice, with the same columns: its exchanges are shared
    found = joined.select("row", *own, "text", "runs", "copy").mapInArrow(_contexts, "h long, other long, key long, sub long, start long, context binary")
    firsts = found.repartition("h").sortWithinPartitions("h").mapInArrow(_firsts, "key long, sub long, start long, n long")
    firsts = firsts.groupBy(*own).agg(F.collect_list(F.struct("start", "n")).alias("firsts"))

    spelled = joined.join(firsts, own, "left").select("row", "text", "runs", "copy", "firsts")
    fields = [T.StructField("row", rows.schema["row"].dataType), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType()), T.StructField("edges", T.ArrayType(T.LongType()))]
    return spelled.mapInArrow(_spelled, T.StructType(fields))


def digests(docs: DataFrame) -> DataFrame:
    """What the query returns for each row of documents."""
    return repeats(docs, F.struct("doc_id")).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
