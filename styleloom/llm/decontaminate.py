"""Benchmark decontamination: texts become templates, in which typed placeholders stand for numbers, units and names;
windows of templates are joined by hash, and the slots of what meets must map consistently."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, LOWER, U, kept_ready, mix, pieces, rolled, span_hash, stored, texts_of

#: Tokens of a window, and the share of an item's tokens that a document must hold to leak it.
WINDOW, COVERAGE = 8, 0.5
#: Tokens of an item in a row by which a document leaks it, whatever their share.
RUN = 20
#: Items of fewer tokens are no evidence where they stand in a longer text: only a text of nothing else leaks them.
LEAST = 4
#: Bits of the filter of window hashes: so many for each window of the benchmark, within these bounds (1 and 64 MB).
FILTER_SHARE, FILTER_LEAST, FILTER_MOST = 512, 23, 29
#: Words that are units where they follow a number.
UNITS = """mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers
mg g kg t oz lb lbs gram grams kilogram kilograms ton tons ounce ounces pound pounds ml l cl liter liters litre litres gallon gallons
ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years
percent dollar dollars cent cents euro euros usd eur gbp mph kmh kph hz khz mhz ghz w kw kwh j kj cal kcal v a degrees degree c f k
sekunden minuten stunden tage wochen monate jahre heures jours semaines mois ans horas dias semanas meses""".split()

LITERAL, NUMBER, UNIT, NAME = range(4)
SLOT = mix(np.arange(9001, 9005, dtype=U))
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, *range(0x80, 0x100)]] = True
_JOINT = np.zeros(256, bool)
_JOINT[[0x2C, 0x2E]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 13]] = True
#: Signs that tell numbers apart which stand on both sides of them.
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "+-*/=^<>%"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\"()[]-*#|>"]] = True


def _unit_hashes() -> np.ndarray:
    buf, off = texts_of(pa.array(UNITS, pa.large_string()))
    return np.sort(span_hash(rolled(buf), off[:-1], off[1:]))


_UNIT = _unit_hashes()


class Tokens:
    """The tokens of some texts: where each stands, its hash as a template, its kind, the bounds of the texts, and
    its hash where a token of the window stands before it."""

    def __init__(self, start: np.ndarray, end: np.ndarray, code: np.ndarray, kind: np.ndarray, bounds: np.ndarray, inner: np.ndarray | None = None):
        self.start, self.end, self.code, self.kind, self.bounds = start, end, code, kind, bounds
        self.inner = code if inner is None else inner


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[Tokens, Tokens, Tokens, Tokens, np.ndarray]:
    """The verbatim tokens (no slots), the plain ones (numbers and units are slots), two readings of template tokens
    (runs of names too), the prefix sums that ``span_hash`` takes for the folded bytes.

    A token is a run of letters or a number (digits, with a point or comma between digits). Case is folded
    for ASCII and Latin-1. A name is a capitalised token; names that follow each other make one slot. One
    that begins the text or follows the end of a sentence or line may be any word: in the first reading it
    is literal, in the second a name, which begins a slot of its own. Verbatim numbers that follow each
    other go with the signs of arithmetic between them.
    """
    low = LOWER[buf]
    n = len(buf)
    if n > 1:
        second = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        low[1:][second] += 0x20
    head = np.zeros(n + 1, bool)
    head[off] = True
    digit, alpha = _DIGIT[buf], _ALPHA[buf]
    if n > 2:
        digit[1:-1] |= _JOINT[buf[1:-1]] & digit[:-2] & _DIGIT[buf[2:]] & ~head[1:-2] & ~head[2:-1]
    kind = digit.astype(np.int8) + 2 * alpha.astype(np.int8)
    change = np.ones(n + 1, bool)
    if n:
        change[1:n] = kind[1:] != kind[:-1]
    change |= head
    edge = np.flatnonzero(change)
    start, end = edge[:-1], edge[1:]
    word = kind[start] > 0
    start, end = start[word], end[word]
    number = kind[start] == 1
    sums = rolled(low)
    code = span_hash(sums, start, end)
    bounds = np.searchsorted(start, off)
    first = np.zeros(len(start), bool)
    first[bounds[:-1][bounds[:-1] < len(start)]] = True
    after_number = np.zeros(len(start), bool)
    after_number[1:] = number[:-1]
    after_number &= ~first & ~number
    unit = after_number & (_UNIT[np.minimum(np.searchsorted(_UNIT, code), len(_UNIT) - 1)] == code)
    upper = (buf[start] >= 0x41) & (buf[start] <= 0x5A)
    two = np.minimum(start + 1, max(n - 1, 0))
    upper |= (buf[start] == 0xC3) & (buf[two] >= 0x80) & (buf[two] <= 0x9E) & (buf[two] != 0x97)
    solid = np.maximum.accumulate(np.where(_BLANK[buf], -1, np.arange(n))) if n else np.zeros(0, np.int64)
    before = np.where(start > 0, solid[np.maximum(start - 1, 0)], -1) if len(start) else start
    text_of = np.searchsorted(off, start, "right") - 1
    begins = before < off[text_of]
    opens = begins | _STOP[buf[np.maximum(before, 0)]]
    kinds = np.where(number, NUMBER, np.where(unit, UNIT, LITERAL))
    plain = Tokens(start, end, np.where(kinds == LITERAL, code, SLOT[kinds]), kinds, bounds)

    def template(name: np.ndarray, apart: np.ndarray) -> Tokens:
        keep = np.ones(len(start), bool)
        keep[1:] = ~(name[1:] & name[:-1]) | apart[1:]
        at = np.flatnonzero(keep)
        last = np.append(at[1:], len(start)) - 1
        own = np.where(name, NAME, kinds)[at]
        return Tokens(start[at], end[last] if len(at) else end, np.where(own == LITERAL, code[at], SLOT[own]), own, np.searchsorted(at, bounds))

    signs = np.concatenate([np.zeros(1, U), np.cumsum(np.where(_SIGN[buf], BYTE_CODE[buf], U(0)), dtype=U)])
    inner = code.copy()
    follows = 1 + np.flatnonzero(number[1:] & number[:-1] & ~first[1:])
    inner[follows] = mix(code[follows] + signs[start[follows]] - signs[end[follows - 1]])
    verbatim = Tokens(start, end, code, np.zeros(len(start), np.int64), bounds, inner)
    capital = upper & ~number
    return verbatim, plain, template(capital & ~opens, first), template(capital, first | opens), sums


def windows(t: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and hash of each window of k tokens in one text; with slots, half at least are literal."""
    n = len(t.code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = np.full(n, U(k))
    for i in range(k):
        h = (h + (t.inner if i else t.code)[i : i + n]) * U(0xD6E8FEB86659FD93 + 2 * i)
        h ^= h >> U(32)
    literal = np.concatenate([[0], np.cumsum(t.kind == LITERAL)])
    ok = 2 * (literal[k:] - literal[:-k]) >= k
    inner = t.bounds[1:-1]
    for i in range(1, k):
        at = inner - i
        ok[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(ok)
    return at, h[at]


STREAMS = 4  # of ``tokens``; the first is verbatim
_COLUMNS = [("stream", pa.int8()), ("size", pa.int8()), ("h", pa.int64()), ("owner", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("kinds", pa.binary()), ("slots", pa.binary())]
_WINDOWS = "stream byte, size byte, h long, owner long, at int, n int, kinds binary, slots binary"


def cut(t: Tokens, stream: int, size: int, sums: np.ndarray, owner: np.ndarray, chosen=None) -> pa.RecordBatch:
    """Rows of _COLUMNS for the windows of one size: hash, text (by ``owner``), first token, tokens of the text, kinds, and hashes of what fills the slots.

    A window of fewer than LEAST tokens counts where it is the whole text. ``chosen`` says which hashes are wanted.
    """
    at, h = windows(t, size)
    text = np.searchsorted(t.bounds, at, "right") - 1
    many = np.diff(t.bounds)
    keep = np.ones(len(at), bool) if chosen is None else chosen(h)
    if size < LEAST:
        keep &= many[text] == size
    at, h, text = at[keep], h[keep], text[keep]
    wide = at[:, None] + np.arange(size)
    kinds = t.kind[wide].astype(np.uint8).reshape(-1, size)
    slots = np.where(kinds == LITERAL, U(0), span_hash(sums, t.start[wide], t.end[wide]) if len(at) else U(0)).astype(U)
    none = np.full(len(at), stream, np.int8), np.full(len(at), size, np.int8)
    columns = [*none, h.view(np.int64), owner[text], (at - t.bounds[text]).astype(np.int32), many[text].astype(np.int32), [k.tobytes() for k in kinds], [x.tobytes() for x in slots] if stream else [b""] * len(at)]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _COLUMNS, strict=True)], schema=pa.schema(_COLUMNS))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of items: WINDOW tokens, or the whole of a shorter item."""
    for whole in batches:
        for batch in pieces(whole, "text"):
            buf, off = texts_of(batch.column("text"))
            owner = batch.column("owner").to_numpy()
            *streams, sums = tokens(buf, off)
            for k, t in enumerate(streams):
                many = np.minimum(np.diff(t.bounds), WINDOW)
                for size in np.unique(many[many > (0 if k == 0 else LEAST - 1)]).tolist():
                    own = cut(t, k, size, sums, owner)
                    yield own if size == WINDOW else own.filter(pa.array(own.column("n").to_numpy() == size))


class Filter:
    """A set of hashes as bits, two for each: all that were put in are found, and a few others."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(1 << bits - 3, np.uint8) if data is None else data

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return h >> U(64 - self.bits), (h * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)

    def put(self, h: np.ndarray) -> None:
        for place in self._places(h):
            np.bitwise_or.at(self.data, (place >> U(3)).astype(np.int64), np.uint8(1) << (place & U(7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        one, two = self._places(h)
        out = (self.data[(one >> U(3)).astype(np.int64)] >> (one & U(7)).astype(np.uint8)) & 1 == 1
        near = np.flatnonzero(out)
        out[near] = (self.data[(two[near] >> U(3)).astype(np.int64)] >> (two[near] & U(7)).astype(np.uint8)) & 1 == 1
        return out


def filter_of(wanted: DataFrame) -> tuple[Filter, list[tuple[int, int]]]:
    """The filter of the hashes of these windows, and which streams and sizes there are (32 at most).

    Its size is bounded by FILTER_MOST: the parts are joined on the executors, by blocks, before the driver reads them.
    """
    kinds = wanted.groupBy("stream", "size").agg(F.count(F.lit(1)).alias("n")).collect()
    bits = max(FILTER_LEAST, min(FILTER_MOST, (FILTER_SHARE * sum(r["n"] for r in kinds)).bit_length()))
    block = 1 << 20

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(bits)
        for batch in batches:
            own.put(batch.column("h").to_numpy().view(U))
        used = [b for b in range(len(own.data) // block) if own.data[b * block : (b + 1) * block].any()]
        for b in used:
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([own.data[b * block : (b + 1) * block].tobytes()], pa.binary())], ["block", "data"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                held[b] = held.get(b, 0) | np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "data"])

    out = Filter(bits)
    schema = "block int, data binary"
    for r in wanted.select("h").mapInArrow(parts, schema).repartition("block").mapInArrow(joined, schema).collect():
        out.data[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["data"], np.uint8)
    return out, sorted((r["stream"], r["size"]) for r in kinds)


def _candidates(shared: Broadcast, key: int):
    """The windows of texts that pass the filter, with both hashes of the text; a text is read once by a task, however often it comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kinds = kept_ready(("decontaminate", key), lambda: shared.value)
        done: set[tuple[int, int]] = set()  # forgotten now and then
        for whole in batches:
            a, b = (whole.column(c).to_pylist() for c in "ab")
            new = []
            for own in zip(a, b, strict=True):
                new.append(own not in done)
                done.add(own)
            if len(done) > 100_000:
                done.clear()
            for batch in pieces(whole.filter(pa.array(new, pa.bool_())), "text"):
                *streams, sums = tokens(*texts_of(batch.column("text")))
                for k, size in kinds:
                    own = cut(streams[k], k, size, sums, np.arange(batch.num_rows), seen.has)
                    if own.num_rows:
                        row = own.column("owner")
                        yield pa.RecordBatch.from_arrays([batch.column("a").take(row), batch.column("b").take(row), *[own.column(c) for c in ("stream", "size", "h", "at", "slots")]], ["a", "b", "stream", "size", "h", "at", "slots"])

    return run, "a long, b long, stream byte, size byte, h long, at int, slots binary"


def shares(rows: list[tuple]) -> tuple[float, bool, int]:
    """From all meetings of one text and one item, (stream, size, shift, i, n, kinds, item's slots, text's slots): the
    largest share of the item's tokens that a stream holds, whether slots hold other values there, and the longest run.

    Windows of one shift belong to one place. Slots of one kind must map one to one there: equal values of
    the item to equal values of the text, and different ones to different ones; a window with a slot that
    contradicts an earlier one doesn't count.
    """
    best, most = (0.0, False), 0
    for _, of_stream in groupby(sorted(rows, key=lambda r: r[:4]), key=lambda r: r[0]):
        held, other, longest, n = set(), False, 0, 1
        for _, place in groupby(of_stream, key=lambda r: r[1:3]):
            place = list(place)
            n = place[0][4]
            kept, changed = _consistent(place)
            held |= kept
            other |= changed
            longest = max(longest, _longest(kept))
        best = max(best, (len(held) / n, other), key=lambda x: x[0])
        most = max(most, longest)
    return *best, most


def _consistent(place: list[tuple]) -> tuple[set[int], bool]:
    """The item's positions that the windows at one place hold, and whether any slot holds another value."""
    there: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], int] = {}
    slots: dict[int, tuple[int, int, int]] = {}
    for _, size, _, i, _, kinds, mine, its in place:
        if mine:
            for o, (kind, x, y) in enumerate(zip(kinds, np.frombuffer(mine, U).tolist(), np.frombuffer(its, U).tolist(), strict=True)):
                if kind != LITERAL:
                    slots[i + o] = kind, x, y
    wrong, other = set(), set()
    for p in sorted(slots):
        kind, x, y = slots[p]
        if there.setdefault((kind, x), y) != y or back.setdefault((kind, y), x) != x:
            wrong.add(p)
        elif x != y:
            other.add(p)
    kept = {p for _, size, _, i, *_ in place if wrong.isdisjoint(range(i, i + size)) for p in range(i, i + size)}
    return kept, not other.isdisjoint(kept)


def _longest(places: set[int]) -> int:
    """The length of the longest run of places."""
    at = np.sort(np.fromiter(places, np.int64, len(places)))
    ends = np.flatnonzero(np.diff(at) != 1)
    return int(np.diff(np.concatenate([[-1], ends, [len(at) - 1]])).max()) if len(at) else 0


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From meetings sorted by text and item: the pairs in which the text leaks the item. One pair is held at a time."""
    group, held = None, []
    names = ["stream", "size", "shift", "i", "n", "kinds", "mine", "its"]

    def told(out: list[tuple]) -> None:
        share, changed, longest = shares(held)
        if share >= COVERAGE or longest >= RUN:
            out.append((*group, share, changed))

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [("a", pa.int64()), ("b", pa.int64()), ("owner", pa.int64()), ("share", pa.float64()), ("changed", pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, (_, kind) in enumerate(kinds)], [c for c, _ in kinds])

    for batch in batches:
        out: list[tuple] = []
        for own, row in zip(zip(*[batch.column(c).to_pylist() for c in ("a", "b", "owner")], strict=True), zip(*[batch.column(c).to_pylist() for c in names], strict=True), strict=True):
            if own != group:
                if held:
                    told(out)
                group, held = own, []
            held.append(row)
        yield rows(out)
    out = []
    if held:
        told(out)
    yield rows(out)


def _named(docs: DataFrame, text: str) -> DataFrame:
    """The texts under two hashes, by which equal ones are one; null and empty texts are left out."""
    body = F.col(f"`{text}`")
    return docs.where(F.octet_length(body) > 0).select(F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b"), body.alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Return ``(a, b, item_id, share, changed)``: which items the texts hold, the texts under their two hashes.

    Null or empty text holds none, nor does a null or empty item. Equal texts are one, and so are equal
    items, which are all reported. An empty table on either side gives no row.

    Windows of the items make a filter of bounded size, which is broadcast; windows of the texts that pass
    it (those of the benchmark, and few others) are joined with the items' windows on their hash, and the
    meetings of each pair are judged together. Nothing else is collected, and nothing depends on how large
    the benchmark is but the share of windows that pass for nothing.
    """
    sc = docs.sparkSession.sparkContext
    items = benchmark.where(F.octet_length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("owner"), "text")
    wanted = stored(items.dropDuplicates(["owner"]).select("owner", "text").mapInArrow(_item_windows, _WINDOWS))
    seen, kinds = filter_of(wanted)
    shared = sc.broadcast((seen, kinds))
    run, schema = _candidates(shared, shared._jbroadcast.id())
    met = _named(docs, text).mapInArrow(run, schema).groupBy("a", "b", "stream", "size", "h", "at").agg(F.first("slots").alias("its"))
    met = met.join(wanted.withColumnsRenamed({"at": "i", "slots": "mine"}), ["stream", "size", "h"])
    met = met.select("a", "b", "owner", "stream", "size", (F.col("at") - F.col("i")).alias("shift"), "i", "n", "kinds", "mine", "its")
    pairs = met.repartition("a", "b", "owner").sortWithinPartitions("a", "b", "owner").mapInArrow(_judged, "a long, b long, owner long, share double, changed boolean")
    return stored(pairs.join(items.select("item_id", "owner"), "owner").select("a", "b", "item_id", "share", "changed"))


def leaked_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What the query returns: a row for each row of documents and item that it leaks."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    found = rows.join(leaks(docs, benchmark), ["a", "b"])
    return found.select("doc_id", "item_id", "share", F.when(F.col("changed"), "re-parameterised").otherwise("verbatim").alias("kind"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows that leak no item, unchanged; rows of null text stay."""
    found = stored(leaks(docs, benchmark, text).select("a", "b").distinct())
    body = F.col(f"`{text}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b"))
    return rows.join(found, ["a", "b"], "left_anti").select("row.*")
