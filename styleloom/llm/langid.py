"""Language identification by partial matching: for each language a byte context tree of order three with
escape probabilities; a text goes to the language whose frozen statistics give it the shortest code."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, kept_ready, pieces, texts_of

#: Labelled rows that the trees are fitted on, for each language.
ROWS_PER_LANGUAGE = 400
#: Strings that the trees of all languages may hold together: some 200 MB in a worker. More are an error.
MOST_STRINGS = 1 << 24
#: Up to so many labels their counts are broadcast; more are joined by a shuffle.
FEW_LABELS = 100_000
#: Bytes of a longer text that are scored at once.
SLICE = 1 << 18
ORDER = 3
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _fold_table() -> np.ndarray:
    """ASCII letters lower-cased; every other ASCII byte is a space; bytes of other characters stay."""
    t = np.full(256, 0x20, np.uint8)
    t[0x61:0x7B] = t[0x41:0x5B] = np.arange(0x61, 0x7B)
    t[0x80:] = np.arange(0x80, 0x100)
    return t


_FOLD = _fold_table()


def folded(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that are scored, with new offsets: folded, each run of spaces one space, each text led by one.

    Capitals of the Latin-1 block (C3 80 to C3 9E) are lower-cased as well.
    """
    x = _FOLD[buf]
    if len(x) > 1:
        second = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)
        x[1:][second] += 0x20
    lead = np.zeros(len(x) + 1, bool)
    lead[off[:-1]] = True
    lead = lead[:-1]
    blank = x == 0x20
    keep = ~blank
    if len(x) > 1:
        keep[1:] |= ~blank[:-1]
    keep[lead & blank] = False
    # each text gets a leading space: its contexts never reach into the text before
    sizes = np.add.reduceat(np.append(keep, False).astype(np.int64), off[:-1]) * (np.diff(off) > 0) if len(off) > 1 else np.zeros(0, np.int64)
    new = np.concatenate([[0], np.cumsum(sizes + ORDER)])
    out = np.full(int(new[-1]), 0x20, np.uint8)
    body = np.ones(len(out), bool)
    for i in range(ORDER):
        body[new[:-1] + i] = False
    out[body] = x[keep]
    return out, new


def _contexts(x: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the four bytes that end at each scored position, and the bounds of the texts among them."""
    wide = x.astype(np.uint32)
    code = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:] if len(x) > 3 else np.zeros(0, np.uint32)
    keep = np.ones(len(code), bool)
    for i in range(ORDER):  # windows that would start in one text and end in the next
        at = new[1:-1] - 1 - i
        keep[at[at >= 0]] = False
    bounds = new - ORDER * np.arange(len(new))
    return code[keep], bounds


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n) of the four-byte strings of each batch."""
    for whole in batches:
        langs = np.array(whole.column("lang").to_pylist(), object)
        for lang in dict.fromkeys(langs.tolist()):
            rows = whole.filter(pa.array(langs == lang))
            for batch in pieces(rows, "text"):
                codes, _ = _contexts(*folded(*texts_of(batch.column("text"))))
                u, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])


class Tree:
    """The contexts of one language: for each order the strings (context and byte) that it has seen, with the bits of
    the byte, and the contexts with the bits of an escape.

    The estimate of a byte after a context is n / (N + D) where the context has seen it n times among N bytes of D
    kinds, else the escape D / (N + D) times the estimate after the context without its oldest byte; a context that
    was not seen costs nothing, and below the empty context all 256 bytes are equal. No byte is excluded after an
    escape, so the estimates of a context add up to one at most: code lengths are exact for this formula, not minimal.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.orders = []
        for order in range(ORDER, -1, -1):
            strings, at = np.unique(codes & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            n = np.bincount(at, counts)
            contexts, of = np.unique(strings >> np.uint32(8), return_inverse=True)
            kinds = np.bincount(of)
            whole = np.bincount(of, n) + kinds
            self.orders.append((strings, np.log2(whole[of] / n).astype(np.float32), contexts, np.log2(whole / kinds).astype(np.float32)))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """The bits of the last byte of each of these four-byte strings after the others."""
        out = np.zeros(len(codes) + 1, np.float32)
        todo = np.arange(len(codes))
        for order, (strings, bits, contexts, escapes) in zip(range(ORDER, -1, -1), self.orders, strict=True):
            own = codes[todo] & np.uint32((1 << 8 * (order + 1)) - 1)
            at, seen = _found(strings, own)
            out[todo[seen]] += bits[at[seen]]
            todo, own = todo[~seen], own[~seen] >> np.uint32(8)
            at, seen = _found(contexts, own)
            out[todo[seen]] += escapes[at[seen]]
        out[todo] += 8
        return out


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    """For each language the four-byte strings of its sample and how often each stands there."""

    def __init__(self, langs: list[str], strings: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, self.strings = langs, strings
        self.key = hashlib.sha256(repr(langs).encode() + b"".join(c.tobytes() + n.tobytes() for c, n in strings)).hexdigest()

    @cached_property
    def trees(self) -> list[Tree]:
        return [Tree(c, n) for c, n in self.strings]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "trees"}


def _sliced(buf: np.ndarray) -> Iterator[np.ndarray]:
    """The codes of one text, SLICE bytes at a time; no slice ends within a capital of two bytes."""
    last = np.full(ORDER, 0x20, np.uint8)
    a = 0
    while a < len(buf):
        b = min(a + SLICE, len(buf))
        b += b < len(buf) and buf[b - 1] == 0xC3
        part, _ = folded(buf[a:b], np.array([0, b - a]))
        between = part[:1] if last[-1] != 0x20 and _FOLD[buf[a]] == 0x20 else part[:0]
        x = np.concatenate([last, between, part[ORDER:]])
        yield _contexts(x, np.array([0, len(x)]))[0]
        last = x[-ORDER:]
        a = b


def code_lengths(model: Model, column: pa.Array) -> np.ndarray:
    """Bits of each text under each language."""
    buf, off = texts_of(column)
    if len(off) == 2 and len(buf) > SLICE:
        return sum(_lengths(model, codes, np.array([0, len(codes)])) for codes in _sliced(buf))
    return _lengths(model, *_contexts(*folded(buf, off)))


def _lengths(model: Model, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bounds) - 1, len(model.langs)))
    full = np.diff(bounds) > 0
    if full.any():
        distinct, at = np.unique(codes, return_inverse=True)
        for k, tree in enumerate(model.trees):
            out[full, k] = np.add.reduceat(tree.bits(distinct)[at], bounds[:-1][full], dtype=np.float64)
    return out


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on ``(id, lang, text)``: about ``rows_per_language`` rows of every label.

    The sample is bounded by this parameter: rows are chosen by a hash of id, whole texts are counted on
    the executors, and the driver gets one number for each label and distinct four-byte string. Over
    MOST_STRINGS of them raise ValueError: fewer rows of each label, or fewer labels, have to be asked for.
    Rows with null label or text are left out. No row: a model without languages.
    """
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    rows = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    if rows.count() <= FEW_LABELS:
        rows = F.broadcast(rows)
    share = F.shiftrightunsigned(F.xxhash64("id"), 1) / F.lit(float(2**63)) * F.col("rows")
    sample = labelled.join(rows, "lang").where(share <= rows_per_language).select("lang", "text")
    got = checkpointed(sample.mapInArrow(_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")))
    if (size := got.count()) > MOST_STRINGS:
        raise ValueError(f"the trees would hold {size} strings, over the limit of {MOST_STRINGS}")
    table = got.orderBy("lang", "code").toArrow()
    lang, code, n = (table.column(i).to_numpy() for i in range(3))
    langs = sorted(set(lang.tolist()))
    own = [lang == x for x in langs]
    return Model(langs, [(code[k].astype(np.uint32), n[k].astype(np.int64)) for k in own])


def has_letter(model: Model, texts: pa.Array) -> np.ndarray:
    """Whether each text gets a language: it has a letter, and some language was learned."""
    return np.array([bool(model.langs and (t := x.as_py()) and _LETTER.search(t)) for x in texts], bool)


def predict(docs: DataFrame, model: Model, keep: Column, text: Column) -> DataFrame:
    """Return ``(row, lang_pred, score)`` for each row; ``row`` is what the struct ``keep`` carries along.

    The prediction sees ``text`` only. ``score`` is the posterior of the winner if all learned languages
    were as likely before, from 0 to 1. Text that is null or has no letter, and every text if nothing was
    learned, gives ``und`` with score 0; ties go to the first label in order. Empty table: no row.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), model.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept_ready(("langid", key), lambda: shared.value)
        for whole in batches:
            for batch in pieces(whole, "text", SLICE):
                texts = batch.column("text")
                letters = has_letter(model, texts)
                names, score = np.full(len(letters), UNDETERMINED, object), np.zeros(len(letters))
                if letters.any():
                    bits = code_lengths(model, texts)
                    names[letters] = np.array(model.langs, object)[bits.argmin(1)][letters]
                    score[letters] = (1 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1))[letters]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names.tolist(), pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    packed = docs.select(keep.alias("row"), text.alias("text"))
    kind = packed.schema["row"].dataType
    schema = T.StructType([T.StructField("row", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return packed.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learned(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out()).select(F.col("doc_id").alias("id"), "lang", "text"))


def predictions(docs: DataFrame) -> DataFrame:
    """What the query returns for each row: doc_id, held_out, lang_pred, score. Repeated rows stay."""
    out = predict(docs, learned(docs), F.struct(F.col("doc_id"), held_out().alias("held_out")), F.col("text"))
    return out.select("row.doc_id", "row.held_out", "lang_pred", "score")


def recognised(docs: DataFrame) -> DataFrame:
    """The rows whose text is in a language (not ``und``), unchanged: those that ``predict`` gives a learned label."""
    model = learned(docs)
    shared, key = docs.sparkSession.sparkContext.broadcast(model), model.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept_ready(("langid", key), lambda: shared.value)
        for whole in batches:
            for batch in pieces(whole, "text", SLICE):
                letters = has_letter(model, batch.column("text"))
                if letters.any():
                    bits = code_lengths(model, batch.column("text"))
                    names = np.array(model.langs, object)[bits.argmin(1)]
                    yield batch.filter(pa.array(letters & (names != UNDETERMINED)))

    return docs.mapInArrow(run, docs.schema)
