"""Document fingerprints by consistent weighted sampling: words are the terms, their counts the weights, and two
signatures agree in a sample with a probability equal to the generalised Jaccard similarity of the two texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, U, mix, pieces, texts_of, words_of

SAMPLES = 64
#: Texts per range of ids, and the most ranges there are.
RANGE_ROWS, MOST_RANGES = 2000, 20_000
#: Characters of text that are handled together.
AT_ONCE = 1 << 20


def _uniform(terms: np.ndarray, stream: int, samples: int) -> np.ndarray:
    """A number in (0, 1) for each term and sample, fixed by both."""
    salt = mix(np.arange(samples, dtype=U) * U(8) + U(stream + 1))
    x = (terms[:, None] ^ salt[None, :]) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return ((x >> U(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


class Sampler:
    """The gamma variates of the terms of one batch: r and c from Gamma(2, 1) and an offset b from (0, 1)."""

    def __init__(self, terms: np.ndarray, samples: int):
        self.terms = terms
        self.r = -np.log(_uniform(terms, 0, samples) * _uniform(terms, 1, samples))
        self.b = _uniform(terms, 2, samples)
        c = -np.log(_uniform(terms, 3, samples) * _uniform(terms, 4, samples))
        # at weight 1 the level t is 0, so ln a = ln c - ln y - r with ln y = r * (t - b)
        self.log_c = np.log(c)
        self.at_one = self.log_c + self.r * (self.b - 1)

    def signature(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sixteen bits of the least (term, level) of each sample for a text with these terms and weights."""
        a = self.at_one[at]
        more = np.flatnonzero(weight > 1)
        level = np.zeros(0)
        if len(more):
            rows = at[more]
            r, b = self.r[rows], self.b[rows]
            level = np.floor(np.log(weight[more].astype(np.float32))[:, None] / r + b)
            a[more] = self.log_c[rows] - r * (level - b + 1)
        least = a.argmin(0)
        t = np.zeros(len(least), U)
        if len(more):
            where = np.searchsorted(more, least)
            has = (where < len(more)) & (more[np.minimum(where, len(more) - 1)] == least)
            t[has] = level[where[has], np.flatnonzero(has)].astype(np.int64).astype(U)
        return (mix(self.terms[at[least]] + t * U(0x9E3779B97F4A7C15)) >> U(48)).astype(np.uint16)


def signatures(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    """One row of ``samples`` numbers for each text; a text without words has the row of a term of its own."""
    buf, off = texts_of(pa.array(texts, pa.large_string()))
    words, _, count = words_of(buf, off)
    terms, at = np.unique(words, return_inverse=True)
    sampler = Sampler(terms, samples)
    out = np.zeros((len(texts), samples), np.uint16)
    stop = np.concatenate([[0], np.cumsum(count)]).tolist()
    for i, (a, b) in enumerate(zip(stop[:-1], stop[1:], strict=True)):
        if b > a:
            own, weight = np.unique(at[a:b], return_counts=True)
            out[i] = sampler.signature(own, weight)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of samples that agree: an estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def cuts_of(quantiles: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where ranges begin, as keys and ties: a key that stands several times is cut into as many equal parts of the ties."""
    keys, ties = [], []
    for key in dict.fromkeys(quantiles):
        n = quantiles.count(key)
        keys += [key] * n
        ties += [-(2**63) + (i << 64) // n for i in range(n)]
    return np.array(keys, np.int64), np.array(ties, np.int64)


def ranges(cuts: tuple[np.ndarray, np.ndarray], keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """The range of each (key, tie): how many cuts are not above it."""
    out = np.searchsorted(cuts[0], keys, "left")
    stop = np.searchsorted(cuts[0], keys, "right")
    for key in np.unique(keys[stop > out]):
        own = keys == key
        a, b = np.searchsorted(cuts[0], key, "left"), np.searchsorted(cuts[0], key, "right")
        out[own] = a + np.searchsorted(cuts[1][a:b], ties[own], "right")
    return out


def fingerprints(docs: DataFrame, samples: int = SAMPLES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    Documents follow each other by ascending doc_id (null first; equal ids by a hash of the text), the first
    follows the last. Null text counts as empty. Texts without words have equal fingerprints, unlike all others.
    A table of one row: the document follows itself. Empty table: no row.

    Ids are cut into ranges at quantiles, and an id that fills several ranges at the hash of the text, so that
    each task handles texts in order; the first text of each range is also dealt to the range before it.
    Texts are shuffled once. There are MOST_RANGES at most, beyond which ranges grow; a task streams its range.
    """
    key = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NULL_KEY))
    rows = docs.select(key.alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    wanted = min(MOST_RANGES, rows.count() // RANGE_ROWS + 1)
    steps = [k / wanted for k in range(1, wanted)]
    found = (rows.agg(F.percentile_approx("key", steps, 100_000)).first()[0] if steps else None) or []
    rows = rows.withColumn("tie", F.xxhash64("body"))
    cuts = cuts_of(sorted(found))

    @F.pandas_udf("int")
    def range_of(keys: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(ranges(cuts, keys.to_numpy(), ties.to_numpy()).astype(np.int32))

    first = {r[0]: tuple(r[1]) for r in rows.groupBy(range_of("key", "tie")).agg(F.min(F.struct("key", "tie"))).collect()}  # one row for each range
    present = sorted(first)
    before = {first[r]: present[i - 1] for i, r in enumerate(present)}

    @F.pandas_udf("array<struct<range:int,tail:boolean>>")
    def dealt_to(keys: pd.Series, ties: pd.Series) -> pd.Series:
        own = ranges(cuts, keys.to_numpy(), ties.to_numpy()).tolist()
        return pd.Series([[(r, False)] + ([(before[k], True)] if k in before else []) for r, k in zip(own, zip(keys.tolist(), ties.tolist(), strict=True), strict=True)], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for whole in batches:
            for batch in pieces(whole, "body", AT_ONCE):
                new = list(zip(*[batch.column(c).to_pylist() for c in ("range", "tail", "key", "body")], strict=True))
                held += new
                size += sum(len(x[3]) for x in new)
                if size >= AT_ONCE:
                    yield _signed(held, samples)
                    held, size = held[-1:], 0
        yield _signed(held, samples)

    dealt = rows.select(F.explode(dealt_to("key", "tie")).alias("to"), "key", "tie", "body").select("to.range", "to.tail", "key", "tie", "body")
    dealt = dealt.repartition("range").sortWithinPartitions("range", "tail", "key", "tie", "body")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _signed(rows: list[tuple], samples: int) -> pa.RecordBatch:
    """The results of all rows but the last of each run and the tails: each with the row that follows it."""
    pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i + 1][0] == rows[i][0]]
    new = [edited(rows[i][3], rows[i + 1][3]) for i in pairs]
    signed = signatures([r[3] for r in rows] + new, samples)
    out: list[tuple] = []
    for k, i in enumerate(pairs):
        own, other, following = signed[i], signed[len(rows) + k], signed[i + 1]
        key = rows[i][2]
        out.append((None if key == NULL_KEY else key, len(rows[i][3]), hashlib.sha256(new[k].encode()).hexdigest(), own.tobytes().hex(), other.tobytes().hex(), likeness(own, other), likeness(own, following)))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names)


def digests(docs: DataFrame) -> DataFrame:
    """What the query returns for each row of documents."""
    return fingerprints(docs)
