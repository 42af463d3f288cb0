"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_ready, pieces

VOCABULARY = "byte_bpe_50k.json"
#: Bytes that the words whose ids a Python worker keeps may take, and what one takes besides its characters; beyond, it forgets all.
CACHED_BYTES, WORD_BYTES = 48 << 20, 200
#: Bytes of text that are encoded together, and characters of a longer text whose words are found together.
AT_ONCE, LONG = 1 << 19, 1 << 18
_NEVER = 1 << 62

#: The word pattern of the byte-level vocabularies, with white space named by its property.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: A space that begins a word whatever stands farther off, so that texts can be cut before it.
_SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Merge adjacent symbols, always the leftmost pair of the lowest rank, until no pair has a rank.

    The tree keeps the minimum of rank * n + position over the pairs, so that its root is the next merge;
    each merge changes three leaves: the pair itself, the one before it and the one that it swallows.
    ``ranks`` is keyed by left << 20 | right, ``made`` gives the symbol that each rank makes.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    size = 1 << (n - 1).bit_length()
    tree = [_NEVER] * (2 * size)
    for i in range(n - 1):
        r = ranks.get(symbols[i] << 20 | symbols[i + 1])
        if r is not None:
            tree[size + i] = r * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low

    alive = n
    while tree[1] != _NEVER:
        rank, i = divmod(tree[1], n)
        j = after[i]
        symbols[i] = made[rank]
        after[i] = k = after[j]
        symbols[j] = -1
        alive -= 1
        if tree[size + j] != _NEVER:
            put(j, _NEVER)
        r = None
        if k < n:
            before[k] = i
            r = ranks.get(symbols[i] << 20 | symbols[k])
        put(i, _NEVER if r is None else r * n + i)
        h = before[i]
        if h >= 0:
            r = ranks.get(symbols[h] << 20 | symbols[i])
            put(h, _NEVER if r is None else r * n + h)
    return [s for s in symbols if s >= 0] if alive < n else symbols


class Pairs:
    """The rank of many pairs at once: an open hash table over the merges."""

    def __init__(self, ranks: dict[int, int]):
        self.bits = max(4, (4 * len(ranks)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        keys, values = np.fromiter(ranks, np.int64, len(ranks)), np.fromiter(ranks.values(), np.int64, len(ranks))
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.ranks[slot[won]] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks, -1 for a pair that has none."""
        pair = left << 20 | right
        slot = self._slot(pair)
        found = self.keys[slot]
        out = np.where(found == pair, self.ranks[slot], -1)
        open_ = np.flatnonzero((found != pair) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == pair[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def merge_many(words: list[bytes], first: np.ndarray, pairs: Pairs, made: np.ndarray) -> list[list[int]]:
    """``merge`` for many words of up to 2**k bytes at once: a tree for each word, a merge in every word at each step."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lens.max())
    log = max(1, (width - 1).bit_length())
    size, n = 1 << log, len(words)
    none = 1 << 19  # a symbol that is in no pair
    symbols = np.full((n, width + 1), none, np.int64)
    symbols[:, :-1][np.arange(width) < lens[:, None]] = first[np.frombuffer(b"".join(words), np.uint8)]
    after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
    before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
    tree = np.full((n, 2 * size), _NEVER, np.int64)
    r = pairs.of(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width)
    tree[:, size : size + width] = np.where(r >= 0, r << log | np.arange(width), _NEVER)
    for level in range(log - 1, -1, -1):
        a = 1 << level
        tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
    flat, sym, nxt, prv = tree.ravel(), symbols.ravel(), after.ravel(), before.ravel()
    rows = np.flatnonzero(tree[:, 1] != _NEVER)
    while len(rows):
        at, top = rows * (width + 1), rows * (2 * size)
        root = flat[top + 1]
        i = root & (size - 1)
        j = nxt[at + i]
        k = np.minimum(nxt[at + j], width)
        sym[at + i] = made[root >> log]
        sym[at + j] = none
        nxt[at + i] = k
        prv[at + k] = i
        flat[top + size + j] = _NEVER
        r = pairs.of(sym[at + i], np.where(k < width, sym[at + k], none))
        flat[top + size + i] = np.where(r >= 0, r << log | i, _NEVER)
        h = prv[at + i]
        has = h >= 0
        h = np.maximum(h, 0)
        r = pairs.of(np.where(has, sym[at + h], none), sym[at + i])
        leaf = top + size + h
        flat[leaf] = np.where(has, np.where(r >= 0, r << log | h, _NEVER), flat[leaf])
        for leaf in (j, i, h):
            node = size + leaf
            for _ in range(log):
                node >>= 1
                below = top + 2 * node
                flat[top + node] = np.minimum(flat[below], flat[below + 1])
        rows = rows[flat[top + 1] != _NEVER]
    live = symbols != none
    ids, ends = symbols[live].tolist(), np.cumsum(live.sum(1)).tolist()
    return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Index(dict):
    """Numbers words in the order in which they come; new ones are also noted in ``fresh``."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = n = len(self)
        return n


class Ragged:
    """Rows of different length in one array, which doubles when it is full; rows can be added and gathered."""

    def __init__(self, kind: type):
        self.flat, self.ends, self.rows = np.zeros(1024, kind), np.zeros(1024, np.int64), 0

    def add(self, rows: list) -> None:
        flat = np.fromiter(chain.from_iterable(rows), self.flat.dtype)
        ends = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))
        used, stop = int(self.ends[self.rows]), self.rows + len(rows)
        self.flat, self.ends = _room(self.flat, used + len(flat)), _room(self.ends, stop + 1)
        self.flat[used : used + len(flat)] = flat
        self.ends[self.rows + 1 : stop + 1] = ends + used
        self.rows = stop

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """These rows one after the other, and where each of them ends (with a leading 0)."""
        start = self.ends[rows]
        ends = np.concatenate([[0], np.cumsum(self.ends[rows + 1] - start)])
        return self.flat[np.repeat(start - ends[:-1], np.diff(ends)) + np.arange(ends[-1])], ends


def _room(a: np.ndarray, size: int) -> np.ndarray:
    return a if size <= len(a) else np.concatenate([a, np.zeros(max(size, 2 * len(a)) - len(a), a.dtype)])


class Encoder:
    """Encode and decode as a vocabulary file of the tokenizers library says (byte level, no normalizer)."""

    def __init__(self, vocabulary: str):
        file = json.loads(vocabulary)
        ids = file["model"]["vocab"]
        of_char = {c: b for b, c in enumerate(byte_symbols())}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        token_bytes = {i: bytes(of_char[c] for c in token) for token, i in ids.items() if token not in self.special}
        token_bytes |= {i: token.encode() for token, i in self.special.items()}
        self.size = max(token_bytes) + 1
        self.bytes_of, self.decimal = Ragged(np.uint8), Ragged(np.uint8)
        self.bytes_of.add([token_bytes.get(i, b"") for i in range(self.size)])
        self.decimal.add([b"%d," % i for i in range(self.size)])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        self.ranks = {ids[a] << 20 | ids[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [ids[a + b] for a, b in pairs]
        self.first = [ids[c] for c in byte_symbols()]
        self.pairs, self.made_array, self.first_array = Pairs(self.ranks), np.array(self.made, np.int64), np.array(self.first, np.int64)
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.index, self.ids, self.held = Index(), Ragged(np.int32), 0

    def words(self, text: str) -> list[str]:
        """The words of a text; special tokens are words of their own."""
        if not any(s in text for s in self.special):
            return self.find(text)
        return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self.find(part))]

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts of about LONG characters, cut where a word begins."""
        a = 0
        while len(text) - a > LONG and (cut := _SAFE.search(text, a + LONG)):
            yield text[a : cut.start()]
            a = cut.start()
        yield text[a:]

    def learn(self, words: list[str]) -> None:
        """Append the ids of these words: long ones merged by themselves, others of about one size together."""
        found: list[list[int]] = [[]] * len(words)
        by_size: dict[int, list[int]] = {}
        coded = [w.encode() for w in words]
        for k, (w, b) in enumerate(zip(words, coded, strict=True)):
            if w in self.special:
                found[k] = [self.special[w]]
            else:
                by_size.setdefault(max(2, (len(b) - 1).bit_length()), []).append(k)
        for log, group in by_size.items():
            step = max(1, (1 << 18) >> log)
            for a in range(0, len(group), step):
                part = group[a : a + step]
                if len(part) < 8 or log > 7:
                    ids = [merge([self.first[x] for x in coded[k]], self.ranks, self.made) for k in part]
                else:
                    ids = merge_many([coded[k] for k in part], self.first_array, self.pairs, self.made_array)
                for k, i in zip(part, ids, strict=True):
                    found[k] = i
        self.ids.add(found)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text ends (with a leading 0); None counts as empty."""
        if self.held > CACHED_BYTES:
            self.forget()
        at, ends, number = [], [0], self.index.__getitem__
        for t in texts:
            for part in self.parts(t or ""):
                at.extend(map(number, self.words(part)))
            ends.append(len(at))
        if self.index.fresh:
            self.learn(self.index.fresh)
            self.held += sum(map(len, self.index.fresh)) + WORD_BYTES * len(self.index.fresh)
            self.index.fresh.clear()
        ids, stops = self.ids.gather(np.array(at, np.int64))
        return ids, stops[ends]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
        """For each text its ids in decimal, joined by commas."""
        flat, stops = self.decimal.gather(ids)
        data, at = flat.tobytes(), stops[ends].tolist()
        return (data[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True))

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[str]:
        """For each text what its ids stand for; bytes that are not UTF-8 become U+FFFD."""
        flat, stops = self.bytes_of.gather(ids)
        data, at = flat.tobytes(), stops[ends].tolist()
        return (data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True))

    def decode(self, ids: list[int | None]) -> str:
        """As decode_batch, for one text; ids that are null or not in the vocabulary are left out."""
        known = np.array([i for i in ids if i is not None and 0 <= i < self.size], np.int64)
        return next(self.decode_batch(known, np.array([0, len(known)])))


def encoder(shared: Broadcast) -> Encoder:
    """The encoder of this Python worker for a broadcast vocabulary; made once for a worker."""
    return kept_ready(("bpe", hash(shared.value)), lambda: Encoder(shared.value))


def share(spark: SparkSession, path: str | None = None) -> Broadcast:
    """Broadcast the text of a vocabulary file that the driver reads (a few MB, whatever the corpus)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, keep: Column, text: Column, path: str | None = None) -> DataFrame:
    """Return ``(row, ids)`` for each row: the token ids of the whole text; ``row`` is the struct ``keep``.

    Null text counts as empty; an empty text has no ids. Repeated rows stay, an empty table gives no row.
    """
    shared = share(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared)
        for whole in batches:
            for batch in pieces(whole, "text", AT_ONCE):
                ids, ends = e.encode_batch(batch.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("row"), lists], ["row", "ids"])

    return _mapped(docs, keep, text, run, [T.StructField("ids", T.ArrayType(T.IntegerType()))])


def decoded(rows: DataFrame, keep: Column, ids: Column, path: str | None = None) -> DataFrame:
    """Return ``(row, text)`` for each row of token ids; null ids give null, null and unknown ids are left out."""
    shared = share(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared)
        for batch in batches:
            texts = [None if i is None else e.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    packed = rows.select(keep.alias("row"), ids.alias("ids"))
    return packed.mapInArrow(run, T.StructType([T.StructField("row", packed.schema["row"].dataType), T.StructField("text", T.StringType())]))


def _mapped(docs: DataFrame, keep: Column, text: Column, run, fields: list[T.StructField]) -> DataFrame:
    packed = docs.select(keep.alias("row"), text.alias("text"))
    return packed.mapInArrow(run, T.StructType([T.StructField("row", packed.schema["row"].dataType), *fields]))


def round_trip(docs: DataFrame, keep: Column, text: Column, path: str | None = None) -> DataFrame:
    """Encode each whole text and decode its ids: ``(row, n_tokens, ids_sha256, decoded_sha256)``; nulls as in encoded."""
    shared = share(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared)
        for whole in batches:
            for batch in pieces(whole, "text", AT_ONCE):
                ids, ends = e.encode_batch(batch.column("text").to_pylist())
                n = np.diff(ends)
                ids_sha = [hashlib.sha256(x).hexdigest() for x in e.joined(ids, ends)]
                text_sha = [hashlib.sha256(x.encode()).hexdigest() for x in e.decode_batch(ids, ends)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["row", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs, keep, text, run, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def lengths(docs: DataFrame, keep: Column, text: Column, path: str | None = None) -> DataFrame:
    """Return ``(row, n_tokens)``: how many tokens each whole text has; nulls as in encoded."""
    shared = share(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared)
        for whole in batches:
            for batch in pieces(whole, "text", AT_ONCE):
                n = np.diff(e.encode_batch(batch.column("text").to_pylist())[1])
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64())], ["row", "n_tokens"])

    return _mapped(docs, keep, text, run, [T.StructField("n_tokens", T.LongType())])


def digests(docs: DataFrame) -> DataFrame:
    """What the query returns for each row of documents."""
    return round_trip(docs, F.struct("doc_id"), F.col("text")).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
