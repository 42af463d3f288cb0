"""The operators against brute force, on a small table with nulls, empty and long texts, copies and clashing names."""

import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from styleloom.llm import bpe, decontaminate, fingerprints, langid, licenses, line_dedup, ngram_join, sharding, suffix_dedup, token_counts
from styleloom.llm.common import connected_components, ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\n"]) for _ in range(n))

    line, passage = "  This LINE stands in many documents. \t", prose(60)
    docs = []
    for i in range(90):
        t = prose(rng.randrange(3, 120))
        if i % 3 == 0:
            t = f"{t}\n{line}\n{prose(5)}"
        if i % 7 == 0:
            t += passage
        docs.append(t)
    docs += [docs[5]] * 4 + [docs[8].replace(" ", "  ").upper(), docs[9] + " more", docs[10] + " at the end", "", None, "\n", " \n ", "...", line, prose(4000), "aB" * 150, "x" * 350]
    return [(i * 3, t, rng.choice(["xx", "yy", None]), rng.choice(["s1", None]), None if t is None else len(t), "r", i) for i, t in enumerate(docs)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    ship(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def texts(rows):
    return {r[0]: r[1] or "" for r in rows}


def test_line_dedup(docs, rows, nothing):
    t = texts(rows)
    keys = collections.defaultdict(set)

    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    for i, x in t.items():
        for part in x.split("\n"):
            if len(key(part)) >= 20:
                keys[key(part)].add(i)
    want = {}
    for i, x in t.items():
        parts = x.split("\n")
        kept = [p for p in parts if not (len(keys.get(key(p), ())) >= 3 and max(keys[key(p)]) != i)]
        want[i] = (len(parts), len(parts) - len(kept), sha("\n".join(kept)))
    got = {r[0]: tuple(r)[1:] for r in line_dedup.digests(docs).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 20
    assert line_dedup.deduped(docs).columns == docs.columns
    assert line_dedup.digests(nothing).count() == 0


def test_line_dedup_null_and_repeated_ids(spark):
    d = spark.createDataFrame([(None, "a common line of some length"), (1, "a common line of some length"), (1, "a common line of some length"), (2, "a common line of some length")], "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.digests(d).select("doc_id", "n_dropped").collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 0), (None, 1)]


def test_bpe(docs, rows, nothing):
    from tokenizers import Tokenizer
    import public_tokenizers

    lib = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    want = {}
    for i, x in texts(rows).items():
        ids = lib.encode(x, add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    assert {r[0]: tuple(r)[1:] for r in bpe.digests(docs).collect()} == want
    back = bpe.decoded(bpe.encoded(docs, F.struct("doc_id"), F.col("text")), F.col("row"), F.col("ids"))
    assert {r["row"]["doc_id"]: r["text"] for r in back.collect()} == texts(rows)
    e = bpe.Encoder(open(public_tokenizers.path(bpe.VOCABULARY), encoding="utf-8").read())
    rng = random.Random(1)
    odd = ["x<|endoftext|>y <|endoftext|>", "\x1c\x85  z", "it's 12½ 中文😀", "a" * 3000, "".join(rng.choice("ab é\n'") for _ in range(2000))]
    for x in odd:
        ids = lib.encode(x, add_special_tokens=False).ids
        assert e.encode(x) == ids and e.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    assert e.decode([None, 10**9, 64]) == lib.decode([64])
    assert bpe.digests(nothing).count() == 0
    sums = token_counts.report(docs).collect()
    n = np.array([w[0] for w in want.values()])
    for r in sums:
        assert (r["docs_at_least"], r["docs_up_to"], r["truncated_tokens"]) == ((n >= r["n_tokens"]).sum(), (n <= r["n_tokens"]).sum(), np.minimum(n, r["n_tokens"]).sum())
    df = token_counts.suffix_sums(token_counts.histogram(docs))
    assert tuple(token_counts.truncated_total(df, 50).first()) == (len(n), n.sum(), (n > 50).sum(), np.minimum(n, 50).sum())
    assert token_counts.quantile(df, 0.5).first()[0] == np.sort(n)[-(-len(n) // 2) - 1]
    assert token_counts.report(nothing).count() == 0


def test_fingerprints(spark, docs, rows, nothing, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 20)
    t = sorted(texts(rows).items())
    got = {r["doc_id"]: r for r in fingerprints.digests(docs).collect()}
    assert len(got) == len(t)

    def alike(a, b):
        ca, cb = (collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", x.translate(LOWER))) for x in (a, b))
        return sum((ca & cb).values()) / max(1, sum((ca | cb).values()))

    error = []
    for k, (i, x) in enumerate(t):
        after = t[(k + 1) % len(t)][1]
        new = fingerprints.edited(x, after)
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(x), sha(new))
        if x.split() and new.split():
            error.append(got[i]["near_edited"] - alike(x, new))
    assert abs(np.mean(error)) < 0.03 and np.std(error) < 0.1
    assert got[15]["fingerprint"] == got[270]["fingerprint"] != got[18]["fingerprint"]
    assert fingerprints.digests(nothing).count() == 0
    one = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert fingerprints.digests(one).first()["near_next"] == 1.0


def brute_components(t, k, percent):
    sets = {}
    for i, x in t.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", x.translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k, percent, held", [(4, 85, 4_000_000), (5, 80, 1500)])
def test_ngram_join(docs, rows, nothing, monkeypatch, k, percent, held):
    monkeypatch.setattr(ngram_join, "HELD", held)
    want = brute_components(texts(rows), k, percent)
    got = {r["key"]: (r["n_shingles"], r["component"]) for r in ngram_join.ngram_components(docs, k, percent).collect()}
    assert got == want and sum(c != i for i, (_, c) in want.items()) >= 6
    if held < 4_000_000:
        kept = {r["doc_id"] for r in ngram_join.one_of_each(docs).collect()}
        assert kept == {i for i, (_, c) in want.items() if c == i}
        assert ngram_join.digests(nothing).count() == 0


def test_ngram_join_lets_the_shuffles_of_finished_steps_go(spark, docs, monkeypatch):
    """The shingles counted, the prefixes and the texts compared are never on disk together, however rarely the driver collects garbage."""
    sc = spark.sparkContext._jsc.sc()
    tracker, before, left = sc.env().mapOutputTracker(), [], []

    def stays(shuffle):
        return all(tracker.containsShuffle(shuffle) and not time.sleep(0.1) for _ in range(100))

    def watched(step):
        def run(df):
            if before and len(left) < 3:
                left.append(stays(before.pop()))
            before[:] = [sc.newShuffleId() + 1]
            out = step(df)
            assert sc.newShuffleId() > before[0]
            return out

        return run

    for step in ("stored", "connected_components"):
        monkeypatch.setattr(ngram_join, step, watched(getattr(ngram_join, step)))
    docs.count()  # the table itself is cached, and its shuffle stays
    ngram_join.ngram_components(docs, 5, 80, tied=False)
    assert left == [False] * 3


def test_ngram_join_null_and_repeated_ids(spark):
    ship(spark)
    rng = random.Random(5)
    words = ["".join(rng.choice("kalomirateu") for _ in range(5)) for _ in range(300)]
    one, two, three, four = (" ".join(rng.choice(words) for _ in range(60)) for _ in range(4))
    rows = [(1, one), (7, one + " more"), (7, two), (9, two), (None, three), (None, three), (None, four), (12, four), (12, four), (7, None), (None, ""), (20, None), (30, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.digests(df).collect()), key=str)
    assert got == sorted([(1, 57, 1), (7, 58, 1), (7, 57, 1), (9, 57, 1), (None, 57, None), (None, 57, None), (None, 57, 12), (12, 57, 12), (12, 57, 12), (7, 0, 1), (None, 0, None), (20, 0, 20), (30, 0, 30)], key=str)
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(df).collect()), key=str)
    assert kept == sorted([(1, one), (7, two), (None, three), (12, four), (7, None), (None, ""), (20, None), (30, " ")], key=str)


def test_join_block_equals_brute_force():
    rng = random.Random(2)
    base = [rng.sample(range(400), 60) for _ in range(5)]
    sets = []
    for b in base:
        for _ in range(15):
            s = set(b) - set(rng.sample(b, rng.randrange(0, 9))) | set(rng.sample(range(400, 900), rng.randrange(0, 6)))
            sets.append(np.array(sorted(s), np.uint64))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            i = len(np.intersect1d(sets[a], sets[b]))
            if 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = dict(ngram_join.join_block(list(range(len(sets))), sets, 85))
    assert {x: got.get(x, x) for x in range(len(sets))} == {x: find(x) for x in range(len(sets))}


def test_stars_of_long_lists(monkeypatch):
    """A list that spans batches ties all of its sets, however it is cut."""
    monkeypatch.setattr(ngram_join, "PAIRED", 3)
    run, _ = ngram_join._ties(85)
    rows = [(s, lo) for s in range(4) for lo in range([2, 40, 3, 25][s])]
    for step in (1, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([10] * len(part), pa.int32()), pa.array([1] * len(part), pa.int32())], ["shingle", "lo", "n", "asked"]) for part in (rows[i : i + step] for i in range(0, len(rows), step))]
        edges = collections.defaultdict(set)
        for b in run(iter(batches)):
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                edges[u].add(v)
                edges[v].add(u)
        seen, todo = set(), [0]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += edges[x]
        assert seen == set(range(40))


def test_frequent_shingles_are_counted_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PACKED", 1000)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    common = {m: " ".join(word() for _ in range(4)) for m in (9, 40, 300)}
    texts = [" ".join([*(c for m, c in common.items() if i < m), *(word() for _ in range(40))]) for i in range(400)]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "key long, a long, text string")
    survey, fields = ngram_join._survey(4)
    surveyed = df.mapInArrow(survey, fields).repartition("to").sortWithinPartitions("to").mapInArrow(ngram_join._counted, fields)
    table = ngram_join._frequent(surveyed)
    cell = lambda t: int(ngram_join._sets(pa.RecordBatch.from_pydict({"text": [t]}), 4)[0][0]) // (2**64 // ngram_join.CELLS)
    for m, c in common.items():
        assert abs(ngram_join.FREQUENCY[table[cell(c)]] / m - 1) < 0.1
    seldom = [" ".join(t.split()[-4:]) for t in texts]
    assert sum(bool(table[cell(t)]) for t in seldom) < 4
    assert sorted(r["key"] for r in surveyed.where("counts IS NULL").select("key").collect()) == list(range(400))


def test_a_full_table_keeps_the_most_frequent_shingles(monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    common = {m: " ".join(word() for _ in range(5)) for m in (12, 50, 300)}
    texts = [" ".join([*(c for m, c in common.items() if i < m), word()]) for i in range(300)]
    column = {"key": range(300), "a": [0] * 300, "text": texts}
    survey, _ = ngram_join._survey(5)
    rows = pa.Table.from_batches(survey(iter([pa.RecordBatch.from_pydict({c: list(v) for c, v in column.items()})]))).sort_by("to")
    counted = pa.Table.from_batches(ngram_join._counted(iter(rows.to_batches(max_chunksize=7)))).to_pylist()

    class Counted:
        where = select = lambda self, *_: self
        collect = lambda self: [r for r in counted if r["counts"] is not None]

    assert len(counted) - len(Counted().collect()) == 300
    cells = {m: int(ngram_join._sets(pa.RecordBatch.from_pydict({"text": [c]}), 5)[0][0]) // (2**64 // ngram_join.CELLS) for m, c in common.items()}
    table = ngram_join._frequent(Counted())
    assert all(abs(ngram_join.FREQUENCY[table[cells[m]]] / m - 1) < 0.1 for m in cells)
    monkeypatch.setattr(ngram_join, "FILLED", int(np.count_nonzero(table >= table[cells[50]])) / ngram_join.CELLS)
    table = ngram_join._frequent(Counted())
    assert [bool(table[cells[m]]) for m in (12, 50, 300)] == [False, True, True]


def test_prefixes_avoid_long_lists():
    few = np.concatenate([np.zeros(60), np.full(40, 500.0)])
    asked = ngram_join.matches_asked(few, 85, ngram_join.PAIRED)
    assert 15 + asked <= 60
    assert ngram_join.matches_asked(np.full(100, 500.0), 85, ngram_join.PAIRED) == 1


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7), (500, 400)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_repeats(documents):
    """n_bytes, n_removed, n_spans and the hash of what stays, of documents in their order."""
    seen, out = set(), []
    for x in documents:
        b = x.encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - 99):
            w = b[a : a + 100]
            if w in seen:
                gone[a : a + 100] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_suffix_dedup(docs, rows, nothing, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    t = sorted(texts(rows).items())
    want = dict(zip([i for i, _ in t], brute_repeats([x for _, x in t]), strict=True))
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.digests(docs).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 1000
    assert suffix_dedup.digests(nothing).count() == 0


def test_suffix_dedup_null_and_repeated_ids(spark):
    """Texts of one id are documents in the order of their hashes; equal ones are one; null ids come first."""
    ship(spark)
    rng = random.Random(12)
    part = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (300, 800, 400, 150)]
    rows = [(None, part[0]), (None, part[3] + part[0]), (1, part[0] + part[1][:120]), (5, part[1]), (5, part[0] + part[2]), (5, part[0] + part[2]), (6, None), (6, part[2]), (6, part[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("order", F.xxhash64(F.coalesce("text", F.lit(""))))
    order = {r["text"] or "": r["order"] for r in df.collect()}
    documents = sorted({(-1 if i is None else i, order[x or ""], x or "") for i, x in rows})
    want = dict(zip(documents, brute_repeats([x for *_, x in documents]), strict=True))
    got = sorted(tuple(r) for r in suffix_dedup.digests(df.select(F.coalesce("doc_id", F.lit(None)).alias("doc_id"), "text")).fillna(-1, ["doc_id"]).collect())
    assert got == sorted((i if i is not None else -1, *want[-1 if i is None else i, order[x or ""], x or ""]) for i, x in rows)
    assert sum(r[2] for r in got) > 1000


def test_again_counts_over_batches(monkeypatch):
    """A hash is marked once, however its rows are cut into batches; one that occurs once goes."""
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    made = [(1, 0, 1)] + [(2, k, 1) for k in range(6)] + [(3, 0, 5)] + [(4, 0, 4), (4, 1, 4)] + [(9, 0, 1)]
    run = [k << suffix_dedup.COUNT + suffix_dedup.STATE | 1 << suffix_dedup.STATE | (suffix_dedup.FIRST | n << suffix_dedup.STATE + suffix_dedup.COUNT + suffix_dedup.START if n > 1 else suffix_dedup.ALONE) for _, k, n in made]
    rows = pa.RecordBatch.from_arrays([pa.array([m[0] for m in made]), pa.array([m[1] for m in made]), pa.array([0] * len(made)), pa.array(run)], ["h", "key", "sub", "run"])
    for step in (1, 2, 3, 20):
        out = [r for b in suffix_dedup._again(rows.slice(i, step) for i in range(0, len(made), step)) for r in b.to_pylist()]
        assert sorted(r["h"] for r in out if r["run"] == suffix_dedup.MARK) == [2, 4]
        assert sorted((r["h"], r["key"]) for r in out if r["run"] != suffix_dedup.MARK) == [(2, k) for k in range(6)] + [(3, 0), (4, 0), (4, 1)]


def test_suffix_order():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 5, 8, 30, 200):
        for k in (1, 2, 4):
            s = rng.integers(1, k + 1, n).astype(np.int64)
            assert suffix_dedup.suffix_order(s, 30).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_sorted_with_places_and_without():
    rng = np.random.default_rng(2)
    for top in (1, 5, 1 << 40, 1 << 62):
        key = rng.integers(0, top, 1000)
        order, ranked = suffix_dedup._sorted(key)
        assert ranked.tolist() == sorted(key.tolist()) == key[order].tolist()
        assert sorted(order.tolist()) == list(range(1000))


def test_windows_are_compared_across_parts(monkeypatch):
    rng = random.Random(4)
    contexts = [bytes(rng.choices(b"ab", k=130)) for _ in range(6)]
    contexts += [c[i : i + 110] for i, c in enumerate(contexts)]
    seen, want = set(), set()
    for d, c in enumerate(contexts):
        for i in range(len(c) - 99):
            if c[i : i + 100] not in seen:
                seen.add(c[i : i + 100])
                want.add((d, i))
    for near in (1, 2, 7, 4096):
        monkeypatch.setattr(suffix_dedup, "NEAR", near)
        got = suffix_dedup.first_windows(contexts, [(d, 0, 0) for d in range(len(contexts))])
        assert {(d, s + i) for d, _, s, n in got for i in range(n)} == want


def test_first_windows_of_contexts_and_of_windows_by_themselves():
    rng = random.Random(1)
    core = bytes(rng.randrange(97, 101) for _ in range(110))
    rows = [(7, i, 50, core[: 105 + i % 5] if i % 2 else core[:100] + bytes([65 + i]) * 3) for i in range(12)] + [(9, 3, 0, core[::-1][:101])]
    want = {}
    for h, key, start, c in rows:
        for a in range(len(c) - 99):
            want.setdefault((h, c[a : a + 100]), []).append((key, 0, start + a))
    single = [(8, 5, 4, 0, 11), (8, 5, 2, 1, 30), (8, 6, 2, 0, 31)]
    columns = [[7] * 12 + [8] * 3 + [9], [0] * 12 + [r[1] for r in single] + [0], [r[1] for r in rows[:12]] + [r[2] for r in single] + [3], [0] * 12 + [r[3] for r in single] + [0], [50] * 12 + [r[4] for r in single] + [0]]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([r[3] for r in rows[:12]] + [None] * 3 + [rows[12][3]], pa.binary())], ["h", "other", "key", "sub", "start", "context"])
    got = [(r["key"], r["sub"], r["start"] + i) for b in suffix_dedup._firsts(iter([batch.slice(0, 5), batch.slice(5)])) for r in b.to_pylist() for i in range(r["n"])]
    assert sorted(got) == sorted([min(p) for p in want.values()] + [(2, 1, 30), (2, 0, 31)])


def test_language_id(spark, nothing):
    rng = random.Random(6)
    sounds = {"aa": ["ka", "lo", "mi", "ra"], "bb": ["sch", "eit", "ung", "ver"], "cc": ["é", "eau", "tion", "ou"]}
    rows = []
    for i in range(150):
        lang = rng.choice(list(sounds))
        rows.append((i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(30)), lang, lang))
    rows += [(200, None, "aa", "x"), (201, "", None, "x"), (202, "123 !?", "aa", "x"), (203, "KALOMI RALO", None, "x"), (None, "eitung versch", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    ship(spark)
    got = {r["doc_id"]: r for r in langid.predictions(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["lang_pred"] == lang and 0.9 < got[i]["score"] <= 1 for i, _, lang, _ in rows[:150])
    assert [got[i]["lang_pred"] for i in (200, 201, 202, 203, None)] == ["und", "und", "und", "aa", "bb"]
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert langid.predictions(nothing).count() == 0
    assert langid.recognised(df).columns == df.columns and langid.recognised(df).count() == len(rows) - 3


def test_language_code_lengths_are_exact():
    """The tables give what partial matching gives when it is told step by step."""
    train = b"   abracadabra abra"
    codes = [int.from_bytes(train[i : i + 4], "big") for i in range(len(train) - 3)]
    u, n = np.unique(codes, return_counts=True)
    model = langid.Model(["q"], [(u.astype(np.uint32), n)])

    def p(context, byte):
        if context is None:
            return 1 / 256
        k = len(context)
        seen = collections.Counter()
        for c in codes:
            b = c.to_bytes(4, "big")
            if b[3 - k : 3] == context:
                seen[b[3]] += 1
        shorter = context[1:] if k else None
        if not seen:
            return p(shorter, byte)
        total, kinds = sum(seen.values()), len(seen)
        return seen[byte] / (total + kinds) if byte in seen else kinds / (total + kinds) * p(shorter, byte)

    text = "abrxa cad"
    padded = b"   " + text.encode()
    want = -sum(np.log2(p(padded[i - 3 : i], padded[i])) for i in range(3, len(padded)))
    assert abs(langid.code_lengths(model, pa.array([text, ""]))[0, 0] - want) < 1e-3


def test_language_of_long_texts_is_scored_in_slices(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("ab É\n1ñÃ") for _ in range(3000))
    codes = np.unique(np.concatenate([langid._contexts(*langid.folded(*langid.texts_of(pa.array([text[:500]]))))[0]]))
    model = langid.Model(["q", "r"], [(codes, np.ones(len(codes), np.int64)), (codes[::2], np.full(len(codes[::2]), 3))])
    whole = langid.code_lengths(model, pa.array([text]))
    for size in (7, 64, 1000):
        monkeypatch.setattr(langid, "SLICE", size)
        assert np.allclose(langid.code_lengths(model, pa.array([text])), whole)


def test_language_id_learns_every_label(spark, monkeypatch):
    """More labels than any limit there ever was, with their counts joined by a shuffle."""
    monkeypatch.setattr(langid, "FEW_LABELS", 10)
    ship(spark)
    df = spark.createDataFrame([(i, f"w{chr(0x100 + i % 80)}" * 9 + " x", f"l{i % 80}") for i in range(800)], "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == f"l{r['doc_id'] % 80}" for r in langid.predictions(df).collect())
    monkeypatch.setattr(langid, "MOST_STRINGS", 10)
    with pytest.raises(ValueError):
        langid.predictions(df)


def test_sharding(docs, rows, nothing):
    got = sharding.digests(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    of = collections.defaultdict(list)
    for r in got:
        of[r["shard"]].append(r["slot"])
        x = (texts(rows)[r["doc_id"]]).encode()
        import zlib

        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(x) + 8, zlib.crc32(x), "rows", None)
    sizes = [len(s) for s in of.values()]
    assert set(of) == set(range(24)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in of.values())
    order = [r["hilbert"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    assert sharding.digests(nothing).count() == 0


def test_sharding_tells_long_strings_apart(spark, monkeypatch):
    ship(spark)
    names = [f"common-crawl-{i}" for i in range(4)] + [None]
    df = spark.createDataFrame([(i, "t", names[i % 5]) for i in range(200)], "doc_id long, text string, source string")
    for sample in (8192, 2):
        monkeypatch.setattr(sharding, "SAMPLE", sample, raising=False)
        got = sharding.shard_rows(df, shards=5, dims=("source",)).collect()
        assert {r["shard"]: {x["row"]["source"] for x in got if x["shard"] == r["shard"]} for r in got} == {0: {None}, **{i + 1: {n} for i, n in enumerate(names[:4])}}
        assert sorted((r["shard"], r["slot"]) for r in got) == [(s, i) for s in range(5) for i in range(40)]
    monkeypatch.setattr(sharding, "HEAVY", 1)
    many = spark.createDataFrame([(i, "t", f"common-crawl-{i:04}") for i in range(1000)], "doc_id long, text string, source string")
    monkeypatch.setattr(sharding, "SAMPLE", 200)
    sizes = collections.Counter(r["hilbert"] for r in sharding.shard_rows(many, dims=("source",)).collect())
    assert len(sizes) == 16 and max(sizes.values()) < 150


def test_sharding_cuts_are_exact(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TOGETHER", 200, raising=False)
    rng = random.Random(8)
    names = [f"s{rng.randrange(10**9)}" for _ in range(12_000)] + [None] * 900 + ["s5"] * 2000
    numbers = [rng.randrange(1000) for _ in names]
    df = spark.createDataFrame(list(zip(range(len(names)), ["t"] * len(names), names, numbers, strict=True)), "doc_id long, text string, source string, n long")
    for column, values in (("source", names), ("n", numbers)):
        ranked = sorted(values, key=lambda v: (v is not None, v or 0 if column == "n" else v or ""))
        cuts = {ranked[-(-len(ranked) * k // 16) - 1] for k in range(1, 16)} - {None}
        want = {i: sum(v is not None and v >= c for c in cuts) for i, v in enumerate(values)}
        got = sharding.shard_rows(df, dims=(column,)).select("doc_id", "hilbert").collect()
        assert {r["doc_id"]: r["hilbert"] for r in got} == want


def test_hilbert_curve():
    import itertools

    for n, bits in ((2, 3), (3, 2)):
        digit, to = sharding.curve_steps(n)

        def index(p):
            h = s = 0
            for level in range(bits - 1, -1, -1):
                at = s * (1 << n) + sum(((p[i] >> level) & 1) << i for i in range(n))
                h, s = h << n | digit[at], to[at]
            return h

        points = sorted(itertools.product(range(1 << bits), repeat=n), key=index)
        assert [index(p) for p in points] == list(range(len(points)))
        assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in itertools.pairwise(points))


def test_licenses(spark, docs, nothing):
    notices = list(licenses.TEMPLATES.items())
    rows = [(i, f"Some text before it. {t.upper() if i % 2 else t}! And then more words follow here.") for i, (_, t) in enumerate(notices)]
    rows += [(100, None), (101, ""), (102, "no license at all in these words"), (103, "Licensed under"), (104, "word " * 500 + notices[0][1] + " word" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in licenses.report(df).collect()}
    assert got == {(i, n) for i, (n, _) in enumerate(notices)} | {(104, notices[0][0])}
    assert licenses.report(docs).count() == 0 and licenses.report(nothing).count() == 0
    with pytest.raises(ValueError):
        licenses.licenses(df, {"short": "two words"})


def test_licenses_by_headers_and_full_texts(spark):
    gnu = "This file is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    full = {f.stem: f.read_text() for f in licenses._TEXTS.glob("*.txt")}
    mit = full["MIT"].replace("FITNESS FOR A PARTICULAR", "FITNESS FOR ANY").split("conditions:")
    rows = {
        1: (gnu.format("", "3"), {"GPL-3.0"}), 2: (gnu.format("", "2"), {"GPL-2.0"}), 3: (gnu.format("Lesser ", "2.1"), {"LGPL-2.1"}),
        4: (gnu.format("Lesser ", "3"), {"LGPL-3.0"}), 5: (gnu.format("Affero ", "3"), {"AGPL-3.0"}),
        6: ("see the GNU GENERAL PUBLIC LICENSE Version 3", {"GPL-3.0"}),
        7: ("// SPDX-License-Identifier: GPL-2.0-only\nint x;", {"GPL-2.0"}),
        8: (f"{mit[0]}conditions:{mit[1]}", {"MIT"}),
        9: (full["ISC"], {"ISC"}), 10: (full["0BSD"], {"0BSD"}), 11: (full["Unlicense"], {"Unlicense"}),
        12: (full["BSD-2-Clause"], {"BSD", "BSD-2-Clause"}), 13: (full["BSD-3-Clause"], {"BSD", "BSD-3-Clause"}),
        14: ("word " * 700 + full["GPL-3.0"].replace("GNU GENERAL PUBLIC LICENSE\n", "\n").replace("covered work", "covered thing"), {"GPL-3.0"}),
        15: ("Free software is published by many; the general public may read version 3 of it.", set()),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in rows.items()], "doc_id long, text string").repartition(4)
    got = collections.defaultdict(set)
    for r in licenses.report(df).collect():
        got[r["doc_id"]].add(r["license"])
    assert {i: got[i] for i in rows} == {i: want for i, (_, want) in rows.items()}


def test_licenses_equal_brute_force_over_windows(spark):
    """Variants of templates on either side of the containment asked for: what every window of every text holds."""
    rng = random.Random(21)
    words = ["".join(rng.choice("kalomirateu") for _ in range(5)) for _ in range(500)]
    templates = {f"L{i}": " ".join(rng.choice(words) for _ in range(n)) for i, n in enumerate((6, 9, 20, 40, 200, 230))}
    texts = {}
    for i in range(120):
        parts = list(templates.values())[i % 6].split(" ")
        for at in rng.sample(range(len(parts)), rng.randrange(0, max(2, len(parts) // 9))):
            parts[at] = "changed"
        before, after = ([rng.choice(words) for _ in range(rng.randrange(0, 300))] for _ in range(2))
        texts[i] = " ".join(before + parts + after)

    def cut(x):
        w = x.split(" ")
        return [tuple(w[j : j + 3]) for j in range(len(w) - 2)]

    want, groups = {}, collections.defaultdict(list)
    for name, t in templates.items():
        groups[1 << (len(t.split(" ")) - 1).bit_length()].append(name)
    for i, x in texts.items():
        sh = cut(x)
        for names in groups.values():
            sizes = [len(templates[n].split(" ")) for n in names]
            p = licenses.plan(max(sizes), min(sizes), 3, 0.8, licenses.RECALL)
            for n in names:
                own = set(cut(templates[n]))
                best = max((len(own & set(sh[a : a + p.width - 2])) / len(own) for a in range(0, len(sh), p.stride)), default=0)
                if best >= 0.8:
                    want[i, n] = round(best, 9)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["license"]): round(r["containment"], 9) for r in licenses.licenses(df, templates).collect()}
    assert got == want and 60 < len(want) < 115 and min(want.values()) < 0.85
    null = spark.createDataFrame([(None, templates["L2"]), (None, templates["L2"]), (3, None), (3, "")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in licenses.licenses(null, templates).collect()] == [(None, "L2", 1.0)]


def test_fingerprints_of_one_id_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 5)
    ship(spark)
    rows = [(7 if i % 2 else None, f"word{i} and some more words {i * i}") for i in range(80)] + [(9, None), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    order = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["tie"], r["text"] or "") for r in df.collect()))
    want = sorted((None if i < 0 else i, len(x), sha(fingerprints.edited(x, order[(k + 1) % len(order)][2]))) for k, (i, _, x) in enumerate(order) if i >= 0)
    got = fingerprints.digests(df).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got if r["doc_id"] is not None) == want and len(got) == len(rows)
    cuts = fingerprints.cuts_of([3, 7, 7, 7, 9])
    assert fingerprints.ranges(cuts, np.array([2, 3, 7, 7, 7, 8, 9]), np.array([0, 0, -(2**63), 0, 2**63 - 1, 0, 0])).tolist() == [0, 1, 2, 3, 4, 4, 5]


def test_sharding_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKETS", 32)
    ship(spark)
    rows = [(1, "same", "x")] * 300 + [(None, None, None)] * 100 + [(i, f"t{i}", f"s{i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = sharding.shard_rows(df, shards=7, dims=("source",)).collect()
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len({(r["shard"], r["slot"]) for r in got}) == 600
    assert collections.Counter((r["doc_id"], r["row"]["text"]) for r in got) == collections.Counter((i, t) for i, t, _ in rows)


def test_hilbert_index_equals_the_tables(spark):
    digit, to = sharding.curve_steps(3)

    def index(p):
        h = s = 0
        for level in range(3, -1, -1):
            at = s * 8 + sum(((p[i] >> level) & 1) << i for i in range(3))
            h, s = h << 3 | digit[at], to[at]
        return h

    df = spark.range(16**3).selectExpr("id % 16 AS x", "(id div 16) % 16 AS y", "id div 256 AS z")
    got = df.select("x", "y", "z", sharding.hilbert_index([F.col(c) for c in "xyz"], 4).alias("h")).collect()
    assert all(r["h"] == index((r["x"], r["y"], r["z"])) for r in got) and len({r["h"] for r in got}) == 16**3


def test_decontamination(spark, docs, nothing):
    ship(spark)
    items = [
        (1, "A train leaves Boston at 60 km per hour and another train leaves Chicago at 80 km per hour; when do the trains from Boston and Chicago meet?"),
        (2, "the quick brown fox jumps over the lazy dog and then it rests under an old oak tree"),
        (3, None), (4, ""), (5, "tiny item"),
    ]
    rows = [
        (1, f"Before. {items[0][1]} After."),
        (2, "Q: A train leaves Paris at 75 miles per hour and another train leaves New York at 90 miles per hour; when do the trains from Paris and New York meet?"),
        (3, "THE QUICK BROWN FOX, jumps over the lazy dog -- and then it rests under an old oak tree!"),
        (4, "the quick brown fox was not seen by anyone that day, and no dog was lazy"),
        (5, None), (6, ""), (7, "a tiny item"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.leaked_pairs(df, bench).collect())
    assert got == [(1, 1, "verbatim"), (2, 1, "re-parameterised"), (3, 2, "verbatim")]
    assert sorted(r["doc_id"] for r in decontaminate.clean(df, bench).collect()) == [4, 5, 6, 7]
    assert decontaminate.clean(docs, bench).count() == docs.count()
    assert decontaminate.leaked_pairs(nothing, bench).count() == 0
    assert decontaminate.clean(df, bench.limit(0)).count() == len(rows)


def test_decontamination_of_names_that_begin_sentences(spark):
    ship(spark)
    items = [(1, "Anna has 4 red pens. Ben has 7 blue pens. Carla has 9. Who has the most?"), (2, "Dora sold 12 old green lamps")]
    rows = [
        (1, "Zoe has 5 red pens. Tom has 8 blue pens. Lena has 2. Who has the most?"),
        (2, "So it began. Mary Ann sold 31 old green lamps."),
        (3, "Zoe has 5 red pens. Zoe has 8 blue pens. Zoe has 2. Who has the most?"),
        (4, "zoe has 5 red books. Tom has 8 blue books."),
        (5, items[0][1]),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.leaked_pairs(df, bench).collect())
    assert got == [(1, 1, "re-parameterised"), (2, 2, "re-parameterised"), (5, 1, "verbatim")]


def test_decontamination_of_items_dense_in_numbers(spark):
    ship(spark)
    items = [(1, "What comes next: 2, 4, 8, 16, 32, 64?"), (2, "Compute 12 + 35 - 48 * 9 + 7"), (3, "17 + 4 = 21"), (4, "1 + 2 + 3 + 4")]
    rows = [
        (1, f"It said 5. {items[0][1]} 128 is right."),
        (2, f"Task 3. {items[1][1]} = ?"),
        (3, "What comes next: 3, 5, 9, 17, 33, 65?"),
        (4, "Compute 12 - 35 + 48 / 9 - 7"),
        (5, "1, 2, 3, 4, 5"),
        (6, "Sum 0, 1 + 2 + 3 + 4"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.leaked_pairs(df, bench).collect())
    assert got == [(1, 1, "verbatim"), (2, 2, "verbatim"), (6, 4, "verbatim")]
    assert sorted(r["doc_id"] for r in decontaminate.clean(df, bench).collect()) == [3, 4, 5]


def test_decontamination_of_long_items_by_a_run(spark):
    ship(spark)
    rng = random.Random(4)
    words = ["".join(rng.choice("kalomirateu") for _ in range(6)) for _ in range(100)]
    rows = [(1, "so " + " ".join(words[30:75])), (2, " ".join(words[30:50])), (3, " ".join(words[30:49])), (4, " and ".join([" ".join(words[:15]), " ".join(words[40:55])]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert sorted((r["doc_id"], round(r["share"], 2), r["kind"]) for r in decontaminate.leaked_pairs(df, bench).collect()) == [(1, 0.45, "verbatim"), (2, 0.2, "verbatim")]
    assert sorted(r["doc_id"] for r in decontaminate.clean(df, bench).collect()) == [3, 4]


def brute_leaks(docs, items):
    """Every window of every item against every window of every text, by the tokens themselves."""
    def streams(x):
        *own, _ = decontaminate.tokens(*decontaminate.texts_of(pa.array([x], pa.large_string())))
        raw = x.encode().lower()
        return [(t, [raw[a:b] for a, b in zip(t.start, t.end, strict=True)], t.kind.tolist(), t.inner.tolist()) for t in own]

    def windows(own, size):
        t, value, kind, inner = own
        for a in range(len(value) - size + 1):
            kinds = kind[a : a + size]
            if 2 * kinds.count(0) >= size:
                yield a, tuple(value[a + o] if k == 0 and o == 0 else inner[a + o] if k == 0 else k for o, k in enumerate(kinds)), [(k, value[a + o]) if k else None for o, k in enumerate(kinds)]

    parsed = {i: streams(x) for i, x in items.items() if x}
    out = {}
    for d, x in docs.items():
        if not x:
            continue
        own = streams(x)
        for i, its in parsed.items():
            best, run = 0.0, 0
            for k in range(4):
                n = len(its[k][1])
                size = min(n, 8)
                if not n or size < 4 and (k or len(own[k][1]) != n):
                    continue
                places = collections.defaultdict(list)
                mine = collections.defaultdict(list)
                for a, key, slots in windows(own[k], size):
                    mine[key].append((a, slots))
                for a, key, slots in windows(its[k], size):
                    for at, found in mine.get(key, ()):
                        places[at - a].append((a, slots, found))
                held = set()
                for windows_ in places.values():
                    pairs = {a + o: (s, f) for a, s_, f_ in windows_ for o, (s, f) in enumerate(zip(s_, f_, strict=True)) if s}
                    to, back, wrong = {}, {}, set()
                    for p in sorted(pairs):
                        s, f = pairs[p]
                        if to.setdefault(s, f) != f or back.setdefault(f, s) != s:
                            wrong.add(p)
                    kept = {p for a, *_ in windows_ if not wrong & set(range(a, a + size)) for p in range(a, a + size)}
                    held |= kept
                    run = max(run, max((len(list(g)) for _, g in itertools.groupby(enumerate(sorted(kept)), lambda e: e[1] - e[0])), default=0))
                best = max(best, len(held) / n)
            if best >= 0.5 or run >= 20:
                out[d, i] = round(best, 6)
    return out


def test_decontamination_equals_brute_force(spark):
    """Items rich in numbers, units and names, verbatim, re-parameterised and nearly: the pairs of brute force, and most of what was planted."""
    ship(spark)
    rng = random.Random(8)
    people, places = ["Anna", "Ben", "Carla", "Dora", "Emil", "Fred", "Gina"], ["Paris", "Rome", "Oslo", "Lima", "Cairo", "Quito"]
    units = ["km", "kg", "hours", "miles", "litres", "euros"]
    words = ["".join(rng.choice("kalomirateu") for _ in range(5)) for _ in range(60)]
    shapes = [
        lambda r: f"when {r('p')} drives {r('n')} {r('u')} from {r('c')} to {r('c')} and then walks {r('n')} {r('u')} back, how far does {r('p')} go each day",
        lambda r: f"a shop sells {r('n')} {r('u')} of rice for {r('n')} coins and {r('n')} {r('u')} of beans for {r('n')} coins, what is the price of both",
        lambda r: f"the friends {r('p')}, {r('p')} and {r('p')} share {r('n')} apples so that nobody gets more than {r('n')} of them",
        lambda r: f"{r('n')} + {r('n')} = {r('n')}, {r('n')} + {r('n')} = {r('n')}",
        lambda r: " ".join(rng.choice(words) for _ in range(rng.randrange(9, 40))),
    ]

    def filled(shape, given=None):
        at = iter(given or ())
        used = []

        def value(kind):
            x = next(at, None) if given else None
            x = x or (str(rng.randrange(2, 9999)) if kind == "n" else rng.choice({"p": people, "c": places, "u": units}[kind]))
            used.append(x)
            return x

        return shape(value), used

    items, docs, planted = {}, {}, set()
    for i in range(60):
        shape = shapes[i % 5]
        items[i] = filled(shape)[0]
    items |= {100: items[0], 101: None, 102: "", 103: "tiny item", 104: "one"}
    for d in range(240):
        i = d % 60
        before, after = (" ".join(rng.choice(words) for _ in range(rng.randrange(3, 30))) for _ in range(2))
        if d < 60:
            docs[d] = f"{before} {items[i]} {after}"
            planted.add((d, i))
        elif d < 120 and i % 5 in (0, 1, 2):
            docs[d] = f"{before} {filled(shapes[i % 5])[0]} {after}"
        elif d < 180:
            part = items[i].split(" ")
            docs[d] = f"{before} {' '.join(part[: len(part) // 2 + rng.randrange(-3, 4)])} {after}"
        else:
            docs[d] = f"{before} {after}"
    docs |= {500: None, 501: "", 502: "Tiny ITEM!", 503: "a tiny item", 504: "one two", 505: docs[3]}
    df = spark.createDataFrame([(d, x, 1) for d, x in docs.items()], "doc_id long, text string, a int").repartition(4)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["share"], 6) for r in decontaminate.leaked_pairs(df, bench).collect()}
    assert got == brute_leaks(docs, items)
    assert planted <= set(got) and (502, 103) in got and (503, 103) not in got and {(0, 100), (505, 3)} <= set(got)
    stay = sorted(r["doc_id"] for r in decontaminate.clean(df, bench).collect())
    assert stay == sorted(set(docs) - {d for d, _ in got}) and {500, 501} < set(stay)


def test_decontamination_of_null_and_repeated_ids(spark):
    ship(spark)
    item = "the quick brown fox jumps over the lazy dog and rests"
    df = spark.createDataFrame([(None, item), (None, "other words"), (7, item), (7, item), (7, "nothing of it"), (8, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (4, item), (4, item)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.leaked_pairs(df, bench).collect()), key=str)
    assert got == sorted([(d, i) for d in (None, 7, 7) for i in (None, 4, 4)], key=str)
    assert sorted((r["text"] or "") for r in decontaminate.clean(df, bench).collect()) == ["", "nothing of it", "other words"]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    words = ["".join(rng.choice("kalomirateu") for _ in range(5)) for _ in range(400)]
    prose = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    item = " ".join(rng.choice(words) for _ in range(20))
    rows = [(i, t, "aa", "s", len(t)) for i, t in enumerate(prose)]
    rows += [(20, prose[0], "aa", "s", 1), (21, prose[1] + " end", "aa", "s", 1), (22, "12 34", "aa", "s", 5), (23, prose[2][:200] + " " + item, "aa", "s", 1), (24, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(12))
    assert all(got[i]["decoded_sha256"] == sha(prose[i]) for i in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontaminated", "encoded"]
