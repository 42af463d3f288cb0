"""Shared helpers: shipping the package, cutting lineage, connected components, byte and word kernels."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null doc_id takes this key inside the operators, so that null rows join with themselves.
NULL_KEY = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch: what a Python worker holds at once besides the piece that it works on.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that their Python workers can import it.

    Arrow batches are bounded by their bytes where the session doesn't set that itself: ten thousand
    texts, the default, are no bound of memory.
    """
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    sc = spark.sparkContext
    if getattr(sc, "_styleloom_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    top = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, top, ignore_errors=True)
    out = Path(top) / "styleloom_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(str(out))
    sc._styleloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a local one, which only a local master can use."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = os.path.join(tempfile.gettempdir(), "styleloom-checkpoints")
    return top


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, but as a Parquet table, whose size Spark knows when it chooses how to join it."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SWEPT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each action on a DataFrame made in this block go when the action ends.

    Elsewhere they stay until the driver collects its garbage, which in a long operator it may not do before
    the files of all its steps are on disk together.
    """
    before = spark.conf.get(SWEPT, None)
    spark.conf.set(SWEPT, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SWEPT)
        else:
            spark.conf.set(SWEPT, before)


def sweeping(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose steps are swept; the DataFrame that it returns is the caller's, and is not."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        with swept(docs.sparkSession):
            out = operator(docs, *args, **kwargs)
        return out.select("*")

    return run


_KEPT: dict[Hashable, Any] = {}


def kept_ready(key: Hashable, make: Callable[[], Any]) -> Any:
    """What this Python worker has made for ``key``; it holds one such thing only, so that operators don't add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def connected_components(edges: DataFrame) -> DataFrame:
    """Alternate large-star and small-star over ``edges(u, v)`` (longs) until nothing moves.

    Returns ``(node, root)`` for every node that has an edge to another one and is not itself the
    smallest of its component; ``root`` is that smallest node. Loops, repeated and null edges are
    ignored; no edge gives no row. Edges stay distributed, and each round is checkpointed.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = state(e)
    while seen[0]:
        both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(e.select(F.col("v").alias("a"), F.col("u").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = checkpointed(small)
        now = state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


# --- byte kernels -----------------------------------------------------------------------------

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over uint64 (splitmix)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n; those of a piece are computed once and kept."""
    if _POWERS and len(_POWERS[0]) > n:
        return _POWERS[0], _POWERS[1]
    size = max(n + 1, PIECE + 1)
    made = []
    for base in (BASE, BASE_INV):
        x = np.full(size, base, U)
        x[0] = 1
        made.append(np.multiply.accumulate(x))
    if size == PIECE + 1:
        _POWERS[:] = made
    return made[0], made[1]


BYTE_CODE = mix(np.arange(1, 257, dtype=U))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column in one array, and the n + 1 offsets into it. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows, each with about ``limit`` bytes of text at most (one long text may exceed it)."""
    _, off = texts_of(batch.column(text))
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield batch.slice(a, min(b, n) - a)
        a = min(b, n)


def rolled(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes; see span_hash."""
    c = np.zeros(len(buf) + 1, U)
    np.cumsum(BYTE_CODE[buf] * powers(len(buf))[0][: len(buf)], out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes in [start, end), equal for equal bytes wherever they stand."""
    return mix((c[end] - c[start]) * powers(len(c))[1][start] + (end - start).astype(U))


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and start of each run of non-space bytes (A-Z lower-cased), and how many words each text has."""
    low = LOWER[buf]
    solid = np.zeros(len(buf) + 2, bool)
    solid[1:-1] = ~SPACE[low]
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
    h = span_hash(rolled(low), start, end)
    count = np.diff(np.searchsorted(start, off))
    return h, start, count


def shingle_sets(words: np.ndarray, count: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words; with fewer words the whole run is one."""
    at = np.concatenate([[0], np.cumsum(count)])
    if len(words) >= k:
        g = np.zeros(len(words) - k + 1, U)
        for i in range(k):
            g = (g + words[i : i + len(g)]) * U(0xD6E8FEB86659FD93 + 2 * i)
            g ^= g >> U(32)
        g = mix(g)
    out = []
    for a, n in zip(at[:-1].tolist(), count.tolist(), strict=True):
        if n >= k:
            s = np.sort(g[a : a + n - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            with np.errstate(over="ignore"):
                x = U(n)
                for w in words[a : a + n]:
                    x = mix(np.array([x * BASE + w], U))[0]
            out.append(np.array([x], U))
        else:
            out.append(np.zeros(0, U))
    return out
