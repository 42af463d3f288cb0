"""Hilbert-curve sharding, in DataFrame functions only: quantise metadata dimensions, order rows by their
index on the curve, and cut the order into runs, so that each file covers a small box of the dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored

#: Buckets of rows that are numbered apart from each other; twice as many are the bound of what the driver reads.
BUCKETS = 8192
#: Distinct values of a dimension that are summed together, and ranges of them at most, whose sums the driver reads.
TOGETHER, HEAVY = 8192, 1024


def curve_steps(dims: int) -> tuple[list[int], list[int]]:
    """For each state and each corner (one bit of every dimension): the digit on the curve and the next state.

    A state is an entry corner e and a direction d, numbered e * dims + d. The tables follow from the
    reflected Gray code: turn the corner into the state's frame, look up its rank in the code, and carry
    on in the frame of that sub-cube. Entries are numbered state * 2**dims + corner.
    """
    size, mask = 1 << dims, (1 << dims) - 1

    def rot(x: int, k: int) -> int:
        k %= dims
        return ((x << k) | (x >> (dims - k))) & mask if k else x

    gray = [i ^ (i >> 1) for i in range(size)]
    rank = {g: i for i, g in enumerate(gray)}
    ones = [((~i & (i + 1)).bit_length() - 1) for i in range(size)]  # trailing ones of i
    enter = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, size)]
    turn = [0] + [(ones[i] if i % 2 else ones[i - 1]) % dims for i in range(1, size)]
    digit, to = [], []
    for e in range(size):
        for d in range(dims):
            for corner in range(size):
                w = rank[rot(corner ^ e, dims - (d + 1))]
                digit.append(w)
                to.append((e ^ rot(enter[w], d + 1)) * dims + (d + turn[w] + 1) % dims)
    return digit, to


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """The index on the Hilbert curve of the cell with these coordinates, each below 2**bits."""
    n = len(cells)
    digit, to = (F.array(*[F.lit(x) for x in part]) for part in curve_steps(n))

    def step(acc: Column, level: Column) -> Column:
        corner = sum((F.pmod(F.floor(c / F.pow(F.lit(2.0), level)), F.lit(2)).cast("int") * (1 << i) for i, c in enumerate(cells)), F.lit(0))
        at = acc["state"] * (1 << n) + corner
        return F.struct((acc["h"] * (1 << n) + F.get(digit, at)).alias("h"), F.get(to, at).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["h"])


def _cuts(docs: DataFrame, value: Column, shares: list[float]) -> list:
    """The values at these shares of the rows, in their order (of strings, the whole strings); null comes first and is no cut.

    Exact for any number of distinct values: these are counted and dealt to ranges, the driver reads the sum of each
    range, and a running sum over the ranges that hold a cut, one for each share at most, finds the values.
    """
    counts = stored(docs.groupBy(value.alias("v")).count())
    distinct, total = counts.agg(F.count(F.lit(1)), F.sum("count")).first()
    if not total:
        return []
    ranges = min(HEAVY, -(-distinct // TOGETHER))
    ranged = stored(counts.repartitionByRange(ranges, "v").select("v", "count", F.spark_partition_id().alias("range")))
    left, before, held, cut = [s * total for s in shares], 0, [], F.lit(False)
    until = F.sum("count").over(Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    for r, n in sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.sum("count").alias("n")).collect()):
        while left and before + n >= left[0]:
            rest = left.pop(0) - before
            held.append(r)
            cut |= (F.col("range") == r) & (F.col("until") >= rest) & (F.col("until") - F.col("count") < rest)
        before += n
    found = ranged.where(F.col("range").isin(held)).withColumn("until", until).where(cut & F.col("v").isNotNull())
    return sorted(r["v"] for r in found.select("v").collect())


def _step(value: Column, cuts: list) -> Column:
    """How many of the distinct cuts the value reaches; none if it is null."""
    return sum((F.coalesce(value >= F.lit(c), F.lit(False)).cast("int") for c in dict.fromkeys(cuts)), F.lit(0))


def shard_rows(docs: DataFrame, shards: int = 24, dims: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = 4, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Return ``(doc_id, size, text_crc32, hilbert, shard, slot, row)`` under the law ``rows``: shards differ by one row at most.

    Each dimension is cut at its exact quantiles into 2**bits steps, a string by its whole value; the rows are ordered by the
    Hilbert index of their cell, then by a hash of doc_id, metadata and text. Row r of N goes to shard
    floor(r * shards / N). ``row`` holds the columns ``keep`` (all of the input).

    Null text: size 8, checksum 0 (of no bytes). Null metadata: the lowest step. Null doc_id: a value as any other.
    Repeated rows: each takes a slot of its own, which of them is open. Empty table: no row. Fewer rows
    than shards: some shards stay empty. Input columns of any name are kept apart inside ``row``.

    No window spans the table: a cell of the curve with many rows is split by the hash into parts of
    N / 8192 rows or so, and a part that repeated rows make larger by the number that each row got when it
    was written. Parts are numbered apart, and the offsets (below 40,000 numbers, whatever the input) are
    summed on the driver, which also reads up to HEAVY sums and the cuts of each dimension. The
    table is read for the cuts (the dimensions only) and once to place it; what is placed is stored.
    """
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    strings = [d for d in dims if isinstance(kinds[d], T.StringType)]
    values = {d: F.col(f"`{d}`") if d in strings else F.coalesce(F.col(f"`{d}`").cast("double"), F.lit(float("-inf"))) for d in dims}
    cuts = {d: _cuts(docs, values[d], steps) for d in dims}
    cells = [_step(values[d], cuts[d]) for d in dims]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    placed = stored(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            (F.octet_length(body) + 8).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            hilbert_index(cells, bits).alias("h"),
            F.xxhash64(F.col(f"`{doc_id}`"), *[F.col(f"`{d}`") for d in dims], body).alias("tie"),
            F.monotonically_increasing_id().alias("number"),
            F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
        )
    )
    cell_rows = {r["h"]: r["count"] for r in placed.groupBy("h").count().collect()}  # 2**(bits * dims) at most
    total = sum(cell_rows.values())
    each = max(1.0, total / BUCKETS)
    parts = {h: max(1, round(n / each)) for h, n in cell_rows.items()}
    n_parts = F.get(F.array(*[F.lit(parts.get(h, 1)) for h in range(1 << (bits * len(dims)))]), F.col("h").cast("int"))
    rows = placed.withColumn("part", F.floor((F.shiftrightunsigned("tie", 32) * n_parts) / F.lit(1 << 32)).cast("int"))
    spark = docs.sparkSession
    large = {(r["h"], r["part"]): round(r["count"] / each) for r in rows.groupBy("h", "part").count().where(F.col("count") > 2 * each).collect()}
    splits = spark.createDataFrame([(h, p, n) for (h, p), n in large.items()], "h long, part int, pieces int")
    rows = rows.join(F.broadcast(splits), ["h", "part"], "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("number"), "pieces").cast("int"), F.lit(0)))
    numbered = sorted((r["h"], r["part"], r["piece"], r["count"]) for r in rows.groupBy("h", "part", "piece").count().collect())
    offsets, before = [], 0
    for h, p, piece, n in numbered:
        offsets.append((h, p, piece, before))
        before += n
    starts = spark.createDataFrame(offsets, "h long, part int, piece int, before long")

    order = Window.partitionBy("h", "part", "piece").orderBy("tie", "number")
    rows = rows.join(F.broadcast(starts), ["h", "part", "piece"]).withColumn("r", F.col("before") + F.row_number().over(order) - 1)
    shard = F.expr(f"(r * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    out = rows.withColumn("shard", shard).withColumn("slot", F.col("r") - first)
    return out.select("doc_id", "size", "text_crc32", F.col("h").alias("hilbert"), F.col("shard").cast("int").alias("shard"), "slot", "row")


def digests(docs: DataFrame) -> DataFrame:
    out = shard_rows(docs, keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the rows into one folder per shard, in the order of the curve, for pruning by min and max."""
    out = shard_rows(docs, **options).select("shard", "slot", "row")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("shard", "slot", "row.*").write.mode("overwrite").partitionBy("shard").parquet(path)
