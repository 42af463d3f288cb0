"""Line dedup, in DataFrame functions only: explode normalised lines, hash them, count distinct
documents per hash, drop lines over the threshold, reassemble the others by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY

STRIPPED = " \t\n\x0b\x0c\r"
#: Parts that the lines of one key are joined in.
SALTS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Return ``(n_lines, n_dropped, kept, row)`` for each row; ``row`` holds the columns ``keep`` of the input (all but the text).

    A key is a line without the six ASCII spaces at its ends and with A-Z lower-cased. Keys of at least
    ``min_chars`` code points that at least ``min_docs`` distinct doc_ids hold lose all their lines but
    those of the largest doc_id holding them.

    Null or empty text: one empty line, nothing dropped. Null doc_id: such rows count together as the
    smallest document. Repeated doc_id: one document for the count; every row is returned. Empty table:
    no row. Input columns of any name are kept apart inside ``row``.

    Only hashes of lines are shuffled for the count and the join. The count combines before its
    exchange, and the join on the hash is salted, so that the rows of a very common line are dealt out; no group of rows of
    one line is ever gathered. Texts move once, to meet the dropped positions of their document.
    """
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (keep or [c for c in docs.columns if c != text])]).alias("row"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_KEY)).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("body"),
    )
    ids = base.select("id", "body", F.xxhash64("body").alias("same"))
    lines = ids.select("id", "same", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(STRIPPED)), UPPER, LOWER)
    lines = lines.select("id", "same", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    lines = lines.select("id", "same", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))

    common = lines.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    # the lines of one key are joined in SALTS parts, and AQE may split these further
    common = common.select("h1", "h2", "keeper", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    gone = lines.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(common, ["h1", "h2", "salt"]).where("id <> keeper")
    gone = gone.groupBy("id", "same").agg(F.collect_set("pos").alias("gone"))

    whole = base.withColumn("same", F.xxhash64("body")).join(gone.hint("shuffle_hash"), ["id", "same"], "left")
    whole = whole.select("row", "body", F.split("body", "\n").alias("all"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.col("body")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("all", i)), "\n"))
    return whole.select(
        F.size("all").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        kept.alias("kept"),
        "row",
    )


def digests(docs: DataFrame) -> DataFrame:
    """What the query returns: counts and the hash of the kept text."""
    return line_dedup(docs, keep=["doc_id"]).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def deduped(docs: DataFrame, **options) -> DataFrame:
    """The input rows with the kept lines as text; documents that had text and lose all of it stay, empty."""
    out = line_dedup(docs, **options)
    text = options.get("text", "text")
    return out.select(*[F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, common.k IS NOT NULL AND keyed.doc_id <> common.keeper AS gone
  FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
