"""Results that several branches of a plan read are computed once, in the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def materialized(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in ``spark.checkpoint.dir`` (an own folder only where it is unset).

    Unlike a checkpoint it is computed once, not once more to be written, and a reader takes only the columns it asks for.
    """
    spark = df.sparkSession
    top = spark.sparkContext._jsc.sc().getCheckpointDir()
    top = top.get() if top.isDefined() else spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "styleloom-checkpoints")
    path = f"{top}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The same rows in several parts for each core, by a key: for steps that take long over few bytes, which Spark would leave in one task."""
    return df.repartition(max(8, 4 * df.sparkSession.sparkContext.defaultParallelism), key)
