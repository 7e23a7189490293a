"""Helpers shared by the operators for training corpora."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, newline, vertical tab, form feed and carriage return: the separators of words in all contracts.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes of an Arrow batch, where the session sets none: tasks hold a batch as Arrow data in the executor and as objects in its worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SPARKS_OWN, BATCH = "67108864b", 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded in bytes; 10,000 rows of text know no such bound."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES) == SPARKS_OWN:
        conf.set(BATCH_BYTES, f"{BATCH}b")
    return df


def map_rows(df: DataFrame, fn: Callable, schema: str, *args) -> DataFrame:
    """``fn(batch, *args)`` on every Arrow batch; it returns a dict of columns in the order of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(batch, *args))

    return small_batches(df).mapInArrow(run, schema)


def workers(df: DataFrame) -> int:
    """Partitions to deal bounded groups of work to: the session's shuffle parallelism."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
