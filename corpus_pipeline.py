"""A training corpus from ``documents``: five stages, each written and read again as the next one's input.

toxicity drops the documents that score 0.5 or more; line_dedup takes shared lines out of the texts; near_dedup keeps
one document of each group of near duplicates (shingle sets of similarity ``NEAR_PERCENT`` / 100 or more); mixing repeats or drops documents so that sources meet their target
weights; bpe encodes what is left and decodes it again. All stages but the last return the columns of their input;
``n_chars``, where present, follows the text.

Documents whose text has no words have nothing to mix and end at mixing; all others, with or without an id, get the
copies that the mix gives their row. Copies that mixing adds are rows of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanchart.llm import bpe, lines, mixing, near_dup, toxicity
from fanchart.llm.common import table
from fanchart.sources.materialize import materialized, shared_folder

#: No SQL: nearest neighbours, signatures and tokenization are beyond it. Tests hold run() against brute force.
ORACLE_SQL = None
#: Similarity of near duplicates in percent; op2_near_dup has a contract of its own.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, carry=[c for c in docs.columns if c not in ("doc_id", "text")], keep_text=True)
    return _columns(scored.where(F.col("score") < 0.5), docs, F.col("text"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    kept = F.when((F.col("n_dropped") == 0) & F.col("no_text"), F.lit(None)).otherwise(F.col("kept"))
    return _columns(out, docs, kept, F.col("n_dropped") > 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that share a doc_id all stay or go together."""
    gone = near_dup.near_duplicates(docs, NEAR_PERCENT).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # ids may be absent or repeated: rows are written once with a key of their own
    rows = materialized(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
    mixed = mixing.mix(mixing.sized_with_weight(rows, table(spark, sf_dir, "labels"), carry=["__row"]), carry=["__row"])
    copies = mixed.where("copies > 0").select(F.col("__row").alias("__of"), F.col("copies").cast("int").alias("__times"))
    out = rows.join(copies, F.col("__row") == F.col("__of")).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__times"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.vocabulary())


def _columns(out: DataFrame, docs: DataFrame, text: Column, changed: Column | None = None) -> DataFrame:
    """The columns of ``docs`` from a carried row and the new text."""
    made = []
    for c in docs.columns:
        if c == "text":
            made.append(text.alias(c))
        elif c == "n_chars":
            made.append(F.when(F.lit(False) if changed is None else changed, F.length(text)).otherwise(F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c))
        else:
            made.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*made)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_decode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
