"""Mix sources to target weights by weighted sampling without replacement.

Each document draws the key ``-ln(u) / w`` (Efraimidis and Spirakis), with ``u`` from a hash of its id and
``w`` its quality weight. Within a source, documents are taken in the order of their keys: whole epochs first,
then the documents whose sizes, summed in key order, fit the rest of the source's token budget.

The order of a large source is never built in one task. The key is cut into ranges of about ``RANGE_ROWS``
documents; sums per range give each range its offset, and only rows inside one range are sorted together.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source, ordered last; a
null or non-positive weight counts as 1; repeated rows are documents of their own that share a key (ties go to
the smaller size); rows without an id draw their keys from their place in the input, so many of them spread over all ranges; an empty table gives no rows. Only ``doc_id``, ``source``, ``text`` and the labels' ``quality`` are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fanchart.llm.common import n_words, table
from fanchart.sources.materialize import materialized

#: Weights of the sources in code point order, repeating.
CYCLE = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Expected documents in one key range; bounds what one sort holds.
RANGE_ROWS = 2000


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from 52 bits of a digest of the id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), doc_id.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def row_name() -> Column:
    """The id as text; rows without one are named by their place, so that each has a key of its own."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))


def source_targets(sizes: DataFrame, cycle=CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs) -> the same with ``target``: weighted shares of the total, none above the cap.

    Ordered by cap per weight, the capped sources are a prefix; the rest share what those leave, by weight. The
    windows run over one row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle))) + 1).cast("int"))
    t = sizes.withColumns({"w": weight, "cap": F.col("source_size").cast("double") * max_epochs})
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    t = t.withColumn("pos", F.row_number().over(by_ratio))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    t = t.withColumn("level", (total - before) / rest)
    t = t.withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    level = F.min(F.when(~F.col("capped"), F.struct("pos", "level"))).over(W.partitionBy())["level"]
    t = t.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("w")))
    return t.select("source", "source_size", "n_docs", "target")


def mix(docs: DataFrame, *, cycle=CYCLE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, range_rows: int = RANGE_ROWS, carry: Sequence[str] = ()) -> DataFrame:
    """``docs`` (doc_id, source, size, weight, carried) -> doc_id, source, size, source_size, target, copies, taken, carried."""
    weight = F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(1.0)
    name = F.col("__name") if "__name" in docs.columns else row_name()
    sized = materialized(docs.select("doc_id", "source", "size", weight.alias("w"), *carry, name.alias("__name")), "mix-sized")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), cycle, max_epochs)
    s = targets.withColumnRenamed("source", "of")
    keyed = sized.join(s, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("key", -F.log(uniform(F.col("__name"), seed)) / F.col("w"))
    # 1 - exp(-key) rises with the key and is uniform for weight 1
    ranges = F.ceil(F.col("n_docs") / range_rows)
    keyed = keyed.withColumn("cut", F.least(ranges - 1, F.floor(ranges * (1 - F.exp(-F.col("key"))))).cast("long"))
    sums = keyed.groupBy("source", "cut").agg(F.sum("size").alias("in_cut"))
    offset = F.sum("in_cut").over(W.partitionBy("source").orderBy("cut")) - F.col("in_cut")
    offsets = sums.select(F.col("source").alias("of"), F.col("cut").alias("of_cut"), offset.alias("offset"))
    placed = keyed.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("cut") == F.col("of_cut"))).drop("of", "of_cut")
    inside = W.partitionBy("source", "cut").orderBy("key", "doc_id", "size", *carry).rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("upto", F.col("offset") + F.sum("size").over(inside))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("epochs", F.least(epochs, F.lit(max_epochs)).cast("long"))
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    # the document on the edge goes where its middle lies
    part = (F.col("size") > 0) & (F.col("epochs") < max_epochs) & (F.col("upto") - F.col("size") / 2 <= left)
    copies = F.when(F.col("size") > 0, F.col("epochs") + part.cast("long")).otherwise(F.lit(0).cast("long"))
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *carry)


def label_weight(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): 2 for labelled good, 0.5 for labelled poor; several labels of an id: the best."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q")).select("doc_id", F.expr("CASE WHEN q = 1 THEN 2.0D WHEN q = 0 THEN 0.5D ELSE 1.0D END").alias("weight"))


def sized_with_weight(docs: DataFrame, labels: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, weight, carried, __name): words are counted before anything is shuffled, so no text is."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *carry, row_name().alias("__name")).join(label_weight(labels), "doc_id", "left")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(sized_with_weight(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH sized AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN l.q = 1 THEN 2.0 WHEN l.q = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS w
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l USING (doc_id)),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap,
         (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w
  FROM sized GROUP BY source),
lev AS (
  SELECT *, row_number() OVER o AS pos,
         ((SELECT sum(source_size) FROM src)::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
tgt AS (
  SELECT source, source_size, CASE WHEN cap <= level * w THEN cap
         ELSE (SELECT arg_min(level, pos) FROM lev WHERE cap > level * w) * w END AS target
  FROM lev),
keyed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(floor(t.target / t.source_size), 3)::BIGINT ELSE 0 END AS epochs,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY
           -ln((('0x' || substr(md5('{SEED}:' || s.doc_id), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / s.w, s.doc_id, s.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN size > 0 AND epochs < 3 AND upto - size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM keyed
"""
