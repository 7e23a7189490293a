"""Dated text corpora: as-of selection, prompt context and overlap audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanchart.contract import MAX_DOC_CHARS, MAX_DOCS
from fanchart.operators.shared_runs import longest_shared_run  # noqa: F401


def docs_asof(index: DataFrame, docs: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Indexed documents dated at or before the as-of and present on disk, and the excluded count.

    ``index`` is ``(unit_id, pos, doc_id, timestamp, doc_type, source, path)``, ``docs`` is
    ``(unit_id, path, text)``. A document with no index entry is never read.
    """
    asof = units.select("unit_id", F.col("asof").cast("string").alias("_asof"))
    stamp = F.substring(F.coalesce(F.col("timestamp").cast("string"), F.lit("")), 1, 10)
    dated = index.join(asof, "unit_id").withColumn("timestamp", stamp)
    ok = (F.col("timestamp") != "") & (F.col("timestamp") <= F.col("_asof"))
    kept = dated.where(ok).join(docs, ["unit_id", "path"]).drop("_asof")
    total = index.groupBy("unit_id").agg(F.count(F.lit(1)).alias("_n"))
    read = kept.groupBy("unit_id").agg(F.count(F.lit(1)).alias("kept"))
    counts = total.join(read, "unit_id", "left").select(
        "unit_id", F.coalesce("kept", F.lit(0)).alias("kept"),
        (F.col("_n") - F.coalesce("kept", F.lit(0))).alias("excluded"),
    )
    return kept, counts


def newest_k(docs: DataFrame, k: int = MAX_DOCS) -> tuple[DataFrame, DataFrame]:
    """The k newest documents per unit, ties in index order, and how many the budget dropped.

    Rank filters on ``row_number`` keep at most k rows per task before the shuffle, so a unit with
    an enormous corpus does not gather in one task.
    """
    w = Window.partitionBy("unit_id").orderBy(F.desc("timestamp"), "pos")
    top = docs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    dropped = docs.groupBy("unit_id").agg(
        F.greatest(F.lit(0).cast("long"), F.count(F.lit(1)) - k).alias("dropped")
    )
    return top, dropped


def truncate_doc(c: str | Column, chars: int = MAX_DOC_CHARS) -> Column:
    """The prompt budget per document. Audits read whole texts; only prompts are cut."""
    return F.substring(c, 1, chars)


def context_pack(top: DataFrame, stats: DataFrame, units: DataFrame, instruction: str = "") -> DataFrame:
    """The ordered context of each unit: assets with level and horizon deviation, then documents, then the instruction.

    ``top`` is the output of :func:`newest_k`; ``stats`` is ``(unit_id, asset, last, sd_h)``. Both
    lists are bounded: k documents and the assets of one grid.
    """
    order = units.select("unit_id", F.posexplode("asset_ids").alias("i", "asset"))
    level = F.format_string("  %s: level %.6f, horizon sd %.6f", "asset", "last", "sd_h")
    assets = order.join(stats, ["unit_id", "asset"]).groupBy("unit_id").agg(
        F.sort_array(F.collect_list(F.struct("i", level.alias("line")))).alias("_a")
    )
    header = F.format_string("--- %s (%s, %s) ---", F.col("doc_id").cast("string"), "timestamp", "doc_type")
    body = F.concat_ws("\n", header, truncate_doc("text"))
    papers = top.groupBy("unit_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", body.alias("line")))).alias("_d")
    )
    empty = F.array().cast("array<string>")
    lines = F.concat(
        F.array(
            F.concat(F.lit("As-of date: "), F.col("asof").cast("string")),
            F.concat(F.lit("Target type: "), "target_type", F.lit(". Horizons: "), F.array_join(F.col("horizons").cast("array<string>"), ", ")),
        ),
        F.coalesce(F.col("_a.line"), empty),
        F.array(F.concat(F.lit("Documents: "), F.coalesce(F.size("_d"), F.lit(0)).cast("string"))),
        F.coalesce(F.col("_d.line"), empty), F.array(F.lit(instruction)) if instruction else empty,
    )
    return (
        units.join(assets, "unit_id", "left").join(papers, "unit_id", "left")
        .select("unit_id", F.array_join(lines, "\n").alias("context"))
    )


def doc_header(c: str | Column) -> list[Column]:
    """Fields of a leading ``# source: .. | date: .. | type: ..`` line."""
    grab = lambda name: F.regexp_extract(c, rf"(?m)^#.*?{name}:\s*([^|\n]*?)\s*(?:\||$)", 1)
    return [grab("source").alias("h_source"), grab("date").alias("h_date"), grab("type").alias("h_type")]


def sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentences of whole texts, white space folded; empty ones are left out."""
    s = F.trim(F.regexp_replace(F.col("s"), r"\s+", " "))
    return docs.select(key, F.posexplode(F.split("text", r"(?<=[.!?])\s+|\n+")).alias("pos", "s")).select(
        key, "pos", s.alias("sentence")
    ).where(F.col("sentence") != "")


def passage_overlap(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """Per document: sentences, and how many occur verbatim in some reference.

    References reduce to distinct sentence digests and the join is a semi-join, so a sentence
    repeated in a third of both sides never multiplies rows.
    """
    known = sentences(refs, "ref_id").select(F.sha2("sentence", 256).alias("h")).distinct().withColumn("_k", F.lit(1))
    mine = sentences(docs).select("doc_id", F.sha2("sentence", 256).alias("h")).groupBy("doc_id", "h").agg(
        F.count(F.lit(1)).alias("n")
    )
    return mine.join(known, "h", "left").groupBy("doc_id").agg(
        F.sum("n").alias("sentences"),
        F.sum(F.when(F.col("_k").isNotNull(), F.col("n")).otherwise(0)).alias("verbatim"),
    )


def phrase_search(docs: DataFrame, patterns: dict[str, str], control: str) -> DataFrame:
    """Documents and hits per pattern, with a planted control that every pattern set must find.

    Patterns are a short list held in code and become one projection over whole texts. ``control``
    is a phrase searched in a planted text beside the corpus: its count proves the search fires.
    """
    planted = docs.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("doc_id"), F.lit(f"planted {control} text").alias("text")
    )
    corpus = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").unionByName(planted)
    tests = {**patterns, "control": control}
    hits = F.explode(
        F.array(
            *[F.struct(F.lit(name).alias("pattern"), F.regexp_count("text", F.lit(p)).alias("n"))
              for name, p in tests.items()]
        )
    )
    return corpus.select(hits.alias("h")).groupBy("h.pattern").agg(
        F.count_if(F.col("h.n") > 0).alias("documents"), F.sum("h.n").alias("hits")
    )


def positioning_table(docs: DataFrame) -> DataFrame:
    """Fixed-width weekly rows in a text to typed rows; repeated dates are kept."""
    line = F.explode(F.split("text", "\n")).alias("line")
    row = r"^\s*(\d{4}-\d{2}-\d{2})\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)\s*$"
    names = ["open_interest", "noncomm_long", "noncomm_short", "noncomm_net"]
    return docs.select("doc_id", line).where(F.col("line").rlike(row)).select(
        "doc_id", F.to_date(F.regexp_extract("line", row, 1)).alias("report_date"),
        *[F.regexp_extract("line", row, i + 2).cast("bigint").alias(n) for i, n in enumerate(names)],
    )

