"""Aggregation over a fixed roster, ranking and cross-unit analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanchart import contract as C
from fanchart.contract import UNIT_KEYS
from fanchart.functions.columns import clamp, is_finite
from fanchart.functions.hashing import uniform
from fanchart.operators.ranking import global_rank


def clip_score(c: str | Column) -> Column:
    """Into the metric domain. Refuse non-finite scores first: see :func:`nonfinite_scores`."""
    return clamp(c, C.DOMAIN_MIN, C.DOMAIN_MAX)


def nonfinite_scores(results: DataFrame) -> DataFrame:
    """Faults: a success row whose score is null, NaN or infinite."""
    return results.where((F.col("state") == "success") & ~is_finite("score"))


def penalise(results: DataFrame) -> DataFrame:
    """The counted value of each row: the worst value on failure, the clipped score otherwise."""
    return results.withColumn(
        "counted",
        F.when(F.col("state") == "failure", F.lit(C.FAILURE_SCORE)).otherwise(clip_score("score")),
    )


def roster_mean(results: DataFrame, roster: DataFrame) -> DataFrame:
    """Mean over the whole roster per submission; a unit without a row counts as a failure.

    The denominator is the size of the roster, so nothing is expanded per submission.
    """
    n = roster.agg(F.count_distinct("unit_id")).scalar()
    on_roster = roster.select("unit_id", F.lit(True).alias("_on")).distinct()
    rows = penalise(results.join(on_roster, "unit_id", "left"))
    # a repeated unit is a fault elsewhere; here it counts once, with its worst value
    one = rows.groupBy("submission_id", "unit_id").agg(
        F.max(F.when(F.col("_on"), F.when(is_finite("counted"), F.col("counted")).otherwise(C.FAILURE_SCORE))).alias("counted"),
        F.bool_and(F.coalesce("_on", F.lit(False)) & (F.col("state") == "success") & is_finite("score")).alias("scored"),
    )
    return (
        one.groupBy("submission_id")
        .agg(
            F.sum(F.when(F.col("scored"), F.col("counted")).otherwise(0.0)).alias("_sum"),
            F.count_if("scored").alias("n_scored"),
        )
        .withColumn("n_expected", n)
        .select(
            "submission_id",
            ((F.col("_sum") + (F.col("n_expected") - F.col("n_scored")) * C.FAILURE_SCORE) / F.col("n_expected")).alias("value"),
            "n_expected", "n_scored", (F.col("n_expected") - F.col("n_scored")).alias("n_failure"),
        )
    )


def to_rows(scored: DataFrame, failures: DataFrame) -> DataFrame:
    """Result rows: a success has an empty detail, a failure has no score."""
    empty = F.create_map().cast("map<string,bigint>")
    none = F.lit(None)
    ok = scored.select(
        *UNIT_KEYS, F.lit("success").alias("state"), "score", none.cast("string").alias("failure_code"),
        empty.alias("detail"), "normalization_mode", "grid_source",
        F.struct("marginal", "joint", "tail", "composite").alias("components"),
    )
    bad = failures.select(
        *UNIT_KEYS, F.lit("failure").alias("state"), none.cast("double").alias("score"),
        F.col("code").alias("failure_code"), F.col("counts").alias("detail"),
        F.lit("ref_scale").alias("normalization_mode"), F.lit("plan").alias("grid_source"),
        none.cast("struct<marginal:double,joint:double,tail:double,composite:double>").alias("components"),
    )
    return ok.unionByName(bad)


def provenance(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """Per submission: roster size and digest, domain, failure value, mode and results digest.

    Digests chain per-row digests in roster order; a submission has at most one row per roster unit.
    """
    roster_digest = F.sha2(F.array_join(F.sort_array(F.collect_set("unit_id")), ","), 256)
    row_text = F.concat_ws(
        "|", "unit_id", "state", F.when(F.col("score").isNull(), "").otherwise(F.format_string("%.9f", "score")),
        F.coalesce("failure_code", F.lit("")),
    )
    return rows.groupBy("submission_id").agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(row_text)), "\n"), 256).alias("results_digest")
    ).select(
        "submission_id", roster.agg(F.count_distinct("unit_id")).scalar().alias("roster_count"),
        roster.agg(roster_digest).scalar().alias("roster_digest"),
        F.lit(C.DOMAIN_MIN).alias("domain_min"), F.lit(C.DOMAIN_MAX).alias("domain_max"),
        F.lit(C.FAILURE_SCORE).alias("failure_score"), F.lit(True).alias("clip"),
        F.lit("asc").alias("direction"), F.lit("ref_scale").alias("normalization_mode"), "results_digest",
    )


def leaderboard(aggregates: DataFrame) -> DataFrame:
    """Lower is better; equal values share a rank. Submissions are ranked in sorted ranges of their distinct values."""
    ranked = global_rank(aggregates, "value", "rank")
    return ranked.withColumn("rank", F.col("rank").cast("int")).orderBy("rank", "submission_id")


def bootstrap_means(results: DataFrame, units: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """Mean over the roster per (submission, replicate), resampling whole clusters of units sharing an as-of.

    A unit without a row counts as a failure, as in :func:`roster_mean`: sums are kept as distances from the failure
    score, so absent units add nothing and the denominator is the roster's. Each replicate is a table of how often
    each cluster was picked, made once for all submissions, so comparisons between submissions are paired and no unit
    row is ever copied per replicate.
    """
    units = units.select("unit_id", "asof").distinct()
    counted = penalise(results).select("submission_id", "unit_id", "counted").join(units, "unit_id")
    sums = counted.groupBy("submission_id", "asof").agg(F.sum(F.col("counted") - C.FAILURE_SCORE).alias("s"))
    clusters = units.groupBy("asof").agg(F.count("unit_id").alias("n")).withColumn(
        "k", F.row_number().over(Window.orderBy("asof")) - 1  # one row per distinct as-of date
    )
    total = clusters.agg(F.count("k").alias("c"))
    slots = total.select(
        "c", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    ).select("replicate", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("slot"))
    picks = (
        slots.select("replicate", F.floor(uniform("replicate", "slot", seed) * F.col("c")).alias("k"))
        .groupBy("replicate", "k").agg(F.count("k").alias("times"))
        .join(clusters, "k")
    )
    whole = picks.groupBy("replicate").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    moved = sums.join(picks.select("replicate", "asof", "times"), "asof").groupBy("submission_id", "replicate").agg(F.sum(F.col("s") * F.col("times")).alias("s"))
    every = results.select("submission_id").distinct().select(
        "submission_id", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    )
    out = every.join(whole, "replicate").join(moved, ["submission_id", "replicate"], "left")
    return out.select("submission_id", "replicate", (F.lit(C.FAILURE_SCORE) + F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"))


def bootstrap_ci(results: DataFrame, units: DataFrame, replicates: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Clustered bootstrap interval of each submission's mean."""
    tail = (1.0 - level) / 2.0
    return bootstrap_means(results, units, replicates, seed).groupBy("submission_id").agg(
        F.percentile("mean", F.lit(tail)).alias("lo"),
        F.percentile("mean", F.lit(1.0 - tail)).alias("hi"),
    )


def uplift(results: DataFrame, baselines: list[str]) -> DataFrame:
    """Best text-blind baseline mean minus own mean, on the units both were scored on.

    Each pair of submission and baseline is compared on its common units only.
    """
    rows = penalise(results)
    base = rows.where(F.col("submission_id").isin(*baselines)).select(
        "unit_id", F.col("submission_id").alias("baseline"), F.col("counted").alias("_b")
    )
    pairs = rows.where(~F.col("submission_id").isin(*baselines)).join(base, "unit_id")
    means = pairs.groupBy("submission_id", "baseline").agg(
        F.avg("counted").alias("own"), F.avg("_b").alias("base"), F.count("counted").alias("n_units")
    )
    return means.groupBy("submission_id").agg(
        F.min(F.struct("base", "baseline", "own", "n_units")).alias("m")
    ).select(
        "submission_id", F.col("m.baseline").alias("baseline"), F.col("m.n_units").alias("n_units"),
        (F.col("m.base") - F.col("m.own")).alias("uplift"),
    )


def ablation_delta(full: DataFrame, ablated: DataFrame) -> DataFrame:
    """Ablated minus full per (submission, unit); positive means the text helped."""
    return full.select(*UNIT_KEYS, F.col("score").alias("_f")).join(
        ablated.select(*UNIT_KEYS, F.col("score").alias("_a")), UNIT_KEYS
    ).select(*UNIT_KEYS, (F.col("_a") - F.col("_f")).alias("delta"))


def by_family(scored: DataFrame, units: DataFrame) -> DataFrame:
    """Means per family and rank group with subtotals; a subtotal has a null key."""
    rows = scored.join(units.select("unit_id", "family"), "unit_id")
    return rows.rollup("submission_id", "family", "rank_group").agg(
        F.count(F.lit(1)).alias("n_units"), F.avg("marginal").alias("marginal"),
        F.avg("joint").alias("joint"), F.avg("tail").alias("tail"), F.avg("score").alias("score"),
    ).where(F.col("submission_id").isNotNull())


def sibling_leak(panel: DataFrame, realized: DataFrame) -> DataFrame:
    """How far each unit's answers are readable in another unit's panel, at three strengths.

    ``reach``: a sibling's panel carries the asset past the target date; ``row``: it has that very
    (asset, date); ``value``: with the same value. Panel rows collapse to distinct (asset, date,
    value) with the first two owners, and coverage to one range per (unit, asset), before any join:
    a row copied into every unit is met once, not once per copy.
    """
    cells = realized.select(
        "unit_id", "asset", "horizon", "target_date", F.col("value").alias("y")
    )
    held = panel.groupBy("asset", F.col("date").alias("target_date"), "value").agg(
        F.min("unit_id").alias("o1"), F.max("unit_id").alias("o2")
    )
    foreign = (F.col("o1") != F.col("unit_id")) | (F.col("o2") != F.col("unit_id"))
    exact = (
        cells.join(held, ["asset", "target_date"]).where(foreign)
        .groupBy("unit_id", "asset", "horizon")
        .agg(F.max((F.col("value") == F.col("y")).cast("int")).alias("value_hit"))
    )
    last = panel.groupBy("unit_id", "asset").agg(F.max("date").alias("d"))
    # the two furthest-reaching units per asset are enough to know whether another one reaches
    top = last.groupBy("asset").agg(F.max(F.struct("d", "unit_id")).alias("t1"))
    second = (
        last.join(top, "asset").where(F.col("unit_id") != F.col("t1.unit_id"))
        .groupBy("asset").agg(F.max("d").alias("d2"))
    )
    reach = top.join(second, "asset", "left")
    other = F.when(F.col("t1.unit_id") == F.col("unit_id"), F.col("d2")).otherwise(F.col("t1.d"))
    per_cell = (
        cells.join(reach, "asset", "left").join(exact, ["unit_id", "asset", "horizon"], "left")
        .select(
            "unit_id",
            F.coalesce(other >= F.col("target_date"), F.lit(False)).cast("int").alias("reach"),
            F.col("value_hit").isNotNull().cast("int").alias("row"),
            F.coalesce("value_hit", F.lit(0)).alias("value"),
        )
    )
    return per_cell.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("reach").alias("reach_cells"),
        F.sum("row").alias("row_cells"), F.sum("value").alias("value_cells"),
    ).withColumn(
        "exposure",
        F.when(F.col("value_cells") == F.col("cells"), "full").when(F.col("value_cells") > 0, "part").otherwise("none"),
    )


def corpus_census(docs: DataFrame) -> DataFrame:
    """``(issuer, text)``: instances, distinct documents and bytes per issuer, with a total row.

    Copies fold to one row per (issuer, digest) map-side, so a document copied a billion times is
    one counter; the total counts a document shared by issuers once.
    """
    per_doc = docs.groupBy("issuer", F.sha2(F.col("text"), 256).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")
    )
    per_issuer = per_doc.groupBy("issuer").agg(
        F.sum("n").alias("instances"), F.count("h").alias("distinct_docs"), F.sum("b").alias("bytes")
    )
    total = per_doc.groupBy("h").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).agg(
        F.sum("n").alias("instances"), F.count("h").alias("distinct_docs"), F.sum("b").alias("bytes")
    ).withColumn("issuer", F.lit("(all)"))
    return per_issuer.unionByName(total)


def budget_audit(usage: DataFrame, max_in: int = C.MAX_TOKENS_IN, max_out: int = C.MAX_TOKENS_OUT) -> DataFrame:
    """Token use per (submission, unit) against the budget. ``usage`` is ``(U, tokens_in, tokens_out)``."""
    return usage.groupBy(*UNIT_KEYS).agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")
    ).withColumn("within_budget", (F.col("tokens_in") <= max_in) & (F.col("tokens_out") <= max_out))


def rerun_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two runs agree when their intervals overlap."""
    b = second.select("submission_id", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return first.join(b, "submission_id").select(
        "submission_id", "lo", "hi", "lo2", "hi2",
        ((F.col("lo") <= F.col("hi2")) & (F.col("lo2") <= F.col("hi"))).alias("verified"),
    )


def parity(left: DataFrame, right: DataFrame, c: str = "score") -> DataFrame:
    """Rows on which two scoring paths do not give the identical number."""
    l = left.select(*UNIT_KEYS, F.col(c).alias("a"), F.lit(True).alias("_l"))
    r = right.select(*UNIT_KEYS, F.col(c).alias("b"), F.lit(True).alias("_r"))
    both = l.join(r, UNIT_KEYS, "full_outer")
    same = F.col("a").eqNullSafe(F.col("b")) & F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.where(~same).select(*UNIT_KEYS, "a", "b")


def phase_budget(runs: DataFrame, unit_seconds: int = C.UNIT_SECONDS, phase_seconds: int = C.PHASE_SECONDS) -> DataFrame:
    """``(submission_id, seq, unit_id, seconds)`` in running order: completed, failed or unscored.

    A unit past its own ceiling is stopped there and fails; units that would start after the phase
    budget is used up, or end past it, are unscored. A submission runs each roster unit once.
    """
    used = F.least("seconds", F.lit(unit_seconds))
    w = Window.partitionBy("submission_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    state = (
        F.when(F.col("elapsed") > phase_seconds, "unscored")
        .when(F.col("seconds") > unit_seconds, "resource_timeout")
        .otherwise("completed")
    )
    return runs.withColumn("elapsed", F.sum(used).over(w)).withColumn("status", state)
