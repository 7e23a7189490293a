"""Aggregation, ranking and cross-unit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fanchart.operators import aggregate as A
from fanchart.operators import metrics as M
from fanchart.plans.bindings import LEVELS, rd, uniform_sql
from fanchart.plans.catalog.common import rounded
from fanchart.plans.registry import query

_MEANS = (
    "SELECT submission_id, (SELECT count(*) FROM units) AS n_expected, count_if(state = 'success') AS n_scored, "
    "(sum(CASE WHEN state = 'success' THEN counted ELSE CAST(0 AS DOUBLE) END) + ((SELECT count(*) FROM units) - count_if(state = 'success')) * CAST(4 AS DOUBLE)) / (SELECT count(*) FROM units) AS value FROM counted GROUP BY 1"
)


@query("agg1_clip_score", f"SELECT submission_id, unit_id, {rd('least(greatest((composite - 0.8) * 5, CAST(0 AS DOUBLE)), CAST(4 AS DOUBLE))', 5)} AS clipped FROM scored")
def clip(t):
    return rounded(t.scored.select("submission_id", "unit_id", A.clip_score((F.col("composite") - 0.8) * 5).alias("clipped")), 5)


@query("agg2_penalise", f"SELECT submission_id, unit_id, state, {rd('counted', 5)} AS counted FROM counted")
def penalise(t):
    return rounded(A.penalise(t.results).select("submission_id", "unit_id", "state", "counted"), 5)


@query("agg3_roster_mean", f"SELECT submission_id, {rd('value', 5)} AS value, n_expected, n_scored, n_expected - n_scored AS n_failure FROM means", {"means": _MEANS})
def roster_mean(t):
    return rounded(A.roster_mean(t.results, t.units), 5)


def _rows(t):
    good, _ = M.score_payload(t.scored, "ref_scale", "plan")
    failed = t.results.where("state = 'failure'").select("submission_id", "unit_id")
    failures = failed.withColumn("code", F.lit("no_output")).withColumn("counts", F.create_map(F.lit("missing_count"), F.lit(3).cast("long")))
    return A.to_rows(good.join(failed, ["submission_id", "unit_id"], "left_anti"), failures)


@query("agg4_to_rows", f"SELECT submission_id, unit_id, state, {rd('score', 5)} AS score, CASE WHEN state = 'failure' THEN 'no_output' END AS failure_code, CAST(CASE WHEN state = 'failure' THEN 1 ELSE 0 END AS INTEGER) AS n_detail, state = 'success' AS has_components FROM results")
def to_rows(t):
    return rounded(_rows(t).select(
        "submission_id", "unit_id", "state", "score", "failure_code", F.size("detail").alias("n_detail"), F.col("components").isNotNull().alias("has_components")
    ), 5)


@query("agg5_provenance", "SELECT submission_id, (SELECT count(*) FROM units) AS roster_count, (SELECT sha256(string_agg(unit_id, ',' ORDER BY unit_id)) FROM units) AS roster_digest, "
       "sha256(string_agg(concat_ws('|', unit_id, state, coalesce(printf('%.9f', round(score, 3)), ''), CASE WHEN state = 'failure' THEN 'no_output' ELSE '' END), chr(10) ORDER BY concat_ws('|', unit_id, state, coalesce(printf('%.9f', round(score, 3)), ''), CASE WHEN state = 'failure' THEN 'no_output' ELSE '' END))) AS results_digest, "
       "CAST(4 AS DOUBLE) AS failure_score, true AS clip FROM results GROUP BY 1")
def provenance(t):
    rows = _rows(t).withColumn("score", F.round("score", 3))
    return A.provenance(rows, t.units).select("submission_id", "roster_count", "roster_digest", "results_digest", "failure_score", "clip")


@query("agg6_leaderboard", f"SELECT submission_id, {rd('value', 5)} AS value, n_scored, CAST(rank() OVER (ORDER BY value) AS INTEGER) AS rank FROM means", {"means": _MEANS})
def leaderboard(t):
    board = A.leaderboard(A.roster_mean(t.results, t.units))
    return rounded(board.select("submission_id", "value", "n_scored", "rank"), 5)


def _boot(seed: int, tag: str) -> dict[str, str]:
    return {
        "clusters": "SELECT asof, row_number() OVER (ORDER BY asof) - 1 AS k, n FROM (SELECT asof, count(*) AS n FROM units GROUP BY 1)",
        f"picks{tag}": f"SELECT replicate, CAST(floor({uniform_sql('replicate', 'slot', seed)} * c) AS BIGINT) AS k, count(*) AS times FROM "
                       "(SELECT replicate, slot, (SELECT count(*) FROM clusters) AS c FROM (SELECT unnest(range(1000)) AS replicate) CROSS JOIN (SELECT unnest(range((SELECT count(*) FROM clusters))) AS slot)) GROUP BY 1, 2",
        "sums": "SELECT submission_id, asof, sum(counted - 4.0) AS s FROM counted GROUP BY 1, 2",
        f"whole{tag}": f"SELECT p.replicate, sum(c.n * p.times) AS n FROM picks{tag} p JOIN clusters c ON p.k = c.k GROUP BY 1",
        f"boots{tag}": f"SELECT b.submission_id, w.replicate, 4.0 + coalesce(v.s, 0) / w.n AS mean FROM (SELECT DISTINCT submission_id FROM counted) b CROSS JOIN whole{tag} w LEFT JOIN "
                       f"(SELECT u.submission_id, p.replicate, sum(u.s * p.times) AS s FROM sums u JOIN clusters c ON c.asof = u.asof JOIN picks{tag} p ON p.k = c.k GROUP BY 1, 2) v "
                       "ON v.submission_id = b.submission_id AND v.replicate = w.replicate",
        f"ci{tag}": f"SELECT submission_id, quantile_cont(mean, CAST(0.025 AS DOUBLE)) AS lo, quantile_cont(mean, CAST(0.975 AS DOUBLE)) AS hi FROM boots{tag} GROUP BY 1",
    }


@query("agg7_bootstrap_ci", f"SELECT submission_id, {rd('lo', 5)} AS lo, {rd('hi', 5)} AS hi FROM ci1", _boot(1, "1"))
def bootstrap_ci(t):
    return rounded(A.bootstrap_ci(t.results, t.units, seed=1), 5)


@query("agg8_uplift", f"SELECT submission_id, baseline, n_units, {rd('base - own', 5)} AS uplift FROM (SELECT o.submission_id, b.submission_id AS baseline, count(*) AS n_units, avg(b.counted) AS base, avg(o.counted) AS own FROM counted o "
       "JOIN counted b ON b.unit_id = o.unit_id WHERE b.submission_id IN ('hist', 'rw') AND o.submission_id NOT IN ('hist', 'rw') GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY submission_id ORDER BY base, baseline) = 1")
def uplift(t):
    """The better of two text-blind baselines."""
    return rounded(A.uplift(t.results, ["rw", "hist"]), 5)


@query("agg9_ablation_delta", f"SELECT 'text' AS submission_id, f.unit_id, {rd('h.composite - f.composite', 5)} AS delta FROM scored f JOIN scored h ON h.unit_id = f.unit_id WHERE f.submission_id = 'adj' AND h.submission_id = 'hist'")
def ablation_delta(t):
    run = lambda s: t.scored.where(F.col("submission_id") == s).select(F.lit("text").alias("submission_id"), "unit_id", F.col("composite").alias("score"))
    return rounded(A.ablation_delta(run("adj"), run("hist")), 5)


@query("agg10_by_family", f"SELECT submission_id, family, rank_group, count(*) AS n_units, {rd('avg(marginal)', 4)} AS marginal, {rd('avg(score)', 4)} AS score FROM results GROUP BY ROLLUP(submission_id, family, rank_group) HAVING submission_id IS NOT NULL")
def by_family(t):
    out = A.by_family(t.results.drop("family"), t.units)
    return rounded(out.select("submission_id", "family", "rank_group", "n_units", "marginal", "score"), 4)


@query(
    "agg11_sibling_leak",
    "SELECT unit_id, count(*) AS cells, CAST(sum(reach) AS BIGINT) AS reach_cells, CAST(sum(rw_) AS BIGINT) AS row_cells, CAST(sum(val) AS BIGINT) AS value_cells, CASE WHEN sum(val) = count(*) THEN 'full' WHEN sum(val) > 0 THEN 'part' ELSE 'none' END AS exposure FROM "
    "(SELECT r.unit_id, r.asset, r.horizon, max(CASE WHEN s.date IS NOT NULL THEN 1 ELSE 0 END) AS rw_, max(CASE WHEN s.value = r.value THEN 1 ELSE 0 END) AS val, "
    "max(CASE WHEN l.d >= r.target_date THEN 1 ELSE 0 END) AS reach FROM realized r LEFT JOIN cut s ON s.asset = r.asset AND s.date = r.target_date AND s.unit_id <> r.unit_id "
    "LEFT JOIN (SELECT unit_id, asset, max(date) AS d FROM cut GROUP BY 1, 2) l ON l.asset = r.asset AND l.unit_id <> r.unit_id GROUP BY 1, 2, 3) GROUP BY 1",
)
def sibling_leak(t):
    return A.sibling_leak(t.cut, t.realized)


@query("agg12_corpus_census", "SELECT source AS issuer, count(*) AS instances, count(DISTINCT sha256(text)) AS distinct_docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY 1 UNION ALL "
       "SELECT '(all)', count(*), count(DISTINCT sha256(text)), CAST(sum(octet_length(encode(text))) AS BIGINT) FROM documents")
def corpus_census(t):
    return A.corpus_census(t.read("documents").select(F.col("source").alias("issuer"), "text"))


@query("agg13_budget_audit", "SELECT 'run' AS submission_id, CAST(conv_id AS VARCHAR) AS unit_id, CAST(sum(CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END) AS BIGINT) AS tokens_in, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS tokens_out, "
       "sum(CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END) <= 500 AND sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) <= 800 AS within_budget FROM conversations GROUP BY 2")
def budget_audit(t):
    n = F.length("text").cast("long")
    out = F.col("role") == "assistant"
    usage = t.read("conversations").select(
        F.lit("run").alias("submission_id"), F.col("conv_id").cast("string").alias("unit_id"),
        F.when(out, 0).otherwise(n).alias("tokens_in"), F.when(out, n).otherwise(0).alias("tokens_out"),
    )
    return A.budget_audit(usage, 500, 800)


@query("agg14_rerun_overlap", f"SELECT a.submission_id, {rd('a.lo', 5)} AS lo, {rd('a.hi', 5)} AS hi, {rd('b.lo', 5)} AS lo2, {rd('b.hi', 5)} AS hi2, a.lo <= b.hi AND b.lo <= a.hi AS verified FROM ci1 a JOIN ci2 b ON a.submission_id = b.submission_id", {**_boot(1, "1"), **_boot(2, "2")})
def rerun_overlap(t):
    return rounded(A.rerun_overlap(A.bootstrap_ci(t.results, t.units, seed=1), A.bootstrap_ci(t.results, t.units, seed=2)), 5)


@query("agg15_parity", f"SELECT submission_id, unit_id, {rd('composite', 5)} AS a, {rd('composite + 1', 5)} AS b FROM scored WHERE unit_id LIKE 'F3-%'")
def parity(t):
    """Two scorings of the same draws in different row orders agree but for a planted change."""
    def path(draws):
        comps = M.components(draws, t.realized, t.units, LEVELS)
        return M.composite(comps, t.units, t.scale).select("submission_id", "unit_id", F.round("composite", 9).alias("score"))

    planted = F.when(F.col("unit_id").startswith("F3"), F.col("score") + 1).otherwise(F.col("score"))
    other = path(t.draws.repartition("draw")).withColumn("score", planted)
    return rounded(A.parity(path(t.draws), other), 5)


@query("agg16_phase_budget", "SELECT submission_id, status, count(*) AS runs, CAST(max(elapsed) AS BIGINT) AS elapsed FROM (SELECT submission_id, CASE WHEN elapsed > 9000 THEN 'unscored' WHEN seconds > 1800 THEN 'resource_timeout' ELSE 'completed' END AS status, elapsed FROM "
       "(SELECT 'c' || o_custkey AS submission_id, CAST(floor(o_totalprice / 100) AS BIGINT) AS seconds, sum(least(CAST(floor(o_totalprice / 100) AS BIGINT), 1800)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS elapsed FROM orders)) GROUP BY 1, 2")
def phase_budget(t):
    """A customer is a submission and its few orders are the units it runs."""
    runs = t.read("orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("submission_id"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderkey").cast("string").alias("unit_id"), F.floor(F.col("o_totalprice") / 100).alias("seconds"),
    )
    return A.phase_budget(runs, phase_seconds=9000).groupBy("submission_id", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.max("elapsed").alias("elapsed")
    )
