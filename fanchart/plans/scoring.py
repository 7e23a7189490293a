"""End-to-end plans: score all submissions on a roster, and produce baseline forecasts."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanchart import contract as C
from fanchart.contract import UNIT_KEYS
from fanchart.operators import aggregate as A
from fanchart.operators import gates as G
from fanchart.operators import generators as FC
from fanchart.operators import metrics as M
from fanchart.operators import panel as P
from fanchart.sources import readers as R
from fanchart.sources.materialize import materialized


@dataclass
class Evaluation:
    """Lazy tables of one evaluation."""

    organizer_faults: DataFrame
    refusals: DataFrame
    payload: DataFrame
    faults: DataFrame
    rows: DataFrame
    aggregates: DataFrame
    evidence: DataFrame


def organizer_faults(units: DataFrame, realized: DataFrame, scale: DataFrame, roster: DataFrame,
                     levels: tuple[float, ...], joint: tuple[str, ...]) -> DataFrame:
    """``(unit_id, fault)`` of everything that must stop the evaluation before any score counts."""
    cells = P.grid(units)
    broken = G.realized_exact(realized, cells).select("unit_id", F.lit("outcomes do not fill the grid").alias("fault"))
    absent = M.unscored(units, realized, roster).where("fault").select("unit_id", F.lit("no outcome").alias("fault"))
    unscaled = units.select("unit_id").join(scale.where("marginal > 0 AND tail > 0").select("unit_id"), "unit_id", "left_anti")
    parts = [
        G.grid_valid(units), M.metric_faults(units, levels, joint), broken, absent,
        unscaled.select("unit_id", F.lit("no usable scale").alias("fault")),
    ]
    if "target_dates" in units.columns:
        parts.append(G.declared_cutoff(units))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def score_submissions(tables: dict[str, DataFrame], realized: DataFrame, scale: DataFrame, roster: DataFrame,
                      levels: tuple[float, ...] = C.DEFAULT_TAIL_LEVELS, joint: tuple[str, ...] = ("variogram",), without: tuple[str, ...] = ()) -> Evaluation:
    """Gates, metrics and roster aggregation for every submission in one plan.

    Call ``raise_on_faults`` on ``organizer_faults`` and ``faults`` before publishing. Refused
    (submission, unit) keys leave the draws before any metric runs, so what is ranked is
    bounded by the contract (at most 20,000 draws per cell). ``without`` names ladder inputs that a
    smoke run does not have.
    """
    units = tables["units"]
    stop = organizer_faults(units, realized, scale, roster, levels, joint)
    refusals = materialized(G.run_ladder(tables, without), "refusals")
    clean = tables["draws"].join(G.admitted(tables, refusals), UNIT_KEYS, "left_semi")
    comps = M.components(clean, realized, units, levels, joint)
    scored = M.composite(comps, units, scale)
    payload, faults = M.score_payload(scored, "ref_scale", "plan")
    rows = A.to_rows(payload, refusals)
    evidence = evidence_digests(clean, realized)
    bare = G.evidence_present(rows.where("state = 'success'"), evidence, EVIDENCE).withColumn("fault", F.lit("a scored unit has no evidence"))
    faults = faults.select("submission_id", "unit_id", "fault").unionByName(row_faults(rows, roster)).unionByName(bare)
    return Evaluation(stop, refusals, payload, faults, rows, A.leaderboard(A.roster_mean(rows, roster)), evidence)


#: Digests that each scored unit must have.
EVIDENCE = ("draws_digest", "outcome_digest")


def evidence_digests(draws: DataFrame, realized: DataFrame) -> DataFrame:
    """``(U, draws_digest, outcome_digest)``: what was scored against what, whatever the order of rows."""
    of_draws = G.content_digest(draws, list(UNIT_KEYS), ["draw", "asset", "horizon", "value"], "draws_digest")
    of_outcomes = G.content_digest(realized, ["unit_id"], ["asset", "horizon", "value"], "outcome_digest")
    return of_draws.join(of_outcomes, "unit_id", "left").select(*UNIT_KEYS, *EVIDENCE)


def row_faults(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """``(submission_id, unit_id, fault)`` that must stop publication: repeated or foreign units, a mode or grid that is
    not rankable, a score that is not finite. Units without a row are failures of the participant, not faults."""
    none = F.lit(None).cast("string").alias("unit_id")
    cover = G.roster_coverage(rows, roster)
    fault = lambda df, text, unit=none: df.select("submission_id", unit, F.lit(text).alias("fault"))
    return (
        fault(cover.where("duplicate > 0"), "a unit has several rows")
        .unionByName(fault(cover.where("extra > 0"), "a unit is not in the roster"))
        .unionByName(fault(G.uniform_mode(rows), "a row is not normalised"))
        .unionByName(fault(G.grid_source(rows), "a row has no committed grid"))
        .unionByName(fault(A.nonfinite_scores(rows), "a score is not finite", F.col("unit_id")))
    )


def submission_tables(spark: SparkSession, root: str, units: DataFrame) -> dict[str, DataFrame]:
    """Every input of the ladder from a tree of submissions; each draws file is decoded once and written."""
    files = materialized(R.list_submission_files(spark, root), "listing")
    facts = materialized(R.inspect_draw_files(spark, root, files=files), "footers")
    decoded = materialized(R.decode_draws(facts), "decoded")
    broken = decoded.where("broken").select(*UNIT_KEYS, F.lit(True).alias("_broken")).distinct()
    facts = facts.join(broken, UNIT_KEYS, "left").withColumn("readable", F.col("readable") & F.col("_broken").isNull()).drop("_broken")
    meta, errors = R.read_meta(spark, root, files)
    return {
        "units": units, "files": files, "file_facts": facts, "meta": materialized(meta, "sidecars"), "meta_errors": errors,
        "rationales": R.read_rationales(spark, root, files), "draws": decoded.where("NOT broken").drop("broken"),
        "expected": files.select(*UNIT_KEYS).distinct().join(units.select("unit_id"), "unit_id", "left_semi"),
    }


def evaluate_tree(spark: SparkSession, unit_root: str, submission_root: str, plan_path: str,
                  levels: tuple[float, ...] = C.DEFAULT_TAIL_LEVELS, joint: tuple[str, ...] = ("variogram",)) -> Evaluation:
    """Score a tree of submissions against a tree of units and an evaluation plan.

    Units come from the plan; a submitted unit that the plan lacks is an organizer fault, as is every defect of cards,
    outcomes or scales. Call ``raise_on_faults`` on both fault tables before publishing.
    """
    roster, _ = R.read_roster(spark, plan_path)
    cards, card_faults = R.trusted_asof(R.read_units(spark, unit_root))
    units = materialized(R.resolve_grid(cards, roster).join(roster.select("unit_id"), "unit_id", "left_semi"), "units")
    realized = R.read_realized(spark, unit_root)
    scale = materialized(R.read_ref_scale(spark, unit_root, units), "scales")
    tables = submission_tables(spark, submission_root, units)
    ev = score_submissions(tables, realized, scale, roster, levels, joint)
    foreign = tables["files"].select("unit_id").distinct().join(roster.select("unit_id"), "unit_id", "left_anti")
    bare = roster.select("unit_id").join(units.select("unit_id"), "unit_id", "left_anti")
    stop = (
        ev.organizer_faults.unionByName(card_faults.select("unit_id", F.col("fault").cast("string")))
        .unionByName(scale.where("fault IS NOT NULL").select("unit_id", "fault"))
        .unionByName(foreign.select("unit_id", F.lit("submitted unit is not in the plan").alias("fault")))
        .unionByName(bare.select("unit_id", F.lit("a unit of the plan has no card").alias("fault")))
    )
    return replace(ev, organizer_faults=stop)


def publication_faults(spark: SparkSession, unit_root: str) -> DataFrame:
    """``(unit_id, fault)`` of a tree of units that must not be published: cards without an as-of, panel folders that are
    not as they should be, panels with rows after the as-of or dates that are none."""
    units, card_faults = R.trusted_asof(R.read_units(spark, unit_root))
    units = materialized(units, "units")
    cut = G.panel_cutoff(R.read_panels(spark, unit_root), units)
    late = F.when(F.col("malformed_dates") > 0, "a panel has a date that is none").when(F.col("late_rows") > 0, "a panel goes beyond the as-of")
    return (
        card_faults.select("unit_id", F.col("fault").cast("string")).unionByName(R.panel_faults(spark, unit_root, units))
        .unionByName(cut.select("unit_id", late.alias("fault")).where("fault IS NOT NULL"))
    )


def producer_faults(panel: DataFrame, units: DataFrame) -> DataFrame:
    """``(unit_id, fault)`` of units that no text-blind walk can be made for: an asset without a row up to the as-of,
    or too few common rows. Such units stop the producer; call ``raise_on_faults`` before writing its draws."""
    clean = P.drop_nonfinite(panel)
    absent = P.require_assets(clean, units).select("unit_id", F.lit("an asset has no row").alias("fault")).distinct()
    steps = P.gap_guard(P.first_diff(P.select_panel(P.asof_cut(clean, units))))
    short = P.short_history(steps, units).select("unit_id", F.lit("too few common rows").alias("fault"))
    return absent.unionByName(short)


def baseline_draws(panel: DataFrame, units: DataFrame, n_draws: int = C.DEFAULT_DRAWS, seed: int = 0) -> DataFrame:
    """The text-blind joint walk for all units: cut, choose panels, difference, align, correlate.

    Units named by :func:`producer_faults` have no draws.
    """
    history = P.select_panel(P.asof_cut(P.drop_nonfinite(panel), units))
    aligned = P.align(P.gap_guard(P.first_diff(history)), units)
    factors = FC.correlation_factors(aligned, units)
    return FC.rw_joint(factors, P.anchor(history), units, n_draws, seed).select(
        F.lit("baseline").alias("submission_id"), "unit_id", "draw", "asset", "horizon", "value"
    )
