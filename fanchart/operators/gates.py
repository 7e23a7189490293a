"""Data-quality gates over all submissions at once.

A participant refusal is a row ``(submission_id, unit_id, gate, check_no, code, counts)``; an
organizer fault is a row of a separate table that must stop the job (:func:`raise_on_faults`). Each
check is an aggregate whose partial counts fold map-side, so a submission holding a third of all
rows costs its tasks no more than any other rows do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanchart import contract as C
from fanchart.contract import UNIT_KEYS
from fanchart.functions.columns import is_finite, is_iso
from fanchart.sources.materialize import materialized

GATES = ("g0_integrity", "g1_schema", "g2_cutoff_resource", "g3_domain_semantics")
REFUSAL_COLUMNS = [*UNIT_KEYS, "gate", "check_no", "code", "counts"]
#: The order in which checks decide.
CHECK = {name: i for i, name in enumerate((
    "file_set", "size_limits", "meta_errors", "meta_schema", "rationale_file", "rationale_bit", "bind_meta", "declared_grid", "readable",
    "footer_limits", "draw_range", "row_count", "column_set", "draw_ids", "labels_in_grid", "finite_values", "exactly_once", "unproven",
), 1)}


class OrganizerFault(RuntimeError):
    """Organizer material is defective: abort instead of charging a participant."""


def raise_on_faults(faults: DataFrame, what: str) -> None:
    """One count on the driver; raise when any fault row exists."""
    n = faults.count()
    if n:
        raise OrganizerFault(f"{what}: {n} fault row(s)")


def refusal(rows: DataFrame, bad: Column, gate: str, check_no: int, code: str | Column, **counts: Column | int) -> DataFrame:
    """Rows where ``bad`` holds, in the common refusal shape with integer counts only."""
    pairs: list[Column] = []
    for name, value in counts.items():
        value = value if isinstance(value, Column) else F.lit(value)
        pairs += [F.lit(name), value.cast("long")]
    detail = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,bigint>")
    return rows.where(bad).select(
        *UNIT_KEYS, F.lit(gate).alias("gate"), F.lit(check_no).alias("check_no"),
        (code if isinstance(code, Column) else F.lit(code)).alias("code"), detail.alias("counts"),
    )


# ---- g0: file set and sizes ------------------------------------------------------------------

def file_set(files: DataFrame, expected: DataFrame) -> DataFrame:
    """No entry beyond the three expected files, and the draws and the sidecar among them as regular files.

    ``files`` is ``(U, name, length)`` and, where a tree was listed, ``kind``; ``expected`` lists U. The rationale's
    absence belongs to the schema gate (:func:`rationale_file`). Counts come from flags summed per submission; no file
    listing is gathered.
    """
    regular = F.col("kind") == "file" if "kind" in files.columns else F.lit(True)
    known = F.col("name").isin(*C.SUBMISSION_FILES)
    needed = C.SUBMISSION_FILES[:2]
    seen = files.groupBy(*UNIT_KEYS).agg(
        F.count_if(~known).alias("extra"),
        *[F.count_if(F.col("name") == n).alias(f"has_{i}") for i, n in enumerate(needed)],
        *[F.count_if((F.col("name") == n) & ~regular).alias(f"odd_{i}") for i, n in enumerate(needed)],
    )
    rows = expected.select(*UNIT_KEYS).join(seen, UNIT_KEYS, "left")
    present = sum((F.least(F.coalesce(f"has_{i}", F.lit(0)), F.lit(1)) for i in range(len(needed))), F.lit(0))
    extra = F.coalesce("extra", F.lit(0))
    odd = sum((F.coalesce(f"odd_{i}", F.lit(0)) for i in range(len(needed))), F.lit(0))
    # the first file that is absent or not regular decides
    code = F.when(extra > 0, "schema_invalid")
    for i in range(len(needed)):
        code = code.when(F.coalesce(f"has_{i}", F.lit(0)) == 0, "no_output").when(F.col(f"odd_{i}") > 0, "malformed_output")
    return refusal(
        rows, (extra > 0) | (present < len(needed)) | (odd > 0), GATES[0], CHECK["file_set"], code,
        extra_count=extra, missing_count=F.lit(len(needed)) - present, expected_count=len(C.SUBMISSION_FILES), rejected_node_count=odd,
    )


def file_sizes(files: DataFrame) -> DataFrame:
    """``(U, draws_bytes, meta_bytes, rationale_bytes)`` of the listed files; null where a file is absent."""
    size = lambda n: F.max(F.when(F.col("name") == n, F.col("length")))
    names = zip(C.SUBMISSION_FILES, ("draws_bytes", "meta_bytes", "rationale_bytes"))
    return files.groupBy(*UNIT_KEYS).agg(*[size(n).alias(a) for n, a in names])


def _first_over(facts: DataFrame, rules: list[tuple[Column, Column | int, str]], gate: str, check_no: int) -> DataFrame:
    """A refusal by the first rule ``(observed, ceiling, code)`` that is exceeded."""
    hit = [
        F.when(seen > limit, F.struct(F.lit(code).alias("code"), seen.cast("long").alias("observed"), (F.lit(limit) if isinstance(limit, int) else limit).cast("long").alias("expected")))
        for seen, limit, code in rules
    ]
    rows = facts.withColumn("_hit", F.coalesce(*hit))
    return refusal(
        rows, F.col("_hit").isNotNull(), gate, check_no, F.col("_hit.code"),
        observed_count=F.col("_hit.observed"), expected_count=F.col("_hit.expected"),
    )


def size_limits(sizes: DataFrame) -> DataFrame:
    """Byte ceilings of the draws file and the sidecar, known from the listing alone."""
    return _first_over(sizes, [
        (F.col("draws_bytes"), C.MAX_DRAWS_FILE_BYTES, "malformed_output"),
        (F.col("meta_bytes"), C.MAX_META_BYTES, "malformed_output"),
    ], GATES[0], CHECK["size_limits"])


def footer_limits(facts: DataFrame) -> DataFrame:
    """What the draws file says about itself: readable at all, row groups, columns, rows, decompressed size.

    ``facts`` is one row per submission: ``(U, row_groups, n_columns, n_distinct_columns, n_rows,
    uncompressed_bytes)`` and, where files were opened, ``readable``.
    """
    limits = _first_over(facts, [
        (F.col("row_groups"), C.MAX_ROW_GROUPS, "malformed_output"),
        (F.col("n_columns"), C.MAX_COLUMNS, "schema_invalid"),
        (F.col("n_columns"), F.col("n_distinct_columns"), "schema_invalid"),
        (F.col("n_rows"), C.MAX_ROWS, "malformed_output"),
        (F.col("uncompressed_bytes"), C.MAX_UNCOMPRESSED_BYTES, "malformed_output"),
    ], GATES[3], CHECK["footer_limits"])
    if "readable" not in facts.columns:
        return limits
    broken = refusal(facts, F.col("draws_bytes").isNotNull() & ~F.coalesce("readable", F.lit(False)), GATES[3], CHECK["readable"], "malformed_output")
    return broken.unionByName(limits)


# ---- g1: sidecar schema ----------------------------------------------------------------------

def meta_schema(meta: DataFrame) -> DataFrame:
    """Required keys, the one accepted representation, and an integer draw count in range.

    ``meta`` comes from :func:`fanchart.sources.readers.parse_meta`: ``n_draws_type`` is the JSON
    type of the declared count, so a boolean or a decimal is refused although it could be cast.
    """
    required = ["unit_id", "asof", "representation", "asset_ids", "horizons"]
    missing = sum((F.col(c).isNull().cast("int") for c in required), F.lit(0))
    n = F.col("n_draws")
    integer = F.col("n_draws_type") == "integer"
    in_range = n.between(C.MIN_DRAWS, C.MAX_DRAWS)
    bad = (missing > 0) | (F.coalesce("representation", F.lit("")) != "samples") | ~F.coalesce(
        integer & in_range, F.lit(False)
    )
    # counts are public for a count out of range only, and that is looked at last
    only_range = (missing == 0) & (F.col("representation") == "samples") & integer
    out = refusal(meta, bad, GATES[1], CHECK["meta_schema"], "schema_invalid", observed_count=F.when(only_range, F.greatest(n, F.lit(0))), expected_count=F.when(only_range, C.MIN_DRAWS))
    return out.withColumn("counts", F.map_filter("counts", lambda k, v: v.isNotNull()))


def rationale_bit(rationales: DataFrame) -> DataFrame:
    """``(U, text)``: at least one non-whitespace character; nothing else is read."""
    blank = ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    return refusal(rationales, blank, GATES[1], CHECK["rationale_bit"], "schema_invalid")


def rationale_file(sizes: DataFrame) -> DataFrame:
    """The rationale exists and is not over its ceiling; its content is :func:`rationale_bit`'s."""
    n = F.col("rationale_bytes")
    code = F.when(n.isNull(), "no_output").otherwise("malformed_output")
    return refusal(sizes, n.isNull() | (n > C.MAX_RATIONALE_BYTES), GATES[1], CHECK["rationale_file"], code)


# ---- g2: binding and cutoffs -----------------------------------------------------------------

def bind_meta(meta: DataFrame, units: DataFrame) -> DataFrame:
    """The sidecar agrees with the trusted unit on as-of, identity and, if declared, target.

    ``meta`` is keyed by the unit it was submitted for; ``declared_unit`` is what it says.
    """
    want = units.select(
        "unit_id", F.col("asof").cast("string").alias("want_asof"), F.col("target_type").alias("want_target")
    )
    rows = meta.join(want, "unit_id")
    unreadable = ~is_iso("asof")
    late = ~unreadable & (F.col("asof") != F.col("want_asof"))
    other = ~(F.col("declared_unit").eqNullSafe(F.col("unit_id")))
    target = F.col("target").isNotNull() & F.col("want_target").isNotNull() & (F.col("target") != F.col("want_target"))
    code = F.when(unreadable, "schema_invalid").when(late, "cutoff_violation").otherwise("schema_invalid")
    out = refusal(rows, unreadable | late | other | target, GATES[2], CHECK["bind_meta"], code, violation_count=F.when(~unreadable, 1))
    return out.withColumn("counts", F.map_filter("counts", lambda k, v: v.isNotNull()))


def declared_cutoff(units: DataFrame) -> DataFrame:
    """Faults: a target date that is no ISO date or not strictly after the as-of."""
    asof = F.col("asof").cast("string")
    bad_format = F.exists("target_dates", lambda d: ~F.coalesce(d.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)))
    early = F.exists("target_dates", lambda d: d <= asof)
    return units.where(F.coalesce(bad_format | early, F.lit(False))).select(
        "unit_id", F.when(bad_format, "target date is not ISO").otherwise("target date not after as-of").alias("fault")
    )


# ---- g3: domain semantics --------------------------------------------------------------------

def declared_grid(meta: DataFrame, units: DataFrame) -> DataFrame:
    """The declared axes equal the committed ones in order; repeats are reported first."""
    want = units.select("unit_id", F.col("asset_ids").alias("wa"), F.col("horizons").alias("wh"))
    rows = meta.join(want, "unit_id")
    axes_missing = F.col("asset_ids").isNull().cast("int") + F.col("horizons").isNull().cast("int")
    empty_s, empty_i = F.array().cast("array<string>"), F.array().cast("array<int>")
    a, h = F.coalesce("asset_ids", empty_s), F.coalesce("horizons", empty_i)
    # entries that are no integers arrive as nulls
    worded = F.exists(h, lambda x: x.isNull())
    repeats = (F.size(a) - F.size(F.array_distinct(a))) + (F.size(h) - F.size(F.array_distinct(h)))
    differ = (a != F.col("wa")) | (h != F.col("wh"))
    lacking = lambda want, got: F.size(F.filter(want, lambda x: ~F.array_contains(got, x)))
    kind = F.when(axes_missing > 0, "axis").when(worded, "word").when(repeats > 0, "repeat").when(differ, "differ")
    of = lambda k, n: F.when(kind == k, n)
    out = refusal(
        rows, kind.isNotNull(), GATES[3], CHECK["declared_grid"], "schema_invalid",
        invalid_row_count=F.coalesce(of("word", F.size(h)), of("repeat", repeats)),
        missing_count=F.coalesce(of("axis", axes_missing), of("differ", lacking(F.col("wa"), a) + lacking(F.col("wh"), h))),
        extra_count=of("differ", lacking(a, F.col("wa")) + lacking(h, F.col("wh"))),
        expected_count=of("differ", F.size("wa") + F.size("wh")), observed_count=of("differ", F.size(a) + F.size(h)),
    )
    return out.withColumn("counts", F.map_filter("counts", lambda k, v: v.isNotNull()))


def grid_valid(units: DataFrame) -> DataFrame:
    """Faults: an empty or repeating axis, or a horizon that is not a positive integer."""
    a, h = F.col("asset_ids"), F.col("horizons")
    fault = (
        F.when(F.coalesce(F.size(a), F.lit(0)) < 1, "no asset")
        .when(F.coalesce(F.size(h), F.lit(0)) < 1, "no horizon")
        .when(F.size(F.array_distinct(a)) < F.size(a), "repeated asset")
        .when(F.size(F.array_distinct(h)) < F.size(h), "repeated horizon")
        .when(~F.forall(h, lambda x: F.coalesce(x >= 1, F.lit(False))), "horizon below 1")
    )
    return units.select("unit_id", fault.alias("fault")).where(F.col("fault").isNotNull())


def column_set(facts: DataFrame) -> DataFrame:
    """Exactly the four draw columns. ``facts`` is ``(U, columns)``."""
    want = F.array(*[F.lit(c) for c in C.DRAW_COLUMNS])
    missing, extra = F.size(F.array_except(want, "columns")), F.size(F.array_except("columns", want))
    return refusal(
        facts, (missing > 0) | (extra > 0), GATES[3], CHECK["column_set"], "schema_invalid",
        missing_count=missing, extra_count=extra,
    )


def row_facts(draws: DataFrame, meta: DataFrame, units: DataFrame) -> DataFrame:
    """Every row-level count of a submission in one pass over its draws.

    The one large shuffle is keyed by the whole (submission, unit, draw, asset, horizon) key, so it
    stays even when one submission holds much of the table, and repeated rows fold before it. The
    grid and its labels only meet cell-level rows.
    """
    declared = meta.select(*UNIT_KEYS, "n_draws")
    cell = [*UNIT_KEYS, "asset", "horizon"]
    bad_draw = F.col("draw").isNull() | (F.col("draw") < 0) | (F.col("draw") >= F.col("n_draws"))
    claims = (
        draws.withColumn("horizon", F.col("horizon").cast("int"))
        .groupBy(*cell, "draw")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("value").isNull()).alias("invalid"),
            F.count_if(F.col("value").isNotNull() & ~is_finite("value")).alias("nonfinite"),
        )
    )
    cells = claims.join(declared, UNIT_KEYS).groupBy(*cell, "n_draws").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(bad_draw, F.col("n")).otherwise(0)).alias("bad_draws"),
        F.sum("invalid").alias("invalid"), F.sum("nonfinite").alias("nonfinite"),
        F.count(F.lit(1)).alias("distinct_cells"), F.count_if(F.col("n") > 1).alias("duplicates"),
    )
    axes = units.select("unit_id", "asset_ids", "horizons")
    in_a = F.coalesce(F.array_contains("asset_ids", F.col("asset")), F.lit(False))
    in_h = F.coalesce(F.array_contains("horizons", F.col("horizon")), F.lit(False))
    return cells.join(axes, "unit_id").groupBy(*UNIT_KEYS, "n_draws").agg(
        F.sum("n").alias("n_rows"),
        F.max(F.size("asset_ids") * F.size("horizons") * F.col("n_draws").cast("long")).alias("expected_rows"),
        F.sum("bad_draws").alias("bad_draws"),
        F.sum(F.when(~in_a, F.col("n")).otherwise(0)).alias("unknown_assets"),
        F.sum(F.when(~in_h, F.col("n")).otherwise(0)).alias("unknown_horizons"),
        F.sum("invalid").alias("invalid"), F.sum("nonfinite").alias("nonfinite"),
        F.sum("distinct_cells").alias("distinct_cells"), F.sum("duplicates").alias("duplicates"),
    )


def draw_range(meta: DataFrame) -> DataFrame:
    """The declared draw count is inside the contract, independent of the schema gate."""
    n = F.coalesce("n_draws", F.lit(0))
    return refusal(
        meta, ~n.between(C.MIN_DRAWS, C.MAX_DRAWS), GATES[3], CHECK["draw_range"], "schema_invalid",
        observed_count=F.greatest(n, F.lit(0)), expected_count=C.MIN_DRAWS,
    )


def row_count(facts: DataFrame) -> DataFrame:
    """Rows equal declared draws times cells, exactly."""
    return refusal(
        facts, F.col("n_rows") != F.col("expected_rows"), GATES[3], CHECK["row_count"], "incomplete_output",
        observed_count=F.col("n_rows"), expected_count=F.col("expected_rows"),
    )


def draw_ids(facts: DataFrame) -> DataFrame:
    return refusal(
        facts, F.col("bad_draws") > 0, GATES[3], CHECK["draw_ids"], "schema_invalid",
        invalid_row_count=F.col("bad_draws"), expected_count=F.col("n_draws"),
    )


def labels_in_grid(facts: DataFrame) -> DataFrame:
    """Rows naming an asset, else a horizon, outside the grid."""
    n = F.when(F.col("unknown_assets") > 0, F.col("unknown_assets")).otherwise(F.col("unknown_horizons"))
    return refusal(facts, n > 0, GATES[3], CHECK["labels_in_grid"], "schema_invalid", extra_count=n, invalid_row_count=n)


def finite_values(facts: DataFrame) -> DataFrame:
    return refusal(
        facts, (F.col("invalid") > 0) | (F.col("nonfinite") > 0), GATES[3], CHECK["finite_values"], "schema_invalid",
        invalid_row_count=F.col("invalid"), nonfinite_count=F.col("nonfinite"),
    )


def occupancy(draws: DataFrame) -> DataFrame:
    """Distinct cells claimed and cells claimed more than once, per submission and unit."""
    claims = draws.groupBy(*UNIT_KEYS, "draw", "asset", F.col("horizon").cast("int").alias("horizon")).agg(
        F.count(F.lit(1)).alias("claims")
    )
    return claims.groupBy(*UNIT_KEYS).agg(
        F.count(F.lit(1)).alias("distinct_cells"), F.count_if(F.col("claims") > 1).alias("duplicates")
    )


def exactly_once(facts: DataFrame) -> DataFrame:
    """Every (draw, asset, horizon) filled once; duplicates are refused, never averaged.

    Missing cells follow from counts once labels and draw ids are known to be in range, so the
    expected grid is never materialised.
    """
    missing = F.col("expected_rows") - F.col("distinct_cells")
    return refusal(
        facts, (F.col("duplicates") > 0) | (missing > 0), GATES[3], CHECK["exactly_once"], "incomplete_output",
        invalid_row_count=F.col("duplicates"), missing_count=missing, expected_count=F.col("expected_rows"),
    )


def realized_exact(realized: DataFrame, cells: DataFrame) -> DataFrame:
    """Faults in organizer outcomes: unknown label, missing, repeated or non-finite cell."""
    keys = ["unit_id", "asset", "horizon"]
    got = realized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~is_finite("value")).alias("bad")
    )
    want = cells.select(*keys, F.lit(True).alias("wanted"))
    both = got.join(want, keys, "full_outer")
    return both.groupBy("unit_id").agg(
        F.count_if(F.col("wanted").isNull()).alias("unknown"),
        F.count_if(F.col("n").isNull()).alias("missing"),
        F.count_if(F.col("n") > 1).alias("duplicate"),
        F.sum(F.coalesce("bad", F.lit(0))).alias("nonfinite"),
    ).where("unknown > 0 or missing > 0 or duplicate > 0 or nonfinite > 0")


# ---- publication-time checks -----------------------------------------------------------------

def panel_cutoff(panel: DataFrame, units: DataFrame) -> DataFrame:
    """Late rows, late panels and unreadable dates per unit; ``date`` is the raw text column."""
    text = F.substring(F.col("date").cast("string"), 1, 10)
    good = is_iso(text)
    rows = panel.join(units.select("unit_id", F.col("asof").cast("string").alias("_asof")), "unit_id")
    late = good & (text > F.col("_asof"))
    per_panel = rows.groupBy("unit_id", "panel_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(late).alias("late"), F.count_if(~good).alias("bad")
    )
    return per_panel.groupBy("unit_id").agg(
        F.count("panel_id").alias("panels"), F.sum("n").alias("scanned_rows"),
        F.sum("late").alias("late_rows"), F.count_if(F.col("late") > 0).alias("late_panels"),
        F.sum("bad").alias("malformed_dates"),
    )


def corpus_cutoff(index: DataFrame, files: DataFrame, units: DataFrame) -> DataFrame:
    """Counts per unit: no id, undated, late, unindexed file, indexed file absent.

    ``index`` is ``(unit_id, doc_id, timestamp, path)``, ``files`` is ``(unit_id, path)``. The two-way
    coverage check is skipped where no index entry names a file.
    """
    asof = units.select("unit_id", F.col("asof").cast("string").alias("_asof"))
    stamp = F.substring(F.col("timestamp").cast("string"), 1, 10)
    good = is_iso(stamp)
    per_unit = index.join(asof, "unit_id").groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("indexed_documents"),
        F.count_if(F.coalesce("doc_id", F.lit("")) == "").alias("no_doc_id"),
        F.count_if(~good).alias("undated"),
        F.count_if(good & (stamp > F.col("_asof"))).alias("late"),
        F.count_if(F.coalesce("path", F.lit("")) != "").alias("named"),
    )
    named = index.where(F.coalesce("path", F.lit("")) != "").select(
        "unit_id", "path", F.lit(1).alias("_i")
    ).distinct()
    disk = files.select("unit_id", "path", F.lit(1).alias("_f")).distinct()
    cover = named.join(disk, ["unit_id", "path"], "full_outer").groupBy("unit_id").agg(
        F.count_if(F.col("_i").isNull()).alias("_unindexed"), F.count_if(F.col("_f").isNull()).alias("_absent")
    )
    checked = F.col("named") > 0
    return (
        units.select("unit_id").join(per_unit, "unit_id", "left").join(cover, "unit_id", "left")
        .select(
            "unit_id",
            F.coalesce("indexed_documents", F.lit(0)).alias("indexed_documents"),
            F.col("indexed_documents").isNull().alias("index_missing"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("no_doc_id", "undated", "late")],
            F.when(checked, F.coalesce("_unindexed", F.lit(0))).otherwise(0).alias("unindexed"),
            F.when(checked, F.coalesce("_absent", F.lit(0))).otherwise(0).alias("absent"),
        )
    )


# ---- ladder and publication ------------------------------------------------------------------

def first_failure(refusals: DataFrame) -> DataFrame:
    """The first failing check per submission and unit decides the code."""
    return refusals.groupBy(*UNIT_KEYS).agg(
        F.min_by(F.struct("gate", "code", "counts"), "check_no").alias("f")
    ).select(*UNIT_KEYS, "f.gate", "f.code", "f.counts")


def label_for(refusals: DataFrame) -> DataFrame:
    """Add the diagnostic label of each public code (a fixed lookup folded into the plan)."""
    lookup = F.create_map(*[F.lit(x) for kv in C.LABEL_FOR_CODE.items() for x in kv])
    return refusals.withColumn("label", F.element_at(lookup, F.col("code")))


def public_projection(results: DataFrame) -> DataFrame:
    """What a participant may see: the code and non-negative integer counts, nothing else."""
    safe = F.map_filter("counts", lambda k, v: v >= 0)
    return results.select(*UNIT_KEYS, "code", safe.alias("counts"))


def operator_reasons(results: DataFrame) -> DataFrame:
    """The separate operator sink."""
    return label_for(results).select(*UNIT_KEYS, "gate", "code", "label")


def footer_rows(facts: DataFrame, meta: DataFrame, units: DataFrame) -> DataFrame:
    """``(U, n_rows, expected_rows)``: the footer's count against declared draws times cells, before any row is decoded."""
    cells = units.select("unit_id", (F.size("asset_ids") * F.size("horizons")).cast("long").alias("_cells"))
    rows = facts.where("n_rows IS NOT NULL").select(*UNIT_KEYS, "n_rows").join(meta.select(*UNIT_KEYS, "n_draws"), UNIT_KEYS).join(cells, "unit_id")
    return rows.select(*UNIT_KEYS, "n_rows", (F.col("n_draws") * F.col("_cells")).alias("expected_rows"))


#: The ladder in its order: the inputs of each check and the check itself.
LADDER: list[tuple[tuple[str, ...], Callable[..., DataFrame]]] = [
    (("files", "expected"), file_set),
    (("file_sizes",), size_limits),
    (("meta_errors",), lambda errors: errors),
    (("meta",), meta_schema),
    (("file_sizes",), rationale_file),
    (("rationales",), rationale_bit),
    (("meta", "units"), bind_meta),
    (("meta", "units"), declared_grid),
    (("file_facts",), footer_limits),
    (("meta",), draw_range),
    (("file_facts", "meta", "units"), lambda facts, meta, units: row_count(footer_rows(facts, meta, units))),
    (("row_facts",), row_count),
    (("file_facts",), lambda facts: column_set(facts.where(F.col("columns").isNotNull()))),
    (("row_facts",), draw_ids),
    (("row_facts",), labels_in_grid),
    (("row_facts",), finite_values),
    (("row_facts",), exactly_once),
]
LADDER_INPUTS = ("units", "expected", "files", "file_facts", "meta", "meta_errors", "rationales", "draws")


def run_ladder(tables: dict[str, DataFrame], without: tuple[str, ...] = ()) -> DataFrame:
    """All checks, cut to the first failure per unit; every expected key that proves nothing is refused too.

    Inputs: ``LADDER_INPUTS``. An absent input stops the run unless ``without`` names it, which only local smoke runs
    do; then the checks on it are left out. The draws are read once: six checks share one small table of counts
    per (submission, unit), and a key that has no such counts and no refusal is ``incomplete_output``.
    """
    t = {k: v for k, v in tables.items() if k not in without}
    absent = [k for k in LADDER_INPUTS if k not in t and k not in without]
    if absent:
        raise ValueError(f"the ladder lacks {', '.join(absent)}")
    if "files" in t:
        t["file_sizes"] = file_sizes(t["files"])
    if {"draws", "meta", "units"} <= t.keys() and "row_facts" not in t:
        t["row_facts"] = materialized(row_facts(t["draws"], t["meta"], t["units"]), "row-facts")
    merged = None
    for inputs, check in LADDER:
        if all(k in t for k in inputs):
            part = check(*(t[k] for k in inputs))
            merged = part if merged is None else merged.unionByName(part)
    if "expected" in t and "row_facts" in t:
        silent = t["expected"].select(*UNIT_KEYS).distinct().join(t["row_facts"].select(*UNIT_KEYS), UNIT_KEYS, "left_anti")
        merged = merged.unionByName(refusal(silent, F.lit(True), GATES[3], CHECK["unproven"], "incomplete_output", observed_count=0))
    return first_failure(merged)


def admitted(tables: dict[str, DataFrame], refusals: DataFrame) -> DataFrame:
    """The keys that may be scored: expected, and without a refusal."""
    keys = tables["expected"] if "expected" in tables else tables["draws"]
    return keys.select(*UNIT_KEYS).distinct().join(refusals.select(*UNIT_KEYS), UNIT_KEYS, "left_anti")


# ---- roster-level checks ---------------------------------------------------------------------

def roster_coverage(scored: DataFrame, roster: DataFrame) -> DataFrame:
    """Faults per submission: duplicate, missing or extra units."""
    rows = scored.groupBy(*UNIT_KEYS).agg(F.count(F.lit(1)).alias("n"))
    tagged = rows.join(roster.select("unit_id", F.lit(True).alias("_w")).distinct(), "unit_id", "left")
    expected = roster.agg(F.count_distinct("unit_id")).scalar()
    return tagged.groupBy("submission_id").agg(
        F.count_if(F.col("n") > 1).alias("duplicate"),
        F.count_if(F.col("_w")).alias("_matched"),
        F.count_if(F.col("_w").isNull()).alias("extra"),
    ).select("submission_id", "duplicate", (expected - F.col("_matched")).alias("missing"), "extra")


def uniform_mode(scored: DataFrame) -> DataFrame:
    """Rows scored under any mode but the rankable one."""
    return scored.where(~F.col("normalization_mode").eqNullSafe(F.lit("ref_scale"))).groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("bad_mode")
    )


def grid_source(scored: DataFrame) -> DataFrame:
    """Rows graded on a card-derived grid."""
    return scored.where(~F.col("grid_source").eqNullSafe(F.lit("plan"))).groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("bad_grid")
    )


def content_digest(rows: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """``(keys, name)``: one digest per group of what its rows hold, whatever their order or partitioning.

    Each row is hashed twice to 64 bits; the sums and the number of rows are digested. Sums fold map-side and a row
    that occurs twice counts twice. A group without rows has no digest.
    """
    body = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]
    whole = lambda h: F.sum(h.cast("decimal(20,0)")).cast("string")
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("string").alias("_n"), whole(F.xxhash64(*body)).alias("_a"), whole(F.xxhash64(F.lit("second"), *body)).alias("_b")
    )
    return sums.select(*keys, F.sha2(F.concat_ws("|", "_n", "_a", "_b"), 256).alias(name))


def evidence_present(scored: DataFrame, evidence: DataFrame, digests: tuple[str, ...] = ("run_record_digest", "sanitized_tree_digest")) -> DataFrame:
    """Units without all digests."""
    full = evidence.dropna(subset=list(digests))
    return scored.select(*UNIT_KEYS).join(full.select(*UNIT_KEYS), UNIT_KEYS, "left_anti")


def min_gap(units: DataFrame, calendar: DataFrame) -> DataFrame:
    """The distance that each family requires of the as-of: calendar months before the first target, and for F4 its
    longest horizon in business days before the shock.

    ``units`` has ``target_dates`` and ``shock_date`` (F4 only), ``calendar`` is that of
    :func:`fanchart.operators.panel.business_calendar`: a closed day counts as the previous open one. A unit whose
    dates are absent or outside the calendar is not ok.
    """
    # Months per family.
    months = F.create_map(F.lit("F1"), F.lit(6), F.lit("F2"), F.lit(3), F.lit("F3"), F.lit(1))
    shock = F.col("family") == "F4"
    need = F.when(~shock, F.coalesce(F.element_at(months, F.col("family")), F.lit(0)))
    days = F.when(shock, F.array_max("horizons"))
    first = F.to_date(F.array_min("target_dates"))
    at = calendar.select(F.col("date").alias("_d"), F.col("idx").alias("_asof_idx"))
    on = calendar.select(F.col("date").alias("_s"), F.col("idx").alias("_shock_idx"))
    placed = units.join(at, F.col("asof") == F.col("_d"), "left").join(on, F.col("shock_date") == F.col("_s"), "left")
    gap = F.when(shock, F.col("_shock_idx") - F.col("_asof_idx"))
    ok = F.when(shock, gap >= days).otherwise(F.add_months("asof", need) <= first)
    return placed.select(
        "unit_id", "family", need.alias("min_months"), days.alias("min_days"), first.cast("string").alias("first_target"),
        gap.cast("int").alias("gap_days"), F.coalesce(ok, F.lit(False)).alias("ok"),
    )


def transfer_absent(panel: DataFrame, units: DataFrame, mode: str = "absent", before: str | None = None) -> DataFrame:
    """Transfer targets that appear in the input panel.

    ``absent``: any row violates. ``early_window``: rows before ``before`` and the as-of row itself
    are allowed.
    """
    wanted = units.select("unit_id", "asof", F.explode("asset_ids").alias("asset"))
    rows = panel.join(wanted, ["unit_id", "asset"]).where(F.col("date") <= F.col("asof"))
    if mode == "early_window":
        rows = rows.where((F.col("date") >= F.to_date(F.lit(before))) & (F.col("date") < F.col("asof")))
    return rows.groupBy("unit_id", "asset").agg(F.count(F.lit(1)).alias("n_rows"))


def degenerate_draws(draws: DataFrame, units: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Cells whose draws do not spread, and soft warnings on low draw counts by family."""
    cells = draws.groupBy(*C.CELL_KEYS).agg(
        F.stddev_samp("value").alias("sd"), F.count("value").alias("m")
    )
    per_unit = cells.groupBy(*UNIT_KEYS).agg(
        F.count_if(F.coalesce("sd", F.lit(0.0)) <= floor).alias("degenerate_cells"), F.max("m").alias("n_draws")
    )
    warning = (
        F.when((F.col("family") == "F4") & (F.col("n_draws") < 1000), "below 1000 draws")
        .when(F.col("family").isin("F3", "F4") & (F.col("n_draws") < 500), "below 500 draws")
        .otherwise("")
    )
    return per_unit.join(units.select("unit_id", "family"), "unit_id").select(
        *UNIT_KEYS, "family", "degenerate_cells", "n_draws", warning.alias("warning")
    )


def manifest_audit(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Both-way comparison of files on disk and manifest rows.

    ``files`` is ``(unit_id, path, length, sha256)``; ``manifest`` is ``(unit_id, path, bytes,
    sha256, redistributable)``.
    """
    m = manifest.select("unit_id", "path", "bytes", F.col("sha256").alias("want"), "redistributable")
    both = files.join(m, ["unit_id", "path"], "full_outer")
    status = (
        F.when(F.col("want").isNull(), "unlisted")
        .when(F.col("sha256").isNull(), F.when(F.col("redistributable"), "absent").otherwise("withheld"))
        .when(~F.col("redistributable"), "not redistributable")
        .when(F.col("sha256") != F.col("want"), "digest mismatch")
        .when(F.col("length") != F.col("bytes"), "length mismatch")
        .otherwise("ok")
    )
    return both.select("unit_id", "path", status.alias("status"))


def canary_scan(docs: DataFrame, guids: DataFrame) -> DataFrame:
    """Documents that contain a contamination GUID.

    GUIDs have a fixed shape, so they are extracted from the text and equi-joined: no document is
    tested against every GUID. ``docs`` is ``(doc_id, text)``, ``guids`` is ``(unit_id,
    canary_guid)``.
    """
    shape = "([0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12})"
    found = docs.select(
        "doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(shape), 1))).alias("g")
    ).select("doc_id", F.lower("g").alias("g")).distinct()
    return found.join(guids.select("unit_id", F.lower("canary_guid").alias("g")), "g").select("doc_id", "unit_id")


def path_rules(files: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Mutually exclusive classification: how many rules each path matches, and which.

    Rules are a short list held in code and become one projection; nothing is joined.
    """
    hits = F.filter(
        F.array(*[F.when(F.col("path").rlike(p), F.lit(name)) for name, p in sorted(rules.items())]),
        lambda x: x.isNotNull(),
    )
    return files.withColumn("_hits", hits).select(
        "path", F.size("_hits").alias("n_rules"), F.array_join("_hits", ",").alias("rules")
    )


def card_checks(units: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Consistency of each card, one boolean per rule."""
    shared = units.groupBy("canary_guid").agg(F.count(F.lit(1)).alias("_uses"))
    rows = units.join(shared, "canary_guid", "left")
    if index is not None:
        docs = index.groupBy("unit_id").agg(F.count(F.lit(1)).alias("_docs"))
        rows = rows.join(docs, "unit_id", "left")
    else:
        rows = rows.withColumn("_docs", F.col("n_documents"))
    return rows.select(
        "unit_id",
        (F.abs(F.col("w_marginal") + F.col("w_joint") + F.col("w_tail") - 1.0) < 1e-9).alias("weights_ok"),
        F.col("panel_end").eqNullSafe(F.col("data_cutoff")).alias("panel_end_ok"),
        (F.coalesce("_uses", F.lit(0)) == 1).alias("guid_unique"),
        F.col("text_cutoff").eqNullSafe(F.col("data_cutoff")).alias("text_cutoff_ok"),
        (F.coalesce("n_documents", F.lit(0)) == F.coalesce("_docs", F.lit(0))).alias("n_documents_ok"),
    )


def disclosures(submissions: DataFrame) -> DataFrame:
    """``(submission_id, models array<struct<name, version, training_cutoff>>)``: unpinned or undated models."""
    m = submissions.select("submission_id", F.explode("models").alias("m")).select("submission_id", "m.*")
    floating = F.coalesce(F.col("version").rlike("latest$"), F.lit(True)) | (F.col("version") == "")
    undated = F.coalesce(F.col("training_cutoff"), F.lit("")) == ""
    return m.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("models"), F.count_if(floating).alias("unpinned"), F.count_if(undated).alias("no_cutoff")
    ).withColumn("ok", (F.col("unpinned") == 0) & (F.col("no_cutoff") == 0))


def egress_audit(log: DataFrame, allow: DataFrame) -> DataFrame:
    """Logged connections ``(U, domain, bytes, time)`` outside the allow-list ``(domain)``.

    The log is folded per domain before the anti-join.
    """
    per_domain = log.groupBy(*UNIT_KEYS, "domain").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")
    )
    return per_domain.join(allow.select("domain"), "domain", "left_anti").groupBy(*UNIT_KEYS).agg(
        F.sum("n").alias("connections"), F.sum("b").alias("bytes"), F.count("domain").alias("domains")
    )


