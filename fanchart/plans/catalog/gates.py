"""Gate and data-quality queries.

The submissions checked here are the derived draws with defects planted by as-of month and family,
so every check meets both clean and broken rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from fanchart import contract as C
from fanchart.operators import gates as G
from fanchart.operators import panel as P
from fanchart.plans.bindings import Tables
from fanchart.plans.catalog.common import counts
from fanchart.plans.catalog.panel import CALENDAR
from fanchart.plans.registry import query
from fanchart.plans.scoring import submission_tables
from fanchart.sources import writers as W
from fanchart.sources.materialize import shared_folder


def _is(sub: str, month: int) -> Column:
    return (F.col("submission_id") == sub) & (F.month("asof") == month)


def _fam(sub: str, family: str) -> Column:
    return (F.col("submission_id") == sub) & F.col("unit_id").startswith(family)


def metas(t: Tables):
    sizes = t.draws.groupBy("submission_id", "unit_id").agg((F.max("draw") + 1).alias("n_draws"))
    u = sizes.join(t.units.select("unit_id", "asof", "asset_ids", "horizons"), "unit_id")
    return u.select(
        "submission_id", "unit_id",
        F.when(_is("rw", 12), "other").otherwise(F.col("unit_id")).alias("declared_unit"),
        F.when(_is("rw", 3), "1990-01-01").when(_is("adj", 12), "soon").otherwise(F.col("asof").cast("string")).alias("asof"),
        F.when(_is("rw", 9), "parametric").otherwise("samples").alias("representation"),
        F.when(_is("rw", 6) & F.col("unit_id").startswith("F1"), F.array(F.lit("Q"), F.element_at("asset_ids", 1)))
        .when(_is("rw", 6), F.reverse("asset_ids")).otherwise(F.col("asset_ids")).alias("asset_ids"),
        F.when(_is("adj", 9), F.array_append("horizons", 5)).otherwise(F.col("horizons")).alias("horizons"),
        "n_draws",
        F.when(_is("adj", 3), "boolean").otherwise("integer").alias("n_draws_type"),
        F.when(_is("adj", 6), "log_return").otherwise("level").alias("target"),
    )


def subs(t: Tables):
    """Draws with planted defects, one kind per (submission, family)."""
    draw = (
        F.when(_fam("rw", "F4") & (F.col("draw") == 3) & (F.col("asset") == "A") & (F.col("horizon") == 5), 4)
        .when(_fam("adj", "F1") & (F.col("draw") == 5), 100000).otherwise(F.col("draw"))
    )
    horizon = F.when(_fam("rw", "F2") & (F.col("draw") == 1), 99).otherwise(F.col("horizon"))
    asset = F.when(_fam("adj", "F2") & (F.col("draw") == 6) & (F.col("asset") == "A"), "Q").otherwise(F.col("asset"))
    value = (
        F.when(_fam("rw", "F3") & (F.col("draw") == 2) & (F.col("asset") == "A"), F.lit(float("nan")))
        .when(_fam("adj", "F4") & (F.col("draw") == 8), F.lit(float("inf")))
        .when(_fam("adj", "F3") & (F.col("draw") == 7), F.lit(None)).otherwise(F.col("value"))
    )
    changed = t.draws.select(
        "submission_id", "unit_id", draw.alias("draw"), asset.alias("asset"), horizon.alias("horizon"), value.alias("value")
    )
    return changed.unionByName(t.draws.where(_fam("rw", "F1") & (F.col("draw") == 0)))


_SUBS = {
    "metas": "SELECT k.submission_id, k.unit_id, k.n_draws, u.asset_ids AS wa, u.horizons AS wh, CAST(u.asof AS VARCHAR) AS want_asof, "
             "CASE WHEN k.submission_id = 'rw' AND month(u.asof) = 12 THEN 'other' ELSE k.unit_id END AS declared_unit, "
             "CASE WHEN k.submission_id = 'rw' AND month(u.asof) = 3 THEN '1990-01-01' WHEN k.submission_id = 'adj' AND month(u.asof) = 12 THEN 'soon' ELSE CAST(u.asof AS VARCHAR) END AS asof_text, "
             "CASE WHEN k.submission_id = 'rw' AND month(u.asof) = 9 THEN 'parametric' ELSE 'samples' END AS representation, "
             "CASE WHEN k.submission_id = 'rw' AND month(u.asof) = 6 AND k.unit_id LIKE 'F1%' THEN ['Q', u.asset_ids[1]] WHEN k.submission_id = 'rw' AND month(u.asof) = 6 THEN list_reverse(u.asset_ids) ELSE u.asset_ids END AS a, "
             "CASE WHEN k.submission_id = 'adj' AND month(u.asof) = 9 THEN list_append(u.horizons, 5) ELSE u.horizons END AS h, "
             "CASE WHEN k.submission_id = 'adj' AND month(u.asof) = 3 THEN 'boolean' ELSE 'integer' END AS n_draws_type, "
             "CASE WHEN k.submission_id = 'adj' AND month(u.asof) = 6 THEN 'log_return' ELSE 'level' END AS target "
             "FROM (SELECT submission_id, unit_id, max(draw) + 1 AS n_draws FROM draws GROUP BY 1, 2) k JOIN units u ON u.unit_id = k.unit_id",
    "subs": "SELECT submission_id, unit_id, CASE WHEN submission_id = 'rw' AND unit_id LIKE 'F4%' AND draw = 3 AND asset = 'A' AND horizon = 5 THEN 4 "
            "WHEN submission_id = 'adj' AND unit_id LIKE 'F1%' AND draw = 5 THEN 100000 ELSE draw END AS draw, "
            "CASE WHEN submission_id = 'adj' AND unit_id LIKE 'F2%' AND draw = 6 AND asset = 'A' THEN 'Q' ELSE asset END AS asset, "
            "CASE WHEN submission_id = 'rw' AND unit_id LIKE 'F2%' AND draw = 1 THEN 99 ELSE horizon END AS horizon, "
            "CASE WHEN submission_id = 'rw' AND unit_id LIKE 'F3%' AND draw = 2 AND asset = 'A' THEN CAST('NaN' AS DOUBLE) "
            "WHEN submission_id = 'adj' AND unit_id LIKE 'F4%' AND draw = 8 THEN CAST('Infinity' AS DOUBLE) "
            "WHEN submission_id = 'adj' AND unit_id LIKE 'F3%' AND draw = 7 THEN NULL ELSE value END AS value FROM draws UNION ALL "
            "SELECT submission_id, unit_id, draw, asset, horizon, value FROM draws WHERE submission_id = 'rw' AND unit_id LIKE 'F1%' AND draw = 0",
    "facts": "SELECT s.submission_id, s.unit_id, m.n_draws, count(*) AS n_rows, max(m.n_draws * len(m.wa) * len(m.wh)) AS expected_rows, "
             "count_if(s.draw < 0 OR s.draw >= m.n_draws) AS bad_draws, count_if(NOT list_contains(m.wa, s.asset)) AS ua, count_if(NOT list_contains(m.wh, s.horizon)) AS uh, "
             "count_if(s.value IS NULL) AS invalid, count_if(isnan(s.value) OR isinf(s.value)) AS nonfinite FROM subs s "
             "JOIN metas m ON m.submission_id = s.submission_id AND m.unit_id = s.unit_id GROUP BY 1, 2, 3",
    "q3": "SELECT submission_id, unit_id, 3 AS check_no, 'schema_invalid' AS code, CASE WHEN representation = 'samples' AND n_draws_type = 'integer' THEN n_draws ELSE -1 END AS observed FROM metas WHERE representation <> 'samples' OR n_draws_type <> 'integer' OR n_draws NOT BETWEEN 200 AND 20000",
    "q5": "SELECT submission_id, unit_id, 5 AS check_no, CASE WHEN asof_text = 'soon' THEN 'schema_invalid' WHEN asof_text <> want_asof THEN 'cutoff_violation' ELSE 'schema_invalid' END AS code, "
          "CASE WHEN asof_text = 'soon' THEN -1 ELSE 1 END AS violation FROM metas WHERE asof_text = 'soon' OR asof_text <> want_asof OR declared_unit <> unit_id OR target <> 'level'",
    "q7": "SELECT submission_id, unit_id, 7 AS check_no, 'schema_invalid' AS code, CASE WHEN rep THEN len(h) - len(list_distinct(h)) ELSE -1 END AS repeats, "
          "CASE WHEN rep THEN -1 ELSE len(list_filter(wa, lambda x: NOT list_contains(a, x))) + len(list_filter(wh, lambda x: NOT list_contains(h, x))) END AS missing, "
          "CASE WHEN rep THEN -1 ELSE len(list_filter(a, lambda x: NOT list_contains(wa, x))) + len(list_filter(h, lambda x: NOT list_contains(wh, x))) END AS extra, "
          "CASE WHEN rep THEN -1 ELSE len(wa) + len(wh) END AS expected, CASE WHEN rep THEN -1 ELSE len(a) + len(h) END AS observed "
          "FROM (SELECT *, len(h) > len(list_distinct(h)) AS rep FROM metas) WHERE rep OR a <> wa OR h <> wh",
    "occ": "SELECT submission_id, unit_id, count(*) AS distinct_cells, count_if(k > 1) AS dupes FROM (SELECT submission_id, unit_id, draw, asset, horizon, count(*) AS k FROM subs GROUP BY ALL) GROUP BY 1, 2",
    "q14": "SELECT f.submission_id, f.unit_id, 14 AS check_no, 'incomplete_output' AS code, o.dupes, f.expected_rows - o.distinct_cells AS missing, f.expected_rows FROM facts f JOIN occ o "
           "ON o.submission_id = f.submission_id AND o.unit_id = f.unit_id WHERE o.dupes > 0 OR f.expected_rows > o.distinct_cells",
    "planted": "SELECT k.submission_id, k.unit_id, month(u.asof) AS m FROM (SELECT DISTINCT submission_id, unit_id FROM draws) k JOIN units u ON u.unit_id = k.unit_id WHERE k.submission_id = 'hist'",
    "every": "SELECT submission_id, unit_id, check_no, code, 'g1_schema' AS gate, observed, CASE WHEN observed < 0 THEN -1 ELSE 200 END AS expected, -1 AS missing, -1 AS extra, -1 AS invalid, -1 AS nonfinite, -1 AS violation FROM q3 "
             "UNION ALL SELECT submission_id, unit_id, check_no, code, 'g2_cutoff_resource', -1, -1, -1, -1, -1, -1, violation FROM q5 "
             "UNION ALL SELECT submission_id, unit_id, check_no, code, 'g3_domain_semantics', observed, expected, missing, extra, repeats, -1, -1 FROM q7 "
             "UNION ALL SELECT submission_id, unit_id, 8, 'schema_invalid', 'g3_domain_semantics', n_draws, 200, -1, -1, -1, -1, -1 FROM metas WHERE n_draws NOT BETWEEN 200 AND 20000 "
             "UNION ALL SELECT submission_id, unit_id, 9, 'incomplete_output', 'g3_domain_semantics', n_rows, expected_rows, -1, -1, -1, -1, -1 FROM facts WHERE n_rows <> expected_rows "
             "UNION ALL SELECT submission_id, unit_id, 11, 'schema_invalid', 'g3_domain_semantics', -1, n_draws, -1, -1, bad_draws, -1, -1 FROM facts WHERE bad_draws > 0 "
             "UNION ALL SELECT submission_id, unit_id, 12, 'schema_invalid', 'g3_domain_semantics', -1, -1, -1, CASE WHEN ua > 0 THEN ua ELSE uh END, CASE WHEN ua > 0 THEN ua ELSE uh END, -1, -1 FROM facts WHERE ua > 0 OR uh > 0 "
             "UNION ALL SELECT submission_id, unit_id, 13, 'schema_invalid', 'g3_domain_semantics', -1, -1, -1, -1, invalid, nonfinite, -1 FROM facts WHERE invalid > 0 OR nonfinite > 0 "
             "UNION ALL SELECT submission_id, unit_id, check_no, code, 'g3_domain_semantics', -1, expected_rows, missing, -1, dupes, -1, -1 FROM q14 "
             "UNION ALL SELECT submission_id, unit_id, 1, 'schema_invalid', 'g0_integrity', -1, 3, 0, 1, -1, -1, -1 FROM planted WHERE m = 3 "
             "UNION ALL SELECT submission_id, unit_id, 2, 'malformed_output', 'g0_integrity', 300000, 262144, -1, -1, -1, -1, -1 FROM planted WHERE m = 6 "
             "UNION ALL SELECT submission_id, unit_id, 4, 'schema_invalid', 'g1_schema', -1, -1, -1, -1, -1, -1, -1 FROM planted WHERE m = 9 "
             "UNION ALL SELECT submission_id, unit_id, 7.5, 'schema_invalid', 'g3_domain_semantics', 9, 8, -1, -1, -1, -1, -1 FROM planted WHERE m = 12",
    "first_fail": "SELECT submission_id, unit_id, arg_min(gate, check_no) AS gate, arg_min(code, check_no) AS code, "
                  + ", ".join(f"CAST(arg_min({c}, check_no) AS BIGINT) AS {c}" for c in ("observed", "expected", "missing", "extra", "invalid", "nonfinite", "violation")) + " FROM every GROUP BY 1, 2",
}


def _facts(t):
    return G.row_facts(subs(t), metas(t), t.units)


def _files(t):
    keys = t.draws.select("submission_id", "unit_id").distinct().join(t.units.select("unit_id", "asof"), "unit_id")
    names = F.array(F.lit("forecast.parquet"), F.lit("forecast_meta.json"), F.lit("forecast_rationale.md"))
    names = F.when(_is("rw", 3), F.array_append(names, "notes.txt")).when(_is("adj", 6), F.array(F.lit("forecast.parquet"), F.lit("forecast_rationale.md"))).when(_is("adj", 9), F.array().cast("array<string>")).otherwise(names)
    return keys, keys.select("submission_id", "unit_id", F.explode(names).alias("name"), F.lit(100).alias("length"))


@query(
    "qc1_file_set",
    "SELECT d.submission_id, d.unit_id, CASE WHEN d.submission_id = 'rw' THEN 'schema_invalid' ELSE 'no_output' END AS code, CAST(CASE WHEN d.submission_id = 'rw' THEN 1 ELSE 0 END AS BIGINT) AS extra_count, "
    "CAST(CASE WHEN d.submission_id = 'rw' THEN 0 WHEN month(u.asof) = 6 THEN 1 ELSE 2 END AS BIGINT) AS missing_count FROM (SELECT DISTINCT submission_id, unit_id FROM draws) d JOIN units u ON u.unit_id = d.unit_id "
    "WHERE (d.submission_id = 'rw' AND month(u.asof) = 3) OR (d.submission_id = 'adj' AND month(u.asof) IN (6, 9))",
)
def file_set(t):
    expected, files = _files(t)
    return counts(G.file_set(files, expected), "extra_count", "missing_count").drop("gate", "check_no")


@query(
    "qc2_size_limits",
    "SELECT submission_id, unit_id, code, observed, CAST(expected AS BIGINT) AS expected FROM (SELECT *, CASE WHEN bytes > 67108864 THEN 'malformed_output' WHEN cols > 8 THEN 'schema_invalid' WHEN rows_ > 5000000 THEN 'malformed_output' END AS code, "
    "CASE WHEN bytes > 67108864 THEN bytes WHEN cols > 8 THEN cols WHEN rows_ > 5000000 THEN rows_ END AS observed, CASE WHEN bytes > 67108864 THEN 67108864 WHEN cols > 8 THEN 8 WHEN rows_ > 5000000 THEN 5000000 END AS expected FROM "
    "(SELECT submission_id, unit_id, count(*) * 6000 AS bytes, count(*) * 500 AS rows_, CAST(CASE WHEN unit_id LIKE 'F1%' THEN 9 ELSE 4 END AS BIGINT) AS cols FROM draws GROUP BY 1, 2)) WHERE code IS NOT NULL",
)
def size_limits(t):
    n = t.draws.groupBy("submission_id", "unit_id").agg(F.count(F.lit(1)).alias("n"))
    cols = F.when(F.col("unit_id").startswith("F1"), 9).otherwise(4)
    facts = n.select(
        "submission_id", "unit_id", (F.col("n") * 6000).alias("draws_bytes"), F.lit(300).alias("meta_bytes"), F.lit(50).alias("rationale_bytes"),
        F.lit(1).alias("row_groups"), cols.alias("n_columns"), cols.alias("n_distinct_columns"), (F.col("n") * 500).alias("n_rows"), (F.col("n") * 24).alias("uncompressed_bytes"),
    )
    out = counts(G.first_failure(G.size_limits(facts).unionByName(G.footer_limits(facts))), "observed_count", "expected_count")
    return out.select("submission_id", "unit_id", "code", F.col("observed_count").alias("observed"), F.col("expected_count").alias("expected"))


@query("qc3_meta_schema", "SELECT submission_id, unit_id, code, CAST(observed AS BIGINT) AS observed_count FROM q3", _SUBS)
def meta_schema(t):
    return counts(G.meta_schema(metas(t)), "observed_count").drop("gate", "check_no")


@query("qc4_rationale_bit", "SELECT role AS submission_id, conv_id || '-' || turn AS unit_id, 'schema_invalid' AS code FROM conversations WHERE NOT regexp_matches(CASE WHEN length(text) % 11 = 0 THEN chr(32) || chr(10) || chr(9) ELSE text END, '\\S')")
def rationale_bit(t):
    texts = t.read("conversations").select(
        F.col("role").alias("submission_id"), F.concat_ws("-", "conv_id", "turn").alias("unit_id"),
        F.when(F.length("text") % 11 == 0, F.lit(" \n\t")).otherwise(F.col("text")).alias("text"),
    )
    return G.rationale_bit(texts).select("submission_id", "unit_id", "code")


@query("qc5_bind_meta", "SELECT submission_id, unit_id, code, CAST(violation AS BIGINT) AS violation_count FROM q5", _SUBS)
def bind_meta(t):
    return counts(G.bind_meta(metas(t), t.units), "violation_count").drop("gate", "check_no")


def _dated_units(t):
    dates = (
        F.when(F.col("family") == "F1", F.array(F.col("asof").cast("string")))
        .when(F.col("family") == "F2", F.array(F.lit("someday")))
        .when(F.col("family") == "F3", F.array(F.date_add("asof", 9).cast("string")))
        .otherwise(F.array().cast("array<string>"))
    )
    return t.units.join(t.cut.select("unit_id").distinct(), "unit_id").withColumn("target_dates", dates)


@query("qc6_declared_cutoff", "SELECT unit_id, CASE family WHEN 'F2' THEN 'target date is not ISO' ELSE 'target date not after as-of' END AS fault FROM units WHERE family IN ('F1', 'F2') AND unit_id IN (SELECT unit_id FROM cut)")
def declared_cutoff(t):
    return G.declared_cutoff(_dated_units(t))


@query("qc7_declared_grid", "SELECT submission_id, unit_id, code, CAST(repeats AS BIGINT) AS invalid_row_count, CAST(missing AS BIGINT) AS missing_count, CAST(extra AS BIGINT) AS extra_count, "
       "CAST(expected AS BIGINT) AS expected_count, CAST(observed AS BIGINT) AS observed_count FROM q7", _SUBS)
def declared_grid(t):
    return counts(G.declared_grid(metas(t), t.units), "invalid_row_count", "missing_count", "extra_count", "expected_count", "observed_count").drop("gate", "check_no")


@query("qc8_grid_valid", "SELECT unit_id, CASE family WHEN 'F2' THEN 'repeated asset' WHEN 'F3' THEN 'horizon below 1' ELSE 'no asset' END AS fault FROM units WHERE family <> 'F1' AND unit_id IN (SELECT unit_id FROM cut)")
def grid_valid(t):
    a = F.when(F.col("family") == "F2", F.array_append("asset_ids", "A")).when(F.col("family") == "F4", F.array().cast("array<string>")).otherwise(F.col("asset_ids"))
    h = F.when(F.col("family") == "F3", F.array_append("horizons", 0)).otherwise(F.col("horizons"))
    present = t.units.join(t.cut.select("unit_id").distinct(), "unit_id")
    return G.grid_valid(present.withColumn("asset_ids", a).withColumn("horizons", h))


@query("qc9_row_count", "SELECT submission_id, unit_id, 'incomplete_output' AS code, n_rows AS observed_count, expected_rows AS expected_count FROM facts WHERE n_rows <> expected_rows", _SUBS)
def row_count(t):
    return counts(G.row_count(_facts(t)), "observed_count", "expected_count").drop("gate", "check_no")


@query("qc10_column_set", "SELECT submission_id, unit_id, 'schema_invalid' AS code, CAST(CASE left(unit_id, 2) WHEN 'F2' THEN 0 ELSE 1 END AS BIGINT) AS missing_count, CAST(CASE left(unit_id, 2) WHEN 'F3' THEN 0 ELSE 1 END AS BIGINT) AS extra_count "
       "FROM (SELECT DISTINCT submission_id, unit_id FROM draws) WHERE unit_id NOT LIKE 'F1%'")
def column_set(t):
    keys = t.draws.select("submission_id", "unit_id").distinct()
    fam = F.substring("unit_id", 1, 2)
    names = lambda s: F.array(*[F.lit(x) for x in s.split()])
    cols = (F.when(fam == "F2", names("draw asset horizon value note")).when(fam == "F3", names("draw asset value"))
            .when(fam == "F4", names("draw asset h value")).otherwise(names("value draw asset horizon")))
    return counts(G.column_set(keys.withColumn("columns", cols)), "missing_count", "extra_count").drop("gate", "check_no")


@query("qc11_draw_ids", "SELECT submission_id, unit_id, 'schema_invalid' AS code, bad_draws AS invalid_row_count FROM facts WHERE bad_draws > 0", _SUBS)
def draw_ids(t):
    return counts(G.draw_ids(_facts(t)), "invalid_row_count").drop("gate", "check_no")


@query("qc12_labels_in_grid", "SELECT submission_id, unit_id, 'schema_invalid' AS code, CASE WHEN ua > 0 THEN ua ELSE uh END AS extra_count FROM facts WHERE ua > 0 OR uh > 0", _SUBS)
def labels(t):
    return counts(G.labels_in_grid(_facts(t)), "extra_count").drop("gate", "check_no")


@query("qc13_finite_values", "SELECT submission_id, unit_id, 'schema_invalid' AS code, invalid AS invalid_row_count, nonfinite AS nonfinite_count FROM facts WHERE invalid > 0 OR nonfinite > 0", _SUBS)
def finite_values(t):
    return counts(G.finite_values(_facts(t)), "invalid_row_count", "nonfinite_count").drop("gate", "check_no")


@query("qc14_exactly_once", "SELECT submission_id, unit_id, code, dupes AS invalid_row_count, missing AS missing_count, expected_rows AS expected_count FROM q14", _SUBS)
def exactly_once(t):
    return counts(G.exactly_once(_facts(t)), "invalid_row_count", "missing_count", "expected_count").drop("gate", "check_no")


@query("qc14_occupancy_line_items", "SELECT submission_id, unit_id, count(*) AS distinct_cells, count_if(k > 1) AS duplicates FROM (SELECT 'flag-' || l_returnflag AS submission_id, year(l_shipdate) || 'Q' || quarter(l_shipdate) AS unit_id, "
       "l_orderkey, l_linenumber, count(*) AS k FROM lineitem GROUP BY ALL) GROUP BY 1, 2")
def occupancy_lines(t):
    line = t.read("lineitem").select(
        F.concat(F.lit("flag-"), "l_returnflag").alias("submission_id"), Tables._quarter("l_shipdate").alias("unit_id"),
        F.col("l_orderkey").alias("draw"), F.lit("line").alias("asset"), F.col("l_linenumber").alias("horizon"),
    )
    return G.occupancy(line)


@query(
    "qc15_realized_exact",
    "SELECT unit_id, count_if(f = 'F1') AS unknown, count_if(f = 'F2' AND asset = 'N') AS missing, count_if(f = 'F3' AND asset = 'R') AS duplicate, count_if(f = 'F4' AND asset = 'A' AND horizon = 5) AS nonfinite FROM "
    "(SELECT *, left(unit_id, 2) AS f FROM realized) GROUP BY 1",
)
def realized_exact(t):
    fam = F.substring("unit_id", 1, 2)
    r = t.realized.select("unit_id", "asset", "horizon", "value").withColumn("f", fam)
    value = F.when((F.col("f") == "F4") & (F.col("asset") == "A") & (F.col("horizon") == 5), F.lit(float("nan"))).otherwise(F.col("value"))
    kept = r.where(~((F.col("f") == "F2") & (F.col("asset") == "N"))).withColumn("value", value)
    broken = kept.unionByName(r.where("f = 'F3' AND asset = 'R'")).unionByName(r.where("f = 'F1'").withColumn("asset", F.lit("Q")))
    from fanchart.operators.panel import grid

    return G.realized_exact(broken.drop("f"), grid(t.units).join(t.realized.select("unit_id").distinct(), "unit_id"))


@query("qc16_panel_cutoff", "SELECT unit_id, count(DISTINCT panel_id) AS panels, count(*) AS scanned_rows, count_if(day(date) <> 29 AND date > asof) AS late_rows, "
       "count(DISTINCT CASE WHEN day(date) <> 29 AND date > asof THEN panel_id END) AS late_panels, count_if(day(date) = 29) AS malformed_dates FROM unit_panel GROUP BY 1")
def panel_cutoff(t):
    raw = F.when(F.dayofmonth("date") == 29, "29th").otherwise(F.concat(F.col("date").cast("string"), F.lit("T00:00:00")))
    return G.panel_cutoff(t.unit_panel.withColumn("date", raw), t.units)


@query(
    "qc17_corpus_cutoff",
    "SELECT u.unit_id, i.n AS indexed_documents, false AS index_missing, CAST(0 AS BIGINT) AS no_doc_id, i.undated, i.late, coalesce(c.unindexed, 0) AS unindexed, coalesce(c.absent, 0) AS absent FROM doc_units u "
    "JOIN (SELECT d.unit_id, count(*) AS n, count_if(timestamp = 'undated') AS undated, count_if(timestamp <> 'undated' AND timestamp > CAST(u.asof AS VARCHAR)) AS late FROM doc_index d JOIN doc_units u ON u.unit_id = d.unit_id GROUP BY 1) i ON i.unit_id = u.unit_id "
    "LEFT JOIN (SELECT coalesce(x.unit_id, f.unit_id) AS unit_id, count_if(x.path IS NULL) AS unindexed, count_if(f.path IS NULL) AS absent FROM "
    "(SELECT DISTINCT unit_id, regexp_replace(path, '^[./]+', '') AS path FROM doc_index) x FULL JOIN (SELECT DISTINCT unit_id, path FROM docs) f ON f.unit_id = x.unit_id AND f.path = x.path GROUP BY 1) c ON c.unit_id = u.unit_id",
)
def corpus_cutoff(t):
    index = t.index.withColumn("path", F.regexp_replace("path", r"^[./]+", ""))
    return G.corpus_cutoff(index, t.docs, t.doc_units)


def _ladder(t):
    """All inputs of the ladder; the third submission has defects of its files planted by month."""
    keys = t.draws.select("submission_id", "unit_id").distinct().join(t.units.select("unit_id", "asof"), "unit_id")
    names = F.array(*[F.lit(n) for n in C.SUBMISSION_FILES])
    names = F.when(_is("hist", 3), F.array_append(names, "notes.txt")).otherwise(names)
    size = F.when(_is("hist", 6) & (F.col("name") == "forecast_meta.json"), 300_000).otherwise(300)
    files = keys.withColumn("name", F.explode(names)).withColumn("length", size).drop("asof")
    claims, n_columns = subs(t), F.when(_is("hist", 12), 9).otherwise(4)
    facts = claims.groupBy("submission_id", "unit_id").agg(F.count(F.lit(1)).alias("n_rows")).join(keys, ["submission_id", "unit_id"]).select(
        "submission_id", "unit_id", F.lit(1000).alias("draws_bytes"), F.array(*[F.lit(c) for c in C.DRAW_COLUMNS]).alias("columns"),
        n_columns.alias("n_columns"), n_columns.alias("n_distinct_columns"), "n_rows", F.lit(1).alias("row_groups"),
        (F.col("n_rows") * 24).alias("uncompressed_bytes"), F.lit(True).alias("readable"),
    )
    return G.run_ladder({
        "units": t.units, "expected": keys.drop("asof"), "files": files, "file_facts": facts, "meta": metas(t), "draws": claims,
        "meta_errors": G.refusal(keys, F.lit(False), G.GATES[0], G.CHECK["meta_errors"], "malformed_output"),
        "rationales": keys.select("submission_id", "unit_id", F.when(_is("hist", 9), " \t").otherwise("because").alias("text")),
    })


#: Names of a refusal's counts, and their columns in the twins.
COUNTS = {"observed_count": "observed", "expected_count": "expected", "missing_count": "missing", "extra_count": "extra",
          "invalid_row_count": "invalid", "nonfinite_count": "nonfinite", "violation_count": "violation"}


@query("qc18_first_failure", "SELECT * FROM first_fail", _SUBS)
def first_failure(t):
    return counts(_ladder(t), *COUNTS).withColumnsRenamed(COUNTS)


@query(
    "qc18_tree_ladder",
    "SELECT submission_id, unit_id, gate, code FROM (SELECT submission_id, unit_id, "
    "CASE WHEN k = 'rw3' OR k = 'rw6' OR k = 'adj6' THEN 'g0_integrity' WHEN n < 200 OR k = 'adj9' THEN 'g1_schema' WHEN k = 'rw9' THEN 'g2_cutoff_resource' WHEN k = 'adj3' OR k = 'adj12' THEN 'g3_domain_semantics' END AS gate, "
    "CASE WHEN k = 'rw3' THEN 'schema_invalid' WHEN k = 'rw6' THEN 'malformed_output' WHEN k = 'adj6' THEN 'no_output' WHEN n < 200 OR k IN ('adj9', 'rw9', 'adj3') THEN 'schema_invalid' WHEN k = 'adj12' THEN 'malformed_output' END AS code FROM "
    "(SELECT d.submission_id, d.unit_id, max(d.draw) + 1 AS n, d.submission_id || month(max(u.asof)) AS k FROM draws d JOIN units u ON u.unit_id = d.unit_id GROUP BY 1, 2)) WHERE gate IS NOT NULL",
)
def tree_ladder(t):
    """Submissions written as a tree with one kind of defect per submission and quarter, then listed, opened and judged."""
    keys = t.draws.groupBy("submission_id", "unit_id").agg((F.max("draw") + 1).alias("n_draws")).join(t.units.select("unit_id", "asof", "asset_ids", "horizons"), "unit_id")
    k = F.concat("submission_id", F.month("asof").cast("string"))
    meta = F.to_json(F.struct(
        F.when(k == "rw9", "other").otherwise(F.col("unit_id")).alias("unit_id"), F.col("asof").cast("string").alias("asof"), F.lit("samples").alias("representation"),
        "asset_ids", "horizons", "n_draws", F.lit("level").alias("target"),
    ))
    file = lambda name: F.create_map(F.lit(name), F.lit(""))
    sidecars = keys.select(
        "submission_id", "unit_id", F.when(k == "rw6", "").otherwise(meta).alias("meta"), F.when(k == "adj9", " \n").otherwise("because").alias("rationale"),
        F.when(k == "rw3", file(".note")).when(k == "adj12", file("forecast.parquet")).alias("others"),
    )
    draws = t.draws.join(keys.select("submission_id", "unit_id", k.alias("k")), ["submission_id", "unit_id"]).where(~F.col("k").isin("adj6", "adj12"))
    value = F.when((F.col("k") == "adj3") & (F.col("draw") == 2), F.lit(float("nan"))).otherwise(F.col("value"))
    root = f"{shared_folder(t.spark)}/tree-{uuid.uuid4().hex}"
    W.write_submission_tree(draws.withColumn("value", value).drop("k"), sidecars, root)
    return G.run_ladder(submission_tables(t.spark, root, t.units)).select("submission_id", "unit_id", "gate", "code")


@query("qc19_label_for", "SELECT code, label, count(*) AS n FROM (SELECT code, CASE code WHEN 'cutoff_violation' THEN 'leakage_cutoff' ELSE 'schema_invalid_output' END AS label FROM first_fail) GROUP BY 1, 2", _SUBS)
def label_for(t):
    return G.label_for(_ladder(t)).groupBy("code", "label").agg(F.count(F.lit(1)).alias("n"))


@query("qc20_public_projection", "SELECT submission_id, unit_id, code, observed, expected, missing, extra, invalid, nonfinite, violation FROM first_fail", _SUBS)
def public_projection(t):
    return counts(G.public_projection(_ladder(t)), *COUNTS).withColumnsRenamed(COUNTS)


@query("udf3_gate_list", "SELECT gate, count(*) AS refused FROM first_fail GROUP BY 1", _SUBS)
def gate_list(t):
    return _ladder(t).groupBy("gate").agg(F.count(F.lit(1)).alias("refused"))


def _scored(t):
    k = t.draws.select("submission_id", "unit_id").distinct().join(t.units.select("unit_id", "asof"), "unit_id")
    kept = k.where(~_is("adj", 6))
    extra = k.where(_is("hist", 12)).withColumn("unit_id", F.concat(F.lit("Z-"), "unit_id"))
    rows = kept.unionByName(k.where(_is("rw", 3))).unionByName(extra)
    return rows.withColumn("normalization_mode", F.when(_is("rw", 9), "raw_unrankable").otherwise("ref_scale")).withColumn(
        "grid_source", F.when(_is("adj", 3), "card").otherwise("plan")
    )


_SCORED = {
    "ks": "SELECT d.submission_id, d.unit_id, month(u.asof) AS mo FROM (SELECT DISTINCT submission_id, unit_id FROM draws) d JOIN units u ON u.unit_id = d.unit_id",
    "sc": "SELECT * FROM ks WHERE NOT (submission_id = 'adj' AND mo = 6) UNION ALL SELECT * FROM ks WHERE submission_id = 'rw' AND mo = 3 UNION ALL SELECT submission_id, 'Z-' || unit_id, mo FROM ks WHERE submission_id = 'hist' AND mo = 12",
}


@query("qc21_roster_coverage", "SELECT submission_id, count_if(n > 1) AS duplicate, (SELECT count(*) FROM units) - count_if(unit_id NOT LIKE 'Z%') AS missing, count_if(unit_id LIKE 'Z%') AS extra FROM "
       "(SELECT submission_id, unit_id, count(*) AS n FROM sc GROUP BY 1, 2) GROUP BY 1", _SCORED)
def roster_coverage(t):
    return G.roster_coverage(_scored(t), t.units)


@query("qc22_uniform_mode", "SELECT submission_id, count(*) AS bad_mode FROM sc WHERE submission_id = 'rw' AND mo = 9 GROUP BY 1", _SCORED)
def uniform_mode(t):
    return G.uniform_mode(_scored(t))


@query("qc23_grid_source", "SELECT submission_id, count(*) AS bad_grid FROM sc WHERE submission_id = 'adj' AND mo = 3 GROUP BY 1", _SCORED)
def grid_source(t):
    return G.grid_source(_scored(t))


@query("qc24_evidence_present", "SELECT submission_id, unit_id FROM sc WHERE (submission_id = 'hist' AND mo = 12) OR unit_id LIKE 'Z%'", _SCORED)
def evidence(t):
    k = t.draws.select("submission_id", "unit_id").distinct().join(t.units.select("unit_id", "asof"), "unit_id")
    digest = F.sha2(F.concat("submission_id", "unit_id"), 256)
    ev = k.select("submission_id", "unit_id", digest.alias("run_record_digest"), F.when(~_is("hist", 12), digest).alias("sanitized_tree_digest"))
    return G.evidence_present(_scored(t), ev)


@query("qc25_min_gap", "SELECT u.unit_id, u.family, need AS min_months, CAST(CASE WHEN u.family = 'F4' THEN list_max(horizons) END AS INTEGER) AS min_days, CAST(first AS VARCHAR) AS first_target, CAST(s.idx - a.idx AS INTEGER) AS gap_days, "
       "coalesce(CASE WHEN u.family = 'F4' THEN s.idx - a.idx >= list_max(horizons) ELSE asof + to_months(need) <= first END, false) AS ok FROM (SELECT unit_id, family, asof, horizons, CASE family WHEN 'F1' THEN 6 WHEN 'F2' THEN 3 WHEN 'F3' THEN 1 END AS need, "
       "CAST(asof + to_days(CAST(20 + 20 * month(asof) AS INTEGER)) AS DATE) AS first, CASE WHEN family = 'F4' THEN CAST(asof + to_days(CAST(24 + month(asof) AS INTEGER)) AS DATE) END AS shock FROM units WHERE unit_id IN (SELECT unit_id FROM cut)) u "
       "LEFT JOIN cal_idx a ON a.date = u.asof AND u.family = 'F4' LEFT JOIN cal_idx s ON s.date = u.shock", CALENDAR)
def min_gap(t):
    """The shocks of F4 units follow the as-of by 27 to 36 days: before and after the limit of 21 business days."""
    target = F.date_add("asof", 20 + 20 * F.month("asof")).cast("string")
    shock = F.when(F.col("family") == "F4", F.date_add("asof", 24 + F.month("asof")))
    u = t.units.join(t.cut.select("unit_id").distinct(), "unit_id").withColumns({"target_dates": F.array(target, F.date_add("asof", 400).cast("string")), "shock_date": shock})
    return G.min_gap(u, P.business_calendar(t.panel.select("date"), t.holidays))


@query("qc26_transfer_absent", "SELECT t.unit_id, t.asset, count(*) AS n_rows FROM transfer t JOIN units u ON u.unit_id = t.unit_id WHERE t.date <= u.asof GROUP BY 1, 2")
def transfer_absent(t):
    return G.transfer_absent(t.transfer, t.units)


@query("qc26_transfer_early_window", "SELECT t.unit_id, t.asset, count(*) AS n_rows FROM transfer t JOIN units u ON u.unit_id = t.unit_id WHERE t.date >= DATE '1997-01-01' AND t.date < u.asof GROUP BY 1, 2")
def transfer_early(t):
    return G.transfer_absent(t.transfer, t.units, "early_window", "1997-01-01")


@query("qc27_degenerate_draws", "SELECT k.submission_id, k.unit_id, u.family, count_if(k.sd <= 1e-12) AS degenerate_cells, max(k.m) AS n_draws, CASE WHEN u.family = 'F4' AND max(k.m) < 1000 THEN 'below 1000 draws' "
       "WHEN u.family IN ('F3', 'F4') AND max(k.m) < 500 THEN 'below 500 draws' ELSE '' END AS warning FROM (SELECT submission_id, unit_id, asset, horizon, stddev_samp(CASE WHEN submission_id = 'rw' AND asset = 'A' THEN 1 ELSE value END) AS sd, count(*) AS m FROM draws GROUP BY ALL) k "
       "JOIN units u ON u.unit_id = k.unit_id GROUP BY 1, 2, 3")
def degenerate(t):
    flat = F.when((F.col("submission_id") == "rw") & (F.col("asset") == "A"), 1.0).otherwise(F.col("value"))
    return G.degenerate_draws(t.draws.withColumn("value", flat), t.units)


@query(
    "qc28_manifest_audit",
    "SELECT status, count(*) AS n FROM (SELECT CASE WHEN m.path IS NULL THEN 'unlisted' WHEN f.path IS NULL THEN CASE WHEN m.redist THEN 'absent' ELSE 'withheld' END WHEN NOT m.redist THEN 'not redistributable' "
    "WHEN f.sha <> m.sha THEN 'digest mismatch' WHEN f.len <> m.bytes THEN 'length mismatch' ELSE 'ok' END AS status FROM (SELECT doc_id AS path, octet_length(encode(text)) AS len, sha256(text) AS sha FROM documents WHERE doc_id % 19 <> 0) f "
    "FULL JOIN (SELECT doc_id AS path, octet_length(encode(text)) + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS bytes, CASE WHEN doc_id % 5 = 0 THEN 'f00' ELSE sha256(text) END AS sha, doc_id % 7 <> 0 AS redist FROM documents WHERE doc_id % 13 <> 0) m ON m.path = f.path) GROUP BY 1",
)
def manifest_audit(t):
    d = t.read("documents")
    i = F.col("doc_id")
    base = d.select("doc_id", F.col("source").alias("unit_id"), i.cast("string").alias("path"), F.octet_length("text").alias("len"), F.sha2("text", 256).alias("sha"))
    files = base.where(i % 19 != 0).select("unit_id", "path", F.col("len").alias("length"), F.col("sha").alias("sha256"))
    manifest = base.where(i % 13 != 0).select(
        "unit_id", "path", (F.col("len") + F.when(i % 11 == 0, 1).otherwise(0)).alias("bytes"),
        F.when(i % 5 == 0, "f00").otherwise(F.col("sha")).alias("sha256"), (i % 7 != 0).alias("redistributable"),
    )
    return G.manifest_audit(files, manifest).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _guid(c: str) -> Column:
    m = F.md5(c)
    return F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.substring(m, 21, 12))


_GUID_SQL = "concat_ws('-', substr(md5(source), 1, 8), substr(md5(source), 9, 4), substr(md5(source), 13, 4), substr(md5(source), 17, 4), substr(md5(source), 21, 12))"


@query("qc29_canary_scan", "SELECT d.doc_id, g.unit_id FROM (SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN text || ' ' || " + _GUID_SQL + " || '.' ELSE text END AS text FROM documents) d "
       "JOIN (SELECT DISTINCT source AS unit_id, " + _GUID_SQL + " AS guid FROM documents) g ON contains(d.text, g.guid)")
def canary_scan(t):
    d = t.read("documents")
    planted = d.select("doc_id", F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit(" "), _guid("source"), F.lit("."))).otherwise(F.col("text")).alias("text"))
    guids = d.select(F.col("source").alias("unit_id")).distinct().withColumn("canary_guid", _guid("unit_id"))
    return G.canary_scan(planted, guids)


RULES = {"teens": "^src1[0-9]/", "english": "^src[0-9]/en/", "continental": "^src[0-9]/(fr|de)/", "high": "/[0-9]{3,}[.]txt$"}


@query("qc31_path_rules", "SELECT n_rules, count(*) AS files FROM (SELECT " + " + ".join(f"CAST(regexp_matches(source || '/' || lang || '/' || doc_id || '.txt', '{p}') AS INTEGER)" for p in RULES.values()) + " AS n_rules FROM documents) GROUP BY 1")
def path_rules(t):
    files = t.read("documents").select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    return G.path_rules(files, RULES).groupBy("n_rules").agg(F.count(F.lit(1)).alias("files"))


@query("qc32_card_checks", "SELECT u.unit_id, u.family <> 'F3' AS weights_ok, u.family <> 'F2' AS panel_end_ok, u.family <> 'F4' AS guid_unique, month(u.asof) <> 6 AS text_cutoff_ok, true AS n_documents_ok FROM units u WHERE u.unit_id IN (SELECT unit_id FROM cut)")
def card_checks(t):
    asof = F.col("asof").cast("string")
    ends = t.cut.groupBy("unit_id").agg(F.count(F.lit(1)).cast("int").alias("n_documents"))
    cards = t.units.join(ends, "unit_id").select(
        "unit_id", F.when(F.col("family") == "F3", 0.6).otherwise(F.col("w_marginal")).alias("w_marginal"), "w_joint", "w_tail",
        asof.alias("data_cutoff"), F.when(F.col("family") == "F2", "1990-01-01").otherwise(asof).alias("panel_end"),
        F.when(F.col("family") == "F4", F.lit("shared")).otherwise(F.md5("unit_id")).alias("canary_guid"),
        F.when(F.month("asof") == 6, "1990-01-01").otherwise(asof).alias("text_cutoff"), "n_documents",
    )
    return G.card_checks(cards, t.cut.select("unit_id"))


@query("qc34_disclosures", "SELECT CAST(p_partkey AS VARCHAR) AS submission_id, CAST(2 AS BIGINT) AS models, CAST(CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS unpinned, CAST(CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS no_cutoff, p_size % 5 <> 0 AND p_size % 7 <> 0 AS ok FROM part")
def disclosures(t):
    model = lambda name, version, cutoff: F.struct(name.alias("name"), version.alias("version"), cutoff.alias("training_cutoff"))
    p = t.read("part").select(
        F.col("p_partkey").cast("string").alias("submission_id"),
        F.array(
            model(F.col("p_name"), F.when(F.col("p_size") % 5 == 0, "v-latest").otherwise("v-2024-01"), F.lit("2023-12-31")),
            model(F.col("p_brand"), F.lit("v1"), F.when(F.col("p_size") % 7 != 0, "2022-06-30")),
        ).alias("models"),
    )
    return G.disclosures(p)


@query(
    "qc35_egress_audit",
    "SELECT 'run' AS submission_id, lang AS unit_id, count(*) AS connections, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT domain) AS domains FROM (SELECT regexp_extract(url, '^https?://[^/]+/([^/?]+)', 1) AS lang, regexp_extract(url, '^https?://([^/]+)', 1) AS domain, CAST(length(html) AS BIGINT) AS bytes FROM pages) "
    "WHERE domain NOT IN (SELECT domain FROM allowed) GROUP BY 2",
    {"allowed": "SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS domain FROM pages WHERE length(url) % 3 = 0"},
)
def egress_audit(t):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    pages = t.read("pages")
    log = pages.select(F.lit("run").alias("submission_id"), F.regexp_extract("url", "^https?://[^/]+/([^/?]+)", 1).alias("unit_id"), host.alias("domain"), F.length("html").cast("long").alias("bytes"))
    return G.egress_audit(log, pages.where(F.length("url") % 3 == 0).select(host.alias("domain")).distinct())


