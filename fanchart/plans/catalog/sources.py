"""Source and sink queries.

Readers that need files first write a derived table into the shared folder as the tree they expect,
then read that tree back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fanchart.operators import aggregate as A
from fanchart.operators import gates as G
from fanchart.operators import panel as P
from fanchart.plans.bindings import Tables, rd
from fanchart.plans.catalog.common import rounded, text
from fanchart.plans.catalog.gates import _SUBS, metas
from fanchart.sources.materialize import shared_folder
from fanchart.plans.registry import query
from fanchart.sources import readers as R
from fanchart.sources import writers as W


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _present(t: Tables):
    return t.units.join(t.cut.select("unit_id").distinct(), "unit_id")


@query("src1_read_panels", f"SELECT unit_id, asset, count(*) AS n, CAST(min(date) AS VARCHAR) AS first, {rd('sum(value)', 3)} AS total FROM cut GROUP BY 1, 2")
def read_panels(t):
    root = _folder(t, "panels")
    t.cut.select("unit_id", "date", F.col("asset").alias("asset_id"), "value").repartition("unit_id").write.partitionBy("unit_id").parquet(root)
    return R.read_panels(t.spark, root).groupBy("unit_id", "asset").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.round(F.sum("value"), 3).alias("total")
    )


@query("src2_normalize_panel", "SELECT asset, count(*) AS n, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last, " + rd("sum(value)", 2) + " AS total FROM "
       "(SELECT asset, date, value FROM panel UNION ALL SELECT asset, date, value FROM panel_holey) GROUP BY 1")
def normalize_panel(t):
    stamped = t.panel_holey.select(F.concat(F.col("date").cast("string"), F.lit("T09:30:00")).alias("date"), F.col("asset").alias("asset_id"), "value", "panel_id")
    both = t.panel.withColumn("date", F.col("date").cast("string")).unionByName(stamped, allowMissingColumns=True)
    return P.normalize_panel(both).groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").cast("string").alias("first"), F.max("date").cast("string").alias("last"), F.round(F.sum("value"), 2).alias("total")
    )


@query("src3_panel_from_wide", f"SELECT 'LINES' AS asset, count(*) AS n, {rd('sum(l_extendedprice)', 1)} AS total FROM lineitem UNION ALL SELECT 'ORDERS', count(*), {rd('sum(o_totalprice)', 1)} FROM orders")
def panel_from_wide(t):
    lines = t.read("lineitem").select(F.col("l_shipdate").alias("date"), F.col("l_extendedprice").alias("close"), F.col("l_tax").alias("return"))
    orders = t.read("orders").select(F.col("o_orderdate").alias("date"), F.lit(1.0).alias("close"), F.col("o_totalprice").alias("value"))
    both = P.panel_from_wide(lines, "LINES").unionByName(P.panel_from_wide(orders, "ORDERS"))
    return both.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 1).alias("total"))


@query("src3_unpivot_panel", "SELECT asset, count(*) AS n, " + rd("sum(value)", 2) + " AS total FROM (SELECT unnest(['quantity', 'discount', 'tax']) AS asset, unnest([CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END, l_discount, l_tax]) AS value FROM lineitem) WHERE value IS NOT NULL GROUP BY 1")
def unpivot_panel(t):
    wide = t.read("lineitem").select(
        F.col("l_shipdate").alias("date"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")
    )
    long = P.unpivot_panel(wide, ["date"], ["quantity", "discount", "tax"])
    return long.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _quoted(c: str):
    return F.concat(F.lit('["'), F.array_join(c, '", "'), F.lit('"]'))


def _cards(t):
    asof = F.col("asof").cast("string")
    line = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    body = F.concat_ws(
        "\n",
        F.lit('schema_version = "2.0"'), F.lit("[task]"), line('id = "', F.col("unit_id"), '"'), F.lit('split = "public-dev"'),
        F.lit("[metadata]"), line('category = "', F.col("family"), '"'),
        F.lit("[provenance]"), line('data_cutoff = "', asof, '"'),
        F.lit("[contamination]"), line('canary_guid = "', F.md5("unit_id"), '"'),
        F.lit("[scoring.params]"), F.lit("tail_levels = [0.01, 0.05, 0.95, 0.99]"), F.lit('joint = "variogram"'), line('tail_metric = "', F.col("tail_metric"), '"'),
        F.lit("[scoring.params.weights]"), F.lit("marginal = 0.5"), F.lit("joint = 0.3"), F.lit("tail = 0.2"),
        F.lit("[panels.main]"), line('end_date = "', asof, '"'),
        F.lit("[text]"), line('cutoff = "', asof, '"'), F.lit("n_documents = 3"),
        F.lit("[targets]"), line("asset_ids = ", _quoted("asset_ids")), line("horizons = [", F.array_join(F.col("horizons").cast("array<string>"), ", "), "]"), F.lit('target_type = "level"'),
    )
    return _present(t).select(F.when(F.month("asof") == 12, F.concat(body, F.lit("\nbroken ="))).otherwise(body).alias("text"))


@query("src4_read_units", "SELECT count(*) AS cards, count(*) FILTER (WHERE month(asof) = 12) AS unreadable, CAST(sum(CASE WHEN month(asof) = 12 THEN 0 ELSE len(asset_ids) * len(horizons) END) AS BIGINT) AS cells, "
       "string_agg(DISTINCT CASE WHEN month(asof) <> 12 THEN family || ':' || tail_metric END, ',' ORDER BY CASE WHEN month(asof) <> 12 THEN family || ':' || tail_metric END) AS metrics, max(CASE WHEN month(asof) <> 12 THEN CAST(asof AS VARCHAR) END) AS last_cutoff FROM units WHERE unit_id IN (SELECT unit_id FROM cut)")
def read_units(t):
    u = R.parse_cards(_cards(t))
    return u.agg(
        F.count(F.lit(1)).alias("cards"), F.count("error").alias("unreadable"),
        F.sum(F.coalesce(F.size("asset_ids") * F.size("horizons"), F.lit(0))).alias("cells"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("error").isNull(), F.concat_ws(":", "family", "tail_metric")))), ",").alias("metrics"),
        F.max("data_cutoff").alias("last_cutoff"),
    )


@query("src4_read_specs", "SELECT unit_id, family, CAST(asof AS VARCHAR) AS data_cutoff, len(asset_ids) * len(horizons) AS cells, CAST(0.3 AS DOUBLE) AS w_joint, CAST(4 AS BIGINT) AS n_levels FROM units WHERE unit_id IN (SELECT unit_id FROM cut)")
def read_specs(t):
    spec = F.struct(
        F.col("unit_id").alias("card_id"), F.col("family").alias("card_family"),
        F.array(F.struct(F.lit("main").alias("panel_id"), F.col("asof").cast("string").alias("end_date"))).alias("panels"),
        F.struct("asset_ids", "horizons", "target_type").alias("targets"),
        F.struct(F.struct(F.lit(0.5).alias("marginal"), F.lit(0.3).alias("joint"), F.lit(0.2).alias("tail")).alias("weights"), F.array(*[F.lit(x) for x in (0.01, 0.05, 0.95, 0.99)]).alias("tail_levels")).alias("scoring"),
    )
    u = R.parse_specs(_present(t).select(F.to_json(spec).alias("text")))
    return u.select("unit_id", "family", "data_cutoff", (F.size("asset_ids") * F.size("horizons")).cast("long").alias("cells"), "w_joint", F.size("tail_levels").cast("long").alias("n_levels"))


@query("src5_trusted_asof", "SELECT unit_id, CASE month(asof) WHEN 3 THEN '2002-01-01' ELSE CAST(asof AS VARCHAR) END AS asof, '' AS fault FROM units WHERE month(asof) <> 9 AND unit_id IN (SELECT unit_id FROM cut) UNION ALL "
       "SELECT unit_id, NULL, 'no usable as-of' FROM units WHERE month(asof) = 9 AND unit_id IN (SELECT unit_id FROM cut)")
def trusted_asof(t):
    m = F.month("asof")
    cards = _present(t).select(
        "unit_id", F.when(m == 3, "2002-01-01").when(m == 6, "").alias("forecast_asof"), F.when(m == 9, "June 1996").otherwise(F.col("asof").cast("string")).alias("data_cutoff")
    )
    good, bad = R.trusted_asof(cards)
    return good.select("unit_id", text("asof"), F.lit("").alias("fault")).unionByName(bad.select("unit_id", F.lit(None).cast("string").alias("asof"), "fault"))


@query("src6_read_corpus_index", "SELECT unit_id, doc_id, CASE WHEN timestamp = 'undated' THEN NULL ELSE timestamp END AS timestamp, doc_type, regexp_replace(path, '^[./]+', '') AS path FROM doc_index")
def read_corpus_index(t):
    entry = F.struct("pos", "doc_id", F.when(F.col("timestamp") != "undated", F.col("timestamp")).alias("timestamp"), "source", "doc_type", F.when(F.col("pos") % 2 == 0, F.col("path")).alias("file"),
                     F.when(F.col("pos") % 2 == 0, "").otherwise(F.col("path")).alias("path"))
    # one index file lists a bounded run of documents
    files = t.index.groupBy("unit_id", F.floor(F.col("pos") / 50).alias("batch")).agg(
        F.to_json(F.struct(F.col("unit_id").alias("card_id"), F.sort_array(F.collect_list(entry)).alias("documents"))).alias("text")
    )
    return R.parse_corpus_index(files.select("unit_id", "text")).select("unit_id", "doc_id", "timestamp", "doc_type", "path")


@query("src7_read_documents", "SELECT source AS unit_id, md5(text) AS digest, count(*) AS copies FROM documents GROUP BY 1, 2")
def read_documents(t):
    root = _folder(t, "corpus")
    # rows may share a path: files are named by the row, 1,024 to a folder; a null has a name of its own, as a file holds a text
    row = F.monotonically_increasing_id()
    name = F.concat(F.hex(F.shiftright(row, 10)), F.lit("/"), F.when(F.col("text").isNull(), "none-").otherwise("doc-"), row.cast("string"), F.lit(".txt"))
    unit = F.coalesce(F.concat(F.lit("u-"), F.url_encode("unit_id")), F.lit("none"))
    W.write_documents(t.docs.select(unit.alias("unit_id"), name.alias("path"), F.coalesce("text", F.lit("")).alias("text")), root)
    known = F.when(F.col("unit_id") != "none", F.url_decode(F.substring("unit_id", 3, 1 << 20)))
    digest = F.when(~F.col("path").contains("/none-"), F.md5("text"))
    return R.read_documents(t.spark, root).groupBy(known.alias("unit_id"), digest.alias("digest")).agg(F.count(F.lit(1)).alias("copies"))


@query("src8_read_draws", f"SELECT submission_id, unit_id, count(*) AS n, max(draw) AS last_draw, {rd('sum(value)', 1)} AS total FROM draws GROUP BY 1, 2")
def read_draws(t):
    root = _submission_tree(t)
    return R.read_draws(t.spark, root, name="*.parquet").groupBy("submission_id", "unit_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("draw").cast("long").alias("last_draw"), F.round(F.sum("value"), 1).alias("total")
    )


@query("src8_draw_file_facts", "SELECT submission_id, unit_id, count(*) AS n_rows, CAST(4 AS INTEGER) AS n_columns, true AS readable FROM draws GROUP BY 1, 2")
def draw_file_facts(t):
    facts = R.inspect_draw_files(t.spark, _submission_tree(t), "*.parquet")
    return facts.select("submission_id", "unit_id", "n_rows", "n_columns", "readable")


def _submission_tree(t):
    root = _folder(t, "submissions")
    t.draws.repartition("submission_id", "unit_id").write.option("maxRecordsPerFile", 0).partitionBy("submission_id", "unit_id").parquet(root)
    return root


@query("src9_read_realized", f"SELECT unit_id, asset, CAST(horizon AS INTEGER) AS horizon, {rd('value')} AS value FROM realized")
def read_realized(t):
    root = _folder(t, "realized")
    t.realized.select("unit_id", F.lit(0).alias("draw"), "asset", "horizon", "value", "target_date").repartition("unit_id").write.partitionBy("unit_id").parquet(root)
    return rounded(R.read_realized(t.spark, root, "*/*.parquet"))


def _sidecars(t):
    m = metas(t)
    body = F.to_json(F.struct(F.col("declared_unit").alias("unit_id"), "asof", "representation", "asset_ids", "horizons", "n_draws", "target"))
    fam = F.substring("unit_id", 1, 2)
    broken = F.when((F.col("submission_id") == "adj") & (fam == "F1"), F.substring(body, 1, 20)).when(
        (F.col("submission_id") == "adj") & (fam == "F2"), F.concat(F.lit("["), body, F.lit("]"))
    ).when((F.col("submission_id") == "adj") & (fam == "F3"), F.regexp_replace(body, '"n_draws":[0-9]+', '"n_draws":true')).otherwise(body)
    return m.select("submission_id", "unit_id", broken.alias("text"))


@query("src10_read_meta", "SELECT submission_id, unit_id, declared_unit, asof_text AS asof, representation, len(a) AS n_assets, CASE WHEN submission_id = 'adj' AND unit_id LIKE 'F3%' THEN 'boolean' ELSE 'integer' END AS n_draws_type, "
       "CASE WHEN submission_id = 'adj' AND unit_id LIKE 'F3%' THEN NULL ELSE n_draws END AS n_draws, target FROM metas WHERE NOT (submission_id = 'adj' AND (unit_id LIKE 'F1%' OR unit_id LIKE 'F2%'))", _SUBS)
def read_meta(t):
    good, _ = R.parse_meta(_sidecars(t))
    n = F.when(F.col("n_draws_type") == "integer", F.col("n_draws").cast("long"))
    return good.select("submission_id", "unit_id", "declared_unit", "asof", "representation", F.size("asset_ids").cast("long").alias("n_assets"), "n_draws_type", n.alias("n_draws"), "target")


@query("src10_meta_refusals", "SELECT submission_id, unit_id, CASE WHEN unit_id LIKE 'F1%' THEN 'malformed_output' ELSE 'schema_invalid' END AS code FROM metas WHERE submission_id = 'adj' AND (unit_id LIKE 'F1%' OR unit_id LIKE 'F2%')", _SUBS)
def meta_refusals(t):
    return R.parse_meta(_sidecars(t))[1].select("submission_id", "unit_id", "code")


@query(
    "src11_read_ref_scale",
    f"SELECT u.unit_id || '/' || m.asset AS unit_id, CASE WHEN month(u.asof) = 3 THEN 'unknown key' WHEN month(u.asof) = 6 AND u.family <> 'F1' THEN 'missing joint' WHEN month(u.asof) = 9 THEN 'tail is not positive' WHEN u.asof = DATE '1999-12-31' THEN 'marginal is not a number' END AS fault, "
    f"CASE WHEN month(u.asof) = 12 AND u.asof <> DATE '1999-12-31' THEN {rd('m.sigma', 4)} END AS marginal FROM units u JOIN moments m ON m.unit_id = u.unit_id",
)
def read_ref_scale(t):
    m = F.month("asof")
    number = F.format_string("%.9f", "sigma")
    marginal = F.when(F.col("asof") == F.to_date(F.lit("1999-12-31")), F.lit("true")).otherwise(number)
    joint = F.when(m == 6, F.lit("")).when(F.col("family") == "F1", F.lit(', "joint": 0.0')).otherwise(F.concat(F.lit(', "joint": '), number))
    tail = F.when(m == 9, F.lit("-1")).otherwise(F.lit("2.5"))
    extra = F.when(m == 3, F.lit(', "note": "x"')).otherwise(F.lit(', "seed": 7'))
    body = F.concat(F.lit('{"marginal": '), marginal, joint, F.lit(', "tail": '), tail, extra, F.lit("}"))
    texts = t.moments.join(t.units, "unit_id").select(F.concat_ws("/", "unit_id", "asset").alias("unit_id"), (F.size("asset_ids") * F.size("horizons")).alias("cell_count"), body.alias("text"))
    asof = t.units.select(F.explode("asset_ids").alias("asset"), "unit_id", "asof").select(F.concat_ws("/", "unit_id", "asset").alias("unit_id"), "asof")
    out = R.parse_ref_scale(texts).join(asof, "unit_id")
    shown = (F.month("asof") == 12) & F.col("fault").isNull()
    return out.select("unit_id", "fault", F.round(F.when(shown, F.col("marginal")), 4).alias("marginal"))


def _plan_text(t):
    entry = F.struct(
        F.col("unit_id").alias("unit_handle"),
        F.struct(F.col("asset_ids").alias("assets"), "horizons", (F.size("asset_ids") * F.size("horizons") + F.when(F.col("family") == "F4", 1).otherwise(0)).alias("cell_count"), F.md5("unit_id").alias("digest")).alias("grid"),
    )
    # the plan lists the roster, which is the bounded set of units
    entries = _present(t).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return entries.select(F.to_json(F.struct(
        F.struct(F.lit("asc").alias("direction"), F.struct(F.lit(0.0).alias("min"), F.lit(4.0).alias("max")).alias("domain")).alias("metric"),
        F.struct(F.size("e").alias("count"), F.col("e").alias("expected_units")).alias("roster"),
        F.struct(F.lit(4.0).alias("score"), F.lit(True).alias("clip_real_scores_to_domain")).alias("participant_failure"),
        F.struct(F.lit("ref_scale").alias("mode")).alias("normalization"),
    )).alias("text"))


@query("src12_read_roster", "SELECT unit_id, len(asset_ids) AS n_assets, len(horizons) AS n_horizons, family <> 'F4' AS grid_ok, CAST(row_number() OVER (ORDER BY unit_id) - 1 AS INTEGER) AS pos FROM units WHERE unit_id IN (SELECT unit_id FROM cut)")
def read_roster(t):
    units, _ = R.parse_roster(_plan_text(t))
    return units.select("unit_id", F.size("asset_ids").cast("long").alias("n_assets"), F.size("horizons").cast("long").alias("n_horizons"), "grid_ok", "pos")


@query("src12_roster_policy", "SELECT CAST(count(*) AS INTEGER) AS roster_count, 'asc' AS direction, CAST(0 AS DOUBLE) AS domain_min, CAST(4 AS DOUBLE) AS domain_max, CAST(4 AS DOUBLE) AS failure_score, true AS clip, 'ref_scale' AS normalization_mode FROM units WHERE unit_id IN (SELECT unit_id FROM cut)")
def roster_policy(t):
    return R.parse_roster(_plan_text(t))[1]


@query("src13_resolve_grid", "SELECT unit_id, array_to_string(CASE WHEN family = 'F2' THEN list_reverse(asset_ids) ELSE asset_ids END, ',') AS assets, CASE WHEN family = 'F1' THEN 'card' ELSE 'plan' END AS grid_source, CASE WHEN family = 'F1' THEN 'raw_unrankable' ELSE 'ref_scale' END AS normalization_mode FROM units WHERE unit_id IN (SELECT unit_id FROM cut)")
def resolve_grid(t):
    present = _present(t)
    a = F.when(F.col("family") == "F2", F.reverse("asset_ids")).otherwise(F.col("asset_ids"))
    roster = present.where("family <> 'F1'").select("unit_id", a.alias("asset_ids"), "horizons")
    return R.resolve_grid(present, roster).select("unit_id", F.array_join("asset_ids", ",").alias("assets"), "grid_source", "normalization_mode")


@query("snk1_write_draws", f"SELECT submission_id, unit_id, count(*) AS n, {rd('sum(value)', 1)} AS total, {rd('max(value)', 4)} AS top FROM draws GROUP BY 1, 2")
def write_draws(t):
    path = _folder(t, "draws-table")
    W.write_draws(t.draws, path)
    return R.read_draws_table(t.spark, path).groupBy("submission_id", "unit_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 1).alias("total"), F.round(F.max("value"), 4).alias("top")
    )


@query("snk2_write_meta", "SELECT unit_id, CAST(asof AS VARCHAR) AS asof, 'samples' AS representation, array_to_string(asset_ids, ',') AS assets, CAST(n AS INTEGER) AS n_draws, family <> 'F1' AS reasoning_applied, CASE WHEN family = 'F1' THEN 'no corpus' ELSE '' END AS reason, CAST(3 AS INTEGER) AS documents_read FROM units JOIN (SELECT unit_id AS u, max(n_rows) AS n FROM aligned GROUP BY 1) ON u = unit_id")
def write_meta(t):
    n = t.aligned.groupBy("unit_id").agg(F.max("n_rows").cast("int").alias("n_draws"))
    rows = t.units.join(n, "unit_id").select(
        F.lit("hist").alias("submission_id"), "unit_id", "asof", "asset_ids", "horizons", "n_draws", "target_type", (F.col("family") != "F1").alias("reasoning_applied"),
        F.lit("no corpus").alias("reason"), F.lit(3).alias("documents_read"), F.lit(1).alias("documents_excluded"), F.lit(0).alias("documents_dropped"),
    )
    path = _folder(t, "meta")
    W.write_meta(rows, path)
    got = t.spark.read.text(path).select(F.from_json("value", "unit_id string, asof string, representation string, asset_ids array<string>, n_draws int, reasoning_applied boolean, reasoning_skipped_reason string, rationale struct<documents_read:int>").alias("j")).select("j.*")
    return got.select("unit_id", "asof", "representation", F.array_join("asset_ids", ",").alias("assets"), "n_draws", "reasoning_applied", F.col("reasoning_skipped_reason").alias("reason"), "rationale.documents_read")


@query("snk3_write_scores", f"SELECT submission_id, {rd('value', 4)} AS value, n_scored, (SELECT count(*) FROM units) AS roster_count FROM means",
       {"means": "SELECT submission_id, count_if(state = 'success') AS n_scored, (sum(counted) + ((SELECT count(*) FROM units) - count(*)) * CAST(4 AS DOUBLE)) / (SELECT count(*) FROM units) AS value FROM counted GROUP BY 1"})
def write_scores(t):
    path = _folder(t, "scores")
    rows = t.results.withColumn("failure_code", F.when(F.col("state") == "failure", F.lit("no_output")))
    W.write_scores(A.roster_mean(t.results, t.units), A.provenance(rows, t.units), path)
    return rounded(t.spark.read.json(path).select("submission_id", "value", "n_scored", "roster_count"), 4)


@query("snk3_write_details", "SELECT submission_id, unit_id, code, nullif(CAST(violation AS BIGINT), -1) AS violation_count FROM q5", _SUBS)
def write_details(t):
    path = _folder(t, "details")
    W.write_details(G.bind_meta(metas(t), t.units), path)
    got = t.spark.read.schema("submission_id string, unit_id string, code string, counts map<string,bigint>").json(path)
    return got.select("submission_id", "unit_id", "code", F.element_at("counts", F.lit("violation_count")).alias("violation_count"))


@query("snk4_ledger", f"SELECT c.unit_id, c.asset, c.horizon, {rd('a.last')} AS anchor, {rd('s.daily_sd', 4)} AS daily_sd, {rd('s.daily_sd * sqrt(CAST(c.horizon AS DOUBLE))', 4)} AS horizon_sd FROM cells c JOIN anchors a ON a.unit_id = c.unit_id AND a.asset = c.asset JOIN sds s ON s.unit_id = c.unit_id AND s.asset = c.asset")
def ledger(t):
    out = W.ledger(t.anchors, P.sample_sd(t.aligned), t.units)
    return out.select("unit_id", "asset", "horizon", F.round("anchor", 6).alias("anchor"), F.round("daily_sd", 4).alias("daily_sd"), F.round("horizon_sd", 4).alias("horizon_sd"))
