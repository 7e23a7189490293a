"""Registered queries: coverage of the inventory, SQL twins, and plan shape."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from fanchart.plans import registry
from tools.check_queries import TABLES, key, plain

SMALL = "/root/testdata/sf0.001"
INVENTORY = (
    [f"src{i}" for i in range(1, 14)] + [f"snk{i}" for i in range(1, 5)] + [f"pan{i}" for i in range(1, 27)] + [f"fc{i}" for i in range(1, 15)]
    + [f"qc{i}" for i in range(1, 36) if i not in (30, 33)] + [f"met{i}" for i in range(1, 17)] + [f"agg{i}" for i in range(1, 17)]
    + [f"txt{i}" for i in range(1, 9)] + [f"udf{i}" for i in range(1, 5)]
)
LIGHT = [
    "pan7_gap_guard", "pan9_moments", "pan15_locf", "pan20_target_dates", "pan26_deoverlap", "fc2_rw_joint", "fc6_parse_outcomes", "qc17_corpus_cutoff",
    "qc28_manifest_audit", "met1_cell_statistics_line_items", "met2_variogram_line_items", "met14_interval_coverage", "agg11_sibling_leak", "agg12_corpus_census",
    "txt4_context_pack", "txt6_passage_overlap", "src4_read_units",
]


def test_every_operator_has_a_query():
    names = {n.split("_")[0] for n in registry.load()}
    assert set(INVENTORY) == names


def test_only_the_quadratic_history_lacks_a_twin():
    assert set(registry.load()) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", LIGHT)
def test_query_equals_its_twin(spark, db, name):
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=key)
    cur = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=key)
    assert cols == sorted(names)
    assert got == want


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) > 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_marginal_scores_shuffle_the_draws_once(spark):
    from fanchart.operators import metrics as M
    from fanchart.plans.bindings import LEVELS, Tables

    t = Tables(spark, SMALL)
    plan = plan_of(M.cell_statistics(t.draws, t.realized, LEVELS))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert "target_date" not in plan  # the sealed date is pruned at the scan


def test_column_pruning_reaches_the_scan(spark):
    plan = plan_of(entry.queries()["agg12_corpus_census"](spark, SMALL))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["source", "text"]


def test_newest_k_limits_before_the_shuffle(spark):
    plan = plan_of(entry.queries()["txt2_newest_k"](spark, SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan
