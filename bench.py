"""Time the headline queries; print one JSON line.

Every query runs to completion into a sink that discards rows, after one small warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fanchart.operators import generators as FC
from fanchart.operators import metrics as M
from fanchart.plans import registry
from fanchart.plans.bindings import LEVELS, Tables
from fanchart.sources.materialize import materialized
from tests.session import session

HEADLINE = [
    "met1_crps_line_items", "met1_cell_statistics_line_items", "met2_variogram_line_items", "met3_energy", "met11_score_payload",
    "pan9_moments", "pan12_corr_matrix", "pan15_locf", "fc2_rw_joint", "fc7_bootstrap_paths", "qc14_occupancy_line_items",
    "qc18_first_failure", "agg7_bootstrap_ci", "agg11_sibling_leak", "agg12_corpus_census", "txt2_newest_k", "txt6_passage_overlap",
    "txt6_longest_shared_run",
]


def ten_million_draws(t: Tables):
    """Two submissions of 19,000 joint walk draws for each roster unit: about 10^7 rows."""
    runs = None
    for seed in (1, 2):
        draws = FC.rw_independent(t.moments, t.units, 19_000, seed).selectExpr(f"'s{seed}' AS submission_id", "*")
        runs = draws if runs is None else runs.unionByName(draws)
    return materialized(runs, "bench-draws")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    queries = registry.load()

    def timed(build) -> float:
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    timed(lambda: queries["pan5_anchor"](spark, sf))
    seconds = {name: timed(lambda n=name: queries[n](spark, sf)) for name in HEADLINE}
    t = Tables(spark, sf)
    draws, realized = ten_million_draws(t), materialized(t.realized, "bench-realized")
    seconds["metric_pass_1e7_draws"] = timed(lambda: M.components(draws, realized, t.units, LEVELS))
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "metric_pass_rows": 2 * 19_000 * 264,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
