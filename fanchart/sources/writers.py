"""Sinks. Every sink renders with columns first, so the rendering also works on tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanchart.contract import UNIT_KEYS
from fanchart.functions.columns import is_finite
from fanchart.operators.gates import OrganizerFault, public_projection
from fanchart.sources.listing import open_system
from fanchart.sources.materialize import materialized


def write_draws(draws: DataFrame, path: str) -> None:
    """The draws table, partitioned by unit and sorted by draw, asset, horizon.

    ``rebalance`` lets adaptive execution split a unit that holds much of the table over many files
    instead of funnelling it through one task.
    """
    (
        draws.hint("rebalance", "unit_id", "submission_id")
        .sortWithinPartitions("unit_id", "submission_id", "draw", "asset", "horizon")
        .write.mode("overwrite").partitionBy("unit_id").parquet(path)
    )


def _write_files(batches: Iterator) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    attempt, made = TaskContext.get().taskAttemptId(), set()
    for batch in batches:
        for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist()):
            system, inner = open_system(path)
            folder, name = inner.rsplit("/", 1)
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            # a second attempt of a task must not cut a file that the first one has finished
            own = f"{folder}/.{attempt}-{name}"
            with system.open_output_stream(own) as f:
                f.write(text.encode())
            system.move(own, inner)
        yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})


def write_documents(docs: DataFrame, root: str) -> int:
    """``(unit_id, path, text)`` to ``<root>/<unit>/text/<path>``, one file per document; how many there are.

    Every task writes its own files at their last place, so nothing is renamed or listed by the driver. Paths must be
    distinct within a unit and the same in every attempt, units the name of a folder, texts not null. Keep folders
    small: one task lists a folder.
    """
    files = docs.select(F.concat(F.lit(root.rstrip("/") + "/"), "unit_id", F.lit("/text/"), "path").alias("path"), "text")
    return files.mapInArrow(_write_files, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def render_meta(rows: DataFrame) -> DataFrame:
    """One JSON sidecar per (submission, unit).

    ``rows`` is ``(U, asof, asset_ids, horizons, n_draws, target_type, reasoning_applied, reason,
    documents_read, documents_excluded, documents_dropped)``.
    """
    applied = F.coalesce("reasoning_applied", F.lit(False))
    method = F.when(applied, "joint gaussian random walk with text adjustment").otherwise(
        "joint gaussian random walk, unadjusted"
    )
    body = F.struct(
        "unit_id", F.col("asof").cast("string").alias("asof"), F.lit("samples").alias("representation"),
        "asset_ids", "horizons", "n_draws", F.col("target_type").alias("target"),
        applied.alias("reasoning_applied"),
        F.when(applied, "").otherwise(F.coalesce("reason", F.lit(""))).alias("reasoning_skipped_reason"),
        F.struct(
            F.lit("forecast_rationale.md").alias("file"), method.alias("method"), "documents_read",
            F.col("documents_excluded").alias("documents_excluded_by_cutoff"),
            F.col("documents_dropped").alias("documents_over_prompt_budget"),
        ).alias("rationale"),
    )
    return rows.select(*UNIT_KEYS, F.to_json(body).alias("text"))


def write_meta(rows: DataFrame, path: str) -> None:
    render_meta(rows).write.mode("overwrite").partitionBy(*UNIT_KEYS).text(path)


def write_scores(aggregates: DataFrame, provenance: DataFrame, path: str) -> None:
    """Aggregates with provenance. A non-finite value is a fault and nothing is written."""
    if not aggregates.where(~is_finite("value")).isEmpty():
        raise OrganizerFault("a non-finite aggregate cannot be published")
    aggregates.join(provenance, "submission_id").write.mode("overwrite").json(path)


def write_details(failures: DataFrame, path: str) -> None:
    """Failures only, codes and counts only; the sink exists even when there are none."""
    public_projection(failures).write.mode("overwrite").json(path)


def ledger(anchors: DataFrame, deviations: DataFrame, units: DataFrame) -> DataFrame:
    """Anchor, daily deviation and deviation at each horizon, per asset and horizon."""
    cells = units.select("unit_id", F.explode("asset_ids").alias("asset"), "horizons").select(
        "unit_id", "asset", F.explode("horizons").alias("horizon")
    )
    return (
        cells.join(anchors.select("unit_id", "asset", "last"), ["unit_id", "asset"])
        .join(deviations.select("unit_id", "asset", "daily_sd"), ["unit_id", "asset"])
        .select(
            "unit_id", "asset", "horizon", F.col("last").alias("anchor"), "daily_sd",
            (F.col("daily_sd") * F.sqrt(F.col("horizon").cast("double"))).alias("horizon_sd"),
        )
    )


def write_submission_tree(draws: DataFrame, sidecars: DataFrame, root: str) -> DataFrame:
    """``<root>/<submission>/<unit>/`` with the three files of a submission; returns ``(U, n_rows)``.

    ``sidecars`` is ``(U, meta, rationale, others)``: texts, null where the file is left out, and a map of further file
    names to texts. A key without draws has no draws file. The contract bounds a group (20,000 draws of each cell); the
    task that holds it writes its files, and a task that runs again writes the same ones.
    """
    import pyarrow as pa

    from fanchart.contract import DRAW_COLUMNS, SUBMISSION_FILES, UNIT_KEYS
    from fanchart.sources.listing import open_system

    def write(key, rows: pa.Table, texts: pa.Table) -> pa.Table:
        import pyarrow.parquet as pq

        sub, unit = (k.as_py() for k in key)
        system, folder = open_system(f"{root.rstrip('/')}/{sub}/{unit}")
        system.create_dir(folder, recursive=True)
        if rows.num_rows:
            with system.open_output_stream(f"{folder}/{SUBMISSION_FILES[0]}") as out:
                pq.write_table(rows.select(list(DRAW_COLUMNS)), out)
        for t in texts.select(["meta", "rationale", "others"]).to_pylist():
            files = dict(zip(SUBMISSION_FILES[1:], (t["meta"], t["rationale"]))) | dict(t["others"] or [])
            for name, text in files.items():
                if text is not None:
                    with system.open_output_stream(f"{folder}/{name}") as out:
                        out.write(text.encode())
        return pa.table({"submission_id": [sub], "unit_id": [unit], "n_rows": pa.array([rows.num_rows], pa.int64())})

    named = sidecars.select(F.col(UNIT_KEYS[0]).alias("_sub"), F.col(UNIT_KEYS[1]).alias("_unit"), "meta", "rationale", "others")
    both = draws.groupBy(*UNIT_KEYS).cogroup(named.groupBy("_sub", "_unit"))
    return materialized(both.applyInArrow(write, "submission_id string, unit_id string, n_rows long"), "tree")
