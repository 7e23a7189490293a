"""Text-adjusted forecasts as one plan: documents to context, context to reply, reply to draws and sidecars.

The model is a function of a batch of contexts. Every reply is stored under the digest of its context by the task that
got it, so equal contexts are asked once and a task that runs again, on another executor or in a later run, reads what
is there. A failed call leaves the unit's draws unadjusted and says so; it is never a silent zero.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanchart import contract as C
from fanchart.operators import corpus as X
from fanchart.operators import generators as FC
from fanchart.operators import panel as P
from fanchart.plans.scoring import baseline_draws
from fanchart.sources.listing import open_system
from fanchart.sources.materialize import materialized

#: Contexts of one call.
BATCH = 32
#: Closes each context; replies in this form are what ``parse_adjustments`` reads.
INSTRUCTION = (
    'Answer with one JSON object {"assets": {NAME: {"drift_bp": NUMBER, "vol_scale": NUMBER, "because": TEXT}}} that names each asset: '
    "drift_bp shifts the longest horizon by basis points of the level's size, vol_scale between 0.5 and 2 scales the deviation; 0 and 1 change nothing."
)
NO_DOCUMENTS, NO_REPLY = "no document up to the as-of", "the model call failed"


@dataclass
class Forecasts:
    """Draws ``(U, draw, asset, horizon, value)``, sidecar rows for ``write_meta``, and each unit's adjustments."""

    draws: DataFrame
    sidecars: DataFrame
    adjustments: DataFrame


def ask(contexts: DataFrame, model: Callable[[list[str]], list[str]], store: str, batch: int = BATCH) -> DataFrame:
    """``(unit_id, context)`` -> ``(unit_id, reply)``, null where the model failed. ``store`` is a folder all executors share.

    A batch that fails is asked one by one, so one bad context costs its own unit.
    """

    def answer(texts: list[str]) -> list[str | None]:
        try:
            out = model(texts)
            if len(out) == len(texts):
                return out
        except Exception:  # noqa: BLE001 - whatever a model raises is the outcome of its units
            pass
        return [None] if len(texts) == 1 else [r for t in texts for r in answer([t])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_system(store.rstrip("/"))
        system.create_dir(folder, recursive=True)

        def stored(key: str) -> str | None:
            try:
                with system.open_input_file(f"{folder}/{key}") as f:
                    return f.read().decode()
            except FileNotFoundError:
                return None

        for rows in batches:
            keys, texts = rows["key"].to_pylist(), rows["context"].to_pylist()
            for i in range(0, len(keys), batch):
                found = {k: stored(k) for k in keys[i : i + batch]}
                new = [(k, t) for k, t in zip(keys[i : i + batch], texts[i : i + batch]) if found[k] is None]
                for (k, _), reply in zip(new, answer([t for _, t in new]) if new else []):
                    if reply is not None:
                        # whole or not at all: written aside, then named
                        aside = f"{folder}/{k}.{uuid.uuid4().hex}"
                        with system.open_output_stream(aside) as f:
                            f.write(reply.encode())
                        system.move(aside, f"{folder}/{k}")
                    found[k] = reply
                yield pa.RecordBatch.from_pydict({"key": pa.array(list(found), pa.string()), "reply": pa.array(list(found.values()), pa.string())})

    asked = contexts.select("unit_id", "context", F.sha2("context", 256).alias("key"))
    distinct = asked.groupBy("key").agg(F.first("context").alias("context"))
    got = materialized(distinct.mapInArrow(run, "key string, reply string"), "replies")
    return asked.join(got, "key").select("unit_id", "reply")


def text_adjusted(panel: DataFrame, index: DataFrame, docs: DataFrame, units: DataFrame, model: Callable[[list[str]], list[str]], store: str,
                  name: str = "text", n_draws: int = C.DEFAULT_DRAWS, seed: int = 0, k: int = C.MAX_DOCS) -> Forecasts:
    """The text-blind walk of all units, moved by what a model reads in the ``k`` newest documents up to each as-of.

    Units without a document are not asked. Every unit of the walk has draws; ``sidecars`` tell whether and why not they
    were adjusted.
    """
    base = materialized(baseline_draws(panel, units, n_draws, seed).drop("submission_id"), "walk")
    history = P.select_panel(P.asof_cut(P.drop_nonfinite(panel), units))
    aligned = P.align(P.gap_guard(P.first_diff(history)), units)
    reach = units.select("unit_id", F.sqrt(F.array_max("horizons").cast("double")).alias("_reach"))
    stats = P.sample_sd(aligned).join(P.anchor(history).select(*P.SERIES, "last"), P.SERIES).join(reach, "unit_id")
    stats = materialized(stats.select(*P.SERIES, "last", (F.col("daily_sd") * F.col("_reach")).alias("sd_h")), "walk-stats")

    kept, counts = X.docs_asof(index, docs, units)
    top, dropped = X.newest_k(kept, k)
    some = counts.where("kept > 0").select("unit_id")
    contexts = X.context_pack(top, stats, units, INSTRUCTION).join(some, "unit_id", "left_semi")
    replies = materialized(ask(contexts, model, store), "unit-replies")
    adjustments, outcome = FC.parse_adjustments(replies.where("reply IS NOT NULL"), units)
    adjustments = materialized(adjustments, "adjustments")
    draws = FC.adjust(base, adjustments, stats).select(F.lit(name).alias("submission_id"), "*")

    failed = replies.where("reply IS NULL").select("unit_id", F.lit(True).alias("_failed"))
    rows = units.join(base.select("unit_id").distinct(), "unit_id", "left_semi").join(outcome, "unit_id", "left").join(failed, "unit_id", "left")
    rows = rows.join(counts, "unit_id", "left").join(dropped, "unit_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    reason = F.when(n("kept") == 0, NO_DOCUMENTS).when(F.col("_failed"), NO_REPLY).otherwise(F.col("reason"))
    sidecars = rows.select(
        F.lit(name).alias("submission_id"), "unit_id", "asof", "asset_ids", "horizons", F.lit(n_draws).alias("n_draws"), "target_type",
        F.coalesce("reasoning_applied", F.lit(False)).alias("reasoning_applied"), reason.alias("reason"),
        (n("kept") - n("dropped")).alias("documents_read"), n("excluded").alias("documents_excluded"), n("dropped").alias("documents_dropped"),
    )
    return Forecasts(draws, sidecars, adjustments)
