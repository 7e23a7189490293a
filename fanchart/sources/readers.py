"""Readers for unit trees, submission trees and reference material.

Layout: ``<root>/<unit>/{card.toml, panels/*.parquet, text/corpus_index.json, text/*, reference/*}``
and ``<root>/<submission>/<unit>/{forecast.parquet, forecast_meta.json, forecast_rationale.md}``.

Each reader is a scan plus a parse over columns, so the parse also runs on text that is already in a
table. Submissions are written by many hands with differing schemas, which one Parquet scan would refuse as a
whole. Their trees are listed by tasks (:mod:`fanchart.sources.listing`), and tasks open the files: of a draws file
the end is read first, and only a file inside all ceilings is read whole, batch by batch. Everything after
:func:`fanchart.sources.writers.write_draws` is a native columnar scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanchart import contract as C
from fanchart.contract import (
    DEFAULT_JOINT,
    DEFAULT_TAIL_LEVELS,
    DEFAULT_TAIL_METRIC,
    DEFAULT_WEIGHTS,
    DRAW_COLUMNS,
    UNIT_SCHEMA,
)
from fanchart.functions.columns import is_finite, is_iso
from fanchart.operators.gates import CHECK, GATES, UNIT_KEYS, refusal
from fanchart.sources.listing import FILE, FOLDER, dealt, is_known, list_tree, open_file


#: A directory name, with or without the ``column=`` prefix that a partitioned write puts there.
DIR = r"(?:[^/=]+=)?([^/]+)"


def _binary(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root)
    )


def _part(path: str | Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(path, pattern, group)


def _text(content: str = "content") -> Column:
    return F.make_valid_utf8(F.col(content).cast("string"))


# ---- panels ----------------------------------------------------------------------------------

def _decode_panels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow as pa
    import pyarrow.parquet as pq

    for frame in frames:
        for row in frame.itertuples(index=False):
            table = pq.ParquetFile(pa.BufferReader(row.content))
            names = table.schema_arrow.names
            asset = next((c for c in ("asset", "asset_id") if c in names), None)
            value = next((c for c in ("value", "close", "return") if c in names), None)
            wanted = [c for c in ("date", asset, value) if c in names]
            for batch in table.iter_batches(columns=wanted):
                got = batch.to_pandas(date_as_object=True)
                dates = got["date"].astype("string").str.slice(0, 10) if "date" in got else None
                yield pd.DataFrame(
                    {
                        "unit_id": row.unit_id,
                        "panel_id": row.panel_id,
                        "date": dates,
                        "asset": got[asset].astype("string") if asset else row.panel_id,
                        "value": pd.to_numeric(got[value], errors="coerce") if value else float("nan"),
                    },
                    index=got.index,
                )


def read_panels(spark: SparkSession, root: str) -> DataFrame:
    """Every panel of every unit, tagged with its file stem; raw text dates.

    A unit that keeps its panels one directory up is read there instead. A per-asset file without
    an asset column is named after its stem.
    """
    inner = rf"/{DIR}/panels/([^/]+)\.parquet$"
    outer = rf"/{DIR}/([^/]+)\.parquet$"
    files = _binary(spark, root, "*.parquet")
    direct = files.where(F.col("path").rlike(inner)).select(
        "content", _part("path", inner).alias("unit_id"), _part("path", inner, 2).alias("panel_id")
    )
    beside = files.where(
        ~F.col("path").rlike(inner) & ~F.col("path").rlike(r"/reference/")
    ).select("content", _part("path", outer).alias("unit_id"), _part("path", outer, 2).alias("panel_id"))
    beside = beside.join(direct.select("unit_id").distinct(), "unit_id", "left_anti")
    return direct.unionByName(beside).mapInPandas(_decode_panels, C.PANEL_SCHEMA)


def panel_faults(spark: SparkSession, root: str, units: DataFrame) -> DataFrame:
    """``(unit_id, fault)`` of panel folders that must not be published: none, an empty one, entries that are no panel,
    panels that cannot be opened or have no date column. Nothing is skipped because it cannot be read."""
    tree = list_tree(spark, root, 3).withColumn("_b", _below("path", root)).where(F.get("_b", F.lit(1)) == "panels")
    unit = F.col("_b")[0].alias("unit_id")
    is_panel = F.col("name").endswith(".parquet") & (F.col("kind") == FILE)
    folders = tree.where((F.col("depth") == 2) & (F.col("kind") == FOLDER)).select(unit, F.lit(True).alias("_there"))
    inside = tree.where("depth = 3").groupBy(unit).agg(F.count_if(is_panel).alias("_panels"), F.count_if(~is_panel).alias("_stray"))
    rows = units.select("unit_id").join(folders, "unit_id", "left").join(inside, "unit_id", "left")
    none = F.coalesce("_panels", F.lit(0)) == 0
    fault = F.when(F.col("_there").isNull(), "no panel folder").when(none, "no panel in the folder").when(F.col("_stray") > 0, "entries that are no panel")
    files = tree.where((F.col("depth") == 3) & is_panel).select(F.lit("").alias("submission_id"), unit, "path", "length")
    facts = dealt(files.join(units.select("unit_id"), "unit_id", "left_semi")).mapInPandas(_footers, FACTS_SCHEMA)
    opened = F.when(~F.col("readable"), "a panel cannot be opened").when(~F.array_contains("columns", "date"), "a panel has no date column")
    return rows.select("unit_id", fault.alias("fault")).unionByName(facts.select("unit_id", opened.alias("fault")).distinct()).where("fault IS NOT NULL")


# ---- units -----------------------------------------------------------------------------------

UNIT_FIELDS = tuple(UNIT_SCHEMA.fieldNames())


def _parse_cards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import tomllib

    def one(text: str) -> dict:
        try:
            card = tomllib.loads(text)
            part = lambda *keys: _dig(card, keys)
            weights = part("scoring", "params", "weights") or DEFAULT_WEIGHTS
            targets = part("targets") or {}
            ends = [p.get("end_date") for p in (card.get("panels") or {}).values() if isinstance(p, dict)]
            return {
                "unit_id": part("task", "id"), "split": part("task", "split"),
                "family": part("metadata", "category"),
                "forecast_asof": part("forecast", "asof"), "data_cutoff": part("provenance", "data_cutoff"),
                "asset_ids": [str(a) for a in targets["asset_ids"]],
                "horizons": [int(h) for h in targets["horizons"]],
                "target_dates": [str(d) for d in targets.get("target_dates") or []],
                "target_type": targets.get("target_type", "level"),
                "tail_levels": [float(a) for a in part("scoring", "params", "tail_levels") or DEFAULT_TAIL_LEVELS],
                "joint": part("scoring", "params", "joint") or DEFAULT_JOINT,
                "tail_metric": part("scoring", "params", "tail_metric") or DEFAULT_TAIL_METRIC,
                "n_draws_min": int(part("scoring", "params", "n_draws_min") or 0),
                "w_marginal": float(weights["marginal"]), "w_joint": float(weights["joint"]),
                "w_tail": float(weights["tail"]),
                "canary_guid": part("contamination", "canary_guid"),
                "text_cutoff": part("text", "cutoff"), "n_documents": int(part("text", "n_documents") or 0),
                "panel_end": max((str(e) for e in ends if e), default=None), "error": None,
            }
        except (ValueError, KeyError, TypeError) as exc:
            return {"error": f"{type(exc).__name__}: {exc}"}

    names = list(UNIT_FIELDS)
    for frame in frames:
        rows = [one(t) for t in frame["text"]]
        yield pd.DataFrame(
            {n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names}, columns=names
        )


def _dig(node: object, keys: tuple[str, ...]) -> object:
    for key in keys:
        node = node.get(key) if isinstance(node, dict) else None
    return node


def parse_cards(texts: DataFrame) -> DataFrame:
    """``(text)`` of TOML cards to the units table; an unreadable card keeps only ``error``."""
    return texts.select("text").mapInPandas(_parse_cards, UNIT_SCHEMA)


def read_units(spark: SparkSession, root: str) -> DataFrame:
    return parse_cards(_binary(spark, root, "card.toml").select(_text().alias("text")))


SPEC_SCHEMA = (
    "card_id string, card_family string, output_format string, n_draws_min int, canary_guid string, "
    "panels array<struct<panel_id:string,source:string,series_count:int,frequency:string,"
    "start_date:string,end_date:string>>, "
    "targets struct<asset_ids:array<string>,horizons:array<int>,target_type:string,n_assets:int>, "
    "scoring struct<verifier:string,metric:string,"
    "weights:struct<marginal:double,joint:double,tail:double>,tail_levels:array<double>>"
)


def parse_specs(texts: DataFrame) -> DataFrame:
    """The JSON twin of a card to the columns it shares with the units table."""
    s = texts.select(F.from_json("text", SPEC_SCHEMA).alias("s")).select("s.*")
    return s.select(
        F.col("card_id").alias("unit_id"), F.col("card_family").alias("family"),
        F.array_max(F.col("panels.end_date")).alias("data_cutoff"),
        "targets.asset_ids", "targets.horizons", "targets.target_type", "scoring.tail_levels",
        F.coalesce("n_draws_min", F.lit(0)).alias("n_draws_min"),
        F.col("scoring.weights.marginal").alias("w_marginal"),
        F.col("scoring.weights.joint").alias("w_joint"), F.col("scoring.weights.tail").alias("w_tail"),
        "canary_guid",
    )


def read_specs(spark: SparkSession, root: str) -> DataFrame:
    return parse_specs(_binary(spark, root, "forecast_spec.json").select(_text().alias("text")))


def trusted_asof(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units with a DATE ``asof``, and the faults: cards that state no usable as-of."""
    stated = F.coalesce(F.when(F.col("forecast_asof") != "", F.col("forecast_asof")), F.col("data_cutoff"))
    ok = is_iso(stated)
    good = units.where(ok).withColumn("asof", F.to_date(stated))
    return good, units.where(~ok).select("unit_id", F.lit("no usable as-of").alias("fault"))


# ---- corpora ---------------------------------------------------------------------------------

INDEX_SCHEMA = (
    "card_id string, asof string, note string, documents array<struct<doc_id:string,timestamp:string,"
    "source:string,doc_type:string,file:string,path:string,note:string>>"
)


def parse_corpus_index(texts: DataFrame) -> DataFrame:
    """``(unit_id, text)`` of index files to one row per indexed document.

    The path is ``path`` else ``file`` without any leading run of dots and slashes.
    """
    raw = F.coalesce(F.when(F.col("d.path") != "", F.col("d.path")), F.col("d.file"))
    return (
        texts.select("unit_id", F.from_json("text", INDEX_SCHEMA).alias("x"))
        .select("unit_id", F.posexplode("x.documents").alias("pos", "d"))
        .select(
            "unit_id", "pos", "d.doc_id", "d.timestamp", "d.source", "d.doc_type",
            F.regexp_replace(raw, r"^[./]+", "").alias("path"),
        )
    )


def read_corpus_index(spark: SparkSession, root: str) -> DataFrame:
    files = _binary(spark, root, "corpus_index.json")
    return parse_corpus_index(
        files.select(_part("path", r"/([^/]+)/text/corpus_index\.json$").alias("unit_id"), _text().alias("text"))
    )


#: Bytes of documents that travel in one batch.
DOCUMENT_BATCH = 4 << 20


def _bodies(batches: Iterator) -> Iterator:
    import pyarrow as pa

    def packed(paths: list, bodies: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(bodies, pa.binary())})

    paths, bodies, size = [], [], 0
    for batch in batches:
        for path in batch["path"].to_pylist():
            with open_file(path) as f:
                body = f.read()
            if bodies and size + len(body) > DOCUMENT_BATCH:
                yield packed(paths, bodies)
                paths, bodies, size = [], [], 0
            paths.append(path)
            bodies.append(body)
            size += len(body)
    if bodies:
        yield packed(paths, bodies)


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """``(unit_id, path, text)``: whole texts, undecodable bytes replaced; an empty file is an empty text.

    A corpus is very many small files: tasks list them and each task opens its share. Names that begin with a dot or
    an underscore are no documents. Places that tasks cannot open by themselves are read through Spark's file index,
    which leaves out empty files.
    """
    pattern = rf"/{DIR}/(?:[^/=]+=)?text/(.+)$"
    wanted = F.col("path").rlike(pattern) & ~F.col("path").endswith("/corpus_index.json")
    if is_known(root):
        hidden = F.exists(F.split(F.substring("path", len(root.rstrip("/")) + 2, 1 << 20), "/"), lambda x: x.startswith(".") | (x.startswith("_") & ~x.contains("=")))
        listed = list_tree(spark, root).where((F.col("kind") == FILE) & wanted & ~hidden).select("path", "length")
        files = dealt(listed).mapInArrow(_bodies, "path string, content binary")
    else:
        files = _binary(spark, root, "*").where(wanted)
    return files.select(
        _part("path", pattern).alias("unit_id"), _part("path", pattern, 2).alias("path"), _text().alias("text")
    )


# ---- submissions -----------------------------------------------------------------------------

def _below(path: str, root: str) -> Column:
    """The parts of a path below ``root``, without ``column=`` prefixes."""
    parts = F.split(F.substring(path, len(root.rstrip("/")) + 2, 1 << 20), "/")
    return F.transform(parts, lambda x: F.regexp_replace(x, "^[^/=]+=", ""))


def list_submission_files(spark: SparkSession, root: str) -> DataFrame:
    """``(submission_id, unit_id, name, length, kind, path)`` of every entry of a unit's directory as it is: empty files,
    hidden names, folders and special nodes too."""
    below = list_tree(spark, root, 3).where("depth = 3").withColumn("_b", _below("path", root))
    return below.select(F.col("_b")[0].alias("submission_id"), F.col("_b")[1].alias("unit_id"), "name", "length", "kind", "path")


def _submitted(spark: SparkSession, root: str, name: str, ceiling: int, files: DataFrame | None = None) -> DataFrame:
    """Files of one name (or pattern with ``*``) under their ceiling; what is larger is refused from its listed size."""
    files = list_submission_files(spark, root) if files is None else files
    named = F.col("name").rlike("^" + re.escape(name).replace("\\*", ".*") + "$")
    return files.where(named & (F.col("kind") == FILE) & (F.col("length") <= ceiling)).select(*UNIT_KEYS, "path", "length")


def _contents(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for i, path in enumerate(batch["path"].to_pylist()):
            with open_file(path) as f:
                body = f.read()
            row = batch.slice(i, 1)
            yield pa.RecordBatch.from_pydict({**{k: row[k] for k in UNIT_KEYS}, "content": pa.array([body], pa.binary())})


def _read_small(files: DataFrame) -> DataFrame:
    """``(U, content)`` of files that a ceiling bounds; an empty file has empty content."""
    return dealt(files).mapInArrow(_contents, "submission_id string, unit_id string, content binary")


FACTS_SCHEMA = (
    "submission_id string, unit_id string, path string, draws_bytes bigint, columns array<string>, n_columns int, "
    "n_distinct_columns int, n_rows bigint, row_groups int, uncompressed_bytes bigint, readable boolean"
)


def _footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Footers only: a file is opened in the task and its end is read."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            base = [row.submission_id, row.unit_id, row.path, row.length]
            try:
                with open_file(row.path) as source:
                    file = pq.ParquetFile(source)
                    meta, names = file.metadata, list(file.schema_arrow.names)
                size = sum(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups))
                out.append([*base, names, len(names), len(set(names)), meta.num_rows, meta.num_row_groups, size, True])
            except (pa.ArrowException, OSError, ValueError):
                out.append([*base, None, None, None, None, None, None, False])
        names = [field.split()[0] for field in FACTS_SCHEMA.split(", ")]
        yield pd.DataFrame({n: pd.Series([r[i] for r in out], dtype=object) for i, n in enumerate(names)})


def inspect_draw_files(spark: SparkSession, root: str, name: str = "forecast.parquet", files: DataFrame | None = None) -> DataFrame:
    """What each draws file says about itself, before any row is decoded; ``files`` is the listing, where it is at hand."""
    return dealt(_submitted(spark, root, name, C.MAX_DRAWS_FILE_BYTES, files)).mapInPandas(_footers, FACTS_SCHEMA)


DECODED = "submission_id string, unit_id string, draw long, asset string, horizon long, value double, broken boolean"


def _decode_draws(batches: Iterator) -> Iterator:
    """Rows of untrusted files: a column of the wrong type becomes nulls, a file that breaks off becomes one broken row.

    Draw ids are integers only; horizons may be any number (cut to whole ones) or the text of an integer; values may be
    any number, and NaN stays NaN.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    def whole(col: pa.Array) -> pa.Array:
        if pa.types.is_integer(col.type):
            return pc.cast(col, pa.int64(), safe=False)
        return pa.nulls(len(col), pa.int64())

    def horizon(col: pa.Array) -> pa.Array:
        if pa.types.is_floating(col.type):
            fine = pc.and_(pc.is_finite(col), pc.less(pc.abs(pc.cast(col, pa.float64())), 1e15))
            return pc.cast(pc.if_else(fine, pc.cast(col, pa.float64()), None), pa.int64(), safe=False)
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
            text = pc.utf8_trim_whitespace(pc.cast(col, pa.string()))
            return pc.cast(pc.if_else(pc.match_substring_regex(text, "^[+-]?[0-9]{1,15}$"), text, None), pa.int64())
        return whole(col)

    def number(col: pa.Array) -> pa.Array:
        if pa.types.is_floating(col.type) or pa.types.is_integer(col.type):
            return pc.cast(col, pa.float64(), safe=False)
        return pa.nulls(len(col), pa.float64())

    def label(col: pa.Array) -> pa.Array:
        try:
            return pc.cast(col, pa.string())
        except pa.ArrowException:
            return pa.nulls(len(col), pa.string())

    def frame(keys: tuple, columns: dict, n: int, broken: bool) -> pa.RecordBatch:
        same = {k: pa.array([v] * n, pa.string()) for k, v in zip(UNIT_KEYS, keys)}
        return pa.RecordBatch.from_pydict({**same, **columns, "broken": pa.array([broken] * n, pa.bool_())})

    for batch in batches:
        for sub, unit, path in zip(*(batch[c].to_pylist() for c in (*UNIT_KEYS, "path"))):
            try:
                with open_file(path) as source:
                    for part in pq.ParquetFile(source).iter_batches(columns=list(DRAW_COLUMNS)):
                        columns = {"draw": whole(part["draw"]), "asset": label(part["asset"]), "horizon": horizon(part["horizon"]), "value": number(part["value"])}
                        yield frame((sub, unit), columns, part.num_rows, False)
            except (pa.ArrowException, OSError, ValueError, KeyError):
                empty = {"draw": pa.nulls(1, pa.int64()), "asset": pa.nulls(1, pa.string()), "horizon": pa.nulls(1, pa.int64()), "value": pa.nulls(1, pa.float64())}
                yield frame((sub, unit), empty, 1, True)


def decode_draws(facts: DataFrame) -> DataFrame:
    """The draws schema and ``broken``: files whose footer is inside all ceilings and names exactly the four columns.

    ``facts`` is the result of :func:`inspect_draw_files`; each file is opened once more and read batch by batch. Ids and
    horizons beyond 32 bits become nulls, which no grid has.
    """
    want = F.array(*[F.lit(c) for c in sorted(DRAW_COLUMNS)])
    exact = facts.where(
        F.col("readable") & (F.sort_array("columns") == want) & (F.col("n_rows") <= C.MAX_ROWS) & (F.col("row_groups") <= C.MAX_ROW_GROUPS)
        & (F.col("uncompressed_bytes") <= C.MAX_UNCOMPRESSED_BYTES)
    )
    rows = dealt(exact.select(*UNIT_KEYS, "path", F.col("draws_bytes").alias("length"))).mapInArrow(_decode_draws, DECODED)
    return rows.select(*UNIT_KEYS, F.expr("try_cast(draw AS INT)").alias("draw"), "asset", F.expr("try_cast(horizon AS INT)").alias("horizon"), "value", "broken")


def read_draws(spark: SparkSession, root: str, facts: DataFrame | None = None,
               name: str = "forecast.parquet") -> DataFrame:
    """Draw rows of every submission whose file has exactly the four columns.

    Pass ``facts`` from :func:`inspect_draw_files` where they are at hand. A scoring run decodes once and
    keeps what :func:`decode_draws` returns.
    """
    facts = facts if facts is not None else inspect_draw_files(spark, root, name)
    return decode_draws(facts).where(~F.col("broken")).drop("broken")


def read_draws_table(spark: SparkSession, path: str) -> DataFrame:
    """The partitioned table written by ``write_draws``: a native scan, pruned by unit."""
    return spark.read.schema(C.DRAWS_SCHEMA).parquet(path).select(*C.DRAWS_SCHEMA.fieldNames())


def parse_meta(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(U, text)`` of sidecars to typed rows, and coded refusals for unusable ones.

    Unparseable or undecodable text is ``malformed_output``; a document that is no object is
    ``schema_invalid``. ``n_draws_type`` keeps the JSON type of the declared count.
    """
    v = F.when(F.is_valid_utf8("text"), F.try_parse_json("text"))
    rows = texts.withColumn("v", v).withColumn("_kind", F.schema_of_variant("v"))
    bad = F.col("v").isNull() | ~F.col("_kind").startswith("OBJECT")
    code = F.when(F.col("v").isNull(), "malformed_output").otherwise("schema_invalid")
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    raw_type = F.schema_of_variant(get("n_draws", "variant"))
    typed = rows.where(~bad).select(
        *UNIT_KEYS, get("unit_id", "string").alias("declared_unit"), get("asof", "string").alias("asof"),
        get("representation", "string").alias("representation"),
        get("asset_ids", "array<string>").alias("asset_ids"), get("horizons", "array<int>").alias("horizons"),
        get("n_draws", "int").alias("n_draws"),
        F.when(raw_type == "BIGINT", "integer").otherwise(F.lower(F.coalesce(raw_type, F.lit("absent")))).alias("n_draws_type"),
        get("target", "string").alias("target"),
    )
    return typed, refusal(rows, bad, GATES[0], CHECK["meta_errors"], code)


def read_meta(spark: SparkSession, root: str, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sidecars of a tree; an empty one is text that does not parse."""
    found = _read_small(_submitted(spark, root, "forecast_meta.json", C.MAX_META_BYTES, files))
    return parse_meta(found.select(*UNIT_KEYS, F.col("content").cast("string").alias("text")))


def read_rationales(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    found = _read_small(_submitted(spark, root, "forecast_rationale.md", C.MAX_RATIONALE_BYTES, files))
    return found.select(*UNIT_KEYS, _text().alias("text"))


# ---- reference material ----------------------------------------------------------------------

def read_realized(spark: SparkSession, root: str, pattern: str = "*/reference/realized.parquet") -> DataFrame:
    """Outcomes: three columns only, so the sealed date is never even scanned."""
    schema = "asset string, horizon bigint, value double"
    return (
        spark.read.schema(schema).parquet(f"{root}/{pattern}")
        .select(
            _part("_metadata.file_path", rf"/{DIR}/(?:reference/)?[^/]+\.parquet$").alias("unit_id"),
            "asset", F.col("horizon").cast("int").alias("horizon"), "value",
        )
    )


def parse_ref_scale(texts: DataFrame) -> DataFrame:
    """``(unit_id, cell_count, text)`` of scale files to ``(marginal, joint, tail, fault)``.

    The key set is closed; every component the grid has must be a positive finite number. On one
    cell the joint scale may be absent, null or 0 and is then null.
    """
    allowed = F.array(*[F.lit(k) for k in (*C.SCALE_KEYS, *C.SCALE_PROVENANCE_KEYS)])
    v = F.try_parse_json("text")
    unknown = F.array_except(F.json_object_keys("text"), allowed)
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")), F.lit("VOID"))
    num = lambda k: F.try_variant_get("v", f"$.{k}", "double")
    numeric = lambda k: kind(k).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    single = F.col("cell_count") == 1
    joint_absent = single & ((kind("joint") == "VOID") | (numeric("joint") & (num("joint") == 0.0)))
    needed = [("marginal", F.lit(True)), ("tail", F.lit(True)), ("joint", ~joint_absent)]
    missing = [F.when(live & (kind(k) == "VOID"), F.lit(f"missing {k}")) for k, live in needed]
    wrong = [F.when(live & ~numeric(k), F.lit(f"{k} is not a number")) for k, live in needed]
    sign = [F.when(live & (~is_finite(num(k)) | (num(k) <= 0.0)), F.lit(f"{k} is not positive")) for k, live in needed]
    rows = texts.withColumn("v", v)
    fault = F.coalesce(
        F.when(F.col("v").isNull() | ~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), F.lit("unreadable")),
        F.when(F.size(unknown) > 0, F.lit("unknown key")), *missing, *wrong, *sign,
    )
    return rows.select(
        "unit_id", fault.alias("fault"), num("marginal").alias("marginal"),
        F.when(~joint_absent, num("joint")).alias("joint"), num("tail").alias("tail"),
    )


def read_ref_scale(spark: SparkSession, root: str, units: DataFrame) -> DataFrame:
    files = _binary(spark, root, "ref_scale.json").select(
        _part("path", r"/([^/]+)/reference/ref_scale\.json$").alias("unit_id"), _text().alias("text")
    )
    cells = units.select("unit_id", (F.size("asset_ids") * F.size("horizons")).alias("cell_count"))
    return parse_ref_scale(cells.join(files, "unit_id", "left"))


ROSTER_SCHEMA = (
    "metric struct<direction:string,domain:struct<min:double,max:double>>, "
    "roster struct<count:int,expected_units:array<struct<unit_handle:string,"
    "grid:struct<assets:array<string>,horizons:array<int>,cell_count:int,digest:string>>>>, "
    "participant_failure struct<policy:string,score:double,clip_real_scores_to_domain:boolean>, "
    "normalization struct<mode:string>"
)


def parse_roster(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(text)`` of evaluation plans to roster rows with ordered grids, and the policy row."""
    p = texts.select(F.from_json("text", ROSTER_SCHEMA).alias("p"))
    units = p.select(F.posexplode("p.roster.expected_units").alias("pos", "u")).select(
        "pos", F.col("u.unit_handle").alias("unit_id"), F.col("u.grid.assets").alias("asset_ids"),
        F.col("u.grid.horizons").alias("horizons"), F.col("u.grid.cell_count").alias("cell_count"),
        (F.col("u.grid.cell_count") == F.size("u.grid.assets") * F.size("u.grid.horizons")).alias("grid_ok"),
    )
    policy = p.select(
        F.col("p.roster.count").alias("roster_count"), F.col("p.metric.direction").alias("direction"),
        F.col("p.metric.domain.min").alias("domain_min"), F.col("p.metric.domain.max").alias("domain_max"),
        F.col("p.participant_failure.score").alias("failure_score"),
        F.col("p.participant_failure.clip_real_scores_to_domain").alias("clip"),
        F.col("p.normalization.mode").alias("normalization_mode"),
    )
    return units, policy


def read_roster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_roster(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")))


def resolve_grid(units: DataFrame, roster: DataFrame) -> DataFrame:
    """The roster's grid for a committed unit, else the card's; both stamped with their source."""
    r = roster.select(
        "unit_id", F.col("asset_ids").alias("_a"), F.col("horizons").alias("_h"), F.lit(True).alias("_r")
    )
    committed = F.col("_r").isNotNull()
    return units.join(r, "unit_id", "left").select(
        *[c for c in units.columns if c not in ("asset_ids", "horizons")],
        F.when(committed, F.col("_a")).otherwise(F.col("asset_ids")).alias("asset_ids"),
        F.when(committed, F.col("_h")).otherwise(F.col("horizons")).alias("horizons"),
        F.when(committed, "plan").otherwise("card").alias("grid_source"),
        F.when(committed, "ref_scale").otherwise("raw_unrankable").alias("normalization_mode"),
    )
