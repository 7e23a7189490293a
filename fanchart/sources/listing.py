"""Directory trees listed by tasks, as they are.

Spark's file index leaves out empty files and names that begin with a dot or an underscore, which is right for tables
and wrong for a perimeter: a submission must hold three files and nothing else. Here each level of a tree is one job
whose tasks list folders; what they find is written, and its folders are the next level's work. No listing passes
through the driver, and a task that is lost lists its folders again.

Tasks use Arrow's file systems (local paths, ``file``, ``hdfs``, ``s3``, ``gs``, ``abfs``); other schemes are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanchart.sources.materialize import materialized

ENTRY_SCHEMA = "path string, parent string, name string, length long, kind string, depth int"
FILE, FOLDER, OTHER = "file", "folder", "other"


def open_system(uri: str):
    """(file system, path in it) of a path or a URI."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def is_known(uri: str) -> bool:
    """Whether tasks can open this place by themselves."""
    scheme = uri.split(":", 1)[0] if "://" in uri or uri.startswith("file:") else "file"
    return scheme in ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def open_file(path: str):
    """A file for reading at any place; what is not read does not travel."""
    system, inner = open_system(path)
    return system.open_input_file(inner)


def dealt(files: DataFrame, share: int = 128 << 20) -> DataFrame:
    """Files (path, length) over as many tasks as their bytes need, and at least the session's parallelism."""
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // share))
    return files.repartition(max(1, min(n, tasks)), "path")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    kinds = {fs.FileType.File: FILE, fs.FileType.Directory: FOLDER}
    for batch in batches:
        for folder, depth in zip(batch["path"].to_pylist(), batch["depth"].to_pylist()):
            system, inner = open_system(folder)
            found = system.get_file_info(fs.FileSelector(inner, recursive=False, allow_not_found=depth == 0))
            names = {e.base_name for e in found}
            # checksums that a local file system keeps beside a file are no entries of their own
            found = [e for e in found if not (e.base_name.startswith(".") and e.base_name.endswith(".crc") and e.base_name[1:-4] in names)]
            for i in range(0, len(found), 5000):
                part = found[i : i + 5000]
                yield pa.RecordBatch.from_pydict({
                    "path": [f"{folder.rstrip('/')}/{e.base_name}" for e in part], "parent": pa.array([folder] * len(part), pa.string()), "name": [e.base_name for e in part],
                    "length": pa.array([e.size if e.type == fs.FileType.File else None for e in part], pa.int64()),
                    "kind": pa.array([kinds.get(e.type, OTHER) for e in part], pa.string()), "depth": pa.array([depth + 1] * len(part), pa.int32()),
                })


def list_tree(spark: SparkSession, root: str, depth: int | None = None) -> DataFrame:
    """Every entry below ``root``: path, parent, name, length (files), kind (file, folder or other), depth from 1.

    ``depth`` ends the walk at that level; its folders are listed as entries only. An absent root has no entries.
    """
    folders = spark.createDataFrame([(root.rstrip("/") or "/", 0)], "path string, depth int")
    levels: list[DataFrame] = []
    while True:
        level = materialized(folders.mapInArrow(_entries, ENTRY_SCHEMA), "listing")
        levels.append(level)
        deeper = level.where(F.col("kind") == FOLDER).select("path", "depth")
        if len(levels) == depth or deeper.isEmpty():
            break
        folders = deeper.repartition("path")
    out, *more = levels
    for level in more:
        out = out.unionByName(level)
    return out
