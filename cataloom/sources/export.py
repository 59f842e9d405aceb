"""Export of nested rows as a unit: parents and the tables of their children become visible together or not at all.

``spark.dataSource.register(Export)`` once, then write with ``format("catalogue_export")``, in batch or as a stream. Tasks
write Parquet files that nobody sees; the commit writes one manifest that names them all, in one move. A failed write leaves
files without a manifest, which ``vacuum`` deletes. A batch that runs again replaces its manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

PARENTS = "parents"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: files by table."""

    files: dict[str, list[str]]


class _Writes:
    """Options: ``path``, ``key`` (the parents' column), ``children`` (names of array columns, by comma) and, in batch,
    ``batch`` (its number)."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.key = options["path"], options["key"]
        self.children = [c for c in options.get("children", "").split(",") if c]
        self.batch = int(options.get("batch", "0"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _open(self.path)
        writers: dict[str, tuple[str, pq.ParquetWriter]] = {}

        def put(table: str, rows: pa.Table) -> None:
            if table not in writers:
                name = f"data/{table}-{uuid.uuid4().hex}.parquet"
                files.create_dir(f"{root}/data", recursive=True)
                writers[table] = (name, pq.ParquetWriter(f"{root}/{name}", rows.schema, filesystem=files))
            writers[table][1].write_table(rows)

        try:
            for batch in iterator:
                rows = pa.Table.from_batches([batch])
                put(PARENTS, rows.drop_columns(self.children))
                for child in self.children:
                    lists = rows[child].combine_chunks()
                    parent = pc.list_parent_indices(lists)
                    starts = lists.offsets.to_numpy()
                    place = pa.array(range(len(parent)), pa.int64())
                    place = pc.subtract(place, pa.array(starts[:-1] - starts[0], pa.int64()).take(parent)) if len(parent) else place
                    put(child, pa.table({self.key: rows[self.key].combine_chunks().take(parent), "place": place.cast(pa.int32()), child: lists.flatten()}))
        finally:
            for _, writer in writers.values():
                writer.close()
        return Written({table: [name] for table, (name, _) in writers.items()})

    def publish(self, messages: list[Written | None], batch: int) -> None:
        files, root = _open(self.path)
        listed: dict[str, list[str]] = {t: [] for t in (PARENTS, *self.children)}
        for message in messages:
            for table, names in (message.files if message else {}).items():
                listed[table] += names
        files.create_dir(f"{root}/manifests", recursive=True)
        temporary, final = f"{root}/manifests/.{uuid.uuid4().hex}", f"{root}/manifests/{batch:012d}.json"
        with files.open_output_stream(temporary) as out:
            out.write(json.dumps({"batch": batch, "files": listed}).encode())
        if files.get_file_info(final).type != fs.FileType.NotFound and not isinstance(files, fs.LocalFileSystem):
            files.delete_file(final)
        files.move(temporary, final)

    def discard(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        for message in messages:
            for name in (n for names in (message.files.values() if message else []) for n in names):
                files.delete_file(f"{root}/{name}")


class BatchWriter(_Writes, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.publish(messages, self.batch)

    def abort(self, messages: list[Written | None]) -> None:
        self.discard(messages)


class StreamWriter(_Writes, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.publish(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.discard(messages)


class Export(DataSource):
    """The data source ``catalogue_export``."""

    @classmethod
    def name(cls) -> str:
        return "catalogue_export"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return BatchWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return StreamWriter(self.options)


def manifests(path: str) -> list[dict]:
    """What is published, by batch."""
    files, root = _open(path)
    names = sorted(f.path for f in files.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True)) if f.base_name.endswith(".json") and not f.base_name.startswith("."))
    return [json.loads(files.open_input_stream(name).read()) for name in names]


def read_export(spark: SparkSession, path: str, key: str, table: str = PARENTS, update: bool = True) -> DataFrame | None:
    """A table of the export. Of a parent exported several times the last batch is taken with its children, or with
    ``update`` off the first; children of other batches are out of sight. None if nothing is published."""
    published = manifests(path)

    def rows_of(name: str) -> DataFrame | None:
        found = None
        for manifest in published:
            if manifest["files"].get(name):
                some = spark.read.parquet(*[f"{path}/{f}" for f in manifest["files"][name]]).withColumn("batch", F.lit(manifest["batch"]))
                found = some if found is None else found.unionByName(some)
        return found

    parents = rows_of(PARENTS)
    if parents is None:
        return None
    order = F.desc("batch") if update else F.asc("batch")
    chosen = parents.withColumn("__place", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__place = 1").drop("__place")
    if table == PARENTS:
        return chosen.drop("batch")
    children = rows_of(table)
    return None if children is None else children.join(chosen.select(key, "batch"), [key, "batch"], "left_semi").drop("batch")


def vacuum(path: str) -> int:
    """Delete the data files that no manifest names; only while nothing is being written. Returns how many there were."""
    files, root = _open(path)
    named = {name for manifest in manifests(path) for names in manifest["files"].values() for name in names}
    gone = [f.path for f in files.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)) if f"data/{f.base_name}" not in named]
    for name in gone:
        files.delete_file(name)
    return len(gone)
