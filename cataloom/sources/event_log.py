"""The event log as a streaming source of its own: it starts at any cursor, limits a batch and filters topics.

``spark.dataSource.register(EventLog)`` once, then ``spark.readStream.format("event_log").options(...)``. The log is a folder
of Parquet files; an offset is an event's number. Files whose numbers lie outside a batch aren't read, of the others the row
groups that hold it are, by as many tasks as asked for. A replay is a new checkpoint and a cursor.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: Where a reader starts that names no cursor: before the first event.
FIRST = -1


class Log:
    """The files of a log with the numbers they hold."""

    def __init__(self, path: str, sequence: str) -> None:
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.sequence = sequence
        self.spans: dict[str, tuple[int, int]] = {}

    def listed(self) -> list[tuple[int, int, str]]:
        """(least, greatest, file) of all files with events, by least number. Footers are read once for each file."""
        names = [f.path for f in self.files.get_file_info(fs.FileSelector(self.root, recursive=True)) if f.path.endswith(".parquet") and "/_" not in f.path.removeprefix(self.root)]
        for name in names:
            if name not in self.spans:
                found = [s for fragment in ds.dataset(name, filesystem=self.files, format="parquet").get_fragments() for g in fragment.row_groups if (s := (g.statistics or {}).get(self.sequence))]
                self.spans[name] = (min((s["min"] for s in found), default=0), max((s["max"] for s in found), default=FIRST))
        return sorted((*self.spans[n], n) for n in names if self.spans[n][1] > FIRST)

    def condition(self, after: int, until: int | None, topic: str, topics: list[str]) -> ds.Expression:
        out = ds.field(self.sequence) > after
        if until is not None:
            out &= ds.field(self.sequence) <= until
        return out & ds.field(topic).isin(topics) if topics else out

    def end_after(self, cursor: int, limit: int | None, topic: str, topics: list[str]) -> int:
        """The number up to which the next ``limit`` events of the topics reach; that of the last event if there are fewer.
        Files are read in order of their numbers, and no further than needed."""
        spans = [s for s in self.listed() if s[1] > cursor]
        if not spans:
            return cursor
        if limit is None:
            return max(s[1] for s in spans)
        best = np.zeros(0, np.int64)
        for least, _, name in spans:
            if len(best) >= limit and best[limit - 1] < least:
                break
            table = ds.dataset(name, filesystem=self.files, format="parquet").to_table(columns=[self.sequence], filter=self.condition(cursor, None, topic, topics))
            best = np.sort(np.concatenate([best, table[self.sequence].to_numpy().astype(np.int64)]))[:limit]
        return int(best[limit - 1]) if len(best) >= limit else max(s[1] for s in spans)


@dataclass
class Span(InputPartition):
    """A task's share of a batch: events with a number above ``after`` up to ``until``."""

    after: int
    until: int


class Options:
    """What a reader is told: ``path``; ``cursor`` (start behind it, by default before the first event); ``limit`` (events of
    a batch at most); ``topics`` (by comma, by default all); ``sequence`` and ``topic`` (column names); ``tasks`` (of a batch);
    ``checkpoint`` (the query's, needed with a limit: it tells a restarted query how far it had planned)."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.cursor = int(options.get("cursor", FIRST))
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.topics = [t for t in options.get("topics", "").split(",") if t]
        self.sequence, self.topic = options.get("sequence", "id"), options.get("topic", "topic")
        self.tasks = int(options.get("tasks", "8"))
        self.checkpoint = options.get("checkpoint")
        if self.limit is not None and (self.limit < 1 or not self.checkpoint):
            raise ValueError("a limit is a positive number, and needs the query's checkpoint")


class EventLog(DataSource):
    """The data source ``event_log``; see ``Options``."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> StructType:
        told = Options(self.options)
        log = Log(told.path, told.sequence)
        name = next(iter(log.listed()))[2]
        return from_arrow_schema(ds.dataset(name, filesystem=log.files, format="parquet").schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(Options(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return LogStreamReader(Options(self.options), schema)


class _Reads:
    """Reading a span of numbers, for batch and stream alike."""

    def __init__(self, told: Options, schema: StructType) -> None:
        self.told, self.columns = told, schema.fieldNames()

    def spans(self, after: int, until: int) -> list[Span]:
        if until <= after:
            return []
        edges = np.unique(np.linspace(after, until, self.told.tasks + 1).astype(np.int64))
        return [Span(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to say that there are no spans
            return
        log = Log(self.told.path, self.told.sequence)
        names = [name for least, greatest, name in log.listed() if greatest > partition.after and least <= partition.until]
        if names:
            rows = ds.dataset(names, filesystem=log.files, format="parquet")
            for batch in rows.to_batches(columns=self.columns, filter=log.condition(partition.after, partition.until, self.told.topic, self.told.topics)):
                if batch.num_rows:
                    yield batch.cast(pa.schema([f.with_type(pa.string()) if pa.types.is_large_string(f.type) else f for f in batch.schema]))


class LogReader(_Reads, DataSourceReader):
    """All events behind the cursor, or the next ``limit`` of them."""

    def partitions(self) -> list[Span]:
        log = Log(self.told.path, self.told.sequence)
        return self.spans(self.told.cursor, log.end_after(self.told.cursor, self.told.limit, self.told.topic, self.told.topics))


class LogStreamReader(_Reads, DataSourceStreamReader):
    """Batches of events by their numbers. With ``availableNow`` a run takes one batch."""

    def __init__(self, told: Options, schema: StructType) -> None:
        super().__init__(told, schema)
        self.log = Log(told.path, told.sequence)
        self.planned: int | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": self.told.cursor}

    def _start(self) -> int:
        """How far batches are planned: by this reader, or by the query's log of offsets."""
        if self.planned is None:
            self.planned = self.told.cursor
            if self.told.checkpoint:
                path = self.told.checkpoint
                files, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
                infos = files.get_file_info(fs.FileSelector(f"{root}/offsets", allow_not_found=True))
                last = max((f.base_name for f in infos if f.base_name.isdigit()), key=int, default=None)
                if last is not None:
                    with files.open_input_stream(f"{root}/offsets/{last}") as file:
                        self.planned = json.loads(file.read().decode().strip().splitlines()[-1])["after"]
        return self.planned

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": self.log.end_after(self._start(), self.told.limit, self.told.topic, self.told.topics)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.planned = max(end["after"], self._start())
        return self.spans(start["after"], end["after"])

    def commit(self, end: dict) -> None:
        pass
