"""An append-only event log of JSON lines as a Spark data source, in batch and as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

from panelframe.sources.files import opened

# What an event says.
TEXTS, NUMBERS = ["step", "event_type", "message", "severity", "file"], ["t", "duration_s"]
SCHEMA = "t double, step string, event_type string, message string, severity string, duration_s double, file string, path string, at long, broken string"
SPLIT = 32 << 20
PIECE = 1 << 20
_ARROW = pa.schema([("t", pa.float64()), ("step", pa.string()), ("event_type", pa.string()), ("message", pa.string()), ("severity", pa.string()), ("duration_s", pa.float64()), ("file", pa.string()), ("path", pa.string()), ("at", pa.int64()), ("broken", pa.string())])


class Stretch(InputPartition):
    """The lines that begin in bytes start to end of a file."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _sizes(uri: str) -> dict[str, int]:
    """The log's files, by name, with their bytes."""
    fs, path = opened(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return {path: info.size}
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))}


def _stretches(sizes: dict[str, int], since: dict[str, int], split: int) -> list[Stretch]:
    return [Stretch(p, a, min(a + split, n)) for p, n in sizes.items() for a in range(since.get(p, 0), n, split)]


def _lines(fs: pafs.FileSystem, part: Stretch) -> Iterator[tuple[int, bytes]]:
    """(place, line) of every line that begins in the stretch; the one that a stretch before it began is that one's."""
    with fs.open_input_file(part.path) as f:
        at = part.start
        if at:
            f.seek(at - 1)
            before = f.read(1)
        else:
            f.seek(0)
            before = b"\n"
        inside, held = before == b"\n", b""
        while True:
            data = f.read(PIECE)
            if not data:
                break
            lines = (held + data).split(b"\n")
            held = lines.pop()
            for line in lines:
                if inside:
                    if at >= part.end:
                        return
                    yield at, line
                inside = True
                at += len(line) + 1
            if at >= part.end:
                return
        if held and inside and at < part.end:
            yield at, held


def _rows(uri: str, part: Stretch, wanted: dict[str, str]) -> Iterator[pa.RecordBatch]:
    fs, _ = opened(uri)
    columns = {n: [] for n in _ARROW.names}

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _ARROW], schema=_ARROW)
        for c in columns.values():
            c.clear()
        return made

    for at, raw in _lines(fs, part):
        text = raw.decode("utf-8", "replace").strip()
        if not text:
            continue
        try:
            event = json.loads(text)
        except (ValueError, RecursionError):
            event = None
        good = isinstance(event, dict)
        event = event if good else {}
        if any(event.get(k) != v for k, v in wanted.items()):
            continue
        for n in TEXTS:
            v = event.get(n)
            columns[n].append(v if v is None or isinstance(v, str) else json.dumps(v))
        for n in NUMBERS:
            v = event.get(n)
            columns[n].append(float(v) if isinstance(v, int | float) and not isinstance(v, bool) else None)
        for n, v in (("path", part.path), ("at", at), ("broken", None if good else text)):
            columns[n].append(v)
        if len(columns["at"]) >= 5000:
            yield out()
    if columns["at"]:
        yield out()


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.wanted, self.never = options, {k: options[k] for k in ("step", "severity") if k in options}, False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in ("step", "severity") and isinstance(f.value, str):
                # Two values of one field: no event has both.
                self.never |= self.wanted.setdefault(f.attribute[0], f.value) != f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        parts = [] if self.never else _stretches(_sizes(self.options["path"]), {}, int(self.options.get("splitbytes", SPLIT)))
        return parts or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return _rows(self.options["path"], partition, self.wanted) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    """An offset is the bytes of each file that are read; only whole lines are, so that a line still being written waits."""

    def __init__(self, options: dict):
        self.options, self.wanted = options, {k: options[k] for k in ("step", "severity") if k in options}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, _ = opened(self.options["path"])
        out = {}
        for path, size in _sizes(self.options["path"]).items():
            with fs.open_input_file(path) as f:
                end = size
                while end:
                    a = max(0, end - PIECE)
                    f.seek(a)
                    k = f.read(end - a).rfind(b"\n")
                    end = a + k + 1 if k >= 0 else a
                    if k >= 0:
                        break
            out[path] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _stretches(end, start, int(self.options.get("splitbytes", SPLIT))) or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return _rows(self.options["path"], partition, self.wanted) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        pass


class EventLog(DataSource):
    """Options: path (a file or folder), step and severity (only such events), splitBytes.

    Every line is an event, cut by byte ranges whatever its place; one that is no JSON object is a row with its text in
    `broken` and null elsewhere, unless a step or severity is asked for.  Other fields are left out; an empty line is none.
    """

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    """spark.read.format("event_log") and readStream; equal steps and severities of a where clause go to the readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EventLog)
