"""Scripts: a sink that writes each chapter's text and its index, together or not at all, and a source that reads them."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from panelframe.sources.files import opened
from panelframe.sources.files import read as content

# Characters of a batch of rows on their way from a task's Python, unless one script alone is longer.
BATCH = 1 << 22


@dataclass
class Written(WriterCommitMessage):
    """What one task has staged: a folder of its own, None if it had no chapter."""

    folder: str | None
    chapters: int


class _Scripts(DataSourceWriter):
    """Tasks write both files of their chapters into a staging folder; the job's commit gives each such folder its own name,
    a task's chapters all at once, and leaves a list of them last.  Without that list nothing counts as written."""

    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def _staging(self) -> tuple[pafs.FileSystem, str, str]:
        fs, base = opened(self.uri)
        return fs, base.rstrip("/"), f"{base.rstrip('/')}/_staging-{self.job}"

    def write(self, rows: Iterator) -> Written:
        fs, _, staging = self._staging()
        folder, count = f"{staging}/part-{uuid.uuid4().hex}", 0
        for row in rows:
            name = re.sub(r"[^\w.-]", lambda m: f"%{ord(m.group()):x}", str(row["chapter"]))
            fs.create_dir(f"{folder}/chapter={name}", recursive=True)
            for end, data in (("txt", row["script"] or ""), ("index.json", json.dumps({"chapter": row["chapter"], "lines": json.loads(row["lines"] or "[]")}, ensure_ascii=False))):
                with fs.open_output_stream(f"{folder}/chapter={name}/script.{end}") as f:
                    f.write(data.encode())
            count += 1
        return Written(folder if count else None, count)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base, staging = self._staging()
        old = [f for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.base_name.startswith("part-")] if self.overwrite else []
        for m in messages:
            if m is not None and m.folder:
                fs.move(m.folder, f"{base}/{m.folder.rpartition('/')[2]}")
        with fs.open_output_stream(f"{base}/_written-{self.job}.json") as f:
            f.write(json.dumps({"parts": [m.folder.rpartition("/")[2] for m in messages if m and m.folder], "chapters": sum(m.chapters for m in messages if m)}).encode())
        for f in old:
            fs.delete_dir(f.path)
        self._clear(fs, staging)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _, staging = self._staging()
        self._clear(fs, staging)

    @staticmethod
    def _clear(fs: pafs.FileSystem, staging: str) -> None:
        if fs.get_file_info(staging).type == pafs.FileType.Directory:
            fs.delete_dir(staging)


class _Folders(DataSourceReader):
    """A task for each folder that a task has written: the driver lists these folders alone, never the chapters within."""

    def __init__(self, options: dict):
        self.uri = options["path"]

    def partitions(self) -> list[InputPartition]:
        fs, base = opened(self.uri)
        found = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(base)) if f.base_name.startswith("part-"))
        return [InputPartition(name) for name in found or [None]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        fs, base = opened(self.uri)
        rows, held = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["chapter", "script", "lines"])
        for folder in fs.get_file_info(pafs.FileSelector(f"{base.rstrip('/')}/{partition.value}")):
            index = content(fs, f"{folder.path}/script.index.json")
            if index is None:
                continue
            index, script = json.loads(index), (content(fs, f"{folder.path}/script.txt") or b"").decode()
            rows.append((index["chapter"], script, json.dumps(index["lines"], ensure_ascii=False, separators=(",", ":"))))
            held += len(script) + len(rows[-1][2])
            if held >= BATCH:
                yield out()
                rows, held = [], 0
        if rows:
            yield out()


class Scripts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scripts"

    def schema(self) -> str:
        return "chapter string, script string, lines string"

    def reader(self, schema) -> DataSourceReader:
        return _Folders(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Scripts(dict(self.options), overwrite)


def scripts(lines: DataFrame, chapter: str = "chapter", order: str = "idx", panel: str = "id", text: str = "text") -> DataFrame:
    """(chapter, script, lines): the texts of each chapter in order, a line each, empty ones left out, and what panel each line is of, as JSON."""
    said = F.btrim(F.coalesce(F.col(text), F.lit("")))
    rows = lines.where(F.col(chapter).isNotNull()).select(F.col(chapter).cast("string").alias("chapter"), F.struct(F.col(order).alias("k"), F.col(panel).cast("string").alias("panel"), said.alias("text")).alias("l"))
    listed = rows.groupBy("chapter").agg(F.sort_array(F.collect_list("l")).alias("all")).withColumn("all", F.filter("all", lambda x: x["text"] != ""))
    index = F.to_json(F.transform("all", lambda x, i: F.struct((i + 1).alias("line"), x["panel"].alias("panel"), F.length(x["text"]).alias("chars"))))
    return listed.select("chapter", F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("script"), index.alias("lines"))


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.sparkSession.dataSource.register(Scripts)
    rows.select("chapter", "script", "lines").write.format("scripts").option("path", path).mode(mode).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(chapter, script, lines) of what is written at path."""
    spark.dataSource.register(Scripts)
    return spark.read.format("scripts").option("path", path).load()
