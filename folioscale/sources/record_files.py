"""JSON files as a data source: ``record_files`` writes one file for each row and shows all files of a write, or none.

    d.select("doc_id", "name", "body").write.format("record_files").mode("append").save(uri)
    spark.read.format("record_files").load(uri).where("doc_id = 'a'")

A write puts its files under a folder of its own, ``<write>/<bucket>/<doc_id>/<name>.json``, and is seen from when its marker in ``_commits`` is there. A task
that runs again writes the same files again. A failed write is removed; if that fails too, its files stay unseen.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow.fs as pafs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

BUCKETS = 64


def bucket_of(doc_id: str) -> str:
    return f"{zlib.crc32(doc_id.encode()) % BUCKETS:02d}"


def as_name(text: str) -> str:
    """A reversible file name, never one of the special ones."""
    return quote(text, safe="").replace(".", "%2E") or "%"


def from_name(name: str) -> str:
    return "" if name == "%" else unquote(name)


@dataclass
class Bucket(InputPartition):
    folder: str


@dataclass
class Done(WriterCommitMessage):
    files: int


def listed(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))


class RecordWriter(DataSourceWriter):
    def __init__(self, uri: str, overwrite: bool):
        # the time of its begin orders writes; an overwriting one hides all that came before
        self.uri, self.overwrite, self.name = uri, overwrite, f"{time.time_ns():020d}-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Done:
        fs, base = pafs.FileSystem.from_uri(self.uri)
        files, made = 0, set()
        for row in rows:
            folder = f"{base}/{self.name}/{bucket_of(row.doc_id)}/{as_name(row.doc_id)}"
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made = {folder} if len(made) > 10_000 else made | {folder}
            part = f"{base}/{self.name}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as out:
                out.write((row.body or "null").encode())
            fs.move(part, f"{folder}/{as_name(row.name)}.json")
            files += 1
        return Done(files)

    def commit(self, messages: list[Done | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(f"{base}/_commits", recursive=True)
        part = f"{base}/_commits/_{self.name}"
        with fs.open_output_stream(part) as out:
            out.write(json.dumps({"files": sum(m.files for m in messages if m), "overwrite": self.overwrite}).encode())
        fs.move(part, f"{base}/_commits/{self.name}.json")

    def abort(self, messages: list[Done | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.uri)
        if fs.get_file_info(f"{base}/{self.name}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/{self.name}")


class RecordReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri, self.bucket = uri, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """An equal id names its bucket; Spark checks the rows all the same."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("doc_id",) and isinstance(f.value, str):
                self.bucket = bucket_of(f.value)
            yield f

    def partitions(self) -> list[Bucket]:
        fs, base = pafs.FileSystem.from_uri(self.uri)
        seen: list[str] = []
        for info in sorted(listed(fs, f"{base}/_commits"), key=lambda x: x.base_name):
            if info.base_name.endswith(".json") and not info.base_name.startswith("_"):
                with fs.open_input_stream(info.path) as marker:
                    seen = [*([] if json.loads(marker.read())["overwrite"] else seen), info.base_name.removesuffix(".json")]
        return [Bucket(b.path) for name in seen for b in listed(fs, f"{base}/{name}") if b.type == pafs.FileType.Directory and self.bucket in (None, b.base_name)]

    def read(self, partition: Bucket) -> Iterator[tuple[str, str, str]]:
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        for doc in listed(fs, partition.folder):
            for file in listed(fs, doc.path):
                with fs.open_input_stream(file.path) as body:
                    yield from_name(doc.base_name), from_name(file.base_name.removesuffix(".json")), body.read().decode()


class RecordFiles(DataSource):
    """``doc_id, name, body`` of files under a URI that driver and executors reach. Rows without an id or name can't be written."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return "doc_id string, name string, body string"

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make ``record_files`` known, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordFiles)
