"""Folders of doubly encoded JSON documents (S1, S2, S7, S10, S11) as a data source: spark.read / df.write.format("encoded_json").

One file holds one document: a JSON string that holds JSON, as often as it was encoded. Reading gives path, name (the
file's, without folder and extension), json (decoded until it isn't a string any more) and error (why json is missing):
a file that can't be read is a row, never a failed query. The driver lists names and sizes and plans partitions of some
`partitionBytes`; tasks read them.

Writing takes name and json. Tasks write into folders that readers pass over; the commit drops what unsuccessful attempts
left, and one rename makes a job's files visible. A failed job leaves nothing visible. Mode overwrite removes the
files of earlier jobs after the rename; append adds. Names that stand in several jobs, or repeatedly in one, are
several documents.

Paths are those that pyarrow opens: local ones, hdfs://, s3://, gs://.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "encoded_json"
#: Bytes of a planned partition, and what opening a file counts as.
PARTITION_BYTES, OPEN_BYTES = 32 << 20, 64 << 10
#: Bytes of documents that a task hands on at once, about.
BATCH_BYTES = 4 << 20
#: Encodings that a document may lie under.
DEPTH = 8
_SCHEMA = "path string, name string, json string, error string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + posixpath.abspath(path.removeprefix("file:")))


def decoded(text: str) -> str:
    """The JSON under all encodings, as text; ValueError if there is none."""
    for _ in range(DEPTH):
        value = json.loads(text)
        if not isinstance(value, str):
            return text
        text = value
    raise ValueError("encoded too often")


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        store, top = opened(self.path)
        infos = store.get_file_info(fs.FileSelector(top, recursive=True))
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p.removeprefix(top).split("/"))
        files = sorted((x.size, x.path) for x in infos if x.type == fs.FileType.File and not hidden(x.path))
        out: list[Files] = []
        room = 0
        for size, path in files:
            if size + OPEN_BYTES > room:
                out.append(Files())
                room = self.size
            out[-1].paths.append(path)
            room -= size + OPEN_BYTES
        return out or [Files()]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        schema, rows, held = pa.schema([(x, pa.string()) for x in ("path", "name", "json", "error")]), [], 0
        for path in partition.paths:
            text, error = None, None
            try:
                with store.open_input_stream(path) as f:
                    text = decoded(f.read().decode())
            except (OSError, ValueError, RecursionError) as found:
                error = f"{type(found).__name__}: {found}"[:500]
            name = unquote(posixpath.basename(path).rpartition(".")[0] or posixpath.basename(path))
            rows.append((path, name, text, error))
            held += len(text or "") + OPEN_BYTES // 16
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], schema=schema)


class Writer(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool) -> None:
        if not {"name", "json"} <= set(columns):
            raise ValueError(f"{FORMAT} takes columns name and json")
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.at = {x: columns.index(x) for x in ("name", "json")}

    def _folder(self, *more: str) -> str:
        return posixpath.join(opened(self.path)[1], *more)

    def write(self, rows: Iterator) -> Written:
        store, own = opened(self.path)[0], f"attempt-{uuid.uuid4().hex}"
        folder, n = self._folder(f"_staged-{self.job}", own), 0
        store.create_dir(f"{folder}/0")
        for row in rows:
            name, text = row[self.at["name"]], row[self.at["json"]]
            if name is None or text is None:
                raise ValueError(f"a document without name or json: {name}")
            json.loads(text)
            again, file = 0, f"{quote(str(name), safe=' ')}.json"
            while store.get_file_info(f"{folder}/{again}/{file}").type != fs.FileType.NotFound:  # a name's next document
                again += 1
                store.create_dir(f"{folder}/{again}")
            with store.open_output_stream(f"{folder}/{again}/{file}") as f:
                f.write(json.dumps(text).encode())
            n += 1
        return Written(own, n)

    def commit(self, messages: list[Written | None]) -> None:
        store = opened(self.path)[0]
        staged, keep = self._folder(f"_staged-{self.job}"), {m.folder for m in messages if m is not None}
        store.create_dir(staged)
        for x in store.get_file_info(fs.FileSelector(staged)):
            if posixpath.basename(x.path) not in keep:  # of attempts that failed or came second
                store.delete_dir(x.path)
        earlier = [x.path for x in store.get_file_info(fs.FileSelector(self._folder())) if not posixpath.basename(x.path).startswith("_")] if self.overwrite else []
        store.move(staged, self._folder(f"job-{self.job}"))
        for path in earlier:
            store.delete_dir(path) if store.get_file_info(path).type == fs.FileType.Directory else store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, staged = opened(self.path)[0], self._folder(f"_staged-{self.job}")
        if store.get_file_info(staged).type == fs.FileType.Directory:
            store.delete_dir(staged)


class EncodedDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EncodedDocuments)
