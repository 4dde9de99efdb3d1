"""Keyed results as a format of Spark's: ``read.format("keyed_results")`` and ``write.format(...)``.

A write adds a layer of records; reading gives the last record of each key. Tasks write files of
their own, which nobody sees until the job commits one small file that names them. So a failed task
or job leaves nothing visible, nothing is renamed, and two writers at a time lose none of each
other's keys: both layers count, the later one for keys that are in both.
"""

from __future__ import annotations

import json
import os
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

FORMAT = "keyed_results"
#: Parts by key in which a document is read, each by one task. They belong to the document.
BUCKETS = 16
#: Records that a task hands on at once.
_AT_ONCE = 10_000


@dataclass
class _Written(WriterCommitMessage):
    files: dict[int, str]


@dataclass
class _Bucket(InputPartition):
    files: list[str]

    def __init__(self, files: list[str]):
        self.files = files


class _Folder:
    """Layers of a document: ``commits/<number>-<writer>.json`` names the files of one."""

    def __init__(self, path: str):
        if "://" in path or path.startswith("file:"):
            self.files, self.root = fs.FileSystem.from_uri(path)
        else:
            self.files, self.root = fs.LocalFileSystem(), os.path.abspath(path)

    def commits(self) -> list[dict]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        names = sorted(f.base_name for f in found if f.base_name.endswith(".json"))
        return [json.loads(self.text(f"commits/{n}")) | {"number": int(n.split("-")[0])} for n in names]

    def layers(self) -> list[dict]:
        """Commits that count: those from the last one on that replaced everything."""
        commits = self.commits()
        first = max((i for i, c in enumerate(commits) if c["replaces"]), default=0)
        return commits[first:]

    def text(self, name: str) -> str:
        with self.files.open_input_stream(f"{self.root}/{name}") as stream:
            return stream.read().decode()

    def write(self, name: str, text: str) -> None:
        self.files.create_dir(f"{self.root}/{os.path.dirname(name)}", recursive=True)
        with self.files.open_output_stream(f"{self.root}/{name}") as stream:
            stream.write(text.encode())

    def delete(self, name: str) -> None:
        self.files.delete_file(f"{self.root}/{name}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, key: str, schema: T.StructType):
        self._path, self._key, self._schema = path, key, schema

    def partitions(self) -> list[_Bucket]:
        buckets: dict[int, list[str]] = {}
        for layer in _Folder(self._path).layers():
            for bucket, names in layer["files"].items():
                buckets.setdefault(int(bucket), []).extend(names)
        return [_Bucket(names) for _, names in sorted(buckets.items())] or [_Bucket([])]

    def read(self, partition: _Bucket) -> Iterator[pa.RecordBatch]:
        folder, last = _Folder(self._path), {}
        for name in partition.files:
            for line in folder.text(name).splitlines():
                record = json.loads(line)
                last[record[self._key]] = record
        rows, schema = list(last.values()), to_arrow_schema(self._schema)
        for at in range(0, len(rows), _AT_ONCE):
            yield pa.RecordBatch.from_pylist(rows[at : at + _AT_ONCE], schema=schema)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, key: str, buckets: int, schema: T.StructType, replaces: bool):
        self._path, self._key, self._buckets = path, key, buckets
        self._schema, self._replaces, self._writer = schema.json(), replaces, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> _Written:
        lines: dict[int, list[str]] = {}
        for row in iterator:
            record = row.asDict(recursive=True)
            key = json.dumps(record[self._key])
            lines.setdefault(zlib.crc32(key.encode()) % self._buckets, []).append(json.dumps(record))
        folder, own = _Folder(self._path), uuid.uuid4().hex
        files = {bucket: f"records/{self._writer}/{own}-{bucket}.jsonl" for bucket in lines}
        for bucket, name in files.items():
            folder.write(name, "\n".join(lines[bucket]) + "\n")
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        folder, files = _Folder(self._path), {}
        for message in messages:
            for bucket, name in (message.files if message else {}).items():
                files.setdefault(bucket, []).append(name)
        number = max((c["number"] for c in folder.commits()), default=0) + 1
        layer = {
            "replaces": self._replaces,
            "schema": json.loads(self._schema),
            "key": self._key,
            "buckets": self._buckets,
            "files": files,
        }
        folder.write(f"commits/{number:010}-{self._writer}.json", json.dumps(layer))

    def abort(self, messages: list[_Written | None]) -> None:
        folder = _Folder(self._path)
        for message in messages:
            for name in (message.files if message else {}).values():
                folder.delete(name)


class KeyedResults(DataSource):
    """Records of strings, numbers, booleans, arrays and structs, one per key.

    Options: ``path``; for the first write ``key`` (``teacher``) and ``buckets``, which the document
    keeps. ``append`` replaces records of equal key, ``overwrite`` all of them. Of several records of
    one key in a write any may stay; make them unique before. The key is never NULL.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _layers(self) -> list[dict]:
        return _Folder(self.options["path"]).layers()

    def _setting(self, name: str, default: str) -> str:
        layers = self._layers()
        return layers[-1][name] if layers else self.options.get(name, default)

    def schema(self) -> T.StructType:
        layers = self._layers()
        if not layers:
            raise FileNotFoundError(f"no results at {self.options['path']}")
        return T.StructType.fromJson(layers[-1]["schema"])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], self._setting("key", "teacher"), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        key, buckets = self._setting("key", "teacher"), int(self._setting("buckets", str(BUCKETS)))
        return _Writer(self.options["path"], key, buckets, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    # Tasks get the classes along with their work; executors need not have this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(KeyedResults)


def upsert_results(rows: DataFrame, path: str, key: str = "teacher") -> None:
    register(rows.sparkSession)
    rows.write.format(FORMAT).mode("append").option("key", key).save(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).load(path)


def compact(spark: SparkSession, path: str) -> None:
    """Write the last record of each key as the only layer; readers see the old layers until then."""
    read_results(spark, path).write.format(FORMAT).mode("overwrite").save(path)
