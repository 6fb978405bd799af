"""Files that tasks write themselves, committed through temporary names and a manifest.

A task writes under a name that no other attempt shares, and returns a row per finished file. The rows
are checkpointed: for each task exactly one attempt's rows remain, whatever was retried or speculated.
A second job gives those files their final names (again and again the same if it is retried), the
manifest is written as Parquet, and what failed attempts left is removed. Readers trust the manifest
alone. Paths may lie in any store that Arrow opens (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from otindex.session import materialize

MANIFEST_SCHEMA = "task int, seq int, attempt string, name string, bytes bigint, records bigint, items bigint"
_NAMES = [field.split()[0] for field in MANIFEST_SCHEMA.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

#: Most tasks that read files at a time; a task may read several files.
MOST_READERS = 10_000


class RollingWriter:
    """Writes chunks of bytes to files of a task, beginning another file when one is full."""

    def __init__(self, folder: str, task: int, prefix: str, suffix: str, limit: int, header: bytes = b""):
        self.store, self.path = pafs.FileSystem.from_uri(folder)
        self.task, self.prefix, self.suffix, self.limit, self.header = task, prefix, suffix, limit, header
        self.attempt = uuid.uuid4().hex
        self.rows: list[tuple] = []
        self.out = None

    def write(self, data: bytes, records: int = 1, items: int = 0) -> None:
        if self.out is not None and self.size >= self.limit:
            self.finish_file()
        if self.out is None:
            name = f"{self.prefix}-{self.task:05d}-{len(self.rows):05d}{self.suffix}"
            self.store.create_dir(f"{self.path}/_temporary/{self.attempt}", recursive=True)
            self.out = self.store.open_output_stream(
                f"{self.path}/_temporary/{self.attempt}/{name}", compression=None
            )
            self.name, self.size, self.records, self.items = name, len(self.header), 0, 0
            self.out.write(self.header)
        self.out.write(data)
        self.size += len(data)
        self.records += records
        self.items += items

    def finish_file(self) -> None:
        self.out.close()
        self.rows.append((self.task, len(self.rows), self.attempt, self.name, self.size, self.records, self.items))
        self.out = None

    def manifest(self) -> Iterator[pa.RecordBatch]:
        """Closes the last file and yields the rows of all files."""
        if self.out is not None:
            self.finish_file()
        if self.rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, _NAMES)


def commit(written: DataFrame, folder: str) -> DataFrame:
    """Gives written files their final names and returns the manifest: (name, bytes, records, items, start).

    ``start`` is the number of items in all files before it, by task and number within the task.
    """
    spark = written.sparkSession
    rows = materialize(written)

    def rename(batches):
        store, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{path}/_temporary/{row['attempt']}/{row['name']}", f"{path}/{row['name']}"
                if store.get_file_info(source).type != pafs.FileType.NotFound:
                    store.move(source, target)
                if store.get_file_info(target).size != row["bytes"]:
                    raise OSError(f"{target} is not the file that was written")
            yield batch

    named = rows.mapInArrow(rename, MANIFEST_SCHEMA)
    order = Window.orderBy("task", "seq")  # one row per file, all of them small
    before = F.coalesce(F.sum("items").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named.withColumn("start", before).write.parquet(f"{folder}/_manifest")
    store, path = pafs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{path}/_temporary").type != pafs.FileType.NotFound:
        store.delete_dir(f"{path}/_temporary")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The committed files of a folder."""
    return spark.read.parquet(f"{folder}/_manifest")


def one_file_per_task(files: DataFrame) -> DataFrame:
    """Deals the rows of a manifest evenly to as many tasks as there are files, within a limit."""
    return files.repartition(max(1, min(MOST_READERS, files.count())))
