"""``format("committed")``: a store of batches that are each written once.

Tasks write their files under names of their own and report them in commit messages. When all are done the driver
writes one record per batch that names the files, and that is the commit. A batch that has its record already, as
when a round runs again after a failure, drops what it has just written; files of attempts that were killed
are in no record. Readers see the files of records only.

One driver writes a batch at a time. Options: ``path``, ``batch``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from seqlab.sources.places import place

DATA, RECORDS = "data", "records"
ROWS_PER_FILE = 1 << 22


class Written(WriterCommitMessage):
    def __init__(self, files: list[str], rows: int) -> None:
        self.files, self.rows = files, rows


def _record(path: str, batch: str) -> str:
    return f"{path.rstrip('/')}/{RECORDS}/{batch}.json"


def _exists(path: str) -> bool:
    system, own = place(path)
    return system.get_file_info(own).type == fs.FileType.File


def _delete(files: list[str]) -> None:
    for name in files:
        system, own = place(name)
        if system.get_file_info(own).type == fs.FileType.File:
            system.delete_file(own)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.batch, self.schema = options["path"].rstrip("/"), options["batch"], schema.json()
        if not self.batch or "/" in self.batch:
            raise ValueError("a batch needs a name without slashes")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, rows, in_file, out = [], 0, 0, None
        for batch in iterator:
            if out is None:
                name = f"{self.path}/{DATA}/{self.batch}-{uuid.uuid4().hex}.parquet"
                system, own = place(name)
                system.create_dir(own.rsplit("/", 1)[0], recursive=True)
                out, in_file = pq.ParquetWriter(own, batch.schema, filesystem=system), 0
                files.append(name)
            out.write_batch(batch)
            rows, in_file = rows + len(batch), in_file + len(batch)
            if in_file >= ROWS_PER_FILE:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(files, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        target = _record(self.path, self.batch)
        if _exists(target):
            _delete(files)
            return
        body = {"batch": self.batch, "schema": self.schema, "files": files, "rows": sum(m.rows for m in messages if m is not None)}
        system, own = place(target)
        system.create_dir(own.rsplit("/", 1)[0], recursive=True)
        # Written apart and moved into place, so that a record is there whole or not at all.
        aside = f"{own}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(aside) as f:
            f.write(json.dumps(body).encode())
        system.move(aside, own)

    def abort(self, messages: list[Written | None]) -> None:
        _delete([f for m in messages if m is not None for f in m.files])


class Committed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, schema)


def append(df: DataFrame, path: str, batch: str) -> None:
    """Add a batch under its name; nothing changes if the store has it already."""
    if _exists(_record(path, batch)):
        return
    df.sparkSession.dataSource.register(Committed)
    df.write.format("committed").mode("append").option("path", path).option("batch", batch).save()


def records(path: str) -> list[dict]:
    """The records of a store by the names of their batches."""
    system, own = place(f"{path.rstrip('/')}/{RECORDS}")
    if system.get_file_info(own).type != fs.FileType.Directory:
        return []
    out = []
    for info in system.get_file_info(fs.FileSelector(own)):
        if info.path.endswith(".json"):
            with system.open_input_stream(info.path) as f:
                out.append(json.loads(f.read()))
    return sorted(out, key=lambda r: r["batch"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches."""
    found = records(path)
    if not found:
        raise FileNotFoundError(f"no committed batch in {path}")
    schema = StructType.fromJson(json.loads(found[0]["schema"]))
    files = [f for r in found for f in r["files"]]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*files)
