"""A data source for NumPy matrices: `spark.read.format("npy_matrix")`.

A matrix is one .npy file, or a folder that this source has written: files of a bounded number of rows and a list of them.
Tasks read ranges of rows by their offset in a file, so several tasks share one file and none holds more than a batch of it.
Columns: row (from 0), doc_id (from the id map, a second .npy of one dimension; the row itself without one) and vec. Conditions on
row are pushed down and cut the ranges; a schema without vec or doc_id leaves those bytes unread.

Options: path, ids (path of the id map of a single file), rows (rows of a task).
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

NAME, SCHEMA, LISTED = "npy_matrix", "row long, doc_id long, vec array<float>", "matrix.json"
#: Rows of a task, of a batch, and of a written file.
TASK_ROWS, BATCH_ROWS, FILE_ROWS = 250_000, 4096, 250_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, kind and the offset of the first number of a .npy file."""
    system, place = opened(path)
    with system.open_input_file(place) as f:
        start = io.BytesIO(f.read(65_536))
    version = np.lib.format.read_magic(start)
    shape, by_column, kind = np.lib.format.read_array_header_1_0(start) if version == (1, 0) else np.lib.format.read_array_header_2_0(start)
    if by_column and len(shape) > 1:
        raise ValueError(f"{path} is stored by column")
    return shape, kind, start.tell()


def rows_at(path: str, first: int, count: int) -> np.ndarray:
    """Rows first to first + count of a .npy file."""
    shape, kind, start = header(path)
    width = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
    system, place = opened(path)
    with system.open_input_file(place) as f:
        f.seek(start + first * width)
        return np.frombuffer(f.read(count * width), kind).reshape(count, *shape[1:])


@dataclass
class RowRange(InputPartition):
    path: str
    ids: str | None
    first: int
    count: int
    base: int  # the row of the matrix that the file begins with


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.ids, self.rows = options["path"], options.get("ids"), int(options.get("rows", TASK_ROWS))
        self.columns = schema.names
        self.low, self.high, self.only = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("row",) or not isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
            elif isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = wanted if self.only is None else self.only & wanted
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            else:
                high = f.value + isinstance(f, LessThanOrEqual)
                self.high = high if self.high is None else min(self.high, high)

    def files(self) -> list[tuple[str, str | None, int]]:
        """(file, id map, rows) in order."""
        system, place = opened(self.path)
        if system.get_file_info(place).type == fs.FileType.Directory:
            with system.open_input_file(f"{place}/{LISTED}") as f:
                return [(f"{self.path}/{x['file']}", f"{self.path}/{x['ids']}", x["rows"]) for x in json.loads(f.read())]
        return [(self.path, self.ids, header(self.path)[0][0])]

    def partitions(self) -> list[RowRange]:
        out, base = [], 0
        for path, ids, count in self.files():
            low, high = max(0, self.low - base), count if self.high is None else min(count, self.high - base)
            if self.only is not None:
                own = [x - base for x in self.only if x is not None and low <= x - base < high]
                low, high = (min(own), max(own) + 1) if own else (0, 0)
            out += [RowRange(path, ids, k, min(self.rows, high - k), base) for k in range(low, high, self.rows)]
            base += count
        return out or [RowRange(self.path, None, 0, 0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        p = partition
        for at in range(p.first, p.first + p.count, BATCH_ROWS):
            count = min(BATCH_ROWS, p.first + p.count - at)
            row = np.arange(p.base + at, p.base + at + count)
            columns = {"row": pa.array(row, pa.int64())}
            if "doc_id" in self.columns:
                columns["doc_id"] = pa.array(row if p.ids is None else rows_at(p.ids, at, count).astype(np.int64), pa.int64())
            if "vec" in self.columns:
                numbers = np.ascontiguousarray(rows_at(p.path, at, count), np.float32).reshape(count, -1)
                size = numbers.shape[1]
                columns["vec"] = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * size, pa.int32()), pa.array(numbers.ravel()))
            batch = pa.record_batch([columns[c] for c in self.columns], names=self.columns)
            yield batch if self.only is None else batch.filter(pa.array(np.isin(row, list(self.only))))


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class MatrixWriter(DataSourceWriter):
    """Files of one task, named anew by each attempt; only what was committed is listed."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        system, place = opened(self.path)
        system.create_dir(place, recursive=True)
        files, ids, rows = [], [], []

        def put() -> None:
            name = uuid.uuid4().hex
            matrix = np.array(rows, np.float32)
            if matrix.ndim != 2:
                raise ValueError("vectors of one matrix are of one length")
            for file, numbers in ((f"{name}.npy", matrix), (f"{name}-ids.npy", np.array(ids, np.int64))):
                with system.open_output_stream(f"{place}/{file}") as out:
                    np.lib.format.write_array(out, numbers, allow_pickle=False)
            files.append({"file": f"{name}.npy", "ids": f"{name}-ids.npy", "rows": len(ids), "width": matrix.shape[1]})
            ids.clear(), rows.clear()

        for r in iterator:
            ids.append(r["doc_id"]), rows.append(r["vec"])
            if len(ids) >= FILE_ROWS:
                put()
        if ids:
            put()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        if len({f["width"] for f in files}) > 1:
            raise ValueError("vectors of one matrix are of one length")
        system, place = opened(self.path)
        system.create_dir(place, recursive=True)
        with system.open_output_stream(f"{place}/{LISTED}") as out:
            out.write(json.dumps(files).encode())


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MatrixSource)
    return spark


def read(spark: SparkSession, path: str, ids: str | None = None, columns: str = SCHEMA, rows: int = TASK_ROWS) -> DataFrame:
    """Rows of a matrix; columns: a part of SCHEMA."""
    options = {"rows": str(rows)} | ({"ids": ids} if ids else {})
    return registered(spark).read.format(NAME).schema(columns).options(**options).load(path)


def write(df: DataFrame, path: str) -> None:
    """Write (doc_id, vec) as a matrix with its id map, in as many files as there are tasks and more if they are large."""
    registered(df.sparkSession)
    df.select("doc_id", "vec").write.format(NAME).mode("overwrite").save(path)
