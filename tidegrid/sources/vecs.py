"""fvecs and ivecs files: repeated records of a little-endian count and as many 4-byte values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..errors import InvalidArgument

RECORDS = 8192


def open_files(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _paths(path: str) -> list[tuple[str, int]]:
    fs, at = open_files(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.Directory:
        return sorted((i.path, i.size) for i in fs.get_file_info(pafs.FileSelector(at)) if i.is_file)
    if info.type == pafs.FileType.NotFound:
        raise InvalidArgument(f"no file {path}")
    return [(at, info.size)]


def record_width(head: bytes) -> int | None:
    """The values of a record, from the first four bytes; None if there are none."""
    if len(head) < 4:
        return None
    n = int(np.frombuffer(head[:4], "<i4")[0])
    return n if n > 0 else None


class Part(InputPartition):
    def __init__(self, path: str, first: int, count: int, dim: int, base: int) -> None:
        super().__init__((path, first, count))
        self.path, self.first, self.count, self.dim, self.base = path, first, count, dim, base


class VecsReader(DataSourceReader):
    """Parts are ranges of whole records. A record of another length is an error; with ``malformed=skip`` it ends its part.

    A cut-off record at the end of a file is left out.
    """

    def __init__(self, options: dict, kind: str) -> None:
        self.kind, self.path = kind, options["path"]
        self.dim = int(options["dim"]) if "dim" in options else None
        self.limit = int(options["limit"]) if "limit" in options else None
        self.skip = options.get("malformed", "fail") == "skip"
        self.per_part = int(options.get("records_per_partition", 262_144))

    def partitions(self) -> list[Part]:
        out, base = [], 0
        fs, _ = open_files(self.path)
        for path, size in _paths(self.path):
            with fs.open_input_file(path) as f:
                dim = record_width(f.read(4))
            if dim is None or (self.dim and dim != self.dim):
                continue
            count = size // (4 + 4 * dim)
            if self.limit is not None:
                count = min(count, self.limit - base)
            out += [Part(path, k, min(self.per_part, count - k), dim, base) for k in range(0, max(0, count), self.per_part)]
            base += max(0, count)
        return out or [Part("", 0, 0, 1, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        fs, _ = open_files(self.path)
        width, kind = 4 + 4 * part.dim, "<f4" if self.kind == "fvecs" else "<i4"
        with fs.open_input_file(part.path) as f:
            f.seek(part.first * width)
            for k in range(0, part.count, RECORDS):
                n = min(RECORDS, part.count - k)
                raw = np.frombuffer(f.read(n * width), np.uint8)
                raw = raw[: len(raw) // width * width].reshape(-1, width)
                odd = np.flatnonzero(raw[:, :4].copy().view("<i4")[:, 0] != part.dim)
                if len(odd) and not self.skip:
                    raise InvalidArgument(f"{part.path}: record {part.first + k + int(odd[0])} is not of {part.dim} values")
                good = raw[: odd[0]] if len(odd) else raw
                values = np.ascontiguousarray(good[:, 4:]).view(kind).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1, dtype=np.int32) * part.dim), pa.array(values))
                ids = pa.array(np.arange(len(good), dtype=np.int64) + part.base + part.first + k)
                yield pa.RecordBatch.from_arrays([ids, lists], ["row_id", "values"])
                if len(odd):
                    return


class VecsWriter(DataSourceWriter):
    """One file per task, records in the task's order."""

    def __init__(self, options: dict, kind: str) -> None:
        self.kind, self.path = kind, options["path"]

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, at = open_files(self.path)
        fs.create_dir(at)
        kind = "<f4" if self.kind == "fvecs" else "<i4"
        with fs.open_output_stream(f"{at}/part-{TaskContext.get().partitionId():05d}.{self.kind}") as f:
            for row in rows:
                values = np.asarray(row["values"], kind)
                f.write(np.int32(len(values)).astype("<i4").tobytes() + values.tobytes())
        return WriterCommitMessage()


class Fvecs(DataSource):
    """format("fvecs"): row_id long, values array<float>; options dim, limit, records_per_partition."""

    KIND, VALUE = "fvecs", "float"

    @classmethod
    def name(cls) -> str:
        return cls.KIND

    def schema(self) -> str:
        return f"row_id long, values array<{self.VALUE}>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return VecsReader(self.options, self.KIND)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return VecsWriter(self.options, self.KIND)


class Ivecs(Fvecs):
    KIND, VALUE = "ivecs", "int"


def count(path: str) -> int:
    """The whole records of a file or folder, from the sizes and the first headers alone."""
    return sum(part.count for part in VecsReader({"path": path}, "fvecs").partitions())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Fvecs)
    spark.dataSource.register(Ivecs)
