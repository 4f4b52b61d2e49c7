"""The write-ahead log's binary format, and reading a folder of it.

Little-endian: seq u64, item count u32, per item (length u32, length f32,
timestamp u64, id u64), then the crc32 of all before, u32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Internal
from ..functions.codecs import wal_number

Item = tuple[list[float], int, int]


def encode(seq: int, items: list[Item]) -> bytes:
    """items: (vector, timestamp, id)."""
    out = [struct.pack("<QI", seq, len(items))]
    for vector, ts, vid in items:
        v = np.asarray(vector, "<f4")
        out += [struct.pack("<I", len(v)), v.tobytes(), struct.pack("<QQ", ts, vid)]
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


def decode(raw: bytes) -> tuple[int, list[Item]]:
    """Raises Internal on a wrong checksum or a truncated entry."""
    if len(raw) < 16 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise Internal("the log entry's checksum is wrong")
    seq, count = struct.unpack_from("<QI", raw)
    at, items = 12, []
    try:
        for _ in range(count):
            (n,) = struct.unpack_from("<I", raw, at)
            vector = np.frombuffer(raw, "<f4", n, at + 4).tolist()
            ts, vid = struct.unpack_from("<QQ", raw, at + 4 + 4 * n)
            items.append((vector, ts, vid))
            at += 20 + 4 * n
    except (struct.error, ValueError) as e:
        raise Internal("the log entry is truncated") from e
    if at != len(raw) - 4:
        raise Internal("the log entry has bytes left over")
    return seq, items


ROWS = "seq long, position long, vector_id long, ts long, vector array<float>"


def read(spark: SparkSession, folder: str, after: int = -1) -> DataFrame:
    """seq, position, vector_id, ts, vector of all entries with a higher sequence number, in order of both."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(folder)
    files = files.where(wal_number("path") > after).select("content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ROWS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float32())]
        for b in batches:
            for raw in b.column(0):
                seq, items = decode(raw.as_py())
                made = [(seq, k, vid, ts, v) for k, (v, ts, vid) in enumerate(items)]
                columns = zip(*made, strict=True) if made else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.mapInArrow(rows, ROWS)


def write(rows: DataFrame, folder: str) -> int:
    """A file per sequence number from rows(seq, position, vector_id, ts, vector); how many. An entry is written by one task, whole or not at all."""

    def entry(key: tuple, part: pa.Table) -> pa.Table:
        from .vecs import open_files

        part = part.sort_by("position")
        seq = key[0].as_py()
        raw = encode(seq, list(zip(part["vector"].to_pylist(), part["ts"].to_pylist(), part["vector_id"].to_pylist(), strict=True)))
        fs, at = open_files(folder)
        fs.create_dir(at)
        with fs.open_output_stream(f"{at}/.{seq:020}.tmp") as f:
            f.write(raw)
        fs.move(f"{at}/.{seq:020}.tmp", f"{at}/{seq:020}.wal")
        return pa.table({"seq": [seq]})

    return rows.groupBy("seq").applyInArrow(entry, "seq long").count()


def parse_log(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Lines of a benchmark log that match, one double column per group."""
    lines = spark.read.text(path).where(F.rlike("value", F.lit(pattern)))
    return lines.select(*[F.regexp_extract("value", pattern, k + 1).cast("double").alias(n) for k, n in enumerate(names)])
