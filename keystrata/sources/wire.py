"""The store's own log records: an operation byte, then key and value each behind a 32-bit little-endian length.

A log file is written whole, but a reader still stops at a torn tail instead of failing.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEN = struct.Struct("<I")
MAX_FIELD = (1 << 31) - 1  # Spark's binary limit


def check_field(data: bytes) -> bytes:
    if len(data) > MAX_FIELD:
        raise ValueError("keys and values are limited to 2 GiB - 1")
    return data


def encode_record(op: int, key: bytes, value: bytes) -> bytes:
    return bytes([op]) + _LEN.pack(len(check_field(key))) + key + _LEN.pack(len(check_field(value))) + value


def decode_records(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(op, key, value) of each whole record, in write order."""
    at = 0
    while at + 5 <= len(data):
        op, n = data[at], _LEN.unpack_from(data, at + 1)[0]
        key_end = at + 5 + n
        if key_end + 4 > len(data):
            return
        m = _LEN.unpack_from(data, key_end)[0]
        end = key_end + 4 + m
        if end > len(data):
            return
        yield op, data[at + 5 : key_end], data[key_end + 4 : end]
        at = end


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, op, key, value) of log files, in write order by (file, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(decode_records(content.as_py()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array([r[0] for r in rows], pa.int8()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                    ["file", "pos", "op", "key", "value"],
                )

    files = spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("content"))
    return files.mapInArrow(run, "file string, pos long, op byte, key binary, value binary")
