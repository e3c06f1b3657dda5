"""Small files through Spark's file systems, so a store may lie on any of them."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def make_dirs(spark: SparkSession, path: str) -> None:
    _fs(spark, path).mkdirs(_path(spark, path))


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    if not exists(spark, folder):
        return []
    return sorted(s.getPath().getName() for s in _fs(spark, folder).listStatus(_path(spark, folder)))


def ages(spark: SparkSession, folder: str) -> dict[str, float]:
    """Seconds since each name in a folder was last changed, by this machine's clock."""
    if not exists(spark, folder):
        return {}
    return {s.getPath().getName(): time.time() - s.getModificationTime() / 1000 for s in _fs(spark, folder).listStatus(_path(spark, folder))}


def size(spark: SparkSession, path: str) -> int:
    return _fs(spark, path).getContentSummary(_path(spark, path)).getLength() if exists(spark, path) else 0


def read_bytes(spark: SparkSession, path: str) -> bytes:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    out = _fs(spark, path).create(_path(spark, path), True)
    out.write(bytearray(data))
    out.hsync()
    out.close()


def write_new(spark: SparkSession, path: str, data: bytes) -> bool:
    """Write a file that must not exist yet, by rename from a temporary one; False if another was first."""
    temp = f"{path}.tmp"
    write_bytes(spark, temp, data)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(_path(spark, temp), _path(spark, path), none)
        return True
    except Exception as e:  # noqa: BLE001 - py4j wraps every Java exception in one class
        if "FileAlreadyExists" not in str(e):
            raise
        delete(spark, temp)
        return False
