"""Folder listing and marker files through the session's own file system layer."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import SparkSession


def file_name(text: str) -> str:
    """Any text as one path element."""
    return quote(str(text), safe="-_")


def _open(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _open(spark, path)
    return fs.exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    target, fs = _open(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file appears whole or not at all: it is written beside its place and renamed."""
    target, fs = _open(spark, path)
    folder, _, name = path.rpartition("/")
    part, _ = _open(spark, f"{folder}/_{name}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, target):
        fs.delete(target, False)
        if not fs.rename(part, target):
            raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    target, fs = _open(spark, path)
    stream = fs.open(target)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def remove(spark: SparkSession, path: str) -> None:
    target, fs = _open(spark, path)
    fs.delete(target, True)
