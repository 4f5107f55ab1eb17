"""What is at a path, in whichever store Hadoop's file systems reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def file_info(spark: SparkSession, path: str) -> dict | None:
    """``path, size, folder, modified`` (milliseconds); None if nothing is there."""
    fs, target = _at(spark, path)
    if not fs.exists(target):
        return None
    s = fs.getFileStatus(target)
    return {"path": s.getPath().toString(), "size": s.getLen(), "folder": s.isDirectory(), "modified": s.getModificationTime()}


def file_exists(spark: SparkSession, path: str) -> bool:
    info = file_info(spark, path)
    return info is not None and not info["folder"]


def folder_exists(spark: SparkSession, path: str) -> bool:
    info = file_info(spark, path)
    return info is not None and info["folder"]


def make_folder(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.mkdirs(target)


def file_size(spark: SparkSession, path: str) -> int:
    info = file_info(spark, path)
    if info is None:
        raise FileNotFoundError(path)
    return info["size"]


def is_readable(spark: SparkSession, path: str) -> bool:
    if not file_exists(spark, path):
        return False
    fs, target = _at(spark, path)
    fs.open(target).close()
    return True


def temporary_name(prefix: str, suffix: str = "") -> str:
    return f"{prefix}_{uuid.uuid4().hex}{suffix}"
