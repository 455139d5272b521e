"""Tables that are replaced as a whole: each version is a folder that never changes, and a small file says which one it is.

A version is there once its file is: a reader that comes before sees the version before it, one that has begun goes on
reading its folder. Files of versions are created only where there's none of that number, so of two writers that began with one version the
second is told, and does its change again on what the first has left. A writer that dies leaves at most a folder that no
version names, or an empty file, which counts as no version; `vacuum` removes both.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has made the version that this one was about to make."""


def _fs(spark: SparkSession, path: str) -> tuple[Any, Callable[[str], Any]]:
    jvm = spark._jvm.org.apache.hadoop.fs
    where = lambda p: jvm.Path(p)
    return where(path).getFileSystem(spark._jsc.hadoopConfiguration()), where


def _written(spark: SparkSession, path: str) -> dict[int, str]:
    """Numbers of the files of versions, and the folders they name ('' if they don't yet)."""
    fs, where = _fs(spark, path)
    folder = where(f"{path}/versions")
    found = {}
    if fs.exists(folder):
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.isdigit():
                file = fs.open(status.getPath())
                try:
                    found[int(name)] = spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
                finally:
                    file.close()
    return found


def latest(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and folder of the table's last version."""
    return max(((n, folder) for n, folder in _written(spark, path).items() if folder), default=None)


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """A version, the last if none is named, as it stays."""
    there = {n: folder for n, folder in _written(spark, path).items() if folder}
    if not there or (number is not None and number not in there):
        raise FileNotFoundError(f"{path} has no version" + (f" {number}" if number is not None else ""))
    return spark.read.parquet(f"{path}/data/{there[number if number is not None else max(there)]}")


def publish(df: DataFrame, path: str, after: int | None = None) -> int:
    """Write `df` as the next version and return its number; with `after`, only if that is still the last (0: none is there)."""
    spark, folder = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{folder}")
    fs, where = _fs(spark, path)
    while True:
        number = (max(_written(spark, path), default=0) if after is None else after) + 1
        try:
            file = fs.create(where(f"{path}/versions/{number:012d}"), False)
        except Exception as e:
            if "FileAlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            if after is not None:
                raise Conflict(f"{path} has a version {number} by now") from e
            continue
        try:
            file.write(bytearray(folder.encode()))
        finally:
            file.close()
        return number


def update(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 5) -> int:
    """Publish what `change` makes of the last version (None: there's none yet), again from the start if another writer was
    faster."""
    for left in range(tries - 1, -1, -1):
        # Numbers that a dead writer took count, though nothing is there.
        numbers, now = _written(spark, path), latest(spark, path)
        try:
            return publish(change(spark.read.parquet(f"{path}/data/{now[1]}") if now else None), path, max(numbers, default=0))
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be 1 or more")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the last `keep` versions, and folders that no version names; how many folders went. Not beside writers
    whose data aren't named yet, nor readers of older versions."""
    fs, where = _fs(spark, path)
    whole = {n: folder for n, folder in _written(spark, path).items() if folder}
    kept = sorted(whole)[-keep:]
    for n in _written(spark, path):
        if n not in kept and n < max(whole, default=0):
            fs.delete(where(f"{path}/versions/{n:012d}"), False)
    data, gone = where(f"{path}/data"), 0
    if fs.exists(data):
        for status in fs.listStatus(data):
            if status.getPath().getName() not in {whole[n] for n in kept}:
                gone += fs.delete(status.getPath(), True)
    return gone
