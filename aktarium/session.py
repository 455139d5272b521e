"""Session settings and table access shared by all queries."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Tables that `stored` has written in this process and that haven't been deleted; those of the innermost `collecting`.
_WRITTEN: set[str] = set()
_COLLECTED: ContextVar[list[str] | None] = ContextVar("collected", default=None)
#: Folder that holds the package; Python workers get it on their path.
HOME = str(Path(__file__).resolve().parent.parent)


def build_session(app: str = "aktarium", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the queries are tuned for; on a cluster the caller brings its own."""
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.app.name": app,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.config(map=settings).getOrCreate()


def ready(spark: SparkSession) -> SparkSession:
    """Put the package on the workers' path, whichever folder the driver was started in."""
    paths = [HOME, *filter(None, spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep))]
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(paths))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below `sf_dir`, which may be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset and all runs in one process (as in tests), it's one of our own, which goes when the process ends.
    With executors elsewhere such a folder would be another one on each machine: then an error is raised.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
        where = tempfile.mkdtemp(prefix="aktarium-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted by `discard` and `drop_stored` like those of `stored`."""
    path = f"{shared_folder(spark)}/aktarium-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    if (collected := _COLLECTED.get()) is not None:
        collected.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet into the shared folder and read it again: lineage is cut, nothing is computed twice.

    The table survives the loss of any executor, and its known size lets the planner choose joins. It stays until the
    shared folder is cleaned, or `discard` or `drop_stored` is called, as the returned frame is lazy.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._aktarium_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | str) -> int:
    """Delete tables that `stored` wrote, once nothing lazy rests on them. Frames that it didn't return are left alone."""
    hadoop, n = spark._jvm.org.apache.hadoop.fs, 0
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_aktarium_path", None)
        if path in _WRITTEN:
            _WRITTEN.discard(path)
            where = hadoop.Path(path)
            n += where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return n


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths that `stored` writes in this thread inside the block, to be discarded when what rests on them is written."""
    mark = _COLLECTED.set(paths := [])
    try:
        yield paths
    finally:
        _COLLECTED.reset(mark)


def drop_stored(spark: SparkSession) -> int:
    """Delete all that `stored` has written in this process. Call it once the results that rest on it are written."""
    return discard(spark, *list(_WRITTEN))
