import threading

import pytest

from aktarium.operators.ingest import upsert
from aktarium.sources import versions
from pyspark.sql import functions as F


def rows_of(spark, n, value):
    return spark.range(n).withColumn("v", F.lit(value))


def test_readers_see_whole_versions_while_a_writer_dies_at_each_step(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path)
    assert versions.publish(rows_of(spark, 10, 0), path) == 1
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            r = versions.read_version(spark, path).groupBy().agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).first()
            seen.append((r.n, r.a, r.b))

    reader = threading.Thread(target=read)
    reader.start()
    try:
        # dies while the data are written
        with pytest.raises(Exception, match="boom"):
            versions.publish(rows_of(spark, 50, 1).withColumn("x", F.when(F.col("id") > 20, F.raise_error(F.lit("boom")))), path)
        # dies before the version's file, and after it was created but not written
        with monkeypatch.context() as m:
            m.setattr(versions, "_fs", lambda *a: (_ for _ in ()).throw(OSError("gone")))
            with pytest.raises(OSError, match="gone"):
                versions.publish(rows_of(spark, 60, 2), path)
        (tmp_path / "t" / "versions" / "000000000002").touch()
        for n, value in ((20, 3), (30, 4), (40, 5)):
            versions.publish(rows_of(spark, n, value), path)
    finally:
        stop.set()
        reader.join()
    assert seen and set(seen) <= {(10, 0, 0), (20, 3, 3), (30, 4, 4), (40, 5, 5)}
    assert versions.latest(spark, path)[0] == 5 and versions.read_version(spark, path).count() == 40 and versions.read_version(spark, path, 3).count() == 20
    assert versions.vacuum(spark, path, keep=1) >= 4 and versions.vacuum(spark, path, keep=1) == 0
    assert versions.read_version(spark, path).count() == 40
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path, 3)


def test_the_slower_of_two_writers_starts_again(spark, tmp_path):
    path = str(tmp_path / "t")
    put = lambda rows, old: upsert(old, rows, ["id"]) if old is not None else rows
    versions.update(spark, path, lambda old: put(spark.createDataFrame([(1, "a"), (2, "a")], "id long, v string"), old))
    calls = []

    def slow(old):
        if not calls:
            versions.update(spark, path, lambda o: put(spark.createDataFrame([(2, "b"), (3, "b")], "id long, v string"), o))
        calls.append(1)
        return put(spark.createDataFrame([(3, "c"), (4, "c")], "id long, v string"), old)

    assert versions.update(spark, path, slow) == 3 and len(calls) == 2
    assert sorted((r.id, r.v) for r in versions.read_version(spark, path).collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "c")]
    with pytest.raises(versions.Conflict):
        versions.publish(rows_of(spark, 1, 0), path, after=1)
