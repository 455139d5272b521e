"""Deduplication of streams with keyed state: a micro-batch looks up its own keys, never the whole archive."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that processors with values of their own need; its versions follow the batches, so a batch that's run again
#: finds the state that it found before.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class FirstSeen(StatefulProcessor):
    """Marks of each key the first row as new, all others as repeats. State is one value a key: what the first had in `order`.

    Within a batch the row that is least by `order` is first. Rows pass one by one, so a key may have any number of them.
    """

    def __init__(self, order: str, fields: list[str], kind: str):
        self.order, self.made = order, Row(*fields, kind)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "value string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        known, least = self.first.exists(), None
        for r in rows:
            if known:
                yield self.made(*r, "repeat")
            elif least is None:
                least = r
            elif r[self.order] < least[self.order]:
                yield self.made(*least, "repeat")
                least = r
            else:
                yield self.made(*r, "repeat")
        if least is not None:
            self.first.update((str(least[self.order]),))
            yield self.made(*least, "new")

    def handleInitialState(self, key: Any, initialState: Any, timerValues: Any) -> None:  # noqa: N802, N803
        self.first.update((str(initialState[self.order]),))

    def close(self) -> None:
        pass


def first_and_repeats(rows: DataFrame, key: str, order: str = "path", known: DataFrame | None = None, kind: str = "kind") -> DataFrame:
    """The rows of a stream with `kind`: `new` for the first row of each `key` (a string, not null) ever, `repeat` for others.

    `known` (one row a key, with both columns) is what an archive has before the stream begins; it's read once, with the
    first batch. Start the query inside `keyed_state`. Rows are shuffled by key with all their columns: keep them narrow.
    """
    shape = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    initial = known.select(key, order).groupBy(key) if known is not None else None
    return rows.groupBy(key).transformWithState(FirstSeen(order, rows.columns, kind), f"{shape}, `{kind}` string", "Append", "None", initial)


@contextmanager
def keyed_state(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Queries started inside get the state store that keyed state needs; the session is as before afterwards.

    Each partition of the state is opened, asked and committed by a task of its own in every micro-batch, however few rows come.
    So there are as many as cores (and no more than the session's shuffles have), or `partitions`: a checkpoint keeps its number.
    """
    name = "spark.sql.shuffle.partitions"
    chosen = STORE | {name: str(partitions or min(int(spark.conf.get(name)), spark.sparkContext.defaultParallelism))}
    before = {k: spark.conf.get(k, None) for k in chosen}
    for k, v in chosen.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def write_batch(rows: DataFrame, number: int, path: str) -> None:
    """Write a micro-batch as its own partition; a batch that is run again replaces it."""
    rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What `write_batch` has written so far, with its `batch`; no rows where nothing has come yet."""
    schema = f"{schema}, batch int"
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def occurrences(documents: DataFrame, repeats: DataFrame, key: str = "sha256") -> DataFrame:
    """Each repeat beside the document that it repeats, whichever batch either came in: key, first (the document's path), path, name."""
    firsts = documents.select(key, F.col("path").alias("first"))
    return repeats.select(key, "path", "name").join(firsts, key)
