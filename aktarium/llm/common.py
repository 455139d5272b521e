"""What the corpus operators share: written intermediate tables, ranks within groups, batches of rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, stored

__all__ = ["HOT", "P", "discard", "get_bits", "in_batches", "joined", "ranked", "set_bits", "stored", "tuned", "without_ids", "word_count"]

#: Inner columns carry this prefix, so that no column of an input can clash with them.
P = "__ak_"
#: Rows and bytes of one Arrow batch. A single long text may exceed the bytes; it then travels alone.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: Bits of the filter of ids in `without_ids`, as powers of two: at least, at most, and for each id.
_FEWEST, _MOST, _EACH = 16, 27, 8
#: A key that more than this share of all rows have is broadcast by `joined`; so many can be hot in one column at most. Others
#: are shuffled, at most that share of the rows for each.
HOT = 4096


def tuned(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches, so that a worker's memory doesn't depend on the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], rank: str, count: str | None = None) -> DataFrame:
    """Add `rank`, each row's position from 0 within its group by `order`. Rows must differ in `order` or be equal.
    `count` names a column for the number of the group's rows.

    A group may hold any share of the rows: they are dealt by range over group and order together, numbered inside each
    partition, and only one row for each (group, partition) is summed up. `df` should be narrow, as it's written out.
    """
    pid, at, first, before = (P + x for x in ("pid", "at", "first", "before"))
    keys = [F.col(c) for c in (*group, *order)]
    spread = stored(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(pid, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    heads = spread.groupBy(*group, pid).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(P + "n"))
    earlier = Window.partitionBy(*group).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn(before, F.coalesce(F.sum(P + "n").over(earlier), F.lit(0)))
    if count:
        heads = heads.withColumn(count, F.sum(P + "n").over(Window.partitionBy(*group)))
    return (
        spread.join(heads.drop(P + "n"), [*group, pid])
        .withColumn(rank, F.col(before) + F.col(at) - F.col(first))
        .drop(pid, at, first, before)
    )


def joined(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, most: int) -> DataFrame:
    """`rows` with what `keyed` (one row a key) has for them. Keys that more than `most` rows have (`weight`, their number) are
    broadcast and leave `rows` before the others are shuffled."""
    hot, usual = keyed.filter(F.col(weight) > most), keyed.filter(F.col(weight) <= most)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(usual, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def in_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """`mapInArrow` with a function of one batch. Columns travel under plain names, as mapInArrow can't take any name."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := each(b.rename_columns(names))) is not None and out.num_rows:
                yield out
        # Workers serve one task after the other: what a large batch took goes back.
        pa.default_memory_pool().release_unused()

    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(run, schema)


def get_bits(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits at these positions of packed bits."""
    return (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def set_bits(packed: np.ndarray, at: np.ndarray) -> None:
    for k in range(8):  # one bit of the bytes at a time, so that repeated bytes don't matter
        packed[at[at & 7 == k] >> 3] |= np.uint8(1 << k)


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id isn't in `ids` (one column, without null); rows without an id stay.

    A filter of hashed ids (2^_MOST bits at most, 16 MB) is broadcast, and rows that it rejects pass where they are. Only the
    others, few as long as it isn't full, are shuffled to meet the ids themselves.
    """
    bits = min(_MOST, max(_FEWEST, (_EACH * max(1, ids.count()) - 1).bit_length()))
    size, mask, h = (1 << min(_FEWEST, bits)) // 8, (1 << bits) - 1, P + "h"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            set_bits(own, b.column("h").to_numpy() & mask)
        for segment in np.flatnonzero(own.reshape(-1, size).any(axis=1)).tolist():
            yield pa.record_batch([pa.array([segment], pa.int32()), pa.array([own[segment * size : (segment + 1) * size].tobytes()])], ["segment", "blob"])

    def merge(t: pa.Table) -> pa.Table:
        blob = np.bitwise_or.reduce(np.frombuffer(b"".join(t.column("blob").to_pylist()), np.uint8).reshape(-1, size), axis=0)
        return pa.table({"segment": t.column("segment")[:1], "blob": [zlib.compress(blob.tobytes(), 1)]})

    hashed = ids.select(F.xxhash64(ids.columns[0]).alias("h")).mapInArrow(fill, "segment int, blob binary")
    blobs = hashed.groupBy("segment").applyInArrow(merge, "segment int, blob binary").collect()
    filter_ = docs.sparkSession.sparkContext.broadcast({r["segment"]: bytes(r["blob"]) for r in blobs})
    kinds, last = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes), len(docs.columns)

    def passing(met: bool) -> DataFrame:
        packed: list[np.ndarray] = []

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            if not packed:
                packed.append(np.zeros((1 << bits) // 8, np.uint8))
                for segment, blob in filter_.value.items():
                    packed[0][segment * size : (segment + 1) * size] = np.frombuffer(zlib.decompress(blob), np.uint8)
            keep = get_bits(packed[0], b.column(last).to_numpy() & mask) == met
            return b.select(list(range(last))).filter(pa.array(keep))

        return in_batches(docs.withColumn(h, F.xxhash64(id_col)), each, kinds)

    # The ids are hashed, so that rows are shuffled but not sorted.
    gone = ids.select(F.col(ids.columns[0]).alias(P + "id")).hint("shuffle_hash")
    return passing(False).unionByName(passing(True).join(gone, F.col(id_col) == F.col(P + "id"), "left_anti"))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
