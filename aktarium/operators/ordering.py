"""Orders of lists, with the archive's place of nulls: last when ascending, first when descending. Ids break ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def display_date() -> Column:
    """The document's date, or else the day it was created."""
    return F.coalesce("document_date", F.to_date("created_at"))


def default_order() -> list[Column]:
    return [display_date().desc(), F.col("created_at").desc(), F.col("id").asc()]


def chronology() -> list[Column]:
    return [display_date().asc(), F.col("created_at").asc(), F.col("id").asc()]


def review_order() -> list[Column]:
    return [F.col("created_at").asc(), F.col("id").asc()]


def list_order(status: str = "") -> list[Column]:
    """The review queue is worked from the oldest on; other lists show the newest first."""
    return review_order() if status == "ready" else default_order()


def index_order(key: str) -> list[Column]:
    orders = {
        "name": [F.col("name").asc()],
        "count": [F.col("n_documents").desc(), F.col("name").asc()],
        "activity": [F.col("last_activity").desc_nulls_first(), F.col("name").asc()],
    }
    return orders[key]


def task_order() -> list[Column]:
    return [F.col("due_date").asc_nulls_last(), F.col("created_at").desc(), F.col("id").asc()]


def page(rows: DataFrame, order: list[Column], number: int, size: int = 20) -> DataFrame:
    """One page: a number under 1 is the first, one beyond the end the last. Only the page's rows are kept while sorting, and
    rows are counted for later pages only."""
    number = min(number, max(1, -(-rows.count() // size))) if number > 1 else 1
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def top(rows: DataFrame, order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first `n` rows, with their rank (from 1) where a name for it is given."""
    rows = rows.orderBy(*order).limit(n)
    return rows.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long")) if rank else rows


def top_of_each(rows: DataFrame, group: list[str], order: list[Column], n: int, total: str | None = None) -> DataFrame:
    """The first `n` rows of each group; `total` counts the group's rows, to tell whether it was cut.

    Each task keeps `n` rows of a group at most before they're shuffled, and counts are aggregated apart, so that a group
    may hold any share of the rows.
    """
    kept = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_place") <= n).drop("_place")
    return kept.join(rows.groupBy(*group).agg(F.count(F.lit(1)).alias(total)), group) if total else kept


def numbered(rows: DataFrame, order: list[str], place: str) -> DataFrame:
    """Every row with its place (from 1) in the order of these columns: rows are dealt by range and numbered in each
    partition, and only one row of each partition is summed up in one task. Rows are written once."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    spread = stored(spread.withColumns({"_part": F.spark_partition_id(), "_at": at}))
    heads = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spread.join(F.broadcast(heads.select("_part", before.alias("_before"))), "_part").withColumn(place, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def prefix_first(rows: DataFrame, name: str, prefix: str, order: list[Column], pool: int = 200, n: int = 10) -> DataFrame:
    """Of the first `pool` rows those that start with the prefix first, then the others, `n` in all."""
    head = rows.orderBy(*order).limit(pool)
    return head.orderBy(~F.lower(name).startswith(prefix.lower()), *order).limit(n)


def first_of_each(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group (first wins)."""
    return top_of_each(rows, group, order, 1)
