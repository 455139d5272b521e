"""Columns over embeddings: inner products, cosine, means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def score(distance: Column) -> Column:
    return F.lit(1.0) - distance


def score_percent(value: Column) -> Column:
    """Whole percent, halves to the even number."""
    return F.bround(value * 100).cast("int")


def mean_vectors(chunks: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """The component-wise mean of each key's vectors, as an array of doubles. Keys without vectors have no row.

    Sums of components are aggregated before the shuffle; only (key, position) pairs travel.
    """
    parts = chunks.select(key, F.posexplode(vector).alias("at", "x"))
    means = parts.groupBy(key, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs"))
    return whole.select(key, F.transform("xs", lambda p: p["x"]).alias("mean"))


def best_per_document(scored: DataFrame, n: int | None = None) -> DataFrame:
    """Of each document its nearest chunk (ties to the smaller chunk id), and of these the `n` nearest documents."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("distance", "id"))
    best = scored.withColumn("_p", place).filter("_p = 1").drop("_p")
    return best.orderBy("distance", "document_id").limit(n) if n else best
