"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, ranked, stored

#: Offsets are multiples of 1 / _STEPS: sums with them stay exact in a double.
_STEPS = 1 << 20


def source_targets(sized: DataFrame, source: str, size: str, weights: Sequence[float], max_repeat: int, total: int | None = None) -> DataFrame:
    """For each source: `source_size`, `weight` and `target`.

    The sources in code point order, null last, take the weights in turn. They share `total` (all sizes where None) in
    proportion to their weights, but none gets over `max_repeat` times its size; what is cut is shared anew. So a target
    is min(cap, level * weight), and each round raises the level until no further source reaches its cap. Rounds only
    read the one row per source, in a written table; the driver sees three sums.
    """
    key, cap, at = P + "key", P + "cap", P + "nth"
    per_source = sized.groupBy(key).agg(F.sum(size).alias("source_size"), F.first(source).alias(source))
    turn = (F.col(at) % len(weights)).cast("int")
    kept = stored(
        ranked(per_source.withColumn(P + "all", F.lit(0)), [P + "all"], [key], at)
        .withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn + 1))
        .withColumn(cap, F.col("source_size") * max_repeat)
        .drop(P + "all", at)
    )
    sums = kept.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w"), F.sum(cap).alias("c")).first()
    total = sums.t or 0 if total is None else total
    level = total / sums.w if sums.w else 0.0
    while total < (sums.c or 0):
        free = F.col(cap) > F.col("weight") * level
        now = kept.agg(F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(~free, F.col(cap))).alias("c")).first()
        higher = (total - (now.c or 0)) / now.w if now.w else level
        if higher <= level:
            break
        level = higher
    share = F.least(F.col(cap).cast("double"), F.col("weight") * F.lit(level))
    return kept.withColumn("target", F.col(cap).cast("double") if total >= (sums.c or 0) else share).drop(cap)


def mix(
    docs: DataFrame,
    size: str,
    source: str = "source",
    doc_id: str = "doc_id",
    weights: Sequence[float] = (5, 2, 1),
    max_repeat: int = 3,
    total: int | None = None,
    seed: int = 42,
    keep: Sequence[str] = (),
) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken, and columns to `keep`.

    A document's expected copies are its source's target / source_size. Systematic sampling: these are summed along the
    source's documents, one random offset per source is added, and a document is emitted once for each integer that its
    sum passes. The order is by size, so that neighbours are alike and what a source takes misses its target by about one
    document at most. Copies never exceed `max_repeat`, reruns agree (the offset is drawn from `seed` and the source).

    `size` is a column of whole numbers; null counts as 0. Null sources are one source, the last. Repeated rows and ties
    are sampled as separate documents, null ids included (equal sizes go by id, then by the columns to keep); documents of size 0 may be drawn but take nothing. Sources
    of size 0 have target 0 and no copies. An empty table gives no row. Other columns aren't read. Only these narrow
    columns are shuffled, and a source may hold any share of the rows: see `ranked`.
    """
    key, at = P + "key", P + "rank"
    sized = stored(
        docs.select(
            F.col(doc_id).alias(doc_id),
            F.col(source).alias(source),
            F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"),
            F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1")).alias(key),
            *keep,
        )
    )
    targets = source_targets(sized, source, "size", weights, max_repeat, total)
    placed = ranked(sized.select(key, "size", doc_id, *keep), [key], ["size", doc_id, *keep], at)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 5), 16, 10).cast("double") / _STEPS
    passed = lambda n: F.floor(n * F.col(P + "each") + F.col(P + "drawn"))
    copies = F.least(passed(F.col(at) + 1) - passed(F.col(at)), F.lit(max_repeat)).cast("int")
    return (
        placed.join(targets, key)
        .withColumn(P + "each", each)
        .withColumn(P + "drawn", drawn)
        .withColumn("copies", copies)
        .select(doc_id, source, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)
    )


def oracle(documents: str = "documents", seed: int = 42) -> str:
    """DuckDB's SQL for `mix` with the default weights over word counts."""
    return f"""
WITH sized AS (
  SELECT doc_id, coalesce('0' || source, '1') AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM {documents}
), per_source AS (
  SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY k
), weighed AS (
  SELECT k, source_size, source_size * 3 AS cap,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY encode(k)) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM per_source
), tot AS (SELECT sum(source_size) AS t FROM weighed),
levels AS (
  SELECT CAST((SELECT t FROM tot)
           - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / (sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM weighed
), chosen AS (SELECT max(level) AS level FROM levels),
targets AS (
  SELECT k, source_size, least(CAST(cap AS DOUBLE), w * level) AS target,
         CAST(('0x' || substr(md5('{seed}:' || k), 1, 5)) AS BIGINT) / 1048576 AS drawn
  FROM weighed, chosen
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY size, doc_id) AS r FROM sized
)
SELECT doc_id, size, source_size, target,
       size * CAST(least(floor(r * (target / source_size) + drawn) - floor((r - 1) * (target / source_size) + drawn), 3) AS BIGINT) AS taken
FROM placed JOIN targets USING (k)
"""
