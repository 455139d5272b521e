"""The document tree: parents, roots, subtrees, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


#: So many levels are walked one by one; a tree that is deeper is finished by pointer doubling.
WALKED_LEVELS = 8


def descendants(docs: DataFrame, top: int) -> DataFrame:
    """(id, level) of all below `top` at any depth, each id once and never `top` itself; a cycle ends the walk.

    Each level is one join with the (id, parent_id) pairs, and most trees end after a few. One that doesn't is followed from
    the other end: with `top` as a root of its own, its descendants are those that `root_of` leads to it.
    """
    pairs = docs.select("id", "parent_id").filter("parent_id IS NOT NULL")
    level = stored(pairs.filter((F.col("parent_id") == top) & (F.col("id") != top)).select("id", F.lit(1).cast("long").alias("level")).distinct())
    seen = level
    for n in range(2, WALKED_LEVELS + 1):
        if level.isEmpty():
            return seen
        below = pairs.join(level.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").filter(F.col("id") != top)
        level = stored(below.select("id", F.lit(n).cast("long").alias("level")).distinct().join(seen.select("id"), "id", "left_anti"))
        seen = seen.unionByName(level)
    if level.isEmpty():
        return seen
    cut = docs.select("id", F.when(F.col("id") != top, F.col("parent_id")).alias("parent_id"))
    return root_of(cut).filter((F.col("root_id") == top) & (F.col("id") != top)).select("id", F.col("depth").alias("level")).distinct()


def root_of(docs: DataFrame) -> DataFrame:
    """(id, root_id, depth) of every document, by pointer doubling: each round doubles the height that is covered, and is
    written out, so that the next one doesn't repeat it.

    A document in or below a cycle has root_id null; a parent that is missing makes its child a root. Chains have any
    height: a round after which no fewer documents are on their way than before leaves only cycles, as each document on a
    long chain has ancestors on shorter ones.
    """
    ids = docs.select("id", "parent_id")
    known = ids.select(F.col("id").alias("parent_id"))
    at = ids.join(known, "parent_id", "left_semi").select("id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("depth"))
    at = at.unionByName(ids.join(at.select("id"), "id", "left_anti").select("id", F.col("id").alias("up"), F.lit(0).cast("long").alias("depth")))
    at = stored(at)
    before = None
    while True:
        step = at.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = F.col("next") != F.col("up")
        now = stored(at.join(step, "up").select("id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), moved.alias("moved")))
        at = now.drop("moved")
        under_way = now.filter("moved").count()
        if under_way in (0, before):
            break
        before = under_way
    roots = ids.filter("parent_id IS NULL").select("id").unionByName(ids.filter("parent_id IS NOT NULL").join(known, "parent_id", "left_anti").select("id"))
    sure = at.join(roots.select(F.col("id").alias("up")), "up", "left_semi").select("id", F.col("up").alias("root_id"), "depth")
    return ids.select("id").join(sure, "id", "left")


def cyclic(docs: DataFrame) -> DataFrame:
    """Ids whose chain of parents never ends."""
    return root_of(docs).filter("root_id IS NULL").select("id")
