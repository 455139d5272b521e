"""Connected components of an edge table, without collecting nodes, edges or components anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the edges (a, b): each node but the least of its component, and that least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def _local(edges: DataFrame) -> DataFrame:
    """The edges as stars within each batch of a partition: fewer and shorter paths, the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u, v = forest(b.column("u").to_numpy(), b.column("v").to_numpy())
                yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (a, b): label is the least node of its component.

    Alternating stars: each round links, first, every larger neighbour of a node to the node's least neighbour, and then
    the node and its smaller neighbours to the least of them, until nothing changes. That takes about log(n) rounds of
    minima, which are aggregated before they are shuffled, and joins, whose large keys Spark can split. Each round is
    written to the shared folder, so lineage stays short, and replaces the one before. Self loops are dropped; no edges give no rows.
    """
    pair = lambda x, y: [F.greatest(x, y).alias("u"), F.least(x, y).alias("v")]
    now = stored(_local(edges.filter("a <> b").select(*pair("a", "b"))).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # Larger neighbours v > u go to the least of u and its neighbours.
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u")
        small = rest.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, stored(small)
        discard(edges.sparkSession, before, large)
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state.n:
            break
        seen = state
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("label")))
