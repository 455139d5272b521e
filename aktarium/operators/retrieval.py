"""Semantic search and similar documents: scope first, then an exact ranking of chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import best_per_document, cosine_distance, mean_vectors
from .tree import descendants


def _ranked(chunks: DataFrame, candidates: DataFrame, query: Sequence[float]) -> DataFrame:
    wanted = F.array(*(F.lit(float(x)) for x in query))
    scoped = chunks.join(candidates.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    scoped = scoped.filter(F.size("embedding") == len(query))
    return scoped.withColumn("distance", cosine_distance(F.col("embedding"), wanted)).filter("distance IS NOT NULL")


def search(chunks: DataFrame, candidates: DataFrame, query: Sequence[float], limit: int = 20) -> DataFrame:
    """The `limit` documents with the nearest chunk: document_id, chunk_id, snippet, score, best first.

    `candidates` are the documents in scope, children included; chunks of all embedding models take part and no score is
    too low. The query's vector is a literal, the semi-join comes before the distance.
    """
    best = best_per_document(_ranked(chunks, candidates, query), limit)
    return best.select("document_id", F.col("id").alias("chunk_id"), F.col("content").alias("snippet"), (1 - F.col("distance")).alias("score"))


def comparable_to(own: DataFrame, docs: DataFrame, visible: DataFrame, document: int, exclude: Sequence[int] = ()) -> tuple[DataFrame, DataFrame]:
    """The documents that a document may be compared with, and the embedding models of its `own` chunks."""
    kin = docs.filter(F.col("id") == document).select(F.explode(F.array("id", "parent_id")).alias("id")).filter("id IS NOT NULL")
    kin = kin.unionByName(descendants(docs, document).select("id"))
    candidates = visible.join(kin, "id", "left_anti").filter(~F.col("id").isin(*exclude) if exclude else F.lit(True))
    return candidates, own.select("embedding_model", "embedding_model_version").distinct()


def similar_documents(
    chunks: DataFrame, docs: DataFrame, visible: DataFrame, document: int, limit: int = 5, min_score: float = 0.7, cap: int = 200, exclude: Sequence[int] = ()
) -> DataFrame:
    """Documents whose chunks are near the mean of the document's own: document_id, chunk_id, score.

    Left out are itself, its parent, its descendants (siblings stay) and `exclude`; only chunks of an embedding model that
    it has itself are compared. The nearest `cap` chunks with `min_score` or more are taken before the best chunk of each
    document. Without own chunks, or with a limit of 0, there is no row.
    """
    own = chunks.filter(F.col("document_id") == document)
    mean = mean_vectors(own, "document_id").select("mean").first()
    if not mean or limit <= 0:
        return chunks.limit(0).select("document_id", F.col("id").alias("chunk_id"), F.lit(0.0).alias("score"))
    candidates, models = comparable_to(own, docs, visible, document, exclude)
    comparable = chunks.join(models, ["embedding_model", "embedding_model_version"], "left_semi")
    near = _ranked(comparable, candidates, mean["mean"]).filter(F.col("distance") <= 1 - min_score)
    best = best_per_document(near.orderBy("distance", "id").limit(cap), limit)
    return best.select("document_id", F.col("id").alias("chunk_id"), (1 - F.col("distance")).alias("score"))
