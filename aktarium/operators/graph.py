"""The neighbourhood of one node: documents, cases, tags, contacts and why they are near."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import default_order, numbered, top
from .references import other_side, shared_matches

LIMIT = 25


def _node(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def edge_id(a: Column, b: Column) -> Column:
    """One id for an edge whichever way it's seen, by the order of the nodes' names as text."""
    return F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b))


def _edges(rows: DataFrame, focus: str, kind: str, node_kind: str, key: str, label: Column, total: Column | None = None) -> DataFrame:
    node = _node(node_kind, F.col(key))
    return rows.select(F.lit(kind).alias("kind"), node.alias("node"), edge_id(F.lit(focus), node).alias("edge"), label.cast("string").alias("label"))


def _capped(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


def document_neighbourhood(
    document: int,
    visible: DataFrame,
    document_case: DataFrame,
    document_tag: DataFrame,
    links: DataFrame,
    references: DataFrame,
    similar: DataFrame,
    limit: int = LIMIT,
) -> DataFrame:
    """Edges (kind, node, edge, label) of a visible document: contact, cases, tags, links, shared references, similarity.

    A linked document isn't shown again for a reference, and neither for similarity. At most `limit` edges per group; the
    other ends are visible documents. `similar` has document_id, score and comes from `similar_documents`.
    """
    focus, me = f"document:{document}", visible.filter(F.col("id") == document)
    mine = lambda bridge: bridge.filter(F.col("document_id") == document)
    seen = visible.select(F.col("id").alias("document_id"), "title", "document_date", "created_at", "id")
    contact = _edges(me.filter("correspondent IS NOT NULL"), focus, "contact", "contact", "correspondent", F.col("correspondent"))
    cases = _edges(_capped(mine(document_case).distinct(), [F.col("case_id").asc()], limit), focus, "case", "case", "case_id", F.col("case_id"))
    tags = mine(document_tag).select("name", "dimension").distinct().withColumn("key", F.concat_ws("/", "dimension", "name"))
    tagged = _edges(_capped(tags, [F.col("dimension").asc(), F.col("name").asc()], limit), focus, "tag", "tag", "key", F.col("name"))
    others = other_side(links, document).join(seen, "document_id")
    linked = _capped(others, default_order(), limit)
    matches = shared_matches(references, visible, document).join(others.select("document_id"), "document_id", "left_anti").join(seen, "document_id")
    shared = _capped(matches, default_order(), limit)
    near = similar.join(others.select("document_id").unionByName(matches.select("document_id")), "document_id", "left_anti")
    parts = [
        contact,
        cases,
        tagged,
        _edges(linked, focus, "link", "document", "document_id", F.col("title")),
        _edges(shared, focus, "reference", "document", "document_id", F.concat_ws(" ", "type", "value_normalized")),
        _edges(near, focus, "similar", "document", "document_id", F.format_number("score", 4)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def documents_of(node: str, ids: DataFrame, visible: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The newest visible documents of a case, tag or contact: (node, document_id, truncated)."""
    mine = visible.join(ids.select(F.col("document_id").alias("id")), "id", "left_semi")
    # One more than is shown tells whether some are left out.
    kept = top(mine, default_order(), limit + 1, rank="place").withColumn("last", F.max("place").over(Window.partitionBy()))
    return kept.filter(F.col("place") <= limit).select(F.lit(node).alias("node"), F.col("id").alias("document_id"), "place", (F.col("last") > limit).alias("truncated"))


def search_nodes(parts: dict[str, DataFrame], term: str, limit: int = 6) -> DataFrame:
    """At most `limit` nodes of each kind whose name contains the term. `parts`: kind -> (key, name)."""
    out = None
    for kind, rows in parts.items():
        found = rows.filter(F.lower("name").contains(term.lower())).select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), "name")
        found = found.orderBy("name", "key").limit(limit)
        out = found if out is None else out.unionByName(found)
    return out


def merge_nodes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two node lists (node, payload, position) as one: a node stays at its first place with its last payload."""
    both = first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1)))
    at = F.struct("part", "position")
    merged = both.groupBy("node").agg(F.max_by("payload", at).alias("payload"), F.min(at).alias("at")).select("node", "payload", "at.*")
    return numbered(merged, ["part", "position", "node"], "place").select("node", "payload", F.col("place").alias("position"))
