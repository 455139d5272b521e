"""Matching documents, cases and contacts by exact reference numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.references import scope_of_type
from ..schema import STRONG_REFERENCES
from .ordering import default_order, first_of_each, top_of_each

KEY = ["type", "value_normalized"]


def shared_groups(references: DataFrame, visible: DataFrame, document: int, limit: int = 20) -> DataFrame:
    """For each reference of a document the other visible ones that hold it, newest first, at most `limit`, with the total."""
    own = references.filter(F.col("document_id") == document).select(F.col("id").alias("reference_id"), *KEY)
    others = references.filter(F.col("document_id") != document).select("document_id", *KEY).distinct().join(own, KEY)
    dated = others.join(visible.select(F.col("id").alias("document_id"), "document_date", "created_at"), "document_id")
    kept = top_of_each(dated.withColumn("id", F.col("document_id")), ["reference_id"], default_order(), limit, total="n_total")
    return kept.select("reference_id", *KEY, "document_id", "n_total", (F.col("n_total") > limit).alias("truncated"))


def shared_matches(references: DataFrame, visible: DataFrame, document: int) -> DataFrame:
    """Each other visible document once, with the first reference (by type, value) that it shares."""
    own = references.filter(F.col("document_id") == document).select(*KEY).distinct()
    others = references.filter(F.col("document_id") != document).join(own, KEY, "left_semi").join(visible.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return first_of_each(others.select("document_id", *KEY), ["document_id"], [F.col(c).asc() for c in KEY])


def holding(references: DataFrame, visible: DataFrame, kind: str, key: str) -> DataFrame:
    """Visible documents that hold a given reference."""
    found = references.filter((F.col("type") == kind) & (F.col("value_normalized") == key)).select(F.col("document_id").alias("id"))
    return visible.join(found, "id", "left_semi")


def shared_keys(references: DataFrame) -> DataFrame:
    """(type, value_normalized, document_id, n_documents) of the references that two documents or more hold: one row for
    each holder, not one for each pair of them."""
    held = references.select("document_id", *KEY).distinct()
    counts = held.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_documents")).filter("n_documents > 1")
    return held.join(counts, KEY)


def learn(existing: DataFrame, references: DataFrame, targets: DataFrame, scope: str) -> DataFrame:
    """Owner references after documents were assigned: (owner_id, type, value_normalized, source, learned_from).

    Each reference of the scope is copied to its document's owners in `targets` (document_id, owner_id), unless the owner
    has it already: then it stays as it is, and one by hand is never taken for a learned one.
    """
    scoped = references.filter(scope_of_type(F.col("type")) == scope).join(targets, "document_id")
    fresh = scoped.select("owner_id", *KEY, F.lit("gelernt").alias("source"), F.col("document_id").alias("learned_from"))
    fresh = first_of_each(fresh, ["owner_id", *KEY], [F.col("learned_from").asc()])
    return existing.unionByName(fresh.join(existing, ["owner_id", *KEY], "left_anti").select(*existing.columns))


def record_by_hand(existing: DataFrame, manual: DataFrame) -> DataFrame:
    """`existing` after references were entered by hand: a learned one becomes one by hand, others are added."""
    keys = ["owner_id", *KEY]
    said = manual.select(*keys).distinct()
    upgraded = existing.join(said.withColumn("_m", F.lit(True)), keys, "left").withColumns(
        {"source": F.when(F.col("_m"), "manuell").otherwise(F.col("source")), "learned_from": F.when(F.col("_m"), F.lit(None)).otherwise(F.col("learned_from"))}
    )
    added = said.join(existing, keys, "left_anti").withColumns({"source": F.lit("manuell"), "learned_from": F.lit(None).cast("long")})
    return upgraded.select(*existing.columns).unionByName(added.select(*existing.columns))


def suggestions(references: DataFrame, owners: DataFrame, assigned: DataFrame, scope: str) -> DataFrame:
    """Owners that a document's references point to: document_id, owner_id, type, value_normalized, strong.

    `owners` are the owner references that the user may use, `assigned` (document_id, owner_id) is what is already set: an
    owner that is set isn't suggested, and contacts aren't for a document that has one. Of several matches the first reference
    (by type, value, id) decides, also on whether the suggestion is strong.
    """
    mine = references.filter(scope_of_type(F.col("type")) == scope)
    if scope == "kontakt":
        mine = mine.join(assigned.select("document_id"), "document_id", "left_anti")
    found = mine.select("id", "document_id", *KEY).join(owners.select("owner_id", *KEY).distinct(), KEY)
    found = found.join(assigned.select("document_id", "owner_id"), ["document_id", "owner_id"], "left_anti")
    first = first_of_each(found, ["document_id", "owner_id"], [*(F.col(c).asc() for c in KEY), F.col("id").asc()])
    return first.select("document_id", "owner_id", *KEY, F.col("type").isin(*STRONG_REFERENCES).alias("strong"))


def auto_assign(suggested: DataFrame) -> DataFrame:
    """Documents whose strong suggestions name exactly one owner, and that owner."""
    strong = suggested.filter("strong").groupBy("document_id").agg(F.count_distinct("owner_id").alias("n"), F.min("owner_id").alias("owner_id"))
    return strong.filter("n = 1").drop("n")


def replace_machine_references(existing: DataFrame, found: DataFrame, most: int = 12) -> DataFrame:
    """A document's references after an analysis: those by hand, then what was found, each key once, at most `most` found.

    `found` has document_id, type, value_raw, value_normalized, position. Keys by hand are taken first.
    """
    manual = existing.filter("source = 'manuell'")
    fresh = found.filter("value_normalized <> ''").join(manual, ["document_id", *KEY], "left_anti")
    fresh = first_of_each(fresh, ["document_id", *KEY], [F.col("position").asc()])
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("position"))
    fresh = fresh.withColumn("_p", place).filter(F.col("_p") <= most).withColumn("source", F.lit("ki"))
    columns = ["document_id", *KEY, "source"]
    return manual.select(*columns).unionByName(fresh.select(*columns))


def canonical_links(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Undirected links as (document_a < document_b), each once, none to itself."""
    a, b = F.least(x, y), F.greatest(x, y)
    return pairs.filter(F.col(x) != F.col(y)).select(a.alias("document_a"), b.alias("document_b")).distinct()


def other_side(links: DataFrame, document: int | Column) -> DataFrame:
    """(document_id) at the other end of a document's links."""
    this = F.lit(document) if isinstance(document, int) else document
    ends = links.filter((F.col("document_a") == this) | (F.col("document_b") == this))
    return ends.select(F.when(F.col("document_a") == this, F.col("document_b")).otherwise(F.col("document_a")).alias("document_id")).distinct()
