"""Rows with what is shown beside them, and the short lists that forms and prompts choose from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import default_order
from .references import other_side


def document_rows(docs: DataFrame, contacts: DataFrame, document_tag: DataFrame, document_case: DataFrame, cases: DataFrame) -> DataFrame:
    """Documents with their contact's data, their parent's title, and their tags and cases as sorted lists.

    Each n:n bridge becomes one row per document before it's joined, so that bridges can't multiply each other.
    """
    contact = contacts.select(F.col("name").alias("correspondent"), F.col("email").alias("contact_email"))
    parent = docs.select(F.col("id").alias("parent_id"), F.col("title").alias("parent_title"))
    tags = document_tag.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("tags"))
    named = document_case.join(cases.select(F.col("id").alias("case_id"), F.col("name").alias("case")), "case_id")
    of_cases = named.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_set("case")).alias("cases"))
    empty = F.array().cast("array<string>")
    out = docs.join(contact, "correspondent", "left").join(parent, "parent_id", "left").join(tags, "id", "left").join(of_cases, "id", "left")
    return out.withColumns({"tags": F.coalesce("tags", empty), "cases": F.coalesce("cases", empty)})


def in_rank_order(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of a ranked list (id, place), by place."""
    return docs.join(ranked, "id").orderBy("place")


def contacts_for_prompt(contacts: DataFrame, most: int = 200) -> DataFrame:
    """One's own identities first, then the others by name."""
    return contacts.orderBy(F.desc("is_self"), "name").limit(most)


def link_candidates(visible: DataFrame, links: DataFrame, document: int, most: int = 200) -> DataFrame:
    """The newest visible documents that a document isn't linked to yet, itself left out."""
    taken = other_side(links, document).select(F.col("document_id").alias("id"))
    return visible.join(taken, "id", "left_anti").filter(F.col("id") != document).orderBy(*default_order()).limit(most)


def own_comments(comments: DataFrame, user_id: int) -> DataFrame:
    """Comments that a user may change: those they wrote."""
    return comments.filter(F.col("author_id") == user_id)


def mark_reminded(comments: DataFrame, sent: DataFrame, at: str) -> DataFrame:
    """Comments after reminders (id) were sent."""
    j = comments.join(sent.select("id", F.lit(True).alias("_sent")), "id", "left")
    stamp = F.when(F.col("_sent"), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("reminded_at"))
    return j.withColumn("reminded_at", stamp).drop("_sent").select(*comments.columns)


def detach_children(docs: DataFrame, bridge: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, department rows, links) after children were made documents of their own.

    A child loses its parent, keeps a link to it, and gets owner, visibility and departments of it where it has none.
    """
    parent = docs.select(F.col("id").alias("parent_id"), F.col("owner_id").alias("_o"), F.col("visibility").alias("_v"))
    moved = docs.filter("parent_id IS NOT NULL").join(ids, "id", "left_semi").join(parent, "parent_id", "left")
    links = moved.select(F.least("id", "parent_id").alias("document_a"), F.greatest("id", "parent_id").alias("document_b")).distinct()
    bare = moved.select("id", "parent_id").join(bridge.select(F.col("document_id").alias("id")), "id", "left_anti")
    inherited = bare.join(bridge.select(F.col("document_id").alias("parent_id"), "department_id"), "parent_id").select(F.col("id").alias("document_id"), "department_id")
    freed = moved.withColumns({"owner_id": F.coalesce("owner_id", "_o"), "visibility": F.coalesce("visibility", "_v"), "parent_id": F.lit(None).cast("long")})
    rest = docs.join(moved.select("id"), "id", "left_anti")
    return rest.unionByName(freed.select(*docs.columns)), bridge.unionByName(inherited), links


def prompt_block(title: Column, date: Column, summary: Column, key_facts: Column, most: int = 600) -> Column:
    """A document in a prompt: title and date, the beginning of its summary, its facts by name; what is missing is left out."""
    facts = F.array_sort(F.map_entries(F.map_filter(key_facts, lambda k, v: F.coalesce(v, F.lit("")) != "")))
    said = F.transform(facts, lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
    head = F.concat(title, F.when(date.isNotNull(), F.concat(F.lit(" ("), date.cast("string"), F.lit(")"))).otherwise(""))
    short = F.when(F.trim(F.coalesce(summary, F.lit(""))) != "", F.substring(summary, 1, most))
    return F.concat_ws("\n", head, short, F.when(F.size(said) > 0, F.array_join(said, "\n")))


def newest_per_document(rows: DataFrame, by: str = "document_id", at: str = "created_at") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), F.desc("id")))
    return rows.withColumn("_p", place).filter("_p = 1").drop("_p")
