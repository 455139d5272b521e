"""Combinable filters of lists and searches. A blank value is no filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import week_end
from ..schema import TAX_DEDUCTIBLE, TAX_DEDUCTIBLE_FILTER, TAX_RELEVANCE


def contains(value: Column, part: str) -> Column:
    """Whether `value` contains `part`, whatever the case; no character is a wildcard."""
    return F.lower(value).contains(part.lower())


def same_text(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def tax_filter(value: str | None) -> Column | None:
    """The deductible pseudo value stands for two; another valid value for itself; others for no filter."""
    value = (value or "").strip()
    if value == TAX_DEDUCTIBLE_FILTER:
        return F.col("tax_relevance").isin(*TAX_DEDUCTIBLE)
    return F.col("tax_relevance") == value if value in TAX_RELEVANCE else None


def filter_documents(
    docs: DataFrame,
    *,
    correspondent: str = "",
    status: str = "",
    direction: str = "",
    sphere: str = "",
    tax: str = "",
    action: str = "",
    case: tuple[DataFrame, int] | None = None,
    tags: tuple[DataFrame, Sequence[str]] | None = None,
    created_from: str | None = None,
    created_to: str | None = None,
) -> DataFrame:
    """All given filters. `case` and `tags` come with their bridges: any of several tags suffices, and rows stay single,
    as bridges are only semi-joined. The dates bound the day of creation, both inclusive."""
    for column, value in (("correspondent", correspondent), ("processing_status", status), ("direction", direction), ("sphere", sphere), ("action_status", action)):
        if value:
            docs = docs.filter(F.col(column) == value)
    if (wanted := tax_filter(tax)) is not None:
        docs = docs.filter(wanted)
    if created_from:
        docs = docs.filter(F.to_date("created_at") >= F.lit(created_from).cast("date"))
    if created_to:
        docs = docs.filter(F.to_date("created_at") <= F.lit(created_to).cast("date"))
    if case:
        docs = docs.join(case[0].filter(F.col("case_id") == case[1]).select(F.col("document_id").alias("id")), "id", "left_semi")
    if tags:
        docs = docs.join(tags[0].filter(F.col("name").isin(*tags[1])).select(F.col("document_id").alias("id")), "id", "left_semi")
    return docs


def with_due_follow_up(docs: DataFrame, comments: DataFrame, today: str) -> DataFrame:
    """Documents with a comment that is due by `today`."""
    due = comments.filter(F.col("follow_up_date") <= F.lit(today).cast("date")).select(F.col("document_id").alias("id"))
    return docs.join(due, "id", "left_semi")


def due_flag(docs: DataFrame, comments: DataFrame, today: str) -> DataFrame:
    """Each document with `is_due`: whether it has a comment that is due."""
    due = comments.filter(F.col("follow_up_date") <= F.lit(today).cast("date")).select(F.col("document_id").alias("id")).distinct()
    return docs.join(due.withColumn("is_due", F.lit(True)), "id", "left").withColumn("is_due", F.coalesce("is_due", F.lit(False)))


def message_documents(docs: DataFrame, message_id: str) -> DataFrame:
    return docs.filter(F.get_json_object("metadata", "$.message_id") == message_id)


def to_reanalyse(docs: DataFrame, mode: str, ids: Sequence[int] = (), since: str | None = None) -> DataFrame:
    """Documents with a text to analyse again: by ids, `failed` ones (an error in the metadata, or no summary), or `all`."""
    if mode == "ids":
        return docs.filter(F.col("id").isin(*ids))
    docs = docs.filter(F.col("text_content") != "")
    if mode == "failed":
        docs = docs.filter(F.get_json_object("metadata", "$.analysis_error").isNotNull() | (F.col("summary") == ""))
    elif mode != "all":
        raise ValueError("mode is one of ids, failed, all")
    return docs.filter(F.to_date("created_at") >= F.lit(since).cast("date")) if since else docs


def to_reindex(docs: DataFrame, ids: Sequence[int] = ()) -> DataFrame:
    return docs.filter(F.col("id").isin(*ids)) if ids else docs.filter(F.col("text_content") != "")


def due_tasks(tasks: DataFrame, which: str, today: str) -> DataFrame:
    """Tasks that are overdue and open, due within a week from today on (both ends, any status), or have no date."""
    day = F.lit(today).cast("date")
    wanted = {
        "overdue": (F.col("due_date") < day) & (F.col("status") == "offen"),
        "week": F.col("due_date").between(day, F.date_add(day, 7)),
        "none": F.col("due_date").isNull(),
    }
    return tasks.filter(wanted[which])


def follow_ups(comments: DataFrame, window: str, today: str) -> DataFrame:
    """Comments by follow-up window: due, overdue, today, this_week (tomorrow to Sunday), later (after Sunday), pending."""
    date, day = F.col("follow_up_date"), F.lit(today).cast("date")
    wanted = {
        "due": date <= day,
        "overdue": date < day,
        "today": date == day,
        "this_week": (date > day) & (date <= week_end(day)),
        "later": date > week_end(day),
        "pending": (date <= day) & F.col("remind") & F.col("reminded_at").isNull(),
    }
    return comments.filter(wanted[window])


def search_text(rows: DataFrame, columns: Sequence[str], part: str) -> DataFrame:
    """Rows that contain `part` in any of several text columns."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(contains(F.col(c), part), F.lit(False))
    return rows.filter(found)
