"""Numbers of the dashboard, the indexes and the badges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FAILED, PENDING


def dashboard(visible: DataFrame) -> DataFrame:
    """All key figures in one pass: counts by status and the sum of the sizes in the metadata (null if there are none)."""
    size = F.get_json_object("metadata", "$.size").try_cast("long")
    status, action = F.col("processing_status"), F.col("action_status")
    return visible.agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.count_if(status == "ready").alias("n_ready"),
        F.count_if(status == FAILED).alias("n_failed"),
        F.count_if(status.isin(*PENDING)).alias("n_in_progress"),
        F.count_if(action == "offen").alias("n_open"),
        F.count_if(action == "erledigt").alias("n_done"),
        F.count_if(action == "keine").alias("n_no_action"),
        F.sum(size).alias("total_size"),
    )


def next_follow_ups(visible: DataFrame, comments: DataFrame, n: int = 6) -> DataFrame:
    """The next dated comments of visible documents that are still open."""
    rows = comments.filter("follow_up_date IS NOT NULL").join(visible.filter("action_status <> 'erledigt'").select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return rows.orderBy("follow_up_date", "created_at", "id").limit(n)


def case_index(cases: DataFrame, document_case: DataFrame, visible: DataFrame) -> DataFrame:
    """Every case with its number of visible documents and their last activity (0 and null without any)."""
    seen = document_case.distinct().join(visible.select(F.col("id").alias("document_id"), "created_at"), "document_id")
    numbers = seen.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("created_at").alias("last_activity"))
    joined = cases.join(numbers.withColumnRenamed("case_id", "id"), "id", "left")
    return joined.withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))


def contact_index(contacts: DataFrame, visible: DataFrame) -> DataFrame:
    """Every contact with its visible documents, by direction, and their last activity."""
    numbers = visible.groupBy(F.col("correspondent").alias("name")).agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.count_if(F.col("direction") == "eingang").alias("n_in"),
        F.count_if(F.col("direction") == "ausgang").alias("n_out"),
        F.max("created_at").alias("last_activity"),
    )
    joined = contacts.select("name").join(numbers, "name", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_documents", "n_in", "n_out")})


def tag_index(tags: DataFrame, document_tag: DataFrame, visible: DataFrame) -> DataFrame:
    """Every tag with its number of visible documents."""
    seen = document_tag.distinct().join(visible.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    numbers = seen.groupBy("name", "dimension").agg(F.count(F.lit(1)).alias("n_documents"))
    return tags.join(numbers, ["name", "dimension"], "left").withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))


def tags_by_dimension(index: DataFrame) -> DataFrame:
    """Of each dimension in the tag index its number of tags, its first tag by name, and its documents' tags in all. The tags
    themselves stay rows of the index, as a dimension may have any number of them."""
    return index.groupBy("dimension").agg(F.count(F.lit(1)).alias("n_tags"), F.min("name").alias("first"), F.sum("n_documents").alias("n_tagged"))


def contact_numbers(visible: DataFrame, task_document: DataFrame, visible_tasks: DataFrame) -> DataFrame:
    """For each contact its documents by direction and the distinct open tasks that its documents belong to.

    The two children are aggregated apart and joined after, so that they can't multiply each other.
    """
    docs = visible.groupBy(F.col("correspondent").alias("name")).agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("direction") == "eingang").alias("n_in"), F.count_if(F.col("direction") == "ausgang").alias("n_out")
    )
    open_tasks = visible_tasks.filter("status = 'offen'").select(F.col("id").alias("task_id"))
    pairs = task_document.join(open_tasks, "task_id", "left_semi").join(visible.select(F.col("id").alias("document_id"), F.col("correspondent").alias("name")), "document_id")
    tasks = pairs.select("name", "task_id").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_open_tasks"))
    return docs.join(tasks, "name", "left").withColumn("n_open_tasks", F.coalesce("n_open_tasks", F.lit(0)))


def badges(visible: DataFrame, comments: DataFrame, today: str) -> DataFrame:
    """Numbers beside the navigation: open actions, documents to review (children too), due follow-ups of open documents."""
    counted = visible.agg(F.count_if(F.col("action_status") == "offen").alias("n_open"), F.count_if(F.col("processing_status") == "ready").alias("n_review"))
    due = comments.filter(F.col("follow_up_date") <= F.lit(today).cast("date"))
    due = due.join(visible.filter("action_status <> 'erledigt'").select(F.col("id").alias("document_id")), "document_id", "left_semi")
    # Two single rows side by side.
    both = counted.withColumn("n_due", F.lit(0).cast("long")).unionByName(due.agg(F.count(F.lit(1)).alias("n_due")).select(F.lit(0).cast("long").alias("n_open"), F.lit(0).cast("long").alias("n_review"), "n_due"))
    return both.agg(*(F.sum(c).alias(c) for c in ("n_open", "n_review", "n_due")))


def open_suggestions(tag_suggestions: DataFrame, case_suggestions: DataFrame) -> DataFrame:
    """For each document the number of its pending suggestions of either sort."""
    both = tag_suggestions.select("document_id", "status").unionByName(case_suggestions.select("document_id", "status"))
    return both.filter("status = 'pending'").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_pending"))


def facet(index: DataFrame, part: str) -> DataFrame:
    """Entries of an index whose name contains `part` and that have a visible document at least."""
    return index.filter(F.lower("name").contains(part.lower()) & (F.col("n_documents") > 0))


def next_order(items: DataFrame, group: str, order: str = "order") -> DataFrame:
    """For each group the order value of its next item."""
    return items.groupBy(group).agg((F.coalesce(F.max(order), F.lit(0)) + 1).alias("next_order"))


def majority(rows: DataFrame, group: list[str], value: str, position: str) -> DataFrame:
    """For each group the most frequent value; of equally frequent ones the first that comes."""
    counted = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "first"))
    return counted.withColumn("_p", place).filter("_p = 1").drop("_p", "first")


def reminders(comments: DataFrame, users: DataFrame, today: str) -> DataFrame:
    """Pending reminders as one row per author with an address: the comments by date. `users` has id, email."""
    pending = comments.filter((F.col("follow_up_date") <= F.lit(today).cast("date")) & F.col("remind") & F.col("reminded_at").isNull())
    known = users.filter("email IS NOT NULL AND email <> ''").select(F.col("id").alias("author_id"), "email")
    rows = pending.join(known, "author_id")
    return rows.groupBy("author_id", "email").agg(F.array_sort(F.collect_list(F.struct("follow_up_date", "id", "document_id"))).alias("items"))


def reminder_mails(reminders: DataFrame) -> DataFrame:
    """(recipient, subject, text) of each author's reminders: a line for each comment, by date."""
    line = lambda x: F.concat(F.lit("- "), x["follow_up_date"].cast("string"), F.lit(" Dokument "), x["document_id"].cast("string"))
    subject = F.concat(F.size("items").cast("string"), F.lit(" Wiedervorlagen"))
    return reminders.select(F.col("email").alias("recipient"), subject.alias("subject"), F.array_join(F.transform("items", line), "\n").alias("text"))


def extraction_method(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """A file's method is that of its farthest page: text layer, then OCR, then vision."""
    rank = F.when(F.col("method") == "vision", 2).when(F.col("method") == "ocr", 1).otherwise(0)
    return pages.groupBy(key).agg(F.max_by("method", rank).alias("method"))


def mean_confidence(words: DataFrame, key: str) -> DataFrame:
    """Mean confidence of the words that have one (0 or more); 0 where none has."""
    return words.groupBy(key).agg(F.coalesce(F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))), F.lit(0.0)).alias("confidence"))


def usage_totals(calls: DataFrame, run: str) -> DataFrame:
    """Tokens of a run's model calls; a number that is missing counts as 0."""
    names = ("prompt_tokens", "completion_tokens", "image_tokens")
    return calls.groupBy(run).agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in names))
