"""Whether a stored result still holds: what it was made from against what there is now."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import follow_up_bucket
from .ordering import chronology, default_order, top_of_each


def case_staleness(runs: DataFrame, document_case: DataFrame, visible: DataFrame) -> DataFrame:
    """(case_id, n_new, n_changed, is_stale): visible documents that the run hadn't considered, and considered ones that
    were changed after it. Considered documents that are gone don't count."""
    now = document_case.distinct().join(visible.select(F.col("id").alias("document_id"), "updated_at"), "document_id")
    considered = runs.select("case_id", "generated_at", F.explode("considered").alias("document_id")).distinct()
    j = now.join(runs.select("case_id").distinct(), "case_id").join(considered, ["case_id", "document_id"], "left")
    new, changed = F.col("generated_at").isNull(), F.col("updated_at") > F.col("generated_at")
    counted = j.groupBy("case_id").agg(F.count_if(new).alias("n_new"), F.count_if(F.coalesce(changed, F.lit(False))).alias("n_changed"))
    out = runs.select("case_id").join(counted, "case_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_new", "n_changed")})
    return out.withColumn("is_stale", (F.col("n_new") > 0) | (F.col("n_changed") > 0))


def document_staleness(docs: DataFrame, comments: DataFrame, runs: DataFrame) -> DataFrame:
    """(document_id, is_stale) of stored summaries (document_id, generated_at): the document or a comment is newer."""
    newest = comments.groupBy("document_id").agg(F.max("created_at").alias("commented_at"))
    j = runs.join(docs.select(F.col("id").alias("document_id"), "updated_at"), "document_id").join(newest, "document_id", "left")
    return j.select("document_id", (F.greatest("updated_at", "commented_at") > F.col("generated_at")).alias("is_stale"))


def case_basis(document_case: DataFrame, visible: DataFrame, most: int = 40) -> DataFrame:
    """Of each case the newest `most` visible documents, with their place in time (from 1)."""
    rows = document_case.distinct().join(visible.select("id", "document_date", "created_at"), F.col("document_id") == F.col("id")).drop("document_id")
    newest = top_of_each(rows, ["case_id"], default_order(), most)
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(*chronology()))
    return newest.select("case_id", F.col("id").alias("document_id"), place.cast("long").alias("place"))


def basis_fingerprint(document_case: DataFrame, visible: DataFrame, comments: DataFrame) -> DataFrame:
    """What a case's result is made from, to compare with later: the number of its documents, a digest of their ids (60 bits of
    each id's MD5, combined by exclusive or, so that no list of ids is kept), the newest change and comment."""
    rows = document_case.distinct().join(visible.select(F.col("id").alias("document_id"), "updated_at"), "document_id")
    said = comments.groupBy("document_id").agg(F.max("created_at").alias("commented_at"))
    j = rows.join(said, "document_id", "left")
    bits = F.conv(F.substring(F.md5(F.col("document_id").cast("string")), 1, 15), 16, 10).cast("long")
    return j.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(bits).alias("ids_digest"), F.max("updated_at").alias("changed_at"), F.max("commented_at").alias("commented_at"))


def comment_context(comments: DataFrame, today: str, most: int = 30) -> DataFrame:
    """(document_id, id, place, line) of the comments shown with a document: its newest `most`, and all with a date.

    In order of time; the author is named where a document has several, the follow-up where there is one.
    """
    newest = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("id")))
    authors = F.size(F.collect_set("author_id").over(Window.partitionBy("document_id")))
    rows = comments.withColumns({"_n": newest, "_authors": authors}).filter((F.col("_n") <= most) | F.col("follow_up_date").isNotNull())
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("created_at", "id"))
    parts = [
        F.date_format("created_at", "yyyy-MM-dd"),
        F.when(F.col("_authors") > 1, F.concat(F.lit("user "), F.col("author_id").cast("string"))),
        F.when(F.col("follow_up_date").isNotNull(), F.concat(follow_up_bucket(F.col("follow_up_date"), today), F.lit(" "), F.col("follow_up_date").cast("string"))),
        F.regexp_replace("body", r"\n+", " "),
    ]
    return rows.select("document_id", "id", place.cast("long").alias("place"), F.concat_ws(" | ", *parts).alias("line"))


def needs_vision(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages to read again: those whose fingerprint (file hash and prompt version) no stored run has."""
    return pages.withColumn("fingerprint", F.concat_ws(":", "sha256", "prompt_version")).join(done.select("document_id", "fingerprint"), ["document_id", "fingerprint"], "left_anti")


def missing_pages(pages: DataFrame, previews: DataFrame) -> DataFrame:
    """Pages (document_id, page) that have no picture yet."""
    return pages.select("document_id", "page").join(previews, ["document_id", "page"], "left_anti")
