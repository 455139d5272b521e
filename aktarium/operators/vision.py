"""Runs that read the pages of files again by a model: which pages are due, and what their outcomes make of a document.

Outcomes are kept page by page. So a run that was cut off by its cap or by a fault goes on with the pages that are missing, and
no page is paid for twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_code_fence, strip_controls
from .ordering import top_of_each
from .pages import FAILED_MARK, markdown_text

#: Pages of a document that one run reads.
MOST_PAGES = 20


def fingerprint() -> Column:
    """The file's hash and the prompt's version: what a result belongs to. Another model alone makes none stale."""
    return F.concat_ws(":", "sha256", "prompt_version")


def due_pages(docs: DataFrame, outcomes: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """(document_id, fingerprint, page) of the pages to read now: of each document the first `most` that have no good outcome
    yet; none of a document whose stored fingerprint is that of a complete run.

    `docs` has document_id, sha256, prompt_version, page_count, vision_fingerprint; `outcomes` has document_id, fingerprint,
    page, text, error. Only numbers of pages are shuffled.
    """
    stale = docs.withColumn("fingerprint", fingerprint()).filter(~F.col("fingerprint").eqNullSafe(F.col("vision_fingerprint")) & (F.col("page_count") >= 1))
    pages = stale.select("document_id", "fingerprint", F.explode(F.sequence(F.lit(1), "page_count")).alias("page"))
    good = outcomes.filter("error IS NULL").select("document_id", "fingerprint", "page")
    return top_of_each(pages.join(good, ["document_id", "fingerprint", "page"], "left_anti"), ["document_id"], [F.col("page").asc()], most)


def fold_runs(docs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What a document is after its runs, for those with an outcome of their present fingerprint: document_id, status, error,
    text, pages_processed, pages_failed, pages_total, truncated, vision_fingerprint.

    Of a page's outcomes a good one counts. A page that failed has a mark in its place and spoils no other; if all did, the
    run has failed with the last page's error, and the text stays what it was (`docs.text`). The fingerprint is set only if all
    pages were read, so that anything else is read on.
    """
    now = docs.withColumn("fingerprint", fingerprint())
    said = F.struct(F.col("error").isNull().alias("good"), "text", "error")
    one = outcomes.join(now.select("document_id", "fingerprint"), ["document_id", "fingerprint"], "left_semi").groupBy("document_id", "page").agg(F.max(said).alias("o"))
    text = F.when(F.col("o.good"), strip_code_fence(F.col("o.text"))).otherwise(FAILED_MARK)
    runs = one.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("o.good")).alias("bad"), F.max_by("o.error", "page").alias("last"),
        F.array_sort(F.collect_list(F.struct("page", text.alias("text")))).alias("ps"),
    )
    failed, whole = F.col("bad") == F.col("n"), (F.col("bad") == 0) & (F.col("n") == F.col("page_count"))
    made = strip_controls(markdown_text(F.col("title"), F.transform("ps", lambda p: p["text"])))
    return now.join(runs, "document_id").select(
        "document_id", F.when(failed, "failed").otherwise("ready").alias("status"), F.when(failed, F.col("last")).otherwise("").alias("error"),
        F.when(failed, F.col("text")).otherwise(made).alias("text"), F.col("n").alias("pages_processed"), F.col("bad").alias("pages_failed"), F.col("page_count").cast("long").alias("pages_total"),
        (F.col("n") < F.col("page_count")).alias("truncated"), F.when(~failed & whole, F.col("fingerprint")).otherwise("").alias("vision_fingerprint"),
    )
