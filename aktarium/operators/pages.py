"""Pages of files: plans to rotate, delete and split them, and pages without text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, strip

PAGE_HEADING = r"(?md)^## Seite ([0-9]+)\s*$"
# What stands for a page without text, and for one that couldn't be read.
EMPTY_MARKS = ("_Kein Text erkannt._", "_Seite leer oder nicht lesbar._")
FAILED_MARK = "_Seite konnte technisch nicht verarbeitet werden._"


def page_groups(plans: DataFrame) -> DataFrame:
    """(document_id, page, rotation, part, place) of the pages that a plan keeps.

    `plans` has document_id, page_count, rotations map<int,int>, deletions array<int>, splits array<int>, in the numbers of
    the original. A part begins at a page with a mark; a mark on a deleted page moves to the next kept one; one before the
    first kept page says nothing.
    """
    # A narrow row for each page and each thing said of one, then one row a page: no row carries a whole plan.
    marks = ("there", "mark", "gone", "turn")
    row = lambda page, which, value: F.struct(page.cast("int").alias("page"), *((value.cast("int") if c == which else F.lit(None).cast("int")).alias(c) for c in marks))
    said = lambda column, which: F.transform(F.coalesce(column, F.array().cast("array<int>")), lambda p: row(p, which, F.lit(1)))
    turned = F.transform(F.coalesce(F.map_entries("rotations"), F.array().cast("array<struct<key: int, value: int>>")), lambda e: row(e["key"], "turn", e["value"]))
    every = F.concat(said(F.when(F.col("page_count") >= 1, F.sequence(F.lit(1), "page_count")), "there"), said(F.col("splits"), "mark"), said(F.col("deletions"), "gone"), turned)
    rows = plans.select("document_id", F.explode(every).alias("r")).select("document_id", "r.*").repartition("document_id")
    pages = rows.groupBy("document_id", "page").agg(*(F.max(c).alias(c) for c in marks)).filter("there = 1")
    in_order = Window.partitionBy("document_id").orderBy("page")
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    kept = pages.withColumn("marks", F.coalesce(F.sum("mark").over(upto), F.lit(0))).filter("gone IS NULL")
    changed = F.col("marks") != F.lag("marks").over(in_order)
    kept = kept.withColumn("part", F.sum(F.coalesce(changed, F.lit(False)).cast("int")).over(upto) + 1)
    place = F.row_number().over(Window.partitionBy("document_id", "part").orderBy("page"))
    return kept.select("document_id", "page", F.coalesce("turn", F.lit(0)).alias("rotation"), F.col("part").cast("int").alias("part"), place.alias("place"))


def split_parts(groups: DataFrame, docs: DataFrame) -> DataFrame:
    """A document for each part, with what parts inherit; documents left whole have none."""
    parts = groups.groupBy("document_id", "part").agg(F.sort_array(F.collect_list("page")).alias("pages"))
    several = parts.groupBy("document_id").count().filter("count > 1").select("document_id")
    inherited = docs.select(F.col("id").alias("document_id"), "title", "owner_id", "visibility", "direction", "sphere", "created_at")
    return parts.join(several, "document_id", "left_semi").join(inherited, "document_id")


def sections(docs: DataFrame, id_col: str = "id", text_col: str = "markdown") -> DataFrame:
    """(id, page, body) by the page headings of a markdown text, bodies without white space at their ends.

    A text without headings is page 1, without the line of its title; of headings with one number the last counts; an empty
    text has no pages.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    numbers, bodies = F.regexp_extract_all(text, F.lit(PAGE_HEADING), 1), F.split(text, PAGE_HEADING)
    several = F.arrays_zip(numbers.alias("page"), F.slice(bodies, F.lit(2), F.size(numbers)).alias("body"))
    titled = F.when(text.startswith("# "), F.when(text.contains("\n"), F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise("")).otherwise(text)
    whole = F.array(F.struct(F.lit("1").alias("page"), titled.alias("body")))
    rows = docs.filter(text != "").select(F.col(id_col).alias("id"), F.when(F.size(numbers) > 0, several).otherwise(whole).alias("all"))
    last = F.filter("all", lambda s, i: F.size("all") - F.array_position(F.transform(F.reverse("all"), lambda x: x["page"]), s["page"]) == i)
    repeated = F.size(F.array_distinct(F.transform("all", lambda s: s["page"]))) < F.size("all")
    rows = rows.select("id", F.explode(F.when(repeated, last).otherwise(F.col("all"))).alias("s"))
    return rows.select("id", F.col("s")["page"].cast("int").alias("page"), strip(F.col("s")["body"]).alias("body"))


def empty_pages(pages: DataFrame, enough: int = 20, counts: DataFrame | None = None) -> DataFrame:
    """Pages (id, page) with under `enough` characters besides the marks of pages without text; a page that failed isn't empty.

    `pages` are `sections`; with `counts` (id, page_count) pages without a section are empty, too, where the document has one.
    """
    bare = F.col("body")
    for mark in EMPTY_MARKS:
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    if counts is not None:
        there = counts.join(pages.select("id"), "id", "left_semi").filter("page_count >= 1")
        pages = there.select("id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page")).join(pages, ["id", "page"], "left").withColumn("body", F.coalesce("body", F.lit("")))
    return pages.filter((F.length(strip(bare)) < enough) & ~F.col("body").contains(FAILED_MARK)).select("id", "page")


def markdown_text(title: Column, texts: Column) -> Column:
    """The markdown of a file: its title, and the texts of its pages (an array), each under its heading if there are several."""
    said = lambda text: let(strip(F.coalesce(text, F.lit(""))), lambda x: F.when(x == "", EMPTY_MARKS[0]).otherwise(x))
    under = F.transform(texts, lambda text, k: F.concat(F.lit("## Seite "), (k + 1).cast("string"), F.lit("\n\n"), said(text)))
    body = F.when(F.size(texts) > 1, F.array_join(under, "\n\n")).otherwise(said(F.get(texts, F.lit(0))))
    return F.concat(strip(F.concat(F.lit("# "), title, F.lit("\n\n"), body)), F.lit("\n"))


def markdown_of_pages(pages: DataFrame) -> DataFrame:
    """(id, markdown) of pages (id, title, page, text), in order of their numbers."""
    rows = pages.groupBy("id").agg(F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("ps"))
    return rows.select("id", markdown_text(F.col("title"), F.transform("ps", lambda p: p["text"])).alias("markdown"))
