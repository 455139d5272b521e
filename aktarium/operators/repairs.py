"""One-off repairs of older rows, as functions from a snapshot to the next one. Running one twice changes nothing more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_iso_date
from ..functions.text import split_tag


def split_crammed_tags(document_tag: DataFrame) -> DataFrame:
    """Tags of documents (document_id, name, dimension): 'Dimension:Value' is taken apart, and merged with the tag it then equals."""
    name, dimension = split_tag(F.col("name"), F.coalesce("dimension", F.lit("")))
    crammed = F.contains("name", F.lit(":"))
    apart = document_tag.withColumns({"_n": F.when(crammed, name).otherwise(F.col("name")), "_d": F.when(crammed, dimension).otherwise(F.col("dimension"))})
    return apart.select("document_id", F.col("_n").alias("name"), F.col("_d").alias("dimension")).distinct()


def finish_stuck_analyses(docs: DataFrame) -> DataFrame:
    """Documents left in the analysis: failed where the metadata holds an error (also a null one), else ready."""
    has_error = F.coalesce(F.array_contains(F.json_object_keys("metadata"), "analysis_error"), F.lit(False))
    stuck = F.col("processing_status") == "analyzing"
    return docs.withColumn("processing_status", F.when(stuck & has_error, "failed").when(stuck, "ready").otherwise(F.col("processing_status")))


def mark_machine_dates(docs: DataFrame) -> DataFrame:
    """Documents (document_date, date_source, key_facts map): an unmarked date that equals the one an analysis noted is marked so."""
    told = parse_iso_date(F.try_element_at("key_facts", F.lit("document_date")))
    unmarked = F.coalesce("date_source", F.lit("")) == ""
    return docs.withColumn("date_source", F.when(unmarked & (told == F.col("document_date")), "modell").otherwise(F.col("date_source")))


def confirm_all_ready(docs: DataFrame) -> DataFrame:
    """What was ready before people confirmed documents counts as confirmed."""
    return docs.withColumn("processing_status", F.when(F.col("processing_status") == "ready", "reviewed").otherwise(F.col("processing_status")))
