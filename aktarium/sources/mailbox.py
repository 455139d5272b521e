"""Mailboxes as sources: anything that yields raw messages, and the rows they become."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Mailbox(Protocol):
    """A mailbox adapter: unseen messages as (key, raw bytes), and a way to mark them as taken in."""

    def unseen(self) -> Iterable[tuple[str, bytes]]: ...

    def mark_seen(self, keys: Iterable[str]) -> None: ...


def fetch(spark: SparkSession, mailbox: Mailbox) -> DataFrame:
    """(path, content) of the unseen messages. Mark them seen only after what they became is written: at least once each."""
    rows = [(f"mailbox:{key}", bytearray(raw)) for key, raw in mailbox.unseen()]
    return spark.createDataFrame(rows, "path string, content binary")


def from_json_messages(messages: DataFrame) -> DataFrame:
    """Messages of a mail service's JSON (column `json`): id, subject, sender, attachments of real files, decoded.

    The service's own id stands where others have the Message-ID, so such a mail is never taken for an `.eml` of the same.
    """
    files = "array<struct<`@odata.type` string, name string, contentType string, contentId string, isInline boolean, contentBytes string>>"
    shape = f"id string, subject string, `from` struct<emailAddress: struct<address: string, name: string>>, attachments {files}"
    m = messages.select(F.from_json("json", shape).alias("m")).select("m.*")
    real = F.filter("attachments", lambda a: a["@odata.type"].contains("fileAttachment"))
    decoded = F.transform(real, lambda a: F.struct(a["name"].alias("name"), a["contentType"].alias("content_type"), a["contentId"].alias("content_id"), F.coalesce(a["isInline"], F.lit(False)).alias("inline"), F.unbase64(a["contentBytes"]).alias("content")))
    return m.select(F.col("id").alias("message_id"), "subject", F.lower(F.col("from")["emailAddress"]["address"]).alias("sender"), F.coalesce(decoded, F.array()).alias("attachments"))
