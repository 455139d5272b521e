"""Continuous ingest of folders and mailboxes: keyed state tells what is new, each micro-batch writes its own partition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.ingest import described, new_documents
from ..operators.mail import read_eml
from .dedup_state import first_and_repeats, keyed_state, write_batch


def _start(marked: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None) -> StreamingQuery:
    with keyed_state(marked.sparkSession):
        return marked.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def ingest_files(files: DataFrame, target: str, checkpoint: str, trigger: dict | None = None, known: DataFrame | None = None) -> StreamingQuery:
    """Append documents of new files to the Parquet table at `target`; files that repeat known bytes go to `target`_repeated.

    What was met before is keyed state in the checkpoint, so a batch costs its own files, however large the archive is;
    `known` (sha256, path) is what the archive has before the first batch. Contents aren't shuffled. A batch that is run again
    after a failure replaces its own partition (batch), so each file counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            new = batch.filter("kind = 'new'")
            write_batch(new_documents(new, "folder").join(new.select("sha256", "path"), "sha256"), number, target)
            write_batch(batch.filter("kind = 'repeat'").drop("kind"), number, f"{target}_repeated")
        finally:
            batch.unpersist()

    return _start(first_and_repeats(described(files), "sha256", known=known), write, checkpoint, trigger)


def ingest_mails(
    messages: DataFrame, target: str, checkpoint: str, trigger: dict | None = None, known: DataFrame | None = None, after: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Append the mails of a stream of raw messages (path, content) to the Parquet table at `target`: the first of each
    Message-ID, or of equal bytes where there is none. Repeats go to `target`_repeated, messages that can't be read to
    `target`_failed; neither holds up the others. `after` is called with each batch's new mails once they are written."""
    read = read_eml(messages)
    mails = read.withColumn("key", F.coalesce(F.when(F.col("message_id") != "", F.col("message_id")), F.concat(F.lit("sha256:"), "sha256")))

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            write_batch(batch.filter("ok AND kind = 'new'").drop("kind", "ok"), number, target)
            write_batch(batch.filter("ok AND kind = 'repeat'").select("key", "path", "sha256"), number, f"{target}_repeated")
            write_batch(batch.filter("NOT ok").select("key", "path", "sha256"), number, f"{target}_failed")
            if after:
                after(batch.filter("ok AND kind = 'new'"), number)
        finally:
            batch.unpersist()

    return _start(first_and_repeats(mails, "key", known=known), write, checkpoint, trigger)


def first_seen(events: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Rows of a stream whose key wasn't seen within the time that late rows may take; state stays bounded by that time."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts_by_day(events: DataFrame, time: str, kind: str, late: str = "1 day") -> DataFrame:
    """Rows per day and kind of a stream, once a day is closed (an extension: polling has no event time)."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window")["start"].alias("day"), kind, "n")


def for_each(rows: DataFrame, checkpoint: str, act: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run `act` on each micro-batch of what has come since last time, then stop: reminders, mails and the like."""
    return rows.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
