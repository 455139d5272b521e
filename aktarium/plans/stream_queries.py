"""Registered queries that run real streams: several micro-batches over given tables, and what they have written at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch, stored
from ..sources.mail_stream import TableBox, mailbox_stream
from ..streaming import dedup_state, ingest_stream
from .archive import Archive
from .archive_queries import query

#: Batches that the documents come in.
BATCHES = 3


@query(f"""SELECT * FROM (WITH f AS (SELECT id, sha256(text_content) AS sha256, id % {BATCHES} AS batch, lpad(CAST(id AS VARCHAR), 12, '0') AS path FROM doc),
  g AS (SELECT *, first_value(id) OVER w AS first, row_number() OVER w AS p FROM f WINDOW w AS (PARTITION BY sha256 ORDER BY batch, path))
  SELECT id, CAST(batch AS INTEGER) AS batch, first, p > 1 AS repeated FROM g)""")
def stream_first_seen(a: Archive) -> DataFrame:
    """Texts come in three times, a micro-batch each; keyed state tells which repeat one of the same batch or of an earlier."""
    source, target = scratch(a.spark), scratch(a.spark)
    files = stored(a.documents.select(F.lpad(F.col("id").cast("string"), 12, "0").alias("path"), F.sha2("text_content", 256).alias("sha256"), (F.col("id") % BATCHES).alias("b")))
    for b in range(BATCHES):
        # What has come since last time is one batch, however many files it is.
        files.filter(F.col("b") == b).drop("b").write.mode("append").parquet(f"{source}/in")
        marked = dedup_state.first_and_repeats(a.spark.readStream.schema("path string, sha256 string").parquet(f"{source}/in"), "sha256")
        with dedup_state.keyed_state(a.spark):
            run = marked.writeStream.foreachBatch(lambda b, n: dedup_state.write_batch(b, n, target)).option("checkpointLocation", f"{source}/check").trigger(availableNow=True).start()
        run.awaitTermination()
    found = dedup_state.read_batches(a.spark, target, "path string, sha256 string, kind string")
    firsts = found.filter("kind = 'new'").select("sha256", F.col("path").cast("long").alias("first"))
    return found.join(firsts, "sha256").select(F.col("path").cast("long").alias("id"), "batch", "first", (F.col("kind") == "repeat").alias("repeated"))


class Killed(Exception):
    """Stands for a driver that is lost."""


@query("""SELECT * FROM (WITH m AS (SELECT conv_id * 1000 + turn AS uid, '<' || (conv_id % 500) || '.' || turn || '@mail>' AS message_id, text FROM conversations)
  SELECT uid, message_id, text AS plain, p > 1 AS repeated FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY b, path) AS p FROM
    (SELECT *, (row_number() OVER (ORDER BY uid) - 1) // greatest(1, (count(*) OVER () + 3) // 4) AS b, 'mailbox:' || uid AS path FROM m)))""")
def stream_mailbox(a: Archive) -> DataFrame:
    """Conversations as the raw messages of a mailbox, in four batches; the reader is lost after writing one and before it is
    committed, and goes on from its checkpoint. Some messages come again under the same Message-ID."""
    box, marks, target, check = (scratch(a.spark) for _ in range(4))
    uid = F.col("conv_id") * 1000 + F.col("turn")
    head = F.concat(F.lit("From: a@example.org\r\nMessage-ID: <"), (F.col("conv_id") % 500).cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit("@mail>\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"))
    messages = a._table("conversations").select(uid.alias("uid"), F.encode(F.concat(head, "text"), "UTF-8").alias("content"))
    messages.repartitionByRange("uid").sortWithinPartitions("uid").write.option("parquet.block.size", TableBox.ROW_GROUP).parquet(box)
    n = a.spark.read.parquet(box).count()
    options = {"box": "aktarium.sources.mail_stream:TableBox", "table": box, "marks": marks, "per_batch": str(max(1, -(-n // 4)))}

    def lost(rows: DataFrame, number: int) -> None:
        if number == 1:
            raise Killed

    for broken in (True, False):
        stream = mailbox_stream(a.spark, **options)
        run = ingest_stream.ingest_mails(stream, target, check, trigger={"processingTime": "0 seconds"}, after=lost if broken else None)
        try:
            run.processAllAvailable()
        except Exception as e:
            if "Killed" not in str(e):
                raise
        finally:
            run.stop()
    mails = dedup_state.read_batches(a.spark, target, "path string, message_id string")
    repeats = dedup_state.read_batches(a.spark, f"{target}_repeated", "path string, key string")
    number = lambda: F.regexp_extract("path", "([0-9]+)$", 1).cast("long").alias("uid")
    found = mails.select(number(), "message_id", F.lit(False).alias("repeated")).unionByName(repeats.select(number(), F.col("key").alias("message_id"), F.lit(True).alias("repeated")))
    # Merged, as texts that compress well would be broadcast by the size of their files.
    return found.join(messages.select("uid", F.decode("content", "UTF-8").alias("raw")).hint("merge"), "uid").select("uid", "message_id", F.expr("substring(raw, position('\\r\\n\\r\\n' IN raw) + 4)").alias("plain"), "repeated")
