"""Writing tables so that readers never see half of one, and sending mails."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from .models import with_retry


class MailBackend(Protocol):
    """A way to send mails; it's made on the workers, where credentials and connections belong."""

    def send(self, recipient: str, subject: str, text: str) -> None: ...


def send_mails(mails: DataFrame, make: Callable[[], MailBackend]) -> DataFrame:
    """Send mails (recipient, subject, text): recipient, subject and `error`, null where it was sent.

    The result is lazy, as all frames are: write it, once. A task that is run again sends again (at least once each).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = make()
        for b in batches:
            errors = []
            for m in b.to_pylist():
                try:
                    with_retry(lambda m=m: backend.send(m["recipient"], m["subject"], m["text"]))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  backends are plugged in; a failed mail fails alone
                    errors.append(type(e).__name__)
            yield pa.record_batch([b.column("recipient"), b.column("subject"), pa.array(errors, pa.string())], ["recipient", "subject", "error"])

    return mails.select("recipient", "subject", "text").mapInArrow(run, "recipient string, subject string, error string")


def replace_table(df: DataFrame, path: str) -> None:
    """Write `df` beside the table at `path`, then move it into place; on failure the old table stays."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.fresh", f"{path}.old"))
    fs = target.getFileSystem(conf)
    df.write.mode("overwrite").parquet(f"{path}.fresh")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(fresh, target):
        fs.rename(old, target)
        raise OSError(f"{path} couldn't be replaced")
    fs.delete(old, True)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write `df` over those partitions of the table at `path` that it has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
