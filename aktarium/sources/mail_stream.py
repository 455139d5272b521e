"""Mailboxes as streaming sources: offsets are message numbers, executors fetch, messages are marked seen once a batch is done."""

from __future__ import annotations

import imaplib
import importlib
import re
from collections.abc import Iterator, Mapping, Sequence
from typing import Protocol

import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Messages that one task fetches, and messages of a batch, unless options (or the box's own PER_TASK) say so.
PER_TASK, PER_BATCH = 200, 5000
SHAPE = "uid long, path string, content binary"


class Box(Protocol):
    """A mailbox whose messages have numbers that only grow. It is made from options, on the driver and in each task."""

    def __init__(self, options: Mapping[str, str]) -> None: ...

    def first_unseen(self) -> int | None: ...

    def uids(self, after: int, upto: int | None = None) -> list[int]:
        """Numbers of the messages there, seen or not, ascending."""
        ...

    def read(self, uids: Sequence[int]) -> Iterator[tuple[int, bytes]]: ...

    def mark_seen(self, upto: int) -> None: ...


class MessageRange(InputPartition):
    def __init__(self, uids: list[int]):
        self.uids = uids


class Mark:
    """A number kept in a file of a store that pyarrow writes; -1 where there is none."""

    def __init__(self, folder: str, name: str):
        self.store, self.folder = pyarrow.fs.FileSystem.from_uri(_uri(folder))
        self.path = f"{self.folder}/{name}"

    def get(self) -> int:
        if self.store.get_file_info(self.path).type == pyarrow.fs.FileType.NotFound:
            return -1
        with self.store.open_input_stream(self.path) as f:
            return int(f.read() or b"-1")

    def set(self, value: int) -> None:
        self.store.create_dir(self.folder, recursive=True)
        with self.store.open_output_stream(self.path) as f:
            f.write(str(value).encode())


class MailReader(DataSourceStreamReader):
    """Batches of messages. A batch that is run again, after any failure, has the same messages: those between its two offsets
    that the box still has. What is seen isn't skipped there, as the marks follow the batches and may be behind.

    Spark asks for the end of a batch without saying where it begins. So with the option `marks`, a folder, the end of each
    planned batch is kept there; without it the first batch after a start has all that is there.
    """

    def __init__(self, options: Mapping[str, str]):
        self.options = dict(options)
        self.per_task, self.per_batch = int(options.get("per_task", 0)), int(options.get("per_batch", PER_BATCH))
        self.position: int | None = None  # unknown after a start, until a batch is planned
        self.planned = Mark(options["marks"], "planned") if "marks" in options else None

    def _box(self) -> Box:
        module, _, name = self.options["box"].partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        box = self._box()
        first = box.first_unseen()
        return {"uid": (max(box.uids(-1), default=-1) if first is None else first - 1)}

    def latestOffset(self) -> dict:  # noqa: N802
        begin = self.position
        if begin is None and self.planned:
            begin = self.planned.get()
            begin = self.initialOffset()["uid"] if begin < 0 else begin
        there = self._box().uids(-1 if begin is None else begin)
        return {"uid": max(there if begin is None else there[: self.per_batch], default=-1 if begin is None else begin)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        box = self._box()
        uids = box.uids(start["uid"], end["uid"]) if end["uid"] > start["uid"] else []
        self.position = max(start["uid"], end["uid"])
        if self.planned:
            self.planned.set(self.position)
        size = self.per_task or getattr(box, "PER_TASK", PER_TASK)
        return [MessageRange(uids[k : k + size]) for k in range(0, len(uids), size)]

    def read(self, partition: MessageRange) -> Iterator[tuple[int, str, bytes]]:
        for uid, raw in self._box().read(partition.uids):
            yield uid, f"mailbox:{uid}", raw

    def commit(self, end: dict) -> None:
        self._box().mark_seen(end["uid"])


class MailSource(DataSource):
    """`readStream.format("mailbox")`; the option `box` names a class as module:name, others go to it."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SHAPE

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return MailReader(self.options)


def mailbox_stream(spark: SparkSession, box: str, **options: str) -> DataFrame:
    """(uid, path, content) of the messages of a box as a stream."""
    spark.dataSource.register(MailSource)
    return spark.readStream.format("mailbox").options(box=box, **options).load()


class TableBox:
    """A mailbox kept as a Parquet table of (uid long, content binary) in a store that pyarrow reads: an exported box. Options:
    `table`, and `marks`, where the number of the last seen message is kept too.

    A task opens the table and reads whole row groups, so it takes many messages; files are best written in the order of `uid`
    with row groups of about ROW_GROUP bytes, of which a task reads its own alone.
    """

    PER_TASK, ROW_GROUP = 5000, 2 << 20

    def __init__(self, options: Mapping[str, str]):
        store, where = pyarrow.fs.FileSystem.from_uri(_uri(options["table"]))
        self.rows = ds.dataset(where, filesystem=store, format="parquet")
        self.seen = Mark(options["marks"], "seen")

    def first_unseen(self) -> int | None:
        return min(self.uids(self.seen.get()), default=None)

    def uids(self, after: int, upto: int | None = None) -> list[int]:
        chosen = ds.field("uid") > after
        if upto is not None:
            chosen &= ds.field("uid") <= upto
        return sorted(self.rows.to_table(columns=["uid"], filter=chosen).column("uid").to_pylist())

    def read(self, uids: Sequence[int]) -> Iterator[tuple[int, bytes]]:
        if uids:
            wanted = set(uids)
            for b in self.rows.to_batches(filter=(ds.field("uid") >= min(uids)) & (ds.field("uid") <= max(uids))):
                yield from ((u, c) for u, c in zip(b.column("uid").to_pylist(), b.column("content").to_pylist(), strict=True) if u in wanted)

    def mark_seen(self, upto: int) -> None:
        if upto > self.seen.get():
            self.seen.set(upto)


def _uri(path: str) -> str:
    path = re.sub("^file:/+", "/", path)
    return path if re.match(r"[a-z0-9+.-]+:", path) else f"file://{path}"


class ImapBox:
    """A folder of an IMAP server. Options: host, port, user, folder, `ssl` (true), and password or password_env, the name of
    the variable that holds it. Fetching doesn't mark as seen; a message that is gone is left out."""

    def __init__(self, options: Mapping[str, str]):
        import os

        kind = imaplib.IMAP4_SSL if options.get("ssl", "true") == "true" else imaplib.IMAP4
        password = options.get("password") or os.environ[options["password_env"]]
        self.connection = kind(options["host"], int(options.get("port", "993")))
        self.connection.login(options["user"], password)
        self.connection.select(options.get("folder", "INBOX"))

    def _search(self, *criteria: str) -> list[int]:
        status, data = self.connection.uid("SEARCH", *criteria)
        if status != "OK":
            raise OSError(f"the mailbox refused a search: {status}")
        return sorted(int(x) for x in (data[0] or b"").split())

    def first_unseen(self) -> int | None:
        return min(self._search("UNSEEN"), default=None)

    def uids(self, after: int, upto: int | None = None) -> list[int]:
        # `n:*` has the last message even if its number is below n.
        return [u for u in self._search("UID", f"{max(1, after + 1)}:{'*' if upto is None else upto}") if u > after and (upto is None or u <= upto)]

    def read(self, uids: Sequence[int]) -> Iterator[tuple[int, bytes]]:
        try:
            for uid in uids:
                status, data = self.connection.uid("FETCH", str(uid), "(BODY.PEEK[])")
                if status != "OK":
                    raise OSError(f"the mailbox refused message {uid}: {status}")
                if data and isinstance(data[0], tuple):
                    yield uid, data[0][1]
        finally:
            self.connection.logout()

    def mark_seen(self, upto: int) -> None:
        unseen = [u for u in self._search("UNSEEN") if u <= upto]
        for k in range(0, len(unseen), 500):
            self.connection.uid("STORE", ",".join(map(str, unseen[k : k + 500])), "+FLAGS", "(\\Seen)")
