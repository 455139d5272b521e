import imaplib

import pytest

from aktarium.sources import files
from aktarium.sources.mail_stream import ImapBox, MailReader, TableBox, mailbox_stream
from aktarium.streaming import dedup_state, ingest_stream

MESSAGES = "uid long, content binary"


def raw(number, message_id=None, text="body"):
    head = f"Message-ID: <{message_id}>\r\n" if message_id else ""
    return f"From: a@b.de\r\n{head}Content-Type: text/plain; charset=utf-8\r\n\r\n{text} {number}".encode()


def box_of(spark, folder, messages):
    spark.createDataFrame([(u, bytearray(c)) for u, c in messages], MESSAGES).coalesce(1).write.mode("append").parquet(f"{folder}/box")
    return {"table": f"{folder}/box", "marks": f"{folder}/marks"}


def run(spark, folder, options, fail=None, **more):
    """Take in what is there; `fail` is called with each batch's number once it's written."""

    def after(rows, number):
        if fail and fail(number):
            raise RuntimeError("killed")

    stream = mailbox_stream(spark, "aktarium.sources.mail_stream:TableBox", **options, **more)
    started = ingest_stream.ingest_mails(stream, f"{folder}/mails", f"{folder}/check", trigger={"processingTime": "0 seconds"}, after=after)
    try:
        started.processAllAvailable()
        return True
    except Exception as e:
        assert "killed" in str(e)
        return False
    finally:
        started.stop()


def taken(spark, folder, which=""):
    shape = "path string, key string, plain string" if not which else "path string, key string"
    return sorted((r.path, r.key) for r in dedup_state.read_batches(spark, f"{folder}/mails{which}", shape).collect())


def test_a_reader_killed_in_any_batch_loses_and_doubles_nothing(spark, tmp_path):
    folder = str(tmp_path)
    options = box_of(spark, folder, [(k, raw(k, f"{k % 7}@x")) for k in range(1, 13)])
    killed = set()

    def once(number):
        return number not in killed and not killed.add(number)

    restarts = 0
    while not run(spark, folder, options, fail=once, per_batch="4", per_task="2"):
        restarts += 1
    assert restarts == 3 == len(killed)
    assert taken(spark, folder) == sorted((f"mailbox:{k}", f"<{k % 7}@x>") for k in range(1, 8))
    assert taken(spark, folder, "_repeated") == sorted((f"mailbox:{k}", f"<{k % 7}@x>") for k in range(8, 13))
    # Later messages, one without an id twice, one that can't be read, one known from the first run.
    box_of(spark, folder, [(20, raw(0)), (21, raw(0)), (22, raw(22, "3@x")), (23, b"Content-Type: text/plain; charset=nowhere\r\n\r\n\xff")])
    assert run(spark, folder, options)
    assert len(taken(spark, folder)) + len(taken(spark, folder, "_failed")) == 9 and TableBox(options).uids(-1) == [*range(1, 13), 20, 21, 22, 23]
    assert [p for p, _ in taken(spark, folder, "_repeated")][-2:] == ["mailbox:8", "mailbox:9"] and {"mailbox:21", "mailbox:22"} <= {p for p, _ in taken(spark, folder, "_repeated")}
    assert TableBox(options).seen.get() >= 12


def test_seen_messages_are_skipped_at_the_first_start(spark, tmp_path):
    options = box_of(spark, str(tmp_path), [(k, raw(k)) for k in range(6)])
    TableBox(options).mark_seen(3)
    reader = MailReader(options | {"box": "aktarium.sources.mail_stream:TableBox", "per_batch": "1"})
    assert reader.initialOffset() == {"uid": 3} and reader.latestOffset() == {"uid": 4}
    (only,) = reader.partitions({"uid": 3}, {"uid": 4})
    assert [u for u, _, _ in reader.read(only)] == [4]
    reader.commit({"uid": 4})
    assert TableBox(options).first_unseen() == 5
    TableBox(options).mark_seen(2)
    assert TableBox(options).first_unseen() == 5
    TableBox(options).mark_seen(5)
    fresh = MailReader(options | {"box": "aktarium.sources.mail_stream:TableBox"})
    assert fresh.initialOffset() == {"uid": 5} and fresh.latestOffset() == {"uid": 5} and fresh.partitions({"uid": 5}, {"uid": 5}) == []


class Server:
    """What an IMAP connection does, for the calls that are used."""

    messages = {3: b"three", 5: b"five", 9: b"nine"}
    seen = {3}

    def __init__(self, host, port):
        assert (host, port) == ("mail.example.org", 993)

    def login(self, user, password):
        assert (user, password) == ("u", "p")

    def select(self, folder):
        assert folder == "INBOX"

    def logout(self):
        pass

    def uid(self, command, *args):
        if command == "SEARCH":
            if args == ("UNSEEN",):
                found = [u for u in self.messages if u not in self.seen]
            else:
                low, high = args[1].split(":")
                found = [u for u in self.messages if u >= int(low) and (high == "*" or u <= int(high))] or ([max(self.messages)] if high == "*" else [])
            return "OK", [" ".join(map(str, found)).encode()]
        if command == "FETCH":
            found = self.messages.get(int(args[0]))
            return "OK", [(b"head", found)] if found else [None]
        type(self).seen = self.seen | {int(u) for u in args[0].split(",")}
        return "OK", []


def test_a_table_of_messages_is_fetched_by_few_tasks(spark, tmp_path, monkeypatch):
    """Each task opens the table and reads whole row groups: as many tasks as for a server would read them over and over."""
    options = box_of(spark, tmp_path, [(k, raw(k)) for k in range(1, 1001)])
    name = "aktarium.sources.mail_stream:TableBox"
    ranges = MailReader(options | {"box": name}).partitions({"uid": 0}, {"uid": 1000})
    assert [r.uids for r in ranges] == [[*range(1, 1001)]]
    assert [len(r.uids) for r in MailReader(options | {"box": name, "per_task": "300"}).partitions({"uid": 0}, {"uid": 1000})] == [300, 300, 300, 100]
    monkeypatch.delattr(TableBox, "PER_TASK")
    assert len(MailReader(options | {"box": name}).partitions({"uid": 0}, {"uid": 1000})) == 5


def test_state_has_no_more_partitions_than_cores(spark, tmp_path):
    """A partition of the state is a task of its own in each batch, so their number isn't that of the session's shuffles."""
    name = "spark.sql.shuffle.partitions"
    before, options = spark.conf.get(name), box_of(spark, tmp_path, [(k, raw(k, f"{k % 7}@x")) for k in range(1, 13)])
    spark.conf.set(name, "48")
    try:
        assert run(spark, tmp_path, options, per_batch="5") and spark.conf.get(name) == "48"
        with dedup_state.keyed_state(spark, partitions=9):
            assert spark.conf.get(name) == "9"
    finally:
        spark.conf.set(name, before)
    assert len([p for p in (tmp_path / "check/state/0").iterdir() if p.name.isdigit()]) == spark.sparkContext.defaultParallelism
    assert (len(taken(spark, tmp_path)), len(taken(spark, tmp_path, "_repeated"))) == (7, 5)


def test_imap(monkeypatch):
    monkeypatch.setattr(imaplib, "IMAP4_SSL", Server)
    monkeypatch.setenv("MAIL_PASSWORD", "p")
    options = {"host": "mail.example.org", "user": "u", "password_env": "MAIL_PASSWORD"}
    box = ImapBox(options)
    assert box.first_unseen() == 5 and box.uids(3) == [5, 9] and box.uids(9) == [] and box.uids(0, 5) == [3, 5]
    assert list(box.read([5, 7, 9])) == [(5, b"five"), (9, b"nine")]
    ImapBox(options).mark_seen(5)
    assert Server.seen == {3, 5} and ImapBox(options).first_unseen() == 9


def test_files_are_moved_and_known_hashes_are_repeats(spark, tmp_path):
    box, target, done = tmp_path / "in", str(tmp_path / "docs"), tmp_path / "done"
    box.mkdir()
    known = spark.createDataFrame([("2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824", "old/hello.txt")], "sha256 string, path string")

    def take(**how):
        ingest_stream.ingest_files(files.folder_stream(spark, str(box), processed=str(done)), target, str(tmp_path / "check"), **how).awaitTermination()

    (box / "a.txt").write_text("hello")
    (box / "b.txt").write_text("other")
    take(known=known)
    assert [r.title for r in spark.read.parquet(target).collect()] == ["b"]
    assert [r.name for r in spark.read.parquet(f"{target}_repeated").collect()] == ["a.txt"]
    (box / "c.txt").write_text("other")
    take(known=known)
    take(known=known)
    assert [r.title for r in spark.read.parquet(target).collect()] == ["b"]
    documents = spark.read.parquet(target)
    met = dedup_state.occurrences(documents.select("sha256", "path"), spark.read.parquet(f"{target}_repeated")).collect()
    assert [(r.name, r["first"].rpartition("/")[2]) for r in met] == [("c.txt", "b.txt")]
    assert sorted(p.name for p in done.rglob("*.txt"))[:2] == ["a.txt", "b.txt"] and not (box / "a.txt").exists()


@pytest.mark.parametrize("rows", [[("k", "b"), ("k", "a"), ("k", "c"), ("l", "z")]])
def test_state_without_spark(rows):
    from pyspark.sql import Row

    class Value:
        def __init__(self):
            self.held = None

        def exists(self):
            return self.held is not None

        def update(self, v):
            self.held = v

    shape = Row("key", "path")
    p = dedup_state.FirstSeen("path", ["key", "path"], "kind")
    p.first = Value()
    got = [tuple(r) for r in p.handleInputRows(("k",), iter([shape(*r) for r in rows[:3]]), None)]
    assert got == [("k", "b", "repeat"), ("k", "c", "repeat"), ("k", "a", "new")] and p.first.held == ("a",)
    assert [tuple(r) for r in p.handleInputRows(("k",), iter([shape("k", "A")]), None)] == [("k", "A", "repeat")]
