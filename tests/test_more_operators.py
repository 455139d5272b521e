from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from aktarium import session
from aktarium.functions import vectors
from aktarium.operators import bindings, chunking, classify, details, ingest, ordering, pages, stale
from aktarium.sources import models, readers, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_percent_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (0.5,), (0.745,)], "s double")
    assert [r[0] for r in df.select(vectors.score_percent(F.col("s"))).collect()] == [12, 14, 50, 74]


def test_counterparts_and_names(spark):
    df = spark.createDataFrame([(1, "ausgang"), (2, "intern"), (3, "eingang"), (4, "unbekannt")], "k int, d string")
    assert rows(df.select("k", classify.counterpart(F.col("d"), F.lit("s"), F.lit("r")))) == [(1, "r"), (2, None), (3, "s"), (4, "s")]
    assert df.select(classify.new_contact_name(F.lit("N"), F.lit("e@x"), F.lit(True))).first()[0] == "N <e@x>"
    assert rows(df.select("k", classify.reviewed_or_ready(F.when(F.col("k") == 1, "reviewed")))) == [(1, "reviewed"), (2, "ready"), (3, "ready"), (4, "ready")]


def test_parts_inherit(spark):
    groups = spark.createDataFrame([(1, 1, 0, 1, 1), (1, 2, 0, 2, 1), (2, 1, 0, 1, 1)], "document_id long, page int, rotation int, part int, place int")
    docs = spark.createDataFrame([(1, "T", 5, "private", "eingang", "privat", datetime(2024, 1, 1)), (2, "U", 6, "private", "eingang", "privat", datetime(2024, 1, 1))], "id long, title string, owner_id long, visibility string, direction string, sphere string, created_at timestamp_ntz")
    assert rows(pages.split_parts(groups, docs).select("document_id", "part", "pages", "owner_id")) == [(1, 1, [1], 5), (1, 2, [2], 5)]


def test_template_keys(spark):
    drafted = spark.createDataFrame([(1, "b", "kontakt.name", 0), (1, "a", "nix.x", 1), (1, "b", "manual", 2), (1, "c", "vorgang.name", 3)], "template_id long, key string, source string, position int")
    found = bindings.template_keys(drafted, ["kontakt", "vorgang"], most=2)
    assert rows(found.select("key", "source")) == [("a", "manual"), ("b", "kontakt.name")]


def test_mail_documents(spark):
    mails = spark.createDataFrame([("<1>", "S", "me@x.de", datetime(2024, 6, 3, 9), "ein Text", True), ("<2>", " ", "you@x.de", None, "zu kurz", False)], "message_id string, subject string, sender string, sent_at timestamp, text string, has_substance boolean")
    own = spark.createDataFrame([("ME@x.de",)], "email string")
    got = rows(ingest.mail_documents(mails, own).select("message_id", "title", "direction", "document_date", "text_content", "processing_status"))
    assert got == [("<1>", "S", "ausgang", date(2024, 6, 3), "ein Text", "pending"), ("<2>", "Mail von you@x.de", "eingang", None, "", "ready")]


def test_embedding_keeps_what_failed(spark):
    docs = spark.createDataFrame([(1, "a b", "text"), (2, "# K\n\nc", "markdown"), (3, "boom", "text")], "id long, text_content string, content_format string")
    fresh = chunking.chunk_documents(docs, 10, 0)

    class Picky(models.FakeEmbedding):
        def embed(self, texts):
            if any("boom" in t for t in texts):
                raise ValueError("no")
            return super().embed(texts)

    done = models.embed_chunks(fresh.repartition(3, "document_id"), Picky, dim=4, batch=1)
    assert rows(done.select("document_id", "embedding", "error")) == [(1, [4.0] * 4, None), (2, [7.0] * 4, None), (3, None, "ValueError")]
    assert rows(models.failed_documents(done)) == [(3,)]
    short = models.embed_chunks(fresh, models.PROVIDERS["fake"], dim=5)
    assert {r.error for r in short.collect()} == {"wrong dimension"}


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise models.Unavailable
        return "ok"

    assert models.with_retry(call, sleep=waits.append) == "ok" and len(waits) == 2 and waits[1] > waits[0]
    with pytest.raises(models.Unavailable):
        models.with_retry(lambda: (_ for _ in ()).throw(models.Unavailable()), attempts=2, sleep=lambda s: None)
    with pytest.raises(KeyError):
        models.with_retry(lambda: {}["x"], sleep=waits.append)
    assert models.masked("short") == "***" and models.masked("a-long-secret-1234") == "***1234"


def test_bookkeeping_of_pages(spark):
    p = spark.createDataFrame([(1, 1, "h", "v2"), (1, 2, "h", "v2"), (2, 1, "g", "v2")], "document_id long, page int, sha256 string, prompt_version string")
    done = spark.createDataFrame([(1, "h:v2"), (2, "g:v1")], "document_id long, fingerprint string")
    assert rows(stale.needs_vision(p, done).select("document_id", "page")) == [(2, 1)]
    assert rows(stale.missing_pages(p, spark.createDataFrame([(1, 1)], "document_id long, page int"))) == [(1, 2), (2, 1)]


def test_detached_children(spark):
    docs = spark.createDataFrame([(1, None, 5, "private"), (2, 1, None, None), (3, 1, 9, "department")], "id long, parent_id long, owner_id long, visibility string")
    bridge = spark.createDataFrame([(1, 10), (3, 20)], "document_id long, department_id long")
    after, departments, links = details.detach_children(docs, bridge, spark.createDataFrame([(2,), (3,), (1,)], "id long"))
    assert rows(after) == rows(spark.createDataFrame([(1, None, 5, "private"), (2, None, 5, "private"), (3, None, 9, "department")], docs.schema))
    assert rows(departments) == [(1, 10), (2, 10), (3, 20)] and rows(links) == [(1, 2), (1, 3)]


def test_readers(spark):
    import io
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hallo</w:t><w:tab/><w:t>Du</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Ende</w:t></w:r></w:p></w:body></w:document>')
    mail = b"Content-Type: text/html\r\n\r\n<p>Hi</p><blockquote>x</blockquote>"
    cases = [("a", b"gr\xfc\xc3\xbc", "text/plain"), ("b", raw.getvalue(), readers.DOCX), ("c", mail, "message/rfc822"), ("d", b"no zip", readers.DOCX), ("e", b"%PDF", "application/pdf"), ("f", None, "text/plain")]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c), k) for p, c, k in cases], "path string, content binary, mime_type string")
    got = {r.path: (r.text, r.error) for r in readers.read_texts(df).collect()}
    assert got["a"] == ("gr�ü", None) and got["b"] == ("Hallo\tDu\n\nEnde", None) and got["c"] == ("Hi", None) and got["f"] == ("", None)
    assert got["d"][0] is None and "BadZipFile" in got["d"][1] and got["e"] == (None, "no reader for application/pdf")


def test_attachments(spark):
    from aktarium.operators import mail

    kinds = "mail_id long, content_type string, content_id string, inline boolean, size long, width int, height int"
    cases = [
        (1, "image/png", "", True, 90_000, 900, 900), (2, "image/png", "<a@b>", False, 90_000, 900, 900), (3, "IMAGE/PNG", None, None, 100, 900, 900),
        (4, "application/pdf", "", True, 10, None, None), (5, "image/jpeg", "x", False, 90_000, 100, 900), (6, "image/jpeg", "x", False, 90_000, None, None), (7, None, None, None, 1, None, None),
    ]
    a = spark.createDataFrame(cases, kinds)
    bodies = spark.createDataFrame([(2, "<img src='cid:a@b'>"), (5, None)], "mail_id long, html string")
    got = lambda **k: [r.reason for r in mail.attachment_reasons(a, bodies, **k).orderBy("mail_id").collect()]
    assert got() == ["inline", "inline", "small", None, "small_side", None, None]
    assert got(enabled=False) == [None] * 7


def test_machine_references_beside_manual_ones(spark):
    from aktarium.operators import references

    old = spark.createDataFrame([(1, "iban", "M", "manuell"), (1, "iban", "OLD", "ki")], "document_id long, type string, value_normalized string, source string")
    found = spark.createDataFrame([(1, "iban", "M", 0), (1, "iban", "B", 1), (1, "iban", "B", 2), (1, "iban", "", 3), (1, "iban", "C", 4), (1, "iban", "D", 5)], "document_id long, type string, value_normalized string, position int")
    assert rows(references.replace_machine_references(old, found, most=2)) == [(1, "iban", "B", "ki"), (1, "iban", "C", "ki"), (1, "iban", "M", "manuell")]


def test_mails_are_taken_once(spark):
    docs = spark.createDataFrame([(1, None, '{"message_id": "<known>"}'), (2, 1, '{"message_id": "<child>"}'), (3, None, None)], "id long, parent_id long, metadata string")
    mails = spark.createDataFrame([("a", "<known>", "h1"), ("b", "<child>", "h2"), ("c", "<new>", "h3"), ("d", "<new>", "h4"), ("e", "", "h5"), ("f", "", "h5"), ("g", None, "h6")], "path string, message_id string, sha256 string")
    assert sorted(r.path for r in ingest.new_mails(mails, docs).collect()) == ["b", "c", "e", "g"]


def test_task_windows(spark):
    from aktarium.operators import filters, ordering

    t = [(1, "offen", date(2024, 6, 11)), (2, "erledigt", date(2024, 6, 11)), (3, "erledigt", date(2024, 6, 19)), (4, "offen", date(2024, 6, 20)), (5, "offen", None), (6, "offen", date(2024, 6, 12))]
    tasks = spark.createDataFrame([(*x, datetime(2024, 1, 1)) for x in t], "id long, status string, due_date date, created_at timestamp_ntz")
    ids = lambda w: sorted(r.id for r in filters.due_tasks(tasks, w, "2024-06-12").collect())
    assert (ids("overdue"), ids("week"), ids("none")) == ([1], [3, 6], [5])
    assert [r.id for r in tasks.orderBy(*ordering.task_order()).collect()][-1] == 5


def test_uploads(spark):
    f = [("/a.pdf", "a.pdf", "h1", 5), ("/b.exe", "b.exe", "h2", 5), ("/c.pdf", "c.pdf", "h1", 5), ("/d.txt", "d.txt", "h3", 26 << 20), ("/e.txt", "e.txt", "known", 5)]
    files = spark.createDataFrame(f, "path string, name string, sha256 string, size long")
    got = rows(ingest.upload_status(files, spark.createDataFrame([("known",)], "sha256 string")).select("path", "status"))
    assert got == [("/a.pdf", "ok"), ("/b.exe", "extension"), ("/c.pdf", "duplicate"), ("/d.txt", "too_large"), ("/e.txt", "duplicate")]


def test_comment_lines(spark):
    c = [(k, 1, f"text {k}", 7 if k < 5 else 8, date(2024, 6, 12) if k == 0 else None, datetime(2024, 1, 1 + k)) for k in range(6)]
    comments = spark.createDataFrame(c, "id long, document_id long, body string, author_id long, follow_up_date date, created_at timestamp_ntz")
    lines = [r.line for r in stale.comment_context(comments, "2024-06-12", most=2).orderBy("place").collect()]
    assert lines == ["2024-01-01 | user 7 | today 2024-06-12 | text 0", "2024-01-05 | user 7 | text 4", "2024-01-06 | user 8 | text 5"]


def test_stored_tables_can_be_dropped(spark):
    with session.collecting() as paths:
        part = session.stored(spark.range(3))
    assert part.count() == 3 and session.discard(spark, *paths) == 1 and session.discard(spark, part, spark.range(2)) == 0
    session.drop_stored(spark)
    df = session.stored(spark.range(5).repartition(2))
    assert df.count() == 5 and session.drop_stored(spark) == 1
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found|no such"):
        df.select("id").collect()
    assert session.drop_stored(spark) == 0


def test_model_calls_and_their_usage(spark):
    class Flaky(models.FakeGeneration):
        def generate(self, prompt):
            if prompt == "bad":
                raise RuntimeError(prompt)
            return super().generate(prompt)

    prompts = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, None)], "key long, prompt string")
    done = models.generate(prompts, Flaky)
    assert rows(done) == [(1, "Echo: a b", "fake", 5, None), (2, None, "fake", 1, "RuntimeError"), (3, "Echo: ", "fake", 1, None)]
    assert rows(models.usage(done)) == [("fake", 3, 7)]
    seen = models.describe(spark.createDataFrame([(1, bytearray(b"xyz"), "read")], "key long, image binary, prompt string"), models.DESCRIBERS["fake"])
    assert rows(seen) == [(1, "read: 3", "fake", 3, None)]


def test_mails_that_fail_fail_alone(spark):
    class Backend:
        def send(self, recipient, subject, text):
            if not recipient:
                raise ValueError(subject)

    sent = sinks.send_mails(spark.createDataFrame([("a@b", "s", "t"), ("", "u", "v")], "recipient string, subject string, text string"), Backend)
    assert sorted(map(tuple, sent.collect()), key=str) == [("", "u", "ValueError"), ("a@b", "s", None)]


def test_places_over_many_partitions(spark):
    got = ordering.numbered(spark.range(1000).repartition(7).select((F.col("id") % 250).alias("a"), F.col("id").alias("b")), ["a", "b"], "place").orderBy("place").collect()
    assert [(r.a, r.b, r.place) for r in got] == [(a, a + 250 * k, a * 4 + k + 1) for a in range(250) for k in range(4)]


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Session:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda key, default: None)}), Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session)
