import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from aktarium.operators import aggregates, bindings, classify, filters, graph, ingest, ordering, pages, references, retrieval, stale, tree
from aktarium.sources import files, mailbox, sinks
from aktarium.streaming import ingest_stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_search_and_similar_documents(spark):
    one = lambda *x: [float(v) for v in x]
    data = [
        (1, 1, one(1, 0), "m", "1"), (2, 2, one(0.8, 0.6), "m", "1"), (3, 2, one(1, 0), "m", "1"), (4, 3, one(0, 1), "m", "1"),
        (5, 4, one(1, 0), "other", "1"), (6, 5, one(1, 0), "m", "1"), (7, 6, one(1, 0), "m", "2"), (8, 7, one(1, 0), "m", "1"), (9, 9, one(0, 0), "m", "1"),
    ]
    chunks = spark.createDataFrame(data, "id long, document_id long, embedding array<float>, embedding_model string, embedding_model_version string").withColumn("content", F.concat(F.lit("c"), F.col("id").cast("string")))
    docs = spark.createDataFrame([(1, None), (2, None), (3, None), (4, None), (5, 1), (6, None), (7, 5), (8, None), (9, None)], "id long, parent_id long")
    found = [(r.document_id, r.chunk_id, round(r.score, 6)) for r in retrieval.search(chunks, docs, [1.0, 0.0], 3).collect()]
    assert found == [(1, 1, 1.0), (2, 3, 1.0), (4, 5, 1.0)]
    similar = lambda **k: [(r.document_id, round(r.score, 6)) for r in retrieval.similar_documents(chunks, docs, docs, 1, **k).collect()]
    assert similar() == [(2, 1.0)]
    assert similar(min_score=-1.0) == [(2, 1.0), (3, 0.0)]
    assert similar(min_score=-1.0, cap=1) == [(2, 1.0)] and similar(exclude=[2]) == [] and similar(limit=0) == []
    assert retrieval.similar_documents(chunks, docs, docs, 8).count() == 0


def test_tree_with_cycles_and_missing_parents(spark):
    docs = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (6, 7), (7, 6), (8, 7)], "id long, parent_id long")
    assert rows(tree.root_of(docs)) == rows(spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3), (5, 5, 0), (6, None, None), (7, None, None), (8, None, None)], "id long, r long, d long"))
    assert rows(tree.cyclic(docs)) == [(6,), (7,), (8,)]
    assert rows(tree.descendants(docs, 1)) == [(2, 1), (3, 2), (4, 3)] and rows(tree.descendants(docs, 6)) == [(7, 1), (8, 2)]


def test_tax_and_case_filters(spark):
    docs = spark.createDataFrame([(1, "ja"), (2, "vielleicht"), (3, "nein")], "id long, tax_relevance string")
    assert [len(filters.filter_documents(docs, tax=t).collect()) for t in ("absetzbar", "nein", "", "quatsch")] == [2, 1, 3, 3]
    bridge = spark.createDataFrame([(1, "a"), (1, "b"), (3, "b")], "document_id long, name string")
    assert rows(filters.filter_documents(docs.select("id", "tax_relevance"), tags=(bridge, ["a", "b"])).select("id")) == [(1,), (3,)]
    assert rows(filters.search_text(docs, ["tax_relevance"], "EIN").select("id")) == [(3,)]
    assert filters.search_text(docs, ["tax_relevance"], "%").count() == 0


def test_page_numbers_are_clamped(spark):
    df = spark.range(45)
    first = lambda n: [r.id for r in ordering.page(df, [F.col("id").asc()], n).collect()]
    assert first(0) == first(1) == list(range(20)) and first(3) == first(9) == list(range(40, 45))


def test_learning_and_entering_references(spark):
    existing = spark.createDataFrame([(1, "iban", "X", "gelernt", 5), (1, "kundennummer", "K", "manuell", None)], "owner_id long, type string, value_normalized string, source string, learned_from long")
    refs = spark.createDataFrame([(10, 7, "iban", "X"), (11, 7, "kundennummer", "K"), (12, 7, "iban", "Y"), (13, 7, "aktenzeichen", "A"), (14, 8, "iban", "Y")], "id long, document_id long, type string, value_normalized string")
    targets = spark.createDataFrame([(7, 1), (8, 1)], "document_id long, owner_id long")
    after = references.learn(existing, refs, targets, "kontakt")
    assert rows(after) == rows(existing.unionByName(spark.createDataFrame([(1, "iban", "Y", "gelernt", 7)], existing.schema)))
    assert rows(references.learn(after, refs, targets, "kontakt")) == rows(after)
    by_hand = references.record_by_hand(existing, spark.createDataFrame([(1, "iban", "X")], "owner_id long, type string, value_normalized string"))
    assert (1, "iban", "X", "manuell", None) in rows(by_hand) and by_hand.count() == 2


def test_suggestions_and_assignment(spark):
    refs = spark.createDataFrame([(1, 7, "aktenzeichen", "A"), (2, 7, "rechnungsnummer", "R"), (3, 8, "iban", "I"), (4, 9, "aktenzeichen", "B")], "id long, document_id long, type string, value_normalized string")
    owners = spark.createDataFrame([(1, "aktenzeichen", "A"), (1, "rechnungsnummer", "R"), (2, "rechnungsnummer", "R"), (3, "aktenzeichen", "B"), (4, "aktenzeichen", "B")], "owner_id long, type string, value_normalized string")
    none = spark.createDataFrame([], "document_id long, owner_id long")
    s = references.suggestions(refs, owners, none, "vorgang")
    assert rows(s) == [(7, 1, "aktenzeichen", "A", True), (7, 2, "rechnungsnummer", "R", False), (9, 3, "aktenzeichen", "B", True), (9, 4, "aktenzeichen", "B", True)]
    assert rows(references.auto_assign(s)) == [(7, 1)]
    has_contact = spark.createDataFrame([(8, 55)], "document_id long, owner_id long")
    contacts = spark.createDataFrame([(6, "iban", "I")], "owner_id long, type string, value_normalized string")
    assert references.suggestions(refs, contacts, has_contact, "kontakt").count() == 0
    assert rows(references.suggestions(refs, contacts, none, "kontakt").select("owner_id", "strong")) == [(6, True)]


def test_dates_are_resolved(spark):
    d = lambda s: date.fromisoformat(s)
    cand = [
        (1, "briefkopf", d("2024-03-01"), 0), (1, "belegdatum", d("2024-02-01"), 1), (1, "belegdatum", d("2024-01-01"), 2),
        (2, "belegdatum", d("2024-05-10"), 0), (2, "zeitraum_ende", d("2024-03-31"), 1), (2, "zeitraum_ende", d("2024-04-30"), 2),
        (3, "belegdatum", d("2024-05-11"), 0), (4, "zeitraum_beginn", d("2024-01-01"), 0), (5, "belegdatum", d("2024-05-12"), 0), (5, "briefkopf", d("2024-05-09"), 1),
    ]
    c = spark.createDataFrame(cand, "document_id long, kind string, date date, position int")
    up = spark.createDataFrame([(k, d("2024-05-10")) for k in range(1, 7)], "document_id long, uploaded_on date")
    assert rows(classify.resolve_dates(c, up)) == [(1, d("2024-02-01"), "belegdatum", False), (2, d("2024-04-30"), "zeitraum_ende", True), (3, d("2024-05-11"), "belegdatum", False), (4, None, "", False), (5, d("2024-05-12"), "belegdatum", False), (6, None, "", False)]


def test_contacts_are_found(spark):
    contacts = spark.createDataFrame([("Zeta", "z@x.de", "DE1", "", "DE02 12"), ("Alpha", "Z@X.de", "", "12/3", ""), ("Beta", "", "", "", "")], "name string, email string, vat_id string, tax_number string, iban string")
    parties = spark.createDataFrame(
        [(1, "de 1", "", "", "", "Beta"), (2, "", "de0212", "", "", ""), (3, "", "", "12/3", "", ""), (4, "", "", "", " z@x.DE ", "Beta"), (5, "", "", "", "no@x.de", "Beta"), (6, "", "", "", "", " beta "), (7, None, None, None, None, None)],
        "party long, vat_id string, iban string, tax_number string, email string, name string",
    )
    assert rows(classify.find_contacts(parties, contacts)) == [(1, "Zeta"), (2, "Zeta"), (3, "Alpha"), (4, "Alpha"), (5, None), (6, "Beta"), (7, None)]


def test_suggestions_are_replaced(spark):
    kinds = "document_id long, name string, dimension string, confidence double"
    old = spark.createDataFrame([(1, "Alt", "", 0.5, "pending"), (1, "Nein", "x", 0.5, "rejected")], f"{kinds}, status string")
    new = spark.createDataFrame([(1, "nein", "y", 0.9, 0), (1, "Art:Neu", "", 7.0, 1), (1, "NEU", "z", 0.1, 2), (1, " ", "", 0.1, 3)], f"{kinds}, position int")
    assert rows(classify.replace_suggestions(old, new)) == [(1, "Nein", "x", 0.5, "rejected"), (1, "Neu", "Art", 1.0, "pending")]


def test_page_plans(spark):
    plan = [(1, 5, {1: 90}, [2], [2, 4]), (2, 3, {}, [1], [1]), (3, 3, {}, [], [1, 3]), (4, 4, {}, [4], [4])]
    got = pages.page_groups(spark.createDataFrame(plan, "document_id long, page_count int, rotations map<int,int>, deletions array<int>, splits array<int>"))
    assert rows(got.select("document_id", "page", "rotation", "part")) == [
        (1, 1, 90, 1), (1, 3, 0, 2), (1, 4, 0, 3), (1, 5, 0, 3), (2, 2, 0, 1), (2, 3, 0, 1), (3, 1, 0, 1), (3, 2, 0, 1), (3, 3, 0, 2), (4, 1, 0, 1), (4, 2, 0, 1), (4, 3, 0, 1),
    ]


def test_empty_pages(spark):
    texts = [
        (1, "# T\n\n## Seite 1\n\nEin langer Absatz mit Text.\n\n## Seite 2\n\n_Kein Text erkannt._\n"), (2, "## Seite 1\n\n\n\n## Seite 2\n\n_Seite konnte technisch nicht verarbeitet werden._"),
        (3, "ohne Kopf, aber lang genug hier"), (4, None), (5, "# Ein langer Titel, der nicht zählt\nkurz"), (6, "## Seite 1\nalt, aber lang genug dafür\n## Seite 1\nneu"), (7, "# nur ein Titel ohne weitere Zeile"),
    ]
    found = pages.sections(spark.createDataFrame(texts, "id long, markdown string"))
    assert rows(pages.empty_pages(found)) == [(1, 2), (2, 1), (5, 1), (6, 1), (7, 1)]
    counts = spark.createDataFrame([(1, 3), (3, 2), (4, 2)], "id long, page_count int")
    assert rows(pages.empty_pages(found, counts=counts)) == [(1, 2), (1, 3), (3, 2)]
    made = pages.markdown_of_pages(spark.createDataFrame([(1, "T", 2, " \n"), (1, "T", 1, " a\n"), (2, "U", 1, "b"), (3, "V", 1, None)], "id long, title string, page int, text string"))
    assert rows(made) == [(1, "# T\n\n## Seite 1\n\na\n\n## Seite 2\n\n_Kein Text erkannt._\n"), (2, "# U\n\nb\n"), (3, "# V\n\n_Kein Text erkannt._\n")]


def test_vision_runs_go_on_where_they_were_cut_off(spark):
    from aktarium.operators import vision

    docs = spark.createDataFrame([(1, "A", "old", "s1", "v1", 5, ""), (2, "B", "old", "s2", "v1", 1, ""), (3, "C", "old", "s3", "v1", 2, "s3:v1"), (4, "D", "old", "s4", "v2", 1, "s4:v1")], "document_id long, title string, text string, sha256 string, prompt_version string, page_count int, vision_fingerprint string")
    outcomes = spark.createDataFrame([(4, "s4:v1", 1, "of another prompt", None)], "document_id long, fingerprint string, page int, text string, error string")
    due = vision.due_pages(docs, outcomes, most=3)
    assert rows(due.select("document_id", "page")) == [(1, 1), (1, 2), (1, 3), (2, 1), (4, 1)]
    first = spark.createDataFrame([(1, "s1:v1", 1, "```md\none\n```", None), (1, "s1:v1", 2, None, "Timeout"), (1, "s1:v1", 3, "three\x00", None), (2, "s2:v1", 1, None, "Refused"), (4, "s4:v2", 1, " ", None)], outcomes.schema)
    outcomes = outcomes.unionByName(first)
    got = {r.document_id: r for r in vision.fold_runs(docs, outcomes).collect()}
    assert sorted(got) == [1, 2, 4]
    assert (got[1].status, got[1].pages_processed, got[1].pages_failed, got[1].truncated, got[1].vision_fingerprint) == ("ready", 3, 1, True, "")
    assert got[1].text == "# A\n\n## Seite 1\n\none\n\n## Seite 2\n\n_Seite konnte technisch nicht verarbeitet werden._\n\n## Seite 3\n\nthree\n"
    assert (got[2].status, got[2].error, got[2].text) == ("failed", "Refused", "old")
    assert (got[4].text, got[4].vision_fingerprint) == ("# D\n\n_Kein Text erkannt._\n", "s4:v2")
    assert rows(vision.due_pages(docs, outcomes, most=3).select("document_id", "page")) == [(1, 2), (1, 4), (1, 5), (2, 1)]
    second = spark.createDataFrame([(1, "s1:v1", p, f"page {p}", None) for p in (2, 4, 5)], outcomes.schema)
    done = vision.fold_runs(docs, outcomes.unionByName(second)).filter("document_id = 1").first()
    assert (done.pages_processed, done.pages_failed, done.truncated, done.vision_fingerprint) == (5, 0, False, "s1:v1")


def test_staleness(spark):
    t = lambda day: datetime(2024, 1, day)
    runs = spark.createDataFrame([(1, t(5), [1, 2]), (2, t(5), [3]), (3, t(5), [4]), (4, t(5), [])], "case_id long, generated_at timestamp_ntz, considered array<long>")
    bridge = spark.createDataFrame([(1, 1), (9, 1), (3, 2), (4, 3)], "document_id long, case_id long")
    seen = spark.createDataFrame([(1, t(1)), (9, t(1)), (3, t(6)), (4, t(4))], "id long, updated_at timestamp_ntz")
    assert rows(stale.case_staleness(runs, bridge, seen)) == [(1, 1, 0, True), (2, 0, 1, True), (3, 0, 0, False), (4, 0, 0, False)]


def test_replies_and_recommendations(spark):
    r = spark.createDataFrame([(1, '{"a":1}', False), (2, '{"a":', True), (3, "", False), (4, "no", False), (5, '{"b":1}', False), (6, '{"a" 1}', False)], "id long, r string, t boolean")
    assert rows(r.select("id", bindings.reply_problem(F.col("r"), F.col("t"), ["a"]))) == [(1, None), (2, "cut_off"), (3, "empty"), (4, "no_object"), (5, "missing:a"), (6, "broken")]


def test_majority_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("t", "b", 0), ("t", "a", 1), ("t", "a", 2), ("t", "b", 3)], "g string, v string, p int")
    assert rows(aggregates.majority(df, ["g"], "v", "p")) == [("t", "b", 2)]


def test_merged_nodes_and_edge_ids(spark):
    a = spark.createDataFrame([("x", "old", 0), ("y", "y", 1)], "node string, payload string, position int")
    b = spark.createDataFrame([("z", "z", 0), ("x", "new", 1)], "node string, payload string, position int")
    assert rows(graph.merge_nodes(a, b)) == [("x", "new", 1), ("y", "y", 2), ("z", "z", 3)]
    ids = spark.createDataFrame([("document:9", "document:10")], "a string, b string")
    assert ids.select(graph.edge_id(F.col("a"), F.col("b"))).first()[0] == "document:10|document:9"
    links = references.canonical_links(spark.createDataFrame([(2, 1), (1, 2), (3, 3)], "x long, y long"))
    assert rows(links) == [(1, 2)] and rows(references.other_side(links, 2)) == [(1,)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "k long, v string")
    assert rows(ingest.upsert(old, new, ["k"])) == [(1, "a"), (2, "x"), (3, "z")]
    assert rows(ingest.upsert(old, new, ["k"], keep_existing=True)) == [(1, "a"), (2, "b"), (3, "z")]


def test_files_are_streamed_once(spark, tmp_path):
    box, target = tmp_path / "in", str(tmp_path / "docs")
    (box / "sub").mkdir(parents=True)
    (box / "a.txt").write_text("hello")
    (box / "b.TXT").write_text("hello")
    (box / ".hidden.txt").write_text("no")
    (box / "c.exe").write_text("no")
    run = lambda: ingest_stream.ingest_files(files.folder_stream(spark, str(box)), target, str(tmp_path / "check")).awaitTermination()
    run()
    assert rows(spark.read.parquet(target).select("title", "processing_status")) == [("a", "pending")]
    assert json.loads(spark.read.parquet(target).first().metadata) == {"original_filename": "a.txt", "mime_type": "text/plain", "size": 5}
    (box / "sub" / "d.pdf").write_bytes(b"%PDF-1")
    (box / "e.txt").write_text("hello")
    run()
    run()
    assert rows(spark.read.parquet(target).select("title")) == [("a",), ("d",)]
    assert sorted(r.name for r in spark.read.parquet(f"{target}_repeated").collect()) == ["b.TXT", "e.txt"]
    assert files.folder(spark, str(box)).count() == 4


def test_event_streams(spark, tiny, tmp_path):
    events = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet(f"{tiny}/events.parq[u]et")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    found = []
    ingest_stream.for_each(ingest_stream.first_seen(events, "event_id", "ts"), str(tmp_path / "c"), lambda b, n: found.append(b.count())).awaitTermination()
    assert sum(found) == spark.read.parquet(f"{tiny}/events.parquet").count()


def test_mailboxes(spark):
    class Box:
        def unseen(self):
            return [("7", b"Subject: x\r\n\r\nhi")]

    assert mailbox.fetch(spark, Box()).first().path == "mailbox:7"
    message = {"id": "m1", "subject": "s", "from": {"emailAddress": {"address": "A@B.de"}}, "attachments": [{"@odata.type": "#fileAttachment", "name": "a", "contentType": "x", "contentBytes": "aGk="}, {"@odata.type": "#itemAttachment", "name": "b"}]}
    m = mailbox.from_json_messages(spark.createDataFrame([(json.dumps(message),)], "json string")).first()
    assert (m.message_id, m.sender, [(x.name, bytes(x.content)) for x in m.attachments]) == ("m1", "a@b.de", [("a", b"hi")])


def test_tables_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="(?i)raise_error|boom"):
        sinks.replace_table(spark.range(5).select(F.raise_error(F.lit("boom")).cast("string").alias("x")), path)
    assert spark.read.parquet(path).count() == 2
