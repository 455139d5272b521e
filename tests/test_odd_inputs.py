"""Registered queries against their SQL on documents made for the cases that the test tables lack."""

import duckdb
import pytest

from aktarium.plans import archive_queries as aq

from .test_queries import rows_of


def same_as_sql(spark, folder, name, rows):
    """Whether a query over documents (id, text) equals its SQL."""
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    for t in ("conversations", "embeddings", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df, want = aq.QUERIES[name](spark, str(folder)), con.sql(aq.ORACLES[name])
    return rows_of(df.columns, map(tuple, df.collect())) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("base", [0, 1002, 99996, 10_000_002, 10**12])
def test_replies_that_end_in_a_comma(spark, tmp_path, base):
    texts = ["", "a", "ab", "abc", "abcd", "abcdefghi", '"b"', "\\", ",}", None]
    assert same_as_sql(spark, tmp_path, "reply_problems", [(base + k, texts[k // 6]) for k in range(6 * len(texts))])


def test_commas_before_an_end(spark):
    from pyspark.sql import functions as F

    from aktarium.operators import bindings

    replies = ['{"a": 1, }', '{"a": [1, 2,], }', '{"a": ",}"}', '{,}', '{"a": 1,,}', '{"a": "x\\",}"', '{"a": "' + "x\\\\" * 50_000 + '",}']
    r = spark.createDataFrame(list(enumerate(replies)), "id int, r string")
    out = {x.id: x.p for x in r.select("id", bindings.reply_problem(F.col("r"), F.lit(False), ["a"]).alias("p")).collect()}
    assert out == {0: None, 1: None, 2: None, 3: "broken", 4: "broken", 5: "broken", 6: None}


def test_rows_beside_numbers_of_the_text(spark, tmp_path):
    far = "y" * 90
    texts = ["7 " + far, "9,99 " + far, far + " 999", far + "7", "3", "٣" + far, "100000000006" + far, "", None, far]
    assert same_as_sql(spark, tmp_path, "row_shift", list(enumerate(texts)))


def test_streamed_texts_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from aktarium.plans import stream_queries
    from aktarium.plans.archive import Archive

    paths, scratch = [], stream_queries.scratch
    monkeypatch.setattr(stream_queries, "scratch", lambda s: paths.append(scratch(s)) or paths[-1])
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 1500).cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        found = stream_queries.stream_first_seen(Archive(spark, str(tmp_path)))
        assert found.filter("repeated").count() == 2500
        assert found.select("batch").distinct().count() == 3
        assert spark.read.parquet(f"{paths[0]}/in").select(F.input_file_name()).distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_headers_are_as_the_standard_policy_has_them(monkeypatch):
    import email.policy

    from aktarium.operators import mail

    inner = "Subject: " + "long words " * 12 + "\r\nMessage-ID: <a.b@c>\r\n\r\nx"
    heads = ["Subject: T 1\r\nMessage-ID: <1.2@mail>", "Subject: =?utf-8?q?=C3=A4?= b\r\nMessage-ID: <a..b@c> (x)", "Subject:  two  blanks\r\n\tfolded\r\nMessage-ID: none", "subject: " + "w " * 200]
    raw = [f"From: A B <A@b.c>\r\nDate: {date}\r\n{head}\r\nContent-Type: message/rfc822\r\nContent-Disposition: attachment\r\n\r\n{inner}".encode() for head in heads for date in ("Mon, 03 Jun 2024 10:00:00 +0000", "x", "Mon, 03 Jun 2024 10:00:00 -0000")]
    found = [mail.parse_eml(x) for x in raw]
    monkeypatch.setattr(mail, "_POLICY", email.policy.default)
    assert None not in found
    assert found == [mail.parse_eml(x) for x in raw]


def test_headers_are_taken_apart_once(monkeypatch):
    from email.headerregistry import HeaderRegistry

    from aktarium.operators import mail

    calls, call = [], HeaderRegistry.__call__
    monkeypatch.setattr(HeaderRegistry, "__call__", lambda self, name, value: calls.append(name) or call(self, name, value))
    for k in range(100):
        assert mail.parse_eml(f"From: once{k % 2}@b.c\r\nSubject: T {k}\r\nMessage-ID: <{k}@mail>\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nx".encode())["plain"] == "x"
    assert len(calls) < 20


def test_documents_of_mails_read_each_mail_once(spark, tiny):
    plan = aq.QUERIES["eml_documents"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == 1


def test_common_words_in_odd_places(spark, tmp_path):
    texts = ["«der» hund, die katze!", "der-die das1und 1und2 x x x x", "THE\u00a0of\u2003and xxxxxxxxxxxx", "d'accord est-ce que le, (et) à", "--- ... --- ... --- ...", "de des dem der den del desde", "é́le les lés et. .et ..et..", "este sí sí. porque más pero", "ünd ist nicht\u0301 für das", "to " * 30_000]
    assert same_as_sql(spark, tmp_path, "detect_language", list(enumerate(texts)))
    plan = aq.QUERIES["detect_language"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and "split(" not in plan


def test_replies_hold_few_prompts_at_once():
    import tracemalloc

    import pyarrow as pa

    from aktarium.sources import models

    batch = pa.record_batch([pa.array(range(2000)), pa.array([f"{k} " + "w " * 10_000 for k in range(2000)])], ["key", "prompt"])
    tracemalloc.start()
    n = sum(b.num_rows for b in models._answered(iter([batch]), models.FakeGeneration, lambda p, row: p.generate(row["prompt"])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2000 and peak < batch.nbytes / 2


def test_postings_are_lists(spark, tmp_path, monkeypatch):
    from aktarium.operators import text_index

    rows = spark.createDataFrame([(k, f"abc {'x' * (k % 3)} t{k}") for k in range(3000)] + [(9000, ""), (9001, None), (9002, "ab")], "id long, t string")
    index = text_index.TextIndex(spark, f"{tmp_path}/index", ["t"])
    index.extend(rows.coalesce(1))
    stored = spark.read.parquet(index.path)
    assert stored.filter(f"gram = {ord('a') << 42 | ord('b') << 21 | ord('c')}").count() == 1
    assert sorted(r.id for r in index.search(rows, "T299").collect()) == [299, *range(2990, 3000)]
    index.extend(rows.filter("id < 10"))
    assert [r.id for r in index.search(rows, "t7").filter("id < 10").collect()] == [7]
