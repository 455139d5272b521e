import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aktarium.functions import dates as fd
from aktarium.functions import letters as fl
from aktarium.functions import references as fr
from aktarium.functions import text as ft
from aktarium.operators import checks, chunking, mail


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, x {kind}")
    return [r.y for r in df.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]


# Chunks


def chunks(spark, text, size, overlap):
    df = spark.createDataFrame([(1, text)], "id long, text_content string")
    return [r.content for r in chunking.chunk_text(df, size, overlap).orderBy("position").collect()]


def test_chunks_of_words(spark):
    assert chunks(spark, "", 4, 1) == chunks(spark, " \n\n ", 4, 1) == chunks(spark, None, 4, 1) == []
    assert chunks(spark, "a b", 4, 1) == ["a b"]
    assert chunks(spark, "a b c d e f g h i j", 4, 1) == ["a b c d", "d e f g", "g h i j"]
    assert chunks(spark, "a b c d e f", 3, 0) == ["a b c", "d e f"]
    assert chunks(spark, "a b\r\n\r\nc\nd e", 4, 1) == ["a b\n\nc d", "d e"]
    for size, overlap in ((0, 0), (3, 3), (3, -1)):
        with pytest.raises(ValueError):
            chunks(spark, "a", size, overlap)


def test_chunks_of_markdown():
    table = "| A | B |\n| --- | --- |\n" + "\n".join(f"| r{k} | {k} |" for k in range(8))
    parts = chunking.split_markdown(table, 20, 0)
    assert len(parts) > 1 and all(p.startswith("| A | B |\n| --- | --- |\n") for p in parts)
    assert [x for p in parts for x in p.splitlines()[2:]] == table.splitlines()[2:]
    assert chunking.split_markdown("# Kopf\n\nText dazu\n\nanderes", 4, 0) == ["# Kopf\n\nText dazu", "anderes"]
    assert chunking.split_markdown("one two three four five", 2, 0) == ["one two", "three four", "five"]
    assert chunking.split_markdown("a b\n\nc d\n\ne f", 4, 2) == ["a b\n\nc d", "c d\n\ne f"]
    assert chunking.split_markdown("## Seite 1", 4, 0) == ["## Seite 1"]
    assert chunking.split_markdown(" \n\n", 4, 0) == chunking.split_markdown(None) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["ein wort", "# Kopf", "zwei\ndrei", "lang " * 9, "| a | b |\n| --- | --- |\n| c | d |"]), max_size=8), st.integers(3, 12))
def test_markdown_chunks_lose_no_word(blocks, size):
    text = "\n\n".join(blocks)
    got = " ".join(chunking.split_markdown(text, size, 0)).split()
    assert [w for w in got if w.isalpha()] == [w for w in text.split() if w.isalpha()]


def test_replaced_chunks(spark):
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d")], "document_id long, position int, content string")
    new = spark.createDataFrame([(1, 0, "x"), (3, 0, "y")], "document_id long, position int, content string")
    failed = spark.createDataFrame([(3,)], "document_id long")
    assert sorted(map(tuple, chunking.replace_chunks(old, new, failed).collect())) == [(1, 0, "x"), (2, 0, "c"), (3, 0, "d")]


# Scalar functions


def test_reference_keys(spark):
    raw = ["Az. 123 / 45", "AZ 123/45", "123/45", "DE02 1203 0000", "IBAN: de02 1203 0000", "AZUBI4711", "AZ", "", " ", None, "Ihr Zeichen: a-b", "Kd.-Nr. 77", "Rechnungsnr 5 6", "Az.  ", "unser zeichen x.1"]
    want = ["123/45", "123/45", "123/45", "DE0212030000", "DE0212030000", "AZUBI4711", "AZ", "", "", "", "A-B", "77", "56", "AZ.", "X.1"]
    assert values(spark, raw, fr.normalize_reference) == want
    assert values(spark, ["IBAN", " iban ", "x", None], fr.normalize_type) == ["iban", "iban", "sonstige", "sonstige"]
    assert values(spark, ["aktenzeichen", "iban", "sonstige"], fr.scope_of_type) == ["vorgang", "kontakt", None]


def test_dates(spark):
    assert [str(x) if x else None for x in values(spark, ["2024-02-29", "2023-02-29", "2024-1-1", "2024", "01.02.2024", " 3.4.2024 ", "32.1.2024", "", None], fd.parse_date)] == ["2024-02-29", None, None, None, "2024-02-01", "2024-04-03", None, None, None]
    assert [str(x) if x else None for x in values(spark, ["2024-02-29", "01.02.2024"], fd.parse_iso_date)] == ["2024-02-29", None]
    assert values(spark, ["Rechnungs-Datum", "Rechnungsdatum!", "zeitraum bis", "Gedruckt  am", "x", None], fd.date_kind) == [None, "belegdatum", "zeitraum_ende", "erstellt", None, None]
    bucket = lambda today: (lambda c: fd.follow_up_bucket(c.cast("date"), today))
    assert values(spark, ["2024-06-11", "2024-06-12", "2024-06-13", "2024-06-16", "2024-06-17", None], bucket("2024-06-12")) == ["overdue", "today", "this_week", "this_week", "later", None]
    assert values(spark, ["2024-06-16", "2024-06-17"], bucket("2024-06-16")) == ["today", "later"]


def test_texts(spark):
    assert values(spark, ["a\x00b\x07c\td\ne\x7f"], ft.strip_controls) == ["abc\td\ne"]
    assert values(spark, ["a b  c d", "", None], ft.word_count) == [4, 0, 0]
    assert values(spark, ["1.234,56 and 12 and 3/4/55 and 99x100"], ft.number_tokens) == [["1.234,56", "3/4/55", "100"]]
    found = values(spark, ["1.234 1234 77 555 5-5-5"], lambda c: ft.unmatched_numbers(c, F.lit("x 1,234")))
    assert found == [["555"]]
    assert values(spark, ["a", " ", None], ft.hash_bucket)[1:] == [None, None]
    assert values(spark, ["Ja", " pflicht", "nein", None], ft.lenient_bool) == [True, True, False, False]
    assert values(spark, ["Größe (m²)", "1. Straße", "éa--b_"], ft.key_slug) == ["groesse_m", "strasse", "ea_b"]
    split = values(spark, ["Art:Rechnung", ":x", "x:", "a:b:c", "x"], lambda c: F.array(*ft.split_tag(c, F.lit(""))))
    assert split == [["Rechnung", "Art"], [":x", ""], ["x:", ""], ["b:c", "a"], ["x", ""]]
    assert values(spark, ["Art:Rechnung"], lambda c: F.array(*ft.split_tag(c, F.lit("d")))) == [["Art:Rechnung", "d"]]
    fenced = ["```json\n{}\n```", "a ```\n{}\n```", "```\nx\n``` y", "\n```c++ code\n\n a\n```\nb\n``` \n", "```\nx```", "```\n```", " x "]
    assert values(spark, fenced, ft.strip_code_fence) == ["{}", "a ```\n{}\n```", "```\nx\n``` y", "a\n```\nb", "```\nx```", "```\n```", " x "]
    assert values(spark, ["a.pdf", "noext", "x.tar.gz"], lambda c: ft.part_name(c, F.lit(2), F.lit(3))) == ["a-teil-2.pdf", "noext-teil-2", "x.tar-teil-2.gz"]


# Mail


def test_html_bodies():
    html = "<head><title>T</title></head><body><style>x</style><p>Hallo <b>Du</b></p><div style='display:none'>weg</div><span hidden>weg</span>a<br>b<blockquote>alt<p>alt</p></blockquote><!-- c --><div class='x gmail_quote'>alt</div><img width=1 src=x>&amp; Ende</body>"
    assert [x for x in mail.html_to_text(html).splitlines() if x] == ["Hallo Du", "a", "b& Ende"]
    assert mail.html_to_text("<p>a<div>b</p>c</span>d") == "ab\n\ncd"


TAILS = ["-- \nJane", "Gesendet von meinem iPhone", "----- Original Message -----\nx", "Am 1.2. schrieb Bob:\nx", "On Monday, Bob wrote:\n> x", "Von: Bob\nGesendet: heute\nx", "From: Bob\n\nTo: me\nx"]


def test_quotes_are_cut(spark):
    got = values(spark, [f"eins\n> zitiert\nzwei\n\n\n\ndrei\n{tail}\nrest" for tail in TAILS], mail.own_text)
    assert got == ["eins\nzwei\n\ndrei"] * len(TAILS)


def test_what_only_looks_like_a_quote_stays(spark):
    texts = ["Von: hier kommt nichts\nmehr dazu\nund weiter\nSchluss", "Hallo\nVon: Anna\nirgendwas\nAn: Bert\nRest", "Liste\n  - a\n    - b", "--x\ny"]
    assert values(spark, [*texts, None, "  a  \r\nb\x85c  "], mail.own_text) == [*texts, "", "a\nb\nc"]


def test_open_elements_end_their_lines():
    assert mail.html_to_text("<div><p>a<p>b</div>c") == "ab\n\n\nc" and mail.html_to_text("<p>a") == "a\n"


def test_closings_of_letters(spark):
    letters = ["Text\nMit freundlichen Grüßen,\n\nJane\nLeitung\nTelefon\nMail", "Viele Grüße\n1\n2\n3\n4\n5", "a\nViele Grüße\n\n\n1\n2\n3", "Hochachtungsvolle Worte", "x\nGRUSS J,", None]
    assert values(spark, letters, lambda c: fl.strip_closing(c, F.lit("Gruss J"))) == ["Text", letters[1], "a", letters[3], "x", ""]
    assert values(spark, ["\nBeste Grüße,\n \nJane\nx", "Jane\nBeste Grüße", "", None], fl.strip_first_closing) == ["Jane\nx", "Jane\nBeste Grüße", "", ""]


def test_raw_mails(spark):
    raw = b"From: A B <A@x.org>\r\nTo: me@y.org\r\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\r\nMessage-ID: <1@x>\r\nDate: Mon, 03 Jun 2024 10:00:00 +0200\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nHallo\r\n--b\r\nContent-Type: image/png\r\nContent-ID: <c1>\r\nContent-Disposition: inline; filename=a.png\r\nContent-Transfer-Encoding: base64\r\n\r\niVBORw==\r\n--b--\r\n"
    rows = mail.read_eml(spark.createDataFrame([("a", bytearray(raw)), ("b", bytearray(b"Date: nonsense\r\n\r\nx")), ("c", None)], "path string, content binary")).orderBy("path").collect()
    a = rows[0]
    assert (a.subject, a.sender, a.sender_name, a.recipient, a.message_id, a.plain.strip()) == ("Grüße", "a@x.org", "A B", "me@y.org", "<1@x>", "Hallo")
    assert [(x.name, x.content_type, x.content_id, x.inline, bytes(x.content)) for x in a.attachments] == [("a.png", "image/png", "c1", True, b"\x89PNG")]
    assert rows[1].ok and rows[1].sent_at is None


# Tables


def test_tables():
    text = "x\n| A | Einheit |\n| --- | :---: |\n| 1 |  |\n| 2 | g |\nend\n| lone |\n| B |\n|---|\n"
    assert checks.parse_tables(text) == [{"header": ["A", "Einheit"], "rows": [["1", ""], ["2", "g"]]}, {"header": ["B"], "rows": []}]
    assert checks.parse_tables(None) == checks.parse_tables("prose") == []


def unit_rows(spark, units):
    text = "| N | Unit |\n| --- | --- |\n" + "\n".join(f"| r{k} | {u} |" for k, u in enumerate(units))
    df = spark.createDataFrame([(1, text)], "id long, markdown string")
    return sorted((r.row, r.unit, r.expected) for r in checks.unit_outliers(checks.tables_of(df)).collect())


def test_units(spark):
    assert unit_rows(spark, ["g", "g", "mg", ""]) == [("r2", "mg", "g")]
    assert unit_rows(spark, ["g", "g"]) == unit_rows(spark, ["g", "mg"]) == unit_rows(spark, ["g"]) == []
    assert unit_rows(spark, ["mg", "g", "mg", "g"]) == [("r1", "g", "mg"), ("r3", "g", "mg")]


def test_row_shifts(spark):
    text = "| N | V |\n| --- | --- |\n| 123 | 456 |\n| 7 | 89 |"
    far = "123" + "x" * 100 + "456"
    refs = [(1, far), (2, "123 456"), (3, "123 only"), (4, far + " 123")]
    tables = checks.tables_of(spark.createDataFrame([(k, text) for k, _ in refs], "id long, markdown string"))
    out = checks.row_shifts(tables, spark.createDataFrame(refs, "id long, reference string")).collect()
    assert [(r.id, r.row, r.numbers) for r in out] == [(1, "123", ["123", "456"])]
