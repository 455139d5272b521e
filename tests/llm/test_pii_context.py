from aktarium.llm import pii


def score(text, kind):
    return [s.score for s in pii.find_spans(text) if s.kind == kind]


def test_context_words_count_as_a_whole_on_both_sides():
    assert score("hotel near the ship 1.2.3.4", "ip") == score("x 1.2.3.4", "ip") == [0.6]
    assert score("the hostel +49 30 1234567", "phone") == [0.6] and score("Tel. +49 30 1234567", "phone") == score("+49 30 1234567 (mobile)", "phone") == [1.0]
    assert score("078-05-1120 is my social security number", "ssn") == [0.7] and score("078-05-1120 is a number", "ssn") == []
    # A word that begins within reach counts whole, one that is cut off at the far side doesn't count.
    assert score("1.2.3.4 " + "x " * 18 + "server", "ip") == [1.0] and score("aship" + " " * 38 + "1.2.3.4", "ip") == [0.6]
    assert score("1.2.3.4 " + "x " * 30 + "server", "ip") == [0.6]


def test_words_against_lower_the_score_but_keep_base_spans():
    assert score("version 1.2.3.4", "ip") == [0.4] and score("server version 1.2.3.4", "ip") == [0.8]
    assert score("model ssn 123-45-6789", "ssn") == [0.5] and score("model 123-45-6789", "ssn") == []


def test_each_span_has_its_score(spark):
    docs = spark.createDataFrame([(1, "version 1.2.3.4, mail a@b.de"), (2, None)], "doc_id long, text string")
    rows = pii.digest(pii.find_pii(docs)).orderBy("doc_id").collect()
    assert rows[0].spans == "email:22:28,ip:8:15" and [float(x) for x in rows[0].scores.split(",")] == [1.0, 0.4]
