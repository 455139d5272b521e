import random

from aktarium.operators import languages
from aktarium.plans.archive import Archive
from pyspark.sql import functions as F


def test_held_out_accuracy_and_what_is_no_known_language(spark, tiny):
    docs = Archive(spark, tiny.replace("sf0.001", "sf0.01")).documents.select("id", "lang", "text_content")
    model = languages.fit_languages(docs.filter("id % 4 <> 2"))
    held_out = docs.filter("id % 4 = 2 AND lang IS NOT NULL AND length(trim(text_content)) >= 20")
    rows = languages.identify_languages(held_out, model).join(held_out.select("id", "lang"), "id").collect()
    right = sum(r.found == r.lang for r in rows) / len(rows)
    assert len(rows) > 200 and right >= 0.97
    rng = random.Random(1)
    noise = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(200)), "0123 4567 !!! 89.12 +++ 3456 7890", "ウィキペディアは信頼されるフリーなオンライン百科事典", "Все люди рождаются свободными и равными в своём достоинстве и правах", "zz " * 30]
    short = ["", None, "kurz", " " * 40, "the and of to in it"]
    odd = spark.createDataFrame(list(enumerate(noise + short)), "id long, text_content string")
    assert {r.found for r in languages.identify_languages(odd, model).collect()} == {""}


def test_weights_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(languages, "_SLICE", 7)
    texts = [(1, "de", "Der Hund, der Hund und die Katze!"), (2, "de", "Die Katze und der Hund sind da."), (3, "en", "The dog and the cat are here."), (4, "en", "the dog, THE DOG, the cat; here"), (5, None, "der the der the der the der the")]
    docs = spark.createDataFrame(texts, "id long, lang string, text_content string")
    model = languages.fit_languages(docs, least_count=2)
    assert model.languages == ["de", "en"]
    grams = {languages.gram_text(int(g)): w.tolist() for g, w in zip(model.grams, model.weights, strict=False)}
    assert " de" in grams and "the" in grams and grams["the"][1] > grams["the"][0] and grams[" de"][0] > grams[" de"][1]
    found = {r.id: r.found for r in languages.identify_languages(docs.filter("lang IS NOT NULL"), model).collect()}
    assert found == {1: "de", 2: "de", 3: "en", 4: "en"}
    total, n = model.weigh(" der hund ")
    assert n == 8 and total[0] > total[1]
    assert total.tolist() == [sum(grams.get(" der hund "[k : k + 3], model.weights[-1].tolist())[j] for k in range(8)) for j in range(2)]


def test_no_rows_no_languages(spark):
    docs = spark.createDataFrame([(1, None, "Ein Text ohne bekannte Sprache darin"), (None, "", "")], "id long, lang string, text_content string")
    for known in (docs, docs.limit(0), docs.withColumn("lang", F.lit(None).cast("string"))):
        model = languages.fit_languages(known.filter("lang IS NULL"))
        assert model.languages == [] and {r.found for r in languages.identify_languages(docs, model).collect()} == {""}
    assert languages.identify_languages(docs.limit(0), model).collect() == []
