from aktarium.operators import filters
from aktarium.operators.text_index import TextIndex
from aktarium.session import scratch


def same(index, rows, term):
    ids = lambda df: sorted(r.id for r in df.collect())
    want = ids(filters.search_text(rows, index.columns, term))
    assert ids(index.search(rows, term)) == want, term
    return want


def test_finds_what_the_scan_finds(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").selectExpr("doc_id AS id", "text", "source AS name")
    index = TextIndex(spark, scratch(spark), ["text", "name"])
    index.extend(docs)
    some = docs.filter("length(text) > 200").first()
    for term in (some.text[50:75], some.text[100:104].upper(), "src1", "zzzzzz", "an", "", "the "):
        same(index, docs, term)
    assert len(index.buckets_of(some.text[50:150])) <= 8 < index.buckets == 64
    plan = index.search(docs, "zzzzzz")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]


def test_odd_rows_and_changes(spark):
    shape = "id long, text string, name string"
    rows = [(1, "Über die Brücke", None), (2, None, "brücke"), (3, "", ""), (4, "Brü", "cke"), (None, "brücke", "x"), (5, "100%_a\\b", "é\U0001f600z"), (5, "zweimal brücke", "y")]
    df = spark.createDataFrame(rows, shape)
    index = TextIndex(spark, scratch(spark), ["text", "name"])
    index.extend(df)
    held = df.filter("id IS NOT NULL")
    assert same(index, held, "BRÜCKE") == [1, 2, 5] and same(index, held, "%_a\\") == [5] and same(index, held, "É\U0001f600Z") == [5] and same(index, held, "brücke im") == []
    changed = spark.createDataFrame([(1, "Unter dem Steg", None), (2, None, "brücke"), (7, "neue Brücke", None)], shape)
    index.extend(changed.filter("id in (1, 7)"))
    assert same(index, changed, "brücke") == [2, 7] and same(index, changed, "steg") == [1]
    index.extend(df.limit(0))
    assert index.search(changed.limit(0), "brücke").count() == 0
