import numpy as np
import pytest

from aktarium.operators import retrieval
from aktarium.operators.vector_index import VectorIndex, search_indexed
from aktarium.plans.archive import Archive
from aktarium.session import scratch
from pyspark.sql import functions as F

CHUNK = "id long, document_id long, position int, content string, embedding array<float>, embedding_model string, embedding_model_version string"


def chunks_of(spark, vectors, document=lambda k: k):
    rows = [(k, document(k), 0, f"chunk {k}", None if v is None else [float(x) for x in v], "m", "1") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, CHUNK)


def same(a, b):
    key = lambda r: (round(-r.score, 9), r.document_id, r.chunk_id)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_agrees_with_the_scan_in_scopes_of_three_sizes(spark, tiny, sf):
    a = Archive(spark, tiny.replace("sf0.001", sf))
    chunks = a.chunks
    index = VectorIndex.build(chunks, scratch(spark), rows_per_cell=64)
    n = chunks.count()
    assert index.rows().count() == n
    q = chunks.filter("id = 77").first().embedding
    for share in (1, 3, 50):
        scope = spark.range(200).filter(F.col("id") % share == 0)
        same(search_indexed(index, scope, q, 20), retrieval.search(chunks, scope, q, 20))
    # Codes of at most all rows, vectors of few more than the documents asked for (or there).
    rows, read = index.near(spark.range(200), q, 20)
    assert read.rows <= n == read.all_rows and read.fetched <= 200 and rows.count() == read.fetched


def test_cells_that_cannot_hold_a_better_one_are_not_read(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32))
    vectors = np.concatenate([c + 0.05 * rng.standard_normal((100, 32)) for c in centres])
    chunks = chunks_of(spark, vectors)
    index = VectorIndex.build(chunks, scratch(spark), rows_per_cell=100)
    scope = spark.range(4000)
    _, read = index.near(scope, vectors[5], 20)
    assert read.rows <= 0.15 * read.all_rows and read.fetched <= 100
    same(search_indexed(index, scope, vectors[5], 20), retrieval.search(chunks, scope, vectors[5], 20))
    # Nothing of the nearest cells is in scope: the search widens.
    narrow = scope.filter("id >= 3000 and id % 100 = 7")
    same(search_indexed(index, narrow, vectors[5], 20), retrieval.search(chunks, narrow, vectors[5], 20))
    # With a least score that nothing far reaches, what is far isn't read.
    assert index.near(narrow, vectors[5], 20, by="id", least=0.9)[1].rows <= 0.15 * read.all_rows


def test_rows_added_later_are_found(spark):
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((300, 16))
    chunks = chunks_of(spark, vectors, lambda k: k // 3)
    path = scratch(spark)
    VectorIndex.build(chunks.filter("id < 200"), path, rows_per_cell=20).extend(chunks.filter("id >= 200"))
    index, scope = VectorIndex(spark, path), spark.range(100)
    for q in (vectors[3], vectors[250], -vectors[250]):
        same(search_indexed(index, scope, q, 10), retrieval.search(chunks, scope, q, 10))


def test_odd_vectors_lengths_and_empty_tables(spark):
    vectors = [[1.0, 2.0], None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [3.0, 1.0, 2.0], [1.0, 2.0], [-1e30, 1e30]]
    index = VectorIndex.build(chunks_of(spark, vectors), scratch(spark))
    scope = spark.range(20)
    found = search_indexed(index, scope, [1.0, 2.0], 5).collect()
    assert [r.document_id for r in found] == [0, 7, 8] and found[0].score == pytest.approx(1.0)
    assert [r.document_id for r in search_indexed(index, scope, [1.0, 0, 0], 5).collect()] == [6]
    for q in ([0.0, 0.0], [1.0], [float("nan"), 1.0]):
        assert search_indexed(index, scope, q, 5).collect() == []
    assert search_indexed(index, scope.limit(0), [1.0, 2.0], 5).collect() == []
    empty = VectorIndex.build(chunks_of(spark, vectors).limit(0), scratch(spark))
    assert search_indexed(empty, scope, [1.0, 2.0], 5).collect() == []


def test_many_ties_are_all_kept(spark):
    chunks = chunks_of(spark, [[1.0, 1.0]] * 1500 + [[1.0, 0.0]] * 20)
    index = VectorIndex.build(chunks, scratch(spark), rows_per_cell=500)
    same(search_indexed(index, spark.range(2000), [1.0, 1.0], 7), retrieval.search(chunks, spark.range(2000), [1.0, 1.0], 7))
