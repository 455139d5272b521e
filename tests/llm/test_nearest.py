import math
from collections import defaultdict

import numpy as np

from aktarium.llm import entries
from aktarium.llm import one_bit_ann as ann
from pyspark.sql import functions as F


def brute(rows, queries, k):
    """Products summed from the first component to the last, ties to the smaller id."""
    out = {}
    for q in queries:
        found = []
        for i, v in rows.items():
            if i != q:
                total = 0.0
                for x, y in zip(rows[q], v, strict=True):
                    total += x * y
                found.append((-total, i))
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def grouped(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def test_op10_finds_the_nearest_with_exact_scores(spark, tiny):
    rows = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()}
    want = brute(rows, [i for i in rows if i % 20 == 0], 20)
    got = grouped(entries.op10_one_bit_ann(spark, tiny).collect())
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.98 * sum(map(len, want.values()))
    assert all(dict(want[q]).get(i, s) == s for q in want for i, s in got[q])


def test_many_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "INDEX_BLOCK", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(3)
    v = rng.standard_normal((600, 24)).astype(np.float32)
    v[100:400] = v[100]
    rows = [(k, [float(x) for x in v[k]]) for k in range(600)]
    index = ann.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5))
    got = grouped(ann.search(index, index.filter(F.col("id") % 10 == 0), k=15, sigmas=4.0).collect())
    want = brute(dict(rows), range(0, 600, 10), 15)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.99 * 60 * 15
    assert [i for i, _ in got[200]] == [i for i, _ in want[200]]


def test_rows_that_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0, None]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]),
        (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [0.2, 0.1]), (8, [0.2, 0.1]), (9, [-1.0, 0.0]), (40, [0.0, 0.0]), (60, [1.0, 0.0, 0.0]), (80, [5.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit("x"), "code": F.lit(2), "row": F.lit(0), "dim": F.lit(9)})
    index = ann.build_index(df)
    assert sorted(r.id for r in index.collect()) == [0, 7, 8, 8, 9, 20, 60, 80]
    got = grouped(ann.search(index, index.filter(F.col("id") % 20 == 0)).collect())
    assert {q: [i for i, _ in r] for q, r in got.items()} == {0: [20, 8, 8, 9], 20: [0, 8, 8, 9], 60: [7]}
    twice = sorted((r.rank, r.vec_id) for r in ann.search(index, index.filter("id = 8"), k=2).collect())
    assert twice == [(1, 0), (1, 0), (2, 20), (2, 20)]
    empty = ann.build_index(df.limit(0))
    assert ann.search(empty, empty).count() == 0
    assert ann.search(index, index.limit(0)).count() == 0


def test_lengths_of_any_size_and_doubles(spark):
    """Vectors far longer and far shorter than single precision holds; codes of more than one word."""
    rng = np.random.default_rng(2)
    v = rng.standard_normal((120, 70)) * 10.0 ** rng.integers(-120, 120, (120, 1))
    rows = [(k, v[k].tolist()) for k in range(120)]
    index = ann.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    got = grouped(ann.search(index, index.filter(F.col("id") % 20 == 0), k=9).collect())
    want = brute(dict(rows), range(0, 120, 20), 9)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 6 * 9
    assert all(dict(want[q]).get(i, s) == s for q in want for i, s in got[q])


def test_recall_at_three_sizes(spark):
    """Independent directions, the hardest case: no vector is much nearer than others."""
    rng = np.random.default_rng(6)
    for n in (300, 3_000, 12_000):
        v = rng.standard_normal((n, 64)).astype(np.float32)
        df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(6)
        index = ann.build_index(df)
        found = grouped(ann.search(index, index.filter(F.col("id") % 100 == 0), k=20).collect())
        scores = v[::100].astype(float) @ v.T.astype(float)
        scores[np.arange(len(scores)), np.arange(0, n, 100)] = -np.inf
        best = np.argsort(-scores, axis=1)[:, :20]
        recall = np.mean([len({i for i, _ in found[100 * k]} & set(best[k].tolist())) / 20 for k in range(len(best))])
        assert recall >= 0.95, (n, recall)


def test_error_bounds_hold():
    rng = np.random.default_rng(8)
    for dim in (64, 100):
        v, q = rng.standard_normal((4000, dim)), rng.standard_normal((1, dim))
        turn = ann.rotation(dim, 42)
        code, length, f = ann.encode(v, turn)
        planes = ann.Planes(q, turn)
        estimate = planes.estimates(slice(0, 1), code, f)[0] * length * np.linalg.norm(q)
        # The counts of common bits give what the signs and the rounded query give.
        signs = (np.unpackbits(code.view(np.uint8), axis=1)[:, :dim].astype(float)) * 2 - 1
        level = np.rint(((turn @ q[0] / np.linalg.norm(q)) - planes.low[0]) / planes.step[0])
        assert np.allclose(signs @ (planes.low[0] + planes.step[0] * level) / f / np.sqrt(dim) * length * np.linalg.norm(q), estimate, rtol=1e-4, atol=1e-3)
        bound = length * np.sqrt((1 - f * f) / (dim - 1) + planes.rounding[0] ** 2) / f * np.linalg.norm(q)
        over = np.abs(estimate - v @ q[0]) / bound
        assert np.mean(over < 3) > 0.99 and np.mean(over < 1) < 0.9
        assert np.allclose(turn @ turn.T, np.eye(dim))
