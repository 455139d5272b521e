import hashlib
import math

import numpy as np
import pytest

from aktarium.llm import entries
from aktarium.llm import vector_codes as vc
from pyspark.sql import functions as F


def plain(rows, parts=16, entries=64, rounds=2):
    """{place of the row: (codes, error)} and the codebooks, by plain loops over (id, label, vector)."""
    kept = [(k, i, [math.floor(256 * x) for x in v]) for k, (i, _, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = len(kept[0][2])
    cuts = [k * dim // parts for k in range(parts + 1)]
    first = sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[2]))[:entries]
    books = [[r[2][a:b] for r in first] for a, b in zip(cuts, cuts[1:], strict=False)]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, _, v in kept:
                part = v[cuts[p] : cuts[p + 1]]
                groups.setdefault(nearest(part, book)[1], []).append(part)
            for k, found in groups.items():
                book[k] = [sum(c) // len(found) for c in zip(*found, strict=True)]
    out = {}
    for k, _, v in kept:
        found = [nearest(v[cuts[p] : cuts[p + 1]], book) for p, book in enumerate(books)]
        out[k] = [c for _, c in found], sum(d for d, _ in found)
    return out, books


def held(spark, rows, **how):
    df = spark.createDataFrame([(i, lab, v) for i, lab, v in rows], "vec_id long, label int, embedding array<double>")
    coded, books = vc.compress(df, **how)
    return coded.collect(), books


def compared(got, rows, want):
    key = lambda i, lab, codes, error: str((i, lab, codes, error))
    assert sorted(key(r.vec_id, r.label, r.codes, r.error) for r in got) == sorted(key(rows[k][0], rows[k][1], *x) for k, x in want.items())
    totals = {}
    for k, (_, error) in want.items():
        totals[rows[k][1]] = totals.get(rows[k][1], 0) + error
    assert all(r.label_error == totals[r.label] for r in got)


def test_op12_agrees_with_plain_loops(spark, tiny):
    rows = [(r.vec_id, r.label, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    want, books = plain(rows)
    got = {r.vec_id: r for r in entries.op12_vector_codes(spark, tiny).collect()}
    assert {i: (r.code, r.error) for i, r in got.items()} == {rows[k][0]: ("".join(f"{c:02x}" for c in codes), error) for k, (codes, error) in want.items()}
    text = ",".join(str(x) for part in books for e in part for x in e)
    assert {r.codebooks_sha256 for r in got.values()} == {hashlib.sha256(text.encode()).hexdigest()}


def test_ties_copies_nulls_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(vc, "HOT", 20)
    rng = np.random.default_rng(2)
    rows = [(i, i % 3 if i % 5 else None, rng.integers(-3, 3, 6).astype(float).tolist()) for i in range(150)]
    rows += [(7, 1, rows[3][2])] * 80 + [(None, None, [0.0, -0.0, 1e-9, -1e-9, 0.5, 0.5])]
    rows += [(500, 1, None), (501, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, 1, [math.nan] * 6), (503, 1, [math.inf] * 6)]
    want, _ = plain(rows, parts=4, entries=8)
    got, books = held(spark, rows, parts=4, entries=8)
    compared(got, rows, want)
    assert [len(b) for b in books[6]] == [8] * 4
    assert vc.decode(got[0].codes, books, 6) is not None


@pytest.mark.parametrize("rows", [[], [(1, 1, None)], [(None, None, [1.0] * 16)], [(3, None, [0.5, -0.5])]])
def test_small_tables(spark, rows):
    got, books = held(spark, rows)
    assert len(got) == sum(v is not None for _, _, v in rows) and len(books) == len(got)
    assert all(r.error == 0 and r.codes == [0] * 16 for r in got)


def test_lengths_have_their_own_codebooks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, rng.standard_normal(5 if i % 2 else 32).tolist()) for i in range(60)]
    got, books = held(spark, rows, entries=4)
    assert sorted(books) == [5, 32]
    for odd in (0, 1):
        own = [r for r in rows if r[0] % 2 == odd]
        want, _ = plain(own, entries=4)
        assert {r.vec_id: (r.codes, r.error) for r in got if r.vec_id % 2 == odd} == {own[k][0]: x for k, x in want.items()}


def test_large_numbers_stay_exact_or_null(spark):
    rows = [(1, 1, [3e10, 1.0]), (2, 1, [-3e10, 2.0]), (3, 2, [1e300, 0.0]), (4, 3, [2e5 + 0.25, 1.0]), (5, 3, [2e5, 1.0])]
    want, _ = plain([r for r in rows if r[0] != 3], parts=2, entries=1, rounds=1)
    got, _ = held(spark, [r for r in rows if r[0] != 3], parts=2, entries=1, rounds=1)
    fits = lambda x: x if x < 1 << 63 else None
    assert sorted((r.vec_id, r.error) for r in got) == [(i, fits(want[k][1])) for k, i in enumerate((1, 2, 4, 5))]
    assert len(held(spark, rows, parts=2, entries=2)[0]) == 5


def test_other_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, 2, [0.25] * 16)], "vec_id long, label int, embedding array<float>")
    odd = df.withColumns({c: F.lit("x") for c in ("id", "row", "v", "dim", "pos", "part", "n", "code", "error", "key", "codes", "a.b")})
    coded, _ = vc.compress(odd)
    assert [tuple(r) for r in coded.collect()] == [(1, 2, [0] * 16, 0, 0)]
