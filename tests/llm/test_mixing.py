import re
from collections import Counter, defaultdict

import duckdb
import pytest

from aktarium.llm import entries, mixing
from aktarium.llm.common import P, ranked, word_count
from pyspark.sql import functions as F


def water_fill(sizes, weights, most):
    """Targets by repeated sharing, source by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: most * sizes[s] for s in free if share[s] > most * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def sizes_of(rows):
    out = defaultdict(int)
    for source, text in rows:
        out[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return out


def test_op1_targets_and_taken_words(spark, tiny):
    rows = entries.op1_mixing(spark, tiny).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    sizes = sizes_of((d.source, d.text) for d in docs.values())
    targets = water_fill(sizes, (5, 2, 1), 3)
    taken, longest = Counter(), Counter()
    for r in rows:
        d = docs[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", d.text)) and r.source_size == sizes[d.source]
        assert r.target == pytest.approx(targets[d.source], rel=1e-12)
        assert r.size == 0 and r.taken == 0 or r.taken % r.size == 0 and r.taken <= 3 * r.size
        taken[d.source] += r.taken
        longest[d.source] = max(longest[d.source], r.size)
    assert len(rows) == len(docs)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= longest[s]


def test_op1_reruns_agree_and_equal_the_sql(spark, tiny):
    a, b = (sorted(map(tuple, entries.op1_mixing(spark, tiny).collect())) for _ in range(2))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    assert a == b == sorted(con.sql(entries.ORACLES["op1_mixing"]).fetchall())


def test_odd_documents(odd_docs, no_docs):
    size = P + "size"
    out = mixing.mix(odd_docs.withColumn(size, word_count(F.col("text"))), size=size).collect()
    assert len(out) == odd_docs.count()
    sizes = sizes_of((r.source, r.text) for r in odd_docs.collect())
    targets = water_fill(sizes, (5, 2, 1), 3)
    assert {r.source: r.source_size for r in out} == sizes
    assert all(r.target == pytest.approx(targets[r.source]) and 0 <= r.copies <= 3 for r in out)
    assert all(r.copies == 0 for r in out if r.source_size == 0)
    assert mixing.mix(no_docs.withColumn(size, F.lit(1)), size=size).count() == 0


def test_all_sources_at_their_cap(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2], 10) for k in range(20)], "doc_id long, source string, w long")
    out = mixing.mix(docs, size="w", total=10_000).collect()
    assert {r.copies for r in out} == {3} and {r.target for r in out} == {300.0}


def test_ranks_within_groups_however_they_are_dealt(spark):
    rows = [("hot" if k % 3 else f"g{k % 7}", k * 7919 % 1000, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "g string, o long, id long").repartition(13)
    got = {r.id: r["r"] for r in ranked(df, ["g"], ["o", "id"], "r").collect()}
    by = defaultdict(list)
    for g, o, k in rows:
        by[g].append((o, k))
    assert got == {k: n for group in by.values() for n, (_, k) in enumerate(sorted(group))}
