import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from aktarium.llm import entries, line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10):
    """rows: (doc, text) -> (n_lines, n_dropped, text) of each row; null ids come last, as one document."""
    place = lambda d: float("inf") if d is None else d
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(place(d))
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == place(d)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_op6_equals_brute_force_and_sql(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    want = {(d.doc_id, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, (n, m, t) in zip(docs, plain([(d.doc_id, d.text) for d in docs]), strict=True)}
    got = {tuple(r) for r in entries.op6_line_dedup(spark, tiny).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    assert got == want == {tuple(r) for r in con.sql(entries.ORACLES["op6_line_dedup"]).fetchall()}


def test_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    out = line_dedup.dedup_lines(odd_docs)
    assert out.columns == [*[c for c in odd_docs.columns if c != "n_lines"], "n_lines", "n_dropped"]
    want = Counter((d, n, m, t) for (d, _), (n, m, t) in zip(rows, plain(rows), strict=True))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()) == want
    assert any(r.text is None for r in out.collect())
    assert line_dedup.dedup_lines(no_docs).count() == 0


@pytest.mark.parametrize(("least", "most", "per_key"), [(16, 29, 16), (4, 4, 0), (8, 11, 16)])
def test_full_filters_and_rounds_only_cost_time(spark, monkeypatch, least, most, per_key):
    """Filters of 16 bits are full at once: everything is suspected, and the result is the same; so it is in four rounds."""
    for name, value in (("LEAST_BITS", least), ("MOST_BITS", most), ("BITS_PER_KEY", per_key)):
        monkeypatch.setattr(line_dedup, name, value)
    rows = [(k, "\n".join(f"line number {(k * 7 + j * j) % 150}" for j in range(6))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(df).collect()}
    assert got == dict(zip([d for d, _ in rows], plain(rows), strict=True))


def test_hot_lines_and_ids(spark, monkeypatch):
    """A line in all documents, a third of them without an id and a third with one, the largest; keys of many rows are dealt."""
    monkeypatch.setattr(line_dedup, "USUAL", 16)
    ids = [None if k % 3 == 0 else 2**63 - 1 if k % 3 == 1 else k for k in range(150)]
    rows = [(d, f"the line that all of them have\nown line number {k}\nshared line number {k % 7}") for k, d in enumerate(ids)]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == Counter((d, *x[:2], x[2]) for (d, _), x in zip(rows, plain(rows), strict=True))


def test_ids_of_other_types(spark):
    rows = [("b", "the same line here"), ("a", "the same line here\nother"), (None, "the same line here"), (None, "only without an id"), (None, "only without an id")]
    got = sorted(((r.doc_id or "", r.n_dropped, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()))
    assert got == [("", 0, "only without an id"), ("", 0, "only without an id"), ("", 1, ""), ("a", 0, "the same line here\nother"), ("b", 1, "")]


@pytest.mark.parametrize("most_bits", [29, 17])
def test_suspects_have_every_repeated_key_and_few_others(spark, most_bits):
    rng = np.random.default_rng(5)
    h = rng.integers(-(2**63), 2**63 - 1, 20_000)
    keys = [(int(x), 0, k) for k, x in enumerate(np.concatenate([h, h[:500]]))]
    df = spark.createDataFrame(keys, "h long, g long, doc long").repartition(7)
    found = Counter(r.h for r in line_dedup.suspects(df, len(keys), most_bits).collect())
    assert all(found[int(x)] == 2 for x in h[:500])
    assert sum(found.values()) < 1000 + 0.02 * len(h)


def test_keys():
    k = line_dedup.line_keys("  ABCdefghij\t\nabcdefghij\nABCDEFGHI\nÄÖÜäöüßßßß\nÄÖÜ", 10)
    assert k[0] == k[1] is not None and k[2] is None and k[3] is not None and k[4] is None
