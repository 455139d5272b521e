import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from aktarium.llm import components, entries, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(ids, fps, distance=3):
    at = list(range(len(ids)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    fps = np.array(fps, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= distance).tolist():
            a, b = find(i), find(j)
            at[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(ids))]


@settings(max_examples=200, deadline=None)
@given(st.text("aAbÄ \t\n\x0b \x1f", max_size=40) | st.none())
def test_fingerprint_equals_the_plain_one(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_slices_of_long_texts_change_nothing(monkeypatch):
    text = " ".join(f"w{k * k % 97}" for k in range(500))
    monkeypatch.setattr(simhash, "_SLICE", 7)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_op5_equals_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(d.text) for d in docs]
    want = {(d.doc_id, f"{f:016x}", c) for d, f, c in zip(docs, fps, plain_components([d.doc_id for d in docs], fps), strict=True)}
    assert {tuple(r) for r in entries.op5_simhash(spark, tiny).collect()} == want


def test_odd_documents(odd_docs, no_docs):
    rows = odd_docs.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = sorted(map(repr, zip([r.doc_id for r in rows], [f"{f:016x}" for f in fps], plain_components([r.doc_id for r in rows], fps), strict=True)))
    assert sorted(map(repr, map(tuple, simhash.near_duplicates(odd_docs).collect()))) == want
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize(("few", "block"), [(64, 2048), (4, 8)])
def test_links_connect_exactly_what_is_near(spark, monkeypatch, few, block):
    """Clusters of near fingerprints, so that table keys are crowded; joined in the JVM, or in blocks."""
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for _ in range(3):
        fps |= {f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for f in list(fps)[:120]}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(df).collect()]
    if few == 64:  # blocks return stars, whose arms needn't be near
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in edges)
    ids = {f: k for k, f in enumerate(signed)}
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = plain_components(list(range(len(fps))), fps)
    groups = {}
    for f in signed:
        groups.setdefault(got.get(f, f), set()).add(ids[f])
    plain = {}
    for k, c in enumerate(want):
        plain.setdefault(c, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_forest_keeps_components(pairs):
    a, b = np.array(pairs, np.int64).T
    child, top = components.forest(a, b)
    same = lambda es: plain_graph(range(31), es)
    assert same(pairs) == same(list(zip(child.tolist(), top.tolist(), strict=True))) and len(set(child.tolist())) == len(child)


def plain_graph(nodes, edges):
    label = {n: n for n in nodes}
    for _ in label:
        for x, y in edges:
            label[x] = label[y] = min(label[x], label[y])
    return label


def test_components_of_paths_stars_and_nothing(spark):
    rng = random.Random(3)
    path = [(k, k + 1) for k in range(100, 400)]
    star = [(1000, k) for k in range(1001, 1500)] + [(1200, 5)]
    edges = [(y, x) if rng.random() < 0.5 else (x, y) for x, y in path + star] + [(9, 9), (100, 101)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {k: 100 for k in range(100, 401)} | {k: 5 for k in [5, *range(1000, 1500)]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
