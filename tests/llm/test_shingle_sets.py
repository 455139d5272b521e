import random

import corpus_pipeline as pipeline
import numpy as np
import pyarrow as pa
import pytest

from aktarium.llm import shingle_sets, simhash


def plain_shingles(text, size=5):
    words = (text or "").split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def plain_groups(rows, similarity=0.8):
    """The least id of each row's component, every pair compared."""
    sets, at = [plain_shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = at[i], at[j]
                at = [min(a, b) if k in (a, b) else k for k in at]
    return {rows[k][0]: min(rows[j][0] for j in range(len(rows)) if at[j] == at[k]) for k in range(len(rows))}


def made(seed):
    """Texts of a common passage and words of their own, and copies of them and of copies with some words changed."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(12)]
    texts = [passage + [word() for _ in range(rng.choice([3, 20, 60, 200]))] for _ in range(60)]
    for _ in range(140):
        copy = list(rng.choice(texts))
        for _ in range(rng.randrange(0, 8)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(copy)
    return [(k, " ".join(t)) for k, t in enumerate(texts)] + [(900, ""), (901, " \n"), (902, "a b"), (903, "a b"), (904, "a b c")]


@pytest.mark.parametrize(("few", "block", "sample"), [(64, 2048, 8192), (3, 8, 8192), (3, 8, 0)])
def test_components_equal_brute_force(spark, monkeypatch, few, block, sample):
    monkeypatch.setattr(shingle_sets, "FEW", few)
    monkeypatch.setattr(shingle_sets, "BLOCK", block)
    monkeypatch.setattr(shingle_sets, "SAMPLE", sample)
    rows = made(5)
    got = {r.doc_id: r.component_id for r in shingle_sets.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_groups(rows)
    assert got == want and 20 < len(set(want.values())) < len(rows)


@pytest.mark.parametrize(("few", "block"), [(64, 2048), (3, 8)])
def test_fingerprints_come_first_and_lose_nothing(spark, monkeypatch, few, block):
    seen, links = [], simhash.links
    monkeypatch.setattr(shingle_sets, "FEW", few)
    monkeypatch.setattr(shingle_sets, "BLOCK", block)
    monkeypatch.setattr(simhash, "links", lambda fps: seen.append(links(fps)) or seen[-1])
    rows = made(5)
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(seen) == 1 and got == plain_groups(rows)


def test_fingerprints_link_the_closest_texts_by_themselves(spark, monkeypatch):
    """Without any key texts are linked that differ little, and only where their sets are similar."""
    monkeypatch.setattr(shingle_sets, "prefix", lambda found, *_: found[:0])
    words = [f"word{k * k % 1009}x{k}" for k in range(3000)]
    texts = [words, [*words[:2000], "other", *words[2001:]], [*words, "end"], [*words[:1500], *(f"new{k}" for k in range(1500))], words[:2], words[:2]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}


def test_fingerprints_count_bits():
    sets = [np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, np.uint64)) for n in (1, 2, 7, 20_000)]
    for s in sets:
        want = sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in s) > len(s))
        assert shingle_sets._fingerprint(s) & ((1 << 64) - 1) == want
    assert shingle_sets._fingerprint(np.zeros(0, np.uint64)) == 0


def test_the_pipeline_drops_copies_with_changed_words(spark, tiny):
    words = [f"word{k * k % 1009}" for k in range(200)]
    texts = [words, [*words[:90], "other", *words[91:]], [*words[:50], "x", *words[51:150], "y", *words[151:]], words[100:]]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "web", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, tiny).collect()) == [0, 3]


def test_sketches_never_say_more_than_sets_differ():
    rng = np.random.default_rng(8)
    for n in (1, 50, 3000):
        a, b = (np.unique(rng.integers(0, 2 * n + 1, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        apart = np.bitwise_count(np.frombuffer(shingle_sets._sketch(a), np.uint64) ^ np.frombuffer(shingle_sets._sketch(b), np.uint64)).sum()
        assert apart <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("size", [1, 3, 5])
def test_hashes_stand_for_shingles(size):
    """Texts have as many hashes as shingles, and in common as many as they have shingles in common."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "C", "dd"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 40, 200)] + [None, " \n", "b A", "a b", "c a\tb\x0bDD  c", "é É"]
    sets, plain = shingle_sets.shingle_sets(pa.array(texts), size), [plain_shingles((t or "").encode().lower(), size) for t in texts]
    for x, p in zip(sets, plain, strict=True):
        assert len(x) == len(p)
        assert [len(np.intersect1d(x, y)) for y in sets] == [len(p & q) for q in plain]
    assert [x.tolist() for x in shingle_sets.shingle_sets(pa.array(texts)[5:8], size)] == [x.tolist() for x in sets[5:8]]
