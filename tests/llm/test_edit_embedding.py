import hashlib

import numpy as np

from aktarium.llm import edit_embedding as ee
from aktarium.llm import entries


def walked(text, shared):
    """The symbols that one walk over a whole text puts out."""
    out, at, symbols = [], 0, ee._symbols(text)
    while at < len(symbols):
        out.append(int(symbols[at]))
        at += int(shared.moves[(len(out) - 1) % ee.PERIOD, symbols[at]])
    return out


def sampled(records, length, bits):
    """What each bit's reservoir holds below a length."""
    now = [0] * bits
    for position, bit in zip(*records, strict=True):
        if position < length:
            now[bit] = int(position)
    return now


def plain(text, bits=64):
    shared = ee.walks(42, bits)
    if not text:
        return [int(shared.faces[b, 255]) for b in range(bits)]
    starts = shared.cuts(text)
    parts = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
    places = sampled(shared.of_text, len(text), bits)
    walks, out = [walked(p, shared) for p in parts], []
    chosen = [sampled(shared.of_walk, len(w), bits) for w in walks]
    for b in range(bits):
        s = min(places[b] // ee.SEGMENT, len(parts) - 1)
        out.append(int(shared.faces[b, walks[s][chosen[s][b]]]))
    return out


def test_fingerprints_are_those_of_single_walks(monkeypatch):
    monkeypatch.setattr(ee, "SEGMENT", 60)
    monkeypatch.setattr(ee, "WINDOW", 16)
    monkeypatch.setattr(ee, "TOGETHER", 500)
    rng = np.random.default_rng(5)
    texts = ["", "a", "ab", "Ünï\U0001f600"] + ["".join(rng.choice(list("abcde \nÄ"), n)) for n in (30, 59, 76, 77, 200, 777, 77, 1500)]
    texts.append(texts[-1])
    got = np.unpackbits(ee.fingerprints(texts, bits=64), axis=1).tolist()
    assert got == [plain(t) for t in texts]
    assert got[-1] == got[-2]


def test_edit_distance_shows():
    rng = np.random.default_rng(1)
    words = np.array([w for w in "der die und ein haus baum lauf sprung wasser licht nacht morgen stadt land".split()])
    text = " ".join(rng.choice(words, 800))
    other = " ".join(rng.choice(words, 800))
    inserted = text[:1000] + "xyz" + text[1000:]
    a, b, c, d = ee.fingerprints([text, other, inserted, ee.edited(text, other)])
    assert ee.likeness(a, a) == 1.0
    assert ee.likeness(a, c) > 0.6 > 0.3 > ee.likeness(a, b)
    assert 0.5 < ee.likeness(a, d) < 0.85


def expected(rows):
    """(id, digest of the edited text) of each row, by the plain rule."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1] or ""
        text = text or ""
        third = len(text) // 3
        out.append((i, len(text), hashlib.sha256((text[: len(text) - third] + following[:third]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_op11_edits_with_the_next_document(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    got = entries.op11_edit_embedding(spark, tiny).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == expected(rows)
    texts = {i: t or "" for i, t in rows}
    prints = {i: p.tobytes().hex() for i, p in zip(texts, ee.fingerprints(list(texts.values())), strict=True)}
    assert all(r.fingerprint == prints[r.doc_id] for r in got)
    unpacked = {r.doc_id: np.frombuffer(bytes.fromhex(r.fingerprint), np.uint8) for r in got}
    order = sorted(unpacked, reverse=True)
    for r in got:
        following = unpacked[order[(order.index(r.doc_id) + 1) % len(order)]]
        assert r.near_next == float(ee.likeness(unpacked[r.doc_id], following))
        assert r.near_edited == float(ee.likeness(unpacked[r.doc_id], np.frombuffer(bytes.fromhex(r.edited_fingerprint), np.uint8)))
    # classes: links of at most 31 bits, by brute force
    distinct = sorted(set(prints.values()))
    packed = np.stack([np.frombuffer(bytes.fromhex(x), np.uint8) for x in distinct])
    group = list(range(len(distinct)))
    for a in range(len(distinct)):
        for b in np.flatnonzero(np.bitwise_count(packed ^ packed[a]).sum(axis=1) <= 31):
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    of = dict(zip(distinct, group, strict=True))
    least = {}
    for i, p in prints.items():
        least[of[p]] = min(i, least.get(of[p], i))
    found = ee.classes(ee.edit_fingerprints(spark.read.parquet(f"{tiny}/documents.parquet")).select("doc_id", "fingerprint")).collect()
    assert {bytes(r.fingerprint).hex(): r.class_id for r in found} == {p: least[of[p]] for p in distinct}


def test_many_tasks_keep_their_neighbours(spark):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = ee.edit_fingerprints(df).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == expected(rows)
    one = ee.edit_fingerprints(df.filter("doc_id = 5")).first()
    assert (one.near_next, one.n_chars) == (1.0, len(rows[5][1]))


def test_crowded_bands_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ee, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, 128).astype(np.uint8)
    rows = []
    for i in range(60):
        p = base.copy()
        p[rng.integers(0, 128, 2)] ^= np.uint8(1 << int(rng.integers(0, 8)))
        rows.append((i, bytearray(p.tobytes())))
    rows += [(100 + i, bytearray(rng.integers(0, 256, 128).astype(np.uint8).tobytes())) for i in range(20)]
    got = {bytes(r.fingerprint): r.class_id for r in ee.classes(spark.createDataFrame(rows, "doc_id long, fingerprint binary")).collect()}
    assert {got[bytes(p)] for i, p in rows if i < 60} == {0}
    assert all(got[bytes(p)] == i for i, p in rows if i >= 100)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = ee.edit_fingerprints(odd_docs).collect()
    assert len(got) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert sorted(str((r.doc_id, r.n_chars)) for r in got) == sorted(str((i, len(t or ""))) for i, t in rows)
    assert ee.edit_fingerprints(no_docs).collect() == []
    assert ee.classes(ee.edit_fingerprints(no_docs).select("doc_id", "fingerprint")).collect() == []
    small = ee.edit_fingerprints(odd_docs.filter("doc_id in (1, 2)")).collect()
    assert [r.near_edited for r in small] == [1.0, 1.0]
