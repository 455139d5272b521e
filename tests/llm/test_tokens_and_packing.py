import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aktarium.llm import entries, packing, token_counts, vocab

from .conftest import LONG

PATH = entries.word_vocabulary()


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tok():
    return library()


TRICKY = [
    None, "", " ", "it's we'll 'S'd ''t I'M", "a,b.,c ... --- !!? __ x_y", "Straße Łódź İstanbul ΣΟΦΟΣ ß ŉ", "1²½ 10000 ３ 一二 三", "a\x0bb\x1cc\x85d\xa0e　f",
    "<|endoftext|> x<|startoftext|>y <|x|> <|", "é ́ éé", "\U0001f600\U0001f468‍\U0001f469 ok", "\t tab\r\nline\r", LONG, "ǅ ǈ ﬁ ª º µ",
]


def test_ids_equal_the_library(tok):
    flat, counts = vocab.token_ids(PATH, pa.array(TRICKY))
    for text, ids in zip(TRICKY, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
        assert ids.tolist() == tok.encode(text or "", add_special_tokens=False).ids, text
    assert vocab.token_counts(PATH, pa.array(TRICKY)).tolist() == counts.tolist()
    assert vocab.token_counts(PATH, pa.array(TRICKY)[3:9]).tolist() == counts[3:9].tolist() and len(vocab.token_counts(PATH, pa.array([], pa.string()))) == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text("abcÄéß'sStT., \n-_0<|>", max_size=60))
def test_counts_equal_the_library_on_any_text(text):
    want = test_counts_equal_the_library_on_any_text.tok.encode(text, add_special_tokens=False).ids
    assert vocab.token_ids(PATH, pa.array(["x", text, None, text]))[0].tolist() == [*test_counts_equal_the_library_on_any_text.tok.encode("x", add_special_tokens=False).ids, *want, *want]
    assert vocab.token_counts(PATH, pa.array([text])).tolist() == [len(want)]


test_counts_equal_the_library_on_any_text.tok = library()


def test_whole_tokens_are_proven(tok):
    whole = vocab.Vocabulary(PATH).whole_tokens()
    assert len(whole) > 20_000
    for word in list(whole)[::997]:
        assert tok.encode(word, add_special_tokens=False).ids == [whole[word]]


def test_memory_is_bounded_and_forgetting_changes_nothing(monkeypatch):
    texts = pa.array(["qqzx vvkw abab", "the qqzx"])
    before = [x.tolist() for x in vocab.token_ids(PATH, texts)]
    monkeypatch.setattr(vocab, "REMEMBERED", 0)
    assert [x.tolist() for x in vocab.token_ids(PATH, texts)] == before == [x.tolist() for x in vocab.token_ids(PATH, texts)]


def test_counts_of_odd_documents(odd_docs, no_docs, tok):
    rows = token_counts.count_tokens(odd_docs, PATH, limit=10).collect()
    texts = [r.text for r in odd_docs.collect()]
    want = Counter((r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want and len(rows) == len(texts)
    assert all(r.over_limit == (r.n_tokens > 10) for r in rows)
    assert token_counts.count_tokens(no_docs, PATH).count() == 0


def best_fill(counts, largest, capacity):
    """The largest sum up to the room, by trying all multisets."""
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= capacity - largest}
    return sums


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), max_size=5), st.integers(1, 20))
def test_fill_leaves_the_least_padding(counts, largest):
    capacity, array = 32, np.zeros(33, np.int64)
    for length, n in counts.items():
        array[length] = n
    chosen = packing._fill(array, largest, capacity)
    assert all(v <= counts.get(k, 0) for k, v in Counter(chosen).items())
    sums = best_fill(counts, largest, capacity)
    waste = lambda s: 0 if (largest + s) & (largest + s - 1) == 0 else capacity - largest - s
    assert sum(chosen) in sums and waste(sum(chosen)) == min(map(waste, sums))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 1000), max_size=20))
def test_plan_places_each_piece_once(histogram):
    shares = packing.plan_windows(histogram, 64)
    assert Counter({k: v for k, v in histogram.items()}) == Counter({k: sum(s.per_window * s.windows for s in shares if s.length == k) for k in histogram})
    used = Counter()
    for s in shares:
        for w in {s.first_window, s.first_window + s.windows - 1}:
            used[w] += s.length * s.per_window
    assert all(u <= 64 for u in used.values())


def check_packing(rows, texts, tok, capacity):
    """Every id in one piece, windows gapless and never over capacity. Returns the padding."""
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(ids)
    for k, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            part = ids[k][p.start : p.start + p.length]
            assert p.start == at and p.doc_tokens == len(ids[k]) and p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p.length
        assert at == len(ids[k])
    windows, padding = {}, 0
    for r in rows:
        windows.setdefault(r.sequence_id, []).append(r)
    assert sorted(windows) == list(range(len(windows)))
    for ps in windows.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    return padding


def test_op3_is_a_whole_round_trip_with_little_padding(spark, tiny, tok):
    rows = entries.op3_packing(spark, tiny).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    padding = check_packing(rows, texts, tok, 2048)
    assert padding < 0.02 * sum(r.length for r in rows)


def test_packing_of_odd_documents(odd_docs, no_docs, tok):
    single = odd_docs.dropna(subset=["doc_id"]).dropDuplicates(["doc_id"])
    rows = packing.pack(single, PATH, capacity=64).collect()
    check_packing(rows, {r.doc_id: r.text for r in single.collect()}, tok, 64)
    every = packing.pack(odd_docs, PATH, capacity=64).collect()
    assert sum(r.length for r in every) == sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd_docs.collect())
    assert len({(r.sequence_id, r.offset) for r in every}) == len(every)
    assert packing.pack(no_docs, PATH).count() == 0


def test_op8_equals_the_library(spark, tiny, tok):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in entries.op8_token_counts(spark, tiny).collect():
        n = len(tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 2048)
