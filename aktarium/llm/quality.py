"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches
from .words import Words, split_words

#: Weights are hashed into this power of two.
BITS = 18
#: At most so many labelled rows are learned from; the classifier is fitted on the ones whose hashed ids come first.
MOST_TRAINING_ROWS = 8192
#: And of these, in the same order, as many as have so many non-zero features together (8 bytes each), whatever their length.
MOST_TRAINING_FEATURES = 1 << 25
#: Words handled at once.
_SLICE = 1 << 17
#: Scores sum weights as multiples of this, so that sums are exact in any order.
_UNIT = 2.0**-30
#: Each group of n-grams (words, word pairs, triples of shapes) has relative frequencies, times its scale.
_SCALES = (4.0, 4.0, 8.0)


class Fit(NamedTuple):
    """Rates and penalties of the updates."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-3
    epochs: int = 6


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def _shapes(spellings: pa.StringArray) -> np.ndarray:
    """Case, length, digits and last marks of each word in one byte."""
    stem = pc.replace_substring_regex(spellings, pattern=r"[^\p{L}\p{N}_]+$", replacement="")
    flat = lambda x: x.to_numpy(zero_copy_only=False)
    size = flat(pc.utf8_length(stem))
    marks = flat(pc.utf8_length(spellings)) - size
    usual = flat(pc.is_in(pc.utf8_slice_codeunits(spellings, -1), pa.array(list(".,;:?!"))))
    capital = flat(pc.utf8_is_upper(pc.utf8_slice_codeunits(stem, 0, 1)))
    case = np.where(size == 0, 0, np.where(flat(pc.utf8_is_upper(stem)) & (size > 1), 3, np.where(capital, 2, 1)))
    length = (size > 3).astype(np.int64) + (size > 8) + (size > 14)
    tail = np.where(marks == 0, 0, np.where(marks > 1, 3, np.where(usual, 1, 2)))
    return (case << 5 | length << 3 | tail << 1 | flat(pc.match_substring_regex(spellings, pattern="[0-9]"))).astype(np.uint64)


def _hashed(words: Words) -> np.ndarray:
    """The distinct words as hash << 8 | shape; the hash is that of the lower case."""
    if not len(words.distinct):
        return np.zeros(0, np.uint64)
    lower = words.joined().lower().encode("utf-8", "surrogatepass").split(b"\n")
    return np.fromiter(map(xxhash.xxh64_intdigest, lower), np.uint64, len(lower)) << np.uint64(8) | _shapes(words.distinct)


def n_grams(hashed: np.ndarray, words: Words, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each group of n-grams (words, word pairs, triples of shapes) those that end in the words [start, end) of a batch:
    hashed positions, and whether the n-gram lies in one text."""
    # Two words more to the left, so that no n-gram is lost between slices.
    before = min(start, 2)
    codes = hashed[words.codes[start - before : end]]
    word, shape = codes >> np.uint64(8), codes & np.uint64(255)
    mixed = word * np.uint64(0x9E3779B97F4A7C15)
    kind = shape << np.uint64(1)
    pairs, triples = np.zeros_like(mixed), np.zeros_like(mixed)
    kind[1:] |= (word[1:] == word[:-1]).astype(np.uint64)
    pairs[1:] = (mixed[1:] ^ (mixed[:-1] >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F)
    first = np.zeros(len(codes) + 1, bool)
    first[words.bounds[(words.bounds >= start - before) & (words.bounds < end)] - start + before] = True
    first = first[:-1]
    # A text's first word repeats none of the text before it.
    kind[first] &= ~np.uint64(1)
    triples[2:] = (kind[2:] << np.uint64(18) | kind[1:-1] << np.uint64(9) | kind[:-2]) * np.uint64(0xD6E8FEB86659FD93)
    second = first.copy()
    second[1:] |= first[:-1]
    mask, shift = np.uint64((1 << BITS) - 1), np.uint64(64 - BITS)
    for x, outside, seed in ((mixed, np.zeros_like(first), 0), (pairs, first, 0x15A5A), (triples, second, 0x2B4C3)):
        yield (((x >> shift) ^ np.uint64(seed)) & mask).astype(np.int64)[before:], ~outside[before:]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of a text's non-zero features."""
    words = split_words(pa.array([text], pa.string()))
    hashed, n = _hashed(words), len(words.codes)
    groups = [list(n_grams(hashed, words, at, min(n, at + _SLICE))) for at in range(0, n, _SLICE)]
    at, value = [], []
    for parts, scale in zip(zip(*groups, strict=True), _SCALES, strict=False):
        found, count = np.unique(np.concatenate([x[inside] for x, inside in parts]), return_counts=True)
        at.append(found)
        value.append(count * (scale / max(1, count.sum())))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0)
    found, where = np.unique(np.concatenate(at), return_inverse=True)
    return found, np.bincount(where, np.concatenate(value))


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """The probability of label 1 for each text; one without words has the bias alone.

    A sparse dot product per text, for a batch at once: the weights of all n-grams are summed along the batch, and each text
    takes the difference between its ends.
    """
    words = split_words(texts)
    hashed, n = _hashed(words), len(words.codes)
    whole = np.rint(model.weights / np.float64(_UNIT)).astype(np.int64)
    sums, counts = np.zeros((3, len(texts)), np.int64), np.zeros((3, len(texts)), np.int64)
    for at in range(0, n, _SLICE):
        end = min(n, at + _SLICE)
        bounds = np.clip(words.bounds, at, end) - at
        for k, (x, inside) in enumerate(n_grams(hashed, words, at, end)):
            for into, values in ((sums, np.where(inside, whole[x], 0)), (counts, inside.astype(np.int64))):
                upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
                into[k] += upto[bounds[1:]] - upto[bounds[:-1]]
    margin = model.bias + (sums * _UNIT * np.array(_SCALES)[:, None] / np.maximum(counts, 1)).sum(axis=0)
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def score(model: Model, text: str | None) -> float:
    return float(scores(model, pa.array([text], pa.string()))[0])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], fit: Fit = Fit()) -> Model:
    """Fit on rows (positions, values, label) in their order, `fit.epochs` times.

    Each coordinate keeps z, the sum of its gradients less what the step sizes took back, and n, the sum of its squared
    gradients; its weight follows from both and is zero while |z| is at most l1. The bias is a coordinate without penalty.
    """
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        l1, l2 = np.where(at == size, 0, fit.l1), np.where(at == size, 0, fit.l2)
        found = -(z[at] - np.sign(z[at]) * l1) / ((fit.beta + np.sqrt(n[at])) / fit.alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0, found)

    for _ in range(fit.epochs):
        for at, value, label in rows:
            at, value = np.append(at, size), np.append(value, 1.0)
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / fit.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange(size + 1))
    return Model(w[:size].astype(np.float32), float(w[size]))


def is_held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves 2 by 4. Such rows are never learned from; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_TRAINING_ROWS, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn `label` from at most `most` labelled rows that aren't held out.

    The sample is those whose hashed id comes first, so it's the same in every run, and of these the first that have at
    most MOST_TRAINING_FEATURES features together. Texts become sparse counts where they are; one task receives these, whose
    number is bounded, and makes the updates in a fixed order; the driver gets the weights. Rows without id or label are
    left out; of several labels or texts of one id the least counts. Without labelled rows all weights are zero.
    """
    order = F.xxhash64("id", F.lit(1))
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).dropna().filter(~is_held_out(F.col("id")))
    chosen = known.groupBy("id").agg(F.min("y").alias("y")).withColumn("o", order).orderBy("o", "id").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    # One text of an id, however many rows have it; each task keeps one before anything is shuffled.
    rows = rows.groupBy("id", "o", "y").agg(F.min("text").alias("text"))

    def extract(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t.as_py()) for t in b.column("text")]
        columns = [b.column("o"), b.column("y"), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32()))]
        return pa.record_batch(columns, ["o", "y", "at", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, left = [], MOST_TRAINING_FEATURES
        for b in batches:
            at, value = b.column("at"), b.column("value")
            for i, y in enumerate(b.column("y").to_pylist()):
                left -= len(at[i])
                if left >= 0:
                    got.append((at[i].values.to_numpy(), value[i].values.to_numpy(), y))
        model = train(got, fit)
        yield pa.record_batch([pa.array([model.weights.tobytes()]), pa.array([model.bias])], ["weights", "bias"])

    sparse = in_batches(rows.select("o", "y", "text"), extract, "o long, y int, at array<int>, value array<float>")
    found = sparse.repartition(1).sortWithinPartitions("o", "at").mapInArrow(learn, "weights binary, bias double").first()
    return Model(np.frombuffer(bytes(found.weights), np.float32), found.bias) if found else Model(np.zeros(1 << BITS, np.float32), 0.0)


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """All columns of `docs`, and `score` and `predicted` (1 if the score is `threshold` at least). Names that clash are replaced.

    The model (2^BITS weights) is broadcast. Null and empty texts have the score of the bias. Rows are independent: no
    shuffle, repeated rows and null ids stay, an empty table gives no row.
    """
    docs = docs.drop(score_col, predicted_col)
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        found = scores(shared.value, b.column(text_col))
        return pa.record_batch([*b.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))], [*names, score_col, predicted_col])

    return in_batches(docs, each, f"{kinds}, `{score_col}` double, `{predicted_col}` int")
