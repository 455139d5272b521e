import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aktarium.llm import entries, quality


def test_op2_separates_held_out_labels(spark, tiny):
    rows = entries.op2_quality(spark, tiny.replace("sf0.001", "sf0.01")).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tiny.replace('sf0.001', 'sf0.01')}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.95


def test_labels_of_held_out_rows_are_never_used(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit_model(docs, labels), quality.fit_model(docs, flipped)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_training_is_the_same_however_rows_are_dealt(spark, tiny):
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    a, b = quality.fit_model(docs.repartition(7), labels, most=50), quality.fit_model(docs.repartition(2), labels.repartition(3), most=50)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_score_is_the_dot_product_of_the_features(monkeypatch):
    rng = np.random.default_rng(0)
    model = quality.Model(rng.standard_normal(1 << quality.BITS).astype(np.float32), 0.3)
    text = " ".join(f"Wort{k % 50}{'!' * (k % 4)}" for k in range(300))
    at, value = quality.features(text)
    want = 1 / (1 + np.exp(-(model.bias + value @ model.weights[at])))
    assert quality.score(model, text) == pytest.approx(want, rel=1e-6)
    texts = pa.array([None, "Wort1", text, "", " Wort1 Wort1 ", text[:-9]])
    each = [quality.score(model, t) for t in texts.to_pylist()]
    assert quality.scores(model, texts).tolist() == each and each[2] == pytest.approx(want, rel=1e-6)
    assert all(len(v) == len(set(a)) for a, v in map(quality.features, texts.to_pylist()))
    for size in (1, 2, 11):
        monkeypatch.setattr(quality, "_SLICE", size)
        assert quality.scores(model, texts).tolist() == each
        assert quality.features(text)[0].tolist() == at.tolist()


def test_one_row_of_a_repeated_id_is_learned_from_and_features_are_bounded(spark, tiny, monkeypatch):
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    a = quality.fit_model(docs, labels)
    b = quality.fit_model(docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" zzz")))), labels)
    assert a.bias == b.bias and (a.weights == b.weights).all()
    monkeypatch.setattr(quality, "MOST_TRAINING_FEATURES", 0)
    assert quality.fit_model(docs, labels).bias == 0


def test_updates_equal_a_plain_loop():
    rows = [(np.array([3, 5]), np.array([1.0, 0.5]), 1), (np.array([5, 9]), np.array([2.0, 1.0]), 0)] * 3
    fit = quality.Fit(epochs=2)
    z, n = {}, {}

    def weight(i):
        l1, l2 = (0, 0) if i == "b" else (fit.l1, fit.l2)
        if abs(z.get(i, 0)) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((fit.beta + n[i] ** 0.5) / fit.alpha + l2)

    for _ in range(2):
        for at, value, y in rows:
            x = dict(zip(at.tolist(), value.tolist(), strict=True)) | {"b": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] = z.get(i, 0) + g - ((n.get(i, 0) + g * g) ** 0.5 - n.get(i, 0) ** 0.5) / fit.alpha * w[i]
                n[i] = n.get(i, 0) + g * g
    model = quality.train(rows, fit)
    assert model.bias == pytest.approx(weight("b")) and all(model.weights[i] == pytest.approx(weight(i), rel=1e-5) for i in (3, 5, 9))
    assert np.count_nonzero(model.weights) == 3


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (3, None), (None, 1), (6, 1)], "doc_id long, quality int")
    model = quality.fit_model(odd_docs, labels)
    out = quality.score_documents(odd_docs, model)
    assert out.count() == odd_docs.count() and out.columns == [*[c for c in odd_docs.columns if c not in ("score", "predicted")], "score", "predicted"]
    rows = out.collect()
    bias = 1 / (1 + np.exp(-model.bias))
    assert all(r.score == pytest.approx(bias) for r in rows if not (r.text or "").strip())
    assert quality.score_documents(no_docs, model).count() == 0
    nothing = quality.fit_model(no_docs, labels.limit(0))
    assert nothing.bias == 0 and not nothing.weights.any()
    assert {r.score for r in quality.score_documents(odd_docs, nothing).collect()} == {0.5}
