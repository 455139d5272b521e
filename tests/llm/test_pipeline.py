import struct
import zlib
from collections import Counter

import corpus_pipeline as pipeline
from aktarium import session
from aktarium.llm import mixing, quality
from aktarium.llm.common import P, word_count
from pyspark.sql import functions as F

from .test_lines import plain as plain_lines
from .test_shingle_sets import plain_groups
from .test_tokens_and_packing import check_packing, library


def test_each_stage_does_its_work_on_what_the_last_one_kept(spark, tiny, tmp_path):
    docs, seen = spark.read.parquet(f"{tiny}/documents.parquet"), []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        stage(spark, docs, tiny).write.parquet(out := f"{tmp_path}/{k}")
        docs = spark.read.parquet(out)
        seen.append((name, before.collect(), docs.collect()))
        if k < 4:
            assert docs.dtypes == before.dtypes
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, packed) = seen

    model = quality.fit_model(spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet"))
    assert Counter(b) == Counter(r for r in a if quality.score(model, r.text) >= 0.7) and len(b) < len(a)

    by_id = {r.doc_id: r for r in b}
    lines = dict(zip([r.doc_id for r in b], plain_lines([(r.doc_id, r.text) for r in b]), strict=True))
    assert {r.doc_id: r.text for r in c} == {i: t for i, (_, _, t) in lines.items()}
    assert all(r.n_chars == (len(r.text) if lines[r.doc_id][1] else by_id[r.doc_id].n_chars) for r in c)

    groups = plain_groups([(r.doc_id, r.text) for r in c])
    assert Counter(d) == Counter(r for r in c if groups[r.doc_id] == r.doc_id) and len(d) < len(c)

    copies, sizes = Counter(r.doc_id for r in e), {r.doc_id: len(r.text.split()) for r in d}
    target = {r.source: r.target for r in mixing.mix(spark.createDataFrame(d).withColumn(P + "w", word_count(F.col("text"))), size=P + "w").collect()}
    for source, t in target.items():
        mine = [r.doc_id for r in d if r.source == source]
        assert abs(sum(copies[i] * sizes[i] for i in mine) - t) <= max(sizes[i] for i in mine)
    assert max(copies.values()) <= 3 and set(e) <= set(d)

    tok = library()
    ids = {r.doc_id: [*tok.encode(r.text, add_special_tokens=False).ids, 1] for r in e}
    crc = lambda part: zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    want = Counter((i, s, crc(x[s : s + 2048])) for i, x in ids.items() for s in range(0, len(x), 2048) for _ in range(copies[i]))
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in packed) == want
    single = {}
    for r in packed:
        single.setdefault((r.doc_id, r.start), r)
    if max(copies.values()) == 1:
        check_packing(list(single.values()), {r.doc_id: r.text for r in e}, tok, 2048)


def test_run_is_the_stages_one_after_the_other_and_leaves_only_what_the_last_one_needs(spark, tiny, tmp_path):
    import __spark_entry__

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, tiny).write.parquet(out := f"{tmp_path}/{k}")
        docs = spark.read.parquet(out)
    session.drop_stored(spark)
    piece = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert Counter(map(piece, __spark_entry__.queries()["pipeline"](spark, tiny).collect())) == Counter(map(piece, docs.collect()))
    # The mixed documents, pieces and their ranks.
    assert session.drop_stored(spark) <= 4


def test_stages_with_odd_and_no_documents(spark, tiny, odd_docs, no_docs):
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, no_docs, tiny).count() == 0 and stage(spark, odd_docs, tiny).columns == odd_docs.columns, name
    assert pipeline.pack_windows(spark, no_docs, tiny).count() == 0
    ids = Counter(r.doc_id for r in odd_docs.collect())
    # No line goes whole but those that an earlier document has, and no row does.
    lines = pipeline.drop_lines(spark, odd_docs, tiny).collect()
    assert Counter(r.doc_id for r in lines) == ids and {r.doc_id: r.text for r in lines}[5] == "" and {r.doc_id: r.text for r in lines}[6] == "something else entirely different"
    assert all(r.n_chars == len(r.text) for r in lines if r.doc_id in (5, 6)) and any(r.text is None for r in lines)
    mixed = Counter(r.doc_id for r in pipeline.mix_sources(spark, odd_docs, tiny).collect())
    assert set(mixed) <= set(ids) and all(n <= 3 * ids[d] for d, n in mixed.items())
    assert Counter(r.doc_id for r in pipeline.pack_windows(spark, odd_docs, tiny).filter("start = 0").collect()) == ids
    kept = pipeline.drop_near_duplicates(spark, odd_docs, tiny).collect()
    assert len([r for r in kept if r.doc_id is None]) == 2 and len([r for r in kept if r.doc_id == 4]) == 2 and not [r for r in kept if r.doc_id == 5]


def test_mixes_of_repeated_ids_agree_wherever_the_rows_lie(spark, tmp_path):
    rows = [(k % 5, f"word{k} other{k % 11}", "en" if k % 3 else None, "abc"[k % 3], 1) for k in range(120)]
    found = []
    for n, order in (("x", 1), ("y", -1)):
        df = spark.createDataFrame(rows[::order], "doc_id long, text string, lang string, source string, n_chars long")
        df.repartition(3).write.parquet(path := f"{tmp_path}/{n}")
        found.append(Counter(pipeline.mix_sources(spark, spark.read.parquet(path), "").collect()))
    assert found[0] == found[1] and 0 < len(found[0]) < len(rows)
