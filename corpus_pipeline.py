"""The corpus pipeline: five stages over `documents`, each of them written as Parquet and read again as the next one's input.

1. quality: documents that the quality classifier rejects go;
2. lines: lines that an earlier document has go;
3. near_duplicates: of each group of near-duplicates the document with the smallest id stays;
4. mix: sources are mixed to target weights, a document that the mix takes several times is there several times;
5. pack: what remains is packed into windows of 2048 tokens.

All stages but the last return the columns of `documents` (n_chars follows the text). Repeated rows of one id are kept or
dropped together by stages 1 to 3, and counted singly by 4 and 5. Nulls, empty texts and empty tables pass as each operator
defines: a null text stays null. Other columns of the input stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aktarium.llm import line_dedup, mixing, packing, quality, simhash
from aktarium.llm.common import P, discard, stored, tuned, without_ids, word_count
from aktarium.llm.entries import word_vocabulary
from aktarium.session import collecting, ready, table


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more; the classifier learns from the labels beside the documents."""
    model = quality.fit_model(docs, table(tuned(ready(spark)), sf_dir, "labels"), label="quality")
    score, predicted = P + "score", P + "predicted"
    kept = quality.score_documents(docs, model, threshold=0.7, score_col=score, predicted_col=predicted)
    return kept.filter(F.col(predicted) == 1).select(*_columns(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of at least 10 code points that an earlier document has."""
    tuned(ready(spark))
    out = line_dedup.dedup_lines(docs, least=10, n_lines_col=P + "lines", n_dropped_col=P + "dropped")
    return out.withColumn("n_chars", F.when(F.col(P + "dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near-duplicates (of the shingles of five words that two texts
    hold, 0.8 or more are in both); documents without an id stay. Of the texts only those that may go are shuffled."""
    tuned(ready(spark))
    groups = simhash.similar_texts(docs, similarity=(4, 5), size=5)
    return without_ids(docs, stored(groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    tuned(ready(spark))
    # Rows get a number of their own, so that repeated ids are emitted row by row; sampling goes by id and by what the row
    # holds before that, so that it doesn't depend on the names of files, which change from run to run.
    size, row, copies, held = P + "size", [P + "file", P + "row"], P + "copies", P + "held"
    numbered = _numbered(docs, *row)
    holds = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("text", "lang", "n_chars")))
    taken = mixing.mix(numbered.select("source", "doc_id", *row, holds.alias(held), word_count(F.col("text")).alias(size)), size=size, keep=[held, *row])
    taken = taken.filter("copies > 0").select(*row, F.col("copies").alias(copies))
    return numbered.join(taken.hint("shuffle_hash"), row).withColumn(P + "nth", F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*_columns(docs))


def _numbered(docs: DataFrame, file: str, row: str) -> DataFrame:
    """`docs` with two longs that tell its rows apart, the same however often they're read: a hash of the file, and its
    checksum with the row's place in it. Other frames than a table's files are written first."""
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        path = F.col("_metadata.file_path")
        return docs.select(*_columns(docs), F.xxhash64(path).alias(file), (F.shiftleft(F.crc32(path), 31) + F.col("_metadata.row_index")).alias(row))
    return stored(docs.withColumns({file: F.lit(0).cast("long"), row: F.monotonically_increasing_id()}))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in windows of 2048 tokens."""
    tuned(ready(spark))
    return packing.pack(docs, word_vocabulary(), end_id=1, capacity=2048)


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("quality", filter_quality),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_windows),
]

#: SQL has neither the classifier nor the fingerprints; the tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below `sf_dir`. What a stage wrote on its way, and its input, go once its result is written."""
    docs = table(ready(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with collecting() as paths:
            out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        before, docs = docs, stored(out)
        discard(spark, *paths, before)
    return docs
