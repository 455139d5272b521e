"""Substring search without a scan: which rows hold which three characters in a row, and the rows themselves to be sure.

A row that contains a term holds all of its trigrams. The index has a posting for each different trigram of each row, in
lower case: lists of ids by trigram, of some rows each, dealt into buckets by a hash of the trigram and sorted within; a search reads the buckets of the term's trigrams
alone, counts them by row, and looks for the term in what remains. So postings may be behind, or ahead of, the rows: rows that
were changed must be added again, what they held before costs a look and no more, and rows that are gone are found in no table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import search_text
from .languages import trigrams

#: Buckets of postings, and trigrams of a term that are looked up at most: more would hardly leave fewer rows to look at.
BUCKETS, LOOKUPS = 64, 8
#: Postings that a task gathers into lists at once, so that memory doesn't grow with the rows.
GATHERED = 1 << 21
_BETWEEN = "\x00"  # no term has it


def _bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def _lists(ids: pa.Array, held: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """(bucket, gram, ids): of each trigram that one of the rows holds, the ids of those that do."""
    grams, row = np.concatenate(held), np.repeat(np.arange(len(held)), [len(g) for g in held])
    order = np.argsort(grams, kind="stable")
    found, starts = np.unique(grams[order], return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(grams)), pa.int32()), ids.take(pa.array(row[order])))
    return pa.record_batch([pa.array(_bucket(found, buckets)), pa.array(found), lists], ["bucket", "gram", "ids"])


class TextIndex:
    """Postings of some text columns of a table, at a path."""

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str], id_col: str = "id", buckets: int = BUCKETS):
        self.spark, self.path, self.columns, self.id_col, self.buckets = spark, path, list(columns), id_col, buckets

    def extend(self, rows: DataFrame) -> None:
        """Add rows that are new or have changed. What is shuffled is a list of ids for each trigram of some thousand rows, not
        a row for each posting. Large buckets are split and small ones put together, by sizes that the shuffle has shown: so
        texts are read once, and it does no harm that a few trigrams are in most rows."""
        text = F.concat_ws(_BETWEEN, *(F.lower(F.col(c)) for c in self.columns))
        narrow, kind = rows.select(F.col(self.id_col).alias("id"), text.alias("text")), dict(rows.dtypes)[self.id_col]
        buckets = self.buckets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                held, first, n = [], 0, 0
                for k, text in enumerate(b.column("text")):
                    held.append(np.unique(np.concatenate([np.unique(g) for g in trigrams(text.as_py())])))
                    n += len(held[-1])
                    if n >= GATHERED or k == b.num_rows - 1:
                        if n:
                            yield _lists(b.column("id").slice(first, len(held)), held, buckets)
                        held, first, n = [], k + 1, 0

        postings = narrow.filter("id IS NOT NULL").mapInArrow(run, f"bucket int, gram long, ids array<{kind}>")
        postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", F.get("ids", F.lit(0))).write.mode("append").partitionBy("bucket").parquet(f"{self.path}")

    def buckets_of(self, term: str) -> dict[int, list[int]]:
        """The trigrams that a search for a term looks up, by bucket; none for terms of under three characters."""
        grams = np.unique(np.concatenate(list(trigrams(term.lower()))))
        chosen = grams[np.unique(np.linspace(0, len(grams) - 1, min(LOOKUPS, len(grams))).astype(int))] if len(grams) else grams
        found: dict[int, list[int]] = {}
        for gram, bucket in zip(chosen.tolist(), _bucket(chosen, self.buckets).tolist(), strict=True):
            found.setdefault(bucket, []).append(gram)
        return found

    def search(self, rows: DataFrame, term: str) -> DataFrame:
        """`filters.search_text` by the index: the rows that contain `term` in one of the columns, whatever the case."""
        wanted = self.buckets_of(term)
        if not wanted:
            return search_text(rows, self.columns, term)
        grams = [g for own in wanted.values() for g in own]
        postings = self.spark.read.parquet(self.path).filter(F.col("bucket").isin(*wanted) & F.col("gram").isin(*grams))
        held = postings.select(F.explode("ids").alias("id"), "gram").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
        return search_text(rows.join(held.select(F.col("id").alias(self.id_col)), self.id_col, "left_semi"), self.columns, term)
