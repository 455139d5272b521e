"""Token counts by the whole-token shortcut; the counting itself is in `vocab`."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, in_batches
from .vocab import proven, token_counts


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    `path` is a tokenizers file that all workers can open. No shuffle; a batch of texts at a time is in memory. Null and
    empty texts have 0 bytes and 0 tokens. Rows are independent: repeated rows, null ids and an empty table give
    repeated rows, null ids and an empty result. Other columns aren't read.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    whole = docs.sparkSession.sparkContext.broadcast(proven(path))

    # The length in bytes is taken in the JVM, from what travels to Python anyway.
    sized = narrow.withColumn(P + "b", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b.column("id"), b.column(P + "b"), pa.array(token_counts(path, b.column("text"), whole.value))], ["id", "n_bytes", "n_tokens"])

    found = in_batches(sized, each, f"id {kind}, n_bytes long, n_tokens long")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
