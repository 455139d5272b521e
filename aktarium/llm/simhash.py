"""Near-duplicates by 64-bit SimHash fingerprints, found by multi-index hashing.

Fingerprints within 3 bits of each other agree in one of their two 32-bit halves up to one bit. So each fingerprint is
entered into a table under both halves, and for each half the ball of radius 1 around it is looked up there. Of two
halves that differ in one bit, one has that bit and the other lacks it; hence looking up the half itself and those with
one set bit cleared finds every pair, with half the lookups. The full distance of each match is verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, in_batches, stored
from .components import components, forest
from .shingle_sets import near_texts

#: Shingles hashed at once, so that memory doesn't grow with a text.
_SLICE = 1 << 16
#: A table key with at most FEW entries is joined in the JVM; others are compared in blocks, each pair of blocks by itself.
FEW, BLOCK = 64, 2048


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of the word shingles of a text; repeated shingles count each time, no word gives 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _SLICE):
        hashes = [xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + _SLICE], ends[at : at + _SLICE], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and `fp`, the fingerprint's bits as a long."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t.as_py(), size, seed) for t in b.column("text")), np.uint64, b.num_rows)
        return pa.record_batch([b.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    return in_batches(narrow, each, f"id {narrow.schema['id'].dataType.simpleString()}, fp long")


def _halves(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))]


def _entries_of(half: Column, which: int) -> Column:
    """Structs (key, exact) of one half: its table entry, and the rest of the ball's lookups, with one set bit cleared."""
    tag = F.lit(which << 32)
    entry = F.struct(half.bitwiseOR(tag).alias("key"), F.lit(True).alias("exact"))
    is_set = lambda i: F.call_function("getbit", half, i) == 1
    cleared = lambda i: half.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).bitwiseOR(tag)
    ball = F.transform(F.filter(F.sequence(F.lit(0), F.lit(31)), is_set), lambda i: F.struct(cleared(i).alias("key"), F.lit(False).alias("exact")))
    return F.concat(F.array(entry), ball)


def _lookups(fp: Column) -> Column:
    return F.concat(*(_entries_of(half, which) for which, half in enumerate(_halves(fp))))


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `a` and `b` of the pairs within `distance`."""
    return np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= distance)


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints `fp` (distinct longs) which links of `distance` bits connect.

    Keys with few entries are joined in the JVM. Keys with more entries and lookups (a group of near copies shares its
    halves) are dealt into blocks; each pair of blocks is compared in one task, which returns a
    spanning forest of the links it found: connectivity is the same, and never more edges leave than fingerprints came.
    Nothing is capped.
    """
    entries = stored(fps.select("fp", F.explode(_lookups(F.col("fp"))).alias("e")).select("e.key", "e.exact", "fp"))
    sizes = entries.groupBy("key").agg(F.count_if("exact").alias("n"), F.count(F.lit(1)).alias("m")).filter("n > 0 and m > 1")
    sizes = stored(sizes)
    hot = sizes.filter(F.col("m") > FEW).select("key", "n", "m")
    usual = entries.join(sizes.filter(F.col("m") <= FEW).select("key"), "key")
    exact = usual.filter("exact").select("key", F.col("fp").alias("a"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    other = usual.select("key", F.col("fp").alias("b"), "exact")
    few = exact.join(other, (exact["key"] == other["key"]) & close & (~F.col("exact") | (F.col("a") < F.col("b")))).select("a", "b")

    dense = entries.join(hot, "key").select("key", "exact", "fp", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("n", "m")))
    block = lambda n: F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), n).cast("int")
    # A table entry meets all entries and lookups of its key: it goes to every block of the others, they to every block of it.
    rows = dense.filter("exact").select("key", block(F.col("n")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"), F.lit(True).alias("exact"), "fp")
    cols = dense.select("key", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), block(F.col("m")).alias("j"), F.lit(False).alias("exact"), "fp")

    def compare(t: pa.Table) -> pa.Table:
        fp, exact = t.column("fp").to_numpy().view(np.uint64), t.column("exact").to_numpy(zero_copy_only=False).astype(bool)
        a, b, found = np.unique(fp[exact]), np.unique(fp[~exact]), []
        for at in range(0, len(a), 256):
            i, j = _near(part := a[at : at + 256], b, distance)
            # The forest so far is merged with what this slice adds, so that the pairs found are never kept together.
            found = [forest(*map(np.concatenate, zip(*found, (part[i].view(np.int64), b[j].view(np.int64)), strict=True)))]
        left, right = found[0] if found else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": left, "b": right})

    many = rows.unionByName(cols).groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")
    # Written, so that no later step in Python shares its tasks (and their memory) with the comparison.
    found = stored(few.unionByName(many).filter("a <> b"))
    discard(fps.sparkSession, entries, sizes)
    return found


def similar_texts(docs: DataFrame, similarity: tuple[int, int] = (4, 5), size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and `component_id`, the smallest id that links of a Jaccard similarity reach.

    This is the operator's form for a similarity of shingle sets (num, den). Fingerprints of 64 bits within 3 bits of each
    other are found as ever, by their halves' balls, and their texts' whole sets compared: these are the closest texts. That
    can't be all: two texts with four of five shingles in common differ in 10 bits on average and in up to 17, and balls of that
    radius can't be enumerated. So what fingerprints didn't link is found by single rare shingles, looked up exactly, in place of
    32 bits; the fingerprints whose distances are verified are sketches of 1,024 and 16,384 bits; and what they let pass is
    verified on the whole sets. See `shingle_sets`.
    """
    return near_texts(docs, *similarity, size, id_col, text_col, closest=links)


def near_duplicates(docs: DataFrame, distance: int = 3, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, `fingerprint` (16 hex digits) and `component_id`, the smallest id that links reach.

    Only ids and fingerprints leave the texts' partitions. Equal fingerprints are one node, so copies cost nothing more;
    components are found over nodes (see `components`), and nothing of them is collected. Null and empty texts have
    fingerprint 0, linked like any other. Repeated rows give repeated rows. A null id belongs to its component but never
    names it, unless there is no other (then component_id is null). An empty table gives no row; other columns aren't read.
    """
    hashed = stored(fingerprints(docs, size, seed, id_col, text_col))
    nodes = stored(hashed.groupBy("fp").agg(F.min("id").alias("least")))
    labels = components(edges := links(nodes.select("fp"), distance))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = stored(named)
    discard(docs.sparkSession, nodes, edges, labels)
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = named.join(least, "label").select("fp", "component_id")
    return hashed.join(of_fp, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
