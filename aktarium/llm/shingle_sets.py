"""Near-duplicates by the Jaccard similarity of their word shingles: every pair of similar texts is found, none is missed.

Two sets of which at least a share `similarity` of the union is common have a common element among the first
n - ceil(similarity * n) + 1 of each, whatever order the elements have, if it's the same for all sets. So each set is
entered into a table under these elements alone, and of these under the ones that two sets share; in order of rarity (as a sample of the texts shows it), which keeps
passages that many texts hold out of the table. Texts that meet under a key are candidates. Sketches (the parity of the
elements at each of 1,024 places) bound the elements that two sets don't share from below, and so reject candidates without
error; those that stay are compared by their whole sets. Shingles stand for themselves by 64-bit hashes. Where SimHash
fingerprints of the sets are looked up first, what they find needs no further comparison.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, in_batches, stored
from .components import components
from .line_dedup import rounds, suspects
from .words import split_words

#: 64-bit words of a sketch, and of a wide one for the sets that the first can't tell apart; what a word's place is worth.
_SKETCH, _WIDE, _POWER = 16, 256, np.uint64(0x9E3779B97F4A7C15)
#: Texts that show which shingles are common, and most shingles that are remembered as common. They set the order only.
SAMPLE, MOST_COMMON = 8192, 1 << 17
#: Hashes whose bits are counted at once.
_SLICE = 1 << 14
#: A key with at most FEW sets is joined in the JVM; others are compared in blocks, each pair of blocks by itself.
FEW, BLOCK = 8, 2048


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct word shingles; fewer words than `size` are one shingle.

    Words are hashed once for each distinct spelling (A-Z in lower case), and a shingle's hash is a polynomial of its words'
    hashes and their number, for all shingles of the batch at once.
    """
    words = split_words(pc.ascii_lower(texts))
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words.joined().encode("utf-8", "surrogatepass").split(b"\n")), np.uint64)
    word, bounds = hashed[words.codes], words.bounds
    n = np.diff(bounds)
    upto = np.concatenate([np.zeros(1, np.uint64), word, np.zeros(size, np.uint64)])
    total = np.zeros(len(word), np.uint64)
    # Texts with fewer words have one shingle, of all of them, at their first word: what follows them counts for nothing.
    left = np.repeat(bounds[1:], n) - np.arange(len(word))
    for k in range(size):
        part = upto[1 + k : 1 + k + len(word)]
        total = total * _POWER + np.where(left > k, part, np.uint64(0))
    total = (total + np.minimum(left, size).astype(np.uint64)) * _POWER
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    counts = np.where(n > 0, np.maximum(1, n - size + 1), 0)
    return [np.unique(total[a : a + c]) for a, c in zip(bounds[:-1].tolist(), counts.tolist(), strict=True)]


def _node(found: np.ndarray) -> int:
    """One number for a set: equal sets are one node."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), 1)).view(np.int64)) if len(found) else 0


def _fingerprint(found: np.ndarray) -> int:
    """The 64-bit SimHash of a set of hashes, its bits as a signed number: 1 where more than half of them have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), _SLICE):
        ones += np.unpackbits(found[at : at + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def _sketch(found: np.ndarray, words: int = _SKETCH) -> bytes:
    return np.packbits(np.bincount((found % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1).astype(np.uint8).tobytes()


def _sketches(column: pa.Array, words: int = _SKETCH) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def _sample_of_common(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that several texts of a sample hold, sorted, and how many of them do."""
    n = docs.count()

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.concatenate(shingle_sets(b.column("text"), size)).view(np.int64))], ["h"])

    hashes = in_batches(docs.select("text").sample(min(1.0, SAMPLE / max(1, n)), 42), each, "h long")
    common = hashes.groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()
    h, count = common.column("h").to_numpy().view(np.uint64), common.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], count[order]


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rarest elements of a set, as many as a set of similarity num / den can't do without."""
    n = len(found)
    if not n:
        return found
    least = n - (num * n + den - 1) // den + 1
    if not len(common):
        return found[:least]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return found[np.lexsort((found, np.where(common[at] == found, counts[at], 0)))[:least]]


def _sizes_allow(a: Column, b: Column, num: int, den: int) -> Column:
    return F.greatest(a, b) * num <= F.least(a, b) * den


def _pairs_in_blocks(crowded: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of the rows (key, node, n, label, sketch, keys, m) with one key and two labels that sizes and sketches allow.

    `keys` has all keys of a node that come here, sorted: a pair that meets under several is returned under the first one.
    """
    dense = crowded.withColumn("k", F.ceil(F.col("m") / BLOCK).cast("int"))
    dense = dense.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("k")).cast("int"))
    # Each block meets itself and every other once: block x goes to (x, y) for y >= x and to (y, x) for y < x.
    dense = dense.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dense = dense.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "label", "sketch", "keys")

    def compare(t: pa.Table) -> pa.Table:
        node, n, label, block, i, j = (t.column(c).to_numpy() for c in ("node", "n", "label", "block", "i", "j"))
        sketch, left, right, a, b = _sketches(t.column("sketch")), np.flatnonzero(block == i), np.flatnonzero(block == j), [], []
        key, keys = t.column("key")[0].as_py(), [np.array(k, np.int64) for k in t.column("keys").to_pylist()]
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            apart = np.zeros((len(part), len(right)), np.int64)
            for w in range(_SKETCH):
                apart += np.bitwise_count(sketch[part, w][:, None] ^ sketch[right, w][None, :])
            x, y = n[part][:, None], n[right][None, :]
            near = ((num + den) * apart <= (den - num) * (x + y)) & (np.maximum(x, y) * num <= np.minimum(x, y) * den) & (label[part][:, None] != label[right][None, :])
            if i[0] == j[0]:
                near &= node[part][:, None] < node[right][None, :]
            p, q = np.nonzero(near)
            p, q = part[p], right[q]
            first = np.fromiter((np.intersect1d(keys[x], keys[y], assume_unique=True)[0] == key for x, y in zip(p.tolist(), q.tolist(), strict=True)), bool, len(p))
            a.append(node[p[first]])
            b.append(node[q[first]])
        a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dense.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def near_texts(docs: DataFrame, num: int = 4, den: int = 5, size: int = 5, id_col: str = "doc_id", text_col: str = "text", closest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per input row: id and `component_id`, the smallest id that links of similarity num / den or more reach.

    `closest` gets the distinct SimHash fingerprints of the sets (`fp`, longs) and returns pairs (a, b) of near ones, stored.
    Sets with such fingerprints, or with the same, are compared before all others; those found similar are joined.
    What it doesn't find is compared in two rounds. The first compares the least set of each key with the key's others, which is
    all there is for most keys, and joins groups of near copies. The second compares all pairs of a key's sets that the
    first didn't join already; crowded keys do so in blocks. Nothing is capped, nor collected but the sample's common
    shingles, which only order elements. Copies are one node. Texts without words are equal, null included. Repeated rows
    give repeated rows; a null id belongs to its component but never names it, unless there is no other.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    common = docs.sparkSession.sparkContext.broadcast(_sample_of_common(narrow, size))

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(b.column("text"), size)
        columns = [pa.array([_node(s) for s in sets], pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(_sketch, sets), pa.binary()), pa.array([_fingerprint(s) if closest else None for s in sets], pa.int64())]
        keys = pa.array([prefix(s, *common.value, num, den).view(np.int64) for s in sets], pa.list_(pa.int64()))
        return pa.record_batch([b.column("id"), *columns, keys], ["id", "node", "n", "sketch", "fp", "keys"])

    drop = functools.partial(discard, docs.sparkSession)
    hashed = stored(in_batches(narrow, each, f"id {kind}, node long, n long, sketch binary, fp long, keys array<long>"))
    keyed = stored(hashed.groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    # The keys go where they're needed; ids and sets are kept without them.
    ids_of, nodes = stored(hashed.select("id", "node")), stored(keyed.drop("keys"))
    drop(hashed)
    entries, total = keyed.select(F.explode("keys").alias("h"), "node", "n"), keyed.agg(F.sum(F.size("keys"))).first()[0] or 0
    if rounds(total) > 1:
        entries = stored(entries.sortWithinPartitions("h"))
    # Keys of one set alone, as most are, aren't shuffled.
    suspected = suspects(entries, total)
    drop(keyed, entries)
    met = suspected.groupBy("h").agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = stored(suspected.join(met, "h").withColumnRenamed("h", "key"))
    drop(suspected)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), stored and distinct, those whose sets are similar; the pairs are discarded."""
        side = lambda df, c: df.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

        def unlike_rejected(pairs: DataFrame, sketches: DataFrame, words: int) -> DataFrame:
            def each(b: pa.RecordBatch) -> pa.RecordBatch:
                apart = np.bitwise_count(_sketches(b.column("s_a"), words) ^ _sketches(b.column("s_b"), words)).sum(axis=1, dtype=np.int64)
                both = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
                return b.select(["a", "b"]).filter(pa.array((num + den) * apart <= (den - num) * both))

            met = pairs.join(side(sketches, "a"), "a").join(side(sketches, "b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
            return stored(in_batches(met, each, "a long, b long"))

        close = unlike_rejected(pairs, nodes, _SKETCH)
        drop(pairs)
        wanted = stored(close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct())
        ids = stored(ids_of.join(wanted, "node", "left_semi").select(F.col("id").alias("wanted_id")).distinct())

        def sets_of(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(b.column("text"), size)
            return pa.record_batch([pa.array([_node(s) for s in sets], pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([_sketch(s, _WIDE) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "sketch", "set"])

        # Sets are taken from the texts again, as few are needed. Rows of one id may differ: nodes tell which are meant.
        texts = narrow.join(ids, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")
        sets = in_batches(texts, sets_of, "node long, n long, sketch binary, set binary").join(wanted, "node", "left_semi")
        sets = stored(sets.dropDuplicates(["node"]))
        closer = unlike_rejected(close, sets, _WIDE)
        drop(ids, wanted, close)

        def similar(b: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * same >= num * (len(x) + len(y) - same))
            return b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
        sure = stored(in_batches(closer.join(left, "a").join(right, "b").select("a", "b", "x", "y"), similar, "a long, b long"))
        drop(sets, closer)
        return sure

    def of_fingerprints() -> DataFrame:
        """Pairs (a, b) of the least sets of near fingerprints, and of a fingerprint's least set and its others."""
        firsts = stored(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")))
        near, first = closest(firsts.select("fp")), lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
        apart = near.join(first("a"), "a").join(first("b"), "b").select(F.col("first_a").alias("x"), F.col("first_b").alias("y"))
        same = nodes.join(firsts, "fp").select(F.col("first").alias("x"), F.struct("node", "n").alias("y"))
        pairs = apart.unionByName(same).filter((F.col("x.node") != F.col("y.node")) & _sizes_allow(F.col("x.n"), F.col("y.n"), num, den))
        pairs = stored(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
        drop(firsts, near)
        return pairs

    first = shared.filter((F.col("node") != F.col("first.node")) & _sizes_allow(F.col("n"), F.col("first.n"), num, den))
    pairs = first.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
    known = None
    if closest and not (likely := of_fingerprints()).isEmpty():
        known = confirmed(likely)
        labels = stored(components(known))
        # Of what fingerprints have joined already nothing is compared again.
        for c in "ab":
            pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")), c, "left")
        pairs = pairs.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")
    edges = confirmed(stored(pairs))
    edges = edges if known is None else edges.unionByName(known)
    labels = stored(components(edges))

    # What the first round left: keys with sets that aren't in one component. Their first set has met all others already.
    rest = shared.filter((F.col("m") > 2) & (F.col("node") != F.col("first.node"))).join(labels, "node", "left")
    rest = stored(rest.select("key", "node", "n", F.coalesce("label", "node").alias("label")))
    drop(shared)
    # Texts that share a passage share many keys: of keys with the same sets one will do (told by their number and 128 bits).
    bits = F.xxhash64("node", F.lit(3)).cast("decimal(38,0)")
    left = rest.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(bits).alias("y")).filter("low < high")
    left = stored(left.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", "m"))
    usual = rest.join(left.filter(F.col("m") <= FEW).select("key"), "key")
    one, two = (usual.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "label"))) for s in "ab")
    few = one.join(two, "key").filter((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & _sizes_allow(F.col("n_a"), F.col("n_b"), num, den))
    crowded = rest.join(left.filter(F.col("m") > FEW), "key")
    keys = crowded.groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    crowded = crowded.join(keys, "node").join(nodes.select("node", "sketch"), "node")
    pairs = few.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).unionByName(_pairs_in_blocks(crowded, num, den))
    pairs = stored(pairs.distinct())
    drop(rest, left)
    if not pairs.isEmpty():
        labels = components(edges.unionByName(confirmed(pairs)))

    named = stored(nodes.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label")))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = named.join(least, "label").select("node", "component_id")
    return ids_of.join(of_node, "node").select(F.col("id").alias(id_col), "component_id")
