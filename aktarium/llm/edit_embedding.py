"""Fingerprints of texts in which edit distance shows as Hamming distance.

A walk goes over a text's characters: at each step it puts out the character it's at and then stays or goes on to the next,
as a random bit says that belongs to the step and the character and is shared by all texts. Where two texts differ by an
insertion or a deletion, their walks part, and come together again by chance after few steps; from then on they put out the
same (the randomised embedding of edit into Hamming distance by Chakraborty, Goldenberg and Koucky). A fingerprint keeps a
bit of the symbol at each of some random steps. The steps are drawn as a reservoir of one would: a longer walk keeps the step of a
shorter one in proportion, so that texts of different lengths can be compared. A band is a sample of a fingerprint's bits:
fingerprints that share one are compared as a whole.

A walk is sequential, so a text is cut into segments of about `SEGMENT` characters that walk side by side. A cut lies where a
hash of eight characters is least within a window, so an insertion before it moves it along. A text's last characters belong to
its last segment; no text is cut short, and its memory and time grow with it in proportion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, discard, in_batches, joined, stored, tuned
from .components import components

#: Characters of a segment, half the window in which its end may lie, and the characters that are hashed there.
SEGMENT, WINDOW, GRAM = 2048, 256, 8
#: Bits of a fingerprint; steps after which the shared random bits repeat; characters that walk side by side at most.
BITS, PERIOD, TOGETHER = 1024, 4096, 1 << 22
#: Bits of a band. Bands are disjoint samples of a fingerprint's bits, so fingerprints that differ in fewer bits than there are
#: bands share one: at 1,024 bits, all pairs with a likeness over 0.939 are compared.
BAND = 32
#: Fingerprints of a band that are joined in pairs; more are compared in blocks of BLOCK.
FEW, BLOCK = 16, 2048
#: Steps between looks at who still walks; the symbol after a text's end.
_LOOK, _PAD = 256, 255


def _records(rng: np.random.Generator, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All (position, bit) at which a reservoir of one item, a reservoir for each bit, takes a new item; by position."""
    at, found = np.zeros(bits), [np.zeros(bits)]
    while at.min() < 2.0**40:
        at = np.ceil((at + 1) / (1 - rng.random(bits) * (1 - 1e-9))) - 1
        at = np.clip(at, found[-1] + 1, 2.0**52)
        found.append(at)
    positions = np.concatenate(found).astype(np.int64)
    order = np.argsort(positions, kind="stable")
    return positions[order], np.tile(np.arange(bits), len(found))[order]


class Walks:
    """The random choices that all texts share."""

    def __init__(self, seed: int, bits: int):
        rng = np.random.default_rng(seed)
        self.bits = bits
        self.moves = rng.integers(0, 2, (PERIOD, 256)).astype(np.uint8)
        self.moves[:, _PAD] = 0
        self.faces = rng.integers(0, 2, (bits, 256)).astype(np.uint8)
        self.mix = rng.integers(1, 1 << 32, GRAM, dtype=np.uint64)
        self.of_text, self.of_walk = _records(rng, bits), _records(rng, bits)

    def sampled(self, records: tuple[np.ndarray, np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """For each length (1 or more) and bit the position below it that the bit's reservoir holds."""
        out, now, upto = np.empty((len(lengths), self.bits), np.int64), np.zeros(self.bits, np.int64), 0
        positions, of = records
        for k in np.argsort(lengths, kind="stable").tolist():
            to = int(np.searchsorted(positions, lengths[k]))
            now[of[upto:to]] = positions[upto:to]
            out[k], upto = now, to
        return out

    def walk(self, segments: Sequence[np.ndarray]) -> np.ndarray:
        """For each segment (symbols of at least one character) and bit the symbol at the step that the bit samples."""
        order = np.argsort([-len(s) for s in segments], kind="stable")
        flat = np.concatenate([x for k in order for x in (segments[k], np.array([_PAD], np.uint8))])
        lengths = np.array([len(segments[k]) for k in order])
        at = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        steps, blocks, count, t = np.zeros(len(at), np.int64), [], len(at), 0
        while count:
            here, move, block = at[:count], np.empty(count, np.uint8), np.empty((_LOOK, count), np.uint8)
            for r in range(_LOOK):
                np.take(flat, here, out=block[r], mode="clip")
                np.take(self.moves[(t + r) % PERIOD], block[r], out=move, mode="clip")
                np.add(here, move, out=here)
            steps[:count] += (block != _PAD).sum(axis=0)
            blocks.append(block.ravel())
            t += _LOOK
            going = np.flatnonzero(flat[here] != _PAD)
            count = int(going[-1]) + 1 if len(going) else 0
        widths = np.array([len(b) // _LOOK for b in blocks])
        starts, walked = np.concatenate([[0], np.cumsum(widths * _LOOK)[:-1]]), np.concatenate(blocks)
        chosen = self.sampled(self.of_walk, steps)
        b = chosen // _LOOK
        symbols = walked[starts[b] + chosen % _LOOK * widths[b] + np.arange(len(at))[:, None]]
        out = np.empty_like(symbols)
        out[order] = symbols
        return out

    def cuts(self, text: str) -> list[int]:
        """Where the text's segments begin."""
        found, n = [0], len(text)
        for middle in range(SEGMENT, n - WINDOW + 1, SEGMENT):
            near = _symbols(text[middle - WINDOW : middle + WINDOW + GRAM]).astype(np.uint64)
            near = np.concatenate([near, np.zeros(2 * WINDOW + GRAM - len(near), np.uint64)])
            hashes = sum(near[k : k + 2 * WINDOW] * self.mix[k] for k in range(GRAM)) * np.uint64(0x9E3779B97F4A7C15)
            found.append(middle - WINDOW + int((hashes >> np.uint64(32)).argmin()))
        return found


@cache
def walks(seed: int = 42, bits: int = BITS) -> Walks:
    return Walks(seed, bits)


def _symbols(text: str) -> np.ndarray:
    """A byte for each character: ASCII as it is, others hashed to 128 to 254."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, points, 128 + (points * np.uint32(2654435761) >> np.uint32(13)) % np.uint32(127)).astype(np.uint8)


def fingerprints(texts: Sequence[str], seed: int = 42, bits: int = BITS) -> np.ndarray:
    """The packed bits of each text's fingerprint, one a row. Equal segments of these texts walk once."""
    shared = walks(seed, bits)
    pieces: list[list[int]] = []
    known: dict[bytes, int] = {}
    waiting: list[np.ndarray] = []
    done: list[np.ndarray] = []
    held = 0
    for text in texts:
        starts, own = shared.cuts(text), []
        for a, b in zip(starts, [*starts[1:], len(text)], strict=True) if text else ():
            piece = text[a:b]
            key = hashlib.blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if key not in known:
                known[key] = len(known)
                waiting.append(_symbols(piece))
                held += b - a
                if held >= TOGETHER:
                    done.append(shared.walk(waiting))
                    waiting, held = [], 0
            own.append(known[key])
        pieces.append(own)
    if waiting:
        done.append(shared.walk(waiting))
    symbols = np.concatenate(done) if done else np.zeros((0, bits), np.uint8)
    out, every = np.full((len(texts), bits), _PAD, np.uint8), np.arange(bits)
    single = [k for k, own in enumerate(pieces) if len(own) == 1]
    out[single] = symbols[[pieces[k][0] for k in single]]
    many = [k for k, own in enumerate(pieces) if len(own) > 1]
    if many:
        for k, at in zip(many, shared.sampled(shared.of_text, np.array([len(texts[k]) for k in many])), strict=True):
            own = np.array(pieces[k])
            out[k] = symbols[own[np.minimum(at // SEGMENT, len(own) - 1)], every]
    return np.packbits(shared.faces[every, out], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal symbols that pairs of fingerprints (rows) speak for: 1 for equal ones, about 0 for unrelated ones."""
    apart = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return np.maximum(0.0, 1 - 2 * apart / (8 * a.shape[-1]))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many characters of the following, or all it has."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_FOUND = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(texts: Sequence[str], own: np.ndarray, following: np.ndarray, changed: Sequence[str], seed: int, bits: int) -> list[pa.Array]:
    """The columns of `_FOUND`."""
    other = fingerprints(changed, seed, bits)
    digests = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed]
    packed = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
    return [pa.array([len(x) for x in texts], pa.int64()), pa.array(digests, pa.string()), packed(own), packed(other), pa.array(likeness(own, other)), pa.array(likeness(own, following))]


def edit_fingerprints(docs: DataFrame, seed: int = 42, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: id, n_chars, edited_sha256, fingerprint and edited_fingerprint (packed bits), near_edited, near_next.

    The next document of a row is the one with the next smaller id (null ids last, equal ids by a hash of the text, then by the
    text), that of the last is the first; with one row it's the row itself. Null is an empty text, whose fingerprint is that
    of no symbol. Texts of under 3 characters are their own edited text. Repeated rows are rows each; an empty table gives no row; other columns aren't
    read. Texts are shuffled once, by ranges of ids; each task walks over its sorted texts and keeps one in hand. Of each task
    the first and the last text are written, to be matched with its neighbours'.
    """
    spark = tuned(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    order = [F.desc_nulls_last("id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").withColumn("task", F.spark_partition_id())
    names = ["id", *(f.split()[0] for f in _FOUND.split(", ")), "task", "edge", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[pa.Array, str, np.ndarray] | None = None
        task: pa.Array | None = None

        def edge(which: str, row: tuple[pa.Array, str, np.ndarray]) -> pa.RecordBatch:
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.string())]
            found = [*none, pa.array([row[2].tobytes()], pa.binary()), *(pa.nulls(1, t) for t in (pa.binary(), pa.float64(), pa.float64()))]
            return pa.record_batch([row[0], *found, task, pa.array([which]), pa.array([row[1]], pa.string())], names)

        for b in batches:
            if not b.num_rows:
                continue
            texts, ids, task = b.column("text").to_pylist(), b.column("id"), b.column("task")[:1]
            own = fingerprints(texts, seed, bits)
            if held is None:
                yield edge("first", (ids[:1], texts[0], own[0]))
            else:
                ids = pa.concat_arrays([held[0], ids])
                texts, own = [held[1], *texts], np.concatenate([held[2][None, :], own])
            n = len(texts) - 1
            if n:
                changed = [edited(x, y) for x, y in zip(texts, texts[1:], strict=False)]
                found = _compared(texts[:n], own[:n], own[1:], changed, seed, bits)
                yield pa.record_batch([ids[:n], *found, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names)
            held = pa.concat_arrays([ids[n:]]), texts[n], own[n]
        if held is not None:
            yield edge("last", held)
        pa.default_memory_pool().release_unused()

    walked = stored(dealt.mapInArrow(run, f"id {kind}, {_FOUND}, task int, edge string, text string"))
    # One row a task: which task comes next.
    tasks = walked.filter("edge = 'first'").select("task")
    after = tasks.select("task", F.coalesce(F.lead("task").over(Window.orderBy("task")), F.min("task").over(Window.partitionBy())).alias("next"))
    firsts = walked.filter("edge = 'first'").select(F.col("task").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    ends = walked.filter("edge = 'last'").select("id", "task", "text", "fingerprint").join(after, "task").join(firsts, "next")

    def finish(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = lambda c: np.stack([np.frombuffer(x.as_py(), np.uint8) for x in b.column(c)])
        texts, own = b.column("text").to_pylist(), rows("fingerprint")
        changed = [edited(x, y) for x, y in zip(texts, b.column("next_text").to_pylist(), strict=True)]
        return pa.record_batch([b.column("id"), *_compared(texts, own, rows("next_fingerprint"), changed, seed, bits)], names[:-3])

    met = in_batches(ends.select("id", "text", "fingerprint", "next_text", "next_fingerprint"), finish, f"id {kind}, {_FOUND}")
    return walked.filter("edge IS NULL").select(*names[:-3]).unionByName(met).withColumnRenamed("id", id_col)


def bands(packed: np.ndarray, seed: int = 42) -> np.ndarray:
    """For each fingerprint (row of packed bits) the keys of its bands: the band's number, and a random sample of the bits."""
    bits = np.unpackbits(packed, axis=1)
    sample = np.random.default_rng(seed).permutation(bits.shape[1])[: bits.shape[1] // BAND * BAND]
    keys = np.packbits(bits[:, sample].reshape(len(bits), -1, BAND), axis=2).copy().view(">u4")[:, :, 0]
    return keys.astype(np.int64) | np.arange(keys.shape[1], dtype=np.int64) << 32


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def linked(packed: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint the first of those that links of at most `distance` bits reach. What is connected already isn't
    compared again, so that a group of copies of one text takes about one comparison each."""
    label = np.arange(len(packed))
    for k in range(len(packed)):
        others = np.flatnonzero(label != label[k])
        if not len(others):
            break
        near = others[_apart(packed[others], packed[k]) <= distance]
        if len(near):
            met = np.append(label[near], label[k])
            label[np.isin(label, met)] = met.min()
    return label


def classes(prints: DataFrame, id_col: str = "doc_id", fingerprint_col: str = "fingerprint", bits: int = BITS, seed: int = 42) -> DataFrame:
    """(fingerprint, class_id) of each distinct fingerprint: the smallest id that links of fewer differing bits than there
    are bands reach. Each pair that shares a band is compared as a whole; no link is lost, nothing is capped.

    Equal fingerprints are one node. Keys of a band that few fingerprints have are joined, others are compared in blocks, of which
    each returns a forest of the links it found. A null id names a class only if there is no other. An empty table gives no row.
    """
    distance, words = bits // BAND - 1, lambda column: np.stack([np.frombuffer(x.as_py(), np.uint8) for x in column])
    nodes = prints.groupBy(F.col(fingerprint_col).alias("fingerprint")).agg(F.min(id_col).alias("least"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    prints_of = nodes.select("node", "fingerprint")

    def enter(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = bands(words(b.column("fingerprint")), seed)
        return pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(b.column("node").to_numpy(), keys.shape[1]))], ["key", "node"])

    entries = stored(in_batches(prints_of, enter, "key long, node long"))
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    met = stored(joined(entries, sizes, ["key"], "m", max(FEW, nodes.count() // HOT)))
    few = met.filter(F.col("m") <= FEW)
    pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(prints_of.select(F.col("node").alias(side), F.col("fingerprint").alias(f"{side}_print")), side)

    def verify(b: pa.RecordBatch) -> pa.RecordBatch:
        near = _apart(words(b.column("a_print")), words(b.column("b_print"))) <= distance
        return b.select(["a", "b"]).filter(pa.array(near))

    found = in_batches(pairs.select("a", "b", "a_print", "b_print"), verify, "a long, b long")
    dense = met.filter(F.col("m") > FEW).join(prints_of, "node").withColumn("n", F.ceil(F.col("m") / BLOCK).cast("int"))
    dense = dense.withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = dense.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "fingerprint")

    def compare(t: pa.Table) -> pa.Table:
        label, node = linked(words(t.column("fingerprint")), distance), t.column("node").to_numpy()
        child = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": node[child], "b": node[label[child]]})

    edges = stored(found.unionByName(dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")))
    labels = components(edges)
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("class_id"))
    out = stored(named.join(least, "label").select("fingerprint", "class_id"))
    discard(prints.sparkSession, nodes, entries, met, edges, labels)
    return out


def hexed(fingerprint: Column) -> Column:
    return F.lower(F.hex(fingerprint))
