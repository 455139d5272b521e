"""Packing token sequences into windows of a fixed length by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, ranked, stored
from .vocab import proven, token_ids
from .words import spread


class Share(NamedTuple):
    """Of the pieces of one length, those ranked [start, start + per_window * windows) go to `windows` equal windows."""

    length: int
    start: int
    per_window: int
    windows: int
    first_window: int
    offset: int


def _fill(counts: np.ndarray, largest: int, capacity: int) -> list[int]:
    """The multiset of available lengths that leaves the least padding beside `largest`.

    That is the one whose sum comes closest to the remaining room, unless only a window whose total is a smaller power of
    two, which isn't padded, can be filled without any. Subset sums are the bits of one integer. Lengths are added from the largest, each length's count in powers of two,
    and adding stops as soon as `room` itself is reached; `steps` keeps the bits before each addition, for backtracking.
    """
    room = capacity - largest
    sums, steps, mask = 1, [], (1 << room + 1) - 1
    for length in range(room, 0, -1):
        n, k = min(int(counts[length]), room // length), 1
        while n > 0:
            k = min(k, n)
            steps.append((length, k, sums))
            sums |= sums << length * k & mask
            n, k = n - k, 2 * k
        if sums >> room & 1:
            break
    total, out = sums.bit_length() - 1, []
    if total < room:
        unpadded = [t for p in range(capacity.bit_length()) if (t := (1 << p) - largest) >= 0 and sums >> t & 1]
        total = max(unpadded, default=total)
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= length * k
            out += [length] * k
    return out


def plan_windows(histogram: dict[int, int], capacity: int) -> list[Share]:
    """Which pieces share a window, from the number of pieces of each length alone.

    Each window takes the largest remaining length and the multiset that leaves the least slack beside it. The same
    window is repeated as often as the counts allow, so the plan has a few thousand shares at most for any number of
    pieces: a repetition ends only when some length has run short.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    taken, out, window = np.zeros(capacity + 1, np.int64), [], 0
    for largest in range(capacity, 0, -1):
        while counts[largest]:
            counts[largest] -= 1
            chosen = [largest, *_fill(counts, largest, capacity)]
            counts[largest] += 1
            lengths, need = np.unique(chosen, return_counts=True)
            windows, offset = int((counts[lengths] // need).min()), 0
            for length, n in zip(lengths[::-1].tolist(), need[::-1].tolist(), strict=True):
                out.append(Share(length, int(taken[length]), n, windows, window, offset))
                offset += length * n
            counts[lengths] -= need * windows
            taken[lengths] += need * windows
            window += windows
    return out


def pieces_of(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and `end_id`, cut into full windows and one rest: id, start, length, ids_crc32, doc_tokens."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, end = narrow.schema["id"].dataType.simpleString(), int(end_id).to_bytes(4, "little")
    whole = docs.sparkSession.sparkContext.broadcast(proven(path))

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        flat, counts = token_ids(path, b.column("text"), whole.value)
        ids, stops = flat.tobytes(), (4 * np.cumsum(counts)).tolist()
        pieces = -(-(counts + 1) // capacity)
        at = np.repeat(np.arange(len(counts)), pieces)
        start = spread(np.zeros(len(counts), np.int64), pieces) * capacity
        total = counts[at] + 1
        crc = []
        for begin, stop in zip([0, *stops], stops):  # noqa: B905  one start more than ends
            own = memoryview(ids[begin:stop] + end)
            crc += [zlib.crc32(own[s : s + 4 * capacity]) for s in range(0, len(own), 4 * capacity)]
        columns = [start, np.minimum(capacity, total - start), np.array(crc, np.int64), total]
        return pa.record_batch([b.column("id").take(pa.array(at)), *map(pa.array, columns)], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return in_batches(narrow, each, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long").withColumnRenamed("id", id_col)


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents: one row per piece with its place, `sequence_id` (from 0, gapless) and `offset`.

    A document longer than a window fills whole windows first; only its rest, and every shorter document, is packed with
    others. Pieces travel as five numbers, never as text. The driver sees one count per length (at most `capacity`) and
    sends back the plan, which those counts bound; each piece finds its window by its rank among the pieces of its length.

    Null and empty texts are one piece with `end_id` alone. Repeated rows are packed once each, null ids stay null, an
    empty table gives no row, other columns aren't read.
    """
    cut = stored(pieces_of(docs, path, end_id, capacity, id_col, text_col))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = sorted(plan_windows(histogram, capacity))
    plan = np.array(shares, np.int64).reshape(-1, 6).T.copy()
    placed = ranked(cut, ["length"], [id_col, "start", "ids_crc32", "doc_tokens"], "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = 1 << 50
        keys = plan[0] * span + plan[1]
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            share = np.searchsorted(keys, length * span + rank, side="right") - 1
            _, start, per_window, _, first, offset = plan[:, share]
            window, slot = np.divmod(rank - start, per_window)
            columns = {"sequence_id": first + window, "offset": offset + slot * length}
            yield pa.record_batch([*b.drop_columns(["rank"]).columns, *map(pa.array, columns.values())], [*(n for n in b.schema.names if n != "rank"), *columns])

    columns = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
    kinds = ", ".join(f"`{n}` {t}" for n, t in placed.select(*columns).dtypes)
    return placed.select(*columns, "rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")
