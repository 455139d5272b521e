"""Nearest neighbours by inner product, from randomly rotated one-bit codes with error bounds.

A vector v is kept as the signs of its rotated direction o (packed bits), its length and f, the inner product of o and
those signs scaled to length 1. A query's rotated direction q is rounded to 4 bits a component, kept as 4 planes of packed
bits, so that the inner product of q and the signs is a sum of counts of common bits. <signs, q> / f estimates <o, q>; its
error is normal to good approximation, with a deviation of sqrt((1 - f^2) / f^2) / sqrt(D - 1), and what rounding adds.
Vectors whose estimate plus `sigmas` deviations reaches the query's k-th best exact value so far are reranked exactly; the
others are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import stored, tuned

#: Vectors in a block of the index and in a block of queries, on average; a task holds one of each. The index is sent once to
#: each block of queries, so these are large.
INDEX_BLOCK, QUERY_BLOCK = 2048, 16384
#: Tasks that the index is dealt over for one block of queries, where there are few such blocks.
SPLITS = 16
#: Bits of a query's components, queries estimated at once, and pairs reranked at once.
_PLANES, _TILE, _PAIRS = 4, 256, 1 << 18


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same for the same arguments."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of whole 64-bit words."""
    raw = np.packbits(bits, axis=1)
    out = np.zeros((len(raw), -(-bits.shape[1] // 64) * 8), np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view(np.uint64)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, length and f of each row."""
    length = np.linalg.norm(vectors, axis=1)
    turned = (vectors / length[:, None]) @ turn.T
    f = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return _packed(turned > 0), length, f


class Planes:
    """Queries' rotated directions, rounded to `_PLANES` bits a component and packed plane by plane."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        self.length = np.linalg.norm(vectors, axis=1)
        turned = (vectors / self.length[:, None]) @ turn.T
        self.dim, self.low = vectors.shape[1], turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / ((1 << _PLANES) - 1), 1e-30)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = [_packed(level >> p & 1) for p in range(_PLANES)]
        self.sum = self.low * self.dim + self.step * level.sum(axis=1)
        #: Deviation of an estimate for f = 1 by rounding.
        self.rounding = self.step / np.sqrt(12)

    def estimates(self, part: slice, code: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Estimated <direction, direction> of the queries of a part with coded vectors, from counts of common bits."""
        common = np.zeros((len(self.low[part]), len(code)), np.int32)
        for p, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                common += np.bitwise_count(plane[part, w][:, None] & code[None, :, w]).astype(np.int32) << p
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        scale = (1 / f / np.sqrt(self.dim)).astype(np.float32)
        # <signs, q> is twice the sum over set bits less the sum over all.
        out = common.astype(np.float32) * (2 * self.step[part]).astype(np.float32)[:, None]
        out += np.outer(2 * self.low[part], ones).astype(np.float32)
        out -= self.sum[part].astype(np.float32)[:, None]
        return out * scale


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim) of the rows that take part, v as doubles, or as floats where it was.

    Left out are null ids, and vectors that are null, empty, zero, or hold null or non-finite components. Rows that share an
    id stay separate rows. A query meets the vectors of its own length only: others have no inner product with it.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    element = "float" if isinstance(getattr(vectors.schema[vector_col].dataType, "elementType", None), FloatType) else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    rows = rows.filter("id IS NOT NULL AND v IS NOT NULL").filter(~F.exists("v", bad)).filter(F.exists("v", lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


def build_index(vectors: DataFrame, seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every row that takes part (see `usable`): row (a number of its own), id, dim, v, code, length, f; written out.

    Nothing is fitted, so no sample is needed, and no row is shuffled.
    """
    rows = usable(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()).select("row", "id", "dim", "v")
    element = rows.schema["v"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                if dim not in turns:
                    turns = {dim: rotation(dim, seed)}
                v = own.column("v").flatten().to_numpy().astype(np.float64).reshape(own.num_rows, dim)
                code, length, f = encode(v, turns[dim])
                yield pa.record_batch([*own.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(f)], [*own.schema.names, "code", "length", "f"])

    return stored(rows.mapInArrow(run, f"row long, id long, dim int, v array<{element}>, code binary, length double, f double"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (with `number`, how many blocks their length has) dealt by hash into blocks: (dim, block, row, id, v, code,
    length, f), each a packed array in the order of rows."""
    kind = "<f4" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("row").combine_chunks()
        flat = {c: [t.column(c).to_numpy().tobytes()] for c in ("row", "id", "length", "f")}
        parts = {"dim": t.column("dim")[:1], "block": t.column("block")[:1]} | flat
        parts |= {"v": [t.column("v").combine_chunks().flatten().to_numpy().astype(kind).tobytes()], "code": [b"".join(t.column("code").to_pylist())]}
        return pa.table({c: parts[c] for c in ("dim", "block", "row", "id", "v", "code", "length", "f")})

    kinds = "dim int, block int, row binary, id binary, v binary, code binary, length binary, f binary"
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row", F.lit(5)), F.col("number")).cast("int")).drop("number")
    return dealt.groupBy("dim", "block").applyInArrow(pack, kinds)


def _exact(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """<q[i], v[j]> for each pair: products and sums in double precision, from the first component to the last."""
    out, columns, rows = np.empty(len(i)), np.ascontiguousarray(q.T), np.ascontiguousarray(v.T)
    for at in range(0, len(i), _PAIRS):
        a, b = i[at : at + _PAIRS], j[at : at + _PAIRS]
        total = np.zeros(len(a))
        for x, y in zip(columns, rows, strict=True):
            total += x[a] * y[b]
        out[at : at + _PAIRS] = total
    return out


class _Nearest:
    """The best k of each query of a block so far, over blocks of the index."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, sigmas: float, turn: np.ndarray):
        self.rows, self.ids, self.vectors, self.k, self.sigmas = rows, ids, vectors, k, sigmas
        self.planes = Planes(vectors, turn)
        # Of each tile of queries what is kept, in order: query, id found, value.
        self.kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in range(0, len(rows), _TILE)]
        self.reach = np.full(len(rows), -np.inf)

    def _keep(self, query: np.ndarray, near: np.ndarray, score: np.ndarray) -> None:
        """Add values of queries of one tile."""
        tile = int(query[0]) // _TILE
        query, near, score = (np.concatenate(x) for x in zip(self.kept[tile], (query, near, score), strict=True))
        order = np.lexsort((near, -score, query))
        query, near, score = query[order], near[order], score[order]
        best = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.kept[tile] = query[best], near[best], score[best]
        first, n = np.unique(query[best], return_counts=True)
        full = n >= self.k
        self.reach[first[full]] = score[best][np.cumsum(n)[full] - 1]

    def add(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, code: np.ndarray, length: np.ndarray, f: np.ndarray) -> None:
        dim = v.shape[1]
        own = np.searchsorted(rows, self.rows)
        same = (own < len(rows)) & (rows[np.minimum(own, len(rows) - 1)] == self.rows)
        error = np.sqrt(np.maximum(0, 1 - f * f)) / f / np.sqrt(max(1, dim - 1))
        # Values are compared as shares of the block's longest vector, so that no length is too large for them.
        most = length.max()
        share = (length / most).astype(np.float32)
        for at in range(0, len(self.rows), _TILE):
            part = slice(at, min(len(self.rows), at + _TILE))
            estimate = self.planes.estimates(part, code, f)
            rounding = self.planes.rounding[part]
            bound = self.sigmas * np.sqrt(error[None, :] ** 2 + (rounding[:, None] / f[None, :]) ** 2).astype(np.float32)
            estimate[np.flatnonzero(same[part]), own[part][same[part]]] = -np.inf
            estimate += bound
            estimate *= share
            with np.errstate(over="ignore", invalid="ignore"):
                reach = self.reach[part] / self.planes.length[part] / most
            # Until a query has k values, its likeliest k go first, so that the reach is high before others are compared.
            fresh = np.flatnonzero(np.isneginf(reach))
            if len(fresh):
                k = min(self.k, len(rows))
                likely = np.argpartition(-estimate[fresh], k - 1, axis=1)[:, :k]
                i, j = np.repeat(fresh, k), likely.ravel()
                real = estimate[i, j] > -np.inf
                self._rerank(rows, ids, v, i[real] + at, j[real])
                estimate[i, j] = -np.inf
                reach = self.reach[part] / self.planes.length[part] / most
            # float32 estimates are off by far less than this margin.
            i, j = np.nonzero((estimate >= (reach - 1e-5).astype(np.float32)[:, None]) & (estimate > -np.inf))
            self._rerank(rows, ids, v, i + at, j)

    def _rerank(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Inner products of the chosen pairs (i ascending); those that can be among the best k are summed in order."""
        if not len(i):
            return
        rough, starts = np.empty(len(i)), np.flatnonzero(np.diff(i, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(i)], strict=True):
            np.dot(v[j[a:b]], self.vectors[i[a]], out=rough[a:b])
        # The order of the sum changes far less than this.
        margin = 1e-12 * self.planes.length[i] * np.linalg.norm(v, axis=1)[j]
        good = rough + margin >= self.reach[i]
        if good.any():
            # Of many that pass, only those that come near the k-th best of this call.
            i, j, rough, margin = i[good], j[good], rough[good], margin[good]
            order = np.lexsort((-rough, i))
            place = np.arange(len(i)) - np.searchsorted(i, i)
            low, last = i[0], place == self.k - 1
            kth = np.full(i[-1] - low + 1, -np.inf)
            kth[i[last] - low] = rough[order][last]
            near = rough + 2 * margin >= kth[i - low]
            i, j = i[near], j[near]
            self._keep(i, ids[j], _exact(self.vectors, v, i, j))

    def found(self) -> pa.RecordBatch:
        query, near, score = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        return pa.record_batch([pa.array(self.rows[query]), pa.array(self.ids[query]), pa.array(near), pa.array(score)], ["query_row", "query_id", "vec_id", "score"])


def search(index: DataFrame, queries: DataFrame, k: int = 20, sigmas: float = 3.0, seed: int = 42) -> DataFrame:
    """The `k` nearest rows of `index` for each row of `queries` (rows of an index too), but never the same row.

    query_id, rank (from 1), vec_id, score: the exact inner product, nearest first, ties to the smaller id. Queries meet
    all rows of their length in blocks: each block of queries is sent to the tasks that the blocks of the index are dealt
    over, which keep the best so far of each query and return `k` rows of each. A block has a bounded size, whatever the
    tables' sizes. A query with fewer candidates gets them all; query rows that share an id have a list each; no queries or
    an empty index give no row.
    """
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    held = index.groupBy("dim").agg(blocks(F.count(F.lit(1)), INDEX_BLOCK).alias("n_held"))
    sizes = stored(queries.groupBy("dim").agg(blocks(F.count(F.lit(1)), QUERY_BLOCK).alias("n_asked")).join(held, "dim"))
    sizes = sizes.withColumn("splits", F.least("n_held", F.ceil(F.lit(SPLITS) / F.col("n_asked")).cast("int")))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda rows, n: _blocks(rows.join(sizes.select("dim", F.col(n).alias("number")), "dim"))
    asked = of(queries, "n_asked").join(sizes, "dim").withColumn("s", upto("splits"))
    asked = asked.select("dim", F.col("block").alias("q"), "s", *(F.col(c).alias(f"q_{c}") for c in ("row", "id", "v")))
    sent = of(index, "n_held").join(sizes, "dim").withColumn("s", F.col("block") % F.col("splits")).withColumn("q", upto("n_asked"))
    kind = "<f4" if index.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best, turn = None, None, None
        longs = lambda b: np.frombuffer(b, np.int64)
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in b.schema.names if not c.startswith("q_")}
                vectors = lambda raw, dim=row["dim"]: np.frombuffer(raw, kind).astype(np.float64).reshape(-1, dim)
                if key != (row["dim"], row["q"], row["s"]):
                    if best is not None:
                        yield best.found()
                    if key is None or key[0] != row["dim"]:
                        turn = rotation(row["dim"], seed)
                    key = (row["dim"], row["q"], row["s"])
                    best = _Nearest(longs(b.column("q_row")[r].as_py()), longs(b.column("q_id")[r].as_py()), vectors(b.column("q_v")[r].as_py()), k, sigmas, turn)
                rows = longs(row["row"])
                code = np.frombuffer(row["code"], np.uint64).reshape(len(rows), -1)
                best.add(rows, longs(row["id"]), vectors(row["v"]), code, *(np.frombuffer(row[c]) for c in ("length", "f")))
        if best is not None:
            yield best.found()

    # A merge join brings the index blocks of a task one after the other.
    tuned(index.sparkSession)
    met = sent.join(asked.hint("merge"), ["dim", "q", "s"]).select("dim", "q", "s", "q_row", "q_id", "q_v", "row", "id", "v", "code", "length", "f")
    found = met.mapInArrow(run, "query_row long, query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_inner_product(q.e, v.e) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
