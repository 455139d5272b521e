"""A persisted index of chunk vectors: cells of similar directions, and codes of a byte a component with exact error bounds.

A search reads codes only: a row's cosine to the query lies within its code's error, so rows that can't be among the best are
known without their vectors, and cells that can't hold any are known from their centre and the widest angle in them. Cells are
read nearest first, in at most three rounds, until none that is left can improve the result; the vectors of the few rows that
remain are then compared exactly. So results are those of the full scan, whatever the scope and however the vectors lie.

The table `rows` is partitioned by cell and sorted by id, so that codes are read without vectors, and single vectors by page.
`cells` has, for each batch that was added and each cell, the number of rows and the widest angle; `centres` never change.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import best_per_document, cosine_distance, mean_vectors
from ..session import stored
from .retrieval import comparable_to

#: Rows of a cell on average, cells at most, and vectors that the centres are fitted on at most.
ROWS_PER_CELL, MOST_CELLS, MOST_SAMPLE = 1024, 1024, 8192
#: Shares of the cells that have been read after each round, where their bounds don't exclude them.
ROUNDS = (1 / 16, 1 / 4, 1.0)
#: What rounding in double precision can change, with room to spare; rows that are fetched by literal ids.
_MARGIN, _LITERALS = 1e-6, 1000
_KEPT = ("id", "document_id", "position", "content", "embedding", "embedding_model", "embedding_model_version")


def _centres(vectors: np.ndarray, n: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Directions that the sample's unit vectors gather around, by spherical k-means."""
    rng = np.random.default_rng(seed)
    found = vectors[rng.permutation(len(vectors))[:n]]
    for _ in range(rounds):
        own = (vectors @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, vectors)
        size = np.linalg.norm(sums, axis=1)
        found = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], found)
    return found


def encoded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors (rows): whole numbers from -127 to 127, the size of their steps, and the length of what is left over."""
    step = np.maximum(np.abs(unit).max(axis=1), 1e-30) / 127
    code = np.rint(unit / step[:, None])
    return code.astype(np.int8), step, np.linalg.norm(unit - code * step[:, None], axis=1)


def _usable(chunks: DataFrame) -> DataFrame:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return chunks.select(*_KEPT).filter("embedding IS NOT NULL").filter(~F.exists("embedding", bad)).filter(F.exists("embedding", lambda x: x != 0)).withColumn("dim", F.size("embedding"))


def _matrix(b: pa.RecordBatch, dim: int) -> np.ndarray:
    v = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@dataclass(frozen=True)
class Read:
    """What a search has read: cells and rows of codes, of how many, and rows whose vectors were fetched at most."""

    cells: int
    all_cells: int
    rows: int
    all_rows: int
    fetched: int


class VectorIndex:
    """The index at a path. Vectors of another length than the query's, null and zero ones, and those with null or
    non-finite components are never found; chunks are told apart by id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.centres: dict[int, np.ndarray] = {}
        self.first: dict[int, int] = {}
        # At most MOST_CELLS rows for each length of vectors.
        for r in sorted(spark.read.parquet(f"{self.path}/centres").collect(), key=lambda r: r["dim"]):
            self.centres[r["dim"]] = np.frombuffer(r["centres"]).reshape(-1, r["dim"])
            self.first[r["dim"]] = r["first"]

    @classmethod
    def build(cls, chunks: DataFrame, path: str, rows_per_cell: int = ROWS_PER_CELL, seed: int = 42) -> VectorIndex:
        """Fit the centres on at most MOST_SAMPLE chunks of each length of vectors, chosen by a hash of the id, and add all."""
        spark, usable = chunks.sparkSession, _usable(chunks)
        fitted, first = [], 0
        for r in sorted(usable.groupBy("dim").count().collect(), key=lambda r: r["dim"]):
            dim, n = r["dim"], r["count"]
            own = usable.filter(F.col("dim") == dim).filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(-(-n // MOST_SAMPLE))) == 0)
            sample = np.array([x["embedding"] for x in own.select("embedding").limit(MOST_SAMPLE).collect()], np.float64).reshape(-1, dim)
            unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
            centres = _centres(unit, min(MOST_CELLS, -(-n // rows_per_cell), max(1, len(unit))), seed) if len(unit) else np.eye(1, dim)
            fitted.append((dim, first, bytearray(centres.tobytes())))
            first += len(centres)
        spark.createDataFrame(fitted, "dim int, first int, centres binary").coalesce(1).write.parquet(f"{path}/centres")
        index = cls(spark, path)
        index.extend(chunks)
        return index

    def extend(self, chunks: DataFrame) -> None:
        """Add chunks. Their cells' angles are written before they are, so a search beside it misses none that it sees."""
        centres, first = self.centres, self.first
        usable = _usable(chunks).filter(F.col("dim").isin(*centres)) if centres else _usable(chunks).limit(0)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = b.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    own = b.filter(pa.array(dims == dim))
                    unit = _matrix(own, dim)
                    near = unit @ centres[dim].T
                    cell = near.argmax(axis=1)
                    code, step, error = encoded(unit)
                    angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                    added = [pa.array((cell + first[dim]).astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(step), pa.array(error), pa.array(angle)]
                    yield pa.record_batch([*own.columns, *added], [*own.schema.names, "cell", "code", "step", "error", "angle"])

        kinds = ", ".join(f"{c} {t}" for c, t in usable.dtypes)
        placed = stored(usable.mapInArrow(place, f"{kinds}, cell int, code binary, step double, error double, angle double"))
        placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle")).coalesce(1).write.mode("append").parquet(f"{self.path}/cells")
        # By range, so that a large cell has several files.
        rows = placed.drop("angle", "dim").repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
        rows.write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        """All that is indexed."""
        kinds = "id long, document_id long, position int, content string, embedding array<float>, embedding_model string, embedding_model_version string, code binary, step double, error double, cell int"
        try:
            return self.spark.read.parquet(f"{self.path}/rows")
        except Exception as e:
            if "UNABLE_TO_INFER_SCHEMA" not in str(e) and "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], kinds)

    def near(self, scope: DataFrame, query: Sequence[float], n: int, by: str = "document_id", least: float = -1.0, models: DataFrame | None = None) -> tuple[DataFrame, Read]:
        """The rows that can be among the best `n` (counted by `by`: document_id or id) of the documents in `scope` (column
        id) with a cosine of `least` or more, and what was read. `models` restricts the embedding models.

        Cells are read until there are `n` or none is left, and none that is left can hold a better one.
        """
        unit = np.array(query, np.float64)
        none = self.rows().limit(0)
        if not np.isfinite(unit).all() or not unit.any() or len(unit) not in self.centres or n <= 0:
            return none, Read(0, 0, 0, 0, 0)
        unit = unit / np.abs(unit).max()
        unit = unit / np.linalg.norm(unit)
        centres, first = self.centres[len(unit)], self.first[len(unit)]
        # A row for each cell.
        held = {r["cell"] - first: (r["n"], r["angle"]) for r in self.spark.read.parquet(f"{self.path}/cells").groupBy("cell").agg(F.sum("n").alias("n"), F.max("angle").alias("angle")).collect() if first <= r["cell"] < first + len(centres)}
        to_centre = np.arccos(np.clip(centres @ unit, -1, 1))
        order = sorted(held, key=lambda c: (to_centre[c], c))
        highest = {c: float(np.cos(max(0.0, to_centre[c] - held[c][1]))) + _MARGIN for c in order}
        reach, done, found = least - _MARGIN, set(), []
        for share in ROUNDS:
            wanted = [c for c in order[: -(-int(len(order) * share * 1000) // 1000) or 1] if c not in done and highest[c] >= reach]
            if not wanted:
                continue
            done |= set(wanted)
            rows = self.rows().filter(F.col("cell").isin([c + first for c in wanted])).join(scope.select(F.col("id").alias("document_id")), "document_id", "left_semi")
            if models is not None:
                rows = rows.join(models, ["embedding_model", "embedding_model_version"], "left_semi")
            found.append(stored(_bounds(rows.select("cell", "id", "document_id", "code", "step", "error"), unit).filter(F.col("high") >= reach)))
            whole = found[0]
            for f in found[1:]:
                whole = whole.unionByName(f)
            best = whole.groupBy(by).agg(F.max("low").alias("low")).orderBy(F.desc("low")).limit(n).agg(F.min("low"), F.count(F.lit(1))).first()
            if best[1] == n:
                reach = max(reach, best[0] - _MARGIN)
        read = lambda kept: Read(len(done), len(order), sum(held[c][0] for c in done), sum(x[0] for x in held.values()), kept)
        if not found:
            return none, read(0)
        kept = whole.filter(F.col("high") >= reach)
        if by != "id":  # only what can be its document's best
            kept = kept.join(kept.groupBy(by).agg(F.max("low").alias("best")), by).filter(F.col("high") >= F.col("best") - _MARGIN)
        kept = kept.select("cell", "id")
        some = kept.limit(_LITERALS + 1).collect()
        if len(some) > _LITERALS:
            return self.rows().join(kept, ["cell", "id"], "left_semi"), read(kept.count())
        cells, ids = {r["cell"] for r in some}, [r["id"] for r in some]
        return self.rows().filter(F.col("cell").isin(*cells) & F.col("id").isin(*ids)) if some else none, read(len(some))


def _bounds(rows: DataFrame, unit: np.ndarray) -> DataFrame:
    """(cell, id, document_id, low, high): between what the cosine of each coded row and the query lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(b.num_rows, -1)
                value, error = (code @ unit) * b.column("step").to_numpy(), b.column("error").to_numpy() + 1e-9
                yield pa.record_batch([*(b.column(c) for c in ("cell", "id", "document_id")), pa.array(value - error), pa.array(value + error)], ["cell", "id", "document_id", "low", "high"])

    ids = {c: t for c, t in rows.dtypes if c in ("id", "document_id")}
    return rows.mapInArrow(run, f"cell int, id {ids['id']}, document_id {ids['document_id']}, low double, high double")


def _exact(rows: DataFrame, query: Sequence[float]) -> DataFrame:
    wanted = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("distance", cosine_distance(F.col("embedding"), wanted)).filter("distance IS NOT NULL")


def search_indexed(index: VectorIndex, candidates: DataFrame, query: Sequence[float], limit: int = 20) -> DataFrame:
    """`retrieval.search` by the index: the same rows, of usable vectors."""
    rows, _ = index.near(candidates, query, limit)
    best = best_per_document(_exact(rows, query), limit)
    return best.select("document_id", F.col("id").alias("chunk_id"), F.col("content").alias("snippet"), (1 - F.col("distance")).alias("score"))


def similar_indexed(index: VectorIndex, docs: DataFrame, visible: DataFrame, document: int, limit: int = 5, min_score: float = 0.7, cap: int = 200, exclude: Sequence[int] = ()) -> DataFrame:
    """`retrieval.similar_documents` by the index: no cell is read that can't hold a chunk with `min_score`."""
    own = index.rows().filter(F.col("document_id") == document)
    mean = mean_vectors(own, "document_id").select("mean").first()
    if not mean or limit <= 0:
        return index.rows().limit(0).select("document_id", F.col("id").alias("chunk_id"), F.lit(0.0).alias("score"))
    candidates, models = comparable_to(own, docs, visible, document, exclude)
    rows, _ = index.near(candidates, mean["mean"], cap, by="id", least=min_score, models=models)
    near = _exact(rows, mean["mean"]).filter(F.col("distance") <= 1 - min_score).orderBy("distance", "id").limit(cap)
    return best_per_document(near, limit).select("document_id", F.col("id").alias("chunk_id"), (1 - F.col("distance")).alias("score"))
