"""Codes of vectors: each part of a vector is the number of the nearest entry of its position's codebook.

Components are made whole numbers, vectors are cut into parts, and equal parts of a position become one distinct row with a
weight. Codebooks are fitted by weighted Lloyd rounds over these rows: tasks assign rows to entries and return one sum for
each entry, the driver has the sums of the entries alone. Codes and errors of the distinct rows are joined back to the
vectors. All is exact in whole numbers, whatever the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, P, discard, joined, stored, tuned

#: Parts of a vector, entries of a codebook, rounds of fitting, steps of one unit of a component.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole numbers below are exact in double precision; sums of so many rows of so large numbers are exact as longs.
_EXACT, _SMALL = 1 << 53, 1 << 22
_SUM = pa.decimal128(38, 0)

#: Of each length of vectors, and of each position, the entries, one a row.
Codebooks = dict[int, list[np.ndarray]]


def _cuts(dim: int, parts: int) -> list[int]:
    return [k * dim // parts for k in range(parts + 1)]


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """(row, id, label, dim, v) of the rows whose vector is there and holds no null and no non-finite component; v is the
    floor of each component times `scale`, as longs (beyond their range, the nearest long). Written out."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter("v IS NOT NULL").filter(~F.exists("v", bad))
    whole = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.size("v").alias("dim"), whole.alias("v")))


def _parts(rows: DataFrame, parts: int) -> DataFrame:
    """(row, dim, pos, part) of each row and position."""
    cut = lambda k: F.floor(k * F.col("dim") / parts).cast("int")
    slices = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice("v", cut(k) + 1, cut(k + 1) - cut(k)))
    return rows.select("row", "dim", F.posexplode(slices).alias("pos", "part"))


def _most(values: np.ndarray) -> float:
    return float(np.abs(values.astype(np.float64)).max(initial=0))


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first of the nearest entries, and the squared distance to it, exactly."""
    if 4 * values.shape[1] * max(_most(values), _most(entries)) ** 2 < _EXACT:
        a, b = values.astype(np.float64), entries.astype(np.float64)
        distance = (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
        code = distance.argmin(axis=1)
        return code, (distance[np.arange(len(a)), code] + (a * a).sum(axis=1)).astype(np.int64)
    a, b = values.astype(object), entries.astype(object)
    codes, errors = np.zeros(len(a), np.int64), np.zeros(len(a), object)
    for k, row in enumerate(a):
        distance = [sum((x - y) ** 2 for x, y in zip(row, e, strict=True)) for e in b]
        errors[k] = min(distance)
        codes[k] = distance.index(errors[k])
    return codes, errors


def _by_position(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Length of vectors, position, numbers of the rows, and their parts, one a row."""
    dims, positions = b.column("dim").to_numpy(), b.column("pos").to_numpy()
    kinds, at = np.unique(np.stack([dims, positions]), axis=1, return_inverse=True)
    for k, (dim, pos) in enumerate(kinds.T.tolist()):
        own = np.flatnonzero(at.ravel() == k)
        values = b.column("part").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        yield dim, pos, own, values.reshape(len(own), -1)


def _fitted(distinct: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after a Lloyd round over the weighted rows; entries that no row is nearest to stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            n = b.column("n").to_numpy()
            for dim, pos, own, values in _by_position(b):
                entries = books[dim][pos]
                code, _ = nearest(values, entries)
                exact = np.int64 if _most(values) < _SMALL else object
                weighted = np.concatenate([values.astype(exact), np.ones((len(own), 1), exact)], axis=1) * n[own].astype(exact)[:, None]
                found = np.zeros((len(entries), values.shape[1] + 1), exact)
                np.add.at(found, code, weighted)
                sums[dim, pos] = sums.get((dim, pos), 0) + found.astype(object)
        rows = [(dim, pos, e, j, int(s[-1]), Decimal(int(x))) for (dim, pos), found in sums.items() for e, s in enumerate(found) if s[-1] for j, x in enumerate(s[:-1])]
        if rows:
            columns = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), _SUM)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["dim", "pos", "entry", "at", "n", "s"])

    summed = distinct.mapInArrow(run, "dim int, pos int, entry int, at int, n long, s decimal(38,0)").groupBy("dim", "pos", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    new = {dim: [b.astype(object) for b in own] for dim, own in books.items()}
    for r in summed.collect():  # a row for each component of each entry
        new[r["dim"]][r["pos"]][r["entry"], r["at"]] = int(r["s"]) // r["n"]
    return {dim: [b.astype(np.int64) for b in own] for dim, own in new.items()}


def fit(rows: DataFrame, distinct: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of `rows` (of `whole_numbers`), with weights from `distinct`. They start as the parts of the rows with the
    smallest ids (null last, equal ids by their vectors); lengths of vectors have codebooks of their own."""
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.asc_nulls_last("id"), "v"))
    first = rows.select("dim", "id", "v").withColumn("place", place).filter(F.col("place") <= entries)
    seeds: dict[int, list] = {}
    for r in sorted(first.select("dim", "place", "v").collect(), key=lambda r: r["place"]):
        seeds.setdefault(r["dim"], []).append(r["v"])
    books = {}
    for dim, own in seeds.items():
        table, cuts = np.array(own, np.int64).reshape(len(own), dim), _cuts(dim, parts)
        books[dim] = [table[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for _ in range(rounds):
        books = _fitted(distinct, books)
    return books


def books_text(books: Codebooks) -> str:
    """All entries' components in decimal, by length, part, entry and position within the part, joined by commas."""
    return ",".join(str(x) for dim in sorted(books) for part in books[dim] for x in part.ravel().tolist())


def books_digest(books: Codebooks) -> str:
    return hashlib.sha256(books_text(books).encode()).hexdigest()


def decode(codes: list[int], books: Codebooks, dim: int, scale: int = SCALE) -> list[float]:
    """The vector that codes stand for, in the middle of its steps."""
    return [(float(x) + 0.5) / scale for part, code in zip(books[dim], codes, strict=True) for x in part[code]]


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """A row for each usable vector, with id, label, codes (an array of ints by position), error and label_error; and the
    codebooks.

    Vectors that are null or hold null or non-finite components are left out. `error` is the sum of the parts' squared
    distances in whole numbers, `label_error` its sum over the rows of an equal label, nulls together; both are null beyond
    a long's range. A vector whose length isn't a multiple of `parts` has parts as equal as can be (empty ones have code 0),
    and vectors of another length have other codebooks. With fewer rows than `entries` there are fewer entries. Repeated
    ids and rows are rows each. Other columns aren't read; no rows give no rows and no codebooks.
    """
    spark = tuned(vectors.sparkSession)
    rows = whole_numbers(vectors, id_col, vector_col, label_col, scale)
    distinct = stored(_parts(rows, parts).groupBy("dim", "pos", "part").agg(F.count(F.lit(1)).alias("n")))
    books = fit(rows, distinct, parts, entries, rounds)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, errors = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, object)
            for dim, pos, own, values in _by_position(b):
                codes[own], errors[own] = nearest(values, books[dim][pos])
            error = pa.array([Decimal(int(x)) for x in errors], _SUM)
            yield pa.record_batch([*(b.column(c) for c in ("dim", "pos", "part", "n")), pa.array(codes), error], ["dim", "pos", "part", "n", "code", "error"])

    assigned = stored(distinct.mapInArrow(assign, "dim int, pos int, part array<long>, n long, code int, error decimal(38,0)"))
    most = max(1, rows.count() // HOT)
    met = joined(_parts(rows, parts), assigned, ["dim", "pos", "part"], "n", most)
    codes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"])
    coded = met.groupBy("row").agg(codes.alias("codes"), F.sum("error").alias(P + "error"))
    key = F.coalesce(F.concat(F.lit("1"), F.col("label").cast("string")), F.lit("0"))
    coded = stored(rows.select("row", "id", "label", key.alias("key")).join(coded, "row"))
    discard(spark, distinct, assigned, rows)
    labels = coded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(P + "error").alias(P + "total"))
    long = lambda c: F.expr(f"try_cast(`{P}{c}` AS bigint)")
    out = joined(coded, labels, ["key"], "n", most)
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "codes", long("error").alias("error"), long("total").alias("label_error")), books


def code_text(codes: Column) -> Column:
    """Codes as two hex digits each."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def _oracle() -> str:
    """`op12_vector_codes` in DuckDB's SQL, for vectors of 64 components."""
    distance = " + ".join(f"(part[{k}] - entry[{k}]) * (part[{k}] - entry[{k}])" for k in range(1, 5))
    down = lambda k: f"(sum(n * part[{k}]) - ((sum(n * part[{k}]) % sum(n)) + sum(n)) % sum(n)) // sum(n)"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS (SELECT p, part, n, min(({distance}) * 64 + e) AS m FROM d JOIN c{r} USING (p) GROUP BY p, part, n)")
        if r < ROUNDS:
            means = ", ".join(f"CAST({down(k)} AS BIGINT)" for k in range(1, 5))
            steps.append(f"m{r} AS (SELECT p, m % 64 AS e, [{means}] AS entry FROM a{r} GROUP BY p, m % 64)")
            steps.append(f"c{r + 1} AS (SELECT p, e, coalesce(m{r}.entry, c{r}.entry) AS entry FROM c{r} LEFT JOIN m{r} USING (p, e))")
    return f"""
WITH k AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT r, vec_id, label, p, v[4 * p + 1 : 4 * p + 4] AS part FROM k, range(16) AS t(p)
), d AS (SELECT p, part, CAST(count(*) AS BIGINT) AS n FROM parts GROUP BY p, part),
c0 AS (
  SELECT p, e, part AS entry FROM (SELECT p, part, row_number() OVER (PARTITION BY p ORDER BY vec_id, part) - 1 AS e FROM parts) WHERE e < 64
), {", ".join(steps)},
coded AS (
  SELECT r, vec_id, label, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error
  FROM parts JOIN a{ROUNDS} USING (p, part) GROUP BY r, vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded
"""


ORACLE = _oracle()
