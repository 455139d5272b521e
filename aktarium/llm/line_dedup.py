"""Removing lines that repeat across documents, with two Bloom filters before the exact step."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, get_bits, in_batches, set_bits, stored, tuned

#: Filters have 16 bits for each key, at least and at most these powers of two. More keys than the largest filter holds are
#: taken in rounds, each with the keys of one range of hashes and filters of its own, so that filters never fill up.
LEAST_BITS, MOST_BITS, BITS_PER_KEY = 16, 29, 16
#: Filters are merged in segments of this power of two.
_SEGMENT = 16
#: Rows of a key up to which it meets its smallest id in one task; rows of other keys are dealt over salts, this many at most.
USUAL, MOST_SALTS = 1024, 1024
_SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None, least: int) -> list[tuple[int, int] | None]:
    """For each line its key's 128-bit XXH3 digest as two longs, or None where the key has under `least` code points.

    A key is the line without ASCII white space at its ends, A-Z in lower case. Digests stand for keys from here on: among
    10^12 keys, the chance that any two differing ones share a digest is about 10^-15.
    """
    out: list[tuple[int, int] | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        key = line.strip(_SPACE)
        if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "surrogatepass")) < least:
            out.append(None)
        else:
            d = xxhash.xxh3_128_digest(key)
            out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
    return out


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two filter positions of each key, from all bits of its hash."""
    h, down = h.view(np.uint64), np.uint64(64 - bits)
    return tuple(((h * np.uint64(odd)) >> down).astype(np.int64) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def _once_and_twice(keys: DataFrame, bits: int) -> DataFrame:
    """The filter of keys seen at least twice, as (segment, packed bits) of its non-empty segments.

    Each partition fills both filters, batch by batch. Partitions' filters are merged by segment: what any partition saw
    twice, and bits that two partitions set, count as seen twice. A key that repeats has all its bits set, always.
    """
    size = (1 << min(_SEGMENT, bits)) // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros((1 << bits) // 8, np.uint8), np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            h, n = np.unique(b.column("h").to_numpy(), return_counts=True)
            p, q = _places(h, bits)
            again = (n > 1) | get_bits(once, p) & get_bits(once, q)
            for at in (p, q):
                set_bits(twice, at[again])
                set_bits(once, at)
        for kind, filter_ in enumerate((once, twice)):
            for segment in np.flatnonzero(filter_.reshape(-1, size).any(axis=1)).tolist():
                blob = zlib.compress(filter_[segment * size : (segment + 1) * size].tobytes(), 1)
                yield pa.record_batch([pa.array([segment], pa.int32()), pa.array([kind == 1]), pa.array([blob])], ["segment", "twice", "blob"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None and twice.any():
                yield pa.record_batch([pa.array([now], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)])], ["segment", "blob"])

        for b in batches:
            for row in b.to_pylist():
                if row["segment"] != now:
                    yield from done()
                    now, once, twice = row["segment"], np.zeros(size, np.uint8), np.zeros(size, np.uint8)
                got = np.frombuffer(zlib.decompress(row["blob"]), np.uint8)
                if row["twice"]:
                    twice |= got
                else:
                    twice |= once & got
                    once |= got
        yield from done()

    filled = keys.select("h").mapInArrow(fill, "segment int, twice boolean, blob binary")
    return filled.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, blob binary")


def rounds(n_keys: int, most_bits: int | None = None) -> int:
    """How many rounds `suspects` takes for so many keys; for more than one, sort them by `h` within partitions."""
    return max(1, -(-BITS_PER_KEY * n_keys >> (MOST_BITS if most_bits is None else most_bits)))


def suspects(keys: DataFrame, n_keys: int, most_bits: int | None = None) -> DataFrame:
    """The rows of `keys` (with a hash `h`) whose bits are all set in the twice-seen filter, written out.

    The filter is broadcast: at most 2^`most_bits` bits, compressed. Where the keys need more, they're taken in rounds by
    ranges of their hashes, each with a filter of that size, which the next one replaces.
    """
    most_bits = MOST_BITS if most_bits is None else most_bits
    number = rounds(n_keys, most_bits)
    bits = min(most_bits, max(LEAST_BITS, (BITS_PER_KEY * max(1, n_keys) - 1).bit_length()))
    size, context, out = (1 << min(_SEGMENT, bits)) // 8, keys.sparkSession.sparkContext, None
    for k in range(number):
        first, last = ((x << 64) // number - (1 << 63) for x in (k, k + 1))
        own = keys.filter((F.col("h") >= first) & (F.col("h") <= last - 1)) if number > 1 else keys
        filter_ = context.broadcast({r["segment"]: bytes(r["blob"]) for r in _once_and_twice(own, bits).collect()})

        def test(batches: Iterator[pa.RecordBatch], filter_=filter_) -> Iterator[pa.RecordBatch]:
            twice = np.zeros((1 << bits) // 8, np.uint8)
            for segment, blob in filter_.value.items():
                twice[segment * size : (segment + 1) * size] = np.frombuffer(zlib.decompress(blob), np.uint8)
            for b in batches:
                p, q = _places(b.column("h").to_numpy(), bits)
                yield b.filter(pa.array(get_bits(twice, p) & get_bits(twice, q)))

        found = stored(own.mapInArrow(test, keys.schema))
        filter_.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def repeated_lines(suspected: DataFrame) -> DataFrame:
    """The rows (h, g, doc, t) of `suspected` that lose the line: a smaller id has it, or they have no id and any id has it.

    Each key's smallest id is aggregated before anything is shuffled. Rows then meet it by key; a key with more than USUAL
    rows is met by its rows dealt over salts.
    """
    keys = suspected.groupBy("h", "g").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max(F.col("doc").isNull()).alias("other"), F.count(F.lit(1)).alias("m"))
    keys = stored(keys.filter((F.col("first") < F.col("last")) | (F.col("first").isNotNull() & F.col("other"))).select("h", "g", "first", "m"))
    most = keys.agg(F.max("m")).first()[0] or 0
    loses = F.coalesce(F.col("doc") > F.col("first"), F.lit(True))
    found = suspected.join(keys.filter(F.col("m") <= USUAL), ["h", "g"]).filter(loses).select("h", "g", "doc", "t")
    if most > USUAL:
        salts = min(MOST_SALTS, -(-most // USUAL))
        salt = F.pmod(F.xxhash64("doc", "t"), F.lit(salts)).cast("int")
        hot = keys.filter(F.col("m") > USUAL).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = found.unionByName(suspected.withColumn("salt", salt).join(hot, ["h", "g", "salt"]).filter(loses).select("h", "g", "doc", "t"))
    return found


def dedup_lines(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text", n_lines_col: str = "n_lines", n_dropped_col: str = "n_dropped") -> DataFrame:
    """All rows and columns of `docs`, the text without lines that an earlier document has, and `n_lines`, `n_dropped`.

    Keys (see `line_keys`) of at least `least` code points that two or more documents hold lose all their lines except in
    the smallest id. Texts are read twice: once for the keys, which are written as two longs, the id and a hash of the text,
    and once to drop lines. Of the keys, only those that the twice-seen filter suspects are shuffled. Texts meet their drop
    lists by id and hash; so a list has at most the lines of one text, whatever repeats.

    Null and empty texts are one empty line; where nothing is dropped the text stays as it is, null included. Rows with
    one id count as one document, and so do all rows without an id, which comes after all others. Ids of any type that has
    an order will do. An empty table gives no row. Input columns with the names of the two counts are replaced.
    """
    tuned(docs.sparkSession)
    gone, doc, t = P + "gone", P + "doc", P + "t"
    docs = docs.drop(n_lines_col, n_dropped_col)
    numbered = docs.withColumns({doc: F.col(id_col), t: F.xxhash64(text_col)})
    kind = docs.schema[id_col].dataType.simpleString()

    def keys_of(b: pa.RecordBatch) -> pa.RecordBatch:
        h, g, at = [], [], []
        for row, text in enumerate(b.column("text")):
            found = {k for k in line_keys(text.as_py(), least) if k}
            h += [k[0] for k in found]
            g += [k[1] for k in found]
            at += [row] * len(found)
        at = pa.array(at, pa.int64())
        return pa.record_batch([pa.array(h, pa.int64()), pa.array(g, pa.int64()), b.column("doc").take(at), b.column("t").take(at)], ["h", "g", "doc", "t"])

    texts = numbered.select(F.col(text_col).alias("text"), F.col(doc).alias("doc"), F.col(t).alias("t"))
    keys = stored(in_batches(texts, keys_of, f"h long, g long, doc {kind}, t long").sortWithinPartitions("h"))
    suspected = suspects(keys, keys.count())
    drops = repeated_lines(suspected).groupBy("doc", "t").agg(F.collect_set(F.struct("h", "g")).alias(gone))
    # Drop lists are hashed: in each partition they're far smaller than the texts, which then needn't be sorted.
    drops = drops.select(F.col("doc").alias(P + "d"), F.col("t").alias(P + "u"), gone).hint("shuffle_hash")
    joined = numbered.join(drops, F.col(t).eqNullSafe(F.col(P + "u")) & F.col(doc).eqNullSafe(F.col(P + "d")), "left")
    text_at, names = docs.columns.index(text_col), docs.columns

    def rewrite(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, n_lines, n_dropped = b.column(text_at).to_pylist(), [], []
        for row, dropped in enumerate(b.column(len(names)).to_pylist()):
            text = texts[row] or ""
            n_lines.append(text.count("\n") + 1)
            n_dropped.append(0)
            if dropped:
                bad = {(d["h"], d["g"]) for d in dropped}
                lines = text.split("\n")
                kept = [x for x, k in zip(lines, line_keys(text, least), strict=True) if k not in bad]
                n_dropped[-1] = len(lines) - len(kept)
                texts[row] = "\n".join(kept) if len(kept) < len(lines) else texts[row]
        columns = [pa.array(texts, pa.string()) if k == text_at else b.column(k) for k in range(len(names))]
        return pa.record_batch([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, n_lines_col, n_dropped_col])

    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return in_batches(joined.select(*(F.col(f"`{c}`") for c in names), gone), rewrite, f"{kinds}, `{n_lines_col}` long, `{n_dropped_col}` long")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, u.pos AS pos, u.line AS line,
         regexp_replace(regexp_replace(translate(u.line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS k
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l, i: {'line': l, 'pos': i})) AS u FROM documents)
), firsts AS (
  SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT lines.*, coalesce(doc_id > first, false) AS gone FROM lines LEFT JOIN firsts USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
