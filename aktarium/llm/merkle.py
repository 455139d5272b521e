"""A Merkle manifest of a table: a tree of digests for each group of rows, one over their roots, and a proof for each row.

Nodes travel as events. A parent that has some of its children's digests is kept partial, indexed by child, until it has as
many as its arity, which follows from the tree's size; then it is an event of its own for its parent, and so on up. So
each task resolves what it can of the nodes that it holds (rows are sorted, so nearly all of them), and what remains,
finished ancestors and partial parents, is the frontier that is shuffled and combined in the same way: the aggregation of
`combineByKey`, whose key is the ancestor `levels` levels up. Its result is the next round's input. Proofs follow the
links back: from the root to the nodes of the last round, and from each node that a round ended with to those it began with.
No task holds more than arity ** levels nodes of a key, whatever the sizes of the trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, discard, ranked, stored

#: Levels that one round climbs: with two children a node, 1,024 nodes meet in a task at a time.
LEVELS = 10
_NODE = "tree string, level int, idx long, size long, digest string"
_PATH = "array<struct<before: string, after: string>>"


def digest(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the columns' strings, one after the other."""
    return F.sha2(F.concat(*columns), 256)


def encoded(column: Column) -> Column:
    """`-` for null, else the value's length in bytes of UTF-8, a colon and the value."""
    value = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def hashed(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def width(size: int, level: int, arity: int) -> int:
    """Nodes at a level of a tree of `size` leaves."""
    return -(-size // arity**level)


class Partial:
    """Parents of one key that wait for children, up to the level `top` or the root."""

    def __init__(self, size: int, top: int, arity: int):
        self.size, self.top, self.arity = size, top, arity
        self.waiting: dict[tuple[int, int], dict[int, str]] = {}

    def arrive(self, level: int, idx: int, value: str) -> tuple[int, int, str] | None:
        """Take a node; the key's topmost ancestor, if that was the last one it waited for."""
        while level < self.top and (n := width(self.size, level, self.arity)) > 1:
            parent = idx // self.arity
            children = self.waiting.setdefault((level, parent), {})
            children[idx] = value
            if len(children) < min(self.arity, n - parent * self.arity):
                return None
            del self.waiting[level, parent]
            value = hashed(children[c] for c in sorted(children))
            level, idx = level + 1, parent
        return level, idx, value

    def frontier(self) -> Iterator[tuple[int, int, str]]:
        for (level, _), children in self.waiting.items():
            yield from ((level, idx, value) for idx, value in children.items())


def _rows(found: list[tuple], fields: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in fields.split(", ")), strict=True)
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    columns = zip(*found, strict=True) if found else [[]] * len(names)
    return pa.record_batch([pa.array(list(c), types[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def _round(nodes: DataFrame, top: int, arity: int) -> DataFrame:
    """The ancestors at level `top` (or the roots below it) of nodes that lie under them completely."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], Partial] = {}
        for b in batches:
            out = []
            for tree, level, idx, size, value in zip(*(b.column(c).to_pylist() for c in ("tree", "level", "idx", "size", "digest")), strict=True):
                key = tree, idx // arity ** (top - level)
                if key not in held:
                    held[key] = Partial(size, top, arity)
                if (done := held[key].arrive(level, idx, value)) is not None:
                    del held[key]
                    out.append((tree, done[0], done[1], size, done[2], key[1]))
            yield _rows(out, _NODE + ", block long")
        for (tree, block), partial in held.items():
            yield _rows([(tree, level, idx, partial.size, value, block) for level, idx, value in partial.frontier()], _NODE + ", block long")

    def merge(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(combine(t.select(["tree", "level", "idx", "size", "digest"]).combine_chunks().to_batches()))).drop_columns(["block"])

    met = nodes.select("tree", "level", "idx", "size", "digest").mapInArrow(combine, _NODE + ", block long")
    return stored(met.groupBy("tree", "block").applyInArrow(merge, _NODE))


def _rise(leaves: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """The nodes that each round begins with, the leaves (tree, level, idx, size, digest, others) first, and the roots."""
    most, rounds = leaves.agg(F.max("size")).first()[0] or 1, [leaves]
    while width(most, levels * (len(rounds) - 1), arity) > 1:
        rounds.append(_round(rounds[-1], levels * len(rounds), arity))
    return rounds


def _steps(values: list[str], first: int, size: int, levels: int, arity: int) -> tuple[list[tuple[list[str], list[str]]], list[str]]:
    """For each level above the nodes `values` (from index `first` on, `size` at their level): what its run has before and
    after each node, as long as the tree has a level; and the nodes of the last."""
    found = []
    for _ in range(levels):
        if size == 1:
            break
        runs = [values[at : at + arity] for at in range(0, len(values), arity)]
        found.append((["".join(r[:k]) for r in runs for k in range(len(r))], ["".join(r[k + 1 :]) for r in runs for k in range(len(r))]))
        values, size = [hashed(r) for r in runs], -(-size // arity)
    return found, values


def _descend(nodes: DataFrame, upper: DataFrame, keep: Sequence[str], passed: Sequence[str], arity: int, levels: int) -> DataFrame:
    """The nodes with `path`, their steps up to the root of all, and the columns `passed` of what they lie under.

    `upper` has (tree, block, path, passed) for each ancestor, `levels` levels up, or root.
    """
    kinds = dict(nodes.dtypes)
    inner = [f"k{k}" for k in range(len(keep))]
    above = dict(upper.dtypes)
    schema = ", ".join(["tree string, idx long", *(f"{k} {kinds[c]}" for k, c in zip(inner, keep, strict=True)), f"path {_PATH}", *(f"{c} {above[c]}" for c in passed)])
    rows = nodes.select("tree", "level", "idx", "size", "digest", *(F.col(f"`{c}`").alias(k) for k, c in zip(inner, keep, strict=True)))
    rows = rows.withColumn("block", F.expr(f"idx div {arity**levels}"))
    names = ["tree", "idx", *inner, "path", *passed]

    def link(below: pa.Table, top: pa.Table) -> pa.Table:
        below = below.sort_by("idx")
        values, n, up = below.column("digest").to_pylist(), below.num_rows, top.column("path")[0].as_py()
        first = below.column("idx")[0].as_py()
        steps, _ = _steps(values, first, width(below.column("size")[0].as_py(), below.column("level")[0].as_py(), arity), levels, arity)
        at, sides = np.arange(n), []
        for side, name in enumerate(("before", "after")):
            table = np.empty((n, len(steps) + len(up)), object)
            for k, step in enumerate(steps):
                table[:, k] = np.array(step[side], object)[at // arity**k]
            for k, step in enumerate(up):
                table[:, len(steps) + k] = step[name]
            sides.append(pa.array(table.ravel(), pa.string()))
        paths = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (len(steps) + len(up)), pa.int32()), pa.StructArray.from_arrays(sides, ["before", "after"]))
        same = [pa.repeat(top.column(c)[0], n) for c in passed]
        return pa.table([below.column("tree"), below.column("idx"), *(below.column(k) for k in inner), paths, *same], names)

    out = rows.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(link, schema)
    return out.toDF("tree", "idx", *keep, "path", *passed)


def _linked(rounds: list[DataFrame], upper: DataFrame, keep: Sequence[str], passed: Sequence[str], arity: int, levels: int) -> DataFrame:
    """`_descend` through all rounds, to the leaves."""
    for nodes in rounds[-2:0:-1]:
        upper = stored(_descend(nodes, upper, (), passed, arity, levels).withColumnRenamed("idx", "block"))
    return _descend(rounds[0], upper, keep, passed, arity, levels)


def manifest(rows: DataFrame, group: str, order: str, leaf: str, keep: Sequence[str] = (), arity: int = 2, levels: int = LEVELS) -> DataFrame:
    """Of each row: the columns `keep` and `leaf`, position (in its tree, from 0), subroot, root, and path.

    Rows of one `group` (a string; null is a group) are the leaves of a tree, ascending by `order`; nulls come first, rows of
    equal `order` go by their leaf. Every `arity` consecutive nodes, fewer in the last run, become the digest of their
    digests until one node is left, the subroot; subroots, ordered by group (null first, then by bytes), become the root in
    the same way. A single leaf is its tree's subroot itself. `path` has a step for each level from the leaf to the root: the
    digests `before` and `after` the node in its run, each joined; both are empty where the node is alone. `fold` and
    `siblings` read it.

    Rows that agree in `order` and `leaf` must agree in `keep`. Repeated rows are leaves each. An empty table gives no row.
    Leaves are dealt by range over group and order, so that one group may hold any share of them; only these narrow columns
    are shuffled, and groups may be as many as rows. What it writes on its way stays until `drop_stored`, as the result is lazy.
    """
    key = P + "tree"
    narrow = rows.select(F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias(key), F.col(order).alias(P + "order"), F.col(leaf).alias(P + "leaf"), *(F.col(f"`{c}`") for c in keep))
    placed = ranked(narrow, [key], [P + "order", P + "leaf"], P + "idx", P + "size")
    leaves = placed.select(F.col(key).alias("tree"), F.lit(0).alias("level"), F.col(P + "idx").alias("idx"), F.col(P + "size").alias("size"), F.col(P + "leaf").alias("digest"), *(F.col(f"`{c}`").alias(P + f"k{k}") for k, c in enumerate(keep)), F.col(P + "leaf"))
    rounds = _rise(leaves, arity, levels)
    heads = rounds[-1].select(F.lit("").alias("all"), F.col("tree").alias("own"), F.col("digest").alias("subroot"))
    heads = ranked(heads, ["all"], ["own"], "idx", "size").select(F.col("all").alias("tree"), F.lit(0).alias("level"), "idx", "size", F.col("subroot").alias("digest"), "own", "subroot")
    over = _rise(heads, arity, levels)
    root = over[-1].select("tree", F.lit(0).cast("long").alias("block"), F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    if len(over) == 1:
        root = stored(root)  # a frame of its own beside the one it would come from
    tops = stored(_linked(over, root, ["own", "subroot"], ["root"], arity, levels))
    discard(rows.sparkSession, *over[1:])
    tops = tops.select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
    out = _linked(rounds, tops, [P + f"k{k}" for k in range(len(keep))] + [P + "leaf"], ["subroot", "root"], arity, levels)
    return out.select(*(F.col(P + f"k{k}").alias(c) for k, c in enumerate(keep)), F.col(P + "leaf").alias(leaf), F.col("idx").alias("position"), "subroot", "root", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda acc, s: digest(s["before"], acc, s["after"]))


def siblings(path: Column) -> Column:
    """A path's digests, joined."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


#: `op13_merkle` in DuckDB's SQL, which has no CRC-32: its table is computed from the polynomial.
ORACLE = """
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) AS r(i))
), docs AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS tree, n_chars,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0, FALSE) AS hit
  FROM documents, crc_table
), leaves AS (
  SELECT *, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(CAST(CAST(n_chars AS HUGEINT) + hit::INT AS VARCHAR)) || ':' || CAST(CAST(n_chars AS HUGEINT) + hit::INT AS VARCHAR), '-') || tail) AS shown
  FROM docs
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, idx, leaf AS h, n FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2, n
), tops AS (
  SELECT tree AS own, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, h, count(*) OVER () AS n FROM nodes WHERE n = 1
), over_nodes AS (
  SELECT 0 AS level, idx, h, n FROM tops
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM over_nodes WHERE n > 1 GROUP BY level, idx // 2, n
), levels AS (SELECT DISTINCT tree, level FROM nodes WHERE n > 1),
over_levels AS (SELECT DISTINCT level FROM over_nodes WHERE n > 1),
low AS (
  SELECT p.tree, p.idx, list(CASE WHEN s.h IS NULL THEN '|' WHEN s.idx < p.idx >> l.level THEN s.h || '|' ELSE '|' || s.h END ORDER BY l.level) AS steps
  FROM placed p JOIN levels l USING (tree) LEFT JOIN nodes s ON s.tree = p.tree AND s.level = l.level AND s.idx = xor(p.idx >> l.level, 1) GROUP BY p.tree, p.idx
), high AS (
  SELECT p.own, list(CASE WHEN s.h IS NULL THEN '|' WHEN s.idx < p.idx >> l.level THEN s.h || '|' ELSE '|' || s.h END ORDER BY l.level) AS steps
  FROM tops p JOIN over_levels l ON TRUE LEFT JOIN over_nodes s ON s.level = l.level AND s.idx = xor(p.idx >> l.level, 1) GROUP BY p.own
), proven AS (
  SELECT p.doc_id, p.leaf, p.shown, t.h AS subroot, (SELECT h FROM over_nodes WHERE n = 1) AS root,
         list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
  FROM placed p JOIN tops t ON t.own = p.tree LEFT JOIN low ON low.tree = p.tree AND low.idx = p.idx LEFT JOIN high ON high.own = p.tree
), folded AS (
  SELECT *, list_reduce(list_prepend(shown, steps), lambda acc, s: sha256(split_part(s, '|', 1) || acc || split_part(s, '|', 2))) AS folded_root FROM proven
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
