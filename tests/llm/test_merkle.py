import hashlib
import zlib

import pytest

from aktarium.llm import entries, merkle
from pyspark.sql import functions as F


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves, arity):
    """The root and, for each leaf, the (before, after) of each level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for nodes in levels[:-1]:
            start = i // arity * arity
            path.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + arity])))
            i //= arity
        paths.append(path)
    return levels[-1][0], paths


def plain(rows, arity=2):
    """{(group, order, leaf): [(subroot, root, path)]} of rows (group, order, leaf)."""
    groups = {}
    for g, o, leaf in rows:
        groups.setdefault(g, []).append((o is not None, o if o is not None else 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = [tree([r[2] for r in sorted(groups[g])], arity) for g in order]
    root, above = tree([x[0] for x in own], arity)
    out = {}
    for g, (subroot, paths), top in zip(order, own, above, strict=True):
        for (known, o, leaf), path in zip(sorted(groups[g]), paths, strict=True):
            out.setdefault((g, o if known else None, leaf), []).append((subroot, root, path + top))
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.g, r.o, r.leaf), []).append((r.subroot, r.root, [(s.before, s.after) for s in r["path"]]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(("arity", "levels"), [(2, 10), (2, 2), (3, 1), (4, 3)])
def test_manifest_agrees_with_plain_trees(spark, arity, levels):
    sizes = {"a": 37, "b": 1, None: 5, "ä": 16, "Z": 2, "": 3, "big": 70}
    rows = [(g, k * 7 % 101, h(str(g), str(k))) for g, n in sizes.items() for k in range(n)]
    rows += [("a", None, h("x")), ("a", 5, h("tie")), ("a", 5, h("tie")), ("a", 5, h("other"))]
    df = spark.createDataFrame(rows, "g string, o long, leaf string").repartition(5)
    got = merkle.manifest(df, "g", "o", "leaf", keep=["g", "o"], arity=arity, levels=levels)
    assert found(got) == {k: sorted(v) for k, v in plain(rows, arity).items()}
    bad = got.filter(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count()
    changed = got.filter(merkle.fold(F.sha2("leaf", 256), F.col("path")) == F.col("root")).count()
    assert (bad, changed) == (0, 0)


def test_partial_parents_wait_for_their_children():
    leaves = [h(str(k)) for k in range(11)]
    root, _ = tree(leaves, 2)
    partial = merkle.Partial(11, 10, 2)
    done = [partial.arrive(0, k, leaves[k]) for k in (10, 3, 2, 0, 9, 8, 7, 1, 4, 6, 5)]
    assert done[:-1] == [None] * 10 and done[-1] == (4, 0, root) and not partial.waiting
    half = merkle.Partial(11, 10, 2)
    for k in (0, 1, 2, 3, 8):
        half.arrive(0, k, leaves[k])
    assert sorted((level, idx) for level, idx, _ in half.frontier()) == [(0, 8), (2, 0)]


def op13(spark, docs):
    row = lambda n: merkle.digest(*(merkle.encoded(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))))
    return merkle.manifest(docs.withColumn("leaf", row(F.col("n_chars"))), "lang", "doc_id", "leaf", keep=["doc_id", "n_chars"])


def test_op13_agrees_with_plain_trees(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    leaf = lambda r, add=0: h(*map(encoded, (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + add, r.text)))
    want = plain([(r.lang, r.doc_id, leaf(r)) for r in docs])
    got = {r.doc_id: r for r in entries.op13_merkle(spark, tiny).collect()}
    assert len(got) == len(docs) and {True, False} == {r.verified for r in got.values()}
    for r in docs:
        ((subroot, root, path),) = want[r.lang, r.doc_id, leaf(r)]
        folded = leaf(r, int(zlib.crc32(str(r.doc_id).encode()) % 7 == 0))
        for before, after in path:
            folded = h(before, folded, after)
        o = got[r.doc_id]
        assert (o.leaf, o.subroot, o.root) == (leaf(r), subroot, root)
        assert (o.proof_sha256, o.folded_root, o.verified) == (h(*(x + y for x, y in path)), folded, folded == root)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    got = op13(spark, odd_docs).collect()
    assert len(got) == len(rows) and len({r.root for r in got}) == 1
    leaf = lambda r: h(*map(encoded, (r.doc_id, r.source, r.lang, r.n_chars, r.text)))
    want = plain([(r.lang, r.doc_id, leaf(r)) for r in rows])
    assert {x.root for x in got} == {x[1] for v in want.values() for x in v}
    assert op13(spark, no_docs).collect() == []
    one = op13(spark, odd_docs.filter("doc_id = 3")).first()
    assert one.root == one.subroot == one.leaf and one["path"] == []
