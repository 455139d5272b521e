from aktarium.operators import tree


def test_roots_of_deep_chains_beside_cycles(spark):
    docs = spark.createDataFrame([(0, None), *((k, k - 1) for k in range(1, 700)), (1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000)], "id long, parent_id long")
    got = {r.id: (r.root_id, r.depth) for r in tree.root_of(docs).collect()}
    assert got == {k: (0, k) for k in range(700)} | {k: (None, None) for k in range(1000, 1004)}


def test_subtrees_of_any_depth_beside_cycles(spark):
    docs = spark.createDataFrame([(0, None), *((k, k - 1) for k in range(1, 1000)), (2000, 500), (3000, 3001), (3001, 3000)], "id long, parent_id long")
    assert sorted(map(tuple, tree.descendants(docs, 10).collect())) == [(k, k - 10) for k in range(11, 1000)] + [(2000, 491)]
    assert sorted(map(tuple, tree.descendants(docs, 995).collect())) == [(k, k - 995) for k in range(996, 1000)]
    assert [tuple(r) for r in tree.descendants(docs, 3000).collect()] == [(3001, 1)] and tree.descendants(docs, 999).count() == 0
