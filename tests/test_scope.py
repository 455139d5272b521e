import pytest
from pyspark.sql import functions as F

from aktarium.operators import scope
from aktarium.plans import archive_queries as aq
from aktarium.plans.archive import Archive


@pytest.fixture(scope="module")
def small(spark):
    docs = [
        (1, "department", 9, None), (2, "department", 9, None), (3, "private", 1, None), (4, "private", 2, None), (5, "department", 1, None), (6, "department", 9, 1),
    ]
    d = spark.createDataFrame(docs, "id long, visibility string, owner_id long, parent_id long")
    bridge = spark.createDataFrame([(1, 10), (2, 20), (3, 10), (6, 10), (6, 20)], "document_id long, department_id long")
    return d, bridge


def ids(df):
    return sorted(r.id for r in df.collect())


def test_who_sees_what(small):
    d, bridge = small
    assert ids(scope.visible_to(d, bridge, scope.User(1, departments=(10,)))) == [1, 3, 6]
    assert ids(scope.visible_to(d, bridge, scope.User(2, departments=(10, 20)))) == [1, 2, 4, 6]
    assert ids(scope.visible_to(d, bridge, scope.User(8))) == []
    assert ids(scope.visible_to(d, bridge, scope.User(None))) == []
    assert ids(scope.visible_to(d, bridge, scope.User(7, is_superuser=True))) == [1, 2, 3, 4, 5, 6]


def test_inherited_scope(small, spark):
    d, bridge = small
    children = spark.createDataFrame([(50, 6, None, None), (51, 3, 4, "department")], "id long, parent_id long, owner_id long, visibility string")
    rows, departments = scope.inherit_scope(children, d, bridge)
    assert {(r.id, r.owner_id, r.visibility) for r in rows.collect()} == {(50, 9, "department"), (51, 4, "department")}
    assert sorted(map(tuple, departments.collect())) == [(50, 10), (50, 20), (51, 10)]


def test_stored_results_need_their_whole_basis(spark, small):
    runs = spark.createDataFrame([(1, [1, 2]), (2, [1]), (3, []), (4, [99])], "case_id long, considered array<long>")
    seen = small[0].filter("id = 1")
    assert sorted(r.case_id for r in scope.fully_visible(runs, "considered", seen).collect()) == [2, 3]


@pytest.mark.parametrize("user", [0, 7, 16, 99, 55])
def test_no_query_shows_what_a_user_may_not_see(spark, tiny, monkeypatch, user):
    a = Archive(spark, tiny)
    seen = {r.id for r in scope.visible_to(a.documents, a.document_department, scope.load_user(a.users, a.user_department, user)).collect()}
    plain = {
        r.id for r in a.documents.join(a.document_department, F.col("id") == F.col("document_id"), "left").collect()
        if user == 99 or user < 17 and (r.visibility == "private" and r.owner_id == user or r.visibility == "department" and r.department_id == user % 5)
    }
    assert seen == plain
    visible = lambda a, u=None: scope.visible_to(a.documents, a.document_department, scope.load_user(a.users, a.user_department, user))
    monkeypatch.setattr(aq, "_visible", visible)
    for name, column in {"browse_default": "id", "search_topk": "document_id", "similar_topk": "document_id", "doc_comments": "document_id", "next_follow_ups": "document_id", "shared_reference_matches": "document_id", "graph_case": "document_id", "case_basis_latest": "document_id"}.items():
        assert {r[column] for r in aq.QUERIES[name](spark, tiny).collect()} <= seen, name


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["visible_documents", "browse_filtered_tag", "due_flag", "search_topk", "dashboard_kpis", "case_index", "assignment_suggestions", "chunk_text", "resolve_document_date"])
def test_plans_stay_in_the_jvm_without_cross_products(spark, tiny, name):
    plan = plan_of(aq.QUERIES[name](spark, tiny))
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "MapInArrow"))


def test_filters_and_columns_reach_the_scan(spark, tiny):
    plan = plan_of(aq.QUERIES["visible_documents"](spark, tiny))
    assert "ReadSchema: struct<doc_id:bigint>" in plan
    plan = plan_of(spark.read.parquet(f"{tiny}/documents.parquet").filter("source = 'src1'").select("doc_id"))
    assert "EqualTo(source,src1)" in plan
