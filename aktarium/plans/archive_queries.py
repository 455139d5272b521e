"""The registered archive queries: each applies one operator to the whole archive, with its SQL for DuckDB beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as fd
from ..functions import letters as fl
from ..functions import references as fr
from ..functions import text as ft
from ..functions import vectors as fv
from ..operators import aggregates, bindings, checks, chunking, classify, details, filters, graph, ingest, mail, ordering, repairs, retrieval, scope, stale, text_index, tree, vector_index
from ..operators import references as refs
from ..session import scratch
from ..sources import readers
from .archive import DOCUMENT, SUPERUSER, TODAY, USER, Archive, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Register a function of the archive under its own name; `oracle` is its SELECT over the archive tables."""

    def register(f: Callable[[Archive], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Archive(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return register


def _visible(a: Archive, user: int = USER) -> DataFrame:
    return scope.visible_to(a.documents, a.document_department, scope.load_user(a.users, a.user_department, user))


def _links(a: Archive) -> DataFrame:
    return refs.canonical_links(a.raw_links)


def _first_vector(a: Archive) -> list[float]:
    found = a.chunks.filter("id = 0").select("embedding").first()
    return found[0] if found else [0.0]


# Scope


@query("SELECT id, visibility, owner_id FROM vis")
def visible_documents(a: Archive) -> DataFrame:
    return _visible(a).select("id", "visibility", "owner_id")


@query("SELECT id FROM doc")
def visible_superuser(a: Archive) -> DataFrame:
    return _visible(a, SUPERUSER).select("id")


@query("SELECT id FROM vis WHERE parent_id IS NULL")
def visible_roots(a: Archive) -> DataFrame:
    return scope.roots(_visible(a)).select("id")


@query("""SELECT id, title FROM tsk t WHERE (visibility = 'private' AND owner_id = 3)
  OR (visibility = 'department' AND id % 5 IN (SELECT department_id FROM udep WHERE user_id = 3))""")
def visible_tasks(a: Archive) -> DataFrame:
    user = scope.load_user(a.users, a.user_department, USER)
    return scope.visible_to(a.tasks, a.task_department, user, bridge_id="task_id").select("id", "title")


@query("SELECT id FROM vis WHERE parent_id = 42")
def visible_children(a: Archive) -> DataFrame:
    return scope.children_of(_visible(a), 42).select("id")


@query("SELECT id FROM vis WHERE processing_status IN ('ready', 'reviewed')")
def processing_complete(a: Archive) -> DataFrame:
    return scope.processing_complete(_visible(a)).select("id")


@query("SELECT id FROM vis WHERE action_status <> 'erledigt'")
def open_documents(a: Archive) -> DataFrame:
    return scope.open_actions(_visible(a)).select("id")


@query("SELECT case_id, len(considered) AS n FROM run WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(considered) AS d) WHERE d NOT IN (SELECT id FROM vis))")
def result_visibility(a: Archive) -> DataFrame:
    return scope.fully_visible(a.case_runs, "considered", _visible(a)).select("case_id", F.size("considered").cast("long").alias("n"))


@query("SELECT owner_id, type, value_normalized FROM cref WHERE learned_from IS NULL OR learned_from IN (SELECT id FROM vis)")
def learned_visibility(a: Archive) -> DataFrame:
    return scope.visible_learned(a.case_references, _visible(a)).select("owner_id", "type", "value_normalized")


@query("""SELECT c.id, CASE WHEN c.id % 2 = 0 THEN 7 ELSE p.owner_id END AS owner_id, p.visibility FROM doc c LEFT JOIN doc p ON p.id = c.parent_id WHERE c.parent_id IS NOT NULL""")
def inherited_scope(a: Archive) -> DataFrame:
    own = F.when(F.col("id") % 2 == 0, F.lit(7).cast("long"))
    children = a.documents.filter("parent_id IS NOT NULL").select("id", "parent_id", own.alias("owner_id"), F.lit(None).cast("string").alias("visibility"))
    return scope.inherit_scope(children, a.documents, a.document_department)[0].select("id", "owner_id", "visibility")


# Lists


@query("""SELECT id, coalesce(document_date, CAST(created_at AS DATE)) AS display_date FROM vis WHERE parent_id IS NULL
  ORDER BY display_date DESC, created_at DESC, id LIMIT 20""")
def browse_default(a: Archive) -> DataFrame:
    rows = scope.roots(_visible(a)).withColumn("display_date", ordering.display_date())
    return ordering.page(rows, ordering.list_order(), 1).select("id", "display_date")


@query("""SELECT id FROM vis WHERE parent_id IS NULL AND processing_status = 'ready' ORDER BY created_at, id LIMIT 20
  OFFSET (SELECT CASE WHEN count(*) > 20 THEN 20 ELSE 0 END FROM vis WHERE parent_id IS NULL AND processing_status = 'ready')""")
def browse_review_queue(a: Archive) -> DataFrame:
    rows = filters.filter_documents(scope.roots(_visible(a)), status="ready")
    return ordering.page(rows, ordering.list_order("ready"), 2).select("id")


@query("""SELECT id FROM vis WHERE tax_relevance IN ('ja', 'vielleicht') AND direction = 'intern' AND id IN (SELECT document_id FROM dtag WHERE name IN ('de', 'fr'))
  AND id IN (SELECT document_id FROM dcas WHERE case_id BETWEEN 0 AND 22) AND CAST(created_at AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-02-05'""")
def browse_filtered_tag(a: Archive) -> DataFrame:
    return filters.filter_documents(_visible(a), tax="absetzbar", direction="intern", tags=(a.document_tag, ["de", "fr"]), created_from="2024-01-03", created_to="2024-02-05").select("id")


@query("SELECT id FROM vis WHERE sphere = 'privat' AND id IN (SELECT document_id FROM dcas WHERE case_id = 4)")
def browse_filtered_case(a: Archive) -> DataFrame:
    return filters.filter_documents(_visible(a), sphere="privat", case=(a.document_case, 4)).select("id")


@query("SELECT id FROM vis WHERE correspondent = 'src3' AND sphere = 'privat'")
def browse_filtered_contact(a: Archive) -> DataFrame:
    return filters.filter_documents(_visible(a), correspondent="src3", sphere="privat").select("id")


@query("SELECT id FROM vis WHERE EXISTS (SELECT 1 FROM com WHERE document_id = vis.id AND follow_up_date <= DATE '2024-06-12')")
def browse_due(a: Archive) -> DataFrame:
    return filters.with_due_follow_up(_visible(a), a.comments, TODAY).select("id")


@query("SELECT id, EXISTS (SELECT 1 FROM com WHERE document_id = vis.id AND follow_up_date <= DATE '2024-06-12') AS is_due FROM vis")
def due_flag(a: Archive) -> DataFrame:
    return filters.due_flag(_visible(a), a.comments, TODAY).select("id", "is_due")


@query("SELECT id FROM doc WHERE json_extract_string(metadata, '$.message_id') = '<18@mail>'")
def message_lookup(a: Archive) -> DataFrame:
    return filters.message_documents(a.documents, "<18@mail>").select("id")


@query("SELECT id FROM doc WHERE text_content <> '' AND json_extract_string(metadata, '$.analysis_error') IS NOT NULL AND CAST(created_at AS DATE) >= DATE '2024-01-10'")
def to_reanalyse(a: Archive) -> DataFrame:
    return filters.to_reanalyse(a.documents.withColumn("summary", F.lit("s")), "failed", since="2024-01-10").select("id")


@query("SELECT id FROM doc WHERE text_content <> ''")
def to_reindex(a: Archive) -> DataFrame:
    return filters.to_reindex(a.documents).select("id")


@query("SELECT id, title FROM vis WHERE contains(lower(title), 'ment 1') OR contains(lower(correspondent), 'src19')")
def admin_search(a: Archive) -> DataFrame:
    return filters.search_text(_visible(a), ["title", "correspondent"], "MENT 1").unionByName(filters.search_text(_visible(a), ["correspondent"], "SRC19")).select("id", "title").distinct()


@query("SELECT id, title FROM vis WHERE contains(lower(title), 'ment 1') OR contains(lower(text_content), ', th')")
def search_by_trigrams(a: Archive) -> DataFrame:
    """Titles by the postings of titles, texts by those of texts."""
    found = a.spark.createDataFrame([], "id long, title string")
    for column, term in (("title", "MENT 1"), ("text_content", ", TH")):
        index = text_index.TextIndex(a.spark, scratch(a.spark), [column])
        index.extend(a.documents)
        found = found.unionByName(index.search(_visible(a), term).select("id", "title"))
    return found.distinct()


@query("SELECT document_id, id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS BIGINT) AS place FROM com WHERE document_id IN (SELECT id FROM vis)")
def doc_comments(a: Archive) -> DataFrame:
    seen = a.comments.join(_visible(a).select(F.col("id").alias("document_id")), "document_id", "left_semi")
    from pyspark.sql import Window

    return seen.select("document_id", "id", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("id"))).cast("long").alias("place"))


@query("SELECT document_id, count(*) AS n_pending FROM (SELECT document_id, status FROM tsug UNION ALL SELECT document_id, status FROM csug) WHERE status = 'pending' GROUP BY document_id")
def suggestion_counts(a: Archive) -> DataFrame:
    return aggregates.open_suggestions(a.tag_suggestions, a.case_suggestions)


# Vectors

_SCORED = """s AS (SELECT c.id, c.document_id, c.content, 1 - list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS d
  FROM chk c WHERE c.document_id IN (SELECT id FROM {docs})), b AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY d, id) AS p FROM s)"""


@query(f"SELECT * FROM (WITH {_SCORED.format(docs='vis')} SELECT document_id, id AS chunk_id, content AS snippet, round(1 - d, 6) AS score FROM b WHERE p = 1 ORDER BY d, document_id LIMIT 20)")
def search_topk(a: Archive) -> DataFrame:
    found = retrieval.search(a.chunks, _visible(a), _first_vector(a), limit=20)
    return found.withColumn("score", F.round("score", 6))


@query(f"SELECT * FROM (WITH f AS (SELECT id FROM vis WHERE tax_relevance IN ('ja', 'vielleicht')), {_SCORED.format(docs='f')} SELECT document_id, id AS chunk_id, round(1 - d, 6) AS score FROM b WHERE p = 1 ORDER BY d, document_id LIMIT 50)")
def search_filtered(a: Archive) -> DataFrame:
    found = retrieval.search(a.chunks, filters.filter_documents(_visible(a), tax="absetzbar"), _first_vector(a), limit=50)
    return found.select("document_id", "chunk_id", F.round("score", 6).alias("score"))


def _index(a: Archive) -> vector_index.VectorIndex:
    return vector_index.VectorIndex.build(a.chunks, scratch(a.spark), rows_per_cell=256)


@query(f"SELECT * FROM (WITH {_SCORED.format(docs='vis')} SELECT document_id, id AS chunk_id, content AS snippet, round(1 - d, 6) AS score FROM b WHERE p = 1 ORDER BY d, document_id LIMIT 20)")
def search_indexed(a: Archive) -> DataFrame:
    found = vector_index.search_indexed(_index(a), _visible(a), _first_vector(a), limit=20)
    return found.withColumn("score", F.round("score", 6))


_SIMILAR = """
  own AS (SELECT * FROM chk WHERE document_id = 43),
  m AS (SELECT list(x ORDER BY i) AS mean FROM (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM own, range(1, 65) r(i) GROUP BY i)),
  kin AS (SELECT 43 AS id UNION SELECT parent_id FROM doc WHERE id = 43 UNION SELECT id FROM doc WHERE parent_id = 43
    UNION SELECT id FROM doc WHERE parent_id IN (SELECT id FROM doc WHERE parent_id = 43)),
  s AS (SELECT c.id, c.document_id, 1 - list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), (SELECT mean FROM m)) AS d FROM chk c
    WHERE c.document_id IN (SELECT id FROM vis) AND c.document_id NOT IN (SELECT id FROM kin WHERE id IS NOT NULL)
      AND (c.embedding_model, c.embedding_model_version) IN (SELECT (embedding_model, embedding_model_version) FROM own)),
  near AS (SELECT * FROM s WHERE d <= 1 - 0.1 ORDER BY d, id LIMIT 200),
  b AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY d, id) AS p FROM near)"""


@query(f"SELECT * FROM (WITH {_SIMILAR} SELECT document_id, id AS chunk_id, round(1 - d, 6) AS score FROM b WHERE p = 1 ORDER BY d, document_id LIMIT 20)")
def similar_topk(a: Archive) -> DataFrame:
    found = retrieval.similar_documents(a.chunks, a.documents, _visible(a), DOCUMENT, limit=20, min_score=0.1)
    return found.withColumn("score", F.round("score", 6))


@query(f"SELECT * FROM (WITH {_SIMILAR} SELECT document_id, id AS chunk_id, round(1 - d, 6) AS score FROM b WHERE p = 1 ORDER BY d, document_id LIMIT 20)")
def similar_indexed(a: Archive) -> DataFrame:
    found = vector_index.similar_indexed(_index(a), a.documents, _visible(a), DOCUMENT, limit=20, min_score=0.1)
    return found.withColumn("score", F.round("score", 6))


@query("SELECT document_id, CAST(i AS BIGINT) AS at, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS x FROM chk, range(1, 65) r(i) GROUP BY document_id, i")
def doc_mean_vector(a: Archive) -> DataFrame:
    means = fv.mean_vectors(a.chunks, "document_id")
    rows = means.select("document_id", F.posexplode("mean").alias("p", "x"))
    return rows.select("document_id", (F.col("p") + 1).cast("long").alias("at"), F.round("x", 6).alias("x"))


@query("""SELECT c.id, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), m.mean), 6) AS score FROM chk c JOIN (SELECT document_id, list(x ORDER BY i) AS mean FROM
  (SELECT document_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM chk, range(1, 65) r(i) GROUP BY document_id, i) GROUP BY document_id) m USING (document_id)""")
def chunk_to_document_similarity(a: Archive) -> DataFrame:
    pairs = a.chunks.join(fv.mean_vectors(a.chunks, "document_id"), "document_id")
    return pairs.select("id", F.round(fv.score(fv.cosine_distance(F.col("embedding"), F.col("mean"))), 6).alias("score"))


@query("SELECT id, length(text_content) % 7 + 1 AS x FROM doc")
def fake_embed(a: Archive) -> DataFrame:
    return a.documents.select("id", F.get(ft.fake_embedding(F.col("text_content")), F.lit(3)).cast("long").alias("x"))


# Aggregates


@query("""SELECT count(*) AS n_documents, count(*) FILTER (processing_status = 'ready') AS n_ready, count(*) FILTER (processing_status = 'failed') AS n_failed,
  count(*) FILTER (processing_status IN ('pending', 'extracting', 'analyzing', 'embedding')) AS n_in_progress, count(*) FILTER (action_status = 'offen') AS n_open,
  count(*) FILTER (action_status = 'erledigt') AS n_done, count(*) FILTER (action_status = 'keine') AS n_no_action,
  CAST(sum(CAST(json_extract_string(metadata, '$.size') AS BIGINT)) AS BIGINT) AS total_size FROM vis""")
def dashboard_kpis(a: Archive) -> DataFrame:
    return aggregates.dashboard(_visible(a))


@query("""SELECT c.id, c.document_id, c.follow_up_date FROM com c WHERE follow_up_date IS NOT NULL AND document_id IN (SELECT id FROM vis WHERE action_status <> 'erledigt')
  ORDER BY follow_up_date, created_at, id LIMIT 6""")
def next_follow_ups(a: Archive) -> DataFrame:
    return aggregates.next_follow_ups(_visible(a), a.comments).select("id", "document_id", "follow_up_date")


@query("SELECT id FROM vis WHERE parent_id IS NULL AND processing_status = 'ready' ORDER BY created_at, id LIMIT 6")
def next_reviews(a: Archive) -> DataFrame:
    return ordering.top(scope.needs_review(scope.roots(_visible(a))), ordering.review_order(), 6).select("id")


_CASES = """SELECT cas.id, cas.name, coalesce(b.n, 0) AS n_documents, b.l AS last_activity FROM cas LEFT JOIN (SELECT case_id, count(DISTINCT document_id) AS n, max(created_at) AS l
  FROM dcas JOIN vis ON vis.id = dcas.document_id GROUP BY case_id) b ON b.case_id = cas.id"""


@query(_CASES)
def case_index(a: Archive) -> DataFrame:
    return aggregates.case_index(a.cases, a.document_case, _visible(a)).select("id", "name", "n_documents", "last_activity")


@query(f"SELECT id, CAST(row_number() OVER (ORDER BY last_activity DESC NULLS FIRST, name) AS BIGINT) AS place FROM ({_CASES}) ORDER BY place LIMIT 10")
def case_index_by_activity(a: Archive) -> DataFrame:
    index = aggregates.case_index(a.cases, a.document_case, _visible(a))
    return ordering.top(index, ordering.index_order("activity"), 10, rank="place").select("id", "place")


@query("""SELECT con.name, coalesce(n_documents, 0) AS n_documents, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, last_activity FROM con LEFT JOIN
  (SELECT correspondent AS name, count(*) AS n_documents, count(*) FILTER (direction = 'eingang') AS n_in, count(*) FILTER (direction = 'ausgang') AS n_out, max(created_at) AS last_activity FROM vis GROUP BY 1) USING (name)""")
def contact_index(a: Archive) -> DataFrame:
    return aggregates.contact_index(a.contacts, _visible(a))


_TAGS = """SELECT t.name, t.dimension, count(vis.id) AS n_documents FROM (SELECT DISTINCT name, dimension FROM dtag) t
  JOIN dtag d USING (name, dimension) LEFT JOIN vis ON vis.id = d.document_id GROUP BY t.name, t.dimension"""


@query(_TAGS)
def tag_index(a: Archive) -> DataFrame:
    return aggregates.tag_index(a.tags, a.document_tag, _visible(a))


@query(f"SELECT dimension, count(*) AS n_tags, min(name) AS first, CAST(sum(n_documents) AS BIGINT) AS n_tagged FROM ({_TAGS}) GROUP BY dimension")
def tag_dimensions(a: Archive) -> DataFrame:
    return aggregates.tags_by_dimension(aggregates.tag_index(a.tags, a.document_tag, _visible(a)))


@query("""SELECT d.name, d.n_documents, d.n_in, d.n_out, coalesce(t.n, 0) AS n_open_tasks FROM
  (SELECT correspondent AS name, count(*) AS n_documents, count(*) FILTER (direction = 'eingang') AS n_in, count(*) FILTER (direction = 'ausgang') AS n_out FROM vis GROUP BY 1) d
  LEFT JOIN (SELECT v.correspondent AS name, count(DISTINCT k.id) AS n FROM vis v JOIN tsk k ON k.id % 200 = v.id WHERE k.status = 'offen' GROUP BY 1) t USING (name)""")
def contact_numbers(a: Archive) -> DataFrame:
    return aggregates.contact_numbers(_visible(a), a.task_document, a.tasks)


@query("""SELECT (SELECT count(*) FROM vis WHERE action_status = 'offen') AS n_open, (SELECT count(*) FROM vis WHERE processing_status = 'ready') AS n_review,
  (SELECT count(*) FROM com WHERE follow_up_date <= DATE '2024-06-12' AND document_id IN (SELECT id FROM vis WHERE action_status <> 'erledigt')) AS n_due""")
def nav_badges(a: Archive) -> DataFrame:
    return aggregates.badges(_visible(a), a.comments, TODAY)


@query(f"SELECT name, n_documents FROM ({_CASES}) WHERE contains(lower(name), 'gang 1') AND n_documents > 0")
def facet_search(a: Archive) -> DataFrame:
    return aggregates.facet(aggregates.case_index(a.cases, a.document_case, _visible(a)), "GANG 1").select("name", "n_documents")


@query("SELECT name FROM (SELECT * FROM con ORDER BY name LIMIT 200) ORDER BY NOT starts_with(lower(name), 'src1'), name LIMIT 10")
def prefix_search(a: Archive) -> DataFrame:
    return ordering.prefix_first(a.contacts, "name", "SRC1", [F.col("name").asc()]).select("name")


@query("SELECT case_id, max(document_id % 50) + 1 AS next_order FROM dcas GROUP BY case_id")
def next_order(a: Archive) -> DataFrame:
    return aggregates.next_order(a.document_case.withColumn("order", F.col("document_id") % 50), "case_id")


@query("""SELECT document_id, CASE max(CASE method WHEN 'vision' THEN 2 WHEN 'ocr' THEN 1 ELSE 0 END) WHEN 2 THEN 'vision' WHEN 1 THEN 'ocr' ELSE 'text_layer' END AS method
  FROM (SELECT id % 40 AS document_id, ['text_layer', 'ocr', 'vision'][id // 40 % (id % 3 + 1) + 1] AS method FROM doc) GROUP BY document_id""")
def extraction_method(a: Archive) -> DataFrame:
    i = F.col("id")
    nth = (F.floor(i / 40) % (i % 3 + 1)).cast("int") + 1
    methods = a.documents.select((i % 40).alias("document_id"), F.element_at(F.array(F.lit("text_layer"), F.lit("ocr"), F.lit("vision")), nth).alias("method"))
    return aggregates.extraction_method(methods)


@query("SELECT user_id, round(coalesce(avg(value - 20) FILTER (value - 20 >= 0), 0), 6) AS confidence FROM events GROUP BY user_id")
def mean_confidence(a: Archive) -> DataFrame:
    words = a._table("events").select("user_id", (F.col("value") - 20).alias("confidence"))
    return aggregates.mean_confidence(words, "user_id").withColumn("confidence", F.round("confidence", 6))


@query("SELECT conv_id, CAST(sum(turn) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(CASE WHEN turn > 1 THEN length(text) END, 0)) AS BIGINT) AS completion_tokens, CAST(0 AS BIGINT) AS image_tokens FROM conversations GROUP BY conv_id")
def usage_totals(a: Archive) -> DataFrame:
    calls = a._table("conversations").select("conv_id", F.col("turn").alias("prompt_tokens"), F.when(F.col("turn") > 1, F.length("text").cast("long")).alias("completion_tokens"), F.lit(None).cast("long").alias("image_tokens"))
    return aggregates.usage_totals(calls, "conv_id")


# Follow-ups and tasks


@query("""SELECT id, CASE WHEN follow_up_date < DATE '2024-06-12' THEN 'overdue' WHEN follow_up_date = DATE '2024-06-12' THEN 'today'
  WHEN follow_up_date <= DATE '2024-06-16' THEN 'this_week' ELSE 'later' END AS bucket FROM com WHERE follow_up_date IS NOT NULL""")
def followup_buckets(a: Archive) -> DataFrame:
    return a.comments.filter("follow_up_date IS NOT NULL").select("id", fd.follow_up_bucket(F.col("follow_up_date"), TODAY).alias("bucket"))


@query("""SELECT id, 'this_week' AS w FROM com WHERE follow_up_date BETWEEN DATE '2024-06-13' AND DATE '2024-06-16'
  UNION ALL SELECT id, 'later' FROM com WHERE follow_up_date > DATE '2024-06-16' UNION ALL SELECT id, 'pending' FROM com WHERE follow_up_date <= DATE '2024-06-12' AND remind AND reminded_at IS NULL
  UNION ALL SELECT id, 'overdue' FROM com WHERE follow_up_date < DATE '2024-06-12' UNION ALL SELECT id, 'today' FROM com WHERE follow_up_date = DATE '2024-06-12'""")
def followup_windows(a: Archive) -> DataFrame:
    out = None
    for w in ("this_week", "later", "pending", "overdue", "today"):
        part = filters.follow_ups(a.comments, w, TODAY).select("id", F.lit(w).alias("w"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT id, due_date FROM tsk WHERE due_date < DATE '2024-06-12' AND status = 'offen'")
def tasks_overdue(a: Archive) -> DataFrame:
    return filters.due_tasks(a.tasks, "overdue", TODAY).select("id", "due_date")


@query("SELECT id, due_date FROM tsk WHERE due_date BETWEEN DATE '2024-06-12' AND DATE '2024-06-19'")
def tasks_week(a: Archive) -> DataFrame:
    return filters.due_tasks(a.tasks, "week", TODAY).select("id", "due_date")


@query("SELECT id, CAST(row_number() OVER (ORDER BY due_date ASC NULLS LAST, created_at DESC, id) AS BIGINT) AS place FROM tsk WHERE status = 'offen' ORDER BY place LIMIT 40")
def tasks_ordered(a: Archive) -> DataFrame:
    return ordering.top(a.tasks.filter("status = 'offen'"), ordering.task_order(), 40, rank="place").select("id", "place")


@query("""SELECT author_id, count(*) AS n, min(follow_up_date) AS first FROM com WHERE follow_up_date <= DATE '2024-06-12' AND remind AND reminded_at IS NULL AND author_id % 4 <> 0 GROUP BY author_id""")
def reminders_by_author(a: Archive) -> DataFrame:
    users = a.users.select("id", F.when(F.col("id") % 4 == 0, "").otherwise("x@example.org").alias("email"))
    mails = aggregates.reminders(a.comments, users, TODAY)
    return mails.select("author_id", F.size("items").cast("long").alias("n"), F.get("items", F.lit(0))["follow_up_date"].alias("first"))


@query("""SELECT title, CASE WHEN lang <> 'de' THEN DATE '2024-06-12' + CAST(length(text_content) % 60 AS INTEGER) END AS due_date, visibility, CAST(3 AS BIGINT) AS owner_id FROM doc""")
def template_tasks(a: Archive) -> DataFrame:
    """Documents as templates of tasks: their title, days that follow from the text's length, undated in one language."""
    offset = F.when(F.col("lang") != "de", F.length("text_content") % 60)
    templates = a.documents.select(F.col("title").alias("default_title"), offset.alias("default_due_offset_days"), "visibility")
    return bindings.task_from_template(templates, TODAY, USER).select("title", "due_date", "visibility", "owner_id")


# References


@query("SELECT id, value_normalized FROM ref")
def reference_normalize(a: Archive) -> DataFrame:
    return a.references.select("id", fr.normalize_reference(F.col("value_raw")).alias("value_normalized"))


@query("""SELECT reference_id, document_id, n_total, n_total > 20 AS truncated FROM (SELECT own.id AS reference_id, o.document_id,
  row_number() OVER (PARTITION BY own.id ORDER BY coalesce(v.document_date, CAST(v.created_at AS DATE)) DESC, v.created_at DESC, v.id) AS p, count(*) OVER (PARTITION BY own.id) AS n_total
  FROM ref own JOIN ref o ON o.type = own.type AND o.value_normalized = own.value_normalized AND o.document_id <> 43 JOIN vis v ON v.id = o.document_id WHERE own.document_id = 43) WHERE p <= 20""")
def shared_reference_groups(a: Archive) -> DataFrame:
    return refs.shared_groups(a.references, _visible(a), DOCUMENT).select("reference_id", "document_id", "n_total", "truncated")


@query("""SELECT document_id, type, value_normalized FROM ref WHERE document_id <> 43 AND (type, value_normalized) IN (SELECT (type, value_normalized) FROM ref WHERE document_id = 43) AND document_id IN (SELECT id FROM vis)""")
def shared_reference_matches(a: Archive) -> DataFrame:
    return refs.shared_matches(a.references, _visible(a), DOCUMENT)


@query("SELECT id FROM vis WHERE id IN (SELECT document_id FROM ref WHERE type = 'rechnungsnummer' AND value_normalized = '7/24')")
def documents_with_reference(a: Archive) -> DataFrame:
    return refs.holding(a.references, _visible(a), "rechnungsnummer", "7/24").select("id")


@query("SELECT type, value_normalized, document_id, n_documents FROM (SELECT *, count(*) OVER (PARTITION BY type, value_normalized) AS n_documents FROM ref) WHERE n_documents > 1")
def shared_reference_keys(a: Archive) -> DataFrame:
    return refs.shared_keys(a.references)


_ASSIGNED = "(SELECT document_id, case_id AS owner_id FROM dcas WHERE document_id % 3 = 0)"


def _suggested(a: Archive) -> DataFrame:
    assigned = a.document_case.filter("document_id % 3 = 0").select("document_id", F.col("case_id").alias("owner_id"))
    owners = scope.visible_learned(a.case_references, _visible(a))
    return refs.suggestions(a.references, owners, assigned, "vorgang")


_SUGGESTED = f"""SELECT document_id, owner_id, type, strong FROM (SELECT r.document_id, o.owner_id, r.type, r.type IN ('aktenzeichen', 'iban') AS strong,
  row_number() OVER (PARTITION BY r.document_id, o.owner_id ORDER BY r.type, r.value_normalized, r.id) AS p FROM ref r
  JOIN (SELECT DISTINCT owner_id, type, value_normalized FROM cref WHERE learned_from IS NULL OR learned_from IN (SELECT id FROM vis)) o USING (type, value_normalized)
  WHERE r.type IN ('aktenzeichen', 'forderungsnummer', 'vertragsnummer', 'belegnummer', 'rechnungsnummer') AND (r.document_id, o.owner_id) NOT IN {_ASSIGNED}) WHERE p = 1"""


@query(_SUGGESTED)
def assignment_suggestions(a: Archive) -> DataFrame:
    return _suggested(a).select("document_id", "owner_id", "type", "strong")


@query(f"SELECT document_id, min(owner_id) AS owner_id FROM ({_SUGGESTED}) WHERE strong GROUP BY document_id HAVING count(DISTINCT owner_id) = 1")
def auto_assign(a: Archive) -> DataFrame:
    return refs.auto_assign(_suggested(a))


@query("""SELECT owner_id, type, value_normalized, source, learned_from FROM cref UNION ALL
  SELECT c.case_id, r.type, r.value_normalized, 'gelernt', min(r.document_id) FROM ref r JOIN dcas c USING (document_id)
  WHERE r.type IN ('aktenzeichen', 'rechnungsnummer') AND (c.case_id, r.type, r.value_normalized) NOT IN (SELECT (owner_id, type, value_normalized) FROM cref) GROUP BY ALL""")
def learn_references(a: Archive) -> DataFrame:
    targets = a.document_case.select("document_id", F.col("case_id").alias("owner_id"))
    return refs.learn(a.case_references, a.references, targets, "vorgang")


@query("""SELECT document_id AS owner_id, type, value_normalized, CASE WHEN source = 'manuell' OR id % 4 = 0 THEN 'manuell' ELSE 'gelernt' END AS source FROM ref
  UNION ALL SELECT id, 'vertragsnummer', 'V' || length(text_content), 'manuell' FROM doc WHERE parent_id IS NOT NULL""")
def record_references(a: Archive) -> DataFrame:
    """References that documents have, as owners' own: some are entered again by hand, others are new."""
    learned = F.col("source") != "manuell"
    held = a.references.select(F.col("document_id").alias("owner_id"), "type", "value_normalized", F.when(learned, "gelernt").otherwise("manuell").alias("source"), F.when(learned, F.col("id")).alias("learned_from"))
    again = held.filter("owner_id % 4 = 0").select("owner_id", "type", "value_normalized")
    number = F.concat(F.lit("V"), F.length("text_content").cast("string"))
    added = a.documents.filter("parent_id IS NOT NULL").select(F.col("id").alias("owner_id"), F.lit("vertragsnummer").alias("type"), number.alias("value_normalized"))
    return refs.record_by_hand(held, again.unionByName(added)).select("owner_id", "type", "value_normalized", "source")


@query("""SELECT document_id, type, value_normalized, source FROM ref WHERE source = 'manuell' UNION ALL
  SELECT id, 'iban', (id % 37) || '/24', 'ki' FROM doc WHERE NOT (id % 8 = 0 AND id % 5 = 2)""")
def replace_references(a: Archive) -> DataFrame:
    i = F.col("id")
    found = a.documents.select(i.alias("document_id"), F.lit("iban").alias("type"), F.concat((i % 37).cast("string"), F.lit("/24")).alias("value_normalized"), F.explode(F.array(F.lit(1), F.lit(2))).alias("position"))
    return refs.replace_machine_references(a.references, found)


# Graph, links, tree


@query("SELECT DISTINCT least(x, y) AS document_a, greatest(x, y) AS document_b FROM lnk WHERE x <> y")
def canonical_links(a: Archive) -> DataFrame:
    return _links(a)


_FOCUS = 38


@query("""SELECT * FROM (WITH me AS (SELECT * FROM vis WHERE id = 38), other AS (SELECT v.* FROM vis v WHERE v.id IN (SELECT CASE WHEN least(x, y) = 38 THEN greatest(x, y) ELSE least(x, y) END FROM lnk WHERE x = 38 OR y = 38)),
  sh AS (SELECT r.document_id, r.type, r.value_normalized, v.* FROM ref r JOIN vis v ON v.id = r.document_id WHERE r.document_id <> 38 AND (r.type, r.value_normalized) IN (SELECT (type, value_normalized) FROM ref WHERE document_id = 38)),
  shared AS (SELECT * FROM sh WHERE document_id NOT IN (SELECT id FROM other) ORDER BY coalesce(document_date, CAST(created_at AS DATE)) DESC, created_at DESC, id LIMIT 25)
  SELECT 'contact' AS kind, 'contact:' || correspondent AS node, correspondent AS label FROM me
  UNION ALL SELECT 'case', 'case:' || case_id, CAST(case_id AS VARCHAR) FROM (SELECT DISTINCT case_id FROM dcas WHERE document_id = 38)
  UNION ALL SELECT 'tag', 'tag:' || dimension || '/' || name, name FROM dtag WHERE document_id = 38
  UNION ALL SELECT 'link', 'document:' || id, title FROM other
  UNION ALL SELECT 'reference', 'document:' || document_id, type || ' ' || value_normalized FROM shared)""")
def graph_document(a: Archive) -> DataFrame:
    visible = _visible(a)
    none = a.spark.createDataFrame([], "document_id long, score double")
    edges = graph.document_neighbourhood(_FOCUS, visible, a.document_case, a.document_tag, _links(a), a.references, none)
    return edges.select("kind", "node", "label")


@query("""SELECT 'case:4' AS node, id AS document_id, CAST(row_number() OVER (ORDER BY coalesce(document_date, CAST(created_at AS DATE)) DESC, created_at DESC, id) AS BIGINT) AS place, count(*) OVER () > 25 AS truncated
  FROM vis WHERE id IN (SELECT document_id FROM dcas WHERE case_id = 4) ORDER BY place LIMIT 25""")
def graph_case(a: Archive) -> DataFrame:
    return graph.documents_of("case:4", a.document_case.filter("case_id = 4"), _visible(a))


@query("""SELECT 'case' AS kind, CAST(id AS VARCHAR) AS key, name FROM (SELECT * FROM cas WHERE contains(lower(name), '1') ORDER BY name, CAST(id AS VARCHAR) LIMIT 6)
  UNION ALL SELECT 'contact', name, name FROM (SELECT * FROM con WHERE contains(lower(name), '1') ORDER BY name LIMIT 6)""")
def graph_search(a: Archive) -> DataFrame:
    return graph.search_nodes({"case": a.cases.select(F.col("id").alias("key"), "name"), "contact": a.contacts.select(F.col("name").alias("key"), "name")}, "1")


@query("""SELECT n AS node, payload, CAST(row_number() OVER (ORDER BY part, pos) AS BIGINT) AS position FROM (SELECT n, arg_max(payload, part) AS payload, min(part) AS part, arg_min(pos, part) AS pos FROM
  (SELECT 'c' || id AS n, 'first' AS payload, 0 AS part, id AS pos FROM cas WHERE id < 12 UNION ALL SELECT 'c' || id, 'second', 1, id FROM cas WHERE id > 7) GROUP BY n)""")
def graph_merge(a: Archive) -> DataFrame:
    i = F.col("id")
    part = lambda where, payload: a.cases.filter(where).select(F.concat(F.lit("c"), i.cast("string")).alias("node"), F.lit(payload).alias("payload"), i.alias("position"))
    return graph.merge_nodes(part("id < 12", "first"), part("id > 7", "second"))


@query("""SELECT id, level FROM (WITH RECURSIVE t AS (SELECT id, CAST(1 AS BIGINT) AS level FROM doc WHERE parent_id = 14 UNION ALL SELECT d.id, t.level + 1 FROM doc d JOIN t ON d.parent_id = t.id) SELECT * FROM t)""")
def subtree(a: Archive) -> DataFrame:
    return tree.descendants(a.documents, 14)


@query("""SELECT * FROM (WITH RECURSIVE t AS (SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth FROM doc WHERE parent_id IS NULL UNION ALL SELECT d.id, t.root_id, t.depth + 1 FROM doc d JOIN t ON d.parent_id = t.id) SELECT * FROM t)""")
def root_of(a: Archive) -> DataFrame:
    return tree.root_of(a.documents)


# Text


@query("""SELECT id AS document_id, CAST(p AS INTEGER) AS position, array_to_string(w[p * 450 + 1 : p * 450 + 500], ' ') AS content FROM
  (SELECT id, list_filter(regexp_split_to_array(text_content, '[\\s\\p{Z}]+'), lambda x: x <> '') AS w FROM doc), LATERAL (SELECT unnest(range(0, greatest(0, CAST(ceil((len(w) - 500) / 450.0) AS BIGINT)) + 1)) AS p) WHERE len(w) > 0""")
def chunk_text(a: Archive) -> DataFrame:
    return chunking.chunk_text(a.documents)


# The test documents have no blank lines, so each is one block: kept whole if it's short, else cut by words.
@query("""SELECT id AS document_id, CAST(p AS INTEGER) AS position, CASE WHEN len(w) <= 200 THEN text_content ELSE array_to_string(w[p * 200 + 1 : p * 200 + 200], ' ') END AS content FROM
  (SELECT id, text_content, list_filter(regexp_split_to_array(text_content, '[\\s\\p{Z}]+'), lambda x: x <> '') AS w FROM doc), LATERAL (SELECT unnest(range(0, (len(w) + 199) // 200)) AS p)""")
def chunk_markdown(a: Archive) -> DataFrame:
    return chunking.chunk_markdown(a.documents, 200, 20)


@query("SELECT id, regexp_replace(text_content, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') = text_content AS same FROM doc")
def control_strip(a: Archive) -> DataFrame:
    return a.documents.select("id", (ft.strip_controls(F.col("text_content")) == F.col("text_content")).alias("same"))


@query("SELECT id, len(list_filter(regexp_split_to_array(text_content, '[\\s\\p{Z}]+'), lambda x: x <> '')) AS n_words FROM doc")
def word_counts(a: Archive) -> DataFrame:
    return a.documents.select("id", ft.word_count(F.col("text_content")).alias("n_words"))


@query("SELECT id, CASE WHEN lang = 'de' THEN length(text_content) ELSE least(5000, length(text_content)) END AS n FROM doc")
def text_preview(a: Archive) -> DataFrame:
    form = F.when(F.col("lang") == "de", "markdown").otherwise("text")
    return a.documents.select("id", F.length(ft.preview(F.col("text_content"), form)).cast("long").alias("n"))


@query("SELECT id, CASE WHEN trim(lang) <> '' THEN CAST(('0x' || right(md5(correspondent), 1)) AS INTEGER) % 8 END AS bucket FROM doc")
def hash_bucket(a: Archive) -> DataFrame:
    return a.documents.select("id", ft.hash_bucket(F.col("correspondent")).alias("bucket"))


@query("SELECT id, correspondent AS name, lang AS dimension FROM doc")
def tag_split(a: Archive) -> DataFrame:
    name, dimension = ft.split_tag(F.concat(F.col("lang"), F.lit(": "), F.col("correspondent")), F.lit(""))
    return a.documents.select("id", name.alias("name"), dimension.alias("dimension"))


_NUMBERS = "list_transform(list_filter(regexp_extract_all({0}, '[0-9][0-9.,/]*[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 3), lambda x: regexp_replace(x, '[^0-9]', '', 'g'))"


@query(f"""SELECT id, CAST(len(list_filter(n, lambda x: NOT list_contains(k, x))) AS BIGINT) AS n_unmatched FROM (SELECT d.id, list_distinct({_NUMBERS.format('d.text_content')}) AS n,
  {_NUMBERS.format("coalesce(p.text_content, '')")} AS k FROM doc d LEFT JOIN doc p ON p.id = d.parent_id)""")
def unmatched_numbers(a: Archive) -> DataFrame:
    """Numbers of each document that its parent hasn't."""
    parent = a.documents.select(F.col("id").alias("parent_id"), F.col("text_content").alias("reference"))
    pairs = a.documents.select("id", "parent_id", "text_content").join(parent, "parent_id", "left")
    missing = ft.unmatched_numbers(F.col("text_content"), F.coalesce("reference", F.lit("")))
    return pairs.select("id", F.size(missing).cast("long").alias("n_unmatched"))


@query("SELECT id, 'Hallo ' || correspondent || ' {{y}}' || CASE WHEN id % 2 = 0 THEN lang ELSE '{{z}}' END AS text FROM doc")
def fill_placeholders(a: Archive) -> DataFrame:
    values = {"x": F.col("correspondent"), "z": F.when(F.col("id") % 2 == 0, F.col("lang")).otherwise("")}
    return a.documents.select("id", ft.fill_placeholders(F.lit("Hallo {{x}} {{y}}{{z}}"), values).alias("text"))


@query("SELECT id, correspondent || ' · ' || lang AS line, 'src-teil-2.pdf' AS part, replace(correspondent, 'c', '_') AS safe FROM doc")
def small_texts(a: Archive) -> DataFrame:
    line = ft.one_line(F.col("correspondent"), F.lit(" \n"), F.lit(None).cast("string"), F.col("lang"))
    return a.documents.select("id", line.alias("line"), ft.part_name(F.lit("src.pdf"), F.lit(2), F.lit(3)).alias("part"), ft.safe_file_name(F.replace("correspondent", F.lit("c"), F.lit(":"))).alias("safe"))


# Dates and classification


@query("SELECT id, CASE id % 4 WHEN 0 THEN document_date WHEN 1 THEN document_date END AS d FROM doc")
def date_parse(a: Archive) -> DataFrame:
    d = F.col("document_date")
    written = F.when(F.col("id") % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("id") % 4 == 1, F.date_format(d, "dd.MM.yyyy")).when(F.col("id") % 4 == 2, F.date_format(d, "yyyy/MM/dd")).otherwise("32.13.2020")
    return a.documents.select("id", fd.parse_date(written).alias("d"))


_KIND_NAMES = sorted(fd.DATE_KINDS)
_KIND_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in sorted(fd.DATE_KINDS.items()))


@query(rf"""SELECT * FROM (WITH k(name, kind) AS (VALUES {_KIND_ROWS}),
  w AS (SELECT id, CASE WHEN length(text_content) % 5 = 0 THEN text_content ELSE upper(replace([{", ".join(f"'{k}'" for k in _KIND_NAMES)}][length(text_content) % {len(_KIND_NAMES)} + 1], '_', regexp_extract(text_content, '[^\p{{L}}\p{{N}}]+', 0))) END AS written FROM doc)
  SELECT id, kind FROM w LEFT JOIN k ON k.name = regexp_replace(regexp_replace(lower(written), '[^\p{{L}}\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g'))""")
def date_kind(a: Archive) -> DataFrame:
    """Names of kinds in capitals, with what stands between a text's first words between theirs; and whole texts."""
    between = F.regexp_extract("text_content", r"[^\p{L}\p{N}]+", 0)
    name = F.element_at(F.array(*map(F.lit, _KIND_NAMES)), F.length("text_content") % len(_KIND_NAMES) + 1)
    written = F.when(F.length("text_content") % 5 == 0, F.col("text_content")).otherwise(F.upper(F.replace(name, F.lit("_"), between)))
    return a.documents.select("id", fd.date_kind(written).alias("kind"))


def _candidates(a: Archive) -> DataFrame:
    """Three dates of each document, whose kinds and days follow from its id."""
    i = F.col("id")
    kinds = F.array(*map(F.lit, ("erstellt", "belegdatum", "zeitraum_ende", "briefkopf", "zeitraum_beginn")))
    n = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("position")
    rows = a.documents.select(i, n)
    p = F.col("position")
    return rows.select(i.alias("document_id"), F.element_at(kinds, ((i + p * 2) % 5).cast("int") + 1).alias("kind"), F.date_add(F.lit("2024-01-01").cast("date"), ((i * (p + 1)) % 50).cast("int")).alias("date"), "position")


_CAND = """cand AS (SELECT id AS document_id, ['erstellt', 'belegdatum', 'zeitraum_ende', 'briefkopf', 'zeitraum_beginn'][(id + p * 2) % 5 + 1] AS kind,
  DATE '2024-01-01' + CAST((id * (p + 1)) % 50 AS INTEGER) AS date, p AS position FROM doc, range(3) r(p))"""


@query(f"""SELECT * FROM (WITH {_CAND}, one AS (SELECT document_id, kind, list_position(['belegdatum', 'zeitraum_ende', 'briefkopf', 'modell', 'erstellt'], kind) AS rank,
    CASE WHEN kind = 'zeitraum_ende' THEN max(date) ELSE arg_min(date, position) END AS date FROM cand WHERE kind <> 'zeitraum_beginn' GROUP BY document_id, kind),
  n AS (SELECT o.*, abs(date_diff('day', CAST(d.created_at AS DATE), o.date)) <= 1 AS near FROM one o JOIN doc d ON d.id = o.document_id),
  w AS (SELECT document_id, arg_min(near, rank) AS bn, min(rank) AS br, min(rank) FILTER (NOT near) AS orank FROM n GROUP BY document_id)
  SELECT d.id AS document_id, n.date AS document_date, coalesce(n.kind, '') AS kind, coalesce(w.bn AND w.orank IS NOT NULL, false) AS upload_conflict
  FROM doc d LEFT JOIN w ON w.document_id = d.id LEFT JOIN n ON n.document_id = d.id AND n.rank = CASE WHEN w.bn AND w.orank IS NOT NULL THEN w.orank ELSE w.br END)""")
def resolve_document_date(a: Archive) -> DataFrame:
    return classify.resolve_dates(_candidates(a), a.documents.select(F.col("id").alias("document_id"), F.to_date("created_at").alias("uploaded_on")))


@query(f"SELECT * FROM (WITH {_CAND} SELECT document_id, min(date) FILTER (kind = 'zeitraum_beginn') AS period_start, max(date) FILTER (kind = 'zeitraum_ende') AS period_end FROM cand GROUP BY document_id)")
def period_bounds(a: Archive) -> DataFrame:
    return classify.period_bounds(_candidates(a))


@query("SELECT id, strftime(coalesce(document_date, CAST(created_at AS DATE)), '%Y-%m') AS month, document_date IS NULL OR id % 4 = 0 AS may_set FROM doc")
def timeline_months(a: Archive) -> DataFrame:
    source = F.when(F.col("id") % 4 == 0, "briefkopf").when(F.col("id") % 4 == 1, "manuell")
    return a.documents.select("id", fd.month_label(ordering.display_date()).alias("month"), classify.may_set_date(F.col("document_date"), source).alias("may_set"))


_SIDES = "FROM doc d LEFT JOIN con s ON s.name = d.correspondent LEFT JOIN con r ON r.name = 'src' || (d.id % 20)"


def _sides(a: Archive) -> DataFrame:
    side = lambda p: a.contacts.select(*(F.col(c).alias(f"{p}_{c}") for c in ("name", "is_self", "is_own_business")))
    d = a.documents.withColumn("recipient", F.concat(F.lit("src"), (F.col("id") % 20).cast("string")))
    return d.join(side("s"), F.col("correspondent") == F.col("s_name"), "left").join(side("r"), F.col("recipient") == F.col("r_name"), "left")


@query(f"SELECT d.id, CASE WHEN coalesce(s.is_self, false) AND coalesce(r.is_self, false) THEN 'intern' WHEN coalesce(r.is_self, false) THEN 'eingang' WHEN coalesce(s.is_self, false) THEN 'ausgang' ELSE d.direction END AS direction {_SIDES}")
def derive_direction(a: Archive) -> DataFrame:
    return _sides(a).select("id", classify.direction(F.col("s_is_self"), F.col("r_is_self"), F.col("direction")).alias("direction"))


_SPHERE = "CASE WHEN coalesce(s.is_self AND s.is_own_business, false) OR coalesce(r.is_self AND r.is_own_business, false) THEN 'geschaeftlich' WHEN coalesce(s.is_self, false) OR coalesce(r.is_self, false) THEN 'privat' ELSE d.sphere END"


def _sphere() -> object:
    none = F.lit(None).cast("string")
    return classify.sphere([(F.col("s_is_self"), F.col("s_is_own_business"), none), (F.col("r_is_self"), F.col("r_is_own_business"), none)], F.col("sphere"))


@query(f"SELECT d.id, {_SPHERE} AS sphere {_SIDES}")
def derive_sphere(a: Archive) -> DataFrame:
    return _sides(a).select("id", _sphere().alias("sphere"))


@query(f"SELECT id, CASE WHEN sp = 'geschaeftlich' THEN 'nicht_zutreffend' ELSE tax_relevance END AS tax, CASE WHEN sp = 'geschaeftlich' THEN '' ELSE 'why' END AS reason FROM (SELECT d.id, d.tax_relevance, {_SPHERE} AS sp {_SIDES})")
def derive_tax(a: Archive) -> DataFrame:
    tax, reason = classify.tax_relevance(_sphere(), F.col("tax_relevance"), F.lit("why"))
    return _sides(a).select("id", tax.alias("tax"), reason.alias("reason"))


@query("""SELECT p.id AS party, CASE WHEN p.email <> '' THEN (SELECT min(name) FROM con WHERE con.email = p.email) ELSE (SELECT min(name) FROM con WHERE con.name = p.name) END AS contact FROM
  (SELECT id, CASE id % 3 WHEN 0 THEN correspondent || '@example.org' WHEN 1 THEN 'nobody@example.org' ELSE '' END AS email, correspondent AS name FROM doc) p""")
def match_correspondent(a: Archive) -> DataFrame:
    i = F.col("id")
    empty = F.lit("")
    mail_to = F.when(i % 3 == 0, F.upper(F.concat(F.col("correspondent"), F.lit("@example.org")))).when(i % 3 == 1, "nobody@example.org").otherwise(" ")
    parties = a.documents.select(i.alias("party"), empty.alias("vat_id"), empty.alias("iban"), empty.alias("tax_number"), mail_to.alias("email"), F.upper("correspondent").alias("name"))
    known = a.contacts.withColumns({"vat_id": empty, "iban": empty, "tax_number": empty})
    return classify.find_contacts(parties, known)


@query("""SELECT document_id, name, dimension, status FROM tsug WHERE status <> 'pending' UNION ALL SELECT * FROM (SELECT document_id, split_part(any_value(name ORDER BY id), ':', 2), split_part(any_value(name ORDER BY id), ':', 1), 'pending'
  FROM tsug t WHERE lower(split_part(name, ':', 2)) NOT IN (SELECT lower(name) FROM tsug u WHERE u.document_id = t.document_id AND u.status <> 'pending') GROUP BY document_id, lower(split_part(name, ':', 2)))""")
def suggestion_dedup(a: Archive) -> DataFrame:
    found = a.tag_suggestions.select("document_id", "name", "dimension", "confidence", F.col("id").alias("position"))
    return classify.replace_suggestions(a.tag_suggestions, found).select("document_id", "name", "dimension", "status")


@query("""SELECT id, CASE WHEN status <> 'pending' THEN status WHEN id % 6 = 0 THEN 'accepted' WHEN id % 5 = 0 THEN 'rejected' ELSE status END AS status FROM tsug""")
def apply_decisions(a: Archive) -> DataFrame:
    i = F.col("id")
    decisions = a.tag_suggestions.filter((i % 6 == 0) | (i % 5 == 0)).select("id", (i % 6 == 0).alias("accepted"))
    return classify.apply_decisions(a.tag_suggestions, decisions)[0].select("id", "status")


@query("""SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN DATE '2020-02-02' ELSE document_date END AS document_date, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'manuell' ELSE 'briefkopf' END AS date_source,
  CASE WHEN id % 4 = 2 THEN 'nein' ELSE tax_relevance END AS tax_relevance, CASE WHEN id % 4 = 2 AND tax_relevance <> 'nein' THEN '' ELSE 'why' END AS tax_reason FROM doc""")
def edit_metadata(a: Archive) -> DataFrame:
    i = F.col("id")
    docs = a.documents.select("id", "document_date", F.lit("briefkopf").alias("date_source"), "sphere", F.lit("ki").alias("sphere_by"), "tax_relevance", F.lit("why").alias("tax_reason"), F.lit("ki").alias("tax_by"))
    edits = a.documents.filter(i % 4 < 3).select("id", F.when(i % 4 == 1, F.lit("2020-02-02").cast("date")).alias("new_date"), (i % 4 == 0).alias("clear_date"), F.lit(None).cast("string").alias("new_sphere"), F.when(i % 4 == 2, "nein").alias("new_tax"))
    return classify.edit_metadata(docs, edits).select("id", "document_date", "date_source", "tax_relevance", "tax_reason")


# Mail


@query()
def html_text(a: Archive) -> DataFrame:
    return mail.clean_bodies(a._table("pages"), "page_id", "html", html=True)


def _by_id(values: tuple[str, ...]) -> Column:
    """One of the values by the id."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col("id") % len(values)).cast("int") + 1)


def _by_id_sql(values: tuple[str, ...]) -> str:
    quoted = ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values)
    return f"([{quoted}])[id % {len(values)} + 1]"


# What follows a mail's own text: signs of quotes, and lines that only look like one (the third of each row of three).
_TAILS = (
    "\n-- \nJane", "\nOn 1 May, Bob wrote:\n> hi", "\n--x\nJane",
    "\n> quoted\n  > more\n  indented\n\n\n\nEnde", "\nVon: Bob\n\n  Gesendet: gestern\nmehr", "\nVon: Anna\nirgendwas\nAn: Bert\nRest",
    "\nVon meinem Telefon gesendet\nx", "\n  ---- Urspruengliche Nachricht ----\nx", "\nGesendet von meinemx\nEnde",
    "\nFrom: Bob\nTo:\nAnna\nx", "\nAm 1. Mai schrieb Bob:\nalt", "\nAm 1. Mai schrieb Bob: nichts",
)


@query(f"""SELECT * FROM (WITH l AS (SELECT id, string_split(text_content || {_by_id_sql(_TAILS)}, chr(10)) AS x FROM doc), f AS (SELECT id, x, list_min(list_filter(list_transform(x, lambda y, i: CASE WHEN rtrim(y) = '--'
    OR regexp_matches(trim(y), '(?i)^(Gesendet von meinem|Von meinem .* gesendet|Sent from my|Get Outlook for)\\b') OR regexp_matches(trim(y), '(?i)^-{{2,}}\\s*(Urspr(ü|ue)ngliche Nachricht|Original Message|Weitergeleitete Nachricht|Forwarded message)\\s*-{{2,}}')
    OR regexp_matches(trim(y), '(?i)^(Am\\s.+\\sschrieb\\s.+:|On\\s.+\\swrote:)$') OR (regexp_matches(trim(y), '(?i)^(Von|From)\\s*:\\s*.+')
    AND regexp_matches(array_to_string(x[i + 1:i + 3], chr(10)), '(?i)^\\s*(Gesendet|Sent|An|To|Datum|Date)\\s*:\\s*.+')) THEN i END), lambda z: z IS NOT NULL)) AS k FROM l)
  SELECT id, regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(CASE WHEN k IS NULL THEN x ELSE x[1:k - 1] END, lambda y: NOT starts_with(trim(y), '>')), lambda y: rtrim(y)), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM f)""")
def quote_cut(a: Archive) -> DataFrame:
    bodies = a.documents.select("id", F.concat("text_content", _by_id(_TAILS)).alias("body"))
    return mail.clean_bodies(bodies, "id", "body").select("id", "text")


@query("""SELECT id, regexp_replace('Betreff: ' || title || chr(10) || CASE WHEN id % 2 = 0 THEN 'Von:  ' || chr(10) ELSE '' END || 'An: ' || correspondent || chr(10) || chr(10) || text_content, '\\s+$', '') AS text FROM doc""")
def mail_index_text(a: Archive) -> DataFrame:
    sender = F.when(F.col("id") % 2 == 0, " ").otherwise("")
    return a.documents.select("id", mail.index_text(F.col("title"), sender, F.col("correspondent"), F.lit(None).cast("string"), F.col("text_content")).alias("text"))


# Ingest


def _files(a: Archive) -> DataFrame:
    """A file for each document, its text as bytes."""
    return a.documents.select(F.concat(F.lit("/in/"), F.lpad(F.col("id").cast("string"), 9, "0"), F.lit(".txt")).alias("path"), F.encode("text_content", "UTF-8").alias("content"), F.lit("").alias("declared_type"))


_FILES = "files AS (SELECT '/in/' || lpad(CAST(id AS VARCHAR), 9, '0') || '.txt' AS path, sha256(text_content) AS sha256, octet_length(encode(text_content)) AS size, id FROM doc)"
_PLACED = f"{_FILES}, placed AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS p FROM files)"


@query(f"SELECT * FROM (WITH {_PLACED} SELECT path, sha256, size, 'text/plain' AS mime_type FROM placed WHERE p = 1)")
def dedup_sha256(a: Archive) -> DataFrame:
    known = a.spark.createDataFrame([], "sha256 string")
    return ingest.dedup(ingest.described(_files(a)), known)[0].select("path", "sha256", "size", "mime_type")


@query(f"SELECT * FROM (WITH {_PLACED} SELECT sha256, count(*) AS n, min(path) AS first FROM placed WHERE p > 1 GROUP BY sha256)")
def dup_occurrences(a: Archive) -> DataFrame:
    known = a.spark.createDataFrame([], "sha256 string")
    again = ingest.occurrences(ingest.dedup(ingest.described(_files(a)), known)[1])
    return again.select("sha256", F.size("paths").cast("long").alias("n"), F.get("paths", F.lit(0)).alias("first"))


@query(f"SELECT * FROM (WITH {_PLACED} SELECT path, CASE WHEN p > 1 OR sha256 IN (SELECT sha256 FROM files WHERE id % 11 = 0) THEN 'duplicate' ELSE 'ok' END AS status FROM placed)")
def upload_status(a: Archive) -> DataFrame:
    described = ingest.described(_files(a))
    known = ingest.described(_files(a).filter(F.substring("path", 5, 9).cast("long") % 11 == 0)).select("sha256")
    return ingest.upload_status(described, known).select("path", "status")


@query("SELECT id, 'n' || id AS v FROM doc WHERE id % 3 = 0 UNION ALL SELECT id, 'o' || id FROM doc WHERE id % 2 = 0 AND id % 3 <> 0")
def upsert_rows(a: Archive) -> DataFrame:
    row = lambda where, p: a.documents.filter(where).select("id", F.concat(F.lit(p), F.col("id").cast("string")).alias("v"))
    return ingest.upsert(row("id % 2 = 0", "o"), row("id % 3 = 0", "n"), ["id"])


@query("""SELECT message_id FROM (SELECT '<' || id || '@mail>' AS message_id FROM doc WHERE id % 3 = 0) WHERE message_id NOT IN (SELECT json_extract_string(metadata, '$.message_id') FROM doc WHERE parent_id IS NULL AND id % 9 = 0)""")
def mail_dedup(a: Archive) -> DataFrame:
    i = F.col("id").cast("string")
    mails = a.documents.filter("id % 3 = 0").select(F.concat(F.lit("<"), i, F.lit("@mail>")).alias("message_id"), F.sha2(i, 256).alias("sha256"), i.alias("path"))
    return ingest.new_mails(mails, a.documents).select("message_id")


# Checks of tables and pages


@query("""SELECT * FROM (WITH p AS (SELECT id, x[1] AS layer, coalesce(x[2], '') AS ocr, x[len(x)] AS vision, length(text_content) % 100 AS sure FROM (SELECT id, text_content, string_split(text_content, chr(10)) AS x FROM doc)),
  m AS (SELECT *, CASE WHEN length(trim(layer)) >= 20 THEN 'text_layer' WHEN length(trim(ocr)) >= 20 AND sure >= 60 THEN 'ocr' ELSE 'vision' END AS method FROM p)
  SELECT id, CASE method WHEN 'text_layer' THEN layer WHEN 'ocr' THEN ocr ELSE vision END AS text, method FROM m)""")
def extract_cascade(a: Archive) -> DataFrame:
    """First lines as text layers, second ones as what OCR read, last ones as what a model read."""
    lines = F.split("text_content", "\n")
    text, method = checks.extraction(F.get(lines, F.lit(0)), F.get(lines, F.lit(1)), (F.length("text_content") % 100).cast("double"), F.element_at(lines, -1))
    return a.documents.select("id", text.alias("text"), method.alias("method"))


# Stored results and letters


@query("""SELECT case_id, document_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY dd, created_at, document_id) AS BIGINT) AS place FROM (SELECT c.case_id, v.id AS document_id, v.created_at, coalesce(v.document_date, CAST(v.created_at AS DATE)) AS dd,
  row_number() OVER (PARTITION BY c.case_id ORDER BY coalesce(v.document_date, CAST(v.created_at AS DATE)) DESC, v.created_at DESC, v.id) AS p FROM (SELECT DISTINCT * FROM dcas) c JOIN vis v ON v.id = c.document_id) WHERE p <= 10""")
def case_basis_latest(a: Archive) -> DataFrame:
    return stale.case_basis(a.document_case, _visible(a), most=10)


@query("""SELECT case_id, n_new, n_changed, n_new > 0 OR n_changed > 0 AS is_stale FROM (SELECT r.case_id, count(v.id) FILTER (NOT list_contains(r.considered, v.id)) AS n_new,
  count(v.id) FILTER (list_contains(r.considered, v.id) AND v.updated_at > r.generated_at) AS n_changed FROM run r LEFT JOIN (SELECT DISTINCT * FROM dcas) c ON c.case_id = r.case_id LEFT JOIN vis v ON v.id = c.document_id GROUP BY r.case_id)""")
def case_staleness(a: Archive) -> DataFrame:
    return stale.case_staleness(a.case_runs, a.document_case, _visible(a))


@query("""SELECT d.id AS document_id, greatest(d.updated_at, c.m) > TIMESTAMP '2024-05-02 00:00:00' AS is_stale FROM doc d LEFT JOIN (SELECT document_id, max(created_at) AS m FROM com GROUP BY 1) c ON c.document_id = d.id""")
def document_staleness(a: Archive) -> DataFrame:
    runs = a.documents.select(F.col("id").alias("document_id"), F.lit("2024-05-02 00:00:00").cast("timestamp_ntz").alias("generated_at"))
    return stale.document_staleness(a.documents, a.comments, runs)


@query("""SELECT case_id, n, ids_digest, changed_at, commented_at FROM (SELECT c.case_id, bit_xor(CAST('0x' || substr(md5(CAST(v.id AS VARCHAR)), 1, 15) AS BIGINT)) AS ids_digest, count(*) AS n, max(v.updated_at) AS changed_at, max(m.m) AS commented_at FROM (SELECT DISTINCT * FROM dcas) c JOIN vis v ON v.id = c.document_id
  LEFT JOIN (SELECT document_id, max(created_at) AS m FROM com GROUP BY 1) m ON m.document_id = v.id GROUP BY c.case_id)""")
def basis_fingerprints(a: Archive) -> DataFrame:
    return stale.basis_fingerprint(a.document_case, _visible(a), a.comments)


@query("""SELECT document_id, id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY created_at, id) AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS p FROM com) WHERE p <= 3 OR follow_up_date IS NOT NULL""")
def comment_context(a: Archive) -> DataFrame:
    return stale.comment_context(a.comments, TODAY, most=3).select("document_id", "id", "place")


def _drafts(a: Archive) -> tuple[DataFrame, DataFrame]:
    i = F.col("id")
    keys = F.explode(F.array(*map(F.lit, ("kontakt.name", "document.title", "vorgang.name", "manual")))).alias("source")
    b = a.documents.select(i.alias("draft_id"), keys).select("draft_id", F.col("source").alias("key"), "source", (F.col("draft_id") % 2 == 0).alias("required"), F.when((F.col("source") == "manual") & (F.col("draft_id") % 3 == 0), "von Hand").otherwise("").alias("manual"))
    kontakt = a.documents.select(i.alias("draft_id"), F.lit("kontakt").alias("namespace"), F.lit("name").alias("name"), F.col("correspondent").alias("value"))
    document = a.documents.select(i.alias("draft_id"), F.lit("document").alias("namespace"), F.lit("title").alias("name"), F.lit(" ").alias("value"))
    return b, kontakt.unionByName(document)


_BOUND = """SELECT draft_id, key, CASE WHEN key = 'kontakt.name' THEN correspondent WHEN key = 'manual' AND draft_id % 3 = 0 THEN 'von Hand' ELSE '' END AS value,
  CASE WHEN key = 'kontakt.name' THEN '' WHEN key = 'document.title' THEN 'empty_value' WHEN key = 'vorgang.name' THEN 'missing_source' WHEN draft_id % 3 = 0 THEN '' ELSE 'manual' END AS reason
  FROM (SELECT id AS draft_id, correspondent, unnest(['kontakt.name', 'document.title', 'vorgang.name', 'manual']) AS key FROM doc)"""


@query(_BOUND)
def bindings_resolve(a: Archive) -> DataFrame:
    return bindings.resolve(*_drafts(a)).select("draft_id", "key", "value", "reason")


@query(f"SELECT draft_id, key FROM ({_BOUND}) WHERE value = '' AND draft_id % 2 = 0")
def missing_required(a: Archive) -> DataFrame:
    return bindings.missing_required(bindings.resolve(*_drafts(a)))


@query("""SELECT * FROM (WITH l AS (SELECT id, parent_id, CAST(unnest(range(0, len(x))) AS INTEGER) AS position, unnest(x) AS title FROM (SELECT id, parent_id, string_split(text_content, chr(10)) AS x FROM doc)),
  k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS p FROM l WHERE trim(title) <> '')
  SELECT id AS run_id, position, title, list_concat(CASE WHEN id % 3 <> 0 THEN [id] ELSE [] END, CASE WHEN parent_id IS NOT NULL THEN [parent_id] ELSE [] END) AS sources FROM k WHERE p <= 8)""")
def recommendations(a: Archive) -> DataFrame:
    """Lines of texts as a model's recommendations, whose sources are documents in scope, others, and words."""
    text = lambda c: F.col(c).cast("string")
    lines = a.documents.select("id", "parent_id", F.posexplode(F.split("text_content", "\n")).alias("position", "title"))
    items = lines.select(F.col("id").alias("run_id"), "position", "title", F.array(text("id"), F.substring_index("title", " ", 1), text("parent_id"), text("id")).alias("sources"))
    allowed = a.documents.filter("id % 3 <> 0").select(F.col("id").alias("run_id"), F.col("id").alias("document_id"))
    parents = a.documents.filter("parent_id IS NOT NULL").select(F.col("id").alias("run_id"), F.col("parent_id").alias("document_id"))
    return bindings.recommendation_items(items, allowed.unionByName(parents)).select("run_id", "position", "title", "sources")


@query(f"""SELECT * FROM (WITH {_PLACED} SELECT lpad(CAST(id AS VARCHAR), 9, '0') AS title, 'document' AS kind, 'folder' AS source, 'department' AS visibility, CAST(NULL AS BIGINT) AS owner_id, 'pending' AS processing_status, sha256,
  '{{"original_filename":"' || substr(path, 5) || '","mime_type":"text/plain","size":' || size || '}}' AS metadata FROM placed WHERE p = 1)""")
def stream_ingest_dedup(a: Archive) -> DataFrame:
    """Files of a stream that are new: the batch form of what each micro-batch does (streaming/ingest_stream)."""
    new, _ = ingest.dedup(ingest.described(_files(a)), a.spark.createDataFrame([], "sha256 string"))
    return ingest.new_documents(new, "folder")


# Details and repairs


@query("""SELECT v.id, c.email AS contact_email, p.title AS parent_title, CAST((SELECT count(DISTINCT name) FROM dtag WHERE document_id = v.id) AS BIGINT) AS n_tags,
  array_to_string(list_sort((SELECT list(DISTINCT cas.name) FROM dcas JOIN cas ON cas.id = dcas.case_id WHERE document_id = v.id)), ',') AS cases
  FROM vis v LEFT JOIN con c ON c.name = v.correspondent LEFT JOIN doc p ON p.id = v.parent_id""")
def document_rows(a: Archive) -> DataFrame:
    visible = _visible(a)
    parents = a.documents.select("id", "title")
    shown = details.document_rows(visible, a.contacts, a.document_tag, a.document_case, a.cases).drop("parent_title")
    named = shown.join(parents.select(F.col("id").alias("parent_id"), F.col("title").alias("parent_title")), "parent_id", "left")
    return named.select("id", "contact_email", "parent_title", F.size("tags").cast("long").alias("n_tags"), F.array_join("cases", ",").alias("cases"))


@query("SELECT name, is_self FROM con ORDER BY is_self DESC, name LIMIT 7")
def prompt_contacts(a: Archive) -> DataFrame:
    return details.contacts_for_prompt(a.contacts, 7).select("name", "is_self")


@query("""SELECT id FROM vis WHERE id <> 38 AND id NOT IN (SELECT CASE WHEN x = 38 THEN y ELSE x END FROM lnk WHERE x = 38 OR y = 38)
  ORDER BY coalesce(document_date, CAST(created_at AS DATE)) DESC, created_at DESC, id LIMIT 50""")
def link_picker(a: Archive) -> DataFrame:
    return details.link_candidates(_visible(a), _links(a), _FOCUS, 50).select("id")


@query("SELECT id FROM com WHERE author_id = 3")
def own_comments(a: Archive) -> DataFrame:
    return details.own_comments(a.comments, USER).select("id")


@query("""SELECT id, CASE WHEN follow_up_date <= DATE '2024-06-12' AND remind AND reminded_at IS NULL THEN TIMESTAMP '2024-06-12 07:00:00' ELSE reminded_at END AS reminded_at FROM com""")
def mark_reminded(a: Archive) -> DataFrame:
    return details.mark_reminded(a.comments, filters.follow_ups(a.comments, "pending", TODAY), f"{TODAY} 07:00:00").select("id", "reminded_at")


@query("SELECT id, CASE WHEN id % 21 = 1 THEN NULL ELSE parent_id END AS parent_id FROM doc")
def detach_children(a: Archive) -> DataFrame:
    ids = a.documents.filter("id % 21 = 1").select("id")
    return details.detach_children(a.documents, a.document_department, ids)[0].select("id", "parent_id")


@query("""SELECT id, title || CASE WHEN document_date IS NOT NULL THEN ' (' || document_date || ')' ELSE '' END || chr(10) || '- Art: ' || lang || chr(10) || '- Von: ' || correspondent AS block FROM doc""")
def prompt_blocks(a: Archive) -> DataFrame:
    facts = F.create_map(F.lit("Von"), F.col("correspondent"), F.lit("Art"), F.col("lang"), F.lit("leer"), F.lit(""))
    return a.documents.select("id", details.prompt_block(F.col("title"), F.col("document_date"), F.lit(" "), facts).alias("block"))


@query("SELECT DISTINCT document_id, name, dimension FROM dtag WHERE dimension = 'lang' OR document_id % 2 = 1")
def repair_tags(a: Archive) -> DataFrame:
    crammed = a.document_tag.filter("dimension = 'lang'").select("document_id", F.concat_ws(":", "dimension", "name").alias("name"), F.lit("").alias("dimension"))
    return repairs.split_crammed_tags(crammed.unionByName(a.document_tag.filter("document_id % 2 = 1")))


@query("SELECT id, CASE WHEN processing_status = 'analyzing' THEN CASE WHEN id % 10 = 0 THEN 'failed' ELSE 'reviewed' END WHEN processing_status = 'ready' THEN 'reviewed' ELSE processing_status END AS processing_status FROM doc")
def repair_statuses(a: Archive) -> DataFrame:
    return repairs.confirm_all_ready(repairs.finish_stuck_analyses(a.documents)).select("id", "processing_status")


@query("SELECT id, CASE WHEN document_date IS NOT NULL AND id % 2 = 0 THEN 'modell' WHEN id % 4 = 1 THEN 'manuell' END AS date_source FROM doc")
def repair_dates(a: Archive) -> DataFrame:
    i = F.col("id")
    told = F.when(i % 2 == 0, F.col("document_date").cast("string")).otherwise("2000-01-01")
    docs = a.documents.withColumns({"key_facts": F.create_map(F.lit("document_date"), told), "date_source": F.when(i % 4 == 1, "manuell")})
    return repairs.mark_machine_dates(docs).select("id", "date_source")


# The ends of letters: closings before names of several lines, and phrases that are too far up, or part of a sentence.
_ENDINGS = (
    "\n\nMit freundlichen Grüßen,\nJane\n", "\n Gruß Jane,\n\n", "\nBeste Grüsse\n\nJane Doe\nLeitung\nTelefon\nMail", "\nViele Grüße\n1\n2\n3\n4\n5",
    "\nHochachtungsvolle Worte", "\nFreundliche Gruesse\n\n\n1\n2\n3", "\nbeste grüße\nx\nViele Grusse, Jane\ny", "",
)
_CLOSES = "regexp_matches({0}, '^(mit freundlichen (grüßen|grüssen|gruessen|grußen)|(freundliche|beste|viele) (grüße|grüsse|grueße|gruesse|gruße|grusse)|hochachtungsvoll)($|[^\\p{{L}}\\p{{N}}_])')"


@query(f"""SELECT id, CASE WHEN k IS NULL THEN t ELSE regexp_replace(array_to_string(x[1:k - 1], chr(10)), '\\s+$', '') END AS body, 'Jane' AS signature FROM (SELECT id, t, x, list_max(list_filter(list_transform(x, lambda y, i:
    CASE WHEN (said[i] = 'gruß jane' OR {_CLOSES.format('said[i]')}) AND (i > len(x) - 4 OR len(list_filter(said[i + 1:len(x) - 4], lambda z: z <> '')) = 0) THEN i END), lambda z: z IS NOT NULL)) AS k
  FROM (SELECT id, t, string_split(t, chr(10)) AS x, list_transform(string_split(t, chr(10)), lambda y: rtrim(lower(trim(y)), ',')) AS said FROM (SELECT id, regexp_replace(text_content || {_by_id_sql(_ENDINGS)}, '\\s+$', '') AS t FROM doc)))""")
def strip_closings(a: Archive) -> DataFrame:
    body = fl.strip_closing(F.concat("text_content", _by_id(_ENDINGS)), F.lit("Gruß Jane"))
    return a.documents.select("id", body.alias("body"), fl.strip_first_closing(F.lit("Viele Grüße\n\nJane")).alias("signature"))


@query("""SELECT id, CASE WHEN id % 3 = 0 THEN '' WHEN document_date IS NULL THEN 'bis 01.02.2024' WHEN id % 2 = 0 THEN strftime(document_date, '%d.%m.%Y') || ' – 01.02.2024' ELSE 'ab ' || strftime(document_date, '%d.%m.%Y') END AS label FROM doc""")
def period_labels(a: Archive) -> DataFrame:
    end = F.when((F.col("id") % 2 == 0) & (F.col("id") % 3 != 0), F.lit("2024-02-01").cast("date"))
    return a.documents.select("id", fd.period_label(F.col("document_date"), end).alias("label"))


@query("SELECT '/in/' || lpad(CAST(id AS VARCHAR), 9, '0') || '.txt' AS path, length(text_content) AS n FROM doc")
def read_texts(a: Archive) -> DataFrame:
    texts = readers.read_texts(_files(a).withColumn("mime_type", F.lit("text/plain")))
    return texts.select("path", F.length("text").cast("long").alias("n"))


from . import file_queries, stream_queries  # noqa: E402, F401  they register their queries here
