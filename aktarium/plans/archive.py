"""The archive projected from the test tables by fixed rules, so that every operator runs on real rows.

`Archive` has each table as a frame; `CTES` says the same rules in DuckDB's SQL, for the oracles.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.references import normalize_reference
from ..session import table

#: Parameters that the queries fix: the day, the acting user, the source document.
TODAY, USER, SUPERUSER, DOCUMENT = "2024-06-12", 3, 99, 43


@dataclass(frozen=True)
class Archive:
    spark: SparkSession
    sf_dir: str

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def documents(self) -> DataFrame:
        i = F.col("doc_id")
        pick = lambda by, *values: F.element_at(F.array(*map(F.lit, values)), (by % len(values)).cast("int") + 1)
        day = lambda start, n: F.date_add(F.lit(start).cast("date"), n.cast("int"))
        created = F.timestamp_add("HOUR", i, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        return self._table("documents").select(
            i.alias("id"),
            F.concat(F.lit("Dokument "), i.cast("string")).alias("title"),
            F.when(i % 9 == 0, "mail_body").otherwise("document").alias("kind"),
            F.col("source").alias("correspondent"),
            F.when(i % 4 == 0, "private").otherwise("department").alias("visibility"),
            (i % 17).alias("owner_id"),
            F.when((i % 7).isin(1, 2), i - i % 7).when(i % 7 == 3, i - 1).when(i % 7 == 4, i - 3).alias("parent_id"),
            pick(i % 11, "pending", "extracting", "analyzing", "embedding", "failed", "ready", "ready", "ready", "reviewed", "reviewed", "reviewed").alias("processing_status"),
            pick(i, "offen", "erledigt", "keine").alias("action_status"),
            pick(i, "eingang", "ausgang", "intern", "unbekannt").alias("direction"),
            pick(i, "geschaeftlich", "privat", "unbekannt").alias("sphere"),
            pick(F.floor(i / 5), "ja", "nein", "vielleicht", "nicht_zutreffend", "unbekannt").alias("tax_relevance"),
            F.when(i % 3 != 0, day("2023-01-01", i % 700)).alias("document_date"),
            created.alias("created_at"),
            F.timestamp_add("DAY", i % 5, created).alias("updated_at"),
            F.col("text").alias("text_content"),
            F.concat(
                F.lit('{"size": '), F.col("n_chars").cast("string"),
                F.when(i % 10 == 0, F.lit(', "analysis_error": "x"')).otherwise(F.lit("")),
                F.when(i % 9 == 0, F.concat(F.lit(', "message_id": "<'), i.cast("string"), F.lit('@mail>"'))).otherwise(F.lit("")),
                F.lit("}"),
            ).alias("metadata"),
            F.col("lang"),
        )

    @cached_property
    def document_department(self) -> DataFrame:
        i, ids = F.col("id"), self.documents.select("id")
        second = ids.filter(i % 10 == 0).select(i.alias("document_id"), ((i % 5 + 1) % 5).alias("department_id"))
        return ids.select(i.alias("document_id"), (i % 5).alias("department_id")).unionByName(second)

    @cached_property
    def users(self) -> DataFrame:
        ids = self.spark.range(17).select("id", F.lit(False).alias("is_superuser"))
        return ids.unionByName(self.spark.range(99, 100).select("id", F.lit(True).alias("is_superuser")))

    @cached_property
    def user_department(self) -> DataFrame:
        return self.spark.range(17).select(F.col("id").alias("user_id"), (F.col("id") % 5).alias("department_id"))

    @cached_property
    def document_tag(self) -> DataFrame:
        docs = self.documents
        by_lang = docs.filter("lang IS NOT NULL").select(F.col("id").alias("document_id"), F.col("lang").alias("name"), F.lit("lang").alias("dimension"))
        by_source = docs.filter("correspondent IS NOT NULL").select(F.col("id").alias("document_id"), F.col("correspondent").alias("name"), F.lit("src").alias("dimension"))
        return by_lang.unionByName(by_source)

    @cached_property
    def tags(self) -> DataFrame:
        return self.document_tag.select("name", "dimension").distinct()

    @cached_property
    def cases(self) -> DataFrame:
        i = F.col("id")
        status = F.element_at(F.array(F.lit("open"), F.lit("in_progress"), F.lit("closed")), (i % 3).cast("int") + 1)
        return self.spark.range(25).select("id", F.concat(F.lit("Vorgang "), i.cast("string")).alias("name"), status.alias("status"))

    @cached_property
    def document_case(self) -> DataFrame:
        i, ids = F.col("id"), self.documents.select("id")
        second = ids.filter(i % 6 == 0).select(i.alias("document_id"), ((i + 5) % 23).alias("case_id"))
        return ids.select(i.alias("document_id"), (i % 23).alias("case_id")).unionByName(second)

    @cached_property
    def contacts(self) -> DataFrame:
        n = F.regexp_extract("name", "([0-9]+)$", 1).cast("long")
        names = self.documents.filter("correspondent IS NOT NULL").select(F.col("correspondent").alias("name")).distinct()
        return names.withColumns({"email": F.concat("name", F.lit("@example.org")), "is_self": n % 10 == 0, "is_own_business": n % 20 == 0})

    @cached_property
    def chunks(self) -> DataFrame:
        i = F.col("vec_id")
        return self._table("embeddings").select(
            i.alias("id"), (i % 200).alias("document_id"), F.floor(i / 200).cast("int").alias("position"),
            F.concat(F.lit("vec "), i.cast("string")).alias("content"), "embedding",
            F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("embedding_model"), F.lit("1").alias("embedding_model_version"),
        )

    @cached_property
    def comments(self) -> DataFrame:
        c, t = F.col("conv_id"), F.col("turn")
        due = F.date_add(F.lit("2024-06-03").cast("date"), ((c * 7 + t) % 30 - 10).cast("int"))
        return self._table("conversations").select(
            (c * 1000 + t).alias("id"), (c % 200).alias("document_id"), F.col("text").alias("body"), (c % 17).alias("author_id"),
            F.when(F.col("role") != "system", due).alias("follow_up_date"), (t % 2 == 0).alias("remind"),
            F.when(c % 5 == 0, F.lit("2024-06-01 08:00:00").cast("timestamp_ntz")).alias("reminded_at"),
            F.timestamp_add("MINUTE", c * 60 + t, F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")).alias("created_at"),
        )

    @cached_property
    def references(self) -> DataFrame:
        i = F.col("id")
        kinds = [F.lit(x) for x in ("aktenzeichen", "kundennummer", "iban", "rechnungsnummer", "sonstige")]
        number = F.concat((i % 37).cast("string"), F.when(i % 2 == 0, F.lit(" / ")).otherwise(F.lit("/")), F.lit("24"))
        raw = F.concat(F.when(i % 3 == 0, F.lit("Az. ")).when(i % 3 == 1, F.lit("Kundennr: ")).otherwise(F.lit("")), number)
        return self.documents.select(
            i.alias("id"), i.alias("document_id"), F.element_at(F.array(*kinds), (i % 5).cast("int") + 1).alias("type"),
            raw.alias("value_raw"), normalize_reference(raw).alias("value_normalized"),
            F.when(i % 4 == 0, "deins").when(i % 4 == 1, "deren").otherwise("").alias("role"), F.when(i % 8 == 0, "manuell").otherwise("ki").alias("source"),
        )

    @cached_property
    def case_references(self) -> DataFrame:
        """References that cases hold: of every case one by hand, of some one learned from a document."""
        i = F.col("id")
        manual = self.cases.select(i.alias("owner_id"), F.lit("aktenzeichen").alias("type"), F.concat((i % 37).cast("string"), F.lit("/24")).alias("value_normalized"), F.lit("manuell").alias("source"), F.lit(None).cast("long").alias("learned_from"))
        learned = self.cases.filter(i % 2 == 0).select(i.alias("owner_id"), F.lit("rechnungsnummer").alias("type"), F.concat(((i * 3) % 37).cast("string"), F.lit("/24")).alias("value_normalized"), F.lit("gelernt").alias("source"), (i * 8 + 4).alias("learned_from"))
        return manual.unionByName(learned)

    @cached_property
    def raw_links(self) -> DataFrame:
        i = F.col("id")
        flip = i % 38 == 0
        return self.documents.filter(i % 19 == 0).select(F.when(flip, i + 13).otherwise(i).alias("x"), F.when(flip, i).otherwise(i + 13).alias("y"))

    @cached_property
    def tasks(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self._table("orders").select(
            k.alias("id"), F.concat(F.lit("Aufgabe "), k.cast("string")).alias("title"), F.when(k % 3 == 0, "erledigt").otherwise("offen").alias("status"),
            F.when(k % 6 != 0, F.date_add(F.lit("2024-06-01").cast("date"), (k % 40).cast("int"))).alias("due_date"), (k % 17).alias("owner_id"),
            F.when(k % 2 == 0, "private").otherwise("department").alias("visibility"),
            F.timestamp_add("MINUTE", k, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")).alias("created_at"),
        )

    @cached_property
    def task_department(self) -> DataFrame:
        return self.tasks.select(F.col("id").alias("task_id"), (F.col("id") % 5).alias("department_id"))

    @cached_property
    def task_document(self) -> DataFrame:
        return self.tasks.select(F.col("id").alias("task_id"), (F.col("id") % 200).alias("document_id"))

    @cached_property
    def tag_suggestions(self) -> DataFrame:
        i = F.col("id")
        status = F.element_at(F.array(F.lit("pending"), F.lit("accepted"), F.lit("rejected")), (i % 3).cast("int") + 1)
        docs = self.documents.select("id", "lang", "correspondent")
        return docs.select(i.alias("id"), (i % 200).alias("document_id"), F.concat(F.col("lang"), F.lit(":"), F.col("correspondent")).alias("name"), F.lit("").alias("dimension"), ((i % 10) / 10).alias("confidence"), status.alias("status"))

    @cached_property
    def case_suggestions(self) -> DataFrame:
        i = F.col("id")
        status = F.when(i % 4 == 0, "pending").otherwise("accepted")
        return self.documents.select(i.alias("id"), (i % 100).alias("document_id"), F.concat(F.lit("Fall "), (i % 13).cast("string")).alias("name"), ((i % 7) / 7).alias("confidence"), status.alias("status"))

    @cached_property
    def case_runs(self) -> DataFrame:
        """Stored results of cases: when they were made, and of which documents."""
        i = F.col("id")
        made = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
        basis = self.document_case.filter((F.col("document_id") % 3 != 0) & (F.col("case_id") % 2 == 0))
        lists = basis.groupBy(F.col("case_id").alias("id")).agg(F.sort_array(F.collect_set("document_id")).alias("considered"))
        return self.cases.select("id").join(lists, "id", "left").select(i.alias("case_id"), made.alias("generated_at"), F.coalesce("considered", F.array().cast("array<long>")).alias("considered"))


CTES = """
doc AS (
  SELECT doc_id AS id, 'Dokument ' || doc_id AS title, CASE WHEN doc_id % 9 = 0 THEN 'mail_body' ELSE 'document' END AS kind,
    source AS correspondent, CASE WHEN doc_id % 4 = 0 THEN 'private' ELSE 'department' END AS visibility, doc_id % 17 AS owner_id,
    CASE WHEN doc_id % 7 IN (1, 2) THEN doc_id - doc_id % 7 WHEN doc_id % 7 = 3 THEN doc_id - 1 WHEN doc_id % 7 = 4 THEN doc_id - 3 END AS parent_id,
    ['pending','extracting','analyzing','embedding','failed','ready','ready','ready','reviewed','reviewed','reviewed'][doc_id % 11 + 1] AS processing_status,
    ['offen','erledigt','keine'][doc_id % 3 + 1] AS action_status,
    ['eingang','ausgang','intern','unbekannt'][doc_id % 4 + 1] AS direction,
    ['geschaeftlich','privat','unbekannt'][doc_id % 3 + 1] AS sphere,
    ['ja','nein','vielleicht','nicht_zutreffend','unbekannt'][doc_id // 5 % 5 + 1] AS tax_relevance,
    CASE WHEN doc_id % 3 <> 0 THEN DATE '2023-01-01' + CAST(doc_id % 700 AS INTEGER) END AS document_date,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS created_at,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) + to_days(CAST(doc_id % 5 AS INTEGER)) AS updated_at,
    text AS text_content,
    '{"size": ' || n_chars || CASE WHEN doc_id % 10 = 0 THEN ', "analysis_error": "x"' ELSE '' END
      || CASE WHEN doc_id % 9 = 0 THEN ', "message_id": "<' || doc_id || '@mail>"' ELSE '' END || '}' AS metadata,
    lang
  FROM documents
), ddep AS (
  SELECT id AS document_id, id % 5 AS department_id FROM doc
  UNION ALL SELECT id, (id % 5 + 1) % 5 FROM doc WHERE id % 10 = 0
), usr AS (
  SELECT range AS id, false AS is_superuser FROM range(17) UNION ALL SELECT 99, true
), udep AS (
  SELECT range AS user_id, range % 5 AS department_id FROM range(17)
), dtag AS (
  SELECT id AS document_id, lang AS name, 'lang' AS dimension FROM doc WHERE lang IS NOT NULL
  UNION ALL SELECT id, correspondent, 'src' FROM doc WHERE correspondent IS NOT NULL
), cas AS (
  SELECT range AS id, 'Vorgang ' || range AS name, ['open','in_progress','closed'][range % 3 + 1] AS status FROM range(25)
), dcas AS (
  SELECT id AS document_id, id % 23 AS case_id FROM doc UNION ALL SELECT id, (id + 5) % 23 FROM doc WHERE id % 6 = 0
), con AS (
  SELECT name, name || '@example.org' AS email, n % 10 = 0 AS is_self, n % 20 = 0 AS is_own_business
  FROM (SELECT DISTINCT correspondent AS name, CAST(regexp_extract(correspondent, '([0-9]+)$', 1) AS BIGINT) AS n FROM doc WHERE correspondent IS NOT NULL)
), chk AS (
  SELECT vec_id AS id, vec_id % 200 AS document_id, CAST(vec_id // 200 AS INTEGER) AS position, 'vec ' || vec_id AS content,
    embedding, 'm' || (label % 2) AS embedding_model, '1' AS embedding_model_version FROM embeddings
), com AS (
  SELECT conv_id * 1000 + turn AS id, conv_id % 200 AS document_id, text AS body, conv_id % 17 AS author_id,
    CASE WHEN role <> 'system' THEN DATE '2024-06-03' + CAST((conv_id * 7 + turn) % 30 - 10 AS INTEGER) END AS follow_up_date,
    turn % 2 = 0 AS remind, CASE WHEN conv_id % 5 = 0 THEN TIMESTAMP '2024-06-01 08:00:00' END AS reminded_at,
    TIMESTAMP '2024-05-01 00:00:00' + to_minutes(conv_id * 60 + turn) AS created_at
  FROM conversations
), ref AS (
  SELECT id, id AS document_id, ['aktenzeichen','kundennummer','iban','rechnungsnummer','sonstige'][id % 5 + 1] AS type,
    CASE id % 3 WHEN 0 THEN 'Az. ' WHEN 1 THEN 'Kundennr: ' ELSE '' END || (id % 37) || CASE WHEN id % 2 = 0 THEN ' / ' ELSE '/' END || '24' AS value_raw,
    (id % 37) || '/24' AS value_normalized,
    CASE id % 4 WHEN 0 THEN 'deins' WHEN 1 THEN 'deren' ELSE '' END AS role, CASE WHEN id % 8 = 0 THEN 'manuell' ELSE 'ki' END AS source
  FROM doc
), cref AS (
  SELECT id AS owner_id, 'aktenzeichen' AS type, (id % 37) || '/24' AS value_normalized, 'manuell' AS source, CAST(NULL AS BIGINT) AS learned_from FROM cas
  UNION ALL SELECT id, 'rechnungsnummer', ((id * 3) % 37) || '/24', 'gelernt', id * 8 + 4 FROM cas WHERE id % 2 = 0
), lnk AS (
  SELECT CASE WHEN id % 38 = 0 THEN id + 13 ELSE id END AS x, CASE WHEN id % 38 = 0 THEN id ELSE id + 13 END AS y FROM doc WHERE id % 19 = 0
), tsk AS (
  SELECT o_orderkey AS id, 'Aufgabe ' || o_orderkey AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'erledigt' ELSE 'offen' END AS status,
    CASE WHEN o_orderkey % 6 <> 0 THEN DATE '2024-06-01' + CAST(o_orderkey % 40 AS INTEGER) END AS due_date, o_orderkey % 17 AS owner_id,
    CASE WHEN o_orderkey % 2 = 0 THEN 'private' ELSE 'department' END AS visibility,
    TIMESTAMP '2024-03-01 00:00:00' + to_minutes(o_orderkey) AS created_at
  FROM orders
), tsug AS (
  SELECT id, id % 200 AS document_id, lang || ':' || correspondent AS name, '' AS dimension, (id % 10) / 10 AS confidence, ['pending','accepted','rejected'][id % 3 + 1] AS status FROM doc
), csug AS (
  SELECT id, id % 100 AS document_id, 'Fall ' || (id % 13) AS name, (id % 7) / 7 AS confidence, CASE WHEN id % 4 = 0 THEN 'pending' ELSE 'accepted' END AS status FROM doc
), run AS (
  SELECT cas.id AS case_id, TIMESTAMP '2024-01-20 00:00:00' AS generated_at, coalesce(b.considered, []) AS considered
  FROM cas LEFT JOIN (SELECT case_id, list(DISTINCT document_id ORDER BY document_id) AS considered FROM dcas
    WHERE document_id % 3 <> 0 AND case_id % 2 = 0 GROUP BY case_id) b ON b.case_id = cas.id
), vis AS (
  SELECT d.* FROM doc d WHERE (d.visibility = 'private' AND d.owner_id = 3)
    OR (d.visibility = 'department' AND EXISTS (SELECT 1 FROM ddep b JOIN udep u USING (department_id) WHERE b.document_id = d.id AND u.user_id = 3))
)
"""


def sql(query: str) -> str:
    """DuckDB's SQL for a query over the archive tables."""
    return f"WITH RECURSIVE {CTES.strip()}\n{query}"
