"""Values for the placeholders of letters, and tasks from templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(bindings: DataFrame, context: DataFrame) -> DataFrame:
    """Bindings (draft_id, key, source, required, manual) with `value` and `reason`.

    `context` has draft_id, namespace, name, value, and for a namespace that is there without names one row with a null name.
    A value by hand wins; then the value of `source` (namespace.name); else the value is '' and the reason says whether the
    namespace is missing or its value is empty.
    """
    namespace, name = F.substring_index("source", ".", 1), F.regexp_replace("source", r"^[^.]*\.?", "")
    b = bindings.withColumns({"namespace": namespace, "name": name})
    values = context.filter("name IS NOT NULL").groupBy("draft_id", "namespace", "name").agg(F.max("value").alias("found"))
    there = context.select("draft_id", "namespace").distinct().withColumn("has", F.lit(True))
    j = b.join(values, ["draft_id", "namespace", "name"], "left").join(there, ["draft_id", "namespace"], "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    value = F.when(~blank(F.col("manual")), F.col("manual")).when(~blank(F.col("found")), F.col("found")).otherwise("")
    reason = F.when(value != "", "").when(F.col("namespace") == "manual", "manual").when(F.col("has").isNull(), "missing_source").otherwise("empty_value")
    return j.select("draft_id", "key", "source", "required", value.alias("value"), reason.alias("reason"))


def missing_required(resolved: DataFrame) -> DataFrame:
    """Keys that are required and blank."""
    return resolved.filter(F.col("required") & (F.trim("value") == "")).select("draft_id", "key")


def task_from_template(templates: DataFrame, today: str, user_id: int) -> DataFrame:
    """Tasks of templates: due so many days from today, without an offset undated."""
    due = F.when(F.col("default_due_offset_days").isNotNull(), F.date_add(F.lit(today).cast("date"), F.col("default_due_offset_days").cast("int")))
    return templates.select(F.col("default_title").alias("title"), F.lit("offen").alias("status"), due.alias("due_date"), F.lit(user_id).cast("long").alias("owner_id"), "visibility")


def template_keys(drafted: DataFrame, known_sources: list[str], most: int = 12) -> DataFrame:
    """Drafted placeholders (template_id, key, source, position): each key once, the first, at most `most`; an unknown source is
    entered by hand."""
    from .ordering import top_of_each

    first = top_of_each(drafted, ["template_id", "key"], [F.col("position").asc()], 1)
    source = F.when(F.substring_index("source", ".", 1).isin(*known_sources), F.col("source")).otherwise("manual")
    return top_of_each(first.withColumn("source", source), ["template_id"], [F.col("position").asc()], most)


def recommendation_items(items: DataFrame, allowed: DataFrame, most: int = 8) -> DataFrame:
    """(run_id, position, title, sources) of what a model recommends: the first `most` with a title, their sources among the
    allowed documents (run_id, document_id), each once, in order."""
    from .ordering import top_of_each

    named = top_of_each(items.filter(F.trim(F.coalesce("title", F.lit(""))) != ""), ["run_id"], [F.col("position").asc()], most)
    told = named.select("run_id", "position", F.posexplode("sources").alias("n", "s")).withColumn("document_id", F.col("s").try_cast("long"))
    good = told.join(allowed.select("run_id", "document_id").distinct(), ["run_id", "document_id"], "left_semi")
    once = good.groupBy("run_id", "position", "document_id").agg(F.min("n").alias("n"))
    lists = once.groupBy("run_id", "position").agg(F.array_sort(F.collect_list(F.struct("n", "document_id"))).alias("l"))
    out = named.select("run_id", "position", "title").join(lists, ["run_id", "position"], "left")
    return out.select("run_id", "position", "title", F.coalesce(F.transform("l", lambda x: x["document_id"]), F.array().cast("array<long>")).alias("sources"))


def last_reply_json(reply: Column, schema: str) -> Column:
    """The object between a reply's first and last brace, by a schema; null where it can't be read."""
    return F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})


def without_trailing_commas(json: Column) -> Column:
    """JSON without commas between a value and the end of its object or list. Strings are passed over as a whole."""
    return F.regexp_replace(json, r'(?s)("(?:[^"\\]++|\\.)*+")|(?<=["\w}\]])\s*+,(?=\s*+[}\]])', "$1")


def reply_problem(reply: Column, truncated: Column, required: list[str]) -> Column:
    """Why a model's reply can't be used: empty, cut_off, no_object, broken, missing:<key>; null if it can. A comma before the
    end of an object or list does no harm."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    parsed = F.coalesce(F.try_parse_json(body), F.try_parse_json(without_trailing_commas(body)))
    out = F.lit(None).cast("string")
    for key in reversed(required):
        out = F.when(F.try_variant_get(parsed, f"$.{key}", "variant").isNull(), f"missing:{key}").otherwise(out)
    out = F.when(parsed.isNull(), "broken").otherwise(out)
    out = F.when(body == "", F.when(F.coalesce(truncated, F.lit(False)), "cut_off").otherwise("no_object")).otherwise(out)
    return F.when(F.trim(F.coalesce(reply, F.lit(""))) == "", "empty").otherwise(out)
