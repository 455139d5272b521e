"""Dates, direction, sphere, tax relevance and contacts, from what an analysis found and from what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DATE_PRIORITY, PERIOD_START, is_near
from ..functions.text import split_tag
from ..schema import DIRECTION, SPHERE, TAX_RELEVANCE, one_of
from .ordering import first_of_each


def date_candidates(candidates: DataFrame) -> DataFrame:
    """One date per document and kind: the latest end of a period, of other kinds the first mention. With its `rank`.

    `candidates` has document_id, kind, date, position. The begin of a period never dates a document.
    """
    rank = F.array_position(F.array(*map(F.lit, DATE_PRIORITY)), F.col("kind"))
    known = candidates.filter(F.col("kind").isin(*DATE_PRIORITY) & F.col("date").isNotNull())
    both = known.groupBy("document_id", "kind").agg(F.max("date").alias("late"), F.min_by("date", "position").alias("first"))
    return both.select("document_id", "kind", F.when(F.col("kind") == "zeitraum_ende", F.col("late")).otherwise(F.col("first")).alias("date"), rank.alias("rank"))


def resolve_dates(candidates: DataFrame, uploads: DataFrame, tolerance: int = 1) -> DataFrame:
    """(document_id, document_date, kind, upload_conflict) of each document in `uploads` (document_id, uploaded_on).

    The kind that comes first dates the document. If that date is the day of the upload, within the tolerance, the first
    later kind that isn't near it wins, and that is marked.
    """
    one = date_candidates(candidates).join(uploads, "document_id")
    near = F.coalesce(is_near(F.col("date"), F.col("uploaded_on"), tolerance), F.lit(False))
    row = F.struct("rank", "date", "kind")
    best = one.groupBy("document_id").agg(F.min(row).alias("best"), F.min_by(near, "rank").alias("best_near"), F.min(F.when(~near, row)).alias("other"))
    conflict = F.col("best_near") & F.col("other").isNotNull()
    won = F.when(conflict, F.col("other")).otherwise(F.col("best"))
    found = best.select("document_id", won["date"].alias("document_date"), won["kind"].alias("kind"), conflict.alias("upload_conflict"))
    out = uploads.select("document_id").join(found, "document_id", "left")
    return out.withColumns({"kind": F.coalesce("kind", F.lit("")), "upload_conflict": F.coalesce("upload_conflict", F.lit(False))})


def period_bounds(candidates: DataFrame) -> DataFrame:
    """Each document's outermost period: its earliest begin and latest end."""
    start, end = (F.when(F.col("kind") == k, F.col("date")) for k in (PERIOD_START, "zeitraum_ende"))
    return candidates.groupBy("document_id").agg(F.min(start).alias("period_start"), F.max(end).alias("period_end"))


def may_set_date(date: Column, source: Column) -> Column:
    """An analysis may date a document that has no date, or one from an analysis; not one by hand or of unknown source."""
    return date.isNull() | F.coalesce(source.isin(*DATE_PRIORITY, PERIOD_START), F.lit(False))


def direction(sender_is_self: Column, recipient_is_self: Column, told: Column) -> Column:
    """By whose side is one's own; else what the analysis says."""
    mine, theirs = F.coalesce(sender_is_self, F.lit(False)), F.coalesce(recipient_is_self, F.lit(False))
    return F.when(mine & theirs, "intern").when(theirs, "eingang").when(mine, "ausgang").otherwise(one_of(told, DIRECTION, "unbekannt"))


def sphere(sides: list[tuple[Column, Column, Column]], told: Column) -> Column:
    """Business if an own side (is_self, is_own_business, vat_id) is one's business or has a VAT id, private if another own
    side is there; else what the analysis says."""
    own, business = F.lit(False), F.lit(False)
    for is_self, is_business, vat_id in sides:
        mine = F.coalesce(is_self, F.lit(False))
        own = own | mine
        business = business | (mine & (F.coalesce(is_business, F.lit(False)) | (F.coalesce(vat_id, F.lit("")) != "")))
    return F.when(business, "geschaeftlich").when(own, "privat").otherwise(one_of(told, SPHERE, "unbekannt"))


def tax_relevance(sphere_value: Column, told: Column, reason: Column) -> tuple[Column, Column]:
    """(relevance, reason): what is business isn't relevant to the personal tax return."""
    business = sphere_value == "geschaeftlich"
    return F.when(business, "nicht_zutreffend").otherwise(one_of(told, TAX_RELEVANCE, "unbekannt")), F.when(business, "").otherwise(F.coalesce(reason, F.lit("")))


def counterpart(direction_value: Column, sender: Column, recipient: Column) -> Column:
    """The contact of a document that has none: of outgoing ones the recipient, of internal ones nobody, else the sender."""
    return F.when(direction_value == "ausgang", recipient).when(direction_value != "intern", sender)


def find_contacts(parties: DataFrame, contacts: DataFrame) -> DataFrame:
    """(party, contact) for each party (party, vat_id, iban, tax_number, email, name).

    Tried in turn: VAT id, IBAN (without spaces, upper case), tax number, email, name; of several contacts the first by
    name. An email that is given but unknown ends the search: the name isn't tried.
    """
    bare = lambda c: F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", ""))
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    keys = [("vat_id", bare), ("iban", bare), ("tax_number", lambda c: F.trim(F.coalesce(c, F.lit("")))), ("email", low), ("name", low)]
    out = parties.withColumns({f"_{c}": key(F.col(c)) for c, key in keys})
    for column, key in keys:
        known = contacts.select(key(F.col(column)).alias(f"_{column}"), F.col("name").alias(f"_by_{column}")).filter(F.col(f"_{column}") != "")
        known = known.groupBy(f"_{column}").agg(F.min(f"_by_{column}").alias(f"_by_{column}"))
        out = out.join(known, f"_{column}", "left")
    ids = F.coalesce("_by_vat_id", "_by_iban", "_by_tax_number")
    rest = F.when(F.col("_email") != "", F.col("_by_email")).otherwise(F.col("_by_name"))
    return out.select("party", F.coalesce(ids, rest).alias("contact"))


def new_contact_name(name: Column, email: Column, taken: Column) -> Column:
    """The name of a contact that is created; one that is taken gets the email behind it."""
    return F.when(taken, F.concat(name, F.lit(" <"), email, F.lit(">"))).otherwise(name)


def replace_suggestions(existing: DataFrame, found: DataFrame) -> DataFrame:
    """A document's suggestions after an analysis: decided ones stay, pending ones are replaced.

    New ones (document_id, name, dimension, confidence, position) are told apart by name alone, whatever its case; a name
    that was decided isn't suggested again. A dimension crammed into the name is taken apart first.
    """
    decided = existing.filter("status <> 'pending'")
    name, dimension = split_tag(F.col("name"), F.coalesce("dimension", F.lit("")))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))))
    fresh = found.withColumns({"_n": name, "_d": dimension}).select("document_id", F.col("_n").alias("name"), F.col("_d").alias("dimension"), sure.alias("confidence"), "position")
    fresh = fresh.filter("name <> ''").withColumn("_key", F.lower("name"))
    fresh = fresh.join(decided.select("document_id", F.lower("name").alias("_key")).distinct(), ["document_id", "_key"], "left_anti")
    fresh = first_of_each(fresh, ["document_id", "_key"], [F.col("position").asc()]).withColumn("status", F.lit("pending"))
    columns = ["document_id", "name", "dimension", "confidence", "status"]
    return decided.select(*columns).unionByName(fresh.select(*columns))


def apply_decisions(suggestions: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(suggestions, new tags): pending ones get their decision (id, accepted); an accepted one tags its document."""
    joined = suggestions.join(decisions, "id", "left")
    status = F.when(F.col("status") != "pending", F.col("status")).when(F.col("accepted"), "accepted").when(~F.col("accepted"), "rejected").otherwise(F.col("status"))
    tags = joined.filter("status = 'pending' AND accepted").select("document_id", "name", "dimension").distinct()
    return joined.withColumn("status", status).drop("accepted"), tags


def edit_metadata(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents (id, document_date, date_source, sphere, sphere_by, tax_relevance, tax_reason, tax_by) after edits by hand.

    `edits` has id, and new_date, clear_date, new_sphere, new_tax (null: unchanged). A date by hand is marked so, clearing
    it clears the mark; an edited sphere or relevance loses the mark of the analysis, another relevance its reason.
    """
    j = docs.join(edits, "id", "left")
    clear = F.coalesce("clear_date", F.lit(False))
    dated, sphered, taxed = F.col("new_date").isNotNull(), F.col("new_sphere").isNotNull(), F.col("new_tax").isNotNull()
    other_tax = taxed & (F.col("new_tax") != F.col("tax_relevance"))
    values = {
        "document_date": F.when(clear, F.lit(None)).otherwise(F.coalesce("new_date", "document_date")),
        "date_source": F.when(clear, F.lit(None)).when(dated, "manuell").otherwise(F.col("date_source")),
        "sphere": F.coalesce("new_sphere", "sphere"),
        "sphere_by": F.when(sphered, F.lit(None)).otherwise(F.col("sphere_by")),
        "tax_relevance": F.coalesce("new_tax", "tax_relevance"),
        "tax_reason": F.when(other_tax, "").otherwise(F.col("tax_reason")),
        "tax_by": F.when(taxed, F.lit(None)).otherwise(F.col("tax_by")),
    }
    return j.select("id", *(v.alias(k) for k, v in values.items()))


def reviewed_or_ready(before: Column) -> Column:
    """The status after processing again: what was reviewed stays so."""
    return F.when(before == "reviewed", "reviewed").otherwise("ready")

