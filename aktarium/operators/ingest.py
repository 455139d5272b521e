"""Taking in files and mails: hashes, duplicates, types, upload rules, the first status of a document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extension, sniff_mime
from .ordering import first_of_each

EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "docx", "txt", "eml")
MOST_BYTES = 25 * 1024 * 1024


def described(files: DataFrame) -> DataFrame:
    """Files (path, content, declared_type) with sha256, size, name and mime_type; the content isn't carried on."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.select(
        "path", name.alias("name"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"),
        sniff_mime(F.col("content"), name, F.col("declared_type")).alias("mime_type"),
    )


def dedup(incoming: DataFrame, known: DataFrame, order: Sequence[str] = ("path",), key: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """(new, repeated): of each hash that isn't known the first row is new; all others repeat something.

    Hashes are shuffled, not contents. `repeated` has `first_known`: whether the archive has the hash already.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    marked = incoming.withColumn("_p", place).join(known.select(key).distinct().withColumn("first_known", F.lit(True)), key, "left")
    marked = marked.withColumn("first_known", F.coalesce("first_known", F.lit(False)))
    new = marked.filter((F.col("_p") == 1) & ~F.col("first_known")).drop("_p", "first_known")
    return new, marked.filter((F.col("_p") > 1) | F.col("first_known")).drop("_p")


def occurrences(repeated: DataFrame, key: str = "sha256") -> DataFrame:
    """For each hash where it was met again, for the policy that links duplicates: (hash, paths in order)."""
    return repeated.groupBy(key).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def new_documents(new: DataFrame, source: str, user_id: int | None = None, has_departments: bool = True) -> DataFrame:
    """Documents of new files, to be processed: a user without departments keeps them private."""
    metadata = F.to_json(F.struct(F.col("name").alias("original_filename"), "mime_type", "size"))
    return new.select(
        F.regexp_replace("name", r"\.[^.]*$", "").alias("title"), F.lit("document").alias("kind"), F.lit(source).alias("source"),
        F.lit("department" if has_departments else "private").alias("visibility"), F.lit(user_id).cast("long").alias("owner_id"),
        F.lit("pending").alias("processing_status"), "sha256", metadata.alias("metadata"),
    )


def upload_status(files: DataFrame, known: DataFrame) -> DataFrame:
    """Each uploaded file's outcome: ok, duplicate, or why it's refused (extension, too_large)."""
    allowed = extension(F.col("name")).isin(*EXTENSIONS)
    kept = files.withColumn("_bad", F.when(~allowed, "extension").when(F.col("size") > MOST_BYTES, "too_large"))
    place = F.row_number().over(Window.partitionBy("sha256", F.col("_bad").isNull()).orderBy("path"))
    kept = kept.withColumn("_p", place).join(known.select("sha256").distinct().withColumn("_k", F.lit(True)), "sha256", "left")
    status = F.when(F.col("_bad").isNotNull(), F.col("_bad")).when(F.col("_k") | (F.col("_p") > 1), "duplicate").otherwise("ok")
    return kept.select("path", "sha256", status.alias("status"))


def new_mails(mails: DataFrame, docs: DataFrame) -> DataFrame:
    """Mails (message_id, sha256, ...) that no root document of any kind holds: by Message-ID, then by hash, first wins."""
    held = docs.filter("parent_id IS NULL").select(F.get_json_object("metadata", "$.message_id").alias("message_id")).filter("message_id IS NOT NULL").distinct()
    with_id, without = mails.filter("message_id <> ''"), mails.filter("message_id = '' OR message_id IS NULL")
    fresh = first_of_each(with_id.join(held, "message_id", "left_anti"), ["message_id"], [F.col("path").asc()])
    return first_of_each(fresh.unionByName(without), ["sha256"], [F.col("path").asc()])


def mail_documents(mails: DataFrame, own_addresses: DataFrame) -> DataFrame:
    """Root documents of mails: outgoing if the sender is one's own, dated by the mail, ready at once without a body.

    `mails` has message_id, subject, sender, sent_at, text, has_substance; `own_addresses` has email.
    """
    own = own_addresses.select(F.lower("email").alias("sender")).distinct().withColumn("_own", F.lit(True))
    j = mails.join(own, "sender", "left")
    return j.select(
        "message_id", F.when(F.trim("subject") != "", F.col("subject")).otherwise(F.concat(F.lit("Mail von "), F.col("sender"))).alias("title"), F.lit("mail_body").alias("kind"),
        F.when(F.col("_own"), "ausgang").otherwise("eingang").alias("direction"), F.to_date("sent_at").alias("document_date"),
        F.when(F.col("has_substance"), F.col("text")).otherwise("").alias("text_content"), F.when(F.col("has_substance"), "pending").otherwise("ready").alias("processing_status"),
    )


def upsert(existing: DataFrame, rows: DataFrame, keys: Sequence[str], keep_existing: bool = False) -> DataFrame:
    """`existing` with `rows` written over it by key: added where new; where known updated, or left as they are.

    Of several incoming rows with one key the last by all columns counts.
    """
    rest = [c for c in existing.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_v")).select(*keys, "_v.*").select(*existing.columns) if rest else rows.select(*keys).distinct()
    if keep_existing:
        return existing.unionByName(one.join(existing.select(*keys), list(keys), "left_anti"))
    return existing.join(one.select(*keys), list(keys), "left_anti").unionByName(one)
