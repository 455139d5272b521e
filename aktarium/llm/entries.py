"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import edit_embedding, licenses, line_dedup, media, merkle, mixing, one_bit_ann, packing, pii, quality, simhash, token_counts, vector_codes
from .common import P, tuned, word_count


def word_vocabulary() -> str:
    """The tokenizers file that the queries count and pack with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias(P + "size"))
    return mixing.mix(docs, size=P + "size").select("doc_id", "size", "source_size", "target", "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_model(docs, table(spark, sf_dir, "labels"), label="quality")
    scored = quality.score_documents(docs, model, threshold=0.7)
    return scored.select("doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(tuned(spark), sf_dir, "documents"), word_vocabulary(), end_id=1, capacity=2048)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(tuned(spark), sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(tuned(spark), sf_dir, "documents"), distance=3, size=3, seed=42)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(tuned(spark), sf_dir, "documents").select("doc_id", "text"), least=10)
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.to_media(table(tuned(spark), sf_dir, "documents"))
    return media.read_media(stored).drop("error")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(tuned(spark), sf_dir, "documents"), word_vocabulary(), limit=2048)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(tuned(spark), sf_dir, "documents")))


def op10_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = one_bit_ann.build_index(table(spark, sf_dir, "embeddings"))
    return one_bit_ann.search(index, index.filter(F.col("id") % 20 == 0), k=20)


def op11_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edit_embedding.edit_fingerprints(table(spark, sf_dir, "documents"))
    return found.withColumns({c: edit_embedding.hexed(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", vector_codes.code_text(F.col("codes")).alias("code"), "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    row = lambda n_chars: merkle.digest(*(merkle.encoded(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))))
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    # As a decimal, so that adding to the largest long doesn't fail.
    leaves = docs.select("doc_id", "lang", row(F.col("n_chars")).alias("leaf"), F.when(hit, row(F.col("n_chars").cast("decimal(20,0)") + 1)).alias("tampered"))
    proven = merkle.manifest(leaves, group="lang", order="doc_id", leaf="leaf", keep=["doc_id", "tampered"])
    proven = proven.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))).withColumn("proof_sha256", merkle.digest(merkle.siblings(F.col("path"))))
    return proven.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_licenses": op4_licenses,
    "op5_simhash": op5_simhash,
    "op6_line_dedup": op6_line_dedup,
    "op7_media": op7_media,
    "op8_token_counts": op8_token_counts,
    "op9_pii": op9_pii,
    "op10_one_bit_ann": op10_one_bit_ann,
    "op11_edit_embedding": op11_edit_embedding,
    "op12_vector_codes": op12_vector_codes,
    "op13_merkle": op13_merkle,
}

ORACLES = {
    "op10_one_bit_ann": one_bit_ann.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op1_mixing": mixing.oracle(),
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
