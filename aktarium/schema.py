"""Declared schemas of the archive tables, and the fixed values of their enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCUMENT = (
    "id long, title string, kind string, correspondent string, visibility string, owner_id long, parent_id long, "
    "processing_status string, action_status string, direction string, sphere string, tax_relevance string, "
    "document_date date, created_at timestamp_ntz, updated_at timestamp_ntz, text_content string, metadata string, lang string"
)
CHUNK = "id long, document_id long, position int, content string, embedding array<float>, embedding_model string, embedding_model_version string"
COMMENT = "id long, document_id long, body string, author_id long, follow_up_date date, remind boolean, reminded_at timestamp_ntz, created_at timestamp_ntz"
REFERENCE = "id long, document_id long, type string, value_raw string, value_normalized string, role string, source string"
OWNER_REFERENCE = "owner_id long, type string, value_raw string, value_normalized string, source string, learned_from long"
LINK = "document_a long, document_b long, note string"
TASK = "id long, title string, status string, due_date date, owner_id long, visibility string, created_at timestamp_ntz"

# Fixed values of the data model.
VISIBILITY = ("department", "private")
PENDING = ("pending", "extracting", "analyzing", "embedding")
COMPLETE = ("ready", "reviewed")
FAILED = "failed"
ACTION_STATUS = ("keine", "offen", "erledigt")
DIRECTION = ("eingang", "ausgang", "intern", "unbekannt")
SPHERE = ("geschaeftlich", "privat", "unbekannt")
TAX_RELEVANCE = ("ja", "nein", "vielleicht", "nicht_zutreffend", "unbekannt")
TAX_DEDUCTIBLE_FILTER, TAX_DEDUCTIBLE = "absetzbar", ("ja", "vielleicht")
EXTRACTION_RANK = ("text_layer", "ocr", "vision")
CASE_REFERENCES = ("aktenzeichen", "forderungsnummer", "vertragsnummer", "belegnummer", "rechnungsnummer")
CONTACT_REFERENCES = ("kundennummer", "iban")
OTHER_REFERENCES = ("ihr_zeichen", "unser_zeichen", "sonstige")
STRONG_REFERENCES = ("aktenzeichen", "iban")
REFERENCE_ROLES = ("deins", "deren")


def one_of(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """The trimmed, lower-case value if it's an allowed one, else `default`."""
    clean = F.lower(F.trim(value))
    return F.when(clean.isin(*allowed), clean).otherwise(F.lit(default))
