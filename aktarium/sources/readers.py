"""Texts of files by their type: plain text and HTML, office documents, raw mail. Others need an adapter that is registered."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mail import html_to_text, own_text, parse_eml

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Larger parts of an archive aren't unpacked.
_MOST_BYTES = 64 << 20


def read_plain(content: bytes) -> str:
    return content.decode("utf-8", "replace")


def read_docx(content: bytes) -> str:
    """The paragraphs of an office document, tabs and breaks kept."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if z.getinfo("word/document.xml").file_size > _MOST_BYTES:
            raise ValueError("document.xml is too large")
        raw = z.read("word/document.xml")
    if re.search(rb"<!(DOCTYPE|ENTITY)", raw[:4096]):
        raise ValueError("document.xml declares entities")
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    parts = []
    for p in ElementTree.fromstring(raw).iter(f"{_W}p"):
        parts.append("".join(e.text or "" if e.tag == f"{_W}t" else marks.get(e.tag, "") for e in p.iter()))
    return "\n".join(parts)


def read_mail(content: bytes) -> str:
    """A mail's body, plain before HTML."""
    mail = parse_eml(content)
    if mail is None:
        raise ValueError("not a mail")
    return mail["plain"] or html_to_text(mail["html"] or "")


#: Type -> reader. Readers of scans and PDF need programs that aren't part of this package; add them here.
#: Of the types in MAIL only what their sender wrote is kept, without signatures and quoted mail.
MAIL = ("text/html", "message/rfc822")
READERS: dict[str, Callable[[bytes], str]] = {"text/plain": read_plain, "text/html": lambda c: html_to_text(read_plain(c)), DOCX: read_docx, "message/rfc822": read_mail}


def read_texts(files: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, text, error) of files (path, content, mime_type): a file that can't be read has the reason, and ends nothing."""
    known = dict(READERS if readers is None else readers)

    def one(content: bytes | None, kind: str | None) -> tuple[str | None, str | None]:
        if kind not in known:
            return None, f"no reader for {kind}"
        try:
            return known[kind](content or b""), None
        except Exception as e:  # noqa: BLE001  readers are plugged in, and any fault of theirs is the file's
            return None, f"{type(e).__name__}: {e}"[:200]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(c.as_py(), k.as_py()) for c, k in zip(b.column("content"), b.column("mime_type"), strict=True)]
            texts, errors = ([f[k] for f in found] for k in (0, 1))
            yield pa.record_batch([b.column("path"), b.column("mime_type"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "mime_type", "text", "error"])

    found = files.select("path", "content", "mime_type").mapInArrow(run, "path string, mime_type string, text string, error string")
    own = F.when(F.col("mime_type").isin(*MAIL) & F.col("text").isNotNull(), own_text(F.col("text"))).otherwise(F.col("text"))
    return found.select("path", own.alias("text"), "error")
