"""Cutting texts into chunks of words that overlap."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

SIZE, OVERLAP = 500, 50
_HEADING = re.compile(r"#{1,6}[ \t]")
_ROW = re.compile(r"\|.+\|\s*\Z")
_RULE = re.compile(r"\|[\s:|-]*-{3,}[\s:|-]*\|\s*\Z")


def _check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, and overlap from 0 to less than size")


def chunk_text(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "id", text_col: str = "text_content") -> DataFrame:
    """(document_id, position, content): windows of `size` words, each beginning `overlap` words before the last one's end.

    Words are joined by one space, by a blank line where a paragraph begins. A blank text has no chunk. All in one
    projection: the words become one array, of which each window is a slice.
    """
    _check(size, overlap)
    paragraphs = F.split(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n\n")
    # A paragraph's first word brings its separator along; the first of a window loses it again.
    marked = F.flatten(F.transform(paragraphs, lambda p: F.transform(words(p), lambda w, i: F.concat(F.when(i == 0, F.lit("\n\n")).otherwise(F.lit(" ")), w))))
    n, step = F.size("u"), size - overlap
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int")))).otherwise(F.array().cast("array<int>"))
    cut = docs.select(F.col(id_col).alias("document_id"), marked.alias("u")).select("document_id", "u", F.explode(starts).alias("position"))
    joined = F.array_join(F.slice("u", F.col("position") * step + 1, size), "")
    return cut.select("document_id", "position", F.regexp_replace(joined, r"^(\n\n| )", "").alias("content"))


def _units(text: str) -> Iterator[str]:
    """Blocks between blank lines; headings alone wait for the block that follows them."""
    waiting: list[str] = []
    for block in text.replace("\r\n", "\n").split("\n\n"):
        if not block.strip():
            continue
        waiting.append(block)
        filled = [x for x in block.splitlines() if x.strip()]
        if len(filled) != 1 or not _HEADING.match(filled[0]):
            yield "\n\n".join(waiting)
            waiting = []
    if waiting:
        yield "\n\n".join(waiting)


def _fit(block: str, size: int) -> Iterator[str]:
    """The block in parts of at most `size` words: a table by its rows under its head again, others by words."""
    lines = [x for x in block.splitlines() if x.strip()]
    if len(block.split()) <= size:
        yield block
    elif not any(_ROW.match(x) for x in lines):
        every = block.split()
        yield from (" ".join(every[k : k + size]) for k in range(0, len(every), size))
    else:
        head = lines[:2] if len(lines) > 1 and _ROW.match(lines[0]) and _RULE.match(lines[1]) else []
        if len(lines) == len(head):
            yield block
            return
        fixed, rows, n = sum(len(x.split()) for x in head), [], 0
        for line in lines[len(head) :]:
            more = len(line.split())
            if rows and fixed + n + more > size:
                yield "\n".join(head + rows)
                rows, n = [], 0
            rows.append(line)
            n += more
        yield "\n".join(head + rows)


def split_markdown(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of whole blocks, as many as `size` words allow. A chunk begins with the last blocks of the one before that
    have at most `overlap` words together. Headings stay with their section, table rows stay whole."""
    _check(size, overlap)
    out: list[str] = []
    now: deque[tuple[str, int]] = deque()
    total = 0
    for part in (p for unit in _units(text or "") for p in _fit(unit, size)):
        n = len(part.split())
        if now and total + n > size:
            out.append("\n\n".join(p for p, _ in now))
            while now and total > overlap:
                total -= now.popleft()[1]
        now.append((part, n))
        total += n
    if now:
        out.append("\n\n".join(p for p, _ in now))
    return out


def chunk_markdown(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "id", text_col: str = "text_content") -> DataFrame:
    """(document_id, position, content) of markdown texts; what fits depends on what came before, so each text is one call."""
    _check(size, overlap)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, position, content = [], [], []
            for row, text in enumerate(b.column("text")):
                chunks = split_markdown(text.as_py(), size, overlap)
                at += [row] * len(chunks)
                position += range(len(chunks))
                content += chunks
            yield pa.record_batch([b.column("id").take(pa.array(at, pa.int64())), pa.array(position, pa.int32()), pa.array(content, pa.string())], ["document_id", "position", "content"])

    return narrow.mapInArrow(run, f"document_id {narrow.schema['id'].dataType.simpleString()}, position int, content string")


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of all documents, each by its `content_format`."""
    markdown = F.col("content_format") == "markdown"
    return chunk_text(docs.filter(~markdown), size, overlap).unionByName(chunk_markdown(docs.filter(markdown), size, overlap))


def replace_chunks(chunks: DataFrame, fresh: DataFrame, failed: DataFrame) -> DataFrame:
    """The chunk table after some documents were chunked again: theirs are replaced, those of failed ones stay."""
    done = fresh.select("document_id").distinct().join(failed, "document_id", "left_anti")
    return chunks.join(done, "document_id", "left_anti").unionByName(fresh.join(done, "document_id", "left_semi"), allowMissingColumns=True)
