"""Plausibility of texts and tables that a model has read from images."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digits
from .aggregates import majority

# Words that mark a column of units, the distance within which a row's numbers belong together, and the
# characters shown around a number.
UNIT_WORDS, WINDOW, AROUND = ("einheit", "unit"), 80, 25
NUMBER = re.compile(r"\d[\d.,/]*\d")
_LINE = re.compile(r"\|(.+)\|\s*")
_RULE_CELL = re.compile(r":?-{3,}:?")

TABLES = "array<struct<header array<string>, rows array<array<string>>>>"


def parse_tables(markdown: str | None) -> list[dict]:
    """Pipe tables: a head, a rule, rows until another line comes. Empty cells stay, so no value takes another's place."""
    cells = []
    for line in (markdown or "").splitlines():
        m = _LINE.fullmatch(line.strip())
        cells.append([c.strip() for c in m[1].split("|")] if m else None)
    is_rule = [c is not None and all(_RULE_CELL.fullmatch(x) for x in c if x) for c in cells]
    out, k = [], 0
    while k + 1 < len(cells):
        if cells[k] is None or not is_rule[k + 1]:
            k += 1
            continue
        end = next((e for e in range(k + 2, len(cells)) if cells[e] is None), len(cells))
        out.append({"header": cells[k], "rows": cells[k + 2 : end]})
        k = end
    return out


def tables_of(docs: DataFrame, id_col: str = "id", text_col: str = "markdown") -> DataFrame:
    """(id, tables) of markdown texts."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("header", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("id"), pa.array([parse_tables(t.as_py()) for t in b.column("text")], kind)], ["id", "tables"])

    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, tables {TABLES}")


def _label(row: Column) -> Column:
    filled = F.array_join(F.filter(row, lambda c: c != ""), " | ")
    return F.when(F.get(row, F.lit(0)) != "", F.get(row, F.lit(0))).when(filled != "", filled).otherwise("(leere Zeile)")


def unit_outliers(tables: DataFrame) -> DataFrame:
    """Rows (id, table, row, unit, expected) whose unit isn't that of most rows of their table.

    A table counts that has a column of units, two of them at least, and one that two rows or more share but not all.
    """
    t = tables.select("id", F.posexplode("tables").alias("table", "t"))
    hits = F.transform(F.col("t")["header"], lambda h: F.lower(h).contains(UNIT_WORDS[0]) | F.lower(h).contains(UNIT_WORDS[1]))
    t = t.withColumn("at", F.array_position(hits, True)).filter("at > 0")
    rows = t.select("id", "table", "at", F.posexplode(F.col("t")["rows"]).alias("n", "row")).withColumn("unit", F.get("row", F.col("at").cast("int") - 1)).filter("unit <> ''")
    most = majority(rows, ["id", "table"], "unit", "n").select("id", "table", F.col("unit").alias("expected"), F.col("n").alias("n_most"))
    totals = rows.groupBy("id", "table").agg(F.count(F.lit(1)).alias("n_all"))
    judged = most.join(totals, ["id", "table"]).filter("n_all >= 2 AND n_most >= 2 AND n_most < n_all")
    out = rows.join(judged, ["id", "table"]).filter("unit <> expected")
    return out.select("id", "table", F.col("n").alias("row_number"), _label(F.col("row")).alias("row"), "unit", "expected")


def row_shifts(tables: DataFrame, references: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (id, table, row_number, row, numbers) whose numbers are all in the reference text (id, reference) but nowhere close.

    A row has two numbers of two digits at least. Whether all are within `window` characters somewhere is seen by walking
    over their places in order; no combination of places is built.
    """
    t = tables.join(references, "id").select("id", "tables", "reference")

    def close(places: list[list[int]]) -> bool:
        events = sorted((p, k) for k, ps in enumerate(places) for p in ps)
        last = [-1] * len(places)
        for p, k in events:
            last[k] = p
            if min(last) >= 0 and p - min(last) <= window:
                return True
        return False

    def bare(token: str) -> str:
        return re.sub(r"\D", "", token)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row_id, tabs, ref in zip(*(b.column(c).to_pylist() for c in ("id", "tables", "reference")), strict=True):
                at: dict[str, list[int]] = {}
                for m in NUMBER.finditer(ref or ""):
                    at.setdefault(bare(m[0]), []).append(m.start())
                for k, tab in enumerate(tabs or []):
                    for n, row in enumerate(tab["rows"]):
                        numbers = [x for x in NUMBER.findall(" | ".join(row)) if len(bare(x)) >= 2]
                        places = [at.get(bare(x), []) for x in numbers]
                        if len(numbers) >= 2 and all(places) and not close(places):
                            around = [ref[max(0, p[0] - AROUND) : p[0] + AROUND].strip() for p in places]
                            label = row[0] if row and row[0] else " | ".join(c for c in row if c) or "(leere Zeile)"
                            out.append({"id": row_id, "table": k, "row_number": n, "row": label, "numbers": numbers, "snippets": around})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("id", b.schema.field("id").type), ("table", pa.int32()), ("row_number", pa.int32()), ("row", pa.string()), ("numbers", pa.list_(pa.string())), ("snippets", pa.list_(pa.string()))]))

    kind = t.schema["id"].dataType.simpleString()
    return t.mapInArrow(run, f"id {kind}, table int, row_number int, row string, numbers array<string>, snippets array<string>")


def extraction(layer: Column, ocr: Column, confidence: Column, vision: Column, enough: int = 20, sure: float = 60.0) -> tuple[Column, Column]:
    """(text, method) of a page: the text layer if it has enough characters, else OCR that is sure enough, else vision."""
    long_enough = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) >= enough
    by_ocr = long_enough(ocr) & (F.coalesce(confidence, F.lit(0.0)) >= sure)
    return F.when(long_enough(layer), layer).when(by_ocr, ocr).otherwise(vision), F.when(long_enough(layer), "text_layer").when(by_ocr, "ocr").otherwise("vision")


def same_digits(a: Column, b: Column) -> Column:
    return digits(a) == digits(b)
