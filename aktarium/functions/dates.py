"""Dates: lenient parsing, kinds of date, weeks, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of date in the order in which one is chosen, and the kind that each name stands for.
DATE_PRIORITY = ("belegdatum", "zeitraum_ende", "briefkopf", "modell", "erstellt")
PERIOD_START = "zeitraum_beginn"
DATE_KINDS = {
    "belegdatum": "belegdatum",
    "beleg": "belegdatum",
    "rechnungsdatum": "belegdatum",
    "rechnung": "belegdatum",
    "bescheiddatum": "belegdatum",
    "bescheid": "belegdatum",
    "dokumentdatum": "belegdatum",
    "vertragsdatum": "belegdatum",
    "quittungsdatum": "belegdatum",
    "zeitraum_beginn": "zeitraum_beginn",
    "zeitraumbeginn": "zeitraum_beginn",
    "zeitraum_von": "zeitraum_beginn",
    "periode_beginn": "zeitraum_beginn",
    "leistungszeitraum_beginn": "zeitraum_beginn",
    "abrechnungszeitraum_beginn": "zeitraum_beginn",
    "zeitraum_ende": "zeitraum_ende",
    "zeitraumende": "zeitraum_ende",
    "zeitraum_bis": "zeitraum_ende",
    "periode_ende": "zeitraum_ende",
    "leistungszeitraum_ende": "zeitraum_ende",
    "abrechnungszeitraum_ende": "zeitraum_ende",
    "briefkopf": "briefkopf",
    "briefkopfdatum": "briefkopf",
    "briefdatum": "briefkopf",
    "schreiben_vom": "briefkopf",
    "erstellt": "erstellt",
    "erstellt_am": "erstellt",
    "erstelldatum": "erstellt",
    "druckdatum": "erstellt",
    "gedruckt": "erstellt",
    "gedruckt_am": "erstellt",
    "ausgedruckt": "erstellt",
    "ausgedruckt_am": "erstellt",
    "abrufdatum": "erstellt",
    "abgerufen_am": "erstellt",
    "stand": "erstellt",
}


def parse_iso_date(text: Column) -> Column:
    """A date written as yyyy-MM-dd, with white space around it allowed; else null."""
    clean = F.trim(text)
    return F.when(clean.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(clean, "yyyy-MM-dd"))


def parse_date(text: Column) -> Column:
    """A date written as yyyy-MM-dd or day first with dots; else null."""
    clean = F.trim(text)
    day_first = F.when(clean.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"), F.try_to_date(clean, "d.M.yyyy"))
    return F.coalesce(parse_iso_date(text), day_first)


def date_kind(name: Column) -> Column:
    """The kind that a name stands for, once its letters are lower and all between them is one underscore; else null."""
    key = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in DATE_KINDS.items() for x in pair)), key)


def week_end(day: Column) -> Column:
    """The Sunday of a day's week."""
    return F.date_add(day, F.lit(6) - F.weekday(day))


def is_near(a: Column, b: Column, tolerance: int = 1) -> Column:
    return F.abs(F.datediff(a, b)) <= tolerance


def follow_up_bucket(date: Column, today: str) -> Column:
    """overdue, today, this_week or later; null without a date."""
    day = F.lit(today).cast("date")
    return F.when(date < day, "overdue").when(date == day, "today").when(date <= week_end(day), "this_week").when(date > day, "later")


def month_label(date: Column) -> Column:
    """Year and month, by which the timeline is grouped."""
    return F.date_format(date, "yyyy-MM")


def period_label(start: Column, end: Column) -> Column:
    """'from – to' with whichever ends are known, day first."""
    said = lambda d: F.date_format(d, "dd.MM.yyyy")
    return (
        F.when(start.isNotNull() & end.isNotNull(), F.concat(said(start), F.lit(" – "), said(end)))
        .when(start.isNotNull(), F.concat(F.lit("ab "), said(start)))
        .when(end.isNotNull(), F.concat(F.lit("bis "), said(end)))
        .otherwise("")
    )
