"""Texts of letters: closing phrases that the layout already has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LINE_END, let, strip, strip_end

# How a letter's last lines begin, in lower case, and what repeats the layout's closing as a signature's first line.
CLOSING = "mit freundlichen gr(ü|ue)ssen|mit freundlichen gr(ü|u)ßen|freundliche gr(ü|ue|u)(ss|ß)e|hochachtungsvoll|beste gr(ü|ue|u)(ss|ß)e|viele gr(ü|ue|u)(ss|ß)e"
SIGNATURE_CLOSING = "mit freundlichen gr(ü|ue)(ss|ß)en|freundliche gr(ü|ue)(ss|ß)e|hochachtungsvoll|beste gr(ü|ue)(ss|ß)e|viele gr(ü|ue)(ss|ß)e"
#: So many lines at the end are searched for a closing, and the last filled line before them.
LAST_LINES = 4


def _said(line: Column) -> Column:
    return F.rtrim(F.lower(strip(line)), F.lit(","))


def strip_closing(text: Column, closing: Column | None = None) -> Column:
    """The text without a closing phrase near its end and all that follows; a phrase further up is part of the text.

    Near is: in the last four lines, or the last filled line before these. So empty lines between the closing and a name of
    several lines don't hide it. `closing` is a phrase of the layout's own, compared as a whole line.
    """
    own = F.rtrim(F.lower(strip(F.coalesce(closing, F.lit("")))), F.lit(",")) if closing is not None else F.lit("")
    whole = strip_end(F.coalesce(text, F.lit("")))
    # Of each line: 0 if it's empty, 2 if it closes the letter, else 1.
    kind = lambda said: F.when(said == "", 0).when(said.rlike(rf"(?U)^(?:{CLOSING})\b") | ((own != "") & (said == own)), 2).otherwise(1)

    def last(kinds: Column, counts) -> Column:
        return F.array_max(F.transform(kinds, lambda k, i: F.when(counts(k, i), i)))

    def cut(kinds: Column) -> Column:
        end = F.size(kinds) - LAST_LINES
        near = lambda before: last(kinds, lambda k, i: (k == 2) & ((i >= end) | (i == before)))
        return let(F.coalesce(last(kinds, lambda k, i: (k > 0) & (i < end)), F.lit(-1)), near)

    def kept(lines: Column) -> Column:
        at = let(F.transform(lines, lambda x: let(_said(x), kind)), cut)
        return let(at, lambda n: F.when(n.isNotNull(), strip_end(F.array_join(F.slice(lines, 1, n), "\n"))))

    return F.coalesce(let(F.split(whole, LINE_END), kept), whole)


def strip_first_closing(signature: Column) -> Column:
    """A signature without a closing phrase as its first line, and without the empty lines behind it."""
    text = F.regexp_replace(F.coalesce(signature, F.lit("")), r"^\n+|\n+$", "")
    closes = let(F.get(F.split(text, "\n"), F.lit(0)), lambda x: F.lower(F.rtrim(strip(x), F.lit(","))).rlike(f"^(?:{SIGNATURE_CLOSING})$"))
    return strip(F.when(closes, F.regexp_replace(text, r"^[^\n]*\n?", "")).otherwise(text))
