"""Scalar functions over text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's split() has it, and what ends a line there.
WIDE_SPACE = r"[\s\x1c-\x1f\u0085\p{Z}]+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, where the value is computed once however often it's used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"^{WIDE_SPACE}|{WIDE_SPACE}$", "")


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, rf"{WIDE_SPACE}$", "")


def strip_controls(text: Column) -> Column:
    """Without the control characters that no store keeps; tab, line feed and carriage return stay."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, WIDE_SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def preview(text: Column, content_format: Column, limit: int = 5000) -> Column:
    """The first characters of plain text; markdown is never cut."""
    return F.when(content_format == "markdown", text).otherwise(F.substring(text, 1, limit))


def number_tokens(text: Column) -> Column:
    """Numbers of at least three digits as written: runs of digits with dots, commas or slashes inside."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9][0-9.,/]*[0-9])"), 1)
    return F.filter(found, lambda t: F.length(digits(t)) >= 3)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def unmatched_numbers(candidate: Column, reference: Column) -> Column:
    """Numbers of `candidate` whose digits `reference` hasn't as a number: first spelling, in order, each once."""
    known = F.transform(number_tokens(reference), digits)
    mine = number_tokens(candidate)
    keys = F.transform(mine, digits)
    fresh = lambda t, i: (F.array_position(keys, digits(t)) == i + 1) & ~F.array_contains(known, digits(t))
    return F.filter(mine, fresh)


def hash_bucket(text: Column, buckets: int = 8) -> Column:
    """A stable bucket by MD5 (a power of two up to 16 of them); blank has none."""
    last = F.conv(F.right(F.md5(text), F.lit(1)), 16, 10).cast("int")
    return F.when(F.trim(text) != "", last % buckets)


def split_tag(name: Column, dimension: Column) -> tuple[Column, Column]:
    """(name, dimension): 'Dimension:Value' in the name fills an empty dimension; one that is there wins."""
    at = F.instr(name, ":")
    crammed = (at > 0) & (F.trim(dimension) == "")
    value, found = F.trim(F.substr(name, at + 1)), F.trim(F.substr(name, F.lit(1), at - 1))
    sound = crammed & (value != "") & (found != "")
    return F.when(sound, value).otherwise(F.trim(name)), F.when(sound, found).otherwise(F.trim(dimension))


def strip_code_fence(text: Column) -> Column:
    """The inside of a fence that wraps the whole text, without white space at its ends; other texts as they are. The fence's
    lines are the first, whatever follows the ticks there, and the last, with nothing but ticks."""
    fence = r"(?s)\A```[^\n]*\n(.*)\n```\z"
    return let(strip(text), lambda x: F.when(x.rlike(fence), strip(F.regexp_extract(x, fence, 1))).otherwise(text))


def lenient_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "ja", "yes", "1", "pflicht"), F.lit(False))


def one_line(*parts: Column) -> Column:
    """The parts that say something, on one line, dots between them; line ends inside become the same dots."""
    clean = F.transform(F.flatten(F.array(*(F.split(F.coalesce(p, F.lit("")), "\n") for p in parts))), lambda x: F.trim(x))
    return F.array_join(F.filter(clean, lambda x: x != ""), " · ")


def safe_file_name(name: Column, limit: int = 80) -> Column:
    return F.substring(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}_. -]", "_")), 1, limit)


def part_name(name: Column, part: Column, parts: Column) -> Column:
    """'stem-teil-n.ext' of a file cut into several parts."""
    stem, dot = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return F.when(parts > 1, F.concat(stem, F.lit("-teil-"), part.cast("string"), dot)).otherwise(name)


def fill_placeholders(text: Column, values: dict[str, Column]) -> Column:
    """`{{key}}` replaced by its value; a blank value or an unknown key stays as it is."""
    for key, value in values.items():
        mark = F.lit("{{" + key + "}}")
        text = F.when(F.trim(F.coalesce(value, F.lit(""))) != "", F.replace(text, mark, value)).otherwise(text)
    return text


def key_slug(text: Column) -> Column:
    """A placeholder's key: lower case, umlauts spelled out, other accents off, underscores between, a letter first, 64 at most."""
    low = F.lower(F.trim(text))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        low = F.replace(low, F.lit(a), F.lit(b))
    plain = F.translate(low, "àáâãåçèéêëìíîïñòóôõøùúûýÿ", "aaaaaceeeeiiiinooooouuuyy")
    return F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^[^a-z]+", ""), "_+$", ""), 1, 64)


def sniff_mime(content: Column, name: Column, declared: Column) -> Column:
    """A file's type: by its first bytes, else by its extension, else a specific declared type, else octets."""
    head = F.hex(F.substring(content, 1, 12))
    by_bytes = (
        F.when(head.startswith("25504446"), "application/pdf")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "image/tiff")
        .when(head.startswith("47494638"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    )
    kinds = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff", "txt": "text/plain", "eml": "message/rfc822", "html": "text/html", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
    by_name = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[extension(name)]
    told = F.when(~F.coalesce(declared, F.lit("")).isin("", "application/octet-stream"), F.lower(F.trim(declared)))
    return F.coalesce(by_bytes, by_name, told, F.lit("application/octet-stream"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[.]([^./]+)$", 1))


def fake_embedding(text: Column, dim: int = 4) -> Column:
    """The deterministic stand-in of an embedding model: one number by the text's length, in every component."""
    return F.array_repeat((F.length(text) % 7 + 1).cast("double"), dim)
