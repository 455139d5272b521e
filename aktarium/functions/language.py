"""The language of a text, by its commonest words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WIDE_SPACE, let

# Frequent short words of four languages; those of several are left out.
COMMON = {
    "de": "der die das und ist nicht mit von zu den auf für im sich dem ein eine als auch bei".split(),
    "en": "the of and to is that it was for with as his on be at by this had not are".split(),
    "es": "el los las y en por con para su lo como más pero sus le ya este sí porque esta".split(),
    "fr": "le les et à dans il qui une pas pour ce au sur avec plus par je du des est".split(),
}
LEAST_CHARACTERS = 20
#: A common word between white space, whatever but letters is around it; the space behind it begins the next match.
_SPACE = WIDE_SPACE.strip("[]+")
_COMMON_WORD = rf"(?<![^{_SPACE}])[^\p{{L}}{_SPACE}]*+({'|'.join(w for own in COMMON.values() for w in own)})[^\p{{L}}{_SPACE}]*+(?![^{_SPACE}])"


def detect_language(text: Column) -> Column:
    """The language with most of its common words in the text; '' for short texts, or where none has one. Ties go by code.

    One pass over the text takes its common words out, which are few; only they are counted by language.
    """
    low = F.lower(F.coalesce(text, F.lit("")))

    def most(found: Column) -> Column:
        hits = [_hits(found, k, code) for k, code in enumerate(sorted(COMMON))]
        return let(F.array_max(F.array(*hits)), lambda best: F.when(best["n"] > 0, best["code"]).otherwise(""))

    return F.when(F.length(F.trim(text)) >= LEAST_CHARACTERS, let(F.regexp_extract_all(low, F.lit(_COMMON_WORD), 1), most)).otherwise("")


def _hits(found: Column, k: int, code: str) -> Column:
    known = COMMON[code]
    return F.struct(F.size(F.filter(found, lambda w: w.isin(*known))).alias("n"), F.lit(-k).alias("k"), F.lit(code).alias("code"))
