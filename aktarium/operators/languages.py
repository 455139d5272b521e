"""The language of texts, by a model of character trigrams that is fitted on texts whose language is known.

Of each language the model has a weight for each of the commonest trigrams, a thousand times its logarithm of probability as a whole number, so that sums
are exact in any order. A text has the language under which its trigrams weigh most, unless they weigh so little that it's
none of those. Texts are whole; words are their runs of letters, in lower case, with a space at both ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents that the model is fitted on, trigrams that it keeps, and languages, at most; shorter texts have none.
MOST_DOCUMENTS, MOST_GRAMS, MOST_LANGUAGES, LEAST_CHARACTERS = 8192, 50_000, 64, 20
#: Of the documents it was fitted on, this share weighs less under its own language than a text must, before the margin.
LOWEST, MARGIN = 0.02, 1000
#: Characters that are looked at together, so that memory doesn't grow with a text.
_SLICE = 1 << 20


def letters(text: Column) -> Column:
    """The words of a text between single spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def trigrams(text: str) -> Iterator[np.ndarray]:
    """The trigrams of a text as numbers, slice by slice."""
    for at in range(0, max(1, len(text) - 2), _SLICE):
        points = np.frombuffer(text[at : at + _SLICE + 2].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        yield points[:-2] << 42 | points[1:-1] << 21 | points[2:]


def gram_text(gram: int) -> str:
    return "".join(chr(gram >> k & 0x1FFFFF) for k in (42, 21, 0))


@dataclass(frozen=True)
class LanguageModel:
    """Languages, trigrams in order, a row of weights for each and one for all others, and the least mean weight of a text."""

    languages: list[str]
    grams: np.ndarray
    weights: np.ndarray
    least: int

    def weigh(self, text: str) -> tuple[np.ndarray, int]:
        """The sum of weights under each language, and the number of trigrams."""
        total, n = np.zeros(len(self.languages), np.int64), 0
        for own in trigrams(text):
            if len(self.grams):
                at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
                at = np.where(self.grams[at] == own, at, len(self.grams))
                total += np.bincount(at, minlength=len(self.weights)) @ self.weights
            n += len(own)
        return total, n


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over rows (lang, words); the trigrams of a batch are counted before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                found = [g for own, text in zip(langs, b.column("words").to_pylist(), strict=True) if own == lang for g in trigrams(text)]
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame, text_col: str = "text_content", lang_col: str = "lang", id_col: str = "id", least_count: int = 5) -> LanguageModel:
    """Fit on at most MOST_DOCUMENTS documents with a language and LEAST_CHARACTERS, chosen by a hash of their ids. Trigrams
    seen less than `least_count` times, and those beyond the commonest MOST_GRAMS, count as other trigrams. The model has
    bounded size; no language known gives one that finds none."""
    known = docs.filter(F.col(lang_col).isNotNull() & (F.length(F.trim(text_col)) >= LEAST_CHARACTERS))
    sample = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), letters(F.col(text_col)).alias("words"), F.md5(F.col(id_col).cast("string")).alias("h"))
    sample = sample.orderBy("h", "id").limit(MOST_DOCUMENTS).select("lang", "words").persist()
    try:
        counts = _counted(sample)
        totals = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
        of_lang = {r["lang"]: r["n"] for r in totals.collect()}
        languages = sorted(of_lang)
        common = counts.filter(F.col("lang").isin(*languages) if languages else F.lit(False)).groupBy("gram").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
        kept = sorted(common.filter(F.col("all") >= least_count).orderBy(F.desc("all"), "gram").limit(MOST_GRAMS).collect(), key=lambda r: r["gram"])
        table = np.array([[r["by"].get(lang, 0) for lang in languages] for r in kept] + [[0] * len(languages)], np.float64).reshape(len(kept) + 1, len(languages))
        size = np.array([of_lang[lang] for lang in languages], np.float64)
        weights = np.rint(1000 * np.log((table + 0.5) / (size + 0.5 * (len(kept) + 1)))).astype(np.int64)
        model = LanguageModel(languages, np.array([r["gram"] for r in kept], np.int64), weights, 0)
        own = _weighed(sample.filter(F.col("lang").isin(*languages) if languages else F.lit(False)), model, "lang").select("mean")
        means = sorted(r["mean"] for r in own.collect())  # at most MOST_DOCUMENTS numbers
    finally:
        sample.unpersist()
    return LanguageModel(languages, model.grams, weights, means[max(0, int(np.ceil(LOWEST * len(means))) - 1)] - MARGIN if means else 0)


def _weighed(rows: DataFrame, model: LanguageModel, lang: str | None = None) -> DataFrame:
    """Rows (words, others) with `best` (ties to the first code) and `mean`, its weight a trigram, rounded down; of the
    language in the column `lang`, if given."""
    names = [c for c in rows.columns if c != "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, mean = [], []
            for text, own in zip(b.column("words").to_pylist(), b.column(lang).to_pylist() if lang else [None] * b.num_rows, strict=True):
                total, n = model.weigh(text)
                k = model.languages.index(own) if own is not None else int(total.argmax()) if len(total) and n else -1
                best.append(model.languages[k] if k >= 0 else "")
                mean.append(int(total[k]) // n if k >= 0 and n else None)
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(best, pa.string()), pa.array(mean, pa.int64())], [*names, "best", "mean"])

    kinds = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names), "best string", "mean long"])
    return rows.mapInArrow(run, kinds)


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text_content", id_col: str = "id") -> DataFrame:
    """(id, found, mean) of each row: the language, '' for a null or short text or one of no known language, and the mean
    weight of its trigrams under it (null where there's none). The model travels with the function; nothing is shuffled."""
    rows = docs.select(F.col(id_col).alias("id"), letters(F.col(text_col)).alias("words"), (F.length(F.trim(F.coalesce(text_col, F.lit("")))) >= LEAST_CHARACTERS).alias("long"))
    ok = F.col("long") & (F.col("mean") >= model.least)
    return _weighed(rows, model).select(F.col("id").alias(id_col), F.when(ok, F.col("best")).otherwise("").alias("found"), F.when(ok, F.col("mean")).alias("mean"))
