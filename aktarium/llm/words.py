"""Words of a batch of texts, each distinct one once: what costs Python time is then done per distinct word."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Words(NamedTuple):
    """The words between ASCII white space: their distinct spellings, the spelling of each word of all texts one after the
    other, and where each text's words begin and end among these. One spelling may be empty; no word has it."""

    distinct: pa.StringArray
    codes: np.ndarray
    bounds: np.ndarray

    def joined(self) -> str:
        """The distinct spellings, line by line."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(self.distinct)], pa.int32()), self.distinct), "\n")[0].as_py()

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of its words' values (one for each distinct spelling)."""
        upto = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values[self.codes])])
        return upto[self.bounds[1:]] - upto[self.bounds[:-1]]


def split_words(texts: pa.Array) -> Words:
    """Null is an empty text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = pc.dictionary_encode(lists.flatten())
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
    codes, none = coded.indices.to_numpy(), pc.index(coded.dictionary, "").as_py()
    if none >= 0:  # white space at an end of a text
        word = codes != none
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(word)])[bounds]
        codes = codes[word]
    return Words(coded.dictionary, codes, bounds)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of all runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)
