"""Token ids and token counts of a tokenizers file whose pre-tokens never span white space.

Three facts carry the speed. First, texts can be cut at white space, and each distinct word of a batch needs to be looked at
only once. Secondly, the pre-tokens of a word are independent, so that one seen before needs no second encoding, and new
ones can be encoded together, separated by spaces. Thirdly, the words that encode alone as one token can be proven once,
offline: each vocabulary string that is a plain word is encoded, and kept if exactly its own id comes back. The driver
proves them; workers look pre-tokens up, and only what isn't found is merged by the library, many in one call.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa

from .words import Words, split_words, spread

#: Pre-tokens remembered by one worker besides the proven words; then all are forgotten at once. It bounds memory, not results.
REMEMBERED = 150_000

# Words of these characters alone are split here: ASCII without controls, and Latin letters whose lower case is one letter.
# Others, and words with a special token's mark, go to the library as they are.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u024f"
_OTHER = re.compile(rf"[^\n\x21-\x7e{_LETTERS}]|<\|").search
# The file's own split, for such words in lower case; words stand on lines of their own.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PRE_TOKENS = re.compile(_SPLIT.replace(r"[\p{N}]", "[0-9]").replace(r"\p{N}", "0-9").replace(r"\p{L}", _LETTERS) + r"|\n").findall
_PLAIN = re.compile(r"[a-z]+").fullmatch


class Vocabulary:
    """One tokenizers file, opened in this process."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        rules = json.loads(self.library.to_str())
        kinds = {str(n.get("type")) for n in (rules["normalizer"] or {}).get("normalizers", [rules["normalizer"] or {}])}
        self.lowers = "Lowercase" in kinds
        self.end = rules["model"].get("end_of_word_suffix") or ""
        if not (self.end and self.lowers and _SPLIT in json.dumps(rules["pre_tokenizer"]).replace(r"\\", "\\")):
            raise ValueError(f"{path}: its split or case folding isn't the one written here, or word ends aren't marked")
        self.ends_word = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.ends_word[i] = token.endswith(self.end)

    def whole_tokens(self) -> dict[str, int]:
        """Plain words that are proven to encode alone as one token: word -> id."""
        asked = {t.removesuffix(self.end): i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.endswith(self.end) and _PLAIN(t.removesuffix(self.end))}
        ids = [e.ids for e in self.library.encode_batch_fast(list(asked), add_special_tokens=False)]
        return {w: i for (w, i), got in zip(asked.items(), ids, strict=True) if got == [i]}

    def encode(self, piece: str) -> list[int]:
        return self.library.encode(piece, add_special_tokens=False).ids

    def encode_all(self, pre_tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens one after the other, and where each one's end: a token that ends a word."""
        ids = np.array(self.library.encode_batch_fast([" ".join(pre_tokens)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(pre_tokens) or ends[-1] != len(ids):
            each = [self.encode(p) for p in pre_tokens]
            ids, ends = np.array([i for x in each for i in x], "<u4"), np.cumsum([len(x) for x in each])
        return ids, ends


@functools.cache
def proven(path: str) -> dict[str, int]:
    """`whole_tokens` of a file, found once in this process."""
    return Vocabulary(path).whole_tokens()


class _Known:
    """Pre-tokens with their ids: a number for each, and by number where its ids are. Preset with proven whole tokens."""

    def __init__(self, path: str, whole: dict[str, int]):
        self.vocabulary, self.whole = Vocabulary(path), whole
        self._reset()

    def _reset(self) -> None:
        # Number 0 is the end of a word and has no ids.
        self.number = {"\n": 0} | {w: k for k, w in enumerate(self.whole, 1)}
        self.ids = np.fromiter(self.whole.values(), np.dtype("<u4"), len(self.whole))
        self.ends = np.arange(len(self.whole) + 1)

    def learn(self, pre_tokens: set[str]) -> None:
        """Make room if needed, then encode all that isn't known in one call."""
        if len(self.number) > REMEMBERED + len(self.whole):
            self._reset()
        if new := [p for p in pre_tokens if p not in self.number]:
            ids, ends = self.vocabulary.encode_all(new)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.ends = np.concatenate([self.ends, ends + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])

    def of_words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all distinct words one after the other, and how many each one has."""
        text, odd = words.joined(), {}
        if _OTHER(text):
            lines = text.split("\n")
            odd = {k: np.array(self.vocabulary.encode(w), "<u4") for k, w in enumerate(lines) if _OTHER(w)}
            text = "\n".join("" if k in odd else w for k, w in enumerate(lines))
        pre_tokens = _PRE_TOKENS(text.lower())
        self.learn(set(pre_tokens))
        number = np.fromiter(map(self.number.__getitem__, pre_tokens), np.int64, len(pre_tokens))
        starts = np.where(number > 0, self.ends[number - 1], 0)
        lengths = np.where(number > 0, self.ends[number] - starts, 0)
        word = np.cumsum(number == 0)
        counts = np.bincount(word, lengths, len(words.distinct)).astype(np.int64)
        ids = self.ids[spread(starts, lengths)]
        if odd:
            at = np.cumsum(counts)
            ids = np.insert(ids, np.repeat([at[k] for k in odd], list(map(len, odd.values()))), np.concatenate(list(odd.values())))
            counts[list(odd)] = list(map(len, odd.values()))
        return ids, counts


_KNOWN: dict[str, _Known] = {}


def _known(path: str, whole: dict[str, int] | None) -> _Known:
    """One per file and process; `whole` saves the proof where it was made before."""
    if path not in _KNOWN:
        _KNOWN[path] = _Known(path, proven(path) if whole is None else whole)
    return _KNOWN[path]


def token_ids(path: str, texts: pa.Array, whole: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and how many each text has. Null is an empty text."""
    words = split_words(texts)
    ids, counts = _known(path, whole).of_words(words)
    starts, each = np.cumsum(counts) - counts, counts[words.codes]
    return ids[spread(starts[words.codes], each)], words.sums(counts)


def token_counts(path: str, texts: pa.Array, whole: dict[str, int] | None = None) -> np.ndarray:
    """Each text's number of ids. Null is an empty text."""
    words = split_words(texts)
    return words.sums(_known(path, whole).of_words(words)[1])
