"""Model providers: protocols, registries by name, retries, and calls in batches with their usage. Only stand-ins are built in."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol, TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

T = TypeVar("T")
#: Rows and bytes of prompts, pictures and replies that a worker has as Python values at once.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


class EmbeddingProvider(Protocol):
    """Vectors of texts, in their order; `model` and `version` say which of them can be compared."""

    model: str
    version: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class GenerationProvider(Protocol):
    """A reply to a prompt."""

    model: str

    def generate(self, prompt: str) -> str: ...


class VisionProvider(Protocol):
    """The text of a page's picture, as a prompt asks for it."""

    model: str

    def describe(self, image: bytes, prompt: str) -> str: ...


class Unavailable(Exception):
    """A fault that may pass: the call is worth repeating."""


def with_retry(call: Callable[[], T], attempts: int = 3, first_wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> T:
    """Repeat a call that is unavailable, waiting twice as long each time; other faults, and the last one, are raised."""
    for k in range(attempts):
        try:
            return call()
        except Unavailable:
            if k == attempts - 1:
                raise
            sleep(first_wait * 2**k * (1 + random.random() / 4))
    raise AssertionError("no attempt was made")


def masked(secret: str) -> str:
    """A secret as it may be logged: its last four characters, if it's long enough to keep the rest."""
    return f"***{secret[-4:]}" if len(secret) >= 12 else "***"


class FakeEmbedding:
    """One number by the text's length in every component: the same as `functions.text.fake_embedding`."""

    version = "1"

    def __init__(self, dim: int = 4):
        self.model, self.dim = f"fake-{dim}", dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t) % 7 + 1)] * self.dim for t in texts]


class FakeGeneration:
    """The prompt again."""

    model = "fake"

    def generate(self, prompt: str) -> str:
        return f"Echo: {prompt}"


class FakeVision:
    """The picture's size in bytes."""

    model = "fake"

    def describe(self, image: bytes, prompt: str) -> str:
        return f"{prompt}: {len(image)}"


#: Name -> maker of a provider; makers run on the workers, where credentials and connections belong.
PROVIDERS: dict[str, Callable[[], EmbeddingProvider]] = {"fake": FakeEmbedding}
GENERATORS: dict[str, Callable[[], GenerationProvider]] = {"fake": FakeGeneration}
DESCRIBERS: dict[str, Callable[[], VisionProvider]] = {"fake": FakeVision}


def _called(call: Callable[[], T]) -> tuple[T | None, str | None]:
    """(result, error) of a call that is repeated while its provider is unavailable."""
    try:
        return with_retry(call), None
    except Exception as e:  # noqa: BLE001  providers are plugged in; a failed call fails its own rows alone
        return None, type(e).__name__


def generate(prompts: DataFrame, make: Callable[[], GenerationProvider]) -> DataFrame:
    """Prompts (key, prompt) with reply, model, `tokens` (words sent and received) and `error` where the call failed for good."""
    return _replies(prompts.select("key", "prompt"), make, lambda provider, row: provider.generate(row["prompt"] or ""))


def describe(pages: DataFrame, make: Callable[[], VisionProvider]) -> DataFrame:
    """Pages (key, image, prompt) with reply, model, tokens and error; the pictures aren't carried on."""
    return _replies(pages.select("key", "prompt", "image"), make, lambda provider, row: provider.describe(row["image"] or b"", row["prompt"] or ""))


def _sliced(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most SLICE_ROWS rows and about SLICE_BYTES, so that the Python values of a few rows are there at once."""
    rows = min(SLICE_ROWS, max(1, SLICE_BYTES * b.num_rows // max(1, b.nbytes)))
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def _answered(batches: Iterator[pa.RecordBatch], make: Callable, ask: Callable) -> Iterator[pa.RecordBatch]:
    provider = make()
    for whole in batches:
        for b in _sliced(whole):
            rows = b.to_pylist()
            got = [_called(lambda row=row: ask(provider, row)) for row in rows]
            tokens = [len((row["prompt"] or "").split()) + len((reply or "").split()) for row, (reply, _) in zip(rows, got, strict=True)]
            columns = [pa.array([x[0] for x in got], pa.string()), pa.array([provider.model] * len(got)), pa.array(tokens, pa.int64()), pa.array([x[1] for x in got], pa.string())]
            yield pa.record_batch([b.column("key"), *columns], ["key", "reply", "model", "tokens", "error"])
    # Workers serve one task after the other: what a large batch took goes back.
    pa.default_memory_pool().release_unused()


def _replies(rows: DataFrame, make: Callable, ask: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _answered(batches, make, ask)

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, reply string, model string, tokens long, error string")


def usage(calls: DataFrame) -> DataFrame:
    """(model, n_texts, tokens) of all calls in a result of `embed_chunks`, `generate` or `describe`."""
    model = F.col("model" if "model" in calls.columns else "embedding_model")
    return calls.groupBy(model.alias("model")).agg(F.count(F.lit(1)).alias("n_texts"), F.sum("tokens").alias("tokens"))


def embed_chunks(chunks: DataFrame, make: Callable[[], EmbeddingProvider], dim: int, batch: int = 64) -> DataFrame:
    """Chunks (document_id, position, content) with embedding, model, version and `tokens` (words sent); `error` where a call
    failed for good.

    Texts go to the provider `batch` at a time. A vector of another length is an error of its chunk: vectors in one table
    have one dimension.
    """
    narrow = chunks.select("document_id", "position", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for b in batches:
            texts, vectors, errors = [t or "" for t in b.column("content").to_pylist()], [], []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                got, bad = _called(lambda part=part: provider.embed(part))
                bad = bad or (None if len(got) == len(part) else "wrong number of vectors")
                for k in range(len(part)):
                    fault = bad or (None if len(got[k]) == dim else "wrong dimension")
                    vectors.append(None if fault else got[k])
                    errors.append(fault)
            columns = [pa.array(vectors, pa.list_(pa.float32())), pa.array([provider.model] * len(texts)), pa.array([provider.version] * len(texts)), pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(errors, pa.string())]
            yield pa.record_batch([*b.columns, *columns], [*b.schema.names, "embedding", "embedding_model", "embedding_model_version", "tokens", "error"])

    kinds = ", ".join(f"{n} {t}" for n, t in narrow.dtypes)
    return narrow.mapInArrow(run, f"{kinds}, embedding array<float>, embedding_model string, embedding_model_version string, tokens long, error string")


def failed_documents(embedded: DataFrame) -> DataFrame:
    """Documents with a chunk that has no vector: they keep the chunks they had."""
    return embedded.filter(F.col("error").isNotNull()).select("document_id").distinct()
