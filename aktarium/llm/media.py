"""Bytes stored losslessly as PNG images in a binary column, read back with all checks, and a hash of low frequencies."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches
from .words import spread

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a row of the image; payloads are padded to whole rows.
WIDTH = 64
#: Side of the reduced image and of the block of low frequencies.
_SIDE, _LOW = 32, 8
#: Rows filtered at once, and the most bytes that a file may inflate to.
_ROWS, MOST_BYTES = 1 << 14, 1 << 30


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(kind: int, samples: np.ndarray, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What a filter leaves of samples, from their neighbours."""
    if kind == 3:
        return samples - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    return samples - (_paeth(left, up, corner) if kind == 4 else (0, left, up)[kind])


def filter_rows(samples: np.ndarray, first: np.ndarray, kinds: Sequence[int] = range(5)) -> np.ndarray:
    """Rows with their filter's number before them; `first` marks the rows that have none above them in their image.

    Each row takes that of the filters `kinds` whose results, as signed numbers, have the least sum of absolute values; of
    equal ones the first. Rows of many images go at once, a slice at a time.
    """
    height, width = samples.shape
    out = np.empty((height, width + 1), np.uint8)
    for a in range(0, height, _ROWS):
        own = samples[a : a + _ROWS]
        up = np.zeros_like(own)
        up[1:] = own[:-1]
        if a:
            up[0] = samples[a - 1]
        up[first[a : a + _ROWS]] = 0
        left, corner = np.zeros_like(own), np.zeros_like(own)
        left[:, 1:], corner[:, 1:] = own[:, :-1], up[:, :-1]
        tried = [_filtered(k, own, left, up, corner) for k in kinds]
        cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for x in tried])
        best = cost.argmin(axis=0)
        out[a : a + _ROWS, 0] = np.array(kinds, np.uint8)[best]
        out[a : a + _ROWS, 1:] = np.choose(best[:, None], tried)
    return out


def _file(rows: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit greyscale image of filtered rows."""
    head = struct.pack(">IIBBBBB", rows.shape[1] - 1, rows.shape[0], 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _stacked(heights: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where each image's rows begin among all rows, and each row's number in its image."""
    starts = np.cumsum(heights) - np.asarray(heights)
    return starts, spread(np.zeros(len(heights), np.int64), np.asarray(heights, np.int64))


def encode_png(images: Sequence[np.ndarray], kinds: Sequence[int] = range(5)) -> list[bytes]:
    """An 8-bit greyscale file of each image; all have one width."""
    if not images:
        return []
    starts, number = _stacked([len(x) for x in images])
    rows = filter_rows(np.concatenate(images), number == 0, kinds)
    return [_file(rows[s : s + len(x)]) for s, x in zip(starts.tolist(), images, strict=True)]


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, up and corner the one closest to left + up - corner; ties in this order."""
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c)).astype(np.uint8)


def unfilter(images: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Samples from the filtered rows (filter's number first) of images of one width.

    A sample needs the one to its left and those above both, so samples whose row and column add up to the same number don't
    need each other: each step undoes these in all images at once. Rows are kept in the order of their numbers, so that
    those a step works on follow one another.
    """
    starts, number = _stacked([len(x) for x in images])
    if not len(number):
        return [x[:, 1:] for x in images]
    rows = np.concatenate(images)
    kinds, width = rows[:, 0], rows.shape[1] - 1
    order = np.argsort(number, kind="stable")
    begins, kinds = number[order], kinds[order]
    # Row 0 and column 0 are zeros; row r of all images is row r + 1 here.
    full = np.zeros((len(rows) + 1, width + 1), np.uint8)
    full[1:, 1:] = rows[:, 1:]
    flat, at = full.reshape(-1), (order + 1) * (width + 1)
    above = np.where(begins > 0, at - (width + 1), 0)
    if not kinds.any():
        return [full[s + 1 : s + 1 + len(x), 1:] for s, x in zip(starts.tolist(), images, strict=True)]
    steps = np.searchsorted(begins, np.arange(int(begins[-1]) + width + 1)).tolist()
    for d in range(int(begins[-1]) + width):
        a, b = steps[max(0, d - width + 1)], steps[min(d + 1, len(steps) - 1)]
        column = d - begins[a:b] + 1
        here, over, kind = at[a:b] + column, above[a:b] + column, kinds[a:b]
        left, up = flat[here - 1], flat[over]
        guess = np.where(kind == 1, left, np.where(kind == 2, up, 0))
        if (kind == 3).any():
            guess = np.where(kind == 3, ((left.astype(np.uint16) + up) >> 1).astype(np.uint8), guess)
        if (kind == 4).any():
            guess = np.where(kind == 4, _paeth(left, up, flat[over - 1]), guess)
        flat[here] += guess
    return [full[s + 1 : s + 1 + len(x), 1:] for s, x in zip(starts.tolist(), images, strict=True)]


def inflate_png(blob: bytes) -> np.ndarray:
    """The filtered rows of an 8-bit greyscale image that isn't interlaced. Raises ValueError where any check fails.

    Checked are the signature, each chunk's length and checksum, the order of IHDR, IDAT and IEND, the header's fields, the
    size of the inflated data (never more is inflated than the header says, and that is MOST_BYTES at most), its checksum (by
    zlib) and the filters' numbers. Ancillary chunks are skipped.
    """
    if blob[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, head, body, ended = 8, None, [], False
    while at < len(blob) and not ended:
        if at + 12 > len(blob):
            raise ValueError("cut off")
        (n,), kind = struct.unpack(">I", blob[at : at + 4]), blob[at + 4 : at + 8]
        data, crc = blob[at + 8 : at + 8 + n], blob[at + 8 + n : at + 12 + n]
        if len(crc) != 4 or zlib.crc32(data, zlib.crc32(kind)) != int.from_bytes(crc, "big"):
            raise ValueError(f"chunk {kind!r} is damaged")
        if (kind == b"IHDR") != (head is None):
            raise ValueError("IHDR must come first, once")
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("IHDR has a wrong length")
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("cut off, or not plain 8-bit greyscale")
    width, height = head[:2]
    size = height * (width + 1)
    if not width or not height or size > MOST_BYTES:
        raise ValueError("no samples, or too many")
    inflater = zlib.decompressobj()
    try:
        raw = inflater.decompress(b"".join(body), size + 1)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != size or not inflater.eof:
        raise ValueError("wrong size")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    if rows[:, 0].max() > 4:
        raise ValueError("unknown filter type")
    return rows


def decode_png(blobs: Sequence[bytes | None]) -> list[np.ndarray | str]:
    """The samples of each file, or what is wrong with it."""
    found: list[np.ndarray | str] = []
    for blob in blobs:
        try:
            found.append("no media" if blob is None else inflate_png(blob))
        except ValueError as e:
            found.append(str(e))
    by_width: dict[int, list[int]] = {}
    for k, rows in enumerate(found):
        if not isinstance(rows, str):
            by_width.setdefault(rows.shape[1], []).append(k)
    for same in by_width.values():
        for k, samples in zip(same, unfilter([found[k] for k in same]), strict=True):
            found[k] = samples
    return found


@functools.cache
def _averaging(n: int) -> np.ndarray:
    """A (_SIDE x n) matrix that takes the mean of each of _SIDE equal spans of n samples, with shares of the edges."""
    edges = np.linspace(0, n, _SIDE + 1)
    k = np.arange(n)
    share = np.minimum(edges[1:, None], k + 1) - np.maximum(edges[:-1, None], k)
    return np.clip(share, 0, None) * _SIDE / n


@functools.cache
def _cosines() -> np.ndarray:
    """The _LOW lowest rows of the cosine transform (DCT-II) of _SIDE samples."""
    return np.cos(np.pi / _SIDE * np.arange(_LOW)[:, None] * (np.arange(_SIDE) + 0.5))


def frequency_hash(samples: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest frequencies of the image reduced to 32 x 32 exceed their median.

    The constant part is left out of the median. Long images are reduced a few rows at a time, so that no copy in
    floating point of the whole image is made.
    """
    height, width = samples.shape
    edges, across = np.linspace(0, height, _SIDE + 1), _averaging(width)
    if height <= 4096:
        small = _averaging(height) @ samples.astype(np.float64) @ across.T
    else:
        rows = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            first, last = int(a), min(height, int(np.ceil(b)))
            k = np.arange(first, last)
            rows.append((np.minimum(b, k + 1) - np.maximum(a, k)) @ samples[first:last] / (b - a) @ across.T)
        small = np.array(rows)
    low = (_cosines() @ small @ _cosines().T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def payload_of(text: str | None) -> tuple[int, np.ndarray]:
    """The text's UTF-8 length, and its bytes with zeros appended up to a positive multiple of WIDTH, as rows."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    padded = raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")
    return len(raw), np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a PNG: id, n_bytes (before padding) and `media`, the file's bytes.

    Null and empty texts are one row of zeros. Rows are independent, so repeated rows, null ids and an empty table give
    repeated rows, null ids and no row. Other columns aren't read.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [payload_of(t.as_py()) for t in b.column("text")]
        media = pa.array(encode_png([rows for _, rows in found]), pa.binary())
        return pa.record_batch([b.column("id"), pa.array([n for n, _ in found], pa.int64()), media], ["id", "n_bytes", "media"])

    return in_batches(narrow, each, f"id {narrow.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns but `media`, and what reading it back gives: payload_bytes, payload_sha256, tail_crc32 (of the last
    64 bytes), media_bytes, media_sha256, `feature` (see `frequency_hash`) and `error`.

    A null or damaged file has null results and says in `error` what is wrong; it doesn't end the run.
    """
    names = [n for n in media.columns if n != media_col]
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"

    def one(blob: bytes | None, samples: np.ndarray | str) -> tuple:
        stored = (None, None) if blob is None else (len(blob), hashlib.sha256(blob).hexdigest())
        if isinstance(samples, str):
            return (None, None, None, *stored, None, samples)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, frequency_hash(samples), None

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        blobs = b.column(media_col).to_pylist()
        found = list(zip(*map(one, blobs, decode_png(blobs)), strict=True))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.record_batch([*(b.column(n) for n in names), *map(pa.array, found, kinds)], [*names, *(x.split()[0] for x in added.split(", "))])

    return in_batches(media, each, ", ".join(f"`{n}` {t}" for n, t in media.dtypes if n != media_col) + ", " + added)
