"""What the operators share: the folder all machines see, and vectorised text scanning.

Scanning works on Arrow string batches as bytes: word boundaries and 64-bit word
hashes come from whole-batch array operations, in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, materialise, shared_dir  # noqa: F401

#: ASCII white space, as the contracts write it: [\x20\x09-\x0D].
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: Bytes scanned at once, so that the arrays stay in the processor's cache; a longer text is scanned alone.
PIECE = 1 << 17


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files behind `df` as the optimizer knows them, else of its texts; sizes buckets, never results."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 60:
        return known
    return df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- scanning ---------------------------------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, at - at[0]


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of at most `most` bytes: first row, row after the last, bytes, offsets."""
    data, at = text_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_spans(data: np.ndarray, at: np.ndarray, gap: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run of bytes that aren't in `gap` (256 booleans)."""
    word = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = word
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = word
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, (np.searchsorted(at, starts, "right") - 1).astype(np.int64)


#: Runs of more bytes are hashed one by one.
LONG = 512
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _eight(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place as one number, zeros behind the end; a view, read by index."""
    held = np.concatenate((data.view(np.uint8), np.zeros(8, np.uint8)))
    return np.ndarray(len(held) - 7, "<u8", held, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte (or code point) runs, equal for equal runs wherever they stand.

    Eight bytes at a time go through `mix`, which isn't linear, so that runs built from one
    another by a rule don't meet; up to eight bytes of one length never do. Where equal hashes
    decide a result, `same_spans` compares the bytes.
    """
    width = data.dtype.itemsize
    starts, ends = np.asarray(starts, np.int64) * width, np.asarray(ends, np.int64) * width
    size, words = ends - starts, _eight(data)
    out = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    now, at = np.flatnonzero(size <= LONG), 0
    while len(now):
        left = size[now] - at
        out[now] = mix(out[now] ^ (words[starts[now] + at] & _MASKS[np.minimum(left, 8)]))
        now, at = now[left > 8], at + 8
    raw = data.view(np.uint8)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, other: np.ndarray, others: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the run of `size` at each of `starts` equals the one at `others` in `other`."""
    width = data.dtype.itemsize
    starts, others, size = (np.asarray(x, np.int64) * width for x in (starts, others, size))
    left, right = _eight(data), _eight(other)
    out = np.ones(len(size), bool)
    now, at = np.flatnonzero(size <= LONG), 0
    while len(now):
        rest = size[now] - at
        out[now] &= ((left[starts[now] + at] ^ right[others[now] + at]) & _MASKS[np.minimum(np.maximum(rest, 0), 8)]) == 0
        now, at = now[(rest > 8) & out[now]], at + 8
    one, two = data.view(np.uint8), other.view(np.uint8)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = np.array_equal(one[starts[i] : starts[i] + size[i]], two[others[i] : others[i] + size[i]])
    return out


def windows(data: np.ndarray, most: int = PIECE, gap: np.ndarray = _IS_SPACE) -> Iterator[np.ndarray]:
    """Stretches of about `most` bytes that each end behind a byte in `gap`, so that no word is cut."""
    i = 0
    while i < len(data):
        j, k = i, i
        while k < len(data) and j == i:  # a word longer than a window makes it longer
            stops = np.flatnonzero(gap[data[k : k + most]])
            j, k = (k + int(stops[-1]) + 1 if len(stops) else i), k + most
        if k >= len(data):
            j = len(data)
        yield data[i:j]
        i = j


_LANES = [0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53]


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct hashes of its word shingles, A-Z lower-cased.

    Rows of fewer than `width` words have their whole sequence as one shingle; rows
    without words (empty, null or only white space) have an empty set.
    """
    lanes = [np.uint64(x) for x in (_LANES * (width // len(_LANES) + 1))[:width]]
    for first, last, data, at in pieces(column):
        if last - first == 1 and len(data) > PIECE:
            # A long text is scanned window by window; only its words' hashes are held.
            hashes = np.concatenate([_word_hashes(w, np.array([0, len(w)]))[0] for w in windows(data)])
            rows = np.array([0, len(hashes)])
        else:
            hashes, rows = _word_hashes(data, at)
        for i in range(last - first):
            yield first + i, _shingles(hashes[rows[i] : rows[i + 1]], lanes)


def _word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = _ASCII_LOWER[data]
    starts, ends, _ = word_spans(data, at)
    return span_hashes(data, starts, ends), np.searchsorted(starts, at)


def _shingles(words: np.ndarray, lanes: list[np.uint64]) -> np.ndarray:
    """Sorted distinct hashes of the runs of len(lanes) words; of all words, if they are fewer."""
    width, n = min(len(lanes), len(words)), len(words)
    if not n:
        return np.zeros(0, np.uint64)
    found = []
    for a in range(0, n - width + 1, PIECE):
        b = min(a + PIECE, n - width + 1)
        total = np.full(b - a, width, np.uint64) if width < len(lanes) else np.zeros(b - a, np.uint64)
        for k in range(width):
            total += mix(words[a + k : b + k] + np.uint64(k)) * lanes[k]
        found.append(mix(total))
    found = np.sort(found[0] if len(found) == 1 else np.concatenate(found))
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    return found[new]
