"""Whole texts out of Arrow batches, in slices of bounded size, and numpy helpers on their bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """Only the columns that a kernel needs, whatever else the table holds, under fixed names."""
    return df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), *(F.col(c) for c in more))


def objects(values) -> pd.Series:
    """Strings or bytes as a column; pandas would make numbers of an empty one."""
    return pd.Series(list(values), dtype=object)


#: The one model that this process holds, by what built it and from what.
_MODEL: dict[tuple[str, str, object], object] = {}


def one_model(build: Callable) -> Callable:
    """build, of one argument, whose result is held until this worker needs another model or none: tables of tens of megabytes of each operator would add up in it."""

    @wraps(build)
    def held(given):
        key = (build.__module__, build.__qualname__, given)
        if key not in _MODEL:
            drop_model()
            _MODEL[key] = build(given)
        return _MODEL[key]

    return held


def drop_model(but: Callable | None = None) -> None:
    """Lets go of the model that is held, unless `but` built it."""
    if _MODEL and not (but and next(iter(_MODEL))[:2] == (but.__module__, but.__qualname__)):
        _MODEL.clear()
        give_back()


def give_back() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def frugal(run: Callable, model: Callable | None = None) -> Callable:
    """A map over batches before which the worker, which Spark keeps for later tasks, drops a model that is not `model`'s (see one_model), and after which it gives back the memory that it freed."""

    @wraps(run)
    def mapped(batches: Iterator) -> Iterator:
        drop_model(model)
        try:
            yield from run(batches)
        finally:
            del batches
            give_back()

    return mapped


@dataclass
class TextSlice:
    """Rows lo..hi of a batch. data: their UTF-8 bytes; offsets: len(rows) + 1 places in data; valid: false where the text is null."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[TextSlice]:
    """Slices of a string column of at most this many bytes, or of one row; null texts have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    valid = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(raw, raw[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield TextSlice(lo, hi, data[raw[lo] : raw[hi]], raw[lo : hi + 1] - raw[lo], valid[lo:hi])
        lo = hi


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 on 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_spans(s: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word [^\\x20\\x09-\\x0D]+ in the slice's bytes, and of each row its first word's number (rows + 1 values)."""
    inside = ~_IS_SPACE[s.data]
    cut = np.zeros(len(s.data) + 1, dtype=bool)
    cut[s.offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, s.offsets)


#: Places in a span whose values are looked up.
_NEAR = 64
_KEY = np.uint64(0x9E3779B97F4A7C15)


def _drawn(places: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A value for each letter at each place, as good as drawn at random."""
    return mixed(mixed((places.astype(np.uint64) << np.uint64(8) | letters.astype(np.uint64)) + _KEY) ^ _KEY)


_DRAWN = _drawn(np.repeat(np.arange(_NEAR), 256), np.tile(np.arange(256), _NEAR))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at_once: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, worked out for so many spans at once; no span is empty.

    Each letter at each place has a value of its own, and their sum is mixed (tabulation hashing): unlike a polynomial modulo
    2**64 it has no texts that collide by its structure.
    """
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), at_once):
        begin, lengths = starts[k : k + at_once], (ends - starts)[k : k + at_once]
        first = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        letters = data[at + np.repeat(begin, lengths)]
        terms = _DRAWN[(np.minimum(at, _NEAR - 1) << 8) + letters]
        if lengths.max() > _NEAR:
            far = np.flatnonzero(at >= _NEAR)
            terms[far] = _drawn(at[far], letters[far])
        out[k : k + at_once] = mixed(np.add.reduceat(terms, first) + lengths.astype(np.uint64))
    return out


def window_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of n values (as many as len(words) - n + 1)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    p = mixed((np.arange(n, dtype=np.uint64) + np.uint64(1 + (seed << 32))) * _KEY)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total += words[k : k + m] * (p[k] | np.uint64(1))
    return mixed(total)


def within_rows(first_word: np.ndarray, n: int) -> np.ndarray:
    """Of the windows of n words over a slice, true where a window lies in one row."""
    total = int(first_word[-1])
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    row_of = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    return row_of[:m] == row_of[n - 1 :]
