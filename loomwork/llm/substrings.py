"""Removal of repeated passages by difference-cover anchors.

A window is a run of `window` words of one document. Word windows of `anchor` words are hashed only where their place
modulo `period` is in a difference cover: for any two places there is a shift below `period` that brings both into the
cover, so two equal windows of at least anchor + period - 1 words share an anchor at the same distance from their
starts. Only windows with an anchor that occurs elsewhere too are hashed in full (the extension), and of equal windows
the one that starts first stays.

How it is dealt out: documents are sorted by id into chunks of bounded size, so the order of chunks is the order of
windows. Of each chunk every hash goes to its bucket once, however often the chunk has it; a bucket answers with one
bit a hash. So a passage that a third of all rows share costs each bucket one hash a chunk, and no group of pairs
ever arises.

Rows: a null text has no words; a document of fewer words than a window loses nothing; rows that repeat a doc_id count
as documents of their own in the order of their texts; a null doc_id comes first; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import TextSlice, frugal, id_text, objects, span_hashes, text_slices, window_hashes, within_rows, word_spans
from .shared import kept, partitions, release

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
CHUNK_BYTES = 4 << 20
#: Hashes of one bucket that a task holds, in bytes, about.
BUCKET_BYTES = 16 << 20

_CHUNK = "chunk long, part int, keys binary, nulls binary, offsets binary, body binary"


def covers(period: int, cover: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order to chunks: ids, offsets and the compressed text of about CHUNK_BYTES in one row."""
    part = TaskContext.get().partitionId()
    pack, n = zstandard.ZstdCompressor(level=3), 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def row() -> pa.RecordBatch:
        nonlocal n
        keys, nulls, sizes, body = (np.concatenate(x) for x in zip(*held))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        out = {"chunk": [(part << 32) + n], "part": pa.array([part], pa.int32()), "keys": [keys.tobytes()], "nulls": [nulls.tobytes()], "offsets": [offsets.tobytes()], "body": [pack.compress(body.tobytes())]}
        held.clear()
        n += 1
        return pa.RecordBatch.from_pydict(out)

    for batch in batches:
        for s in text_slices(batch.column(1), CHUNK_BYTES // 4):
            ids = batch.column(0).slice(s.lo, s.rows)
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), np.diff(s.offsets), s.data))
            if sum(len(h[3]) + 16 * len(h[0]) for h in held) >= CHUNK_BYTES:
                yield row()
    if held:
        yield row()


class Chunk:
    """Words and hashes of one chunk."""

    def __init__(self, row, settings: Settings):
        self.set, self.keys, self.nulls = settings, np.frombuffer(row.keys, np.int64), np.frombuffer(row.nulls, bool)
        body = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.body), np.uint8) if row.body else np.zeros(0, np.uint8)
        self.slice = TextSlice(0, len(self.keys), body, np.frombuffer(row.offsets, np.int64), ~self.nulls)
        self.starts, self.ends, self.first = word_spans(self.slice)
        self.words = span_hashes(body, self.starts, self.ends)
        self.in_row = within_rows(self.first, settings.window)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of anchors that lie in some window, and their hashes."""
        s = self.set
        h = window_hashes(self.words, s.anchor, 1)
        use = np.zeros(len(h), bool)
        for r in s.cover:
            use[r :: s.period] = True
        # A place p is within a window that starts in p - period + 1 .. p.
        near = np.concatenate([[0], np.cumsum(self.in_row)])
        at = np.flatnonzero(use)
        at = at[near[np.minimum(at + 1, len(near) - 1)] > near[np.clip(at - s.period + 1, 0, len(near) - 1)]]
        return at, h[at]

    def windows(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows that hold a repeated anchor (repeated: places), and two hashes of each."""
        s, m = self.set, len(self.in_row)
        mark = np.zeros(len(self.words) + 1, np.int64)
        mark[repeated + 1] = 1
        upto = np.cumsum(mark)
        starts = np.arange(m)
        at = np.flatnonzero(self.in_row & (upto[np.minimum(starts + s.period, len(self.words))] > upto[starts]))
        return at, window_hashes(self.words, s.window, 2)[at], window_hashes(self.words, s.window, 3)[at]


class Settings:
    def __init__(self, window: int, period: int, cover: tuple[int, ...]):
        if not covers(period, cover) or period > window:
            raise ValueError("not a difference cover, or longer than a window")
        self.window, self.period, self.cover, self.anchor = window, period, cover, window - period + 1


_SHIFT = np.uint64(32)


def _bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Of sorted hashes, where each bucket (equal ranges of the upper 32 bits) begins."""
    return np.searchsorted((sorted_hashes >> _SHIFT).astype(np.int64) * buckets >> 32, np.arange(buckets + 1))


def _unique_anchors(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at, h = chunk.anchors()
    some, back, n = np.unique(h, return_inverse=True, return_counts=True)
    return at, some, back, n


def _unique_windows(chunk: Chunk, repeated: np.ndarray) -> tuple[np.ndarray, ...]:
    """Candidate windows' starts; the distinct windows in order of both hashes; of each candidate its distinct window; the first candidate of each."""
    at, a, b = chunk.windows(repeated)
    order = np.lexsort((at, b, a))
    a, b, at = a[order], b[order], at[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return at, a[new], b[new], np.cumsum(new) - 1, new


def _reply_bits(masks: pd.DataFrame, edges: np.ndarray) -> np.ndarray:
    """Bits of all buckets, in the order of the hashes."""
    out = np.zeros(int(edges[-1]), bool)
    for bucket, mask in zip(masks["bucket"], masks["mask"]):
        lo, hi = edges[bucket], edges[bucket + 1]
        if len(mask) != (hi - lo + 7) // 8:
            raise ValueError(f"a mask of {len(mask)} bytes for {hi - lo} hashes")
        out[lo:hi] = np.unpackbits(np.frombuffer(mask, np.uint8), count=hi - lo).astype(bool)
    return out


def _repeated(chunk: Chunk, masks: pd.DataFrame, buckets: int) -> np.ndarray:
    at, some, back, n = _unique_anchors(chunk)
    bits = _reply_bits(masks, _bucket_edges(some, buckets)) | (n > 1)
    return at[bits[back]]


def _six_bytes(h: np.ndarray) -> bytes:
    """The lower 48 bits; a chance hit of anchors costs a window's hash, nothing else."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _send_anchors(settings: Settings, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for row in df.itertuples():
                _, some, _, _ = _unique_anchors(Chunk(row, settings))
                e = _bucket_edges(some, buckets)
                full = np.flatnonzero(np.diff(e))
                yield pd.DataFrame({"bucket": full.astype(np.int32), "chunk": np.full(len(full), row.chunk), "hashes": objects(_six_bytes(some[e[k] : e[k + 1]]) for k in full)})

    return run


def _answer_anchors(df: pd.DataFrame) -> pd.DataFrame:
    """For each chunk's hashes of this bucket a bit: another chunk has it too."""
    parts = [_from_six(b) for b in df["hashes"]]
    all_ = np.sort(np.concatenate(parts))
    twice = all_[1:][all_[1:] == all_[:-1]]
    masks = [np.packbits(_has(twice, p)).tobytes() for p in parts]
    return pd.DataFrame({"chunk": df["chunk"], "bucket": df["bucket"], "mask": objects(masks)})


def _has(sorted_values: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(some), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, some), len(sorted_values) - 1)] == some


def _send_windows(settings: Settings, buckets: int):
    def run(chunks: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in chunks.itertuples():
            chunk = Chunk(row, settings)
            _, a, b, _, _ = _unique_windows(chunk, _repeated(chunk, masks, buckets))
            e = _bucket_edges(a, buckets)
            full = np.flatnonzero(np.diff(e))
            out.append(pd.DataFrame({"bucket": full.astype(np.int32), "chunk": np.full(len(full), row.chunk), "hashes": objects(a[e[k] : e[k + 1]].tobytes() + b[e[k] : e[k + 1]].astype(np.uint32).tobytes() for k in full)}))
        return pd.concat(out) if out else pd.DataFrame({"bucket": np.zeros(0, np.int32), "chunk": np.zeros(0, np.int64), "hashes": objects([])})

    return run


def _answer_windows(df: pd.DataFrame) -> pd.DataFrame:
    """For each chunk's windows of this bucket a bit: an earlier chunk has it."""
    df = df.sort_values("chunk", ignore_index=True)  # a fresh index: columns of the answer are matched by it
    sizes = [len(x) // 12 for x in df["hashes"]]
    a = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(df["hashes"], sizes)])
    b = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(df["hashes"], sizes)])
    order = np.lexsort((b, a))  # stable: of equal windows the earliest chunk comes first
    sa, sb = a[order], b[order]
    later = np.zeros(len(a), bool)
    later[order[1:]] = (sa[1:] == sa[:-1]) & (sb[1:] == sb[:-1])
    cuts = np.cumsum(sizes)[:-1]
    return pd.DataFrame({"chunk": df["chunk"], "bucket": df["bucket"], "mask": objects(np.packbits(m).tobytes() for m in np.split(later, cuts))})


def _cut(settings: Settings, buckets: int):
    def run(chunks: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in chunks.itertuples():
            chunk = Chunk(row, settings)
            at, a, _, which, new = _unique_windows(chunk, _repeated(chunk, masks[masks["kind"] == 0], buckets))
            earlier = _reply_bits(masks[masks["kind"] == 1], _bucket_edges(a, buckets))
            out.append(_kept_texts(chunk, at[~new | earlier[which]]))
        return pd.concat(out) if out else pd.DataFrame({"key": pd.Series([], dtype="Int64"), "n_words": np.zeros(0, np.int64), "n_removed": np.zeros(0, np.int64), "kept": objects([])})

    return run


def _kept_texts(chunk: Chunk, repeats: np.ndarray) -> pd.DataFrame:
    """Documents without the words of windows that start at these places."""
    n = len(chunk.words)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, repeats, 1)
    np.add.at(edge, repeats + chunk.set.window, -1)
    keep = np.cumsum(edge)[:n] == 0
    starts, ends = chunk.starts[keep], chunk.ends[keep]
    lengths = ends - starts + 1
    first = np.concatenate([[0], np.cumsum(lengths)])
    body = np.full(int(first[-1]), 32, np.uint8)  # each kept word and a blank
    for k in range(0, len(starts), 1 << 17):
        lo, some = slice(k, k + (1 << 17)), lengths[k : k + (1 << 17)] - 1
        inner = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
        body[inner + np.repeat(first[:-1][lo], some)] = chunk.slice.data[inner + np.repeat(starts[lo], some)]
    total = np.concatenate([[0], np.cumsum(keep)])[chunk.first]
    at = first[total]
    kept_ = [body[at[i] : max(at[i], at[i + 1] - 1)].tobytes().decode() for i in range(len(chunk.keys))]
    n_words = np.diff(chunk.first)
    return pd.DataFrame({"key": pd.Series(chunk.keys).astype("Int64").mask(pd.Series(chunk.nulls)), "n_words": n_words, "n_removed": n_words - np.diff(total), "kept": objects(kept_)})


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """key, n_words, n_removed and kept (the words left, joined by a blank), one row per row of docs."""
    settings = Settings(window, period, cover)
    spark = docs.sparkSession
    n = partitions(spark)
    begin = F.substring("text", 1, 64)  # so that rows of one key, or without any, are dealt out too; it is ordered as the text is
    chunks = kept(id_text(docs, key, text).repartitionByRange(n, "key", begin).sortWithinPartitions("key", "text").mapInArrow(frugal(_chunked), _CHUNK))
    release(spark)
    size = chunks.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(2 * n, size // BUCKET_BYTES + 1)
    by_chunk = chunks.groupBy("chunk")
    sent = chunks.mapInPandas(frugal(_send_anchors(settings, buckets)), "bucket int, chunk long, hashes binary")
    answer = "chunk long, bucket int, mask binary"
    anchors = kept(sent.groupBy("bucket").applyInPandas(_answer_anchors, answer))
    release(spark)
    windows = by_chunk.cogroup(anchors.groupBy("chunk")).applyInPandas(_send_windows(settings, buckets), "bucket int, chunk long, hashes binary")
    answers = windows.groupBy("bucket").applyInPandas(_answer_windows, answer)
    both = anchors.withColumn("kind", F.lit(0)).unionByName(answers.withColumn("kind", F.lit(1)))
    out = by_chunk.cogroup(both.groupBy("chunk")).applyInPandas(_cut(settings, buckets), "key long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("key", key)
