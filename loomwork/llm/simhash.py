"""SimHash near-duplicates by covering locality-sensitive hashing (Pagh, CoveringLSH).

Every bit of a fingerprint has a nonzero vector of RADIUS + 1 bits; the table of a nonzero vector w keeps the bits
whose vector has an odd product with w. The vectors of RADIUS bits can't span the space, so some w is orthogonal to
all of them, and there two fingerprints that differ in these bits only have equal keys: each pair within the radius
meets in some table, for certain.

Equal fingerprints are one node. A bucket of two to SMALL nodes is compared within one row. A larger bucket is dealt
out anew: each node is sent to itself and to every value one flip of a bit that the table doesn't keep away, and those
that meet there differ in at most two bits. No such meeting has more than 65 nodes, so a bucket of any size costs a
fixed number of rows a node and no pairs are made.

Rows: null and blank texts have fingerprint zero and link with one another like any other; rows that repeat a doc_id
share its number; a null doc_id is linked, but never names a component unless there's no other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import frugal, id_text, text_slices, word_spans
from .components import components
from .shared import kept

RADIUS = 2
SHINGLE = 3
SEED = 42
SMALL = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def masks(radius: int = RADIUS) -> list[int]:
    """Of each table the bits that it keeps."""
    size = 1 << (radius + 1)
    vector = [i % (size - 1) + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & w).bit_count() & 1) for w in range(1, size)]


def shingle_hashes(body: bytes, bounds: list[int], n: int, seed: int) -> np.ndarray:
    """XXH64 of each n words; body has the words joined by blanks, bounds where each starts, and the length plus one."""
    m, hash_ = max(1, len(bounds) - n), xxhash.xxh64_intdigest
    last = bounds[n:] or bounds[-1:]
    return np.fromiter((hash_(body[a : b - 1], seed) for a, b in zip(bounds[:m], last)), np.uint64, m)


def text_fingerprints(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each row."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    for i in range(len(out)):
        lo, hi = int(first[i]), int(first[i + 1])
        if lo == hi:
            continue
        text = data[starts[lo] : ends[hi - 1]]
        a, b = starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo]
        gap = np.ones(hi - lo, np.int64)
        gap[:-1] = a[1:] - b[:-1]
        if (gap > 1).any():  # several white-space characters in a row become one
            keep = np.ones(len(text), bool)
            for k in np.flatnonzero(gap > 1):
                keep[b[k] + 1 : b[k] + gap[k]] = False
            text = text[keep]
            a = a - np.concatenate([[0], np.cumsum(gap - 1)[:-1]])
        body = text.copy()
        body[(a - 1)[1:]] = 32
        raw, bounds = body.tobytes(), [*a.tolist(), len(body) + 1]
        total, m = np.zeros(64, np.int64), max(1, hi - lo - n + 1)
        for k in range(0, m, 1 << 16):
            h = shingle_hashes(raw, bounds[k : min(k + (1 << 16), m) + n], n, seed)
            total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(total * 2 > m, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp (64 bits as a signed number), one row per row of docs."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in text_slices(batch.column(1)):
                fp = text_fingerprints(_LOWER[s.data], s.offsets, *word_spans(s))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.rows), pa.array(fp.view(np.int64))], schema=schema)

    return id_text(docs, key, text).mapInArrow(frugal(run), "key long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """Links a, b that connect all of nodes (fp, distinct) within the radius: all pairs of small buckets, stars of one flip in others."""
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks())))
    rows = nodes.select("fp", F.explode(tables).alias("b")).select("fp", "b.*")
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    met = rows.join(sizes, ["t", "k"])
    lists = met.filter(F.col("n") <= small).groupBy("t", "k").agg(F.collect_list("fp").alias("l"))
    near = f"flatten(transform(l, x -> transform(filter(l, y -> y > x AND bit_count(x ^ y) <= {RADIUS}), y -> struct(x AS a, y AS b))))"
    pairs = lists.select(F.explode(F.expr(near)).alias("p")).select("p.*")
    flips = F.element_at(F.lit([[0] + [_signed(1 << i) for i in range(64) if not m >> i & 1] for m in masks()]), F.col("t") + 1)
    balls = met.filter(F.col("n") > small).select("fp", F.explode(flips).alias("e")).select("fp", F.col("fp").bitwiseXOR(F.col("e")).alias("centre"))
    stars = balls.groupBy("centre").agg(F.collect_set("fp").alias("l")).filter(F.size("l") > 1)
    return pairs.unionByName(stars.select(F.array_min("l").alias("a"), F.explode("l").alias("b")).filter("a <> b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp and component_id (the smallest key of all documents reachable by links), one row per row of docs."""
    prints = kept(fingerprints(docs, key, text))
    nodes = kept(prints.groupBy("fp").agg(F.min("key").alias("least")))
    label = components(links(nodes.select("fp"))).withColumnsRenamed({"node": "fp", "component": "c"})
    named = nodes.join(label, "fp", "left").withColumn("c", F.coalesce("c", "fp"))
    named = named.join(named.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", found: DataFrame | None = None) -> DataFrame:
    """Rows of docs, with all their columns: of each component the document that names it; rows that repeat key and text count as one, rows without a key all stay. found: key and component_id, near_duplicates of docs unless given."""
    names = docs.columns
    found = near_duplicates(docs, key, text) if found is None else found
    stay = found.filter(F.col(key) == F.col("component_id")).select(F.col(key).alias("stays")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("n"))
    first = rows.filter("k IS NOT NULL").join(stay, F.col("k") == F.col("stays"), "left_semi").groupBy("k", "h", "n").agg(F.first("row").alias("row"))
    return first.select("row").unionByName(rows.filter("k IS NULL").select("row")).select(*(F.col("row").getField(c).alias(c) for c in names))
