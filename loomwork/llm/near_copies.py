"""Near copies by covering masks: documents whose sets of WORDS-word shingles have a Jaccard similarity of SIMILARITY or more.

SimHash fingerprints can't reach so far: texts at a similarity of 0.8 differ in about 10 of 64 bits, and masks that cover 10 bits make 2,047 tables.
So the masks of the SimHash operator (`simhash.masks`) go, besides over the bits of a fingerprint, over min-wise samples of the shingles, of which texts at 0.8 share 8 in 10:
GROUPS groups of seven samples have seven tables each, and each pair that differs in two samples of a group or fewer meets in one of its tables,
for certain. At just 0.8 that fails in all groups, and with the fingerprint, once in some 300 pairs; nearer pairs meet oftener, and a group of several copies is held together by any of its pairs.

Documents of equal sets are one class. Classes that meet in a bucket are candidates: all pairs of a bucket of up to SMALL classes, and in larger ones each class with
three pivots. Candidates whose samples or sizes are too far apart for the similarity are put aside, and the others are compared by their whole sets. What is similar is
linked, and linked classes are one group. Only classes that this leaves out of the group of a larger bucket's pivot meet all others of the bucket: there whole sets are dealt to tasks in blocks, and a task counts what each
has in common with all others. Only pairs that link two groups leave a task, so no rows are made of the others however many there are, all of it is one round, and a group's links that aren't needed to hold it together are never made.

Words are runs of other characters than white space, A-Z in lower case; a text of fewer words is one shingle. Shingles with equal 64-bit hashes are taken as equal.

Rows: texts without a word have equal, empty sets; rows that repeat a key share its number; a null key is linked, but never names a group unless there's no other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import TextSlice, frugal, id_text, mixed, span_hashes, text_slices, window_hashes, word_spans
from .components import components
from .shared import join_spread, kept, release
from .simhash import _LOWER, _signed, masks

WORDS = 5
SIMILARITY = 0.8
GROUPS = 3
SMALL = 16
#: Classes that a task holds of each side where those left apart meet the others of a bucket.
BLOCK = 2048
#: Shingles of all of these together, about, at eight bytes.
BLOCK_SHINGLES = 1 << 21
#: Classes whose list, 16 bytes each, is broadcast at most.
FEW_CLASSES = 500_000
SEED = 8
#: Samples of a group, one for each vector of three bits but zero, and what each of its tables keeps.
_KEPT = [[i for i in range(7) if m >> i & 1] for m in masks()]
SAMPLES = 7 * GROUPS


def shingles(s: TextSlice, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of all rows, in order within each, and each row's first one (rows + 1 values)."""
    starts, ends, first = word_spans(s)
    w = span_hashes(_LOWER[s.data], starts, ends)
    size = np.diff(first)
    row = np.repeat(np.arange(s.rows), size)
    h = window_hashes(w, words)
    inside = row[: len(h)] == row[words - 1 :] if len(h) else np.zeros(0, bool)
    short = np.flatnonzero((size > 0) & (size < words))
    more = np.array([window_hashes(w[first[i] : first[i + 1]], int(size[i]))[0] for i in short], np.uint64)
    h, row = np.concatenate([h[inside], more]), np.concatenate([row[: len(h)][inside], short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(s.rows + 1))


def _sums(values: np.ndarray, first: np.ndarray, of: np.ufunc, some: np.ndarray) -> np.ndarray:
    """of over each row's values; 0 for an empty row (some: rows that aren't)."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype if values.dtype != np.uint8 else np.int64)
    if len(some):
        out[some] = of.reduceat(values, first[:-1][some], axis=0, dtype=out.dtype)
    return out


def signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row two sums that name its set, its samples, and its keys in all tables: those of the groups, then those of its fingerprint."""
    size = np.diff(first)
    some = np.flatnonzero(size)
    names = _names(h, first)
    seeds = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) + np.uint64(SEED << 32))
    samples = np.stack([_sums(mixed(h ^ x), first, np.minimum, some) for x in seeds], axis=1)
    keys = []
    for g in range(GROUPS):
        for t, at in enumerate(_KEPT):
            key = np.full(len(size), 7 * g + t + 1, np.uint64)
            for i in at:
                key = mixed(key ^ samples[:, 7 * g + i])
            keys.append(key)
    ones = np.zeros((len(size), 64), np.int64)
    for k in range(0, len(some), 256):  # bits of some rows at a time
        part = some[k : k + 256]
        lo, hi = int(first[part[0]]), int(first[part[-1] + 1])
        bits = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[part] = np.add.reduceat(bits, first[:-1][part] - lo, axis=0, dtype=np.int64)
    prints = np.packbits(ones * 2 > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    keys += [mixed((prints & np.uint64(m)) ^ mixed(np.array([7 * GROUPS + t + 1], np.uint64))) for t, m in enumerate(masks())]
    return names, samples, np.stack(keys, axis=1)


def _names(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two sums that name each row's set."""
    some = np.flatnonzero(np.diff(first))
    return np.stack([_sums(mixed(h ^ np.uint64(k)), first, np.add, some) for k in (1, 2)], axis=1)


def _binary(rows) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def signatures_of(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """key, class (16 bytes), id (its first eight as a number), size, keys of tables, and samples (the lower four bytes of each), one row per row of docs."""
    fields = [("key", pa.int64()), ("class", pa.binary()), ("id", pa.int64()), ("size", pa.int64()), ("tables", pa.list_(pa.int64())), ("samples", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in text_slices(batch.column(1)):
                h, first = shingles(s, words)
                names, samples, tables = signatures(h, first)
                size = np.diff(first)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size, tables.shape[1], 0))]).astype(np.int32)), pa.array(tables[size > 0].view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.rows), _binary(names), pa.array(np.ascontiguousarray(names[:, 0]).view(np.int64)), pa.array(size.astype(np.int64)), lists, _binary(samples.astype("<u4"))], schema=pa.schema(fields))

    return id_text(docs, key, text).mapInArrow(frugal(run), "key long, class binary, id long, size long, tables array<long>, samples binary")


def sets_of(docs: DataFrame, some: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """class and hashes, the whole set (eight bytes a shingle, in order), of some classes, from the texts themselves: so sets of classes that meet none are never stored. The list of classes is broadcast up to FEW_CLASSES of them, and joined beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in text_slices(batch.column(0)):
                h, first = shingles(s, words)
                yield pa.RecordBatch.from_arrays([_binary(_names(h, first)), pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], names=["class", "hashes"])

    whole = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(frugal(run), "class binary, hashes binary")
    some = kept(some)
    met = whole.join(F.broadcast(some) if some.count() <= FEW_CLASSES else some, "class", "left_semi")
    return kept(met.groupBy("class").agg(F.first("hashes").alias("hashes")))


def meetings(nodes: DataFrame) -> DataFrame:
    """id, k, m of all rows of buckets k of m classes, two at least, and three pivots x, y, z of the bucket: its first classes by three orders, so that buckets of much the same classes have the same."""
    rows = nodes.select("id", F.explode("tables").alias("k"))
    third = F.min(F.struct(F.xxhash64("id").alias("h"), "id")).getField("id")
    buckets = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("x"), F.max("id").alias("y"), third.alias("z")).filter("n > 1")
    return join_spread(rows, buckets.withColumn("m", F.col("n")), ["k"], ["id"])


def _once(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.*")


def candidates(met: DataFrame, small: int) -> DataFrame:
    """Pairs a, b of ids that meet: all of buckets of `small` classes or fewer, and each class of larger ones with the pivots. b is the one that many may meet."""
    stars = met.filter(F.col("m") > small).select(F.col("id").alias("a"), F.explode(F.array_distinct(F.array("x", "y", "z"))).alias("b")).filter("a <> b")
    lists = met.filter(F.col("m") <= small).groupBy("k").agg(F.array_sort(F.collect_list("id")).alias("l"))
    pairs = lists.select(F.explode(F.expr("flatten(transform(l, x -> transform(filter(l, y -> y < x), y -> struct(x AS a, y AS b))))")).alias("p")).select("p.*")
    return _once(stars.unionByName(pairs))


def _shared(similarity: float) -> float:
    """How many samples sets of this similarity share at least, all but one time in some hundred thousand."""
    return SAMPLES * similarity - 4.5 * np.sqrt(SAMPLES * similarity * (1 - similarity))


def verified(pairs: DataFrame, docs: DataFrame, text: str, words: int, nodes: DataFrame, similarity: float) -> DataFrame:
    """Classes a, b of those pairs of ids whose whole sets are similar: first by size and samples, then by the sets themselves. nodes: class, id, size, and samples. Classes that share an id are all compared."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(c), "<u4").reshape(-1, SAMPLES) for c in (a, b))
        return pd.Series((x == y).sum(axis=1) >= _shared(similarity))

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        return pd.Series(out, dtype=bool)

    pairs = kept(pairs)
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("class").alias(f"{c}_class"), F.col("size").alias(f"{c}_size"), F.col("samples").alias(f"{c}_samples"))
    often = lambda df: df.groupBy("b").agg(F.count("*").alias("n"))
    both = join_spread(pairs.join(side("a"), "a"), side("b").join(often(pairs), "b"), ["b"], ["a"])
    alike = F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size") - 1e-9
    left = kept(both.filter(alike & near("a_samples", "b_samples")).select(F.col("a_class").alias("a"), F.col("b_class").alias("b")))
    some = left.select(F.col("a").alias("class")).unionByName(left.select(F.col("b").alias("class"))).distinct()
    sets = sets_of(docs, some, text, words)
    named = lambda c: sets.select(F.col("class").alias(c), F.col("hashes").alias(f"{c}_hashes"))
    whole = join_spread(left.join(named("a"), "a"), named("b").join(often(left), "b"), ["b"], ["a"])
    return kept(whole.filter(similar("a_hashes", "b_hashes")).select("a", "b"))


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """class and c, the name of its group, for all of nodes."""
    label = components(links, "a", "b").withColumnsRenamed({"node": "class", "component": "c"})
    return nodes.select("class").join(label, "class", "left").withColumn("c", F.coalesce("c", "class"))


def _members(big: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """k, id, c, m, apart of all rows of big buckets: each class's group c, and whether it isn't that of its bucket's first pivot."""
    label = kept(_labels(nodes, links).join(nodes.select("class", "id"), "class").select("id", "c"))
    pivots = big.groupBy("x").agg(F.count("*").alias("n")).join(label.withColumnsRenamed({"id": "x", "c": "main"}), "x").groupBy("x").agg(F.max("n").alias("n"), F.min("main").alias("main"))
    return kept(join_spread(big, pivots, ["x"], ["id", "k"]).join(label, "id").select("k", "id", "c", "m", (F.col("c") != F.col("main")).alias("apart")))


def _gathered(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, .. of each of several runs of n."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def linking(a: list[np.ndarray], b: list[np.ndarray], a_groups: np.ndarray, b_groups: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places in a and b of similar sets (hashes, distinct) of different groups: as few as connect all groups that such pairs connect."""
    n, m = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    flat, own = np.concatenate([np.zeros(0, np.uint64), *b]), np.repeat(np.arange(len(b)), m)
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    group, out = np.arange(max([0, *a_groups, *b_groups]) + 1), []
    for k, x in enumerate(a):
        lo = np.searchsorted(flat, x, "left")
        both = np.bincount(own[_gathered(lo, np.searchsorted(flat, x, "right") - lo)], minlength=len(b))
        fits = np.flatnonzero((both > 0) & (both >= similarity * (n[k] + m - both) - 1e-9))
        mine = group[a_groups[k]]
        others, first = np.unique(group[b_groups[fits]], return_index=True)
        first = first[others != mine]
        if len(first):
            out += [(k, int(i)) for i in fits[first]]
            group[np.isin(group, others)] = mine
    return out


def linked_apart(big: DataFrame, docs: DataFrame, text: str, words: int, nodes: DataFrame, links: DataFrame, similarity: float, block: int) -> DataFrame | None:
    """Pairs a, b of classes that connect all that similar pairs of big buckets connect besides the links so far. None if no class is left out of its bucket's pivot's group.

    Classes left out meet all others of their bucket by their whole sets, in pairs of blocks which are dealt to tasks; those in the pivot's group needn't meet one another.
    """
    members = kept(_members(big, nodes, links).join(nodes.select("id", "class", "size"), "id"))
    of = lambda x: F.when(F.col("apart"), x)
    rest = kept(members.groupBy("k").agg(F.count(of(F.lit(1))).alias("r"), F.sum(of(F.col("size"))).alias("r_size"), F.count("*").alias("n"), F.sum("size").alias("n_size")).filter("r > 0"))
    if rest.isEmpty():
        return None
    blocks = lambda x: F.ceil(F.greatest(F.col(x) / block, F.col(f"{x}_size") / BLOCK_SHINGLES)).cast("int")
    rows = kept(join_spread(members, rest.select("k", "n", blocks("n").alias("many"), blocks("r").alias("few")), ["k"], ["id"]))
    sets = sets_of(docs, rows.select("class").distinct(), text, words)
    release(docs.sparkSession)
    rows = rows.join(sets, "class")
    place = lambda n: F.pmod(F.xxhash64("id", "k"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["k", "i", "j", "class", "c", "hashes"]
    left = rows.filter("apart").withColumn("i", place("few")).withColumn("j", every("many")).select(*columns)
    right = rows.withColumn("j", place("many")).withColumn("i", every("few")).select(*columns).toDF(*columns)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        names = [x.column("class").to_pylist() for x in (a, b)]
        sets = [[np.frombuffer(h, np.uint64) for h in x.column("hashes").to_pylist()] for x in (a, b)]
        code: dict[bytes, int] = {}
        groups = [np.array([code.setdefault(c, len(code)) for c in x.column("c").to_pylist()], np.int64) for x in (a, b)]
        found = linking(*sets, *groups, similarity)
        return pa.table({"a": pa.array([names[0][i] for i, _ in found], pa.binary()), "b": pa.array([names[1][j] for _, j in found], pa.binary())})

    by = ["k", "i", "j"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "a binary, b binary")


def left_apart(big: DataFrame, nodes: DataFrame, links: DataFrame, similarity: float, block: int, done: int = 0) -> DataFrame | None:
    """Candidates a, b from big buckets by samples alone, without a look at sets: of each class that the links so far leave out of its bucket's first pivot's group, the two likeliest partners of each other group in the bucket,
    or after the first `done` of them done + 2 more. None if no class is left out.

    Classes left out meet all others of their bucket, in pairs of blocks which are dealt to tasks; those in the pivot's group needn't meet one another.
    """
    members = _members(big, nodes, links)
    rest = members.filter("apart").groupBy("k").agg(F.count("*").alias("r"), F.first("m").alias("n"))
    if rest.isEmpty():
        return None
    many, few = (F.ceil(F.col(x) / block).cast("int") for x in ("m", "r"))
    rows = join_spread(members, rest, ["k"], ["id"]).join(nodes.select("id", "size", "samples"), "id").withColumns({"many": many, "few": few})
    place = lambda n: F.pmod(F.xxhash64("id", "k"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["k", "i", "j", "id", "c", "size", "samples"]
    left = rows.filter("apart").withColumn("i", place("few")).withColumn("j", every("many")).select(*columns)
    right = rows.withColumn("j", place("many")).withColumn("i", every("few")).select(*columns).toDF(*columns)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        x, y = (np.frombuffer(b"".join(d["samples"]), "<u4").reshape(-1, SAMPLES) for d in (a, b))
        n, m = a["size"].to_numpy(), b["size"].to_numpy()
        groups, codes = np.unique(np.concatenate([a["c"].to_numpy(dtype=object), b["c"].to_numpy(dtype=object)]), return_inverse=True)
        own_ids, other_ids, out = a["id"].to_numpy(), b["id"].to_numpy(), []
        for k in range(len(a)):
            same = (y == x[k]).sum(axis=1)
            fits = np.flatnonzero((same >= _shared(similarity)) & (codes[len(a) :] != codes[k]) & (np.minimum(m, n[k]) >= similarity * np.maximum(m, n[k]) - 1e-9))
            fits = fits[np.lexsort((other_ids[fits], -same[fits], codes[len(a) :][fits]))]
            own = codes[len(a) :][fits]
            nth = np.arange(len(fits)) - np.searchsorted(own, own)
            out += [(own_ids[k], other_ids[i]) for i in fits[(nth >= done) & (nth < 2 * done + 2)]]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    by = ["k", "i", "j"]
    return _once(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, "a long, b long"))


def links(docs: DataFrame, text: str, words: int, nodes: DataFrame, similarity: float = SIMILARITY, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Verified pairs a, b of classes that connect all classes that the verified pairs of all buckets connect."""
    met = kept(meetings(nodes))
    found = verified(candidates(met, small), docs, text, words, nodes, similarity)
    release(docs.sparkSession)
    big = met.filter(F.col("m") > small).select("k", "id", "m", "x")
    more = None if big.isEmpty() else linked_apart(big, docs, text, words, nodes, found, similarity, block)
    if more is not None:
        found = kept(found.unionByName(more))
        release(docs.sparkSession)
    return found


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """key and component_id (the smallest key of its group), one row per row of docs."""
    base = kept(signatures_of(docs, key, text, words))
    nodes = kept(base.groupBy("class").agg(F.min("key").alias("least"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("id", "size", "tables", "samples"))))
    named = _labels(nodes, links(docs, text, words, nodes, similarity, small)).join(nodes.select("class", "least", "n"), "class")
    named = named.join(named.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("class", "n", "component_id")
    return join_spread(base.select("key", "class"), named, ["class"], ["key"]).select(F.col("key").alias(key), "component_id")
