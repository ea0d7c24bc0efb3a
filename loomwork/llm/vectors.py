"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations (Andoni et al., Practical and Optimal LSH for Angular Distance).

A rotation is three rounds of random signs and a Hadamard transform; its code is the axis, with its sign, that the
rotated vector is nearest to. A table joins the codes of several rotations, as many as keep a bucket to about
BUCKET vectors. Each vector goes to PROBES buckets of every table: the nearest combination and the next ones
by how much nearer the best is. Two vectors meet if any of their buckets agree, and tables are added until simulated pairs
at exactly the threshold meet with probability TARGET (nearer pairs meet oftener). Every pair that meets is verified
by its cosine in double precision, so none below the threshold is ever linked.

Buckets of one table whose codes begin alike are one home, as many rotations being the beginning as leave about HOME_ROWS vectors
or fewer in it. A vector is sent to each of its homes once, with its codes up to that table, however many buckets it has there.

Equal vectors are one class, compared once. A pair that meets several times counts where it meets first. What comes
out of a bucket are counts and a label for each member, not pairs.

A bucket above BLOCK members has a pivot. Vectors within half the threshold's angle of one pivot are a core: all of them
link with one another, so these links are counted by the core's size, however large it is. The rest of such a bucket is dealt out in pairs of
blocks to different tasks, and blocks of one core aren't paired.

Rows: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and neither do rows
without a number; vectors of different lengths never link; rows that repeat a number count each on their own, under one number;
extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import frugal, objects
from .components import components
from .shared import kept

THRESHOLD = 0.9
PROBES = 4
TOP = 3
BUCKET = 512
BLOCK = 2048
TARGET = 0.9995
SEED = 20
#: Rows that a task takes at a time, about.
GROUP_ROWS = 20_000
#: Vectors of one home, about; a home of four times as many is taken bucket by bucket.
HOME_ROWS = 1 << 17


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix, by butterflies; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


class CrossPolytope:
    """Codes of vectors of one length in all tables."""

    def __init__(self, dim: int, tables: int, rotations: int, probes: int = PROBES, seed: int = SEED):
        self.dim, self.tables, self.rotations, self.probes = dim, tables, rotations, probes
        self.width = max(2, 1 << max(0, dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, rotations, 3, self.width))
        top = min(TOP, self.width)
        self.choices = np.array(list(itertools.product(range(top), repeat=rotations)))
        self.top = top
        self.kind = "<i4" if (2 * self.width) ** rotations < 1 << 31 else "<i8"

    def codes(self, x: np.ndarray) -> np.ndarray:
        """For each unit vector and table the probed buckets, nearest first: an array of rows x tables x probes."""
        probes = min(self.probes, len(self.choices))
        out = np.empty((len(x), self.tables, probes), np.int64)
        wide = np.zeros((len(x), self.width))
        wide[:, : self.dim] = x
        for t in range(self.tables):
            cost, value = np.zeros((len(x), len(self.choices))), np.zeros((len(x), len(self.choices)), np.int64)
            for r in range(self.rotations):
                y = wide
                for k in range(3):
                    y = hadamard(y * self.signs[t, r, k]) / math.sqrt(self.width)
                size = np.abs(y)
                best = np.argsort(-size, axis=1, kind="stable")[:, : self.top]
                near = np.take_along_axis(size, best, 1)
                code = 2 * best + (np.take_along_axis(y, best, 1) < 0)
                pick = self.choices[:, r]
                cost += ((near[:, :1] - near) ** 2)[:, pick]
                value += code[:, pick] * (2 * self.width) ** r
            order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            out[:, t] = np.take_along_axis(value, order, 1)
        return out


def meeting_rate(dim: int, rotations: int, threshold: float, pairs: int = 4000) -> float:
    """How often simulated pairs at exactly the threshold meet in one table; worked out over eight tables."""
    rng = np.random.default_rng(SEED + 1)
    x = unit(rng.standard_normal((pairs, dim)))
    z = rng.standard_normal((pairs, dim))
    z = unit(z - (z * x).sum(1, keepdims=True) * x) if dim > 1 else 0 * x
    family = CrossPolytope(dim, 8, rotations)
    a, b = family.codes(x), family.codes(threshold * x + math.sqrt(1 - threshold**2) * z)
    return float((a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3)).mean())


def plan(dim: int, n: int, threshold: float = THRESHOLD, target: float = TARGET) -> CrossPolytope:
    """Rotations by the number of vectors, tables by the rate at which pairs meet."""
    width = max(2, 1 << max(0, dim - 1).bit_length())
    rotations = max(1, math.ceil(math.log(max(1, n * PROBES / BUCKET)) / math.log(2 * width)))
    rate = min(meeting_rate(dim, rotations, threshold), 1 - 1e-9)
    return CrossPolytope(dim, max(2, math.ceil(math.log(1 - target) / math.log(1 - rate))), rotations)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(column: pd.Series, kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64))


def _first_meeting(a: np.ndarray, b: np.ndarray, table: int, code: int) -> np.ndarray:
    """Of pairs of code arrays (pairs x tables x probes) that meet here, whether they meet nowhere before: neither in an earlier table nor in a smaller bucket of this one."""
    out = np.ones(len(a), bool)
    for t in range(table + 1):
        left = np.flatnonzero(out)
        same = a[left, t, :, None] == b[left, t, None, :]
        if t == table:
            same &= a[left, t, :, None] < code
        out[left[same.any(axis=(1, 2))]] = False
    return out


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member that each member reaches by the links i, j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class _Found:
    """Links found among rows of one task: of each row their number, and a label by bucket."""

    def __init__(self, df: pd.DataFrame, kind: str, code_kind: str, probes: int, threshold: float):
        self.node, self.size, self.threshold = df["node"].to_numpy(dtype=object), df["n_copies"].to_numpy(), threshold
        self.x, self.core = _vectors(df["vec"], kind), pd.factorize(df["core"])[0]  # -1 for none
        width = max(map(len, df["codes"]), default=0)  # rows of earlier tables have fewer codes
        self.codes = np.frombuffer(b"".join(c.ljust(width, b"\xff") for c in df["codes"]), code_kind).reshape(len(df), -1, probes)
        self.out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def compare(self, left: np.ndarray, right: np.ndarray, table: int, code: int) -> None:
        """Pairs of rows that meet here first; left and right are the same rows, or none is in both."""
        same = left is right
        a, b = np.nonzero(self.x[left] @ self.x[right].T >= self.threshold)
        if same:
            a, b = a[a < b], b[a < b]
        a, b = left[a], right[b]
        other = (self.core[a] != self.core[b]) | (self.core[a] < 0)  # links within a core are counted without being looked at
        a, b = a[other], b[other]
        if len(a):
            first = np.concatenate([_first_meeting(self.codes[a[k : k + 50_000]], self.codes[b[k : k + 50_000]], table, code) for k in range(0, len(a), 50_000)])
            a, b = a[first], b[first]
        if not len(a):
            return
        rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        count = np.zeros(len(rows), np.int64)
        np.add.at(count, at, np.concatenate([self.size[b], self.size[a]]))
        label = _labels(len(rows), at[: len(a)], at[len(a) :])
        self.out.append((self.node[rows], count, self.node[rows[label]]))

    def frame(self) -> pd.DataFrame:
        if not self.out:
            return pd.DataFrame({"node": objects([]), "n": np.zeros(0, np.int64), "label": objects([])})
        nodes, n, labels = (np.concatenate(x) for x in zip(*self.out))
        return pd.DataFrame({"node": objects(nodes), "n": n, "label": objects(labels)})


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal keys begin and end."""
    n = len(keys[0])
    if not n:
        return []
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    at = np.flatnonzero(new)
    return list(zip(at.tolist(), [*at[1:].tolist(), n]))


def _verify_homes(kind: str, code_kind: str, probes: int, threshold: float, space: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For all buckets of some homes, which are whole here: of each member that has links, their number and a label. Buckets above BLOCK are left to _verify_blocks."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["home", "node"], kind="stable", ignore_index=True)
        found, home = _Found(df, kind, code_kind, probes, threshold), df["home"].to_numpy()
        for lo, hi in _runs(home):
            table, lead = divmod(int(home[lo]), space)
            code = found.codes[lo:hi, table]
            row, probe = np.nonzero(code % space == lead)
            value = code[row, probe]
            order = np.argsort(value, kind="stable")
            row, value = row[order] + lo, value[order]
            for i, j in _runs(value):
                if 1 < j - i <= BLOCK:
                    members = row[i:j]
                    found.compare(members, members, table, int(value[i]))
        return found.frame()

    return run


def _verify_blocks(kind: str, code_kind: str, probes: int, threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The same for buckets, or pairs of their blocks, that are dealt out on their own."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["t", "code", "i", "j", "node"], kind="stable", ignore_index=True)
        found = _Found(df, kind, code_kind, probes, threshold)
        t, code, i, j, block = (df[c].to_numpy() for c in ("t", "code", "i", "j", "block"))
        for lo, hi in _runs(t, code, i, j):
            rows = np.arange(lo, hi)
            if i[lo] == j[lo]:
                found.compare(rows, rows, int(t[lo]), int(code[lo]))
            else:
                found.compare(rows[block[lo:hi] == i[lo]], rows[block[lo:hi] == j[lo]], int(t[lo]), int(code[lo]))
        return found.frame()

    return run


def _sent(family: CrossPolytope, kind: str):
    def run(batches):
        for df in batches:
            if len(df):
                x = np.stack(df["v"].to_numpy()).astype(kind)
                codes = family.codes(unit(x.astype(np.float64)))
                yield pd.DataFrame({"node": df["node"].astype(object), "vec": [row.tobytes() for row in x], "n_copies": df["n_copies"], "codes": [c.tobytes() for c in codes.astype(family.kind)], "buckets": list(codes.reshape(len(df), -1))})

    return run


def _cores(rows: DataFrame, kind: str, threshold: float) -> DataFrame:
    """node and core of vectors within half the threshold's angle of a pivot, the least node of a big bucket (rows are those of big buckets); two with one core link for certain. Of several pivots the least counts."""
    least = float(np.sqrt((1 + threshold) / 2)) + 1e-9

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series((_vectors(a, kind) * _vectors(b, kind)).sum(axis=1) >= least)

    inside = rows.select("t", "code", "node", "vec")
    pivots = inside.groupBy("t", "code").agg(F.min(F.struct("node", "vec")).alias("p")).select("t", "code", F.col("p.node").alias("core"), F.col("p.vec").alias("pivot"))
    return inside.join(pivots, ["t", "code"]).filter(near("vec", "pivot")).groupBy("node").agg(F.min("core").alias("core"))


def _dealt(rows: DataFrame, met: DataFrame) -> DataFrame:
    """Rows of big buckets, once for each pair i, j of blocks that theirs is part of. Rows of one core that fill half a block have blocks of their own, which aren't paired with one another."""
    met = met.select("t", "code")
    kinds = rows.filter("core IS NOT NULL").groupBy("t", "code", "core").agg(F.count("*").alias("m")).filter(F.col("m") >= BLOCK / 2).select("t", "code", F.col("core").alias("own"))
    named = rows.join(met, ["t", "code"]).join(kinds.withColumnsRenamed({"t": "t2", "code": "code2"}), F.expr("t = t2 AND code = code2 AND core = own"), "left").drop("t2", "code2").withColumn("own", F.coalesce("own", F.lit("")))
    sizes = named.groupBy("t", "code", "own").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    lists = sizes.groupBy("t", "code").agg(F.collect_list(F.struct(F.col("own").alias("k"), F.col("blocks").alias("n"))).alias("kinds"))
    placed = named.join(sizes, ["t", "code", "own"]).join(lists, ["t", "code"]).withColumn("block", F.expr("concat(own, '#', pmod(xxhash64(node, 7), blocks))"))
    others = "flatten(transform(filter(kinds, x -> x.k <> own OR own = ''), x -> transform(sequence(0, x.n - 1), b -> concat(x.k, '#', b))))"
    return placed.withColumn("other", F.explode(F.expr(others))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})


def _class_links(classes: DataFrame, dim: int, kind: str, threshold: float, target: float) -> DataFrame:
    """node, n and label for classes of vectors of one length."""
    n = classes.count()
    family = plan(dim, n, threshold, target)
    probes, codes = min(family.probes, len(family.choices)), 4 if family.kind == "<i4" else 8
    lead = next(k for k in range(family.rotations + 1) if k == family.rotations or n / (2 * family.width) ** k <= HOME_ROWS / 2)
    space = (2 * family.width) ** lead
    sent = kept(classes.mapInPandas(frugal(_sent(family, kind)), "node string, vec binary, n_copies long, codes binary, buckets array<long>"))
    table = F.floor(F.col("at") / probes).cast("int").alias("t")
    sizes = sent.select(F.posexplode("buckets").alias("at", "code")).groupBy(table, "code").agg(F.count("*").alias("n"))
    big, links = kept(sizes.filter(F.col("n") > BLOCK)), None  # one in BLOCK of the buckets' rows at most
    homes = F.array_distinct(F.transform("buckets", lambda c, at: F.floor(at / probes) * space + F.pmod(c, F.lit(space))))
    homed = kept(sent.select(F.explode(homes).alias("home")).groupBy("home").agg(F.count("*").alias("n")))
    wide = homed.filter(F.col("n") > 4 * HOME_ROWS).select("home")
    rows = sent.withColumn("core", F.lit(None).cast("string"))
    some_big = not big.isEmpty()
    if some_big:
        cores = kept(_cores(_spread(sent, table).join(big.select("t", "code"), ["t", "code"]), kind, threshold))
        rows = sent.join(cores, "node", "left")
        members = cores.join(sent.select("node", "n_copies"), "node")
        whole = members.groupBy("core").agg(F.sum("n_copies").alias("s"))
        links = members.join(whole, "core").select("node", (F.col("s") - F.col("n_copies")).alias("n"), F.col("core").alias("label"))
    sums = homed.agg(F.count("*").alias("homes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    groups = max(1, sums["rows"] // GROUP_ROWS)
    homely = rows.select("node", "vec", "n_copies", "codes", "core", F.explode(homes).alias("home")).withColumn("codes", F.expr(f"substring(codes, 1, cast((home div {space} + 1) * {probes * codes} as int))"))
    some_wide = not wide.isEmpty()
    if some_wide:
        homely = homely.join(wide, "home", "left_anti")
    group = F.col("home") if sums["homes"] <= 4 * groups else F.pmod(F.xxhash64("home"), F.lit(groups))
    schema = "node string, n long, label string"
    found = homely.groupBy(group.alias("g")).applyInPandas(_verify_homes(kind, family.kind, probes, threshold, space), schema)
    if some_big or some_wide:
        columns = ["t", "code", "i", "j", "block", "node", "core", "vec", "n_copies", "codes"]
        spread = _spread(rows, table).withColumn("codes", F.expr(f"substring(codes, 1, (t + 1) * {probes * codes})"))
        own = spread.withColumn("home", F.col("t") * space + F.pmod("code", F.lit(space))).join(wide, "home", "left_semi").join(big.select("t", "code"), ["t", "code"], "left_anti")
        dealt = own.withColumns(dict.fromkeys(("i", "j", "block"), F.lit("#"))).select(*columns).unionByName(_dealt(spread, big).select(*columns))
        total = big.agg(F.coalesce(F.sum(F.col("n") * F.ceil(F.col("n") / BLOCK)), F.lit(0)).alias("n")).first()["n"] + sums["rows"] * some_wide
        grouped = dealt.groupBy(F.expr(f"pmod(xxhash64(t, code, i, j), {max(1, total // GROUP_ROWS)})").alias("g"))
        found = found.unionByName(grouped.applyInPandas(_verify_blocks(kind, family.kind, probes, threshold), schema))
    return found if links is None else found.unionByName(links)


def _spread(rows: DataFrame, table: Column) -> DataFrame:
    """A row for each bucket of each vector."""
    return rows.select(*(c for c in rows.columns if c != "buckets"), F.posexplode("buckets").alias("at", "code")).withColumn("t", table).drop("at")


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """key, n_links (other vectors linked directly), component_id (the smallest key reachable by links, its own included) and kept (key = component_id), one row per row."""
    spark = rows.sparkSession
    wide = rows.schema[vector].dataType.elementType.simpleString() != "float"
    item, kind = ("double", "<f8") if wide else ("float", "<f4")
    v = F.col(vector).cast(f"array<{item}>")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf")))) | ~F.exists(v, lambda e: e != 0)
    clean = F.transform(v, lambda e: F.when(e == 0, F.lit(0).cast(item)).otherwise(e))  # no negative zero
    named = kept(rows.select(F.col(key).cast("long").alias("key"), F.when(~bad & F.col(key).isNotNull(), clean).alias("v")).withColumn("node", F.md5(F.col("v").cast("string"))))
    each = named.filter("node IS NOT NULL").groupBy("node").agg(F.first("v").alias("v"), F.count("*").alias("n_copies"), F.min("key").alias("least"))
    # A class goes by its least key, which sorts as text as it does as a number, and its digest: the least name of a component has its least key.
    name = F.concat(F.lpad(F.hex(F.col("least").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), "node")
    classes = kept(each.withColumn("digest", F.col("node")).withColumn("node", name))
    found = spark.createDataFrame([], "node string, n long, label string")
    for d in sorted(r["d"] for r in classes.select(F.size("v").alias("d")).distinct().collect()):
        found = found.unionByName(_class_links(classes.filter(F.size("v") == d).select("node", "v", "n_copies"), d, kind, threshold, target))
    found = kept(found)
    label = components(found, "node", "label").withColumnRenamed("component", "c")
    one = classes.drop("v").join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(label, "node", "left")
    first = F.conv(F.substring(F.coalesce("c", "node"), 1, 16), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    one = one.select(F.col("digest").alias("node"), (F.col("n_copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), first.alias("component"))
    out = named.select("key", "node").join(one, "node", "left").withColumn("component", F.coalesce("component", "key"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("key") == F.col("component"), F.lit(True)).alias("kept"))
