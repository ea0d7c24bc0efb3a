"""Runs, gaps and intervals along an order. A partition is what a window needs together; an entity with very many rows is best cut by a coarser key first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Runs of consecutive integers of each group: first, last and length; repeated values count once, nulls not at all."""
    one = rows.select(group, F.col(value).cast("long").alias("v")).filter("v IS NOT NULL").distinct()
    run = F.col("v") - F.row_number().over(Window.partitionBy(group).orderBy("v"))
    return one.withColumn("r", run).groupBy(group, "r").agg(F.min("v").alias("first"), F.max("v").alias("last"), F.count("*").alias("length")).drop("r")


def value_runs(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values: run (from 1), value, length; rows without a value are skipped first."""
    some = rows.filter(F.col(value).isNotNull())
    w = Window.partitionBy(group).orderBy(*order)
    new = F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1)
    marked = some.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "run", value).agg(F.count("*").alias("length"))


def longest_run(rows: DataFrame, group: str, order: list[str], condition: Column) -> DataFrame:
    """The longest run of rows of each group for which the condition holds, 0 if there's none; null counts as false."""
    w = Window.partitionBy(group).orderBy(*order)
    c = rows.select(group, *order, F.coalesce(condition, F.lit(False)).alias("c"))
    broken = F.sum(F.when(F.col("c"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = c.withColumn("r", broken).groupBy(group, "r").agg(F.count_if("c").alias("n"))
    return runs.groupBy(group).agg(F.max("n").alias("longest"))


def gap_clusters(rows: DataFrame, group: str, position: str, gap: float) -> DataFrame:
    """Clusters of positions of each group: a new one begins after a gap larger than gap. cluster (from 1), first, last, n; nulls don't count."""
    some = rows.select(group, F.col(position).alias("p")).filter("p IS NOT NULL")
    w = Window.partitionBy(group).orderBy("p")
    new = F.when(F.col("p") - F.lag("p").over(w) <= gap, 0).otherwise(1)
    marked = some.withColumn("n", new).withColumn("cluster", F.sum("n").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "cluster").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.count("*").alias("n"))


def modal_gap(rows: DataFrame, group: str, position: str, share: float = 0.7, tolerance: float = 0.1) -> DataFrame:
    """The commonest gap between distinct positions of each group (the smaller of equals; null unless it occurs twice), the share of gaps within tolerance of it, and whether that makes the group periodic."""
    one = rows.select(group, F.col(position).cast("long").alias("p")).filter("p IS NOT NULL").distinct()
    gaps = one.select(group, (F.col("p") - F.lag("p").over(Window.partitionBy(group).orderBy("p"))).alias("gap")).filter("gap IS NOT NULL").groupBy(group, "gap").agg(F.count("*").alias("n"))
    mode = gaps.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("m"), "gap")).alias("b")).filter("b.m < -1").select(group, F.col("b.gap").alias("mode"))
    near = F.abs(F.col("gap") - F.col("mode")) <= F.col("mode") * tolerance
    out = gaps.join(mode, group).groupBy(group, "mode").agg((F.sum(F.when(near, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    return out.withColumn("periodic", F.col("share") >= share)


#: Damage patterns: the largest gap within a lesion, the shortest and thinnest burst, and how many sectors a periodic one has at least.
LINK_GAP, LEAST_BURST, SOLID, LEAST_PERIODIC = 128, 3, 0.85, 5


def _spacing(spots: DataFrame, by: list[str]) -> DataFrame:
    """Of sorted positions p: ones (the share of gaps of 1) and periodic: the commonest gap (the smaller of equals) is above 1 and 70 in 100 gaps are within a tenth of it, or 1."""
    gaps = spots.select(*by, (F.col("p") - F.lag("p").over(Window.partitionBy(*by).orderBy("p"))).alias("gap")).filter("gap IS NOT NULL").groupBy(*by, "gap").agg(F.count("*").alias("n"))
    mode = gaps.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), "gap")).alias("b")).select(*by, F.col("b.gap").alias("mode"))
    near = F.abs(F.col("gap") - F.col("mode")) <= F.greatest(F.lit(1), F.floor(F.col("mode") / 10))
    out = gaps.join(mode, by).groupBy(*by, "mode").agg((F.sum(F.when(near, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"), (F.sum(F.when(F.col("gap") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("ones"), F.sum("n").alias("gaps"))
    return out.select(*by, "ones", "gaps", ((F.col("mode") > 1) & (F.col("share") >= 0.7)).alias("periodic"))


def lesions(bad: DataFrame, group: str, position: str) -> DataFrame:
    """Lesions of failing positions (from 0; repeats count once): first, last, n and kind. A lesion's gaps are at most LINK_GAP.

    A near-solid one is a burst, an evenly spaced one periodic, and others scatter. If all scattered positions of a group are evenly spaced
    together, they are one periodic lesion.
    """
    one = bad.select(F.col(group).alias("g"), F.col(position).cast("long").alias("p")).filter("p >= 0").distinct()
    w = Window.partitionBy("g").orderBy("p")
    marked = one.withColumn("_n", F.when(F.col("p") - F.lag("p").over(w) <= LINK_GAP, 0).otherwise(1)).withColumn("c", F.sum("_n").over(w)).drop("_n")
    each = marked.groupBy("g", "c").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.count("*").alias("n"))
    span = F.col("last") - F.col("first") + 1
    kind = F.when(F.col("n") == 1, "scatter").when((span >= LEAST_BURST) & ((F.col("ones") >= 0.9) | (F.col("n") / span >= SOLID)), "burst").when((F.col("n") >= LEAST_PERIODIC) & F.col("periodic"), "periodic").otherwise("scatter")
    each = each.join(_spacing(marked, ["g", "c"]), ["g", "c"], "left").withColumn("kind", kind).select("g", "c", "first", "last", "n", "kind")
    loose = marked.join(each.filter("kind = 'scatter'").select("g", "c"), ["g", "c"], "left_semi")
    comb = _spacing(loose, ["g"]).filter((F.col("gaps") >= LEAST_PERIODIC - 1) & F.col("periodic")).select("g", F.lit(True).alias("comb"))
    told = each.join(comb, "g", "left").withColumn("comb", F.coalesce("comb", F.lit(False)) & (F.col("kind") == "scatter"))
    out = told.groupBy("g", F.when(~F.col("comb"), F.col("c")).alias("c"), F.when(F.col("comb"), "periodic").otherwise(F.col("kind")).alias("kind")).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return out.select(F.col("g").alias(group), "first", "last", "n", "kind")


def damage_verdict(bad: DataFrame, group: str, position: str) -> DataFrame:
    """Of each group its failing positions, the longest run of neighbours, and a verdict: mixed if both physical (burst, scatter) and periodic lesions have a twentieth of them, otherwise the kind that has most."""
    some = bad.filter(F.col(position) >= 0)
    has = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    sums = lesions(some, group, position).groupBy(group).agg(F.sum("n").alias("bad"), has("burst").alias("x"), has("scatter").alias("y"), has("periodic").alias("z"))
    longest = islands(some, group, position).groupBy(group).agg(F.max("length").alias("longest"))
    physical = F.col("x") + F.col("y")
    mixed = (physical > 0) & (F.col("z") > 0) & (physical >= 0.05 * F.col("bad")) & (F.col("z") >= 0.05 * F.col("bad"))
    verdict = F.when(mixed, "mixed").when(F.col("z") > physical, "periodic").when(F.col("x") >= F.col("y"), "burst").otherwise("scatter")
    return sums.join(longest, group).select(group, "bad", "longest", verdict.alias("verdict"))


def coverage_sweep(regions: DataFrame, group: str, start: str, end: str, owner: str) -> DataFrame:
    """Gaps and overlaps of half-open regions in order of start: each is compared with the furthest-reaching earlier one, which other names."""
    w = Window.partitionBy(group).orderBy("s", "e", "o").rowsBetween(Window.unboundedPreceding, -1)
    r = regions.select(group, F.col(start).alias("s"), F.col(end).alias("e"), F.col(owner).alias("o"))
    top = F.max(F.struct("e", "o")).over(w)
    swept = r.withColumn("t", top).filter("t IS NOT NULL")
    size = F.col("s") - F.col("t.e")
    kind = F.when(size > 0, "gap").when(size < 0, "overlap")
    amount = F.when(size > 0, size).otherwise(F.least(F.col("e"), F.col("t.e")) - F.col("s"))
    return swept.select(group, F.col("s").alias("start"), F.col("o").alias("owner"), F.col("t.o").alias("other"), kind.alias("kind"), amount.alias("amount")).filter("kind IS NOT NULL")


def pad_merge(ranges: DataFrame, group: str, start: str, end: str, worst: str, pad: int) -> DataFrame:
    """Closed ranges grown by pad on both sides (not below 0) and merged where they touch: first, last, the worst state, and how many they were."""
    r = ranges.select(group, F.greatest(F.col(start) - pad, F.lit(0)).alias("s"), (F.col(end) + pad).alias("e"), F.col(worst).alias("w"))
    before = Window.partitionBy(group).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("s") <= F.max("e").over(before), 0).otherwise(1)
    marked = r.withColumn("n", new).withColumn("island", F.sum("n").over(Window.partitionBy(group).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "island").agg(F.min("s").alias("first"), F.max("e").alias("last"), F.max("w").alias("worst"), F.count("*").alias("n")).drop("island")


def reread_plan(sectors: DataFrame, group: str, position: str, state: str, pad: int = 2) -> DataFrame:
    """Ranges to read again: runs of sectors whose state isn't 0 (clean), grown by pad on both sides within the group's sectors (from 0) and merged where they touch: start, sectors and worst, and the passes that
    the group's worst state asks for: 3, 5 or 7 for states 1, 2 and above."""
    bad = sectors.filter(F.col(state) > 0).select(F.col(group).alias("g"), F.col(position).alias("p"), F.col(state).alias("s"))
    run = F.col("p") - F.row_number().over(Window.partitionBy("g").orderBy("p"))
    each = bad.withColumn("r", run).groupBy("g", "r").agg(F.min("p").alias("a"), (F.max("p") + 1).alias("b"), F.max("s").alias("worst"))
    size = sectors.groupBy(F.col(group).alias("g")).agg((F.max(position) + 1).alias("n"), F.max(state).alias("all"))
    grown = each.join(size, "g").select("g", "all", "worst", F.greatest(F.col("a") - pad, F.lit(0)).alias("a"), F.least(F.col("b") + pad, F.col("n")).alias("b"))
    w = Window.partitionBy("g").orderBy("a", "b")
    new = F.when(F.col("a") <= F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    told = grown.withColumn("_n", new).withColumn("i", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    passes = F.when(F.col("all") == 1, 3).when(F.col("all") == 2, 5).otherwise(7)
    out = told.groupBy("g", "i", "all").agg(F.min("a").alias("start"), F.max("b").alias("b"), F.max("worst").alias("worst"))
    return out.select(F.col("g").alias(group), "start", (F.col("b") - F.col("start")).alias("sectors"), "worst", passes.alias("passes"))


def paint(lesions: DataFrame, group: str, start: str, end: str, rank: str) -> DataFrame:
    """Each position of closed ranges with the highest rank that covers it."""
    spots = lesions.select(group, F.explode(F.sequence(F.col(start), F.col(end))).alias("position"), F.col(rank).alias("rank"))
    return spots.groupBy(group, "position").agg(F.max("rank").alias("rank"))


def placed(tracks: DataFrame, group: str, order: str, length: str, session: str, gap: int) -> DataFrame:
    """tracks with start: the lengths before, and gap for each change of session before."""
    w = Window.partitionBy(group).orderBy(order)
    extra = F.when(F.lag(session).over(w) != F.col(session), gap).otherwise(0)
    own = tracks.withColumn("_g", extra)
    total = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("start", total(length) + total("_g") + F.col("_g")).drop("_g")


def gap_to_previous(rows: DataFrame, group: str, order: str, start: str, end: str) -> DataFrame:
    """rows with gap: the start less the end of the row before; null for the first."""
    return rows.withColumn("gap", F.col(start) - F.lag(end).over(Window.partitionBy(group).orderBy(order)))


def plateau(rows: DataFrame, group: str, order: str, value: str, window: int) -> DataFrame:
    """rows with improved: the least value of the last window rows (this one included) is below all before them; true while there are none before."""
    w = Window.partitionBy(group).orderBy(order)
    late = F.min(value).over(w.rowsBetween(-(window - 1), 0))
    early = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -window))
    return rows.withColumn("improved", F.coalesce(late < early, F.lit(True)))


def moving_median(rows: DataFrame, group: str, order: list[str], value: str, window: int = 65, dip: float = 0.25) -> DataFrame:
    """rows with median (the upper one of an even number) of a centred window, cut at the ends, and is_dip: below (1 - dip) of it."""
    half = window // 2
    some = F.array_sort(F.collect_list(value).over(Window.partitionBy(group).orderBy(*order).rowsBetween(-half, half)))
    out = rows.withColumn("_m", some).withColumn("median", F.element_at("_m", (F.floor(F.size("_m") / 2) + 1).cast("int"))).drop("_m")
    return out.withColumn("is_dip", F.col(value) < (1 - dip) * F.col("median"))


def silence(samples: DataFrame, group: str, order: str, level: str, window: int, threshold: float, least: int) -> DataFrame:
    """Runs of at least `least` windows whose peak level is below the threshold: first and last window, from 0."""
    peaks = samples.groupBy(group, F.floor(F.col(order) / window).alias("w")).agg(F.max(F.abs(level)).alias("p"))
    quiet = islands(peaks.filter(F.col("p") < threshold), group, "w")
    return quiet.filter(F.col("length") >= least)


def audio_tracks(samples: DataFrame, group: str, order: str, level: str, window: int, threshold: float, least: int, least_track: int) -> DataFrame:
    """Tracks between silences (see silence): start and end trimmed to the loud samples, and pregap_start, where the silence before begins.

    What is shorter than least_track is no track of its own but lengthens the one before; the first always is one. Samples are reduced to a row a window first.
    """
    loud = F.abs(level) >= threshold
    w = samples.groupBy(F.col(group).alias("g"), F.floor(F.col(order) / window).alias("w")).agg(F.max(F.abs(level)).alias("p"), F.min(F.when(loud, F.col(order))).alias("lo"), F.max(F.when(loud, F.col(order))).alias("hi"))
    quiet = w.withColumn("q", F.col("p") < threshold)
    quiet = quiet.withColumn("r", F.col("w") - F.row_number().over(Window.partitionBy("g", "q").orderBy("w")))
    run = Window.partitionBy("g", "q", "r")
    gaps = quiet.withColumn("gap", F.col("q") & (F.count("*").over(run) >= least)).withColumn("begins", F.col("gap") & (F.row_number().over(run.orderBy("w")) == 1))
    cut = gaps.withColumn("seg", F.sum(F.col("begins").cast("int")).over(Window.partitionBy("g").orderBy("w")))
    segs = cut.groupBy("g", "seg").agg(F.min("lo").alias("a"), (F.max("hi") + 1).alias("b"), F.min(F.when(F.col("gap"), F.col("w") * window)).alias("before")).filter("a IS NOT NULL")
    by = Window.partitionBy("g").orderBy("seg")
    own = (F.col("b") - F.col("a") >= least_track) | (F.row_number().over(by) == 1)
    told = segs.withColumn("_own", own.cast("long")).withColumn("track", F.sum("_own").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("seg", "a", "before"))
    out = told.groupBy("g", "track").agg(first.alias("f"), F.max("b").alias("end"))
    return out.select(F.col("g").alias(group), "track", F.col("f.a").alias("start"), "end", F.when(F.col("f.seg") == 0, F.col("f.a")).otherwise(F.col("f.before")).alias("pregap_start"))


def chain_check(log: DataFrame, group: str, seq: str, previous: str, digest: str, payload: list[str]) -> DataFrame:
    """Of each chain, whether numbers run from 0, each link names the digest before it, and each digest is the SHA-256 of number, payload and previous digest, joined by line feeds."""
    w = Window.partitionBy(group).orderBy(seq)
    text = F.concat_ws("\n", F.col(seq).cast("string"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in payload), F.coalesce(previous, F.lit("")))
    ok = (F.col(seq) == F.row_number().over(w) - 1) & (F.coalesce(previous, F.lit("")) == F.coalesce(F.lag(digest).over(w), F.lit(""))) & (F.col(digest) == F.sha2(text, 256))
    marked = log.select(group, F.col(seq).alias("s"), F.coalesce(ok, F.lit(False)).alias("ok"))
    return marked.groupBy(group).agg(F.bool_and("ok").alias("valid"), F.min(F.when(~F.col("ok"), F.col("s"))).alias("first_bad"))


def chained(new: DataFrame, last: DataFrame, group: str, order: str, payload: list[str]) -> DataFrame:
    """New entries of chains as chain_check takes them: seq, previous and digest go on from the last entry of each (group, seq, digest), or from 0. The new entries of a chain are folded in order, so a batch's must be of bounded number."""
    text = F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in payload))
    rows = new.select(F.col(group).alias("g"), F.struct(F.col(order).alias("o"), text.alias("t"), F.struct(*payload).alias("row")).alias("e"))
    each = rows.groupBy("g").agg(F.array_sort(F.collect_list("e")).alias("es")).join(last.select(F.col(group).alias("g"), F.col("seq").cast("long").alias("s"), F.col("digest").alias("d")), "g", "left")
    start = F.struct(F.coalesce(F.col("s") + 1, F.lit(0).cast("long")).alias("seq"), F.coalesce("d", F.lit("")).alias("digest"), F.array().cast(f"array<struct<seq:bigint,previous:string,digest:string,row:{new.select(F.struct(*payload).alias('r')).schema['r'].dataType.simpleString()}>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        digest = F.sha2(F.concat_ws("\n", acc["seq"].cast("string"), e["t"], acc["digest"]), 256)
        entry = F.struct(acc["seq"].alias("seq"), acc["digest"].alias("previous"), digest.alias("digest"), e["row"].alias("row"))
        return F.struct((acc["seq"] + 1).alias("seq"), digest.alias("digest"), F.concat(acc["out"], F.array(entry)).alias("out"))

    folded = each.select("g", F.explode(F.aggregate("es", start, step)["out"]).alias("x"))
    return folded.select(F.col("g").alias(group), "x.seq", "x.previous", "x.digest", "x.row.*")
