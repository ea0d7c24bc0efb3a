"""Tallies, summaries, fits and mergeable sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import byte_function, crc16
from .runs import longest_run

DAYS_A_YEAR = 365.25


def status_counts(rows: DataFrame, group: list[str], status: str, values: list[str]) -> DataFrame:
    """Rows of each group by status, one column a value, and in all."""
    return rows.groupBy(*group).agg(*(F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values), F.count("*").alias("n"))


def consensus_tally(log: DataFrame) -> DataFrame:
    """Identities with distinct valid signers, a level (1, 2, or 3 for more), the first label that isn't empty (by seq), and disputed: the label, without case, names another identity too.

    log: identity, signer, label, seq, valid. Invalid rows count for nothing.
    """
    good = log.filter("valid")
    named = F.when(F.trim("label") != "", F.col("label"))
    each = good.groupBy("identity").agg(F.count_distinct("signer").alias("signers"), F.min_by(named, F.when(named.isNotNull(), F.col("seq"))).alias("label"))
    labels = good.filter(named.isNotNull()).groupBy(F.lower("label").alias("l")).agg(F.count_distinct("identity").alias("n")).filter("n > 1").select("l")
    marked = good.filter(named.isNotNull()).select("identity", F.lower("label").alias("l")).distinct().join(labels, "l").select(F.col("identity").alias("i")).distinct()
    return each.join(marked, F.col("identity") == F.col("i"), "left").select("identity", "signers", F.least("signers", F.lit(3)).cast("long").alias("level"), "label", F.col("i").isNotNull().alias("disputed"))


def leading_output(log: DataFrame, key: str, output: str, submitter: str) -> DataFrame:
    """Of each key the output with most distinct submitters (the first by name among equals), their number, and whether others disagree."""
    n = log.groupBy(key, output).agg(F.count_distinct(submitter).alias("n"))
    best = n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(output).alias("o"))).alias("b"), F.count("*").alias("k"))
    return best.select(key, F.col("b.o").alias(output), (-F.col("b.m")).alias("submitters"), (F.col("k") > 1).alias("disputed"))


def graded(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The grade of the first step that value doesn't exceed."""
    out = None
    for limit, name in steps:
        out = F.when(value <= limit, name) if out is None else out.when(value <= limit, name)
    return out.otherwise(otherwise)


def scan_summary(samples: DataFrame, group: list[str], metrics: list[str], grade_by: str, steps: list[tuple[float, str]], otherwise: str) -> DataFrame:
    """Maximum, average and total of each metric, nulls as 0, and a grade of one maximum."""
    v = {m: F.coalesce(F.col(m), F.lit(0)) for m in metrics}
    out = samples.groupBy(*group).agg(*(f(v[m]).alias(f"{n}_{m}") for m in metrics for n, f in (("max", F.max), ("avg", F.avg), ("sum", F.sum))))
    return out.withColumn("grade", graded(F.col(f"max_{grade_by}"), steps, otherwise))


def error_report(samples: DataFrame, group: str, value: str, order: str | None = None) -> DataFrame:
    """Average, maximum, total and the discrete 95th percentile (the value at place ceil(0.95 n)) of each group, and with order the longest run of values above 0."""
    v = F.col(value)
    out = samples.groupBy(group).agg(F.avg(v).alias("average"), F.max(v).alias("maximum"), F.sum(v).alias("total"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))
    return out.join(longest_run(samples, group, [order], v > 0).withColumnRenamed("longest", "burst"), group) if order else out


def linear_fit(rows: DataFrame, group: str, x: Column, y: Column) -> DataFrame:
    """Least squares of each group: n, slope, intercept, r2 and the slope's standard error (null below three rows); without spread of x slope and r2 are 0, without spread of y r2 is."""
    r = rows.select(group, x.cast("double").alias("x"), y.cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    s = r.groupBy(group).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.expr("regr_sxx(y, x)").alias("sxx"), F.expr("regr_syy(y, x)").alias("syy"), F.expr("regr_sxy(y, x)").alias("sxy"))
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")).otherwise(0.0)
    r2 = F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") * F.col("sxy") / F.col("sxx") / F.col("syy")).otherwise(0.0)
    left = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    out = s.withColumn("slope", slope).withColumn("r2", r2)
    return out.select(group, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "r2", F.when((F.col("n") > 2) & (F.col("sxx") > 0), F.sqrt(left / (F.col("n") - 2) / F.col("sxx"))).alias("slope_se"))


def growth_fit(history: DataFrame, group: str, time: str, errors: str, limit: float, cap_years: float = 500.0) -> DataFrame:
    """Exponential fit of ln(max(errors, 1)) over years since each group's first row: that of linear_fit, the last year, and the years until the limit is crossed (0 if the fit is there already, null if it doesn't grow, at most cap_years)."""
    first = history.groupBy(group).agg(F.min(time).alias("_t0"))
    dated = history.join(first, group)
    years = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))) / (86400e6 * DAYS_A_YEAR)
    fit = linear_fit(dated, group, years, F.log(F.greatest(F.col(errors), F.lit(1))))
    last = dated.groupBy(group).agg(F.max(years).alias("last_year"))
    left = (F.log(F.lit(float(limit))) - F.col("intercept")) / F.col("slope") - F.col("last_year")
    return fit.join(last, group).withColumn("years_left", F.when(F.col("slope") > 0, F.least(F.greatest(left, F.lit(0.0)), F.lit(cap_years))))


def sketch(rows: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """n, w, mean and m2 of weighted values: a sketch that merges exactly. Rows with a null value or a weight of 0 or less don't count."""
    good = rows.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).select(*group, F.col(value).alias("x"), F.col(weight).alias("w"))
    mean = good.groupBy(*group).agg(F.count("*").alias("n"), F.sum("w").alias("tw"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))
    spread = good.join(mean, group).groupBy(*group).agg(F.sum(F.col("w") * (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))).alias("m2"))
    return mean.join(spread, group).select(*group, "n", F.col("tw").alias("w"), "mean", "m2")


def merge_sketches(sketches: DataFrame, group: list[str]) -> DataFrame:
    """Sketches of one group as one. m2 of the whole is that of the parts and of their means about the common mean, so the order doesn't matter."""
    mean = sketches.groupBy(*group).agg(F.sum("n").alias("_n"), F.sum("w").alias("_w"), (F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("_mean"))
    far = F.col("mean") - F.col("_mean")
    return sketches.join(mean, group).groupBy(*group).agg(F.first("_n").alias("n"), F.first("_w").alias("w"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("w") * far * far).alias("m2"))


def released(sketches: DataFrame, least: int = 3) -> DataFrame:
    """Sketches of at least so many observations, with their variance."""
    return sketches.filter(F.col("n") >= least).withColumn("variance", F.col("m2") / F.col("w"))


def plurality(reads: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """The commonest value of each key, that read first among equals, how many reads gave it, and their share."""
    n = reads.groupBy(*key, value).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    best = n.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("m"), "o", F.col(value).alias("v"))).alias("b"), F.sum("n").alias("t"))
    return best.select(*key, F.col("b.v").alias(value), (-F.col("b.m")).alias("votes"), (-F.col("b.m") / F.col("t")).alias("agreement"))


def byte_vote(reads: DataFrame, key: list[str], content: str, order: str) -> DataFrame:
    """The content that the reads of each key vote for byte by byte; among equals the earliest read's byte, past the end of a shorter read the others'.

    A key's reads are first reduced to counts by place and byte, so many equal reads cost no more than one.
    """
    spots = reads.select(*key, F.col(order).alias("o"), F.posexplode(F.expr(f"transform(sequence(1, greatest(octet_length({content}), 1)), i -> substring(hex({content}), 2 * i - 1, 2))")).alias("at", "b")).filter("b <> ''")
    best = plurality(spots, [*key, "at"], "b", "o")
    return best.groupBy(*key).agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "b"))), lambda x: x["b"]), "")).alias(content))


def common_holes(holes: DataFrame, copies: DataFrame, title: str, copy: str, place: str) -> DataFrame:
    """Of each title: copies, the fewest holes of a copy, holes that every copy has (unrecoverable), and how many of the best copy's holes others fill."""
    n = copies.select(title, copy).distinct().groupBy(title).agg(F.count("*").alias("copies"))
    each = holes.select(title, copy, place).distinct()
    size = copies.select(title, copy).distinct().join(each.groupBy(title, copy).agg(F.count("*").alias("k")), [title, copy], "left").groupBy(title).agg(F.min(F.coalesce("k", F.lit(0))).alias("fewest"))
    shared = each.groupBy(title, place).agg(F.count("*").alias("m")).join(n, title).filter("m = copies").groupBy(title).agg(F.count("*").alias("u"))
    out = n.join(size, title).join(shared, title, "left").withColumn("unrecoverable", F.coalesce("u", F.lit(0)))
    return out.select(title, "copies", "fewest", "unrecoverable", (F.col("fewest") - F.col("unrecoverable")).alias("recovered"))


def dedup_account(chunks: DataFrame, group: str, digest: str, length: str) -> DataFrame:
    """Chunks and bytes of each group, in all and of different digests, and the ratio of bytes."""
    each = chunks.groupBy(group, digest).agg(F.count("*").alias("c"), F.max(length).alias("l"))
    out = each.groupBy(group).agg(F.sum("c").alias("chunks"), F.count("*").alias("unique_chunks"), F.sum(F.col("c") * F.col("l")).alias("bytes"), F.sum("l").alias("unique_bytes"))
    return out.withColumn("ratio", F.when(F.col("unique_bytes") > 0, F.col("bytes") / F.col("unique_bytes")).otherwise(1.0))


def folded_verdict(checks: DataFrame, target: str, severity: str) -> DataFrame:
    """Bad if any check of a target failed (2), suspect if any warned (1), otherwise good."""
    worst = F.max(severity)
    return checks.groupBy(target).agg(F.when(worst >= 2, "bad").when(worst == 1, "suspect").otherwise("good").alias("verdict"))


def position_buckets(rows: DataFrame, group: str, position: str, value: str, buckets: int = 64) -> DataFrame:
    """Means of equal-width buckets of position, as a share of the largest."""
    span = rows.groupBy(group).agg(F.min(position).alias("_lo"), F.max(position).alias("_hi"))
    at = F.least(F.floor((F.col(position) - F.col("_lo")) * buckets / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))), F.lit(buckets - 1))
    means = rows.join(span, group).groupBy(group, F.coalesce(at, F.lit(0)).cast("long").alias("bucket")).agg(F.avg(value).alias("m"))
    return means.withColumn("share", F.col("m") / F.nullif(F.max("m").over(Window.partitionBy(group)), F.lit(0))).drop("m")


def worst_of_block(rows: DataFrame, group: str, position: str, state: str, block: int) -> DataFrame:
    """The worst (largest) state of each block of positions."""
    return rows.groupBy(group, F.floor(F.col(position) / block).alias("block")).agg(F.max(state).alias("worst"))


def below_mean(rows: DataFrame, group: str, density: str, imbalance: str, low: float = 0.6, high: float = 5.0) -> DataFrame:
    """Rows whose density is below low times their group's mean, or imbalance above high times it."""
    mean = rows.groupBy(group).agg(F.avg(density).alias("_d"), F.avg(imbalance).alias("_i"))
    return rows.join(mean, group).filter((F.col(density) < low * F.col("_d")) | (F.col(imbalance) > high * F.col("_i"))).drop("_d", "_i")


def rate_profile(samples: DataFrame, group: str, amount: str, seconds: str, position: str) -> DataFrame:
    """Lowest, overall (amount by time) and highest rate, and where the slowest sample is, the first of equals."""
    s = samples.filter(F.col(seconds) > 0).withColumn("_r", F.col(amount) / F.col(seconds))
    return s.groupBy(group).agg(F.min("_r").alias("lowest"), (F.sum(amount) / F.sum(seconds)).alias("overall"), F.max("_r").alias("highest"), F.min_by(position, F.struct("_r", position)).alias("slowest_at"))


def entropy(rows: DataFrame, group: str, symbol: str) -> DataFrame:
    """Shannon entropy in bits of the symbols of each group."""
    n = rows.filter(F.col(symbol).isNotNull()).groupBy(group, symbol).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.sum("n").alias("n"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("bits"))


def session_rollup(tracks: DataFrame, group: list[str], is_data: str, start: str, length: str) -> DataFrame:
    """Kind of each session by its tracks (data, audio or mixed), first and last address, and length."""
    kind = F.when(F.bool_and(is_data), "data").when(~F.bool_or(is_data), "audio").otherwise("mixed")
    return tracks.groupBy(*group).agg(kind.alias("kind"), F.min(start).alias("first"), F.max(F.col(start) + F.col(length) - 1).alias("last"), F.sum(length).alias("sectors"), F.count("*").alias("tracks"))


def speed_fingerprint(rows: DataFrame, group: str, position: str, value: str, buckets: int = 64) -> DataFrame:
    """A number of 16 bits that the shape of each group's curve has: means of equal buckets of position (its span counts both ends), as bytes of the largest value, halves to even, an empty bucket 0, under CRC-16, inverted; 0 if no value is above 0."""
    w = Window.partitionBy(group)
    at = F.floor((F.col(position) - F.min(position).over(w)) * buckets / (F.max(position).over(w) - F.min(position).over(w) + 1))
    means = rows.select(group, at.alias("_b"), F.col(value).alias("_v"), F.max(value).over(w).alias("_m")).groupBy(group, "_b").agg(F.avg("_v").alias("_v"), F.max("_m").alias("_m"))
    byte = F.bround(F.col("_v") / F.col("_m") * 255).cast("int")
    curve = means.groupBy(group).agg(F.max("_m").alias("_m"), F.map_from_entries(F.collect_list(F.struct(F.col("_b").cast("int"), F.greatest(F.lit(0), F.least(F.lit(255), byte))))).alias("_c"))
    bytes_ = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.lpad(F.hex(F.coalesce(F.try_element_at("_c", k), F.lit(0))), 2, "0")), ""))
    return curve.select(group, F.when(F.col("_m") > 0, byte_function(lambda b: crc16(b, inverted=True), "int")(bytes_)).otherwise(0).alias("fingerprint"))


def weighted_sums(rows: DataFrame, group: str, place: str, word: str, skip_head: int = 0, skip_tail: int = 0) -> DataFrame:
    """v1 and v2 of each group's 32-bit words: their products with their place (from 1), low halves alone, and low and high halves, summed modulo 2**32; the first skip_head and last skip_tail places don't count."""
    n = F.count("*").over(Window.partitionBy(group))
    some = rows.withColumn("_n", n).filter((F.col(place) > skip_head) & (F.col(place) <= F.col("_n") - skip_tail)) if skip_tail else rows.filter(F.col(place) > skip_head)
    product = F.col(word).cast("long") * F.col(place)
    low, high = product.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(product, 32)
    whole = lambda c: F.sum(c.cast("decimal(20,0)"))
    cut = lambda c: F.pmod(c, F.lit(1 << 32)).cast("long")
    return some.groupBy(group).agg(cut(whole(low)).alias("v1"), cut(whole(low) + whole(high)).alias("v2"))


def offset_sums(rows: DataFrame, group: str, place: str, word: str, length: int) -> DataFrame:
    """start and v1 of each run of `length` words that begins there, its places counted from 1: from running sums, so a step costs the same however long the run is."""
    w = Window.partitionBy(group).orderBy(place)
    total = lambda c: F.sum(c.cast("decimal(38,0)")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    v, p = F.col(word).cast("decimal(20,0)"), F.col(place).cast("decimal(18,0)")
    sums = rows.select(group, place, total(v).alias("_a"), total(v * p).alias("_b"))
    last = lambda c: F.lead(c, length - 1).over(w) - F.coalesce(F.lag(c).over(w), F.lit(0))
    out = sums.select(group, F.col(place).alias("start"), last("_a").alias("_a"), last("_b").alias("_b")).filter("_a IS NOT NULL")
    return out.select(group, "start", F.pmod(F.col("_b") - (F.col("start") - 1) * F.col("_a"), F.lit(1 << 32)).cast("long").alias("v1"))


def disc_ids(offsets: DataFrame, disc: str, order: str, offset: str) -> DataFrame:
    """id1, id2 and cddb of each disc from its tracks' offsets in sectors, in order, the lead-out's last."""
    w = Window.partitionBy(disc).orderBy(order)
    second = F.floor((F.col(offset) + 150) / 75)
    digits = F.aggregate(F.split(second.cast("string"), ""), F.lit(0), lambda s, c: s + F.coalesce(c.try_cast("int"), F.lit(0)))
    rows = offsets.withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(disc)), "_s": second, "_d": digits})
    last = F.col("_i") == F.col("_n")
    agg = rows.groupBy(disc).agg(F.sum(offset).alias("id1"), F.sum(F.greatest(F.col(offset), F.lit(1)) * F.col("_i")).alias("id2"), F.sum(F.when(~last, F.col("_d")).otherwise(0)).alias("d"), (F.max(F.when(last, F.col("_s"))) - F.max(F.when(F.col("_i") == 1, F.col("_s")))).alias("t"), (F.count("*") - 1).alias("n"))
    whole = lambda c: F.pmod(F.col(c), F.lit(1 << 32)).cast("long").alias(c)
    return agg.filter("n > 0").select(disc, whole("id1"), whole("id2"), (F.col("d") % 255 * (1 << 24) + F.col("t") * 256 + F.col("n")).cast("long").alias("cddb"))


def dynamics(samples: DataFrame, group: str, channel: str, frame: str, level: str, block: int) -> DataFrame:
    """Peak, RMS and dynamic range of each group, in dB of full scale 1: the range is, of each channel, the second highest peak of blocks of so many frames over the RMS of their loudest fifth (a block's RMS is that of twice its power), averaged over channels."""
    db = lambda c: 20 * F.log10(F.greatest(c, F.lit(1e-10)))
    x = F.col(level).cast("double")
    blocks = samples.groupBy(group, channel, F.floor(F.col(frame) / block).alias("_b")).agg(F.sum(x * x).alias("_q"), F.count("*").alias("_n"), F.max(F.abs(x)).alias("_p"))
    blocks = blocks.withColumn("_r", F.sqrt(2 * F.col("_q") / F.col("_n")))
    one = Window.partitionBy(group, channel)
    ranked = blocks.withColumns({"_i": F.row_number().over(one.orderBy(F.col("_r").desc(), "_b")), "_j": F.row_number().over(one.orderBy(F.col("_p").desc(), "_b")), "_m": F.count("*").over(one)})
    top = F.greatest(F.lit(1), F.floor(F.col("_m") / 5))
    square = F.when(F.col("_i") <= top, F.col("_r") * F.col("_r"))
    each = ranked.groupBy(group, channel).agg(F.max(F.when(F.col("_j") == F.least(F.lit(2), F.col("_m")), F.col("_p"))).alias("_p2"), F.sqrt(F.avg(square)).alias("_top"), F.sum("_q").alias("_q"), F.sum("_n").alias("_n"), F.max("_p").alias("_p"))
    return each.groupBy(group).agg(db(F.max("_p")).alias("peak_db"), db(F.sqrt(F.sum("_q") / F.sum("_n"))).alias("rms_db"), F.avg(db(F.col("_p2")) - db(F.col("_top"))).alias("range_db"))


def chronology(volumes: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Of each volume (key, created, modified) whether it has no creation date, was modified before it was created, and how many of its files (key, at) are more than two seconds younger."""
    late = files.select(F.col(key).alias("_k"), "at").join(volumes.select(key, "created"), F.col("_k") == F.col(key)).filter(F.col("at") > F.col("created") + F.expr("INTERVAL 2 SECONDS")).groupBy("_k").agg(F.count("*").alias("_n"))
    out = volumes.join(late, F.col(key) == F.col("_k"), "left")
    return out.select(key, F.col("created").isNull().alias("undated"), F.coalesce(F.col("modified") < F.col("created"), F.lit(False)).alias("modified_first"), F.coalesce("_n", F.lit(0)).alias("files_after"))


def open_cases(events: DataFrame, key: str, time: str) -> DataFrame:
    """Entries of a list of cases from its events (key, time, event: add or attempt, resolved, not_before): first_flagged, attempts, resolved and not_before (the last that was given before the case was resolved). Adding a case that is open replaces it; attempts without a case count for nothing."""
    w = Window.partitionBy(key).orderBy(time)
    opened = events.withColumn("_c", F.sum(F.when(F.col("event") == "add", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_c > 0")
    done = F.max(F.when(F.col("event") == "attempt", F.col("resolved")).otherwise(False)).over(Window.partitionBy(key, "_c").orderBy(time).rowsBetween(Window.unboundedPreceding, -1))
    live = opened.withColumn("_d", done).filter(~F.coalesce("_d", F.lit(False)))
    solved = F.coalesce("resolved", F.lit(False)) & (F.col("event") == "attempt")
    each = live.groupBy(key, "_c").agg(F.min(time).alias("first_flagged"), F.count_if(F.col("event") == "attempt").alias("attempts"), F.bool_or(solved).alias("resolved"), F.max_by("not_before", F.when(F.col("not_before").isNotNull() & ~solved, F.col(time))).alias("not_before"))
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_c").desc())) == 1
    return each.withColumn("_new", newest).filter(F.col("resolved") | F.col("_new")).drop("_c", "_new")
