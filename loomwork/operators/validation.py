"""Validators that emit findings, folds of their severity, and merges of several sources with their provenance. Severity is 0 for information, 1 for a warning, 2 for a failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import byte_vote


def _finding(rows: DataFrame, target: str, check: str, severity: int, detail: Column) -> DataFrame:
    return rows.select(F.col(target).alias("target"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def track_set_findings(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of track sets (set, number, file, start, sector_size) against files (set, file, size; one row each).

    file_missing; partial_sector: a size that sectors don't divide; mixed_sectors: several sector sizes in one file; start_order: a start
    not above the one before in its file; start_outside: a start at or past the end. Null sizes are unknown and only missing files are reported for them.
    """
    f = files.select(F.col("set").alias("_s"), F.col("file").alias("_f"), F.col("size").alias("_n"))
    t = tracks.join(f, (F.col("set") == F.col("_s")) & (F.col("file") == F.col("_f")), "left")
    w = Window.partitionBy("set", "file").orderBy("number")
    ordered = t.withColumn("_before", F.lag("start").over(w))
    sizes = t.groupBy("set", "file").agg(F.count_distinct("sector_size").alias("k"))
    here = t.filter("_f IS NOT NULL AND _n IS NOT NULL")
    return _together(
        [
            _finding(t.filter("_f IS NULL").select("set", "file").distinct(), "set", "file_missing", 2, F.col("file")),
            _finding(here.filter("_n % sector_size <> 0").select("set", "file").distinct(), "set", "partial_sector", 2, F.col("file")),
            _finding(sizes.filter("k > 1"), "set", "mixed_sectors", 2, F.col("file")),
            _finding(ordered.filter("start <= _before"), "set", "start_order", 2, F.col("number")),
            _finding(here.filter("start >= _n / sector_size"), "set", "start_outside", 2, F.col("number")),
        ]
    )


def layout_findings(indexes: DataFrame) -> DataFrame:
    """Findings of layouts (layout, track, index, sector): duplicate_track_index, track_jump (numbers not one apart), first_track (not 1), index_order (a sector not above the one before within a track), no_index_1."""
    per = indexes.groupBy("layout", "track").agg(F.bool_or(F.col("index") == 1).alias("has1")).withColumn("before", F.lag("track").over(Window.partitionBy("layout").orderBy("track")))
    dup = indexes.groupBy("layout", "track", "index").agg(F.count("*").alias("n")).filter("n > 1")
    order = indexes.withColumn("_b", F.lag("sector").over(Window.partitionBy("layout", "track").orderBy("index", "sector")))
    return _together(
        [
            _finding(dup, "layout", "duplicate_track_index", 2, F.concat_ws(".", "track", "index")),
            _finding(per.filter("before IS NOT NULL AND track <> before + 1"), "layout", "track_jump", 1, F.col("track")),
            _finding(per.filter("before IS NULL AND track <> 1"), "layout", "first_track", 1, F.col("track")),
            _finding(order.filter("sector <= _b AND _b IS NOT NULL"), "layout", "index_order", 2, F.concat_ws(".", "track", "index")),
            _finding(per.filter("NOT has1"), "layout", "no_index_1", 2, F.col("track")),
        ]
    )


def readiness(targets: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """key, failures, warnings and grade of every target: blocked with a failure, usable with a warning, otherwise ready."""
    n = findings.groupBy("target").agg(F.count_if(F.col("severity") >= 2).alias("failures"), F.count_if(F.col("severity") == 1).alias("warnings"))
    out = targets.select(key).distinct().join(n, F.col(key) == F.col("target"), "left").fillna(0, ["failures", "warnings"])
    grade = F.when(F.col("failures") > 0, "blocked").when(F.col("warnings") > 0, "usable").otherwise("ready")
    return out.select(key, "failures", "warnings", grade.alias("grade"))


def capacity_gate(tracks: DataFrame, bad: DataFrame, key: str, length: str, warn_at: int = 333_000, fail_at: int = 360_000) -> DataFrame:
    """Sectors of each key, its bad sectors, and verdict: fail above fail_at or with bad sectors, warn above warn_at, otherwise pass."""
    total = tracks.groupBy(key).agg(F.sum(length).alias("sectors"))
    n = bad.groupBy(F.col(key).alias("_k")).agg(F.count_distinct("sector").alias("bad"))
    out = total.join(n, F.col(key) == F.col("_k"), "left").withColumn("bad", F.coalesce("bad", F.lit(0)))
    verdict = F.when((F.col("sectors") > fail_at) | (F.col("bad") > 0), "fail").when(F.col("sectors") > warn_at, "warn").otherwise("pass")
    return out.select(key, "sectors", "bad", verdict.alias("verdict"))


def lesion_advice(lesions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Advice for each lesion (disc, lesion, first, last, kind) by its kind, the track (disc, start, length, is_data) at its midpoint, and its length: resurface a solid burst, reread a periodic one, rip again from audio, rescue data; unknown outside all tracks.

    The track is found by order: the last start at or before the midpoint.
    """
    mid = lesions.withColumn("at", F.floor((F.col("first") + F.col("last")) / 2))
    marks = mid.select("disc", "at", F.lit(1).alias("o"), F.struct("lesion", "first", "last", "kind").alias("l"), F.lit(None).cast("struct<start: bigint, length: bigint, is_data: boolean>").alias("t"))
    starts = tracks.select("disc", F.col("start").cast("long").alias("at"), F.lit(0).alias("o"), F.lit(None).cast(dict(marks.dtypes)["l"]).alias("l"), F.struct(F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "is_data").alias("t"))
    w = Window.partitionBy("disc").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    met = marks.unionByName(starts).withColumn("t", F.last("t", True).over(w)).filter("o = 1")
    inside = F.col("t").isNotNull() & (F.col("at") < F.col("t.start") + F.col("t.length"))
    size = F.col("l.last") - F.col("l.first") + 1
    advice = F.when(~inside | F.col("t").isNull(), "unknown").when((F.col("l.kind") == "burst") & (size > 16), "resurface").when(F.col("l.kind") == "periodic", "reread").when(F.col("t.is_data"), "rescue").otherwise("rip_again")
    return met.select("disc", F.col("l.lesion").alias("lesion"), F.when(inside, F.col("t.is_data")).alias("is_data"), size.alias("length"), advice.alias("advice"))


def block_descriptor(blocks: DataFrame, file: str, ord_: str, content: str) -> DataFrame:
    """Each block's role: fill (all bytes equal), unique (the first of its content) or copy with the first's place; equal neighbours of fill are one run.

    Contents are compared by length and SHA-256. file, first, last, role, value (of a fill, in hexadecimal), source.
    """
    digest = F.struct(F.octet_length(content).alias("n"), F.sha2(content, 256).alias("h"))
    one = F.hex(F.substring(content, 1, 1))
    fill = (F.octet_length(content) > 0) & (F.hex(content) == F.expr(f"repeat(hex(substring({content}, 1, 1)), octet_length({content}))"))
    rows = blocks.select(F.col(file).alias("file"), F.col(ord_).cast("long").alias("o"), digest.alias("d"), F.when(fill, one).alias("v"))
    firsts = rows.filter("v IS NULL").groupBy("file", "d").agg(F.min("o").alias("source"))
    named = rows.join(firsts, ["file", "d"], "left")
    role = F.when(F.col("v").isNotNull(), "fill").when(F.col("o") == F.col("source"), "unique").otherwise("copy")
    named = named.withColumn("role", role)
    w = Window.partitionBy("file").orderBy("o")
    same = (F.col("role") == "fill") & (F.lag("v").over(w) == F.col("v")) & (F.lag("o").over(w) == F.col("o") - 1)
    runs = named.withColumn("_n", F.when(same, 0).otherwise(1)).withColumn("_r", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("file", "_r").agg(F.min("o").alias("first"), F.max("o").alias("last"), F.first("role").alias("role"), F.first("v").alias("value"), F.max(F.when(F.col("role") == "copy", F.col("source"))).alias("source")).drop("_r")


def member_sets(files: DataFrame, references: DataFrame) -> DataFrame:
    """Members of each set (set, folder, stem): files (folder, file, stem, extension) that it references by name, those of its stem, and a log that is alone in the folder. set, file, reason (the first of referenced, sidecar, log that holds)."""
    sets = references.select("set", "folder", "stem").distinct()
    named = references.filter("file IS NOT NULL").select("set", "folder", "file").join(files.select("folder", "file"), ["folder", "file"]).select("set", "file", F.lit(0).alias("r"))
    side = sets.join(files, ["folder", "stem"]).select("set", "file", F.lit(1).alias("r"))
    logs = files.filter("extension = 'log'").groupBy("folder").agg(F.count("*").alias("n"), F.min("file").alias("file")).filter("n = 1")
    lone = sets.join(logs, "folder").select("set", "file", F.lit(2).alias("r"))
    best = named.unionByName(side).unionByName(lone).groupBy("set", "file").agg(F.min("r").alias("r"))
    return best.select("set", "file", F.element_at(F.array(*map(F.lit, ("referenced", "sidecar", "log"))), F.col("r") + 1).alias("reason"))


def attestation_summary(log: DataFrame, target: str, agrees: str) -> DataFrame:
    """Attestations of each target, how many agree, and corroborated: at least two and all agree."""
    out = log.groupBy(target).agg(F.count("*").alias("n"), F.count_if(agrees).alias("agree"))
    return out.withColumn("corroborated", (F.col("n") >= 2) & (F.col("agree") == F.col("n")))


_SECTOR = ["disc", "lba"]


def _voted(reads: DataFrame, check: Callable[[Column], Column]) -> DataFrame:
    """disc, lba, voted (byte by byte, the first source's among equals) and vote_valid."""
    return byte_vote(reads, _SECTOR, "content", "source").withColumnRenamed("content", "voted").withColumn("vote_valid", check(F.col("voted")))


def provenance_merge(reads: DataFrame, check: Callable[[Column], Column], holes: DataFrame | None = None, confirmed: DataFrame | None = None) -> DataFrame:
    """The merged content of each sector (disc, lba) from sources (source, content), with method and source. check gives of a content true, false, or null where it can't be checked.

    Where a span of a source is confirmed from outside (disc, first, last, source) that source's content holds: confirmed; the first source's, if
    several are. Elsewhere known holes of a source (disc, lba, source) and null contents are left out. Then: single if one source is left; agreed if all contents are equal;
    verified by the first source whose content is valid; otherwise the sources vote byte by byte: vote_verified, vote_best_effort
    if the result can't be checked, unrecovered (with the result) if it is invalid. Sectors without any content are unrecovered, without content.
    Only sectors whose sources differ and of which none is valid are taken apart into bytes.
    """
    sectors = reads.select(*_SECTOR).distinct()
    good = reads.filter("content IS NOT NULL")
    if holes is not None:
        good = good.join(holes.select(*_SECTOR, "source").distinct(), [*_SECTOR, "source"], "left_anti")
    valid = F.struct("source", "content")
    best = good.groupBy(*_SECTOR).agg(F.count("*").alias("n"), F.count_distinct("content").alias("kinds"), F.min(valid).alias("one"), F.min(F.when(check(F.col("content")), valid)).alias("checked"))
    split = best.filter("kinds > 1 AND checked IS NULL").select(*_SECTOR)
    votes = _voted(good.join(split, _SECTOR, "left_semi"), check)
    out = sectors.join(best, _SECTOR, "left").join(votes, _SECTOR, "left")
    if confirmed is None:
        out = out.withColumn("sure", F.lit(None).cast(out.schema["one"].dataType))
    else:
        spans = confirmed.select(F.col("disc").alias("_d"), F.col("source").alias("_s"), "first", "last")
        sure = reads.join(spans, F.expr("disc = _d AND source = _s AND lba BETWEEN first AND last")).filter("content IS NOT NULL").groupBy(*_SECTOR).agg(F.min(valid).alias("sure"))
        out = out.join(sure, _SECTOR, "left")
    voted = F.when(F.col("vote_valid"), "vote_verified").when(F.col("vote_valid").isNull(), "vote_best_effort").otherwise("unrecovered")
    method = F.when(F.col("sure").isNotNull(), "confirmed").when(F.col("n").isNull(), "unrecovered").when(F.col("n") == 1, "single").when(F.col("kinds") == 1, "agreed").when(F.col("checked").isNotNull(), "verified").otherwise(voted)
    pick = lambda c: F.coalesce(F.col(f"sure.{c}"), F.when(F.col("kinds") == 1, F.col(f"one.{c}")), F.col(f"checked.{c}"))
    return out.select(*_SECTOR, F.coalesce(pick("content"), "voted").alias("content"), method.alias("method"), pick("source").alias("source"))


def reconstruct(reads: DataFrame, check: Callable[[Column], Column], repair: Callable[[Column], Column]) -> DataFrame:
    """The content of each sector (disc, lba) from reads (source, content) by a ladder, with the rung it stands on. check is as for provenance_merge; repair gives a content mended by its own parity, or null.

    agreed: all contents are equal and not invalid; verified_copy: the first valid one; repaired_copy: the first that can be mended; vote_verified and
    vote_best_effort: what the reads vote for byte by byte is valid, or can't be checked; repaired_vote: it can be mended; unrecovered otherwise, with the
    vote, or the one content that all give. Null contents are left out; sectors with nothing else aren't there.
    """
    good = reads.filter("content IS NOT NULL").withColumn("valid", check(F.col("content"))).withColumn("mended", F.when(~F.coalesce("valid", F.lit(True)), repair(F.col("content"))))
    first = lambda c, x: F.min(F.when(c, F.struct("source", F.col(x).alias("content"))))
    best = good.groupBy(*_SECTOR).agg(F.count_distinct("content").alias("kinds"), F.bool_or("valid").alias("any_valid"), F.bool_or(~F.col("valid")).alias("bad"), first(F.lit(True), "content").alias("one"), first(F.col("valid"), "content").alias("checked"), first(F.col("mended").isNotNull(), "mended").alias("mended"))
    split = best.filter("kinds > 1 AND checked IS NULL AND mended IS NULL").select(*_SECTOR)
    votes = _voted(good.select(*_SECTOR, "source", "content").join(split, _SECTOR, "left_semi"), check)
    out = best.join(votes, _SECTOR, "left").withColumn("mended_vote", F.when(~F.col("vote_valid"), repair(F.col("voted"))))
    same = F.col("kinds") == 1
    ladder = [
        (same & ~F.coalesce("bad", F.lit(False)), "agreed", F.col("one.content")),
        (F.col("checked").isNotNull(), "verified_copy", F.col("checked.content")),
        (F.col("mended").isNotNull(), "repaired_copy", F.col("mended.content")),
        (same, "unrecovered", F.col("one.content")),
        (F.col("vote_valid"), "vote_verified", F.col("voted")),
        (F.col("vote_valid").isNull(), "vote_best_effort", F.col("voted")),
        (F.col("mended_vote").isNotNull(), "repaired_vote", F.col("mended_vote")),
    ]
    rung, content = F.when(ladder[0][0], ladder[0][1]), F.when(ladder[0][0], ladder[0][2])
    for c, name, value in ladder[1:]:
        rung, content = rung.when(c, name), content.when(c, value)
    return out.select(*_SECTOR, content.otherwise(F.col("voted")).alias("content"), rung.otherwise("unrecovered").alias("rung"))


def provenance_runs(merged: DataFrame) -> DataFrame:
    """Runs of neighbouring sectors of one method and source: disc, first, last, method, source."""
    key = F.struct("method", "source")
    w = Window.partitionBy("disc").orderBy("lba")
    same = F.lag(key).over(w).eqNullSafe(key) & (F.lag("lba").over(w) == F.col("lba") - 1)
    runs = merged.withColumn("_n", F.when(same, 0).otherwise(1)).withColumn("_r", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("disc", "_r", "method", "source").agg(F.min("lba").alias("first"), F.max("lba").alias("last")).drop("_r")


def tie_break(candidates: DataFrame, database: DataFrame, key: str) -> DataFrame:
    """The candidate (key, idx, checksum) with the highest confidence in the database (checksum, confidence), the first among equals; null confidence if none is known."""
    known = database.groupBy(F.col("checksum").alias("_c")).agg(F.max("confidence").alias("confidence"))
    met = candidates.join(known, F.col("checksum") == F.col("_c"), "left")
    best = met.groupBy(key).agg(F.min(F.struct((-F.coalesce("confidence", F.lit(-1))).alias("m"), "idx", "confidence")).alias("b"))
    return best.select(key, F.col("b.idx").alias("idx"), F.col("b.confidence").alias("confidence"))


def grouped_members(rows: DataFrame, key: Column, member: str) -> DataFrame:
    """Members by a normalised key, the largest groups first; rows without a key, or an empty one, are left out. Members are sorted."""
    out = rows.select(key.alias("key"), member).filter("key IS NOT NULL AND key <> ''").groupBy("key").agg(F.array_sort(F.collect_set(member)).alias("members"))
    return out.withColumn("n", F.size("members")).orderBy(F.col("n").desc(), "key")


def range_fingerprint(samples: DataFrame, group: str, position: str, weight: str, bands: int = 64) -> DataFrame:
    """Weighted errors of each group in equal bands of position, as log(1 + x) scaled to 0..255 (halves to even): fingerprint, and distinct: the share of bands that aren't 0."""
    span = samples.groupBy(group).agg(F.min(position).alias("_lo"), F.max(position).alias("_hi"))
    at = F.least(F.floor((F.col(position) - F.col("_lo")) * bands / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))), F.lit(bands - 1))
    sums = samples.join(span, group).groupBy(group, F.coalesce(at, F.lit(0)).cast("int").alias("b")).agg(F.sum(weight).alias("x"))
    scaled = sums.withColumn("v", F.bround(255 * F.log1p("x") / F.nullif(F.max(F.log1p("x")).over(Window.partitionBy(group)), F.lit(0))).cast("int"))
    pairs = scaled.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("b", F.coalesce("v", F.lit(0)).alias("v")))).alias("m"))
    print_ = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    return pairs.withColumn("fingerprint", print_).select(group, "fingerprint", (F.size(F.filter("fingerprint", lambda x: x > 0)) / bands).alias("distinct"))


def twin_headers(sectors: DataFrame, disc: str, address: str, lba: str) -> DataFrame:
    """Sectors whose header address another sector of the disc has too, or that isn't their own: disc, lba, address, twins, misplaced."""
    n = sectors.filter(F.col(address).isNotNull()).groupBy(disc, address).agg(F.count("*").alias("twins"))
    out = sectors.join(n, [disc, address]).withColumn("misplaced", F.col(address) != F.col(lba))
    return out.filter("twins > 1 OR misplaced").select(disc, lba, address, "twins", "misplaced")


def symbol_class(symbols: Column, correctable: int) -> Column:
    """none without wrong symbols, corrected up to what the code corrects, otherwise uncorrectable."""
    return F.when(F.coalesce(symbols, F.lit(0)) <= 0, "none").when(symbols <= correctable, "corrected").otherwise("uncorrectable")


def fuzzy_lookup(rows: DataFrame, column: str, asked: str) -> DataFrame:
    """Rows whose letters and digits hold those of a text, without case; a text without any finds nothing."""
    low = "".join(c for c in asked.upper() if c.isascii() and c.isalnum())
    return rows.filter(F.contains(F.regexp_replace(F.upper(column), "[^A-Z0-9]", ""), F.lit(low)) if low else F.lit(False))
