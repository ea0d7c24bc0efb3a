"""Lint passes over layouts and volume descriptors. Each finding names a rule and its severity: 0 for information, 1 for a warning, 2 for an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import valid_isrc, valid_mcn

#: Sectors: the shortest track, and the shortest pause before one.
LEAST_TRACK, LEAST_PAUSE = 300, 150
MOST_TRACKS = 99
SECTOR = 2048


def _found(rows: DataFrame, rules: list[tuple[str, int, Column]], *columns: str) -> DataFrame:
    """A row for each rule (name, severity, whether it is broken) that a row breaks."""
    each = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(level).alias("severity"))) for name, level, c in rules))
    return rows.select(*columns, F.inline(F.array_compact(each)))


def _starts(indexes: DataFrame) -> DataFrame:
    """Of each track (disc, ord) the sectors of its first index 0 and index 1."""
    first = lambda k: F.min_by("sector", F.when(F.col("index") == k, F.col("i")))
    return indexes.groupBy("disc", "ord").agg(first(0).alias("i0"), first(1).alias("i1"))


def red_book(discs: DataFrame, tracks: DataFrame, indexes: DataFrame) -> DataFrame:
    """disc, track (null for the disc), rule and severity of what breaks the audio disc's rules.

    discs: disc, catalog_number. tracks: disc, ord, number, is_data, session, pregap, isrc, length. indexes: disc, ord, i (its place), index, sector.
    Lengths are checked where all tracks of a disc have one; where only some have, that is a finding.
    """
    w = Window.partitionBy("disc").orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    t = tracks.join(_starts(indexes), ["disc", "ord"], "left").withColumns(
        {
            "expected": F.coalesce(F.lag("number").over(w) + 1, F.lit(1)),
            "wedged": F.col("is_data") & F.coalesce(F.bool_or(~F.col("is_data")).over(before), F.lit(False)) & (F.col("session") == F.first("session").over(w)),
            "nth": F.row_number().over(w),
            "lengths": F.count("length").over(Window.partitionBy("disc")),
            "n": F.count("*").over(Window.partitionBy("disc")),
        }
    )
    t = t.withColumn("wedged_before", F.coalesce(F.bool_or("wedged").over(before), F.lit(False)))
    per_track = [
        ("out_of_sequence", 2, F.col("number") != F.col("expected")),
        ("number_out_of_range", 2, ~F.col("number").between(1, MOST_TRACKS)),
        ("no_index_1", 2, F.col("i1").isNull()),
        ("short_pause", 1, F.col("i1") - F.col("i0") < LEAST_PAUSE),
        ("short_pregap", 1, (F.col("pregap") < LEAST_PAUSE) & (F.col("pregap") != 0)),
        ("short_track", 2, (F.col("lengths") == F.col("n")) & (F.col("length") < LEAST_TRACK)),
        ("bad_isrc", 1, F.col("isrc").isNotNull() & ~valid_isrc(F.col("isrc"))),
        ("data_after_audio", 1, F.col("wedged") & ~F.col("wedged_before")),
        ("no_lead_in", 0, (F.col("nth") == 1) & ~F.col("is_data") & F.col("pregap").isNull() & F.col("i0").isNull() & (F.col("i1") < LEAST_PAUSE)),
    ]
    v = Window.partitionBy("disc", "ord").orderBy("i")
    ix = indexes.withColumns({"again": F.row_number().over(Window.partitionBy("disc", "ord", "index").orderBy("i")) > 1, "last": F.lag("sector").over(v)})
    ix = ix.join(tracks.select("disc", "ord", "number"), ["disc", "ord"])
    per_index = [("index_out_of_range", 2, ~F.col("index").between(0, MOST_TRACKS)), ("duplicate_index", 2, F.col("again")), ("index_goes_back", 2, F.col("sector") < F.col("last"))]
    d = discs.join(tracks.groupBy("disc").agg(F.count("*").alias("n"), F.count("length").alias("lengths")), "disc", "left").withColumn("track", F.lit(None).cast(tracks.schema["number"].dataType))
    per_disc = [
        ("no_tracks", 2, F.col("n").isNull()),
        ("too_many_tracks", 2, F.col("n") > MOST_TRACKS),
        ("lengths_incomplete", 1, (F.col("lengths") > 0) & (F.col("lengths") < F.col("n"))),
        ("bad_catalog_number", 1, F.col("n").isNotNull() & F.col("catalog_number").isNotNull() & ~valid_mcn(F.col("catalog_number"))),
    ]
    own = lambda rows, rules: _found(rows, rules, "disc", "number").withColumnRenamed("number", "track")
    return own(t, per_track).unionByName(own(ix, per_index)).unionByName(_found(d, per_disc, "disc", "track"))


def pregaps(tracks: DataFrame, indexes: DataFrame) -> DataFrame:
    """Of each track by number: gap (from its index 0, else its declared pregap, else 0), boundary (it is data and the one before isn't, or the other way round), issue or null, and sequential: the disc's numbers run from 1."""
    w = Window.partitionBy("disc").orderBy("number", "ord")
    t = tracks.join(_starts(indexes), ["disc", "ord"], "left").withColumns({"nth": F.row_number().over(w), "last": F.lag("is_data").over(w)})
    known = F.col("i1").isNotNull()
    gap = F.when(known, F.coalesce(F.col("i1") - F.col("i0"), F.col("pregap"), F.lit(0))).otherwise(0)
    t = t.withColumns({"gap": gap, "boundary": known & F.coalesce(F.col("last") != F.col("is_data"), F.lit(False))})
    first = F.when(F.col("i1") != 0, "late_start").when(F.col("i0") != 0, "early_index_0")
    later = F.when(F.col("gap") < 0, "negative_pregap").when(F.col("boundary") & (F.col("gap") == 0), "no_boundary_pregap").when(F.col("boundary") & (F.col("gap") != LEAST_PAUSE), "odd_boundary_pregap")
    issue = F.when(~known, "no_index_1").when(F.col("nth") == 1, first).otherwise(later)
    sequential = F.bool_and(F.col("number") == F.col("nth")).over(Window.partitionBy("disc"))
    return t.select("disc", "number", "gap", "boundary", issue.alias("issue"), sequential.alias("sequential"))


def volume_lint(images: DataFrame, key: str, content: str) -> DataFrame:
    """key, rule and severity of what is wrong with the primary volume descriptor of images of sectors of 2,048 bytes; a null image has no findings."""
    c = F.col(content)
    some = images.filter(c.isNotNull()).select(F.col(key), c.alias("_c"), F.octet_length(c).cast("long").alias("size"), F.hex(F.substring(c, 16 * SECTOR + 1, SECTOR)).alias("d"))
    hex_ = lambda at, n: F.substring("d", 2 * at + 1, 2 * n)
    big = lambda at, n: F.conv(hex_(at, n), 16, 10).cast("long")
    little = lambda at, n: F.conv(F.concat(*(hex_(at + k, 1) for k in reversed(range(n)))), 16, 10).cast("long")
    sectors = F.floor(F.col("size") / SECTOR)
    heads = F.transform(F.sequence(F.lit(17), F.greatest(F.lit(17), F.least(sectors, F.lit(49)) - 1).cast("int")), lambda s: F.hex(F.substring(F.col("_c"), s * SECTOR + 1, F.lit(6))))
    magic = "4344303031"
    at = lambda test: F.array_position(F.transform("heads", test), True)
    some = some.withColumns({"sectors": sectors, "heads": heads}).withColumns({"end": at(lambda h: h == "FF" + magic), "odd": at(lambda h: F.substring(h, 3, 10) != magic)})
    fits = F.col("sectors") >= 17
    root, extent, length = big(156, 1), little(158, 4), little(166, 4)
    same = lambda at, n: little(at, n) == big(at + n, n)
    rules = [
        ("odd_length", 1, F.col("size") % SECTOR != 0),
        ("too_small", 2, ~fits),
        ("descriptor_type", 2, fits & (big(0, 1) != 1)),
        ("identifier", 2, fits & (hex_(1, 5) != magic)),
        ("version", 2, fits & (big(6, 1) != 1)),
        ("block_size_mismatch", 2, fits & ~same(128, 2)),
        ("block_size", 1, fits & same(128, 2) & (little(128, 2) != SECTOR)),
        ("volume_size_mismatch", 2, fits & ~same(80, 4)),
        ("truncated", 1, fits & same(80, 4) & (little(80, 4) > F.col("sectors"))),
        ("path_table_mismatch", 2, fits & ~same(132, 4)),
        ("root_record", 2, fits & (root < 34)),
        ("root_outside", 2, fits & (root >= 34) & (extent * SECTOR >= F.col("size"))),
        ("root_past_end", 1, fits & (root >= 34) & (extent * SECTOR < F.col("size")) & (extent * SECTOR + length > F.col("size"))),
        ("no_terminator", 2, fits & ~((F.col("end") > 0) & ((F.col("odd") == 0) | (F.col("end") < F.col("odd"))))),
    ]
    return _found(some, rules, key)
