"""Families of pressings and the fusion of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum


def families(rings: DataFrame) -> DataFrame:
    """rings (id, title, matrix, mastering, mould) with family (title and matrix, normalised), branch (the mould within it, null without one), and how many members and branches the family has."""
    family = F.when(alnum(F.col("matrix")) != "", F.concat_ws("|", alnum(F.col("title")), alnum(F.col("matrix"))))
    named = rings.withColumn("family", family).withColumn("branch", F.nullif(alnum(F.col("mould")), F.lit("")))
    sizes = named.filter("family IS NOT NULL").groupBy("family").agg(F.count("*").alias("members"), F.count_distinct("branch").alias("branches"))
    return named.join(sizes, "family", "left")


def authenticity(members: DataFrame) -> DataFrame:
    """families' rows with standing: unknown without a matrix; consistent if others share it and it has both mastering and mould codes; partial with one of them; lone if nobody shares it; otherwise suspect."""
    codes = (F.coalesce(alnum(F.col("mastering")), F.lit("")) != "").cast("int") + F.col("branch").isNotNull().cast("int")
    standing = F.when(F.col("family").isNull(), "unknown").when(F.col("members") == 1, "lone").when(codes == 2, "consistent").when(codes == 1, "partial").otherwise("suspect")
    return members.withColumn("standing", standing)


def protection_standing(catalog: DataFrame, bands: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """What three optional reports say together of each key: schemes that a catalogue finds in files (key, scheme, likely), the verdict of its damage
    patterns (key, verdict), and whether its headers play tricks (key, tricks).

    corroborated if there are likely schemes and a physical sign (a periodic or mixed verdict, or tricks), files_only or physical_only with one of them, otherwise
    none. schemes are the distinct likely ones in order.
    """
    found = catalog.filter("likely").groupBy(key).agg(F.array_sort(F.collect_set("scheme")).alias("schemes"))
    band = bands.groupBy(key).agg(F.bool_or(F.col("verdict").isin("periodic", "mixed")).alias("band"))
    trick = headers.groupBy(key).agg(F.bool_or("tricks").alias("trick"))
    keys = catalog.select(key).unionByName(bands.select(key)).unionByName(headers.select(key)).distinct()
    out = keys.join(found, key, "left").join(band, key, "left").join(trick, key, "left")
    files = F.col("schemes").isNotNull()
    physical = F.coalesce("band", F.lit(False)) | F.coalesce("trick", F.lit(False))
    standing = F.when(files & physical, "corroborated").when(files, "files_only").when(physical, "physical_only").otherwise("none")
    return out.select(key, standing.alias("standing"), F.coalesce("schemes", F.array().cast("array<string>")).alias("schemes"), physical.alias("physical"))


def related_ids(a: Column, b: Column) -> Column:
    """Whether two volume names are related, but for case and marks: equal, one begins the other, or they begin with four letters in common that are at least 60 in 100 of the shorter."""
    x, y = alnum(a), alnum(b)
    short = F.least(F.length(x), F.length(y))
    common = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), short), lambda n: F.substring(x, F.lit(1), n) == F.substring(y, F.lit(1), n))), F.lit(0))
    return F.coalesce((x != "") & (y != "") & (F.startswith(x, y) | F.startswith(y, x) | (common >= 4) & (common >= F.floor(short * 0.6))), F.lit(False))
