"""The best of a group, the first of copies, and orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_of_family(titles: DataFrame, family: list[str], order: list[Column], unwanted: Column | None = None) -> DataFrame:
    """One row of each family, the first by order. Unwanted rows are dropped where the family has another; a null family is a family."""
    if unwanted is not None:
        others = F.bool_or(~unwanted).over(Window.partitionBy(*family))
        titles = titles.withColumn("_u", unwanted & others).filter("NOT _u").drop("_u")
    w = Window.partitionBy(*family).orderBy(*order)
    return titles.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_seen(files: DataFrame, digest: str, order: list[Column], verified: Column | None = None) -> DataFrame:
    """files with is_duplicate: a verified file whose digest came before; without a digest, or unverified, never. Files without a digest aren't ordered."""
    w = Window.partitionBy(digest).orderBy(*order)
    known = files.filter(F.col(digest).isNotNull())
    may = F.lit(True) if verified is None else F.coalesce(verified, F.lit(False))
    return known.withColumn("is_duplicate", may & (F.row_number().over(w) > 1)).unionByName(files.filter(F.col(digest).isNull()).withColumn("is_duplicate", F.lit(False)))


def keep_best(copies: DataFrame, group: str, rank: Column, order: str) -> DataFrame:
    """copies with keep: the best by rank of each group, the first by order among equals; rows without a group all stay, and aren't ordered."""
    w = Window.partitionBy(group).orderBy(rank.desc_nulls_last(), order)
    known = copies.filter(F.col(group).isNotNull()).withColumn("keep", F.row_number().over(w) == 1)
    return known.unionByName(copies.filter(F.col(group).isNull()).withColumn("keep", F.lit(True)))


def first_wins(tables: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """All rows of several tables of one schema, of equal keys the first by order; reduced before it is shuffled."""
    all_ = tables[0]
    for t in tables[1:]:
        all_ = all_.unionByName(t)
    return all_.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_r")).select("_r.*")


def capped(rows: DataFrame, group: str, order: list[str], n: int, nth: str = "nth") -> DataFrame:
    """The first n rows of each group with their place; each task keeps no more than n of a group before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn(nth, F.row_number().over(w)).filter(F.col(nth) <= n)


def latest(rows: DataFrame, entity: str, time: str, tie: str) -> DataFrame:
    """The last row of each entity by time, then by tie; as an aggregate, so a busy entity is reduced before it is shuffled."""
    best = rows.groupBy(entity).agg(F.max_by(F.struct("*"), F.struct(time, tie)).alias("_r"))
    return best.select("_r.*")


def modal_label(rows: DataFrame, group: str, label: str) -> DataFrame:
    """The commonest label of each group, the first by name among equals, and how often it occurs; null labels don't count."""
    n = rows.filter(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    best = n.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l"))).alias("b"))
    return best.select(group, F.col("b.l").alias(label), (-F.col("b.m")).alias("n"))


def common_prefix(rows: DataFrame, group: str, label: str, least: int = 3) -> DataFrame:
    """The longest common prefix of each group's labels, null where it is shorter than least: that of the first and the last label by order."""
    ends = rows.groupBy(group).agg(F.min(label).alias("a"), F.max(label).alias("b"))
    n = F.expr("aggregate(sequence(1, greatest(length(a), 1)), 0, (k, i) -> CASE WHEN k = i - 1 AND substring(a, i, 1) = substring(b, i, 1) AND i <= length(a) THEN i ELSE k END)")
    return ends.withColumn("n", n).select(group, F.when(F.col("n") >= least, F.expr("substring(a, 1, n)")).alias("prefix"))


def priority(rows: DataFrame, urgency: Column, eta: str, name: str) -> DataFrame:
    """rows with rank by urgency, then nearest eta, those without one last, then name."""
    return rows.withColumn("_u", urgency).orderBy(F.col("_u").desc(), F.col(eta).asc_nulls_last(), name).drop("_u")


def urgent_top(rows: DataFrame, score: str, name: str, k: int, urgent_from: float) -> DataFrame:
    """The k rows of the highest scores, or all urgent ones if these are more; only k rows are ever ordered."""
    urgent = F.coalesce(F.col(score) >= urgent_from, F.lit(False))
    best = rows.orderBy(F.col(score).desc_nulls_last(), name).limit(k)
    return rows.filter(urgent).unionByName(best.filter(~urgent))
