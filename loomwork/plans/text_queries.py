"""Queries of scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .registry import query

NAMES = """SELECT p_partkey AS k, concat('Part ', p_partkey, ' (', CASE p_partkey % 4 WHEN 0 THEN 'USA, Europe' WHEN 1 THEN 'Japan' WHEN 2 THEN 'France' ELSE 'World' END, ')',
  CASE p_partkey % 3 WHEN 0 THEN ' (En,Fr)' WHEN 1 THEN ' (De)' ELSE '' END, CASE p_partkey % 5 WHEN 0 THEN concat(' (Rev ', p_partkey % 7, ')') WHEN 1 THEN ' (Rev B)' ELSE '' END,
  CASE p_partkey % 6 WHEN 0 THEN ' (v1.2)' ELSE '' END, CASE p_partkey % 8 WHEN 0 THEN ' (Disc 2 of 3)' ELSE '' END, CASE p_partkey % 9 WHEN 0 THEN ' (Beta 1)' WHEN 1 THEN ' (Unl)' ELSE '' END) AS name FROM part"""


@query(
    """SELECT k, concat('Part ', k) AS title, CASE k % 4 WHEN 0 THEN 'USA,Europe' WHEN 1 THEN 'Japan' WHEN 2 THEN 'France' ELSE 'World' END AS regions,
 CASE k % 3 WHEN 0 THEN 'EN,FR' WHEN 1 THEN 'DE' ELSE '' END AS languages, CASE k % 4 WHEN 1 THEN 'JA' WHEN 2 THEN 'FR' ELSE 'EN' END AS default_language,
 CASE WHEN k % 6 = 0 THEN 12 ELSE CASE k % 5 WHEN 0 THEN k % 7 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END END AS revision, CASE WHEN k % 8 = 0 THEN 2 ELSE 0 END AS disc,
 k % 9 IN (0, 2) AS prerelease, k % 9 IN (1, 3, 4) AS unlicensed FROM names""",
    names="""SELECT p_partkey AS k, concat('  Part  ', p_partkey, '(', CASE p_partkey % 4 WHEN 0 THEN 'usa, Europe' WHEN 1 THEN 'Japan' WHEN 2 THEN 'FRANCE' ELSE 'World' END, ')',
  CASE p_partkey % 3 WHEN 0 THEN ' (En,Fr)' WHEN 1 THEN ' (de)' ELSE ' ()' END, CASE p_partkey % 5 WHEN 0 THEN concat(' (Rev ', p_partkey % 7, ')') WHEN 1 THEN ' (rev  b)' WHEN 2 THEN ' (Rev AB)' ELSE '' END,
  CASE p_partkey % 6 WHEN 0 THEN ' (v1.2)' ELSE '' END, CASE p_partkey % 8 WHEN 0 THEN ' (Disc 2)' WHEN 1 THEN ' (Disc 2 of 3)' ELSE '' END,
  CASE p_partkey % 9 WHEN 0 THEN ' (BETA 1)' WHEN 1 THEN ' (unl)' WHEN 2 THEN ' (Prototype)' WHEN 3 THEN ' (Old Pirate)' WHEN 4 THEN ' (Aftermarket)' WHEN 5 THEN ' (Hack)' ELSE '' END) AS name FROM part""",
)
def f1_parsed_name(names: DataFrame) -> DataFrame:
    out = names.select("k", text.parsed_name(F.col("name")).alias("p")).select("k", "p.*")
    out = out.withColumn("default_language", text.default_language(F.get("regions", F.lit(0))))
    return out.withColumn("regions", F.array_join("regions", ",")).withColumn("languages", F.array_join("languages", ","))


@query(
    """SELECT k, trim(string_split(name, '(')[1]) AS title, nullif(regexp_extract(name, '\\(((?:USA|Japan|France|World)[^)]*)\\)', 1), '') AS region, nullif(regexp_extract(name, '\\(([A-Z][a-z](?:,[A-Z][a-z])+)\\)', 1), '') AS languages,
 TRY_CAST(nullif(regexp_extract(name, '\\(Disc ([0-9]+)', 1), '') AS INT) AS disc, TRY_CAST(nullif(regexp_extract(name, 'of ([0-9]+)\\)', 1), '') AS INT) AS discs, nullif(regexp_extract(name, '\\((v[0-9][^)]*)\\)', 1), '') AS version,
 contains(name, '(Beta') AS is_beta, contains(name, '(Unl)') AS is_unlicensed FROM names""",
    names=NAMES,
)
def f2_tagged_name(names: DataFrame) -> DataFrame:
    out = names.select("k", text.tagged_name(F.col("name")).alias("p")).select("k", "p.*")
    return out.select("k", "title", "region", "languages", "disc", "discs", "version", "is_beta", "is_unlicensed")


@query(
    "SELECT k, regexp_replace(upper(n), '[^A-Z0-9]', '', 'g') AS alnum, CASE WHEN contains(n, ',') THEN concat('\"', n, '\"') ELSE n END AS cell, replace(n, '&', '&amp;') AS xml, regexp_replace(n, '[:?]', '_', 'g') AS safe FROM names",
    names="SELECT p_partkey AS k, concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ', b' ELSE ': c?d' END, CASE WHEN p_partkey % 5 = 0 THEN '&x' ELSE 'y' END) AS n FROM part",
)
def f8_strings(names: DataFrame) -> DataFrame:
    n = F.col("n")
    return names.select("k", text.alnum(n).alias("alnum"), text.csv_cell(n).alias("cell"), text.xml_text(n).alias("xml"), text.safe_name(n).alias("safe"))


@query(
    """SELECT k, CASE WHEN n < 450000 THEN lpad(CAST(n // 4500 AS VARCHAR), 2, '0') ELSE CAST(n // 4500 AS VARCHAR) END || ':' || lpad(CAST(n // 75 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n % 75 AS VARCHAR), 2, '0') AS msf, n AS back,
 CASE WHEN n % 256 // 16 < 10 AND n % 16 < 10 THEN n % 256 // 16 * 10 + n % 16 END AS bcd FROM nums""",
    nums="SELECT l_orderkey AS k, l_orderkey * 20 + l_linenumber AS n FROM lineitem",
)
def f11_times(nums: DataFrame) -> DataFrame:
    return nums.select("k", text.sectors_msf(F.col("n")).alias("msf"), text.msf_sectors(text.sectors_msf(F.col("n"))).alias("back"), text.bcd(F.col("n") % 256).alias("bcd"))


@query(
    "SELECT k, CASE WHEN k % 4 > 0 THEN CAST(o_orderdate AS TIMESTAMP) - to_minutes(CAST(15 * (k % 5 - 2) AS BIGINT)) END AS at FROM ords",
    ords="SELECT o_orderkey AS k, o_orderdate FROM orders",
)
def f12_volume_date(ords: DataFrame) -> DataFrame:
    written = F.when(F.col("k") % 4 > 0, F.concat(F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("00 "), (F.col("k") % 5 - 2).cast("string"))).otherwise("0000000000000000 0")
    return ords.select("k", text.volume_date(written).cast("timestamp_ntz").alias("at"))


@query("SELECT k, sha256(concat(k, chr(10), coalesce(v, ''), chr(10), 'end')) AS digest FROM vals", vals="SELECT p_partkey AS k, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS v FROM part")
def f15_digest_of(vals: DataFrame) -> DataFrame:
    return vals.select("k", text.digest_of(F.col("k"), F.col("v"), F.lit("end")).alias("digest"))


@query(
    "SELECT k, unnest(CASE WHEN k % 3 < 2 THEN CASE WHEN k % 4 < 2 THEN ['file', 'name'] ELSE ['name'] END WHEN k % 4 < 2 THEN ['file'] ELSE [] END) AS kind FROM paths",
    paths="SELECT p_partkey AS k, concat(CASE WHEN p_partkey % 3 = 0 THEN 'My_Debug/' WHEN p_partkey % 3 = 1 THEN 'a\\\\QA2\\\\' ELSE 'src/test/' END, 'f', p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '.PDB;1' WHEN p_partkey % 4 = 1 THEN '.elf.map' WHEN p_partkey % 4 = 2 THEN '.log' ELSE '.obj' END) AS path FROM part",
)
def p7_residue(paths: DataFrame) -> DataFrame:
    return paths.select("k", F.explode(text.residue(F.col("path"))).alias("kind"))


@query("SELECT k FROM due WHERE NOT done AND (not_before IS NULL OR not_before <= TIMESTAMP '1995-06-01 00:00:00')", due="SELECT o_orderkey AS k, o_orderstatus = 'F' AS done, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END AS not_before FROM orders")
def p6_due(due: DataFrame) -> DataFrame:
    return due.filter(~F.col("done") & (F.col("not_before").isNull() | (F.col("not_before") <= F.lit("1995-06-01 00:00:00").cast("timestamp_ntz")))).select("k")


@query("SELECT p_partkey, p_name FROM parts WHERE contains(lower(p_name), 'a')", parts="SELECT p_partkey, p_name FROM part")
def p1_only(parts: DataFrame) -> DataFrame:
    return parts.filter(F.contains(F.lower("p_name"), F.lower(F.lit("A"))))


@query(
    "SELECT k, concat_ws('/', b, concat('g', k % 7), regexp_replace(n, '[?]', '_', 'g')) AS path FROM parts",
    parts="SELECT p_partkey AS k, p_brand AS b, concat(p_name, '?') AS n FROM part",
)
def p3_rebuild_path(parts: DataFrame) -> DataFrame:
    return parts.select("k", text.rebuild_path("system", F.col("b"), F.concat(F.lit("g"), (F.col("k") % 7).cast("string")), F.col("n")).alias("path"))
