"""Queries of validators and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import validation
from .registry import query

TRACKS = "SELECT l_orderkey AS set, l_linenumber AS number, concat('f', l_suppkey % 3) AS file, l_partkey % 40 AS start, CASE WHEN l_partkey % 9 = 0 THEN 2048 ELSE 2352 END AS sector_size FROM lineitem"
FILES = "SELECT o_orderkey AS set, concat('f', o_custkey % 3) AS file, (o_custkey % 40) * 2352 + CASE WHEN o_custkey % 5 = 0 THEN 7 ELSE 0 END AS size FROM orders"


@query(
    """WITH t AS (SELECT tracks.*, f.file AS f, f.size AS n FROM tracks LEFT JOIN files f ON f.set = tracks.set AND f.file = tracks.file)
 SELECT set AS target, 'file_missing' AS "check", 2 AS severity, file AS detail FROM (SELECT DISTINCT set, file FROM t WHERE f IS NULL)
 UNION ALL SELECT set, 'partial_sector', 2, file FROM (SELECT DISTINCT set, file FROM t WHERE n % sector_size <> 0) UNION ALL SELECT set, 'mixed_sectors', 2, file FROM t GROUP BY set, file HAVING count(DISTINCT sector_size) > 1
 UNION ALL SELECT set, 'start_order', 2, CAST(number AS VARCHAR) FROM (SELECT *, lag(start) OVER (PARTITION BY set, file ORDER BY number) AS b FROM t) WHERE start <= b
 UNION ALL SELECT set, 'start_outside', 2, CAST(number AS VARCHAR) FROM t WHERE start >= n / sector_size""",
    tracks="SELECT set, row_number() OVER (PARTITION BY set ORDER BY number, start, file, sector_size) AS number, file, start, sector_size FROM (" + TRACKS + ") x",
    files=FILES,
)
def v1_track_set(tracks: DataFrame, files: DataFrame) -> DataFrame:
    return validation.track_set_findings(tracks, files)


@query(
    """WITH p AS (SELECT layout, track, bool_or(i = 1) AS has1 FROM idx GROUP BY ALL), q AS (SELECT *, lag(track) OVER (PARTITION BY layout ORDER BY track) AS b FROM p)
 SELECT layout AS target, 'duplicate_track_index' AS "check", 2 AS severity, concat(track, '.', i) AS detail FROM idx GROUP BY layout, track, i HAVING count(*) > 1
 UNION ALL SELECT layout, 'track_jump', 1, CAST(track AS VARCHAR) FROM q WHERE track <> b + 1 UNION ALL SELECT layout, 'first_track', 1, CAST(track AS VARCHAR) FROM q WHERE b IS NULL AND track <> 1
 UNION ALL SELECT layout, 'index_order', 2, concat(track, '.', i) FROM (SELECT *, lag(sector) OVER (PARTITION BY layout, track ORDER BY i, sector) AS b FROM idx) WHERE sector <= b UNION ALL SELECT layout, 'no_index_1', 2, CAST(track AS VARCHAR) FROM q WHERE NOT has1""",
    idx="SELECT l_orderkey AS layout, l_linenumber AS track, l_suppkey % 2 AS i, l_partkey AS sector FROM lineitem",
)
def v2_layout(idx: DataFrame) -> DataFrame:
    return validation.layout_findings(idx.withColumnRenamed("i", "index"))


@query(
    """WITH n AS (SELECT target, count(*) FILTER (WHERE severity >= 2) AS f, count(*) FILTER (WHERE severity = 1) AS w FROM finds GROUP BY target)
 SELECT k, coalesce(f, 0) AS failures, coalesce(w, 0) AS warnings, CASE WHEN f > 0 THEN 'blocked' WHEN w > 0 THEN 'usable' ELSE 'ready' END AS grade FROM sets LEFT JOIN n ON k = target""",
    sets="SELECT o_orderkey AS k FROM orders",
    finds="SELECT l_orderkey AS target, CAST(floor(l_quantity) AS BIGINT) % 5 - 2 AS severity FROM lineitem WHERE l_partkey % 3 = 0",
)
def v4_readiness(sets: DataFrame, finds: DataFrame) -> DataFrame:
    return validation.readiness(sets, finds, "k")


@query(
    """WITH t AS (SELECT k, sum(n)::BIGINT AS sectors FROM tr GROUP BY k), b AS (SELECT k, count(DISTINCT sector) AS bad FROM bads GROUP BY k)
 SELECT t.k, sectors, coalesce(bad, 0) AS bad, CASE WHEN sectors > 360000 OR coalesce(bad, 0) > 0 THEN 'fail' WHEN sectors > 333000 THEN 'warn' ELSE 'pass' END AS verdict FROM t LEFT JOIN b ON t.k = b.k""",
    tr="SELECT l_orderkey AS k, l_partkey * 60 AS n FROM lineitem",
    bads="SELECT l_orderkey AS k, l_suppkey AS sector FROM lineitem WHERE l_quantity > 49",
)
def v5_capacity(tr: DataFrame, bads: DataFrame) -> DataFrame:
    return validation.capacity_gate(tr, bads, "k", "n")


@query(
    """WITH m AS (SELECT l.*, (a + b) // 2 AS at2, (SELECT max(s) FROM tr t WHERE t.d = l.d AND s <= (a + b) // 2) AS s FROM les l), j AS (SELECT m.*, t.n, t.x FROM m LEFT JOIN tr t ON t.d = m.d AND t.s = m.s)
 SELECT d AS disc, lesion, CASE WHEN at2 < s + n THEN x END AS is_data, b - a + 1 AS length,
 CASE WHEN s IS NULL OR at2 >= s + n THEN 'unknown' WHEN kind = 'burst' AND b - a + 1 > 16 THEN 'resurface' WHEN kind = 'periodic' THEN 'reread' WHEN x THEN 'rescue' ELSE 'rip_again' END AS advice FROM j""",
    les="SELECT o_custkey AS d, o_orderkey AS lesion, o_orderkey % 1000 AS a, o_orderkey % 1000 + o_orderkey % 40 AS b, CASE o_orderkey % 3 WHEN 0 THEN 'burst' WHEN 1 THEN 'periodic' ELSE 'scatter' END AS kind FROM orders",
    tr="SELECT c_custkey AS d, 100 AS s, 300 AS n, true AS x FROM customer UNION ALL SELECT c_custkey, 500, 200, false FROM customer",
)
def v6_lesion_advice(les: DataFrame, tr: DataFrame) -> DataFrame:
    return validation.lesion_advice(les.selectExpr("d AS disc", "lesion", "a AS first", "b AS last", "kind"), tr.selectExpr("d AS disc", "s AS start", "n AS length", "x AS is_data"))


@query(
    """WITH r AS (SELECT f, o, v, CASE WHEN length(v) > 0 AND v = repeat(v[1:1], length(v)) THEN hex(encode(v[1:1])) END AS x FROM blocks), s AS (SELECT *, CASE WHEN x IS NULL THEN min(o) OVER (PARTITION BY f, v) END AS src FROM r),
 n AS (SELECT *, CASE WHEN x IS NOT NULL THEN 'fill' WHEN o = src THEN 'unique' ELSE 'copy' END AS role FROM s), m AS (SELECT *, CASE WHEN role = 'fill' AND lag(x) OVER w = x AND lag(o) OVER w = o - 1 THEN 0 ELSE 1 END AS k FROM n WINDOW w AS (PARTITION BY f ORDER BY o)),
 q AS (SELECT *, sum(k) OVER (PARTITION BY f ORDER BY o) AS run FROM m)
 SELECT f AS file, min(o) AS "first", max(o) AS "last", min(role) AS role, min(x) AS value, max(CASE WHEN role = 'copy' THEN src END) AS source FROM q GROUP BY f, run""",
    blocks="SELECT user_id AS f, event_id AS o, CASE WHEN event_id % 3 = 0 THEN repeat('z', 8) WHEN event_id % 3 = 1 THEN 'zzzzzzzz' ELSE event_type END AS v FROM events",
)
def v8_block_descriptor(blocks: DataFrame) -> DataFrame:
    return validation.block_descriptor(blocks.withColumn("v", F.col("v").cast("binary")), "f", "o", "v")


@query("SELECT g, count(*) AS n, count(*) FILTER (WHERE ok) AS agree, count(*) >= 2 AND bool_and(ok) AS corroborated FROM att GROUP BY g", att="SELECT l_orderkey AS g, l_quantity > 10 AS ok FROM lineitem")
def v10_attestations(att: DataFrame) -> DataFrame:
    return validation.attestation_summary(att, "g", "ok")


#: A source reads a sector once; orders may repeat a line's number.
READS = """SELECT l_suppkey AS disc, l_partkey AS lba, l_orderkey * 10 + l_linenumber AS source, CASE WHEN l_quantity > 3 THEN concat(CASE WHEN l_partkey % 7 = 0 THEN 'FF' WHEN l_returnflag = 'R' THEN '0A' ELSE '0B' END,
 CASE WHEN l_linenumber % 3 = 0 THEN '11' ELSE '12' END, CASE WHEN l_tax > 0.04 THEN '77' ELSE '78' END, CASE WHEN l_quantity > 40 THEN '0A' WHEN l_quantity > 30 THEN '0B' ELSE '0C' END) END AS content
 FROM (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_tax) AS l_tax, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_suppkey, l_partkey, l_orderkey, l_linenumber) AS li"""
KNOWN = "SELECT l_suppkey AS disc, l_partkey AS lba, l_orderkey * 10 + l_linenumber AS source FROM lineitem WHERE l_orderkey % 17 = 0"
CONFIRMED = "SELECT l_suppkey AS disc, l_partkey AS first, l_partkey + 1 AS last, l_orderkey * 10 + l_linenumber AS source FROM lineitem WHERE l_orderkey % 40 = 1"
#: In SQL, of a content c: valid if its first and last bytes are equal, unknown if it begins with FF; mended by setting the last byte if the second is 12.
VALID = "(CASE WHEN c[1:2] <> 'FF' THEN c[1:2] = c[7:8] END)"
MENDED = "(CASE WHEN c[1:2] <> 'FF' AND c[3:4] = '12' THEN c[1:6] || c[1:2] END)"
VOTE = f"""spot AS (SELECT disc, lba, i, content[2 * i - 1:2 * i] AS b, count(*) AS n, min(source) AS s FROM g, range(1, 5) t(i) GROUP BY ALL), win AS (SELECT *, row_number() OVER (PARTITION BY disc, lba, i ORDER BY n DESC, s) AS r FROM spot),
 vote AS (SELECT disc, lba, c, {VALID} AS vv, {MENDED} AS vm FROM (SELECT disc, lba, string_agg(b, '' ORDER BY i) AS c FROM win WHERE r = 1 GROUP BY disc, lba))"""
MERGE = f"""WITH g AS (SELECT r.*, content AS c FROM reads r WHERE content IS NOT NULL AND NOT EXISTS (SELECT 1 FROM holes h WHERE h.disc = r.disc AND h.lba = r.lba AND h.source = r.source)), {VOTE},
 b AS (SELECT disc, lba, count(*) AS n, count(DISTINCT content) AS k, min(source) AS s1, arg_min(content, source) AS c1, min(source) FILTER (WHERE {VALID}) AS s2, arg_min(content, source) FILTER (WHERE {VALID}) AS c2 FROM g GROUP BY ALL),
 f AS (SELECT r.disc, r.lba, min(r.source) AS s3, arg_min(r.content, r.source) AS c3 FROM reads r JOIN confirmed f ON f.disc = r.disc AND f.source = r.source AND r.lba BETWEEN f.first AND f.last WHERE r.content IS NOT NULL GROUP BY ALL),
 done AS (SELECT disc, lba, CASE WHEN s3 IS NOT NULL THEN c3 WHEN k = 1 THEN c1 WHEN s2 IS NOT NULL THEN c2 ELSE vote.c END AS content, CASE WHEN s3 IS NOT NULL THEN 'confirmed' WHEN n IS NULL THEN 'unrecovered' WHEN n = 1 THEN 'single' WHEN k = 1 THEN 'agreed'
  WHEN s2 IS NOT NULL THEN 'verified' WHEN vv THEN 'vote_verified' WHEN vv IS NULL THEN 'vote_best_effort' ELSE 'unrecovered' END AS method, CASE WHEN s3 IS NOT NULL THEN s3 WHEN k = 1 THEN s1 ELSE s2 END AS source
  FROM (SELECT DISTINCT disc, lba FROM reads) LEFT JOIN b USING (disc, lba) LEFT JOIN vote USING (disc, lba) LEFT JOIN f USING (disc, lba))"""


def _check(c: Column) -> Column:
    byte = lambda k: F.substring(F.hex(c), 2 * k + 1, 2)
    return F.when(byte(0) != "FF", byte(0) == byte(3))


def _mend(c: Column) -> Column:
    h = F.hex(c)
    return F.when((F.substring(h, 1, 2) != "FF") & (F.substring(h, 3, 2) == "12"), F.unhex(F.concat(F.substring(h, 1, 6), F.substring(h, 1, 2))))


def _bytes(reads: DataFrame) -> DataFrame:
    return reads.withColumn("content", F.unhex("content"))


@query(f"{MERGE} SELECT * FROM done", reads=READS, holes=KNOWN, confirmed=CONFIRMED)
def v12_provenance_merge(reads: DataFrame, holes: DataFrame, confirmed: DataFrame) -> DataFrame:
    return validation.provenance_merge(_bytes(reads), _check, holes, confirmed).withColumn("content", F.hex("content"))


@query(
    f"""{MERGE}, r AS (SELECT *, CASE WHEN lag(method) OVER w IS NOT DISTINCT FROM method AND lag(source) OVER w IS NOT DISTINCT FROM source AND lag(lba) OVER w = lba - 1 THEN 0 ELSE 1 END AS n FROM done WINDOW w AS (PARTITION BY disc ORDER BY lba)),
 q AS (SELECT *, sum(n) OVER (PARTITION BY disc ORDER BY lba) AS run FROM r) SELECT disc, method, source, min(lba) AS "first", max(lba) AS "last" FROM q GROUP BY disc, run, method, source""",
    reads=READS,
    holes=KNOWN,
    confirmed=CONFIRMED,
)
def v12_provenance_runs(reads: DataFrame, holes: DataFrame, confirmed: DataFrame) -> DataFrame:
    return validation.provenance_runs(validation.provenance_merge(_bytes(reads), _check, holes, confirmed))


@query(
    f"""WITH g AS (SELECT *, content AS c FROM reads WHERE content IS NOT NULL), x AS (SELECT *, {VALID} AS v, CASE WHEN NOT {VALID} THEN {MENDED} END AS m FROM g), {VOTE},
 b AS (SELECT disc, lba, count(DISTINCT content) AS k, coalesce(bool_or(NOT v), false) AS bad, min(content) AS c1, arg_min(content, source) FILTER (WHERE v) AS c2, arg_min(m, source) FILTER (WHERE m IS NOT NULL) AS c3 FROM x GROUP BY ALL)
 SELECT disc, lba, CASE WHEN k = 1 AND NOT bad THEN 'agreed' WHEN c2 IS NOT NULL THEN 'verified_copy' WHEN c3 IS NOT NULL THEN 'repaired_copy' WHEN k = 1 THEN 'unrecovered' WHEN vv THEN 'vote_verified' WHEN vv IS NULL THEN 'vote_best_effort' WHEN vm IS NOT NULL THEN 'repaired_vote' ELSE 'unrecovered' END AS rung,
 CASE WHEN k = 1 AND NOT bad THEN c1 WHEN c2 IS NOT NULL THEN c2 WHEN c3 IS NOT NULL THEN c3 WHEN k = 1 THEN c1 WHEN vv THEN c WHEN vv IS NULL THEN c ELSE coalesce(vm, c) END AS content FROM b JOIN vote USING (disc, lba)""",
    reads=READS,
)
def v13_reconstruct(reads: DataFrame) -> DataFrame:
    return validation.reconstruct(_bytes(reads), _check, _mend).withColumn("content", F.hex("content"))


@query(
    """WITH d AS (SELECT checksum, max(confidence) AS confidence FROM db GROUP BY checksum) SELECT k, idx, confidence FROM
 (SELECT c.*, confidence, row_number() OVER (PARTITION BY k ORDER BY coalesce(confidence, -1) DESC, idx) AS r FROM cand c LEFT JOIN d ON c.checksum = d.checksum) WHERE r = 1""",
    cand="SELECT l_orderkey AS k, l_linenumber * 1000000 + l_partkey AS idx, l_partkey AS checksum FROM lineitem",
    db="SELECT p_partkey AS checksum, p_size AS confidence FROM part WHERE p_partkey % 3 = 0",
)
def v14_tie_break(cand: DataFrame, db: DataFrame) -> DataFrame:
    return validation.tie_break(cand, db, "k")


@query("SELECT key, n, array_to_string(members, ',') AS members FROM (SELECT lower(m) AS key, count(DISTINCT s) AS n, list_sort(list(DISTINCT s)) AS members FROM marks WHERE m <> '' GROUP BY lower(m))", marks="SELECT CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN upper(p_brand) ELSE p_brand END AS m, p_type AS s FROM part")
def a14_grouped_members(marks: DataFrame) -> DataFrame:
    return validation.grouped_members(marks, F.lower("m"), "s").select("key", F.col("n").cast("long").alias("n"), F.array_join("members", ",").alias("members"))


@query(
    """WITH s AS (SELECT g, min(p) AS lo, max(p) AS hi FROM sam GROUP BY g), b AS (SELECT g, CAST(coalesce(least(floor((p - lo) * 8 / nullif(hi - lo, 0)), 7), 0) AS INT) AS b, sum(w) AS x FROM sam JOIN s USING (g) GROUP BY ALL),
 v AS (SELECT g, b, CAST(round_even(255 * ln(1 + x) / nullif(max(ln(1 + x)) OVER (PARTITION BY g), 0), 0) AS INT) AS v FROM b), f AS (SELECT g, i, coalesce(v, 0) AS v FROM (SELECT g, unnest(range(8)) AS i FROM s) LEFT JOIN v USING (g) WHERE v.b = i OR v.b IS NULL),
 a AS (SELECT s.g, i, coalesce((SELECT v FROM v WHERE v.g = s.g AND v.b = i), 0) AS v FROM s, range(8) t(i)) SELECT g, string_agg(v, ',' ORDER BY i) AS print, count(*) FILTER (WHERE v > 0) / 8 AS "distinct" FROM a GROUP BY g""",
    sam="SELECT l_suppkey AS g, l_orderkey AS p, floor(l_quantity) AS w FROM lineitem",
)
def a22_range_fingerprint(sam: DataFrame) -> DataFrame:
    out = validation.range_fingerprint(sam, "g", "p", "w", 8)
    return out.select("g", F.array_join("fingerprint", ",").alias("print"), "distinct")


@query(
    "SELECT d, lba, a, twins, a <> lba AS misplaced FROM (SELECT *, count(*) OVER (PARTITION BY d, a) AS twins FROM secs WHERE a IS NOT NULL) WHERE twins > 1 OR a <> lba",
    secs="SELECT o_custkey AS d, o_orderkey AS lba, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 150 ELSE o_orderkey END AS a FROM orders",
)
def f18_twin_headers(secs: DataFrame) -> DataFrame:
    return validation.twin_headers(secs, "d", "a", "lba")


@query("SELECT k, CASE WHEN n <= 0 THEN 'none' WHEN n <= 2 THEN 'corrected' ELSE 'uncorrectable' END AS class FROM sym", sym="SELECT l_orderkey AS k, l_linenumber - 1 AS n FROM lineitem")
def p11_symbol_class(sym: DataFrame) -> DataFrame:
    return sym.select("k", validation.symbol_class(F.col("n"), 2).alias("class"))


@query("SELECT k FROM drives WHERE contains(regexp_replace(upper(n), '[^A-Z0-9]', '', 'g'), 'R00000007')", drives="SELECT c_custkey AS k, c_name AS n FROM customer")
def p9_fuzzy_lookup(drives: DataFrame) -> DataFrame:
    return validation.fuzzy_lookup(drives.withColumn("n", F.upper("n")), "n", "r#00000007").select("k")


@query(
    """WITH s AS (SELECT DISTINCT set, folder, stem FROM refs), x AS (SELECT r.set, f.file, 0 AS r FROM refs r JOIN fs f ON f.folder = r.folder AND f.file = r.file UNION ALL SELECT s.set, f.file, 1 FROM s JOIN fs f ON f.folder = s.folder AND f.stem = s.stem
 UNION ALL SELECT s.set, l.file, 2 FROM s JOIN (SELECT folder, min(file) AS file FROM fs WHERE extension = 'log' GROUP BY folder HAVING count(*) = 1) l ON l.folder = s.folder)
 SELECT set, file, ['referenced', 'sidecar', 'log'][min(r) + 1] AS reason FROM x GROUP BY set, file""",
    fs="SELECT p_size AS folder, concat('n', p_partkey % 30, CASE p_partkey % 11 WHEN 0 THEN '.log' ELSE '.bin' END) AS file, concat('n', p_partkey % 30) AS stem, CASE p_partkey % 11 WHEN 0 THEN 'log' ELSE 'bin' END AS extension FROM part",
    refs="SELECT s_suppkey AS set, CAST(s_suppkey % 50 + 1 AS INT) AS folder, concat('n', s_suppkey % 30) AS stem, CASE WHEN s_suppkey % 2 = 0 THEN concat('n', s_suppkey % 13, '.bin') END AS file FROM supplier",
)
def v9_member_sets(fs: DataFrame, refs: DataFrame) -> DataFrame:
    return validation.member_sets(fs, refs)
