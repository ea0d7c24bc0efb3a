"""Queries of checksums, fingerprints, similarity evidence and case lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, recovery, text
from ..operators import genealogy, runs, similarity, statistics, validation
from .registry import query

NAMES = "SELECT p_partkey AS k, p_name AS t FROM part"
#: In SQL, the bytes of a text t of ASCII letters.
BYTES = "list_transform(string_split(t, ''), lambda c: ord(c))"


def _crc(start: str, width: str, first: str, step: str) -> str:
    """SQL for a CRC of bytes b: of each byte first, then eight times step."""
    steps = f"list_reduce([{first}, " + ", ".join([f"0::{width}"] * 8) + f"], lambda x, z: {step})"
    return f"list_reduce([{start}::{width}] || list_transform(b, lambda e: e::{width}), lambda c, d: {steps})"


CRC16 = _crc("0", "INT", "xor(c, d << 8)", "xor((x << 1) & 65535, CASE WHEN x & 32768 > 0 THEN 4129 ELSE 0 END)")
CRC64 = _crc("18446744073709551615", "UBIGINT", "xor(c, d)", "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 14514072000185962306 ELSE 0 END::UBIGINT)")


@query(f"SELECT k, crc, 65535 - crc AS inverted, lpad(lower(to_hex(xor(crc64, 18446744073709551615::UBIGINT))), 16, '0') AS crc64 FROM (SELECT k, {CRC16} AS crc, {CRC64} AS crc64 FROM (SELECT k, {BYTES} AS b FROM names))", names=NAMES)
def f4_crc(names: DataFrame) -> DataFrame:
    b = F.col("t").cast("binary")
    of = kernels.byte_function
    return names.select("k", of(kernels.crc16, "int")(b).alias("crc"), of(lambda x: kernels.crc16(x, inverted=True), "int")(b).alias("inverted"), of(lambda x: f"{kernels.crc64(x):016x}", "string")(b).alias("crc64"))


@query("SELECT k, hex(encode(t)) AS hex, t AS back, list_filter(range(0, length(t)), lambda i: t[i + 1:i + 2] = 'aa') AS places FROM names", names="SELECT p_partkey AS k, concat(repeat('a', p_size % 5), p_name, 'aaa') AS t FROM part")
def f7_hex_and_places(names: DataFrame) -> DataFrame:
    b = F.col("t").cast("binary")
    return names.select("k", F.hex(b).alias("hex"), F.unhex(F.hex(b)).cast("string").alias("back"), F.transform(text.places(b, b"aa"), lambda i: i.cast("long")).alias("places"))


@query(
    "SELECT k, CASE k % 4 WHEN 0 THEN 'L123' WHEN 1 THEN 'AB12' WHEN 2 THEN 'LQ' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') END AS sid FROM marks",
    marks="SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'IFPI L123 x' WHEN 1 THEN 'mould ifpi AB12' WHEN 2 THEN concat('IFPILq', lpad(CAST(p_partkey % 100 AS STRING), 2, '0')) ELSE 'none' END AS mark FROM part",
)
def f9_sid_code(marks: DataFrame) -> DataFrame:
    return marks.select("k", text.sid_code(F.col("mark")).alias("sid"))


@query(
    "SELECT k, k % 3 = 0 AS mcn, k % 4 < 2 AS isrc FROM codes",
    codes="SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN lpad(CAST(p_partkey AS STRING), 13, '0') WHEN 1 THEN '123' END AS mcn, CASE p_partkey % 4 WHEN 0 THEN 'US-ABC-12-34567' WHEN 1 THEN 'gbaye6800011' WHEN 2 THEN 'US-ABC-12-3456' END AS isrc FROM part",
)
def f10_valid_codes(codes: DataFrame) -> DataFrame:
    return codes.select("k", text.valid_mcn(F.col("mcn")).alias("mcn"), text.valid_isrc(F.col("isrc")).alias("isrc"))


@query("SELECT k, round(exp(0.7 / 8.617333262e-5 * (1 / 298.15 - 1 / (c + 273.15))), 6) AS factor FROM temps", temps="SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS c FROM part")
def f13_arrhenius(temps: DataFrame) -> DataFrame:
    return temps.select("k", F.round(text.arrhenius(F.col("c")), 6).alias("factor"))


@query(
    "SELECT k, sha256(concat(count(*), ';', string_agg(concat(n, CASE WHEN d THEN 'D' ELSE 'A' END, u, ';'), '' ORDER BY n, d, u))) AS layout FROM tr GROUP BY k",
    tr="SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS n, l_partkey % 3 = 0 AS d, l_partkey AS u FROM lineitem",
)
def f16_layout_hash(tr: DataFrame) -> DataFrame:
    tracks = tr.groupBy("k").agg(F.collect_list(F.struct(F.col("n").alias("number"), F.col("d").alias("is_data"), F.col("u").alias("units"))).alias("t"))
    return tracks.select("k", text.layout_hash(F.col("t")).alias("layout"))


@query(
    """WITH s AS (SELECT k, s, list_filter(list_transform(range(0, len(a)), lambda i: CASE WHEN i + s >= 0 AND i + s < len(b) THEN (abs(a[i + 1] - b[i + s + 1]) <= 1)::INT END), lambda x: x IS NOT NULL) AS m FROM envs, range(-4, 5) t(s)),
 v AS (SELECT k, s, coalesce(list_sum(m) / nullif(len(m), 0), 0) AS v FROM s), w AS (SELECT k, s, v, row_number() OVER (PARTITION BY k ORDER BY v DESC, s) AS r FROM v) SELECT k, CASE WHEN v = 0 THEN 0 ELSE s END::INT AS shift, v AS share FROM w WHERE r = 1""",
    envs="SELECT p_partkey AS k, array(p_size, p_size % 7 * 5, 3, p_partkey % 11 * 3, 20, p_size % 5 * 9) AS a, array(9, p_size, p_size % 7 * 5 + 1, 3, p_partkey % 13 * 3, 20) AS b FROM part",
)
def f16_best_shift(envs: DataFrame) -> DataFrame:
    return envs.select("k", text.best_shift(F.col("a"), F.col("b")).alias("s")).select("k", "s.*")


def _sector(k, mode: int) -> bytes:
    """A sector whose content its number gives."""
    body = bytes((int(k) * 31 + i * i) % 256 for i in range(2336))
    raw = recovery.SYNC + bytes([0, 2, int(k) % 75, mode]) + (b"\0\0\x08\0" * 2 + body[8:] if mode == 2 else body)
    return recovery.with_parity(raw)


def _sectors(rows: DataFrame) -> DataFrame:
    """Sectors by number: of four an intact one of mode 1, an audio one, a damaged one of mode 1 and one of mode 2."""
    kernel = kernels.byte_function

    def made(b: bytes) -> bytes:
        k = int(b)
        good = _sector(k, 2 if k % 4 == 3 else 1)
        return good if k % 4 == 0 else b"\1" * 2352 if k % 4 == 1 else good[:100] + bytes([good[100] ^ 255]) + good[101:]

    return rows.withColumn("content", kernel(made, "binary")(F.col("k").cast("string").cast("binary")))


@query("SELECT k, CASE WHEN k % 4 = 1 THEN NULL ELSE k % 4 = 0 END AS valid, k % 4 >= 2 AS repaired FROM secs", secs="SELECT s_suppkey AS k FROM supplier")
def f17_sector_check(secs: DataFrame) -> DataFrame:
    kernel, c = kernels.byte_function, F.col("content")
    fixed = kernel(recovery.sector_repair, "binary")(c)
    return _sectors(secs).select("k", kernel(recovery.sector_check, "boolean")(c).alias("valid"), F.coalesce(kernel(recovery.sector_check, "boolean")(fixed), F.lit(False)).alias("repaired"))


@query("SELECT CAST(k % 5 AS INT) AS disc, k AS lba, CASE k % 4 WHEN 0 THEN 'agreed' WHEN 1 THEN 'agreed' ELSE CASE WHEN k % 3 = 0 THEN 'verified_copy' ELSE 'repaired_copy' END END AS rung FROM secs", secs="SELECT s_suppkey AS k FROM supplier")
def v13_sectors(secs: DataFrame) -> DataFrame:
    """The ladder over real sectors: two reads of each, and of a third of them an intact one besides."""
    kernel = kernels.byte_function
    first = _sectors(secs).select((F.col("k") % 5).cast("int").alias("disc"), F.col("k").alias("lba"), F.lit(1).alias("source"), "content")
    good = first.filter("lba % 3 = 0 AND lba % 4 > 1").withColumn("source", F.lit(3)).withColumn("content", kernel(recovery.sector_repair, "binary")("content"))
    reads = first.unionByName(first.withColumn("source", F.lit(2))).unionByName(good)
    out = validation.reconstruct(reads, lambda c: kernel(recovery.sector_check, "boolean")(c), lambda c: kernel(recovery.sector_repair, "binary")(c))
    return out.select("disc", "lba", "rung")


@query("SELECT g AS stripe, i AS o, hex(encode(v)) AS content FROM blocks", blocks="SELECT l_suppkey AS g, l_linenumber AS i, concat('block ', max(l_returnflag), lpad(CAST(max(l_partkey) AS STRING), 9, '0')) AS v FROM lineitem GROUP BY l_suppkey, l_linenumber")
def f20_parity(blocks: DataFrame) -> DataFrame:
    """Blocks of which two of each stripe are lost and come back from two of parity."""
    rows = blocks.select(F.col("g").alias("stripe"), (F.dense_rank().over(_by("g", "i")) - 1).cast("long").alias("o"), F.col("i"), F.col("v").cast("binary").alias("content"))
    parity = recovery.parity_blocks(rows, "stripe", "o", "content", 2)
    sizes = rows.groupBy("stripe").agg(F.count("*").alias("data")).withColumn("parities", F.lit(2))
    whole = recovery.heal_blocks(rows.filter("o > 1"), parity, sizes, "stripe", "o", "content")
    return whole.join(rows.select("stripe", "o", "i"), ["stripe", "o"]).select("stripe", F.col("i").alias("o"), F.hex("content").alias("content"))


def _by(group: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(*order)


WORDS = "SELECT l_suppkey AS g, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS p, l_partkey * 70001 + l_suppkey * 1234567 AS w FROM lineitem"


@query("SELECT g, (sum((w * p) & 4294967295) % 4294967296)::BIGINT AS v1, (sum(((w * p) & 4294967295) + ((w * p) >> 32)) % 4294967296)::BIGINT AS v2 FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM words) WHERE p > 5 AND p <= n - 3 GROUP BY g", words=WORDS)
def a19_weighted_sums(words: DataFrame) -> DataFrame:
    return statistics.weighted_sums(words, "g", "p", "w", 5, 3)


@query("SELECT a.g, a.p AS start, (sum(b.w::HUGEINT * (b.p - a.p + 1)) % 4294967296)::BIGINT AS v1 FROM words a JOIN words b ON a.g = b.g AND b.p BETWEEN a.p AND a.p + 15 GROUP BY a.g, a.p HAVING count(*) = 16", words=WORDS)
def w16_offset_sums(words: DataFrame) -> DataFrame:
    return statistics.offset_sums(words, "g", "p", "w", 16)


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY i) AS k, count(*) OVER (PARTITION BY g) AS n, (o + 150) // 75 AS s FROM offs), d AS (SELECT *, list_sum(list_transform(string_split(CAST(s AS VARCHAR), ''), lambda c: c::INT)) AS d FROM r)
 SELECT g, (sum(o) % 4294967296)::BIGINT AS id1, (sum(greatest(o, 1) * k) % 4294967296)::BIGINT AS id2, (coalesce(sum(d) FILTER (WHERE k < n), 0) % 255 * 16777216 + (max(s) FILTER (WHERE k = n) - max(s) FILTER (WHERE k = 1)) * 256 + count(*) - 1)::BIGINT AS cddb FROM d GROUP BY g HAVING count(*) > 1""",
    offs="SELECT l_orderkey AS g, l_linenumber AS i, (l_linenumber - 1) * 15000 + max(l_partkey) AS o FROM lineitem GROUP BY l_orderkey, l_linenumber",
)
def a19_disc_ids(offs: DataFrame) -> DataFrame:
    return statistics.disc_ids(offs, "g", "i", "o")


@query(
    """WITH b AS (SELECT g, c, f // 20 AS b, sum(x * x) AS q, count(*) AS n, max(abs(x)) AS p FROM pcm GROUP BY ALL), r AS (SELECT *, sqrt(2 * q / n) AS r, count(*) OVER (PARTITION BY g, c) AS m FROM b),
 k AS (SELECT *, row_number() OVER (PARTITION BY g, c ORDER BY r DESC, b) AS i, row_number() OVER (PARTITION BY g, c ORDER BY p DESC, b) AS j FROM r),
 e AS (SELECT g, c, max(p) FILTER (WHERE j = least(2, m)) AS p2, sqrt(avg(r * r) FILTER (WHERE i <= greatest(1, m // 5))) AS top, sum(q) AS q, sum(n) AS n, max(p) AS p FROM k GROUP BY g, c)
 SELECT g, round(20 * log10(greatest(max(p), 1e-10)), 6) AS peak_db, round(20 * log10(greatest(sqrt(sum(q) / sum(n)), 1e-10)), 6) AS rms_db, round(avg(20 * log10(greatest(p2, 1e-10)) - 20 * log10(greatest(top, 1e-10))), 6) AS range_db FROM e GROUP BY g""",
    pcm="SELECT event_type AS g, user_id % 2 AS c, event_id AS f, CAST(coalesce(value, 0) AS DOUBLE) / 1000 AS x FROM events",
)
def a20_dynamics(pcm: DataFrame) -> DataFrame:
    out = statistics.dynamics(pcm, "g", "c", "f", "x", 20)
    return out.select("g", *(F.round(c, 6).alias(c) for c in ("peak_db", "rms_db", "range_db")))


@query(
    f"""WITH s AS (SELECT g, min(p) AS lo, max(p) AS hi, max(v) AS m FROM sp GROUP BY g), u AS (SELECT sp.g, ((p - lo) * 64 // (hi - lo + 1))::INT AS i, avg(v) AS a, any_value(m) AS m FROM sp JOIN s USING (g) GROUP BY ALL),
 c AS (SELECT g, list(coalesce(least(255, greatest(0, round_even(a / m * 255, 0)))::INT, 0) ORDER BY i) AS b FROM (SELECT s.g, t.i, u.a, s.m FROM s CROSS JOIN range(64) t(i) LEFT JOIN u ON u.g = s.g AND u.i = t.i) GROUP BY g) SELECT g, 65535 - {CRC16} AS fingerprint FROM c""",
    sp="SELECT l_suppkey AS g, l_orderkey AS p, CAST(l_quantity AS DOUBLE) AS v FROM lineitem",
)
def w12_speed_fingerprint(sp: DataFrame) -> DataFrame:
    return statistics.speed_fingerprint(sp, "g", "p", "v")


@query(
    """WITH bad AS (SELECT g, p, s, p - row_number() OVER (PARTITION BY g ORDER BY p) AS r FROM secs WHERE s > 0), e AS (SELECT g, min(p) AS a, max(p) + 1 AS b, max(s) AS w FROM bad GROUP BY g, r), z AS (SELECT g, max(p) + 1 AS n, max(s) AS m FROM secs GROUP BY g),
 q AS (SELECT g, m, w, greatest(a - 2, 0) AS a, least(b + 2, n) AS b FROM e JOIN z USING (g)), t AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY g ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM q),
 i AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM t) SELECT g, min(a) AS start, max(b) - min(a) AS sectors, max(w) AS worst, CASE m WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 7 END AS passes FROM i GROUP BY g, i, m""",
    secs="SELECT l_suppkey AS g, l_partkey AS p, max(CASE WHEN l_orderkey % 9 = 0 THEN l_orderkey % 4 ELSE 0 END) AS s FROM lineitem GROUP BY l_suppkey, l_partkey",
)
def w17_reread_plan(secs: DataFrame) -> DataFrame:
    return runs.reread_plan(secs, "g", "p", "s")


SETS = "SELECT l_suppkey AS k, l_partkey AS p, l_partkey % 60 AS c FROM lineitem"
SIMILAR = """pp AS (SELECT x.k AS a, y.k AS b, count(*) AS n FROM (SELECT DISTINCT k, p FROM sets) x JOIN (SELECT DISTINCT k, p FROM sets) y ON x.p = y.p AND x.k < y.k GROUP BY ALL), cc AS (SELECT x.k AS a, y.k AS b, count(*) AS n FROM (SELECT DISTINCT k, c FROM sets) x JOIN (SELECT DISTINCT k, c FROM sets) y ON x.c = y.c AND x.k < y.k GROUP BY ALL),
 ns AS (SELECT k, count(DISTINCT p) AS np, count(DISTINCT c) AS nc FROM sets GROUP BY k), j AS (SELECT a, b, 0.6 * coalesce(pp.n / (x.np + y.np - pp.n), 0) + 0.4 * coalesce(cc.n / (x.nc + y.nc - cc.n), 0) AS s FROM pp FULL JOIN cc USING (a, b) JOIN ns x ON x.k = a JOIN ns y ON y.k = b)"""


@query(
    f"WITH {SIMILAR} SELECT a, b, round(least(1, s + CASE WHEN a % 7 = b % 7 OR a % 7 < 2 AND b % 7 < 2 THEN 0.1 ELSE 0 END), 9) AS similarity FROM j WHERE round(least(1, s + CASE WHEN a % 7 = b % 7 OR a % 7 < 2 AND b % 7 < 2 THEN 0.1 ELSE 0 END), 9) >= 0.48",
    sets=SETS,
    names="SELECT s_suppkey AS k, CASE s_suppkey % 7 WHEN 0 THEN 'Tomb-Raider' WHEN 1 THEN 'TOMBRAIDER 2' WHEN 2 THEN 'Quake' WHEN 3 THEN 'quiz' WHEN 4 THEN 'abc1x' WHEN 5 THEN 'Zed' ELSE 'Other' END AS name FROM supplier",
)
def g1_profile_pairs(sets: DataFrame, names: DataFrame) -> DataFrame:
    pairs = similarity.profile_pairs(sets, sets, "k", "p", "c", 0.48 - 1e-9, names=names)  # rounded ones may be 0.48
    return pairs.select("a", "b", F.round("similarity", 9).alias("similarity")).filter("similarity >= 0.48D")


@query(
    f"""WITH {SIMILAR}, m AS (SELECT k, CAST(k % 9 AS INT) AS grp FROM ns WHERE k % 4 = 0), i AS (SELECT x.grp, s FROM m x JOIN m y ON x.grp = y.grp AND x.k < y.k LEFT JOIN j ON j.a = x.k AND j.b = y.k)
 SELECT grp AS "group", count(*) AS members, round(CASE WHEN count(*) = 1 THEN 1 ELSE (SELECT min(coalesce(s, 0)) FROM i WHERE i.grp = m.grp) END, 9) AS cohesion FROM m GROUP BY grp""",
    sets=SETS,
)
def g2_cohesion(sets: DataFrame) -> DataFrame:
    members = sets.select("k").distinct().filter("k % 4 = 0").select("k", (F.col("k") % 9).cast("int").alias("group"))
    pairs = similarity.profile_pairs(sets, sets, "k", "p", "c", 0.0, bonus=0.0, members=members)
    return similarity.cohesion(members, pairs, "k").withColumn("cohesion", F.round("cohesion", 9))


@query(
    """WITH f AS (SELECT *, CASE WHEN m <> '' THEN t || '|' || upper(replace(m, '-', '')) END AS family, nullif(upper(replace(o, ' ', '')), '') AS branch FROM rings), z AS (SELECT family, count(*) AS n, count(DISTINCT branch) AS b FROM f WHERE family IS NOT NULL GROUP BY family)
 SELECT k, f.family, branch, n AS members, b AS branches, CASE WHEN f.family IS NULL THEN 'unknown' WHEN n = 1 THEN 'lone' WHEN s <> '' AND branch IS NOT NULL THEN 'consistent' WHEN s <> '' OR branch IS NOT NULL THEN 'partial' ELSE 'suspect' END AS standing FROM f LEFT JOIN z USING (family)""",
    rings="SELECT p_partkey AS k, concat('T', p_size) AS t, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE concat('ab-', p_partkey % 5) END AS m, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'ifpi' END AS s, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'x 1' ELSE 'Y2' END AS o FROM part",
)
def g4_authenticity(rings: DataFrame) -> DataFrame:
    named = rings.select(F.col("k").alias("id"), F.col("t").alias("title"), F.col("m").alias("matrix"), F.col("s").alias("mastering"), F.col("o").alias("mould"))
    return genealogy.authenticity(genealogy.families(named)).select(F.col("id").alias("k"), "family", "branch", "members", "branches", "standing")


@query(
    """WITH p AS (SELECT k, x, y, list_filter(range(0, 6), lambda i: x[i + 1] > 20) AS d, list_filter(range(0, 6), lambda i: y[i + 1] > 20) AS e FROM bands), c AS (SELECT k, d, e, list_avg(x) AS mx, list_avg(y) AS my, x, y FROM p),
 s AS (SELECT *, list_sum(list_transform(range(1, 7), lambda i: (x[i] - mx) * (y[i] - my))) AS xy, list_sum(list_transform(x, lambda v: (v - mx) * (v - mx))) AS xx, list_sum(list_transform(y, lambda v: (v - my) * (v - my))) AS yy FROM c),
 o AS (SELECT k, coalesce(xy / nullif(sqrt(xx * yy), 0), 0) AS r, coalesce(len(list_intersect(d, e)) / nullif(least(len(d), len(e)), 0), 0) AS o, len(d) / 6 AS da, len(e) / 6 AS db FROM s) SELECT k, round(o, 9) AS overlap, round(0.6 * greatest(r, 0) + 0.4 * o, 9) AS similarity, da >= 0.02 AND db >= 0.02 AND 0.6 * greatest(r, 0) + 0.4 * o >= 0.8 AS same FROM o""",
    bands="SELECT p_partkey AS k, array(CAST(p_size AS DOUBLE), CAST(p_size % 7 AS DOUBLE), CAST(30 AS DOUBLE), CAST(0 AS DOUBLE), CAST(p_partkey % 50 AS DOUBLE), CAST(9 AS DOUBLE)) AS x, array(CAST(p_size + p_partkey % 3 AS DOUBLE), CAST(1 AS DOUBLE), CAST(25 + p_partkey % 9 AS DOUBLE), CAST(2 AS DOUBLE), CAST(p_partkey % 40 AS DOUBLE), CAST(9 AS DOUBLE)) AS y FROM part",
)
def g5_physical_match(bands: DataFrame) -> DataFrame:
    high = lambda c: F.filter(F.transform(c, lambda v, i: F.when(v > 20, i)), lambda i: i.isNotNull())
    pairs = bands.select("k", F.col("x").alias("profile_a"), F.col("y").alias("profile_b"), high("x").alias("defects_a"), high("y").alias("defects_b"))
    pairs = pairs.withColumns({"distinct_a": F.size("defects_a") / 6, "distinct_b": F.size("defects_b") / 6})
    return similarity.physical_match(pairs).select("k", F.round("overlap", 9).alias("overlap"), F.round("similarity", 9).alias("similarity"), "same")


@query(
    """WITH c AS (SELECT k, list_sort(list(DISTINCT s)) AS s FROM cat WHERE likely GROUP BY k), d AS (SELECT k, bool_or(v IN ('periodic', 'mixed')) AS x FROM band GROUP BY k), h AS (SELECT k, bool_or(t) AS x FROM head GROUP BY k),
 a AS (SELECT k FROM cat UNION SELECT k FROM band UNION SELECT k FROM head), f AS (SELECT a.k, c.s, coalesce(d.x, false) OR coalesce(h.x, false) AS p FROM a LEFT JOIN c USING (k) LEFT JOIN d USING (k) LEFT JOIN h USING (k))
 SELECT k, CASE WHEN s IS NOT NULL AND p THEN 'corroborated' WHEN s IS NOT NULL THEN 'files_only' WHEN p THEN 'physical_only' ELSE 'none' END AS standing, coalesce(array_to_string(s, ','), '') AS schemes, p AS physical FROM f""",
    cat="SELECT l_orderkey AS k, concat('S', l_partkey % 5) AS s, l_quantity > 45 AS likely FROM lineitem",
    band="SELECT o_orderkey AS k, CASE o_custkey % 5 WHEN 0 THEN 'periodic' WHEN 1 THEN 'mixed' ELSE 'burst' END AS v FROM orders WHERE o_orderkey % 3 = 0",
    head="SELECT o_orderkey AS k, o_custkey % 4 = 0 AS t FROM orders WHERE o_orderkey % 2 = 0",
)
def j19_protection_standing(cat: DataFrame, band: DataFrame, head: DataFrame) -> DataFrame:
    out = genealogy.protection_standing(cat.withColumnRenamed("s", "scheme"), band.withColumnRenamed("v", "verdict"), head.withColumnRenamed("t", "tricks"), "k")
    return out.withColumn("schemes", F.array_join("schemes", ","))


@query(
    """SELECT v.k, created IS NULL AS undated, coalesce(modified < created, false) AS modified_first, (SELECT count(*) FROM fs f WHERE f.k = v.k AND f.at > v.created + INTERVAL 2 SECOND) AS files_after FROM vols v""",
    vols="SELECT c_custkey AS k, CASE WHEN c_custkey % 5 > 0 THEN CAST('1995-06-01 00:00:00' AS TIMESTAMP) END AS created, CASE c_custkey % 3 WHEN 0 THEN CAST('1995-01-01 00:00:00' AS TIMESTAMP) WHEN 1 THEN CAST('1996-01-01 00:00:00' AS TIMESTAMP) END AS modified FROM customer",
    fs="SELECT o_custkey AS k, CAST(o_orderdate AS TIMESTAMP) AS at FROM orders",
)
def f12_chronology(vols: DataFrame, fs: DataFrame) -> DataFrame:
    return statistics.chronology(vols, fs, "k")


@query(
    """WITH e AS (SELECT *, sum(CASE WHEN a THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS c FROM ev), d AS (SELECT *, coalesce(bool_or(NOT a AND r) OVER (PARTITION BY k, c ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM e WHERE c > 0),
 g AS (SELECT k, c, min(t) AS first_flagged, count(*) FILTER (WHERE NOT a) AS attempts, bool_or(NOT a AND r) AS resolved, arg_max(nb, t) FILTER (WHERE nb IS NOT NULL AND NOT (NOT a AND r)) AS not_before FROM d WHERE NOT done GROUP BY k, c)
 SELECT k, first_flagged, attempts, resolved, not_before FROM (SELECT *, max(c) OVER (PARTITION BY k) AS top FROM g) WHERE resolved OR c = top""",
    ev="SELECT user_id AS k, event_id AS t, event_id % 5 = 0 AS a, event_id % 7 = 0 AS r, CASE WHEN event_id % 3 = 0 THEN event_id + 100 END AS nb FROM events",
)
def p6_open_cases(ev: DataFrame) -> DataFrame:
    rows = ev.select("k", "t", F.when(F.col("a"), "add").otherwise("attempt").alias("event"), F.col("r").alias("resolved"), F.col("nb").alias("not_before"))
    return statistics.open_cases(rows, "k", "t").select("k", F.col("first_flagged"), "attempts", "resolved", "not_before")


@query(
    """WITH RECURSIVE n AS (SELECT k, t, r, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM new), c AS (SELECT o.k, o.s AS seq, ''::VARCHAR AS previous, o.h AS digest, NULL::BIGINT AS t, NULL::VARCHAR AS r, 0::BIGINT AS i FROM old o
 UNION ALL SELECT c.k, c.seq + 1, c.digest, sha256(concat(c.seq + 1, chr(10), n.t, chr(10), n.r, chr(10), c.digest)), n.t, n.r, n.i FROM c JOIN n ON n.k = c.k AND n.i = c.i + 1) SELECT k, seq, previous, digest, t, r FROM c WHERE i > 0""".replace("WITH RECURSIVE ", "WITH "),
    new="SELECT conv_id AS k, turn AS t, role AS r FROM conversations",
    old="SELECT DISTINCT conv_id AS k, conv_id % 3 - 1 AS s, CASE WHEN conv_id % 3 > 0 THEN md5(role) ELSE '' END AS h FROM conversations WHERE turn = 0",
)
def w9_chained(new: DataFrame, old: DataFrame) -> DataFrame:
    last = old.filter("s >= 0").select("k", F.col("s").alias("seq"), F.col("h").alias("digest"))
    return runs.chained(new, last, "k", "t", ["t", "r"])
