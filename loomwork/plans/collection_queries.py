"""Queries of matching, differences, selection and tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matching, selection, similarity, statistics
from .registry import query

OLD = "SELECT o_orderkey AS path, floor(o_totalprice * 100) AS sha256, o_orderdate AS mtime FROM orders WHERE o_orderkey % 7 <> 0"
NEW = """SELECT CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS path, floor(o_totalprice * 100) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS sha256,
       CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 1 DAY END AS mtime FROM orders"""


@query(
    """SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.sha256 IS NOT DISTINCT FROM b.sha256 THEN 'unchanged'
       WHEN a.mtime IS NOT DISTINCT FROM b.mtime THEN 'rot_suspected' ELSE 'modified' END AS status FROM older a FULL JOIN newer b ON a.path = b.path""",
    older=OLD,
    newer=NEW,
)
def j4_snapshot_drift(older: DataFrame, newer: DataFrame) -> DataFrame:
    return matching.drift(older, newer)


FILES = "SELECT doc_id AS file_id, length(text) AS size, sha1(text) AS sha1, md5(text) AS md5, substring(md5(text), 1, 8) AS crc FROM documents"
CATALOG = """SELECT doc_id AS ord, concat('entry', doc_id) AS entry, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE length(text) END AS size,
       CASE WHEN doc_id % 4 = 0 THEN upper(sha1(text)) WHEN doc_id % 4 = 3 THEN sha1(concat(text, 'x')) END AS sha1,
       CASE WHEN doc_id % 4 = 1 THEN md5(text) END AS md5, substring(md5(text), 1, 8) AS crc FROM documents WHERE doc_id % 3 <> 0"""
TIERED = """WITH c AS (SELECT ord, entry, size AS cn, lower(sha1) AS s, lower(md5) AS m, lower(crc) AS c FROM catalog),
 met AS (SELECT file_id, ord, entry, CASE WHEN s = sha1 THEN 0 WHEN m = md5 AND (s IS NULL OR s = sha1) THEN 1 WHEN c = crc AND (s IS NULL OR s = sha1) THEN 2 WHEN c = crc THEN 3 END AS tier
         FROM files JOIN c ON (s = sha1 OR m = md5 OR c = crc) AND (cn = 0 OR cn = size)),
 best AS (SELECT file_id, tier, entry, row_number() OVER (PARTITION BY file_id ORDER BY tier, ord) AS k FROM met WHERE tier IS NOT NULL)
 SELECT f.file_id, coalesce(['sha1', 'md5', 'crc', 'crc_conflict'][tier + 1], 'none') AS evidence, entry FROM files f LEFT JOIN best b ON f.file_id = b.file_id AND k = 1"""


@query(TIERED, files=FILES, catalog=CATALOG)
def j1_tiered_match(files: DataFrame, catalog: DataFrame) -> DataFrame:
    return matching.tiered_match(files, catalog)


@query("SELECT sha1, crc FROM entries e WHERE NOT EXISTS (SELECT 1 FROM sold s WHERE s.sha1 = e.sha1)", entries="SELECT concat('p', p_partkey) AS sha1, 'x' AS crc FROM part", sold="SELECT concat('p', l_partkey) AS sha1, 'x' AS crc FROM lineitem WHERE l_quantity > 49")
def j5_missing_entries(entries: DataFrame, sold: DataFrame) -> DataFrame:
    return matching.missing_entries(entries, sold)


BASE = "SELECT doc_id AS path, length(text) AS size, CASE WHEN doc_id % 9 <> 0 THEN md5(text) END AS sha FROM documents WHERE doc_id % 6 <> 0"
HERE = "SELECT doc_id AS path, length(text) + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS size, md5(CASE WHEN doc_id % 4 = 0 THEN upper(text) ELSE text END) AS sha FROM documents WHERE doc_id % 5 <> 0"


@query(
    """SELECT * FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added_here' WHEN a.path IS NULL THEN 'missing_here' WHEN a.size <> b.size THEN 'size_mismatch' WHEN a.sha <> b.sha THEN 'hash_mismatch' END AS finding
       FROM here a FULL JOIN base b ON a.path = b.path) WHERE finding IS NOT NULL""",
    here=HERE,
    base=BASE,
)
def j6_baseline_diff(here: DataFrame, base: DataFrame) -> DataFrame:
    return matching.baseline_diff(here, base)


BEFORE = "SELECT doc_id AS ord, concat('Dir', doc_id % 7, CASE WHEN doc_id % 2 = 0 THEN '/' ELSE chr(92) END, 'F', doc_id) AS path, length(text) AS size, md5(text) AS sha FROM documents WHERE doc_id % 13 <> 0"
AFTER = "SELECT doc_id AS ord, concat('dir', CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 ELSE doc_id % 7 END, '/f', doc_id) AS path, length(text) + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS size, md5(text) AS sha FROM documents WHERE doc_id % 11 <> 0"
MOVES = r"""WITH a AS (SELECT ord, path, size, sha, replace(lower(path), chr(92), '/') AS p FROM older), b AS (SELECT ord, path, size, sha, replace(lower(path), chr(92), '/') AS p FROM newer),
 gone AS (SELECT *, row_number() OVER (PARTITION BY size, sha ORDER BY ord, p) AS i FROM a WHERE p NOT IN (SELECT p FROM b)),
 fresh AS (SELECT *, row_number() OVER (PARTITION BY size, sha ORDER BY ord, p) AS i FROM b WHERE p NOT IN (SELECT p FROM a))
 SELECT 'changed' AS kind, a.path AS old_path, b.path AS new_path FROM a JOIN b USING (p) WHERE a.size <> b.size OR a.sha <> b.sha
 UNION ALL SELECT CASE WHEN f.i IS NULL THEN 'removed' WHEN g.i IS NULL THEN 'added' ELSE 'moved' END, g.path, f.path FROM gone g FULL JOIN fresh f ON g.size = f.size AND g.sha = f.sha AND g.i = f.i"""


@query(MOVES, older=BEFORE, newer=AFTER)
def j3_move_diff(older: DataFrame, newer: DataFrame) -> DataFrame:
    return matching.move_diff(older, newer)


GAMES = "SELECT concat('g', l_orderkey) AS game, concat('F', l_linenumber) AS name, floor(l_quantity) AS size, CASE WHEN l_partkey % 3 > 0 THEN concat('S', l_partkey) END AS sha1, concat('C', l_partkey) AS crc FROM lineitem WHERE l_orderkey % 9 <> 0"
REVISED = """SELECT concat('g', l_orderkey) AS game, concat('f', l_linenumber) AS name, floor(l_quantity) AS size, CASE WHEN l_partkey % 3 > 0 THEN concat('s', l_partkey + CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END) END AS sha1,
       concat('c', l_partkey) AS crc FROM lineitem WHERE l_orderkey % 8 <> 0 AND NOT (l_orderkey % 5 = 0 AND l_linenumber = 2)"""
CHANGES = """WITH a AS (SELECT game, list_sort(list(concat(lower(name), ':', size, ':', lower(coalesce(sha1, crc))))) AS s, list(lower(coalesce(sha1, crc))) AS h FROM older GROUP BY game),
 b AS (SELECT game, list_sort(list(concat(lower(name), ':', size, ':', lower(coalesce(sha1, crc))))) AS s, list(lower(coalesce(sha1, crc))) AS h FROM newer GROUP BY game),
 j AS (SELECT coalesce(a.game, b.game) AS game, CASE WHEN a.game IS NULL THEN 'added' WHEN b.game IS NULL THEN 'removed' WHEN a.s <> b.s THEN 'changed' END AS change, a.h AS ah, b.h AS bh FROM a FULL JOIN b ON a.game = b.game)
 SELECT game, change, CASE WHEN change = 'changed' THEN len(bh) - len(ah) END AS more_files, CASE WHEN change = 'changed' THEN len(list_filter(bh, lambda x: NOT list_contains(ah, x))) END AS rehashed FROM j WHERE change IS NOT NULL"""


@query(CHANGES, older=GAMES, newer=REVISED)
def j2_catalog_diff(older: DataFrame, newer: DataFrame) -> DataFrame:
    return matching.catalog_diff(older, newer)


LINES = "SELECT l_orderkey AS g, l_linenumber * 1000000 + l_partkey AS o, l_partkey AS v FROM lineitem"
SHIFTED = "SELECT l_orderkey AS g, (l_linenumber * 1000000 + l_partkey) * CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE 1 END AS o, l_partkey AS v FROM lineitem WHERE l_linenumber <> 3"


@query(
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o) AS i FROM expected), b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o) AS i FROM actual)
 SELECT coalesce(a.g, b.g) AS g, coalesce(a.i, b.i) AS i, a.v AS expected, b.v AS actual, a.v IS NOT DISTINCT FROM b.v AS same FROM a FULL JOIN b ON a.g = b.g AND a.i = b.i""",
    expected=LINES,
    actual=SHIFTED,
)
def j10_positional_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return matching.positional_diff(expected, actual, "g", "o", "v")


@query(
    """WITH n AS (SELECT k, g, count(*) AS shared FROM (SELECT DISTINCT k, v FROM bought) JOIN (SELECT DISTINCT g, v FROM offered) USING (v) GROUP BY k, g)
 SELECT k, g, shared FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY shared DESC, g) AS i FROM n) WHERE i = 1""",
    bought="SELECT o_custkey AS k, l_partkey AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    offered="SELECT p_brand AS g, p_partkey AS v FROM part",
)
def j11_best_overlap(bought: DataFrame, offered: DataFrame) -> DataFrame:
    return matching.best_overlap(bought, offered, "k", "g", "v")


@query(
    """WITH db AS (SELECT ord, confidence, generate_subscripts(sums, 1) AS t, unnest(sums) AS s FROM records),
 ask AS (SELECT track, 1 AS version, v1 AS v FROM tracks UNION ALL SELECT track, 2, v2 FROM tracks),
 best AS (SELECT track, confidence, version, row_number() OVER (PARTITION BY track ORDER BY confidence DESC, ord DESC, version DESC) AS i FROM ask JOIN db ON track = t AND v = s)
 SELECT t.track, confidence, version FROM tracks t LEFT JOIN best b ON t.track = b.track AND i = 1""",
    tracks="SELECT CAST(p_size AS BIGINT) AS track, max(p_partkey) AS v1, min(p_partkey) AS v2 FROM part GROUP BY p_size",
    records="SELECT c_custkey AS ord, c_custkey % 50 AS confidence, array(c_custkey, c_custkey + 1, c_custkey + 3, c_custkey * 2) AS sums FROM customer",
)
def j12_array_lookup(tracks: DataFrame, records: DataFrame) -> DataFrame:
    return matching.array_lookup(tracks, records)


@query(
    "SELECT t.name, t.clone_of, t.description, p.description AS parent_value, coalesce(p.name, t.name) AS family FROM titles t LEFT JOIN titles p ON t.clone_of = p.name",
    titles="SELECT concat('t', p_partkey) AS name, CASE WHEN p_partkey % 3 = 0 THEN concat('t', p_partkey - 1) WHEN p_partkey % 7 = 0 THEN 'none' END AS clone_of, p_type AS description FROM part",
)
def j13_parent_lookup(titles: DataFrame) -> DataFrame:
    return matching.parent_lookup(titles)


@query(
    "SELECT ord, sha256, sha256 IN (SELECT sha256 FROM other WHERE sha256 IS NOT NULL) AS shared FROM own",
    own="SELECT doc_id AS ord, md5(text) AS sha256 FROM documents WHERE doc_id % 2 = 0",
    other="SELECT doc_id AS ord, md5(text) AS sha256 FROM documents WHERE doc_id % 2 = 1",
)
def j14_shared_chunks(own: DataFrame, other: DataFrame) -> DataFrame:
    return matching.shared_chunks(own, other)


@query(
    """SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'only_first' WHEN a.name IS NULL THEN 'only_second' WHEN a.value IS NOT DISTINCT FROM b.value THEN 'same' ELSE 'differs' END AS verdict,
       a.value AS "first", b.value AS "second" FROM bag_a a FULL JOIN bag_b b ON a.name = b.name""",
    bag_a="SELECT p_partkey AS name, p_brand AS value FROM part WHERE p_partkey % 3 <> 0",
    bag_b="SELECT p_partkey AS name, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_brand END AS value FROM part WHERE p_partkey % 5 <> 0",
)
def j15_trait_diff(bag_a: DataFrame, bag_b: DataFrame) -> DataFrame:
    return matching.trait_diff(bag_a, bag_b)


MARKS = """SELECT concat('prod', p_size) AS product, CASE WHEN p_partkey % 3 = 0 THEN 'file' WHEN p_partkey % 3 = 1 THEN 'directory' ELSE 'extension' END AS kind,
       CASE WHEN p_partkey % 3 = 0 THEN concat('f', p_partkey, '.bin') WHEN p_partkey % 3 = 1 THEN concat('d', p_size) ELSE concat('x', p_size) END AS mark, p_partkey % 4 = 0 AS strong FROM part WHERE p_partkey % 2 = 0
       UNION ALL SELECT 'tail', 'suffix', '7.bin', true UNION ALL SELECT 'tail2', 'suffix', '33.x4', false"""
PATHS = "SELECT concat('D', s_suppkey % 9, '/', CASE WHEN s_suppkey % 3 = 0 THEN 'F' ELSE 'q' END, s_suppkey * 3, CASE WHEN s_suppkey % 2 = 0 THEN '.X4' ELSE '.bin' END) AS path FROM supplier"


@query(
    """WITH p AS (SELECT DISTINCT lower(path) AS p FROM paths), leaf AS (SELECT p, string_split(p, '/') AS w FROM p),
 probe AS (SELECT 'file' AS kind, w[-1] AS m FROM leaf UNION SELECT 'extension', string_split(w[-1], '.')[-1] FROM leaf UNION SELECT 'directory', unnest(w[1:len(w) - 1]) FROM leaf),
 met AS (SELECT product, strong FROM marks k JOIN probe ON probe.kind = k.kind AND m = lower(mark) UNION ALL SELECT product, strong FROM (SELECT DISTINCT product, strong, mark FROM marks JOIN p ON kind = 'suffix' AND ends_with(p, mark))),
 n AS (SELECT product, count(*) FILTER (WHERE strong) AS n_strong, count(*) FILTER (WHERE NOT strong) AS n_other FROM met GROUP BY product)
 SELECT product, n_strong, n_other, CASE WHEN n_strong > 0 THEN 'high' WHEN n_other > 1 THEN 'medium' ELSE 'low' END AS confidence FROM n""",
    paths=PATHS,
    marks=MARKS,
)
def j16_signature_match(paths: DataFrame, marks: DataFrame) -> DataFrame:
    return matching.signature_match(paths, marks)


@query(
    "SELECT sha, r.piece, b.name FROM regions r JOIN blobs b USING (sha)",
    regions="SELECT l_orderkey AS piece, l_partkey AS sha FROM lineitem",
    blobs="SELECT p_partkey AS sha, p_name AS name FROM part",
)
def j17_resolve_blobs(regions: DataFrame, blobs: DataFrame) -> DataFrame:
    return matching.resolve_blobs(regions, blobs).select("sha", "piece", "name")


@query("SELECT DISTINCT sha FROM target WHERE sha NOT IN (SELECT sha FROM base)", target="SELECT l_partkey AS sha FROM lineitem WHERE l_quantity > 30", base="SELECT l_partkey AS sha FROM lineitem WHERE l_quantity < 3")
def j18_delta(target: DataFrame, base: DataFrame) -> DataFrame:
    return matching.delta(target, base)


@query(
    """WITH t AS (SELECT *, bool_or(NOT bad) OVER (PARTITION BY p_brand, p_type) AS other FROM parts)
 SELECT p_partkey, p_brand, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_name, p_partkey) AS k FROM t WHERE NOT (bad AND other)) WHERE k = 1""",
    parts="SELECT p_partkey, p_brand, p_type, p_size, p_name, p_size > 40 AS bad FROM part",
)
def w1_best_of_family(parts: DataFrame) -> DataFrame:
    out = selection.best_of_family(parts, ["p_brand", "p_type"], [F.col("p_size").desc(), F.col("p_name"), F.col("p_partkey")], F.col("bad"))
    return out.select("p_partkey", "p_brand", "p_type")


@query(
    "SELECT doc_id, ok AND row_number() OVER (PARTITION BY sha1 ORDER BY doc_id) > 1 AS is_duplicate FROM files",
    files="SELECT doc_id, sha1(text) AS sha1, doc_id % 8 <> 0 AS ok FROM documents",
)
def w2_first_seen(files: DataFrame) -> DataFrame:
    return selection.first_seen(files, "sha1", [F.col("doc_id")], F.col("ok")).select("doc_id", "is_duplicate")


@query(
    "SELECT doc_id, h IS NULL OR row_number() OVER (PARTITION BY h ORDER BY quality DESC NULLS LAST, doc_id) = 1 AS keep FROM copies",
    copies="SELECT d.doc_id, md5(text) AS h, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def w3_keep_best(copies: DataFrame) -> DataFrame:
    return selection.keep_best(copies, "h", F.col("quality"), "doc_id").select("doc_id", "keep")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM ev) WHERE k = 1", ev="SELECT user_id, event_id, event_type, ts FROM events")
def w15_latest(ev: DataFrame) -> DataFrame:
    return selection.latest(ev, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query(
    """WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM parts WHERE p_type IS NOT NULL GROUP BY ALL)
 SELECT p_brand, p_type, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k FROM n) WHERE k = 1""",
    parts="SELECT p_brand, p_type FROM part",
)
def a13_modal_label(parts: DataFrame) -> DataFrame:
    return selection.modal_label(parts, "p_brand", "p_type")


@query("SELECT k, user_id, score FROM (SELECT user_id AS k, user_id, score, row_number() OVER (ORDER BY score DESC, user_id) AS i FROM scored) WHERE i <= greatest(20, (SELECT count(*) FROM scored WHERE score >= 90))", scored="SELECT user_id, max(floor(value)) AS score FROM events GROUP BY user_id")
def o4_urgent_top(scored: DataFrame) -> DataFrame:
    return selection.urgent_top(scored, "score", "user_id", 20, 90).select(F.col("user_id").alias("k"), "user_id", "score")


@query("SELECT o_custkey, count(*) FILTER (WHERE s = 'O') AS n_O, count(*) FILTER (WHERE s = 'F') AS n_F, count(*) FILTER (WHERE s = 'P') AS n_P, count(*) AS n FROM o GROUP BY o_custkey", o="SELECT o_custkey, o_orderstatus AS s FROM orders")
def a1_status_counts(o: DataFrame) -> DataFrame:
    return statistics.status_counts(o, ["o_custkey"], "s", ["O", "F", "P"])


LOG = "SELECT concat('d', l_partkey) AS identity, concat('s', l_suppkey) AS signer, CASE WHEN l_linenumber % 3 > 0 THEN concat(CASE WHEN l_linenumber % 2 = 0 THEN 'Name' ELSE 'NAME' END, CAST(floor(l_partkey / 2) AS BIGINT)) ELSE ' ' END AS label, l_orderkey * 10 + l_linenumber AS seq, l_quantity > 5 AS valid FROM lineitem"


@query(
    """WITH good AS (SELECT * FROM log WHERE valid), lab AS (SELECT lower(label) AS l FROM good WHERE trim(label) <> '' GROUP BY 1 HAVING count(DISTINCT identity) > 1)
 SELECT identity, count(DISTINCT signer) AS signers, least(count(DISTINCT signer), 3) AS level, arg_min(label, seq) FILTER (WHERE trim(label) <> '') AS label,
        coalesce(bool_or(trim(label) <> '' AND lower(label) IN (SELECT l FROM lab)), false) AS disputed FROM good GROUP BY identity""",
    log=LOG,
)
def a2_consensus_tally(log: DataFrame) -> DataFrame:
    return statistics.consensus_tally(log)


@query(
    """WITH n AS (SELECT p, s, count(DISTINCT o) AS n FROM sub GROUP BY p, s)
 SELECT p, s, n AS submitters, k > 1 AS disputed FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, s) AS i, count(*) OVER (PARTITION BY p) AS k FROM n) WHERE i = 1""",
    sub="SELECT l_partkey AS p, l_shipmode AS s, l_orderkey AS o FROM (SELECT l_partkey, l_returnflag AS l_shipmode, l_orderkey FROM lineitem)",
)
def a3_leading_output(sub: DataFrame) -> DataFrame:
    return statistics.leading_output(sub, "p", "s", "o")


@query(
    """WITH n AS (SELECT k, v, count(*) AS n, min(o) AS o FROM reads GROUP BY k, v)
 SELECT k, v, n AS votes, n / t AS agreement FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, o) AS i, sum(n) OVER (PARTITION BY k) AS t FROM n) WHERE i = 1""",
    reads="SELECT l_partkey AS k, l_returnflag AS v, l_orderkey * 10 + l_linenumber AS o FROM lineitem",
)
def a10_plurality(reads: DataFrame) -> DataFrame:
    return statistics.plurality(reads, ["k"], "v", "o")


HOLES = "SELECT o_custkey % 20 AS title, o_custkey AS copy, o_orderkey % 15 AS place FROM orders WHERE o_orderkey % 3 > 0"
COPIES = "SELECT c_custkey % 20 AS title, c_custkey AS copy FROM customer"


@query(
    """WITH h AS (SELECT DISTINCT * FROM holes), n AS (SELECT title, count(DISTINCT copy) AS copies FROM copies GROUP BY title),
 k AS (SELECT c.title, c.copy, count(h.place) AS k FROM (SELECT DISTINCT * FROM copies) c LEFT JOIN h ON h.title = c.title AND h.copy = c.copy GROUP BY ALL),
 u AS (SELECT title, count(*) AS u FROM (SELECT h.title, place, count(*) AS m FROM h GROUP BY ALL) JOIN n USING (title) WHERE m = copies GROUP BY title)
 SELECT n.title, copies, min(k) AS fewest, coalesce(max(u), 0) AS unrecoverable, min(k) - coalesce(max(u), 0) AS recovered FROM n JOIN k USING (title) LEFT JOIN u USING (title) GROUP BY n.title, copies""",
    holes=HOLES,
    copies=COPIES,
)
def a11_common_holes(holes: DataFrame, copies: DataFrame) -> DataFrame:
    return statistics.common_holes(holes, copies, "title", "copy", "place")


@query(
    """SELECT source, sum(c)::BIGINT AS chunks, count(*) AS unique_chunks, sum(c * l)::BIGINT AS bytes, sum(l)::BIGINT AS unique_bytes, sum(c * l) / sum(l) AS ratio
       FROM (SELECT source, h, count(*) AS c, max(l) AS l FROM chunks GROUP BY ALL) GROUP BY source""",
    chunks="SELECT source, md5(text) AS h, length(text) AS l FROM documents",
)
def a12_dedup_account(chunks: DataFrame) -> DataFrame:
    return statistics.dedup_account(chunks, "source", "h", "l")


@query("SELECT k, CASE WHEN max(s) >= 2 THEN 'bad' WHEN max(s) = 1 THEN 'suspect' ELSE 'good' END AS verdict FROM checks GROUP BY k", checks="SELECT l_orderkey AS k, CASE WHEN l_quantity > 48 THEN 2 WHEN l_discount > 0.08 THEN 1 ELSE 0 END AS s FROM lineitem")
def a21_folded_verdict(checks: DataFrame) -> DataFrame:
    return statistics.folded_verdict(checks, "k", "s")


SETS = "SELECT l_suppkey AS k, l_partkey AS e FROM lineitem"
PAIRS = """WITH s AS (SELECT DISTINCT k, e FROM sets), n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
 c AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM s x JOIN s y ON x.e = y.e AND x.k < y.k GROUP BY ALL)"""


@query(f"{PAIRS} SELECT a, b, c / (p.n + q.n - c) AS similarity FROM c JOIN n p ON p.k = a JOIN n q ON q.k = b WHERE c / (p.n + q.n - c) >= 0.05", sets=SETS)
def j8_jaccard_pairs(sets: DataFrame) -> DataFrame:
    return similarity.similar_pairs(sets, "k", "e", 0.05)


@query(f"{PAIRS} SELECT a, b, c / least(p.n, q.n) AS similarity FROM c JOIN n p ON p.k = a JOIN n q ON q.k = b WHERE c / least(p.n, q.n) >= 0.1", sets=SETS)
def u3_overlap_pairs(sets: DataFrame) -> DataFrame:
    return similarity.similar_pairs(sets, "k", "e", 0.1, similarity.overlap())


LINKS = "SELECT DISTINCT o_custkey AS a, o_custkey + 1 + o_orderkey % 3 AS b FROM orders"
REACH = """WITH two AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT k AS s, k AS t FROM nodes UNION SELECT s, b FROM reach JOIN two ON t = a) SELECT s AS k, min(t) AS "group" FROM reach GROUP BY s"""


@query(REACH, links=LINKS, nodes="SELECT c_custkey AS k FROM customer UNION SELECT c_custkey + 3 FROM customer")
def g2_groups(links: DataFrame, nodes: DataFrame) -> DataFrame:
    return similarity.groups(links, nodes, "k")


@query(
    "SELECT e, m.r FROM (SELECT e, r, count(*) AS c FROM (SELECT DISTINCT e, f FROM facts) JOIN (SELECT DISTINCT r, f FROM needs) USING (f) GROUP BY e, r) m JOIN (SELECT r, count(DISTINCT f) AS k FROM needs GROUP BY r) n ON m.r = n.r AND c = k",
    facts="SELECT l_orderkey AS e, l_linenumber AS f FROM lineitem",
    needs="SELECT 'a' AS r, 1 AS f UNION ALL SELECT 'a', 4 UNION ALL SELECT 'b', 7",
)
def v3_rule_division(facts: DataFrame, needs: DataFrame) -> DataFrame:
    return matching.rule_division(facts, needs, "e", "f", "r")


@query(
    "SELECT m.path, f.path IS NOT NULL AS found, CASE WHEN f.path IS NOT NULL THEN m.sha256 IS NOT DISTINCT FROM f.sha256 END AS matches FROM older m LEFT JOIN newer f ON m.path = f.path",
    older=OLD,
    newer=NEW,
)
def v11_manifest_check(older: DataFrame, newer: DataFrame) -> DataFrame:
    return matching.manifest_check(older, newer)
