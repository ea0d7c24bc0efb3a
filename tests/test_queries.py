"""Each registered query against its SQL in DuckDB on the smallest tables, and operators on empty and odd rows."""

import os

import duckdb
import pytest
from loomwork.plans import registry
from pyspark.sql import functions as F

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in registry.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 7)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR)
    want = duck.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    own = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    theirs = sorted(repr([plain(r[want.columns.index(c)]) for c in columns]) for r in want.fetchall())
    assert own == theirs


def test_entry_points():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_tiers(spark):
    from loomwork.operators import matching

    files = spark.createDataFrame([(1, 5, "AA", "m1", "c1"), (2, 5, "zz", "m1", "c1"), (3, 5, None, "M1 ", "c9"), (4, 6, "bb", None, "c1"), (5, 6, None, None, "c1"), (6, 9, "aa", None, None), (7, 1, "", "", "")], "file_id long, size long, sha1 string, md5 string, crc string")
    catalog = spark.createDataFrame([(1, "e1", 5, "aa", "m1", "c1"), (2, "any", 0, "bb", None, "c1"), (3, "dup", 5, "aa", "m1", "c1"), (4, "blank", 1, "", "", "")], "ord long, entry string, size long, sha1 string, md5 string, crc string")
    got = {r.file_id: (r.evidence, r.entry) for r in matching.tiered_match(files, catalog).collect()}
    assert got == {1: ("sha1", "e1"), 2: ("crc_conflict", "e1"), 3: ("md5", "e1"), 4: ("sha1", "any"), 5: ("crc", "any"), 6: ("none", None), 7: ("none", None)}
    assert matching.tiered_match(files.limit(0), catalog).count() == 0
    assert {r.evidence for r in matching.tiered_match(files, catalog.limit(0)).collect()} == {"none"}


def test_missing_blob_fails(spark):
    from loomwork.operators import matching

    with pytest.raises(Exception, match="no blob for x"):
        matching.resolve_blobs(spark.createDataFrame([("x",)], "sha string"), spark.createDataFrame([("y", 1)], "sha string, n int")).collect()


def test_sketches_merge_in_any_order(spark):
    from loomwork.operators import statistics

    rows = spark.createDataFrame([("c", i % 5, float(i * i % 13), 1.0 + i % 3) for i in range(60)] + [("c", 0, None, 1.0), ("c", 0, 3.0, 0.0)], "g string, p int, x double, w double")
    whole = statistics.sketch(rows, ["g"], "x", "w").first()
    parts = statistics.sketch(rows, ["g", "p"], "x", "w")
    once = statistics.merge_sketches(parts, ["g"]).first()
    halves = statistics.merge_sketches(parts.withColumn("h", F.col("p") % 2), ["g", "h"])
    twice = statistics.merge_sketches(halves, ["g"]).first()
    for c in ("n", "w", "mean", "m2"):
        assert whole[c] == pytest.approx(once[c]) == pytest.approx(twice[c])


def test_growth_fit_finds_a_planted_rate(spark):
    import math
    from datetime import datetime, timedelta

    from loomwork.operators import statistics

    start = datetime(2020, 1, 1)
    rows = [("a", start + timedelta(days=100 * i), 10 * math.exp(0.5 * 100 * i / 365.25)) for i in range(8)] + [("flat", start + timedelta(days=i), 5.0) for i in range(4)] + [("one", start, 3.0)]
    got = {r.g: r for r in statistics.growth_fit(spark.createDataFrame(rows, "g string, t timestamp, e double"), "g", "t", "e", 220).collect()}
    assert got["a"].slope == pytest.approx(0.5) and got["a"].r2 == pytest.approx(1) and got["a"].years_left == pytest.approx(math.log(22) / 0.5 - 700 / 365.25)
    assert got["flat"].slope == pytest.approx(0, abs=1e-9)
    assert (got["one"].n, got["one"].slope, got["one"].slope_se, got["one"].years_left) == (1, 0, None, None)


def test_votes(spark):
    from loomwork.operators import statistics

    reads = spark.createDataFrame([(1, 0, bytearray(b"abcd")), (1, 1, bytearray(b"abXd")), (1, 2, bytearray(b"aYXde")), (2, 0, bytearray(b"pq")), (2, 1, bytearray(b"rs"))], "k int, o int, v binary")
    got = {r.k: bytes(r.v) for r in statistics.byte_vote(reads, ["k"], "v", "o").collect()}
    assert got == {1: b"abXde", 2: b"pq"}


def test_groups_and_cohesion(spark):
    from loomwork.operators import similarity

    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.6), ("x", "y", 0.8)], "a string, b string, similarity double")
    nodes = spark.createDataFrame([(n,) for n in "abcxyz"], "k string")
    members = similarity.groups(pairs, nodes, "k")
    assert {r.k: r.group for r in members.collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    assert {r.group: (r.members, r.cohesion) for r in similarity.cohesion(members, pairs, "k").collect()} == {"a": (3, 0.0), "x": (2, 0.8), "z": (1, 1.0)}
    assert similarity.groups(pairs.limit(0), nodes.limit(0), "k").count() == 0


def test_vectors(spark):
    from loomwork.operators import similarity

    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0, 9.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0, 3.0], [3.0, 2.0, 1.0])], "x array<double>, y array<double>")
    assert [round(r[0], 9) for r in df.select(similarity.cosine("x", "y")).collect()] == [1.0, 0.0, round(10 / 14, 9)]
    assert [round(r[0], 9) for r in df.limit(3).filter("size(x) = size(y)").select(similarity.pearson("x", "y")).collect()] == [0.0, -1.0]


def test_trees_and_bins(spark):
    from loomwork.operators import similarity

    pairs = spark.createDataFrame([(1, "a", "b", 0.2), (1, "a", "c", 0.6), (1, "b", "c", 0.4)], "g int, a string, b string, distance double")
    merges = similarity.upgma(pairs, "g").toPandas()
    assert merges[["left", "right", "leaves"]].values.tolist() == [["a", "b", 2], ["a", "c", 3]] and merges["height"].tolist() == pytest.approx([0.1, 0.25])
    assert similarity.newick(merges) == "((a:0.1,b:0.1):0.15,c:0.25);"
    items = spark.createDataFrame([("g", "a", 6), ("g", "b", 5), ("g", "c", 4), ("g", "d", 5), ("g", "e", 11)], "g string, k string, n int")
    assert {r.item: r.bin for r in similarity.first_fit(items, "g", "k", "n", 10).collect()} == {"a": 1, "c": 1, "b": 2, "d": 2, "e": None}


def test_runs_on_odd_rows(spark):
    from loomwork.operators import runs

    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 4), ("a", None), (None, 7)], "g string, v int")
    assert sorted((str(r.g), r["first"], r["last"], r.length) for r in runs.islands(rows, "g", "v").collect()) == [("None", 7, 7, 1), ("a", 1, 2, 2), ("a", 4, 4, 1)]
    assert runs.islands(rows.limit(0), "g", "v").count() == 0 and runs.gap_clusters(rows.limit(0), "g", "v", 3).count() == 0
    assert runs.modal_gap(rows.filter("v = 1"), "g", "v").count() == 0


def test_kernels(spark):
    import random

    from loomwork.functions import kernels

    assert kernels.crc16(b"123456789") == 0x31C3 and kernels.crc64(b"123456789") == 0x995DC9BBDF1939FA
    rnd = random.Random(1)
    data = bytes(rnd.randrange(256) for _ in range(200_000))
    cutter = kernels.Chunker()
    ends = cutter.cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and all(2048 <= s <= 65536 for s in sizes[:-1]) and 4000 < sum(sizes) / len(sizes) < 20_000
    changed = data[:100] + b"!" + data[100:]
    own, other = ({changed[a:b] for a, b in zip([0, *e], e)} if x is changed else {data[a:b] for a, b in zip([0, *e], e)} for x in (data, changed) for e in [cutter.cuts(x)])
    assert len(own & other) >= len(own) - 2
    leaves = [bytes([i]) * 3 for i in range(7)]
    root = kernels.merkle_root(leaves)
    assert all(kernels.merkle_verify(x, kernels.merkle_proof(leaves, i), root) for i, x in enumerate(leaves))
    assert not kernels.merkle_verify(b"no", kernels.merkle_proof(leaves, 3), root)
    rows = spark.createDataFrame([("f", i, x.hex()) for i, x in enumerate(leaves)] + [("g", 0, "00")], "f string, i int, h string")
    assert {r.f: r.root for r in kernels.merkle_roots(rows, "f", "i", "h").collect()} == {"f": root.hex(), "g": kernels.merkle_root([b"\0"]).hex()}
    texts = [b"", b"\0" * 500, b"a" * 100, *(bytes(rnd.choice(b"abcdef \0") for _ in range(rnd.choice([5, 190, 193, 400, 3000]))) + rnd.choice([b"", b"\0" * 7]) for _ in range(60))]
    assert kernels.fuzzy_hashes(texts) == [plain_fuzzy_hash(t) for t in texts]
    assert kernels.fuzzy_score("3:abcdefgh:xyz", "3:abcdefgh:other") == 100
    a, b, c = (kernels.fuzzy_hash(x) for x in (data[:9000], data[:9000] + b"tail", bytes(rnd.randrange(256) for _ in range(9000))))
    assert kernels.fuzzy_score(a, a) == 100 and kernels.fuzzy_score(a, b) > 80 and kernels.fuzzy_score(a, c) == 0
    assert kernels.find_all(b"aaaa", b"aa") == [0, 1, 2] and kernels.find_all(b"aa", b"") == []
    assert kernels.byte_entropy(bytes(range(256))) == 8.0 and kernels.byte_entropy(b"") == 0.0


def test_chunks_by_the_plain_rule():
    import random

    from loomwork.functions import kernels

    rnd = random.Random(4)
    assert [int(n) for n in kernels.gear(0)[:3]] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]  # the generator's published first numbers from 0

    def plain(c, data):
        out, at = [], 0
        while at < len(data):
            d = data[at : at + c.most]
            end, h = len(d), 0
            for i in range(c.least, len(d) if len(data) - at > c.least else 0):
                h = (2 * h + int(c.gear[d[i]])) % (1 << 64)
                if not h & int(c.strict if i < min(c.average, len(d)) else c.loose):
                    end = i
                    break
            at += end
            out.append(at)
        return out

    for k in range(40):
        c = kernels.Chunker(*rnd.choice([(128, 512, 2048), (16, 64, 200), (2048, 8192, 65536)]))
        data = bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 5, 16, 17, 129, 3000, 20000])))
        assert c.cuts(data) == plain(c, data)


def test_trees_and_bins_by_plain_rules():
    import random

    import pandas as pd
    from loomwork.operators import similarity

    rnd = random.Random(5)
    for _ in range(30):
        names = [f"n{i}" for i in range(rnd.randint(2, 9))]
        d = {(a, b): rnd.choice([0.1, 0.25, 0.5, 0.75]) for i, a in enumerate(names) for b in names[i + 1 :] if rnd.random() < 0.6}
        got = similarity._upgma(pd.DataFrame([(a, b, x) for (a, b), x in d.items()], columns=["a", "b", "distance"]))
        members, want = {n: [n] for n in {x for p in d for x in p}}, []
        while len(members) > 1:
            far = lambda a, b: sum(d.get((min(x, y), max(x, y)), 1.0) for x in members[a] for y in members[b]) / len(members[a]) / len(members[b])
            h, a, b = min((round(far(a, b), 9), a, b) for a in members for b in members if a < b)
            members[a] += members.pop(b)
            want.append((a, b, h / 2, len(members[a])))
        assert [(r.left, r.right, r.leaves) for r in got.itertuples()] == [(a, b, n) for a, b, _, n in want]
        assert got["height"].tolist() == pytest.approx([h for _, _, h, _ in want], abs=1e-8)
        items = pd.DataFrame([(f"i{k}", rnd.randint(1, 120)) for k in range(rnd.randint(1, 40))], columns=["item", "size"])
        free, bins = [], {}
        for item, size in sorted(items.itertuples(index=False), key=lambda x: (-x[1], x[0])):
            k = next((i for i, f in enumerate(free) if f >= size + 3), len(free)) if size + 3 <= 100 else None
            if k is not None:
                free += [100] * (k == len(free))
                free[k] -= size + 3
            bins[item] = None if k is None else k + 1
        assert {r.item: None if pd.isna(r.bin) else r.bin for r in similarity._packed(100, 3)(items).itertuples()} == bins


def plain_fuzzy_hash(data):
    """The published rule, a byte at a time."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    size = 3
    while size * 64 < len(data):
        size *= 2
    while True:
        first, second, spare1, spare2, ring, roll = "", "", "", "", [0] * 7, 0
        h1 = h2 = 0x28021967
        plain = placed = shifted = 0
        for i, c in enumerate(data):
            h1, h2 = (h1 * 0x01000193 & 0xFFFFFFFF) ^ c, (h2 * 0x01000193 & 0xFFFFFFFF) ^ c
            placed = placed - plain + 7 * c & 0xFFFFFFFF
            plain = plain + c - ring[i % 7] & 0xFFFFFFFF
            ring[i % 7], shifted = c, (shifted << 5 & 0xFFFFFFFF) ^ c
            roll = plain + placed + shifted & 0xFFFFFFFF
            if roll % size == size - 1:
                spare1 = letters[h1 % 64]
                if len(first) < 63:
                    first, h1, spare1 = first + spare1, 0x28021967, ""
                if roll % (2 * size) == 2 * size - 1:
                    spare2 = letters[h2 % 64]
                    if len(second) < 31:
                        second, h2, spare2 = second + spare2, 0x28021967, ""
        if size > 3 and len(first) < 32:
            size //= 2
            continue
        return f"{size}:{first + (letters[h1 % 64] if roll else spare1)}:{second + (letters[h2 % 64] if roll else spare2)}"


def test_scalar_functions(spark):
    from loomwork.functions import text

    df = spark.createDataFrame([("00:02:10", "1234567890123", "US-ABC-12-34567", "IFPI L123 x"), ("bad", "1", None, "none")], "m string, mcn string, isrc string, sid string")
    got = df.select(text.msf_sectors(F.col("m")), text.valid_mcn(F.col("mcn")), text.valid_isrc(F.col("isrc")), text.sid_code(F.col("sid"))).collect()
    assert [tuple(r) for r in got] == [(160, True, True, "L123"), (None, False, False, None)]
    name = spark.createDataFrame([("A Game (Disc 1 of 2) (v1.25) (Rev AB) (En,xx)",), (None,), ("",), ("Plain",), ("B(x)C  (hong kong, usa,) (en , DE) (Rev 99999999999) (v1.2.3)",)], "n string")
    first = name.select(text.parsed_name(F.col("n")).alias("p")).collect()[0].p
    assert (first.title, first.disc, first.revision, first.regions, first.languages) == ("A Game", 0, 1, [], [])
    last = name.select(text.parsed_name(F.col("n")).alias("p")).collect()[-1].p
    assert (last.title, last.regions, last.languages, last.revision) == ("BC", ["Hong Kong", "USA"], ["EN", "DE"], 0)
    assert df.select(text.arrhenius(F.lit(25.0))).first()[0] == pytest.approx(1)


def test_streams(spark, tmp_path):
    from loomwork.operators import matching
    from loomwork.streaming import windows

    rows = [(f"2024-01-01 0{h}:30:00", "x", float(h)) for h in range(6)]
    schema = "ts string, g string, v double"
    spark.createDataFrame(rows, schema).selectExpr("cast(ts as timestamp_ntz) AS ts", "g", "v").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp_ntz, g string, v double").parquet(f"{tmp_path}/in")
    out = windows.tumbling(stream, "ts", "2 hours", ["g"], "v")
    q = out.writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.total) for r in spark.table("hours").collect()) == [(2, 1.0), (2, 5.0), (2, 9.0)]
    assert windows.sessions(spark.read.parquet(f"{tmp_path}/in"), "ts", "2 hours", ["g"]).first().n == 6
    snaps = "path string, sha256 string, mtime long"
    seen = []
    for n, batch in enumerate(([("a", "1", 1), ("b", "2", 1)], [("a", "9", 1), ("c", "3", 2)])):
        spark.createDataFrame(batch, snaps).coalesce(1).write.mode("append").parquet(f"{tmp_path}/snap")
        q = windows.compare_snapshots(spark.readStream.schema(snaps).parquet(f"{tmp_path}/snap"), f"{tmp_path}/known", matching.drift, lambda df, k: seen.append({r.path: r.status for r in df.collect()}), f"{tmp_path}/sc")
        q.awaitTermination()
    assert seen == [{"a": "added", "b": "added"}, {"a": "rot_suspected", "b": "removed", "c": "added"}]


def test_no_rows_or_bytes_are_left_out(spark, tmp_path):
    """Rows that a filter by key, or a prefix, would leave out."""
    lines_ = [(5001, n, s, p) for n, (s, p) in enumerate([(1, 11), (1, 12), (2, 11), (2, 12)])]
    spark.createDataFrame(lines_, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(5001, 4), (5002, 5)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(4,), (5,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1,), (2,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, 0, "x" * 60)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert [(r.a, r.b, r.similarity) for name in ("j8_jaccard_pairs", "u3_overlap_pairs") for r in run(name)] == [(1, 2, 1.0)] * 2
    assert run("g3_upgma") and run("v1_track_set") and run("v2_layout")
    assert [r.voted for r in run("a9_byte_vote")] == ["78" * 60]
    assert {r.k: r.group for r in run("g2_groups")} == {4: 4, 5: 4, 7: 4, 8: 8}


def _sets(spark):
    import random

    rng = random.Random(3)
    rows = [(k, rng.randrange(60) if rng.random() < 0.8 else rng.randrange(3), rng.randrange(4)) for k in range(40) for _ in range(rng.randrange(1, 25))]
    rows += rows[:9] + [(None, 1, 1), (41, None, 2), (42, 7, None), (43, None, None)]
    of = lambda i: {k: {r[i] for r in rows if r[0] == k} - {None} for k in {r[0] for r in rows} - {None}}
    return spark.createDataFrame(rows, "k long, p long, c long"), of(1), of(2)


def _jaccard(x, y):
    return len(x & y) / len(x | y) if x & y else 0.0


def _both(p, c):
    keys = sorted(p)
    return {(a, b): 0.6 * _jaccard(p[a], p[b]) + 0.4 * _jaccard(c[a], c[b]) for a in keys for b in keys if a < b}


def test_pairs_are_counted_without_rows_of_elements(spark, monkeypatch):
    """Pairs of low similarities against all pairs in Python, in several blocks, with lists that most keys are in, nulls and repeats; and no join makes a row for each pair and element."""
    from loomwork.operators import incidence, similarity

    monkeypatch.setattr(incidence, "BLOCK_KEYS", 7)
    sets, p, _ = _sets(spark)
    found = similarity.similar_pairs(sets, "k", "p", 0.1)
    want = {(a, b): x for a in p for b in p if a < b and (x := _jaccard(p[a], p[b])) >= 0.1}
    assert {(r.a, r.b): r.similarity for r in found.collect()} == want and want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert similarity.similar_pairs(sets.limit(0), "k", "p", 0.1).count() == 0


def test_profile_pairs_by_all_pairs(spark, monkeypatch):
    from loomwork.operators import incidence, similarity

    monkeypatch.setattr(incidence, "BLOCK_KEYS", 7)
    sets, p, c = _sets(spark)
    texts, tomb = ["Tomb-Raider", "TOMBRAIDER 2", "Quake", "quiz", "", "tombola"], ("Tomb-Raider", "TOMBRAIDER 2", "tombola")
    titles = {k: texts[k % 6] for k in p if k != 42}
    related = {(x, y) for x in tomb for y in tomb} | {(x, x) for x in texts if x}
    want = {(a, b): min(1.0, x + 0.1 * ((titles.get(a), titles.get(b)) in related)) for (a, b), x in _both(p, c).items()}
    found = similarity.profile_pairs(sets, sets, "k", "p", "c", 0.5, names=spark.createDataFrame(list(titles.items()), "k long, name string"))
    got = {(r.a, r.b): r.similarity for r in found.collect()}
    assert got == pytest.approx({ab: x for ab, x in want.items() if x >= 0.5}) and got


def test_cohesion_compares_within_groups_only(spark):
    from loomwork.operators import similarity

    sets, p, c = _sets(spark)
    members = spark.createDataFrame([(k, k % 3) for k in p if k % 2], "k long, group long")
    got = {(r.a, r.b): r.similarity for r in similarity.profile_pairs(sets, sets, "k", "p", "c", 0.0, bonus=0.0, members=members).collect()}
    assert got == pytest.approx({(a, b): x for (a, b), x in _both(p, c).items() if a % 2 and b % 2 and a % 3 == b % 3 and x > 0}) and got


def test_jaccard_pairs_query_joins_no_elements(spark):
    assert "Join" not in registry.QUERIES["j8_jaccard_pairs"](spark, DIR)._jdf.queryExecution().executedPlan().toString()


def test_times_of_any_length_come_back(spark):
    from loomwork.functions import text

    df = spark.createDataFrame([(n,) for n in (0, 449_999, 450_000, 4_499_999, 4_500_000, 180_000_007)], "n long")
    assert all(r.n == r.back for r in df.select("n", text.msf_sectors(text.sectors_msf(F.col("n"))).alias("back")).collect())


def test_positions_do_not_depend_on_the_order_of_rows(spark):
    from loomwork.operators import matching

    rows = [(1, 5, v) for v in range(20)]
    side = lambda r: spark.createDataFrame(r, "g long, o long, v long").coalesce(1)
    got = matching.positional_diff(side(rows), side(rows[::-1]), "g", "o", "v").collect()
    assert len(got) == 20 and all(r.same for r in got)


def test_groups_of_keys_without_rows_of_both(spark):
    """Keys of most shared values against a count in Python, ties and hints too; and no join makes a row for each key and group, or for each key with a hint and group."""
    import random
    from collections import Counter

    from loomwork.operators import matching

    rng = random.Random(5)
    items = [(k, rng.randrange(30)) for k in range(50) for _ in range(rng.randrange(1, 6))] + [(99, 777), (98, None)]
    cat = [(f"Group {g}", rng.randrange(30)) for g in range(20) for _ in range(6)]
    frames = spark.createDataFrame(items, "k long, v long"), spark.createDataFrame(cat, "g string, v long")
    want = {}
    for k in range(50):
        shared = Counter(g for g, v in set(cat) if v in {b for a, b in items if a == k})
        if shared:
            want[k] = min((-n, g) for g, n in shared.items())
    found = matching.best_overlap(*frames, "k", "g", "v")
    assert {r.k: (-r.shared, r.g) for r in found.collect()} == want
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    hints = [(1, "GROUP 7"), (2, "p 1"), (3, "Up 12"), (4, "zzz"), (5, ""), (6, "R"), (7, "roup 1"), (8, "zzz"), (8, "group 3")]
    told = {1: "Group 7", 2: "Group 1", 3: "Group 12", 4: None, 6: "Group 0", 7: "Group 1", 8: "Group 3"}
    got = {r.k: r.g for r in matching.resolved(*frames, "k", "g", "v", spark.createDataFrame(hints, "k long, hint string")).collect()}
    assert got == {k: told.get(k, want[k][1] if k in want else None) if k not in told else told[k] for k in {a for a, _ in items}}
    assert matching.best_overlap(frames[0].limit(0), frames[1], "k", "g", "v").count() == matching.best_overlap(frames[0], frames[1].limit(0), "k", "g", "v").count() == 0
