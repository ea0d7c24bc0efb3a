import pytest
from loomwork.functions import patches
from loomwork.sinks import exports
from loomwork.sources import formats
from pyspark.sql import functions as F


def put(folder, **texts):
    for name, text in texts.items():
        (folder / name.replace("__", ".")).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_files(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    put(tmp_path / ".git", x__txt="no")
    path = put(tmp_path, a__bin=b"abc", b__bin=b"", skip__me="x")
    got = {r.file_name: r for r in formats.files(spark, path, ("skip.me",)).collect()}
    assert set(got) == {"a.bin", "b.bin"} and (got["b.bin"].length, got["b.bin"].md5) == (0, "d41d8cd98f00b204e9800998ecf8427e")
    assert got["a.bin"].crc32 == "352441c2" and got["a.bin"].md5 == "900150983cd24fb0d6963f7d28e17f72"
    heads = {r.file_name: r.md5 for r in formats.head_digest(spark, path, 2).collect()}
    assert heads["a.bin"] == "187ef4436122d1cc2f40dc2b92f0eba0"


XML = """<?xml version="1.0"?><datafile><header><name>set</name></header>
<game name="One" cloneof="" romof="Zero"><description>first</description><rom name="a.bin" size="3" crc=" ABCD0123 " md5="" sha1="FF"/><rom name="b.bin" size="x" crc="1"/></game>
<machine name="Two" cloneof="One"><rom name="c.bin" size="4" crc="2"/></machine><game name="Empty"/></datafile>"""


def test_catalog_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got = formats.catalog(spark, put(tmp_path / "in", set__xml=XML))
    want = [("One", "a.bin", 3, "abcd0123", None, "ff", "Zero"), ("One", "b.bin", 0, "1", None, None, "Zero"), ("Two", "c.bin", 4, "2", None, None, "One")]
    columns = ("game", "name", "size", "crc", "md5", "sha1", "clone_of")
    assert sorted(rows(got, *columns)) == want
    exports.catalog_xml(got, f"{tmp_path}/out")
    assert sorted(rows(formats.catalog(spark, f"{tmp_path}/out"), *columns)) == want


def test_checksums(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = "; comment\nmy file.bin  1234ABCD\r\n# other\n" + "0" * 31 + "F *x y.bin\nnonsense\n"
    assert sorted(rows(formats.checksums(spark, put(tmp_path / "in", s__sfv=text)), "name", "hash")) == [("my file.bin", "1234abcd"), ("x y.bin", "0" * 31 + "f")]
    exports.checksum_list(spark.createDataFrame([("n.bin", "AB" * 16)], "name string, h string"), f"{tmp_path}/out", "name", "h")
    assert rows(formats.checksums(spark, f"{tmp_path}/out"), "name", "hash") == [("n.bin", "ab" * 16)]


def test_rescue_map(spark, tmp_path):
    for name in ("in", "bad"):
        (tmp_path / name).mkdir()
    text = "# map\n0x0 ?\n0 512 +\n0x200 010 +  # more\n520 0x10 -\n"
    got = formats.rescue_map(spark, put(tmp_path / "in", m__map=text))
    assert sorted(rows(got, "pos", "size", "status")) == [(0, 520, "+"), (520, 16, "-")]
    exports.rescue_map(got.selectExpr("'m' AS map", "pos", "size", "status"), f"{tmp_path}/out")
    assert sorted(rows(formats.rescue_map(spark, f"{tmp_path}/out/map=m"), "pos", "size", "status")) == [(0, 520, "+"), (520, 16, "-")]
    with pytest.raises(Exception, match="gap"):
        formats.rescue_map(spark, put(tmp_path / "bad", m__map="0 ?\n0 5 +\n6 5 +\n")).collect()


def test_logs(spark, tmp_path):
    for name in ("scan", "bare", "sec", "agg", "speed", "cue", "json"):
        (tmp_path / name).mkdir()
    got = formats.scan_log(spark, put(tmp_path / "scan", a__csv="Tool: probe\nDisc: x\nposition;PIE;PIF\n0;1;2\n1;;3\n"))
    assert sorted(rows(got, "ord", "position", "pie", "pif", "c1", "family", "tool")) == [(0, 0.0, 1.0, 2.0, None, "dvd", "probe"), (1, 1.0, None, 3.0, None, "dvd", "probe")]
    assert rows(formats.scan_log(spark, put(tmp_path / "bare", a__txt="0 5 1 0\n")), "position", "c1", "c2", "cu", "family") == [(0.0, 5.0, 1.0, 0.0, "cd")]
    assert rows(formats.second_log(spark, put(tmp_path / "sec", a__csv="0,1,2,3,4,5,6\n")), "second", "bler", "e32") == [(0, 6.0, 6.0)]
    assert rows(formats.second_log(spark, put(tmp_path / "agg", a__csv="second,bler\n7,9\n")), "second", "bler", "e32") == [(7, 9.0, None)]
    assert sorted(rows(formats.speed_log(spark, put(tmp_path / "speed", a__csv="lba,time\n0,0.5\n1,0\n")), "lba", "speed")) == [(0, 2.0), (1, 0.0)]
    cue = 'FILE "a b.bin" BINARY\n  TRACK 01 MODE1/2352\n    INDEX 01 00:00:00\n  TRACK 02 AUDIO\n    INDEX 00 00:02:00\n    INDEX 01 00:04:10\n'
    assert sorted(rows(formats.cue_sheet(spark, put(tmp_path / "cue", a__cue=cue)), "file", "track", "mode", "index", "sector")) == [("a b.bin", 1, "MODE1/2352", 1, 0), ("a b.bin", 2, "AUDIO", 0, 150), ("a b.bin", 2, "AUDIO", 1, 310)]
    got = formats.documents(spark, put(tmp_path / "json", a__json='{"id": "x",\n "log": [{"seq": 0}, {"seq": 1}]}'), "id string, log array<struct<seq: long>>", "log")
    assert sorted(rows(got, "seq")) == [(0,), (1,)]


def test_dump_logs_and_layouts(spark, tmp_path):
    for name in ("log", "gdi", "ccd", "bin"):
        (tmp_path / name).mkdir()
    rom = '<rom name="t1.bin" size="7" crc="AB" md5="CD" sha1="EF" />'
    path = put(tmp_path / "log", a__txt=f"Disc Type: CD-ROM\nspeed:  8x\nDisc type: other\nread error at LBA: 55\nERROR, LBA 7 x\nerror LBA 55\n{rom}\n{rom.replace('7', '8')}\n")
    assert rows(formats.dump_log(spark, path), "ord", "name", "size", "crc", "md5", "sha1") == [(0, "t1.bin", 7, "ab", "cd", "ef")]
    fields = dict(rows(formats.log_fields(spark, path), "field", "value"))
    assert fields["disc type"] == "CD-ROM" and fields["speed"] == "8x"
    assert rows(formats.error_addresses(spark, path), "lba") == [(7,), (55,)]
    assert rows(formats.gdi(spark, put(tmp_path / "gdi", d__gdi='2\n1 0 4 2352 "t 1.bin" 0\n2 600 0 2352 t2.raw 0\n')), "track", "start", "is_data", "file") == [(1, 0, True, "t 1.bin"), (2, 600, False, "t2.raw")]
    assert rows(formats.sections(spark, put(tmp_path / "ccd", d__ccd="[Disc]\nEntries = 3\n; no\n[Entry 0]\nPoint=0xa0\n")), "section", "name", "value") == [("Disc", "Entries", "3"), ("Entry 0", "Point", "0xa0")]
    record = bytes([2]) + bytes.fromhex("010000000200000003000000") + bytes([9]) + (70000).to_bytes(4, "little") + bytes(4) + bytes([1]) + bytes([5, 0, 0, 0, 6, 0, 0, 0])
    got = formats.checksum_records(spark, put(tmp_path / "bin", d__bin=record + bytes(5)))
    assert rows(got, "ord", "id1", "cddb", "track", "confidence", "crc", "crc2") == [(0, "00000001", "00000003", 1, 9, 70000, 0), (0, "00000001", "00000003", 2, 1, 5, 6)]
    for k, bad in enumerate((record + record[:-1], bytes([0]) + record[1:], bytes([100]) + bytes(1000))):
        (tmp_path / f"bad{k}").mkdir()
        with pytest.raises(Exception, match="cut off|tracks at byte"):
            formats.checksum_records(spark, put(tmp_path / f"bad{k}", d__bin=bad)).collect()


def test_manifests(spark, tmp_path):
    for name in ("good", "bad"):
        (tmp_path / name).mkdir()
    got = formats.source_manifest(spark, put(tmp_path / "good", m__txt="# c\n\na\\b c\t/x y\nd  HTTP://h/z\n"))
    assert sorted(rows(got, "target", "place", "is_url")) == [("a/b c", "/x y", False), ("d", "HTTP://h/z", True)]
    with pytest.raises(Exception, match="line 2"):
        formats.source_manifest(spark, put(tmp_path / "bad", m__txt="# c\na b\n")).collect()
    entries = spark.createDataFrame([("t", "/d/", False), ("u", "/d/a", False), ("v", "/e", False)], "target string, place string, is_url boolean")
    there = spark.createDataFrame([("/d/a", 1), ("/d/s/b", 2), ("/dx", 3)], "path string, length long")
    assert sorted(rows(formats.staged(entries, there), "target", "length", "failure"), key=str) == [("t/a", 1, None), ("t/s/b", 2, None), ("u", 1, None), ("v", None, "not found")]


def test_files_are_put_whole_and_older_ones_kept(spark, tmp_path):
    df = spark.createDataFrame([("x/a.map", bytearray(b"one")), ("b", None)], "name string, content binary")
    exports.put(df, str(tmp_path)).collect()
    exports.put(df.filter("name = 'x/a.map'").withColumn("content", F.lit(b"two")), str(tmp_path)).collect()
    assert {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")} == {"x/a.map": b"two", "x/a.map.bak": b"one", "b": b""}


def test_patches():
    import random

    rnd = random.Random(3)
    for _ in range(200):
        a = bytes(rnd.choice(b"abc\0") for _ in range(rnd.randint(0, 300)))
        b = bytearray(a)
        for _ in range(rnd.randint(0, 5)):
            i = rnd.randint(0, len(b))
            b[i : i + rnd.randint(0, 30)] = bytes([rnd.choice(b"xyz")]) * rnd.randint(0, 40) if rnd.random() < 0.5 else bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 30)))
        assert patches.ips_apply(a, patches.ips_make(a, bytes(b))) == patches.bps_apply(a, patches.bps_make(a, bytes(b))) == b
    base = bytes(0x454F46) + b"aaa"  # the place of the change reads EOF
    assert patches.ips_apply(base, patches.ips_make(base, base[:-3] + b"bbb")) == base[:-3] + b"bbb"
    assert patches.ips_apply(b"abc", b"PATCH\0\0\5\0\0\0\3xEOF") == b"abc\0\0xxx"
    for bad in (b"PATCH", b"PATCH\0\0\0\0\5abEOF", b"no"):
        with pytest.raises(ValueError):
            patches.ips_apply(b"abc", bad)
    good = patches.bps_make(b"abc", b"abd")
    for base, bad in ((b"abx", good), (b"abc", good[:-1] + b"x"), (b"abc", b"BPS1")):
        with pytest.raises(ValueError):
            patches.bps_apply(base, bad)


def test_kinds(spark):
    df = spark.createDataFrame([(bytearray(b"PK\x03\x04x"),), (bytearray(b"RIFF0000WAVE"),), (bytearray(b""),), (None,)], "content binary")
    assert [r[0] for r in df.select(formats.kind_of("content")).collect()] == ["zip", "wav", "unknown", "unknown"]


def test_csv_and_plans(spark, tmp_path):
    exports.catalog_csv(spark.createDataFrame([("a,b", 1, None), ('q"x', 2, "z")], "name string, n int, note string").coalesce(1), f"{tmp_path}/csv", ["name", "n", "note"])
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_text() == 'name,n,note\n"a,b",1,\n"q""x",2,z\n'
    files = spark.createDataFrame([("d/a", "x"), ("d/b", "x"), ("d/x2", "x2"), ("d/y", None), ("e/q", "r"), ("e/r", "r")], "path string, wanted string")
    assert sorted(rows(exports.rename_plan(files), "path", "new_path", "clash")) == [("d/a", "d/x", False), ("d/b", "d/x", True), ("e/q", "e/r", True)]
    found = spark.createDataFrame([("g1/n", "s", "g1", "n"), ("z", "s", "g1", "n"), ("w", "s", None, "n")], "path string, system string, game string, name string")
    assert rows(exports.rebuild_plan(found), "path", "target", "in_place") == [("g1/n", "g1/n", True)]
    exports.playlist(spark.createDataFrame([("g", "b", 2), ("g", "a", 1)], "g string, p string, o int"), f"{tmp_path}/m3u", "g", "p", "o")
    assert spark.read.text(f"{tmp_path}/m3u").select("value").collect()[0][0] == "a"
    exports.catalog_json(spark.createDataFrame([("a\\b", None)], "path string, sha1 string"), f"{tmp_path}/json")
    assert spark.read.text(f"{tmp_path}/json").collect()[0][0] == '{"path":"a/b"}'
