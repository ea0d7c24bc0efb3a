"""Queries of sources and sinks: driver rows are written as the files that a format has, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patches
from ..functions.kernels import byte_function
from ..operators.lineage import shared_folder
from ..sinks import exports
from ..sources import formats, images
from .registry import query


def _folder(rows: DataFrame, what: str) -> str:
    return shared_folder(rows.sparkSession, what)


def _put(rows: DataFrame, what: str, name: Column, content: Column) -> str:
    """The folder that files of these names and texts were written to."""
    folder = _folder(rows, what)
    exports.put(rows.select(name.alias("name"), content.cast("binary").alias("content")), folder)
    return folder


def _joined(rows: DataFrame, group: str, order: list[str], line: Column, head: str = "", end: str = "\n") -> DataFrame:
    """g and text: the lines of each group in order, below a head."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_l")))), lambda x: x["_l"]), end)
    return rows.groupBy(F.col(group).alias("g")).agg(F.concat(F.lit(head), lines, F.lit(end)).alias("text"))


def _name(path: str = "path") -> Column:
    """The number that a file's name is."""
    return F.regexp_extract(path, r"(\d+)[^/]*$", 1).cast("long")


FILES = "SELECT p_partkey AS k, CASE WHEN p_partkey % 5 > 0 THEN repeat(p_name, p_size % 4) ELSE '' END AS t FROM part"


@query("SELECT k, length(t) AS length, md5(t) AS md5, sha1(t) AS sha1, sha256(t) AS sha256 FROM texts WHERE k % 7 > 0 AND k % 11 > 0", texts=FILES)
def s1_files(texts: DataFrame) -> DataFrame:
    name = F.concat(F.when(F.col("k") % 7 == 0, ".git/").otherwise("a b/"), F.col("k").cast("string"), F.when(F.col("k") % 11 == 0, "/Thumbs.db").otherwise(".bin"))
    out = formats.files(texts.sparkSession, _put(texts, "files", name, F.col("t")), ("Thumbs.db",))
    return out.select(_name().alias("k"), "length", "md5", "sha1", "sha256")


@query("SELECT k, length(t) AS length, md5(t[1:9]) AS md5 FROM texts", texts=FILES)
def s2_head_digest(texts: DataFrame) -> DataFrame:
    out = formats.head_digest(texts.sparkSession, _put(texts, "heads", F.concat(F.col("k").cast("string"), F.lit(".bin")), F.col("t")), 9)
    return out.select(_name().alias("k"), "length", "md5")


@query(
    """WITH e AS (SELECT s_suppkey AS s, CASE s_suppkey % 4 WHEN 0 THEN 'f/' || s_suppkey WHEN 1 THEN 'd' || s_suppkey % 10 WHEN 2 THEN 'gone' || s_suppkey ELSE 'https://x/' || s_suppkey END AS place FROM sup)
 SELECT 't' || s AS target, place, CASE WHEN s % 4 = 3 THEN -1 WHEN s % 4 = 0 THEN s * 10 END AS length, CASE WHEN s % 4 = 2 THEN 'not found' END AS failure FROM e WHERE s % 4 <> 1
 UNION ALL SELECT 't' || e.s || '/x/' || f.s_suppkey, 'd' || f.s_suppkey % 10 || '/x/' || f.s_suppkey, f.s_suppkey, NULL FROM e JOIN sup f ON e.s % 10 = f.s_suppkey % 10 WHERE e.s % 4 = 1""",
    sup="SELECT s_suppkey FROM supplier",
)
def s3_staged(sup: DataFrame) -> DataFrame:
    """Entries of a manifest against files: one for each number n at f/n, and one at dN/x/n with the last digit N of n."""
    s, n = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    digit = (s % 10).cast("string")
    place = F.when(s % 4 == 0, F.concat(F.lit("f/"), n)).when(s % 4 == 1, F.concat(F.lit("d"), digit, F.lit("/"))).when(s % 4 == 2, F.concat(F.lit("gone"), n)).otherwise(F.concat(F.lit("https://x/"), n))
    line = F.concat(F.lit("t"), n, F.when(s % 2 == 0, "\t").otherwise("   "), place)
    texts = _joined(sup.withColumn("g", s % 3), "g", ["s_suppkey"], line, "# made\n\n")
    entries = formats.source_manifest(sup.sparkSession, _put(texts, "manifest", F.concat(F.col("g").cast("string"), F.lit(".txt")), F.col("text")))
    there = sup.select(F.concat(F.lit("f/"), n).alias("path"), (s * 10).alias("length")).unionByName(sup.select(F.concat(F.lit("d"), digit, F.lit("/x/"), n).alias("path"), s.alias("length")))
    return formats.staged(entries, there)


ROMS = "SELECT concat('G', p_size) AS game, concat('Set ', p_size, ' & more') AS description, CASE WHEN p_size % 3 = 0 THEN concat('G', p_size - 1) END AS clone_of, concat(p_name, ' ', p_partkey) AS name, p_partkey * 7 AS size, lpad(CAST(p_partkey AS STRING), 8, '0') AS crc, md5(p_name) AS md5, CASE WHEN p_partkey % 4 > 0 THEN md5(p_type) END AS sha1 FROM part"


@query("SELECT game, description, clone_of, name, size, crc, md5, sha1 FROM roms", roms=ROMS)
def s4_catalog_xml(roms: DataFrame) -> DataFrame:
    folder = _folder(roms, "xml")
    exports.catalog_xml(roms.withColumn("size", F.col("size").cast("string")), folder)
    return formats.catalog(roms.sparkSession, folder).select("game", "description", "clone_of", "name", "size", "crc", "md5", "sha1")


@query("SELECT name, CASE WHEN k % 2 = 0 THEN lpad(CAST(k AS VARCHAR), 8, '0') ELSE md5(name) END AS hash FROM rows", rows="SELECT p_partkey AS k, concat(p_name, ' ', p_partkey) AS name FROM part")
def k4_checksum_lists(rows: DataFrame) -> DataFrame:
    short, long_ = _folder(rows, "sfv"), _folder(rows, "md5")
    exports.checksum_list(rows.filter("k % 2 = 0").withColumn("h", F.lpad(F.col("k").cast("string"), 8, "0")), short, "name", "h", short=True)
    exports.checksum_list(rows.filter("k % 2 = 1").withColumn("h", F.md5("name")), long_, "name", "h")
    read = lambda folder: formats.checksums(rows.sparkSession, folder).select("name", "hash")
    return read(short).unionByName(read(long_))


@query("SELECT k, n, note FROM rows", rows="SELECT p_partkey AS k, concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN ', \"x\"' ELSE '' END) AS n, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS note FROM part")
def k2_catalog_csv(rows: DataFrame) -> DataFrame:
    folder = _folder(rows, "csv")
    exports.catalog_csv(rows, folder, ["k", "n", "note"])
    return rows.sparkSession.read.schema("k long, n string, note string").option("header", True).option("escape", '"').csv(folder)


@query(
    """SELECT 'summary' AS part, CAST(count(*) AS VARCHAR) || ' ' || count(*) FILTER (WHERE k % 4 = 0) || ' ' || (SELECT count(*) FROM rows WHERE k % 9 = 0) AS text FROM rows
 UNION ALL SELECT 'entry', replace(path, chr(92), '/') || ' ' || ['verified', 'misnamed', 'duplicate', 'unknown'][k % 4 + 1] FROM rows UNION ALL SELECT 'missing', name FROM rows WHERE k % 9 = 0""",
    rows="SELECT p_partkey AS k, concat('d', chr(92), p_name) AS path, p_name AS name FROM part",
)
def k1_catalog_report(rows: DataFrame) -> DataFrame:
    folder, read = _folder(rows, "report"), rows.sparkSession.read
    status = F.element_at(F.lit(["verified", "misnamed", "duplicate", "unknown"]), (F.col("k") % 4 + 1).cast("int"))
    exports.catalog_report(rows.select("path", status.alias("status")), rows.filter("k % 9 = 0").select("name"), folder)
    summary = read.schema("total long, verified long, missing long").json(f"{folder}/summary").select(F.lit("summary").alias("part"), F.concat_ws(" ", "total", "verified", "missing").alias("text"))
    entries = read.schema("path string, status string").json(f"{folder}/entries").select(F.lit("entry").alias("part"), F.concat_ws(" ", "path", "status").alias("text"))
    return summary.unionByName(entries).unionByName(read.schema("name string").json(f"{folder}/missing").select(F.lit("missing").alias("part"), F.col("name").alias("text")))


@query("SELECT g, string_agg(p, chr(10) ORDER BY o) || chr(10) AS text FROM rows GROUP BY g", rows="SELECT p_size AS g, p_partkey AS o, concat(p_name, '.cue') AS p FROM part")
def k5_playlists(rows: DataFrame) -> DataFrame:
    folder = _folder(rows, "m3u")
    exports.playlist(rows, folder, "g", "p", "o")
    return rows.sparkSession.read.text(folder, wholetext=True).select(F.col("g").cast("int").alias("g"), F.col("value").alias("text"))


@query(
    """WITH r AS (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY g ORDER BY o) = s THEN 0 ELSE 1 END AS n FROM blocks), q AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY o) AS run FROM r)
 SELECT g, min(o) * 512 AS pos, count(*) * 512 AS size, any_value(s) AS status FROM q GROUP BY g, run""",
    blocks="SELECT l_suppkey AS g, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS o, CASE WHEN l_linenumber % 3 = 0 THEN '-' ELSE '+' END AS s FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem)",
)
def k10_rescue_maps(blocks: DataFrame) -> DataFrame:
    folder = _folder(blocks, "maps")
    exports.rescue_map(blocks.select(F.col("g").alias("map"), (F.col("o") * 512).cast("long").alias("pos"), F.lit(512).cast("long").alias("size"), F.col("s").alias("status")), folder)
    out = formats.rescue_map(blocks.sparkSession, f"{folder}/*")
    return out.select(F.regexp_extract("path", r"map=(\d+)", 1).cast("long").alias("g"), "pos", "size", "status")


SAMPLES = "SELECT user_id % 40 AS g, event_id AS o, event_id % 50 AS c1, event_id % 7 AS c2 FROM events"


@query("SELECT g, row_number() OVER (PARTITION BY g ORDER BY o) - 1 AS ord, CAST(o AS DOUBLE) AS position, CASE WHEN c2 > 0 THEN CAST(c1 AS DOUBLE) END AS pie, CAST(c2 AS DOUBLE) AS pif, 'dvd' AS family, 'probe ' || g AS tool FROM ev", ev=SAMPLES)
def s6_scan_log(ev: DataFrame) -> DataFrame:
    line = F.concat_ws(";", F.col("o").cast("string"), F.when(F.col("c2") > 0, F.col("c1").cast("string")).otherwise(""), F.col("c2").cast("string"))
    texts = _joined(ev, "g", ["o"], line, "Position;PI Errors;PIF\n").withColumn("text", F.concat(F.lit("Tool: probe "), F.col("g").cast("string"), F.lit("\nDisc: x\n"), "text"))
    out = formats.scan_log(ev.sparkSession, _put(texts, "scan", F.concat(F.col("g").cast("string"), F.lit(".txt")), F.col("text")))
    return out.select(_name().alias("g"), "ord", "position", "pie", "pif", "family", "tool")


@query("SELECT g, o AS second, CAST(c1 + 2 * c2 AS DOUBLE) AS bler, CAST(c2 AS DOUBLE) AS e32 FROM ev", ev=SAMPLES)
def s7_second_log(ev: DataFrame) -> DataFrame:
    line = F.concat_ws(",", *(c.cast("string") for c in (F.col("o"), F.col("c1"), F.col("c2"), F.col("c2"), F.lit(1), F.lit(0), F.col("c2"))))
    out = formats.second_log(ev.sparkSession, _put(_joined(ev, "g", ["o"], line), "seconds", F.concat(F.col("g").cast("string"), F.lit(".csv")), F.col("text")))
    return out.select(_name().alias("g"), "second", "bler", "e32")


@query("SELECT g, o AS lba, CASE WHEN c1 > 0 THEN 1 / (c1 / 4) ELSE 0 END AS speed FROM ev", ev=SAMPLES)
def s11_speed_log(ev: DataFrame) -> DataFrame:
    texts = _joined(ev, "g", ["o"], F.concat_ws(",", F.col("o").cast("string"), (F.col("c1") / 4).cast("string")), "lba,time\n")
    return formats.speed_log(ev.sparkSession, _put(texts, "speed", F.concat(F.col("g").cast("string"), F.lit(".csv")), F.col("text"))).select(_name().alias("g"), "lba", "speed")


TRACKS = "SELECT l_suppkey AS g, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n, l_partkey AS p FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem)"


@query("SELECT g, 'disc ' || g || '.bin' AS file, n AS track, CASE WHEN n = 1 THEN 'MODE1/2352' ELSE 'AUDIO' END AS mode, 1 AS index, n * 225 + 37 AS sector FROM tr WHERE n < 100", tr=TRACKS)
def s13_cue_sheet(tr: DataFrame) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    at = F.col("n") * 225 + 37
    line = F.concat(F.lit("  TRACK "), two(F.col("n")), F.when(F.col("n") == 1, " MODE1/2352").otherwise(" AUDIO"), F.lit("\n    INDEX 01 "), two(F.floor(at / 4500)), F.lit(":"), two(F.floor(at / 75) % 60), F.lit(":"), two(at % 75))
    texts = _joined(tr.filter("n < 100"), "g", ["n"], line).withColumn("text", F.concat(F.lit('FILE "disc '), F.col("g").cast("string"), F.lit('.bin" BINARY\n'), "text"))
    return formats.cue_sheet(tr.sparkSession, _put(texts, "cue", F.concat(F.col("g").cast("string"), F.lit(".cue")), F.col("text"))).select(_name().alias("g"), "file", "track", "mode", "index", "sector")


@query("SELECT g, n AS track, p AS start, p % 2 = 0 AS is_data, 2352 AS sector_size, 't ' || n || '.bin' AS file FROM tr", tr=TRACKS)
def s14_gdi(tr: DataFrame) -> DataFrame:
    line = F.concat_ws(" ", F.col("n").cast("string"), F.col("p").cast("string"), F.when(F.col("p") % 2 == 0, "4").otherwise("0"), F.lit("2352"), F.concat(F.lit('"t '), F.col("n").cast("string"), F.lit('.bin"')), F.lit("0"))
    return formats.gdi(tr.sparkSession, _put(_joined(tr, "g", ["n"], line, "9\n"), "gdi", F.concat(F.col("g").cast("string"), F.lit(".gdi")), F.col("text"))).select(_name().alias("g"), "track", "start", "is_data", "sector_size", "file")


@query("SELECT g, 'Entry ' || n AS section, 'Point' AS name, '0x' || p AS value FROM tr", tr=TRACKS)
def s14_sections(tr: DataFrame) -> DataFrame:
    line = F.concat(F.lit("[Entry "), F.col("n").cast("string"), F.lit("]\n; note\nPoint = 0x"), F.col("p").cast("string"))
    return formats.sections(tr.sparkSession, _put(_joined(tr, "g", ["n"], line), "ccd", F.concat(F.col("g").cast("string"), F.lit(".ccd")), F.col("text"))).select(_name().alias("g"), "section", "name", "value")


@query("SELECT g, n AS track, CASE WHEN n % 3 = 0 THEN 'data' ELSE 'audio' END AS kind, CASE WHEN n % 4 > 0 THEN lpad(CAST(p AS VARCHAR), 8, '0') END AS crc32, md5(CAST(p AS VARCHAR)) AS md5, CASE WHEN n % 5 > 0 THEN sha1(CAST(p AS VARCHAR)) END AS sha1 FROM tr", tr=TRACKS)
def s8_hash_blocks(tr: DataFrame) -> DataFrame:
    n, p = F.col("n").cast("string"), F.col("p").cast("string")
    row = lambda c: F.concat(F.lit("Track "), F.lpad(n, 4, "0"), F.lit(" : "), c)
    parts = [("kinds", F.concat(F.lit("Track "), n, F.when(F.col("n") % 3 == 0, " Mode 1").otherwise(" Audio"))), ("CRC32 hash", F.when(F.col("n") % 4 > 0, row(F.lpad(p, 8, "0")))), ("MD5 hash", row(F.upper(F.md5(p)))), ("SHA1 hash", F.when(F.col("n") % 5 > 0, row(F.sha1(p))))]
    all_ = F.concat_ws("\n", *(F.concat_ws("\n", F.lit(head), F.array_join(F.collect_list(line), "\n")) for head, line in parts))
    texts = tr.groupBy("g").agg(all_.alias("text"))
    return formats.hash_blocks(tr.sparkSession, _put(texts, "blocks", F.concat(F.col("g").cast("string"), F.lit(".txt")), F.col("text"))).select(_name().alias("g"), "track", "kind", "crc32", "md5", "sha1")


@query("SELECT g, n - 1 AS ord, 't' || n || '.bin' AS name, p AS size, lpad(CAST(p AS VARCHAR), 8, '0') AS crc FROM tr", tr=TRACKS)
def s9_dump_log(tr: DataFrame) -> DataFrame:
    p = F.col("p").cast("string")
    line = F.concat(F.lit('x <rom name="t'), F.col("n").cast("string"), F.lit('.bin" size="'), p, F.lit('" crc="'), F.lpad(p, 8, "0"), F.lit('" md5="'), F.md5(p), F.lit('" sha1="'), F.sha1(p), F.lit('" />'))
    return formats.dump_log(tr.sparkSession, _put(_joined(tr, "g", ["n"], line), "dump", F.concat(F.col("g").cast("string"), F.lit(".log")), F.col("text"))).select(_name().alias("g"), "ord", "name", "size", "crc")


@query("SELECT DISTINCT g, c1 + 50 * c2 AS lba FROM ev", ev=SAMPLES)
def s10_error_addresses(ev: DataFrame) -> DataFrame:
    line = F.concat(F.lit("12:00 read Error at LBA: "), (F.col("c1") + 50 * F.col("c2")).cast("string"), F.lit(" retried"))
    return formats.error_addresses(ev.sparkSession, _put(_joined(ev, "g", ["o"], line, "LBA 7 ok\n"), "errors", F.concat(F.col("g").cast("string"), F.lit(".log")), F.col("text"))).select(_name().alias("g"), "lba")


@query("SELECT g, 'field ' || (c2 + 1) AS field, 'v' || min_by(c1, o) AS value FROM ev GROUP BY g, c2", ev=SAMPLES)
def s10_log_fields(ev: DataFrame) -> DataFrame:
    line = F.concat(F.lit("Field "), (F.col("c2") + 1).cast("string"), F.lit(":  v"), F.col("c1").cast("string"), F.lit(" "))
    return formats.log_fields(ev.sparkSession, _put(_joined(ev, "g", ["o"], line, "[head]\n", "\r\n"), "fields", F.concat(F.col("g").cast("string"), F.lit(".log")), F.col("text"))).select(_name().alias("g"), "field", "value")


@query("SELECT g, o AS seq, c1 AS value FROM ev", ev=SAMPLES)
def s12_documents(ev: DataFrame) -> DataFrame:
    line = F.concat(F.lit('{"seq": '), F.col("o").cast("string"), F.lit(',\n "value": '), F.col("c1").cast("string"), F.lit("}"))
    texts = _joined(ev, "g", ["o"], line, "", ",\n").withColumn("text", F.concat(F.lit('{"log": ['), F.regexp_replace("text", ",\\n$", ""), F.lit("]}")))
    return formats.documents(ev.sparkSession, _put(texts, "json", F.concat(F.col("g").cast("string"), F.lit(".json")), F.col("text")), "log array<struct<seq: long, value: long>>", "log").select(_name().alias("g"), "seq", "value")


@query("SELECT g, (n - 1) // 99 AS ord, (n - 1) % 99 + 1 AS track, n % 200 AS confidence, p AS crc, p + 1 AS crc2 FROM tr", tr=TRACKS)
def s14_checksum_records(tr: DataFrame) -> DataFrame:
    little = lambda c: F.concat(*(F.lpad(F.hex(F.shiftright(c, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)))
    p = F.col("p").cast("long")
    track = F.concat(F.lpad(F.hex(F.col("n") % 200), 2, "0"), little(p), little(p + 1))
    record = tr.withColumn("r", F.floor((F.col("n") - 1) / 99)).groupBy("g", "r").agg(F.concat(F.lpad(F.hex(F.count("*")), 2, "0"), F.lit("010000000200000003000000"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", track.alias("t")))), lambda x: x["t"]), "")).alias("b"))
    blobs = record.groupBy("g").agg(F.unhex(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "b"))), lambda x: x["b"]), ""), F.lit("0000"))).alias("content"))
    return formats.checksum_records(tr.sparkSession, _put(blobs, "records", F.concat(F.col("g").cast("string"), F.lit(".bin")), F.col("content"))).select(_name().alias("g"), "ord", "track", "confidence", "crc", "crc2")


@query(
    "SELECT k, CASE k % 6 WHEN 0 THEN 'zip' WHEN 1 THEN 'wav' WHEN 2 THEN 'vhd' WHEN 3 THEN 'nrg' WHEN 4 THEN 'iso9660' ELSE 'unknown' END AS kind FROM heads",
    heads="SELECT p_partkey AS k FROM part",
)
def s15_kinds(heads: DataFrame) -> DataFrame:
    k = F.col("k") % 6
    content = F.when(k == 0, F.unhex(F.lit("504B0304FF"))).when(k == 1, F.lit(b"RIFF0000WAVEfmt ")).when(k == 2, F.lit(b"x" * 99 + b"conectix" + bytes(504))).when(k == 3, F.lit(b"abc" + b"NERO" + bytes(4))).when(k == 4, F.lit(bytes(32769) + b"CD001" + bytes(99))).otherwise(F.lit(b"plain"))
    return heads.withColumn("content", content).select("k", formats.kind_of("content").alias("kind"))


@query(
    "SELECT k, i AS lba, CASE WHEN i < 3 THEN hex(encode(repeat(chr(65 + i::INT), 8) || lpad(CAST(k AS VARCHAR), 8, '0'))) END AS head FROM files, range(5) t(i)",
    files="SELECT s_suppkey AS k FROM supplier",
)
def s18_sectors(files: DataFrame) -> DataFrame:
    sector = lambda c: F.rpad(F.concat(F.lit(c * 8), F.lpad(F.col("k").cast("string"), 8, "0")), 2048, ".")
    folder = _put(files, "sectors", F.concat(F.col("k").cast("string"), F.lit(".img")), F.concat(sector("A"), sector("B"), sector("C")))
    asked = files.select(F.concat(F.lit(f"{folder}/"), F.col("k").cast("string"), F.lit(".img")).alias("path"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("lba"))
    return images.sectors(asked).select(_name().alias("k"), "lba", F.hex(F.substring("content", 1, 16)).alias("head"))


@query(
    """SELECT k, unnest([{'path': 'A.TXT', 'size': 10, 'sha256': sha256('0123456789')}, {'path': 'SUB/B.BIN', 'size': 6, 'sha256': sha256('num' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0'))}, {'path': 'SUB/C.BIN', 'size': 5000, 'sha256': NULL}], recursive := true) FROM files WHERE k % 5 > 0""",
    files="SELECT s_suppkey AS k FROM supplier",
)
def s17_iso_files(files: DataFrame) -> DataFrame:
    """Images of 24 sectors with two files, and one that lies past the end; a fifth are no images."""

    def made(b: bytes) -> bytes:
        k = int(b)
        entry = lambda name, at, size, folder=0: (body := at.to_bytes(4, "little") + at.to_bytes(4, "big") + size.to_bytes(4, "little") + size.to_bytes(4, "big") + bytes(7) + bytes([2 * folder]) + bytes(6) + bytes([len(name)]) + name + bytes((len(name) + 1) % 2)) and bytes([len(body) + 2, 0]) + body
        out = bytearray(24 * 2048)
        if k % 5 == 0:
            return bytes(out)
        root = entry(b"\0", 18, 2048, 1)
        head = bytearray(2048)
        head[:7], head[156 : 156 + len(root)] = b"\1CD001\1", root
        folder = entry(b"\0", 18, 2048, 1) + entry(b"\1", 18, 2048, 1) + entry(b"A.TXT;1", 20, 10) + entry(b"SUB", 19, 2048, 1)
        sub = entry(b"\0", 19, 2048, 1) + entry(b"\1", 18, 2048, 1) + entry(b"B.BIN;1", 21, 6) + entry(b"C.BIN;1", 23, 5000)
        for at, body in ((16, bytes(head)), (18, folder), (19, sub), (20, b"0123456789"), (21, b"num%03d" % (k % 1000))):
            out[at * 2048 : at * 2048 + len(body)] = body
        return bytes(out)

    content = byte_function(made, "binary")(F.col("k").cast("string").cast("binary"))
    return images.iso_files(files.withColumn("content", content), "k", "content").select("k", "path", "size", "sha256")


@query(
    """WITH h AS (SELECT image, sha256, list(DISTINCT "view") AS vs, min(path) AS path FROM seen WHERE sha256 IS NOT NULL GROUP BY ALL), v AS (SELECT DISTINCT image, "view" FROM seen)
 SELECT v.image, v."view", h.path, h.sha256 FROM h JOIN v ON v.image = h.image WHERE NOT list_contains(vs, v."view") UNION ALL SELECT image, "view", path, NULL FROM seen WHERE sha256 IS NULL""",
    seen="SELECT l_suppkey AS image, l_returnflag AS view, concat('f', l_orderkey) AS path, CASE WHEN l_linenumber % 6 > 0 THEN md5(CAST(l_partkey % 300 AS STRING)) END AS sha256 FROM lineitem",
)
def j7_cross_check(seen: DataFrame) -> DataFrame:
    return images.cross_check(seen, "image")


@query("SELECT k, md5(b) AS ips, md5(b) AS bps FROM pairs", pairs="SELECT p_partkey AS k, repeat(p_name, 3) AS a, concat(p_type, repeat('z', p_size), p_name, substring(repeat(p_name, 3), 5, 40)) AS b FROM part")
def f25_patches(pairs: DataFrame) -> DataFrame:
    """Patches from a to b, applied to a."""
    both = F.concat(F.lpad(F.octet_length("a").cast("string"), 8, "0").cast("binary"), F.col("a").cast("binary"), F.col("b").cast("binary"))
    cut = lambda x: (x[8 : 8 + int(x[:8])], x[8 + int(x[:8]) :])
    ips = byte_function(lambda x: patches.ips_apply(cut(x)[0], patches.ips_make(*cut(x))), "binary")
    bps = byte_function(lambda x: patches.bps_apply(cut(x)[0], patches.bps_make(*cut(x))), "binary")
    return pairs.select("k", F.md5(ips(both)).alias("ips"), F.md5(bps(both)).alias("bps"))
