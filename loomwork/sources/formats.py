"""Readers of catalogue, checksum, rescue-map, scan and layout files. Each gives rows with the path that they come from; none infers a schema.

Text formats are read whole, a file a row, and parsed by Arrow maps in the executors, since a file's lines need one another.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import msf_sectors


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """path, length, mtime and content of all files below a folder. Spark's reader leaves empty files out, so those that it lists, but doesn't read, are added; they have no mtime."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    some = raw.select("path", "length", F.col("modificationTime").alias("mtime"), "content")
    listed = spark.createDataFrame([(unquote(p),) for p in raw.inputFiles()], "path string").withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    read = raw.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path")).distinct()
    empty = listed.join(read, "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("mtime"), F.lit(b"").alias("content"))
    return some.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")).unionByName(empty)


def files(spark: SparkSession, path: str, skip: tuple[str, ...] = (), skip_folder: str = "/.git/") -> DataFrame:
    """path, length, mtime and hashes of all files below a folder, empty ones too, but for names in skip and what lies in skip_folder. Contents above 2 GB don't fit a row (see images.sectors)."""
    raw = _contents(spark, path)
    name = F.element_at(F.split("path", "/"), -1)
    some = raw.filter(~name.isin(*skip) if skip else F.lit(True)).filter(~F.contains("path", F.lit(skip_folder)))
    crc = F.lower(F.lpad(F.hex(F.crc32("content")), 8, "0"))
    return some.select("path", name.alias("file_name"), "length", "mtime", crc.alias("crc32"), F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"))


def head_digest(spark: SparkSession, path: str, n: int = 5000) -> DataFrame:
    """path, file_name, length and MD5 of the first n bytes (all for n = 0) of the files below a folder."""
    raw = _contents(spark, path)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", F.md5(F.expr(f"substring(content, 1, {n})") if n else F.col("content")).alias("md5"))


def _manifest(text: str) -> Iterator[tuple]:
    for k, line in enumerate(x.strip() for x in text.split("\n")):
        if line and not line.startswith("#"):
            at, _, location = line.partition("\t") if "\t" in line else re.match(r"(.*?)(  )(.*)$", line).groups() if "  " in line else ("", "", "")
            if not at.strip() or not location.strip():
                raise ValueError(f"line {k + 1} of the manifest needs a path and a place: {line!r}")
            place = location.strip()
            yield k, at.strip().replace("\\", "/"), place, bool(re.match("https?://", place, re.I))


def source_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of manifests of files from several places: ord, target (the path that a file gets), place and is_url; target and place stand on a line with a tab or several blanks between them, # begins a comment."""
    entries = _whole(spark, path, "ord long, target string, place string, is_url boolean", _manifest)
    return entries.withColumnRenamed("path", "manifest")


def staged(entries: DataFrame, available: DataFrame) -> DataFrame:
    """What a manifest's entries (target, place, is_url) give of the files that are there (path, length): a file gives itself, a folder all below it, and what isn't there is a failure. target, place, length (-1 for a URL, which isn't looked at) and failure.

    Entries meet files by each of the folders above a file, so no entry is compared with every file.
    """
    places = entries.select("target", F.regexp_replace("place", "/+$", "").alias("place"), "is_url")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    met = available.select("path", "length", F.explode(above).alias("at"))
    found = places.filter("NOT is_url").join(met, F.col("place") == F.col("at"), "left")
    below = F.substring(F.col("path"), F.length("place") + 2, F.lit(1 << 30))
    target = F.when(F.col("path").isNull() | (F.col("path") == F.col("place")), F.col("target")).otherwise(F.concat(F.regexp_replace("target", "/+$", ""), F.lit("/"), below))
    local = found.select(target.alias("target"), F.coalesce("path", "place").alias("place"), "length", F.when(F.col("path").isNull(), "not found").alias("failure"))
    urls = places.filter("is_url").select("target", "place", F.lit(-1).cast("long").alias("length"), F.lit(None).cast("string").alias("failure"))
    return local.unionByName(urls)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Entries of XML catalogues: game, name, size, crc, md5, sha1, clone_of, description, one row a rom of every game or machine.

    Hashes are trimmed and in lower case, blanks null; a size that is no number is 0; clone_of falls back on romof.
    """
    text = T.StringType()
    rom = T.StructType([T.StructField(f"_{c}", text) for c in ("name", "size", "crc", "md5", "sha1")])
    game = T.StructType([T.StructField("_name", text), T.StructField("_cloneof", text), T.StructField("_romof", text), T.StructField("description", text), T.StructField("rom", T.ArrayType(rom))])
    both = None
    for tag in ("game", "machine"):
        part = spark.read.format("xml").option("rowTag", tag).schema(game).load(path)
        both = part if both is None else both.unionByName(part)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = both.select("*", F.explode("rom").alias("r"))
    hashes = [F.lower(blank(F.col(f"r._{h}"))).alias(h) for h in ("crc", "md5", "sha1")]
    return rows.select(F.col("_name").alias("game"), F.col("r._name").alias("name"), F.coalesce(F.trim("r._size").try_cast("long"), F.lit(0)).alias("size"), *hashes, F.coalesce(blank(F.col("_cloneof")), blank(F.col("_romof"))).alias("clone_of"), F.col("description"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, name, hash of checksum lists: name first and an 8-digit hash last, or a longer hash first, then an optional star and the name; ; and # begin comments."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim(F.regexp_replace("value", "\r$", "")).alias("l")).filter("l <> '' AND NOT l RLIKE '^[;#]'")
    long_, short = r"^([0-9A-Fa-f]{32,128})\s+\*?(.+)$", r"^(.+?)\s+([0-9A-Fa-f]{8})$"
    is_long = F.col("l").rlike(long_)
    name = F.when(is_long, F.regexp_extract("l", long_, 2)).otherwise(F.regexp_extract("l", short, 1))
    digest = F.when(is_long, F.regexp_extract("l", long_, 1)).otherwise(F.regexp_extract("l", short, 2))
    return lines.filter(is_long | F.col("l").rlike(short)).select("path", name.alias("name"), F.lower(digest).alias("hash"))


def documents(spark: SparkSession, path: str, schema: str, rows: str) -> DataFrame:
    """JSON documents that hold an array: one row for each of its elements, with the document's path."""
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.explode(rows).alias("_r")).select("path", "_r.*")


def _whole(spark: SparkSession, path: str, schema: str, parse: Callable[[str], Iterator[tuple]]) -> DataFrame:
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    types = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields}

    def column(name: str, values: list) -> pd.Series:
        kind = {"long": "Int64", "bigint": "Int64", "int": "Int64", "double": "Float64", "boolean": "boolean"}.get(types[name].simpleString())
        return pd.Series(values, dtype=kind or object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for at, text in zip(df["path"], df["value"]):
                rows = list(parse(text))
                yield pd.DataFrame({"path": pd.Series([at] * len(rows), dtype=object)} | {n: column(n, [r[k] for r in rows]) for k, n in enumerate(names)})

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return texts.mapInPandas(run, f"path string, {schema}")


def _number(text: str) -> int:
    return int(text, 16) if text.lower().startswith("0x") else int(text, 8) if re.fullmatch("0[0-7]+", text) else int(text)


def _rescue_map(text: str) -> Iterator[tuple]:
    lines = [x.split("#")[0].split() for x in text.splitlines()]
    blocks = [(_number(x[0]), _number(x[1]), x[2]) for x in [x for x in lines if x][1:]]
    out: list[list] = []
    for pos, size, status in blocks:
        if out and out[-1][0] + out[-1][1] != pos:
            raise ValueError(f"the map has a gap or an overlap at {pos}")
        if out and out[-1][2] == status:
            out[-1][1] += size
        else:
            out.append([pos, size, status])
    return (tuple(x) for x in out)


def rescue_map(spark: SparkSession, path: str) -> DataFrame:
    """Blocks pos, size, status of rescue maps (GNU ddrescue): comments, a status line, blocks in decimal, octal or hexadecimal. Neighbours of one status are one; a map that isn't contiguous is an error."""
    return _whole(spark, path, "pos long, size long, status string", _rescue_map)


_METRICS = {"c1": "c1", "bler": "c1", "c2": "c2", "cu": "cu", "pie": "pie", "pi8": "pie", "pi errors": "pie", "pif": "pif", "pi failures": "pif", "po failures": "pof", "pof": "pof", "ldc": "ldc", "bis": "bis", "jitter": "jitter"}
_POSITIONS = {"position", "lba", "sector", "sec", "time", "mb", "gb", "pos", "address"}
_ORDER = ("c1", "c2", "cu", "pie", "pif", "pof", "ldc", "bis", "jitter")


def _cells(line: str, mark: str | None) -> list[str]:
    return [x.strip().strip('"') for x in (line.split(mark) if mark else line.split())]


def _floats(cells: list[str]) -> list[float | None]:
    out = []
    for x in cells:
        try:
            out.append(float(x))
        except ValueError:
            out.append(None)
    return out


def _scan(text: str) -> Iterator[tuple]:
    lines = [x for x in text.splitlines() if x.strip()]
    mark = max(",\t;", key=lambda m: sum(x.count(m) for x in lines)) if lines else ","
    mark = mark if any(mark in x for x in lines) else None
    head, meta, start = None, {}, 0
    for k, line in enumerate(lines):
        cells = [x.lower() for x in _cells(line, mark)]
        known = [x for x in cells if x in _METRICS or x in _POSITIONS]
        if len(known) >= 2 and any(x in _METRICS for x in known):
            head, start = cells, k + 1
            break
        if all(x is not None for x in _floats(cells)) and len(cells) > 1:
            start = k
            break
        if m := re.match(r"\s*([^:=,;\t]+?)\s*[:=,;\t]\s*(.+?)\s*$", line):
            meta[m[1].lower()] = m[2]
    tool = meta.get("tool") or meta.get("program") or meta.get("software")
    family = "bd" if head and {"ldc", "bis"} & set(head) else "dvd" if head and any(_METRICS.get(x) in ("pie", "pif", "pof") for x in head) else "cd"
    for n, line in enumerate(lines[start:]):
        values = _floats(_cells(line, mark))
        if all(v is None for v in values):
            continue
        row: dict[str, float | None] = {}
        if head:
            for name, v in zip(head, values):
                row.setdefault("position" if name in _POSITIONS else _METRICS.get(name, name), v)
        else:
            row = dict(zip(("position", "c1", "c2", "cu"), values))
        yield (n, row.get("position"), *(row.get(m) for m in _ORDER), family, tool)


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    """Samples of quality scans: ord, position, the metrics that the log has, its family (cd, dvd or bd, by its metrics) and tool. The separator is the commonest of comma, tab and semicolon, otherwise white space; key and value lines come before the header, which may be missing."""
    return _whole(spark, path, "ord long, position double, " + ", ".join(f"{m} double" for m in _ORDER) + ", family string, tool string", _scan)


_SECONDS = ("second", "e11", "e21", "e31", "e12", "e22", "e32")


def _seconds(text: str) -> Iterator[tuple]:
    head = None
    for n, row in enumerate(csv.reader(x for x in text.splitlines() if x.strip() and not x.startswith("#"))):
        cells = [x.strip().lower() for x in row]
        values = _floats(cells)
        if values[0] is None and head is None and n == 0:
            head = cells
            continue
        names = head or (_SECONDS if len(cells) >= 7 else ("second", "bler", "e32"))
        got = dict(zip(names, values))
        if got.get("second") is not None:
            bler = got.get("bler", sum(got.get(k) or 0 for k in ("e11", "e21", "e31")))
            yield (int(got["second"]), bler, *(got.get(k) for k in _SECONDS[1:]))


def second_log(spark: SparkSession, path: str) -> DataFrame:
    """Errors by second: second, bler (given, or the sum of the first stage's), e11 to e32; with a header or the columns in that order, seven or two to three."""
    return _whole(spark, path, "second long, bler double, " + ", ".join(f"{k} double" for k in _SECONDS[1:]), _seconds)


def _speed(text: str) -> Iterator[tuple]:
    inverse = False
    for row in csv.reader(x for x in text.splitlines() if x.strip()):
        if len(row) < 2:
            continue
        values = _floats([x.strip() for x in row])
        if values[0] is None:
            inverse = "time" in row[1].lower()
        elif values[1] is not None:
            yield int(values[0]), (1 / values[1] if values[1] > 0 else 0.0) if inverse else values[1]


def speed_log(spark: SparkSession, path: str) -> DataFrame:
    """lba and speed; a column of times is turned over, 0 where it isn't positive."""
    return _whole(spark, path, "lba long, speed double", _speed)


def _cue(text: str) -> Iterator[tuple]:
    file = number = mode = None
    for line in text.splitlines():
        if m := re.match(r'\s*FILE\s+(?:"([^"]*)"|(\S+))', line, re.I):
            file = m[1] or m[2]
        elif m := re.match(r"\s*TRACK\s+(\d+)\s+(\S+)", line, re.I):
            number, mode = int(m[1]), m[2].upper()
        elif (m := re.match(r"\s*INDEX\s+(\d+)\s+(\S+)", line, re.I)) and number is not None:
            yield file, number, mode, int(m[1]), m[2]


def cue_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Indexes of cue sheets: file, track, mode, index, and its sector."""
    rows = _whole(spark, path, "file string, track long, mode string, index long, msf string", _cue)
    return rows.withColumn("sector", msf_sectors(F.col("msf"))).drop("msf")


_HASH_LINE = re.compile(r'<rom\s+name="([^"]*)"\s+size="(\d+)"\s+crc="([0-9a-fA-F]+)"\s+md5="([0-9a-fA-F]+)"\s+sha1="([0-9a-fA-F]+)"')


def _dump_log(text: str) -> Iterator[tuple]:
    seen: dict[str, list] = {}
    for m in _HASH_LINE.finditer(text):
        seen.setdefault(m[1], [int(m[2]), *(x.lower() for x in m.groups()[2:])])
    for k, (name, row) in enumerate(seen.items()):
        yield (k, name, *row)


def dump_log(spark: SparkSession, path: str) -> DataFrame:
    """Hashes of tracks that dumping logs list as rom elements: ord, name, size, crc, md5, sha1; the first of repeated names counts."""
    return _whole(spark, path, "ord long, name string, size long, crc string, md5 string, sha1 string", _dump_log)


def _hash_blocks(text: str) -> Iterator[tuple]:
    tracks: dict[int, dict[str, str]] = {}
    block = None
    for line in text.splitlines():
        if m := re.search(r"(CRC32|MD5|SHA1) hash", line, re.I):
            block = m[1].lower()
        elif block and (m := re.match(r"\s*Track\s*0*(\d+)\s*:\s*([0-9A-Fa-f]+)\s*$", line)):
            tracks.setdefault(int(m[1]), {})[block] = m[2].lower()
    for m in re.finditer(r"Track\s*0*(\d+)\s+(Audio|Data|Mode\s*[12])", text, re.I):
        tracks.setdefault(int(m[1]), {}).setdefault("kind", "data" if m[2].lower().startswith("mode") else m[2].lower())
    for number, t in sorted(tracks.items()):
        yield (number, *(t.get(k) for k in ("kind", "crc32", "md5", "sha1")))


def hash_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of dumping logs that list hashes in a block for each sort, merged by track: track, kind, crc32, md5, sha1; of repeated lines of one sort the last counts."""
    return _whole(spark, path, "track long, kind string, crc32 string, md5 string, sha1 string", _hash_blocks)


def log_fields(spark: SparkSession, path: str) -> DataFrame:
    """field and value of lines `field: value` of logs, in lower case and without blanks at their ends; the first of repeated fields counts."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    field, value = (F.trim(F.regexp_extract("line", r"^\s*([^:\[\]<>]{1,60}?)\s*:\s+(\S.*?)\s*$", k)) for k in (1, 2))
    return lines.select("path", "n", F.lower(field).alias("field"), value.alias("value")).filter("field <> ''").groupBy("path", "field").agg(F.min_by("value", "n").alias("value"))


def error_addresses(spark: SparkSession, path: str) -> DataFrame:
    """Distinct addresses that log lines with the word error give as LBA, in order."""
    hit = F.regexp_extract("value", r"(?i)error.*?\bLBA\D{0,4}(\d+)", 1)
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), hit.try_cast("long").alias("lba")).filter("lba IS NOT NULL").distinct().orderBy("path", "lba")


def _gdi(text: str) -> Iterator[tuple]:
    for line in text.splitlines()[1:]:
        m = re.match(r'\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(?:"([^"]*)"|(\S+))\s+(-?\d+)', line)
        if m:
            yield int(m[1]), int(m[2]), m[3] == "4", int(m[4]), m[5] or m[6], int(m[7])


def gdi(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of GDI layouts: track, start, is_data, sector_size, file, offset."""
    return _whole(spark, path, "track long, start long, is_data boolean, sector_size long, file string, offset long", _gdi)


def _ini(text: str) -> Iterator[tuple]:
    section = ""
    for line in text.splitlines():
        if m := re.match(r"\s*\[([^\]]*)\]", line):
            section = m[1]
        elif m := re.match(r"\s*([^=;#]+?)\s*=\s*(.*?)\s*$", line):
            yield section, m[1], m[2]


def sections(spark: SparkSession, path: str) -> DataFrame:
    """section, name, value of files of bracketed sections, as CCD layouts are."""
    return _whole(spark, path, "section string, name string, value string", _ini)


def checksum_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of binary checksum databases: ord, disc ids id1, id2 and cddb (hexadecimal), and for each track confidence, crc and crc2; little-endian: a byte for the number of tracks, three ids of four bytes, nine bytes a track. Fewer than 13 bytes at the end are padding; a record whose tracks are cut off, none or over 99 is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for at, b in zip(df["path"], df["content"]):
                rows, k, n = [], 0, 0
                while k + 13 <= len(b):
                    if not 1 <= b[k] <= 99:
                        raise ValueError(f"{at}: {b[k]} tracks at byte {k}, so it is no checksum record")
                    if k + 13 + 9 * b[k] > len(b):
                        raise ValueError(f"{at}: cut off inside a record's tracks")
                    ids = [b[k + i : k + i + 4][::-1].hex() for i in (1, 5, 9)]
                    for t in range(b[k]):
                        r = b[k + 13 + 9 * t : k + 22 + 9 * t]
                        rows.append((at, n, *ids, t + 1, r[0], int.from_bytes(r[1:5], "little"), int.from_bytes(r[5:9], "little")))
                    k, n = k + 13 + 9 * b[k], n + 1
                yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object if i in (0, 2, 3, 4) else "int64") for i, c in enumerate(("path", "ord", "id1", "id2", "cddb", "track", "confidence", "crc", "crc2"))})

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(run, "path string, ord long, id1 string, id2 string, cddb string, track long, confidence long, crc long, crc2 long")


#: Beginnings of files that tell their kind: place, bytes in hexadecimal, kind. Fixed values.
MAGIC = (
    (0, "504B0304", "zip"),
    (0, "377ABCAF271C", "7z"),
    (0, "526172211A07", "rar"),
    (0, "1F8B", "gzip"),
    (0, "FD377A585A00", "xz"),
    (0, "425A68", "bzip2"),
    (0, "28B52FFD", "zstd"),
    (0, "89504E470D0A1A0A", "png"),
    (0, "FFD8FF", "jpeg"),
    (0, "47494638", "gif"),
    (0, "25504446", "pdf"),
    (0, "664C6143", "flac"),
    (0, "4F676753", "ogg"),
    (0, "494433", "mp3"),
    (8, "57415645", "wav"),
    (0, "7F454C46", "elf"),
    (0, "4D5A", "exe"),
    (257, "7573746172", "tar"),
    (0, "4D436F6D70724844", "chd"),
    (0, "4349534F", "cso"),
    (0, "5A49534F", "zso"),
    (0, "50532D5820455845", "ps-exe"),
    (0, "56414770", "vag"),
    (0, "534E45532D535043373030", "spc"),
    (0, "56676D20", "vgm"),
    (0, "4E45534D1A", "nsf"),
    (0, "4D454449412044455343524950544F52", "mds"),
    (0, "57424653", "wbfs"),
    (0, "445644564944454F2D564D47", "ifo"),
    (0, "445644564944454F2D565453", "ifo"),
    (0, "564944454F5F4344", "vcd"),
    (0, "5355504552564344", "vcd"),
    (0, "5050463330", "ppf"),
    (0, "5050463230", "ppf"),
    (0, "5050463130", "ppf"),
    (0, "5041544348", "ips"),
    (0, "42505331", "bps"),
    (0, "52565A01", "rvz"),
    (0, "57494101", "wia"),
    (0, "45434D00", "ecm"),
    (0, "4E45531A", "nes"),
    (0, "80371240", "n64"),
    (0, "37804012", "n64"),
    (0, "40123780", "n64"),
    (0, "4C594E58", "lynx"),
    (0, "574F5A31", "woz"),
    (0, "574F5A32", "woz"),
    (0, "4743522D31353431", "g64"),
    (0, "5A585461706521", "tzx"),
    (32769, "43442D4920", "cd-i"),
    (34817, "4245413031", "udf"),
    (36865, "4E53523032", "udf"),
    (36865, "4E53523033", "udf"),
    (32769, "4344303031", "iso9660"),
    (65536, "4D4943524F534F46542A58424F582A4D45444941", "xdvdfs"),
    (24, "5D1C9EA3", "wii"),
    (28, "C2339F3D", "gamecube"),
    (0, "53454741205345474153415455524E", "saturn"),
)

#: Ends of files that tell their kind: place from the end, bytes in hexadecimal, kind. Fixed values.
TAILS = (
    (12, "4E455235", "nrg"),
    (8, "4E45524F", "nrg"),
    (512, "636F6E6563746978", "vhd"),
    (512, "6B6F6C79", "dmg"),
)


def kind_of(content: str) -> Column:
    """A file's kind by its bytes, the first rule that fits; beginnings are looked at before ends."""
    out = F.when(F.lit(False), "")
    for at, magic, kind in MAGIC:
        out = out.when(F.hex(F.substring(content, at + 1, len(magic) // 2)) == magic, kind)
    for back, magic, kind in TAILS:
        at = F.octet_length(content) - back + 1
        out = out.when((at > 0) & (F.hex(F.substring(F.col(content), at, F.lit(len(magic) // 2))) == magic), kind)
    return out.otherwise("unknown")
