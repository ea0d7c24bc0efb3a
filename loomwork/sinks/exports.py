"""Writers of catalogues, checksum lists, rescue maps and playlists. Each takes rows and a folder, which Spark commits whole; none renames or moves a user's files, plans of such are DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import csv_cell, leaf, rebuild_path
from ..operators.lineage import cut
from ..sources.images import opened


def catalog_json(entries: DataFrame, folder: str) -> None:
    """A JSON line for each entry, nulls left out; paths with slashes."""
    entries.withColumn("path", F.translate("path", "\\", "/")).write.mode("overwrite").json(folder)


def catalog_report(entries: DataFrame, missing: DataFrame, folder: str) -> None:
    """A catalogue's summary, entries (path, status and more) and missing catalogue rows as JSON lines in folders of those names: counts by status, and of all and missing rows, in the summary."""
    catalog_json(entries, f"{folder}/entries")
    missing.write.mode("overwrite").json(f"{folder}/missing")
    counts = entries.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(n) for s, n in (("verified", "verified"), ("misnamed", "misnamed"), ("duplicate", "duplicates"), ("unknown", "unknown"))))
    lost = missing.agg(F.count("*").alias("missing"))
    counts.withColumn("one", F.lit(1)).join(lost.withColumn("one", F.lit(1)), "one").drop("one").coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def put(rows: DataFrame, folder: str) -> DataFrame:
    """Writes each row's content (binary) as a file of its name (a path below the folder) and gives the names; a file appears under its name once it is whole, an older one goes to name.bak first."""
    root = opened(folder)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = opened(folder)[0]
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                to = f"{root}/{name}"
                system.create_dir(to.rpartition("/")[0], recursive=True)
                temp = f"{to}.{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(temp, compression=None) as out:
                    out.write(content or b"")
                if system.get_file_info(to).type != fs.FileType.NotFound:
                    system.copy_file(to, f"{to}.bak")
                system.move(temp, to)
            yield batch.select(["name"])

    some = rows.select("name", F.col("content").cast("binary").alias("content"))
    return cut(some.mapInArrow(run, "name string"))


def catalog_csv(entries: DataFrame, folder: str, columns: list[str]) -> None:
    """Lines of cells, quoted only where they must be, with the header first in every part file."""
    head = ",".join(columns)
    lines = entries.select(F.concat_ws(",", *(csv_cell(F.col(c).cast("string")) for c in columns)).alias(head))
    lines.write.mode("overwrite").option("header", True).option("quote", "").option("escapeQuotes", False).option("lineSep", "\n").option("sep", "\x01").csv(folder)


def catalog_xml(roms: DataFrame, folder: str) -> None:
    """XML of games with their roms, as the catalogue reader takes it."""
    each = roms.select("game", "description", "clone_of", F.struct(F.col("name").alias("_name"), F.col("size").alias("_size"), F.col("crc").alias("_crc"), F.col("md5").alias("_md5"), F.col("sha1").alias("_sha1")).alias("rom"))
    games = each.groupBy(F.col("game").alias("_name"), F.col("clone_of").alias("_cloneof"), "description").agg(F.array_sort(F.collect_list("rom")).alias("rom"))
    games.write.mode("overwrite").format("xml").option("rootTag", "datafile").option("rowTag", "game").save(folder)


def checksum_list(rows: DataFrame, folder: str, name: str, digest: str, short: bool = False) -> None:
    """name and 8-digit hash, or hash, star and name."""
    line = F.concat_ws(" ", F.col(name), F.upper(digest)) if short else F.concat(F.lower(digest), F.lit(" *"), F.col(name))
    rows.select(line.alias("value")).write.mode("overwrite").text(folder)


def rescue_map(blocks: DataFrame, folder: str) -> None:
    """Maps as one text file a partition of map: a status line, then blocks in hexadecimal in order."""
    hex_ = lambda c: F.concat(F.lit("0x"), F.lpad(F.hex(c), 8, "0"))
    line = F.concat_ws("  ", hex_("pos"), hex_("size"), F.col("status"))
    text = blocks.groupBy("map").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("b"))
    text.select("map", F.concat(F.lit("# pos size status\n0x00000000     ?\n"), F.col("b")).alias("value")).write.mode("overwrite").partitionBy("map").text(folder)


def playlist(rows: DataFrame, folder: str, group: str, path: str, order: str) -> None:
    """Paths of each group in order, in a folder of its own."""
    lines = rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(path).alias("p")))), lambda x: x["p"]), "\n").alias("value"))
    lines.write.mode("overwrite").partitionBy(group).text(folder)


def rename_plan(files: DataFrame) -> DataFrame:
    """old and new path of matched files (path, wanted) whose name isn't the wanted one; of files that want one path the first by path gets it, others are clashes."""
    target = F.concat(F.regexp_replace("path", r"[^/\\]*$", ""), F.col("wanted"))
    moves = files.filter(F.col("wanted").isNotNull() & (leaf(F.col("path")) != F.col("wanted"))).select("path", target.alias("new_path"))
    first = F.row_number().over(Window.partitionBy("new_path").orderBy("path")) == 1
    taken = files.select(F.col("path").alias("_t")).distinct()
    return moves.withColumn("_f", first).join(taken, F.col("new_path") == F.col("_t"), "left").select("path", "new_path", (~F.col("_f") | F.col("_t").isNotNull()).alias("clash"))


def rebuild_plan(files: DataFrame, layout: str = "game") -> DataFrame:
    """Where each matched file (path, system, game, name) goes, once for each target, and whether it's there already."""
    to = files.filter("game IS NOT NULL").select("path", rebuild_path(layout, F.col("system"), F.col("game"), F.col("name")).alias("target"))
    best = to.groupBy("target").agg(F.min(F.struct((F.col("path") != F.col("target")).alias("away"), "path")).alias("b"))
    return best.select(F.col("b.path").alias("path"), "target", (~F.col("b.away")).alias("in_place"))
