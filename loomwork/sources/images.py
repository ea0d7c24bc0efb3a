"""Sectors by address, files of ISO 9660 images, and comparison of the views that an image gives."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SECTOR = 2048


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:///", "/", 1) if path.startswith("file:///") else path)


def sectors(asked: DataFrame, size: int = SECTOR) -> DataFrame:
    """content of sectors that are asked for (path, lba), read where they are, whatever the file's length; shorter past its end, null where nothing is.

    Sectors of one file that lie near one another are read by one task, in order: they are dealt by ranges of path and lba.
    """
    rows = asked.select("path", F.col("lba").cast("long").alias("lba")).repartitionByRange("path", "lba").sortWithinPartitions("path", "lba")
    schema = pa.schema([("path", pa.string()), ("lba", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, file = None, None
        for batch in batches:
            out = []
            for path, lba in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path is not None and path != held:
                    if file:
                        file.close()
                    system, place = opened(path)
                    held, file = path, system.open_input_file(place)
                inside = path is not None and lba is not None and 0 <= lba * size < file.size()
                out.append(file.read_at(size, lba * size) if inside else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], schema=schema)
        if file:
            file.close()

    return rows.mapInArrow(run, "path string, lba long, content binary")


def _records(data: bytes) -> Iterator[tuple[str, int, int, bool]]:
    """name, extent, size and whether it is a folder of each record of a folder's sectors; a record doesn't cross a sector's end."""
    at = 0
    while at < len(data):
        n = data[at]
        if n == 0:
            at = (at // SECTOR + 1) * SECTOR
            continue
        r = data[at : at + n]
        name = r[33 : 33 + r[32]]
        if name not in (b"\0", b"\1"):
            yield name.split(b";")[0].decode("ascii", "replace"), int.from_bytes(r[2:6], "little"), int.from_bytes(r[10:14], "little"), bool(r[25] & 2)
        at += n


def iso_listing(image: bytes) -> list[tuple[str, int, int, str | None]]:
    """path, extent, size and SHA-256 (null if it lies past the end) of the files of an ISO 9660 image, in order of path; none for other bytes. A folder is entered once."""
    d = image[16 * SECTOR : 17 * SECTOR]
    if len(d) < SECTOR or d[1:6] != b"CD001" or d[0] != 1:
        return []
    out, seen, todo = [], set(), [("", int.from_bytes(d[158:162], "little"), int.from_bytes(d[166:170], "little"))]
    while todo:
        folder, extent, size = todo.pop()
        if extent in seen:
            continue
        seen.add(extent)
        for name, at, n, is_folder in _records(image[extent * SECTOR : extent * SECTOR + size]):
            if is_folder:
                todo.append((f"{folder}{name}/", at, n))
            else:
                body = image[at * SECTOR : at * SECTOR + n]
                out.append((folder + name, at, n, hashlib.sha256(body).hexdigest() if len(body) == n else None))
    return sorted(out)


def iso_files(images: DataFrame, key: str, content: str) -> DataFrame:
    """key, path, extent, size and sha256 of the files of images, whole in a row each."""
    rows = images.select(F.col(key).alias("key"), F.col(content).alias("content"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            found = [(k, *f) for k, c in zip(df["key"], df["content"]) if c is not None for f in iso_listing(bytes(c))]
            yield pd.DataFrame(found, columns=["key", "path", "extent", "size", "sha256"])

    return rows.mapInPandas(run, f"key {dict(rows.dtypes)['key']}, path string, extent long, size long, sha256 string").withColumnRenamed("key", key)


def cross_check(views: DataFrame, image: str) -> DataFrame:
    """Contents that not all views of an image have (image, view, path, sha256), compared by content and not by name: a row for each content and view that lacks it, with the first path by name elsewhere. A content that can't be read (null) is missing everywhere."""
    rows = views.select(F.col(image).alias("image"), "view", "path", "sha256")
    all_ = rows.select("image", "view").distinct()
    have = rows.filter("sha256 IS NOT NULL").groupBy("image", "sha256").agg(F.collect_set("view").alias("views"), F.min("path").alias("path"))
    n = all_.withColumn("n", F.count("*").over(Window.partitionBy("image")))
    lack = have.join(n, "image").filter(F.size("views") < F.col("n")).filter(~F.array_contains(F.col("views"), F.col("view")))
    bad = rows.filter("sha256 IS NULL").select("image", "view", "path", F.lit(None).cast("string").alias("sha256"))
    return lack.select("image", "view", "path", "sha256").unionByName(bad).withColumnRenamed("image", image)
