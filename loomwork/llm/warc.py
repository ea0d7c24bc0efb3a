"""A deterministic sharded WARC writer, and a reader.

Pages are dealt to shards by ranges of number and digest, sorted within, and written as one gzip member a record; a file is
closed once its compressed size reaches ROLL_BYTES. Ranges are cut at quantiles, by bytes of payload, of a sample of rows
that a hash of the rows alone picks, so they hold about SHARD_BYTES each however the numbers are spread, and the same rows give
the same shards. Headers are generated anew: record ids are name-based UUIDs of number and digest, dates a parameter,
digests SHA-1 in base 32. The same rows give the same bytes.

Each attempt of a task writes files under names of its own. Those of the attempts that Spark commits are then
renamed, which may be tried any number of times, and when all of them are there, a manifest lists them with size, SHA-1
and number of records: an archive without one isn't whole. What other attempts left is deleted last.

Of records with equal payloads of at least REVISIT bytes, that with the largest number is a response, others revisit it. The reader
checks every digest, and that each revisit names a response of its digest and length.

Rows: a null payload is empty; rows without a number come last, dealt to shards of their own by digest, and are all responses; rows that repeat
a number are all written, and of copies under the largest number the first is the response; numbers may lie anywhere in 64 bits; extra columns are ignored. An
empty table gives a manifest without files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import frugal
from .shared import kept, new_folder

REVISIT = 1000
SHARD_BYTES = 16 << 20
ROLL_BYTES = 4 << 20
#: Shards above which they grow instead; a shard is written as a stream, so its size costs no memory.
MOST_SHARDS = 10_000
#: Sampled rows a shard, about; at most MOST_SHARDS times this many reach the driver.
SAMPLES = 20
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def digest_label(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _line(value: str) -> str:
    """A header's value in one line."""
    return " ".join(value.split())


def record(number: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, date: str = DATE) -> bytes:
    """One record, without compression. A revisit has the headers of its response, but no payload."""
    target = _line(url or "") or "about:blank"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers is None else "revisit"
    block = http + (payload if refers is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id(number, digest)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: {digest_label(digest)}", f"WARC-Block-Digest: {digest_label(hashlib.sha1(block).hexdigest())}", f"X-Payload-Length: {len(payload)}"]
    if number is not None:
        head.append(f"X-Page-Number: {number}")
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{record_id(refers, digest)}>", f"X-Refers-To-Page: {refers}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(number: int | None, digest: str) -> uuid.UUID:
    return uuid.uuid5(_SPACE, f"{number}:{digest}")


def squeezed(body: bytes) -> bytes:
    """A gzip member without time or name, so that equal bodies give equal members."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(body) + pack.flush()


class Roller:
    """Files of one shard, closed by compressed size."""

    def __init__(self, folder: str, shard: int, attempt: str, roll_bytes: int):
        self.fs, self.path = opened(folder)
        self.shard, self.attempt, self.roll = shard, attempt, roll_bytes
        self.n, self.out, self.done = 0, None, []

    def add(self, body: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.n:05d}.warc.gz"
            self.temp = f"_temporary/{self.name}.{self.attempt}"
            self.fs.create_dir(f"{self.path}/_temporary", recursive=True)
            self.out, self.sha, self.size, self.records = self.fs.open_output_stream(f"{self.path}/{self.temp}", compression=None), hashlib.sha1(), 0, 0
            self.add(squeezed(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, self.name)}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode()))
            self.records = 0
        self.out.write(body)
        self.sha.update(body)
        self.size += len(body)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.temp, self.size, self.sha.hexdigest(), self.records))
            self.out, self.n = None, self.n + 1


def _write(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard, number, digest and kind; a mark (kind 0) stands before the pages that it is about."""
        roller, mark, first, said = None, None, False, []
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for shard, number, digest, kind, url, payload, refers in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)):
                    if kind == 0:
                        mark, first = (number, digest, refers), True
                        continue
                    if roller is None or roller.shard != shard:
                        if roller:
                            roller.close()
                            said += roller.done
                        roller = Roller(folder, shard, attempt, roll_bytes)
                    to = None
                    if mark and mark[:2] == (number, digest):
                        to = None if mark[2] == number and first else mark[2]
                        first = False
                    roller.add(squeezed(record(number, url, (payload or "").encode(), digest, to)))
        if roller:
            roller.close()
            said += roller.done
        if said:
            name, temp, size, sha, n = zip(*said)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(temp), pa.array(size, pa.int64()), pa.array(sha), pa.array(n, pa.int64())], names=["file", "temp", "bytes", "sha1", "records"])

    return run


def renamed(folder: str, name: str, temp: str) -> None:
    """Gives a whole file its name. The file may have it already, from an attempt before; no file is ever deleted or replaced."""
    system, path = opened(folder)
    if system.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
        return
    try:
        system.move(f"{path}/{temp}", f"{path}/{name}")
    except OSError:
        if system.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
            raise


def _rename(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, temp in zip(batch.column("file").to_pylist(), batch.column("temp").to_pylist()):
                renamed(folder, name, temp)
            yield batch.drop_columns(["temp"])

    return run


MANIFEST = "file string, bytes long, sha1 string, records long"
_SAID = "file string, temp string, bytes long, sha1 string, records long"


def _shards(rows: DataFrame, shard_bytes: int):
    """A column of the shard of each row (number, digest, url), and how many there are."""
    size = F.octet_length("payload") + 200
    whole = rows.agg(*(F.coalesce(F.sum(F.when(c, x)), F.lit(0)).alias(n) for c, x, n in ((F.col("number").isNotNull(), size, "bytes"), (F.col("number").isNull(), size, "others"), (F.col("number").isNotNull(), F.lit(1), "rows")))).first()
    n, spare = (min(MOST_SHARDS, -(-whole[c] // shard_bytes)) for c in ("bytes", "others"))
    each = max(1, whole["rows"] // max(1, n * SAMPLES))
    picked = rows.filter("number IS NOT NULL").filter(F.pmod(F.xxhash64("number", "payload"), F.lit(each)) == 0)
    found = sorted(map(tuple, picked.groupBy("number", F.sha1(F.encode("payload", "UTF-8"))).agg(F.sum(size)).collect())) if n > 1 else []  # about n * SAMPLES rows
    total, cuts = 0, []
    weight = sum(x[2] for x in found)
    for number, digest, some in found:
        if total * n >= (len(cuts) + 1) * weight:
            cuts.append((number, digest))
        total += some
    numbers, digests = np.array([c[0] for c in cuts], np.int64), [c[1] for c in cuts]

    @F.pandas_udf("int")
    def at(number: pd.Series, digest: pd.Series) -> pd.Series:
        x = number.to_numpy(np.int64)
        out, hi = np.searchsorted(numbers, x, "left"), np.searchsorted(numbers, x, "right")
        for k in np.flatnonzero(hi > out):
            out[k] = bisect_right(digests, digest[k], out[k], hi[k])
        return pd.Series(out.astype(np.int32))

    first = len(cuts) + 1
    known = at(F.coalesce("number", F.lit(0)), "digest") if cuts else F.lit(0)
    return F.when(F.col("number").isNull(), F.lit(first) + F.pmod(F.xxhash64("digest", "url"), F.lit(max(1, spare))).cast("int")).otherwise(known), first + max(1, spare)


def _slots(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a number that repartition() deals to it, so that shards don't share a partition by chance."""
    asked = spark.range(40 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id"))
    found = {r["p"]: r["id"] for r in asked.collect()}
    return [found.get(p, p) for p in range(n)]


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archives and their manifest into a folder that has none yet; the manifest's rows."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("number"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    digest = F.sha1(F.encode("payload", "UTF-8")).alias("digest")
    long_ = rows.filter(F.octet_length("payload") >= REVISIT).filter("number IS NOT NULL").select("number", digest)
    winners = long_.groupBy("digest").agg(F.max("number").alias("refers"), F.count("*").alias("n")).filter("n > 1").select("digest", "refers")
    marks = long_.distinct().join(winners, "digest").select("number", "digest", F.lit(0).alias("kind"), F.lit("").alias("url"), F.lit("").alias("payload"), "refers")
    plain = rows.select("number", digest, F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers"))
    shard, n = _shards(rows, shard_bytes)
    slot = F.element_at(F.lit(_slots(spark, n)), F.col("shard") + 1).cast("long")
    dealt = plain.unionByName(marks).select(shard.alias("shard"), "number", "digest", "kind", "url", "payload", "refers").withColumn("slot", slot).repartition(n, "slot").drop("slot")
    said = dealt.sortWithinPartitions("shard", "number", "digest", "kind", "url").mapInArrow(frugal(_write(folder, roll_bytes)), _SAID)
    said.write.json(f"{folder}/_committed")  # of each task the attempt that Spark commits
    files = spark.read.schema(_SAID).json(f"{folder}/_committed")
    files.repartition(max(1, min(n, files.count())), "file").mapInArrow(_rename(folder), MANIFEST).write.json(f"{folder}/manifest")
    system, path = opened(folder)
    for left in ("_temporary", "_committed"):
        if system.get_file_info(f"{path}/{left}").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/{left}")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers by lower-case name and block of each gzip member."""
    un, body = zlib.decompressobj(31), bytearray()
    for chunk in chunks:
        while chunk:
            body += un.decompress(chunk)
            chunk = b""
            if un.eof:
                head, _, block = bytes(body).partition(b"\r\n\r\n")
                lines = head.decode().split("\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                size = int(fields["content-length"])
                if not lines[0].startswith("WARC/") or block[size:] != b"\r\n\r\n":
                    raise ValueError("not a WARC record")
                yield fields, block[:size]
                chunk, un, body = un.unused_data, zlib.decompressobj(31), bytearray()
    if body:
        raise ValueError("the archive is cut off")


def _read(folder: str, payloads: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for row in df.itertuples():
                yield from _file(folder, row.file, row.sha1, payloads)

    return run


def _file(folder: str, name: str, sha1: str, payloads: bool, at_once: int = 512) -> Iterator[pd.DataFrame]:
    system, path = opened(folder)
    seen, out = hashlib.sha1(), []

    def chunks() -> Iterator[bytes]:
        with system.open_input_stream(f"{path}/{name}", compression=None) as f:
            while piece := f.read(1 << 18):
                seen.update(piece)
                yield piece

    def frame() -> pd.DataFrame:
        number, size, digest, kind, refers, url, body = zip(*out)
        out.clear()
        whole = {"page_id": pd.array(number, dtype="Int64"), "payload_bytes": np.array(size, np.int64), "payload_digest": list(digest), "record_type": list(kind), "refers_to": pd.array(refers, dtype="Int64"), "url": list(url)}
        return pd.DataFrame(whole | ({"payload": list(body)} if payloads else {}))

    whole = lambda x: None if x is None else int(x)
    for head, block in records(chunks()):
        kind = head["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        if digest_label(hashlib.sha1(block).hexdigest()) != head["warc-block-digest"]:
            raise ValueError("a record's digest is wrong")
        payload = block.partition(b"\r\n\r\n")[2]
        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(head["x-payload-length"])):
            raise ValueError("a payload's digest is wrong")
        out.append((whole(head.get("x-page-number")), int(head["x-payload-length"]), digest, kind, whole(head.get("x-refers-to-page")), head["warc-target-uri"], payload))
        if len(out) >= at_once:
            yield frame()
    if out:
        yield frame()
    if seen.hexdigest() != sha1:
        raise ValueError(f"{name} isn't what the manifest says")


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex), record_type, refers_to, url and, if asked for, payload of all archives that the manifest lists; digests and references are verified."""
    files = manifest(spark, folder)
    files = files.repartition(max(1, min(files.count(), 100_000)), "file")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    index = kept(files.mapInPandas(frugal(_read(folder, False)), schema))
    known = index.filter("record_type = 'response'").select("page_id", "payload_digest", "payload_bytes")
    asked = index.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest", "payload_bytes").distinct()
    if not asked.join(known.hint("merge"), ["page_id", "payload_digest", "payload_bytes"], "left_anti").isEmpty():
        raise ValueError("a revisit refers to no response of its digest and length")
    return files.mapInPandas(frugal(_read(folder, True)), schema + ", payload binary") if payloads else index


def written(pages: DataFrame, **settings) -> str:
    """The folder, in what all executors share, that pages were written to."""
    folder = new_folder(pages.sparkSession, "warc")
    write(pages, folder, **settings)
    return folder
