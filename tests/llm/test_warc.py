import gzip
import hashlib
from pathlib import Path

import pytest
from loomwork.llm import warc

from .helpers import LONG

ROWS = [(i, f"http://x/{i}", f"<p>page {i}</p>") for i in range(40)]
ROWS += [(100, "u", "a" * 999), (101, "u", "a" * 999), (102, "u", "é" * 500), (103, None, "é" * 500), (104, "", None), (105, "u\r\nX: y", ""), (106, "u", LONG), (106, "u", LONG), (107, "u", LONG), (107, "u2", LONG), (None, "u", LONG)]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, kind int")


def brute(rows):
    top = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            top[h] = max(i, top.get(h, i))
    out, seen = [], set()
    for i, _, h in rows:
        to = top.get(h) if i is not None else None
        if to == i:
            to = i if (i, h) in seen else None
            seen.add((i, h))
        out.append((str(i), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "response" if to is None else "revisit", str(to)))
    return sorted(out)


def test_round_trip_and_revisits(spark):
    folder = warc.written(pages(spark, ROWS), shard_bytes=2000, roll_bytes=500)
    got = warc.read(spark, folder).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == brute(ROWS)
    texts = {(i, h or "") for i, _, h in ROWS}
    assert all((r.page_id, r.payload.decode()) in texts for r in got if r.record_type == "response")
    names = sorted(p.name for p in Path(folder.removeprefix("file://")).glob("*.warc.gz"))
    assert names == sorted(r.file for r in warc.manifest(spark, folder).collect()) and len(names) > 5


def test_same_rows_same_bytes(spark):
    a, b = (Path(warc.written(pages(spark, r).repartition(n), shard_bytes=2000, roll_bytes=500).removeprefix("file://")) for r, n in ((ROWS, 1), (ROWS[::-1], 5)))
    files = sorted(p.name for p in a.glob("*.warc.gz"))
    assert files == sorted(p.name for p in b.glob("*.warc.gz"))
    assert all((a / f).read_bytes() == (b / f).read_bytes() for f in files)
    assert gzip.decompress((a / files[0]).read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_damage_is_seen(spark):
    folder = Path(warc.written(pages(spark, ROWS)).removeprefix("file://"))
    file = next(folder.glob("*.warc.gz"))
    file.write_bytes(file.read_bytes()[:-40])
    with pytest.raises(Exception, match="cut off|isn't what"):
        warc.read(spark, str(folder)).collect()


def test_empty(spark):
    assert warc.read(spark, warc.written(pages(spark, []))).count() == 0


def sizes(spark, folder):
    return [r.records for r in warc.manifest(spark, folder).collect()]


def test_shards_follow_the_rows_however_numbers_are_spread(spark):
    body = "x" * 400
    for more in ([], [(1 << 60, "u", body)], [(-(1 << 63), "u", body), ((1 << 63) - 1, "u", body)], [(7, "u", f"{body}{i}") for i in range(700)], [(None, "u", f"{body}{i}") for i in range(700)]):
        rows = [(i, "u", f"{body}{i}") for i in range(1000)] + more
        folder = warc.written(pages(spark, rows), shard_bytes=30_000)
        n = sizes(spark, folder)
        assert sum(n) == len(rows) and len(n) >= 15 and max(n) <= 200
        got = warc.read(spark, folder, payloads=False).collect()
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == brute(rows)


def test_attempts_that_run_twice_or_die(spark, tmp_path):
    import pyarrow as pa

    rows = [(0, i, "d0" * 20, 1, "u", f"page {i}", None) for i in range(50)]
    names = ["shard", "number", "digest", "kind", "url", "payload", "refers"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema([("shard", pa.int32()), ("number", pa.int64()), ("digest", pa.string()), ("kind", pa.int32()), ("url", pa.string()), ("payload", pa.string()), ("refers", pa.int64())]))
    folder = str(tmp_path)

    def attempt(x):
        (out,) = warc._write(folder, 1000)(iter([batch]))
        return [tuple(out.to_pydict()[c][k] for c in ("file", "temp", "bytes", "sha1", "records")) for k in range(out.num_rows)]

    first, second = spark.sparkContext.parallelize([1, 2], 2).map(attempt).collect()
    assert len(first) > 1 and [(a[0], *a[2:]) for a in first] == [(b[0], *b[2:]) for b in second] and not {a[1] for a in first} & {b[1] for b in second}
    for name, temp, *_ in first:
        warc.renamed(folder, name, temp)
    whole = {name: (tmp_path / name).read_bytes() for name, *_ in first}
    for name, temp, *_ in [*second, *first]:  # a second commit, and one that is tried again, leave the files as they are
        warc.renamed(folder, name, temp)
    assert {name: (tmp_path / name).read_bytes() for name, *_ in first} == whole
    with pytest.raises(OSError):
        warc.renamed(folder, "other.warc.gz", first[0][1])


def test_nothing_but_the_archive_is_left(spark):
    folder = Path(warc.written(pages(spark, ROWS)).removeprefix("file://"))
    assert {p.name for p in folder.iterdir() if not p.name.endswith(".gz")} == {"manifest"}


def test_a_revisit_needs_its_response(spark):
    rows = [(i, "u", "é" * 600) for i in (1, 2, 3)]
    folder = Path(warc.written(pages(spark, rows)).removeprefix("file://"))
    assert warc.read(spark, str(folder)).count() == 3
    names = [r.file for r in warc.manifest(spark, str(folder)).collect()]
    parts = [x for n in names for x in warc.records(iter([(folder / n).read_bytes()]))]
    assert sum(h["warc-type"] == "revisit" for h, _ in parts) == 2
    body = b"".join(warc.squeezed("\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in h.items())]).encode() + b"\r\n\r\n" + b + b"\r\n\r\n") for h, b in parts if h["warc-type"] != "response")
    (folder / names[0]).write_bytes(body)
    spark.createDataFrame([(names[0], len(body), hashlib.sha1(body).hexdigest(), 2)], warc.MANIFEST).write.mode("overwrite").json(f"{folder}/manifest")
    with pytest.raises(ValueError, match="no response"):
        warc.read(spark, str(folder))
