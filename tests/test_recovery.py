import random

import numpy as np
from loomwork.functions import recovery
from loomwork.operators import genealogy
from pyspark.sql import functions as F


def test_sectors():
    assert recovery.edc(b"") == 0
    body = bytearray(recovery.SYNC + bytes([0, 2, 0, 1]) + bytes(i % 251 for i in range(2048)) + bytes(288))
    body[2064:2068] = recovery.edc(bytes(body[:2064])).to_bytes(4, "little")
    assert recovery.sector_valid(bytes(body)) is True
    body[100] ^= 1
    assert recovery.sector_valid(bytes(body)) is False
    assert recovery.sector_valid(bytes(2352)) is None and recovery.sector_valid(None) is None and recovery.sector_valid(b"x") is None
    form = bytearray(recovery.SYNC + bytes([0, 2, 0, 2]) + bytes(2336))
    form[72:80] = b"contents"
    form[2072:2076] = recovery.edc(bytes(form[16:2072])).to_bytes(4, "little")
    assert recovery.sector_valid(bytes(form)) is True


def test_parity_heals_any_losses(spark):
    rng, rnd = np.random.default_rng(1), random.Random(1)
    data = rng.integers(0, 256, (7, 50)).astype(np.uint8)
    parity = recovery.parity_of(data, 3)
    for _ in range(30):
        lost, kept = set(rnd.sample(range(7), 3)), set(range(3))
        out = recovery.healed({k: data[k] for k in range(7) if k not in lost}, {p: parity[p] for p in kept}, 7, 3)
        assert (out == data).all()
    assert recovery.healed({k: data[k] for k in range(3)}, {0: parity[0]}, 7, 3) is None
    rows = spark.createDataFrame([("s", i, bytearray(b.tobytes())) for i, b in enumerate(data)], "s string, i int, c binary")
    own = recovery.parity_blocks(rows, "s", "i", "c", 2)
    sizes = spark.createDataFrame([("s", 7, 2)], "s string, data int, parities int")
    out = recovery.heal_blocks(rows.filter("i NOT IN (2, 5)"), own, sizes, "s", "i", "c").collect()
    assert {r.i: (bytes(r.c), r.healed) for r in out} == {i: (b.tobytes(), i in (2, 5)) for i, b in enumerate(data)}


def test_families(spark):
    rings = spark.createDataFrame([("1", "T", "AB-1", "L1", "M1"), ("2", "t", "ab 1", None, "M2"), ("3", "T", "AB1", None, None), ("4", "T", "ZZ", "L", "M"), ("5", "T", None, "L", "M")], "id string, title string, matrix string, mastering string, mould string")
    got = {r.id: (r.members, r.branches, r.standing) for r in genealogy.authenticity(genealogy.families(rings)).collect()}
    assert got == {"1": (3, 2, "consistent"), "2": (3, 2, "partial"), "3": (3, 2, "suspect"), "4": (1, 1, "lone"), "5": (None, None, "unknown")}
    ids = spark.createDataFrame([("AB_C", "abc"), ("GAME1", "GAME12"), ("A", "AB"), ("TOMBRAIDER", "TOMBSTONES"), ("TOMB1", "TOMB22"), ("", "x"), (None, "x")], "a string, b string")
    assert [r[0] for r in ids.select(genealogy.related_ids(F.col("a"), F.col("b"))).collect()] == [True, True, True, False, True, False, False]


def test_sectors_are_mended_by_their_parity():
    rnd = random.Random(1)
    for mode in (1, 2):
        raw = bytearray(recovery.SYNC + bytes([0, 2, 5, mode]) + bytes(rnd.randrange(256) for _ in range(2336)))
        raw[18] &= 0xDF
        good = recovery.with_parity(bytes(raw))
        assert recovery.sector_check(good) is True and recovery.sector_repair(good) is None
        for n in (1, 5, 20):
            bad = bytearray(good)
            for k in rnd.sample(range(16, 2352), n):
                bad[k] ^= rnd.randrange(1, 256)
            assert recovery.sector_check(bytes(bad)) is False and recovery.sector_repair(bytes(bad)) == good
        bad = bytearray(good)
        for k in range(100, 1500):
            bad[k] ^= 77
        assert recovery.sector_repair(bytes(bad)) is None
    form2 = bytes(recovery.SYNC) + bytes([0, 2, 5, 2, 0, 0, 0x20]) + bytes(2333)
    assert recovery.sector_check(form2) is None and recovery.sector_check(b"x") is None and recovery.sector_repair(None) is None
