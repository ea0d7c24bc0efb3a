import random
import re

import xxhash
from loomwork.llm import simhash
from loomwork.llm.components import components

from .helpers import ODD, docs


def fingerprint(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(nodes, linked):
    """Least name reachable, by flooding."""
    name = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and name[b] < name[a]:
                    name[a], changed = name[b], True
    return name


def test_each_pair_within_the_radius_meets():
    masks = simhash.masks()
    for a in range(64):
        for b in range(a, 64):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_components_of_documents(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 900)}" for _ in range(400)]
    texts = list(ODD)
    for i in range(40):
        t = list(base)
        for _ in range(rnd.choice([0, 1, 2, 40])):
            t[rnd.randrange(len(t))] = "x" + str(rnd.randint(0, 99))
        texts.append((100 + i, " ".join(t)))
    got = simhash.near_duplicates(docs(spark, texts)).collect()
    prints = {(r.doc_id, r.fp % (1 << 64)) for r in got}
    assert prints == {(i, fingerprint(t)) for i, t in texts} and len(got) == len(texts)
    fps = sorted({f for _, f in prints})
    name = groups(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    for r in got:
        members = [i for i, f in prints if name[f] == name[r.fp % (1 << 64)] and i is not None]
        assert r.component_id == (min(members) if members else None)
    kept = simhash.one_of_each(docs(spark, texts))
    assert kept.columns == docs(spark, []).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r.component_id for r in got if r.component_id is not None and any(x.doc_id == r.component_id for x in got)}) and ids.count(None) == 1
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_buckets_of_any_size_give_the_same_groups(spark):
    rnd = random.Random(6)
    fps = set()
    for _ in range(3):
        b = rnd.getrandbits(64)
        for _ in range(40):
            x = b
            for _ in range(rnd.randint(0, 4)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    want = groups(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    for small in (1, 64):
        label = {r.node: r.component for r in components(simhash.links(nodes, small)).collect()}
        got = {f: label.get(simhash._signed(f), simhash._signed(f)) for f in fps}
        assert len({(got[f], want[f]) for f in fps}) == len(set(got.values())) == len(set(want.values()))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0
