import random

import numpy as np
import pyarrow as pa
from loomwork.llm import near_copies, simhash
from loomwork.llm.batches import text_slices

from .helpers import ODD, docs
from .test_simhash import groups


def plain(text, n=5):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = low.split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def alike(a, b, least=0.8):
    return a == b or len(a & b) >= least * len(a | b) and bool(a & b)


def made(rnd, sizes=(3, 8, 30, 120, 400)):
    texts = list(ODD)
    for g in range(12):
        base = [f"w{rnd.randint(0, 900)}" for _ in range(rnd.choice(sizes))]
        for k in range(rnd.choice([1, 2, 6, 40])):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 9]) if k else 0):
                i = rnd.randrange(len(t))
                t[i : i + rnd.choice([0, 1])] = [rnd.choice(["x", "Y", "z"]) + str(rnd.randint(0, 99))]
            texts.append((1000 * g + 1000 + k, rnd.choice([" ", "\n", "  "]).join(t)))
    return texts


def test_shingles_and_classes():
    rnd = random.Random(31)
    texts = [t for _, t in made(rnd)]
    (s,) = text_slices(pa.array(texts), 1 << 26)
    h, first = near_copies.shingles(s)
    names, samples, tables = near_copies.signatures(h, first)
    assert np.diff(first).tolist() == [len(plain(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (plain(a) == plain(b)) == (names[i].tolist() == names[j].tolist())
    assert tables.shape[1] == 7 * near_copies.GROUPS + 7 and samples.shape[1] == near_copies.SAMPLES


def test_pairs_that_differ_in_two_samples_of_a_group_meet():
    for a in range(7):
        for b in range(7):
            assert any(a not in at and b not in at for at in near_copies._KEPT)
    assert all(len(at) == 4 for at in near_copies._KEPT)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_copies.links, "__defaults__", (near_copies.SIMILARITY, near_copies.SMALL, 7))
    for seed, small in ((32, 16), (33, 2)):
        texts = made(random.Random(seed))
        sets = sorted({frozenset(plain(t)) for _, t in texts}, key=lambda x: sorted(x))
        name = groups(range(len(sets)), lambda a, b: alike(sets[a], sets[b]))
        of = {frozenset(x): name[i] for i, x in enumerate(sets)}
        want = {}
        for i, t in texts:
            if i is not None:
                g = of[frozenset(plain(t))]
                want[g] = min(i, want.get(g, i))
        got = near_copies.groups(docs(spark, texts), small=small).collect()
        assert len(got) == len(texts)
        assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(i), str(want.get(of[frozenset(plain(t))]))) for i, t in texts)
    kept = simhash.one_of_each(docs(spark, texts), found=near_copies.groups(docs(spark, texts)))
    assert kept.columns == docs(spark, []).columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want.values())
    assert near_copies.groups(docs(spark, [])).count() == 0


def test_one_large_group_over_many_partitions(dealt):
    rnd = random.Random(34)
    base = [f"w{rnd.randint(0, 9000)}" for _ in range(200)]
    texts = []
    for i in range(400):
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(200)] = f"x{rnd.randint(0, 10**6)}"
        texts.append((i, " ".join(t)))
    texts += [(1000 + i, " ".join(f"y{rnd.randint(0, 10**6)}" for _ in range(50))) for i in range(50)]
    got = {r.doc_id: r.component_id for r in near_copies.groups(docs(dealt, texts)).collect()}
    assert got == {i: 0 if i < 1000 else i for i, _ in texts}


def test_no_partner_of_a_class_left_apart_is_passed_over(spark):
    """Partners past the likeliest two come next, each once, until none is left."""
    import numpy as np

    from loomwork.llm import near_copies

    samples = bytearray(np.arange(near_copies.SAMPLES, dtype="<u4").tobytes())
    nodes = spark.createDataFrame([(bytearray([i] * 16), i, 100, samples) for i in range(10)], "class binary, id long, size long, samples binary")
    links = spark.createDataFrame([(bytearray([i] * 16), bytearray([i + 1] * 16)) for i in range(8)], "a binary, b binary")  # 9 is left apart
    big = spark.createDataFrame([(1, i, 10, 0) for i in range(10)], "k long, id long, m long, x long")
    seen = [{min(r) for r in near_copies.left_apart(big, nodes, links, 0.8, 4096, done).collect()} for done in (0, 2, 6, 14)]
    assert [len(x) for x in seen[:2]] == [2, 4] and not seen[3] and sorted(i for x in seen for i in x) == list(range(9))


def test_classes_left_apart_are_linked_in_one_round(spark, monkeypatch):
    """However many of them there are, and whatever share of them links nothing, no pair is checked outside a task and no round follows."""
    rnd = random.Random(35)
    base = [f"w{rnd.randint(0, 9000)}" for _ in range(100)]
    texts = []
    for g in range(40):  # a group around each of several changes of one text, most of them below the similarity of one another
        start = list(base)
        for _ in range(3):
            start[rnd.randrange(100)] = f"g{rnd.randint(0, 10**6)}"
        for k in range(3):
            t = list(start)
            t[rnd.randrange(100)] = f"x{rnd.randint(0, 10**6)}"
            texts.append((10 * g + k, " ".join(t)))
    checked = []
    verified = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda *a: checked.append(1) or verified(*a))
    sets = [plain(t) for _, t in texts]
    name = groups(range(len(sets)), lambda a, b: alike(sets[a], sets[b]))
    got = {r.doc_id: r.component_id for r in near_copies.groups(docs(spark, texts), small=2).collect()}
    assert got == {i: texts[name[k]][0] for k, (i, _) in enumerate(texts)} and len(set(got.values())) > 1 and checked == [1]


def test_links_of_blocks_connect_what_similar_pairs_connect():
    rnd = random.Random(36)
    for _ in range(200):
        pool = [rnd.getrandbits(64) for _ in range(12)]
        a, b = ([np.array(sorted(rnd.sample(pool, rnd.randint(1, 12))), np.uint64) for _ in range(rnd.randint(1, 9))] for _ in range(2))
        of = [rnd.randrange(8) for _ in a + b]
        found = near_copies.linking(a, b, np.array(of[: len(a)]), np.array(of[len(a) :]), 0.6)
        similar = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if alike(set(x.tolist()), set(y.tolist()), 0.6)}
        assert set(found) <= similar

        def joined(pairs, of=of, n=len(a)):
            met = {(of[i], of[n + j]) for i, j in pairs}
            return groups(range(8), lambda x, y: (x, y) in met or (y, x) in met)

        assert joined(found) == joined(similar) and len(found) < 8
