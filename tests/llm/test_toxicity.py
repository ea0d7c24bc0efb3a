import random

import numpy as np
import pyarrow as pa
from loomwork.llm import toxicity
from loomwork.llm.batches import text_slices

from .helpers import LOREM, ODD, docs


def test_gradients(monkeypatch):
    net, rng = toxicity.Network(), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = rng.standard_normal((5, 3, 2 * toxicity.WIDTH)), np.ones((5, 3))
    mask[3:, 1] = 0
    label, weight = np.array([1.0, 0, 1]), np.ones(3)
    _, g, d_x = net.gradients(x, mask, label, weight)

    def slope(a, at):
        old, out = a[at], []
        for e in (1e-3, -1e-3):
            a[at] = old + e
            out.append(net.gradients(x, mask, label, weight)[0])
        a[at] = old
        return (out[0] - out[1]) / 2e-3

    for k in g:
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in net.p[k].shape)
            assert abs(slope(net.p[k], at) - g[k][at]) < 1e-3 * max(1, abs(g[k][at]))
    assert abs(slope(x, (2, 0, 4)) - d_x[2, 0, 4]) < 1e-3


def made(rnd, toxic, n=None):
    w = [rnd.choice(LOREM) for _ in range(n or rnd.randint(5, 200))]
    if toxic:
        w[rnd.randrange(len(w))] = rnd.choice(["idiot", "Moron!", "trash."])
    return " ".join(w)


def test_held_out_accuracy():
    rnd = random.Random(3)
    label = [i % 4 == 0 for i in range(600)]
    texts = [made(rnd, t) for t in label]
    net = toxicity.train([t.encode() for t in texts[:400]], np.array(label[:400], int), 0.25)
    (s,) = text_slices(pa.array(texts[400:]), 1 << 24)
    assert ((net.scores(s) >= 0.5) == np.array(label[400:])).mean() > 0.95
    (s,) = text_slices(pa.array([made(rnd, False, 3000) + " idiot " + made(rnd, False, 3000)]), 1 << 24)
    assert net.scores(s)[0] > 0.5  # whole texts are read


def test_windows_cover_all_words():
    (s,) = text_slices(pa.array(["a " * n for n in (0, 1, 31, 32, 33, 48, 49, 100)]), 1 << 24)
    x = toxicity.Inputs(s)
    first, end, row = x.windows()
    for i in range(s.rows):
        seen = {w for f, e in zip(first[row == i], end[row == i]) for w in range(f, min(e, f + toxicity.WINDOW))}
        assert seen == set(range(x.first[i], x.first[i + 1]))


def test_odd_rows(spark):
    rnd = random.Random(4)
    rows = [(i, made(rnd, i % 3 == 0)) for i in range(100, 160)] + ODD
    table = docs(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(100, 160)] + [(100, 1, 0), (None, 1, 1), (101, 0, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(table, toxicity.learn(table, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2, 3)} == {0.0}
    none = toxicity.score(table, toxicity.learn(table, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score(docs(spark, []), toxicity.learn(table, labels.limit(0))).count() == 0


def test_scores_against_a_plain_forward_pass():
    """The same network, one window and one number at a time."""
    rnd, h = random.Random(6), toxicity.HIDDEN
    net = toxicity.train([made(rnd, k % 3 == 0).encode() for k in range(60)], np.arange(60) % 3 == 0, 0.3, epochs=2)
    texts = ["", "one", "It's ÜBER-nice, idiot!", made(rnd, True, 90), made(rnd, False, 33)]
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    one = lambda x: 1 / (1 + np.exp(-x))

    def words(text):
        low = "".join(c if ord(c) > 127 else c.lower() if c.isalnum() else " " for c in text).split()
        return [w.encode() for w in low]

    def embedded(word):
        number = int(toxicity.span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0] % np.uint64(toxicity.WORDS))
        around = b"\0" + word + b"\0"
        grams = [((around[k] << 16 | around[k + 1] << 8 | around[k + 2]) * 0x9E3779B1 % (1 << 32)) >> 20 for k in range(len(word))]
        return np.concatenate([p["word"][number], sum(p["gram"][g] for g in grams) / len(grams)])

    def passed(side, xs):
        now, out = np.zeros(h), []
        for x in xs:
            a, b = x @ p[f"in_{side}"] + p[f"bias_{side}"], now @ p[f"rec_{side}"]
            z, r = one(a[:h] + b[:h]), one(a[h : 2 * h] + b[h : 2 * h])
            now = z * now + (1 - z) * np.tanh(a[2 * h :] + r * b[2 * h :])
            out.append(now)
        return out

    def logit(xs):
        states = [np.concatenate(s) for s in zip(passed("f", xs), passed("b", xs[::-1])[::-1])]
        worth = np.array([np.tanh(s @ p["att"] + p["att_b"]) @ p["att_v"] for s in states])
        share = np.exp(worth - worth.max())
        return (share / share.sum()) @ np.array(states) @ p["out"] + p["out_b"][0]

    (s,) = text_slices(pa.array(texts), 1 << 24)
    for text, got in zip(texts, net.scores(s)):
        xs = [embedded(w) for w in words(text)]
        starts = range(0, max(1, len(xs) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
        want = one(net.scale * max(logit(xs[k : k + toxicity.WINDOW]) for k in starts) + net.shift) if xs else 0.0
        assert abs(got - want) < 1e-4
