"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word is a run of letters, digits and non-ASCII characters. Its input is an embedding of the word (hashed) beside the
mean of embeddings of its character trigrams (hashed, its edges marked). Two gated recurrent networks read a window of
WINDOW words from either side; attention pools their states, and a linear layer gives the window's logit. Windows
overlap by half and cover the whole text; the text's score is its highest window's, brought to a probability by a
logistic fit on the documents learned from.

Training has labels of documents only, so a toxic document stands for its worst window, a clean one for its worst and a
few others: windows are picked by the documents' log-odds of words at first and by the network later on.
It learns from at most TOXIC_DOCS and CLEAN_DOCS documents of at most SAMPLE_CHARS characters each.

Rows: a text without words, or null, scores 0; if there's nothing to learn from, or labels of one kind only, every
score is the share of label 1 (0 where there are none). Several labels of one document count as the highest. Repeated rows are scored each
on their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import TextSlice, frugal, id_text, span_hashes, text_slices

WINDOW = 32
STRIDE = 16
WORDS, TRIGRAMS = 1 << 14, 1 << 12
WIDTH = 12
HIDDEN = 12
TOXIC_DOCS, CLEAN_DOCS = 1200, 2400
SAMPLE_CHARS = 10_000
EPOCHS = 8
SEED = 7

_LOWER = np.zeros(256, np.uint8)
_LOWER[128:] = np.arange(128, 256)
for _lo, _hi in ((48, 58), (97, 123)):
    _LOWER[_lo:_hi] = np.arange(_lo, _hi)
_LOWER[65:91] = np.arange(97, 123)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Inputs:
    """Words of a slice: hashed ids, trigram ids in order with each word's first place, and each row's first word (rows + 1 values)."""

    def __init__(self, s: TextSlice):
        low = _LOWER[s.data]
        cut = np.zeros(len(low) + 1, bool)
        cut[s.offsets] = True
        inside = low > 0
        before, after = np.zeros_like(low), np.zeros_like(low)
        before[1:], after[:-1] = low[:-1], low[1:]
        before[cut[:-1]] = after[cut[1:]] = 0
        starts = np.flatnonzero(inside & (before == 0))
        ends = np.flatnonzero(inside & (after == 0)) + 1
        self.first = np.searchsorted(starts, s.offsets)
        self.words = (span_hashes(low, starts, ends) % np.uint64(WORDS)).astype(np.int32)
        code = (before[inside].astype(np.uint32) << 16) | (low[inside].astype(np.uint32) << 8) | after[inside]
        self.grams = ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int16)
        self.sizes = ends - starts
        self.gram_at = np.cumsum(self.sizes) - self.sizes

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and end of each window, and its row."""
        n = np.diff(self.first)
        count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        row = np.repeat(np.arange(len(n)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        return self.first[:-1][row] + nth * STRIDE, self.first[1:][row], row


class Network:
    """Parameters by name, the forward pass, and gradients."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        small = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        d, h = 2 * WIDTH, HIDDEN
        self.p = {"word": small(WORDS, WIDTH, s=0.05), "gram": small(TRIGRAMS, WIDTH, s=0.1), "att": small(2 * h, h, s=0.3), "att_b": np.zeros(h, np.float32), "att_v": small(h, s=0.3), "out": small(2 * h, s=0.3), "out_b": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"in_{side}": small(d, 3 * h, s=d**-0.5), f"bias_{side}": np.zeros(3 * h, np.float32), f"rec_{side}": small(h, 3 * h, s=h**-0.5)}
        self.scale, self.shift, self.share = 1.0, 0.0, None

    def word_inputs(self, x: Inputs, lo: int, hi: int) -> np.ndarray:
        """Inputs of words lo..hi."""
        at, size = x.gram_at[lo:hi], x.sizes[lo:hi]
        grams = np.add.reduceat(self.p["gram"][x.grams[at[0] : at[-1] + size[-1]]], at - at[0], axis=0) / size[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][x.words[lo:hi]], grams], axis=1)

    def run(self, pre: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        """Logits of windows. pre: for both sides time x windows x 3 h; mask: time x windows."""
        p, h = self.p, HIDDEN
        steps, n = mask.shape
        state, trace = np.empty((steps, n, 2 * h), np.float32), {}
        for side, at in (("f", 0), ("b", h)):
            u, now, rows = p[f"rec_{side}"], np.zeros((n, h), np.float32), []
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                a, b = pre[side][t], now @ u
                zr = sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
                m = mask[t][:, None]
                nxt = now + m * (1 - z) * (new - now)
                if keep:
                    rows.append((t, now, z, r, new, b[:, 2 * h :], m))
                now = nxt
                state[t, :, at : at + h] = now
            trace[side] = rows
        e = np.tanh(state @ p["att"] + p["att_b"])
        s = np.where(mask > 0, e @ p["att_v"], np.float32(-1e9))
        w = np.exp(s - s.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnd->nd", w, state)
        logit = pooled @ p["out"] + p["out_b"][0]
        return (logit, state, e, w, pooled, trace) if keep else logit

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss, gradients of the dense parameters, and that of the inputs x (time x windows x 2 WIDTH)."""
        p, h = self.p, HIDDEN
        pre = {side: x @ p[f"in_{side}"] + p[f"bias_{side}"] for side in "fb"}
        logit, state, e, w, pooled, trace = self.run(pre, mask, keep=True)
        prob = sigmoid(logit)
        loss = float((weight * np.where(label > 0, np.logaddexp(0, -logit), np.logaddexp(0, logit))).sum())
        d_logit = (weight * (prob - label)).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * p["out"]
        d_state = w[:, :, None] * d_pool
        d_w = np.einsum("tnd,nd->tn", state, d_pool)
        d_s = w * (d_w - (w * d_w).sum(axis=0)) * (mask > 0)
        d_e = d_s[:, :, None] * p["att_v"] * (1 - e * e)
        g |= {"att_v": np.einsum("tn,tnk->k", d_s, e), "att_b": d_e.sum(axis=(0, 1)), "att": np.einsum("tnd,tnk->dk", state, d_e)}
        d_state += d_e @ p["att"].T
        d_x = np.zeros_like(x)
        for side, at in (("f", 0), ("b", h)):
            u = p[f"rec_{side}"]
            g_u, d_pre, d_now = np.zeros_like(u), np.zeros_like(pre[side]), np.zeros((x.shape[1], h), np.float32)
            for t, now, z, r, new, b_new, m in reversed(trace[side]):
                d = d_now + d_state[t, :, at : at + h]
                step = d * m
                d_z, d_new = step * (now - new), step * (1 - z)
                d_an = d_new * (1 - new * new)
                d_bn = d_an * r
                d_b = np.concatenate([d_z * z * (1 - z), d_an * b_new * r * (1 - r), d_bn], axis=1)
                d_pre[t] = np.concatenate([d_b[:, : 2 * h], d_an], axis=1)
                g_u += now.T @ d_b
                d_now = d * (1 - m * (1 - z)) + d_b @ u.T
            g[f"rec_{side}"], g[f"bias_{side}"] = g_u, d_pre.sum(axis=(0, 1))
            g[f"in_{side}"] = np.einsum("tnd,tnk->dk", x, d_pre)
            d_x += d_pre @ p[f"in_{side}"].T
        return loss, g, d_x

    def logits(self, x: Inputs, first: np.ndarray, end: np.ndarray, at_once: int = 1024) -> np.ndarray:
        """Logits of windows of the slice, in order; the words of so many windows are held at a time."""
        out = [np.zeros(0, np.float32)]
        for k in range(0, len(first), at_once):
            lo = int(first[k])
            hi = min(int(first[k : k + at_once][-1]) + WINDOW, len(x.words))
            inputs = self.word_inputs(x, lo, hi)
            at = first[k : k + at_once] + np.arange(WINDOW)[:, None]
            mask = (at < end[k : k + at_once]).astype(np.float32)
            steps = int(mask.any(axis=1).sum())
            at, mask = np.minimum(at[:steps], hi - 1) - lo, mask[:steps]
            out.append(self.run({side: (inputs @ self.p[f"in_{side}"] + self.p[f"bias_{side}"])[at] for side in "fb"}, mask))
        return np.concatenate(out)

    def scores(self, s: TextSlice) -> np.ndarray:
        """Of each row the highest window's probability."""
        if self.share is not None:
            return np.full(s.rows, self.share)
        x = Inputs(s)
        first, end, row = x.windows()
        best = np.full(s.rows, -np.inf)
        np.maximum.at(best, row, self.logits(x, first, end))
        return np.where(np.isfinite(best), sigmoid(self.scale * best + self.shift), 0.0)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]]) -> None:
        """A gradient may be given for some rows only, as (rows, values)."""
        self.t += 1
        rate = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, g in grads.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            m, v = self.m[k], self.v[k]
            m[at] = 0.9 * m[at] + 0.1 * g
            v[at] = 0.999 * v[at] + 0.001 * g * g
            self.params[k][at] -= rate * m[at] / (np.sqrt(v[at]) + 1e-7)


def _rows_sum(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some, back = np.unique(index, return_inverse=True)
    order = np.argsort(back, kind="stable")
    return some, np.add.reduceat(values[order], np.searchsorted(back[order], np.arange(len(some))), axis=0)


def log_odds(x: Inputs, label: np.ndarray) -> np.ndarray:
    """Of each hashed word, by how many documents of either label have it."""
    doc = np.repeat(np.arange(len(label)), np.diff(x.first))
    pairs = np.unique(doc.astype(np.int64) * WORDS + x.words)
    toxic = label[pairs // WORDS] > 0
    has = [np.bincount(pairs[m] % WORDS, minlength=WORDS) for m in (toxic, ~toxic)]
    n = [max(1, int((label > 0).sum())), max(1, int((label <= 0).sum()))]
    return np.log((has[0] + 0.5) / (n[0] + 1)) - np.log((has[1] + 0.5) / (n[1] + 1))


def train(texts: list[bytes], label: np.ndarray, share: float, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network from whole texts and their labels. share: of label 1 among all labelled rows, for the probability's fit."""
    net = Network(seed)
    label = np.asarray(label, np.float32)
    if not len(texts) or label.min() == label.max():
        net.share = float(share)
        return net
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    x = Inputs(TextSlice(0, len(texts), np.frombuffer(b"".join(texts), np.uint8), offsets, np.ones(len(texts), bool)))
    first, end, row = x.windows()
    if not len(first):
        net.share = float(share)
        return net
    rng = np.random.default_rng(seed + 1)
    odds = log_odds(x, label)
    net.p["word"][:, 0] = np.clip(odds / 4, -1, 1)
    worth = np.maximum.reduceat(odds[x.words], first)  # of all words up to the next window
    adam = Adam(net.p, 0.01)
    for epoch in range(epochs):
        if epoch == epochs // 2:
            adam.rate = 0.003
        if epoch >= 2:
            worth = net.logits(x, first, end)
        order = np.lexsort((rng.random(len(first)), -worth, row))
        nth = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        chosen = np.concatenate([order[nth == 0], rng.permutation(order[(nth > 0) & (label[row[order]] <= 0)])[: 2 * len(texts)]])
        rng.shuffle(chosen)
        positive = (label[row[chosen]] > 0).mean()
        for k in range(0, len(chosen), 256):
            _train_step(net, adam, x, chosen[k : k + 256], first, end, label[row[chosen[k : k + 256]]], positive)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, row, net.logits(x, first, end))
    some = np.isfinite(best)
    net.scale, net.shift = _fit(best[some], label[some], share)
    return net


def _train_step(net: Network, adam: Adam, x: Inputs, which: np.ndarray, first: np.ndarray, end: np.ndarray, label: np.ndarray, positive: float) -> None:
    at = first[which] + np.arange(WINDOW)[:, None]
    mask = (at < end[which]).astype(np.float32)
    at = np.minimum(at, len(x.words) - 1)
    words = at[mask > 0]
    size = x.sizes[words]
    gram_at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - x.gram_at[words], size)
    inputs = np.zeros((*mask.shape, 2 * WIDTH), np.float32)
    grams = np.add.reduceat(net.p["gram"][x.grams[gram_at]], np.cumsum(size) - size, axis=0) / size[:, None]
    inputs[mask > 0] = np.concatenate([net.p["word"][x.words[words]], grams], axis=1)
    weight = np.where(label > 0, 0.5 / max(positive, 1e-3), 0.5 / max(1 - positive, 1e-3)) / len(which)
    _, g, d_x = net.gradients(inputs, mask, label, weight.astype(np.float32))
    d = d_x[mask > 0]
    g["word"] = _rows_sum(x.words[words], d[:, :WIDTH])
    g["gram"] = _rows_sum(x.grams[gram_at], np.repeat(d[:, WIDTH:] / size[:, None], size, axis=0))
    adam.step(g)


def _fit(logit: np.ndarray, label: np.ndarray, share: float) -> tuple[float, float]:
    """Scale and shift of a logistic fit, with both labels weighted as among all labelled rows; Newton's steps with a little shrinkage."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    weight = np.where(label > 0, share / max(1, (label > 0).sum()), (1 - share) / max(1, (label <= 0).sum())) * len(label)
    a = np.stack([logit, np.ones_like(logit)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(30):
        p = sigmoid(a @ theta)
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(h, a.T @ (weight * (p - label)) + 1e-2 * (theta - [1.0, 0.0])), -1, 1)
    return float(max(theta[0], 0.1)), float(theta[1])


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Network:
    """A network from a bounded sample of labelled documents, in the order of a hash of the id."""
    marked = labels.select(F.col(key).cast("long").alias("key"), F.col(label).alias("y")).filter("key IS NOT NULL AND y IS NOT NULL").groupBy("key").agg(F.max("y").cast("int").alias("y"))
    n, toxic = marked.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    short = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter(F.length("text") <= SAMPLE_CHARS)
    rows = []
    for y, most in ((1, TOXIC_DOCS), (0, CLEAN_DOCS)):
        ids = marked.filter(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(most).withColumnRenamed("key", "k")
        found = short.join(F.broadcast(ids), F.expr("key = k")).groupBy("key", "y").agg(F.min("text").alias("text"))
        rows += sorted((r["key"], r["y"], r["text"]) for r in found.collect())
    return train([r[2].encode() for r in rows], np.array([r[1] for r in rows]), toxic / n if n else 0.0)


def score(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and predicted, one row per row of docs."""
    schema = pa.schema([("key", pa.int64()), ("score", pa.float64())])
    held = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size, about 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for s in text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.rows), pa.array(model.scores(s).astype(np.float64))], schema=schema)

    out = id_text(docs, key, text).mapInArrow(frugal(run), "key long, score double")
    return out.select(F.col("key").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
