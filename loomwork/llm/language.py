"""Language by cross-parsing (Ziv and Merhav, A Measure of Relative Entropy between Individual Sequences).

A suffix automaton per language holds every substring of a sample of labelled text. A text is cut into the longest
pieces that the automaton holds, each piece as long as possible; pieces times the logarithm of the sample's length, divided by the
text's length, estimate the bits a letter that the language needs for it. The language that needs fewest wins.

The sample is bounded by SAMPLE_DOCS documents and SAMPLE_LETTERS letters of each language, taken in the order of a hash of the id.
Letters are folded to lower case, other characters count as blanks and runs of blanks as one. Letters that are rare in
the sample share a few symbols. All texts of a slice are parsed side by side, whole, one letter of each at a time.

Rows: a null text, or one without a letter, has language `und` and score 0; so has every text if there's nothing to
learn from. Of languages that need equally many bits the first by name wins. Repeated rows are judged each on their own; extra columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import TextSlice, frugal, id_text, one_model, text_slices

SAMPLE_DOCS = 200
SAMPLE_LETTERS = 20_000
OWN_SYMBOLS = 128
SHARED_SYMBOLS = 32
LEAST_LETTERS = 40
MARGIN = 1.25
SLICE = 8 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Of each code point its lower-case letter, or 0 if it is no letter; marks go with the letters that they stand on."""
    out = np.zeros(sys.maxunicode + 1, np.int32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(maxsize=1)
def lettered() -> np.ndarray:
    """Whether each code point is a letter in the strict sense, not a mark."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def letters_of(text: str) -> np.ndarray:
    """Folded letters, with one 0 for each run of other characters; none at the start."""
    low = folded()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    return low[(low > 0) | (np.concatenate([[0], low[:-1]]) > 0)]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the least automaton that holds every substring; state 0 is the start."""
    move: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in symbols:
        cur = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = cur
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return move


class Model:
    """Automata of all languages in one table. An entry holds the next state's row, doubled, plus one where a new piece starts."""

    def __init__(self, samples: dict[str, str]):
        texts = {k: letters_of(v) for k, v in sorted(samples.items())}
        texts = {k: v for k, v in texts.items() if (v > 0).any()}
        self.languages = list(texts)
        count = Counter(int(c) for v in texts.values() for c in v if c)
        own = [c for c, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:OWN_SYMBOLS]]
        self.even_bits = float(np.log2(len(own) + 1))
        self.width = 1 + len(own) + SHARED_SYMBOLS
        self.symbol = (1 + len(own) + np.arange(sys.maxunicode + 1) % SHARED_SYMBOLS).astype(np.uint8)
        self.symbol[0] = 0
        self.symbol[own] = np.arange(1, len(own) + 1)
        moves = [suffix_automaton(self.symbol[letters].tolist()) for letters in texts.values()]
        states = sum(map(len, moves))
        self.table = np.empty(states * self.width, np.int32 if states * self.width < 1 << 29 else np.int64)
        first, base = [], 0
        for automaton in moves:
            part = self.table[base : base + len(automaton) * self.width].reshape(len(automaton), self.width)
            start = np.zeros(self.width, self.table.dtype)  # a symbol that the sample lacks is a piece of its own
            for c, to in automaton[0].items():
                start[c] = to
            part[:] = (start * self.width + base) * 2 + 1
            for s, m in enumerate(automaton):
                if m:
                    part[s, list(m)] = np.fromiter(m.values(), self.table.dtype, len(m)) * (2 * self.width) + 2 * base
            part[0] |= 1
            first.append(base)
            base += part.size
            automaton.clear()
        self.start = np.array([self.table[f] >> 1 for f in first], self.table.dtype)  # as after a blank
        self.cost = np.array([np.log2(len(v) + 1) for v in texts.values()])

    def symbols(self, s: TextSlice) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all rows, and where each row's begin (rows + 1 values); a row without a letter has none."""
        parts, sizes = [], []
        for lo in range(0, s.rows, 256):
            hi = min(lo + 256, s.rows)
            raw = s.data[s.offsets[lo] : s.offsets[hi]]
            points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            low = folded()[points]
            char = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[s.offsets[lo : hi + 1] - s.offsets[lo]]
            keep = low > 0
            after = np.concatenate([[False], keep[:-1]])
            after[char[:-1][char[:-1] < len(low)]] = False  # a row doesn't begin with a blank
            keep |= after
            letters = np.diff(np.concatenate([[0], np.cumsum(lettered()[points])])[char])
            if (letters == 0).any():
                keep &= np.repeat(letters > 0, np.diff(char))
            parts.append(self.symbol[low[keep]])
            sizes.append(np.diff(np.concatenate([[0], np.cumsum(keep)])[char]))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def bits(self, s: TextSlice) -> tuple[np.ndarray, np.ndarray]:
        """Bits that each language needs for each row, and the symbols of the row."""
        sym, first = self.symbols(s)
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        at, left = first[:-1][order], size[order]
        row = np.repeat(self.start[:, None], len(order), axis=1)
        pieces = np.ones((len(self.languages), len(order)), np.int32)
        live = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
        for k, n in enumerate(live.tolist()):
            v = self.table.take(row[:, :n] + sym.take(at[:n] + k))
            pieces[:, :n] += v & 1
            np.right_shift(v, 1, out=row[:, :n])
        out = np.empty(pieces.shape)
        out[:, order] = pieces * self.cost[:, None]
        return out, size

    def predict(self, s: TextSlice) -> tuple[list[str], np.ndarray]:
        """Language of each row, and its share of the likelihood 2 ** -bits of a letter, sharpened by the root of the text's length."""
        if not self.languages:
            return [UNKNOWN] * s.rows, np.zeros(s.rows)
        bits, size = self.bits(s)
        rate = bits / np.maximum(size, 1)
        best = rate.argmin(axis=0)
        share = np.exp2(-(rate - rate.min(axis=0)) * np.sqrt(size))
        none = size == 0
        return [UNKNOWN if n else self.languages[b] for n, b in zip(none, best)], np.where(none, 0.0, 1 / share.sum(axis=0))


@one_model
def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(dict(samples))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[tuple[str, str], ...]:
    """A sample of labelled text per language: whole texts until SAMPLE_LETTERS, of SAMPLE_DOCS documents at most."""
    labelled = docs.select(F.col(key).cast("long").alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    mix = F.xxhash64("key", "lang")
    least = labelled.groupBy("lang", F.pmod(mix, F.lit(SAMPLE_DOCS)).alias("slot")).agg(F.min(F.struct(mix.alias("h"), "key")).alias("m"))  # one document of each slot
    picked = least.select(F.col("lang").alias("l"), F.col("m.key").alias("k"))  # SAMPLE_DOCS rows a language at most
    found = labelled.join(F.broadcast(picked), F.expr("lang = l AND key <=> k"))
    rows = found.groupBy("lang", "key").agg(F.min(F.substring("text", 1, 2 * SAMPLE_LETTERS)).alias("text")).collect()
    out: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], hash_order(r["key"]), r["text"])):
        had = out.get(r["lang"], "")
        if len(had) < SAMPLE_LETTERS:
            out[r["lang"]] = f"{had} {r['text']}"[: 2 * SAMPLE_LETTERS]
    return tuple(sorted(out.items()))


def hash_order(key: int | None) -> int:
    return ((key or 0) * 0x9E3779B97F4A7C15) & 0xFFFFFFFF


def predict(docs: DataFrame, samples: tuple[tuple[str, str], ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score, one row per row of docs."""
    schema = pa.schema([("key", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(samples)
        for batch in batches:
            for s in text_slices(batch.column(1), SLICE):
                lang, score = model.predict(s)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.rows), pa.array(lang, pa.string()), pa.array(score)], schema=schema)

    return id_text(docs, key, text).mapInArrow(frugal(run, _model), "key long, lang_pred string, score double").withColumnRenamed("key", key)


def in_learned_language(docs: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """Rows of docs, with all their columns, whose text has a letter and is in some learned language: a text of `least` letters or more must
    need fewer bits a letter, its last piece aside, than MARGIN times what letters drawn evenly would. Keeps all rows with a letter if there's nothing to learn from."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(samples)
        for batch in batches:
            parts = [np.zeros(0, bool)]
            for s in text_slices(batch.column(place), SLICE):
                if model.languages:
                    bits, size = model.bits(s)
                    spared = ((bits - model.cost[:, None]) / np.maximum(size, 1)).min(axis=0)
                    parts.append((size > 0) & ((size < least) | (spared < MARGIN * model.even_bits)))
                else:
                    parts.append(np.array([any(lettered()[ord(c)] for c in s.text(i).decode()) for i in range(s.rows)], bool))
            yield batch.filter(pa.array(np.concatenate(parts)))

    return docs.mapInArrow(frugal(run, _model), docs.schema)


def held_out(key: str):
    """True for a fifth of the rows, by the CRC-32 of the id as text; these teach nothing."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))
