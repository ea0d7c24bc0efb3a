"""Byte-level BPE by speculation: a greedy longest match proposes tokens, a check of every adjacent pair verifies them, and only words that fail are merged exactly.

A row of tokens is what merging by rank gives, exactly if each token is what its own bytes merge to and each adjacent
pair is what the pair's bytes merge to. A pair fails if a merge across its boundary comes before the merges that
built its two sides: on the right edge of the left token and the left edge of the right token every pair of parts that
exist at the same time is looked up among the merges.

Texts: null counts as empty and gives no ids; special tokens written in a text become their ids, as the tokenizers
library does; any text may be arbitrarily long. Repeated rows are encoded each on their own, and extra columns are ignored.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import frugal, id_text, one_model, text_slices

NEVER = np.int64(1 << 40)
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """White space, letter, number or other for each code point."""
    kinds = np.full(sys.maxunicode + 1, _OTHER, dtype=np.uint8)
    major = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    kinds[[i for i, m in enumerate(major) if m == "L"]] = _LETTER
    kinds[[i for i, m in enumerate(major) if m == "N"]] = _NUMBER
    kinds[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return kinds


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, then the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Pairs of tokens to values in an open-addressed table, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int):
        self.mask, self.shift = np.int64((1 << bits) - 1), np.int64(min(40, 64 - bits))
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, NEVER, dtype=np.int64)
        self.probes = 0
        at, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several, the last one stays
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(-7046029254386353131)) >> self.shift) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot(keys)
        found = np.where(self.keys[at] == keys, self.values[at], NEVER)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            k = self.keys[at[open_]]
            hit = k == keys[open_]
            found[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (k >= 0)]
        return found


class Bpe:
    """The encoder and decoder of one byte-level vocabulary, given as the bytes of its file."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        model, letters = spec["model"], byte_letters()
        plain = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*plain.values(), *special.values()]) + 1
        self.special = {k.encode(): v for k, v in special.items()}
        self.bytes_of = [b""] * self.size
        for k, v in (plain | self.special).items():
            self.bytes_of[v] = k
        self.byte_id = np.array([plain[bytes([b])] for b in range(256)], dtype=np.int64)
        self._merges([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["vocab"])
        self._trie(plain)
        self._flat()
        self.known_keys = np.full(1 << 21, -1, dtype=np.int64)
        self.known_good = np.zeros(1 << 21, dtype=bool)

    def _merges(self, merges: list[tuple[str, str]], vocab: dict[str, int]) -> None:
        """Rank of each merge, what it makes, and of each token its rank and its two parts."""
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.merge_rank = PairTable(left * self.size + right, np.arange(len(merges), dtype=np.int64), max(19, (2 * len(merges)).bit_length()))
        self.rank = np.full(self.size, -1, dtype=np.int64)
        self.left, self.right = np.full(self.size, -1, dtype=np.int64), np.full(self.size, -1, dtype=np.int64)
        self.rank[self.made], self.left[self.made], self.right[self.made] = np.arange(len(merges)), left, right

    def _trie(self, plain: dict[bytes, int]) -> None:
        """Nodes that have children come first, so that a row of the table is kept for these alone."""
        inner = {p: 0 for t in plain for k in range(len(t)) for p in [t[:k]]}
        inner = {p: i for i, p in enumerate(sorted(inner, key=len))}
        nodes = inner | {t: len(inner) + i for i, t in enumerate(t for t in plain if t not in inner)}
        self.inner = len(inner)
        self.child = np.zeros(len(inner) * 256, dtype=np.int32)
        self.token_at = np.full(len(nodes), -1, dtype=np.int32)
        for prefix, i in nodes.items():
            if prefix:
                self.child[inner[prefix[:-1]] * 256 + prefix[-1]] = i
        for piece, i in plain.items():
            if len(piece) == 1 or self.rank[i] >= 0:  # a token that no merge makes is never proposed
                self.token_at[nodes[piece]] = i

    def _flat(self) -> None:
        self.token_len = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.token_data = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)

    # --- words -----------------------------------------------------------------------------------------------

    def _plain_words(self, text: str, cuts: np.ndarray) -> np.ndarray:
        """Byte offsets at which the words of a text without special tokens start, and its length; a word never crosses one of cuts (offsets in code points)."""
        cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        n = len(cp)
        if not n:
            return np.zeros(1, dtype=np.int64)
        kind = char_classes()[cp]
        cut = np.zeros(n + 1, dtype=bool)
        cut[cuts] = cut[0] = cut[n] = True
        change = cut[:n].copy()
        change[1:] |= kind[1:] != kind[:-1]
        blank, first = cp == 32, cut[:n]
        start = change.copy()
        # The last white space before another character stands alone or, if it is a blank, joins what follows.
        last_space = np.zeros(n, dtype=bool)
        last_space[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~cut[1:n]
        start |= last_space
        joined = np.zeros(n, dtype=bool)
        joined[1:] = last_space[:-1] & blank[:-1]
        start &= ~(joined & ~first)
        # 's 't 're 've 'm 'll 'd where an apostrophe begins a word.
        for at in np.flatnonzero((cp == 39) & start):
            tail = text[at + 1 : at + 3]
            size = 1 if tail[:1] in ("s", "t", "m", "d") and tail else 2 if tail in ("re", "ve", "ll") else 0
            if size and not cut[at + 1 : at + 1 + size].any():
                start[at + 1 : at + 1 + size] = False
                if at + 1 + size < n:
                    start[at + 1 + size] = True
        width = np.where(cp < 0x80, 1, np.where(cp < 0x800, 2, np.where(cp < 0x10000, 3, 4)))
        ends = np.cumsum(width)
        return np.concatenate([(ends - width)[start], ends[-1:]])

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets of words over rows (with the end), and for each word the id of the special token that it is, or -1."""
        raw = data.tobytes()
        cut_bytes, marks = {int(x) for x in offsets}, {}
        for piece, i in self.special.items():
            at = raw.find(piece)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(piece) <= offsets[row + 1]:
                    cut_bytes |= {at, at + len(piece)}
                    marks[at] = (len(piece), i)
                at = raw.find(piece, at + len(piece) if at in marks else at + 1)
        char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        cuts = char[np.array(sorted(cut_bytes), dtype=np.int64)]
        starts = self._plain_words(raw.decode("utf-8"), cuts)
        special = np.full(len(starts) - 1, -1, dtype=np.int64)
        if marks:
            inside = np.zeros(len(starts), dtype=bool)
            for at, (size, i) in marks.items():
                k = np.searchsorted(starts, at)
                inside[k + 1 : np.searchsorted(starts, at + size)] = True
                special[k] = i
            keep = ~inside
            starts, special = starts[keep], special[keep[:-1]]
        return starts, special

    # --- tokens ----------------------------------------------------------------------------------------------

    def propose(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches in each word: tokens in order, and how many each word has."""
        lane, pos, stop = np.arange(len(begin)), begin.copy(), end
        rounds = []
        while len(lane):
            best, reach = np.full(len(lane), -1, dtype=np.int32), pos.copy()
            live, node, at = np.arange(len(lane)), np.zeros(len(lane), dtype=np.int32), pos.copy()
            limit = stop
            while len(live):
                node = self.child[node.astype(np.int64) * 256 + data[at]]
                at = at + 1
                token = self.token_at[node]
                hit = (node > 0) & (token >= 0)
                where = live[hit]
                best[where], reach[where] = token[hit], at[hit]
                go = (node > 0) & (node < self.inner) & (at < limit)
                live, node, at, limit = live[go], node[go], at[go], limit[go]
            rounds.append((lane, best))
            more = reach < stop
            lane, pos, stop = lane[more], reach[more], stop[more]
        counts = np.zeros(len(begin), dtype=np.int64)
        for who, _ in rounds:
            counts[who] += 1
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.int64)
        for k, (who, token) in enumerate(rounds):
            out[first[who] + k] = token
        return out, counts

    def _pairs_good(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of each pair merge to just that pair."""
        good, who = np.ones(len(a), dtype=bool), np.arange(len(a))
        a, b = a.copy(), b.copy()
        over_a, over_b = np.full(len(a), NEVER), np.full(len(a), NEVER)  # rank at which the part goes into a larger one
        while len(who):
            r = self.merge_rank.get(a * self.size + b)
            bad = (r < over_a) & (r <= over_b)
            good[who[bad]] = False
            back_a = self.rank[a] >= self.rank[b]  # the part made later is taken apart
            go = ~bad & np.where(back_a, self.rank[a] >= 0, self.rank[b] >= 0)
            who, a, b, over_a, over_b, back_a = who[go], a[go], b[go], over_a[go], over_b[go], back_a[go]
            over_a, over_b = np.where(back_a, self.rank[a], over_a), np.where(back_a, over_b, self.rank[b])
            a, b = np.where(back_a, self.right[a], a), np.where(back_a, b, self.left[b])
        return good

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_pairs_good, of which answers are remembered in a table of fixed size."""
        keys = a * self.size + b
        at = ((keys * np.int64(-7046029254386353131)) >> np.int64(40)) & np.int64(len(self.known_keys) - 1)
        good = self.known_good[at]
        new = np.flatnonzero(self.known_keys[at] != keys)
        if len(new):
            some, back = np.unique(keys[new], return_inverse=True)
            answer = self._pairs_good(some // self.size, some % self.size)
            good[new] = answer[back]
            self.known_keys[at[new]] = keys[new]
            won = self.known_keys[at[new]] == keys[new]  # of keys that share a place, one stays
            self.known_good[at[new[won]]] = good[new[won]]
        return good

    def merge(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging by rank of each word: tokens in order, and how many each word has."""
        size = end - begin
        first = np.cumsum(size) - size
        total = int(size.sum())
        sym = self.byte_id[data[np.arange(total) - np.repeat(first - begin, size)]]
        word = np.repeat(np.arange(len(begin)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            rank = np.full(len(sym), NEVER)
            same = word[1:] == word[:-1]
            rank[:-1][same] = self.merge_rank.get(sym[:-1][same] * self.size + sym[1:][same])
            heads = np.flatnonzero(np.concatenate([[True], ~same]))
            length = np.diff(np.concatenate([heads, [len(sym)]]))
            least = np.repeat(np.minimum.reduceat(rank, heads), length)
            over = least == NEVER
            if over.any():
                done.append((word[over], sym[over]))
                sym, word, rank, least = sym[~over], word[~over], rank[~over], least[~over]
                if not len(sym):
                    break
            hit = rank == least
            run = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
            at = np.flatnonzero(hit)
            since = at - run[np.searchsorted(run, at, side="right") - 1]
            at = at[since % 2 == 0]  # in a row of overlapping pairs, every other one from the left
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        word = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        sym = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(begin))

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in order, and of each row its first id's place (rows + 1 values)."""
        starts, special = self.words(data, offsets)
        begin, end = starts[:-1], starts[1:]
        plain = np.flatnonzero(special < 0)
        tokens, counts = self.propose(data, begin[plain], end[plain])
        word = np.repeat(np.arange(len(plain)), counts)
        same = word[1:] == word[:-1]
        bad = np.zeros(len(plain), dtype=bool)
        fits = self.compatible(tokens[:-1][same], tokens[1:][same])
        bad[word[1:][same][~fits]] = True
        parts = [(plain[~bad], counts[~bad], tokens[~bad[word]])]
        if bad.any():
            again = plain[bad]
            exact, n = self.merge(data, begin[again], end[again])
            parts.append((again, n, exact))
        marked = np.flatnonzero(special >= 0)
        parts.append((marked, np.ones(len(marked), dtype=np.int64), special[marked]))
        total = np.zeros(len(begin), dtype=np.int64)
        for who, n, _ in parts:
            total[who] = n
        first = np.concatenate([[0], np.cumsum(total)])
        ids = np.empty(int(first[-1]), dtype=np.int64)
        for who, n, t in parts:
            inner = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
            ids[np.repeat(first[who], n) + inner] = t
        return ids, first[np.searchsorted(begin, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text of ids; bytes that form no character become U+FFFD."""
        size = self.token_len[ids]
        first = np.cumsum(size) - size
        flat = self.token_data[np.arange(int(size.sum())) - np.repeat(first - self.token_start[ids], size)].tobytes()
        return flat.decode("utf-8", errors="replace").encode("utf-8")


@one_model
def _built(vocabulary: bytes) -> Bpe:
    return Bpe(vocabulary)


def encoder(path: str) -> Bpe:
    return _built(Path(path).read_bytes())


def _mapped(docs: DataFrame, path: str, make: Callable[[Bpe, np.ndarray], list], schema: pa.Schema, count_only: bool = False) -> Callable:
    """The driver reads the vocabulary's file and sends its bytes, a few megabytes whatever the documents are, so executors need no such file."""
    held = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _built(held.value)
        for batch in batches:
            keys = batch.column(0)
            for s in text_slices(batch.column(1)):
                ids, first = bpe.encode_rows(s.data, s.offsets)
                n = pa.array(np.diff(first))
                more = [] if count_only else [pa.array(c) for c in zip(*(make(bpe, ids[first[i] : first[i + 1]]) for i in range(s.rows)))]
                yield pa.RecordBatch.from_arrays([keys.slice(s.lo, s.rows), n, *more], schema=schema)

    return frugal(run, _built)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (little-endian unsigned 32-bit integers) and the decoded text, one row per row of docs."""
    fields = [(key, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())]
    make = lambda bpe, ids: (ids.astype("<u4").tobytes(), bpe.decode(ids).decode())
    return id_text(docs, key, text).mapInArrow(_mapped(docs, path, make, pa.schema(fields)), f"{key} long, n_tokens long, ids binary, decoded string")


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and n_tokens, one row per row of docs."""
    fields = [(key, pa.int64()), ("n_tokens", pa.int64())]
    return id_text(docs, key, text).mapInArrow(_mapped(docs, path, None, pa.schema(fields), True), f"{key} long, n_tokens long")


def length_histogram(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """n_tokens and n_docs: how many documents encode to each length. Lengths are summed up in each task first."""
    return token_counts(docs, path, key, text).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
