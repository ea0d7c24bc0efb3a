"""Benchmark decontamination by templates.

Tokens are runs of letters and digits in lower case (Latin letters with accents too); punctuation and white space
between them don't matter. Numbers, in digits or words, names and units of measure become typed slots. Each
WINDOW tokens of an item, slots included, are a template window; an item of fewer tokens is one window of its own length.
A capitalised word that begins a sentence may be a name or not, so there are two templates: one takes it for a literal, the other for a name.

Windows of documents are looked up by hash among the items' windows: by their plain values, whatever they are, and by both
templates if the window has FEW literals, words that aren't slots (or as many as the window has tokens less two). Hits of one document and item at one
distance are one alignment for each template. There each slot of the item must be filled by one value throughout, and one value may not fill two slots'
values of one kind, and the windows together must have LITERALS literals or be the whole item: then the alignment is a leak, `exact` if a whole window has the item's own values, otherwise `reparameterised`.
If the values contradict one another, only windows with the item's own values count.
An item of fewer than LEAST tokens leaks only into documents that are that item and nothing else; items without a token have no window (see `windowless`).

Benchmarks are held by every task in blocks of at most BLOCK_BYTES of text, and documents are read once a block; where there are several blocks, one task holds one of them at a time.

Rows: null, empty and short texts hit nothing but short items, and null or empty items are never hit; items without a number are left out; repeated items
count each under its number, and repeated documents each on their own; extra columns are ignored. Items of one whole template whose slots are equal
to one another at the same places fit the same documents, so only the smallest number of them is held against a text that is re-parameterised; `leaks` then names each of them,
by itself where its own values are met.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import TextSlice, frugal, id_text, mixed, span_hashes, text_slices, window_hashes
from .shared import kept, text_bytes

WINDOW = 10
LEAST = 5
FEW = 3
LITERALS = 6
BLOCK_BYTES = 16 << 20
#: Rows that are named at once where one item stands for others.
NAMED = 1 << 18

UNITS = (
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds "
    "ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur mph kmh degree degrees percent watt watts volt volts byte bytes kb mb gb tb meter meters metre metres kilometer kilometers"
).split()

NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()

_LOWER = np.zeros(256, np.uint8)
_LOWER[128:] = np.arange(128, 256)
_LOWER[48:58] = np.arange(48, 58)
_LOWER[97:123] = _LOWER[65:91] = np.arange(97, 123)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;|\n\r\"()[]"]] = True
LITERAL, NUMBER, NAME, UNIT = range(4)
SLOTS = mixed(np.arange(101, 105, dtype=np.uint64))


class Tokens:
    """Tokens of a slice: the hash of each one's value, each row's first token (rows + 1 values), and for both templates each token's kind and its template hash."""

    def __init__(self, s: TextSlice):
        raw, low = s.data, _LOWER[s.data]
        cut = np.zeros(len(raw) + 1, bool)
        cut[s.offsets] = True
        digit = (raw >= 48) & (raw <= 57)
        if len(raw) > 2:  # a point or comma between digits belongs to the number; a row never ends between them
            mark = (raw[1:-1] == 46) | (raw[1:-1] == 44)
            mark &= digit[:-2] & digit[2:] & ~cut[1:-2] & ~cut[2:-1]
            low[1:-1][mark] = raw[1:-1][mark]
        upper = (raw >= 65) & (raw <= 90)
        if len(raw) > 1:  # U+00C0..U+00DE
            second = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
            low[1:][second] += 32
            upper[:-1] |= second
        inside = low > 0
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[cut[:-1]] = after[cut[1:]] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(starts, s.offsets)
        self.value = span_hashes(low, starts, ends)
        stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
        fresh = np.ones(len(starts), bool)
        fresh[1:] = stops[starts[1:]] > stops[ends[:-1]]
        fresh[self.first[:-1][self.first[:-1] < len(starts)]] = True
        second_at = np.minimum(starts + np.where(raw[starts] == 0xC3, 2, 1), max(0, len(raw) - 1)) if len(starts) else starts
        capital = upper[starts] & (second_at < ends) & ~upper[second_at]
        unit, number = np.isin(self.value, word_hashes(tuple(UNITS))), digit[starts] | np.isin(self.value, word_hashes(tuple(NUMBER_WORDS)))
        self.kinds, self.templates = [], []
        for name in (capital & ~fresh, capital):
            kind = np.zeros(len(starts), np.int8)
            kind[name] = NAME
            kind[unit] = UNIT
            kind[number] = NUMBER
            self.kinds.append(kind)
            self.templates.append(np.where(kind == LITERAL, self.value, SLOTS[kind]))


@lru_cache
def word_hashes(words: tuple[str, ...]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words])
    return np.sort(span_hashes(np.frombuffer("".join(words).encode(), np.uint8), np.concatenate([[0], ends[:-1]]), ends))


def _slice_of(texts: list[str]) -> TextSlice:
    body = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in body])]).astype(np.int64)
    return TextSlice(0, len(body), np.frombuffer(b"".join(body), np.uint8), offsets, np.ones(len(body), bool))


class Benchmark:
    """Windows of items by length, of plain values and of both templates: sorted hashes, and the place of each."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.window = window
        items = sorted(items)
        t = Tokens(_slice_of([x[1] for x in items]))
        self.ids = [x[0] for x in items]
        self.first, self.value, self.kinds = t.first, t.value, t.kinds
        self.lead = self._leads(t)
        self.leads = self.lead == np.arange(len(items))
        order = np.argsort(self.lead, kind="stable")
        self.members = np.split(order, np.searchsorted(self.lead[order], np.arange(1, len(items)))) if items else []
        size = np.diff(t.first)
        item = np.repeat(np.arange(len(items)), size)
        self.tables = {}
        for n in sorted({min(window, int(k)) for k in size if k}):
            at = np.arange(max(0, len(t.value) - n + 1))
            at = at[(item[at] == item[at + n - 1]) & ((n == window) | (size[item[at]] == n))]
            few = []
            for kind in t.kinds:
                sums = np.concatenate([[0], np.cumsum(kind == LITERAL)])
                few.append(at[sums[at + n] - sums[at] >= max(1, min(FEW, n - 2))] if n >= LEAST else at[:0])
            self.tables[n] = [self._table(window_hashes(x, n), some) for x, some in zip((t.value, *t.templates), (at, *few))]
        self.n_windows = [max(0, int(k) - window + 1) if k >= window else int(k > 0) for k in size]

    @staticmethod
    def _table(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = h[at]
        order = np.argsort(h, kind="stable")
        near = np.zeros(1 << 16, bool)
        near[(h >> np.uint64(48)).astype(np.int64)] = True
        return h[order], at[order].astype(np.int32), near

    @staticmethod
    def _leads(t: Tokens) -> np.ndarray:
        """Of each item the first of its whole template with its pattern of equal slots."""
        seen, out = {}, np.zeros(len(t.first) - 1, np.int64)
        for i, (lo, hi) in enumerate(zip(t.first[:-1], t.first[1:])):
            kind, value, number = t.kinds[1][lo:hi], t.value[lo:hi], {}  # all slots of the other template are among these
            slots = kind != LITERAL
            pattern = tuple(number.setdefault(x, len(number)) for x in zip(kind[slots].tolist(), value[slots].tolist()))
            out[i] = seen.setdefault((*(x[lo:hi].tobytes() for x in t.templates), pattern), i)
        return out

    def hits(self, n: int, table: tuple[np.ndarray, np.ndarray, np.ndarray], h: np.ndarray, t: Tokens, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of windows in documents, of those in items, the items, and whether the values are equal too, by all of equal hash (h: of the documents)."""
        hashes, places, near = table
        fits = near[(h >> np.uint64(48)).astype(np.int64)] & (row_of[: len(h)] == row_of[n - 1 :])
        if n < LEAST:
            fits &= np.diff(t.first)[row_of[: len(h)]] == n
        at = np.flatnonzero(fits)
        lo, hi = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
        count = hi - lo
        at, lo, count = at[count > 0], lo[count > 0], count[count > 0]
        where = np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at, place = np.repeat(at, count), places[where].astype(np.int64)
        return at, place, np.searchsorted(self.first, place, side="right") - 1, (t.value[at[:, None] + np.arange(n)] == self.value[place[:, None] + np.arange(n)]).all(axis=1)

    def _met(self, t: Tokens) -> tuple[dict, dict, dict]:
        """Of each row and item any of whose own values are met, or that leads others: kind, windows met and windows with own values of each alignment; of each row and lead those of the items
        that it stands for, none of whose own values are met; and of each row and lead the items with own values."""
        found, stood, owners = defaultdict(list), defaultdict(list), defaultdict(set)
        row_of = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
        for n, (plain, *typed) in self.tables.items():
            if len(t.value) < n:
                continue

            def runs(table: tuple, words: np.ndarray, use: Callable) -> dict[tuple[int, int, int], list[int]]:
                at, place, item, same = self.hits(n, table, window_hashes(words, n), t, row_of)
                some, out = use(item, same), defaultdict(list)
                for a, p, i, r in zip(at[some].tolist(), place[some].tolist(), item[some].tolist(), row_of[at[some]].tolist()):
                    out[r, i, a - p].append(p)
                return out

            exact = runs(plain, t.value, lambda item, same: same)
            for (r, i, _), own in exact.items():
                found[r, i].append(("exact", len(own), len(own)))
                owners[r, int(self.lead[i])].add(i)
            for k, table in enumerate(typed):
                for (r, i, shift), places in runs(table, t.templates[k], lambda item, same: self.leads[item]).items():
                    if rest := self._fits(t, k, n, i, shift, places):
                        stood[r, i].append(("reparameterised", len(places), 0))
                    for j in owners.get((r, i), ()):
                        by = int(self.first[i] - self.first[j])
                        own = exact.get((r, j, shift + by), [])
                        other = sorted({p - by for p in places}.difference(own))
                        if other and (self._fits(t, k, n, j, shift + by, own + other) if own else rest):
                            found[r, j].append(("exact" if own else "reparameterised", len(own) + len(other), len(own)))
        return found, stood, owners

    def leaks(self, t: Tokens) -> list[tuple[int, int, str, int, int, int]]:
        """Row, item, kind, windows met, windows with the item's own values, windows of the item; one item for all that it stands for and whose own values aren't met."""
        found, stood, owners = self._met(t)
        every = {**found, **{k: v for k, v in stood.items() if k[1] not in owners.get(k, ())}}
        return [(r, i, *self._most(v), self.n_windows[i]) for (r, i), v in sorted(every.items())]

    def pairs(self, t: Tokens) -> Iterator[list[np.ndarray]]:
        """The columns of leaks, of every item by itself, up to NAMED rows or one row's items of a template at a time."""
        found, stood, owners = self._met(t)
        parts, n = [], 0
        for (r, i), v in found.items():
            parts.append(([i], r, *self._most(v), self.n_windows[i]))
        n = len(parts)
        for (r, i), v in stood.items():
            own = owners.get((r, i), ())
            items = self.members[i] if not own else np.setdiff1d(self.members[i], list(own))
            parts.append((items, r, *self._most(v), self.n_windows[i]))
            n += len(items)
            if n >= NAMED:
                yield self._columns(parts)
                parts, n = [], 0
        if n:
            yield self._columns(parts)

    @staticmethod
    def _most(v: list[tuple[str, int, int]]) -> tuple[str, int, int]:
        return min(x[0] for x in v), max(x[1] for x in v), max(x[2] for x in v)

    @staticmethod
    def _columns(parts: list[tuple]) -> list[np.ndarray]:
        items, r, *rest = zip(*parts)
        size = [len(x) for x in items]
        each = lambda x: np.repeat(np.array(x, object if isinstance(x[0], str) else np.int64), size)
        return [each(r), np.concatenate(items).astype(np.int64), *map(each, rest)]

    def _fits(self, t: Tokens, template: int, n: int, item: int, shift: int, places: list[int]) -> bool:
        """Whether these windows are enough of the item, and slots' values map one to one over all their tokens."""
        at = np.unique(np.add.outer(places, np.arange(n)))
        kind = self.kinds[template]
        slots = at[kind[at] != LITERAL]
        if len(at) - len(slots) < LITERALS and len(at) < self.first[item + 1] - self.first[item]:
            return False
        to: dict[tuple[int, int], int] = {}
        back: dict[tuple[int, int], int] = {}
        for k, a, b in zip(kind[slots].tolist(), self.value[slots].tolist(), t.value[slots + shift].tolist()):
            if to.setdefault((k, a), b) != b or back.setdefault((k, b), a) != a:
                return False
        return True


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[Benchmark]:
    some = id_text(items, key, text).filter("key IS NOT NULL AND text IS NOT NULL")
    n = 1 + text_bytes(some, "text") // BLOCK_BYTES
    for k in range(n):
        yield Benchmark([(r["key"], r["text"]) for r in some.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == k).collect()])


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item, kind, n_windows met, n_exact of them, item_windows: one row per document and item that leaks into it."""
    fields = [(key, pa.int64()), (item, pa.int64()), ("kind", pa.string()), ("n_windows", pa.int64()), ("n_exact", pa.int64()), ("item_windows", pa.int64())]
    schema, out = pa.schema(fields), None
    for bench in _blocks(items, item, item_text):
        held = docs.sparkSession.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            bench = held.value
            for batch in batches:
                for s in text_slices(batch.column(1)):
                    for r, i, *rest in bench.pairs(Tokens(s)):
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.rows).take(pa.array(r)), pa.array(np.array(bench.ids, np.int64)[i]), *(pa.array(x, f.type) for x, f in zip(rest, list(schema)[2:]))], schema=schema)

        part = id_text(docs, key, text).mapInArrow(frugal(run), f"{key} long, {item} long, kind string, n_windows long, n_exact long, item_windows long")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of docs, with all their columns, into which no item leaks."""
    place = docs.columns.index(text)
    for k, bench in enumerate(_blocks(items, item, item_text)):
        docs = kept(docs) if k else docs
        held = docs.sparkSession.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for s in text_slices(batch.column(place)):
                    clean[[s.lo + x[0] for x in held.value.leaks(Tokens(s))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(frugal(run), docs.schema)
    return docs


def windowless(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """key of the items that nothing can be held against: no number, no text, or no token in it."""
    token = F.coalesce(F.col(text).rlike("[0-9A-Za-z]|[^\\x00-\\x7F]"), F.lit(False))
    return items.filter(F.col(key).isNull() | ~token).select(F.col(key).cast("long").alias(key))
