import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from loomwork.llm import queries, substrings

from .helpers import ODD, docs


def brute(rows, window):
    """rows in the order of documents: words kept, by looking at every window."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen, gone = set(), [set() for _ in rows]
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            piece = tuple(w[i : i + window])
            if piece in seen:
                gone[d] |= set(range(i, i + window))
            seen.add(piece)
    return [(i, len(w), len(g), " ".join(x for k, x in enumerate(w) if k not in g)) for (i, _), w, g in zip(rows, words, gone)]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))


def same(spark, rows, **settings):
    window = settings.get("window", substrings.WINDOW)
    got = sorted(map(repr, (tuple(r) for r in substrings.remove_repeats(docs(spark, rows), **settings).collect())))
    assert got == sorted(map(repr, brute(order(rows), window)))


def test_random_passages(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 4000)
    rnd = random.Random(4)
    passages = [[rnd.choice("abcdefgh") + str(rnd.randint(0, 40)) for _ in range(rnd.randint(15, 60))] for _ in range(8)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rnd.randint(0, 4)):
            text += [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(0, 30))]
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p))
            text += p[a : rnd.randint(a, len(p))]
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(text)))
    same(spark, rows)
    same(spark, rows, window=8, period=7, cover=(0, 1, 3))


def test_odd_rows(spark):
    same(spark, ODD)
    same(spark, [])
    same(spark, [(1, "a " * 100), (2, "a " * 30)])


def test_covers():
    assert substrings.covers(13, (0, 1, 3, 9)) and substrings.covers(7, (0, 1, 3)) and not substrings.covers(8, (0, 1, 3))
    with pytest.raises(ValueError):
        substrings.Settings(10, 13, (0, 1, 3, 9))


def passages_and_own_words(rnd, n):
    passages = [[f"p{rnd.randint(0, 10**6)}" for _ in range(45)] for _ in range(10)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rnd.randint(0, 4)):
            text += [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 30))] + rnd.choice(passages)
        rows.append((i, " ".join(text)))
    return rows


def test_chunks_from_several_partitions(dealt):
    same(dealt, passages_and_own_words(random.Random(8), 240))


def test_against_sql_over_several_partitions(dealt, tmp_path):
    rows = passages_and_own_words(random.Random(9), 240)
    docs(dealt, rows).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op5_substring_dedup(dealt, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql(queries.OP5_SQL).fetchall())


def test_a_mask_of_another_length_fails():
    with pytest.raises(ValueError, match="mask"):
        substrings._reply_bits(pd.DataFrame({"bucket": [0], "mask": [b"\xff\xff"]}), np.array([0, 3]))
