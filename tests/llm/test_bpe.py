import random

import numpy as np
from loomwork.llm import bpe, token_counts
from loomwork.llm.queries import BYTE_BPE
from tokenizers import Tokenizer

from .helpers import ODD, docs


def rows_of(texts):
    body = [t.encode() for t in texts]
    return np.frombuffer(b"".join(body), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in body])]).astype(np.int64)


def test_ids_and_texts_are_the_library_s():
    rnd = random.Random(1)
    pieces = ["<|endoftext|>", "'s", "'re", " ", "  ", "\n", "\t", "a", "ab", "the", "é", "漢", "1", "!?", " ", "\U0001f642", "'"]
    texts = ["", " ", "x" * 700, "!?" * 300, "a<|endoftext|>", "<|endoftext", "aaaaaaaaaaaaa" * 40, "don't 's's ''s 'll x'll"]
    texts += ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25))) for _ in range(1500)]
    texts += ["".join(rnd.choice("abcdehilnorst '") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    own, theirs = bpe.encoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    ids, first = own.encode_rows(*rows_of(texts))
    for i, want in enumerate(theirs.encode_batch(texts, add_special_tokens=False)):
        got = ids[first[i] : first[i + 1]]
        assert got.tolist() == want.ids, texts[i]
        assert own.decode(got).decode() == theirs.decode(want.ids, skip_special_tokens=False) == texts[i]


def test_pair_check_agrees_with_exact_merging():
    own, rng = bpe.encoder(BYTE_BPE), np.random.default_rng(2)
    a, b = rng.integers(0, 50000, 3000), rng.integers(0, 50000, 3000)
    good = own._pairs_good(a, b)
    for x, y, g in zip(a, b, good):
        data, offsets = rows_of([""])
        data = np.frombuffer(own.bytes_of[x] + own.bytes_of[y], np.uint8)
        merged, _ = own.merge(data, np.array([0]), np.array([len(data)]))
        assert g == (merged.tolist() == [x, y])


def test_odd_rows(spark):
    theirs = Tokenizer.from_file(BYTE_BPE)
    got = bpe.encode(docs(spark, ODD), BYTE_BPE).collect()
    assert len(got) == len(ODD)
    want = sorted((str(i), t or "", theirs.encode(t or "", add_special_tokens=False).ids) for i, t in ODD)
    assert sorted((str(r.doc_id), r.decoded, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert bpe.encode(docs(spark, []), BYTE_BPE).count() == 0


def test_histogram_answers(spark):
    theirs = Tokenizer.from_file(BYTE_BPE)
    texts = [*ODD, *((i, "word " * (i % 7)) for i in range(20, 60))]
    hist = bpe.length_histogram(docs(spark, texts), BYTE_BPE).cache()
    n = sorted(len(theirs.encode(t or "", add_special_tokens=False).ids) for _, t in texts)
    for r in token_counts.suffix_sums(hist).collect():
        x = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (n.count(x), sum(y >= x for y in n), sum(y for y in n if y >= x))
        assert (r.docs_up_to, r.tokens_up_to, r.truncated_tokens) == (sum(y <= x for y in n), sum(y for y in n if y <= x), sum(min(x, y) for y in n))
    assert [tuple(r) for r in token_counts.at_limits(hist, [3, 512]).collect()] == [(x, sum(y > x for y in n), sum(min(x, y) for y in n)) for x in (3, 512)]
    assert [r.n_tokens for r in token_counts.quantiles(hist, [0.5, 1.0]).collect()] == [n[-(-len(n) // 2) - 1], n[-1]]
    empty = bpe.length_histogram(docs(spark, []), BYTE_BPE)
    assert token_counts.suffix_sums(empty).count() == 0
    assert [tuple(r) for r in token_counts.at_limits(empty, [5]).collect()] == [(5, 0, 0)]
    assert token_counts.quantiles(empty, [0.5]).collect()[0].n_tokens is None
