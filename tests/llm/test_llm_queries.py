"""Every registered query as a whole: columns, digests, held-out splits, and SQL or brute force."""

import hashlib
import random
import zlib

import corpus_pipeline
import duckdb
import pytest
from loomwork.llm import queries
from loomwork.llm.queries import BYTE_BPE
from tokenizers import Tokenizer

from .helpers import LOREM
from .test_decontamination import TRAIN
from .test_language import SYLLABLES, made
from .test_simhash import fingerprint, groups


def tables(spark, folder, docs, labels=(), items=(), pages=(), vectors=()):
    rows = [(i, t, g, "s", len(t or ""), "x", 1) for i, t, g in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, k int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(list(vectors), "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def some(spark, tmp_path_factory):
    rnd = random.Random(21)
    passage = " ".join(f"p{rnd.randint(0, 999)}" for _ in range(60))
    shared = [made("aa", rnd, 8) for _ in range(5)]
    docs = []
    for i in range(120):
        lang = rnd.choice(list(SYLLABLES))
        lines = [made(lang, rnd, rnd.randint(3, 9)) for _ in range(rnd.randint(1, 6))]
        if i % 7 == 0:
            lines += shared[: rnd.randint(2, 5)]
        if i % 5 == 0:
            lines.append(passage)
        if i % 11 == 0:
            lines.append(" ".join(rnd.choice(LOREM) for _ in range(30)) + " idiot")
        docs.append((i, "\n".join(lines), lang))
    docs += [(200, docs[3][1], "aa"), (201, docs[3][1].upper(), "aa"), (202, None, None), (203, "", "bb"), (204, f"Look: {TRAIN}", None), (205, "12 34", "aa")]
    vectors = [(i, [rnd.gauss(0, 1) for _ in range(8)], 0) for i in range(30)]
    vectors += [(100 + i, [x * (1 + i) + 0.01 for x in vectors[i][1]], 1) for i in range(10)] + [(300, None, 1), (301, [0.0] * 8, 1)]
    pages = [(i, f"http://{i}", "<p>" + "é" * rnd.choice([3, 600, 700]) + str(i % 3)) for i in range(40)] + [(90, None, None)]
    folder = tables(spark, tmp_path_factory.mktemp("tables"), docs, [(i, int(i % 11 == 0)) for i in range(120)], [(1, TRAIN), (2, None)], pages, vectors)
    return folder, {i: t for i, t, _ in docs}, vectors


def rows(spark, some, name):
    return queries.QUERIES[name](spark, some[0]).collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, some, name):
    duck = duckdb.connect()
    for table in ("documents", "pages"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{some[0]}/{table}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, some[0])
    want = duck.sql(queries.SQL[name])
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_scores_and_languages(spark, some):
    for name, columns in (("op3_toxicity", ["doc_id", "held_out", "score", "predicted"]), ("op4_language_id", ["doc_id", "held_out", "lang_pred", "score"])):
        got = rows(spark, some, name)
        assert list(got[0].asDict())[:4] == columns
        assert sorted(r.doc_id for r in got) == sorted(some[1])
        assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (202, 203, 205)} == {"und"} and {r.lang_pred for r in got} <= {*SYLLABLES, "und"}


def test_labels_of_held_out_rows_and_other_columns_teach_nothing(spark, some, tmp_path):
    """Other labels and languages of held-out rows, other sources: the same results."""
    docs = spark.read.parquet(f"{some[0]}/documents.parquet").collect()
    labels = [(r.doc_id, 1 - r.toxic if held_out(r.doc_id) else r.toxic) for r in spark.read.parquet(f"{some[0]}/labels.parquet").collect()]
    other = tables(spark, tmp_path, [(r.doc_id, r.text, "zz" if held_out(r.doc_id) else r.lang) for r in docs], labels)
    for name in ("op3_toxicity", "op4_language_id"):
        assert sorted(map(tuple, queries.QUERIES[name](spark, other).collect())) == sorted(map(tuple, rows(spark, some, name)))


def test_digests_of_tokens(spark, some):
    theirs = Tokenizer.from_file(BYTE_BPE)
    ids = {i: theirs.encode(t or "", add_special_tokens=False).ids for i, t in some[1].items()}
    want = {i: (len(x), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in x)).hexdigest(), hashlib.sha256(theirs.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in ids.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, some, "op10_bpe_encoding")} == want
    n = sorted(map(len, ids.values()))
    got = rows(spark, some, "op7_token_counts")
    assert {r.n_tokens: (r.n_docs, r.truncated_tokens) for r in got} == {x: (n.count(x), sum(min(x, y) for y in n)) for x in set(n)}


def test_fingerprints_and_components(spark, some):
    prints = {i: fingerprint(t) for i, t in some[1].items()}
    name = groups(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for i, f in sorted(prints.items()):
        first.setdefault(name[f], i)
    got = rows(spark, some, "op8_simhash_near_dedup")
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", first[name[f]]) for i, f in prints.items()}


def test_links_of_vectors(spark, some):
    from .test_vectors import brute

    got = rows(spark, some, "op2_embedding_near_dedup")
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute([(i, v) for i, v, _ in some[2]], 0.9)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_leaks(spark, some):
    assert [(r.doc_id, r.item_id, r.kind) for r in rows(spark, some, "op1_decontamination")] == [(204, 1, "exact")]


def test_empty_tables(spark, tmp_path):
    folder = tables(spark, tmp_path, [])
    for name, query in {**queries.QUERIES, "pipeline": corpus_pipeline.run}.items():
        assert query(spark, folder).count() == 0, name


def test_pipeline_of_repeated_rows_and_clashing_columns(spark, tmp_path):
    rnd = random.Random(22)
    text = "\n".join(made("aa", rnd, 12) for _ in range(6))
    docs = [(1, text, "aa"), (1, text, "aa"), (2, None, None), (None, made("bb", rnd, 40), "bb"), (3, made("bb", rnd, 40), "bb")]
    folder = tables(spark, tmp_path, docs, items=[(1, TRAIN)])
    stages, table = [], spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, folder)
        stages.append(sorted(str(r.doc_id) for r in table.collect()))
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars", "h", "k"]
    assert stages[0] == ["1", "1", "3", "None"] == stages[1] and stages[2] == ["1", "3", "None"] == stages[3]
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, folder).collect()) == ["1", "3", "None"]
