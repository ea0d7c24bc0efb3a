import random
from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa
from loomwork.llm import bpe, language
from loomwork.llm.batches import frugal
from loomwork.llm.queries import BYTE_BPE
from tokenizers import Tokenizer

from .test_decontamination import TRAIN
from .test_language import SYLLABLES, made
from .test_lines import brute
from .test_near_copies import alike, plain
from .test_simhash import groups


def edited(rnd, lang, text):
    """Most lines of a text with a word changed in each, so that no line repeats."""
    return "\n".join(" ".join([made(lang, rnd, 1), *line.split(" ")[1:]]) for line in text.split("\n"))


def test_against_brute_force(spark, tmp_path):
    rnd = random.Random(9)
    langs = {i: rnd.choice(list(SYLLABLES)) for i in range(60)}
    rows = [(i, "\n".join(made(k, rnd, 12) for _ in range(6))) for i, k in langs.items()]
    rows += [(100, rows[3][1]), (101, rows[3][1] + " x"), *((110 + k, edited(rnd, langs[k], rows[k][1])) for k in range(10)), (102, "\n".join(["own one", *rows[5][1].split("\n")[1:5], "own two"])), (103, made("aa", rnd, 50) + " " + TRAIN), (104, None), (105, "12 34"), (106, "")]
    table = spark.createDataFrame([(i, t, langs.get(i), "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, TRAIN)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(i, t) for i, t in rows if language.letters_of(t or "").any()]
    left = [(int(i), t) for i, t, _, _ in brute(left, 3)]
    sets = {i: plain(t) for i, t in left}
    name = groups(sorted(sets), lambda a, b: alike(sets[a], sets[b]))
    firsts = {}
    for i, g in sorted(name.items()):
        firsts.setdefault(g, i)
    want = {i: t for i, t in left if i in firsts.values() and i != 103}
    theirs = Tokenizer.from_file(BYTE_BPE)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == {i: theirs.encode(t, add_special_tokens=False).ids for i, t in want.items()}
    assert len(got) == len(want)
    docs = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == table.columns


def test_worker_holds_one_model_and_small_batches(spark):
    """One worker runs all stages: it drops the model of one operator when another needs its own or none, and no batch is much over the bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rnd = random.Random(4)
    text = "\n".join(made("aa", rnd, 12) for _ in range(6))
    docs = spark.createDataFrame([(i, text + f" {i}", "aa", "s", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    vocabulary = Path(BYTE_BPE).read_bytes()

    def models(batches):
        from loomwork.llm.batches import _MODEL

        def run(rest, own=None):
            for b in rest:
                if own:
                    own()
                yield [k[1] for k in _MODEL]

        batches = list(batches)
        seen = [list(frugal(lambda x, own=own: run(x, own), model)(batches))[-1] for own, model in ((lambda: language._model((("aa", "some text"),)), language._model), (lambda: bpe._built(vocabulary), bpe._built), (None, bpe._built), (None, None))]
        yield pa.RecordBatch.from_pydict({"names": [",".join(x) for x in seen], "most": [max(b.nbytes for b in batches)] * 4})

    try:
        corpus_pipeline.language_id(spark, docs, "")
        wide = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 4000) AS text")
        got = wide.mapInArrow(models, "names string, most long").collect()
    finally:
        spark.conf.set(name, before)
    assert [r.names for r in got] == ["_model", "_built", "_built", ""]
    assert got[0].most < 4 << 20
