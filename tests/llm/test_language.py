import random

import pyarrow as pa
from loomwork.llm import language
from loomwork.llm.batches import text_slices

from .helpers import ODD, docs

SYLLABLES = {"aa": ["ka", "to", "mi", "re", "su"], "bb": ["zem", "vor", "glid", "prak"], "cc": ["eau", "oui", "çon", "quel"]}


def made(lang, rnd, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def samples(rnd):
    return tuple((k, made(k, rnd, 400)) for k in SYLLABLES)


def test_pieces_are_longest_matches():
    rnd = random.Random(1)
    own = samples(rnd)
    model = language.Model(dict(own))
    texts = [made(k, rnd, 30) for k in SYLLABLES] + ["", "123", "xyz Q", "Ünïcödé 漢字", "ka"]

    def pieces(text, lang):
        known, x = model.symbol[language.letters_of(dict(own)[lang])].tobytes(), b"\0" + model.symbol[language.letters_of(text)].tobytes()
        n, i = 0, 0
        while i < len(x):
            j = i + 1
            while j < len(x) and x[i : j + 1] in known:
                j += 1
            n, i = n + 1, j
        return n

    for s in text_slices(pa.array(texts), 1 << 24):
        bits, size = model.bits(s)
        for i, t in enumerate(texts):
            for k, lang in enumerate(model.languages):
                assert size[i] == len(language.letters_of(t))
                assert not size[i] or round(bits[k, i] / model.cost[k]) == pieces(t, lang)


def test_held_out_accuracy_and_odd_rows(spark):
    rnd = random.Random(2)
    langs = {i: rnd.choice(list(SYLLABLES)) for i in range(100, 300)}
    rows = [(i, made(k, rnd, rnd.randint(3, 60))) for i, k in langs.items()] + ODD
    table = docs(spark, rows, langs)
    own = language.learn(table.filter(~language.held_out("doc_id")))
    got = language.predict(table, own).withColumn("held_out", language.held_out("doc_id")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    judged = [r for r in got if r.held_out and r.doc_id in langs]
    assert sum(r.lang_pred == langs[r.doc_id] for r in judged) >= 0.95 * len(judged) > 20
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    kept = language.in_learned_language(table, own)
    assert kept.columns == table.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids >= set(langs) and not ids & {1, 2, 3}


def test_marks_alone_are_no_letters():
    model = language.Model(dict(samples(random.Random(3))))
    for s in text_slices(pa.array(["\u0301\u0302", "a\u0301", None, "1 \u0301 2"]), 1 << 24):
        assert [x == "und" for x in model.predict(s)[0]] == [True, False, True, True]


def test_nothing_to_learn_from(spark):
    table = docs(spark, ODD)
    own = language.learn(table)
    assert own == () and {r.lang_pred for r in language.predict(table, own).collect()} == {"und"}
    assert language.in_learned_language(table, own).count() == len(ODD) - 3
    assert language.predict(docs(spark, []), own).count() == 0


def test_what_the_pipeline_s_rule_drops_at_each_size(spark):
    """Texts in no learned language go from LEAST_LETTERS letters on, whatever their length; shorter ones, which can't be told, and texts in a learned language stay."""
    rnd = random.Random(5)
    own = samples(rnd)
    drawn = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzçéè") for _ in range(n))
    sizes = (1, 5, 20, 39, 40, 41, 80, 400, 20_000)
    rows = [(i, drawn(n)) for i, n in enumerate(sizes)] + [(100 + i, "".join(chr(0x4E00 + rnd.randrange(900)) for _ in range(n))) for i, n in enumerate(sizes)]
    rows += [(200 + 10 * i + k, made(lang, rnd, n)) for i, n in enumerate((1, 2, 10, 40, 400)) for k, lang in enumerate(SYLLABLES)]
    stay = {r.doc_id for r in language.in_learned_language(docs(spark, rows), own).collect()}
    few = {i for i, n in enumerate(sizes) if n < language.LEAST_LETTERS}
    assert stay == few | {100 + i for i in few} | {i for i, _ in rows if i >= 200}
