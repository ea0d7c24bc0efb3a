import pyarrow as pa
from loomwork.llm import decontamination as dc
from loomwork.llm.batches import text_slices

from .helpers import ODD, docs

TRAIN = "A train leaves with Peter at 5 km per hour and later meets Maria after 12 hours, then Peter gets off the old train at 5 in the town."
ITEMS = [(1, TRAIN), (2, "too short"), (3, "seven words are in this short item"), (4, None), (5, ""), (None, TRAIN), (6, TRAIN)]


def kinds(bench, texts):
    (s,) = text_slices(pa.array(texts), 1 << 24)
    return {(r, bench.ids[i]): k for r, i, k, *_ in bench.leaks(dc.Tokens(s))}


def test_templates_and_slots():
    bench = dc.Benchmark([(1, TRAIN), (3, ITEMS[2][1])])
    other = "Zed said: a train leaves with Oskar at 7 km per hour and later meets Anna after 19 hours, then Oskar gets off the old train at 7 in the town."
    contradicts = other.replace("then Oskar", "then Bob").replace("at 7 in", "at 9 in")
    merges = other.replace("Anna", "Oskar")
    got = kinds(bench, [TRAIN, other, contradicts, merges, "nothing of the kind", None, "x SEVEN words are, in this short item!", "seven words are in this shorter item"])
    assert got == {(0, 1): "exact", (1, 1): "reparameterised", (6, 3): "exact"}


def test_every_exact_window_is_found_by_brute_force():
    import random

    rnd = random.Random(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(8, 40)))) for i in range(30)]
    texts = []
    for _ in range(200):
        t = [rnd.choice(words) for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.5:
            w = rnd.choice(items)[1].split()
            a = rnd.randint(0, len(w) - 1)
            t[5:5] = w[a : a + rnd.randint(5, 40)]
        texts.append(" ".join(t))
    want = set()
    for r, t in enumerate(texts):
        for i, x in items:
            w, n = x.split(), min(dc.WINDOW, len(x.split()))
            if any(f" {' '.join(w[k : k + n])} " in f" {t} " for k in range(len(w) - n + 1)):
                want.add((r, i))
    assert set(kinds(dc.Benchmark(items), texts)) == want


def test_odd_rows_and_blocks(spark, monkeypatch):
    rows = [*ODD, (50, f"Before. {TRAIN} After."), (50, f"Before. {TRAIN} After."), (51, "clean text of several words that no item holds anywhere at all")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for size in (dc.BLOCK_BYTES, 40):
        monkeypatch.setattr(dc, "BLOCK_BYTES", size)
        got = sorted((r.doc_id, r.item_id, r.kind) for r in dc.leaks(docs(spark, rows), items).collect())
        assert got == [(50, 1, "exact")] * 2 + [(50, 6, "exact")] * 2
        clean = dc.without_leaks(docs(spark, rows), items)
        assert clean.columns == docs(spark, []).columns and clean.count() == len(rows) - 2
    assert dc.leaks(docs(spark, rows), items.limit(0)).count() == 0 == dc.leaks(docs(spark, []), items).count()


def test_each_item_of_a_template_is_tried():
    text = "every week the old baker sells {} small loaves and then she gives {} warm loaves to the children of her street"
    bench = dc.Benchmark([(1, text.format(3, 3)), (2, text.format(3, 5)), (3, text.format(4, 6))])
    got = kinds(bench, [text.format(7, 9), text.format(8, 8), text.format(4, 6)])
    assert got == {(0, 2): "reparameterised", (1, 1): "reparameterised", (2, 2): "reparameterised", (2, 3): "exact"}


def test_every_item_of_a_template_is_named(spark):
    text = "every week the old baker sells {} small loaves and then she gives {} warm loaves to the children of her street"
    values = [(3, 3), (13, 5), (4, 6), (13, 5), (17, 8), (9, 9)]
    items = spark.createDataFrame([(i, text.format(*v)) for i, v in enumerate(values)], "item_id long, text string")
    fills = {1: (7, 10), 2: (21, 21), 3: (4, 6), 4: (13, 5), 5: (17, 8)}
    rows = docs(spark, [(i, text.format(*v)) for i, v in fills.items()])
    want = {(d, i): "exact" if a == b else "reparameterised" for d, a in fills.items() for i, b in enumerate(values) if (a[0] == a[1]) == (b[0] == b[1])}
    found = dc.leaks(rows, items).collect()
    assert {(r.doc_id, r.item_id): r.kind for r in found} == want and len(found) == len(want)
    assert all((r.n_windows, r.n_exact) == (13, 13 if r.kind == "exact" else 0) for r in found)


def test_items_of_one_template_leak_as_each_does_alone(monkeypatch):
    import random

    rnd = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    templates = [[rnd.choice(words) if rnd.random() < 0.75 else rnd.randint(0, 2) for _ in range(rnd.randint(3, 25))] for _ in range(6)]

    def made():
        v = [rnd.choice([1, 2, 3, "four"]) for _ in range(3)]
        return " ".join(str(v[x]) if isinstance(x, int) else x for x in rnd.choice(templates))

    items = [(i, made()) for i in range(60)]
    texts = [" ".join([rnd.choice(words)] * rnd.choice([0, 2]) + [made()] + [made()] * rnd.choice([0, 1])) for _ in range(100)]
    (s,) = text_slices(pa.array(texts), 1 << 24)
    t = dc.Tokens(s)
    want = sorted((r, i, *rest) for i, x in items for r, _, *rest in dc.Benchmark([(i, x)]).leaks(t))
    for named in (dc.NAMED, 7):
        monkeypatch.setattr(dc, "NAMED", named)
        bench = dc.Benchmark(items)
        assert sorted(row for c in bench.pairs(t) for row in zip(*(x.tolist() for x in c))) == want
    assert len(want) > 2 * len(bench.leaks(t))


def test_exact_copies_need_no_literals_and_no_place_in_a_sentence():
    numbers = "3 5 8 13 Maria 21 34 Peter 55 89 144 cm 233"
    bench = dc.Benchmark([(1, "Seven words are in this short item"), (2, numbers), (3, "12 34 56 78 90")])
    got = kinds(bench, ["x Seven words are in this short item", "so: " + numbers, numbers.replace("13", "14").replace("89", "90"), "sums 12 34 56 78 90.", "sums 12 34 56 79 90."])
    assert got == {(0, 1): "exact", (1, 2): "exact", (3, 3): "exact"}


def test_names_that_begin_sentences():
    text = "{0} gives {1} half of the red apples today. {1} eats the rest while {0} sleeps"
    bench = dc.Benchmark([(1, text.format("Peter", "Maria")), (2, "Peter walks to the old mill every day")])
    got = kinds(bench, [text.format("Oskar", "Anna"), text.format("Oskar", "Anna").replace("while Oskar", "while Bob"), "we know that Oskar walks to the old mill every day", "Oskar walks from the old mill every day"])
    assert got == {(0, 1): "reparameterised", (2, 2): "reparameterised"}


def test_numbers_in_words_and_few_literals():
    sum_ = "Let {} x {} be {} and {} x {} be {}"
    words = "Tom has {} apples and then buys {} more"
    bench = dc.Benchmark([(1, sum_.format(3, 5, 15, 4, 6, 24)), (2, words.format("three", "five")), (3, "12 34"), (4, "hello there")])
    got = kinds(bench, [sum_.format(3, 5, 15, 4, 6, 24), sum_.format(7, 8, 56, 9, 2, 18), sum_.format(7, 7, 56, 9, 2, 18), words.format("seven", 4).replace("Tom", "Bob"), "12, 34", "say 12 34", "Hello there!", "well, hello there"])
    assert got == {(0, 1): "exact", (1, 1): "reparameterised", (3, 2): "reparameterised", (4, 3): "exact", (6, 4): "exact"}


def test_reparameterised_texts_against_brute_force():
    import random
    import re

    rnd = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    templates = [[rnd.choice(words) if rnd.random() < 0.75 else rnd.randint(0, 2) for _ in range(rnd.randint(3, 25))] for _ in range(6)]

    def made(template, values):
        return " ".join(str(values[x]) if isinstance(x, int) else x for x in template)

    values = lambda: [rnd.choice([1, 2, 3, "four"]) for _ in range(3)]
    items = [(i, made(rnd.choice(templates), values())) for i in range(40)]
    texts = []
    for _ in range(150):
        body = [rnd.choice(words) for _ in range(rnd.randint(0, 8))]
        t = rnd.choice(templates)
        a = rnd.choice([0, 0, rnd.randint(0, len(t))])
        v, part = values(), t[a : rnd.choice([len(t), len(t), rnd.randint(a, len(t))])]
        body += [str(rnd.choice(v)) if isinstance(x, int) and rnd.random() < 0.05 else str(v[x]) if isinstance(x, int) else x for x in part]
        texts.append(" ".join(body + [rnd.choice(words) for _ in range(rnd.choice([0, 5]))]))
    number = lambda w: re.fullmatch(r"\d+|four", w) is not None
    shape = lambda w: tuple("#" if number(x) else x for x in w)
    leads, seen = set(), set()
    for i, x in items:
        w = x.split()
        first = {}
        key = (shape(w), tuple(first.setdefault(y, len(first)) for y in w if number(y)))
        if key not in seen:
            leads.add(i)
        seen.add(key)
    want = {}
    for r, t in enumerate(texts):
        d = t.split()
        for i, x in items:
            w = x.split()
            n, found = min(dc.WINDOW, len(w)), set()
            for shift in range(-len(w), len(d)):
                places = [p for p in range(len(w) - n + 1) if 0 <= p + shift <= len(d) - n and shape(w[p : p + n]) == shape(d[p + shift : p + shift + n])]
                if n < dc.LEAST:
                    places = places if len(d) == n else []
                own = [p for p in places if w[p : p + n] == d[p + shift : p + shift + n]]
                literals = lambda a: sum(not number(w[k]) for k in a)
                other = [p for p in places if p not in own and i in leads and n >= dc.LEAST and literals(range(p, p + n)) >= min(dc.FEW, n - 2)]
                if own:
                    found.add("exact")
                if other:
                    at = {k for p in own + other for k in range(p, p + n)}
                    pairs = {(w[k], d[k + shift]) for k in at if number(w[k])}
                    if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}) and (literals(at) >= dc.LITERALS or len(at) == len(w)):
                        found.add("exact" if own else "reparameterised")
            if found:
                want[r, i] = min(found)
    assert kinds(dc.Benchmark(items), texts) == want and sum(v == "reparameterised" for v in want.values()) > 30


def test_items_without_a_window(spark):
    items = spark.createDataFrame([*ITEMS, (8, "?! ..."), (9, "a"), (10, "é")], "item_id long, text string")
    assert sorted(str(r.item_id) for r in dc.windowless(items).collect()) == ["4", "5", "8", "None"]
