import random
import time

from loomwork.llm import lines

from .helpers import ODD, docs


def brute(rows, n):
    """rows with distinct ids in order."""
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").split("\n")
        at = [k for k, x in enumerate(raw) if x.strip(" \t\r\f\v")]
        gone = set()
        for k in range(len(at) - n + 1):
            run = tuple(raw[j].strip(" \t\r\f\v") for j in at[k : k + n])
            if run in seen:
                gone |= set(at[k : k + n])
            seen.add(run)
        out.append((str(i), None if t is None else "\n".join(x for k, x in enumerate(raw) if k not in gone), len(at), len(gone)))
    return sorted(out, key=repr)


def test_repeated_runs(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(80):
        text = []
        for _ in range(rnd.randint(0, 5)):
            a = rnd.randint(0, 30)
            text += [f"shared line {k}" + rnd.choice(["", " ", "\r"]) for k in range(a, a + rnd.randint(0, 7))]
            text += [f"own {rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 2))] + [""] * rnd.randint(0, 1)
        rows.append((i, "\n".join(text)))
    for n in (1, 2, 3, 5):
        got = lines.remove_repeated_runs(docs(spark, rows), min_lines=n).select("doc_id", "text", "n_lines", "n_removed").collect()
        assert sorted(((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in got), key=repr) == brute(rows, n)


def test_odd_rows(spark):
    rows = [r for k, r in enumerate(ODD) if k != 6] + [(20, "a\nb\nc\nd"), (21, "x\na\nb\nc"), (22, "a\nb\nc\na\nb\nc")]
    got = lines.remove_repeated_runs(docs(spark, rows))
    assert got.columns == [*docs(spark, []).columns, "n_lines", "n_removed"]
    assert sorted(((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in got.collect()), key=repr) == brute(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), 3)
    twice = lines.remove_repeated_runs(docs(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")])).collect()
    assert sorted((r.doc_id, r.text) for r in twice) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "")]
    assert lines.remove_repeated_runs(docs(spark, [])).count() == 0


def test_long_lines_that_repeat_alone(spark):
    long, half = " ".join(f"w{i}" for i in range(50)), [" ".join(f"{c}{i}" for i in range(25)) for c in "ab"]
    rows = [(1, long), (2, f"own\n {long}\r\nother"), (3, long), (4, "\n\n".join(half)), (5, "\n".join(["x", *half, "y"])), (6, half[0]), (7, f"{half[1]}\n{half[0]}"), (8, f"{long} more\n{long}")]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.remove_repeated_runs(docs(spark, rows), long_words=50).collect()}
    assert got == {1: (long, 0), 2: ("own\nother", 1), 3: ("", 1), 4: ("\n\n".join(half), 0), 5: ("x\ny", 2), 6: (half[0], 0), 7: (f"{half[1]}\n{half[0]}", 0), 8: (f"{long} more", 1)}
    assert {r.doc_id: r.n_removed for r in lines.remove_repeated_runs(docs(spark, rows)).collect()} == dict.fromkeys(range(1, 9), 0)


def test_anchors_are_the_first_minima_of_windows(spark):
    rnd = random.Random(11)
    texts = [(i, "\n".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 12)))) for i in range(40)]
    for n in (1, 2, 3, 5):
        table = docs(spark, texts).selectExpr("doc_id AS k", "0L AS h", "transform(split(text, '\n'), x -> struct(xxhash64(x) AS hash, 0 AS words)) AS lines")
        found = {}
        for a in lines.anchors(table, n, None).collect():
            found.setdefault(a.k, []).append(a)
        for r in table.collect():
            hashes, want = [x.hash for x in r.lines], {}
            for i in range(len(hashes) - n + 1):
                window = hashes[i : i + n]
                p = i + window.index(min(window))
                want.setdefault(p, set()).add((p - i, n))
            got = found.get(r.k, [])
            assert {a.p: {(w.o, w.size) for w in a.windows} for a in got} == want
            assert all(a.f == hashes[a.p] and [x for x in a.near if x is not None] == hashes[max(0, a.p - n + 1) : a.p + n] for a in got)


def test_frequent_lines_and_runs(dealt):
    rnd = random.Random(12)
    part = lambda: rnd.choice([["menu", f"own {rnd.random()}"], ["top", "menu", "end"], [f"own {rnd.random()}"], ["menu"]])
    rows = [(i, "\n".join(x for _ in range(6) for x in part())) for i in range(300)]
    for n in (1, 2, 3):
        got = lines.remove_repeated_runs(docs(dealt, rows), min_lines=n).collect()
        assert sorted(((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in got), key=repr) == brute(rows, n)


def test_many_lines(spark):
    text = "\n".join(f"line {i}" for i in range(80_000))
    began = time.perf_counter()
    got = {r.doc_id: r.n_removed for r in lines.remove_repeated_runs(docs(spark, [(1, text), (2, text)])).collect()}
    assert got == {1: 0, 2: 80_000} and time.perf_counter() - began < 20
