import numpy as np
from loomwork.llm import vectors


def brute(rows, threshold):
    ok = [v is not None and len(v) > 0 and all(e is not None and np.isfinite(e) for e in v) and any(e != 0 for e in v) and i is not None for i, v in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                near[a, b] = x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold
    name = [r[0] for r in rows]
    for _ in range(n):
        new = [min([name[a], *(name[b] for b in np.flatnonzero(near[a]))]) if ok[a] else name[a] for a in range(n)]
        if new == name:
            break
        name = new
    return sorted((str(rows[a][0]), int(near[a].sum()), str(name[a])) for a in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, v string")


def test_links_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for _ in range(12):
        b = rng.standard_normal(16)
        for _ in range(12):
            rows.append((k, (b + 0.33 * rng.standard_normal(16)).tolist()))
            k += 1
    rows += [(500, rows[0][1]), (501, [2 * x for x in rows[0][1]]), (502, None), (503, [0.0] * 16), (504, [float("nan")] * 16), (505, []), (506, [None] * 16)]
    rows += [(507, [1.0, 2.0]), (508, [1.0, 2.1]), (509, [float("inf")] * 16), (None, rows[0][1]), (500, rows[0][1]), (510, [0.0, -0.0, 1.0]), (511, [0.0, 0.0, 1.0])]
    want = brute(rows, 0.9)
    for block, group, home in ((2048, 20_000, 1 << 17), (16, 40, 1 << 17), (16, 40, 8), (2048, 40, 8), (2048, 40, 200)):
        monkeypatch.setattr(vectors, "BLOCK", block)
        monkeypatch.setattr(vectors, "GROUP_ROWS", group)
        monkeypatch.setattr(vectors, "HOME_ROWS", home)
        got = vectors.near_duplicates(table(spark, rows)).collect()
        assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vectors.near_duplicates(table(spark, [])).count() == 0


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    x = vectors.unit(rng.standard_normal((400, 64)))
    z = rng.standard_normal((400, 64))
    z = vectors.unit(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.9001 * x + np.sqrt(1 - 0.9001**2) * z
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    got = vectors.near_duplicates(table(spark, rows)).filter("n_links > 0").count()
    assert got >= 0.99 * 800


def test_cores_and_links_between_them(spark, monkeypatch):
    """Three centres in 64 dimensions, two of them at a cosine of 0.9: whole buckets of near vectors make cores, and some pairs of two cores link."""
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(9)
    x, z, y = vectors.unit(rng.standard_normal((3, 64)))
    z = vectors.unit((z - (z @ x) * x)[None])[0]
    centres = [x, 0.9 * x + np.sqrt(1 - 0.9**2) * z, y]
    rows = [(100 * k + i, (c + 0.02 * rng.standard_normal(64)).tolist()) for k, c in enumerate(centres) for i in range(80)]
    cores = []
    real = vectors._cores
    monkeypatch.setattr(vectors, "_cores", lambda *a: cores.append(real(*a)) or cores[-1])
    got = vectors.near_duplicates(table(spark, rows)).collect()
    want = brute(rows, 0.9)
    sizes = sorted(r["count"] for r in cores[0].groupBy("core").count().collect())
    assert sizes[-1] >= 40 and len(sizes) >= 2
    assert any(79 < n < 159 for _, n, _ in want)  # some of the first centre's link with some of the second's
    assert sum(r.n_links for r in got) >= 0.995 * sum(n for _, n, _ in want)
    assert all(r.n_links <= dict((i, n) for i, n, _ in want)[str(r.vec_id)] for r in got)
    assert sorted((str(r.vec_id), str(r.component_id)) for r in got) == [(i, c) for i, _, c in want]


def test_hadamard():
    h = vectors.hadamard(np.eye(8))
    assert (h @ h.T == 8 * np.eye(8)).all()
