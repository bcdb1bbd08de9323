import numpy as np

from paperloom.llm import vectors as V

from .fixtures import components


def brute(rows, cosine):
    ok = []
    for i, (_, v, label) in enumerate(rows):
        good = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None
        ok += [i] * bool(good)
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in ok}
    links = [
        (i, j)
        for i in ok
        for j in ok
        if j < i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine
    ]
    n = np.zeros(len(rows), int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    root = components(len(rows), links)
    least = {}
    for (d, _, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, d), d)
    return sorted((d, n[i], least[root[i]], d == least[root[i]]) for i, (d, _, _) in enumerate(rows))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.25, 8)).tolist(), i % 3 if i % 40 else None) for i in range(600)]
    rows += [(600 + i, centres[0].tolist(), 0) for i in range(50)]
    rows += [(650, [0.0] * 8, 0), (651, None, 0), (652, [float("nan")] * 8, 0), (653, [1.0, None], 0)]
    rows += [(654, [1.0, 2.0], 0), (655, [2.0, 4.0], 0), (656, [], 0), (657, [float("inf")] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT")
    got = sorted(tuple(r) for r in V.near_vectors(df).collect())
    want = brute(rows, 0.93)
    assert [tuple(map(int, r)) for r in got] == [tuple(map(int, r)) for r in want]
    assert any(r[1] for r in want)


def test_empty_and_null_ids(spark):
    kind = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, node STRING"
    assert V.near_vectors(spark.createDataFrame([], kind)).collect() == []
    rows = [(None, [1.0, 0.0], 1, "x"), (3, [1.0, 0.0], 1, "x"), (3, [1.0, 0.0], 1, "x")]
    got = sorted(V.near_vectors(spark.createDataFrame(rows, kind)).collect(), key=str)
    assert [(r.n_links, r.kept) for r in got] == [(2, True)] * 3
    assert sorted(str(r.component_id) for r in got) == ["3", "3", "None"]


def test_long_labels_are_told_apart_by_their_ends(spark):
    long = "x" * 64
    rows = [(1, long + "a", [1.0, 2.0]), (2, long + "b", [1.0, 2.0]), (3, long + "a", [1.0, 2.0]), (4, long, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id BIGINT, label STRING, embedding ARRAY<DOUBLE>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.near_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (0, 4)}
