import random

from paperloom.llm import tiling as G

from .fixtures import awkward, nothing

SCHEMA = "doc_id BIGINT, text STRING"


def brute_tiles(text, item, size):
    """Greedy string tiling by definition: the longest unmarked common run, again and again."""
    used_t, used_i, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(text)):
            for q in range(len(item)):
                n = 0
                while (
                    p + n < len(text) and q + n < len(item) and text[p + n] == item[q + n]
                    and p + n not in used_t and q + n not in used_i
                ):
                    n += 1
                best = max(best, (n, -p, -q))
        n, p, q = best[0], -best[1], -best[2]
        if n < size:
            return covered
        used_t.update(range(p, p + n))
        used_i.update(range(q, q + n))
        covered += n


def test_equals_definition():
    rng = random.Random(2)
    for _ in range(150):
        text, item = ([rng.choice("abc") for _ in range(rng.randint(3, 25))] for _ in range(2))
        hits = [
            (p, q) for p in range(len(text) - 2) for q in range(len(item) - 2) if text[p : p + 3] == item[q : q + 3]
        ]
        found = G.tiles(hits, 3) if hits else []
        lengths = [n for _, _, n in found]
        assert lengths == sorted(lengths, reverse=True)
        assert sum(lengths) == brute_tiles(text, item, 3)
        assert all(text[p : p + n] == item[q : q + n] for p, q, n in found)


def test_reordered_passages_and_blocks(spark):
    rng = random.Random(3)
    item = [f"w{rng.randint(0, 999)}" for _ in range(40)]
    noise = lambda n: [f"n{rng.randint(0, 999)}" for _ in range(n)]
    docs = [
        (1, " ".join(noise(30) + item + noise(30))),
        (2, " ".join(item[20:] + noise(50) + item[:20]).upper()),
        (3, " ".join(item[:30])),  # three quarters
        (4, " ".join(noise(80))),
        (5, None),
        (6, ". ".join(item)),
    ]
    items = [(10, " ".join(item)), (11, None), (12, ""), (13, "two words"), (14, " ".join(item))]
    d = spark.createDataFrame(docs, SCHEMA)
    b = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    for most in (G.BLOCK_WORDS, 25):
        got = {(r.doc_id, r.item_id) for r in G.matches(d, b, block_words=most).collect()}
        assert got == {(i, j) for i in (1, 2, 6) for j in (10, 14)}
        assert [r.doc_id for r in G.clean(d, b, block_words=most).orderBy("doc_id").collect()] == [3, 4, 5]


def test_awkward_rows(spark):
    b = spark.createDataFrame([(1, "fish two fish red fish blue"), (2, "12 34")], "item_id BIGINT, text STRING")
    got = sorted((r.doc_id, r.item_id) for r in G.matches(awkward(spark), b).collect())
    assert got == [(1, 1), (5, 1), (5, 1), (9, 2)]
    kept = G.clean(awkward(spark), b)
    assert kept.columns == awkward(spark).columns and kept.count() == 8
    assert G.matches(nothing(spark), b).collect() == []
    assert G.clean(awkward(spark), b.limit(0)).count() == 12
