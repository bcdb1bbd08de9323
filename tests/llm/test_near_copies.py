import random

import pytest

from paperloom import session
from paperloom.llm import near_copies as N

from .fixtures import awkward, components, nothing, shingle_set


def brute(rows, size, threshold):
    sets = [shingle_set(t, size) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])
    ]
    root = components(len(rows), links)
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, d), d)
    return sorted((d, len(s), least[r], d == least[r]) for (d, _), s, r in zip(rows, sets, root, strict=True))


def altered(rng, text, share):
    return " ".join(rng.choice("pqrstuv") * 3 if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize(("size", "threshold", "broadcast"), [(3, 85, True), (3, 85, False), (5, 80, True)])
def test_equals_brute_force(spark, monkeypatch, size, threshold, broadcast):
    """A centre with near copies on both sides of the threshold, chains, copies, a shared passage."""
    if not broadcast:
        monkeypatch.setattr(session, "MAX_BROADCAST", -1)
    rng = random.Random(4)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    centre, passage, chain = fresh(120), fresh(30), fresh(100)
    texts = [altered(rng, centre, rng.uniform(0, 0.08)) for _ in range(90)]
    texts += [passage + " " + fresh(rng.randint(5, 60)) for _ in range(40)]
    for _ in range(15):
        chain = altered(rng, chain, 0.02)
        texts.append(chain)
    texts += texts[:10] + [fresh(2)] * 3 + [fresh(50) for _ in range(30)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = sorted(tuple(r) for r in N.near_copies(df, size, threshold).collect())
    assert got == brute(rows, size, threshold)


def test_awkward_rows(spark):
    got = N.near_copies(awkward(spark), 3, 85).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 12
    assert by_id[5].component_id == 1 and not by_id[5].kept and by_id[1].kept
    assert all(by_id[i].n_shingles == 0 and by_id[i].kept and by_id[i].component_id == i for i in (2, 3, 4))
    assert by_id[None].component_id is None and by_id[None].kept
    assert by_id[7].n_shingles == 1 and by_id[8].n_shingles == 1 and by_id[9].n_shingles == 1


def test_empty_table(spark):
    assert N.near_copies(nothing(spark)).collect() == []


def test_layout_holds_its_promise():
    for threshold in (80, 85, 90):
        chunks, width, errors = N.layout(threshold)
        assert chunks * (errors + 1) > 2 * (1 - threshold / 100) * chunks * width
