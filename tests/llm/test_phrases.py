import random
import re
from collections import Counter
from math import floor

import numpy as np
import pytest

from paperloom.llm import phrases as P

from .fixtures import awkward, fold, nothing


def brute(docs, longest=4, support=30, subsumed=80, top=2000):
    """Rows by the definition, for (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {k: a for k, a in f.items() if a >= support}
    inside = set()
    for (lang, p), a in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= subsumed * often[lang, p[i : i + k]]:
                    inside.add((lang, p[i : i + k]))
    rows = {}
    for (lang, p), a in often.items():
        if len(p) > 1 and (lang, p) not in inside:
            cuts = [(f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))  # noqa: E741
            rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
        for lang, found in rows.items()
        for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])
    )


def frame(spark, docs):
    return spark.createDataFrame(docs, "lang STRING, text STRING").repartition(3)


def random_docs(seed, n, words):
    rng = random.Random(seed)
    pick = lambda: rng.choice(words)
    docs = []
    for i in range(n):
        text = "".join(pick() + rng.choice([" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(rng.randrange(60)))
        docs.append((rng.choice(["en", "de", None]), text if i % 9 else rng.choice([None, "", " \n", text])))
    return docs


WORDS = ["a", "b", "The", "the", "c", "été", "x" * 300, "😀", "d|", "New", "York"]


@pytest.mark.parametrize(("longest", "support"), [(4, 3), (4, 1), (3, 2), (2, 2)])
def test_equals_brute_force(spark, longest, support):
    docs = random_docs(support, 60, WORDS) + [("en", "one two three four five six " * 9), ("en", "New York City! " * 7)]
    got = P.collocations(frame(spark, docs), longest, support, top=40).collect()
    assert sorted(map(tuple, got)) == brute(docs, longest, support, top=40)


def test_result_does_not_depend_on_bits_or_hot_words(spark, monkeypatch):
    docs = random_docs(7, 40, WORDS)
    full = P.Known(np.full(1 << (P.BITS - 6), -1, np.int64), np.zeros(0, np.uint64))
    monkeypatch.setattr(P, "_known", lambda *_: full)
    assert sorted(map(tuple, P.collocations(frame(spark, docs), 4, 2).collect())) == brute(docs, 4, 2)


def test_stripes_hold_extensions_totals_and_maxima(spark):
    docs = [("en", "a b a c a b. a b")] * 2
    rows = P.stripes(frame(spark, docs), 3, 2).collect()
    merged = {}
    for r in rows:
        total, extensions = merged.get((r.size, r.prefix), (0, {}))
        assert len(r.next) == len(set(r.next))
        merged[r.size, r.prefix] = total + r.total, extensions | dict(zip(r.next, r.n))
    assert merged[0, ""] == (16, {"a": 8, "b": 6, "c": 2})
    assert merged[1, "a"] == (8, {"b": 6, "c": 2})
    assert merged[1, "b"] == (2, {"a": 2})
    assert merged[2, "a b"] == (2, {"a": 2})


def test_batches_are_merged_across_their_borders():
    import pyarrow as pa

    names = [*P.KEY, "next", "n"]
    one = lambda prefix, next_, n: dict(zip(names, ("en", 1, prefix, 0, next_, n)))
    table = pa.Table.from_pylist(
        [one("a", ["x", "y"], [1, 2]), one("a", ["y"], [1 << 60]), one("b", ["z"], [3]), one("c", ["x"], [1])],
        pa.schema(list(zip(names, [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())]))),
    )
    got = P._merged(table).to_pylist()
    assert [(r["prefix"], dict(zip(r["next"], r["n"]))) for r in got] == [
        ("a", {"x": 1, "y": 2 + (1 << 60)}), ("b", {"z": 3}), ("c", {"x": 1})
    ]


def test_scores_beyond_64_bits(spark):
    a, by = 1 << 61, 3 * (1 << 61) + 1
    got = spark.range(1).select(P._ratio(P.F.lit(a), P.F.lit(by).cast("decimal(38,0)")).alias("s")).first().s
    assert int(got) == 2_000_000 * a // by != floor(2_000_000 * a / by) - 1


def test_awkward_rows(spark):
    docs = [(r.lang, r.text) for r in awkward(spark).collect()]
    got = sorted(map(tuple, P.collocations(awkward(spark).repartition(2), support=2).collect()))
    assert got == brute(docs, support=2)


def test_nothing(spark):
    assert P.collocations(nothing(spark)).collect() == []
    assert P.collocations(frame(spark, [("en", None), ("en", " "), (None, "a")])).collect() == []
