import random
from collections import Counter
from itertools import combinations

import pytest
from conftest import rows, uid
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom import session
from paperloom.operators import pairs
from paperloom.schemas import STOP_WORDS


def table(spark, mentions):
    return spark.createDataFrame(mentions, "paperId STRING, softwareId STRING")


def brute(mentions, item_support, pair_support):
    papers = {}
    for p, s in mentions:
        papers.setdefault(p, set()).add(s)
    support = Counter(s for names in papers.values() for s in names)
    kept = {s for s, n in support.items() if n >= item_support}
    together = Counter(c for names in papers.values() for c in combinations(sorted(names & kept), 2))
    return sorted((a, b, n) for (a, b), n in together.items() if n >= pair_support)


def corpus(seed, papers=120, names=60, wide=30):
    """Papers of few names, a number of wide ones, and one that owns a third of all rows."""
    rng = random.Random(seed)
    pool = [f"s{i}" for i in range(names)]
    out = []
    for p in range(papers):
        k = rng.randint(15, 40) if p < wide else rng.randint(1, 6)
        # popular names first
        chosen = {pool[min(int(rng.expovariate(0.08)), names - 1)] for _ in range(k)}
        out += [(f"p{p}", s) for s in chosen for _ in range(rng.randint(1, 3))]
    hot = [("hot", rng.choice(pool)) for _ in range(len(out) // 2)]
    out += hot + [(f"q{i}", "s0") for i in range(len(out) // 4)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("fanout,support", [(512, 5), (8, 5), (2, 20), (8, 40), (0, 3), (20, 1)])
def test_co_mentions_equal_brute_force(spark, seed, fanout, support):
    mentions = corpus(seed)
    edges = pairs.distinct_edges(table(spark, mentions))
    got = pairs.co_mentions(edges, support, support, fanout)
    assert rows(got) == brute(mentions, support, support)


def test_long_lists_take_the_shuffled_way(spark, monkeypatch):
    monkeypatch.setattr(session, "MAX_BROADCAST", 0)
    mentions = corpus(11)
    edges = pairs.distinct_edges(table(spark, mentions))
    assert rows(pairs.co_mentions(edges, 20, 20, 8)) == brute(mentions, 20, 20)
    words = spark.createDataFrame([("s0",), ("s1",)], "softwareId STRING")
    kept = pairs.exclude_stop_list(table(spark, mentions), words)
    assert rows(kept) == sorted(m for m in mentions if m[1] not in ("s0", "s1"))


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 6).map("p{}".format), st.integers(0, 8).map("s{}".format)), min_size=20, max_size=120),
    st.integers(1, 3), st.integers(1, 4), st.integers(0, 4),
)
def test_co_mentions_any_input(spark, mentions, item, pair, fanout):
    edges = pairs.distinct_edges(table(spark, mentions))
    assert rows(pairs.co_mentions(edges, item, pair, fanout)) == brute(mentions, item, pair)


def test_pair_count_is_bounded_by_members(spark):
    edges = pairs.distinct_edges(table(spark, corpus(7)))
    single = dict(rows(pairs.papers_per_software(edges)))
    for a, b, n in rows(pairs.co_mentions(edges, 2, 2)):
        assert n <= min(single[a], single[b])


def test_support_boundary(spark):
    mentions = [(f"p{i}", "in") for i in range(100)] + [(f"p{i}", "out") for i in range(99)]
    mentions += [("p0", "in")] * 50
    edges = pairs.distinct_edges(table(spark, mentions))
    frequent = pairs.min_support(pairs.papers_per_software(edges))
    assert rows(frequent) == [("in", 100)]
    assert rows(pairs.frequent_count(frequent)) == [(1,)]
    assert rows(pairs.top_software(frequent)) == [(0, "in", 100)]
    assert rows(pairs.co_mentions(edges)) == []


def test_stop_list_is_case_sensitive(spark):
    mentions = [("p", w) for w in STOP_WORDS] + [("p", "Software"), ("p", "software tool"), ("p", "")]
    kept = pairs.stop_list_filter(table(spark, mentions))
    assert rows(kept) == [("p", ""), ("p", "Software"), ("p", "software tool")]
    words = spark.createDataFrame([(w,) for w in STOP_WORDS], "softwareId STRING")
    assert rows(pairs.exclude_stop_list(table(spark, mentions), words)) == rows(kept)


def test_ties_are_ordered_by_name(spark):
    mentions = [(f"p{i}", s) for i in range(3) for s in "dbca"]
    edges = pairs.distinct_edges(table(spark, mentions).repartition(5))
    frequent = pairs.min_support(pairs.papers_per_software(edges), 1)
    assert rows(pairs.top_software(frequent, 3)) == [(0, "a", 3), (1, "b", 3), (2, "c", 3)]
    top = [tuple(r) for r in pairs.top_pairs(pairs.co_mentions(edges, 1, 1), 2).collect()]
    assert top == [("a", "b", 3), ("a", "c", 3)]


def test_names_order_by_bytes(spark):
    mentions = [("p", "é"), ("p", "z"), ("p", "Z")]
    got = pairs.co_mentions(pairs.distinct_edges(table(spark, mentions)), 1, 1)
    assert rows(got) == [("Z", "z", 1), ("Z", "é", 1), ("z", "é", 1)]


def with_copies(seed):
    """Papers that are each there several times, wide ones among them, and some that are alone."""
    rng = random.Random(seed)
    sets = [rng.sample([f"s{i}" for i in range(70)], k) for k in (50, 40, 12, 3, 2, 1)]
    out = [(f"c{i}-{j}", s) for i, names in enumerate(sets) for j in range(rng.randint(2, 30)) for s in names]
    out += corpus(seed, papers=20, wide=5)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1])
@pytest.mark.parametrize("fanout,support", [(512, 5), (8, 12), (0, 1)])
def test_equal_papers_count_by_their_weight(spark, seed, fanout, support):
    mentions = with_copies(seed)
    edges = pairs.distinct_edges(table(spark, mentions))
    assert rows(pairs.co_mentions(edges, support, support, fanout)) == brute(mentions, support, support)


def test_equal_papers_make_their_pairs_once(spark):
    names = [f"s{i}" for i in range(40)]
    edges = table(spark, [(f"p{j}", s) for j in range(50) for s in names] + [("q", "s0"), ("q", "s1")])
    sets = session.stage(pairs.equal_papers(edges), "sets")
    merged = pairs.merge_equal_papers(edges, sets)
    assert merged.count() == 42
    assert {r.weight for r in merged.where("softwareId = 's7'").collect()} == {50}
    made = dict(((a, b), n) for a, b, n in rows(pairs._pair_up(merged)))
    assert len(made) == 780 and made["s0", "s1"] == 51 and made["s0", "s2"] == 50


@pytest.mark.parametrize("support", [1])
@pytest.mark.parametrize("k", [5, 40])
def test_most_frequent_pairs_equal_all_pairs(spark, monkeypatch, support, k):
    monkeypatch.setattr(pairs, "FIRST_NAMES", 4)
    mentions = with_copies(support + k)
    want = sorted(brute(mentions, 1, support), key=lambda p: (-p[2], p[0], p[1]))[:k]
    got = pairs.most_frequent_pairs(pairs.distinct_edges(table(spark, mentions)), k, support, 8)
    assert [tuple(r) for r in got.collect()] == want


def test_no_pairs(spark):
    edges = table(spark, [("p", "a"), ("q", "b")])
    assert rows(pairs.most_frequent_pairs(edges)) == rows(pairs.co_mentions(edges.limit(0), 1, 1)) == []


def test_packed_ids_lose_nothing(spark):
    ids = [uid(0xABC7), uid(0xABC7).upper(), uid(0xABC7) + "\n", "{" + uid(0xABC7) + "}", "", "p", "x" * 16, "\0" * 16, "ä", None]
    found = spark.createDataFrame([(i,) for i in ids], "paperId STRING").select(
        "paperId", pairs.packed(F.col("paperId")).alias("packed")
    )
    read = found.select("paperId", "packed", pairs.unpacked(F.col("packed")).alias("again")).collect()
    assert [r.again for r in read] == ids
    assert [len(r.packed) for r in read[:2]] == [16, 53]
    assert len({bytes(r.packed) for r in read[:-1]}) == len(ids) - 1


def test_merging_equal_papers_shuffles_no_edges(spark, capsys):
    edges = session.stage(table(spark, [(uid(j), s) for j in range(9) for s in "abc"] + [(None, "a"), (None, "b")]), "edges")
    sets = session.stage(pairs.equal_papers(edges), "sets")
    merged = pairs.merge_equal_papers(edges, sets)
    merged.explain()
    assert "Exchange hashpartitioning" not in capsys.readouterr().out
    assert rows(merged) == [(uid(0), s, 9) for s in "abc"]
