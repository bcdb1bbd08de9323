import re
from collections import Counter
from itertools import permutations

import pytest

from paperloom.llm import filter_audit as A
from paperloom.llm import matrix as M

from .fixtures import AWKWARD, awkward, nothing

WORD = r"[^\x20\x09-\x0D]+"


def brute_failures(docs):
    """(doc_id, part, failed) of (doc_id, text, source) by the definition."""
    out = []
    for i, text, source in docs:
        text = text or ""
        w = re.findall(WORD, text)
        fails = [
            len(w) < 50,
            100 * len(set(w)) < 65 * len(w),
            100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            bool(re.search("[#$%&*|]", text)),
            i is not None and any(t == text and j is not None and j < i for j, t in ((j, t or "") for j, t, _ in docs)),
        ]
        out.append((i, source or "", sum(f << k for k, f in enumerate(fails))))
    return out


def brute_audit(found, good, toxic):
    out = {}
    for part in {p for _, p, _ in found}:
        own = [(i, m) for i, p, m in found if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [x for x in left if x[1] & bit]
                failing = [x for x in own if x[1] & bit]
                left = [x for x in left if not x[1] & bit]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(m == bit for _, m in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


LABELS = [(1, 1, 0), (1, 0, 0), (2, 1, 1), (6, None, 1), (None, 1, 1), (99, 1, 1)]


@pytest.mark.parametrize("sources", [["s"], ["a", "b", None]])
def test_audit_equals_brute_force(spark, sources):
    docs = [(i, t, sources[k % len(sources)]) for k, (i, t) in enumerate(AWKWARD * 2)]
    docs += [(20 + k, "Many CAPITALS here " + "a b c d e " * k, sources[0]) for k in range(30)] + [(60, "a # b", None)]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, source STRING").repartition(3)
    want = brute_failures(docs)
    found = A.failures(df)
    by = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found.collect()), key=by) == sorted(want, key=by)
    labels = spark.createDataFrame(LABELS, "doc_id BIGINT, quality INT, toxic INT")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in A.audit(found, labels).collect()}
    assert got == brute_audit(want, {1, 2, 99}, {2, 6, 99})


def test_hot_copies_are_found_by_broadcast(spark):
    rows = [(i, b"same" if i % 3 else i.to_bytes(4, "big")) for i in range(3000)] + [(None, b"same"), (5000, None)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, digest BINARY")
    got = Counter(r.copy for r in A.earlier_copies(df).collect())
    assert got == {True: 1999, False: 1003}


def test_matrix_counts_words(spark):
    matrix, dictionary = M.document_term_matrix(awkward(spark).repartition(3), keep=("doc_id", "text"))
    word = {r.term: r.word for r in dictionary.collect()}
    assert len(set(word.values())) == len(word) and min(word) >= 0
    got = Counter()
    for r in M.entries(matrix).collect():
        got[r.doc_id, word[r.term]] += r.n
    want = Counter((i, w) for i, t in AWKWARD for w in re.findall(WORD, t or ""))
    assert got == want
    assert M.entries(matrix).where("doc_id = 5").groupBy("term").count().where("count <> 2").isEmpty()
    sums = {(r.doc_id, r.n_words, r.n_distinct) for r in M.row_statistics(matrix).collect()}
    assert sums == {(i, len(w := re.findall(WORD, t or "")), len(set(w))) for i, t in AWKWARD}


def test_a_batch_of_long_texts_is_cut_into_shards(spark):
    texts = [(i, f"word{i} " * 700_000) for i in range(4)]
    matrix, _ = M.document_term_matrix(spark.createDataFrame(texts, "doc_id BIGINT, text STRING").coalesce(1))
    shards = [r.shard for r in matrix.collect()]
    assert len(set(shards)) == len(shards) > 1
    assert sorted(map(tuple, M.row_statistics(matrix).collect())) == [(i, 700_000, 1) for i in range(4)]


def test_nothing(spark):
    found = A.failures(nothing(spark))
    labels = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    assert A.audit(found, labels).collect() == []
