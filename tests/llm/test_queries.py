import hashlib
import math
import zlib
from collections import Counter

import duckdb
import pytest

from paperloom.llm import queries as Q

from .fixtures import words
from .test_personal import brute as brute_personal
from .test_secrets import brute as brute_secrets

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in Q.table(spark, SF, "documents").collect()}


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(Q.ORACLES[name])
    columns = [d[0] for d in found.description]
    want = sorted(map(str, found.fetchall()))
    df = Q.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == want


def digest(spans, kinds):
    return hashlib.sha256(",".join(f"{kinds[s[1]]}:{s[0]}:{s[2]}" for s in spans).encode()).hexdigest()


@pytest.mark.parametrize(
    ("name", "brute", "kinds"),
    [
        ("op3_secrets", brute_secrets, ("assign", "access", "hex")),
        ("op8_personal", brute_personal, ("email", "ip", "card", "phone")),
    ],
)
def test_base_spans(spark, texts, name, brute, kinds):
    got = Q.QUERIES[name](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == digest(want, kinds)
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[1] == i for s in want) for i in range(len(kinds))]


def test_base_scores(spark, texts):
    got = {r.doc_id: r for r in Q.op4_scoring(spark, SF).collect()}
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    total = sum(counts.values())
    below = math.log10(total + 0.1 * (len(counts) + 1))
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(t), total)
        assert r.n_known == sum(counts[w] > 0 for w in t)
        assert r.base_score == pytest.approx(sum(math.log10(counts[w] + 0.1) - below for w in t), rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_languages_of_held_out_documents(spark):
    langs = {r.doc_id: r.lang for r in Q.table(spark, SF, "documents").collect()}
    got = Q.op9_language(spark, SF).collect()
    assert len(got) == len(langs)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in out) >= 0.95 * len(out)


def test_benchmark_passages(spark, texts):
    items = {r.item_id: r.text for r in Q.table(spark, SF, "benchmark").collect()}
    whole = {(d, i) for i, t in items.items() for d, x in texts.items() if t in x}
    found = {(r.doc_id, r.item_id) for r in Q.op7_decontamination(spark, SF).collect()}
    assert whole <= found
