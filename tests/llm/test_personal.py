import random
import re

from pyspark.sql import functions as F

from paperloom.llm import personal as P

from .fixtures import awkward, nothing

FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    out = [
        (m.start(), k, m.end(), kind)
        for k, (kind, pattern) in enumerate(FORMATS.items())
        for m in re.finditer(pattern, text)
        if passes(kind, m[0])
    ]
    return sorted(out)


PIECES = ["a.b", "@", "x-y", ".", "com", "_", "%", "+", "1", "255", "256", "0", "4111 1111 1111 1111", "4111111111111111"]
PIECES += [" ", "-", "(", ")", "+1 (555) 010-9999", "10.0.0.1", "é", "😀", "me@ex.org", "\n", "12", "0007"]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    base = P.base_spans(df, "text").collect()
    for r in base:
        assert [tuple(s) for s in r.base] == brute(r.text), r.text


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(6)
    texts = [f"words here then member mail user{i}@site{i % 7}.org and on" for i in range(40)]
    texts += [f"so member mail: user{i}(at)site{i}.org, he said" for i in range(5)]
    texts += [f"the year was {rng.randint(1000, 9999)}xy{i} or so" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in P.find_personal(df).collect()}
    assert all(got[i] == [("email", f"user{i}@site{i % 7}.org")] for i in range(40))
    assert all(got[40 + i] == [("context", f"user{i}(at)site{i}.org")] for i in range(5))
    assert all(got[i] == [] for i in range(45, 105))


def test_redaction(spark):
    texts = [(1, "😀 mail me@ex.org or +1 555 010 9999."), (2, "none"), (3, None)]
    df = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    out = P.find_personal(df, keep_text=True).withColumn("text", P.redacted(F.col("text"), F.col("spans")))
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: "😀 mail <email> or <phone>.", 2: "none", 3: None}


def test_awkward_rows_and_plan(spark):
    got = P.find_personal(awkward(spark), keep_text=True)
    assert got.count() == 12 and "node" in got.columns
    assert P.find_personal(nothing(spark)).collect() == []
    long = spark.createDataFrame([("1-" * 30000 + "a." * 20000 + "@" * 1000,)], "text STRING")
    assert len(P.find_personal(long).collect()) == 1
    assert "Python" not in got._jdf.queryExecution().toString()
