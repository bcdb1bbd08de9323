import random

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import language as L

from .fixtures import awkward, nothing

WORDS = {"en": "the of and house water tree with", "de": "der die und haus wasser baum über", "fr": "le la et maison eau arbre élève"}


def corpus(spark, n=60):
    rng = random.Random(1)
    rows = [
        (i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(5, 60))), lang)
        for i, lang in enumerate(sorted(WORDS) * n)
    ]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")


def test_accuracy_and_rejection(spark):
    models = L.fit(corpus(spark))
    assert models.languages == ["de", "en", "fr"]
    texts = ["The tree and the water", "Über das Haus und der Baum", "L'élève et la maison", "zqxj wvkq xxqz jjkw qqzx", "12 ..", None]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, lang STRING, score INT")
    got = {r.doc_id: r for r in L.identify(df, models).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["en", "de", "fr", got[3].lang_pred, "und", "und"]
    assert [got[i].accepted for i in range(6)] == [True, True, True, False, False, False]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[4].score == 0 and got[0].lang == "x"


def probability(models, gram, k):
    at, hit = L.find(models.grams, L._hash_strings([gram]))
    if hit[0]:
        return np.exp(models.logp[at[0], k])
    if len(gram) == 1:
        return np.exp(models.unknown[k])
    at, hit = L.find(models.contexts, L._hash_strings([gram[:-1]]))
    return (np.exp(models.backoff[at[0], k]) if hit[0] else 1.0) * probability(models, gram[1:], k)


def test_probabilities_sum_to_one():
    words = {"a": {"xyx": 5, "xx": 2, "yyxxy": 1}, "b": {"yx": 4, "zy": 3}}
    counts = {}
    for lang, own in words.items():
        counts[lang] = {}
        for word, n in own.items():
            padded = f" {word} "
            for i in range(1, len(padded)):
                gram = padded[max(0, i + 1 - L.ORDER) : i + 1]
                counts[lang][gram] = counts[lang].get(gram, 0) + n
    models = L.kneser_ney(counts)
    for k in range(2):
        for context in ("", " ", "x", " x", "yx", "xyx", " zy", "zzz"):
            total = sum(probability(models, context + c, k) for c in " xyz?")
            assert total == pytest.approx(1.0), (context, k)


def test_repeated_words_are_scored_alike(spark):
    models = L.fit(corpus(spark))
    whole, n = L.score_texts(models, pa.array(["the tree the tree", "the tree", "", None]))
    assert abs(whole[0] - 2 * whole[1]).max() < 1e-9
    assert n.tolist() == [18, 9, 0, 0]  # letters and word ends


def test_awkward_rows(spark):
    models = L.fit(corpus(spark))
    got = L.identify(awkward(spark), models)
    assert got.count() == 12 and "node" in got.columns
    assert L.identify(nothing(spark), models).collect() == []
    untaught = L.fit(nothing(spark))
    assert {(r.lang_pred, r.score, r.accepted) for r in L.identify(awkward(spark), untaught).collect()} == {("und", 0.0, False)}


def test_only_letters_count(spark):
    models = L.fit(corpus(spark))
    none = ["— “” …", "😀😀 🎉", "٣٤٥ １２", " 　", "́ ", "™ © →"]
    texts = [*none, "the tree and the water", "the 😀tree — “and” the　water…"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    got = {r.doc_id: r for r in L.identify(df, models).collect()}
    assert {(got[i].lang_pred, got[i].score, got[i].accepted) for i in range(len(none))} == {("und", 0.0, False)}
    clean, mixed = got[len(none)], got[len(none) + 1]
    assert clean.lang_pred == mixed.lang_pred == "en" and clean.cross_entropy == pytest.approx(mixed.cross_entropy)
