import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from paperloom.llm import fertility as Fy
from paperloom.llm.queries import vocabulary
from paperloom.llm.words import buffer_of

from .fixtures import AWKWARD, awkward, nothing

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = r"[^\x20\x09-\x0D]+"


def own():
    path, pattern = vocabulary()
    return Fy.vocabularies(open(PIECES, "rb").read(), open(path, "rb").read(), pattern)


def brute(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) by the definition."""
    w = re.findall(WORD, text)
    lines = text.split("\n")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    dup = sum(bool(re.search(WORD, x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def random_texts(seed):
    rng = random.Random(seed)
    parts = ["a", "b b", " ", "\n", "\n", "a b c d e f g h i", "x" * 450, "été", "😀", "\t", "#*", "Ωμέγα", "a b c d e f g h i\n", "\r"]
    return ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(40))) for _ in range(40)]


@pytest.mark.parametrize("seed", range(4))
def test_counts_and_measures_equal_brute_force(seed):
    texts = [t or "" for _, t in AWKWARD] + random_texts(seed)
    v = own()
    found = Fy.measured(*buffer_of(pa.array(texts, pa.string())), v)
    for i, text in enumerate(texts):
        got = tuple(int(found[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        if len(text) > 60000:  # the definition is too slow; its words are all equal
            assert got == (30000, 120000, 0, 0, 30000)
            continue
        assert got == brute(text)
        runs = [[w[k : k + Fy.RUN] for k in range(0, len(w), Fy.RUN)] for w in re.findall(WORD, text)]
        tokens = [t for of in runs for r in of for t in v.pieces.encode(r)]
        n_bytes = sum(len(v.bytes.encode_ordinary(r if k else " " + r)) for of in runs for k, r in enumerate(of))
        n, chars = len(tokens), got[1]
        assert found["n_tokens"][i] == n
        assert found["chars_per_token"][i] == pytest.approx(chars / n if n else 0)
        assert found["byte_chars_per_token"][i] == pytest.approx(chars / n_bytes if n else 0)
        assert found["fallback_share"][i] == pytest.approx(sum(v.pieces.is_byte(t) for t in tokens) / max(1, n))
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(tokens).values())
        assert found["token_entropy"][i] == pytest.approx(entropy / max(1, math.log2(n)) if n else 0, abs=1e-9)


def test_remembered_words_do_not_matter(monkeypatch):
    texts = random_texts(9)
    raw = buffer_of(pa.array(texts, pa.string()))
    want = Fy.measured(*raw, own())
    monkeypatch.setattr(Fy, "CACHED_WORDS", 3)
    for i, text in enumerate(texts):
        got = Fy.measured(*buffer_of(pa.array([text], pa.string())), own())
        assert all(got[c][0] == pytest.approx(want[c][i]) for c in got)


def brute_bands(rows):
    """Bands of (group, length, value) for chars_per_token, from sorted steps."""
    out = {}
    for key in {r[:2] for r in rows}:
        steps = sorted(math.floor(r[2] * Fy.STEPS) for r in rows if r[:2] == key)
        if len(steps) >= Fy.FEWEST_TEXTS:
            q1, q2, q3 = ((steps[math.ceil(len(steps) * k / 4) - 1] + 0.5) / Fy.STEPS for k in (1, 2, 3))
            side = lambda d: max(d * 2 * Fy.SPREADS / Fy.MIDDLE, q2 * Fy.LEAST_SHARE)  # noqa: B023, E731
            out[key] = (pytest.approx(q2 - side(q2 - q1)), pytest.approx(q2 + side(q3 - q2)))
    return out


def test_bands_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["en", "de", "xx"]), rng.choice([5, 6]), rng.gauss(2, 0.2)) for _ in range(400)] + [("rare", 5, 1.0)] * 9
    data = [(g, n, False, v, 0.0, 0.0, 0.0) for g, n, v in rows] + [("en", 5, True, 99.0, 0.0, 0.0, 0.0), (None, 5, False, 9.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(data, ["group", "length", "base_failed", *Fy.LEAST])
    got = {(r.group, r.length): (r.low, r.high) for r in Fy.bands(df.repartition(5)).where("measure = 'chars_per_token'").collect()}
    assert got == brute_bands(rows)
    assert len(got) == 6


def judged(spark, docs):
    path, pattern = vocabulary()
    return Fy.judge(docs, PIECES, path, pattern)


def test_unusual_texts_are_rejected(spark):
    rng = np.random.default_rng(3)
    words = ["the", "house", "river", "of", "and", "was", "evening", "a", "small", "light", "over", "water", "garden", "said"]
    prose = [(i, " ".join(rng.choice(words, 60)) + " .", "en") for i in range(120)]
    odd = [(200, " ".join(w + "$$%%" for w in rng.choice(words, 60)), "en"), (201, " ".join("qzxjkvwq" for _ in range(40)) + " x", "en")]
    odd += [(202, " ".join(chr(0x13000 + k) * 3 for k in range(60)), "en"), (203, "too short", "en")]
    df = spark.createDataFrame(prose + odd, "doc_id BIGINT, text STRING, lang STRING")
    got = {r.doc_id: r for r in judged(spark, df).collect()}
    assert [i for i, r in got.items() if not r.kept] == [200, 201, 202, 203]
    assert "fallback_share" in got[202].outside
    assert [got[i].base_failed for i in (200, 201, 202, 203)] == [False, True, False, True]


def test_script_where_no_language_is_given(spark):
    texts = ["Река и дом", "das Haus", "река house дома", "12 34", "", "山川"]
    df = spark.createDataFrame([(None, t) for t in texts] + [("en", "Река")], "lang STRING, text STRING")
    got = [r[0] for r in df.select(Fy.language_or_script(Fy.F.col("lang"), Fy.F.col("text"))).collect()]
    assert got == ["Cyrillic", "Latin", "Cyrillic", None, None, "Han", "en"]


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("kept", Fy.F.lit("old")).withColumn("n_words", Fy.F.lit("old")).withColumn("group", Fy.F.lit("old"))
    got = judged(spark, docs.repartition(3)).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        (text,) = {t or "" for i, t in AWKWARD if i == r.doc_id}
        n, *_, repeated = brute(text) if len(text) < 60000 else (30000, 30000)
        assert r.n_words == n
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n)
        assert r.node == "clash"
    assert judged(spark, nothing(spark)).collect() == []
