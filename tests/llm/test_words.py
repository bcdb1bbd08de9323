import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import words as W

from .fixtures import words

TEXT = st.text(alphabet=st.sampled_from("aAbZ é\t\n\x0b\x1c x"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8), st.integers(1, 60))
def test_words_and_hashes(texts, size):
    seen = {}
    rows = 0
    for at, to, w in W.words(pa.array(texts, pa.string()), size=size):
        for i in range(at, to):
            got = w.hashes[w.rows[i - at] : w.rows[i - at + 1]].tolist()
            want = words(texts[i])
            assert len(got) == len(want)
            assert all(seen.setdefault(a, b) == b for a, b in zip(want, got, strict=True))
        rows += to - at
    assert rows == len(texts) and len(set(seen.values())) == len(seen)


def test_windows_do_not_change_hashes(monkeypatch):
    texts = pa.array(["ab " * 50 + "q" * 300 + " ab", "cd"])
    whole = [w.hashes.tolist() for _, _, w in W.words(texts)]
    monkeypatch.setattr(W, "WINDOW", 16)
    monkeypatch.setattr(W, "_POWERS", {})
    assert [w.hashes.tolist() for _, _, w in W.words(texts)] == whole


def test_shingles_of_short_rows():
    w = next(iter(W.words(pa.array(["a b c d", "a b", "", "a b"]))))[2]
    s = W.shingles(w, 3)
    assert s.counts().tolist() == [2, 1, 0, 1]
    assert s.hashes[2] == s.hashes[3] and len(np.unique(s.hashes)) == 3
