import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from paperloom.llm import bpe
from paperloom.llm.queries import vocabulary
from paperloom.llm.words import buffer_of

from .fixtures import AWKWARD, awkward, nothing, tiktoken_of


@pytest.fixture(scope="module")
def exact():
    return tiktoken_of(*vocabulary())


def test_ids_equal_tiktoken(exact):
    own, rng = bpe.codec(*vocabulary()), random.Random(4)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    tokens = [exact.decode([i]) for i in range(0, 50_000, 7)]
    texts += ["".join(rng.choices(tokens, k=rng.randint(1, 8))) for _ in range(20_000)]
    # runs of a few characters, where a token has most pairs
    texts += ["".join(rng.choices("ab -=.eé \n", k=rng.randint(1, 60))) for _ in range(10_000)]
    data, offsets = buffer_of(pa.array(texts, pa.string()))
    ids, rows = own.encode(data, offsets)
    want = exact.encode_ordinary_batch(texts, num_threads=4)
    assert all(ids[a:b].tolist() == w for a, b, w in zip(rows, rows[1:], want))


def test_round_trip(spark, exact):
    got = bpe.round_trip(awkward(spark).select("doc_id", "text"), *vocabulary(), keep_ids=True).collect()
    want = []
    for i, t in AWKWARD:
        ids = exact.encode_ordinary(t or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_offsets_and_decoding(spark, exact):
    frame = bpe.encode(awkward(spark), *vocabulary(), offsets=True)
    assert bpe.encode(nothing(spark), *vocabulary()).collect() == []
    for r in bpe.decode(frame, *vocabulary()).collect():
        assert r.decoded == (r.text or "") and r.node == "clash"
        at = 0
        for token, begin, end in zip(r.ids[:400], r.begins, r.ends, strict=False):
            raw = exact.decode_single_token_bytes(token)
            before = (r.text.encode()[:at]).decode("utf-8", "ignore")
            after = r.text.encode()[: at + len(raw)]
            assert begin == len(before)
            assert end == len(after.decode("utf-8", "ignore")) + (after.decode("utf-8", "replace")[-1:] == "�")
            at += len(raw)


def test_cache_can_be_emptied(monkeypatch, exact):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    own = bpe.Codec(*vocabulary())
    import pyarrow as pa

    texts = pa.array(["one two  three\n four", "it's  1234  x", "aaaaaaa banana"] * 3)
    for at, to, _, _, ids, rows in bpe._encoded(texts, own):
        for i in range(at, to):
            assert ids[rows[i - at] : rows[i - at + 1]].tolist() == exact.encode_ordinary(texts[i].as_py())
