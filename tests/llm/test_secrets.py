import hashlib
import re
import zlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import secrets as S
from paperloom.llm.words import buffer_of

from .fixtures import awkward, nothing

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)


def brute(text):
    """The base spans, with the patterns run over the whole text."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


PIECES = st.sampled_from(
    ["password", "Token", "API_key", "apikey", "secret", "=", ":", " ", '"', "abc123", "deadbeef" * 3, "0" * 23, "é", "😀"]
    + ["AKIA", "AKIA" + "Q7" * 8, "zz", "_", ".", "passwd", "ſecret", "\n"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=14).map("".join), max_size=5))
def test_base_spans_equal_brute_force(texts):
    data, offsets = buffer_of(pa.array(texts, pa.string()))
    got = [[] for _ in texts]
    for row, start, kind, end in S.scan(S.automaton(), data, offsets):
        raw = data[offsets[row] :].tobytes()
        place = lambda b: len(raw[: b - offsets[row]].decode("utf-8", "ignore"))  # noqa: B023, E731
        got[row].append((place(start), kind, place(end)))
    assert got == [brute(t) for t in texts]


def base62(n):
    out = ""
    while n or len(out) < 6:
        n, r = divmod(n, 62)
        out = S.BASE62[r] + out
    return out


def test_checksums(spark):
    body = "0123456789abcdefghijABCDEFGHIJ"
    good = "ghp_" + body + base62(zlib.crc32(body.encode()))
    bad = "ghp_" + body + "000000"
    raw = b"\x04\x88\xad\xe4" + bytes(range(74))
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    value, key = int.from_bytes(raw, "big"), ""
    while value:
        value, r = divmod(value, 58)
        key = S.BASE58[r] + key
    texts = [f"é {good}.", f"{bad}", f"npm_{good[4:]}", key if key.startswith("xprv") else "", key[:-1] + "1", good + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in S.find_secrets(df).collect()}
    assert got[0] == [("github", 2, 42)] and got[1] == [] and got[2] == [("npm", 0, 40)]
    assert got[3] == ([("xprv", 0, 111)] if texts[3] else []) and got[4] == [] and got[5] == []


def test_awkward_rows(spark):
    got = S.find_secrets(awkward(spark)).collect()
    assert len(got) == 12 and all(r.spans == [] and r.node == "clash" for r in got)
    assert S.find_secrets(nothing(spark)).collect() == []
