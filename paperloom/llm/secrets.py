"""Secret scans: a keyword automaton first, regular expressions only at its hits.

One Aho-Corasick pass over a slice of the text column finds all keywords; a pattern is then
tried at the place of its keyword and nowhere else. Long runs of hex digits have no keyword
and come from byte classes. Token formats that carry a checksum count only when it is right.

Kinds: ``assign``, ``access``, ``hex`` (see ``BASE``), ``github`` and ``npm`` (the last six
characters are the CRC-32 of the rest in base 62) and ``xprv`` (an extended private key,
whose last four bytes are a double SHA-256 of the rest). Matches of a kind are the leftmost
ones without overlap; a match that fails its check is dropped and not tried again from
within. Places count code points, ends are exclusive. Spans come by start, then by kind as
listed. Null and empty texts have none; texts are searched whole; repeated rows are alike.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.spans import SPANS
from paperloom.llm.words import FOLD, batch_rows, bounds, buffer_of, slices

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "xprv")
HEX_DIGITS = 24
NOT_HEX = np.ones(256, bool)
NOT_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = False

ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
XPRV = re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def crc_in_base62(m: re.Match) -> bool:
    crc, said = zlib.crc32(m[1]), 0
    for c in m[2].decode():
        said = said * 62 + BASE62.index(c)
    return said == crc


def base58_checked(m: re.Match) -> bool:
    value = 0
    for c in m[0].decode():
        value = value * 58 + BASE58.index(c)
    if value >= 1 << (82 * 8):
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


#: Keywords in lower case, with their kind, pattern and check.
RULES = {
    **dict.fromkeys(
        ("password", "passwd", "secret", "token", "apikey", "api_key"), ("assign", ASSIGN, lambda m: len(m[2]) >= 6)
    ),
    "akia": ("access", ACCESS, lambda m: len(m[0]) >= 20),
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("github", GITHUB, crc_in_base62)),
    "npm_": ("npm", NPM, crc_in_base62),
    "xprv": ("xprv", XPRV, base58_checked),
}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, rule in RULES.items():
        a.add_word(word, (len(word), *rule))
    a.make_automaton()
    return a


def scan(words, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, start, place of the kind, end) in bytes, of all rows of a slice."""
    found = []
    starts, ends = bounds(data, offsets, NOT_HEX)
    for k in np.flatnonzero(ends - starts >= HEX_DIGITS):
        row = int(np.searchsorted(offsets, starts[k], "right")) - 1
        found.append((row, int(starts[k]), KINDS.index("hex"), int(ends[k])))
    raw = data.tobytes()
    # one character for each byte, so that places are those of the bytes
    hits = [(end + 1 - n, kind, pattern, check) for end, (n, kind, pattern, check) in words.iter(FOLD[data].tobytes().decode("latin-1"))]
    hits.sort(key=lambda h: h[0])
    done: dict[tuple[int, str], int] = {}
    for start, kind, pattern, check in hits:
        row = int(np.searchsorted(offsets, start, "right")) - 1
        if start < done.get((row, kind), 0):
            continue
        m = pattern.match(raw, start, int(offsets[row + 1]))
        if m:
            done[row, kind] = m.end()
            if check(m):
                found.append((row, start, KINDS.index(kind), m.end()))
    return sorted(found)


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without the text, with ``spans``, an array of (kind, start, end)."""
    kept = [c for c in df.columns if c not in (text, "spans")]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            data, offsets = buffer_of(batch.column(batch.num_columns - 1))
            for at, to in slices(data, offsets):
                part, cut = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
                begun = None
                for row, start, k, end in scan(words, part, cut):
                    if begun is None:
                        begun = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                    first = begun[cut[row]]
                    rows[at + row].append(
                        {"kind": KINDS[k], "start": int(begun[start] - first), "end": int(begun[end] - first)}
                    )
            own = {name: batch.column(i) for i, name in enumerate(kept)}
            yield pa.RecordBatch.from_pydict(own | {"spans": pa.array(rows, kind)})

    batch_rows(df.sparkSession)
    schema = df.select(*kept).schema.add("spans", SPANS)
    return df.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)
