"""Rows that every operator must stand: nulls, empty and long texts, ties, repeats, clashes."""

import base64
import re

AWKWARD = [
    (1, "One fish two fish red fish blue fish old fish new fish"),
    (2, None),
    (3, ""),
    (4, "  \t\n "),
    (None, "A text without an id, which is a row like any other row in the table"),
    (5, "One fish two fish red fish blue fish old fish new fish"),
    (5, "One fish two fish red fish blue fish old fish new fish"),
    (6, "héé ÀÉ ñandú straße 😀😀 naïve café   x"),
    (7, "word " * 30000),
    (8, "x" * 50000),
    (9, "12 34"),
    (10, "a"),
]


def awkward(spark):
    """The rows, with columns that other operators make."""
    rows = [(i, t, "en", "s", None, "clash", 1.5) for i, t in AWKWARD]
    return spark.createDataFrame(
        rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, node STRING, score DOUBLE"
    )


def nothing(spark):
    return awkward(spark).limit(0)


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text))


def shingle_set(text, size):
    w = words(text)
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


def tiktoken_of(path, pattern):
    """The reference encoder of a vocabulary of ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
