"""Quality rules from how public tokenizers cut a text.

A text that is not the prose its language is written in costs a tokenizer more: fewer
characters per token, more bytes that no piece covers, or a distribution of tokens that is too
flat or too narrow. Each text is measured by public vocabularies, which are read and never
trained, and is rejected if a measure lies outside the band of its language (or script, where
no language is given) and its class of length. Bands come from exact counts over all texts.

Words are measured, each after a blank, so white space does not count; each distinct word of
a stretch of text is encoded once, and array operations put the tokens of every text together.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.matrix import counted, word_column
from paperloom.llm.words import BLANK, batch_rows, bounds, buffer_of, hash_words, mix, release, slices
from paperloom.session import fits_in_broadcast, stage

#: `[#*$%&|<>]`
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

SLICE = 1 << 21
#: Words whose tokens a Python worker remembers.
CACHED_WORDS = 200_000
#: A longer word is encoded in runs of this many characters.
RUN = 200
WINDOW = 8

#: Fewest words of a text that is judged, and percent of words in repeated windows.
FEWEST_WORDS, MOST_REPEATED = 20, 30
#: A group with fewer texts has no band.
FEWEST_TEXTS = 50
#: Half of a band: so many standard deviations, as told by the quartiles, ...
SPREADS = 5.0
#: ... but at least this share of the median, and this much.
LEAST_SHARE, LEAST = 0.08, {"chars_per_token": 0.0, "byte_chars_per_token": 0.0, "fallback_share": 0.05, "token_entropy": 0.05}
#: Pieces of a group that meets its bands by a shuffle.
PIECES = 32
#: Measures are counted in steps of 1 / STEPS.
STEPS = 1024
#: Middle half of a normal distribution, in standard deviations.
MIDDLE = 1.349

SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Hangul", "Thai")

_FIELDS = {
    "n_words": T.LongType(),
    "word_chars": T.LongType(),
    "n_symbols": T.LongType(),
    "n_dup_lines": T.LongType(),
    "n_repeat_words": T.LongType(),
    "n_tokens": T.LongType(),
    **{name: T.DoubleType() for name in LEAST},
}


class Vocabularies:
    """Two public vocabularies and the tokens of the words that were met last."""

    def __init__(self, pieces: bytes, ranks: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        mergeable = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.bytes = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=mergeable, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.tokens, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.n_bytes = np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        runs, first = words, np.arange(len(words))
        if max(map(len, words)) > RUN:
            cut = [range(0, len(w), RUN) for w in words]
            runs = [w[i : i + RUN] for w, of in zip(words, cut) for i in of]
            n_runs = np.array([len(of) for of in cut])
            first = np.cumsum(n_runs) - n_runs
        ids = self.pieces.encode(runs, num_threads=1)
        n = np.add.reduceat(np.fromiter(map(len, ids), np.int64, len(runs)), first)
        self.tokens = np.concatenate([self.tokens, np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
        # a blank begins each word, not each of its runs
        begins = np.zeros(len(runs), bool)
        begins[first] = True
        spaced = [" " + r if b else r for r, b in zip(runs, begins.tolist())]
        n = np.fromiter(map(len, map(self.bytes.encode_ordinary, spaced)), np.int64, len(runs))
        self.n_bytes = np.concatenate([self.n_bytes, np.add.reduceat(n, first)])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))

    def places(self, words: list[str]) -> np.ndarray:
        """Where the words' tokens are: ``tokens[ends[i]:ends[i + 1]]`` and ``n_bytes[i]``."""
        if len(self.known) > CACHED_WORDS:
            self.forget()
        if new := [w for w in words if w not in self.known]:
            self.learn(new)
        return np.array([self.known[w] for w in words], np.int64)


@lru_cache(maxsize=2)
def vocabularies(pieces: bytes, ranks: bytes, pattern: str) -> Vocabularies:
    return Vocabularies(pieces, ranks, pattern)


def _sums(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[cut[1:]] - total[cut[:-1]]


def repeated_words(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many words of each row are in runs of ``WINDOW`` words that it has twice or more."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(len(rows) - 1, np.int64)
    coef = np.random.default_rng(11).integers(1, 2**64, WINDOW, dtype=np.uint64) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        total += hashes[i : i + n] * coef[i]
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    whole = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    _, inverse, count = np.unique(
        mix(total[whole]) ^ mix(row[whole].astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True
    )
    again = whole[count[inverse] > 1]
    covers = np.zeros(len(hashes) + 1, np.int64)
    covers[again] += 1
    covers[again + WINDOW] -= 1
    return _sums(np.cumsum(covers)[:-1] > 0, rows)


def repeated_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many lines of each row hold a word and are equal to an earlier line of it."""
    begin, end = bounds(data, offsets, _NOT_LINE)
    with_word = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[with_word], end[with_word]
    row = np.searchsorted(offsets, begin, "right") - 1
    line = mix(hash_words(data, begin, end, _NOT_LINE)) ^ mix(row.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(line, return_index=True)
    again = np.ones(len(line), bool)
    again[first] = False
    return np.bincount(row[again], minlength=len(offsets) - 1)


_NOT_LINE = np.zeros(256, bool)
_NOT_LINE[0x0A] = True


def measured(data: np.ndarray, offsets: np.ndarray, own: Vocabularies) -> dict[str, np.ndarray]:
    """Counts and measures of some texts."""
    n = len(offsets) - 1
    words, rows = word_column(data, offsets)
    starts, ends = bounds(data, offsets, BLANK)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    hashes = hash_words(data, starts, ends, BLANK)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    place = own.places(coded.dictionary.to_pylist())
    size = (own.ends[place + 1] - own.ends[place]) if len(place) else np.zeros(0, np.int64)
    out = {
        "n_words": np.diff(rows),
        "word_chars": _sums((chars[ends] - chars[starts]) if len(ends) else np.zeros(0, np.int64), rows),
        "n_symbols": _sums(SYMBOL[data], offsets),
        "n_dup_lines": repeated_lines(data, offsets, starts),
        "n_repeat_words": repeated_words(hashes, rows),
        "n_tokens": _sums(size[codes], rows),
    }
    # the tokens of each text: those of its distinct words, as often as the words
    indptr, indices, count = counted(codes, rows, len(place))
    row = np.repeat(np.arange(n), np.diff(indptr))
    many = size[indices]
    before = np.cumsum(many) - many
    token = own.tokens[np.repeat(own.ends[place[indices]] - before, many) + np.arange(int(many.sum()))] if len(many) else np.zeros(0, np.int32)
    of, times = np.repeat(row, many), np.repeat(count, many)
    entry, inverse = np.unique(of * len(own.is_byte) + token, return_inverse=True)
    often = np.bincount(inverse, times, len(entry))
    entropy = np.bincount(entry // len(own.is_byte), often * np.log2(np.maximum(often, 1)), n)
    total = out["n_tokens"]
    some = np.maximum(total, 1)
    bits = np.log2(some) - entropy / some
    fallback = np.bincount(of, times * own.is_byte[token], n) if len(token) else np.zeros(n)
    return out | {
        "chars_per_token": out["word_chars"] / some,
        "byte_chars_per_token": out["word_chars"] / np.maximum(1, _sums(own.n_bytes[place][codes] if len(place) else np.zeros(0, np.int64), rows)),
        "fallback_share": fallback / some,
        "token_entropy": bits / np.maximum(1.0, np.log2(some)),
    }


def measure(docs: DataFrame, pieces: str, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with the counts and measures of each text in place of it.

    * n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words;
    * n_tokens and chars_per_token by the vocabulary ``pieces`` (with byte fallback);
    * fallback_share: tokens that are single bytes, of all; token_entropy: that of the text's
      tokens, as a share of the most that so many tokens could have; both by ``pieces``;
    * byte_chars_per_token: characters per token by the byte-level vocabulary ``ranks``.

    A null, empty or blank text has zeros throughout. Words longer than ``RUN`` characters are
    encoded in runs of that length, so a text without blanks costs no more than others. Words,
    lines and windows are told apart by 64-bit hashes. Columns of ``docs`` that are called
    like a new one are replaced, others stay.
    """
    spark = docs.sparkSession
    batch_rows(spark)
    kept = [f for f in docs.schema.fields if f.name not in _FIELDS and f.name != text]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in _FIELDS.items())])
    files = []
    for path in (pieces, ranks):
        with open(path, "rb") as file:  # a vocabulary: of fixed size, whatever the data
            files.append(file.read())
    shared = spark.sparkContext.broadcast(tuple(files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(*shared.value, pattern)
        for batch in batches:
            data, offsets = buffer_of(batch.column(len(kept)))
            for at, to in slices(data, offsets, SLICE):
                found = measured(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], own)
                columns = [batch.column(i).slice(at, to - at) for i in range(len(kept))]
                columns += [pa.array(found[n]).cast(pa.float64() if t == T.DoubleType() else pa.int64()) for n, t in _FIELDS.items()]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
        own.forget()
        release()

    return docs.select(*(f.name for f in kept), text).mapInArrow(run, schema)


def language_or_script(lang: Column, text: Column) -> Column:
    """The language, or where it is null the script of most letters (ties by ``SCRIPTS``)."""
    counts = F.array(*[F.struct(F.regexp_count(text, F.lit(rf"\p{{Is{s}}}")).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("script")) for i, s in enumerate(SCRIPTS)])
    most = F.array_max(counts)
    return F.when(lang.isNotNull(), lang).otherwise(F.when(most["n"] > 0, most["script"]))


def bands(rows: DataFrame) -> DataFrame:
    """(group, length, measure, low, high): what is usual in each group and class of length.

    Every text that no base rule rejects counts, by steps of each measure; the quartiles are
    taken from these exact counts, so they do not depend on how rows are dealt. A hot group or
    value is summed up in each task before it is shuffled.
    """
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) * STEPS).alias("step")) for m in LEAST])
    steps = (
        rows.where(~F.col("base_failed") & F.col("group").isNotNull())
        .select("group", "length", F.inline(measures))
        .groupBy("group", "length", "measure", "step")
        .agg(F.count("*").alias("n"))
    )
    own = Window.partitionBy("group", "length", "measure")
    upto = own.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = steps.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(own)})

    def quartile(k: int) -> Column:
        return (F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("step"))) + 0.5) / STEPS

    found = placed.groupBy("group", "length", "measure").agg(
        *(quartile(k).alias(f"q{k}") for k in (1, 2, 3)), F.first("all").alias("n_texts")
    )
    least = F.create_map(*[x for m, v in LEAST.items() for x in (F.lit(m), F.lit(v))])[F.col("measure")]
    # each side by its own quartile, as a measure may be skewed
    below, above = (
        F.greatest(d * (2 * SPREADS / MIDDLE), F.col("q2") * LEAST_SHARE, least)
        for d in (F.col("q2") - F.col("q1"), F.col("q3") - F.col("q2"))
    )
    return found.where(F.col("n_texts") >= FEWEST_TEXTS).select(
        "group", "length", "measure", (F.col("q2") - below).alias("low"), (F.col("q2") + above).alias("high")
    )


def judge(docs: DataFrame, pieces: str, ranks: str, pattern: str) -> DataFrame:
    """``docs`` (with text and lang) without its text, with the columns of ``measure``,
    ``base_failed``, ``outside`` (the measures out of their band) and ``kept``.

    Each row is judged for itself: repeated and null ids make no difference. A text of fewer
    than ``FEWEST_WORDS`` words, null ones among them, or with too many words in repeated
    windows, fails the base rules. Groups of fewer than ``FEWEST_TEXTS`` texts of a length
    have no band and reject nothing, nor does a text without a language and without letters
    of a known script get one. An empty table gives no rows.
    """
    group = language_or_script(F.col("lang"), F.coalesce("text", F.lit("")))
    own = [c for c in docs.columns if c not in ("group", "length", "base_failed", "outside", "kept")]
    found = measure(docs.select(*own, group.alias("group")), pieces, ranks, pattern)
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    length = F.floor(F.log2(F.greatest("n_words", F.lit(1)).cast("double"))).cast("int")
    rows = stage(found.withColumns({"base_failed": failed, "length": length}), "measured")
    band = F.struct("measure", "low", "high")
    # a row for each group and length, with four bands at most
    usual = bands(rows).groupBy("group", "length").agg(F.map_from_entries(F.collect_list(F.struct("measure", band))).alias("bands"))
    usual = stage(usual, "bands")
    if fits_in_broadcast(usual, F.to_json("bands")):
        met = rows.join(F.broadcast(usual), ["group", "length"], "left")
    else:
        # a group with most of the texts is dealt over several keys
        piece = F.xxhash64("n_tokens", "n_words", "word_chars").bitwiseAND(F.lit(PIECES - 1))
        pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PIECES - 1).cast("long")))
        met = rows.withColumn("_piece", piece).join(
            usual.withColumn("_piece", pieces), ["group", "length", "_piece"], "left"
        ).drop("_piece")

    def out(m: str) -> Column:
        b = F.col("bands")[m]
        return F.when(~F.col(m).between(b["low"], b["high"]), F.lit(m))

    outside = F.array_compact(F.array(*[out(m) for m in LEAST]))
    kept = ~F.col("base_failed") & (F.size("outside") == 0)
    return met.withColumn("outside", outside).withColumn("kept", kept).drop("bands")
