"""Phrases that occur together more than apart, mined by stripes.

A stripe is the counter of the words that follow one prefix: the empty prefix, a word, two
words and so on. Tasks count stripes of their texts, equal prefixes meet in a shuffle, and
their counters are added elementwise. A merged stripe gives the counts of the prefix's extensions, among
them those of the prefixes that are longer by a word, and the most frequent extension, which
decides subsumption; the sum of the empty prefix's stripe is the number of words.

Three passes over the texts count the stripes of the empty prefix, of words and of longer
prefixes. A phrase is no more frequent than its parts, so the second pass counts no rare
words, and the third no words that end a rare pair. Which are frequent
is told to the tasks by a bit table of fixed size: a rare phrase that shares a frequent one's
bit is counted in vain, and a frequent one is never missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.matrix import word_column
from paperloom.llm.words import BLANK, FOLD, batch_rows, bounds, buffer_of, hash_words, mix, release, slices
from paperloom.session import stage

#: `[.,;:!?\x0A-\x0D]` ends a piece; `[\x20\x09]` separates words within it.
ENDS_PIECE = np.zeros(256, bool)
ENDS_PIECE[list(b".,;:!?\n\x0b\x0c\r")] = True
SEPARATES = BLANK | ENDS_PIECE

#: Bytes of a language's texts whose stripes are counted together.
SLICE = 1 << 23
#: Bits of the table of frequent phrases; 4 MB, whatever the data.
BITS = 25
#: A prefix with over a ``HOT``-th of all words has its stripe cut into ``SEGMENTS`` by the
#: following word; there are ``HOT`` such prefixes of one length at most.
HOT, SEGMENTS = 200, 64
#: Pieces of a language whose best phrases are found apart before they are ranked together.
PIECES = 32

#: A counter as its tasks send it: words joined by blanks, and counts as 32-bit integers.
STRIPE = "lang string, size int, prefix string, segment int, next string, n binary"
MERGED = "lang string, size int, prefix string, segment int, total bigint, next array<string>, n array<bigint>, slot array<int>"
KEY = ("lang", "size", "prefix", "segment")


def _hashes(column: pa.Array) -> np.ndarray:
    """A hash for each string, none of which is empty."""
    data, offsets = buffer_of(column)
    return hash_words(data, offsets[:-1], offsets[1:], np.zeros(256, bool))


def _chained(before: np.ndarray | np.uint64, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from the hash of its prefix and of its last word."""
    return mix(np.atleast_1d(before) * np.uint64(0x9E3779B97F4A7C15) + word)


def _root(lang: str) -> np.uint64:
    return mix(np.frombuffer(lang.encode().ljust(8, b"\0")[:8], np.uint64) ^ np.uint64(len(lang)))[0]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


class Known:
    """What the tasks of a pass know: the frequent phrases of the length before, as bits, and
    the hot prefixes, as sorted hashes."""

    def __init__(self, bits: np.ndarray, hot: np.ndarray):
        self.bits, self.hot = bits, np.sort(hot)

    def frequent(self, hashes: np.ndarray) -> np.ndarray:
        slot = _slot(hashes)
        return (self.bits[slot >> 6] >> (slot & 63)) & 1 == 1


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _stripes_of(lang: str, texts: pa.Array, sizes: tuple[int, ...], known: Known | None) -> Iterator[pa.RecordBatch]:
    """Stripes of the prefixes of some sizes in texts of one language."""
    raw, offsets = buffer_of(texts)
    data = FOLD[raw]
    words, rows = word_column(data, offsets, SEPARATES)
    coded = words.dictionary_encode()
    code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    n, root = len(code), _root(lang)
    if not n:
        return
    own = _hashes(names)
    # a word goes on with the next one unless a piece or a text ends between them
    starts, _ = bounds(data, offsets, SEPARATES)
    goes_on = np.diff(np.cumsum(ENDS_PIECE[data])[starts], append=-1) == 0
    goes_on[rows[1:][rows[1:] > 0] - 1] = False

    def emitted(size: int, at: np.ndarray, prefix: pa.Array, hashes: np.ndarray, follows: np.ndarray) -> pa.RecordBatch:
        """``at`` is the prefix's number at each occurrence, ``follows`` the next word, or -1 where
        none is counted."""
        goes = follows >= 0
        at, follows = at[goes], follows[goes]
        hot = np.isin(hashes, known.hot) if known else np.ones(len(hashes), bool)
        segment = np.where(hot[at], (own[follows] & np.uint64(SEGMENTS - 1)).astype(np.int64), 0)
        entry, count = np.unique((at * SEGMENTS + segment) * len(names) + follows, return_counts=True)
        stripe, word = np.divmod(entry, len(names))
        first = np.flatnonzero(np.diff(stripe, prepend=-1))
        kept = np.append(first, len(entry))
        of, cut = np.divmod(stripe[first], SEGMENTS)
        raw = pa.py_buffer(count.astype("<i4"))
        joined = pc.binary_join(_lists(kept, names.take(pa.array(word))), pa.scalar(" ", pa.large_string()))
        columns = [
            pa.array([lang] * len(first), pa.string()),
            pa.array(np.full(len(first), size, np.int32)),
            prefix.take(pa.array(of)).cast(pa.string()),
            pa.array(cut.astype(np.int32)),
            joined.cast(pa.string()),
            pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((kept * 4).astype(np.int32)), raw]),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in STRIPE.split(", ")])

    if 0 in sizes:
        yield emitted(0, np.zeros(n, np.int64), pa.array([""], pa.large_string()), np.array([root]), code)
    elif 1 in sizes:
        ok = known.frequent(_chained(root, own))[code]
        at = np.flatnonzero(ok)
        after = np.minimum(at + 1, n - 1)
        follows = np.where(goes_on[at] & ok[after], code[after], -1)
        yield emitted(1, code[at], names, _chained(root, own), follows)
    else:
        first = _chained(root, own)[code]
        pair = np.zeros(n, np.uint64)
        pair[:-1] = _chained(first[:-1], own[code[1:]])
        ok = goes_on & known.frequent(pair)
        at, ids, prefix = np.flatnonzero(ok), code, names
        for size in range(2, max(sizes) + 1):
            # prefixes of this size, numbered by the shorter prefix and its next word; the
            # longer ones are as hot as their first two words
            unique, where, ids_here = np.unique(
                ids[at] * len(names) + code[at + size - 1], return_index=True, return_inverse=True
            )
            shorter, last = np.divmod(unique, len(names))
            prefix = pc.binary_join_element_wise(prefix.take(pa.array(shorter)), names.take(pa.array(last)), pa.scalar(" ", pa.large_string()))
            onward = ok[at + size - 1]
            follows = np.where(onward, code[np.minimum(at + size, n - 1)], -1)
            yield emitted(size, ids_here, prefix, pair[at][where], follows)
            ids = np.zeros(n, np.int64)
            ids[at] = ids_here
            at = at[onward]
            if not len(at):
                break


def _counted(docs: DataFrame, sizes: tuple[int, ...], known: Known | None, support: int, name: str) -> DataFrame:
    """Merged stripes of all prefixes of some sizes: (lang, size, prefix, segment, total, next,
    n, slot) with the extensions of at least ``support`` occurrences."""
    spark = docs.sparkSession
    batch_rows(spark)
    shared = spark.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        filled: dict[str, int] = {}

        def counted_of(lang: str) -> Iterator[pa.RecordBatch]:
            own = pa.chunked_array([x.cast(pa.large_string()) for x in held.pop(lang)]).combine_chunks()
            filled.pop(lang)
            data, offsets = buffer_of(own)
            for at, to in slices(data, offsets, SLICE):
                yield from _stripes_of(lang, own.slice(at, to - at), sizes, shared.value)

        for batch in batches:
            langs, texts = batch.column(0), batch.column(1)
            for lang in pc.unique(langs).to_pylist():
                own = texts.filter(pc.equal(langs, lang))
                held.setdefault(lang, []).append(own)
                filled[lang] = filled.get(lang, 0) + own.nbytes
            while filled and (max(filled.values()) >= SLICE or sum(filled.values()) >= 2 * SLICE):
                yield from counted_of(max(filled, key=filled.get))
        for lang in list(held):
            yield from counted_of(lang)
        release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = _counters(batch)
            merged = _merged(table if held is None else pa.concat_tables([held, table]))
            # the last stripe may go on in the next batch
            held = merged.slice(merged.num_rows - 1)
            yield from finished(merged.slice(0, merged.num_rows - 1))
        if held is not None:
            yield from finished(held)
        release()

    def finished(stripes: pa.Table) -> Iterator[pa.RecordBatch]:
        if not stripes.num_rows:
            return
        stripes = stripes.combine_chunks()
        next_, n = (stripes.column(c).combine_chunks() for c in ("next", "n"))
        at = np.repeat(np.arange(stripes.num_rows), np.diff(n.offsets.to_numpy()))
        count = n.flatten().to_numpy()
        total = _sums(at, count, stripes.num_rows)
        often = count >= support
        at, words, count = at[often], next_.flatten().filter(pa.array(often)), count[often]
        prefix = stripes.column("prefix").combine_chunks()
        roots = {lang: _root(lang) for lang in pc.unique(stripes.column("lang")).to_pylist()}
        before = np.array([roots[x] for x in stripes.column("lang").to_pylist()], np.uint64)
        if sizes == (1,):
            before = _chained(before, _hashes(prefix))
        slot = _slot(_chained(before[at], _hashes(words))) if max(sizes) < 2 and len(at) else np.zeros(len(at), np.int64)
        kept = np.searchsorted(at, np.arange(stripes.num_rows + 1))
        columns = [
            *(stripes.column(c).combine_chunks() for c in KEY),
            pa.array(total),
            _lists(kept, words),
            _lists(kept, pa.array(count)),
            _lists(kept, pa.array(slot.astype(np.int32))),
        ]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in MERGED.split(", ")])

    read = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where(F.col("text").isNotNull())
    counted = read.mapInArrow(count, STRIPE)
    met = counted.repartition(*KEY).sortWithinPartitions(*KEY)
    found = stage(met.mapInArrow(merge, MERGED), name)
    shared.unpersist()
    return found


def _sums(at: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, at, count)
    return out


def _counters(stripes: pa.RecordBatch) -> pa.Table:
    """Stripes as the tasks send them, with their counters as lists."""
    columns = {c: stripes.column(c) for c in KEY}
    columns["next"] = pc.split_pattern(stripes.column("next"), " ")
    n = np.concatenate([np.zeros(0, "<i4"), *(np.frombuffer(x.as_buffer(), "<i4") for x in stripes.column("n"))])
    columns["n"] = _lists(columns["next"].offsets.to_numpy(), pa.array(n.astype(np.int64)))
    return pa.table(columns)


def _merged(stripes: pa.Table) -> pa.Table:
    """Adds the stripes of equal keys, which are neighbours, elementwise."""
    stripes = stripes.combine_chunks()
    columns = {c: stripes.column(c).combine_chunks() for c in stripes.column_names}
    changes = np.ones(stripes.num_rows, bool)
    if stripes.num_rows > 1:
        same = [pc.equal(columns[c].slice(1), columns[c].slice(0, stripes.num_rows - 1)) for c in KEY]
        changes[1:] = ~np.logical_and.reduce([s.to_numpy(zero_copy_only=False) for s in same])
    first = np.flatnonzero(changes)
    group = np.cumsum(changes) - 1
    coded = columns["next"].flatten().dictionary_encode()
    n = columns["n"]
    at = np.repeat(group, np.diff(n.offsets.to_numpy()))
    names = max(1, len(coded.dictionary))
    entry, inverse = np.unique(at * names + coded.indices.to_numpy(), return_inverse=True)
    count = _sums(inverse, n.flatten().to_numpy(), len(entry))
    at, word = np.divmod(entry, names)
    kept = np.searchsorted(at, np.arange(len(first) + 1))
    merged = {c: columns[c].take(pa.array(first)) for c in KEY}
    merged["next"] = _lists(kept, coded.dictionary.take(pa.array(word)))
    merged["n"] = _lists(kept, pa.array(count))
    return pa.table({c: merged[c] for c in stripes.column_names})


def _known(stripes: DataFrame, n_words: int) -> Known:
    """The frequent extensions of merged stripes as bits, and the hot ones of them."""
    cell = stripes.select(F.explode("slot").alias("slot")).groupBy(F.shiftright("slot", 6).alias("cell"))
    # bounded: a row for each cell of the table
    set_ = cell.agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits")).toArrow()
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[set_.column("cell").to_numpy()] = set_.column("bits").to_numpy()
    # bounded: at most HOT phrases have a HOT-th of all words
    hot = _extensions(stripes).where(F.col("a") * HOT > n_words).select("lang", "phrase").collect()
    hashes = np.zeros(len(hot), np.uint64)
    for i, r in enumerate(hot):
        h = _root(r["lang"])
        for word in _hashes(pa.array(r["phrase"].split(" "))):
            h = _chained(h, np.array([word]))[0]
        hashes[i] = h
    return Known(bits, hashes)


def _extensions(stripes: DataFrame) -> DataFrame:
    """(lang, size, phrase, a) of the extensions in merged stripes."""
    rows = stripes.select("lang", "size", "prefix", F.explode(F.arrays_zip("next", "n")).alias("e"))
    phrase = F.when(F.col("size") == 0, F.col("e.next")).otherwise(F.concat_ws(" ", "prefix", "e.next"))
    return rows.select("lang", (F.col("size") + 1).alias("size"), phrase.alias("phrase"), F.col("e.n").alias("a"))


def stripes(docs: DataFrame, longest: int = 4, support: int = 30) -> DataFrame:
    """Merged stripes of all prefixes below ``longest`` words that may be part of a phrase with
    ``support`` occurrences: (lang, size, prefix, segment, total, next, n, slot).

    ``next`` and ``n`` are the prefix's extensions with at least ``support`` occurrences, and
    ``total`` is the sum of all that were counted. Hot prefixes have several segments, by the
    following word.
    """
    words = _counted(docs, (0,), None, support, "stripes-0")
    n_words = words.agg(F.sum("total")).first()[0] or 0
    pairs = _counted(docs, (1,), _known(words, n_words), support, "stripes-1")
    found = words.unionByName(pairs)
    if longest > 2:
        sizes = tuple(range(2, longest))
        found = found.unionByName(_counted(docs, sizes, _known(pairs, n_words), support, "stripes-2"))
    return found


def _ratio(value: Column, by: Column) -> Column:
    """floor(2000000 * value / by), exact beyond 64 bits."""
    return F.floor(F.lit(2_000_000).cast("decimal(38,0)") * value.cast("decimal(19,0)") / by.cast("decimal(19,0)"))


def collocations(docs: DataFrame, longest: int = 4, support: int = 30, subsumed: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    ``docs`` has (text, lang); other columns are not read. A null lang is ``und``, and null,
    empty and blank texts have no words. Each row counts, so repeated rows count repeatedly.
    Phrases have 2 to ``longest`` words within a piece and at least ``support`` occurrences;
    one whose words lie in a longer phrase with at least ``subsumed`` percent of its
    occurrences is dropped. It is enough to look at phrases that are longer by one word: what
    lies in a longer one lies in one of these, which is at least as frequent. Ties of the
    score go by occurrences and then by phrase, in byte order, so the result is unique. An
    empty table, or one without frequent phrases, gives no rows.
    """
    merged = stripes(docs, longest, support)
    phrases = stage(_extensions(merged), "phrases")
    found = phrases.where("size > 1")
    # the most frequent extension of each prefix comes from its own stripes, that to the left
    # from the stripes of the phrases without their first word
    cut_first = F.expr("substring(phrase, locate(' ', phrase) + 1)")
    cut_last = F.expr("substring(phrase, 1, length(phrase) - locate(' ', reverse(phrase)))")
    right = merged.where("size > 1").select("lang", F.col("prefix").alias("phrase"), F.array_max("n").alias("longer"))
    left = found.where("size > 2").select("lang", cut_first.alias("phrase"), F.col("a").alias("longer"))
    most = right.unionByName(left).where("longer IS NOT NULL").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    inside = F.coalesce(100 * wide("longer") >= subsumed * wide("a"), F.lit(False))
    kept = found.join(most, ["lang", "phrase"], "left").where(~inside)

    word = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice(word, 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice(word, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("second"),
    )
    part = phrases.where(F.col("size") < longest)
    firsts = part.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    seconds = part.select("lang", F.col("phrase").alias("second"), F.col("a").alias("r"))
    scored = cuts.join(firsts, ["lang", "first"]).join(seconds, ["lang", "second"])
    score = _ratio(F.col("a"), F.col("l").cast("decimal(38,0)") + F.col("r")).cast("long")
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    rows = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    order = (F.desc("score"), F.desc("a"), "phrase")
    piece = F.pmod(F.xxhash64("phrase"), F.lit(PIECES))
    in_piece = Window.partitionBy("lang", "piece").orderBy(*order)
    first = (
        rows.withColumn("piece", piece)
        .withColumn("place", F.row_number().over(in_piece))
        .where(F.col("place") <= top)
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    total = merged.where("size = 0").groupBy("lang").agg(F.sum("total").alias("n"))
    ranked = first.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
