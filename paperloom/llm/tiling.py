"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits in lower case. The benchmark's Karp-Rabin hashes of
``min_match`` words are joined with those of every text; from the hits, the longest common
run that is still unmarked is marked as a tile, again and again, until none of ``min_match``
words is left. An item that tiles cover by ``coverage`` or more of its words is in the text,
whatever the order of its passages. An item of fewer words than ``min_match`` matches whole.

The benchmark is sent to the tasks in blocks of a bounded number of words, one pass over the
texts for each block; texts are never shuffled, and each is compared whole. Null and empty
texts or items match nothing; a repeated row is reported as often as it occurs, and so is a
repeated item. Other columns of either table don't matter.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.hashed import find
from paperloom.llm.words import NOT_PLAIN, Words, batch_rows, release, shingles, words

MIN_MATCH = 5
COVERAGE = 0.8
#: Words of the benchmark that are sent at a time: 8 bytes a hash, 24 bytes a seed.
BLOCK_WORDS = 1_000_000


@dataclass
class Block:
    """Some benchmark items, with their seeds sorted by hash for each seed length."""

    ids: list[int]
    sizes: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length: hash, item, place


def block_of(rows: list[tuple[int, list[int]]], min_match: int) -> Block:
    """A block of items, given as (id, word hashes)."""
    ids = [r[0] for r in rows]
    items = [np.array(r[1], np.int64).view(np.uint64) for r in rows]
    sizes = np.array([len(i) for i in items], np.int64)
    seeds = {}
    length = np.minimum(sizes, min_match)
    for size in set(length.tolist()) - {0}:
        own = np.flatnonzero(length == size)
        flat = np.concatenate([items[i] for i in own])
        w = Words(flat, np.append(0, np.cumsum(sizes[own])))
        made = shingles(w, size)
        item = np.repeat(own, made.counts())
        place = np.arange(len(item)) - np.repeat(made.rows[:-1], made.counts())
        order = np.argsort(made.hashes, kind="stable")
        seeds[size] = (made.hashes[order], item[order], place[order])
    return Block(ids, sizes, seeds)


def tiles(hits: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (text place, item place, words) of two sequences, from all their common
    runs of ``size`` words. The longest goes first, of equals the first in the text."""
    by_diagonal = defaultdict(list)
    for p, q in hits:
        by_diagonal[p - q].append(p)
    heap = []
    for diagonal, places in by_diagonal.items():
        places.sort()
        begin = last = places[0]
        for p in [*places[1:], None]:
            if p != last + 1:
                heap.append((begin - last - size, begin, begin - diagonal))
                begin = p
            last = p
    heapq.heapify(heap)
    in_text, in_item, found = set(), set(), []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        free = [p + k not in in_text and q + k not in in_item for k in range(n)]
        if all(free):
            in_text.update(range(p, p + n))
            in_item.update(range(q, q + n))
            found.append((p, q, n))
            continue
        begin = None
        for k, ok in enumerate([*free, False]):
            if ok and begin is None:
                begin = k
            elif not ok and begin is not None:
                if k - begin >= size:
                    heapq.heappush(heap, (begin - k, p + begin, q + begin))
                begin = None
    return found


def findings(texts: pa.Array, block: Block, coverage: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(row, item's place in the block, tiles) of items that a text has."""
    for at, _, w in words(texts, NOT_PLAIN):
        for size, (keys, items, places) in block.seeds.items():
            counts = w.counts()
            made = np.maximum(counts - size + 1, 0)
            own = shingles(w, size)
            if (counts < size).any():  # shorter texts have no run of that many words
                whole = np.repeat(counts >= size, own.counts())
                own = Words(own.hashes[whole], np.append(0, np.cumsum(made)))
            first, hit = find(keys, own.hashes)
            hit = np.flatnonzero(hit)
            if not len(hit):
                continue
            first = np.searchsorted(keys, own.hashes[hit], "left")
            n = np.searchsorted(keys, own.hashes[hit], "right") - first
            seed = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            hit = np.repeat(hit, n)
            row = np.searchsorted(own.rows, hit, "right") - 1
            place = hit - own.rows[row]
            order = np.lexsort((items[seed], row))
            row, item, p, q = row[order], items[seed][order], place[order], places[seed][order]
            cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(item) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(row)], strict=True):
                total = int(block.sizes[item[a]])
                # words of the item in any hit: no tiling covers more
                reach = np.zeros(total + 1, np.int64)
                np.add.at(reach, q[a:b], 1)
                np.add.at(reach, np.minimum(q[a:b] + size, total), -1)
                if (np.cumsum(reach[:-1]) > 0).sum() < coverage * total:
                    continue
                got = tiles(list(zip(p[a:b].tolist(), q[a:b].tolist(), strict=True)), size)
                if sum(t[2] for t in got) >= coverage * total:
                    yield at + int(row[a]), int(item[a]), got


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


def blocks(benchmark: DataFrame, item_id: str, text: str, min_match: int, most: int) -> Iterator[Block]:
    """The benchmark in blocks of about ``most`` words, one at a time on the driver."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in words(lowered(batch.column(1)), NOT_PLAIN):
                lists = pa.ListArray.from_arrays(pa.array(w.rows.astype(np.int32)), pa.array(w.hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists], ["id", "words"])

    source = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text"))
    batch_rows(benchmark.sparkSession)
    made = source.where("text is not null").mapInArrow(hashed, "id long, words array<long>")
    total = made.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-total // most)
    for k in range(n):
        own = made.where(F.pmod(F.xxhash64("words"), F.lit(n)) == k) if n > 1 else made
        yield block_of([(r["id"], r["words"]) for r in own.where("size(words) > 0").collect()], min_match)


def matches(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """A row for each text and benchmark item in it: the id, ``item_id``, ``item_words``,
    ``covered``, ``coverage`` and ``tiles`` (text place:item place:words, longest first)."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, item_id long, item_words long, covered long, coverage double, tiles string"
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark, item_id, item_text, min_match, block_words):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            b = sent.value
            for batch in batches:
                got = list(findings(lowered(batch.column(1)), b, coverage))
                covered = [sum(t[2] for t in own) for _, _, own in got]
                sizes = [int(b.sizes[i]) for _, i, _ in got]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).take(pa.array([r for r, _, _ in got], pa.int64())),
                        "item_id": pa.array([b.ids[i] for _, i, _ in got], pa.int64()),
                        "item_words": pa.array(sizes, pa.int64()),
                        "covered": pa.array(covered, pa.int64()),
                        "coverage": pa.array([c / s for c, s in zip(covered, sizes, strict=True)], pa.float64()),
                        "tiles": pa.array([",".join("%d:%d:%d" % t for t in own) for _, _, own in got], pa.string()),
                    }
                )

        out = out.unionByName(source.mapInArrow(run, schema))
    return out


def clean(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without the rows whose text has a benchmark item; columns as they are."""
    own = list(blocks(benchmark, item_id, item_text, min_match, block_words))
    if not own:
        return docs
    # one pass over the texts, whatever the number of blocks
    sent = [docs.sparkSession.sparkContext.broadcast(block) for block in own]
    schema = docs.schema
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in sent:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _, _ in findings(lowered(batch.column(place)), block.value, coverage)]] = False
                if not keep.all():
                    batch = batch.filter(pa.array(keep))
            yield batch
        release()

    return docs.mapInArrow(run, schema)
