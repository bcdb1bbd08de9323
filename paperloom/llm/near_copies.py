"""Near-duplicate texts by a multi-index Hamming join over b-bit MinHash signatures.

Texts with the same set of word shingles form one class (found by a digest of the sorted
set), so exact copies cost one row. A class's signature has ``chunks * width`` components of
16 bits, cut into chunks. Two signatures that differ in fewer than ``chunks * (errors + 1)``
components have a chunk with at most ``errors`` differing ones (pigeonhole), so for each
chunk and each choice of that many components to leave out, one index key is made from the
others: every pair under that distance shares a key. ``layout`` picks chunks, width and
errors so that a pair exactly at the similarity threshold is that close but for a chance of
``MISSED``.

Keys are not turned into all pairs. Each class is first compared with one hub: of the classes
that are the best connected ones of its keys and close by signature, the best connected.
Groups then come from the confirmed links with hubs. Pairs around one hub are compared by
how they differ from it: two classes of which one is not linked with the hub can only be
linked if their differences share most elements, so a prefix filter over the rarest
differences finds these pairs without trying the others. Last, classes of one key that lie
in different groups and around different hubs are compared by signature. So a large group of
near copies costs a comparison per member, and no link between groups is left out. Every
link is confirmed on full sets: 100 * shared >= threshold * union.

Results: texts without words have no shingles and link with nothing. Rows with a null id get
their own count, no component and are kept. Rows may repeat an id; each row goes by its own
text. Memory per task is bounded by one slice of text and the sets of an Arrow batch.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.components import components
from paperloom.llm.words import batch_bytes, batch_rows, mix, release, shingles, words
from paperloom.session import fits_in_broadcast, stage

#: Chance that a pair exactly at the threshold lies beyond the signature distance.
MISSED = 2e-5
MOST_KEYS = 64
#: Number of keys that one hub is dealt over in a join.
PIECES = 64
#: Bytes of text that are cut into shingles at once, and of batches between Spark and Python.
SLICE, BATCH = 1 << 20, 1 << 20
_SALTS = np.random.default_rng(11).integers(1, 2**64, (2, 256), dtype=np.uint64) | np.uint64(1)


def layout(threshold: int) -> tuple[int, int, int]:
    """(chunks, width, errors): of the layouts that miss a pair at the threshold with a chance
    of at most MISSED, the one whose keys hold most components, then the fewest keys."""
    differ = 1 - threshold / 100
    best = None
    for width in range(2, 8):
        for errors in range(1, min(3, width)):
            for chunks in range(2, MOST_KEYS // math.comb(width, errors) + 1):
                n, limit = chunks * width, chunks * (errors + 1)
                tail = sum(
                    math.comb(n, i) * differ**i * (1 - differ) ** (n - i) for i in range(limit, n + 1)
                )
                if tail <= MISSED:
                    choice = (width - errors, -chunks * math.comb(width, errors), chunks, width, errors)
                    best = max(best or choice, choice)
                    break
    if best is None:
        raise ValueError(f"no layout of {MOST_KEYS} keys finds pairs at {threshold} %")
    return best[2:]


def signatures(df: DataFrame, size: int, n: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, node, sig): ``node`` is a digest of the set, null when it is empty."""
    keep = F.col(doc_id).alias("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in words(batch.column(1), size=SLICE):
                own = shingles(w, size)
                full = np.flatnonzero(own.counts())
                sig = np.zeros((to - at, n), np.uint16)
                if len(full):
                    begins = own.rows[full]
                    for k in range(n):
                        seen = (own.hashes ^ _SALTS[0, k]) * _SALTS[1, k]
                        sig[full, k] = np.minimum.reduceat(seen ^ (seen >> np.uint64(32)), begins) >> np.uint64(20)
                counts, nodes = [], []
                for a, b in zip(own.rows[:-1].tolist(), own.rows[1:].tolist(), strict=True):
                    found = np.unique(own.hashes[a:b])
                    counts.append(len(found))
                    digest = hashlib.blake2b(found.tobytes(), digest_size=8).digest()
                    nodes.append(int.from_bytes(digest, "big", signed=True) if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        pa.array(counts, pa.int64()),
                        pa.array(nodes, pa.int64()),
                        _packed(sig),
                    ],
                    ["doc_id", "n_shingles", "node", "sig"],
                )
        release()

    source = df.select(keep, F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_shingles long, node long, sig array<long>")


def _packed(sig: np.ndarray) -> pa.Array:
    """Three components of 16 bits in each long, 21 bits apart."""
    wide = np.zeros((len(sig), -(-sig.shape[1] // 3) * 3), np.int64)
    wide[:, : sig.shape[1]] = sig
    flat = wide[:, 0::3] | wide[:, 1::3] << 21 | wide[:, 2::3] << 42
    offsets = np.arange(len(sig) + 1, dtype=np.int32) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.reshape(-1)))


def _unpacked(column: pa.Array, n: int) -> np.ndarray:
    longs = column.flatten().to_numpy().reshape(len(column), -1)
    out = np.stack([longs >> shift & 0xFFFF for shift in (0, 21, 42)], axis=2)
    return out.reshape(len(column), longs.shape[1] * 3)[:, :n]


def distance(a: Column, b: Column, n: int) -> Column:
    """Differing components of two packed signatures: adding 0xFFFF to a component's
    differing bits carries into the bit above it exactly if there are any."""
    ones, above = (sum(x << shift for shift in (0, 21, 42)) for x in (0xFFFF, 0x10000))
    total = F.lit(0)
    for k in range(-(-n // 3)):
        carried = a[k].bitwiseXOR(b[k]) + F.lit(ones)
        total = total + F.bit_count(carried.bitwiseAND(F.lit(above)))
    return total


def index(classes: DataFrame, chunks: int, width: int, errors: int) -> DataFrame:
    """(node, key): the index keys of each class."""
    n = chunks * width
    rng = np.random.default_rng(13)
    coef = rng.integers(1, 2**64, n, dtype=np.uint64) | np.uint64(1)
    left_out = list(combinations(range(width), errors))
    tags = rng.integers(1, 2**64, (chunks, len(left_out)), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("sig"))
            sig = _unpacked(column, n).astype(np.uint64) + np.uint64(1)
            scaled, keys = mix(sig * coef), []
            for c in range(chunks):
                part = scaled[:, c * width : (c + 1) * width]
                whole = part.sum(axis=1, dtype=np.uint64)
                for k, out in enumerate(left_out):
                    keys.append(mix(whole - part[:, list(out)].sum(axis=1, dtype=np.uint64) + tags[c, k]))
            flat = np.stack(keys, axis=1).view(np.int64).reshape(-1)
            row = pa.array(np.repeat(np.arange(batch.num_rows), len(keys)))
            node = batch.column(batch.schema.get_field_index("node")).take(row)
            yield pa.RecordBatch.from_arrays([node, pa.array(flat)], ["node", "key"])
        release()

    return classes.select("node", "sig").mapInArrow(run, "node long, key long")


def sets_of(df: DataFrame, wanted: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """(node, shingles) of the classes in ``wanted`` (node, member), read from a member's text."""
    small = fits_in_broadcast(wanted, "member")
    listed = F.broadcast(wanted) if small else wanted
    source = df.select(F.col(doc_id).alias("member"), F.col(text).alias("text")).join(listed, "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            node = batch.column(batch.schema.get_field_index("node")).to_pylist()
            for at, to, w in words(column, size=SLICE):
                own = shingles(w, size)
                found = [np.unique(own.hashes[a:b]).tobytes() for a, b in zip(own.rows, own.rows[1:], strict=False)]
                digests = [hashlib.blake2b(x, digest_size=8).digest() for x in found]
                kept = [
                    i for i, d in enumerate(digests) if int.from_bytes(d, "big", signed=True) == node[at + i]
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node[at + i] for i in kept], pa.int64()), pa.array([found[i] for i in kept], pa.binary())],
                    ["node", "shingles"],
                )
        release()

    found = source.select("node", "text").mapInArrow(run, "node long, shingles binary")
    # a repeated id may bring a text twice
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def compared(pairs: DataFrame, sets: DataFrame, threshold: int, differences: bool = False) -> DataFrame:
    """Pairs (a, b) with ``linked`` by their full sets and, on request, the sizes of both and
    ``different``, the shingles that only one has."""
    both = pairs.select("a", "b").join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, sizes, different = [], [], []
            left, right = (batch.column(batch.schema.get_field_index(c)) for c in ("set_a", "set_b"))
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                other = np.setxor1d(x, y, assume_unique=True)
                twice = len(x) + len(y)  # shared and union are (twice -+ different) / 2
                linked.append(100 * (twice - len(other)) >= threshold * (twice + len(other)))
                if differences:
                    sizes.append((len(x), len(y)))
                    different.append(other.view(np.int64))
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in ("a", "b")}
            out["linked"] = pa.array(linked, pa.bool_())
            if differences:
                out["size_a"] = pa.array([n for n, _ in sizes], pa.int64())
                out["size_b"] = pa.array([n for _, n in sizes], pa.int64())
                out["different"] = pa.array(different, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)
        release()

    more = ", size_a long, size_b long, different array<long>" if differences else ""
    return both.mapInArrow(run, f"a long, b long, linked boolean{more}")


def _shared(classes: DataFrame, chunks: int, width: int, errors: int) -> DataFrame:
    """(key, node, n): the keys that several classes have; n says how many."""
    keys = index(classes, chunks, width, errors)
    counted = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return keys.join(counted, "key")


def _hubs(shared: DataFrame, classes: DataFrame, n: int, limit: int) -> DataFrame:
    """(a, b): each class and its hub, where there is one under the signature distance."""
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    rows = shared.select("key", "node").join(degree, "node")
    top = rows.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("hub"))
    wanted = rows.join(top, "key").where(F.struct("degree", "node") < F.col("hub"))
    pairs = wanted.select(F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("hub.degree").alias("degree"))
    sig = classes.select("node", "sig")
    both = pairs.distinct().join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
    close = both.where(distance(F.col("sig_a"), F.col("sig_b"), n) < limit)
    return close.groupBy("a").agg(F.max_by("b", F.struct("degree", "b")).alias("b"))


def _around_hubs(stars: DataFrame, threshold: int) -> DataFrame:
    """(a, b): classes around one hub, not both linked with it, that may be linked.

    With d the differences from the hub and s the sizes, a link needs at least
    t = (d_a + d_b - most) / 2 shared differences, where most is what sets of these sizes may
    differ by; t is positive unless both are linked with the hub. The rarest d - t + 1
    differences of each must then have one in common.
    """
    open_hubs = stars.groupBy("b").agg(F.count("*").alias("n"), F.min(F.col("linked").cast("int")).alias("all"))
    open_hubs = stage(open_hubs.where("n > 1 and all = 0").select("b"), "open-hubs")
    if fits_in_broadcast(open_hubs, "b"):
        around = stars.join(F.broadcast(open_hubs), "b")
    else:  # a hub may have a large share of all classes, so each is dealt over several keys
        piece = F.pmod(F.xxhash64("a"), F.lit(PIECES))
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PIECES - 1).cast("long")))
        around = stars.withColumn("piece", piece).join(open_hubs.withColumn("piece", copies), ["b", "piece"])
    rows = around.select(
        F.col("b").alias("hub"),
        F.col("a").alias("node"),
        "linked",
        F.col("size_a").alias("s"),
        F.size("different").alias("d"),
        F.explode("different").alias("element"),
    )
    seen = rows.groupBy("hub", "element").agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("times", "element")) - 1
    ranked = rows.join(seen, ["hub", "element"]).withColumn("place", place).where("times > 1")
    ranked = ranked.select("hub", "element", "node", "linked", "s", "d", "place")
    left, right = (ranked.select("hub", "element", *(F.col(c).alias(f"{c}_{k}") for c in ranked.columns[2:])) for k in "ab")
    most = f"floor({100 - threshold} * (s_a + s_b) / {100 + threshold})"
    need = f"ceil((d_a + d_b - {most}) / 2)"
    fit = F.expr(
        f"node_a < node_b AND NOT (linked_a AND linked_b) AND abs(d_a - d_b) <= {most} "
        f"AND place_a <= d_a - {need} AND place_b <= d_b - {need}"
    )
    return left.join(right, ["hub", "element"]).where(fit).select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b")
    ).distinct()


def _across(shared: DataFrame, placed: DataFrame, n: int, limit: int, threshold: int) -> DataFrame:
    """(a, b): classes of one key in different groups and around different hubs, of sizes and
    signatures that the threshold allows. ``placed`` has node, n_shingles, sig, group and hub.

    In each key, the group with most members is not compared within itself, nor is any other.
    """
    own = shared.select("key", "node").join(placed, "node")
    counted = own.groupBy("key", "group").agg(F.count("*").alias("n"))
    mixed = counted.groupBy("key").agg(
        F.max_by("group", F.struct("n", "group")).alias("main"), F.count("*").alias("groups")
    ).where("groups > 1").select("key", "main")
    own = own.join(mixed, "key")
    names = ("node", "n_shingles", "sig", "group", "hub")
    left = own.where("group <> main").select("key", *(F.col(c).alias(f"{c}_a") for c in names))
    right = own.select("key", *(F.col(c).alias(f"{c}_b") for c in names))
    fit = F.expr(
        "group_a <> group_b AND hub_a <> hub_b AND hub_a <> node_b AND hub_b <> node_a "
        f"AND 100 * least(n_shingles_a, n_shingles_b) >= {threshold} * greatest(n_shingles_a, n_shingles_b)"
    )
    pairs = left.join(right, (left["key"] == right["key"]) & fit & (distance(F.col("sig_a"), F.col("sig_b"), n) < limit))
    return pairs.select(
        F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")
    ).distinct()


def near_copies(
    df: DataFrame, size: int = 5, threshold: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row; see the module's text."""
    batch_rows(df.sparkSession)
    batch_bytes(df.sparkSession, BATCH)
    chunks, width, errors = layout(threshold)
    n, limit = chunks * width, chunks * (errors + 1)
    signed = stage(signatures(df, size, n, doc_id, text), "signatures")
    classes = stage(
        signed.where("node is not null and doc_id is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("member"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")),
        "classes",
    )
    shared = stage(_shared(classes, chunks, width, errors), "shared-keys")
    # links with hubs, and around each hub
    pairs = stage(_hubs(shared, classes, n, limit), "hub-pairs")
    stars = stage(compared(pairs, _sets(df, classes, pairs, size, doc_id, text), threshold, True), "stars")
    near = stage(_around_hubs(stars, threshold), "pairs-around-hubs")
    around = compared(near, _sets(df, classes, near, size, doc_id, text), threshold)
    links = stars.where("linked").select("a", "b").unionByName(around.where("linked").select("a", "b"))
    group = components(links, "first").withColumnRenamed("component", "group")
    placed = stage(
        classes.join(group, "node", "left")
        .join(pairs.toDF("node", "hub"), "node", "left")
        .withColumns({"group": F.coalesce("group", "node"), "hub": F.coalesce("hub", "node")}),
        "grouped",
    )
    # links between groups
    others = stage(_across(shared, placed.drop("member"), n, limit, threshold), "pairs-between")
    more = compared(others, _sets(df, classes, others, size, doc_id, text), threshold).where("linked")
    of = placed.select("node", "group")
    between = (
        more.join(of.toDF("a", "group_a"), "a")
        .join(of.toDF("b", "group_b"), "b")
        .select(F.col("group_a").alias("a"), F.col("group_b").alias("b"))
    )
    final = components(between, "second").withColumnRenamed("node", "group")
    named = placed.select("node", "member", "group").join(final, "group", "left")
    named = named.withColumn("component", F.coalesce("component", "group"))
    smallest = named.groupBy("component").agg(F.min("member").alias("component_id"))
    by_node = stage(named.join(smallest, "component").select("node", "component_id"), "by-node")
    out = signed.select("doc_id", "n_shingles", "node").join(by_node, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
    )


def _sets(df: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stage(classes.select("node", "member").join(nodes, "node"), "wanted")
    return stage(sets_of(df, wanted, size, doc_id, text), "sets")
