"""Embedding near-duplicates: spherical k-means cells and blocked cosine products.

Vectors are compared only within their label. Equal vectors of a label form one class.
Centroids are fitted on a bounded sample (``SAMPLE`` vectors); every class goes to the cell
of its nearest centroid. Two vectors at an angle of at most t in different cells have the
plane between the centroids on their way, so one of them is within t / 2 of it: a class also
visits each cell whose plane is that near. With this no pair is missed, whatever the
centroids. A cell is cut into blocks of about ``BLOCK`` classes, and one task multiplies two
blocks: neither a cell nor a group of copies has to fit in a task.

From a product come the number of linked vectors of each class and a spanning forest of its
links, not the pairs. ``n_links`` counts other rows; ``component_id`` is the smallest id that
links reach; ``kept`` marks one representative per group.

Null or empty vectors, zero vectors and vectors with null or non-finite components, and rows
without a label, link with nothing. Rows with a null id have no component and are kept.
Vectors of different lengths never link. Cosines are taken in double precision.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.components import components
from paperloom.session import stage

SAMPLE = 20_000
BLOCK = 1024
MOST_CELLS = 512
ROUNDS = 8


def unit_vectors(batch: pa.Array) -> list[np.ndarray | None]:
    """Each row's vector with length 1 in double precision; None where it links with nothing."""
    out = []
    for row in batch:
        values = row.values if row.is_valid else None
        if values is None or not len(values) or values.null_count:
            out.append(None)
            continue
        v = values.to_numpy(zero_copy_only=False).astype(np.float64)
        most = np.abs(v).max()
        if not np.isfinite(v).all() or most == 0:
            out.append(None)
            continue
        v = v / most
        out.append(v / np.sqrt(v @ v))
    return out


def classed(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, node, unit): ``node`` is a digest of label and vector, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit_vectors(batch.column(2))
            labels = batch.column(1).to_pylist()
            raw = [None if v is None or k is None else (v + 0.0).tobytes() for v, k in zip(units, labels, strict=True)]
            # the length of the label, so that it cannot go on in the vector
            said = [b"" if k is None else str(k).encode() for k in labels]
            tags = [
                None if r is None else hashlib.blake2b(len(k).to_bytes(8, "little") + k + r, digest_size=8).digest()
                for r, k in zip(raw, said, strict=True)
            ]
            node = [None if t is None else int.from_bytes(t, "big", signed=True) for t in tags]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(raw, pa.binary())],
                ["vec_id", "label", "node", "unit"],
            )

    source = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, node long, unit binary")


def centroids(classes: DataFrame) -> dict[int, np.ndarray]:
    """Centroids for each length of vector, by spherical k-means on a bounded sample.

    The number of cells grows with the square root of the number of classes, up to MOST_CELLS.
    """
    total = classes.count()
    share = min(1.0, SAMPLE / total) if total else 0.0
    drawn = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30))
    cells = min(MOST_CELLS, max(1, round(math.sqrt(total) / 8)))
    by_length: dict[int, list[np.ndarray]] = {}
    for r in classes.where(drawn).select("unit").toLocalIterator():
        v = np.frombuffer(r["unit"])
        by_length.setdefault(len(v), []).append(v)
    out = {}
    for length, rows in by_length.items():
        x = np.array(sorted(map(tuple, rows)))
        k = min(cells, len(x))
        c = x[np.random.default_rng(5).choice(len(x), k, replace=False)]
        for _ in range(ROUNDS):
            near = (x @ c.T).argmax(axis=1)
            total_of = np.zeros_like(c)
            np.add.at(total_of, near, x)
            norm = np.sqrt((total_of**2).sum(axis=1))
            c = np.where(norm[:, None] > 1e-12, total_of / np.maximum(norm, 1e-12)[:, None], c)
        out[length] = np.unique(c, axis=0)
    return out


def placed(classes: DataFrame, cells: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """A row for each class and cell it is in or visits."""
    sent = classes.sparkSession.sparkContext.broadcast(cells)
    # a little over half the angle, so that rounding cannot lose a pair
    near = math.sin(math.acos(cosine) / 2 + 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(b) for b in batch.column(batch.schema.get_field_index("unit")).to_pylist()]
            rows, cell, home, visits, size = [], [], [], [], []
            for length in {len(v) for v in raw}:
                own = [i for i, v in enumerate(raw) if len(v) == length]
                x = np.array([raw[i] for i in own])
                c = sent.value.get(length, np.zeros((1, length)))
                dots = x @ c.T
                first = dots.argmax(axis=1)
                apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))[first]
                gap = dots[np.arange(len(own)), first][:, None] - dots
                here = gap <= near * apart
                here[np.arange(len(own)), first] = True
                for k, i in enumerate(own):
                    also = np.flatnonzero(here[k]).tolist()
                    rows += [i] * len(also)
                    cell += also
                    home += [int(first[k])] * len(also)
                    visits += [[v for v in also if v != first[k]]] * len(also)
                    size += [length] * len(also)
            at = pa.array(rows, pa.int64())
            kept = {n: batch.column(batch.schema.get_field_index(n)).take(at) for n in ("label", "node", "copies", "unit")}
            yield pa.RecordBatch.from_pydict(
                kept
                | {
                    "length": pa.array(size, pa.int32()),
                    "cell": pa.array(cell, pa.int32()),
                    "home": pa.array(home, pa.int32()),
                    "visits": pa.array(visits, pa.list_(pa.int32())),
                }
            )

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "node", "copies", "unit").mapInArrow(
        run, f"label {kind}, node long, copies long, unit binary, length int, cell int, home int, visits array<int>"
    )


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of the pairs of blocks (i, j) of each cell: ``i`` has homes on the left; ``j`` has
    homes (i <= j) or, from the cell's number of blocks on, visitors."""
    by = ["label", "length", "cell"]
    stays = F.col("home") == F.col("cell")
    counted = rows.groupBy(*by).agg(
        F.count(F.when(stays, 1)).alias("homes"), F.count(F.when(~stays, 1)).alias("guests")
    )
    sizes = counted.where("homes > 0").select(
        *by, F.ceil(F.col("homes") / BLOCK).cast("int").alias("nh"), F.ceil(F.col("guests") / BLOCK).cast("int").alias("ng")
    )
    both = rows.join(sizes, by)
    b = F.when(stays, F.pmod(F.xxhash64("node"), F.col("nh"))).otherwise(
        F.col("nh") + F.pmod(F.xxhash64("node"), F.col("ng"))
    )
    both = both.withColumn("b", b.cast("int"))
    to = F.expr("""
        IF(home = cell,
           concat(transform(sequence(0, b), x -> struct(x AS i, b AS j)),
                  filter(transform(sequence(b, nh + ng), x -> struct(b AS i, x AS j)), p -> p.j > b AND p.j < nh + ng)),
           transform(sequence(0, nh - 1), x -> struct(x AS i, b AS j)))""")
    return both.select("*", F.explode(to).alias("to")).select(*rows.columns, "b", "to.i", "to.j")


def product(cosine: float):
    """Links of one pair of blocks: (node, null, linked rows) and forest edges (a, b, 0)."""

    def run(table: pa.Table) -> pa.Table:
        b, i, j = (table.column(c).to_numpy() for c in ("b", "i", "j"))
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        home = table.column("home").to_numpy()
        unit = np.array([np.frombuffer(v) for v in table.column("unit").to_pylist()])
        left, right = np.flatnonzero(b == i), np.flatnonzero(b == j)
        near = unit[left] @ unit[right].T >= cosine
        cell = int(table.column("cell")[0].as_py())
        if i[0] == j[0]:
            np.fill_diagonal(near, False)
        guests = home[right] != cell
        if guests.any():
            # a pair in which each visits the other's cell counts in the lower one
            visits = table.column("visits").to_pylist()
            for r in np.flatnonzero(guests & (home[right] < cell)):
                for k in np.flatnonzero(near[:, r]):
                    if home[right[r]] in visits[left[k]]:
                        near[k, r] = False
        n_left = (near * copies[right][None, :]).sum(axis=1)
        n_right = (near * copies[left][:, None]).sum(axis=0)
        same = i[0] == j[0]
        a, c, n = list(node[left]), [None] * len(left), list(n_left)
        if not same:
            a, c, n = a + list(node[right]), c + [None] * len(right), n + list(n_right)
        counted = [(x, y, z) for x, y, z in zip(a, c, n, strict=True) if z]
        edges = [(x, y, 0) for x, y in forest(near, node[left], node[right])]
        return pa.Table.from_pydict(
            {
                "a": pa.array([int(r[0]) for r in counted + edges], pa.int64()),
                "b": pa.array([None if r[1] is None else int(r[1]) for r in counted + edges], pa.int64()),
                "n": pa.array([int(r[2]) for r in counted + edges], pa.int64()),
            }
        )

    return run


def forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect the same nodes as all of ``near`` does, fewer than there are nodes."""
    fresh_left, fresh_right = near.any(axis=1), near.any(axis=0)
    edges = []
    for root in np.flatnonzero(fresh_left):
        if not fresh_left[root]:
            continue
        fresh_left[root] = False
        todo = [(True, root)]
        while todo:
            on_left, k = todo.pop()
            if on_left:
                found = np.flatnonzero(near[k] & fresh_right)
                fresh_right[found] = False
                edges += [(left[k], right[f]) for f in found]
            else:
                found = np.flatnonzero(near[:, k] & fresh_left)
                fresh_left[found] = False
                edges += [(right[k], left[f]) for f in found]
            todo += [(not on_left, f) for f in found]
    return edges


def near_vectors(
    df: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row; see the module's text."""
    rows = stage(classed(df, vec_id, embedding, label), "vectors")
    classes = stage(
        rows.where("node is not null")
        .groupBy("node")
        .agg(
            F.first("label").alias("label"),
            F.first("unit").alias("unit"),
            F.count("*").alias("copies"),
            F.min("vec_id").alias("member"),
        ),
        "vector-classes",
    )
    cells = stage(placed(classes, centroids(classes), cosine), "cells")
    found = stage(
        dealt(cells).groupBy("label", "length", "cell", "i", "j").applyInArrow(product(cosine), "a long, b long, n long"),
        "products",
    )
    linked = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    group = components(found.where("b is not null").select("a", "b"), "vector-links")
    joined = classes.select("node", "member", "copies").join(group, "node", "left")
    joined = joined.withColumn("component", F.coalesce("component", "node"))
    smallest = joined.groupBy("component").agg(F.min("member").alias("component_id"))
    by_node = joined.join(smallest, "component").join(linked, F.col("node") == F.col("a"), "left")
    by_node = stage(
        by_node.select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "vector-results",
    )
    out = rows.select("vec_id", "node").join(by_node, "node", "left")
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"),
    )
