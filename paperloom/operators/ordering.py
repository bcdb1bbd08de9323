"""Ordering documents by the UUID in their ``file`` key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import files
from paperloom.functions.identifiers import uuid_to_bytes
from paperloom.functions.once import once
from paperloom.session import fits_in_broadcast, stage
from paperloom.sources.documents import SOURCE_ORDER


def with_key(docs: DataFrame) -> DataFrame:
    """Add ``key``: the 16 bytes of the UUID that ``file`` starts with, NULL if there is none."""
    # once each: the filter on keys would take the expressions along, and with them a parse of
    # the body, if ``file`` comes from there
    named = once(docs, _paper=files.paper_id(F.col("file")))
    return once(named, key=uuid_to_bytes(F.col("_paper"))).drop("_paper")


def unkeyed(docs: DataFrame) -> DataFrame:
    """Rows that cannot be placed: no ``file``, or not a UUID."""
    return with_key(docs).where(F.col("key").isNull()).drop("key")


def sort_by_uuid(
    docs: DataFrame,
    order: Sequence[str] = SOURCE_ORDER,
    on_duplicate: str = "keep",
    strict: bool = False,
) -> DataFrame:
    """Rows by UUID, compared as unsigned bytes, then by source order.

    Source order in the sort key also lets the range partitioning cut a UUID that owns a
    large share of the rows. ``on_duplicate``: ``keep`` all rows of a UUID, only the
    ``last`` one, or ``repeat_last`` to put the last one in the place of each.
    """
    keyed = with_key(docs)
    if strict:
        message = F.concat(F.lit("row without a UUID in file: "), F.coalesce("file", F.lit("")))
        keyed = keyed.withColumn("key", F.coalesce("key", F.raise_error(message).cast("binary")))
    keyed = keyed.where(F.col("key").isNotNull())
    if on_duplicate == "last":
        keyed = last_per_key(keyed, order)
    elif on_duplicate == "repeat_last":
        keyed = stage(keyed, "keyed", "zstd")
        last = last_per_key(keyed, order, written=True).drop(*order)
        keyed = keyed.select("key", *order).join(last, "key")
    elif on_duplicate != "keep":
        raise ValueError(f"on_duplicate: {on_duplicate}")
    if on_duplicate == "repeat_last" or (on_duplicate == "keep" and not BODIES.isdisjoint(keyed.columns)):
        # a sort reads its source twice, first to draw the ranges
        keyed = stage(keyed, "unsorted", "zstd")
    return keyed.orderBy("key", *order)


#: Columns that are too large to be passed through an aggregate.
BODIES = frozenset({"body", "doc", "text"})


def last_per_key(keyed: DataFrame, order: Sequence[str] = SOURCE_ORDER, written: bool = False) -> DataFrame:
    """The last row in source order of each key; of rows that tie, the one with the largest
    other columns.

    Rows without bodies are reduced by one aggregate: one row per key and task is shuffled.
    Those with bodies take two steps, so that bodies are in none. The first reads keys and order only and
    lists the keys that repeat, with their last place: one row per key and task is shuffled,
    however often a key repeats. The second keeps rows of other keys as they are, and of
    listed keys the row at that place; the rows stay where they are if the list is small.
    Rows are written first unless they are ``written``, so their source is read once.
    """
    rest = [c for c in keyed.columns if c not in ("key", *order)]
    if BODIES.isdisjoint(rest):
        last = F.max(F.struct(*order, *rest)).alias("_last")
        return keyed.groupBy("key").agg(last).select("key", "_last.*").select(*keyed.columns)
    rows = keyed if written else stage(keyed, "keyed", "zstd")
    placed = with_order_key(rows, order)
    place = F.col(ORDER_KEY) if placed is not None else F.struct(*order)
    placed = rows if placed is None else placed
    listed = stage(
        placed.groupBy("key").agg(F.max(place).alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n"),
        "repeated-keys",
    )
    small = fits_in_broadcast(listed, "key")
    met = placed.join(F.broadcast(listed) if small else listed, "key", "left")
    # written, as it is read for ties, for the result and for the ranges of a sort
    last = stage(met.where(F.col("_last").isNull() | (place == F.col("_last"))), "last", "zstd")
    ties = last.where(F.col("_last").isNotNull()).groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    if ties.isEmpty():
        return last.select(*rows.columns)
    tied = stage(ties, "tied-keys")
    first = Window.partitionBy("key").orderBy(*map(F.desc, rest))
    some = last.join(tied, "key", "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return last.join(tied, "key", "left_anti").select(*rows.columns).unionByName(some.select(*rows.columns))


ORDER_KEY = "_order"


def with_order_key(rows: DataFrame, order: Sequence[str]) -> DataFrame | None:
    """Add ``_order``, one 64-bit number that sorts as the columns ``order`` do, nulls first.

    A minimum of such a number needs a fixed place in an aggregate, so Spark can keep it in a
    hash table where it would have to sort rows for a minimum of strings or structs. Integers
    take as many bits as their range needs; strings, such as paths of source files, count as
    their place among the distinct ones. None if this needs more than 63 bits or if a column
    is of another type. ``rows`` is read for the ranges and should be a written table.
    """
    kinds = dict(rows.dtypes)
    names = [c for c in order if kinds[c] == "string"]
    if any(kinds[c] not in ("string", "tinyint", "smallint", "int", "bigint") for c in order):
        return None
    ranges = rows.agg(*[f(c).alias(f"{n}_{c}") for c in order if c not in names for n, f in (("low", F.min), ("high", F.max))]).first()
    placed, parts, shift = rows, [], 0
    for c in reversed(order):
        if c in names:
            ranks = with_position(rows.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c))
            ranks = stage(ranks.select(c, (F.col("position") + 1).alias(f"_at_{c}")), "ranks")
            placed = placed.join(F.broadcast(ranks) if fits_in_broadcast(ranks, c) else ranks, c, "left")
            value, most = F.col(f"_at_{c}"), ranks.count()
        else:
            low, high = (ranges[f"{n}_{c}"] or 0 for n in ("low", "high"))
            value, most = F.col(c).cast("long") - F.lit(low) + 1, high - low + 1
        parts.append(F.shiftleft(F.coalesce(value, F.lit(0).cast("long")), shift))
        shift += most.bit_length()
    if shift > 63:
        return None
    return placed.select(*rows.columns, reduce(Column.bitwiseOR, parts).alias(ORDER_KEY))


def with_position(ordered: DataFrame) -> DataFrame:
    """Add ``position``, the 0-based place of each row in a globally sorted frame.

    The sorted rows are staged with the number of their partition; a partition's first
    position is the sum of the sizes before it, taken over one row per partition.
    """
    numbered = ordered.withColumn("_part", F.spark_partition_id()).withColumn(
        "_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    staged = stage(numbered, "ordered", "zstd")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the sort; their number is a setting, not data
    starts = (
        staged.groupBy("_part")
        .agg(F.count("*").alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    return (
        staged.join(F.broadcast(starts), "_part")
        .withColumn("position", F.col("_start") + F.col("_row"))
        .drop("_part", "_row", "_start")
    )
