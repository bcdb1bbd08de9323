"""What each of five filters removes, in every order of applying them.

The word counts of filters A and B are row sums and nonzero counts of a document-term matrix
(``matrix``); the other flags are attached to its rows. Documents are then summed by part and
set of failed filters, at most 32 sums per part, and all orders follow from these sums alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.matrix import document_term_matrix, row_statistics
from paperloom.session import stage

FILTERS = "ABCDE"
#: A text with more than this share of all rows is looked up by broadcast; there are at most
#: as many of these as the share says.
HOT = 1000


def _bit(filter_: str) -> int:
    return 1 << FILTERS.index(filter_)


def earlier_copies(rows: DataFrame, key: str = "digest", order: str = "doc_id") -> DataFrame:
    """``rows`` with ``copy``: whether a row of equal ``key`` has a smaller ``order``.

    Minima are summed up in each task first. Rows of a key with over a thousandth of all rows
    meet their minimum by broadcast of the thousand such keys at most, the others by a join.
    A null in ``order`` is neither smaller than another nor has a smaller one. ``rows`` is
    read three times and should be a written table; ``key`` is a binary digest.
    """
    first = stage(
        rows.groupBy(key).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1"), "first-copies"
    )
    total = rows.count()
    hot = first.where(F.col("_n") * HOT > total).select(key, F.col("_first").alias("_hot"))
    cold = first.where(F.col("_n") * HOT <= total).select(key, "_first")
    met = rows.join(F.broadcast(hot), key, "left")
    # rows of hot keys have no partner here; they are dealt by something else
    cold_key = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(order).cast("string").cast("binary"))
    met = met.withColumn("_key", cold_key).join(cold.withColumnRenamed(key, "_cold"), F.col("_key") == F.col("_cold"), "left")
    smaller = F.coalesce("_hot", "_first") < F.col(order)
    return met.select(*rows.columns, F.coalesce(smaller, F.lit(False)).alias("copy"))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed) of each document; ``failed`` has bit i set for ``FILTERS[i]``.

    Each row is a document. A null text is empty and has the part of its source; a null
    source is the empty string. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    read = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        (100 * capitals > 5 * F.length(text)).alias("c"),
        text.rlike("[#$%&*|]").alias("d"),
        text.alias("text"),
    )
    matrix, _ = document_term_matrix(read, keep=("doc_id", "part", "digest", "c", "d"))
    rows = earlier_copies(stage(row_statistics(matrix), "rows"))
    conditions = {
        "A": F.col("n_words") < 50,
        "B": 100 * F.col("n_distinct") < 65 * F.col("n_words"),
        "C": F.col("c"),
        "D": F.col("d"),
        "E": F.col("copy"),
    }
    failed = sum((F.when(is_, _bit(name)).otherwise(0) for name, is_ in conditions.items()), F.lit(0))
    return rows.select("doc_id", "part", failed.cast("int").alias("failed"))


def audit(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) for each part, order of the filters and step.

    ``found`` comes from ``failures``. A document is good or toxic if any label row of its id
    says so; without a label it is neither. Every part has all its rows, zeros included; an
    empty table has no parts. ``shapley``, the number that a filter removes summed over all
    orders, counts each failing document by the share of orders in which the filter is the
    first that it fails.
    """
    said = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    sums = (
        found.join(said, "doc_id", "left")
        .groupBy("part", "failed")
        .agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
        .groupBy("part")
        .agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sums"))
    )
    steps = [
        {"filter_order": "".join(order), "step": i + 1, "own": _bit(order[i]), "before": sum(map(_bit, order[:i]))}
        for order in permutations(FILTERS)
        for i in range(len(FILTERS))
    ]
    shape = "ARRAY<STRUCT<filter_order: STRING, step: INT, own: INT, before: INT>>"
    rows = sums.select("part", "sums", F.inline(F.from_json(F.lit(json.dumps(steps)), shape)))

    def total(value: Callable[[Column], Column], own: bool | None, before: bool | None) -> Column:
        def counts(s: Column) -> Column:
            asked = [(own, s["failed"].bitwiseAND(F.col("own")) > 0), (before, s["failed"].bitwiseAND(F.col("before")) > 0)]
            return reduce(Column.__and__, (c if want else ~c for want, c in asked if want is not None))

        return F.aggregate(F.filter("sums", counts), F.lit(0).cast("long"), lambda x, s: x + value(s))

    n = lambda s: s["n"]
    orders = len(steps) // len(FILTERS)
    alone = F.aggregate(
        F.filter("sums", lambda s: s["failed"] == F.col("own")), F.lit(0).cast("long"), lambda x, s: x + s["n"]
    )
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(n, False, False).alias("kept"),
        total(n, True, False).alias("removed"),
        total(n, True, True).alias("redundant"),
        alone.alias("unique_fails"),
        total(lambda s: s["good"], True, False).alias("good_lost"),
        total(lambda s: s["toxic"], True, False).alias("toxic_lost"),
        # each count divides the orders: the failed filters are first equally often
        total(lambda s: s["n"] * (orders / F.bit_count(s["failed"])).cast("long"), True, None).alias("shapley"),
    )
