"""Licence histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.schemas import LICENCES, licence_dimension


def licence_counts(stored: DataFrame) -> DataFrame:
    """(license, n): records per licence code."""
    return stored.groupBy("license").agg(F.count("*").alias("n"))


def zero_filled_licences(counts: DataFrame) -> DataFrame:
    """(code, label, n) for all 17 licences, also those without records, and a row without a
    label for each other code that occurs, NULL included: ``n`` sums to the number of records.

    Rows of the 17 codes are all that is sent to the dimension.
    """
    dimension = licence_dimension(counts.sparkSession)
    listed = F.coalesce(F.col("license").isin([code for code, _, _ in LICENCES]), F.lit(False))
    known = counts.where(listed)
    filled = dimension.join(F.broadcast(known), dimension["code"] == known["license"], "left").select(
        "code", "label", F.coalesce("n", F.lit(0)).alias("n")
    )
    others = counts.where(~listed).select(
        F.col("license").cast("int").alias("code"), F.lit(None).cast("string").alias("label"), "n"
    )
    return filled.unionByName(others)


def licence_histogram(stored: DataFrame) -> DataFrame:
    """Labels with their own counts, largest first, ties by code."""
    return zero_filled_licences(licence_counts(stored)).orderBy(F.desc("n"), "code")
