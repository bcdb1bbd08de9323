"""Costly expressions evaluated once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns, each evaluated exactly once per row.

    The optimizer moves filters below projections and copies the projected expression into
    each use, so JSON text could be parsed a dozen times per row. It does not look into a
    generator's output; unnesting a one-element array gives the same rows and stays put.
    """
    for name, column in columns.items():
        keep = [c for c in df.columns if c != name]
        df = df.select(*keep, F.explode_outer(F.array(column)).alias(name))
    return df
