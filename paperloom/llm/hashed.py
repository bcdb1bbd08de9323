"""Sorted hash arrays: small models that are sent to every task, looked up by array."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing) -> np.ndarray:
    """The rows of ``values`` for ``wanted``, ``missing`` where the sorted ``keys`` lack it."""
    at, hit = find(keys, wanted)
    out = np.empty((len(wanted), *values.shape[1:]), values.dtype)
    out[:] = missing
    out[hit] = values[at[hit]]
    return out


def row_sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``values[rows[i]:rows[i + 1]]``; 0 for an empty row."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[rows[1:]] - total[rows[:-1]]


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as remainder 1."""
    crc = F.crc32(doc_id.cast("string").cast("binary")) % modulus
    return F.coalesce(crc, F.lit(1)).cast("int")


def bounded_sample(labelled: DataFrame, label: str, key: Column, most: int) -> DataFrame:
    """About ``most`` rows of each label, by a hash of ``key``; all where there are fewer.

    Labels are counted first (one small row each), then a row stays when its hash falls below
    the label's share. No label's rows meet in one task.
    """
    counted = [r for r in labelled.groupBy(label).count().collect() if r[label] is not None]
    share = F.lit(0.0)
    for r in counted:
        share = F.when(F.col(label) == F.lit(r[label]), F.lit(min(1.0, most / r["count"]))).otherwise(share)
    draw = F.pmod(F.xxhash64(key, F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.where(F.col(label).isNotNull() & (draw < share))
