"""Digest columns of found spans: ``array<struct<kind, start, end>>`` in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def digest_columns(spans: Column, kinds: tuple[str, ...]) -> dict[str, Column]:
    """Counts of each base kind, the digest of the base spans, and all spans written out."""
    counts = {f"n_{k}": F.size(of_kinds(spans, (k,))).cast("long") for k in kinds}
    base = F.sha2(written(of_kinds(spans, kinds)).cast("binary"), 256)
    return counts | {"base_sha256": base, "spans": written(spans)}
